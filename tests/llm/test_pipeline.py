"""The pipeline stage by stage against brute force, and its queries against their SQL twins."""

import collections
import random
import re

import pytest
from compare import rows, twin

import corpus_pipeline
from tenderlens.llm import toxicity
from tenderlens.llm.mixing import mixed
from tenderlens.llm.queries import ORACLE, QUERIES, tokenizer

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic rows, copies that differ in case, near copies and three sources; labels for most of them."""
    rng = random.Random(21)
    calm = [f"calm{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(300):
        words = rng.choices(calm, k=rng.choice([8, 60, 200]))
        if i % 9 == 0:
            words[3:3] = ["idiot", "scum", "idiot"]
        docs.append((i, " ".join(words), "en", ["a", "b", None][i % 3], 0))
        labels.append((i, 1, int(i % 9 == 0)))
    for i in range(60):
        docs.append((1000 + i, docs[i * 2 + 1][1].upper(), "en", "b", 0))
    for i in range(40):
        w = docs[i * 3 + 2][1].split()
        if len(w) >= 200:
            w[50] = "changed"
        docs.append((2000 + i, " ".join(w), "en", "a", 0))
    docs += [(None, None, None, None, None), (3000, "", "en", "a", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def shingled(text):
    w = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "").split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_stages_equal_brute_force(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")

    def step(name, df):
        out = STAGES[name](spark, df, corpus)
        if name != "pack":
            assert out.columns == df.columns
        path = f"{corpus}/{name}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    calm = step("toxicity", docs)
    scored = toxicity.toxicity(docs, labels).collect()
    assert collections.Counter(r["doc_id"] for r in calm.collect()) == collections.Counter(r["doc_id"] for r in scored if r["predicted"] == 0)
    assert {r["doc_id"] for r in calm.collect()} >= {i for i in range(300) if i % 9} and not any(r["doc_id"] in range(0, 300, 9) for r in calm.collect())

    single = step("exact_dedup", calm)
    groups = collections.defaultdict(list)
    for r in calm.collect():
        groups[re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")].append(-1 if r["doc_id"] is None else r["doc_id"])
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in single.collect()) == sorted(max(g) for g in groups.values())

    kept = step("simhash_dedup", single)
    texts = {r["doc_id"]: shingled(r["text"]) for r in single.collect() if r["doc_id"] is not None}
    ids, root = sorted(texts), {i: i for i in texts}
    for n, b in enumerate(ids):
        for a in ids[:n]:
            both = len(texts[a] & texts[b])
            if texts[a] == texts[b] or 5 * both >= 4 * (len(texts[a]) + len(texts[b]) - both):
                low, high = min(root[a], root[b]), max(root[a], root[b])
                root = {i: low if r == high else r for i, r in root.items()}
    want, got = {i for i in ids if root[i] == i}, {r["doc_id"] for r in kept.collect()} - {None}
    assert want <= got and len(got - want) <= 0.1 * (len(ids) - len(want)) and len(want) < len(ids)

    taken = step("mix", kept)
    plan = {r["doc_id"]: r["taken"] // r["size"] for r in mixed(kept).collect() if r["size"]}
    assert collections.Counter(r["doc_id"] for r in taken.collect()) == collections.Counter({i: n for i, n in plan.items() if n})

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    pieces = step("pack", taken).collect()
    lengths = {r["doc_id"]: len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in taken.dropDuplicates(["doc_id"]).collect()}
    packed = collections.Counter()
    for r in pieces:
        packed[r["doc_id"]] += r["length"]
    assert packed == collections.Counter({i: lengths[i] * n for i, n in plan.items() if n})
    ends = collections.defaultdict(list)
    for r in pieces:
        ends[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert all(sorted(e)[0][0] == 0 and sorted(e)[-1][1] <= 2048 and all(x[1] == y[0] for x, y in zip(sorted(e), sorted(e)[1:], strict=False)) for e in ends.values())


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        n = out.count()
        if name != "pack":
            assert 0 < n <= before * (3 if name == "mix" else 1), name
        docs, before = out, n


def test_pipeline_runs(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.filter("offset + length > 2048").count() == 0 and out.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, data, name):
    assert rows(QUERIES[name](spark, data).toPandas()) == rows(twin(ORACLE[name], data))
