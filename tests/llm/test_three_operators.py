"""Centroid clustering, the n-gram Jaccard join and hard negatives against brute force, and on odd inputs."""

import collections
import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tenderlens.llm import centroids, hard_negatives, jaccard_join

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, rank int, key string"


def some_vectors(n=400, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims))
    x = middles[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dims))
    x[n // 2 : n // 2 + n // 4] = x[7]  # a large group of equal vectors: ties everywhere
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def odd_vectors(dims=8):
    fine = [0.5, -0.5, 0.25, 0.0, 1.0, -1.0, 0.125, 0.75]
    rows = [(1, fine), (1, fine), (2, None), (3, []), (4, fine[:-1]), (5, [*fine[:-1], None]), (6, [*fine[:-1], float("nan")]), (7, [*fine[:-1], float("inf")]), (8, [0.0] * dims), (None, fine), (50, fine), (100, [-x for x in fine])]
    return [(i, v, None if k % 5 == 4 else k % 2, None, None, "k") for k, (i, v) in enumerate(rows)]


def lloyd(rows, k, rounds, scale):
    """Plain k-means with the rules of the operator."""
    x = {i: np.floor(v.astype(np.float64) * scale).astype(np.int64) for i, v in rows}
    c = [x[i] for i in sorted(x, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]]
    for r in range(rounds + 1):
        d = {i: [int(((v - m) ** 2).sum()) for m in c] for i, v in x.items()}
        near = {i: (min(range(len(c)), key=lambda j: (e[j], j))) for i, e in d.items()}
        if r == rounds:
            return {i: (near[i], d[i][near[i]], hashlib.sha256(",".join(map(str, c[near[i]].tolist())).encode()).hexdigest()) for i in x}
        for j in range(len(c)):
            own = [x[i] for i in x if near[i] == j]
            if own:
                c[j] = np.array([int(s) // len(own) for s in np.sum(own, axis=0)])


@pytest.mark.parametrize("k", [1, 5, 16])
def test_centroids(spark, k):
    x = some_vectors()
    rows = list(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist(), 0, None, None, None) for i, v in rows], VECTORS).repartition(5)
    got = centroids.clusters(df, k=k, dims=8).collect()
    want = lloyd(rows, k, 3, 64)
    assert {r["vec_id"]: (r["cluster"], r["distance"], r["centroid_sha256"]) for r in got} == want
    assert {r["inertia"] for r in got} == {sum(d for _, d, _ in want.values())}
    per = collections.Counter()
    for c, d, _ in want.values():
        per[c] += d
    assert all(r["cluster_inertia"] == per[r["cluster"]] for r in got)


def test_threshold_algorithm_is_exact():
    rng = np.random.default_rng(5)
    for k, dims, top in ((1, 3, 4), (7, 4, 3), (40, 6, 50), (300, 2, 9)):
        x, c = rng.integers(-top, top, (500, dims)), rng.integers(-top, top, (k, dims))
        number, best = centroids.nearest(x, c)
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_centroids_odd(spark):
    df = spark.createDataFrame(odd_vectors(), VECTORS).repartition(3)
    got = centroids.clusters(df, dims=8).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "100", "50", "8", "None"] and all(r["distance"] == 0 for r in got)
    assert centroids.clusters(df.filter("false"), dims=8).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        centroids.clusters(spark.createDataFrame([(1, [1e9] * 8, 0, None, None, None)], VECTORS), dims=8).count()


def shingle_sets(texts, n=4):
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        yield frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_join(ids, texts, up=85, down=100):
    sets = list(shingle_sets(texts))
    label, links = list(range(len(ids))), [0] * len(ids)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and down * both >= up * (len(sets[i]) + len(sets[j]) - both):
            links[i] += 1
            links[j] += 1
            label[max(find(i), find(j))] = min(find(i), find(j))
    least = collections.defaultdict(lambda: None)
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = i if least[r] is None or (i is not None and i < least[r]) else least[r]
    return [(i, len(sets[k]), least[find(k)], links[k]) for k, i in enumerate(ids)]


def near_texts(seed=11):
    """Chains, groups of near copies, a passage that all share, contiguous and scattered edits, copies in another case."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(14):
        base = rng.choices(words, k=rng.choice([3, 12, 60, 150, 400])) + (passage if rng.random() < 0.6 else [])
        for _ in range(rng.choice([1, 2, 8])):
            w = list(base)
            if rng.random() < 0.5:
                for _ in range(rng.randrange(0, max(2, len(w) // 40))):
                    w[rng.randrange(len(w))] = rng.choice(words)
            else:
                at = rng.randrange(len(w))
                w[at:at] = rng.choices(words, k=rng.randrange(0, max(2, len(w) // 8)))
            texts.append(" ".join(w) if rng.random() < 0.8 else "\t\n".join(w).upper())
    return texts


@pytest.mark.parametrize("members,load", [(4096, 1 << 19), (3, 200)])
def test_jaccard_join(spark, members, load):
    texts = near_texts()
    texts += texts[:20] + [None, "", " \n", "one two", "One Two", "one two three"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, node string, size string").repartition(5)
    got = [tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "n_links")) for r in jaccard_join.jaccard_join(df, members=members, load=load).collect()]
    want = brute_join(list(range(len(texts))), texts)
    assert sorted(got) == sorted(want) and len({w[2] for w in want}) < len(want) - 30


@pytest.mark.parametrize("up", [60, 85, 95])
def test_bitmaps_lose_no_pair(up):
    """Every pair of a tile that links passes sizes and bitmaps, in long and short bitmaps."""
    rng = np.random.default_rng(up)
    base = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (3, 63, 64, 65, 130, 500, 1025)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > p], rng.integers(0, 1 << 62, int(p * len(b))).astype(np.uint64)])) for b in base for p in (0, 0.02, 0.05, 0.1, 0.2, 0.3)]
    sets = sorted((s for s in sets if len(s)), key=len)
    size = np.array([len(s) for s in sets])
    zero = np.zeros(len(sets), np.int64)
    for share in (1, 2):
        bits, begin = jaccard_join.flat_bits([jaccard_join.bitmap(s, share) for s in sets])
        found = {(i, j) for a, b in jaccard_join.passing(zero, zero, zero, zero, size, bits, begin, (up, 100)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= up * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in found
        assert len(found) < len(sets) * (len(sets) - 1) // 2


def test_jaccard_join_odd(spark):
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(None, "No id here."), (None, None), (5, long_text), (4, long_text.upper()), (7, "Same text."), (7, "Same text."), (9, "a-" * 50_000), (10, "x" * 300_000), (11, "ab | " * 3000)]
    df = spark.createDataFrame([(i, t, None, 1, 2) for i, t in rows], "doc_id bigint, text string, key string, own int, bits int").repartition(3)
    got = collections.Counter((r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.jaccard_join(df).collect())
    assert got == {(None, None, 0): 2, (5, 4, 1): 1, (4, 4, 1): 1, (7, 7, 1): 2, (9, 9, 0): 1, (10, 10, 0): 1, (11, 11, 0): 1}
    assert jaccard_join.jaccard_join(df.filter("false")).count() == 0


def brute_negatives(rows, every, noisy, labels, scale, most, fewest):
    x = {i: np.floor(np.array(v, np.float32).astype(np.float64) * scale) for i, v, _ in rows}
    label = {i: (y + 1) % labels if i % noisy == 0 else y for i, _, y in rows}
    out = set()
    for a in x:
        if a % every:
            continue
        score = {i: int(x[a] @ v) for i, v in x.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:most]:
            fit = [i for i in order if label[i] != label[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(fit[:fewest])}
    return out


@pytest.mark.parametrize("sample,fan,leaf,chunk", [(8192, 12, 512, 4096), (100, 3, 10, 7), (5, 2, 1, 1000)])
def test_hard_negatives(spark, sample, fan, leaf, chunk):
    x = some_vectors(300)
    rng = random.Random(1)
    rows = [(i, v.tolist(), rng.randrange(10) if i < 290 else 77) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, y, None, None, None) for i, v, y in rows], VECTORS).repartition(5)
    got = hard_negatives.hard_negatives(df, every=10, sample=sample, fan=fan, leaf=leaf, chunk=chunk).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = brute_negatives(rows, 10, 7, 10, 256, 5, 3)
    assert {tuple(r[c] for c in names) for r in got} == want and len(got) == len(want)


def test_tree_prunes_and_keeps(spark):
    """In clustered data the ranges drop most leaves, and never one that holds a wanted row."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.normal(size=(40, 1, 4)) + 0.01 * rng.normal(size=(40, 50, 4)))).reshape(-1, 4)
    tree = hard_negatives.grow(x[::3], 60, 5, [0])
    df = spark.createDataFrame([(v.astype(int).tolist(),) for v in x], "vector array<int>")
    hard_negatives.measure(df, tree)
    leaf = hard_negatives.descend(tree, x)
    q = x[::17]
    product = q @ x.T
    high = np.sort(product, axis=1)[:, -20].astype(float)
    left = hard_negatives.survivors(tree, q, high, np.full(len(q), 2.0**62))
    assert all(set(leaf[product[i] >= high[i]].tolist()) <= set(left[i].tolist()) for i in range(len(q)))
    assert sum(map(len, left)) < 0.5 * len(q) * len(set(leaf.tolist()))


def test_hard_negatives_odd(spark):
    df = spark.createDataFrame(odd_vectors(), VECTORS).repartition(3)
    assert hard_negatives.hard_negatives(df).count() >= 0
    assert hard_negatives.hard_negatives(df.filter("false")).count() == 0
    twice = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (51, [1.0, 0.0], 1), (52, [0.75, 0.0], 2), (52, [0.75, 0.0], 2), (53, [0.75, 0.0], 3)]
    got = hard_negatives.hard_negatives(spark.createDataFrame([(i, v, y, None, None, None) for i, v, y in twice], VECTORS)).collect()
    assert [(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(50, 51, 1, 52), (50, 51, 2, 53)]


def test_hard_negatives_holds_few_anchors(spark):
    """A shard's anchors are answered as they come, not gathered, and an anchor is sent to a shard once."""
    rng = np.random.default_rng(5)
    x = rng.integers(-99, 99, (60, 4))
    ids = np.arange(60)
    one = lambda v, kind: pa.array([v], kind)
    fields = [("shard", "bigint"), ("leaf", "int"), ("anchor_id", "bigint"), ("vec_id", "bigint"), ("label", "bigint"), ("vector", "array<int>"), ("low", "array<bigint>"), ("high", "array<bigint>"), ("leaves", "array<int>")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}
    names = [n for n, _ in fields]
    row = lambda *v: pa.RecordBatch.from_arrays([one(a, kinds[k]) for a, (_, k) in zip(v, fields, strict=True)], names)
    rows = [row(0, i % 2, None, i, i % 3, v.tolist(), None, None, None) for i, v in enumerate(x)]
    asks = [row(0, None, i, None, i % 3, x[i].tolist(), [-(1 << 62)], [1 << 62], [0, 1]) for i in range(40)]
    taken, out = [], []

    def feed():
        for b in [*rows, *asks]:
            taken.append(b)
            yield b

    for part in hard_negatives.scan(False, 3, 8)(feed()):
        assert part.num_rows <= 8 * 3 and len(taken) <= len(rows) + len(out) + 1
        out.append(part)
    got = {(r["anchor_id"], r["vec_id"]) for b in out for r in b.to_pylist()}
    score = x @ x.T
    assert got == {(i, j) for i in range(40) for j in sorted((k for k in ids if k % 3 != i % 3), key=lambda k: (-score[i, k], k))[:3]}
    tree = hard_negatives.grow(x.astype(float), 30, 3, [0])
    anchors = spark.createDataFrame([(i, 0, v.tolist(), 0, [-(1 << 62)], [1 << 62]) for i, v in enumerate(x)], "anchor_id bigint, label bigint, vector array<int>, leaf bigint, low array<bigint>, high array<bigint>")
    hard_negatives.measure(anchors, tree)
    n = tree.last + 1
    sent = hard_negatives.visits(anchors, tree, np.zeros(n, int), np.zeros(n, int), False)
    assert n > 5 and sent.count() == 60
