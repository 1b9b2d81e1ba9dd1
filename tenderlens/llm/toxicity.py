"""Operator 7: a toxicity classifier regularised by counterfactuals.

A bounded sample of labelled documents (the ``sample`` training rows of least hash) is cut in
words on the executors.  A document's features are its words, and for each beginning of three
or five letters whether at least one word, 0.5 % or 2 % of its words begin so (inflected and
compound insults share a beginning).  The model's size is bounded as its sample is: of the
features that at least ``least`` sampled documents hold and that tell the labels apart (a
two-proportion z of ``z_least``), the ``vocabulary`` of greatest z are used, and all identity terms.
Every sampled document that names a group also yields its counterfactual, with each identity
term swapped for another of its family.  A logistic regression on feature presence is fitted with
an L2 penalty and ``swap_weight`` times the squared change of the linear score under the swap,
so that naming a group cannot by itself move the score.  The documents are scored in batches,
from the distinct words of each batch, with weights of bounded size.

Null and empty texts get the score of a document without any known word.  Without training
rows of both labels every score is the base rate (0 without rows).  Very long texts are scored
whole; ties of z go to the first feature by name; null doc_ids are scored; repeated rows get equal
scores; an empty table gives an empty result.  ``toxicity`` reads doc_id and text only, and
``drop_toxic`` keeps all columns of the rows it keeps, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, id_text, ship, slices

ship(__name__)

SAMPLE, LEAST, Z_LEAST, VOCABULARY = 16_384, 8, 4.0, 512
SPLIT = r"[^\p{L}\p{N}]+"
#: Identity terms by family, in English, German, French and Spanish; a counterfactual swaps a term for the next of its family (fixed values).
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"), ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"),
    ("immigrants", "locals", "refugees", "citizens"), ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
    ("frauen", "männer"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"), ("schwule", "lesben", "heterosexuelle"),
    ("ausländer", "einheimische", "flüchtlinge", "bürger"), ("behinderte", "gehörlose", "autisten"),
    ("femmes", "hommes"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"), ("noirs", "blancs", "asiatiques", "africains", "arabes"),
    ("immigrés", "réfugiés", "citoyens"), ("handicapés", "sourds", "aveugles", "autistes"),
    ("mujeres", "hombres"), ("niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"), ("negros", "blancos", "asiáticos", "africanos", "árabes"),
    ("inmigrantes", "refugiados", "ciudadanos"), ("discapacitados", "sordos", "ciegos", "autistas"),
)
SWAP: dict[str, str] = {}
for family in IDENTITIES:
    for word, other in zip(family, family[1:] + family[:1], strict=True):
        SWAP.setdefault(word, other)


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Lower-cased runs of letters and digits of each text."""
    return pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), SPLIT)


def features(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(names, row, code): parts of the features of each text, as distinct pairs of row and code in names."""
    lists = word_lists(texts)
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    code = words.indices.to_numpy().astype(np.int64)
    real = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    row, code = row[real], code[real]
    total = np.bincount(row, minlength=len(texts))
    pairs = np.unique(row << 32 | code)
    yield words.dictionary, pairs >> 32, pairs & 0xFFFFFFFF
    for letters in (3, 5):
        starts = pc.utf8_slice_codeunits(words.dictionary, 0, letters).dictionary_encode()
        own = starts.indices.to_numpy().astype(np.int64)[code] if len(code) else code
        pairs, number = np.unique(row << 32 | own, return_counts=True)
        share = number / np.maximum(total[pairs >> 32], 1)
        for mark, level in (("", 0.0), ("%", 0.005), ("%%", 0.02)):
            kept = pairs[share >= level]
            yield pc.binary_join_element_wise(f"{letters}{mark}", starts.dictionary, "^"), kept >> 32, kept & 0xFFFFFFFF


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, label, text) to one row (row, label, word) for each feature of a text."""
    for batch in (part for whole in batches for part in slices(whole, "text")):
        for names, row, code in features(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(row)), batch.column("label").take(pa.array(row)), names.take(pa.array(code))], ["row", "label", "word"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int) -> DataFrame:
    """(row, label, text) of at most ``sample`` labelled documents outside the held-out fold."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    own = own.filter(F.crc32(id_text()) % folds != held).dropDuplicates(["doc_id", "label"])
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most ``sample`` rows
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(F.col("doc_id").alias("row"), "label", "text")


def fit(x: np.ndarray, y: np.ndarray, change: np.ndarray, swap_weight: float, ridge: float, rounds: int = 60, step_rows: int = 1024) -> np.ndarray:
    """Newton steps for the logistic loss, ridge and counterfactual penalty; the last weight is the intercept.

    ``x`` and ``change`` may be of small integers: a few rows at a time become floating.
    """
    cols = x.shape[1] + 1
    parts = range(0, len(x), step_rows)
    flat = np.diag(np.append(np.full(cols - 1, ridge), 1e-6))
    for i in range(0, len(change), step_rows):
        c = change[i : i + step_rows].astype(float)
        flat[:-1, :-1] += swap_weight * c.T @ c
    w = np.zeros(cols)
    for _ in range(rounds):
        curve, slope = flat.copy(), flat @ w
        for i in parts:
            part = np.column_stack([x[i : i + step_rows], np.ones(len(x[i : i + step_rows]))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve += part.T @ (part * (p * (1 - p))[:, None])
            slope += part.T @ (p - y[i : i + step_rows])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def model(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, sample: int = SAMPLE, least: int = LEAST, z_least: float = Z_LEAST, vocabulary: int = VOCABULARY, swap_weight: float = 10.0, ridge: float = 0.005) -> tuple[dict[str, float], float]:
    """(weight of each word, intercept)."""
    rows = training_rows(docs, labels, label, folds, held, sample)
    kind = rows.schema["row"].dataType.simpleString()
    words = durable(rows.mapInArrow(feature_rows, f"row {kind}, label int, word string"))
    totals = words.groupBy("label").agg(F.count_distinct("row").alias("n")).collect()
    n = {r["label"]: r["n"] for r in totals}
    if len(n) < 2:
        rate = 1.0 if 1 in n else 0.0
        return {}, math.inf if rate else -math.inf
    n1, n0 = n[1], n[0]
    counted = words.groupBy("word").agg(F.sum(F.col("label").cast("bigint")).alias("a"), F.sum(1 - F.col("label")).alias("b"))
    rate = (F.col("a") + F.col("b")) / F.lit(n0 + n1)
    z = (F.col("a") / F.lit(n1) - F.col("b") / F.lit(n0)) / F.sqrt(rate * (1 - rate) * F.lit(1 / n0 + 1 / n1) + 1e-12)
    told = counted.filter((F.col("a") + F.col("b") >= least) & (F.abs(z) >= z_least)).orderBy(F.abs(z).desc(), "word").limit(vocabulary)
    group_starts = {f"{n}{mark}^{w[:n]}" for w in SWAP for n in (3, 5) for mark in ("", "%", "%%")}  # a swap must change nothing but its terms
    names = sorted({r["word"] for r in told.select("word").collect()} - group_starts | set(SWAP))  # at most ``vocabulary`` and the terms
    index = {w: i for i, w in enumerate(names)}
    spark = docs.sparkSession
    known = F.broadcast(spark.createDataFrame(list(index.items()), "word string, at int"))
    sets = words.join(known, "word").groupBy("row", "label").agg(F.collect_set("at").alias("at")).select("label", "at").toArrow()  # at most ``sample`` rows of small numbers
    label, lists = sets.column("label").to_numpy(), sets.column("at").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    at, row = lists.values.to_numpy(), np.repeat(np.arange(len(size)), size)
    x = np.zeros((len(size), len(names)), np.int8)
    x[row, at] = 1
    y = label.astype(float)
    shown = {k: int((label == k).sum()) for k in (0, 1)}
    swap = np.array([index[SWAP.get(w, w)] for w in names], np.int64)
    named = np.isin(np.arange(len(size)), row[np.isin(at, [index[w] for w in SWAP])])  # texts with an identity term
    swapped = np.zeros_like(x)
    swapped[row, swap[at]] = 1
    change = (swapped - x)[named]
    del swapped
    bare = [k for k in (0, 1) for _ in range(n[k] - shown[k])]  # documents without any word of the vocabulary
    x, y = np.vstack([x, np.zeros((len(bare), x.shape[1]), np.int8)]), np.append(y, bare)
    w = fit(x, y, change, swap_weight, ridge)
    return {v: float(w[i]) for v, i in index.items() if abs(w[i]) > 1e-6}, float(w[-1])


def scores(weights: dict[str, float], intercept: float):
    known = pa.array(weights.keys(), pa.string())
    values = np.array([*weights.values(), 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            linear = np.full(batch.num_rows, intercept)
            for names, row, code in features(batch.column("text")):
                weight = values[pc.fill_null(pc.index_in(names, known), len(known)).to_numpy()] if len(names) else values
                linear += np.bincount(row, weight[code], batch.num_rows)
            with np.errstate(over="ignore"):
                score = 1 / (1 + np.exp(-linear))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1, **settings) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    weights, intercept = model(docs, labels, folds=folds, held=held, **settings)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(scores(weights, intercept), f"doc_id {kind}, score double")
    return out.select("doc_id", (F.crc32(id_text()) % folds == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **settings) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns, scored in passing, without a join."""
    weights, intercept = model(docs, labels, **settings)
    score = scores(weights, intercept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            own = next(score(iter([batch])))
            yield batch.filter(pc.less(own.column("score"), threshold))

    return docs.mapInArrow(run, docs.schema)
