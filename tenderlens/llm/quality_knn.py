"""Operator 2: quality by nearest-neighbour voting among latent-semantic vectors.

A text is counted as pairs of neighbouring character classes over the whole text (each letter,
digits, capitals, each sign, white space, high bytes), with two more terms for the shares of
words equal to the word before and of lines equal to an earlier line.  A bounded sample of
labelled documents (the ``sample`` training rows of least hash) gives the inverse document
frequencies and, by a truncated SVD of its TF-IDF matrix, a latent space of ``dims`` dimensions.
The labelled vectors (sample x dims floats, 1 MB at the defaults) go to every task, which takes
exact cosine products of its documents with all of them, block by block; the ``neighbours`` most
similar vote with their similarity, and so do all that tie with the last of these.

Null and empty texts have no terms and get the share of label 1 in the sample (0 without
labelled rows), as do texts without a similar neighbour.  Very long texts are counted whole.
Null doc_ids are scored and count as held out by the checksum of the empty text; repeated rows get
equal scores; an empty table gives an empty result; columns besides doc_id and text are ignored,
whatever their names.  Labels that are null or have no doc_id are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, ship
from .toxicity import training_rows

ship(__name__)

SAMPLE, DIMS, NEIGHBOURS, BLOCK = 4096, 48, 15, 512
TERMS, SHARE = 4096 + 2, 30.0


def classes() -> np.ndarray:
    """Class of each byte, below 64."""
    table = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            table[b] = 1 + b - 97
        elif "A" <= c <= "Z":
            table[b] = 27
        elif "0" <= c <= "9":
            table[b] = 28
        elif c in "\n\r":
            table[b] = 29
        elif c in " \t\v\f":
            table[b] = 30
        elif 33 <= b < 127:
            table[b] = 31 + sum(1 for k in range(33, b) if not chr(k).isalnum()) % 31
        elif b >= 128:
            table[b] = 62 + b % 2
    return table


def counts(text: bytes, table: np.ndarray) -> np.ndarray:
    """Damped counts of the pairs of classes, 4096 of them, and the two shares of repeats."""
    code = table[np.frombuffer(text, np.uint8)]
    out = np.zeros(TERMS, np.float32)
    if len(code) > 1:
        out[:4096] = np.log1p(np.bincount(code[:-1] << 6 | code[1:], minlength=4096))
        words, lines = text.split(), text.split(b"\n")
        out[4096] = SHARE * sum(map(eq, words, words[1:])) / max(1, len(words))
        out[4097] = SHARE * (1 - len(set(lines)) / len(lines))
    return out


def sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = classes()
    for batch in batches:
        made = [counts((t.as_py() or "").encode(), table) for t in batch.column("text")]
        at = [np.flatnonzero(m) for m in made]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([m[a].tobytes() for m, a in zip(made, at, strict=True)], pa.binary())], ["row", "label", "at", "value"])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def space(x: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(inverse document frequencies, basis of the latent space) of damped counts."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    a = unit(x * idf)
    guess = a.T @ (a @ np.random.default_rng(0).standard_normal((a.shape[1], dims + 8)).astype(np.float32))
    for _ in range(3):
        guess = a.T @ (a @ np.linalg.qr(guess)[0])
    q = np.linalg.qr(guess)[0]
    _, _, rows = np.linalg.svd(a @ q, full_matrices=False)
    return idf, (q @ rows[:dims].T).astype(np.float32)


def vote(vectors: np.ndarray, known: np.ndarray, label: np.ndarray, neighbours: int, base: float) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest, with all ties of the last; exact products of blocks."""
    k = min(neighbours, len(known))
    near = vectors @ known.T
    last = np.partition(near, len(known) - k, axis=1)[:, len(known) - k, None]
    weight = np.where(near >= last, np.maximum(near, 0), 0)
    total = weight.sum(axis=1)
    return np.where(total > 1e-9, weight @ label / np.maximum(total, 1e-9), base)


def score_batches(idf: np.ndarray, basis: np.ndarray, known: np.ndarray, label: np.ndarray, neighbours: int, base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes()
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, BLOCK):
                block = np.stack([counts((t.as_py() or "").encode(), table) for t in batch.column("text").slice(at, BLOCK)])
                scores.append(vote(unit(unit(block * idf) @ basis), known, label, neighbours, base))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(np.concatenate([*scores, np.zeros(0)]).astype(np.float64), 0, 1))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, folds: int = 5, held: int = 0, sample: int = SAMPLE, dims: int = DIMS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    rows = training_rows(docs, labels, label, folds, held, sample)
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(sparse_counts, f"row {kind}, label int, at binary, value binary").collect()  # at most ``sample`` rows
    found.sort(key=lambda r: r["row"])
    x, y = np.zeros((len(found), TERMS), np.float32), np.array([float(r["label"]) for r in found], np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], np.float32)
    base = float(y.mean()) if len(y) else 0.0
    if len(found):
        idf, basis = space(x, min(dims, len(found)))
        known = unit(unit(x * idf) @ basis)
    else:
        idf, basis, known, y = np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)
    own = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(score_batches(idf, basis, known, y, neighbours, base), f"doc_id {own}, score double")
    return out.select("doc_id", (F.crc32(id_text()) % folds == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
