"""Vector and hybrid retrieval over given embeddings: exact nearest neighbours in blocks, re-ranking and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import word_list
from ..functions.storage import durable


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` and ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def slices(batches: Iterator[pd.DataFrame], most: int = 1024) -> Iterator[pd.DataFrame]:
    """The rows in frames of at most ``most``, so that their distances to all pivots stay few in memory."""
    for pdf in batches:
        for i in range(0, len(pdf), most):
            yield pdf.iloc[i : i + most]


def cells(vectors: DataFrame, pivots: np.ndarray, key: str) -> DataFrame:
    """(key, v, cell, away): the nearest pivot of each vector and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            d = distances(np.stack(list(pdf["v"])), pivots)
            at = d.argmin(1)
            yield pdf.assign(cell=at, away=np.sqrt(d[np.arange(len(at)), at]))

    return vectors.mapInPandas(run, f"{key} bigint, v array<double>, cell int, away double")


def reach(q: np.ndarray, most: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which cells may hold a vector within ``most`` of each query.

    A cell is a ring about its pivot, and lies behind the plane half-way between its pivot and the
    query's.  The slack is above the rounding of roots of vectors of this length and of ties at
    nine decimals, so that neither loses a row.
    """
    d2, between = distances(q, pivots), distances(pivots, pivots)
    d, home = np.sqrt(d2), d2.argmin(1)
    known = high >= low
    longest = np.sqrt((pivots * pivots).sum(1).max()) + (high[known].max() if known.any() else 0)
    slack = 1e-6 * (1 + longest + np.sqrt((q * q).sum(1)))[:, None]
    ring = np.maximum(low[None] - d, d - high[None])
    gap = np.sqrt(between[home])
    plane = np.divide(d2 - d2.min(1)[:, None], 2 * gap, out=np.zeros_like(d2), where=gap > slack)
    return (np.maximum(ring, plane) <= np.sqrt(most * most + 2e-9)[:, None] + slack) & known[None]


def best_of_block(met: DataFrame, k: int, key: str) -> DataFrame:
    """The ``k`` nearest of a block's vectors to each of its queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d_rows, q_ids, q_vecs in zip(pdf["d_ids"].items(), pdf["q_ids"], pdf["q_vectors"], strict=True):
                ids, d, q = np.asarray(d_rows[1]), np.stack(list(pdf["d_vectors"][d_rows[0]])), np.stack(list(q_vecs))
                dist = distances(q, d)
                order = np.lexsort((np.broadcast_to(ids, dist.shape), np.round(dist, 9)), axis=1)[:, :k]
                yield pd.DataFrame({"query": np.repeat(np.asarray(q_ids), order.shape[1]), key: ids[order].ravel(), "distance": np.take_along_axis(dist, order, 1).ravel()})

    return met.mapInPandas(run, f"query bigint, {key} bigint, distance double")


class Neighbours:
    """Exact squared-L2 neighbours among ``vectors``, indexed by the cells of pivots.

    At most ``most`` pivots, about twice the root of the number of vectors, are the vectors with
    the least hashes of their ids; every vector goes to the cell of its nearest one, and a cell is
    dealt in blocks of about ``block`` vectors.  Only the pivots and each cell's size and ring
    (least and largest distance to its pivot) are known to the driver and to each task: that is
    ``most`` vectors, whatever the number of rows.  Null vectors take no part.
    """

    def __init__(self, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", most: int = 1024, block: int = 4096):
        if block < k:
            raise ValueError("a block must hold k vectors")
        self.k, self.key, self.vector = k, key, vector
        v = self.narrow(vectors)
        wanted = min(most, max(1, round(2 * v.count() ** 0.5)))
        chosen = v.orderBy(F.xxhash64(key), key).limit(wanted).collect()  # at most ``most`` vectors
        self.pivots = np.array([r["v"] for r in chosen]) if chosen else np.zeros((1, 1))
        self.placed = durable(cells(v, self.pivots, key))
        known = self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()  # one row per pivot
        self.n, self.low, self.high = np.zeros(len(self.pivots), int), np.full(len(self.pivots), np.inf), np.full(len(self.pivots), -np.inf)
        for r in known:
            self.n[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["low"], r["high"]
        parts = np.maximum(1, self.n // block)
        self.parts = parts
        count = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cell") + 1)
        dealt = self.placed.withColumn("part", F.pmod(F.xxhash64(key, F.lit(1)), count).cast("int"))
        rows = F.collect_list(F.struct(key, "v")).alias("rows")
        self.blocks = durable(dealt.groupBy("cell", "part").agg(rows).select("cell", "part", F.transform("rows", lambda x: x[key]).alias("d_ids"), F.transform("rows", lambda x: x["v"]).alias("d_vectors")))

    def narrow(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.vector).isNotNull()).select(F.col(self.key).cast("bigint").alias(self.key), F.col(self.vector).cast("array<double>").alias("v"))

    def asked(self, visits: DataFrame, query_block: int) -> DataFrame:
        """(cell, part) with the ids and vectors of at most about ``query_block`` queries."""
        group = F.collect_list(F.struct("query", "v")).alias("rows")
        return visits.groupBy("cell", "part", "deal").agg(group).select("cell", "part", F.transform("rows", lambda x: x["query"]).alias("q_ids"), F.transform("rows", lambda x: x["v"]).alias("q_vectors"))

    def home(self, queries: DataFrame) -> DataFrame:
        """Each query's first block: one that holds k vectors, of its nearest cell with so many; none if no cell has them."""
        pivots, n, parts, k = self.pivots, self.n, self.parts, self.k

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in slices(batches):
                if (n >= k).any():
                    d = np.where(n >= k, distances(np.stack(list(pdf["v"])), pivots), np.inf)
                    at = d.argmin(1)
                    yield pdf.assign(cell=at, part=pdf["query"].to_numpy() % parts[at])

        return queries.mapInPandas(run, "query bigint, v array<double>, deal bigint, cell int, part int")

    def visits(self, queries: DataFrame, bounds: DataFrame) -> DataFrame:
        """The blocks that may still hold one of a query's k nearest; ``bounds`` (query, most) are distances that k vectors keep."""
        pivots, low, high, parts = self.pivots, self.low, self.high, self.parts

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in slices(batches):
                if (high >= low).any():  # an empty index has no cells
                    row, cell = np.nonzero(reach(np.stack(list(pdf["v"])), pdf["most"].to_numpy(dtype=float), pivots, low, high))
                    times = parts[cell]
                    row, cell = np.repeat(row, times), np.repeat(cell, times)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    for i in range(0, len(row), 10_000):  # a query may reach every block
                        s = slice(i, i + 10_000)
                        yield pdf[["query", "v", "deal"]].iloc[row[s]].assign(cell=cell[s], part=part[s])

        open_ = queries.join(bounds, "query", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        return open_.mapInPandas(run, "query bigint, v array<double>, deal bigint, cell int, part int")

    def search(self, queries: DataFrame, query_block: int = 1024) -> tuple[DataFrame, DataFrame]:
        """(query, key, distance, rank) and the visits (query, cell, part) after the first block; ties by the least key.

        The k-th distance in a query's first block bounds what is looked for; every other block
        that the bound reaches is searched, and passes on only its k best of each query.
        """
        k, key = self.k, self.key
        q = durable(self.narrow(queries).withColumnRenamed(key, "query").withColumn("deal", F.floor(F.monotonically_increasing_id() / F.lit(query_block))))
        first = durable(self.home(q))
        near = durable(best_of_block(self.asked(first, query_block).join(self.blocks, ["cell", "part"]), k, key))
        bounds = near.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("distance"))).alias("most"))
        more = durable(self.visits(q, bounds).join(first.select("query", "cell", "part"), ["query", "cell", "part"], "left_anti"))
        rest = best_of_block(self.asked(more, query_block).join(self.blocks, ["cell", "part"]), k, key)
        place = F.row_number().over(W.partitionBy("query").orderBy(F.round("distance", 9), key))
        return near.unionByName(rest).withColumn("rank", place).filter(F.col("rank") <= k), more.select("query", "cell", "part")


def knn(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_block: int = 1024, block: int = 4096) -> DataFrame:
    """Exact squared-L2 neighbours: (query, key, distance, rank), ties by the least key; see ``Neighbours``."""
    return Neighbours(vectors, k, key, vector, block=block).search(queries, query_block)[0]


def cosine_of(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return dot / (norm(a) * norm(b))


def rerank(found: DataFrame, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """0.3 of the normalised closeness within a query and 0.7 of the cosine."""
    v = vectors.select(key, vector)
    j = found.join(v, key).join(v.select(F.col(key).alias("query"), F.col(vector).alias("qv")), "query").withColumn("cosine", cosine_of(F.col(vector), F.col("qv")))
    w, near = W.partitionBy("query"), 1 - F.col("distance")
    low, high = F.min(near).over(w), F.max(near).over(w)
    scaled = F.when(high > low, (near - low) / F.when(high > low, high - low)).otherwise(1.0)
    return j.select("query", key, "rank", "cosine", (0.3 * scaled + 0.7 * F.col("cosine")).alias("semantic"))


def tfidf(found: DataFrame, docs: DataFrame, key: str = "vec_id") -> DataFrame:
    """Cosine of TF-IDF rows (smooth idf over the query's candidates and itself) of each candidate with the query's text."""
    members = durable(found.select("query", key).unionByName(found.select("query", F.col("query").alias(key))).distinct())
    wanted = docs.withColumnRenamed("doc_id", key).join(members.select(key).distinct(), key, "left_semi")  # only the candidates' texts are cut in words
    text = wanted.select(key, F.explode(word_list(F.col("text"))).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("tf"))
    rows = members.join(text, key)
    n = members.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    df = rows.groupBy("query", "w").agg(F.count(F.lit(1)).alias("df"))
    weighed = rows.join(df, ["query", "w"]).join(n, "query").withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = weighed.groupBy("query", key).agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    own = weighed.filter(F.col(key) == F.col("query")).select("query", "w", F.col("x").alias("qx"))
    dot = weighed.join(own, ["query", "w"]).groupBy("query", key).agg(F.sum(F.col("x") * F.col("qx")).alias("dot"))
    qn = norms.filter(F.col(key) == F.col("query")).select("query", F.col("norm").alias("qn"))
    out = found.select("query", key).join(norms, ["query", key], "left").join(dot, ["query", key], "left").join(qn, "query", "left")
    return out.select("query", key, F.coalesce(F.col("dot") / (F.col("norm") * F.col("qn")), F.lit(0.0)).alias("lexical"))


def fuse(semantic: DataFrame, lexical: DataFrame, k: int, key: str = "vec_id", c: int = 60) -> DataFrame:
    """Reciprocal rank fusion: relevance in per cent of the best possible, top k of each query."""
    place = lambda col: F.row_number().over(W.partitionBy("query").orderBy(F.round(col, 9).desc(), key))
    j = semantic.join(lexical, ["query", key]).withColumn("r1", place("semantic")).withColumn("r2", place("lexical"))
    j = j.withColumn("relevance", (1 / (c + F.col("r1")) + 1 / (c + F.col("r2"))) / (2 / (c + 1)) * 100)
    top = F.row_number().over(W.partitionBy("query").orderBy(F.round("relevance", 9).desc(), key))
    return j.withColumn("place", top).filter(F.col("place") <= k).select("query", key, "relevance", "place")
