"""Exact neighbours by pivot cells against brute force, with the share of blocks that is searched."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenderlens.operators import retrieval as V


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>").repartition(4)


def brute(x, asked, k):
    out = {}
    for q in asked:
        d = ((x - x[q]) ** 2).sum(1)
        out[q] = [int(i) for i in np.lexsort((np.arange(len(x)), np.round(d, 9)))[:k]]
    return out


def found(result):
    pdf = result.toPandas().sort_values(["query", "rank"])
    return {int(q): [int(i) for i in g["vec_id"]] for q, g in pdf.groupby("query")}


@pytest.mark.parametrize("shape", ["clusters", "uniform", "copies", "line", "far", "hot"])
def test_neighbours_equal_brute_force(spark, shape):
    rng = np.random.default_rng(5)
    n = 3000
    x = {
        "clusters": lambda: rng.integers(0, 40, n)[:, None] * np.array([1.0, 7.0, -3.0, 2.0]) + rng.normal(0, 0.05, (n, 4)),
        "uniform": lambda: rng.random((n, 3)),
        "copies": lambda: rng.integers(0, 3, (n, 3)).astype(float),
        "line": lambda: np.arange(n, dtype=float)[:, None],
        "far": lambda: 1e4 + rng.random((n, 3)),
        "hot": lambda: np.where(rng.random(n)[:, None] < 0.5, 0.25, rng.random((n, 2))),
    }[shape]()
    df = table(spark, x)
    index = V.Neighbours(df, 7, most=64, block=64)
    result, visits = index.search(df.filter("vec_id % 50 = 0"), query_block=16)
    assert found(result) == brute(x, range(0, n, 50), 7)
    blocks, queries, seen = index.blocks.count(), n // 50, visits.count()
    assert visits.distinct().count() == seen
    assert index.blocks.agg(F.max(F.size("d_ids"))).first()[0] <= 64 * 3  # a hot cell is dealt again
    if shape in ("clusters", "line"):
        assert seen + queries < 0.15 * blocks * queries  # the first block and the visits, of all meetings
    if shape == "uniform":
        assert seen + queries < 0.5 * blocks * queries


def test_small_empty_and_null_tables(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    df = table(spark, x)
    assert found(V.knn(df, df, 10)) == brute(x, range(3), 10)  # fewer vectors than k
    odd = df.union(spark.createDataFrame([(9, None)], "vec_id bigint, embedding array<double>"))
    assert found(V.knn(odd, odd, 2)) == brute(x, range(3), 2)
    assert V.knn(df.limit(0), df, 3).count() == 0 and V.knn(df, df.limit(0), 3).count() == 0
    clash = df.withColumn("v", F.lit("x")).withColumn("cell", F.lit(0)).withColumn("query", F.lit(None))
    assert found(V.knn(clash, clash, 2)) == brute(x, range(3), 2)
    with pytest.raises(ValueError):
        V.knn(df, df, 10, block=5)


def test_bounds_never_drop_a_cell_that_holds_a_vector_in_reach():
    rng = np.random.default_rng(8)
    for scale in (1e-6, 1.0, 1e5):
        x, p = scale * rng.normal(size=(500, 3)), scale * rng.normal(size=(20, 3))
        d = V.distances(x, p)
        cell, away = d.argmin(1), np.sqrt(d.min(1))
        rings = pd.DataFrame({"c": cell, "a": away}).groupby("c")["a"].agg(["min", "max"]).reindex(range(20))
        low, high = rings["min"].fillna(np.inf).to_numpy(), rings["max"].fillna(-np.inf).to_numpy()
        q = scale * rng.normal(size=(30, 3))
        true = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
        most = np.sort(true, 1)[:, 9]
        seen = V.reach(q, most, p, low, high)
        assert all(seen[i, c] for i in range(30) for c in cell[true[i] <= most[i]])
