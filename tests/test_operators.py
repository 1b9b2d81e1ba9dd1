"""Operators on small hand-made inputs and properties."""

import numpy as np
from pyspark.sql import functions as F

from tenderlens.operators import graph as G
from tenderlens.operators import learning as L
from tenderlens.operators import prices as P
from tenderlens.operators import sequences as S
from tenderlens.operators import text as X


def test_gini_and_fences(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 100)] + [("b", 5.0), ("b", 5.0), ("c", 1.0)], "g string, x double")
    g = {r["g"]: r["gini"] for r in P.gini(df, ["g"], "x").collect()}
    assert abs(g["a"] - (2 * 414 / 424 - 1.25)) < 1e-9 and abs(g["b"]) < 1e-12 and g["c"] == 0.0
    assert abs(P.global_gini(df, "x").first()["gini"] - sum((2 * i - 8) * x for i, x in enumerate(sorted([1, 2, 3, 100, 5, 5, 1]), 1)) / (7 * 117)) < 1e-9
    f = {r["g"]: r for r in P.fences(df, "g", "x").collect()}
    assert f["a"]["q1"] == 1.75 and f["b"]["q1"] == 0.0


def test_shape_of_equal_values(spark):
    r = P.shape(spark.createDataFrame([("a", 2.0)] * 4, "g string, x double"), "g", "x").first()
    assert (r["skew"], r["kurt"]) == (0.0, -3.0)


def test_seal_and_verify(spark):
    df = spark.createDataFrame([(i, i % 2, f"act{i}") for i in range(20)], "event_id bigint, user_id bigint, action string")
    cols = ["event_id", "user_id", "action"]
    sealed = S.seal(df, "user_id", "event_id", cols)
    assert S.verify(sealed, "user_id", "event_id", cols).filter("fault is not null").count() == 0
    bad = sealed.withColumn("action", F.when(F.col("event_id") == 6, "x").otherwise(F.col("action")))
    assert [(r["event_id"], r["fault"]) for r in S.verify(bad, "user_id", "event_id", cols).filter("fault is not null").collect()] == [(6, "CONTENT_TAMPERED")]


def test_ewma_spike(spark):
    df = spark.createDataFrame([("a", i, 10.0 if i != 10 else 100.0) for i in range(25)], "k string, i int, v double")
    assert S.ewma(df, "k", ["i"], "v", 5).orderBy(F.desc("residual")).first()["i"] == 10


def test_grid_components_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(5, 0.3, (120, 2)), rng.uniform(-8, 8, (80, 2))])
    near = ((pts[:, None] - pts[None]) ** 2).sum(-1) <= 0.25
    label = np.arange(len(pts))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(pts))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k bigint, x double, y double")
    got = {r["node"]: r["component"] for r in G.components(G.grid_edges(df, "k", "x", "y", 0.5)).collect()}
    assert all(got.get(i, i) == label[i] for i in range(len(pts)))
    assert {r["node"]: r["component"] for r in G.grid_components(df, "k", "x", "y", 0.5).collect()} == got


def test_neighbour_counts_equal_brute_force(spark):
    pts = np.random.default_rng(6).normal(0, 1, (200, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k bigint, x double, y double")
    got = {r["k"]: r["links"] for r in G.neighbour_counts(df.filter("k % 10 = 0"), df, "k", "x", "y", 0.5, 7, 32).collect()}
    assert got == {i: int((((pts - pts[i]) ** 2).sum(1) <= 0.25).sum()) - 1 for i in range(0, 200, 10)}


def test_shared_attributes_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *[None if v == 0 else int(v) for v in rng.integers(0, 5, 3)]) for i in range(60)]
    points = {"a": 4, "b": 2, "c": 3}
    got = {r["k"]: (r["links"], r["critical"], r["warning"], r["strongest"]) for r in G.shared_attributes(spark.createDataFrame(rows, "k int, a int, b int, c int"), "k", points, 6, 3).collect()}
    for k, *own in rows:
        scores = [sum(p for p, x, y in zip(points.values(), own, other, strict=True) if x is not None and x == y) for j, *other in rows if j != k]
        scores = [s for s in scores if s]
        assert got[k] == (len(scores), sum(s >= 6 for s in scores), sum(3 <= s < 6 for s in scores), max(scores, default=0))


def test_medians_equal_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), None if b < 0.3 else float(round(b, 1)), None) for a, b in rng.random((501, 2))]
    got = L.medians(spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"])
    assert abs(got["x"] - np.median([r[0] for r in rows])) < 1e-12 and abs(got["y"] - np.median([r[1] for r in rows if r[1] is not None])) < 1e-12 and got["z"] == 0.0


def test_betweenness_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 14
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.22]
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in range(n)}
    live = [v for v in range(n) if near[v]]
    want = dict.fromkeys(live, 0.0)
    for s in live:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        load = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist.get(v) == dist[w] - 1:
                    load[v] += paths[v] / paths[w] * (1 + load[w])
            if w != s:
                want[w] += load[w]
    k = len(live)
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a bigint, b bigint, shared bigint")
    for block in (5, 1024):
        got = {r["node"]: r["betweenness"] for r in G.betweenness(edges, block).collect()}
        assert set(got) == set(live) and all(abs(got[v] - want[v] / ((k - 1) * (k - 2))) < 1e-9 for v in live)


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 4, 1)], "a bigint, b bigint, shared bigint")
    got = {r["node"]: round(r["betweenness"], 6) for r in G.betweenness(edges).collect()}
    assert got == {1: 0.0, 2: 0.666667, 3: 0.666667, 4: 0.0}


def test_shingle_jaccard_equals_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:50] + ["x"] * 10), " ".join(base[20:] + ["y"] * 30), " ".join(f"z{i}" for i in range(40)), "w1 w2"]
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "doc_id bigint, kind string, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in range(5) for b in range(a + 1, 5) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.3}
    got = {(r["a"], r["b"]): round(r["jaccard"], 6) for r in X.shingle_jaccard(df, "doc_id", "kind", 0.3).collect()}
    assert got == want


def test_chunks_cover_the_text():
    text = "One sentence here. " * 100
    spans = X.chunk(text, 500, 50)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= 500 for a, b in spans) and all(n[0] <= p[1] for p, n in zip(spans, spans[1:], strict=False))


def test_isolation_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))] + [(999, 12.0, -12.0)]
    out = L.isolation_forest(spark.createDataFrame(rows, "id bigint, x double, y double"), "id", ["x", "y"], trees=20)
    assert out.orderBy(F.desc("score")).first()["id"] == 999


def test_only_columns_with_nulls_are_ranked(spark, monkeypatch):
    asked, real = [], L.medians
    monkeypatch.setattr(L, "medians", lambda df, cols: asked.append(list(cols)) or real(df, cols))
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 6.0), (3, 3.0, 9.0), (4, 8.0, 9.5)], "id bigint, x double, y double")
    assert sorted(map(tuple, L.impute(df, ["x", "y"]).collect())) == [(1, 1.0, 5.0), (2, 3.0, 6.0), (3, 3.0, 9.0), (4, 8.0, 9.5)]
    assert asked == [["x"]]


def test_rows_are_scored_once(spark):
    """Each row passes the trees in one walk that goes as deep as the tree, and ends at the leaf that the nodes lead to."""
    x = np.random.default_rng(8).normal(size=(300, 3))
    x[0, 1] = np.nan
    nodes = np.array(L.grow(x[1:], np.random.default_rng(9), 8))

    def leaf(row):
        at = 0
        while nodes[at, 0] >= 0:
            at = int(nodes[at, 2] if row[int(nodes[at, 0])] < nodes[at, 1] else nodes[at, 3])
        return nodes[at, 1]

    assert L.depths(L.walkable(nodes), x).tolist() == [leaf(row) for row in x]
