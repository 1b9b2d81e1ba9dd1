"""Pairs of bidders, their likeness and what follows from them, against brute force, without rows for each meeting."""

import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.operators import graph as G

BIDS = "tender_id bigint, vendor_id bigint"


def bids(seed=0):
    """A tender with all vendors, one with a single bidder, repeated bids and nulls."""
    rng = np.random.default_rng(seed)
    rows = [(int(t), int(v)) for t, v in zip(rng.integers(0, 60, 400), rng.integers(0, 30, 400), strict=True)]
    return [*rows, *[(99, v) for v in range(40)], (98, 3), *rows[:20], (None, 1), (None, 2), (5, None)]


def brute(rows):
    by, met = defaultdict(set), defaultdict(list)
    for t, v in rows:
        if t is not None and v is not None:
            by[t].add(v)
    for t in sorted(by):
        for a, b in itertools.combinations(sorted(by[t]), 2):
            met[a, b].append(t)
    return met


@pytest.mark.parametrize("most", [7, 1 << 22])
def test_co_bids(spark, most):
    df, want = spark.createDataFrame(bids(), BIDS).repartition(3), brute(bids())
    plain = G.co_bids(df)
    assert {(r["a"], r["b"]): r["shared"] for r in plain.collect()} == {k: len(v) for k, v in want.items()}
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["a"], r["b"]): (r["shared"], r["tenders"]) for r in G.co_bids(df, 3, most).collect()}
    assert got == {k: (len(v), v[:3]) for k, v in want.items()}


@pytest.mark.parametrize("block", [4, 512])
def test_neighbour_jaccard(spark, block):
    """Neighbours of both ends in common, without a list of neighbours for each pair."""
    edges = sorted(brute(bids())) + [(500, 501)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)
    got = {(r["a"], r["b"]): r["co"] for r in G.neighbour_jaccard(df, block).collect()}
    assert got == {(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a, b in edges}


@pytest.mark.parametrize("most", [7, 1 << 22])
def test_strong_edges(spark, most):
    """Pairs above the bar of all pairs, though pairs met once are not written; names may be numbers or text."""
    for kind, name in (("bigint", int), ("string", "v{:03}".format)):
        rows = [(t, None if v is None else name(v)) for t, v in bids(1)]
        met = {k: len(v) for k, v in brute(rows).items()}
        x = np.array(list(met.values()))
        bar = x.mean() + 1.5 * x.std()
        counted = G.counted_pairs(spark.createDataFrame(rows, f"tender_id bigint, vendor_id {kind}").repartition(3), 2, most).collect()
        assert sum(r["shared"] for r in counted if r["a"] is None) == (x == 1).sum() > 0
        assert all(r["shared"] > 1 for r in counted if r["a"] is not None)
        got = G.strong_edges(spark.createDataFrame(rows, f"tender_id bigint, vendor_id {kind}"), most=most)
        assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == {k: n for k, n in met.items() if n > bar}
    level = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], BIDS)
    assert G.strong_edges(level).count() == 0 and G.strong_edges(level.limit(0)).count() == 0


def test_network_counts_others_of_few(spark):
    """Vendors whose meetings cannot reach the moderate share are LOW without their others being counted."""
    from tenderlens.operators import anomaly as A

    rows = [*bids(2), *[(1000 + i, 100 + i + j) for i in range(200) for j in (0, 1)]]
    met = brute(rows)
    degree, total = defaultdict(int), defaultdict(int)
    for pair, tenders in met.items():
        for v in pair:
            degree[v] += 1
            total[v] += len(tenders)
    others = len(degree) - 1
    level = lambda v, h, m: "HIGH" if degree[v] / others > h and total[v] / degree[v] > 2 else "MODERATE" if degree[v] / others > m else "LOW"
    df = spark.createDataFrame(rows, BIDS)
    for h, m in ((0.7, 0.4), (0.15, 0.1)):
        got = {r["vendor_id"]: r["network_risk"] for r in A.network(df, h, m).collect()}
        assert got == {v: level(v, h, m) for v in degree}
    assert len(set(got.values())) > 1


def test_components_of_stars(spark):
    """Edges are joined where they lie before they are shuffled; numbers or text, few edges at a time."""
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 650)] + [(7, 7)]
    least = {v: v for e in rows if e[0] != e[1] for v in e}
    for _ in least:
        for a, b in rows:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    for kind, name in (("bigint", int), ("string", "v{:03}".format)):
        df = spark.createDataFrame([(name(a), name(b)) for a, b in rows], f"a {kind}, b {kind}").repartition(3)
        for most in (5, 1 << 20):
            got = {r["node"]: r["component"] for r in G.components(df, most=most).collect()}
            assert got == {name(k): name(v) for k, v in least.items()}
    dense = spark.createDataFrame([(i, j) for i in range(60) for j in range(i)], "a bigint, b bigint").repartition(2)
    assert dense.mapInArrow(G.stars(1 << 20), "a bigint, b bigint").count() <= 2 * 59


def test_counting_holds_little(spark):
    """A task's share of the meetings keeps its arrays small."""
    sent = spark.createDataFrame([(i, list(range(i + 1, 60))) for i in range(59)], "a bigint, others array<bigint>")
    assert G.counted(sent, 1 << 26).rdd.getNumPartitions() >= 32


def test_betweenness_of_parts(spark):
    """Components that a task follows alone and those that go level by level, also together, against brute force."""
    rng = np.random.default_rng(8)
    parts = [{tuple(sorted(map(int, p))) for p in rng.integers(0, 12, (20, 2)) if p[0] != p[1]}, {(20 + i, 21 + i) for i in range(5)}, {(40, 41)}]
    near = defaultdict(set)
    for a, b in itertools.chain(*parts):
        near[a].add(b)
        near[b].add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, defaultdict(int, {s: 1}), [s]
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        load = defaultdict(float)
        for v in reversed(order[1:]):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    load[u] += paths[u] / paths[v] * (1 + load[v])
            want[v] += load[v]
    n = len(near)
    edges = spark.createDataFrame([(a, b, 1) for a, b in itertools.chain(*parts)], "a bigint, b bigint, shared bigint").repartition(3)
    for alone, block in ((4096, 1024), (4096, 3), (0, 4), (6, 4)):
        got = {r["node"]: r["betweenness"] for r in G.betweenness(edges, block, alone).collect()}
        assert set(got) == set(near) and all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-9 for v in near)


def test_likeness_blocks_keep_to_components(spark, monkeypatch):
    """Interleaved numbers of separate groups do not make every block meet every other."""
    edges = [(i * 20 + k, j * 20 + k) for k in range(20) for i in range(4) for j in range(i + 1, 4)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    sent, write = [], G.stored
    monkeypatch.setattr(G, "stored", lambda d: sent.append(write(d)) or sent[-1])
    assert {r["co"] for r in G.neighbour_jaccard(df, 4).collect()} == {0.5}
    ranks = next(d for d in sent if "ra" in d.columns)
    assert ranks.selectExpr("floor(ra / 4) AS x", "floor(rb / 4) AS y").distinct().count() == 20


@pytest.mark.parametrize("asked,most", [(7, 50), (1 << 21, 1 << 18)])
def test_links_on_few_lines(spark, asked, most):
    """Points on few lines, many in one place and on the circle, against all pairs; no run of one tile is sent to far ones."""
    rng = np.random.default_rng(4)
    p = np.concatenate([np.column_stack([np.round(rng.normal(size=600), 2), rng.integers(-8, 8, 600) / 4]), np.repeat([[0.25, 0.5]], 80, axis=0)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "k bigint, x double, y double").repartition(3)
    for eps in (0.5, 0.8):
        want = (((p[:, None] - p[None]) ** 2).sum(axis=2) <= eps * eps).sum(axis=1) - 1
        got = G.line_counts(df, eps, 1.5 * eps, asked, most).collect()
        assert len(got) == len(p) and {r["k"]: r["links"] for r in got} == dict(enumerate(want.tolist()))
    plan = G.neighbour_counts(df, df, "k", "x", "y", 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and {r["k"]: r["links"] for r in G.neighbour_counts(df, df, "k", "x", "y", 0.8).collect()} == dict(enumerate(want.tolist()))
