"""One key, one cell or one text that holds most of the input: results stay whole and work stays dealt."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderlens.operators import graph as G
from tenderlens.operators import sequences as S
from tenderlens.operators import text as X


def test_one_series_spans_many_tasks(spark):
    """A series of 60,000 rows in eight parts, three short ones, one without values, nulls within."""
    rng = np.random.default_rng(1)
    parts = [("a", i, float(v)) for i, v in enumerate(rng.normal(size=60_000))] + [(k, i, float(i * j)) for j, k in enumerate("bcd") for i in range(3)] + [("e", 0, None), ("c", 7, None), ("c", 8, 5.0)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.createDataFrame(parts, "k string, i int, v double").repartition(5)
        out = S.ewma(df, "k", ["i"], "v", 10)
        got = out.toPandas().sort_values(["k", "i"]).reset_index(drop=True)
        tasks = out.filter("k = 'a'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k, part in got.groupby("k"):
        known = part.dropna(subset=["v"])
        want = known["v"].ewm(alpha=2 / 11, adjust=False).mean()
        assert np.allclose(known["ewma"], want, atol=1e-9), k
    assert got.loc[(got.k == "c") & (got.i == 7), "ewma"].iloc[0] == got.loc[(got.k == "c") & (got.i == 2), "ewma"].iloc[0]
    assert got.loc[got.k == "e", "ewma"].isna().all() and len(got) == len(parts) and tasks >= 4


@pytest.mark.parametrize("eps,m,block", [(0.8, 16, 8192), (0.8, 16, 60), (0.3, 3, 100), (5.0, 8, 200)])
def test_neighbour_counts(spark, eps, m, block):
    """Against all pairs, with a third of the points in one place and points without coordinates."""
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(size=(500, 2)), np.repeat([[0.25, 0.5]], 300, axis=0), np.round(rng.normal(size=(100, 2)), 1)])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(p)]
    df = spark.createDataFrame([*rows, (9001, None, 1.0), (9002, float("nan"), 0.0)], "k bigint, x double, y double").repartition(4)
    got = {r["k"]: r["links"] for r in G.neighbour_counts(df, df, "k", "x", "y", eps, m, block).collect()}
    want = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= eps * eps
    assert got == {i: int(n) - 1 for i, n in enumerate(want.sum(axis=1))} | {9001: 0, 9002: 0}


@pytest.mark.parametrize("unit", ["a.", "ab | ", "1.", "a-", "a@", "a@b.", "a_", "9 ", ". "])
def test_redaction_is_linear(spark, unit):
    df = spark.createDataFrame([(unit * (500_000 // len(unit)),)], "text string")
    began = time.time()
    df.select(F.length(X.redact(F.col("text")))).collect()
    assert time.time() - began < 20


def test_redaction_of_addresses(spark):
    texts = ["mail jane.doe+x@example.co.uk now", "..a@b.cd", "a@b.com-x@y.com", "éa@b.org", "a@b", "x@y.c", "a@b.c|d", "@b.com", "a@b.com@c.org"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pattern = X.REDACTIONS[2][0]
    rows = df.select(F.regexp_replace("text", pattern, "#").alias("want"), F.regexp_replace("text", X.ADDRESS_NOW, "$1#").alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows) and rows[0]["got"] == "mail # now"


def test_locate_on_long_lines(spark):
    """A heading of thousands of dotted numbers, a line of 100,000 words, and a quote whose words are mostly common."""
    long = "1." * 20_000 + " x\n" + " ".join(f"w{i % 50}" for i in range(100_000)) + "\n2.1 Scope\nthe bidder shall pay the fee to the office of the buyer"
    docs = spark.createDataFrame([(1, long), (2, "the the the of of to"), (3, None), (4, "")], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, "The bidder shall pay the fee"), (2, "nothing like it"), (3, "")], "id bigint, quote string")
    got = {r["id"]: r for r in X.locate(quotes, docs).collect()}
    assert set(got) == {1} and got[1]["doc_id"] == 1 and got[1]["line"] == 3 and got[1]["exact"] and got[1]["section"] == "2.1 Scope"


@pytest.mark.parametrize("seed", range(3))
def test_locate_equals_all_lines(spark, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(12)]
    weights = np.arange(12, 0, -1) / 78
    line = lambda n: " ".join(rng.choice(words, n, p=weights))
    docs = [(i, "\n".join(line(int(rng.integers(1, 9))) for _ in range(5))) for i in range(12)]
    quotes = [(i, line(int(rng.integers(1, 9)))) for i in range(20)]
    want = {}
    for q, t in quotes:
        asked = set(t.split())
        found = []
        for d, text in docs:
            for k, row in enumerate(text.split("\n")):
                shared = len(asked & set(row.split()))
                if shared >= min(3, len(asked)) and shared >= 0.4 * len(asked):
                    found.append((t not in row, -shared / len(asked), d, k))
        if found:
            want[q] = min(found)
    got = {r["id"]: (not r["exact"], -r["overlap"], r["doc_id"], r["line"]) for r in X.locate(spark.createDataFrame(quotes, "id bigint, quote string"), spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("eps", [0.5, 0.3])
def test_points_on_few_lines(eps):
    """Bisection on lines of equal y, with places that lie at just the radius and places held many times."""
    rng = np.random.default_rng(3)
    d = np.unique(np.column_stack([np.round(rng.normal(size=4000), 1), np.round(rng.normal(size=4000) * 2) / 10]), axis=0)
    n = rng.integers(1, 5, len(d))
    q = np.concatenate([d[::3], rng.normal(size=(50, 2))])
    want = ((((q[:, None] - d[None]) ** 2).sum(axis=2) <= eps * eps) * n).sum(axis=1)
    assert (G.near_on_lines(q[:, 0], q[:, 1], d[:, 0], d[:, 1], n, eps) == want).all()
    assert (G.near_in_blocks(q[:, 0], q[:, 1], d[:, 0], d[:, 1], n, eps, 8) == want).all()


def test_betweenness_goes_on_with_all_blocks_at_a_time(spark, monkeypatch):
    """Rounds follow the levels, not the blocks of sources; small blocks and parts of the graph give the same."""
    edges = spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, 40) if (a * b) % 7 == 1], "a bigint, b bigint")
    want = {r["node"]: r["betweenness"] for r in G.betweenness(edges).collect()}
    made = []
    real = G.stored
    monkeypatch.setattr(G, "stored", lambda df: made.append(1) or real(df))
    monkeypatch.setattr(G, "HELD", 64)
    got = {r["node"]: r["betweenness"] for r in G.betweenness(edges, 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(made) < 14


def test_files_of_one_row_group_are_read_by_many_tasks(spark, data):
    """The profile of vendors runs in as many tasks as the session shuffles by, however few the file has."""
    from tenderlens.plans import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert QUERIES["vendor_profile_extract"](spark, data).rdd.getNumPartitions() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_only_documents_of_best_lines_are_followed_line_by_line(spark, monkeypatch):
    """Pages and headings are carried along the lines of the documents that win, not of all."""
    docs = spark.createDataFrame([(i, f"--- Page {i + 2} ---\n{i}.1 Scope\nthe bidder shall pay {'the fee' if i == 7 else 'w' + str(i)}") for i in range(40)], "doc_id bigint, text string")
    quotes = spark.createDataFrame([(1, "The bidder shall pay the fee")], "id bigint, quote string")
    made, real = [], X.durable
    monkeypatch.setattr(X, "durable", lambda df: made.append(real(df)) or made[-1])
    got = X.locate(quotes, docs).collect()
    assert [(r["doc_id"], r["page"], r["line"], r["section"], r["exact"]) for r in got] == [(7, 9, 2, "7.1 Scope", True)]
    assert made[-1].count() == 1 and "page" not in made[-1].columns
