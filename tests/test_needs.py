"""Queries do not prepare what they do not return."""

from tenderlens.operators import graph as G
from tenderlens.plans import QUERIES
from tenderlens.plans import learning as P
from tenderlens.sources.views import Tables


def test_heuristic_risk_reads_its_features_only(spark, data, monkeypatch):
    """The risk of vendors needs no pairs of bidders, and is that of the whole feature vector."""
    want = {r["vendor_id"]: r["risk"] for r in P.heuristic(P.vendor_features(Tables(spark, data))).select("vendor_id", P.r("risk").alias("risk")).collect()}
    monkeypatch.setattr(G, "strong_edges", None)
    got = {r["vendor_id"]: r["risk"] for r in QUERIES["vendor_heuristic_risk"](spark, data).collect()}
    assert got == want and got


def test_gap_analysis_looks_for_a_need_once(spark):
    """The words of a need are searched in the text, in its lines and near an amount, not again for each column."""
    from tenderlens.operators import rules as R

    docs = spark.createDataFrame([(1, "a line\npast experience\nRs. 5"), (2, None)], "doc_id bigint, text string").repartition(2)
    results = spark.createDataFrame([(1, R.NEEDS[0][0], "FAIL")], "doc_id bigint, rule string, status string").repartition(2)
    df = R.gap_analysis(results, docs, "doc_id")
    word = "|".join(R.NEEDS[0][2])
    assert df._jdf.queryExecution().optimizedPlan().toString().count(word) <= 4
    assert df.count() == 1
