"""The procurement domain over the given tables; each view is lazy and prunes to what a query uses.

``SQL`` holds the same definitions as common table expressions for the SQL twins.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored

STATUSES = ("Draft", "Published", "Under Evaluation", "Awarded", "Closed", "Cancelled")


class Tables:
    """Domain views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def once(self, *names: str) -> Tables:
        """These tables with the named views written once, for queries that read them many times."""
        out = copy(self)
        for name in names:
            setattr(out, name, lambda df=stored(getattr(self, name)()): df)
        return out

    def vendors(self) -> DataFrame:
        s, n = self.raw("supplier"), self.raw("nation")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"), F.col("n_name").alias("country"),
            (F.col("s_acctbal") < 0).alias("is_blacklisted"),
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.col("s_acctbal") + 1000) / 110)).alias("performance_score"),
            (F.col("s_suppkey") % 3 == 0).alias("msme"), (F.col("s_suppkey") % 5 == 0).alias("startup"), (F.col("n_regionkey") == 2).alias("make_in_india"),
        )

    def tenders(self) -> DataFrame:
        span = self.raw("lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").cast("timestamp").alias("published_at"), F.max("l_shipdate").cast("timestamp").alias("closing_at"))
        p = self.raw("part").join(span, F.col("p_partkey") == F.col("l_partkey"), "left")
        status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("p_size") % 6 + 1).cast("int"))
        return p.select(
            F.col("p_partkey").alias("tender_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"),
            (2 * F.col("p_retailprice")).alias("estimated_value"), status.alias("tender_status"), "published_at", "closing_at",
        )

    def bids(self) -> DataFrame:
        g = self.raw("lineitem").groupBy(F.col("l_partkey").alias("tender_id"), F.col("l_suppkey").alias("vendor_id"))
        a = g.agg(
            F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("total_amount"), F.max("l_quantity").cast("int").alias("delivery_period"),
            F.min("l_shipdate").cast("timestamp").alias("submitted_at"), F.min("l_returnflag").alias("flag"),
            F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"),
        )
        status = F.when(F.col("flag") == "A", "Awarded").when(F.col("flag") == "N", "Submitted").otherwise("Disqualified")
        return a.select(
            (F.col("tender_id") * 100000 + F.col("vendor_id")).alias("bid_id"), "tender_id", "vendor_id", "total_amount", "delivery_period", "submitted_at",
            status.alias("status"), (F.col("flag") == "R").alias("is_disqualified"),
            F.least(F.lit(100.0), 2 * F.col("q")).alias("score_1"), F.least(F.lit(100.0), 1000 * F.col("d")).alias("score_2"), (100 - 1000 * F.col("t")).alias("score_3"),
        )

    def criteria(self) -> DataFrame:
        return self.spark.createDataFrame(CRITERIA, "criteria_id int, criteria_name string, weight double, max_score double, threshold double")

    def bid_scores(self) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("criteria_id"), F.round(f"score_{i}", 4).alias("score")) for i in (1, 2, 3)])).alias("s")
        return self.bids().select("bid_id", "tender_id", "vendor_id", pairs).select("bid_id", "tender_id", "vendor_id", "s.criteria_id", "s.score")

    def bid_fact(self) -> DataFrame:
        """Bids with their vendor and tender (the canonical record of the analytics)."""
        return self.bids().join(self.vendors(), "vendor_id").join(self.tenders(), "tender_id")

    def purchase_orders(self) -> DataFrame:
        first = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("vendor_id"), F.min("l_partkey").alias("tender_id"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("invoice_amount"))
        o = self.raw("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return o.select(
            F.col("o_orderkey").alias("po_id"), "vendor_id", "tender_id", F.col("o_totalprice").alias("po_value"), F.col("o_orderstatus").alias("po_status"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"), "invoice_amount", F.col("o_orderpriority").alias("priority"),
        )

    def deliveries(self) -> DataFrame:
        result = F.when(F.col("l_returnflag") == "N", "Passed").when(F.col("l_returnflag") == "R", "Failed").otherwise("Pending")
        return self.raw("lineitem").select(F.col("l_orderkey").alias("po_id"), F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("tender_id"), F.col("l_quantity").alias("days"), F.col("l_shipdate").cast("timestamp").alias("delivered_at"), result.alias("inspection"), F.col("l_tax").alias("tax"))

    def documents(self) -> DataFrame:
        vendor = F.col("source").substr(F.lit(4), F.length("source")).cast("long") + 1
        return self.raw("documents").select("doc_id", vendor.alias("vendor_id"), F.col("lang").alias("doc_type"), "text", "source")

    def audit(self) -> DataFrame:
        return self.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("action"), F.col("props").alias("details"), "value")

    def decisions(self) -> DataFrame:
        l, d = self.raw("labels"), self.raw("documents").select("doc_id", "source")
        action = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("quality") == 1, "modified").otherwise("rejected")
        return l.join(d, "doc_id").select(
            F.col("doc_id").alias("decision_id"), (F.col("doc_id") % 2000 + 1).alias("tender_id"), (F.col("source").substr(F.lit(4), F.length("source")).cast("long") + 1).alias("vendor_id"),
            (F.col("doc_id") % 4).cast("int").alias("criteria_id"), (F.col("doc_id") * 37 % 101 / 100.0).alias("confidence"), (F.col("doc_id") % 100).cast("double").alias("ai_score"),
            action.alias("human_action"), F.when(action == "modified", (F.col("doc_id") * 7 % 100).cast("double")).alias("human_score"),
            (F.col("doc_id") % 5 + 1).cast("int").alias("rating"), F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")).alias("month"),
        )


#: Evaluation criteria of every tender (fixed values): id, name, weight, maximum, threshold.
CRITERIA = [(1, "Capacity", 40.0, 100.0, 30.0), (2, "Commercial terms", 35.0, 100.0, 20.0), (3, "Compliance", 25.0, 100.0, 50.0)]

SQL = """
WITH vendors AS (SELECT s_suppkey AS vendor_id, s_name AS vendor_name, n_name AS country, s_acctbal < 0 AS is_blacklisted,
    greatest(0.0, least(100.0, (s_acctbal + 1000) / 110)) AS performance_score, s_suppkey % 3 = 0 AS msme, s_suppkey % 5 = 0 AS startup, n_regionkey = 2 AS make_in_india
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
tenders AS (SELECT p_partkey AS tender_id, p_name AS title, p_type AS category, 2 * p_retailprice AS estimated_value,
    ['Draft', 'Published', 'Under Evaluation', 'Awarded', 'Closed', 'Cancelled'][p_size % 6 + 1] AS tender_status, published_at, closing_at
  FROM part LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS published_at, max(l_shipdate) AS closing_at FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
bids AS (SELECT l_partkey * 100000 + l_suppkey AS bid_id, l_partkey AS tender_id, l_suppkey AS vendor_id, min(l_extendedprice / l_quantity) AS total_amount,
    max(l_quantity)::INT AS delivery_period, min(l_shipdate) AS submitted_at,
    CASE min(l_returnflag) WHEN 'A' THEN 'Awarded' WHEN 'N' THEN 'Submitted' ELSE 'Disqualified' END AS status, min(l_returnflag) = 'R' AS is_disqualified,
    least(100.0, 2 * avg(l_quantity)) AS score_1, least(100.0, 1000 * avg(l_discount)) AS score_2, 100 - 1000 * avg(l_tax) AS score_3
  FROM lineitem GROUP BY l_partkey, l_suppkey),
criteria(criteria_id, criteria_name, weight, max_score, threshold) AS (VALUES (1, 'Capacity', 40.0::DOUBLE, 100.0::DOUBLE, 30.0::DOUBLE), (2, 'Commercial terms', 35.0, 100.0, 20.0), (3, 'Compliance', 25.0, 100.0, 50.0)),
bid_scores AS (SELECT bid_id, tender_id, vendor_id, i AS criteria_id, round(CASE i WHEN 1 THEN score_1 WHEN 2 THEN score_2 ELSE score_3 END, 4) AS score FROM bids, (VALUES (1), (2), (3)) t(i)),
bid_fact AS (SELECT * FROM bids JOIN vendors USING (vendor_id) JOIN tenders USING (tender_id)),
purchase_orders AS (SELECT o_orderkey AS po_id, vendor_id, tender_id, o_totalprice AS po_value, o_orderstatus AS po_status, o_orderdate AS created_at, invoice_amount, o_orderpriority AS priority
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS vendor_id, min(l_partkey) AS tender_id, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS invoice_amount FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
deliveries AS (SELECT l_orderkey AS po_id, l_suppkey AS vendor_id, l_partkey AS tender_id, l_quantity AS days, l_shipdate AS delivered_at, CASE l_returnflag WHEN 'N' THEN 'Passed' WHEN 'R' THEN 'Failed' ELSE 'Pending' END AS inspection, l_tax AS tax FROM lineitem),
bid_documents AS (SELECT doc_id, substr(source, 4)::BIGINT + 1 AS vendor_id, lang AS doc_type, text, source FROM documents),
audit AS (SELECT event_id, ts, user_id, event_type AS action, props AS details, value FROM events),
decisions AS (SELECT doc_id AS decision_id, doc_id % 2000 + 1 AS tender_id, substr(source, 4)::BIGINT + 1 AS vendor_id, (doc_id % 4)::INT AS criteria_id, doc_id * 37 % 101 / 100.0::DOUBLE AS confidence,
    (doc_id % 100)::DOUBLE AS ai_score, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN quality = 1 THEN 'modified' ELSE 'rejected' END AS human_action,
    CASE WHEN quality = 1 AND toxic <> 0 THEN (doc_id * 7 % 100)::DOUBLE END AS human_score, (doc_id % 5 + 1)::INT AS rating, '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') AS month
  FROM labels JOIN documents USING (doc_id))
"""
