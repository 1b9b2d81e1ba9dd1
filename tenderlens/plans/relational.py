"""Queries of scans, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import compare, different, holds, positive, same
from ..operators import graph as G
from ..operators import relational as R
from ..operators import text as X
from .registry import query
from .shared import QCBS


@query("SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, coalesce(n_chars, 0) AS n_chars FROM documents")
def scan_table(t):
    return R.with_defaults(t.raw("documents").select("doc_id", "lang", "source", "n_chars"), {"lang": "unknown", "source": "unknown", "n_chars": 0})


@query("""
SELECT coalesce(n.vendor_id, v.vendor_id) AS vendor_id, coalesce(n.vendor_name, v.vendor_name) AS vendor_name, coalesce(n.performance_score, v.performance_score) AS performance_score
FROM vendors v FULL JOIN (SELECT vendor_id + 50 AS vendor_id, upper(vendor_name) AS vendor_name, 50.0 AS performance_score FROM vendors WHERE msme) n ON n.vendor_id = v.vendor_id""")
def upsert_by_key(t):
    v = t.vendors()
    new = v.filter("msme").select((F.col("vendor_id") + 50).alias("vendor_id"), F.upper("vendor_name").alias("vendor_name"), F.lit(50.0).alias("performance_score"))
    return R.upsert_by_key(v.select("vendor_id", "vendor_name", "performance_score"), new, "vendor_id")


@query("SELECT doc_id, doc_type FROM bid_documents WHERE NOT coalesce(doc_type = 'en' AND vendor_id <= 5, false)")
def delete_where(t):
    return R.delete_where(t.documents(), (F.col("doc_type") == "en") & (F.col("vendor_id") <= 5)).select("doc_id", "doc_type")


@query("SELECT count(*) FILTER (doc_type = 'en' AND vendor_id <= 5) AS deleted, count(*) FILTER (NOT coalesce(doc_type = 'en' AND vendor_id <= 5, false)) AS kept FROM bid_documents")
def delete_where_count(t):
    return R.deleted_count(t.documents(), (F.col("doc_type") == "en") & (F.col("vendor_id") <= 5))


@query("""
SELECT po_id, new_id, format('PO/2024/{:04d}', new_id) AS number, '45' || (new_id + 100000)::VARCHAR AS po_number
FROM (SELECT po_id, 500 + row_number() OVER (ORDER BY created_at, po_id) AS new_id FROM purchase_orders WHERE po_status = 'F')""")
def assign_ids_and_numbers(t):
    rows = t.purchase_orders().filter("po_status = 'F'").select("po_id", "created_at")
    return R.assign_numbers(rows, ["created_at", "po_id"], 500, "PO", 2024).select("po_id", "new_id", "number", "po_number")


@query("""
SELECT coalesce(a.vendor_id, b.vendor_id) AS vendor_id, CASE WHEN a.vendor_id IS NULL THEN 'added' WHEN b.vendor_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT vendor_id, msme FROM vendors WHERE NOT startup) a FULL JOIN (SELECT vendor_id, msme AND NOT is_blacklisted AS msme FROM vendors WHERE vendor_id % 7 <> 0) b ON a.vendor_id = b.vendor_id
WHERE a.vendor_id IS NULL OR b.vendor_id IS NULL OR a.msme <> b.msme""")
def snapshot_diff(t):
    v = t.vendors()
    return R.snapshot_diff(v.filter("not startup").select("vendor_id", "msme"), v.filter("vendor_id % 7 <> 0").select("vendor_id", (F.col("msme") & ~F.col("is_blacklisted")).alias("msme")), "vendor_id")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(t):
    return R.first_of_content(t.documents(), "doc_id", "text")


@query("SELECT bid_id, vendor_id AS vendor, total_amount AS amount, total_amount * 1.18 AS amount_with_tax FROM bids")
def project_labels(t):
    return t.bids().select("bid_id", F.col("vendor_id").alias("vendor"), F.col("total_amount").alias("amount"), (F.col("total_amount") * 1.18).alias("amount_with_tax"))


@query("SELECT decision_id, human_score FROM decisions WHERE human_score IS DISTINCT FROM 21 AND coalesce(confidence >= 0.5, false) AND NOT coalesce(human_score < 10, false)")
def filter_compare(t):
    c = F.col
    return t.decisions().filter(different(c("human_score"), 21) & compare(c("confidence"), ">=", 0.5) & ~compare(c("human_score"), "<", 10)).select("decision_id", "human_score")


@query("SELECT bid_id, status FROM bids WHERE (status = 'Awarded' AND delivery_period > 40) OR (status = 'Submitted' AND (total_amount < 950 OR delivery_period < 5))")
def filter_and_or(t):
    c = F.col
    return t.bids().filter((same(c("status"), "Awarded") & (c("delivery_period") > 40)) | (same(c("status"), "Submitted") & ((c("total_amount") < 950) | (c("delivery_period") < 5)))).select("bid_id", "status")


@query("SELECT tender_id, tender_status FROM tenders WHERE tender_status IN ('Published', 'Awarded')")
def filter_in(t):
    return t.tenders().filter(F.col("tender_status").isin("Published", "Awarded")).select("tender_id", "tender_status")


@query("SELECT tender_id, title, category FROM tenders WHERE contains(lower(category), 'al') OR contains(title, '1')")
def filter_ilike(t):
    return t.tenders().filter(holds(F.col("category"), "%AL%") | F.contains("title", F.lit("1"))).select("tender_id", "title", "category")


@query("""
SELECT vendor_id, vendor_name, country FROM vendors WHERE (contains(lower(vendor_name), '1') OR contains(lower(country), '1')) AND msme AND NOT is_blacklisted
ORDER BY vendor_id LIMIT 20 OFFSET 2""")
def vendor_search(t):
    found = t.vendors().filter(R.any_of([holds(F.col(c), "1") for c in ("vendor_name", "country")]) & F.col("msme") & ~F.col("is_blacklisted"))
    return R.page(found.select("vendor_id", "vendor_name", "country"), ["vendor_id"], 2, 20)


@query("SELECT event_id, user_id, action, count(*) FILTER (action <> 'view') OVER () AS unread FROM audit WHERE user_id = 7 OR user_id IS NULL")
def scoped_or_broadcast_rows(t):
    mine = t.audit().filter((F.col("user_id") == 7) | F.col("user_id").isNull()).select("event_id", "user_id", "action")
    unread = mine.agg(F.count_if(F.col("action") != "view").alias("unread"))
    return mine.crossJoin(F.broadcast(unread))  # one row


@query("SELECT decision_id, vendor_id, human_action, confidence FROM decisions WHERE human_action = 'rejected' AND confidence >= 0.3 ORDER BY decision_id DESC LIMIT 50 OFFSET 5")
def decision_listing(t):
    found = t.decisions().filter((F.col("human_action") == "rejected") & (F.col("confidence") >= 0.3))
    return R.page(found.select("decision_id", "vendor_id", "human_action", "confidence"), [F.desc("decision_id")], 5, 50)


@query("SELECT bid_id, vendor_name, total_amount FROM bids JOIN vendors USING (vendor_id)")
def join_inner(t):
    return t.bids().join(t.vendors(), "vendor_id").select("bid_id", "vendor_name", "total_amount")


@query("SELECT po_id, po_value, coalesce(vendor_name, 'Unknown') AS vendor_name FROM purchase_orders p LEFT JOIN (SELECT * FROM vendors WHERE NOT is_blacklisted) v USING (vendor_id)")
def join_left_outer(t):
    good = t.vendors().filter("not is_blacklisted").select("vendor_id", "vendor_name")
    return t.purchase_orders().join(good, "vendor_id", "left").select("po_id", "po_value", F.coalesce("vendor_name", F.lit("Unknown")).alias("vendor_name"))


@query("SELECT po_id, vendor_name, title FROM purchase_orders LEFT JOIN vendors USING (vendor_id) LEFT JOIN tenders USING (tender_id)")
def join_three_way_left(t):
    return t.purchase_orders().join(t.vendors(), "vendor_id", "left").join(t.tenders(), "tender_id", "left").select("po_id", "vendor_name", "title")


@query("SELECT bid_id, tender_id, vendor_id, vendor_name, total_amount, delivery_period, status, is_disqualified, is_blacklisted, estimated_value FROM bid_fact")
def bid_fact(t):
    return t.bid_fact().select("bid_id", "tender_id", "vendor_id", "vendor_name", "total_amount", "delivery_period", "status", "is_disqualified", "is_blacklisted", "estimated_value")


@query("SELECT a.vendor_id AS a, b.vendor_id AS b, count(*) AS shared FROM bids a JOIN bids b ON a.tender_id = b.tender_id AND a.vendor_id < b.vendor_id GROUP BY 1, 2")
def pair_self_join(t):
    return G.co_bids(t.bids())


@query("""
SELECT bid_id, total_amount * 1.18 AS total_with_tax, CASE WHEN t.tender_id IS NULL THEN 'tender not open' WHEN v.is_blacklisted IS NULL THEN 'vendor unknown' WHEN v.is_blacklisted THEN 'vendor blacklisted' WHEN turn > 1 THEN 'already bid' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY tender_id, vendor_id ORDER BY submitted_at, bid_id) AS turn FROM bids) b
LEFT JOIN (SELECT tender_id FROM tenders WHERE tender_status = 'Published') t USING (tender_id) LEFT JOIN vendors v USING (vendor_id)""")
def admission_check(t):
    out = R.admit(t.bids(), t.tenders().filter("tender_status = 'Published'"), t.vendors())
    return out.select("bid_id", (F.col("total_amount") * 1.18).alias("total_with_tax"), "reason")


@query("""
WITH need AS (SELECT DISTINCT vendor_id, l AS doc_type FROM bid_documents, (VALUES ('en'), ('de'), ('fr'), ('es'), ('it')) r(l))
SELECT vendor_id, string_agg(doc_type, ',' ORDER BY doc_type) AS missing FROM need ANTI JOIN bid_documents USING (vendor_id, doc_type) GROUP BY 1""")
def missing_documents(t):
    required = t.spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it")], "doc_type string")
    return R.missing_labels(t.documents(), required, "vendor_id", "doc_type")


_LEGAL = ", ".join(f"'{w.lower()}'" for w in X.LEGAL_WORDS)
_COMMON = ", ".join(f"'{w.lower()}'" for w in X.COMMON_NAMES)


@query(f"""
WITH item AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_LEGAL})) AS ws FROM benchmark),
k AS (SELECT item_id, CASE WHEN len(ws) >= 2 THEN ws[1] || ' ' || ws[2] WHEN len(ws[1]) >= 4 AND ws[1] NOT IN ({_COMMON}) THEN ws[1] END AS k FROM item),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
said AS (SELECT DISTINCT doc_id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS k FROM d)
SELECT item_id, count(*) AS mentions FROM k JOIN said USING (k) GROUP BY 1""")
def entity_mention_join(t):
    """Documents that mention a name (here: the items' texts as names), which is known by its first two telling words."""
    return X.mentions(t.documents(), t.raw("benchmark"), "doc_id", "item_id").groupBy("item_id").agg(F.count(F.lit(1)).alias("mentions"))


GRUBBS = [(3, 1.153), (4, 1.463), (5, 1.672), (6, 1.822), (7, 1.938), (8, 2.032), (9, 2.110), (10, 2.176), (12, 2.285), (15, 2.409), (20, 2.557), (25, 2.663), (30, 2.745), (40, 2.866), (50, 2.956), (100, 3.207)]
GRUBBS_SQL = "grubbs(k, critical) AS (VALUES " + ", ".join(f"({k}, {v}::DOUBLE)" for k, v in GRUBBS) + ")"


@query(f"WITH {GRUBBS_SQL}, n AS (SELECT tender_id, count(*) AS n FROM bids GROUP BY 1) SELECT tender_id, n, (SELECT arg_min(critical, abs(n - k) * 1000 + k) FROM grubbs) AS critical FROM n")
def nearest_lookup_join(t):
    n = t.bids().groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"))
    return R.nearest_lookup(n, "n", t.spark.createDataFrame(GRUBBS, "k int, critical double"), "k", "critical").select("tender_id", "n", "critical")


@query("""
SELECT decision_id, coalesce(vendor_name, 'Unknown') AS vendor_name, coalesce(criteria_name, 'General / No Criteria') AS criteria_name
FROM decisions LEFT JOIN vendors USING (vendor_id) LEFT JOIN criteria USING (criteria_id)""")
def decision_with_names(t):
    out = t.decisions().join(t.vendors(), "vendor_id", "left").join(F.broadcast(t.criteria()), "criteria_id", "left")  # three rows
    return out.select("decision_id", F.coalesce("vendor_name", F.lit("Unknown")).alias("vendor_name"), F.coalesce("criteria_name", F.lit("General / No Criteria")).alias("criteria_name"))


@query("SELECT tender_id, category, estimated_value, row_number() OVER (PARTITION BY category ORDER BY estimated_value DESC, tender_id) AS place FROM tenders")
def order_by_multi(t):
    return t.tenders().select("tender_id", "category", "estimated_value", F.row_number().over(W.partitionBy("category").orderBy(F.desc("estimated_value"), "tender_id")).alias("place"))


@query("SELECT bid_id, total_amount FROM bids ORDER BY total_amount DESC, bid_id LIMIT 100 OFFSET 10")
def offset_limit(t):
    return R.page(t.bids().select("bid_id", "total_amount"), [F.desc("total_amount"), "bid_id"], 10, 100)


@query("SELECT vendor_id, vendor_name, performance_score FROM vendors WHERE NOT is_blacklisted ORDER BY performance_score DESC, vendor_id LIMIT 5")
def top_vendors(t):
    return R.page(t.vendors().filter("not is_blacklisted").select("vendor_id", "vendor_name", "performance_score"), [F.desc("performance_score"), "vendor_id"], 0, 5)


@query("SELECT tender_id, title FROM tenders ORDER BY published_at DESC NULLS LAST, tender_id DESC LIMIT 5")
def recent_tenders(t):
    return R.page(t.tenders(), [F.desc_nulls_last("published_at"), F.desc("tender_id")], 0, 5).select("tender_id", "title")


@query("""
WITH c AS (SELECT source AS k, doc_id, n_chars AS len, (doc_id * 13 % 100) / 100.0::DOUBLE AS quality, (doc_id * 29 % 100) / 100.0::DOUBLE AS confidence FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(0.6 * quality + 0.4 * confidence, 6) DESC, doc_id) AS n FROM c),
p AS (SELECT a.k, a.doc_id AS a_id, b.doc_id AS b_id, a.quality AS aq, a.confidence AS ac, a.len AS al, b.quality AS bq, b.confidence AS bc, b.len AS bl FROM r a LEFT JOIN r b ON a.k = b.k AND b.n = 2 WHERE a.n = 1)
SELECT k, CASE WHEN aq > 0.7 AND ac > 0.7 THEN a_id WHEN coalesce(bl > 1.3 * al AND bq > 0.5, false) OR coalesce(bc > 1.2 * ac AND bl >= 0.8 * al, false) THEN b_id ELSE a_id END AS chosen FROM p""")
def best_candidate_per_key(t):
    c = t.raw("documents").select(F.col("source").alias("k"), "doc_id", F.col("n_chars").alias("len"), (F.col("doc_id") * 13 % 100 / 100.0).alias("quality"), (F.col("doc_id") * 29 % 100 / 100.0).alias("confidence"))
    two = R.top_per_key(c, ["k"], [F.round(0.6 * F.col("quality") + 0.4 * F.col("confidence"), 6).desc(), "doc_id"], 2)
    pick = lambda n: F.max_by(F.struct("doc_id", "len", "quality", "confidence"), F.when(F.col("rank") == n, 1)).alias(f"c{n}")
    p = two.groupBy("k").agg(pick(1), pick(2))
    longer = (F.col("c2.len") > 1.3 * F.col("c1.len")) & (F.col("c2.quality") > 0.5)
    surer = (F.col("c2.confidence") > 1.2 * F.col("c1.confidence")) & (F.col("c2.len") >= 0.8 * F.col("c1.len"))
    sure = (F.col("c1.quality") > 0.7) & (F.col("c1.confidence") > 0.7)
    return p.select("k", F.when(sure, F.col("c1.doc_id")).when(F.coalesce(longer, F.lit(False)) | F.coalesce(surer, F.lit(False)), F.col("c2.doc_id")).otherwise(F.col("c1.doc_id")).alias("chosen"))


@query("""
SELECT vendor_id, 'bid' AS kind, epoch(submitted_at)::BIGINT AS at, bid_id AS ref FROM bids UNION ALL SELECT vendor_id, 'disqualified', epoch(submitted_at)::BIGINT, bid_id FROM bids WHERE is_disqualified
UNION ALL SELECT vendor_id, 'awarded', epoch(submitted_at)::BIGINT, bid_id FROM bids WHERE status = 'Awarded' UNION ALL SELECT vendor_id, 'delivery', epoch(delivered_at)::BIGINT, po_id FROM deliveries
UNION ALL SELECT vendor_id, 'payment', epoch(created_at)::BIGINT, po_id FROM purchase_orders WHERE invoice_amount IS NOT NULL""")
def vendor_timeline(t):
    b, row = t.bids(), lambda df, kind, at, ref: df.select("vendor_id", F.lit(kind).alias("kind"), F.unix_timestamp(at).alias("at"), F.col(ref).alias("ref"))
    parts = [row(b, "bid", "submitted_at", "bid_id"), row(b.filter("is_disqualified"), "disqualified", "submitted_at", "bid_id"), row(b.filter("status = 'Awarded'"), "awarded", "submitted_at", "bid_id"),
             row(t.deliveries(), "delivery", "delivered_at", "po_id"), row(t.purchase_orders().filter("invoice_amount is not null"), "payment", "created_at", "po_id")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
WITH gaps AS (SELECT tender_id, min((total_amount - prev) / prev * 100) AS gap FROM (SELECT tender_id, total_amount, lag(total_amount) OVER (PARTITION BY tender_id ORDER BY total_amount, bid_id) AS prev FROM bids) WHERE prev > 0 GROUP BY 1),
per AS (SELECT tender_id, count(*) AS n, min(total_amount) AS l1, any_value(estimated_value) AS est FROM bid_fact GROUP BY 1),
feed AS (SELECT 'BID_CLUSTERING' AS rule, 1 AS severity, tender_id AS ref FROM gaps WHERE gap < 0.5 UNION ALL SELECT 'PRICE_DUMPING', 2, tender_id FROM per WHERE l1 < 0.5 * est
 UNION ALL SELECT 'LOW_COMPETITION', 3, tender_id FROM per WHERE n < 3 UNION ALL SELECT DISTINCT 'BLACKLISTED_ACTIVE', 1, vendor_id FROM bid_fact WHERE is_blacklisted)
SELECT rule, severity, ref FROM feed ORDER BY severity, rule, ref LIMIT 20""")
def threat_feed(t):
    f = t.bid_fact()
    prev = F.lag("total_amount").over(W.partitionBy("tender_id").orderBy("total_amount", "bid_id"))
    gaps = f.select("tender_id", (100 * (F.col("total_amount") - prev) / F.when(prev > 0, prev)).alias("gap")).groupBy("tender_id").agg(F.min("gap").alias("gap"))
    per = f.groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"), F.min("total_amount").alias("l1"), F.first("estimated_value").alias("est"))
    row = lambda df, rule, severity, ref: df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(ref).alias("ref"))
    feed = row(gaps.filter("gap < 0.5"), "BID_CLUSTERING", 1, "tender_id").unionByName(row(per.filter("l1 < 0.5 * est"), "PRICE_DUMPING", 2, "tender_id"))
    feed = feed.unionByName(row(per.filter("n < 3"), "LOW_COMPETITION", 3, "tender_id")).unionByName(row(f.filter("is_blacklisted").select("vendor_id").distinct(), "BLACKLISTED_ACTIVE", 1, "vendor_id"))
    return R.page(feed, ["severity", "rule", "ref"], 0, 20)


@query("""
WITH feed AS (SELECT 'CLOSING_SOON' AS rule, count(*) AS n FROM tenders WHERE closing_at BETWEEN TIMESTAMP '1998-09-01' AND TIMESTAMP '1998-09-04' UNION ALL SELECT 'PENDING_EVALUATION', count(*) FROM bids WHERE status = 'Submitted'
 UNION ALL SELECT 'BLACKLISTED', count(*) FROM vendors WHERE is_blacklisted UNION ALL SELECT 'FEW_BIDS', count(*) FROM (SELECT tender_id FROM bids GROUP BY 1 HAVING count(*) < 3) UNION ALL SELECT 'FAILED_DELIVERY', count(*) FROM deliveries WHERE inspection = 'Failed')
SELECT rule, n FROM feed WHERE n > 0 UNION ALL SELECT 'ALL_CLEAR', 0 WHERE NOT EXISTS (SELECT 1 FROM feed WHERE n > 0)""")
def insight_feed(t, as_of="1998-09-01", days=3):
    start = F.lit(as_of).cast("timestamp")
    soon = t.tenders().filter(F.col("closing_at").between(start, start + F.expr(f"interval {days} days")))
    found = {"CLOSING_SOON": soon, "PENDING_EVALUATION": t.bids().filter("status = 'Submitted'"), "BLACKLISTED": t.vendors().filter("is_blacklisted"),
             "FEW_BIDS": t.bids().groupBy("tender_id").count().filter("count < 3"), "FAILED_DELIVERY": t.deliveries().filter("inspection = 'Failed'")}
    feed = None
    for rule, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        feed = one if feed is None else feed.unionByName(one)
    clear = feed.agg(F.max("n").alias("m")).filter("m = 0").select(F.lit("ALL_CLEAR").alias("rule"), F.lit(0).cast("bigint").alias("n"))
    return feed.filter("n > 0").unionByName(clear)


@query("""
WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1),
s AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS k FROM w a JOIN w b USING (w) WHERE a.item_id % 100 = 0 AND a.item_id <> b.item_id GROUP BY 1, 2)
SELECT a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM s JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b""")
def set_similarity(t):
    """Every hundredth item as a query against all items, by the words they share."""
    items = t.raw("benchmark").select("item_id", "text")
    queries = items.filter("item_id % 100 = 0").withColumnRenamed("item_id", "a")
    return X.word_overlap(queries, items.withColumnRenamed("item_id", "b"), "a", "b").filter("a != b").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""
WITH {QCBS.strip()}, y AS (SELECT * FROM ranked JOIN vendors USING (vendor_id))
SELECT tender_id, bid_id, CASE WHEN is_disqualified THEN 'DQ' WHEN rank IS NULL THEN '-' ELSE rank::VARCHAR END AS "Rank", vendor_name AS "Vendor Name", 'GEM-' || vendor_id::VARCHAR AS "GEM Reg No",
  CASE WHEN msme THEN 'Yes' ELSE 'No' END AS "MSME", CASE WHEN make_in_india THEN 'Yes' ELSE 'No' END AS "Make in India", round((total_amount / 1.18)::DECIMAL(38,9), 4)::DOUBLE AS "Bid Amount",
  round((total_amount - total_amount / 1.18)::DECIMAL(38,9), 4)::DOUBLE AS "Taxes", round((total_amount)::DECIMAL(38,9), 4)::DOUBLE AS "Total Amount", round((technical)::DECIMAL(38,9), 4)::DOUBLE AS "Technical Score", round((financial)::DECIMAL(38,9), 4)::DOUBLE AS "Financial Score",
  round((composite)::DECIMAL(38,9), 4)::DOUBLE AS "Composite Score", status AS "Status", CASE WHEN is_disqualified THEN 'Disqualified' WHEN rank IS NULL THEN 'Below threshold' END AS "Disqualification Reason" FROM y""")
def export_comparative_csv(t):
    """The comparative sheet of 13 columns (after the tender's and the bid's id), written as CSV and read back."""
    from ..operators.sequences import qcbs
    from ..sources.files import comparative_sheet, csv_round_trip

    rows = qcbs(t.bids(), t.bid_scores(), t.criteria()).join(t.vendors(), "vendor_id").withColumn("gem_reg_no", F.concat(F.lit("GEM-"), "vendor_id"))
    rows = rows.withColumn("bid_amount", F.col("total_amount") / 1.18).withColumn("taxes", F.col("total_amount") - F.col("total_amount") / 1.18)
    reason = F.when(F.col("is_disqualified"), "Disqualified").when(F.col("rank").isNull(), "Below threshold")
    return csv_round_trip(comparative_sheet(rows.withColumn("disqualification_reason", reason)))


@query("SELECT text, source || '/' || doc_id AS file_path, 'OCR Engine Cascade' AS engine_used, 0.85::DOUBLE AS confidence FROM documents")
def scan_json_documents(t):
    from ..sources.files import json_documents, write_json_documents

    return json_documents(t.spark, write_json_documents(t.documents().select("text", F.concat("source", F.lit("/"), "doc_id").alias("file_path"))))


@query()
def scan_file_listing(t):
    from ..sources.files import file_listing

    return file_listing(t.spark, t.dir)


@query("SELECT tender_id, count(*) AS bids, count(*) FILTER (total_amount > 0) AS priced FROM bids GROUP BY 1")
def positive_amounts(t):
    return t.bids().groupBy("tender_id").agg(F.count(F.lit(1)).alias("bids"), F.count(positive(F.col("total_amount"))).alias("priced"))
