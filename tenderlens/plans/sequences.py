"""Queries of rankings, windows and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import above, count_if, ladder
from ..operators import sequences as S
from .aggregates import r
from .registry import query
from .shared import QCBS, exact

@query(f"WITH {QCBS} SELECT bid_id, tender_id, vendor_id, round((technical)::DECIMAL(38,9), 6)::DOUBLE AS technical, round(financial, 6) AS financial, round((composite)::DECIMAL(38,9), 6)::DOUBLE AS composite, qualified, rank FROM ranked")
def qcbs_rank(t):
    q = S.qcbs(t.bids(), t.bid_scores(), t.criteria())
    return q.select("bid_id", "tender_id", "vendor_id", exact("technical").alias("technical"), r("financial").alias("financial"), exact("composite").alias("composite"), "qualified", "rank")


@query("""
SELECT bid_id, criteria_name, round(score / max_score * 100, 6) AS pct, round(100 * weight / sum(weight) OVER (PARTITION BY bid_id), 6) AS weight_pct, round(score / max_score * weight, 6) AS contribution, score / max_score * 100 >= threshold AS passes FROM bid_scores JOIN criteria USING (criteria_id)""")
def criteria_breakdown(t):
    j = t.bid_scores().join(F.broadcast(t.criteria()), "criteria_id")  # three rows
    pct = F.col("score") / F.col("max_score") * 100
    return j.select("bid_id", "criteria_name", r(pct).alias("pct"), r(100 * F.col("weight") / F.sum("weight").over(W.partitionBy("bid_id"))).alias("weight_pct"), r(F.col("score") / F.col("max_score") * F.col("weight")).alias("contribution"), (pct >= F.col("threshold")).alias("passes"))


@query(f"""
WITH {QCBS} SELECT tender_id, bid_id, vendor_name, round((composite)::DECIMAL(38,9), 6)::DOUBLE AS composite, coalesce(rank::VARCHAR, 'DQ') AS place, round((total_amount - min(total_amount) OVER (PARTITION BY tender_id)) / total_amount * 100, 6) AS above_l1_pct,
 row_number() OVER (PARTITION BY tender_id ORDER BY NOT qualified, rank, vendor_name, bid_id) AS line FROM ranked JOIN vendors USING (vendor_id)""")
def comparative_statement(t):
    q = S.qcbs(t.bids(), t.bid_scores(), t.criteria()).join(t.vendors().select("vendor_id", "vendor_name"), "vendor_id")
    tender = W.partitionBy("tender_id")
    return q.select("tender_id", "bid_id", "vendor_name", exact("composite").alias("composite"), F.coalesce(F.col("rank").cast("string"), F.lit("DQ")).alias("place"), r((F.col("total_amount") - F.min("total_amount").over(tender)) / F.col("total_amount") * 100).alias("above_l1_pct"), F.row_number().over(tender.orderBy(~F.col("qualified"), "rank", "vendor_name", "bid_id")).alias("line"))


@query("""
SELECT tender_id, bid_id, round(gap, 6) AS gap_pct, CASE WHEN gap < 0.5 THEN 'CRITICAL' WHEN gap < 2 THEN 'HIGH' WHEN gap < 5 THEN 'MODERATE' ELSE 'LOW' END AS level
FROM (SELECT tender_id, bid_id, (total_amount - lag(total_amount) OVER w) / lag(total_amount) OVER w * 100 AS gap FROM bids WINDOW w AS (PARTITION BY tender_id ORDER BY total_amount, bid_id)) WHERE gap IS NOT NULL""")
def bid_gap_clusters(t):
    g = t.bids().withColumn("gap", S.adjacent_gap("tender_id", "total_amount", "bid_id")).filter("gap is not null")
    return g.select("tender_id", "bid_id", r("gap").alias("gap_pct"), ladder(F.col("gap"), [(0.5, "CRITICAL"), (2, "HIGH"), (5, "MODERATE")], "LOW").alias("level"))


@query("""
WITH m AS (SELECT tender_id, avg(total_amount) AS mu, stddev_samp(total_amount) AS sd FROM bids WHERE NOT is_disqualified GROUP BY 1)
SELECT bid_id, tender_id, round(z, 5) AS z, CASE WHEN abs(z) > 2.5 THEN 'critical' ELSE 'outlier' END AS level FROM (SELECT bid_id, tender_id, (total_amount - mu) / sd AS z FROM bids JOIN m USING (tender_id) WHERE sd > 0) WHERE abs(z) > 1.5""")
def zscore_outliers(t):
    m = t.bids().filter("not is_disqualified").groupBy("tender_id").agg(F.avg("total_amount").alias("mu"), F.stddev_samp("total_amount").alias("sd")).filter("sd > 0")
    z = t.bids().join(m, "tender_id").withColumn("z", (F.col("total_amount") - F.col("mu")) / F.col("sd")).filter("abs(z) > 1.5")
    return z.select("bid_id", "tender_id", r("z", 5).alias("z"), F.when(F.abs("z") > 2.5, "critical").otherwise("outlier").alias("level"))


@query("SELECT bid_id, round(per, 6) AS per, CASE WHEN per < 0.7 THEN 'PREDATORY' WHEN per < 0.95 THEN 'COMPETITIVE' WHEN per < 1.05 THEN 'FAIR' WHEN per < 1.3 THEN 'HIGH' ELSE 'EXCESSIVE' END AS assessment FROM (SELECT bid_id, total_amount / estimated_value AS per FROM bid_fact WHERE estimated_value > 0)")
def price_to_estimate(t):
    p = t.bid_fact().filter("estimated_value > 0").select("bid_id", (F.col("total_amount") / F.col("estimated_value")).alias("per"))
    return p.select("bid_id", r("per").alias("per"), ladder(F.col("per"), [(0.7, "PREDATORY"), (0.95, "COMPETITIVE"), (1.05, "FAIR"), (1.3, "HIGH")], "EXCESSIVE").alias("assessment"))


@query("""
WITH u AS (SELECT bid_id, tender_id, (0.45 * (lo / total_amount) ** 2 * 100 + 0.25 * performance_score + 0.30 * score_1) * (1 + CASE WHEN msme AND total_amount <= 1.15 * lo THEN 0.25 ELSE 0 END + CASE WHEN make_in_india AND total_amount <= 1.20 * lo THEN 0.15 ELSE 0 END) AS u FROM (SELECT *, min(total_amount) OVER (PARTITION BY tender_id) AS lo FROM bid_fact)),
e AS (SELECT *, exp((u - max(u) OVER (PARTITION BY tender_id)) / 12) AS e FROM u) SELECT bid_id, tender_id, round(u, 6) AS utility, round(100 * e / sum(e) OVER (PARTITION BY tender_id), 6) AS probability FROM e""")
def winner_probability(t):
    w = W.partitionBy("tender_id")
    f = t.bid_fact().withColumn("lo", F.min("total_amount").over(w))
    x, lo = F.col("total_amount"), F.col("lo")
    bonus = 1 + F.when(F.col("msme") & (x <= 1.15 * lo), 0.25).otherwise(0.0) + F.when(F.col("make_in_india") & (x <= 1.20 * lo), 0.15).otherwise(0.0)
    u = f.withColumn("u", (0.45 * (lo / x) ** 2 * 100 + 0.25 * F.col("performance_score") + 0.30 * F.col("score_1")) * bonus)
    e = u.withColumn("e", F.exp((F.col("u") - F.max("u").over(w)) / 12))
    return e.select("bid_id", "tender_id", r("u").alias("utility"), r(100 * F.col("e") / F.sum("e").over(w)).alias("probability"))


@query("SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM audit")
def inter_arrival(t):
    at = F.unix_micros("ts")
    return t.audit().select("event_id", "user_id", (at - F.lag(at).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap_us"))


BURSTS = """
marks AS (SELECT user_id, epoch(ts)::BIGINT AS at_ FROM audit), isl AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce((at_ - lag(at_) OVER (PARTITION BY user_id ORDER BY at_) > 300)::INT, 1) AS new FROM marks)),
bursts AS (SELECT user_id, min(at_) AS start, count(*) AS members, max(at_) - min(at_) AS span FROM isl GROUP BY user_id, island HAVING count(*) >= 2)
"""


@query("WITH" + BURSTS.replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT") + "SELECT user_id, start, members, span FROM bursts")
def bid_bursts(t):
    return S.bursts(t.audit().select("user_id", F.unix_timestamp("ts").alias("at")), "user_id", "at", 300)


@query("WITH" + BURSTS.replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT") + """, c AS (SELECT user_id, hour(ts) AS h, count(*) AS c FROM audit GROUP BY 1, 2), e AS (SELECT user_id, count(*) AS bins, CASE WHEN count(*) = 1 THEN 100 ELSE (1 - (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*))) * 100 END AS score FROM c GROUP BY 1),
b AS (SELECT user_id, count(*) AS bursts FROM bursts GROUP BY 1)
SELECT user_id, round(score, 6) AS score, coalesce(bursts, 0) AS bursts, CASE WHEN score > 70 OR coalesce(bursts, 0) >= 3 THEN 'CRITICAL' WHEN score > 45 OR coalesce(bursts, 0) >= 2 THEN 'HIGH' WHEN score > 25 OR coalesce(bursts, 0) >= 1 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM e LEFT JOIN b USING (user_id)""")
def timing_coordination(t):
    return S.timing(t.audit(), "user_id", "ts").withColumn("score", r("score"))


@query("""
WITH c AS (SELECT user_id, max(ts) + INTERVAL 1 HOUR AS closing FROM audit GROUP BY 1), x AS (SELECT user_id, (epoch_us(closing) - epoch_us(ts)) / 3.6e9 AS h, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3.6e9 AS gap FROM audit JOIN c USING (user_id))
SELECT user_id, count(*) AS n, count(*) FILTER (h < 2) AS last_minute, count(*) FILTER (h > 168) AS early, count(*) FILTER (gap < 0.5) AS close, CASE WHEN count(*) FILTER (h < 2) * 2 > count(*) THEN 'CRITICAL' WHEN count(*) FILTER (gap < 0.5) > 0 THEN 'HIGH' ELSE 'LOW' END AS risk FROM x GROUP BY 1""")
def last_minute_bids(t):
    at, order = F.unix_micros("ts"), W.partitionBy("user_id").orderBy("ts", "event_id")
    x = t.audit().select("user_id", ((F.max(at).over(W.partitionBy("user_id")) + 3_600_000_000 - at) / 3.6e9).alias("h"), ((at - F.lag(at).over(order)) / 3.6e9).alias("gap"))
    a = x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("h") < 2).alias("last_minute"), count_if(F.col("h") > 168).alias("early"), count_if(F.col("gap") < 0.5).alias("close"))
    return a.withColumn("risk", F.when(F.col("last_minute") * 2 > F.col("n"), "CRITICAL").when(F.col("close") > 0, "HIGH").otherwise("LOW"))


@query("""
WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM audit), e(user_id, event_id, i, value, ewma) AS (SELECT user_id, event_id, i, value, value FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, o.value, 2 / 11.0::DOUBLE * o.value + (1 - 2 / 11.0::DOUBLE) * e.ewma FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1),
x AS (SELECT *, abs(value - ewma) AS res FROM e), s AS (SELECT user_id, avg(res) + 2 * stddev_pop(res) AS limit_ FROM x GROUP BY 1)
SELECT user_id, event_id, round(ewma, 6) AS ewma, round(limit_, 6) AS threshold, res > limit_ AS alert, res > 1.5 * limit_ AS high FROM x JOIN s USING (user_id)""", recursive=True)
def ewma_control_chart(t):
    e = S.ewma(t.audit().select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 10)
    w = W.partitionBy("user_id")
    x = e.withColumn("threshold", F.avg("residual").over(w) + 2 * F.stddev_pop("residual").over(w))
    return x.select("user_id", "event_id", r("ewma").alias("ewma"), r("threshold").alias("threshold"), (F.col("residual") > F.col("threshold")).alias("alert"), (F.col("residual") > 1.5 * F.col("threshold")).alias("high"))


@query("""
WITH o AS (SELECT vendor_id, total_amount AS y, row_number() OVER (PARTITION BY vendor_id ORDER BY submitted_at, bid_id)::DOUBLE AS x FROM bids), a AS (SELECT vendor_id, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS icept, regr_r2(y, x) AS r2 FROM o GROUP BY 1 HAVING count(*) >= 3)
SELECT vendor_id, n, round(slope, 5) AS slope, round(icept + slope * (n + 1), 4) AS next_value, round(r2, 6) AS r2, CASE WHEN slope > 1 THEN 'RISING' WHEN slope < -1 THEN 'FALLING' ELSE 'STABLE' END AS trend, CASE WHEN r2 > 0.7 THEN 'HIGH' WHEN r2 > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM a""")
def linear_bid_forecast(t, step=1.0):
    o = t.bids().select("vendor_id", F.col("total_amount").alias("y"), F.row_number().over(W.partitionBy("vendor_id").orderBy("submitted_at", "bid_id")).cast("double").alias("x"))
    a = o.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("icept"), F.regr_r2("y", "x").alias("r2")).filter("n >= 3")
    trend = F.when(F.col("slope") > step, "RISING").when(F.col("slope") < -step, "FALLING").otherwise("STABLE")
    return a.select("vendor_id", "n", r("slope", 5).alias("slope"), r(F.col("icept") + F.col("slope") * (F.col("n") + 1), 4).alias("next_value"), r("r2").alias("r2"), trend.alias("trend"), F.when(F.col("r2") > 0.7, "HIGH").when(F.col("r2") > 0.3, "MEDIUM").otherwise("LOW").alias("confidence"))


@query("""
WITH m AS (SELECT category, month(submitted_at) AS month, avg(total_amount) / 10 AS v FROM bid_fact GROUP BY 1, 2), f AS (SELECT category, regr_slope(v, month) AS s, regr_intercept(v, month) AS i FROM m GROUP BY 1)
SELECT f.category, k.month, round(coalesce(v, greatest(50, least(300, i + s * k.month))), 5) AS price_index, v IS NULL AS filled FROM f CROSS JOIN (SELECT unnest(range(1, 13))::BIGINT AS month) k LEFT JOIN m ON m.category = f.category AND m.month = k.month""")
def price_index_gapfill(t, scale=10.0):
    """Twelve months of each category; months without bids take the fitted line within [50, 300]."""
    m = t.bid_fact().withColumn("month", F.month("submitted_at").cast("bigint")).groupBy("category", "month").agg((F.avg("total_amount") / scale).alias("v"))
    f = m.groupBy("category").agg(F.regr_slope("v", "month").alias("s"), F.regr_intercept("v", "month").alias("i"))
    spine = f.withColumn("month", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint"))))
    fit = F.greatest(F.lit(50.0), F.least(F.lit(300.0), F.col("i") + F.col("s") * F.col("month")))
    return spine.join(m, ["category", "month"], "left").select("category", "month", r(F.coalesce("v", fit), 5).alias("price_index"), F.col("v").isNull().alias("filled"))


@query("""
WITH o AS (SELECT vendor_id, score_1, row_number() OVER (PARTITION BY vendor_id ORDER BY submitted_at, bid_id) AS i, count(*) OVER (PARTITION BY vendor_id) AS n FROM bids), a AS (SELECT vendor_id, avg(score_1) FILTER (i <= n // 2) AS a, avg(score_1) FILTER (i > n // 2) AS b FROM o GROUP BY 1 HAVING any_value(n) >= 2)
SELECT vendor_id, round(a, 6) AS first_half, round(b, 6) AS second_half, CASE WHEN b - a > 2 THEN 'IMPROVING' WHEN b - a < -2 THEN 'DECLINING' ELSE 'STABLE' END AS trend FROM a""")
def half_split_trend(t):
    w = W.partitionBy("vendor_id")
    o = t.bids().select("vendor_id", "score_1", F.row_number().over(w.orderBy("submitted_at", "bid_id")).alias("i"), F.count(F.lit(1)).over(w).alias("n")).filter("n >= 2")
    half = F.expr("n div 2")
    a = o.groupBy("vendor_id").agg(F.avg(F.when(F.col("i") <= half, F.col("score_1"))).alias("a"), F.avg(F.when(F.col("i") > half, F.col("score_1"))).alias("b"))
    d = F.col("b") - F.col("a")
    return a.select("vendor_id", r("a").alias("first_half"), r("b").alias("second_half"), F.when(d > 2, "IMPROVING").when(d < -2, "DECLINING").otherwise("STABLE").alias("trend"))


WINNERS = """
win AS (SELECT tender_id, category, arg_min(vendor_id, (total_amount, vendor_id)) AS winner, any_value(closing_at) AS closed FROM bid_fact WHERE status = 'Awarded' GROUP BY 1, 2),
trans AS (SELECT category, winner AS from_item, nxt AS to_item, count(*) AS n FROM (SELECT *, lead(winner) OVER (PARTITION BY category ORDER BY closed, tender_id) AS nxt FROM win) WHERE nxt IS NOT NULL GROUP BY ALL)
"""


def winners(t):
    f = t.bid_fact().filter("status = 'Awarded'")
    return f.groupBy("tender_id", "category").agg(F.min_by("vendor_id", F.struct("total_amount", "vendor_id")).alias("winner"), F.first("closing_at").alias("at"))


@query(f"WITH {WINNERS} SELECT * FROM trans")
def winner_transitions(t):
    return S.transitions(winners(t), "category", ["at", "tender_id"], "winner")


@query(f"""
WITH {WINNERS}, rows_ AS (SELECT category, from_item, sum((n / total) ** 2) AS h, count(*) AS k FROM (SELECT *, sum(n) OVER (PARTITION BY category, from_item) AS total FROM trans) GROUP BY 1, 2), x AS (SELECT category, avg(h) AS idx, bool_and(k = 1) AS cycle FROM rows_ GROUP BY 1)
SELECT category, round(idx, 6) AS rotation_index, CASE WHEN idx >= 0.8 THEN 'CRITICAL' WHEN idx >= 0.5 THEN 'HIGH' WHEN idx >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS risk, cycle AS deterministic FROM x""")
def rotation_index(t):
    n = winner_transitions(t)
    share = F.col("n") / F.sum("n").over(W.partitionBy("category", "from_item"))
    rows = n.withColumn("p", share).groupBy("category", "from_item").agg(F.sum(F.col("p") ** 2).alias("h"), F.count(F.lit(1)).alias("k"))
    x = rows.groupBy("category").agg(F.avg("h").alias("i"), F.min(F.col("k") == 1).alias("deterministic"))
    return x.select("category", r("i").alias("rotation_index"), above(F.col("i"), [(0.8, "CRITICAL"), (0.5, "HIGH"), (0.3, "MODERATE")], "LOW").alias("risk"), "deterministic")


@query(f"WITH {WINNERS} SELECT category, count(*) AS awards, count(DISTINCT winner) AS winners, count(DISTINCT winner) = count(*) AS perfect FROM win GROUP BY 1 HAVING count(*) >= 3")
def perfect_rotation(t):
    a = winners(t).groupBy("category").agg(F.count(F.lit(1)).alias("awards"), F.count_distinct("winner").alias("winners"))
    return a.filter("awards >= 3").withColumn("perfect", F.col("winners") == F.col("awards"))


@query("""
SELECT bid_id, tender_id, coalesce(l1, 0) AS current_l1, l1 IS NULL OR total_amount < l1 AS accepted FROM (SELECT bid_id, tender_id, total_amount, min(total_amount) OVER (PARTITION BY tender_id ORDER BY submitted_at, bid_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l1 FROM bids)""")
def running_l1_auction(t):
    before = W.partitionBy("tender_id").orderBy("submitted_at", "bid_id").rowsBetween(W.unboundedPreceding, -1)
    b = t.bids().withColumn("l1", F.min("total_amount").over(before))
    return b.select("bid_id", "tender_id", F.coalesce("l1", F.lit(0.0)).alias("current_l1"), (F.col("l1").isNull() | (F.col("total_amount") < F.col("l1"))).alias("accepted"))


OTHERS = """
o AS (SELECT *, arg_min(bid_id, total_amount + bid_id / 1e18) OVER w AS l1_bid, min(total_amount) OVER w AS l1 FROM bids WINDOW w AS (PARTITION BY tender_id)),
others AS (SELECT *, CASE WHEN bid_id = l1_bid THEN min(total_amount) FILTER (bid_id <> l1_bid) OVER (PARTITION BY tender_id) ELSE l1 END AS others FROM o)
"""


@query("WITH" + OTHERS + "SELECT bid_id, round((0.99 * others)::DECIMAL(38,9), 6)::DOUBLE AS optimum, round(d, 5) AS deviation, CASE WHEN d > 3 THEN 'PASSIVE' WHEN d < -3 THEN 'AGGRESSIVE' ELSE 'OPTIMAL' END AS strategy FROM (SELECT *, (total_amount - 0.99 * others) / (0.99 * others) * 100 AS d FROM others WHERE others IS NOT NULL)")
def leave_one_out_min(t):
    o = S.leave_one_out(t.bids(), "tender_id", "total_amount", "bid_id").filter("others is not null")
    best = 0.99 * F.col("others")
    d = (F.col("total_amount") - best) / best * 100
    return o.select("bid_id", exact(best).alias("optimum"), r(d, 5).alias("deviation"), F.when(d > 3, "PASSIVE").when(d < -3, "AGGRESSIVE").otherwise("OPTIMAL").alias("strategy"))


@query("WITH" + OTHERS + "SELECT vendor_id, count(*) AS tenders, round(sum(greatest(0, others - total_amount)), 4) AS impact, CASE WHEN sum(greatest(0, others - total_amount)) > 5000 THEN 'CRITICAL' WHEN sum(greatest(0, others - total_amount)) > 1000 THEN 'HIGH' ELSE 'LOW' END AS criticality FROM others WHERE others IS NOT NULL GROUP BY 1")
def vendor_removal_impact(t, critical=5000, high=1000):
    o = S.leave_one_out(t.bids(), "tender_id", "total_amount", "bid_id").filter("others is not null")
    a = o.groupBy("vendor_id").agg(F.count(F.lit(1)).alias("tenders"), F.sum(F.greatest(F.lit(0.0), F.col("others") - F.col("total_amount"))).alias("x"))
    return a.select("vendor_id", "tenders", r("x", 4).alias("impact"), F.when(F.col("x") > critical, "CRITICAL").when(F.col("x") > high, "HIGH").otherwise("LOW").alias("criticality"))


@query("SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM audit) WHERE n > 2")
def sliding_window_rate(t, seconds=3600, limit=2):
    w = W.partitionBy("user_id").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return t.audit().withColumn("us", F.unix_micros("ts")).withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") > limit).select("event_id", "user_id", "n")


COLS = ["event_id", "user_id", "action", "details"]


def tampered(t):
    """Sealed chains per user with every 97th entry edited and every 101st link rewritten after sealing."""
    s = S.seal(t.audit().select(*COLS), "user_id", "event_id", COLS)
    s = s.withColumn("action", F.when(F.col("event_id") % 97 == 5, F.lit("edited")).otherwise(F.col("action")))
    return s.withColumn("prev_hash", F.when(F.col("event_id") % 101 == 7, F.lit("f" * 64)).otherwise(F.col("prev_hash")))


@query("SELECT event_id, user_id, CASE WHEN event_id % 101 = 7 THEN 'LINK_BREAK' WHEN event_id % 97 = 5 THEN 'CONTENT_TAMPERED' END AS fault FROM audit")
def audit_chain_verify(t):
    return S.verify(tampered(t), "user_id", "event_id", COLS).select("event_id", "user_id", "fault")


CHAIN = r"""
e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
  array_to_string(list_transform([event_id::VARCHAR, user_id::VARCHAR, action, details], lambda v: coalesce(replace(replace(v, '\', '\\'), '|', '\|'), '\N')), '|') AS content FROM audit),
c(user_id, event_id, k, prev_hash, hash) AS (
  SELECT user_id, event_id, k, repeat('0', 64), sha256(repeat('0', 64) || '|' || content) FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.k, c.hash, sha256(c.hash || '|' || e.content) FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)"""


@query(f"WITH {CHAIN.strip()} SELECT user_id, event_id, k AS block, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS newest, prev_hash, hash FROM c", recursive=True)
def ledger_blocks(t, most=None):
    """Blocks of each user's chain, newest first, with their hashes; ``most`` keeps that many a user."""
    w = W.partitionBy("user_id")
    a = S.seal(t.audit().select(*COLS), "user_id", "event_id", COLS)
    a = a.select("user_id", "event_id", F.row_number().over(w.orderBy("event_id")).alias("block"), F.row_number().over(w.orderBy(F.desc("event_id"))).alias("newest"), "prev_hash", "hash")
    return a.filter(F.col("newest") <= most) if most else a


@query("""
WITH m AS (SELECT category, date_trunc('month', submitted_at) AS m, avg(total_amount) AS p FROM bid_fact GROUP BY 1, 2)
SELECT category, strftime(m, '%Y-%m') AS month, row_number() OVER w AS idx, round((sin(2 * pi() * month(m) / 12))::DECIMAL(38,9), 6)::DOUBLE AS sin_month, round((cos(2 * pi() * month(m) / 12))::DECIMAL(38,9), 6)::DOUBLE AS cos_month, round(coalesce(p - lag(p) OVER w, 0), 5) AS momentum,
 round(avg(p) OVER (w ROWS 2 PRECEDING), 5) AS sma3, round(stddev_pop(p) OVER (w ROWS 2 PRECEDING), 5) AS std3 FROM m WINDOW w AS (PARTITION BY category ORDER BY m)""")
def seasonal_price_features(t):
    m = t.bid_fact().groupBy("category", F.date_trunc("month", "submitted_at").alias("m")).agg(F.avg("total_amount").alias("p"))
    w = W.partitionBy("category").orderBy("m")
    w3, angle = w.rowsBetween(-2, 0), 2 * F.pi() * F.month("m") / 12
    return m.select("category", F.date_format("m", "yyyy-MM").alias("month"), F.row_number().over(w).alias("idx"), exact(F.sin(angle)).alias("sin_month"), exact(F.cos(angle)).alias("cos_month"), r(F.coalesce(F.col("p") - F.lag("p").over(w), F.lit(0.0)), 5).alias("momentum"), r(F.avg("p").over(w3), 5).alias("sma3"), r(F.stddev_pop("p").over(w3), 5).alias("std3"))


STAGES = [(1, "browse", ["view", "search"]), (2, "select", ["click", "add_to_cart", "cart"]), (3, "buy", ["purchase", "checkout"]), (4, "after", ["refund", "logout", "error", "signup", "login"])]


@query("""
WITH s(stage, name, acts) AS (VALUES (1, 'browse', ['view', 'search']), (2, 'select', ['click', 'add_to_cart', 'cart']), (3, 'buy', ['purchase', 'checkout']), (4, 'after', ['refund', 'logout', 'error', 'signup', 'login']))
SELECT user_id, stage, name, arg_min(event_id, (ts, event_id)) AS event_id, min(epoch_us(ts)) AS at FROM audit JOIN s ON list_contains(acts, action) GROUP BY 1, 2, 3""")
def lifecycle_timeline(t):
    act = t.spark.createDataFrame([(i, n, a) for i, n, acts in STAGES for a in acts], "stage int, name string, action string")
    j = t.audit().join(F.broadcast(act), "action")  # the fixed stage table
    return j.groupBy("user_id", "stage", "name").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min(F.unix_micros("ts")).alias("at"))


@query(f"WITH {CHAIN.strip()} SELECT event_id, user_id, prev_hash, hash FROM c", recursive=True)
def audit_chain_seal(t):
    return S.seal(t.audit().select(*COLS), "user_id", "event_id", COLS).select("event_id", "user_id", "prev_hash", "hash")


@query("SELECT t.tender_id, CASE WHEN tender_status = 'Published' AND closing_at < TIMESTAMP '2001-09-08' THEN 'Under Evaluation' ELSE tender_status END AS new_status, coalesce(tender_status = 'Published' AND closing_at < TIMESTAMP '2001-09-08', false) AS changed FROM tenders t")
def deadline_transition(t, as_of="2001-09-08"):
    due = F.coalesce((F.col("tender_status") == "Published") & (F.col("closing_at") < F.lit(as_of).cast("timestamp")), F.lit(False))
    return t.tenders().select("tender_id", F.when(due, "Under Evaluation").otherwise(F.col("tender_status")).alias("new_status"), due.alias("changed"))


@query("SELECT tender_id, 'status_change' AS action, 'Published' AS old_value, 'Under Evaluation' AS new_value, epoch(closing_at)::BIGINT AS due FROM tenders WHERE tender_status = 'Published' AND closing_at < TIMESTAMP '2001-09-08'")
def deadline_audit_rows(t, as_of="2001-09-08"):
    """The audit rows of ``deadline_transition``: one for each tender whose state changes."""
    due = (F.col("tender_status") == "Published") & (F.col("closing_at") < F.lit(as_of).cast("timestamp"))
    return t.tenders().filter(due).select("tender_id", F.lit("status_change").alias("action"), F.lit("Published").alias("old_value"), F.lit("Under Evaluation").alias("new_value"), F.unix_timestamp("closing_at").alias("due"))
