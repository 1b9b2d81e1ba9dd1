"""Queries of the aggregations."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import above, avg0, count_if, ladder, ratio, share
from ..operators import prices as P
from ..operators import relational as R
from .registry import query
from .relational import GRUBBS, GRUBBS_SQL
from .shared import exact


def r(c, n=6):
    return F.round(c, n)


@query("SELECT status, coalesce(avg(human), 0.0) AS avg_score, count(human) AS n FROM (SELECT human_action AS status, human_score AS human FROM decisions) GROUP BY 1")
def agg_avg_count(t):
    return t.decisions().groupBy(F.col("human_action").alias("status")).agg(avg0(F.col("human_score")).alias("avg_score"), F.count("human_score").alias("n"))


@query("""
SELECT (SELECT count(*) FROM tenders) AS tenders, (SELECT count(*) FROM tenders WHERE tender_status = 'Published') AS published, count(*) AS bids, count(*) FILTER (status = 'Submitted') AS pending,
 round(avg(score_1 * 0.4 + score_2 * 0.35 + score_3 * 0.25), 6) AS avg_composite FROM bids""")
def dashboard_stats(t):
    a = t.tenders().agg(F.count(F.lit(1)).alias("tenders"), count_if(F.col("tender_status") == "Published").alias("published"))
    b = t.bids().agg(F.count(F.lit(1)).alias("bids"), count_if(F.col("status") == "Submitted").alias("pending"), r(avg0(F.col("score_1") * 0.4 + F.col("score_2") * 0.35 + F.col("score_3") * 0.25)).alias("avg_composite"))
    return a.crossJoin(b)  # one row each


@query("SELECT tender_status, count(*) AS n FROM tenders GROUP BY 1")
def status_distribution(t):
    return t.tenders().groupBy("tender_status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(submitted_at, '%Y-%m') AS month, count(*) AS n FROM bids GROUP BY 1 ORDER BY 1 LIMIT 6")
def monthly_bid_counts(t, latest=False):
    m = t.bids().groupBy(F.date_format("submitted_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return m.orderBy(F.desc("month") if latest else "month").limit(6)


@query("SELECT count(*) FILTER (po_status = 'O') AS open, count(*) FILTER (po_status = 'F') AS finished, count(*) FILTER (po_status = 'P') AS partial, count(*) AS orders FROM purchase_orders")
def stage_counts(t):
    s = F.col("po_status")
    return t.purchase_orders().agg(count_if(s == "O").alias("open"), count_if(s == "F").alias("finished"), count_if(s == "P").alias("partial"), F.count(F.lit(1)).alias("orders"))


@query("""
WITH g AS (SELECT *, lag(total_amount) OVER (PARTITION BY tender_id ORDER BY total_amount, bid_id) AS prev FROM bid_fact),
per AS (SELECT tender_id, min(total_amount) AS l1, max(total_amount) AS top, any_value(estimated_value) AS est, max((prev > 0 AND (total_amount - prev) / prev * 100 < 0.5)::INT) AS close, count(*) FILTER (NOT is_disqualified) AS ok, count(*) AS n, epoch(any_value(closing_at) - any_value(published_at)) / 86400 AS days FROM g GROUP BY 1)
SELECT round(avg(days) FILTER (days > 0), 6) AS cycle_days, round(avg((est - l1) / est * 100) FILTER (est > 0), 6) AS savings, (sum(coalesce(close, 0)) + count(*) FILTER (l1 < 0.5 * est) + (SELECT count(*) FROM vendors WHERE is_blacklisted))::BIGINT AS threats,
 round(100.0 * sum(ok) / sum(n), 6) AS compliance, count(*) AS with_bids, (SELECT count(*) FROM bids WHERE status = 'Awarded') AS awarded FROM per""")
def kpi_summary(t):
    f = t.bid_fact()
    prev = F.lag("total_amount").over(W.partitionBy("tender_id").orderBy("total_amount", "bid_id"))
    g = f.withColumn("close", (prev > 0) & (100 * (F.col("total_amount") - prev) / F.when(prev > 0, prev) < 0.5))
    per = g.groupBy("tender_id").agg(F.min("total_amount").alias("l1"), F.first("estimated_value").alias("est"), F.max(F.coalesce(F.col("close"), F.lit(False)).cast("int")).alias("close"), count_if(~F.col("is_disqualified")).alias("ok"), F.count(F.lit(1)).alias("n"), count_if(F.col("status") == "Awarded").alias("awarded"), ((F.unix_timestamp(F.first("closing_at")) - F.unix_timestamp(F.first("published_at"))) / 86400).alias("days"))
    a = per.agg(
        r(F.avg(F.when(F.col("days") > 0, F.col("days")))).alias("cycle_days"), r(F.avg((F.col("est") - F.col("l1")) / F.when(F.col("est") > 0, F.col("est")) * 100)).alias("savings"),
        (F.sum("close") + count_if(F.col("l1") < 0.5 * F.col("est"))).alias("t"), r(100.0 * F.sum("ok") / F.sum("n")).alias("compliance"), F.count(F.lit(1)).alias("with_bids"), F.sum("awarded").alias("awarded"),
    )
    black = t.vendors().agg(count_if(F.col("is_blacklisted")).alias("black"))
    return a.crossJoin(black).select("cycle_days", "savings", (F.col("t") + F.col("black")).alias("threats"), "compliance", "with_bids", "awarded")  # one row each


@query("""
WITH per AS (SELECT tender_id, any_value(category) AS category, any_value(estimated_value) AS est, count(*) AS n, min(total_amount) AS l1 FROM bid_fact GROUP BY 1)
SELECT category, count(*) AS tenders, round(sum(est), 4) AS value, sum(n)::BIGINT AS bids, round(avg((est - l1) / est * 100), 6) AS savings, round(sum(n) / count(*), 6) AS competition,
 CASE WHEN avg((est - l1) / est * 100) > 10 AND sum(n) / count(*) > 3 THEN 'STRONG' WHEN avg((est - l1) / est * 100) > 5 THEN 'MODERATE' ELSE 'WEAK' END AS health FROM per GROUP BY 1""")
def market_categories(t):
    per = t.bid_fact().groupBy("tender_id").agg(F.first("category").alias("category"), F.first("estimated_value").alias("est"), F.count(F.lit(1)).alias("n"), F.min("total_amount").alias("l1"))
    a = per.groupBy("category").agg(F.count(F.lit(1)).alias("tenders"), F.sum("est").alias("value"), F.sum("n").alias("bids"), F.avg((F.col("est") - F.col("l1")) / F.col("est") * 100).alias("savings"))
    comp = F.col("bids") / F.col("tenders")
    health = F.when((F.col("savings") > 10) & (comp > 3), "STRONG").when(F.col("savings") > 5, "MODERATE").otherwise("WEAK")
    return a.select("category", "tenders", r("value", 4).alias("value"), "bids", r("savings").alias("savings"), r(comp).alias("competition"), health.alias("health"))


@query("SELECT vendor_id, count(*) AS bids, count(*) FILTER (status = 'Awarded') AS wins, round(100.0 * count(*) FILTER (status = 'Awarded') / count(*), 6) AS win_pct, round(sum(total_amount), 4) AS value FROM bids GROUP BY 1")
def vendor_dominance(t):
    won = F.col("status") == "Awarded"
    return t.bids().groupBy("vendor_id").agg(F.count(F.lit(1)).alias("bids"), count_if(won).alias("wins"), r(100.0 * count_if(won) / F.count(F.lit(1))).alias("win_pct"), r(F.sum("total_amount"), 4).alias("value"))


@query("SELECT round(100.0 * count(*) FILTER (msme) / count(*), 6) AS msme_pct, round(100.0 * count(*) FILTER (make_in_india) / count(*), 6) AS mii_pct, count(*) FILTER (msme) * 4 >= count(*) AS compliant FROM bid_fact")
def policy_participation(t):
    n = F.count(F.lit(1))
    return t.bid_fact().agg(r(100.0 * count_if(F.col("msme")) / n).alias("msme_pct"), r(100.0 * count_if(F.col("make_in_india")) / n).alias("mii_pct"), (count_if(F.col("msme")) * 4 >= n).alias("compliant"))


@query("""
SELECT vendor_id, n, round(cv * 100, 6) AS cv_pct, CASE WHEN cv * 100 < 10 THEN 'Stable' WHEN cv * 100 < 25 THEN 'Variable' ELSE 'ERRATIC' END AS label
FROM (SELECT vendor_id, count(*) AS n, stddev_samp(total_amount) / avg(total_amount) AS cv FROM bids GROUP BY 1) WHERE n > 1""")
def price_consistency(t):
    v = P.variation(t.bids(), ["vendor_id"], "total_amount").filter("n > 1").withColumn("p", F.col("cv") * 100)
    return v.select("vendor_id", "n", r("p").alias("cv_pct"), ladder(F.col("p"), [(10, "Stable"), (25, "Variable")], "ERRATIC").alias("label"))


@query("""
WITH s AS (SELECT vendor_id, sum(total_amount) AS v FROM bids WHERE status = 'Awarded' GROUP BY 1), p AS (SELECT vendor_id, round(100 * v / (SELECT sum(v) FROM s), 2) AS share FROM s), h AS (SELECT sum(share * share) AS hhi FROM p)
SELECT vendor_id, share, round(share * share, 4) AS contribution, round(hhi, 4) AS hhi, CASE WHEN hhi < 1500 THEN 'COMPETITIVE' WHEN hhi < 2500 THEN 'MODERATE' ELSE 'CONCENTRATED' END AS label FROM p, h""")
def hhi(t):
    s = t.bids().filter("status = 'Awarded'").groupBy("vendor_id").agg(F.sum("total_amount").alias("v"))
    p = s.crossJoin(F.broadcast(s.agg(F.sum("v").alias("total")))).select("vendor_id", F.round(100 * F.col("v") / F.col("total"), 2).alias("share"))
    h = p.agg(F.sum(F.col("share") ** 2).alias("h"))
    return p.crossJoin(F.broadcast(h)).select("vendor_id", "share", r(F.col("share") ** 2, 4).alias("contribution"), r("h", 4).alias("hhi"), ladder(F.col("h"), [(1500, "COMPETITIVE"), (2500, "MODERATE")], "CONCENTRATED").alias("label"))


@query("""
SELECT tender_id, n, round(CASE WHEN n < 2 THEN 0 ELSE 2 * ix / (n * s) - (n + 1) / n END, 6) AS gini
FROM (SELECT tender_id, count(*) AS n, sum(i * total_amount) AS ix, sum(total_amount) AS s FROM (SELECT tender_id, total_amount, row_number() OVER (PARTITION BY tender_id ORDER BY total_amount) AS i FROM bids WHERE total_amount > 0) GROUP BY 1)""")
def gini(t):
    return P.gini(t.bids(), ["tender_id"], "total_amount").select("tender_id", "n", r("gini").alias("gini"))


@query("""
SELECT n, round(2 * ix / (n * s) - (n + 1) / n, 6) AS gini FROM (SELECT count(*) AS n, sum(i * total_amount) AS ix, sum(total_amount) AS s FROM (SELECT total_amount, row_number() OVER (ORDER BY total_amount) AS i FROM bids WHERE total_amount > 0))""")
def gini_all(t):
    return P.global_gini(t.bids(), "total_amount").select("n", r("gini").alias("gini"))


FENCES = """
q AS (SELECT tender_id, count(*) AS n, quantile_cont(total_amount, 0.25) AS q1, quantile_cont(total_amount, 0.5) AS q2, quantile_cont(total_amount, 0.75) AS q3 FROM bids GROUP BY 1),
fences AS (SELECT tender_id, n, CASE WHEN n < 4 THEN 0 ELSE q1 END AS q1, CASE WHEN n < 4 THEN 0 ELSE q2 END AS q2, CASE WHEN n < 4 THEN 0 ELSE q3 END AS q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high, q1 - 3 * (q3 - q1) AS far_low, q3 + 3 * (q3 - q1) AS far_high FROM q),
classed AS (SELECT bid_id, tender_id, total_amount, n, q1, q2, q3, CASE WHEN n < 4 THEN 'normal' WHEN total_amount < far_low OR total_amount > far_high THEN 'extreme' WHEN total_amount < low OR total_amount > high THEN 'mild' ELSE 'normal' END AS fence FROM bids JOIN fences USING (tender_id))
"""


@query(f"WITH {FENCES} SELECT bid_id, tender_id, round((q1)::DECIMAL(38,9), 6)::DOUBLE AS q1, round((q2)::DECIMAL(38,9), 6)::DOUBLE AS q2, round((q3)::DECIMAL(38,9), 6)::DOUBLE AS q3, fence FROM classed")
def tukey_fences(t):
    f = P.fences(t.bids(), "tender_id", "total_amount")
    out = t.bids().select("bid_id", "tender_id", "total_amount").join(f, "tender_id")
    return out.select("bid_id", "tender_id", exact("q1").alias("q1"), exact("q2").alias("q2"), exact("q3").alias("q3"), P.fence_class(F.col("total_amount")).alias("fence"))


GRUBBS_TEST = f"""
{GRUBBS_SQL},
dev AS (SELECT tender_id, bid_id, abs(total_amount - avg(total_amount) OVER w) AS dev, stddev_samp(total_amount) OVER w AS s, count(*) OVER w AS n FROM bids WINDOW w AS (PARTITION BY tender_id)),
top AS (SELECT * FROM dev QUALIFY row_number() OVER (PARTITION BY tender_id ORDER BY round(dev, 9) DESC, bid_id) = 1),
tested AS (SELECT tender_id, n, bid_id, CASE WHEN n >= 3 AND s > 0 THEN dev / s ELSE 0 END AS g, (SELECT arg_min(critical, abs(n - k) * 1000 + k) FROM grubbs) AS critical FROM top)
"""


@query(f"WITH {GRUBBS_TEST} SELECT tender_id, n, bid_id, round(g, 6) AS g, critical, g > critical AS significant FROM tested")
def grubbs_test(t):
    return tested(t).select("tender_id", "n", "bid_id", r("g").alias("g"), "critical", (F.col("g") > F.col("critical")).alias("significant"))


def tested(t):
    g = P.grubbs(t.bids(), "tender_id", "bid_id", "total_amount")
    return R.nearest_lookup(g, "n", t.spark.createDataFrame(GRUBBS, "k int, critical double"), "k", "critical")


SHAPE = """
m AS (SELECT tender_id, count(*) AS n, avg(total_amount) AS mu, stddev_pop(total_amount) AS sd FROM bids GROUP BY 1),
shape AS (SELECT b.tender_id, CASE WHEN any_value(sd) > 0 THEN avg(((total_amount - mu) / nullif(sd, 0)) ** 3) ELSE 0 END AS skew, CASE WHEN any_value(sd) > 0 THEN avg(((total_amount - mu) / nullif(sd, 0)) ** 4) - 3 ELSE -3 END AS kurt FROM bids b JOIN m USING (tender_id) GROUP BY 1)
"""


@query(f"""
WITH {SHAPE} SELECT tender_id, round(skew, 5) AS skew, round(kurt, 5) AS kurt, CASE WHEN skew > 0.5 THEN 'right' WHEN skew < -0.5 THEN 'left' ELSE 'symmetric' END AS skew_label, CASE WHEN kurt > 1 THEN 'heavy' WHEN kurt < -1 THEN 'light' ELSE 'normal' END AS kurt_label FROM shape""")
def shape_stats(t):
    return P.shape(t.bids(), "tender_id", "total_amount").withColumns({"skew": r("skew", 5), "kurt": r("kurt", 5)})


ENTROPY = """
bin AS (SELECT tender_id, CASE WHEN hi = lo THEN 0 ELSE least(4, floor((total_amount - lo) / (hi - lo) * 5)) END::INT AS bin FROM (SELECT tender_id, total_amount, min(total_amount) OVER w AS lo, max(total_amount) OVER w AS hi FROM bids WINDOW w AS (PARTITION BY tender_id))),
entropy AS (SELECT tender_id, sum(c)::BIGINT AS n, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(5) AS entropy FROM (SELECT tender_id, bin, count(*) AS c FROM bin GROUP BY 1, 2) GROUP BY 1)
"""


@query(f"WITH {ENTROPY} SELECT tender_id, n, round(entropy, 6) AS entropy, CASE WHEN round(entropy, 9) < 0.25 THEN 'CRITICAL' WHEN round(entropy, 9) < 0.5 THEN 'HIGH' WHEN round(entropy, 9) < 0.75 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM entropy")
def price_entropy(t):
    return P.price_entropy(t.bids(), "tender_id", "total_amount")


DIGITS = "ltrim(replace(round(total_amount, 4)::DECIMAL(30,4)::VARCHAR, '.', ''), '0')"
LAW = "law(place, digit, expected) AS (VALUES " + ", ".join([f"(1, {d}, {math.log10(1 + 1 / d)!r}::DOUBLE)" for d in range(1, 10)] + [f"(2, {d}, {sum(math.log10(1 + 1 / (10 * k + d)) for k in range(1, 10))!r}::DOUBLE)" for d in range(10)]) + ")"
BENFORD = f"""
{LAW}, s AS (SELECT vendor_id, {DIGITS} AS s FROM bids WHERE total_amount > 0),
c AS (SELECT vendor_id, place, substr(s, place, 1)::INT AS digit, count(*) AS c FROM s, (VALUES (1), (2)) p(place) GROUP BY ALL),
n AS (SELECT vendor_id, count(*) AS n FROM s GROUP BY 1),
benford AS (SELECT n.vendor_id, any_value(n) AS n, avg(abs(coalesce(c, 0) / n - expected)) FILTER (place = 1) AS mad_1, avg(abs(coalesce(c, 0) / n - expected)) FILTER (place = 2) AS mad_2 FROM n CROSS JOIN law LEFT JOIN c USING (vendor_id, place, digit) GROUP BY 1 HAVING any_value(n) >= 10)
"""
MAD_RISK = "CASE WHEN mad_1 > 0.12 OR mad_2 > 0.08 THEN 'CRITICAL' WHEN mad_1 > 0.06 OR mad_2 > 0.04 THEN 'HIGH' WHEN mad_1 > 0.03 OR mad_2 > 0.02 THEN 'MODERATE' ELSE 'LOW' END"


@query(f"WITH {BENFORD} SELECT vendor_id, n, round(mad_1, 6) AS mad_1, round(mad_2, 6) AS mad_2, {MAD_RISK} AS risk FROM benford")
def benford_mad(t):
    return P.benford_mad(t.bids(), ["vendor_id"], "total_amount")


@query(f"""
WITH {LAW}, s AS (SELECT vendor_id, substr({DIGITS}, 1, 1)::INT AS digit FROM bids WHERE total_amount > 0), n AS (SELECT vendor_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 10), c AS (SELECT vendor_id, digit, count(*) AS c FROM s GROUP BY ALL),
x AS (SELECT n.vendor_id, any_value(n) AS n, sum((coalesce(c, 0) - n * expected) ** 2 / (n * expected)) AS chi FROM n CROSS JOIN (SELECT * FROM law WHERE place = 1) l LEFT JOIN c USING (vendor_id, digit) GROUP BY 1)
SELECT vendor_id, n, round(chi, 6) AS chi2, chi > 15.5 AS fails FROM x""")
def benford_chi2(t):
    return P.benford_chi2(t.bids(), "vendor_id", "total_amount")


@query("SELECT vendor_id, n, round(cv, 6) AS cv, CASE WHEN cv < 0.02 THEN 'CRITICAL' WHEN cv < 0.05 THEN 'HIGH' WHEN cv < 0.10 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM (SELECT vendor_id, count(*) AS n, stddev_samp(total_amount) / avg(total_amount) AS cv FROM bids WHERE total_amount > 0 GROUP BY 1) WHERE n >= 3")
def cross_tender_cv(t):
    v = P.variation(t.bids(), ["vendor_id"], "total_amount").filter("n >= 3")
    return v.select("vendor_id", "n", r("cv").alias("cv"), ladder(F.col("cv"), [(0.02, "CRITICAL"), (0.05, "HIGH"), (0.10, "MODERATE")], "LOW").alias("risk"))


@query("""
WITH v AS (SELECT tender_id, count(*) AS n, stddev_samp(total_amount) / avg(total_amount) AS cv FROM bids WHERE total_amount > 0 GROUP BY 1)
SELECT tender_id, n, round(cv * 100, 6) AS cv_pct, cv > 0 AND cv < 0.01 AS low_variance FROM v WHERE n >= 3""")
def low_variance_tenders(t, most=0.01):
    """Tenders of three bids and more, with those whose bids vary by less than 1 % marked."""
    v = P.variation(t.bids(), ["tender_id"], "total_amount").filter("n >= 3")
    return v.select("tender_id", "n", r(F.col("cv") * 100).alias("cv_pct"), ((F.col("cv") > 0) & (F.col("cv") < most)).alias("low_variance"))


@query(f"""
SELECT tender_id, count(*) AS n, round(avg(total_amount), 6) AS mean, round((median(total_amount))::DECIMAL(38,9), 6)::DOUBLE AS median, round(coalesce(stddev_samp(total_amount), 0), 6) AS std, round(coalesce(stddev_samp(total_amount), 0) / avg(total_amount) * 100, 6) AS cv_pct, min(total_amount) AS low, max(total_amount) AS high,
 round((max(total_amount) - min(total_amount))::DECIMAL(38,9), 6)::DOUBLE AS spread, CASE WHEN count(*) > 10 THEN 'High' WHEN count(*) > 5 THEN 'Moderate' ELSE 'Low' END AS competition FROM bids WHERE NOT is_disqualified GROUP BY 1""")
def tender_price_stats(t):
    x = F.col("total_amount")
    a = t.bids().filter("not is_disqualified").groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.expr("percentile(total_amount, 0.5)").alias("median"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    return a.select("tender_id", "n", r("mean").alias("mean"), exact("median").alias("median"), r("std").alias("std"), r(F.col("std") / F.col("mean") * 100).alias("cv_pct"), "low", "high", exact(F.col("high") - F.col("low")).alias("spread"), above(F.col("n"), [(11, "High"), (6, "Moderate")], "Low").alias("competition"))


@query(f"""
WITH {FENCES}, {GRUBBS_TEST.strip()}, {ENTROPY.strip()}, {SHAPE.strip()}
SELECT c.bid_id, c.tender_id, CASE WHEN fence <> 'normal' THEN fence WHEN g.bid_id = c.bid_id AND g.g > critical THEN 'grubbs' ELSE 'normal' END AS outlier, round(entropy, 6) AS entropy, round(skew, 5) AS skew
FROM classed c JOIN tested g USING (tender_id) JOIN entropy USING (tender_id) JOIN shape USING (tender_id)""")
def quantile_analysis(t):
    b = t.bids()
    f, e, s = P.fences(b, "tender_id", "total_amount"), P.price_entropy(b, "tender_id", "total_amount").select("tender_id", "entropy"), P.shape(b, "tender_id", "total_amount").select("tender_id", r("skew", 5).alias("skew"))
    g = tested(t).filter(F.col("g") > F.col("critical")).select("tender_id", F.col("bid_id").alias("marked"))
    out = b.select("bid_id", "tender_id", "total_amount").join(f, "tender_id").join(e, "tender_id").join(s, "tender_id").join(g, "tender_id", "left")
    kind = P.fence_class(F.col("total_amount"))
    return out.select("bid_id", "tender_id", F.when(kind != "normal", kind).when(F.col("marked") == F.col("bid_id"), "grubbs").otherwise("normal").alias("outlier"), "entropy", "skew")


ACCURACY = "round(100.0 * count(*) FILTER (human_action = 'accepted') / count(*), 6) AS accepted, round(100.0 * count(*) FILTER (human_action = 'rejected') / count(*), 6) AS rejected, round(100.0 * count(*) FILTER (human_action = 'modified') / count(*), 6) AS modified, round(coalesce(avg(abs(ai_score - human_score)), 0), 6) AS deviation, round(avg(confidence), 6) AS confidence, round(avg(rating), 6) AS rating, count(*) AS n"


def accuracy(df, *keys):
    n = F.count(F.lit(1))
    part = lambda a: r(100.0 * count_if(F.col("human_action") == a) / n).alias(a)
    aggs = [part("accepted"), part("rejected"), part("modified"), r(avg0(F.abs(F.col("ai_score") - F.col("human_score")))).alias("deviation"), r(F.avg("confidence")).alias("confidence"), r(F.avg("rating")).alias("rating"), n.alias("n")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


@query(f"SELECT {ACCURACY} FROM decisions")
def decision_accuracy(t):
    return accuracy(t.decisions())


@query(f"SELECT coalesce(criteria_name, 'General') AS criteria, {ACCURACY} FROM decisions LEFT JOIN criteria USING (criteria_id) GROUP BY 1")
def decision_accuracy_by_criteria(t):
    named = t.decisions().join(F.broadcast(t.criteria()), "criteria_id", "left").withColumn("criteria", F.coalesce("criteria_name", F.lit("General")))
    return accuracy(named, "criteria")


@query(f"SELECT month, {ACCURACY} FROM decisions GROUP BY 1")
def decision_accuracy_by_month(t):
    return accuracy(t.decisions(), "month")


@query("""
SELECT bin * 20 AS low, count(confidence) AS n, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, round(coalesce(100.0 * count(*) FILTER (human_action = 'accepted') / nullif(count(confidence), 0), 0), 6) AS accepted
FROM (VALUES (0), (1), (2), (3), (4)) b(bin) LEFT JOIN decisions ON floor(round(confidence * 100, 6) / 20) = bin GROUP BY 1""")
def confidence_calibration(t):
    bins = t.spark.range(5).select(F.col("id").cast("int").alias("bin"))
    d = t.decisions().withColumn("bin", F.floor(F.round(F.col("confidence") * 100, 6) / 20).cast("int"))
    a = bins.join(d, "bin", "left").groupBy("bin").agg(F.count("confidence").alias("n"), avg0(F.col("confidence")).alias("c"), count_if(F.col("human_action") == "accepted").alias("a"))
    return a.select((F.col("bin") * 20).alias("low"), "n", r("c").alias("mean_confidence"), r(share(F.col("a"), F.col("n"))).alias("accepted"))


@query("""
WITH v AS (SELECT vendor_id, count(*) AS bids, count(*) FILTER (status = 'Awarded') AS wins, avg(total_amount / estimated_value) AS ratio, coalesce(stddev_samp(total_amount) / avg(total_amount), 0) AS vol, avg(delivery_period) AS days, count(*) FILTER (is_disqualified) AS dq, any_value(is_blacklisted) AS black FROM bid_fact GROUP BY 1),
x AS (SELECT *, wins / bids AS win_rate, dq / bids AS dq_rate FROM v)
SELECT vendor_id, bids, round(vol, 6) AS volatility, round(ratio, 6) AS price_ratio, round(win_rate, 6) AS win_rate, concat_ws(',', CASE WHEN vol > 1.05 THEN 'volatile' END, CASE WHEN vol < 0.2 THEN 'steady' END, CASE WHEN ratio < 0.9 THEN 'aggressive' END, CASE WHEN ratio > 1.7 THEN 'premium' END,
 CASE WHEN win_rate > 0.38 THEN 'dominant' END, CASE WHEN win_rate < 0.2 THEN 'cover' END, CASE WHEN dq_rate > 0.3 THEN 'careless' END, CASE WHEN black THEN 'blacklisted' END) AS traits FROM x""")
def vendor_behaviour_profile(t):
    a = t.bid_fact().groupBy("vendor_id").agg(F.count(F.lit(1)).alias("bids"), count_if(F.col("status") == "Awarded").alias("wins"), F.avg(F.col("total_amount") / F.col("estimated_value")).alias("ratio"), F.coalesce(F.stddev_samp("total_amount") / F.avg("total_amount"), F.lit(0.0)).alias("vol"), count_if(F.col("is_disqualified")).alias("dq"), F.first("is_blacklisted").alias("black"))
    c, win, dq = F.col, F.col("wins") / F.col("bids"), F.col("dq") / F.col("bids")
    traits = [(c("vol") > 1.05, "volatile"), (c("vol") < 0.2, "steady"), (c("ratio") < 0.9, "aggressive"), (c("ratio") > 1.7, "premium"), (win > 0.38, "dominant"), (win < 0.2, "cover"), (dq > 0.3, "careless"), (c("black"), "blacklisted")]
    return a.select("vendor_id", "bids", r("vol").alias("volatility"), r("ratio").alias("price_ratio"), r(win).alias("win_rate"), F.array_join(F.array_compact(F.array(*[F.when(k, n) for k, n in traits])), ",").alias("traits"))


@query("""
SELECT vendor_id, any_value(vendor_name) AS vendor_name, count(*) AS bids, count(*) FILTER (status = 'Awarded') AS wins, round(100.0 * count(*) FILTER (status = 'Awarded') / count(*), 6) AS win_pct, round(coalesce(sum(total_amount) FILTER (status = 'Awarded'), 0), 4) AS revenue,
 round(avg(score_1) FILTER (NOT is_disqualified), 6) AS technical, (any_value(is_blacklisted)::INT + (count(*) FILTER (is_disqualified) * 10 > count(*) * 3)::INT + (any_value(performance_score) < 40)::INT)::INT AS risk_factors FROM bid_fact GROUP BY 1""")
def vendor_360(t):
    won, n = F.col("status") == "Awarded", F.count(F.lit(1))
    return t.bid_fact().groupBy("vendor_id").agg(
        F.first("vendor_name").alias("vendor_name"), n.alias("bids"), count_if(won).alias("wins"), r(100.0 * count_if(won) / n).alias("win_pct"), r(F.coalesce(F.sum(F.when(won, F.col("total_amount"))), F.lit(0.0)), 4).alias("revenue"),
        r(F.avg(F.when(~F.col("is_disqualified"), F.col("score_1")))).alias("technical"), (F.first("is_blacklisted").cast("int") + (count_if(F.col("is_disqualified")) * 10 > n * 3).cast("int") + (F.first("performance_score") < 40).cast("int")).alias("risk_factors"),
    )


@query("""
WITH d AS (SELECT vendor_id, count(*) FILTER (inspection = 'Passed') AS passed, count(*) FILTER (inspection <> 'Pending') AS done, avg(greatest(0, days - 45)) AS delay FROM deliveries GROUP BY 1), b AS (SELECT vendor_id, count(*) AS bids FROM bids GROUP BY 1)
SELECT vendor_id, round(CASE WHEN coalesce(done, 0) = 0 THEN 100 ELSE 100.0 * passed / done END, 6) AS pass_rate, round(coalesce(delay, 0), 6) AS avg_delay, round(greatest(20, 100 - 5.3 * coalesce(delay, 0)), 6) AS delay_score, least(100, 10 * coalesce(bids, 0))::BIGINT AS activity
FROM vendors LEFT JOIN d USING (vendor_id) LEFT JOIN b USING (vendor_id)""")
def vendor_delivery_analytics(t):
    d = t.deliveries().groupBy("vendor_id").agg(count_if(F.col("inspection") == "Passed").alias("passed"), count_if(F.col("inspection") != "Pending").alias("done"), F.avg(F.greatest(F.lit(0.0), F.col("days") - 45)).alias("delay"))
    b = t.bids().groupBy("vendor_id").agg(F.count(F.lit(1)).alias("bids"))
    delay = F.coalesce("delay", F.lit(0.0))
    return t.vendors().select("vendor_id").join(d, "vendor_id", "left").join(b, "vendor_id", "left").select(
        "vendor_id", r(100.0 * ratio(F.col("passed"), F.col("done"), 1.0)).alias("pass_rate"), r(delay).alias("avg_delay"), r(F.greatest(F.lit(20.0), 100 - 5.3 * delay)).alias("delay_score"), F.least(F.lit(100), 10 * F.coalesce("bids", F.lit(0))).cast("bigint").alias("activity"),
    )


@query("""
WITH b AS (SELECT vendor_id, any_value(is_blacklisted) AS black, any_value(msme) AS msme, count(*) FILTER (status = 'Awarded') / count(*) AS win, avg(score_1) AS tech, stddev_samp(total_amount) / avg(total_amount) * 100 AS cv FROM bid_fact GROUP BY 1),
d AS (SELECT vendor_id, count(*) FILTER (inspection = 'Passed') / nullif(count(*) FILTER (inspection <> 'Pending'), 0) AS pass FROM deliveries GROUP BY 1)
SELECT vendor_id, round(least(100, win * 25 + coalesce(tech / 100 * 30, 15) + coalesce(greatest(0, 15 - 0.3 * cv), 10) + coalesce(pass * 20, 15) + CASE WHEN black THEN 0 WHEN msme THEN 7 ELSE 10 END), 6) AS performance FROM b LEFT JOIN d USING (vendor_id)""")
def vendor_performance_recalc(t):
    b = t.bid_fact().groupBy("vendor_id").agg(F.first("is_blacklisted").alias("black"), F.first("msme").alias("msme"), (count_if(F.col("status") == "Awarded") / F.count(F.lit(1))).alias("win"), F.avg("score_1").alias("tech"), (F.stddev_samp("total_amount") / F.avg("total_amount") * 100).alias("cv"))
    done = count_if(F.col("inspection") != "Pending")
    d = t.deliveries().groupBy("vendor_id").agg((count_if(F.col("inspection") == "Passed") / F.when(done > 0, done)).alias("pass"))
    base = F.when(F.col("black"), 0).when(F.col("msme"), 7).otherwise(10)
    steady = F.coalesce(F.when(F.col("cv").isNotNull(), F.greatest(F.lit(0.0), 15 - 0.3 * F.col("cv"))), F.lit(10.0))
    total = F.col("win") * 25 + F.coalesce(F.col("tech") / 100 * 30, F.lit(15.0)) + steady + F.coalesce(F.col("pass") * 20, F.lit(15.0)) + base
    return b.join(d, "vendor_id", "left").select("vendor_id", r(F.least(F.lit(100.0), total)).alias("performance"))


@query("""
WITH per AS (SELECT tender_id, count(*) AS n, (any_value(estimated_value) - min(total_amount)) / any_value(estimated_value) * 100 AS savings FROM bid_fact GROUP BY 1), s AS (SELECT vendor_id, sum(total_amount) AS v FROM bids WHERE status = 'Awarded' GROUP BY 1),
h AS (SELECT sum((100 * v / (SELECT sum(v) FROM s)) ** 2) AS hhi FROM s), k AS (SELECT count(*) FILTER (is_blacklisted) AS black FROM vendors), q AS (SELECT 100.0 * count(*) FILTER (is_disqualified) / count(*) AS dq FROM bids),
x AS (SELECT least(25, 5 * (SELECT avg(n) FROM per)) AS competition, greatest(0, least(25, 2 * coalesce((SELECT avg(savings) FROM per), 6))) AS efficiency, (10000 - hhi) / 400 AS diversity, greatest(0, 25 - 5 * black - 0.5 * dq) AS integrity FROM h, k, q)
SELECT round(competition, 6) AS competition, round(efficiency, 6) AS efficiency, round(diversity, 6) AS diversity, round(integrity, 6) AS integrity, round(competition + efficiency + diversity + integrity, 6) AS total,
 CASE WHEN competition + efficiency + diversity + integrity >= 90 THEN 'A+' WHEN competition + efficiency + diversity + integrity >= 80 THEN 'A' WHEN competition + efficiency + diversity + integrity >= 70 THEN 'B' WHEN competition + efficiency + diversity + integrity >= 60 THEN 'C' WHEN competition + efficiency + diversity + integrity >= 50 THEN 'D' ELSE 'F' END AS grade FROM x""")
def procurement_health(t):
    per = t.bid_fact().groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"), ((F.first("estimated_value") - F.min("total_amount")) / F.first("estimated_value") * 100).alias("savings")).agg(F.avg("n").alias("n"), F.avg("savings").alias("savings"))
    s = t.bids().filter("status = 'Awarded'").groupBy("vendor_id").agg(F.sum("total_amount").alias("v")).agg((10000 * F.sum(F.col("v") ** 2) / F.sum("v") ** 2).alias("hhi"))
    one = per.crossJoin(s).crossJoin(t.vendors().agg(count_if(F.col("is_blacklisted")).alias("black"))).crossJoin(t.bids().agg((100.0 * count_if(F.col("is_disqualified")) / F.count(F.lit(1))).alias("dq")))  # one row each
    zero, full = F.lit(0.0), F.lit(25.0)
    x = one.select(F.least(full, 5 * F.col("n")).alias("competition"), F.greatest(zero, F.least(full, 2 * F.coalesce("savings", F.lit(6.0)))).alias("efficiency"), ((10000 - F.col("hhi")) / 400).alias("diversity"), F.greatest(zero, 25 - 5 * F.col("black") - 0.5 * F.col("dq")).alias("integrity"))
    total = F.col("competition") + F.col("efficiency") + F.col("diversity") + F.col("integrity")
    return x.select(*[r(c).alias(c) for c in x.columns], r(total).alias("total"), above(total, [(90, "A+"), (80, "A"), (70, "B"), (60, "C"), (50, "D")], "F").alias("grade"))


@query("""
WITH per AS (SELECT tender_id, count(*) AS n FROM bids GROUP BY 1), x AS (SELECT (SELECT count(*) FROM bid_fact WHERE total_amount > 1.1 * estimated_value) AS overpriced, (SELECT count(*) FROM bid_fact WHERE total_amount < 0.5 * estimated_value) AS dumping, (SELECT count(*) FROM per WHERE n = 1) AS single,
 (SELECT count(*) FROM bids WHERE is_disqualified) AS disqualified, (SELECT count(*) FROM vendors WHERE is_blacklisted) AS blacklisted, (SELECT count(*) FROM per WHERE n < 3) AS low_competition)
SELECT *, CASE WHEN overpriced + dumping + single + disqualified + blacklisted + low_competition > 15 THEN 'CRITICAL' WHEN overpriced + dumping + single + disqualified + blacklisted + low_competition > 8 THEN 'HIGH' WHEN overpriced + dumping + single + disqualified + blacklisted + low_competition > 3 THEN 'MODERATE' ELSE 'LOW' END AS threat FROM x""")
def anomaly_signal_matrix(t):
    f, per = t.bid_fact(), t.bids().groupBy("tender_id").agg(F.count(F.lit(1)).alias("n"))
    a = f.agg(count_if(F.col("total_amount") > 1.1 * F.col("estimated_value")).alias("overpriced"), count_if(F.col("total_amount") < 0.5 * F.col("estimated_value")).alias("dumping"), count_if(F.col("is_disqualified")).alias("disqualified"))
    x = a.crossJoin(per.agg(count_if(F.col("n") == 1).alias("single"), count_if(F.col("n") < 3).alias("low_competition"))).crossJoin(t.vendors().agg(count_if(F.col("is_blacklisted")).alias("blacklisted")))  # one row each
    total = sum((F.col(c) for c in x.columns), F.lit(0))
    return x.withColumn("threat", above(total, [(16, "CRITICAL"), (9, "HIGH"), (4, "MODERATE")], "LOW"))


@query("SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS orders, round(sum(po_value), 4) AS value FROM purchase_orders GROUP BY 1")
def monthly_po_value(t):
    return t.purchase_orders().groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orders"), r(F.sum("po_value"), 4).alias("value"))


@query("SELECT least(4, datediff('day', submitted_at, (SELECT max(submitted_at) FROM bids)) // 7)::INT AS weeks_ago, count(*) AS n FROM bids GROUP BY 1")
def weekly_bid_velocity(t):
    last = t.bids().agg(F.max("submitted_at").alias("last"))
    w = t.bids().crossJoin(F.broadcast(last)).select(F.least(F.lit(4), F.floor(F.datediff("last", "submitted_at") / 7)).cast("int").alias("weeks_ago"))
    return w.groupBy("weeks_ago").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT d.doc_id) AS documents, count(*) AS chunks, count(DISTINCT md5(text)) AS hashes FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def index_stats(t):
    c = t.raw("embeddings").select(F.col("vec_id").alias("doc_id")).join(t.raw("documents").select("doc_id", "text"), "doc_id")
    return c.agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.md5("text")).alias("hashes"))
