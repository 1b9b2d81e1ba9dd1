"""Queries of features and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import count_if, ladder
from ..functions.storage import durable
from ..operators import anomaly as A
from ..operators import graph as G
from ..operators import learning as L
from ..operators import prices as P
from .aggregates import BENFORD, ENTROPY, FENCES, GRUBBS_TEST, MAD_RISK, r
from .graph import PAIRS
from .registry import query
from .relational import GRUBBS
from .sequences import BURSTS
from .shared import exact

FEATURES = ["amount", "ratio", "period", "gap", "score", "trust"]
MATRIX = """
raw AS (SELECT bid_id, tender_id, vendor_id, total_amount AS amount, CASE WHEN estimated_value > 0 THEN total_amount / estimated_value END AS ratio, delivery_period::DOUBLE AS period, (total_amount - lag(total_amount) OVER (PARTITION BY tender_id ORDER BY total_amount, bid_id)) / total_amount * 100 AS gap, score_1 AS score, performance_score AS trust FROM bid_fact),
matrix AS (SELECT bid_id, tender_id, vendor_id, amount, coalesce(ratio, (SELECT median(ratio) FROM raw)) AS ratio, period, coalesce(gap, (SELECT median(gap) FROM raw)) AS gap, score, trust FROM raw)
"""


def matrix(t, features=FEATURES, keys=("bid_id", "tender_id", "vendor_id")):
    """Each bid's ``keys`` and ``features`` with nulls replaced; what is not asked is neither written nor ranked."""
    prev = F.lag("total_amount").over(W.partitionBy("tender_id").orderBy("total_amount", "bid_id"))
    x, est = F.col("total_amount"), F.col("estimated_value")
    raw = t.bid_fact().select("bid_id", "tender_id", "vendor_id", x.alias("amount"), F.when(est > 0, x / F.when(est > 0, est)).alias("ratio"), F.col("delivery_period").cast("double").alias("period"), ((x - prev) / x * 100).alias("gap"), F.col("score_1").alias("score"), F.col("performance_score").alias("trust"))
    return L.impute(raw.select(*keys, *features), features)


@query(f"WITH {MATRIX} SELECT bid_id, round(ratio, 6) AS ratio, period, round(gap, 5) AS gap, round((score)::DECIMAL(38,9), 6)::DOUBLE AS score FROM matrix")
def bid_feature_matrix(t):
    return matrix(t).select("bid_id", r("ratio").alias("ratio"), "period", r("gap", 5).alias("gap"), exact(F.col("score")).alias("score"))


@query(f"""
WITH {MATRIX}, s AS (SELECT avg(amount) AS m, stddev_pop(amount) AS s FROM matrix), z AS (SELECT bid_id, least(1, abs(amount - m) / s / 3) AS z FROM matrix, s)
SELECT bid_id, round(z, 6) AS score, CASE WHEN z < 0.4 THEN 'NORMAL' WHEN z < 0.6 THEN 'LOW' WHEN z < 0.8 THEN 'MEDIUM' ELSE 'HIGH' END AS label FROM z""")
def zscore_anomaly(t):
    z = L.standardise(matrix(t).select("bid_id", "amount"), ["amount"]).withColumn("z", F.least(F.lit(1.0), F.abs("amount") / 3))
    return z.select("bid_id", r("z").alias("score"), ladder(F.col("z"), [(0.4, "NORMAL"), (0.6, "LOW"), (0.8, "MEDIUM")], "HIGH").alias("label"))


@query()
def isolation_forest(t):
    return L.isolation_forest(matrix(t), "bid_id", FEATURES)


VENDOR_COLS = ["bids", "win_rate", "dq_rate", "mean_ratio", "cv", "mean_gap", "mean_period", "mean_score", "trust", "degree", "mad", "failed_rate"]


def vendor_features(t):
    """Twelve features per vendor; population standard deviation here."""
    m = matrix(t).groupBy("vendor_id").agg(F.count(F.lit(1)).cast("double").alias("bids"), F.avg("ratio").alias("mean_ratio"), (F.stddev_pop("amount") / F.avg("amount")).alias("cv"), F.avg("gap").alias("mean_gap"), F.avg("period").alias("mean_period"), F.avg("score").alias("mean_score"), F.first("trust").alias("trust"))
    n = F.count(F.lit(1))
    b = t.bids().groupBy("vendor_id").agg((count_if(F.col("status") == "Awarded") / n).alias("win_rate"), (count_if(F.col("is_disqualified")) / n).alias("dq_rate"))
    g = G.both_ways(G.strong_edges(t.bids())).groupBy("node").agg(n.cast("double").alias("degree")).withColumnRenamed("node", "vendor_id")
    d = P.benford_mad(t.bids(), ["vendor_id"], "total_amount").select("vendor_id", F.col("mad_1").alias("mad"))
    f = t.deliveries().groupBy("vendor_id").agg((count_if(F.col("inspection") == "Failed") / n).alias("failed_rate"))
    out = m.join(b, "vendor_id").join(g, "vendor_id", "left").join(d, "vendor_id", "left").join(f, "vendor_id", "left")
    return out.fillna(0.0, ["degree", "mad", "failed_rate"])


@query(f"""
WITH {MATRIX.strip()}, {PAIRS.strip()}, {BENFORD.strip()},
v AS (SELECT vendor_id, count(*)::DOUBLE AS bids, avg(ratio) AS mean_ratio, stddev_pop(amount) / avg(amount) AS cv, avg(gap) AS mean_gap, avg(period) AS mean_period, avg(score) AS mean_score, any_value(trust) AS trust FROM matrix GROUP BY 1),
w AS (SELECT vendor_id, count(*) FILTER (status = 'Awarded') / count(*) AS win_rate, count(*) FILTER (is_disqualified) / count(*) AS dq_rate FROM bids GROUP BY 1),
g AS (SELECT vendor_id, count(*)::DOUBLE AS degree FROM (SELECT a AS vendor_id FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1),
i AS (SELECT vendor_id, count(*) FILTER (inspection = 'Failed') / count(*) AS failed_rate FROM deliveries GROUP BY 1)
SELECT v.vendor_id, bids, round(mean_ratio, 6) AS mean_ratio, round(cv, 6) AS cv, round(mean_gap, 5) AS mean_gap, round(mean_period, 6) AS mean_period, round(mean_score, 5) AS mean_score, round(trust, 6) AS trust, round(win_rate, 6) AS win_rate, round(dq_rate, 6) AS dq_rate,
  coalesce(degree, 0) AS degree, coalesce(round(mad_1, 6), 0) AS mad, round(coalesce(failed_rate, 0), 6) AS failed_rate FROM v JOIN w USING (vendor_id) LEFT JOIN g USING (vendor_id) LEFT JOIN benford USING (vendor_id) LEFT JOIN i USING (vendor_id)""")
def vendor_feature_vector(t):
    f = vendor_features(t)
    digits = {"bids": None, "degree": None, "mad": None, "mean_gap": 5, "mean_score": 5}
    return f.select("vendor_id", *[F.col(c) if digits.get(c, 6) is None else r(c, digits.get(c, 6)).alias(c) for c in VENDOR_COLS])


def risk_features(t):
    """The features of ``vendor_features`` that ``heuristic`` reads."""
    m = matrix(t, ["amount", "ratio", "trust"], ["vendor_id"]).groupBy("vendor_id").agg(F.avg("ratio").alias("mean_ratio"), (F.stddev_pop("amount") / F.avg("amount")).alias("cv"), F.first("trust").alias("trust"))
    b = t.bids().groupBy("vendor_id").agg((count_if(F.col("is_disqualified")) / F.count(F.lit(1))).alias("dq_rate"))
    return m.join(b, "vendor_id")


def heuristic(f):
    risk = 0.3 * F.least(F.lit(1.0), F.col("dq_rate") / 0.5) + 0.25 * F.least(F.lit(1.0), F.col("cv")) + 0.2 * F.least(F.lit(1.0), F.abs(F.col("mean_ratio") - 1)) + 0.25 * (1 - F.col("trust") / 100)
    return f.withColumn("risk", F.greatest(F.lit(0.0), F.least(F.lit(1.0), risk)))


@query(f"""
WITH {MATRIX}, f AS (SELECT vendor_id, avg(ratio) AS mr, stddev_pop(amount) / avg(amount) AS cv, any_value(trust) AS trust FROM matrix GROUP BY 1), q AS (SELECT vendor_id, count(*) FILTER (is_disqualified) / count(*) AS dq FROM bids GROUP BY 1)
SELECT vendor_id, round(greatest(0, least(1, 0.3 * least(1, dq / 0.5) + 0.25 * least(1, cv) + 0.2 * least(1, abs(mr - 1)) + 0.25 * (1 - trust / 100))), 6) AS risk FROM f JOIN q USING (vendor_id)""")
def vendor_heuristic_risk(t):
    return heuristic(risk_features(t)).select("vendor_id", r("risk").alias("risk"))


def modelled(t):
    f = heuristic(vendor_features(t)).join(t.vendors().select("vendor_id", "is_blacklisted"), "vendor_id").withColumn("bad", F.col("is_blacklisted") | (F.col("dq_rate") > 0.5))
    f = durable(f)
    p = L.soft_vote(f, f, VENDOR_COLS, "bad", "vendor_id")
    if p is None:  # too few vendors or one class: heuristic and density of ties
        ties = F.least(F.lit(0.4), F.col("degree") / 100)
        return f.withColumn("probability", 0.6 * F.col("risk") + ties)
    return p


@query()
def vendor_risk_model(t):
    return modelled(t).select("vendor_id", "bad", r("probability", 4).alias("probability"))


@query()
def vendor_risk_predict(t):
    p = modelled(t)
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("dq_rate") > 0.3, "disqualifications"), F.when(F.col("cv") > 0.8, "volatile prices"), F.when(F.col("degree") > 5, "many ties"), F.when(F.col("trust") < 40, "low performance"))), ", ")
    x = F.col("probability")
    return p.select("vendor_id", r(x, 4).alias("probability"), F.when(x >= 0.75, "CRITICAL").when(x >= 0.5, "HIGH").when(x >= 0.25, "MEDIUM").otherwise("LOW").alias("level"), reasons.alias("factors"))


def monthly_prices(t):
    return t.bid_fact().groupBy("category", F.date_trunc("month", "submitted_at").alias("month")).agg(F.avg("total_amount").alias("price"))


def advised(f):
    move = (F.col("forecast") - F.col("last")) / F.col("last") * 100
    return f.withColumn("advice", F.when(move > 4, "EXPEDITE").when(move < -4, "DEFER").otherwise("HOLD"))


@query()
def price_forecast(t, horizon=3):
    """Next months' mean price of each category by an ensemble, short series by their line, with advice by the move from the last price."""
    f = advised(L.forecast(monthly_prices(t), "category", "month", "price", horizon))
    return f.select("category", "step", r("forecast", 2).alias("forecast"), r("low", 2).alias("low"), r("high", 2).alias("high"), "advice", "engine")


@query("""
WITH mp AS (SELECT category, date_trunc('month', submitted_at) AS month, avg(total_amount) AS y FROM bid_fact GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY month)::DOUBLE AS x FROM mp),
a AS (SELECT category, count(*) AS n, coalesce(regr_slope(y, x), 0) AS slope, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, max(month) AS m, max_by(y, x) AS last FROM o GROUP BY 1),
f AS (SELECT *, my + slope * (n + step - mx) AS forecast, sqrt(greatest(0, syy - slope * slope * sxx) / nullif(greatest(n - 2, 0), 0) * (1 + 1 / n + (n + step - mx) ** 2 / nullif(sxx, 0))) AS error FROM a, (VALUES (1), (2), (3)) s(step))
SELECT category, step, strftime(m + to_months(step), '%Y-%m') AS month, round(forecast, 2) AS forecast, round(forecast - abs(forecast) * 0.02 * step, 2) AS low, round(forecast + abs(forecast) * 0.02 * step, 2) AS high, round(forecast * 0.96, 2) AS optimistic, round(forecast * 1.05, 2) AS pessimistic, round(error, 4) AS error,
  CASE WHEN (forecast - last) / last > 0.04 THEN 'EXPEDITE' WHEN (forecast - last) / last < -0.04 THEN 'DEFER' ELSE 'HOLD' END AS advice FROM f""")
def linear_price_forecast(t):
    """Next months' mean price of each category by its least-squares line, for series too short for the ensemble."""
    f = advised(L.linear_forecast(monthly_prices(t), "category", "month", "price"))
    digits = {"error": 4}
    return f.select("category", "step", F.date_format("month", "yyyy-MM").alias("month"), *[r(c, digits.get(c, 2)).alias(c) for c in ("forecast", "low", "high", "optimistic", "pessimistic", "error")], "advice")


_RISK = lambda c: f"coalesce({c}, 'LOW') AS {c}"
SIGNALS = f"""
{FENCES.strip()}, {GRUBBS_TEST.strip()}, {ENTROPY.strip()}, {BENFORD.strip()}, {PAIRS.strip()}, {BURSTS.replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT").strip()},
en AS (SELECT tender_id, CASE WHEN round(entropy, 9) < 0.25 THEN 'CRITICAL' WHEN round(entropy, 9) < 0.5 THEN 'HIGH' WHEN round(entropy, 9) < 0.75 THEN 'MODERATE' ELSE 'LOW' END AS entropy_risk FROM entropy),
dg AS (SELECT vendor_id, {MAD_RISK} AS digit_risk FROM benford),
xn AS (SELECT vendor_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 10), x2 AS (SELECT xn.vendor_id, sum((coalesce(c.c, 0) - xn.n * expected) ** 2 / (xn.n * expected)) > 15.5 AS digit_fails FROM xn CROSS JOIN (SELECT * FROM law WHERE place = 1) l LEFT JOIN c ON c.vendor_id = xn.vendor_id AND c.place = 1 AND c.digit = l.digit GROUP BY 1),
cv AS (SELECT vendor_id, CASE WHEN cv < 0.02 THEN 'CRITICAL' WHEN cv < 0.05 THEN 'HIGH' WHEN cv < 0.10 THEN 'MODERATE' ELSE 'LOW' END AS cv_risk FROM (SELECT vendor_id, stddev_samp(total_amount) / avg(total_amount) AS cv FROM bids GROUP BY 1 HAVING count(*) >= 3)),
nd AS (SELECT node AS vendor_id, count(*) AS degree, avg(shared) AS w FROM (SELECT a AS node, shared FROM pairs UNION ALL SELECT b, shared FROM pairs) GROUP BY 1),
nw AS (SELECT vendor_id, CASE WHEN degree / others > 0.7 AND w > 2 THEN 'HIGH' WHEN degree / others > 0.4 THEN 'MODERATE' ELSE 'LOW' END AS network_risk FROM nd, (SELECT greatest(count(*) - 1, 1) AS others FROM nd)),
hc AS (SELECT user_id, hour(ts) AS h, count(*) AS c FROM audit GROUP BY 1, 2), he AS (SELECT user_id, CASE WHEN count(*) = 1 THEN 100 ELSE (1 - (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*))) * 100 END AS score FROM hc GROUP BY 1), hb AS (SELECT user_id, count(*) AS b FROM bursts GROUP BY 1),
tm AS (SELECT user_id AS vendor_id, CASE WHEN score > 70 OR coalesce(b, 0) >= 3 THEN 'CRITICAL' WHEN score > 45 OR coalesce(b, 0) >= 2 THEN 'HIGH' WHEN score > 25 OR coalesce(b, 0) >= 1 THEN 'MODERATE' ELSE 'LOW' END AS timing_risk FROM he LEFT JOIN hb USING (user_id)),
eo AS MATERIALIZED (SELECT vendor_id, bid_id, total_amount AS value, row_number() OVER (PARTITION BY vendor_id ORDER BY submitted_at, bid_id) AS i FROM bids),
ee(vendor_id, bid_id, i, value, ewma) AS (SELECT vendor_id, bid_id, i, value, value FROM eo WHERE i = 1 UNION ALL SELECT o.vendor_id, o.bid_id, o.i, o.value, 2 / 11.0::DOUBLE * o.value + (1 - 2 / 11.0::DOUBLE) * e.ewma FROM ee e JOIN eo o ON o.vendor_id = e.vendor_id AND o.i = e.i + 1),
eb AS (SELECT vendor_id, avg(abs(value - ewma)) + 2 * stddev_pop(abs(value - ewma)) AS bar FROM ee GROUP BY 1), ea AS (SELECT bid_id, abs(value - ewma) > bar AS ewma_alert FROM ee JOIN eb USING (vendor_id)),
signals AS (SELECT k.bid_id, k.tender_id, vendor_id, fence, coalesce(g > critical AND tested.bid_id = k.bid_id, FALSE) AS grubbs, ewma_alert, {", ".join(map(_RISK, ("entropy_risk", "digit_risk")))}, coalesce(digit_fails, FALSE) AS digit_fails, {", ".join(map(_RISK, ("cv_risk", "network_risk", "timing_risk")))}
  FROM classed k JOIN bids USING (bid_id) JOIN tested ON tested.tender_id = k.tender_id JOIN en ON en.tender_id = k.tender_id JOIN ea ON ea.bid_id = k.bid_id LEFT JOIN dg USING (vendor_id) LEFT JOIN x2 USING (vendor_id) LEFT JOIN cv USING (vendor_id) LEFT JOIN nw USING (vendor_id) LEFT JOIN tm USING (vendor_id))
"""


@query(f"WITH {SIGNALS} SELECT * FROM signals", recursive=True)
def anomaly_signals(t):
    """Every bid with the signals of ten detectors; a vendor's hours are those of the audit rows of the user with its id, since bids have dates only."""
    times = t.audit().select(F.col("user_id").alias("vendor_id"), F.col("ts").alias("at"))
    return A.bid_signals(t.bids(), times, t.spark.createDataFrame(GRUBBS, "k int, critical double"))


def with_forest(t):
    forest = L.isolation_forest(matrix(t), "bid_id", FEATURES).select("bid_id", F.col("is_anomaly").alias("forest"))
    return durable(anomaly_signals(t).join(forest, "bid_id", "left"))


@query()
def anomaly_scan(t):
    """Each tender with the counts and worst levels of all eleven signals of its bids, points and risk."""
    return A.summarise(with_forest(t.once("bids")), "tender_id")


@query()
def anomaly_summary(t):
    """All bids in one row: counts and levels of all signals, points and overall risk; the digit law is that of all amounts together."""
    t = t.once("bids")
    whole = P.benford_mad(t.bids(), [], "total_amount").select(F.col("risk").alias("digit_risk"))
    a = A.summarise(with_forest(t)).drop("digits", "points", "risk").join(F.broadcast(whole), how="left")  # one row each
    return A.scored(a.withColumn("digits", F.coalesce(A.level("digit_risk"), F.lit(0)).cast("int")).drop("digit_risk"))
