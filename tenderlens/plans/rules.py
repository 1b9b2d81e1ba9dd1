"""Queries of scoring and rule evaluation; rules are rows of small fixed tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import above, count_if, ladder
from ..functions.storage import durable, ranked, small
from ..operators import extraction as E
from ..operators import rules as R
from ..operators import text as X
from .aggregates import r
from .registry import query
from .shared import exact
from .text import CITED, MONEY, SQL_HEADING, quoted, quotes, sql_any, sql_contains, sql_normal, sql_number

OK = "ok AS (SELECT tender_id, avg(total_amount) AS mu, coalesce(stddev_samp(total_amount), 0) AS sd FROM bids WHERE NOT is_disqualified GROUP BY 1)"
RISK = """
risk AS (SELECT f.*, 0.20 * greatest(0, 100 - 30 * CASE WHEN sd > 0 THEN abs(total_amount - mu) / sd ELSE 0 END) + 0.25 * performance_score + 0.25 * score_1 + 0.10 * greatest(0, least(100, 120 - delivery_period)) + 0.15 * greatest(0, 100 - 150 * abs(1 - total_amount / estimated_value)) - 0.05 * (CASE WHEN is_blacklisted THEN 50 ELSE 0 END + CASE WHEN is_disqualified THEN 40 ELSE 0 END) AS score
 FROM bid_fact f JOIN ok USING (tender_id))
"""


def risk_scores(t):
    ok = t.bids().filter("not is_disqualified").groupBy("tender_id").agg(F.avg("total_amount").alias("mu"), F.coalesce(F.stddev_samp("total_amount"), F.lit(0.0)).alias("sd"))
    f = t.bid_fact().join(ok, "tender_id")
    zero, hundred = F.lit(0.0), F.lit(100.0)
    z = F.when(F.col("sd") > 0, F.abs(F.col("total_amount") - F.col("mu")) / F.when(F.col("sd") > 0, F.col("sd"))).otherwise(0.0)
    penalty = F.when(F.col("is_blacklisted"), 50).otherwise(0) + F.when(F.col("is_disqualified"), 40).otherwise(0)
    score = 0.20 * F.greatest(zero, 100 - 30 * z) + 0.25 * F.col("performance_score") + 0.25 * F.col("score_1") + 0.10 * F.greatest(zero, F.least(hundred, F.lit(120.0) - F.col("delivery_period"))) + 0.15 * F.greatest(zero, 100 - 150 * F.abs(1 - F.col("total_amount") / F.col("estimated_value"))) - 0.05 * penalty
    return f.withColumn("score", score)


@query(f"WITH {OK}, {RISK.strip()} SELECT bid_id, round(score, 6) AS score, CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD' WHEN score >= 40 THEN 'FAIR' ELSE 'POOR' END AS class FROM risk")
def bid_risk_score(t):
    return risk_scores(t).select("bid_id", r("score").alias("score"), above(F.col("score"), [(80, "EXCELLENT"), (60, "GOOD"), (40, "FAIR")], "POOR").alias("class"))


@query(f"""
WITH {OK}, {RISK.strip()}, p AS (SELECT tender_id, arg_min(bid_id, (total_amount, bid_id)) AS l1, arg_max(bid_id, (round(score, 9), -bid_id)) AS safest, count(*) FILTER (is_blacklisted OR total_amount < 0.5 * estimated_value) AS red_flags FROM risk WHERE NOT is_disqualified GROUP BY 1)
SELECT tender_id, l1, safest, l1 <> safest AS conflict, red_flags FROM p""")
def award_recommendation(t):
    q = risk_scores(t).filter("not is_disqualified")
    flags = F.col("is_blacklisted") | (F.col("total_amount") < 0.5 * F.col("estimated_value"))
    p = q.groupBy("tender_id").agg(F.min_by("bid_id", F.struct("total_amount", "bid_id")).alias("l1"), F.max_by("bid_id", F.struct(F.round("score", 9), -F.col("bid_id"))).alias("safest"), count_if(flags).alias("red_flags"))
    return p.select("tender_id", "l1", "safest", (F.col("l1") != F.col("safest")).alias("conflict"), "red_flags")


@query("""
WITH p AS (SELECT tender_id, avg(total_amount) AS mu, greatest(0.5 * (quantile_cont(total_amount, 0.75) - quantile_cont(total_amount, 0.25)), 0.15 * coalesce(stddev_samp(total_amount), 0)) AS sigma FROM bids GROUP BY 1),
d AS (SELECT tender_id, greatest(0, mu + sigma * sqrt(-2 * ln(((i * 7919 % 10007) + 1) / 10008.0::DOUBLE)) * cos(2 * pi() * ((i * 104729 % 10009) / 10009.0::DOUBLE))) AS x FROM p, range(1, 1001) r(i)), o AS (SELECT tender_id, x, row_number() OVER (PARTITION BY tender_id ORDER BY x) AS k FROM d)
SELECT tender_id, round(max(x) FILTER (k = 51), 4) AS p5, round(max(x) FILTER (k = 251), 4) AS p25, round(max(x) FILTER (k = 501), 4) AS p50, round(max(x) FILTER (k = 751), 4) AS p75, round(max(x) FILTER (k = 951), 4) AS p95 FROM o GROUP BY 1""")
def monte_carlo_price(t, draws=1000):
    p = t.bids().groupBy("tender_id").agg(F.avg("total_amount").alias("mu"), F.greatest(0.5 * (F.expr("percentile(total_amount, 0.75)") - F.expr("percentile(total_amount, 0.25)")), 0.15 * F.coalesce(F.stddev_samp("total_amount"), F.lit(0.0))).alias("sigma"))
    # draws are made and ranked inside the row: a fixed number per tender, no shuffle
    normal = lambda i: F.sqrt(-2 * F.log((i * 7919 % 10007 + 1) / 10008.0)) * F.cos(2 * F.pi() * (i * 104729 % 10009 / 10009.0))
    x = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(draws)).cast("array<bigint>"), lambda i: F.greatest(F.lit(0.0), F.col("mu") + F.col("sigma") * normal(i))))
    return p.select("tender_id", x.alias("x")).select("tender_id", *[r(F.get("x", F.lit(draws * q // 100)), 4).alias(f"p{q}") for q in (5, 25, 50, 75, 95)])


FACTORS = [("price", 0.30), ("technical", 0.25), ("delivery", 0.15), ("trust", 0.15), ("estimate", 0.10), ("compliance", 0.05)]


@query("""
WITH f AS (SELECT bid_id, unnest([{'factor': 'price', 'v': 0.30 * greatest(0, least(100, 100 * lo / total_amount))}, {'factor': 'technical', 'v': 0.25 * score_1}, {'factor': 'delivery', 'v': 0.15 * greatest(0, least(100, 120 - delivery_period))}, {'factor': 'trust', 'v': 0.15 * performance_score}, {'factor': 'estimate', 'v': 0.10 * greatest(0, least(100, 100 - 100 * abs(1 - total_amount / estimated_value)))}, {'factor': 'compliance', 'v': 0.05 * score_3}]) AS s FROM (SELECT *, min(total_amount) OVER (PARTITION BY tender_id) AS lo FROM bid_fact))
SELECT bid_id, s.factor AS factor, round(100 * s.v / sum(s.v) OVER (PARTITION BY bid_id), 6) AS contribution_pct, row_number() OVER (PARTITION BY bid_id ORDER BY round(s.v, 9) DESC, s.factor) = 1 AS dominant FROM f""")
def factor_attribution(t):
    f = t.bid_fact().withColumn("lo", F.min("total_amount").over(W.partitionBy("tender_id")))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    x = F.col("total_amount")
    values = {"price": clamp(100 * F.col("lo") / x), "technical": F.col("score_1"), "delivery": clamp(F.lit(120.0) - F.col("delivery_period")), "trust": F.col("performance_score"), "estimate": clamp(100 - 100 * F.abs(1 - x / F.col("estimated_value"))), "compliance": F.col("score_3")}
    own = f.select("bid_id", F.array(*[F.struct(F.lit(n).alias("factor"), (w * values[n]).alias("v")) for n, w in FACTORS]).alias("fs"))
    total = F.aggregate("fs", F.lit(0.0), lambda a, s: a + s["v"])
    best = F.array_min(F.transform("fs", lambda s: F.struct((-F.round(s["v"], 9)).alias("v"), s["factor"].alias("factor"))))["factor"]
    e = own.select("bid_id", total.alias("total"), best.alias("best"), F.explode("fs").alias("s"))
    return e.select("bid_id", "s.factor", r(100 * F.col("s.v") / F.col("total")).alias("contribution_pct"), (F.col("s.factor") == F.col("best")).alias("dominant"))


@query("""
WITH b AS (SELECT vendor_id, count(*) FILTER (status = 'Awarded') / count(*) AS win, count(*) FILTER (total_amount < 0.5 * estimated_value) AS dumps FROM bid_fact GROUP BY 1), d AS (SELECT vendor_id, count(*) FILTER (inspection = 'Failed') AS failed FROM deliveries GROUP BY 1), p AS (SELECT vendor_id, count(*) FILTER (invoice_amount > po_value * 1.05) AS held FROM purchase_orders GROUP BY 1),
x AS (SELECT v.vendor_id, 40 * is_blacklisted::INT + (100 - performance_score) * 0.25 + CASE WHEN win < 0.1 THEN 8 WHEN win < 0.3 THEN 5 ELSE 0 END + least(20, 7 * coalesce(failed, 0)) + least(10, 5 * coalesce(held, 0)) + least(10, 5 * coalesce(dumps, 0)) AS risk FROM vendors v LEFT JOIN b USING (vendor_id) LEFT JOIN d USING (vendor_id) LEFT JOIN p USING (vendor_id))
SELECT vendor_id, round(risk, 6) AS risk, CASE WHEN risk >= 60 THEN 'CRITICAL' WHEN risk >= 35 THEN 'HIGH' WHEN risk >= 15 THEN 'MODERATE' ELSE 'LOW' END AS tier FROM x""")
def vendor_risk_score(t):
    b = t.bid_fact().groupBy("vendor_id").agg((count_if(F.col("status") == "Awarded") / F.count(F.lit(1))).alias("win"), count_if(F.col("total_amount") < 0.5 * F.col("estimated_value")).alias("dumps"))
    d = t.deliveries().groupBy("vendor_id").agg(count_if(F.col("inspection") == "Failed").alias("failed"))
    p = t.purchase_orders().groupBy("vendor_id").agg(count_if(F.col("invoice_amount") > F.col("po_value") * 1.05).alias("held"))
    v = t.vendors().join(b, "vendor_id", "left").join(d, "vendor_id", "left").join(p, "vendor_id", "left")
    capped = lambda c, k, cap: F.least(F.lit(cap), k * F.coalesce(c, F.lit(0)))
    risk = 40 * F.col("is_blacklisted").cast("int") + (100 - F.col("performance_score")) * 0.25 + F.when(F.col("win") < 0.1, 8).when(F.col("win") < 0.3, 5).otherwise(0) + capped("failed", 7, 20) + capped("held", 5, 10) + capped("dumps", 5, 10)
    return v.select("vendor_id", r(risk).alias("risk"), above(risk, [(60, "CRITICAL"), (35, "HIGH"), (15, "MODERATE")], "LOW").alias("tier"))


#: Rules over vendor profiles: kind, bound, weight, mandatory (fixed values).
PROFILE_RULES = [("experience", 50.0, 30.0, True), ("turnover", 100000.0, 30.0, True), ("msme", 1.0, 20.0, False), ("local", 1.0, 20.0, False)]


def profiles(t):
    b = t.bids().groupBy("vendor_id").agg(F.count(F.lit(1)).cast("double").alias("experience"), F.sum(F.when(F.col("status") == "Awarded", F.col("total_amount")).otherwise(0.0)).alias("turnover"))
    return t.vendors().join(b, "vendor_id").select("vendor_id", "experience", "turnover", F.col("msme").alias("is_msme"), F.col("msme").cast("double").alias("msme"), F.col("make_in_india").cast("double").alias("local"), "performance_score")


PROFILES = "profiles AS (SELECT vendor_id, experience, turnover, v.msme AS is_msme, v.msme::DOUBLE AS msme, make_in_india::DOUBLE AS local, performance_score FROM vendors v JOIN (SELECT vendor_id, count(*)::DOUBLE AS experience, sum(CASE WHEN status = 'Awarded' THEN total_amount ELSE 0 END) AS turnover FROM bids GROUP BY 1) USING (vendor_id))"
PROFILE_SQL = PROFILES + ", prules(kind, bound, weight, mandatory) AS (VALUES ('experience', 50.0::DOUBLE, 30.0::DOUBLE, true), ('turnover', 100000.0, 30.0, true), ('msme', 1.0, 20.0, false), ('local', 1.0, 20.0, false)), hits AS (SELECT vendor_id, kind, bound, weight, mandatory, is_msme, CASE kind WHEN 'experience' THEN experience WHEN 'turnover' THEN turnover WHEN 'msme' THEN msme ELSE local END AS have FROM profiles, prules), scored AS (SELECT *, CASE WHEN have >= bound OR (kind = 'turnover' AND is_msme) THEN 1.0 WHEN have >= 0.5 * bound THEN 0.5 WHEN kind IN ('msme', 'local') THEN 0.3 ELSE 0.2 END AS credit FROM hits)"


@query(f"WITH {PROFILE_SQL} SELECT vendor_id, round(100 * sum(credit * weight) / sum(weight), 6) AS score, count(*) FILTER (mandatory AND credit < 1) AS mandatory_failures FROM scored GROUP BY 1")
def profile_rules(t):
    s = profile_credits(t)
    return s.groupBy("vendor_id").agg(r(100 * F.sum(F.col("credit") * F.col("weight")) / F.sum("weight")).alias("score"), count_if(F.col("mandatory") & (F.col("credit") < 1)).alias("mandatory_failures"))


def profile_credits(t):
    rules = t.spark.createDataFrame(PROFILE_RULES, "kind string, bound double, weight double, mandatory boolean")
    p = profiles(t).crossJoin(F.broadcast(rules))  # four rules
    have = F.when(F.col("kind") == "experience", F.col("experience")).when(F.col("kind") == "turnover", F.col("turnover")).when(F.col("kind") == "msme", F.col("msme")).otherwise(F.col("local"))
    full = (have >= F.col("bound")) | ((F.col("kind") == "turnover") & F.col("is_msme"))
    return p.withColumn("credit", F.when(full, 1.0).when(have >= 0.5 * F.col("bound"), 0.5).when(F.col("kind").isin("msme", "local"), 0.3).otherwise(0.2))


@query(f"WITH {PROFILES} SELECT vendor_id, round(CASE WHEN is_msme THEN 0.7 * performance_score + 0.3 * least(100, experience / 10) ELSE 0.4 * performance_score + 0.6 * least(100, experience / 10) END, 6) AS blended FROM profiles")
def profile_quick_score(t):
    quick = F.least(F.lit(100.0), F.col("experience") / 10)
    return profiles(t).select("vendor_id", r(F.when(F.col("is_msme"), 0.7 * F.col("performance_score") + 0.3 * quick).otherwise(0.4 * F.col("performance_score") + 0.6 * quick)).alias("blended"))


LAKH = 50.0  # the given tables' amounts are small: fifty stands for a lakh, so that every bound can be reached
_CASES = {
    "min_bids": f"CASE WHEN estimate >= {R.COMPETITION_FROM} AND n_bids < bound THEN 'VIOLATION' ELSE 'COMPLIANT' END",
    "price_deviation_pct": f"CASE WHEN NOT (estimate > 0 AND l1 > 0) THEN 'NOT_EVALUATED' WHEN (l1 - estimate) / estimate * 100 > bound THEN 'VIOLATION' WHEN (l1 - estimate) / estimate * 100 < {R.LOW_PRICE_PCT} THEN 'WARNING' ELSE 'COMPLIANT' END",
    "bid_gap_pct": "CASE WHEN n_paid < 2 THEN 'NOT_EVALUATED' WHEN min_gap < bound THEN 'VIOLATION' ELSE 'COMPLIANT' END",
    "msme_pct": "CASE WHEN msme_pct < bound THEN 'WARNING' ELSE 'COMPLIANT' END",
    "blacklist_check": "CASE WHEN blacklisted > 0 THEN 'VIOLATION' ELSE 'COMPLIANT' END",
    "alb_pct": "CASE WHEN NOT (estimate > 0 AND l1 > 0) THEN 'NOT_EVALUATED' WHEN l1 / estimate * 100 < bound THEN 'VIOLATION' ELSE 'COMPLIANT' END",
}
_TABLE = ", ".join(f"('{i}', '{k}', {'NULL' if b is None else b}::DOUBLE, '{v}')" for i, _, k, b, v, _ in R.PROCUREMENT_RULES)
_STATUS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in _CASES.items()) + " ELSE 'ADVISORY' END"


@query(f"""
WITH trules(rule_id, kind, bound, severity) AS (VALUES {_TABLE}),
g AS (SELECT *, (total_amount - lag(total_amount) OVER w) / lag(total_amount) OVER w * 100 AS gap FROM bid_fact WINDOW w AS (PARTITION BY tender_id ORDER BY total_amount, bid_id)),
c AS (SELECT tender_id, count(*) AS n_bids, count(*) FILTER (total_amount > 0) AS n_paid, round(any_value(estimated_value) / {LAKH}, 2) AS estimate, round(coalesce(min(total_amount) FILTER (NOT is_disqualified), 0) / {LAKH}, 2) AS l1,
  round(100.0 * count(*) FILTER (msme) / count(*), 2) AS msme_pct, max(is_blacklisted::INT) AS blacklisted, coalesce(min(gap), 100) AS min_gap FROM g GROUP BY 1),
v AS (SELECT tender_id, severity, {_STATUS} AS status FROM c, trules)
SELECT tender_id, {", ".join(f"count(*) FILTER (status = '{n}') AS {n.lower()}" for n in ("VIOLATION", "WARNING", "ADVISORY", "COMPLIANT", "NOT_EVALUATED"))},
  CASE WHEN count(*) FILTER (status = 'VIOLATION' AND severity IN ('CRITICAL', 'HIGH')) > 0 THEN 'NON-COMPLIANT' WHEN count(*) FILTER (status IN ('WARNING', 'ADVISORY')) > 0 THEN 'PARTIAL COMPLIANCE' ELSE 'COMPLIANT' END AS overall_status FROM v GROUP BY 1""")
def procurement_rule_check(t):
    """All fifteen rules over every tender."""
    return R.rule_summary(R.procurement_rules(R.tender_context(t.bid_fact(), LAKH)))


#: What one, two or three orders must reach, and the turnover, in lakhs.
NEEDED = {"one": 80.0, "two": 50.0, "three": 40.0, "turnover": 10.0}
AUDIT = f"""
{MONEY.strip()},
text_ AS (SELECT doc_id, vendor_id, coalesce(text, '') AS t, upper(coalesce(text, '')) AS u, count(*) OVER (PARTITION BY vendor_id) AS files FROM bid_documents),
audit_ AS (SELECT x.*, coalesce(a.vs, []) AS amounts, coalesce(o.vs, []) AS orders FROM text_ x LEFT JOIN money a ON a.doc_id = x.doc_id AND NOT a.near LEFT JOIN money o ON o.doc_id = x.doc_id AND o.near),
elig AS (SELECT *, CASE WHEN len(list_filter(orders, lambda v: v >= {NEEDED["one"]})) >= 1 THEN 1 WHEN len(list_filter(orders, lambda v: v >= {NEEDED["two"]})) >= 2 THEN 2 WHEN len(list_filter(orders, lambda v: v >= {NEEDED["three"]})) >= 3 THEN 3 END AS option,
  list_filter(amounts, lambda v: v >= {NEEDED["turnover"]} AND v < 50000) AS reached FROM audit_),
eligible AS (SELECT *, CASE WHEN option IS NULL THEN 'FAIL' ELSE 'PASS' END AS experience, reached[1] AS max_turnover, CASE WHEN len(reached) > 0 THEN 'PASS' WHEN {sql_any(E.FILINGS)} THEN 'PASS (With Risk)' ELSE 'FAIL' END AS turnover,
  CASE WHEN {sql_any(E.NET_WORTH)} AND {sql_any(E.NEGATIVE)} THEN 'FAIL' WHEN {sql_any(E.NET_WORTH)} THEN 'PASS' ELSE 'PASS (With Risk)' END AS net_worth,
  CASE WHEN {sql_any(E.AUTHORIZATION)} THEN 'PASS' ELSE 'FAIL' END AS maf, CASE WHEN {sql_any(E.QUALITY)} THEN 'PASS' ELSE 'FAIL' END AS iso FROM elig)"""


@query(f"WITH {AUDIT.strip()} SELECT doc_id, experience, option AS experience_option, max_turnover, turnover, net_worth, maf, iso FROM eligible")
def eligibility_audit(t):
    e = E.eligibility(F.col("text"), *map(F.lit, NEEDED.values()))
    return t.documents().select("doc_id", e.alias("e")).select("doc_id", "e.*")


def sql_spec(column: str) -> list[str]:
    """A null for each shown parameter, else its name."""
    ratio = lambda n: f" OR len(list_filter(regexp_extract_all({column}, '{E.CONTRAST}', 1), lambda v: {sql_number('v')} >= {E.CONTRASTS[n]})) > 0" if n in E.CONTRASTS else ""
    return [f"CASE WHEN NOT (regexp_matches({column}, '{quoted(p)}'){ratio(n)}) THEN '{quoted(n)}' END" for n, p in E.SPECIFICATION]


def missing_sql(column: str) -> str:
    return "list_filter([" + ", ".join(sql_spec(column)) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string(m, '; ') AS missing, len(m) AS lacking FROM (SELECT doc_id, {missing_sql('t')} AS m FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")
def spec_checklist(t):
    m = t.documents().select("doc_id", E.missing_parameters(F.col("text")).alias("m"))
    return m.select("doc_id", F.array_join("m", "; ").alias("missing"), F.size("m").cast("bigint").alias("lacking"))


_WEIGHTS = {r: w for r, _, w in E.PQC_RULES}
_SMALL = f"regexp_matches(u, '{quoted(E.SMALL_ENTERPRISE)}')"
_STARTUP = f"(contains(u, '{E.STARTUP}') OR contains(u, 'CERTIFICATE OF RECOGNITION') AND contains(u, 'DEPARTMENT FOR PROMOTION'))"
_VERDICTS = {
    "R1": f"CASE WHEN {_SMALL} OR {_STARTUP} THEN 'PASS (Waiver)' ELSE experience END", "R2": f"CASE WHEN {_SMALL} OR {_STARTUP} THEN 'PASS (Waiver)' ELSE turnover END", "R3": "net_worth", "R4": "maf", "R5": "iso",
    "R6": f"CASE WHEN len(u) > 100 AND len({missing_sql('u')}) = 0 THEN 'PASS' ELSE 'FAIL' END", "R7": "CASE WHEN files >= 3 THEN 'PASS' ELSE 'ADVISORY' END",
    "R8": f"CASE WHEN {sql_any(E.DEPOSIT_PROOF)} OR {_SMALL} OR {_STARTUP} THEN 'PASS' ELSE 'FAIL' END",
}
_SCORE = "CASE WHEN contains(status, 'Risk') THEN CASE rule WHEN 'R2' THEN 15 WHEN 'R3' THEN 10 ELSE weight END WHEN starts_with(status, 'PASS') THEN weight WHEN status = 'ADVISORY' THEN 2 ELSE 0 END"
#: (doc_id, rule, weight, status, score) of every document.
PQC = f"""{AUDIT.strip()},
verdicts AS ({" UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, {_WEIGHTS[r]} AS weight, {v} AS status FROM eligible" for r, v in _VERDICTS.items())}),
pqc AS (SELECT *, {_SCORE} AS score FROM verdicts)"""


def submissions(t):
    """Documents with the number of their vendor's documents; texts stay where they are read."""
    d = t.documents()
    files = small(durable(d.groupBy(F.col("vendor_id").alias("owner")).agg(F.count(F.lit(1)).alias("files"))))
    return d.join(files, F.col("vendor_id").eqNullSafe(F.col("owner"))).drop("owner")


def pqc(t):
    return R.qualify(submissions(t), "doc_id", *NEEDED.values())


@query(f"WITH {PQC} SELECT doc_id, rule, weight, status, score FROM pqc")
def pqc_evaluate(t):
    return pqc(t).select("doc_id", "rule", "weight", "status", "score")


_ANOMALIES = "((len(t) < 300)::INT + contains(lower(t), 'draft')::INT)"


@query(f"""
WITH {PQC}, p AS (SELECT doc_id, sum(score) AS points, sum(weight) AS most, {", ".join(f"max(status) FILTER (rule = '{r}') AS {r}" for r in _WEIGHTS)} FROM pqc GROUP BY 1),
f AS (SELECT p.*, files, {_ANOMALIES} AS anomalies, 95 AS auth, (least(2000, len(t)) + 1) // 2 AS quality FROM p JOIN text_ USING (doc_id)),
a AS (SELECT *, round(100 * points / most)::INT AS compliance, greatest(10, least(100, auth - 10 * anomalies - CASE WHEN files < 3 THEN 15 ELSE 0 END)) AS forensic,
  CASE WHEN R2 = 'FAIL' OR R3 = 'FAIL' THEN 25 WHEN contains(R3, 'Risk') THEN 70 ELSE 95 END AS financial,
  greatest(10, 100 - CASE WHEN R6 = 'FAIL' THEN 45 ELSE 0 END - CASE WHEN R4 = 'FAIL' THEN 35 ELSE 0 END - CASE WHEN R5 <> 'PASS' THEN 10 ELSE 0 END) AS technical,
  CASE WHEN 'FAIL' IN (R2, R3, R4, R6, R8) THEN 'Rejected' WHEN R1 = 'FAIL' THEN 'Experience not substantiated' ELSE 'Accepted' END AS verdict FROM f),
o AS (SELECT *, round((30 * compliance + 25 * forensic + 25 * financial + 20 * technical) / 100)::INT AS overall FROM a)
SELECT doc_id, compliance, forensic, financial, technical, greatest(10, 98 - 15 * anomalies - CASE WHEN verdict = 'Rejected' THEN 25 ELSE 0 END - CASE WHEN files < 3 THEN 10 ELSE 0 END) AS collusion_safe,
  overall, CASE WHEN overall >= 85 THEN 'LOW' WHEN overall >= 65 THEN 'MEDIUM' WHEN overall >= 40 THEN 'HIGH' ELSE 'CRITICAL' END AS level, verdict, greatest(10, least(100, (700 * overall + 30 * quality + 500) // 1000))::INT AS confidence FROM o""")
def pqc_risk_profile(t):
    """Risk profile of each document as a submission: its qualification, short and draft texts as anomalies, and its length as reading quality."""
    text = F.coalesce("text", F.lit(""))
    anomalies = (F.char_length(text) < 300).cast("int") + X.flag(F.lower(text), "draft").cast("int")
    forensic = submissions(t).select("doc_id", "files", anomalies.alias("anomalies"), F.lit(95).alias("authenticity"), F.least(F.lit(1.0), F.char_length(text) / 2000).alias("quality"))
    return R.risk_profile(pqc(t).join(forensic, "doc_id"), "doc_id")


@query("""
WITH have AS (SELECT vendor_id, count(DISTINCT doc_type) AS kinds, count(*) AS docs FROM bid_documents GROUP BY 1), m AS (SELECT bid_id, vendor_id, total_amount / estimated_value AS ratio, is_disqualified FROM bid_fact)
SELECT bid_id, CASE WHEN docs IS NULL THEN 'Not' WHEN kinds < 4 THEN 'Unverified' ELSE 'Given' END AS documents, CASE WHEN ratio >= 1 THEN 'STRONG' WHEN ratio >= 0.8 THEN 'ADEQUATE' WHEN ratio >= 0.6 THEN 'WEAK' ELSE 'INSUFFICIENT' END AS financial, NOT is_disqualified AND ratio >= 0.6 AND docs IS NOT NULL AS recommended FROM m LEFT JOIN have USING (vendor_id)""")
def tcr_matrix(t):
    have = t.documents().groupBy("vendor_id").agg(F.count_distinct("doc_type").alias("kinds"), F.count(F.lit(1)).alias("docs"))
    m = t.bid_fact().join(have, "vendor_id", "left").withColumn("ratio", F.col("total_amount") / F.col("estimated_value"))
    given = F.when(F.col("docs").isNull(), "Not").when(F.col("kinds") < 4, "Unverified").otherwise("Given")
    return m.select("bid_id", given.alias("documents"), above(F.col("ratio"), [(1.0, "STRONG"), (0.8, "ADEQUATE"), (0.6, "WEAK")], "INSUFFICIENT").alias("financial"), (~F.col("is_disqualified") & (F.col("ratio") >= 0.6) & F.col("docs").isNotNull()).alias("recommended"))


@query("SELECT bid_id, criteria_name, 'Clarify ' || criteria_name || ': score below ' || threshold::INT::VARCHAR AS query FROM bid_scores JOIN criteria USING (criteria_id) WHERE score < threshold")
def clarification_queries(t):
    j = t.bid_scores().join(F.broadcast(t.criteria()), "criteria_id").filter("score < threshold")  # three rows
    return j.select("bid_id", "criteria_name", F.concat(F.lit("Clarify "), "criteria_name", F.lit(": score below "), F.col("threshold").cast("int").cast("string")).alias("query"))


@query("""
SELECT po_id, round(0.02 * invoice_amount, 4) AS tds, round(v, 6) AS variance_pct, CASE WHEN v = 0 THEN 'EXACT' WHEN v <= 5 THEN 'TOLERATED' ELSE 'MISMATCH' END AS match, CASE WHEN v <= 5 THEN 'Released' ELSE 'Held' END AS payment FROM (SELECT po_id, invoice_amount, abs(invoice_amount - po_value) / po_value * 100 AS v FROM purchase_orders WHERE invoice_amount IS NOT NULL)""")
def three_way_match(t):
    p = t.purchase_orders().filter("invoice_amount is not null").withColumn("v", F.abs(F.col("invoice_amount") - F.col("po_value")) / F.col("po_value") * 100)
    return p.select("po_id", r(0.02 * F.col("invoice_amount"), 4).alias("tds"), r("v").alias("variance_pct"), F.when(F.col("v") == 0, "EXACT").when(F.col("v") <= 5, "TOLERATED").otherwise("MISMATCH").alias("match"), F.when(F.col("v") <= 5, "Released").otherwise("Held").alias("payment"))


@query("""
WITH f AS (SELECT po_id, count(*) AS failed, CASE WHEN max(tax) > 0 THEN 'damages of ' || round(max(tax) * 100)::INT || '% of the value' ELSE 'damages as agreed' END AS clause FROM deliveries WHERE inspection = 'Failed' GROUP BY 1),
x AS (SELECT vendor_id, failed, po_value * coalesce(TRY_CAST(nullif(regexp_extract(clause, '([0-9]+(?:\\.[0-9]+)?)\\s*%', 1), '') AS DOUBLE), 0.5) / 100 AS penalty FROM purchase_orders JOIN f USING (po_id))
SELECT vendor_id, sum(failed)::BIGINT AS failed, round((sum(penalty))::DECIMAL(38,9), 6)::DOUBLE AS penalty, round(any_value(performance_score) - 10 * sum(failed), 4) AS score, any_value(performance_score) - 10 * sum(failed) < 40 AS blacklist FROM x JOIN vendors USING (vendor_id) GROUP BY 1""")
def ld_penalty(t):
    """Damages of orders with failed deliveries; each order's clause is written from the highest tax of its failed lines, and names no rate where that is 0."""
    tax = F.max("tax")
    clause = F.when(tax > 0, F.concat(F.lit("damages of "), F.round(tax * 100).cast("int"), F.lit("% of the value"))).otherwise("damages as agreed")
    failed = t.deliveries().filter("inspection = 'Failed'").groupBy("po_id").agg(F.count(F.lit(1)).alias("failed"), clause.alias("ld_clause"))
    d = R.damages(t.purchase_orders(), failed, t.vendors())
    return d.select("vendor_id", "failed", exact("penalty").alias("penalty"), r("score", 4).alias("score"), "blacklist")


@query("""
WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS dispute_id, l_orderkey AS po_id, bool_or(month(l_shipdate) BETWEEN 6 AND 9) AS wet FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
x AS (SELECT dispute_id, po_id, CASE WHEN wet THEN 75.0 ELSE 0.0 END::DOUBLE AS refund_pct, round((CASE WHEN wet THEN 0.75 ELSE 0 END * (0.005 * po_value))::DECIMAL(38,9), 2)::DOUBLE AS refund, po_value, invoice_amount FROM f JOIN purchase_orders USING (po_id)),
y AS (SELECT *, greatest(0, 0.01 * po_value - sum(refund) OVER (PARTITION BY po_id ORDER BY dispute_id)) AS ld_left FROM x)
SELECT dispute_id, po_id, refund_pct, refund, round(ld_left::DECIMAL(38,9), 4)::DOUBLE AS ld_left, round((invoice_amount - 0.02 * invoice_amount - ld_left)::DECIMAL(38,9), 2)::DOUBLE AS net_payable FROM y""")
def dispute_refund(t):
    """Disputes of failed lines, by number: 0.5 % of the order's value each, of 1 % held back; the weather is that of the months of shipping, wet from June to September."""
    o, wet = t.purchase_orders(), F.bool_or(F.month("l_shipdate").between(6, 9))
    failed = t.raw("lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.when(wet, "monsoon").otherwise("dry").alias("weather"))
    lines = failed.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("dispute_id"), F.col("l_orderkey").alias("po_id"), "weather")
    disputes = lines.join(o.select("po_id", (0.005 * F.col("po_value")).alias("disputed_amount")), "po_id").withColumn("statement", F.lit("delivered late"))
    payments = o.select("po_id", "invoice_amount", (0.02 * F.col("invoice_amount")).alias("tds_deduction"), (0.01 * F.col("po_value")).alias("ld_deduction"))
    return R.settle_disputes(disputes, payments).withColumn("ld_left", exact("ld_left", 4))


@query("""
WITH a AS (SELECT tender_id, avg(total_amount) AS mu, stddev_samp(total_amount) AS sd, min(total_amount) AS l1, any_value(estimated_value) AS est FROM bid_fact GROUP BY 1 HAVING count(*) > 1), x AS (SELECT *, mu - 0.675 * sd AS p25 FROM a)
SELECT tender_id, round(sd / mu, 6) AS cv, round(p25, 5) AS p25, round(0.97 * p25, 5) AS optimum, round(least(8, greatest(0, (l1 - 0.97 * p25) / l1 * 100)), 5) AS reduction_pct, l1 < 0.7 * est AS predatory FROM x""")
def negotiation_target(t):
    a = t.bid_fact().groupBy("tender_id").agg(F.avg("total_amount").alias("mu"), F.stddev_samp("total_amount").alias("sd"), F.min("total_amount").alias("l1"), F.first("estimated_value").alias("est"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    p25 = F.col("mu") - 0.675 * F.col("sd")
    cut = F.least(F.lit(8.0), F.greatest(F.lit(0.0), (F.col("l1") - 0.97 * p25) / F.col("l1") * 100))
    return a.select("tender_id", r(F.col("sd") / F.col("mu")).alias("cv"), r(p25, 5).alias("p25"), r(0.97 * p25, 5).alias("optimum"), r(cut, 5).alias("reduction_pct"), (F.col("l1") < 0.7 * F.col("est")).alias("predatory"))


@query("""
WITH x AS (SELECT vendor_id, 20 + 15 * make_in_india::INT + 15 * msme::INT + 10 * startup::INT + 5 * (NOT is_blacklisted)::INT + 0.3 * performance_score AS esg FROM vendors) SELECT vendor_id, round(esg, 6) AS esg, CASE WHEN esg >= 85 THEN 'AAA' WHEN esg >= 70 THEN 'AA' WHEN esg >= 55 THEN 'A' WHEN esg >= 40 THEN 'BBB' ELSE 'B' END AS grade FROM x""")
def vendor_esg_scorecard(t):
    i = lambda c: c.cast("int")
    e = 20 + 15 * i(F.col("make_in_india")) + 15 * i(F.col("msme")) + 10 * i(F.col("startup")) + 5 * i(~F.col("is_blacklisted")) + 0.3 * F.col("performance_score")
    return t.vendors().select("vendor_id", r(e).alias("esg"), above(e, [(85, "AAA"), (70, "AA"), (55, "A"), (40, "BBB")], "B").alias("grade"))


@query("""
SELECT tender_id, count(*) AS bids, round((any_value(estimated_value) - min(total_amount)) / any_value(estimated_value) * 100, 6) AS savings_pct, round((avg(performance_score))::DECIMAL(38,9), 6)::DOUBLE AS trust, round(100.0 * count(DISTINCT country) / count(*), 6) AS geo_spread, round((avg(score_1))::DECIMAL(38,9), 6)::DOUBLE AS technical, count(*) FILTER (total_amount > 1.3 * estimated_value OR total_amount < 0.7 * estimated_value) AS anomalies FROM bid_fact GROUP BY 1""")
def tender_dossier(t):
    odd = (F.col("total_amount") > 1.3 * F.col("estimated_value")) | (F.col("total_amount") < 0.7 * F.col("estimated_value"))
    n, est = F.count(F.lit(1)), F.first("estimated_value")
    return t.bid_fact().groupBy("tender_id").agg(n.alias("bids"), r((est - F.min("total_amount")) / est * 100).alias("savings_pct"), exact(F.avg("performance_score")).alias("trust"), r(100.0 * F.count_distinct("country") / n).alias("geo_spread"), exact(F.avg("score_1")).alias("technical"), count_if(odd).alias("anomalies"))


@query("SELECT bid_id, delivery_period, CASE WHEN delivery_period <= 10 THEN 'LOW' WHEN delivery_period <= 25 THEN 'MODERATE' WHEN delivery_period <= 40 THEN 'HIGH' ELSE 'CRITICAL' END AS risk FROM bids")
def delivery_risk(t, steps=(10, 25, 40)):
    low, mid, high = steps
    return t.bids().select("bid_id", "delivery_period", ladder(F.col("delivery_period"), [(low + 1, "LOW"), (mid + 1, "MODERATE"), (high + 1, "HIGH")], "CRITICAL").alias("risk"))


@query("""
WITH e AS (SELECT event_id, least(100, value) AS live, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS age, action = 'error' AS virtual FROM audit),
s AS (SELECT event_id, 0.6 * live + 0.4 * CASE WHEN virtual THEN 0 ELSE 100 - CASE WHEN floor(age) > 300 THEN 40 ELSE 0 END END AS score FROM e)
SELECT event_id, round(score, 6) AS score, score < 85 AS failed FROM s""")
def identity_check_score(t):
    """Requests (here: events) by their value as liveness, seconds since the user's last one as age, and failed actions as virtual devices."""
    before = F.lag(F.unix_micros("ts")).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t.audit().withColumn("age", F.floor((F.unix_micros("ts") - before) / 1_000_000))
    none = F.lit(None).cast("int")
    score, failed = R.identity_check(F.least(F.lit(100.0), F.col("value")), none, none, none, F.col("age"), F.col("action") == "error", F.lit(False))
    return e.select("event_id", r(score).alias("score"), failed.alias("failed"))


INDENT_CRITERIA = [("Technical", 40), ("Experience", 20), ("Delivery", 15), ("Compliance", 15), ("Sustainability", 10)]


@query("SELECT tender_id, round(0.02 * estimated_value, 6) AS emd, criteria, weight FROM tenders, (VALUES " + ", ".join(f"('{n}', {w})" for n, w in INDENT_CRITERIA) + ") c(criteria, weight) WHERE tender_status = 'Draft'")
def indent_to_tender(t):
    rows = t.spark.createDataFrame(INDENT_CRITERIA, "criteria string, weight int")
    return t.tenders().filter("tender_status = 'Draft'").crossJoin(F.broadcast(rows)).select("tender_id", r(0.02 * F.col("estimated_value")).alias("emd"), "criteria", "weight")  # five rows


def sql_evidence(words) -> str:
    """A structure (line, snippet, confidence) of the column t."""
    word = r"\b(?:" + "|".join(words) + r")\b"
    at = f"list_position(list_transform(string_split(t, chr(10)), lambda x: regexp_matches(x, '(?i){word}')), true)"
    return f"(SELECT {{'pos': pos, 's': regexp_replace(array_to_string(string_split(t, chr(10))[greatest(1, pos - 2):pos + 2], chr(10)), '^\\s+|\\s+$', '', 'g')}} FROM (SELECT {at} AS pos))"


def sql_evidence_columns(words, e: str = "e") -> str:
    word = r"\b(?:" + "|".join(words) + r")\b"
    near = rf"(?i){word}[\s\S]{{0,50}}{R.MONEY}|{R.MONEY}[\s\S]{{0,50}}{word}"
    short = f"CASE WHEN len({e}.s) > 400 THEN substr({e}.s, 1, 397) || '...' ELSE {e}.s END"
    return f"CASE WHEN {e}.pos > 0 THEN {e}.pos - 1 END AS line, CASE WHEN {e}.pos > 0 THEN {short} END AS snippet, CASE WHEN coalesce({e}.pos, 0) = 0 THEN 'low' WHEN regexp_matches({e}.s, '{near}') THEN 'high' ELSE 'medium' END AS confidence"


_BEFORE = "string_split(t, chr(10))[1:e.pos]"
_PAGES = f"list_filter(list_transform({_BEFORE}, lambda x: regexp_extract(x, '{X.PAGE_MARK}', 1)), lambda x: x <> '')"
_HEADS = f"list_filter({_BEFORE}, lambda x: regexp_matches(x, '{SQL_HEADING}'))"
_PLACE = f"CASE WHEN e.pos > 0 THEN coalesce({_PAGES}[-1]::INT, 1) END AS page, CASE WHEN e.pos > 0 THEN {_HEADS}[-1] END AS section"
_PROOF = " UNION ALL ".join(f"SELECT doc_id, plain, '{rule}' AS rule, '{need}' AS need, '{grave}' AS grave, {_PLACE}, {sql_evidence_columns(words)} FROM (SELECT doc_id, t, {sql_normal('t')} AS plain, {sql_evidence(words)} AS e FROM text_)" for rule, need, words, grave in R.NEEDS)


def sql_holds(quote: str, cut: str) -> str:
    return f"({sql_normal(quote)} <> '' AND contains(' ' || plain || ' ', ' ' || {sql_normal(quote)} || CASE WHEN {cut} THEN '' ELSE ' ' END))"


@query(f"""
WITH {PQC}, proof AS ({_PROOF}), cited AS (SELECT doc_id + k AS doc_id, 'R5' AS rule, string_split(text, chr(10))[1] AS citation FROM documents, unnest(range(2)) u(k) WHERE doc_id % 2 = 0)
SELECT doc_id, rule, need, status, CASE WHEN status = 'FAIL' THEN 'missing: ' || need ELSE 'met' END AS gap,
  CASE WHEN status = 'FAIL' THEN grave WHEN contains(status, 'Risk') THEN 'warning' WHEN status = 'ADVISORY' THEN 'info' ELSE 'success' END AS severity,
  source, page, section, line, confidence, coalesce({sql_holds("citation", "false")}, {sql_holds("snippet", "ends_with(snippet, '...')")}, false) AS citation_verified
FROM pqc JOIN proof USING (doc_id, rule) JOIN documents USING (doc_id) LEFT JOIN cited USING (doc_id, rule)""")
def gap_analysis(t):
    """One row per document and qualification rule: need, gap, severity, the line, page and section that show it, and whether the citation is verified.

    The first line of each document with an even number is given as its and the next one's citation for rule R5.
    """
    cited = t.raw("documents").filter("doc_id % 2 = 0").select(F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("doc_id"), F.lit("R5").alias("rule"), F.element_at(F.split("text", "\n"), 1).alias("citation"))
    return R.gap_analysis(pqc(t), t.documents(), "doc_id", F.col("source"), cited).drop("snippet")


@query(f"""
WITH {CITED.strip()} SELECT id, CASE WHEN match IS NOT NULL THEN size ELSE 0 END AS value, CASE WHEN match IS NOT NULL THEN 'citation verified' ELSE 'citation not verified' END AS reason FROM cited""")
def citation_gated_merge(t):
    """Each item's length as the extracted value, with its whole text as the citation that must be verified; the baseline is 0."""
    q = quotes(t)
    fields = q.select("id", F.char_length(F.trim("quote")).cast("bigint").alias("extracted"), F.lit(0).cast("bigint").alias("baseline"))
    return R.citation_gated(fields, X.citation_guard(q, t.documents()))


@query(f"""
WITH {PROFILE_SQL}, q(word, kind) AS (VALUES ('orders', 'experience'), ('income', 'turnover')), a AS (SELECT vendor_id, count(*) AS relevant, count(*) FILTER (credit < 1) AS failed FROM scored JOIN q USING (kind) GROUP BY 1)
SELECT vendor_id, round(0.8 * (1 - failed / relevant) * 100 + 0.2 * performance_score, 6) AS prediction, CASE WHEN 0.8 * (1 - failed / relevant) * 100 + 0.2 * performance_score >= 75 THEN 'COMPLIANT' ELSE 'AT RISK' END AS verdict FROM a JOIN vendors USING (vendor_id)""")
def clause_pass_prediction(t, asked=(("orders", "experience"), ("income", "turnover"))):
    q = t.spark.createDataFrame(list(asked), "word string, kind string")
    a = profile_credits(t).join(F.broadcast(q), "kind").groupBy("vendor_id").agg(F.count(F.lit(1)).alias("relevant"), count_if(F.col("credit") < 1).alias("failed"))
    p = 0.8 * (1 - F.col("failed") / F.col("relevant")) * 100 + 0.2 * F.col("performance_score")
    return a.join(t.vendors(), "vendor_id").select("vendor_id", r(p).alias("prediction"), F.when(p >= 75, "COMPLIANT").otherwise("AT RISK").alias("verdict"))


@query("SELECT decision_id, CASE WHEN human_action NOT IN ('accepted', 'modified') THEN 'unknown action' WHEN rating NOT BETWEEN 1 AND 4 THEN 'rating out of range' END AS rejected, round(abs(ai_score - human_score), 6) AS deviation FROM decisions")
def feedback_resolution(t):
    d = t.decisions()
    return d.select("decision_id", F.when(~F.col("human_action").isin("accepted", "modified"), "unknown action").when(~F.col("rating").between(1, 4), "rating out of range").alias("rejected"), r(F.abs(F.col("ai_score") - F.col("human_score"))).alias("deviation"))


#: Rules of a tender: name and description.
ASKED = [("Technical specification", ""), ("Past performance", ""), ("Delivery period", ""), ("Quality system", ""), ("Financial standing", ""), ("License notice", "licensed version")]
_HITS = [f"max(({sql_any(R.rule_words(*rule), 't')})::INT)" for rule in ASKED]
#: What stands in the given texts for an authorization, credentials and an annexure.
SHOWN = {"maf": "@", "credentials": "licensed under", "annexure": "rights reserved"}
_PROOFS = ", ".join(f"max(contains(t, '{w}')::INT) AS {k}" for k, w in SHOWN.items())


@query(f"""
WITH d AS (SELECT vendor_id, lower(coalesce(text, '')) AS t FROM bid_documents),
a AS (SELECT vendor_id, count(*) AS files, {", ".join(f"{h} AS h{i}" for i, h in enumerate(_HITS))}, {_PROOFS} FROM d GROUP BY 1),
c AS (SELECT *, h0 + h1 + h2 + h3 + h4 + h5 AS hits, least(100, greatest(0, 20 + 15 * maf + 15 * credentials + 10 * annexure + 15 * (h0 + h1 + h2 + h3 + h4 + h5) - 5 * (6 - (h0 + h1 + h2 + h3 + h4 + h5))))::INT AS confidence FROM a)
SELECT vendor_id, files, hits::BIGINT AS hits, confidence, least(100, 50 * credentials + 25 * (h0 + h1) + 8 * files + confidence // 3)::INT AS technical, CASE WHEN h4 > 0 THEN 100 ELSE 20 END::INT AS financial,
  least(100, 40 * maf + 20 * annexure + 40 + confidence // 4)::INT AS compliance, least(100.0, greatest(5.0, 100 + 15 * (6 - hits) - floor(confidence / 1.5)))::DOUBLE AS risk, CASE WHEN maf + credentials + annexure = 3 THEN 'Accepted' ELSE 'Rejected' END AS status FROM c""")
def ontology_rule_check(t):
    """Rules by synonym over each vendor's documents; the given texts name no forms, so words that they do hold stand for them (``SHOWN``)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return R.ontology_check(t.documents(), "vendor_id", ASKED, *[F.contains(low, F.lit(w)) for w in SHOWN.values()])


@query("""
SELECT vendor_id, count(*) AS files, count(*) FILTER (human_action = 'accepted') AS accepted, count(*) FILTER (human_action = 'rejected') AS rejected, count(*) FILTER (human_action = 'modified') AS pending, count(*) FILTER (confidence < 0.2) AS anomalies,
  row_number() OVER (ORDER BY count(*) FILTER (human_action = 'rejected'), round(-avg(confidence), 9), vendor_id) AS place FROM decisions GROUP BY 1""")
def pqc_status_summary(t):
    act = F.col("human_action")
    a = t.decisions().groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("files"), *[count_if(act == k).alias(n) for k, n in (("accepted", "accepted"), ("rejected", "rejected"), ("modified", "pending"))],
        count_if(F.col("confidence") < 0.2).alias("anomalies"), F.round(-F.avg("confidence"), 9).alias("c"),
    )
    placed, _ = ranked(a, [], [F.col("rejected"), F.col("c"), F.col("vendor_id")], small_keys=True)
    return placed.withColumn("place", F.col("rank") + 1).drop("c", "rank")
