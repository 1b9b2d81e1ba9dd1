"""Rule evaluation over a user's own columns: procurement rules, qualification, gaps, citations, penalties and identity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import above, count_if
from . import extraction as E
from . import text as X

#: Procurement rules: id, title, what is tested, bound, severity, and words that a question about the rule holds (fixed values).
PROCUREMENT_RULES = (
    ("GFR-2017-R173", "Minimum Competition Requirement", "min_bids", 3.0, "CRITICAL", ("competition", "minimum bids", "valid comparison", "open tender", "3 bids", "participation")),
    ("GFR-2017-R175", "Price Reasonableness Check", "price_deviation_pct", 25.0, "HIGH", ("price reasonableness", "estimate", "deviation", "overpriced", "pac approval", "above estimate")),
    ("GFR-2017-R160", "Mandatory Vendor Documentation", "documentation", None, "CRITICAL", ("documentation", "gst", "pan", "experience", "mandatory", "certificate", "document")),
    ("GFR-2017-R162", "Bid Validity Period", "validity_days", 90.0, "MODERATE", ("bid validity", "validity period", "90 days", "valid")),
    ("CVC-GL-01", "Single Tender / Limited Tender Justification", "single_source", None, "HIGH", ("single tender", "limited tender", "single source", "justification", "cvc")),
    ("CVC-GL-02", "Identical Bids Prohibition", "bid_gap_pct", 0.5, "CRITICAL", ("identical bids", "collusion", "same price", "cartel", "near identical", "clustering")),
    ("CVC-GL-03", "Same IP Address Submissions", "ip_collision", None, "CRITICAL", ("ip address", "same ip", "submission", "collusion", "ip collision")),
    ("CVC-GL-04", "Post-Tender Negotiation Prohibition", "negotiation", None, "HIGH", ("negotiation", "post-tender", "l1 negotiation", "price negotiation")),
    ("GEM-DPIIT-01", "MSME 25% Procurement Mandate", "msme_pct", 25.0, "COMPLIANCE", ("msme", "25%", "msme mandate", "small enterprise", "micro", "sme")),
    ("GEM-DPIIT-02", "Class I / Class II Local Supplier Preference", "local_content", 50.0, "HIGH", ("make in india", "local content", "class i", "class ii", "dpiit", "local supplier")),
    ("GEM-DPIIT-03", "Blacklisted Vendor Exclusion", "blacklist_check", None, "CRITICAL", ("blacklist", "debar", "excluded", "banned", "integrity")),
    ("GEM-DPIIT-04", "Earnest Money Deposit (EMD) Requirement", "emd_compliance", 10.0, "MODERATE", ("emd", "earnest money", "deposit", "bid security")),
    ("IOCL-PR-01", "L1 Underbid Protection", "alb_pct", 70.0, "HIGH", ("abnormally low", "alb", "underbid", "below estimate", "70%", "dumping")),
    ("IOCL-PR-02", "Performance Bank Guarantee Requirement", "pbg_threshold", 50.0, "HIGH", ("performance bank guarantee", "pbg", "performance bond", "50 lakh")),
    ("IOCL-PR-03", "OISD Safety Certification for Petroleum Equipment", "safety_cert", None, "CRITICAL", ("oisd", "petroleum", "refinery", "safety", "137", "certification")),
)
#: Tenders from this many lakhs on need three bids; bids this far below the estimate are a warning (fixed values).
COMPETITION_FROM, LOW_PRICE_PCT = 25.0, -25.0


def relevant_rules(question: str, rules=PROCUREMENT_RULES, most: int = 10) -> list[str]:
    """Ids of the rules that a question is about, by words it shares with them, at most ``most``; all rules where it shares none."""
    hits = [(-sum(w in question.lower() for w in words), i, rule) for i, (rule, *_, words) in enumerate(rules)]
    asked = [rule for n, _, rule in sorted(hits) if n < 0][:most]
    return asked or [rule for rule, *_ in rules]


def tender_context(bids: DataFrame, unit: float = 100_000.0) -> DataFrame:
    """What the rules test, per tender, of bids (tender_id, bid_id, total_amount, estimated_value, is_disqualified, msme, is_blacklisted); amounts in ``unit``."""
    paid = F.when(F.col("total_amount") > 0, F.col("total_amount"))
    previous = F.lag("paid").over(W.partitionBy("tender_id").orderBy(F.col("paid").asc_nulls_first(), "bid_id"))
    b = bids.withColumn("paid", paid).withColumn("gap", (F.col("paid") - previous) / previous * 100)
    n = F.count(F.lit(1))
    first = F.round(F.coalesce(F.min(F.when(~F.col("is_disqualified"), F.col("paid"))), F.lit(0.0)) / unit, 2)
    return b.groupBy("tender_id").agg(
        n.alias("n_bids"), F.count("paid").alias("n_paid"), F.round(F.coalesce(F.first("estimated_value"), F.lit(0.0)) / unit, 2).alias("estimate"), first.alias("l1"),
        F.round(100.0 * count_if(F.col("msme")) / n, 2).alias("msme_pct"), F.coalesce(F.max(F.col("is_blacklisted").cast("int")), F.lit(0)).alias("blacklisted"), F.coalesce(F.min("gap"), F.lit(100.0)).alias("min_gap"),
    )


def procurement_rules(context: DataFrame, question: str = "", rules=PROCUREMENT_RULES) -> DataFrame:
    """(tender_id, rule_id, title, severity, status) for each tender and relevant rule: VIOLATION, WARNING, ADVISORY, COMPLIANT or NOT_EVALUATED."""
    asked = set(relevant_rules(question, rules))
    table = context.sparkSession.createDataFrame([r[:5] for r in rules if r[0] in asked], "rule_id string, title string, kind string, bound double, severity string")
    kind, bound = F.col("kind"), F.col("bound")
    priced = (F.col("estimate") > 0) & (F.col("l1") > 0)
    estimate = F.when(F.col("estimate") > 0, F.col("estimate"))
    deviation = (F.col("l1") - estimate) / estimate * 100
    one = lambda test, bad="VIOLATION": F.when(test, bad).otherwise("COMPLIANT")
    status = (
        F.when(kind == "min_bids", one((F.col("estimate") >= COMPETITION_FROM) & (F.col("n_bids") < bound)))
        .when(kind == "price_deviation_pct", F.when(~priced, "NOT_EVALUATED").when(deviation > bound, "VIOLATION").when(deviation < LOW_PRICE_PCT, "WARNING").otherwise("COMPLIANT"))
        .when(kind == "bid_gap_pct", F.when(F.col("n_paid") < 2, "NOT_EVALUATED").otherwise(one(F.col("min_gap") < bound)))
        .when(kind == "msme_pct", one(F.col("msme_pct") < bound, "WARNING"))
        .when(kind == "blacklist_check", one(F.col("blacklisted") > 0))
        .when(kind == "alb_pct", F.when(~priced, "NOT_EVALUATED").otherwise(one(F.col("l1") / estimate * 100 < bound)))
        .otherwise("ADVISORY")
    )
    return context.crossJoin(F.broadcast(table)).select("tender_id", "rule_id", "title", "severity", status.alias("status"))  # at most fifteen rules


def rule_summary(results: DataFrame) -> DataFrame:
    """Counts of each status per tender, and the overall status."""
    s = F.col("status")
    names = ("VIOLATION", "WARNING", "ADVISORY", "COMPLIANT", "NOT_EVALUATED")
    grave = count_if((s == "VIOLATION") & F.col("severity").isin("CRITICAL", "HIGH"))
    a = results.groupBy("tender_id").agg(*[count_if(s == n).alias(n.lower()) for n in names], grave.alias("grave"))
    overall = F.when(F.col("grave") > 0, "NON-COMPLIANT").when(F.col("warning") + F.col("advisory") > 0, "PARTIAL COMPLIANCE").otherwise("COMPLIANT")
    return a.withColumn("overall_status", overall).drop("grave")


def qualify(docs: DataFrame, key: str, one: float, two: float, three: float, turnover: float, relaxation: bool = True) -> DataFrame:
    """(key, rule, name, weight, status, score): the eight qualification rules of each row's ``text`` and number of ``files``."""
    q = E.qualification(F.col("text"), F.col("files"), *map(F.lit, (one, two, three, turnover)), F.lit(relaxation))
    return docs.select(key, F.explode(q).alias("q")).select(key, "q.*")


def risk_profile(results: DataFrame, key: str, authenticity: str = "authenticity", anomalies: str = "anomalies", files: str = "files", quality: str = "quality") -> DataFrame:
    """Risk profile of each key from its qualification results joined with forensic columns: four scores, collusion index, overall, level, verdict, confidence."""
    status = lambda rule: F.max(F.when(F.col("rule") == rule, F.col("status")))
    forensic = [F.first(c).alias(c) for c in (authenticity, anomalies, files, quality)]
    a = results.groupBy(key).agg(F.sum("score").alias("points"), F.sum("weight").alias("most"), *[status(r).alias(r) for r, *_ in E.PQC_RULES], *forensic)
    few = F.col(files) < 3
    within = lambda c: F.greatest(F.lit(10), F.least(F.lit(100), c))
    number = lambda test, n: F.when(test, n).otherwise(0)
    failed = lambda *rules: sum(((F.col(r) == "FAIL").cast("int") for r in rules), F.lit(0))
    a = a.withColumn("compliance", F.round(100 * F.col("points") / F.col("most")).cast("int"))
    a = a.withColumn("forensic", within(F.round(F.col(authenticity) - 10 * F.col(anomalies)).cast("int") - number(few, 15)))
    a = a.withColumn("financial", F.when(failed("R2", "R3") > 0, 25).when(F.col("R3").contains("Risk"), 70).otherwise(95))
    a = a.withColumn("technical", within(100 - number(F.col("R6") == "FAIL", 45) - number(F.col("R4") == "FAIL", 35) - number(F.col("R5") != "PASS", 10)))
    core = failed("R2", "R3", "R4", "R6", "R8")
    verdict = F.when(core > 0, "Rejected").when(F.col("R1") == "FAIL", "Experience not substantiated").otherwise("Accepted")
    a = a.withColumn("verdict", verdict)
    a = a.withColumn("collusion_safe", within(98 - 15 * F.col(anomalies) - number(F.col("verdict") == "Rejected", 25) - number(few, 10)))
    overall = F.round((30 * F.col("compliance") + 25 * F.col("forensic") + 25 * F.col("financial") + 20 * F.col("technical")) / 100).cast("int")
    a = a.withColumn("overall", overall).withColumn("level", above(F.col("overall"), [(85, "LOW"), (65, "MEDIUM"), (40, "HIGH")], "CRITICAL"))
    tenths = 7000 * F.col("overall") + 300 * F.round(1000 * F.col(quality).cast("decimal(38,9)")).cast("bigint")  # of a thousandth: halves round up, whatever the noise of binary fractions
    confidence = within(F.floor((tenths + 5000) / 10_000).cast("int"))
    return a.select(key, "compliance", "forensic", "financial", "technical", "collusion_safe", "overall", "level", "verdict", confidence.alias("confidence"))


def citation_gated(fields: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """(key, value, reason): the extracted value where its citation is verified, else the baseline."""
    j = fields.join(verdicts.select(key, "verdict"), key, "left")
    missing, good = F.col("extracted").isNull(), F.coalesce(F.col("verdict") == "VERIFIED", F.lit(False))
    reason = F.when(missing, "nothing extracted").when(good, "citation verified").otherwise("citation not verified")
    return j.select(key, F.when(~missing & good, F.col("extracted")).otherwise(F.col("baseline")).alias("value"), reason.alias("reason"))


def damages(orders: DataFrame, failed: DataFrame, vendors: DataFrame, clause: str = "ld_clause", default: float = 0.5) -> DataFrame:
    """Liquidated damages per vendor: the first per cent of each order's clause on its value where deliveries failed; ten points less for each of these."""
    pct = F.coalesce(E.first_match(F.col(clause), r"([0-9]+(?:\.[0-9]+)?)\s*%").try_cast("double"), F.lit(default))
    x = orders.join(failed, "po_id").withColumn("penalty", F.col("po_value") * pct / 100)
    a = x.groupBy("vendor_id").agg(F.sum("failed").alias("failed"), F.sum("penalty").alias("penalty")).join(vendors.select("vendor_id", "performance_score"), "vendor_id")
    score = F.col("performance_score") - 10 * F.col("failed")
    return a.select("vendor_id", "failed", "penalty", score.alias("score"), (score < 40).alias("blacklist"))


def identity_check(liveness: Column, fps: Column, width: Column, height: Column, age: Column, virtual: Column, placeholder: Column) -> tuple[Column, Column]:
    """(score, failed): 0.6 of liveness and 0.4 of the request's metadata integrity, at most 40 for a placeholder image; under 85 fails."""
    less = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    integrity = F.when(virtual, 0).otherwise(F.greatest(F.lit(0), 100 - less(fps < 8, 50) - less((width <= 160) & (height <= 120), 30) - less(age > 300, 40)))
    score = 0.6 * liveness + 0.4 * integrity
    score = F.when(placeholder, F.least(score, F.lit(40.0))).otherwise(score)
    return score, score < 85


#: What each qualification rule needs, the words that show it, and how grave its lack is (fixed values).
NEEDS = (
    ("R1", "orders of the required value", ("purchase order", "work order", "order value"), "error"), ("R2", "annual turnover", ("turnover", "balance sheet"), "error"), ("R3", "positive net worth", ("net worth",), "warning"),
    ("R4", "manufacturer authorization", ("authorization", "authorize", "maf"), "error"), ("R5", "quality certificate", ("iso", "bis", "certificate"), "warning"), ("R6", "all parameters of the specification", ("specification", "resolution"), "warning"),
    ("R7", "a complete submission", ("annexure", "declaration"), "info"), ("R8", "bid security", ("emd", "earnest money", "bid bond"), "error"),
)
MONEY = r"(?:INR|RS|₹|USD)\.?\s*[0-9]"


def word_of(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def line_of(text: Column, lines: Column, words: tuple[str, ...]) -> Column:
    """The 1-based first line with one of the words, else 0; lines are looked through only where the text has one."""
    word = f"(?i){word_of(words)}"
    return F.when(text.rlike(word), F.array_position(F.transform(lines, lambda x: x.rlike(word)), True).cast("int")).otherwise(0)


def lines_around(lines: Column, at: Column, around: int = 2) -> Column:
    first = F.greatest(F.lit(1), at - around)
    return F.regexp_replace(F.array_join(F.slice(lines, first, at + around - first + 1), "\n"), r"^\s+|\s+$", "")


def shortened(joined: Column, most: int = 400) -> Column:
    return F.when(F.char_length(joined) > most, F.concat(F.substring(joined, 1, most - 3), F.lit("..."))).otherwise(joined)


def near_amount(joined: Column, words: tuple[str, ...]) -> Column:
    word = word_of(words)
    return joined.rlike(rf"(?i){word}[\s\S]{{0,50}}{MONEY}|{MONEY}[\s\S]{{0,50}}{word}")


def evidence_of(text: Column, words: tuple[str, ...], around: int = 2, most: int = 400) -> Column:
    """(line, snippet, confidence): the first line with one of the words and its neighbours; high if an amount stands within 50 characters, low without any line."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")
    at = line_of(text, lines, words)
    joined = lines_around(lines, at, around)
    return F.struct(F.when(at > 0, at - 1).alias("line"), F.when(at > 0, shortened(joined, most)).alias("snippet"), F.when(at == 0, "low").when(near_amount(joined, words), "high").otherwise("medium").alias("confidence"))


def holds(normal_text: Column, quote: Column, cut: Column) -> Column:
    """A normalised text holds a quote's words in a row; the last word of a ``cut`` quote may go on."""
    q = X.normal(F.coalesce(quote, F.lit("")))
    return (q != "") & F.contains(F.concat(F.lit(" "), normal_text, F.lit(" ")), F.concat(F.lit(" "), q, F.when(cut, "").otherwise(" ")))


def gap_analysis(results: DataFrame, docs: DataFrame, key: str, source: Column | None = None, cited: DataFrame | None = None) -> DataFrame:
    """One row per key and rule: need, what is missing, severity, the evidence in the key's text, where it stands, and whether it is verified.

    ``cited`` (key, rule, citation; one row each) holds citations that somebody gave for a rule;
    they are checked against the key's own text in place of the evidence found.  A row without
    either is not verified.  ``source`` names a text; else it is its key.
    """
    needs = results.sparkSession.createDataFrame([(r, n, s) for r, n, _, s in NEEDS], "rule string, need string, grave string")
    text = F.coalesce("text", F.lit(""))
    d = docs.select(key, text.alias("text"), F.coalesce((F.col(key) if source is None else source).cast("string"), F.lit("")).alias("source"), X.normal(text).alias("plain"))
    # each step is a column of its own, as an expression that is named twice is worked out twice
    lined = d.withColumn("lines", F.split("text", "\n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), line_of(F.col("text"), F.col("lines"), words).alias("at")) for r, _, words, _ in NEEDS])
    shown = lined.select(key, "source", "lines", "plain", F.explode(rules).alias("x")).select(key, "source", "lines", "plain", "x.rule", "x.at")
    found = F.col("at") > 0
    near = F.lit(False)
    for r, _, words, _ in NEEDS:
        near = F.when(F.col("rule") == r, near_amount(F.col("joined"), words)).otherwise(near)
    shown = shown.withColumn("joined", F.when(found, lines_around(F.col("lines"), F.col("at")))).withColumn("before", F.slice("lines", F.lit(1), F.col("at"))).drop("lines")
    marks = F.filter(F.transform("before", lambda x: F.regexp_extract(x, X.PAGE_MARK, 1)), lambda x: x != "")
    shown = shown.withColumn("snippet", shortened(F.col("joined"))).withColumn("marks", marks).withColumn("heads", F.filter("before", lambda x: x.rlike(X.HEADING))).drop("before")
    last = lambda c: F.when(F.size(c) > 0, F.get(c, F.size(c) - 1))
    page, section = F.when(found, F.coalesce(last("marks").cast("int"), F.lit(1))), F.when(found, last("heads"))
    confidence = F.when(~found, "low").when(near, "high").otherwise("medium")
    shown = shown.withColumn("quote", X.normal(F.coalesce("snippet", F.lit(""))))
    own = (F.col("quote") != "") & F.contains(F.concat(F.lit(" "), "plain", F.lit(" ")), F.concat(F.lit(" "), "quote", F.when(F.endswith("snippet", F.lit("...")), "").otherwise(" ")))
    evidence = shown.select(key, "rule", "source", page.alias("page"), section.alias("section"), F.when(found, F.col("at") - 1).alias("line"), "snippet", confidence.alias("confidence"), F.coalesce(own, F.lit(False)).alias("own"))
    if cited is None:
        evidence = evidence.withColumn("given", F.lit(None).cast("boolean"))
    else:
        given = cited.select(key, "rule", "citation").join(d.select(key, "plain"), key).select(key, "rule", holds(F.col("plain"), F.col("citation"), F.lit(False)).alias("given"))
        evidence = evidence.join(given, [key, "rule"], "left")
    j = results.join(F.broadcast(needs), "rule").join(evidence, [key, "rule"])  # eight needs
    lacks = F.col("status") == "FAIL"
    severity = F.when(lacks, F.col("grave")).when(F.col("status").contains("Risk"), "warning").when(F.col("status") == "ADVISORY", "info").otherwise("success")
    gap = F.when(lacks, F.concat(F.lit("missing: "), "need")).otherwise("met")
    return j.select(key, "rule", "need", "status", gap.alias("gap"), severity.alias("severity"), "source", "page", "section", "line", "snippet", "confidence", F.coalesce("given", "own").alias("citation_verified"))


#: What a statement or a weather report on a late delivery names as force majeure (fixed values).
FORCE_MAJEURE = ("flood", "monsoon", "rain", "cyclone", "force majeure", "disaster", "landslide")


def settle_disputes(disputes: DataFrame, payments: DataFrame, words: tuple[str, ...] = FORCE_MAJEURE, waived: float = 75.0) -> DataFrame:
    """Rulings on disputed damages, and each order's payment after them.

    ``disputes`` (dispute_id, po_id, statement, weather, disputed_amount): ``waived`` per cent of the
    amount go back where the statement or the weather names one of the words, else nothing.
    ``payments`` (po_id, invoice_amount, tds_deduction, ld_deduction; one row per order): an
    order's disputes are settled in the order of their ids, each taking its refund off the
    damages left, which never fall below 0.  An order without a payment has null sums.
    """
    cents = lambda c: F.round(c.cast("decimal(38,9)"), 2).cast("double")
    told = F.lower(F.concat_ws(" ", F.coalesce("statement", F.lit("")), F.coalesce("weather", F.lit(""))))
    pct = F.when(X.flag(told, *words), F.lit(waived)).otherwise(F.lit(0.0))
    ruled = disputes.select("dispute_id", "po_id", "disputed_amount", pct.alias("refund_pct"))
    ruled = ruled.withColumn("refund", cents(F.col("refund_pct") / 100 * F.coalesce("disputed_amount", F.lit(0.0))))
    so_far = F.sum("refund").over(W.partitionBy("po_id").orderBy("dispute_id").rowsBetween(W.unboundedPreceding, 0))  # the disputes of one order
    paid = payments.select("po_id", "invoice_amount", "tds_deduction", "ld_deduction")
    j = ruled.withColumn("back", so_far).join(paid, "po_id", "left").withColumn("ld_left", F.greatest(F.lit(0.0), F.col("ld_deduction") - F.col("back")))
    j = j.withColumn("ld_left", F.when(F.col("ld_deduction").isNotNull(), F.col("ld_left")))
    return j.select("dispute_id", "po_id", "refund_pct", "refund", "ld_left", cents(F.col("invoice_amount") - F.col("tds_deduction") - F.col("ld_left")).alias("net_payable"))


#: Words that show a family of rules (fixed values).
ONTOLOGY = {
    "technical": ("specification", "standard", "iso", "technical", "api", "compliant", "parameter", "drawing"),
    "performance": ("experience", "purchase order", "completion", "delivered", "executed", "contract", "client", "work order"),
    "delivery": ("schedule", "timeline", "dispatch", "freight", "transport", "delivery", "lead time", "transit"),
    "quality": ("qms", "iso 9001", "quality assurance", "inspection", "testing", "certificate", "audit", "qc", "guarantee"),
    "financial": ("turnover", "revenue", "balance sheet", "audit", "profit", "net worth", "financial", "ca certificate", "chartered"),
}


def rule_words(name: str, description: str = "") -> tuple[str, ...]:
    """The words that a rule is looked for by: those of the families its name holds, else the longer words of name and description."""
    found = [w for family, words in ONTOLOGY.items() if family in name.lower() for w in words]
    return tuple(dict.fromkeys(found or [w.lower() for w in f"{description} {name}".split() if len(w) > 4]))


def ontology_check(docs: DataFrame, key: str, rules: list[tuple[str, str]], maf: Column, credentials: Column, annexure: Column) -> DataFrame:
    """Per key: rules (name, description) that some text of it shows, confidence, four scores and the verdict.

    A rule that is shown adds 15 to the confidence, one that is not takes 5; a submission with
    an authorization, credentials and an annexure is accepted.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    has = lambda words: F.max(low.rlike(E.any_of(words)).cast("int")) if words else F.lit(0)
    a = docs.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"), *[has(rule_words(*r)).alias(f"hit_{i}") for i, r in enumerate(rules)],
        *[F.max(c.cast("int")).alias(n) for n, c in (("maf", maf), ("credentials", credentials), ("annexure", annexure))],
    )
    hits = sum((F.col(f"hit_{i}") for i in range(len(rules))), F.lit(0))
    of = lambda *families: sum((F.col(f"hit_{i}") for i, (n, _) in enumerate(rules) if any(f in n.lower() for f in families)), F.lit(0))
    clamp = lambda c: F.least(F.lit(100), F.greatest(F.lit(0), c)).cast("int")
    confidence = 20 + 15 * F.col("maf") + 15 * F.col("credentials") + 10 * F.col("annexure") + 15 * hits - 5 * (len(rules) - hits)
    a = a.withColumn("hits", hits.cast("bigint")).withColumn("confidence", clamp(confidence))
    financial = 50 * of("financial", "turnover")
    c = F.col("confidence")
    return a.select(
        key, "files", "hits", "confidence", clamp(50 * F.col("credentials") + 25 * of("technical", "performance") + 8 * F.col("files") + F.floor(c / 3)).alias("technical"),
        F.when(financial > 0, clamp(financial + 65)).otherwise(20).cast("int").alias("financial"), clamp(40 * F.col("maf") + 20 * F.col("annexure") + 40 + F.floor(c / 4)).alias("compliance"),
        F.least(F.lit(100.0), F.greatest(F.lit(5.0), 100 + 15 * (len(rules) - hits) - F.floor(c / 1.5))).alias("risk"),
        F.when(F.col("maf") + F.col("credentials") + F.col("annexure") == 3, "Accepted").otherwise("Rejected").alias("status"),
    )
