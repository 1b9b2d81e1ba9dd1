"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import share, word_list
from ..functions.storage import partitions
from ..operators import extraction as E
from ..operators import rules as RULES
from ..operators import text as X
from .aggregates import r
from .registry import query
from .shared import WS


def quoted(text: str) -> str:
    return text.replace("'", "''")


def sql_first(pattern: str, column: str = "t", group: int = 1) -> str:
    """The group of the first match, or null."""
    return f"nullif(regexp_extract({column}, '{quoted(pattern)}', {group}), '')"


def sql_number(expr: str) -> str:
    return f"TRY_CAST(replace({expr}, ',', '') AS DOUBLE)"


def sql_any(words, column: str = "u") -> str:
    return f"regexp_matches({column}, '{quoted(E.any_of(words))}')"


def sql_contains(words, column: str = "t") -> str:
    return "(" + " OR ".join(f"contains({column}, '{quoted(w)}')" for w in words) + ")"


REDACTED = "text"
for _pattern, _mark in X.REDACTIONS:
    REDACTED = f"regexp_replace({REDACTED}, '{quoted(_pattern)}', '{_mark}', 'g')"


@query(f"SELECT doc_id, sha256({REDACTED}) AS redacted_hash FROM documents")
def redact_pii(t):
    return t.documents().select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("redacted_hash"))


@query(f"""
WITH w AS (SELECT doc_id, text, list_filter({WS}, lambda x: len(x) >= 3) AS w, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'))), lambda n: n > 0) AS s FROM documents)
SELECT doc_id, round(coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0), 6) AS ttr, round(coalesce(list_avg(s), 0), 6) AS mean_sentence, round(coalesce(list_var_samp(s), 0), 5) AS var_sentence, round(coalesce(1000.0 * (len(text) - len(replace(text, ',', ''))) / nullif(len(text), 0), 0), 6) AS commas, round(coalesce(1000.0 * (len(text) - len(replace(text, '.', ''))) / nullif(len(text), 0), 0), 6) AS periods FROM w""")
def stylometric_fingerprint(t):
    s = X.stylometry(t.documents())
    return s.select("doc_id", r("ttr").alias("ttr"), r("mean_sentence").alias("mean_sentence"), r("var_sentence", 5).alias("var_sentence"), r("commas").alias("commas"), r("periods").alias("periods"))


_NAMED = f"regexp_matches(t, '(?i){quoted(E.TURNOVER)}')"
_VALUE = f"CASE WHEN {_NAMED} THEN {sql_number(sql_first('(?i)' + E.TURNOVER))} ELSE {sql_number(sql_first('(?i)' + E.TURNOVER_WITH_UNIT))} END"
_AROUND = " ".join([
    f"lower(CASE WHEN {_NAMED} THEN regexp_extract(t, '(?i)[\\s\\S]{{0,10}}{quoted(E.TURNOVER)}[\\s\\S]{{0,20}}', 0)",
    f"ELSE regexp_extract(t, '(?i)[\\s\\S]{{0,10}}{quoted(E.TURNOVER_WITH_UNIT)}[\\s\\S]{{0,20}}', 0) END)",
])
_CERTIFICATES = ", ".join(f"CASE WHEN contains(u, '{c}') THEN '{c}' END" for c in E.PROFILE_CERTIFICATES)


@query(f"""
WITH d AS (SELECT doc_id, text AS t, upper(text) AS u FROM documents),
v AS (SELECT *, {_VALUE} AS value, {_AROUND} AS around FROM d),
c AS (SELECT *, round(CASE WHEN contains(around, 'lakh') THEN value / 100 WHEN contains(around, 'million') THEN value / 10 ELSE value END, 2) AS turnover_crore FROM v)
SELECT doc_id, {sql_first(E.GSTIN)} AS gstin, {sql_first(E.PAN)} AS pan, {sql_first(E.GEM_NUMBER)} AS gem_number,
  {sql_any(("MSME", "UDYAM"))} AS msme,
  CASE WHEN {sql_any(("MSME", "UDYAM"))} THEN CASE WHEN contains(u, 'MICRO') THEN 'Micro' WHEN contains(u, 'SMALL') THEN 'Small' WHEN contains(u, 'MEDIUM') THEN 'Medium' END END AS msme_category,
  {sql_any(("MAKE IN INDIA", "MAKE-IN-INDIA"))} AS make_in_india,
  array_to_string(list_filter([{_CERTIFICATES}], lambda x: x IS NOT NULL), ',') AS certifications, turnover_crore,
  CASE WHEN turnover_crore > 10 THEN 'Good' WHEN turnover_crore > 2 THEN 'Moderate' WHEN turnover_crore IS NOT NULL THEN 'Poor' END AS health FROM c""")
def vendor_profile_extract(t):
    d = t.documents().select("doc_id", "text")
    p = d.repartition(partitions(d), "doc_id").select("doc_id", E.vendor_profile(F.col("text")).alias("p"))  # a file of few row groups is read by few tasks
    return p.select("doc_id", "p.gstin", "p.pan", "p.gem_number", "p.msme", "p.msme_category", "p.make_in_india", F.array_join("p.certifications", ",").alias("certifications"), "p.turnover_crore", "p.health")


_RULES = " UNION ALL ".join([
    f"SELECT doc_id, 'Minimum Experience' AS criteria_name, 'Experience' AS criterion_type, true AS is_mandatory, TRY_CAST({sql_first(E.EXPERIENCE_RULE)} AS INT) AS years, NULL AS turnover_cr FROM d WHERE regexp_matches(t, '{quoted(E.EXPERIENCE_RULE)}')",
    f"SELECT doc_id, 'Minimum Annual Turnover', 'Financial', true, NULL, TRY_CAST({sql_first(E.TURNOVER_RULE)} AS DOUBLE) FROM d WHERE regexp_matches(t, '{quoted(E.TURNOVER_RULE)}')",
    *[f"SELECT doc_id, '{c} Certification', 'Certification', regexp_matches(u, 'MANDATORY|ESSENTIAL'), NULL, NULL FROM d WHERE contains(u, '{c}')" for c in E.RULE_CERTIFICATES],
])


@query(f"WITH d AS (SELECT doc_id, text AS t, upper(text) AS u FROM documents) {_RULES}")
def tender_rule_extract(t):
    rules = t.documents().select("doc_id", F.explode(E.tender_rules(F.col("text"))).alias("r"))
    return rules.select("doc_id", "r.criteria_name", "r.criterion_type", "r.is_mandatory", F.col("r.min_years_experience").alias("years"), F.col("r.min_turnover_cr").alias("turnover_cr"))


def sql_typed(pattern: str, kind: str, column: str = "t") -> str:
    found = sql_first(pattern, column)
    if kind == "string":
        return f"coalesce(trim({found}), '')"
    return f"coalesce({sql_number(found)}, 0)" if kind == "double" else f"coalesce(TRY_CAST({found} AS INT), 0)"


_FIELDS = ", ".join([
    *[f"{sql_typed(p, k)} AS {n}" for n, p, k in E.THRESHOLDS if n != "turnover_lakhs"],
    *[f"{sql_typed(p, k, 'b')} AS {n}" for n, p, k in E.THRESHOLDS_B],
    f"CASE WHEN regexp_matches(t, '{quoted(E.NOT_APPLICABLE)}') THEN 0 ELSE {next(sql_typed(p, k) for n, p, k in E.THRESHOLDS if n == 'turnover_lakhs')} END AS turnover_lakhs",
    f"NOT regexp_matches(t, '{quoted(E.NO_RELAXATION)}') AS relaxation_applicable",
    f"coalesce({sql_first(E.TENDER_REFERENCE)}, '') AS tender_ref_no",
    *[f"len(list_filter(list_transform(string_split_regex(coalesce({sql_first(E.SYSTEMS, c)}, ''), '[/,]'), lambda x: trim(x)), lambda x: x <> '')) AS {n}" for c, n in (("t", "a_os_options"), ("b", "b_os_options"))],
])


@query(f"WITH d AS (SELECT doc_id, text AS t, regexp_extract(text, '{quoted(E.SECTION_B)}', 1) AS b FROM documents) SELECT doc_id, {_FIELDS} FROM d")
def threshold_parse(t):
    x = t.documents().select("doc_id", E.thresholds(F.col("text")).alias("x"))
    plain = [f"x.{n}" for n, *_ in (*E.THRESHOLDS, *E.THRESHOLDS_B)]
    return x.select("doc_id", *plain, "x.relaxation_applicable", "x.tender_ref_no", *[F.size(f"x.{c}").cast("bigint").alias(c) for c in ("a_os_options", "b_os_options")])


_PLAIN = lambda pattern, low, high, extra="": f"SELECT doc_id, i, near, round(v / 100000.0, 2) AS v FROM (SELECT doc_id, i, near, {sql_number('n')} AS v FROM (SELECT doc_id, i, near, unnest(regexp_extract_all(t, '{quoted(pattern)}', 1)) AS n FROM good {extra})) WHERE v BETWEEN {low} AND {high}"
#: (doc_id, i, near, v): amounts of each line in lakhs, and whether an order is near.
MONEY = f"""
lines AS (SELECT doc_id, i, ls[i] AS t, upper(ls[i]) AS u, array_to_string(ls[i:i + 2], chr(10)) AS nx, len(list_filter(ls[greatest(i - 2, 1):i + 2], lambda x: {sql_any(E.ORDER_MARKS, 'upper(x)')})) > 0 AS near
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) x(i)),
good AS (SELECT * FROM lines WHERE NOT {sql_any(E.BOILERPLATE)}),
units AS (SELECT doc_id, i, near, unnest(regexp_extract_all(t, '{E.UNIT_AMOUNT}', 1)) AS n, unnest(regexp_extract_all(t, '{E.UNIT_AMOUNT}', 2)) AS k FROM good),
totals AS (SELECT doc_id, i, near, {sql_number(sql_first(E.TOTAL_AMOUNT, 'nx'))} AS v FROM good),
vals AS (
  SELECT doc_id, i, near, round(v, 2) AS v FROM (SELECT doc_id, i, near, {sql_number('n')} * CASE WHEN starts_with(lower(k), 'cr') THEN 100.0 ELSE 1.0 END AS v FROM units) WHERE v BETWEEN 0.5 AND 500
  UNION ALL {_PLAIN(E.PREFIX_AMOUNT, 50_000, 50_000_000, f"WHERE NOT {sql_any(E.DEPOSITS)}")}
  UNION ALL {_PLAIN(E.SUFFIX_AMOUNT, 100_000, 50_000_000)}
  UNION ALL SELECT doc_id, i, near, round(CASE WHEN v >= 100000 THEN v / 100000.0 WHEN v BETWEEN 1 AND 500 THEN v END, 2) FROM totals WHERE v >= 100000 OR v BETWEEN 1 AND 500),
steps AS (SELECT doc_id, near, list_transform(list_reverse_sort(list_distinct(list(v))), lambda x: [x]) AS vs FROM (SELECT doc_id, false AS near, v FROM vals UNION ALL SELECT doc_id, true, v FROM vals WHERE near) GROUP BY 1, 2),
money AS (SELECT doc_id, near, list_reduce(vs, lambda a, x: CASE WHEN a[-1] - x[1] > 0.5 THEN list_concat(a, x) ELSE a END) AS vs FROM steps)"""


@query(f"""
WITH {MONEY.strip()} SELECT d.doc_id, coalesce(len(a.vs), 0) AS amounts, coalesce(list_sum(a.vs), 0) AS lakhs, coalesce(len(o.vs), 0) AS order_amounts
FROM documents d LEFT JOIN money a ON a.doc_id = d.doc_id AND NOT a.near LEFT JOIN money o ON o.doc_id = d.doc_id AND o.near""")
def monetary_values(t):
    m = t.documents().select("doc_id", E.monetary_values(F.col("text")).alias("a"), E.monetary_values(F.col("text"), True).alias("o"))
    total = F.aggregate("a", F.lit(0.0), lambda x, y: x + y)
    return m.select("doc_id", F.size("a").cast("bigint").alias("amounts"), total.alias("lakhs"), F.size("o").cast("bigint").alias("order_amounts"))


_RISK = " + ".join(f"{k} * least(3, (len(t) - len(replace(t, '{w}', ''))) // {len(w)})" for w, k in X.RISK_WORDS.items())


@query(f"WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT doc_id, least(100, {_RISK})::DOUBLE AS risk, ({' + '.join(f'contains(t, {chr(39)}{w}{chr(39)})::INT' for w in X.RISK_WORDS)})::BIGINT AS keywords FROM d")
def risk_keywords(t):
    score, found = X.keyword_score(F.col("text"))
    return t.documents().select("doc_id", score.alias("risk"), F.size(found).cast("bigint").alias("keywords"))


def sql_esg() -> str:
    groups = []
    for most, terms in X.ESG:
        shown = {what: (points, [x for x, w, _ in terms if w == what]) for _, what, points in terms}
        groups.append(f"least({most}, " + " + ".join(f"{points} * {sql_contains(words)}::INT" for points, words in shown.values()) + ")")
    total = " + ".join(groups)
    return f"CASE WHEN len(trim(t)) < 10 THEN 0 WHEN {total} = 0 THEN 15 ELSE {total} END::INT"


@query(f"SELECT doc_id, {sql_esg()} AS esg FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def esg_score(t):
    return t.documents().select("doc_id", X.esg_points(F.col("text")).alias("esg"))


@query(f"WITH e AS (SELECT vendor_id, {sql_esg()} AS esg FROM (SELECT vendor_id, lower(text) AS t FROM bid_documents)) SELECT vendor_id, round(avg(esg), 6) AS esg FROM e GROUP BY 1")
def composite_esg(t):
    return t.documents().groupBy("vendor_id").agg(r(F.avg(X.esg_points(F.col("text")))).alias("esg"))


_MET = " + ".join(f"{sql_contains(ws)}::INT" for _, ws in X.CLAUSES)
_FLAGS = f"{sql_contains(('single bid', 'single vendor'))}::INT + ({sql_contains(('nomination',))} AND NOT {sql_contains(('proprietary',))})::INT + ({sql_contains(('advance payment',))} AND NOT {sql_contains(('bank guarantee',))})::INT"


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS t, coalesce(msme, false) AS msme FROM bid_documents LEFT JOIN vendors USING (vendor_id)),
m AS (SELECT doc_id, msme, {_MET} AS met, {_FLAGS} AS flags FROM d), p AS (SELECT *, round(100.0 * met / 8, 1) AS pct FROM m)
SELECT doc_id, met, pct, CASE WHEN pct >= 90 THEN 'FULLY COMPLIANT' WHEN pct >= 70 THEN 'MOSTLY COMPLIANT' WHEN pct >= 50 THEN 'PARTIALLY COMPLIANT' ELSE 'NON-COMPLIANT' END AS status,
  8 - met AS missing, flags, CASE WHEN msme THEN 2 ELSE 0 END AS waivers FROM p""")
def clause_compliance(t):
    """Clauses of each document; the vendors of the given tables have no turnover, so that waiver is not given."""
    d = t.documents().join(t.vendors().select("vendor_id", "msme"), "vendor_id", "left")
    c = d.select("doc_id", X.clause_compliance(F.col("text"), F.coalesce("msme", F.lit(False)), F.lit(0.0)).alias("c"))
    return c.select("doc_id", "c.met", "c.pct", "c.status", *[F.size(f"c.{x}").alias(x) for x in ("missing", "flags", "waivers")])


_CLASS = "CASE " + " ".join(f"WHEN {sql_contains(names, 'n')} OR {sql_contains(words, 'u')} THEN '{label}'" for label, names, words in X.DOCUMENT_CLASSES) + f" ELSE '{X.OTHER_CLASS}' END"
_COARSE = "CASE " + " ".join(f"WHEN {sql_contains(names, 'n')} THEN '{label}'" for label, names in X.COARSE) + " ELSE 'general' END"


@query(f"SELECT doc_id, {_CLASS} AS kind, {_COARSE} AS coarse, {' OR '.join(sql_contains(x, c) for x, c in zip(X.DOCUMENT_FLAGS['bid_bond'], 'nu', strict=True))} OR starts_with(n, 'BG') AS bid_bond, {sql_contains(X.DOCUMENT_FLAGS['maf'][0], 'n')} OR (({sql_contains(X.DOCUMENT_FLAGS['maf'][1], 'u')}) AND ({sql_contains(X.MAKERS, 'u')})) AS maf FROM (SELECT doc_id, upper(source) AS n, upper(text) AS u FROM documents)")
def document_classify(t):
    """Classes by file name (here: the source), then by text."""
    name, text = F.col("source"), F.col("text")
    return t.documents().select("doc_id", X.document_class(name, text).alias("kind"), X.coarse_class(name).alias("coarse"), X.document_flags(name, text)["bid_bond"].alias("bid_bond"), X.document_flags(name, text)["maf"].alias("maf"))


_RUNS = " + ".join(f"(len(t) - len(replace(t, '{g}', ''))) // {len(g)}" for g in X.GARBAGE)


@query(f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, len(t)::DOUBLE AS n, list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '') AS ws, len(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS plain,
  {_RUNS} AS runs, len(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) AS alien, len(regexp_replace(t, '[^\\x{{0900}}-\\x{{097F}}]', '', 'g')) AS deva FROM d),
s AS (SELECT *, greatest(len(ws), 1) AS k, CASE WHEN runs > 5 THEN least(0.02 * runs, 0.3) ELSE 0 END + CASE WHEN alien > 0.3 * n AND deva < 0.5 * alien THEN 0.15 ELSE 0 END AS penalty FROM w)
SELECT doc_id, round(CASE WHEN n = 0 THEN 0 WHEN n < 10 THEN 0.05
  ELSE greatest(0, least(1, 0.3 * plain / n + 0.2 * CASE WHEN n / k BETWEEN 3 AND 12 THEN 1.0 ELSE 0.5 END + 0.2 * len(list_distinct(ws)) / k + 0.3 * least(n / 500, 1.0) - penalty)) END, 6) AS quality FROM s""")
def text_quality(t):
    return t.documents().select("doc_id", r(X.text_quality(F.col("text"))).alias("quality"))


SENTENCES = r"""
parts AS (SELECT {key}, pos - 1 AS pos, trim(p[pos]) AS s FROM (SELECT {key}, string_split_regex(text, '[.!?\n]+') AS p FROM {table}), unnest(range(1, len(p) + 1)) u(pos)),
sentences AS (SELECT * FROM parts WHERE s <> '')"""


@query(f"""
WITH {SENTENCES.strip().format(key="doc_id", table="documents")}, w AS (SELECT doc_id, pos, unnest({WS.replace("text", "s")}) AS w FROM sentences), tf AS (SELECT doc_id, w, count(*) AS tf FROM w GROUP BY 1, 2),
best AS (SELECT doc_id, pos, avg(tf) AS score FROM w JOIN tf USING (doc_id, w) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY avg(tf) DESC, pos) <= 3)
SELECT doc_id, string_agg(s, '. ' ORDER BY pos) AS summary FROM best JOIN sentences USING (doc_id, pos) GROUP BY 1""")
def extractive_summary(t):
    return X.summarize(t.documents())


QUERY = "licensed under the apache license"


@query(f"""
WITH tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({WS}) AS w FROM documents) GROUP BY 1, 2), q(w) AS (VALUES ('licensed'), ('under'), ('the'), ('apache'), ('license')),
c AS (SELECT doc_id, sum(CASE WHEN w IN (SELECT w FROM q) THEN tf ELSE 0 END) / (sqrt(sum(tf * tf)) * sqrt(5)) AS cosine FROM tf GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, cosine + 0.5 * contains(lower(text), '{QUERY}')::INT AS score FROM c JOIN documents USING (doc_id)) WHERE score > 0.02 ORDER BY round(score, 9) DESC, doc_id LIMIT 10""")
def bow_cosine_search(t):
    return X.bow_search(t.documents(), QUERY).select("doc_id", r("score").alias("score"))


#: Classes of equal texts of a type, and the index of all pairs of classes that share a shingle.
SHINGLES = f"""
cls AS (SELECT doc_id, doc_type, vendor_id, min(doc_id) OVER (PARTITION BY doc_type, sha256(coalesce(text, ''))) AS class_id FROM bid_documents),
own AS (SELECT class_id, min(vendor_id) AS lo, max(vendor_id) AS hi, count(*) AS copies FROM cls GROUP BY 1),
ws AS (SELECT doc_id, doc_type, {WS} AS w FROM bid_documents SEMI JOIN own ON doc_id = class_id),
sh AS (SELECT DISTINCT doc_id, doc_type, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM ws, unnest(range(1, len(w) - 1)) u(i) WHERE len(w) >= 3),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_type = b.doc_type AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b, shared / (x.n + y.n - shared) AS jaccard, p.copies AS a_copies, q.copies AS b_copies
  FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b JOIN own p ON p.class_id = a JOIN own q ON q.class_id = b
  WHERE shared / (x.n + y.n - shared) > 0.35 AND NOT (p.lo = p.hi AND q.lo = q.hi AND p.lo = q.lo)),
links AS (SELECT * FROM near UNION ALL SELECT class_id, class_id, 1.0, copies, copies FROM own WHERE lo <> hi)"""


def copied(t):
    return X.plagiarism(t.documents(), "doc_id", "doc_type", "vendor_id", 0.35)


@query(f"WITH {SHINGLES.strip()} SELECT a, b, round(jaccard, 6) AS jaccard, CASE WHEN jaccard > 0.7 THEN 'COPY' ELSE 'SUSPICIOUS' END AS verdict, a_copies, b_copies FROM links")
def plagiarism_pairs(t):
    """Pairs of text classes of a type that different vendors hold (a = b: one text held by several); plagiarism_members names the documents of a class."""
    pairs, _ = copied(t)
    verdict = F.when(F.col("jaccard") > 0.7, "COPY").otherwise("SUSPICIOUS").alias("verdict")
    return pairs.select("a", "b", r("jaccard").alias("jaccard"), verdict, F.col("na").alias("a_copies"), F.col("nb").alias("b_copies"))


@query(f"""
WITH {SHINGLES.strip()}, ends AS (SELECT a AS class_id FROM links UNION ALL SELECT b FROM links WHERE a <> b)
SELECT doc_id, vendor_id, class_id, (SELECT count(*) FROM ends e WHERE e.class_id = cls.class_id) AS links FROM cls""")
def plagiarism_members(t):
    _, members = copied(t)
    return members.select("doc_id", "vendor_id", "class_id", "links")


_GRAMS = "SELECT DISTINCT {key}, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM ({rows}), unnest(range(1, len(w) - 1)) u(i) WHERE len(w) >= 3"


@query(f"""
WITH {SENTENCES.strip().format(key="item_id", table="benchmark")},
q AS ({_GRAMS.format(key="item_id, pos", rows=f"SELECT item_id, pos, {WS.replace('text', 's')} AS w FROM sentences WHERE len(s) >= 20")}), d AS ({_GRAMS.format(key="doc_id", rows=f"SELECT doc_id, {WS} AS w FROM documents")}),
n AS (SELECT item_id, pos, count(*) AS n FROM q GROUP BY 1, 2), hits AS (SELECT item_id, pos, doc_id AS other, count(*) AS k FROM q JOIN d USING (g) GROUP BY 1, 2, 3)
SELECT item_id, other, pos, round(k / n, 6) AS share FROM hits JOIN n USING (item_id, pos) WHERE k >= 0.4 * n QUALIFY row_number() OVER (PARTITION BY item_id, other ORDER BY pos) <= 5""")
def matching_phrases(t):
    """Sentences of a benchmark item's text of which another document holds at least 40 % of the trigrams; first five of each pair."""
    s = X.sentences(t.raw("benchmark").select(F.col("item_id").alias("doc_id"), "text")).filter(F.char_length("sentence") >= 20)
    grams = X.shingles(s.select(F.struct("doc_id", "pos").alias("k"), F.col("sentence").alias("text")), "k")
    n = grams.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hits = grams.join(X.shingles(t.documents(), "doc_id").withColumnRenamed("doc_id", "other"), "shingle").groupBy("k", "other").agg(F.count(F.lit(1)).alias("shared"))
    good = hits.join(n, "k").filter(F.col("shared") >= 0.4 * F.col("n"))
    first = F.row_number().over(W.partitionBy("k.doc_id", "other").orderBy("k.pos"))
    return good.withColumn("turn", first).filter("turn <= 5").select(F.col("k.doc_id").alias("item_id"), "other", F.col("k.pos").alias("pos"), F.round(F.col("shared") / F.col("n"), 6).alias("share"))


def sql_chunk_end(size: int = 500) -> str:
    """The end of the chunk that begins at ``pos``: after the strongest separator of its second half, if there is one."""
    first, last = f"pos + {size // 2}", f"least(n, pos + {size})"
    half = f"substr(t, {first} + 1, {last} - ({first}))"
    seps = ["chr(10) || chr(10)", "chr(10)", "'. '", "' '"]
    found = " ".join(f"WHEN contains({half}, {x}) THEN {first} + len({half}) - position(reverse({x}) IN reverse({half})) + 1" for x in seps)
    return f"CASE WHEN {last} = n THEN n {found} ELSE {last} END"


@query(f"""
WITH c(doc_id, t, n, k, a, b) AS (
  SELECT doc_id, t, n, 0, 0, {sql_chunk_end()} FROM (SELECT doc_id, text AS t, len(text) AS n, 0 AS pos FROM documents WHERE len(text) > 0)
  UNION ALL SELECT doc_id, t, n, k + 1, pos, {sql_chunk_end()} FROM (SELECT doc_id, t, n, k, greatest(b - 50, a + 1) AS pos FROM c WHERE b < n))
SELECT doc_id, k AS chunk_index, max(k) OVER (PARTITION BY doc_id) + 1 AS total, a AS start, sha256(substr(t, a + 1, b - a)) AS content_hash FROM c""", recursive=True)
def chunk_text(t):
    return X.chunks(t.documents()).select("doc_id", "chunk_index", "total", "start", "content_hash")


@query(f"""
WITH c AS (SELECT doc_id, len(list_filter({WS}, lambda x: x IN ('licensed', 'license', 'version', 'work'))) AS hits, len(regexp_extract_all(text, '[0-9]+')) AS numbers, len(text) AS n FROM documents)
SELECT doc_id, least(100, 20 * hits + 5 * least(numbers, 8))::INT AS score, round(0.5 * least(1, hits / 4) + 0.3 * least(1, numbers / 8) + 0.2 * least(1, n / 2000), 6) AS confidence FROM c""")
def criterion_score(t, words=("licensed", "license", "version", "work")):
    hits = F.size(F.filter(word_list(F.col("text")), lambda w: w.isin(*words)))
    c = t.documents().select("doc_id", hits.alias("hits"), F.regexp_count("text", F.lit("[0-9]+")).alias("numbers"), F.char_length("text").alias("n"))
    one = lambda c, k: F.least(F.lit(1.0), F.col(c) / k)
    return c.select("doc_id", F.least(F.lit(100), 20 * F.col("hits") + 5 * F.least("numbers", F.lit(8))).cast("int").alias("score"), r(0.5 * one("hits", 4) + 0.3 * one("numbers", 8) + 0.2 * one("n", 2000)).alias("confidence"))


@query(f"""
WITH cl AS (SELECT item_id, trim(unnest(string_split_regex(text, '[;.\\n]'))) AS clause FROM benchmark), k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY clause) AS n, list_distinct(list_filter(regexp_extract_all(lower(clause), '[\\p{{L}}\\p{{N}}_]+'), lambda x: len(x) >= 4)) AS need FROM (SELECT DISTINCT item_id, clause FROM cl WHERE len(clause) > 15)),
v AS (SELECT vendor_id, list_distinct(flatten(list({WS}))) AS have FROM bid_documents GROUP BY 1), x AS (SELECT item_id, n, vendor_id, 100.0 * len(list_intersect(need, have)) / len(need) AS pct FROM k, v WHERE len(need) > 0)
SELECT item_id, vendor_id, count(*) AS clauses, count(*) FILTER (pct >= 70) AS covered, count(*) FILTER (pct >= 40 AND pct < 70) AS partial, round(avg(pct), 6) AS mean_pct,
  CASE WHEN avg(pct) >= 85 THEN 'COMPLIANT' WHEN avg(pct) >= 60 THEN 'PARTIAL' ELSE 'GAPS' END AS status FROM x GROUP BY 1, 2 HAVING sum(pct) > 0""")
def sow_clause_coverage(t):
    """Items and vendors that share a word of four letters and more; other pairs cover nothing."""
    cl = t.raw("benchmark").select("item_id", F.explode(F.split("text", r"[;.\n]")).alias("c")).select("item_id", F.trim("c").alias("clause")).filter(F.char_length("clause") > 15).distinct()
    need = cl.select("item_id", "clause", F.explode(F.array_distinct(F.filter(word_list(F.col("clause")), lambda w: F.char_length(w) >= 4))).alias("w"))
    sizes = need.groupBy("item_id", "clause").agg(F.count(F.lit(1)).alias("n"))
    have = t.documents().select("vendor_id", F.explode(F.array_distinct(word_list(F.col("text")))).alias("w")).distinct()
    hits = need.join(have, "w").groupBy("item_id", "clause", "vendor_id").agg(F.count(F.lit(1)).alias("k"))
    per = hits.join(sizes, ["item_id", "clause"]).withColumn("pct", share(F.col("k"), F.col("n")))
    whole = sizes.groupBy("item_id").agg(F.count(F.lit(1)).alias("clauses"))  # clauses without a hit count by their number
    a = per.groupBy("item_id", "vendor_id").agg(F.count_if(F.col("pct") >= 70).alias("covered"), F.count_if((F.col("pct") >= 40) & (F.col("pct") < 70)).alias("partial"), F.sum("pct").alias("s"))
    a = a.join(whole, "item_id").withColumn("m", F.col("s") / F.col("clauses"))
    return a.select("item_id", "vendor_id", "clauses", "covered", "partial", r("m").alias("mean_pct"), F.when(F.col("m") >= 85, "COMPLIANT").when(F.col("m") >= 60, "PARTIAL").otherwise("GAPS").alias("status"))


PROOF_WORDS = ("license", "licensed", "version")
_WORD = r"\b(?:license|licensed|version)\b"


@query(rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
a AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i){_WORD}')), true) AS pos FROM d),
s AS (SELECT doc_id, pos, regexp_replace(array_to_string(ls[greatest(1, pos - 2):pos + 2], chr(10)), '^\s+|\s+$', '', 'g') AS s FROM a)
SELECT doc_id, CASE WHEN pos > 0 THEN pos - 1 END AS line, CASE WHEN pos > 0 THEN CASE WHEN len(s) > 400 THEN substr(s, 1, 397) || '...' ELSE s END END AS snippet,
  CASE WHEN coalesce(pos, 0) = 0 THEN 'low' WHEN regexp_matches(s, '(?i){_WORD}[\s\S]{{0,50}}{RULES.MONEY}|{RULES.MONEY}[\s\S]{{0,50}}{_WORD}') THEN 'high' ELSE 'medium' END AS confidence FROM s""")
def evidence_snippet(t):
    e = RULES.evidence_of(F.col("text"), PROOF_WORDS)
    return t.documents().select("doc_id", e.alias("e")).select("doc_id", "e.*")


def quotes(t):
    return t.raw("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("quote"))


_LINE_WORDS = WS.replace("text", "t")
#: A line that heads a section, without the possessive repeats that DuckDB doesn't know.
SQL_HEADING = r"^([0-9]+(\.[0-9]+)*\.?\s+\S|[A-Z][A-Z ]{5,}$)"


@query(rf"""
WITH l AS (SELECT doc_id, i - 1 AS line, ls[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
m AS (SELECT *, coalesce(last_value(nullif(regexp_extract(t, '--- Page ([0-9]+) ---', 1), '')::INT IGNORE NULLS) OVER w, 1) AS page,
  last_value(CASE WHEN regexp_matches(t, '^([0-9]+(\.[0-9]+)*\.?\s+\S|[A-Z][A-Z ]{{5,}}$)') THEN t END IGNORE NULLS) OVER w AS section
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT item_id AS id, text AS quote, unnest(list_distinct({WS})) AS w FROM benchmark), n AS (SELECT id, quote, count(*) AS n FROM q GROUP BY 1, 2),
lw AS (SELECT DISTINCT doc_id, line, unnest({_LINE_WORDS}) AS w FROM l), o AS (SELECT id, doc_id, line, count(*) AS shared FROM q JOIN lw USING (w) GROUP BY 1, 2, 3)
SELECT id, doc_id, page, line, section, contains(lower(t), lower(quote)) AS exact, round(shared / n, 6) AS overlap FROM o JOIN n USING (id) JOIN m USING (doc_id, line) WHERE shared >= least(3, n) AND shared >= 0.4 * n
QUALIFY row_number() OVER (PARTITION BY id ORDER BY contains(lower(t), lower(quote)) DESC, shared / n DESC, doc_id, line) = 1""")
def evidence_locator(t):
    return X.locate(quotes(t), t.documents()).withColumn("overlap", F.round("overlap", 6))


@query("""
WITH s AS (SELECT doc_id, pos - 1 AS pos, lower(trim(p[pos])) AS low FROM (SELECT doc_id, string_split_regex(text, '[.!?\\n]+') AS p FROM documents), unnest(range(1, len(p) + 1)) u(pos)), h AS (SELECT doc_id, pos, low, len(list_intersect(regexp_extract_all(low, '[\\p{L}\\p{N}_]+'), ['apache', 'license', 'licensed', 'the', 'under'])) / 5 AS hits FROM s WHERE low <> '')
SELECT doc_id, pos, (CASE WHEN contains(low, 'licensed under the apache license') THEN 98 ELSE floor(90 * hits) END)::INT AS score FROM h WHERE contains(low, 'licensed under the apache license') OR hits >= 0.6""")
def clause_search(t):
    return X.clause_search(t.documents(), QUERY)


def sql_normal(column: str) -> str:
    return f"trim(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


CITED = f"""
q AS (SELECT item_id AS id, {sql_normal("text")} AS q, lower(trim(text)) AS low FROM benchmark), d AS (SELECT doc_id, {sql_normal("text")} AS t FROM documents),
hit AS (SELECT id, min(doc_id) AS found_in FROM q JOIN d ON q <> '' AND contains(' ' || t || ' ', ' ' || q || ' ') GROUP BY 1),
cited AS (SELECT id, found_in, length(low) AS size, CASE WHEN low IN ({", ".join(f"'{x}'" for x in X.PLACEHOLDERS)}) THEN 'placeholder' WHEN found_in IS NOT NULL THEN 'verbatim'
  WHEN {sql_contains(X.POLICIES, "low")} AND {sql_contains(X.POLICY_PARTS, "low")} THEN 'policy' END AS match FROM q LEFT JOIN hit USING (id))"""


@query(f"WITH {CITED.strip()} SELECT id, CASE WHEN match IS NULL THEN 'HALLUCINATION_DETECTED' ELSE 'VERIFIED' END AS verdict, match, found_in FROM cited")
def citation_guard(t):
    return X.citation_guard(quotes(t), t.documents())


@query("""
SELECT doc_id, greatest(20, 100 - 30 * (len(text) < 300)::INT - 20 * (NOT regexp_matches(text, '[0-9]{12}'))::INT - 25 * contains(lower(text), 'draft')::INT - 15 * (NOT contains(text, '@'))::INT)::INT AS authenticity, len(text) < 300 AS small FROM documents""")
def document_forensic_flags(t):
    x = F.col("text")
    small = F.char_length(x) < 300
    score = 100 - 30 * small.cast("int") - 20 * (~x.rlike("[0-9]{12}")).cast("int") - 25 * X.flag(F.lower(x), "draft").cast("int") - 15 * (~F.contains(x, F.lit("@"))).cast("int")
    return t.documents().select("doc_id", F.greatest(F.lit(20), score).cast("int").alias("authenticity"), small.alias("small"))


@query("SELECT po_id, strftime(created_at, '%d/%m/%Y') AS day, datediff('day', created_at, TIMESTAMP '1999-01-01') AS age FROM purchase_orders")
def date_functions(t):
    text = F.when(F.col("po_id") % 2 == 0, F.date_format("created_at", "yyyy-MM-dd")).otherwise(F.date_format("created_at", "dd/MM/yyyy"))
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))
    return t.purchase_orders().select("po_id", F.date_format(parsed, "dd/MM/yyyy").alias("day"), F.datediff(F.lit("1999-01-01").cast("date"), parsed).cast("bigint").alias("age"))


@query("""
WITH e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@([a-z0-9.-]+)', 1))) AS domain FROM documents), i AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '([0-9]+\\.[0-9]+\\.[0-9]+)\\.[0-9]+', 1))) AS net FROM documents)
SELECT doc_id, 'domain' AS kind, domain AS key FROM e WHERE domain NOT IN ('gmail.com', 'yahoo.com', 'outlook.com') UNION ALL SELECT doc_id, 'subnet', net FROM i""")
def contact_keys(t, public=("gmail.com", "yahoo.com", "outlook.com")):
    d = t.documents()
    e = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9._%+-]+@([a-z0-9.-]+)"), F.lit(1)))).alias("key")).filter(~F.col("key").isin(*public))
    i = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]+\.[0-9]+\.[0-9]+)\.[0-9]+"), F.lit(1)))).alias("key"))
    return e.select("doc_id", F.lit("domain").alias("kind"), "key").unionByName(i.select("doc_id", F.lit("subnet").alias("kind"), "key"))


@query(f"""
WITH q AS (SELECT DISTINCT item_id, unnest({WS}) AS w FROM benchmark WHERE item_id % 100 = 0), d AS (SELECT DISTINCT doc_id, unnest({WS}) AS w FROM documents),
nq AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), nd AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), s AS (SELECT item_id, doc_id, count(*) AS k FROM q JOIN d USING (w) GROUP BY 1, 2)
SELECT doc_id, item_id, round(k / (nq.n + nd.n - k), 6) AS jaccard FROM s JOIN nq USING (item_id) JOIN nd USING (doc_id)""")
def word_jaccard(t):
    """Every hundredth item as a query against all documents, by the words they share."""
    queries = t.raw("benchmark").filter("item_id % 100 = 0").select("item_id", "text")
    return X.word_overlap(queries, t.documents(), "item_id", "doc_id").select("doc_id", "item_id", r("jaccard").alias("jaccard"))
