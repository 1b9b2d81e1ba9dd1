"""The thin contract queries of the numbered operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .centroids import clusters
from .common import SPACES, table
from .exact_dedup import exact_groups
from .hard_negatives import hard_negatives
from .hilbert import sharded
from .jaccard_join import jaccard_join
from .licenses import TEMPLATES, TERM, THRESHOLD, document_files, license_scan
from .line_rules import BOILERPLATE, ENDING, NAVIGATION, SYMBOLS, line_rules
from .mixing import mixed
from .packing import packed
from .pii import KINDS, find_pii
from .quality_knn import quality
from .simhash import near_groups
from .toxicity import toxicity

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_exact_dedup(spark, sf_dir):
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op6_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op10_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))


@query
def op1_license_scan(spark, sf_dir):
    scanned = license_scan(document_files(table(spark, sf_dir, "documents")))
    return scanned.withColumnRenamed("file_id", "doc_id")


@query
def op2_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_hilbert_shards(spark, sf_dir):
    return sharded(table(spark, sf_dir, "documents"))


@query
def op4_source_mix(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).drop("check")


def is_kind(kind):
    return lambda k: k == kind


@query
def op5_pii(spark, sf_dir):
    found = find_pii(table(spark, sf_dir, "documents"))
    number = [F.coalesce(F.size(F.filter(F.col("base.kind"), is_kind(k))), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *number, "base_sha256", "spans")


@query
def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_line_rules(spark, sf_dir):
    return line_rules(table(spark, sf_dir, "documents")).drop("clean_text")


@query
def op9_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), tokenizer())


@query
def op11_centroids(spark, sf_dir):
    return clusters(table(spark, sf_dir, "embeddings"))


@query
def op12_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def tokenizer() -> str:
    """The place of the vocabulary file; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_WS = r"[\x20\x09-\x0D]"
ORACLE["op8_line_rules"] = rf"""
WITH w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACES}'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS g FROM w, unnest(range(1, len(ws) - 3)) u(i) WHERE len(ws) >= 5),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, sum(n)::BIGINT AS n FROM (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM dup) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
 len(regexp_replace(array_to_string(list_filter(ls, lambda l: regexp_matches(l, '{ENDING.replace("'", "''")}') AND NOT len(regexp_extract_all(l, '!{_WS}')) * 3 > len(regexp_extract_all(l, '{SPACES}')) + 1 AND NOT len(regexp_extract_all(l, '{SYMBOLS}')) * 10 > len(l) AND NOT regexp_matches(l, '{NAVIGATION}') AND NOT regexp_matches(l, '{BOILERPLATE}')), chr(10)), '{SPACES}', '', 'g'))::BIGINT AS kept_chars FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars >= 0.5 * word_chars AS kept, kept_chars FROM m
"""
_ROWS = ", ".join("({}, '{}', '{}')".format(i, n, x.replace("'", "''")) for i, (n, x) in enumerate(TEMPLATES))
ORACLE["op1_license_scan"] = rf"""
WITH f AS (
  SELECT doc_id AS file_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || coalesce(replace(format('{{:,}}', doc_id), ',', '/'), 'none') || '.txt' AS path,
    coalesce(text, '') AS t FROM documents),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '{TERM}'))) AS term FROM f) GROUP BY 1),
parts AS (
  SELECT file_id, path, true AS whole, t AS candidate FROM f
  UNION SELECT file_id, path, false, unnest(string_split(t, chr(10))) FROM f
  UNION SELECT file_id, path, false, unnest(string_split_regex(regexp_replace(t, '(?m)^[^A-Za-z0-9\n]*$', '', 'g'), '\n\n+')) FROM f),
tpl(template, name, text) AS (VALUES {_ROWS}),
ct AS (
  SELECT candidate, term, count(*) AS tf
  FROM (SELECT candidate, unnest(regexp_extract_all(lower(candidate), '{TERM}')) AS term FROM (SELECT DISTINCT candidate FROM parts)) GROUP BY 1, 2),
tt AS (SELECT template, term, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM tpl) GROUP BY 1, 2),
cw AS (SELECT candidate, term, tf * (ln((1.0 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM ct LEFT JOIN df USING (term), n),
tw AS (SELECT template, term, tf * (ln((1.0 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM tt LEFT JOIN df USING (term), n),
cn AS (SELECT candidate, sqrt(sum(w * w)) AS k FROM cw GROUP BY 1),
tn AS (SELECT template, sqrt(sum(w * w)) AS k FROM tw GROUP BY 1),
dot AS (SELECT candidate, template, sum(cw.w * tw.w) AS p FROM cw JOIN tw USING (term) GROUP BY 1, 2),
cs AS (SELECT candidate, template, p / (cn.k * tn.k) AS score FROM dot JOIN cn USING (candidate) JOIN tn USING (template)),
best AS (SELECT candidate, template, score FROM cs QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY round(score, 9) DESC, template) = 1),
hits AS (SELECT * FROM parts JOIN best USING (candidate) JOIN tpl USING (template) WHERE score >= {THRESHOLD} - 1e-9),
own AS (
  SELECT file_id, path, arg_max(name, (round(score, 9), -template)) AS own_license, round(max(score), 6) AS own_score, bool_or(whole) AS whole
  FROM hits GROUP BY 1, 2),
r AS (
  SELECT f.file_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS folder, own_license, own_score, coalesce(whole, false) AS is_license
  FROM f LEFT JOIN own ON own.file_id IS NOT DISTINCT FROM f.file_id AND own.path = f.path),
given AS (SELECT folder AS above, arg_min(own_license, (-own_score, path)) AS passed FROM r WHERE is_license AND own_license IS NOT NULL GROUP BY 1),
near AS (
  SELECT folder, passed, above, len(string_split(folder, '/')) - len(string_split(above, '/')) AS distance
  FROM (SELECT DISTINCT folder FROM r) JOIN given ON folder = above OR starts_with(folder, above || '/')
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY len(above) DESC) = 1)
SELECT file_id AS doc_id, path, own_license, own_score, coalesce(own_license, passed) AS license,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN passed IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN own_license IS NULL THEN above END AS inherited_from, CASE WHEN own_license IS NULL THEN distance END AS distance
FROM r LEFT JOIN near USING (folder)
"""


def _round(i: int) -> str:
    """One round of SQL k-means: assignment to the centroids ``c{i}``, then the centroids ``c{i + 1}``."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, x, c, d FROM (SELECT v.vec_id, v.x, c.c, (list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x))::BIGINT AS d FROM v, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1),
m{i} AS (SELECT c, list(m ORDER BY k) AS x FROM (SELECT c, k, floor(sum(x[k]) / count(*)) AS m FROM a{i}, range(1, 65) r(k) GROUP BY c, k) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c)),"""


_FINITE = "len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0"
ORACLE["op11_centroids"] = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)),{"".join(_round(i) for i in range(4))}
s AS (SELECT c, sha256(array_to_string(list_transform(x, lambda e: e::BIGINT), ',')) AS sha FROM c3)
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a3 JOIN s USING (c)
"""
ORACLE["op12_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END)) AS g FROM w),
d AS MATERIALIZED (SELECT doc_id, g, len(g) AS n, md5(array_to_string(g, chr(10))) AS k FROM g),
c AS MATERIALIZED (SELECT k, any_value(g) AS g, any_value(n) AS n, count(*) AS copies, min(doc_id) AS least FROM d WHERE n > 0 GROUP BY k),
t AS (SELECT k, n, unnest(g) AS sh FROM c),
p AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.sh = b.sh AND a.k < b.k AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT k, k FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
f AS (SELECT r.a AS k, min(c.least) AS least FROM r JOIN c ON c.k = r.b GROUP BY 1),
l AS (SELECT e.a AS k, sum(c.copies)::BIGINT AS links FROM e JOIN c ON c.k = e.b GROUP BY 1)
SELECT d.doc_id, d.n AS n_shingles, coalesce(f.least, d.doc_id) AS component_id, coalesce(l.links, 0) + coalesce(c.copies, 1) - 1 AS n_links FROM d LEFT JOIN c USING (k) LEFT JOIN f USING (k) LEFT JOIN l USING (k)
"""
ORACLE["op13_hard_negatives"] = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b))::INTEGER AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3
"""
