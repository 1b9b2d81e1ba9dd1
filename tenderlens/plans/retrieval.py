"""Queries of vector and hybrid retrieval; every row whose id is divisible by 100 is a query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import durable, small
from ..operators import retrieval as V
from .aggregates import r
from .registry import query

K = 25
KNN = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), d AS (SELECT q.vec_id AS query, e.vec_id, list_distance(q.v, e.v) ** 2 AS distance, list_cosine_similarity(q.v, e.v) AS cosine FROM e JOIN e q ON q.vec_id % 100 = 0),
knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), vec_id) AS rank FROM d QUALIFY rank <= 25),
sem AS (SELECT query, vec_id, 0.3 * CASE WHEN max(1 - distance) OVER w > min(1 - distance) OVER w THEN (1 - distance - min(1 - distance) OVER w) / (max(1 - distance) OVER w - min(1 - distance) OVER w) ELSE 1 END + 0.7 * cosine AS semantic FROM knn WINDOW w AS (PARTITION BY query)),
tf AS (SELECT doc_id AS vec_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents) GROUP BY 1, 2), mem AS (SELECT query, vec_id FROM knn UNION SELECT query, query FROM knn), rows_ AS (SELECT * FROM mem JOIN tf USING (vec_id)),
wt AS (SELECT r.query, r.vec_id, r.w, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM rows_ r JOIN (SELECT query, w, count(*) AS df FROM rows_ GROUP BY 1, 2) USING (query, w) JOIN (SELECT query, count(*) AS n FROM mem GROUP BY 1) USING (query)),
nm AS (SELECT query, vec_id, sqrt(sum(x * x)) AS norm FROM wt GROUP BY 1, 2), dt AS (SELECT a.query, a.vec_id, sum(a.x * b.x) AS dot FROM wt a JOIN wt b ON a.query = b.query AND a.w = b.w AND b.vec_id = b.query GROUP BY 1, 2),
lex AS (SELECT k.query, k.vec_id, coalesce(dot / (n1.norm * n2.norm), 0) AS lexical FROM knn k LEFT JOIN nm n1 ON n1.query = k.query AND n1.vec_id = k.vec_id LEFT JOIN nm n2 ON n2.query = k.query AND n2.vec_id = k.query LEFT JOIN dt ON dt.query = k.query AND dt.vec_id = k.vec_id),
fused AS (SELECT query, vec_id, (1 / (60 + row_number() OVER (PARTITION BY query ORDER BY round(semantic, 9) DESC, vec_id)) + 1 / (60 + row_number() OVER (PARTITION BY query ORDER BY round(lexical, 9) DESC, vec_id))) / (2 / 61) * 100 AS relevance FROM sem JOIN lex USING (query, vec_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(relevance, 9) DESC, vec_id) AS place FROM fused)
"""


def found(t, vectors=None):
    v = t.raw("embeddings") if vectors is None else vectors
    return V.knn(v.filter("vec_id % 100 = 0"), v, K)


@query(f"WITH {KNN} SELECT query, vec_id, round(distance, 6) AS distance, rank FROM knn")
def knn_l2(t):
    return found(t).select("query", "vec_id", r("distance").alias("distance"), "rank")


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <= 3), d AS (SELECT q.vec_id AS query, e.vec_id, list_distance(q.v, e.v) ** 2 AS distance FROM e JOIN e q ON q.vec_id % 100 = 0)
SELECT query, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), vec_id) AS rank FROM d QUALIFY rank <= 25""")
def metadata_filter(t):
    """Neighbours among the vectors of given labels, filtered before the search so that none are missing."""
    return found(t, t.raw("embeddings").filter("label <= 3")).select("query", "vec_id", r("distance").alias("distance"), "rank")


@query(f"WITH {KNN} SELECT query, vec_id, round(semantic, 6) AS semantic FROM sem")
def semantic_rerank(t):
    return V.rerank(found(t), t.raw("embeddings")).select("query", "vec_id", r("semantic").alias("semantic"))


@query(f"WITH {KNN} SELECT query, vec_id, round(lexical, 6) AS lexical FROM lex")
def tfidf_scores(t):
    return V.tfidf(found(t), t.raw("documents")).select("query", "vec_id", r("lexical").alias("lexical"))


def fused(t, k):
    f = durable(found(t))
    return V.fuse(V.rerank(f, t.raw("embeddings")), V.tfidf(f, t.raw("documents")), k)


@query(f"WITH {KNN} SELECT query, vec_id, round(relevance, 6) AS relevance, place, relevance >= 40 AS relevant FROM top WHERE place <= 5")
def rrf_fusion(t, k=5):
    return fused(t, k).select("query", "vec_id", r("relevance").alias("relevance"), "place", (F.col("relevance") >= 40).alias("relevant"))


@query(f"""
WITH {KNN}, u AS (SELECT sha256(text) AS hash, max(relevance) AS relevance FROM top JOIN documents ON doc_id = vec_id GROUP BY 1) SELECT hash, round(relevance, 6) AS relevance FROM u ORDER BY round(relevance, 9) DESC, hash LIMIT 50""")
def multi_query_union(t):
    """All queries as variants of one search: hits united, equal texts once, best 50."""
    hits = fused(t, K).join(t.raw("documents").select(F.col("doc_id").alias("vec_id"), F.sha2("text", 256).alias("hash")), "vec_id")
    u = hits.groupBy("hash").agg(F.max("relevance").alias("relevance"))
    return u.orderBy(F.round("relevance", 9).desc(), "hash").limit(50).select("hash", r("relevance").alias("relevance"))


@query("""
WITH bank AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS c FROM embeddings GROUP BY 1), s AS (SELECT source, label, max(list_cosine_similarity(embedding::DOUBLE[], c)) AS best FROM (SELECT e.embedding, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id), bank GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY best DESC, label) - 1 AS k FROM s)
SELECT source, round(greatest(0, least(100, (sum(best / (1 + 0.3 * k)) / sum(1 / (1 + 0.3 * k)) - 0.15) * 150)), 5) AS risk, count(*) FILTER (best > 0.25) AS concepts FROM k WHERE k < 10 GROUP BY 1""")
def concept_risk(t):
    e = t.raw("embeddings")
    bank = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))  # one vector per label
    s = e.join(t.raw("documents").select(F.col("doc_id").alias("vec_id"), "source"), "vec_id").select("source", "embedding").crossJoin(small(durable(bank), 1000))  # one vector per label
    best = s.groupBy("source", "label").agg(F.max(V.cosine_of(F.col("embedding"), F.col("c"))).alias("best"))
    k = best.withColumn("k", F.row_number().over(W.partitionBy("source").orderBy(F.desc("best"), "label")) - 1).filter("k < 10").withColumn("w", 1 / (1 + 0.3 * F.col("k")))
    risk = (F.sum(F.col("best") * F.col("w")) / F.sum("w") - 0.15) * 150
    return k.groupBy("source").agg(r(F.greatest(F.lit(0.0), F.least(F.lit(100.0), risk)), 5).alias("risk"), F.count_if(F.col("best") > 0.25).alias("concepts"))
