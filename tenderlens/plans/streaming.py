"""Queries that replay bounded streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.text import chunks
from ..streaming import feeds as S
from .registry import query
from .sequences import CHAIN
from .text import sql_esg


#: The last watermark, in seconds: what is behind it has been told.
END = "epoch(max(ts)) - 600"


def events(t):
    """The audit rows in three micro-batches, in order of time."""
    return S.arrivals(t.audit().select("event_id", "ts", "user_id", "action", "details", "value"), "ts")


@query("SELECT event_id, user_id, action FROM audit WHERE event_id > 1000")
def audit_tail(t):
    return S.replay(S.audit_tail(events(t), 1000))


IN_ORDER = "e AS (SELECT user_id, event_id, value AS v, floor(epoch(ts))::BIGINT AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM audit)"
_M = "2 / 11.0::DOUBLE * e.v + (1 - 2 / 11.0::DOUBLE) * c.m"


@query(f"""
WITH {IN_ORDER}, c(user_id, event_id, k, m, mean, square, alert) AS (
  SELECT user_id, event_id, k, v, 0.0::DOUBLE, 0.0::DOUBLE, false FROM e WHERE k = 1
  UNION ALL SELECT user_id, event_id, k, m, mean + (res - mean) / k, square + (res - mean) * (res - (mean + (res - mean) / k)), k > 3 AND res > mean + 2 * sqrt(square / (k - 1))
  FROM (SELECT e.user_id, e.event_id, e.k, {_M} AS m, abs(e.v - ({_M})) AS res, c.mean, c.square FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1))
SELECT event_id, user_id, round(m, 6) AS ewma, alert FROM c""", recursive=True)
def ewma_stream(t):
    return S.replay(S.ewma_stream(events(t))).withColumn("ewma", F.round("ewma", 6))


_NEW = "e.a > c.e_ + 604800"


@query(f"""
WITH {IN_ORDER}, c(user_id, event_id, a, k, verdict, best, e_, leader, round) AS (
  SELECT user_id, event_id, a, k, 'accepted', v, a + 86400, event_id, 1 FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.a, e.k, CASE WHEN {_NEW} THEN 'accepted' WHEN e.a > c.e_ THEN 'closed' WHEN e.v < c.best THEN 'accepted' ELSE 'not lower' END,
    CASE WHEN {_NEW} OR (e.a <= c.e_ AND e.v < c.best) THEN e.v ELSE c.best END,
    CASE WHEN {_NEW} THEN e.a + 86400 WHEN e.a <= c.e_ AND e.v < c.best AND c.e_ - e.a < 120 THEN c.e_ + 120 ELSE c.e_ END,
    CASE WHEN {_NEW} OR (e.a <= c.e_ AND e.v < c.best) THEN e.event_id ELSE c.leader END, CASE WHEN {_NEW} THEN c.round + 1 ELSE c.round END FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1),
w AS (SELECT arg_max(leader, k) AS event_id, user_id, 'awarded' AS verdict, arg_max(best, k) AS best, arg_max(e_, k) AS e_ FROM c GROUP BY user_id, round),
l AS (SELECT user_id, max(a) AS a FROM c GROUP BY 1)
SELECT event_id, user_id, verdict, best, e_ AS "end" FROM c UNION ALL SELECT event_id, w.user_id, verdict, best, e_ FROM w JOIN l USING (user_id) WHERE e_ < l.a OR e_ < (SELECT {END} FROM audit)""", recursive=True)
def auction_stream(t):
    return S.replay(S.auction_stream(events(t)))


@query(f"""
WITH m AS (SELECT user_id, floor(epoch(ts))::BIGINT AS at_ FROM audit), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce((at_ - lag(at_) OVER (PARTITION BY user_id ORDER BY at_) > 300)::INT, 1) AS new FROM m))
SELECT user_id, min(at_) AS start, count(*) AS members, max(at_) - min(at_) AS span FROM i GROUP BY user_id, island HAVING count(*) >= 2 AND max(at_) + 300 <= (SELECT floor({END}) FROM audit)""")
def burst_sessions(t):
    return S.replay(S.burst_sessions(events(t)))


@query("SELECT event_id, user_id, n FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM audit) WHERE n > 2")
def rate_violation_stream(t):
    return S.replay(S.rate_violations(events(t)))


@query(f"WITH {CHAIN.strip()} SELECT event_id, user_id, prev_hash, hash FROM c", recursive=True)
def audit_seal_stream(t):
    return S.replay(S.seal_stream(events(t)))


@query()
def document_ingest_stream(t):
    """New texts once, redacted, scored and cut in chunks."""
    new = S.replay(S.ingest_documents(S.document_stream(t.spark, t.dir)))
    return chunks(new).join(new.select("doc_id", "esg"), "doc_id").select("doc_id", "esg", "chunk_index", "total", F.col("content_hash").alias("chunk_hash"))


@query(f"SELECT coalesce(source, '') AS source, count(*) AS n, round(avg(esg), 6) AS mean_esg FROM (SELECT source, {sql_esg()} AS esg FROM (SELECT source, lower(text) AS t FROM (SELECT DISTINCT source, text FROM documents))) GROUP BY 1")
def vendor_esg_stream(t):
    """Each source's texts and mean points after the last micro-batch; a source's equal texts count once."""
    docs = t.raw("documents")
    told = S.replay(S.running_esg(S.arrivals(docs.select("doc_id", "source", "text"), "doc_id")))
    return told.groupBy("source").agg(F.max("n").alias("n"), F.round(F.max_by("mean_esg", "n"), 6).alias("mean_esg"))


@query(f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, action, count(*) AS n FROM audit GROUP BY 1, 2 HAVING min(epoch(date_trunc('hour', ts))) + 3600 <= (SELECT {END} FROM audit)")
def windowed_counts(t):
    return S.replay(S.windowed_counts(events(t)))


@query("""
WITH b AS (SELECT ts, (3 * user_id) // (SELECT max(user_id) + 1 FROM audit) AS batch FROM audit), h AS (SELECT batch, max(ts) AS high FROM b GROUP BY 1),
w AS (SELECT a.batch, max(p.high) - INTERVAL 600 SECOND AS edge FROM h a LEFT JOIN h p ON p.batch < a.batch GROUP BY 1)
SELECT batch, count(*) AS n, count(*) FILTER (WHERE ts <= edge) AS late FROM b JOIN w USING (batch) GROUP BY 1""")
def late_rows(t):
    """Rows behind the watermark where users' rows arrive in three blocks of user ids."""
    rows = t.audit()
    last = rows.agg(F.max("user_id")).first()[0]
    block = F.floor(3 * F.col("user_id") / (last + 1))
    return S.late_rows(S.arrivals(rows.select("ts", block.alias("block")), "block", cuts=[0, 1]))
