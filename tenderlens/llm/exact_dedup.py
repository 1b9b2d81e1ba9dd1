"""Operator 6: exact duplicates, with heavy digests found by Misra-Gries and settled map-side.

Digests of all rows are cut to a durable table.  Each partition keeps a Misra-Gries summary
of at most ``counters`` digests; the merged summaries name every digest with more than
rows / counters copies.  Their counts and winners are verified exactly by a map-side combined
aggregation and broadcast (at most ``counters`` rows), so that hot digests never shuffle by
key; the remaining digests, each with at most rows / counters rows, take an ordinary shuffle.

Null text counts as the empty text and all empty texts are equal.  Of equal texts the row with
the largest doc_id stays (null doc_ids come last); among rows that repeat text and doc_id one
stays, the least by its other columns as JSON (in ``exact_groups``, any).  Very long texts are hashed whole; an empty table gives an empty
result; ``drop_exact_copies`` keeps all columns, whatever their names, and ``exact_groups`` reads
doc_id and text only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, ship, small

ship(__name__)

COUNTERS = 4096


def digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tkey, text) to (doc_id, tkey, digest): SHA-256 of the text with A-Z lowered."""
    for batch in batches:
        texts = pc.ascii_lower(pc.fill_null(batch.column("text"), ""))
        digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), pa.array(digests, pa.binary())], ["doc_id", "tkey", "digest"])


def summarize(counters: int):
    """Misra-Gries over a partition's digests: rows (digest, n), with n at most the true count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            for pair in pc.value_counts(batch.column("digest")).to_pylist():
                kept[pair["values"]] = kept.get(pair["values"], 0) + pair["counts"]
            if len(kept) > counters:
                floor = sorted(kept.values(), reverse=True)[counters]
                kept = {k: v - floor for k, v in kept.items() if v > floor}
        yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.binary()), pa.array(kept.values(), pa.int64())], ["digest", "n"])

    return run


def text_key() -> Column:
    """Tells texts of one doc_id apart when rows are looked up again."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, digest, uid) of all rows; uid tells repeated rows apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", text_key().alias("tkey"), "text").mapInArrow(digest_batches, f"doc_id {kind}, tkey bigint, digest binary")
    return durable(made.withColumn("uid", F.monotonically_increasing_id()))


def heavy_digests(table: DataFrame, counters: int) -> DataFrame:
    """Digests with more than rows / counters copies, and perhaps some others; at most ``counters``."""
    found = table.select("digest").mapInArrow(summarize(counters), "digest binary, n bigint")
    top = durable(found.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1))
    # merging summaries takes the count of the first digest too many from all
    floor = top.agg(F.min("n")).first()[0] if top.count() > counters else 0
    return top.filter(F.col("n") > floor).select("digest")


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, tkey, digest, keep_id, group_size, kept."""
    table = digests(docs)
    best = F.max(F.struct("doc_id", "uid"))
    heavy = F.broadcast(heavy_digests(table, counters))
    winners = table.join(heavy, "digest").groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = durable(winners)
    hot = table.join(F.broadcast(winners), "digest")
    same = W.partitionBy("digest")
    cold = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("*", best.over(same).alias("best"), F.count(F.lit(1)).over(same).alias("group_size"))
    return hot.select(*cold.columns).unionByName(cold).select("doc_id", "tkey", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"))


def drop_exact_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; a row is known by doc_id and text.

    The rows that go leave by one anti-join on narrow keys, which is broadcast while those are
    few, so that texts are not shuffled then.  Only rows that repeat doc_id and text, where one
    of several must stay, are looked up a second time.
    """
    groups = durable(exact_groups(docs, counters))
    rows = groups.groupBy(F.col("doc_id").alias("__xd_id"), F.col("tkey").alias("__xd_key")).agg(F.count(F.lit(1)).alias("__xd_rows"), F.max("kept").alias("__xd_kept"))
    rows = durable(rows.filter((F.col("__xd_rows") > 1) | ~F.col("__xd_kept")))
    same = docs["doc_id"].eqNullSafe(F.col("__xd_id")) & (text_key() == F.col("__xd_key"))
    single = docs.join(small(rows.select("__xd_id", "__xd_key")), same, "left_anti")
    again = rows.filter(F.col("__xd_kept"))
    if again.isEmpty():
        return single
    turn = F.row_number().over(W.partitionBy("__xd_id", "__xd_key").orderBy(F.to_json(F.struct(*docs.columns))))  # rows of one doc_id and text
    more = docs.join(small(again), same).withColumn("__xd_turn", turn).filter("__xd_turn = 1").select(*docs.columns)
    return single.unionByName(more)
