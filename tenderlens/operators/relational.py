"""Select, filter, join, set and update operators over any tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import ranked


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Declared defaults for null values."""
    return df.fillna(defaults)


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with those of ``new`` inserted or overwriting; ``new`` holds one row per key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def latest_by_key(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key."""
    last = W.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def delete_where(df: DataFrame, test: Column) -> DataFrame:
    """The rows that stay; an undecided test deletes nothing."""
    return df.filter(~F.coalesce(test, F.lit(False)))


def deleted_count(df: DataFrame, test: Column) -> DataFrame:
    """One row: how many rows ``delete_where`` deletes, and how many stay."""
    gone = F.coalesce(test, F.lit(False))
    return df.agg(F.coalesce(F.sum(gone.cast("bigint")), F.lit(0)).alias("deleted"), F.coalesce(F.sum((~gone).cast("bigint")), F.lit(0)).alias("kept"))


def assign_numbers(rows: DataFrame, order: Sequence[str], start: int, prefix: str, year: int) -> DataFrame:
    """Consecutive ids after ``start`` and document numbers, without sorting all rows in one task."""
    placed, _ = ranked(rows, [], [F.col(c) for c in order], small_keys=True)
    out = placed.withColumn("new_id", F.col("rank") + start + 1).drop("rank")
    return out.withColumn("number", F.format_string(f"{prefix}/{year}/%04d", "new_id")).withColumn("po_number", F.concat(F.lit("45"), F.col("new_id") + 100000))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """added, removed or changed for each key, by a digest of all other columns."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256)
    a, b = old.select(key, digest(old).alias("a")), new.select(key, digest(new).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def first_of_content(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The least id of each content hash, with the number of rows that share it."""
    return docs.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies"))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def page(df: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_key(df: DataFrame, key: Sequence[str], order: Sequence, n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col(name) <= n)


def pair_join(df: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs (a, b), a < b, of distinct items of each group."""
    d = df.select(group, item).distinct()
    return d.select(group, F.col(item).alias("a")).join(d.select(group, F.col(item).alias("b")), group).filter("a < b")


def nearest_lookup(df: DataFrame, value: str, table: DataFrame, key: str, keep: str) -> DataFrame:
    """``keep`` of the table row whose key is nearest to ``value`` (ties: the smaller key); the table is small and fixed."""
    found = df.select(value).distinct().crossJoin(F.broadcast(table))
    best = found.groupBy(value).agg(F.min_by(keep, F.struct(F.abs(F.col(value) - F.col(key)), F.col(key))).alias(keep))
    return df.join(best, value, "left")


def admit(bids: DataFrame, open_tenders: DataFrame, vendors: DataFrame) -> DataFrame:
    """Adds ``reason`` (null: accepted): tender not open, vendor unknown or blacklisted, or a repeated bid."""
    turn = F.row_number().over(W.partitionBy("tender_id", "vendor_id").orderBy("submitted_at", "bid_id"))
    out = bids.withColumn("turn", turn).join(open_tenders.select("tender_id", F.lit(True).alias("is_open")), "tender_id", "left")
    out = out.join(vendors.select("vendor_id", "is_blacklisted"), "vendor_id", "left")
    reason = F.when(F.col("is_open").isNull(), "tender not open").when(F.col("is_blacklisted").isNull(), "vendor unknown").when(F.col("is_blacklisted"), "vendor blacklisted").when(F.col("turn") > 1, "already bid")
    return out.withColumn("reason", reason).drop("turn", "is_open", "is_blacklisted")


def missing_labels(have: DataFrame, required: DataFrame, key: str, label: str) -> DataFrame:
    """Sorted missing labels of each key; ``required`` is a small list."""
    need = have.select(key).distinct().crossJoin(F.broadcast(required.select(label)))
    return need.join(have.select(key, label).distinct(), [key, label], "left_anti").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(label)), ",").alias("missing"))
