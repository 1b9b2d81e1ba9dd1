"""Ranking, adjacency, control-chart and ledger operators over ordered rows of a key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import durable, partitions, small


def qcbs(bids: DataFrame, scores: DataFrame, criteria: DataFrame, technical: float = 0.7, financial: float = 0.3, legacy_threshold: bool = False) -> DataFrame:
    """Quality- and cost-based ranking: technical, financial and composite score, qualification and rank of each bid.

    A bid qualifies when every criterion reaches its threshold; ``legacy_threshold`` multiplies
    the bar by the number of criteria.  Only qualified bids have a rank.
    """
    joined = scores.join(F.broadcast(criteria), "criteria_id")  # criteria are a handful of rows
    normal = F.col("score") / F.col("max_score") * 100
    bar = F.col("threshold") * (F.lit(criteria.count()) if legacy_threshold else F.lit(1))
    a = joined.groupBy("bid_id").agg((F.sum(normal * F.col("weight")) / F.sum("weight")).alias("technical"), F.min((normal >= bar).cast("int")).alias("passes"))
    tender = W.partitionBy("tender_id")
    b = bids.join(a, "bid_id").withColumn("financial", F.min("total_amount").over(tender) / F.col("total_amount") * 100)
    b = b.withColumn("composite", F.col("technical") * technical + F.col("financial") * financial).withColumn("qualified", F.col("passes") == 1)
    place = F.row_number().over(W.partitionBy("tender_id", "qualified").orderBy(F.round("composite", 9).desc(), "bid_id"))
    return b.withColumn("rank", F.when(F.col("qualified"), place))


def adjacent_gap(group: str, value: str, key: str) -> Column:
    """Per cent between a value and the next lower of its group; null for the lowest."""
    prev = F.lag(value).over(W.partitionBy(group).orderBy(value, key))
    return (F.col(value) - prev) / F.when(prev > 0, prev) * 100


def bursts(df: DataFrame, key: str, at: str, gap: int, least: int = 2) -> DataFrame:
    """Islands of rows whose gaps are at most ``gap`` seconds: (key, start, members, span)."""
    order = W.partitionBy(key).orderBy(at)
    new = (F.col(at) - F.lag(at).over(order) > gap).cast("int")
    marked = df.select(key, at).withColumn("new", F.coalesce(new, F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min(at).alias("start"), F.count(F.lit(1)).alias("members"), (F.max(at) - F.min(at)).alias("span")).filter(F.col("members") >= least).drop("island")


def ewma(df: DataFrame, key: str, order: list[str], value: str, span: int = 10) -> DataFrame:
    """Exponentially weighted mean of each series in order: key, the order columns, value, ewma, residual.

    A step of the recursion is affine in the mean before it, and so is any run of steps.  Rows are
    range-partitioned by key and order, so that one series may span many tasks; each task runs its
    part of a series from zero and keeps the power that the mean before it is to be multiplied
    with.  The parts' last steps, one row for each part of a series, give the means before all
    parts.  Null values leave the mean as it was; a series' first value starts it
    (rows before that one show it already).
    """
    alpha = 2.0 / (span + 1)
    types = dict(df.dtypes)
    fields = ", ".join([f"{key} {types[key]}", *(f"{c} {types[c]}" for c in order), f"{value} double", "__local double", "__power double", "__at bigint"])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mean, steps, at = None, 0.0, 0, 0  # of the series that may go on in the next batch
        for pdf in pdfs:
            out = []
            for k, part in pdf.groupby(key, sort=False, dropna=False):
                if last is None or not (k == last[0] or (pd.isna(k) and pd.isna(last[0]))):
                    last, mean, steps, at = (k,), 0.0, 0, 0
                known = part[value].astype(float)
                local = pd.concat([pd.Series([mean]), known.dropna()], ignore_index=True).ewm(alpha=alpha, adjust=False).mean()
                done = known.notna().cumsum().to_numpy()
                made = local.to_numpy()[done]
                out.append(part.assign(__local=made, __power=(1 - alpha) ** (steps + done), __at=np.arange(at, at + len(part))))
                mean, steps, at = made[-1], steps + int(done[-1]), at + len(part)
            if out:
                yield pd.concat(out)

    rows = df.select(key, *order, F.col(value).cast("double").alias(value))
    rows = rows.repartitionByRange(partitions(df), key, *order).sortWithinPartitions(key, *order).mapInPandas(run, fields)
    rows = durable(rows.withColumn("__part", F.spark_partition_id()))
    ends = rows.groupBy(key, "__part").agg(F.max_by(F.struct("__local", "__power"), "__at").alias("end"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col("__at"))).alias("first"))

    # one struct for each part of a series; the mean before a part is that after the one before it
    part = F.struct("__part", F.col("end.__local").alias("local"), F.col("end.__power").alias("power"), "first")
    series = ends.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    start = F.get(F.filter(F.col("parts.first"), lambda v: v.isNotNull()), F.lit(0))
    none = F.array().cast("array<struct<p:int,before:double>>")
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.array(F.struct(x["__part"].alias("p"), acc["mean"].alias("before")))).alias("out"), (x["local"] + x["power"] * acc["mean"]).alias("mean"))
    walked = F.aggregate("parts", F.struct(none.alias("out"), start.alias("mean")), step, lambda acc: acc["out"])
    starts = series.select(key, F.explode(walked).alias("s")).select(key, F.col("s.p").alias("__part"), F.col("s.before").alias("__before"))
    named = small(durable(starts.select(F.col(key).alias("__key"), F.col("__part").alias("__p"), "__before")))  # one row for each part of a series
    met = rows.join(named, rows[key].eqNullSafe(named["__key"]) & (rows["__part"] == named["__p"]))
    mean = F.col("__local") + F.col("__power") * F.col("__before")
    return met.select(key, *order, value, mean.alias("ewma")).withColumn("residual", F.abs(F.col(value) - F.col("ewma")))


def leave_one_out(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """``others``: the least value of the group's other rows (null where there is none); bounded state per group."""
    least = F.min(F.struct(value, key))
    w = W.partitionBy(group)
    first = df.withColumn("__l1", least.over(w))
    rest = F.min(F.when(F.col(key) != F.col(f"__l1.{key}"), F.col(value))).over(w)
    return first.withColumn("__l2", rest).withColumn("others", F.when(F.col(key) == F.col(f"__l1.{key}"), F.col("__l2")).otherwise(F.col(f"__l1.{value}"))).drop("__l1", "__l2")


def canonical(cols: list[str]) -> Column:
    """The text that an audit entry is sealed by: columns in the given order, joined by bars; bars and backslashes within are escaped, null is \\N."""
    escaped = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.concat_ws("|", *[F.coalesce(escaped(c), F.lit("\\N")) for c in cols])


def seal(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Appends prev_hash and hash to each chain in order; sequential within a key (a chain must fit in a task), parallel across keys."""
    types = dict(df.dtypes)
    fields = ", ".join([*(f"{c} {types[c]}" for c in df.columns), "content string", "prev_hash string", "hash string"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        prev, before, hashes = "0" * 64, [], []
        for text in pdf["content"]:
            before.append(prev)
            prev = hashlib.sha256(f"{prev}|{text}".encode()).hexdigest()
            hashes.append(prev)
        return pdf.assign(prev_hash=before, hash=hashes)

    return df.withColumn("content", canonical(cols)).groupBy(key).applyInPandas(run, fields)


def verify(sealed: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Adds ``fault``: LINK_BREAK before CONTENT_TAMPERED, null for sound rows."""
    before = F.coalesce(F.lag("hash").over(W.partitionBy(key).orderBy(order)), F.lit("0" * 64))
    recomputed = F.sha2(F.concat(F.col("prev_hash"), F.lit("|"), canonical(cols)), 256)
    return sealed.withColumn("fault", F.when(F.col("prev_hash") != before, "LINK_BREAK").when(F.col("hash") != recomputed, "CONTENT_TAMPERED"))


def transitions(df: DataFrame, group: str, order: list[str], item: str) -> DataFrame:
    """Counts of consecutive items: (group, from_item, to_item, n)."""
    nxt = F.lead(item).over(W.partitionBy(group).orderBy(*order))
    return df.select(group, F.col(item).alias("from_item"), nxt.alias("to_item")).filter("to_item is not null").groupBy(group, "from_item", "to_item").agg(F.count(F.lit(1)).alias("n"))


def timing(rows: DataFrame, key: str, at: str, gap: int = 300) -> DataFrame:
    """(key, score, bursts, risk): how narrow the hours of day are (100: one hour), runs of rows at most ``gap`` seconds apart, and the worse of both."""
    c = rows.groupBy(key, F.hour(at).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    a = c.groupBy(key).agg(F.count(F.lit(1)).alias("bins"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("cl"))
    bits = F.log2("n") - F.col("cl") / F.col("n")
    score = F.when(F.col("bins") == 1, 100.0).otherwise((1 - bits / F.log2(F.greatest("bins", F.lit(2)))) * 100)
    b = bursts(rows.select(key, F.unix_timestamp(at).alias("at")), key, "at", gap).groupBy(key).agg(F.count(F.lit(1)).alias("bursts"))
    x = a.select(key, score.alias("score")).join(b, key, "left").withColumn("bursts", F.coalesce("bursts", F.lit(0)))
    risk = F.when((F.col("score") > 70) | (F.col("bursts") >= 3), "CRITICAL").when((F.col("score") > 45) | (F.col("bursts") >= 2), "HIGH").when((F.col("score") > 25) | (F.col("bursts") >= 1), "MODERATE").otherwise("LOW")
    return x.withColumn("risk", risk)
