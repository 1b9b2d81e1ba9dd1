"""Durable intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, with its lineage cut; lost executors don't lose it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder as compressed columns, for long narrow tables that a query reads several times."""
    out = scratch(df.sparkSession, "stored")
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a narrow durable table, to be broadcast if it has at most ``most`` rows; else Spark deals both sides of its join."""
    return F.broadcast(df) if df.count() <= most else df


def ranked(df: DataFrame, keys: list[str], order: list, small_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """Adds ``rank``, 0-based among the rows of equal ``keys`` by ``order``, without gathering a key in one task.

    The rows are written once, then range-partitioned by keys and order, so a hot key spreads
    over many tasks; each partition's count of each key gives the offset of its rows.
    ``small_keys`` says that the number of distinct keys is bounded, so that keys + partitions
    rows may be broadcast.  Keys must not be null.  Returns the ranked rows and (keys, n), the
    count of each key.
    """
    cols = [F.col(k) for k in keys]
    rows = durable(df).repartitionByRange(partitions(df), *cols, *order).sortWithinPartitions(*cols, *order)
    rows = durable(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    runs = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per key and partition
    runs = durable(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    counts = runs.groupBy(*keys).agg(F.sum("_n").alias("n"))
    side = runs.select(*keys, "_part", (F.col("_before") - F.col("_first")).alias("_shift"))
    out = rows.withColumn("_part", part).join(F.broadcast(side) if small_keys else side, [*keys, "_part"])
    return out.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"), counts
