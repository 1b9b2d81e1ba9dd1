"""Price statistics per group: concentration, fences, outlier tests, shape, entropy and digit laws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import ladder, ratio
from ..functions.storage import durable, partitions

NEVER = 1e300


def gini(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Gini of the positive values of each group; fewer than two give 0."""
    x = df.filter(F.col(value) > 0)
    i = F.row_number().over(W.partitionBy(*group).orderBy(value))
    a = x.withColumn("i", i).groupBy(*group).agg(F.sum(F.col("i") * F.col(value)).alias("ix"), F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    g = 2 * F.col("ix") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return a.select(*group, "n", F.when(F.col("n") < 2, 0.0).otherwise(g).alias("gini"))


def global_gini(df: DataFrame, value: str) -> DataFrame:
    """Gini of all positive values without a one-task sort: equal values are merged, ranks come from ranges' offsets."""
    per = df.filter(F.col(value) > 0).groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    placed = durable(per.repartitionByRange(partitions(df), "x").withColumn("part", F.spark_partition_id()))
    offsets = placed.groupBy("part").agg(F.sum("c").alias("rows"))
    offsets = offsets.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))  # one row per range
    within = F.coalesce(F.sum("c").over(W.partitionBy("part").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    r = placed.withColumn("before", within).join(F.broadcast(offsets), "part").withColumn("first", F.col("before") + F.col("offset") + 1)
    # ranks of equal values sum to c * first + c (c - 1) / 2
    a = r.agg(F.sum(F.col("x") * (F.col("c") * F.col("first") + F.col("c") * (F.col("c") - 1) / 2)).alias("ix"), F.sum(F.col("x") * F.col("c")).alias("s"), F.sum("c").alias("n"))
    return a.select("n", F.when(F.col("n") < 2, 0.0).otherwise(2 * F.col("ix") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def fences(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles by linear interpolation and Tukey's fences; groups under four values give zeros."""
    q = df.groupBy(group).agg(F.count(value).alias("n"), *[F.expr(f"percentile({value}, {p})").alias(f"q{i}") for i, p in ((1, 0.25), (2, 0.5), (3, 0.75))])
    few = F.col("n") < 4
    zero = lambda c: F.when(few, 0.0).otherwise(c)
    iqr = F.col("q3") - F.col("q1")
    side = lambda k, sign: zero((F.col("q3") + k * iqr) if sign > 0 else (F.col("q1") - k * iqr))
    return q.select(group, "n", zero(F.col("q1")).alias("q1"), zero(F.col("q2")).alias("q2"), zero(F.col("q3")).alias("q3"), side(1.5, -1).alias("low"), side(1.5, 1).alias("high"), side(3.0, -1).alias("far_low"), side(3.0, 1).alias("far_high"))


def fence_class(value: Column) -> Column:
    return F.when(F.col("n") < 4, "normal").when((value < F.col("far_low")) | (value > F.col("far_high")), "extreme").when((value < F.col("low")) | (value > F.col("high")), "mild").otherwise("normal")


def grubbs(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """n, the largest deviation in sample standard deviations, and the row (least ``key`` on ties) it belongs to."""
    w = W.partitionBy(group)
    d = df.select(group, key, value, F.avg(value).over(w).alias("m"), F.stddev_samp(value).over(w).alias("s"))
    a = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s"), F.max_by(F.struct(key, F.abs(F.col(value) - F.col("m")).alias("dev")), F.struct(F.round(F.abs(F.col(value) - F.col("m")), 9), -F.col(key))).alias("top"))
    usable = (F.col("n") >= 3) & (F.coalesce(F.col("s"), F.lit(0.0)) > 0)
    return a.select(group, "n", F.when(usable, F.col("top.dev") / F.when(F.col("s") > 0, F.col("s"))).otherwise(0.0).alias("g"), F.col(f"top.{key}").alias(key))


def shape(df: DataFrame, group: str, value: str) -> DataFrame:
    """Population skewness and excess kurtosis; equal values give 0 and -3."""
    a = df.groupBy(group).agg(F.coalesce(F.skewness(value), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(value), F.lit(-3.0)).alias("kurt"))
    skewed = F.when(F.col("skew") > 0.5, "right").when(F.col("skew") < -0.5, "left").otherwise("symmetric")
    tails = F.when(F.col("kurt") > 1.0, "heavy").when(F.col("kurt") < -1.0, "light").otherwise("normal")
    return a.select("*", skewed.alias("skew_label"), tails.alias("kurt_label"))


def entropy_of(df: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Shannon bits of the buckets of each group, with their number."""
    c = df.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("c"))
    a = c.groupBy(*group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("cl"), F.count(F.lit(1)).alias("buckets"))
    return a.select(*group, "n", "buckets", (F.log2("n") - F.col("cl") / F.col("n")).alias("bits"))


def price_entropy(df: DataFrame, group: str, value: str, bins: int = 5) -> DataFrame:
    w = W.partitionBy(group)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    width = F.col("hi") - F.col("lo")
    b = df.select(group, value, lo.alias("lo"), hi.alias("hi")).withColumn("bin", F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.when(width > 0, width) * bins))).cast("int"))
    e = entropy_of(b, [group], "bin").withColumn("entropy", F.col("bits") / math.log2(bins))
    return e.select(group, "n", F.round("entropy", 6).alias("entropy"), ladder(F.round("entropy", 9), [(0.25, "CRITICAL"), (0.5, "HIGH"), (0.75, "MODERATE")], "LOW").alias("risk"))


def digits(value: Column) -> Column:
    """The significant digits of a positive amount, from a fixed-scale decimal text."""
    return F.ltrim(F.regexp_replace(F.round(value, 4).cast("decimal(30,4)").cast("string"), r"\.", ""), F.lit("0"))


def benford_mad(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean absolute deviation from Benford's law of the first and second digits, for groups of ten or more."""
    spark = df.sparkSession
    theory = [(1, d, math.log10(1 + 1 / d)) for d in range(1, 10)] + [(2, d, sum(math.log10(1 + 1 / (10 * k + d)) for k in range(1, 10))) for d in range(10)]
    law = spark.createDataFrame(theory, "place int, digit int, expected double")
    s = df.filter(F.col(value) > 0).select(*group, digits(F.col(value)).alias("s"))
    d = s.select(*group, F.explode(F.array(F.struct(F.lit(1).alias("place"), F.substring("s", 1, 1).cast("int").alias("digit")), F.struct(F.lit(2).alias("place"), F.substring("s", 2, 1).cast("int").alias("digit")))).alias("d"))
    c = d.groupBy(*group, "d.place", "d.digit").agg(F.count(F.lit(1)).alias("c"))
    n = c.filter("place = 1").groupBy(*group).agg(F.sum("c").alias("n"))
    full = n.crossJoin(F.broadcast(law)) if group else n.join(F.broadcast(law))  # 19 rows of theory
    joined = full.join(c, [*group, "place", "digit"], "left").withColumn("dev", F.abs(F.coalesce(F.col("c"), F.lit(0)) / F.col("n") - F.col("expected")))
    a = joined.groupBy(*group).agg(F.first("n").alias("n"), F.avg(F.when(F.col("place") == 1, F.col("dev"))).alias("mad_1"), F.avg(F.when(F.col("place") == 2, F.col("dev"))).alias("mad_2"))
    risk = F.when((F.col("mad_1") > 0.12) | (F.col("mad_2") > 0.08), "CRITICAL").when((F.col("mad_1") > 0.06) | (F.col("mad_2") > 0.04), "HIGH").when((F.col("mad_1") > 0.03) | (F.col("mad_2") > 0.02), "MODERATE").otherwise("LOW")
    return a.filter("n >= 10").select(*group, "n", F.round("mad_1", 6).alias("mad_1"), F.round("mad_2", 6).alias("mad_2"), risk.alias("risk"))


def benford_chi2(df: DataFrame, group: str, value: str, least: int = 10) -> DataFrame:
    s = df.filter(F.col(value) > 0).select(group, F.substring(digits(F.col(value)), 1, 1).cast("int").alias("d"))
    counts = s.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("d") == d).cast("int")).alias(f"c{d}") for d in range(1, 10)])
    chi = sum((F.col(f"c{d}") - F.col("n") * math.log10(1 + 1 / d)) ** 2 / (F.col("n") * math.log10(1 + 1 / d)) for d in range(1, 10))
    return counts.filter(F.col("n") > least).select(group, "n", F.round(chi, 6).alias("chi2"), (chi > 15.5).alias("fails"))


def variation(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, sample standard deviation and their ratio."""
    a = df.filter(F.col(value) > 0).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return a.withColumn("cv", ratio(F.col("std"), F.col("mean")))
