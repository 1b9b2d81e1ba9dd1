"""The combined anomaly scan: the detectors of prices, series, ties and times on one table of bids, and their points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.core import above, count_if, ladder
from ..functions.storage import durable, small, stored
from . import graph as G
from . import prices as P
from . import relational as R
from . import sequences as S

RISKS = ("LOW", "MODERATE", "HIGH", "CRITICAL")
#: Points at which a sum is critical, high or moderate (fixed values).
LEVELS = [(5, "CRITICAL"), (3, "HIGH"), (1, "MODERATE")]


def network(bids: DataFrame, high: float = 0.7, moderate: float = 0.4, least: float = 2.0) -> DataFrame:
    """(vendor_id, network_risk) by the share of all bidders that a vendor has met in tenders; high only if they meet ``least`` times on average.

    A vendor's meetings are counted from the sizes of its tenders.  It has met no more others than it has
    meetings, so that only vendors with more meetings than the moderate share of all bidders need
    their distinct others counted; all others are LOW.
    """
    met = stored(G.bidders(bids).filter(F.size("vs") > 1))
    own = met.select(F.explode("vs").alias("node"), (F.size("vs") - 1).alias("n")).groupBy("node").agg(F.sum("n").alias("meetings"))
    own = stored(own.crossJoin(F.broadcast(own.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("others")))))  # one row
    open_ = own.filter(F.col("meetings") / F.col("others") > min(high, moderate))
    ends = met.select("vs", F.explode("vs").alias("a")).join(small(open_.select(F.col("node").alias("a"))), "a")
    pairs = G.counted(ends.select("a", F.array_remove("vs", F.col("a")).alias("others")), int(open_.agg(F.sum("meetings")).first()[0] or 0))
    degree = pairs.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    d = open_.join(degree, "node").withColumn("w", F.col("meetings") / F.col("degree"))
    c = F.col("degree") / F.col("others")
    d = d.select("node", F.when((c > high) & (F.col("w") > least), "HIGH").when(c > moderate, "MODERATE").otherwise("LOW").alias("network_risk"))
    low = own.join(open_.select("node"), "node", "left_anti").select("node", F.lit("LOW").alias("network_risk"))
    return d.unionByName(low).withColumnRenamed("node", "vendor_id")


def bid_signals(bids: DataFrame, times: DataFrame, critical: DataFrame, span: int = 10, gap: int = 300) -> DataFrame:
    """One row per bid with a positive amount: its own signals, its tender's and its vendor's.

    ``bids`` (bid_id, tender_id, vendor_id, total_amount, submitted_at) is written once and feeds
    all detectors; ``times`` (vendor_id, at) are moments of submission; ``critical`` (k, critical)
    are the outlier test's bounds.  Per tender: fence, the outlier test and price entropy.  Per
    vendor: digit law (mean deviation and chi square), variation over tenders (three bids and
    more), ties, hours and bursts, and the moving average of its bids in order of time, whose
    alerts are residuals above the mean plus two deviations.  What cannot be told (too few bids,
    no times) is LOW or false.
    """
    b = durable(bids.filter("total_amount > 0").select("bid_id", "tender_id", "vendor_id", "total_amount", "submitted_at"))
    fence = P.fences(b, "tender_id", "total_amount")
    top = R.nearest_lookup(P.grubbs(b, "tender_id", "bid_id", "total_amount"), "n", critical, "k", "critical")
    tender = fence.join(top.select("tender_id", F.when(F.col("g") > F.col("critical"), F.col("bid_id")).alias("outlier")), "tender_id", "left")
    tender = tender.join(P.price_entropy(b, "tender_id", "total_amount").select("tender_id", "entropy", F.col("risk").alias("entropy_risk")), "tender_id", "left")
    cv = P.variation(b, ["vendor_id"], "total_amount").filter("n >= 3")
    vendor = b.select("vendor_id").distinct()
    for one in (
        P.benford_mad(b, ["vendor_id"], "total_amount").select("vendor_id", F.col("risk").alias("digit_risk")),
        P.benford_chi2(b, "vendor_id", "total_amount").select("vendor_id", F.col("fails").alias("digit_fails")),
        cv.select("vendor_id", ladder(F.col("cv"), [(0.02, "CRITICAL"), (0.05, "HIGH"), (0.10, "MODERATE")], "LOW").alias("cv_risk")),
        network(b),
        S.timing(times, "vendor_id", "at", gap).select("vendor_id", F.col("risk").alias("timing_risk")),
    ):
        vendor = vendor.join(one, "vendor_id", "left")
    mean = S.ewma(b.select("vendor_id", "submitted_at", "bid_id", "total_amount"), "vendor_id", ["submitted_at", "bid_id"], "total_amount", span)
    bar = mean.groupBy("vendor_id").agg((F.avg("residual") + 2 * F.stddev_pop("residual")).alias("bar"))
    alerts = mean.join(bar, "vendor_id").select("bid_id", (F.col("residual") > F.col("bar")).alias("ewma_alert"))
    risk = lambda c: F.coalesce(F.col(c), F.lit("LOW")).alias(c)
    out = b.join(tender, "tender_id").join(vendor, "vendor_id").join(alerts, "bid_id")
    return out.select(
        "bid_id", "tender_id", "vendor_id", P.fence_class(F.col("total_amount")).alias("fence"), F.coalesce(F.col("outlier") == F.col("bid_id"), F.lit(False)).alias("grubbs"), "ewma_alert",
        risk("entropy_risk"), risk("digit_risk"), F.coalesce("digit_fails", F.lit(False)).alias("digit_fails"), risk("cv_risk"), risk("network_risk"), risk("timing_risk"),
    )


def level(risk: Column | str) -> Column:
    """0 for LOW to 3 for CRITICAL."""
    c = F.col(risk) if isinstance(risk, str) else risk
    return F.array_position(F.array(*map(F.lit, RISKS)), c) - 1


def scored(df: DataFrame) -> DataFrame:
    """Adds ``points`` and ``risk`` from forest (anomalous bids), network, timing, digits and entropy (0 to 3 each)."""
    n, timing = F.col("forest"), F.col("timing")
    points = F.when(n > 3, 3).when(n > 1, 2).when(n > 0, 1).otherwise(0) + F.when(F.col("network") >= 2, 2).otherwise(0) + F.when(timing >= 2, 2).when(timing == 1, 1).otherwise(0)
    points = (points + F.when(F.col("digits") >= 2, 2).otherwise(0) + F.when(F.col("entropy") >= 2, 1).otherwise(0)).cast("int")
    return df.withColumn("points", points).withColumn("risk", above(F.col("points"), LEVELS, "LOW"))


def summarise(signals: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys`` (or over all): how many bids show each signal, the worst level of each risk, points and overall risk.

    ``signals`` are those of ``bid_signals`` with a boolean ``forest``.
    """
    worst = {"entropy": "entropy_risk", "digits": "digit_risk", "variation": "cv_risk", "network": "network_risk", "timing": "timing_risk"}
    a = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bids"), count_if(F.col("forest")).alias("forest"), count_if(F.col("fence") == "extreme").alias("extreme"), count_if(F.col("fence") == "mild").alias("mild"),
        count_if(F.col("grubbs")).alias("grubbs"), count_if(F.col("ewma_alert")).alias("ewma_alerts"), count_if(F.col("digit_fails")).alias("digit_fails"),
        *[F.coalesce(F.max(level(c)), F.lit(0)).cast("int").alias(name) for name, c in worst.items()],
    )
    return scored(a)
