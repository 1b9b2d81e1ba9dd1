"""Live feeds as Structured Streaming jobs over an event stream (event_id, ts, user_id, action, details, value).

Builders take a streaming DataFrame and return one; ``replay`` runs a bounded stream to its end
through a durable sink and returns what it wrote.  State is kept per key and leaves: windows and
sessions when the watermark passes them, the processors' state by timers, known texts by their
age; only a chain's last hash and an owner's two sums stay.  Rows behind the watermark are dropped
by feeds with a watermark; ``late_rows`` counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import scratch
from ..operators.sequences import canonical
from ..operators.text import esg_points, redact
from . import processors as P

WATERMARK = "10 minutes"


def table_path(folder: str, name: str) -> str:
    """A pattern that only the table's path matches, be it a file or a folder of files; a file source takes a plain path as a folder."""
    return f"{folder.rstrip('/')}/{name}.parque[t]"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table of a folder as a file stream."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(table_path(folder, "events"))
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("action"), F.col("props").alias("details"), "value")


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet").schema
    return spark.readStream.schema(schema).parquet(table_path(folder, "documents"))


def arrivals(rows: DataFrame, order: str, parts: int = 3, cuts: list | None = None, each: int = 20_000) -> DataFrame:
    """The rows of a table as a stream of files: micro-batches are cut after the values ``cuts`` of ``order``, or at even ranks in ``parts``.

    A micro-batch is one file, or as many as give the least of them ``each`` rows a file; all have equally many.
    """
    spark = rows.sparkSession
    base = scratch(spark, "arrivals")
    if cuts is None:
        cuts = rows.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    number = sum((F.coalesce(F.col(order) > F.lit(c), F.lit(False)).cast("int") for c in cuts or []), F.lit(0))
    sizes = {r["i"]: r["n"] for r in rows.groupBy(number.alias("i")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a micro-batch
    files = max(1, min(sizes.get(i, 0) for i in range(len(cuts or []) + 1)) // each)
    for i in range(len(cuts or []) + 1):  # one after another: a file source takes files by their age
        part = rows.filter(number == i)
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")


def run(writer, base: str) -> None:
    writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def replay(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Runs the stream, in append mode, over all there is, and returns all that was written.

    ``base`` is the folder of results and checkpoint; a later replay with the same one goes on
    where that one ended.  What a window or timer holds back until the watermark passes is not
    written yet.
    """
    spark = stream.sparkSession
    base = base or scratch(spark, "stream")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")  # a batch that runs again replaces itself

    run(stream.writeStream.foreachBatch(write), base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def audit_tail(events: DataFrame, high_water: int) -> DataFrame:
    """Rows past a high-water id; the source's checkpoint keeps the offset."""
    return events.filter(F.col("event_id") > high_water).select("event_id", "user_id", "action")


def ewma_stream(events: DataFrame, span: int = 10, ttl: int = 30 * 86_400) -> DataFrame:
    """Per user: EWMA of value and an alert where the residual exceeds the mean + 2 sd of the residuals before it (causal)."""
    return P.stateful(events.withWatermark("ts", WATERMARK), "user_id", P.Ewma(span, ttl), P.Ewma.SCHEMA)


def auction_stream(events: DataFrame, seconds: int = 86_400, extension: int = 120, pause: int = 7 * 86_400) -> DataFrame:
    """A reverse auction per user id; a row per bid, and one ("awarded", with the best bid's id) when an auction has ended."""
    return P.stateful(events.withWatermark("ts", WATERMARK), "user_id", P.Auction(seconds, extension, pause), P.Auction.SCHEMA)


def burst_sessions(events: DataFrame, gap: str = "300 seconds", least: int = 2) -> DataFrame:
    """Sessions of a user whose events are at most ``gap`` apart."""
    s = events.withColumn("at", F.date_trunc("second", "ts")).withWatermark("at", WATERMARK).groupBy("user_id", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("members"), F.min("at").alias("a"), F.max("at").alias("b"))
    return s.filter(F.col("members") >= least).select("user_id", F.unix_timestamp("a").alias("start"), "members", (F.unix_timestamp("b") - F.unix_timestamp("a")).alias("span"))


def rate_violations(events: DataFrame, seconds: int = 3600, limit: int = 2) -> DataFrame:
    """Events at which a user has more than ``limit`` in the trailing window; the state holds that window only."""
    return P.stateful(events.withWatermark("ts", WATERMARK), "user_id", P.Rate(seconds, limit), P.Rate.SCHEMA)


def seal_stream(events: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Hash chain per user with the last hash in state; equals the batch seal of the same rows in event order.

    ``chains`` (user_id, last) are chains that were sealed before and go on.
    """
    rows = events.select("event_id", "user_id", canonical(["event_id", "user_id", "action", "details"]).alias("content"))
    return P.stateful(rows, "user_id", P.Seal(), P.Seal.SCHEMA, timers=False, initial=chains)


def windowed_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    c = events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "action").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.unix_timestamp(F.col("window.start")).alias("start"), "action", "n")


def ingest_documents(docs: DataFrame, owner: str = "source", keep: str = "30 days") -> DataFrame:
    """Redacted text, sustainability points and content hash of each new text of an owner.

    Equal texts of an owner pass once within ``keep`` of arrival (the time of their file), so the
    state of known texts is bounded.
    """
    rows = docs.select("doc_id", owner, redact(F.col("text")).alias("text"), esg_points(F.col("text")).alias("esg"), F.sha2("text", 256).alias("content_hash"), F.col("_metadata.file_modification_time").alias("arrived"))
    return rows.withWatermark("arrived", keep).dropDuplicatesWithinWatermark([owner, "content_hash"])


def running_esg(docs: DataFrame, owner: str = "source", keep: str = "30 days") -> DataFrame:
    """Number and mean sustainability points of an owner's texts so far, after each micro-batch with new ones."""
    new = ingest_documents(docs, owner, keep).select(F.coalesce(owner, F.lit("")).alias(owner), "esg")
    return P.stateful(new, owner, P.RunningMean(owner), f"{owner} string, n bigint, mean_esg double", timers=False)


def late_rows(events: DataFrame, watermark_s: int = 600, time: str = "ts") -> DataFrame:
    """Per micro-batch: rows, and those at or behind the watermark (the latest time of the batches before less ``watermark_s``).

    A feed with a watermark drops such rows from the next batch on; in the batch that moves the
    watermark they may still meet a window that it closes.  Each batch writes its row and the latest time so far; a batch that runs again replaces it.
    """
    spark = events.sparkSession
    base = scratch(spark, "late")
    schema = "batch bigint, n bigint, late bigint, high timestamp"

    def count(df: DataFrame, batch: int) -> None:
        before = spark.read.schema(schema).parquet(f"{base}/out").filter(F.col("batch") < batch).agg(F.max("high")).first()[0] if batch else None
        edge = F.lit(before).cast("timestamp") - F.make_interval(secs=F.lit(watermark_s))
        late = F.sum(F.coalesce(F.col(time) <= edge, F.lit(False)).cast("bigint"))
        row = df.agg(F.lit(batch).cast("bigint").alias("batch"), F.count(F.lit(1)).alias("n"), F.coalesce(late, F.lit(0)).alias("late"), F.greatest(F.max(time), F.lit(before).cast("timestamp")).alias("high"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{base}/out/part={batch}")

    run(events.writeStream.foreachBatch(count), base)
    return spark.read.schema(schema).parquet(f"{base}/out").select("batch", "n", "late")
