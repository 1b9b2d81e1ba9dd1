"""File sources and sinks: JSON documents, file listings and CSV sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import scratch


def write_json_documents(docs: DataFrame) -> str:
    out = scratch(docs.sparkSession, "json")
    docs.write.json(out)
    return out


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents {text, file_path, engine_used, confidence} with declared defaults."""
    df = spark.read.schema("text string, file_path string, engine_used string, confidence double").json(path)
    return df.fillna({"engine_used": "OCR Engine Cascade", "confidence": 0.85})


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def comparative_sheet(rows: DataFrame) -> DataFrame:
    """The 13 columns of a comparative sheet, after tender_id and bid_id; rank is DQ for disqualified bids and - for unranked ones."""
    yes = lambda c: F.when(F.col(c), "Yes").otherwise("No")
    money = lambda c: F.round(F.col(c).cast("decimal(38,9)"), 4).cast("double")
    return rows.select(
        "tender_id", "bid_id", F.when(F.col("is_disqualified"), "DQ").otherwise(F.coalesce(F.col("rank").cast("string"), F.lit("-"))).alias("Rank"),
        F.col("vendor_name").alias("Vendor Name"), F.col("gem_reg_no").alias("GEM Reg No"), yes("msme").alias("MSME"), yes("make_in_india").alias("Make in India"),
        money("bid_amount").alias("Bid Amount"), money("taxes").alias("Taxes"), money("total_amount").alias("Total Amount"), money("technical").alias("Technical Score"),
        money("financial").alias("Financial Score"), money("composite").alias("Composite Score"), F.col("status").alias("Status"), F.col("disqualification_reason").alias("Disqualification Reason"),
    )


def csv_round_trip(df: DataFrame) -> DataFrame:
    out = scratch(df.sparkSession, "csv")
    df.write.csv(out, header=True)
    return df.sparkSession.read.schema(df.schema).csv(out, header=True)
