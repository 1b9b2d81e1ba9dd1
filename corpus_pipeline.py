"""A training-data pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderlens.functions.storage import scratch
from tenderlens.llm.exact_dedup import drop_exact_copies
from tenderlens.llm.mixing import take_mix
from tenderlens.llm.packing import packed
from tenderlens.llm.queries import tokenizer
from tenderlens.llm.simhash import keep_one
from tenderlens.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the classifier learns from ``labels``."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the least doc_id stays."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document appears as often as the mix takes it."""
    return take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packed(docs, tokenizer())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("mix", mix), ("pack", pack)]

#: The stages are trained, iterated or packed; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet in the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
