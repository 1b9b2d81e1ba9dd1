"""Shared helpers of the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import durable, partitions, ranked, small

__all__ = ["SPACES", "WORD", "durable", "id_text", "let", "partitions", "ranked", "ship", "slices", "small", "table"]

#: Whitespace of every contract here: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send the functions of ``module`` to Python workers by value, so that they need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes of ``column`` each, and one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a native stand-in for a local variable)."""
    return F.transform(F.array(value), body)[0]


def id_text(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
