"""Operator 3: shards cut along a Hilbert curve over quantised metadata.

Each dimension is scaled between its least and greatest value to ``bits`` bits: integers
linearly, sizes by logarithm, strings by the bytes after the prefix that all share (so that
order is kept).  Rows are range-partitioned and sorted by curve index, and the global rank is
cut into runs whose counts differ by at most one (law ``rows``).  Nearby metadata thus falls in
the same files, and file statistics prune on every dimension at once.

Null metadata takes the lowest cell, null and empty texts have size 1 and checksum 0, very long
texts are measured whole.  Ties on the curve go by doc_id, checksum and size, null doc_ids first;
repeated rows take places of their own and may exchange them.  An empty table gives an empty
result; columns besides doc_id, text and the chosen dimensions are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, ship

ship(__name__)

BITS, SHARDS = 5, 16


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (one row per point), by Skilling's transpose method."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> b & 1)
    return index


def string_code(value: Column, prefix: int) -> Column:
    """The six bytes after the first ``prefix`` bytes as a number, which keeps the order of strings."""
    part = F.substring(F.encode(value, "UTF-8"), prefix + 1, 6)
    return F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("double")


def scaled(docs: DataFrame, dims: Sequence[str], bits: int) -> list[Column]:
    """A column of 0 to 2^bits - 1 for each dimension; one pass finds the ranges."""
    kinds = {f.name: f.dataType for f in docs.schema}
    bounds = docs.agg(*[f(F.col(d)).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = []
    for i, d in enumerate(dims):
        low, high = bounds[f"lo{i}"], bounds[f"hi{i}"]
        if low is None:
            cells.append(F.lit(0))
            continue
        value = F.col(d).cast("double")
        if isinstance(kinds[d], T.StringType):
            a, b = low.encode(), high.encode()
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            number = lambda s: float(int.from_bytes(s[same : same + 6].ljust(6, b"\0"), "big"))  # noqa: B023, E731
            value, low, high = string_code(F.col(d), same), number(a), number(b)
        width = float(high) - float(low)
        part = (value - F.lit(float(low))) / F.lit(width) if width else F.lit(0.0)
        cells.append(F.coalesce(F.least(F.floor(part * (1 << bits)), F.lit((1 << bits) - 1)), F.lit(0)).cast("int"))
    return cells


def sharded(docs: DataFrame, dims: Sequence[str] = ("source", "lang", "log_size", "doc_id"), shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint")
    own = [d for d in dims if d not in ("log_size", "doc_id")]
    rows = docs.select("doc_id", *own, size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows = rows.withColumn("log_size", F.log2("size"))
    cells = scaled(rows, dims, bits)

    @F.pandas_udf("bigint")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.column_stack(cells), bits))

    placed = rows.select("doc_id", "size", "text_crc32", curve(*cells).alias("curve"))
    rows, counts = ranked(placed, [], [F.col(c) for c in ("curve", "doc_id", "text_crc32", "size")], small_keys=True)
    total = (counts.first() or {"n": 0})["n"] or 0
    # shard s holds the ranks from s * total div shards on
    shard = F.expr(f"(rank * {shards} + {shards - 1}) div {max(total, 1)}").cast("int")
    begin = F.expr(f"({total}L * shard) div {shards}")
    out = rows.withColumn("shard", shard)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - begin).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
