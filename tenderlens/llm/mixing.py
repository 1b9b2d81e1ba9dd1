"""Operator 4: mixing sources to target weights by fitting a subset-sum budget.

Sources, by code point and null last, weigh 5, 2, 1, repeating; their targets share all words
and stop at three times the source's size, the excess going to the others by weight.  A source
takes every document floor(target / size) times; for the remaining budget the number of
documents of each exact length is chosen: a proportional share of every length, rounded up or
down by a seeded offset along the lengths, and a bounded-knapsack dynamic program over the last
``grid`` words, which tries lengths in seeded order and finds the fullest reachable sum.  The documents of a length are then taken in seeded order.

Work per source is bounded by its distinct lengths, and the targets' windows hold one row per
source; documents get their seeded rank without gathering a source or a length in one task.

Null and empty texts have no words and take nothing; very long texts are counted whole and are
chosen like others, so a source of few long texts may stay below its target by less than its
shortest one.  Ties of the seed go by doc_id and checksum, null doc_ids first.  Repeated rows count
as rows: they share what is taken of them equally, what is left going to the first by their other
columns.  Reruns agree because the order depends on doc_id, text and seed only.  An empty table gives an
empty result; ``mixed`` ignores columns besides doc_id, text and source, and ``take_mix`` keeps them
all, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, durable, ranked, ship

ship(__name__)

WEIGHTS, MOST, GRID = (5.0, 2.0, 1.0), 3, 65_536


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, grid: int = GRID, seed: int = 7) -> np.ndarray:
    """How many documents of each distinct length to take, at most ``counts``, for a sum close to and not above ``budget``."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    rng = np.random.default_rng(seed)
    by = np.argsort(lengths, kind="stable")
    # shares rounded along the lengths: any run of lengths gets its share to within a document, so the sum errs by about the longest length
    ends = np.floor(np.cumsum(counts[by] * (max(0, budget - grid // 2) / total)) + rng.uniform()).astype(np.int64)
    take = np.zeros(len(lengths), np.int64)
    take[by] = np.minimum(counts[by], np.diff(ends, prepend=0))
    left = budget - int((lengths * take).sum())
    while left < 0:  # only where a document is longer than half the grid
        some = by[take[by] > 0]
        i = some[min(int(np.searchsorted(lengths[some], -left)), len(some) - 1)]
        take[i] -= 1
        left += int(lengths[i])
    order = by[::-1]
    while left > grid:  # as above: the longest first, in equal rounds, until the rest fits the program
        some = order[counts[order] > take[order]]
        some = some[lengths[some] <= left - grid // 2]
        fits = some[np.cumsum(lengths[some]) <= left - grid // 2]
        if not len(fits):  # only very long documents are left
            fits = order[(counts[order] > take[order]) & (lengths[order] <= left)][:1]
        if not len(fits):
            break
        take[fits] += 1
        left -= int(lengths[fits].sum())
    # bounded knapsack: pieces of 1, 2, 4, ... documents of a length, lengths in seeded order; first[s] is the piece that first reached s
    left_grid = min(left, 2 * grid)
    reach = np.zeros(left_grid + 1, bool)
    reach[0] = True
    first = np.full(left_grid + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    for i in by[rng.permutation(len(by))]:
        have = min(int(counts[i] - take[i]), left_grid // int(lengths[i]))
        size = 1
        while have > 0 and not reach[left_grid]:
            n = min(size, have)
            shift = n * int(lengths[i])
            new = np.zeros_like(reach)
            new[shift:] = reach[: left_grid + 1 - shift]
            new &= ~reach
            first[new] = len(pieces)
            reach |= new
            pieces.append((i, n))
            have -= n
            size *= 2
        if reach[left_grid]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = pieces[first[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def fit_source(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    return pdf.assign(chosen=fit(lengths, counts, int(pdf["budget"].iloc[0]), seed=seed))[["source_key", "size", "chosen"]]


def source_key() -> Column:
    """Sorts as the source by code point, null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_key, source_size) with target: the weight's share of all words, at most ``most`` times the source's."""
    every = W.orderBy("source_key")
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")))
    # sources by the level at which they are full; those below the common level are capped
    whole = W.partitionBy()
    order = W.orderBy(F.col("source_size") / F.col("w"), "source_key").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - before(most * F.col("source_size").cast("double"))) / (F.sum("w").over(whole) - before(F.col("w")))
    filled = weighed.select("*", level.alias("level"), (most * F.col("source_size") / F.col("w")).alias("full_at"))
    common = F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_key"))).over(whole)
    return filled.withColumn("target", F.least(common * F.col("w"), most * F.col("source_size").cast("double"))).select("source_key", "source_size", "target")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and the text's checksum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.crc32(text))
    rows = docs.select("doc_id", source_key().alias("source_key"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.crc32(text).alias("check"), order.alias("seeded"))
    rows, counts = ranked(rows, ["source_key", "size"], [F.col("seeded"), F.col("doc_id"), F.col("check")], small_keys=False)
    counts = durable(counts)
    goals = targets(counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    budget = F.round("target").cast("bigint")
    goals = durable(goals.withColumn("times", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(budget / F.col("source_size")))).otherwise(0)).withColumn("budget", budget - F.col("times") * F.col("source_size")))
    plan = counts.filter("size > 0").join(goals.filter("budget > 0").select("source_key", "budget"), "source_key")
    chosen = plan.groupBy("source_key").applyInPandas(lambda pdf: fit_source(pdf, seed), "source_key string, size bigint, chosen bigint")
    out = rows.join(durable(chosen), ["source_key", "size"], "left").join(goals, "source_key")
    extra = F.when(F.col("rank") < F.coalesce("chosen", F.lit(0)), 1).otherwise(0)
    taken = F.col("size") * (F.col("times") + extra)
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "check")


def take_mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken; documents without words are not in it."""
    plan = mixed(docs, **settings).filter("taken > 0").select(F.col("doc_id").alias("__mx_id"), F.col("check").alias("__mx_check"), (F.col("taken") / F.col("size")).cast("int").alias("__mx_n"))
    plan = plan.groupBy("__mx_id", "__mx_check").agg(F.sum("__mx_n").cast("int").alias("__mx_n"), F.count(F.lit(1)).alias("__mx_rows"))
    key = docs["doc_id"].eqNullSafe(F.col("__mx_id")) & (F.crc32(F.coalesce(docs["text"], F.lit(""))) == F.col("__mx_check"))
    rows = docs.join(plan, key)
    # repeated rows share one plan row; each takes an equal part, the first ones what is left
    whole = F.floor(F.col("__mx_n") / F.col("__mx_rows")).cast("int")
    alone = rows.filter("__mx_rows = 1").withColumn("__mx_take", F.col("__mx_n"))
    turn = F.row_number().over(W.partitionBy("__mx_id", "__mx_check").orderBy(F.to_json(F.struct(*docs.columns))))
    shared = rows.filter("__mx_rows > 1").withColumn("__mx_turn", turn).withColumn("__mx_take", whole + F.when(F.col("__mx_turn") <= F.col("__mx_n") % F.col("__mx_rows"), 1).otherwise(0)).drop("__mx_turn")
    both = alone.unionByName(shared).filter("__mx_take > 0")
    return both.withColumn("__mx_copy", F.explode(F.sequence(F.lit(1), F.col("__mx_take")))).select(*docs.columns)
