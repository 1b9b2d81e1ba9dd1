"""Co-bidding graphs: edges, centrality, communities, components and fingerprints."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import durable, partitions, ranked, small, stored


#: Pairs of bidders that are listed at a time with their tenders, and that are counted at a time.
MOST, COUNTED = 1 << 22, 1 << 20


def bidders(bids: DataFrame) -> DataFrame:
    """(tender_id, vs): each tender's bidders in order, in ranges of tenders, since tenders of a range share bidders more than others do.

    A tender's bidders are at most all vendors, in one row.
    """
    d = bids.select("tender_id", "vendor_id").filter("tender_id is not null and vendor_id is not null").distinct()
    ranges = d.repartitionByRange(4 * partitions(d), "tender_id")
    return ranges.groupBy("tender_id").agg(F.array_sort(F.collect_list("vendor_id")).alias("vs"))


def met_pairs(vs: Sequence[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, a, b): of each array, by its place, the pairs of its values with the lesser first; about ``most`` at a time, in order of i."""
    held, size = [], 0
    for i, v in enumerate(vs):
        n = len(v)
        for low in range(0, n - 1, step := max(1, most // n)):  # a part of a very long array at a time
            x, y = np.triu_indices(min(step, n - 1 - low), 1, n - low)
            held.append((np.full(len(x), i), v[low + x], v[low + y]))
            size += len(x)
            if size >= most:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def first_met(tenders: int, most: int):
    """Batches (tender_id, vs) in order of tender_id to parts (a, b, shared, tenders) with the least ``tenders`` of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = batch.column("tender_id").to_numpy(zero_copy_only=False), batch.column("vs")
            ends, values = vs.offsets.to_numpy(), vs.values.to_numpy(zero_copy_only=False)
            for i, a, b in met_pairs([values[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], most):
                known, code = np.unique(np.concatenate([a, b]), return_inverse=True)
                key = code[: len(a)] * len(known) + code[len(a) :]
                order = np.argsort(key, kind="stable")  # tenders stay in order
                begin = np.flatnonzero(np.diff(key[order], prepend=-1))
                count = np.diff(begin, append=len(key))
                kept = np.minimum(count, tenders)
                to = np.cumsum(kept)
                met = ids[i[order[np.repeat(begin - to + kept, kept) + np.arange(to[-1])]]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], to)), pa.int32()), pa.array(met))
                yield pa.RecordBatch.from_arrays([pa.array(a[order[begin]]), pa.array(b[order[begin]]), pa.array(count), lists], ["a", "b", "shared", "tenders"])

    return run


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) with each pair once and its counts added up."""
    a, b, n = map(np.concatenate, zip(*parts, strict=True))
    if not len(a):
        return a, b, n
    whole = a.dtype.kind in "iu" and (low := min(a.min(), b.min())) > -(1 << 62) and (wide := int(max(a.max(), b.max())) - int(low) + 1) < 1 << 31
    if whole:
        x, y = (v.astype(np.int64) - low for v in (a, b))
    else:
        known, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, wide = code[: len(a)], code[len(a) :], len(known)
    key = x * wide + y
    order = np.argsort(key)
    begin = np.flatnonzero(np.diff(key[order], prepend=-1))
    first = order[begin]
    return a[first], b[first], np.add.reduceat(n[order], begin)


def pair_counts(most: int, least: int):
    """Batches (a, others) to rows (a, b, shared), one for each pair that is met ``least`` times; of the rest one row without vendors, shared being their number.

    All rows of a vendor ``a`` are in one task.  Pairs are counted when ``most`` have gathered, so that a
    task holds these and its distinct pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, held, waiting, size, bound = None, [], [], 0, most
        for batch in batches:
            a, vs = batch.column("a"), batch.column("others")
            kinds = a.type
            ends = vs.offsets.to_numpy()
            low = 0
            while low < batch.num_rows:  # about ``most`` pairs at a time, and one row at least
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + most, "right")) - 1)
                others = vs.values.to_numpy(zero_copy_only=False)[ends[low] : ends[high]]
                waiting.append((np.repeat(a.to_numpy(zero_copy_only=False)[low:high], np.diff(ends[low : high + 1])), others, np.ones(len(others), np.int64)))
                size, low = size + len(others), high
                if size >= bound:
                    held = [merged([*held, *waiting])]
                    waiting, size, bound = [], 0, max(most, len(held[0][0]))
        if held or waiting:
            a, b, n = merged([*held, *waiting])
            strong = n >= least
            rest = int((~strong).sum())
            for at in range(0, int(strong.sum()), 1 << 16):
                cut = np.flatnonzero(strong)[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(a[cut], kinds), pa.array(b[cut], kinds), pa.array(n[cut])], ["a", "b", "shared"])
            if rest:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds), pa.nulls(1, kinds), pa.array([rest], pa.int64())], ["a", "b", "shared"])

    return run


def counted(sent: DataFrame, meetings: int, least: int = 1, most: int = COUNTED) -> DataFrame:
    """Rows (a, others) to the counts of ``pair_counts``.

    Tasks have about twice ``most`` meetings each, so that their number grows with the meetings and their memory does not.
    """
    kind = dict(sent.dtypes)["a"]
    dealt = sent.repartition(max(partitions(sent), meetings // (2 * most) + 1), "a")
    return dealt.mapInArrow(pair_counts(most, least), f"a {kind}, b {kind}, shared bigint")


def counted_pairs(bids: DataFrame, least: int = 1, most: int = COUNTED) -> DataFrame:
    """(a, b, shared) for vendors a < b with ``least`` tenders in common; for ``least`` 2 also rows without vendors, whose shared adds up to the number of pairs met once.

    Each bidder is sent once for each of its tenders, with the bidders after it, to the task that counts
    its pairs; no meeting is a row.
    """
    met = stored(bidders(bids))
    n = F.size("vs").cast("bigint")
    meetings = int(met.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0)
    sent = met.select("vs", F.posexplode("vs").alias("i", "a")).select("a", F.slice("vs", F.col("i") + 2, F.size("vs")).alias("others")).filter(F.size("others") > 0)
    return counted(sent, meetings, least, most)


def co_bids(bids: DataFrame, tenders: int = 0, most: int = MOST) -> DataFrame:
    """(a, b, shared) for vendors a < b that bid on the same tenders; with the least ``tenders`` of these, if that many are asked for.

    Quadratic in the bidders of a tender, which ``pair_load`` reports.  With tenders, pairs are counted where
    their tenders lie, and only the counts of a range of tenders are shuffled.
    """
    if not tenders:
        return counted_pairs(bids, 1, min(most, COUNTED))
    kinds = dict(bids.dtypes)
    schema = f"a {kinds['vendor_id']}, b {kinds['vendor_id']}, shared bigint, tenders array<{kinds['tender_id']}>"
    parts = bidders(bids).sortWithinPartitions("tender_id").mapInArrow(first_met(tenders, most), schema)
    found = parts.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.array_sort(F.flatten(F.collect_list("tenders"))).alias("tenders"))
    return found.withColumn("tenders", F.slice("tenders", 1, tenders))


def pair_load(bids: DataFrame, top: int = 10) -> DataFrame:
    """The tenders with the most bidders, and how many pairs of bidders each makes."""
    n = bids.groupBy("tender_id").agg(F.count_distinct("vendor_id").alias("bidders"))
    return n.withColumn("pairs", (F.col("bidders") * (F.col("bidders") - 1) / 2).cast("bigint")).orderBy(F.desc("bidders"), "tender_id").limit(top)


def strong_edges(bids: DataFrame, deviations: float = 1.5, most: int = COUNTED) -> DataFrame:
    """(a, b, shared) of the pairs of vendors whose count is above mean + ``deviations`` standard deviations of all pairs that have met.

    The mean is 1 at least, so that a pair that has met once is never above it: such pairs are counted,
    not written.  The bar is found in whole numbers from the number of pairs and their sums.
    """
    pairs = stored(counted_pairs(bids, 2, most))
    once, x = F.col("a").isNull(), F.col("shared")
    n, total, squares = (int(v or 0) for v in pairs.agg(F.sum(F.when(once, x).otherwise(1)), F.sum("shared"), F.sum(F.when(once, x).otherwise(x * x).cast("decimal(38,0)"))).first())
    d = Fraction(deviations)
    above = math.isqrt(d.numerator**2 * max(0, n * squares - total**2)) + 1  # of d.numerator standard deviations times n
    bar = -(-(total * d.denominator + above) // (max(n, 1) * d.denominator))
    return pairs.filter(F.col("a").isNotNull() & (x >= F.lit(bar)))


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """Each edge from both of its ends; the edges are read once."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
    return edges.select(ends.alias("e"), *keep).select("e.node", "e.other", *keep)


#: Edges that a task of ``stars`` holds.
EDGES = 1 << 20


def stars(most: int):
    """Batches of edges (a, b) to edges (a, b) that connect the same nodes: each node of a task's edges with one node of its part.

    A task joins ``most`` edges at a time with the stars so far, and gives these away when they are that many.
    """

    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        a, b = map(np.concatenate, zip(*parts, strict=True))
        known, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, label = code[: len(a)], code[len(a) :], np.arange(len(known))
        while (apart := label[x] != label[y]).any():
            x, y = x[apart], y[apart]
            u, v = label[x], label[y]
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))  # roots only
            while (label != (up := label[label])).any():
                label = up
        leaf = np.flatnonzero(label != np.arange(len(known)))
        return known[leaf], known[label[leaf]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kind = [], 0, None
        for batch in batches:
            kind = batch.column("a").type
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in "ab"))
                size += batch.num_rows
            if size >= 2 * most:
                held = [joined(held)]
                size = len(held[0][0])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in held[0]], ["a", "b"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in joined(held)], ["a", "b"])

    return run


def components(edges: DataFrame, rounds: int = 50, most: int = EDGES) -> DataFrame:
    """(node, component): the least node reachable, by large-star and small-star rounds over what ``stars`` leaves of the edges (a, b)."""
    kind = dict(edges.dtypes)["a"]
    few = edges.filter("a != b").select("a", "b").mapInArrow(stars(most), f"a {kind}, b {kind}")
    pairs = stored(few.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = durable(small.filter("u != v").distinct())
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = now
    raise RuntimeError("components did not settle")


def eigenvector(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, centrality) by power iteration over weighted edges (a, b, shared); each round is written once."""
    e = stored(both_ways(edges, "shared"))
    v = durable(e.select("node").distinct().withColumn("x", F.lit(1.0)))
    for _ in range(rounds):
        nxt = durable(e.join(small(v).withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum(F.col("shared") * F.col("x")).alias("x")))
        norm = nxt.agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
        v = nxt.crossJoin(F.broadcast(norm)).select("node", (F.col("x") / F.col("norm")).alias("x"))  # one row
    return v.withColumnRenamed("x", "centrality")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): each node takes the label of the greatest weight among its neighbours and itself, ties to the least; each round is written once."""
    e = stored(both_ways(edges, "shared"))
    labels = durable(e.select("node").distinct().withColumn("community", F.col("node")))
    for _ in range(rounds):
        votes = e.join(small(labels.select(F.col("node").alias("other"), "community")), "other").select("node", "community", "shared")
        own = labels.select("node", "community", F.lit(1).cast("bigint").alias("shared"))
        tally = votes.unionByName(own).groupBy("node", "community").agg(F.sum("shared").alias("w"))
        labels = durable(tally.groupBy("node").agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("community")))
    return labels


#: Numbers of a matrix of sources by nodes, or of a part of the graph, that a task of ``betweenness`` holds.
HELD = 1 << 20


def path_steps(n: int, size: int, chunk: int, level: int, back: bool):
    """Rows (s, chunk, us, vs, dist, paths, loads) in order, a block's state (chunk -1) before the parts of the graph that it needs, to the states one level on.

    dist (-1: not reached), paths and loads are matrices of a block's sources by all nodes.  Forward, the nodes
    at ``level`` pass their paths on to their neighbours; back, their dependencies.  ``next`` has the parts
    of the graph that the next level needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None

        def done() -> pa.RecordBatch:
            s, dist, paths, loads, _, got = own
            if back:
                at = dist == level - 1
                loads[at] = (paths * got)[at]
            else:
                at = (dist < 0) & (got > 0)
                dist[at], paths[at] = level + 1, got[at]
            parts = np.unique(np.flatnonzero(at.any(axis=0)) // chunk).astype(np.int32)
            return pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "dist": [dist.tobytes()], "paths": [paths.tobytes()], "loads": [loads.tobytes()], "next": pa.array([parts], pa.list_(pa.int32()))})

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("s", "chunk", "us", "vs", "dist", "paths", "loads")}
                if row["chunk"].as_py() < 0:
                    if own is not None:
                        yield done()
                    dist, paths, loads = (np.frombuffer(row[c].as_buffer(), t).reshape(-1, n).copy() for c, t in (("dist", np.int32), ("paths", float), ("loads", float)))
                    at = dist == level
                    sent = np.where(at, (1 + loads) / np.where(at, paths, 1) if back else paths, 0.0)
                    own = (row["s"].as_py(), dist, paths, loads, sent, np.zeros(dist.shape))
                    continue
                us, vs = (row[c].values.to_numpy() for c in ("us", "vs"))
                from_, x = np.unique(us, return_inverse=True)
                to, y = np.unique(vs, return_inverse=True)
                some = np.flatnonzero(own[4][:, from_].any(axis=1))  # sources that have come here
                part = np.zeros((len(from_), len(to)))
                part[x, y] = 1
                own[5][np.ix_(some, to)] += own[4][np.ix_(some, from_)] @ part
        if own is not None:
            yield done()

    return run


def level_loads(edges: DataFrame, named: DataFrame, block: int = 1024) -> DataFrame:
    """(node, load): the dependencies of all sources on the nodes (node, component), over edges (node, other) from both ends, in blocks of at most ``block`` sources.

    The graph is cut in parts of some nodes with their edges; a block of sources is a matrix of sources by nodes.
    All blocks go a level on at a time, forward and then back: a task reads its block's matrices and
    then, one after another, the parts of the graph that its nodes at this level lie in, and multiplies.  It holds
    ``HELD`` numbers or so of each; blocks have one source at least.  The work is that of sources times edges.
    """
    e = stored(edges)
    ranks, _ = ranked(named, [], [F.col("component"), F.col("node")], small_keys=True)
    ranks = durable(ranks.select("node", F.col("rank").cast("int").alias("rank")))
    n = ranks.count()
    size = max(1, min(block, HELD // n))
    chunk = max(1, min(1024, HELD // n))
    coded = e.join(small(ranks).toDF("node", "u"), "node").join(small(ranks).toDF("other", "v"), "other")
    parts = stored(coded.groupBy(F.floor(F.col("u") / chunk).cast("int").alias("chunk")).agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs")))
    fields = "s int, dist binary, paths binary, loads binary, next array<int>"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column("s").to_pylist():
                low, high = s * size, min(n, (s + 1) * size)
                own = np.eye(high - low, n, low)
                need = np.arange(low // chunk, (high - 1) // chunk + 1, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "dist": [(own - 1).astype(np.int32).tobytes()], "paths": [own.tobytes()], "loads": [np.zeros(own.shape).tobytes()], "next": pa.array([need], pa.list_(pa.int32()))})

    blocks = -(-n // size)
    tasks = max(partitions(edges), blocks // 4)  # a few blocks each
    none = F.array().cast("array<int>")
    empty = F.lit(None).cast("binary")

    def step(states: DataFrame, level: int, back: bool) -> DataFrame:
        need = states.select("s", F.explode("next").alias("chunk")).join(parts, "chunk").select("s", "chunk", "us", "vs", empty.alias("dist"), empty.alias("paths"), empty.alias("loads"))
        rows = states.select("s", F.lit(-1).alias("chunk"), none.alias("us"), none.alias("vs"), "dist", "paths", "loads").unionByName(need)
        return stored(rows.repartition(tasks, "s").sortWithinPartitions("s", "chunk").mapInArrow(path_steps(n, size, chunk, level, back), fields))

    level = 0
    states = stored(edges.sparkSession.range(0, blocks, 1, tasks).select(F.col("id").cast("int").alias("s")).mapInArrow(first, fields))
    while not states.filter(F.size("next") > 0).isEmpty():
        states, level = step(states, level, False), level + 1
    level -= 1  # the last level that has nodes
    states = states.select("s", "dist", "paths", "loads", F.sequence(F.lit(0), F.lit((n - 1) // chunk)).alias("next")) if level > 1 else states
    for at in range(level, 1, -1):
        states = step(states, at, True)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dist, loads = (np.frombuffer(batch.column(c)[i].as_buffer(), t).reshape(-1, n) for c, t in (("dist", np.int32), ("loads", float)))
                total = np.where(dist > 0, loads, 0.0).sum(axis=0)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"rank": pa.array(at, pa.int32()), "load": pa.array(total[at])})

    loads = states.select("dist", "loads").mapInArrow(summed, "rank int, load double").groupBy("rank").agg(F.sum("load").alias("load"))
    return ranks.join(loads, "rank").select("node", "load")


#: Most nodes and edges of a component whose paths a task follows alone.
ALONE, ALONE_EDGES = 4096, 1 << 20


def whole_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (nodes, us, vs, low, high), a component with the sources of a block, to the dependencies (node, load) of its nodes on these sources."""
    for batch in batches:
        for i in range(batch.num_rows):
            nodes, us, vs = (batch.column(c)[i].values for c in ("nodes", "us", "vs"))
            low, high, n = batch.column("low")[i].as_py(), batch.column("high")[i].as_py(), len(nodes)
            us, vs = us.to_numpy(), vs.to_numpy()
            order = np.argsort(us, kind="stable")
            us, vs = us[order], vs[order]
            step = max(1, HELD // n)
            cuts = np.searchsorted(us, np.arange(0, n + step, step))

            def passed(sent: np.ndarray) -> np.ndarray:
                got = np.zeros(sent.shape)
                for j, at in enumerate(range(0, n, step)):  # noqa: B023
                    here = sent[:, at : at + step]  # noqa: B023
                    if here.any():
                        part = np.zeros((here.shape[1], n))  # noqa: B023
                        some = slice(cuts[j], cuts[j + 1])  # noqa: B023
                        part[us[some] - at, vs[some]] = 1  # noqa: B023
                        got += here @ part
                return got

            paths = np.eye(high - low, n, low)
            dist, loads, level = (paths - 1).astype(np.int32), np.zeros(paths.shape), 0
            while (at := (dist < 0) & ((got := passed(np.where(dist == level, paths, 0.0))) > 0)).any():
                level += 1
                dist[at], paths[at] = level, got[at]
            for back in range(level, 1, -1):
                here = dist == back
                got = passed(np.where(here, (1 + loads) / np.where(here, paths, 1), 0.0))
                at = dist == back - 1
                loads[at] = (paths * got)[at]
            yield pa.RecordBatch.from_arrays([nodes, pa.array(np.where(dist > 0, loads, 0.0).sum(axis=0))], ["node", "load"])


def named_parts(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (node, other) that are given from both ends."""
    ways = edges.select(F.col("node").alias("a"), F.col("other").alias("b")).filter("a > b")
    return durable(edges.select("node").distinct().join(components(ways), "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def betweenness(edges: DataFrame, block: int = 1024, alone: int = ALONE) -> DataFrame:
    """(node, betweenness), exact, over unweighted shortest paths.

    Paths stay within a component.  One of at most ``alone`` nodes and a bounded number of edges is sent once for each
    block of its sources to a task that follows all paths from these; larger ones go by ``level_loads``.
    """
    e = stored(both_ways(edges).distinct())
    named = named_parts(e)
    n = named.count()
    if n < 3:
        return named.select("node", F.lit(0.0).alias("betweenness"))
    kind = dict(named.dtypes)["node"]
    placed = e.join(small(named), "node")
    sizes = placed.groupBy("component").agg(F.count_distinct("node").alias("n"), F.count(F.lit(1)).alias("m"))
    few = durable(sizes.filter((F.col("n") <= alone) & (F.col("m") <= ALONE_EDGES)).select("component", "n"))
    lists = durable(named.join(small(few.select("component")), "component").groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("nodes")))
    at = durable(lists.select("component", F.posexplode("nodes").alias("i", "node")).select("node", "i"))
    coded = placed.join(small(at).toDF("node", "u"), "node").join(small(at).toDF("other", "v"), "other")
    ways = coded.groupBy("component").agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(HELD) / F.size("nodes")))).cast("int")
    rows = lists.join(ways, "component").withColumn("size", size).withColumn("low", F.explode(F.sequence(F.lit(0), F.size("nodes") - 1, F.col("size"))))
    rows = rows.select("component", "nodes", "us", "vs", "low", F.least(F.size("nodes"), F.col("low") + F.col("size")).alias("high"))
    loads = rows.repartition(4 * partitions(e), "component", "low").mapInArrow(whole_paths, f"node {kind}, load double").groupBy("node").agg(F.sum("load").alias("load"))
    large = named.join(few, "component", "left_anti")
    if not large.isEmpty():
        loads = loads.unionByName(level_loads(placed.join(few, "component", "left_anti").select("node", "other"), large, block))
    scale = 1.0 / ((n - 1) * (n - 2))  # each unordered pair is seen from both ends
    return named.join(loads, "node", "left").select("node", (F.coalesce("load", F.lit(0.0)) * scale).alias("betweenness"))


def shared_attributes(rows: DataFrame, key: str, points: dict[str, int], critical: int, warning: int) -> DataFrame:
    """Per key: links (other keys that share an attribute), how many of these reach ``critical`` and ``warning`` points, the most points, and the verdict.

    Keys that agree on each set of attributes are counted, one row per key and set; how many
    share exactly a set follows by inclusion and exclusion.  Pairs are never written, so an
    attribute that very many keys share costs no more than others.
    """
    kinds = list(points)
    sets = range(1, 1 << len(kinds))
    inside = lambda m: [k for i, k in enumerate(kinds) if m >> i & 1]
    known = lambda m: reduce(lambda a, c: a & c, [F.col(k).isNotNull() for k in inside(m)])
    keyed = F.array_compact(F.array(*[F.when(known(m), F.struct(F.lit(m).alias("m"), F.xxhash64(F.lit(m), *inside(m)).alias("v"))) for m in sets]))
    long = rows.select(key, F.explode(keyed).alias("x")).select(key, "x.m", "x.v")
    sized = long.join(long.groupBy("m", "v").agg((F.count(F.lit(1)) - 1).alias("n")), ["m", "v"])
    wide = sized.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("m") == m, F.col("n"))), F.lit(0)).alias(f"n{m}") for m in sets])
    exactly = {m: sum(((-1) ** ((t ^ m).bit_count()) * F.col(f"n{t}") for t in sets if t & m == m), F.lit(0)) for m in sets}
    worth = {m: sum(points[k] for k in inside(m)) for m in sets}
    total = lambda test: F.coalesce(sum((exactly[m] for m in sets if test(worth[m])), F.lit(0)), F.lit(0)).cast("bigint")
    strongest = F.coalesce(F.greatest(F.lit(0), *[F.when(exactly[m] > 0, worth[m]).otherwise(0) for m in sets]), F.lit(0)).cast("bigint")
    out = rows.select(key).join(wide, key, "left").select(
        key, total(lambda w: w > 0).alias("links"), total(lambda w: w >= critical).alias("critical"), total(lambda w: warning <= w < critical).alias("warning"), strongest.alias("strongest"),
    )
    return out.withColumn("verdict", F.when(F.col("strongest") >= critical, "CRITICAL").when(F.col("strongest") >= warning, "WARNING").otherwise("CLEAR"))


#: Points of what two vendors share (fixed values), and mail domains that anyone may have.
COLLUSION = {"ip": 4, "subnet": 2, "domain": 3, "device": 2, "distance": 4, "directors": 4, "address": 4, "phone": 3, "style": 3}
FREE_MAIL = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com")
METRES = 111_000  # of a degree


def same_style(x: Column, y: Column, ttr: float = 0.05, sentence: float = 3.0, rates: float = 1.5) -> Column:
    """Some kind of document in both maps of ``text.styles`` whose means differ by less than the bounds."""
    apart = lambda u, v: F.aggregate(F.zip_with(u["rates"], v["rates"], lambda i, j: F.abs(i - j)), F.lit(0.0), lambda s, d: s + d)
    near = lambda u, v: (F.abs(u["ttr"] - v["ttr"]) < ttr) & (F.abs(u["sentence"] - v["sentence"]) < sentence) & (apart(u, v) < rates)
    return F.exists(F.map_keys(x), lambda k: F.coalesce(near(F.try_element_at(x, k), F.try_element_at(y, k)), F.lit(False)))


def collusion(pairs: DataFrame, vendors: DataFrame, key: str = "vendor_id", points: dict[str, int] = COLLUSION, metres: float = 100.0, free: Sequence[str] = FREE_MAIL) -> DataFrame:
    """The pairs (a, b, ...) with what both vendors share: score, signals in the order of ``points``, distance_m and level (high from 5, medium from 2).

    ``vendors`` has ``key`` and any of ip, email, device, lat and lon, directors (array), address,
    phone and style (of ``text.styles``); signals whose column is absent don't fire, nor do nulls.
    A subnet (the first three parts of ip) counts only where the whole ip differs.  Attributes are
    looked up for the pairs that exist; no pair is made from an attribute.
    """
    have = [c for c in vendors.columns if c != key]
    vendors = small(durable(vendors))  # a row per vendor, so that pairs need not move
    own = lambda x: vendors.select(F.col(key).alias(x), F.struct(*have).alias(f"{x}_own"))
    a, b = (lambda c: F.col(f"a_own.{c}")), (lambda c: F.col(f"b_own.{c}"))
    equal = lambda f: f(a) == f(b)
    domain = lambda x: F.lower(F.when(F.contains(x("email"), F.lit("@")), F.split_part(x("email"), F.lit("@"), F.lit(2))).otherwise(x("email")))
    tests: dict[str, Column] = {}
    if "ip" in have:
        tests["ip"] = equal(lambda x: x("ip"))
        tests["subnet"] = (a("ip") != b("ip")) & equal(lambda x: F.substring_index(x("ip"), ".", 3))
    if "email" in have:
        tests["domain"] = equal(domain) & ~domain(a).isin(*free)
    distance = F.lit(None).cast("double")
    if {"lat", "lon"} <= set(have):
        north, east = (a("lat") - b("lat")) * METRES, (a("lon") - b("lon")) * METRES * F.cos(F.radians(a("lat")))
        distance = F.sqrt(north * north + east * east)
        tests["distance"] = distance < metres
    if "directors" in have:
        tests["directors"] = F.arrays_overlap(a("directors"), b("directors"))
    if "style" in have:
        tests["style"] = same_style(a("style"), b("style"))
    tests |= {c: equal(lambda x, c=c: x(c)) for c in ("device", "address", "phone") if c in have}
    fires = {k: F.coalesce(tests[k], F.lit(False)) for k in points if k in tests}
    marked = pairs.join(own("a"), "a").join(own("b"), "b").select(*pairs.columns, F.array_compact(F.array(*[F.when(t, k) for k, t in fires.items()], F.lit(None).cast("string"))).alias("hits"), distance.alias("distance_m"))
    score = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, k: s + F.element_at(F.create_map(*[F.lit(v) for kv in points.items() for v in kv]), k))
    out = marked.withColumn("score", score)
    level = F.when(F.col("score") >= 5, "high").when(F.col("score") >= 2, "medium").otherwise("low")
    return out.select(*pairs.columns, "score", F.array_join("hits", ",").alias("signals"), "distance_m", level.alias("level"))


def grid_cells(points: DataFrame, key: str, x: str, y: str, eps: float) -> tuple[DataFrame, DataFrame]:
    """(k, root) of each point that is not the least of its cell, and the edges (a, b) between the least points of cells, which connect points as all pairs within ``eps`` would; cells have the side eps / sqrt 2.

    Points of a cell are within eps of each other.  Neighbouring cells are
    first compared by at most eight outermost points each: a close pair among these joins the
    cells, and cells whose bounding boxes are further apart than eps cannot touch.  Only cell
    pairs that this leaves open (as a rule thin ones) compare all their points.
    """
    side = eps / 2**0.5
    cells = points.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), F.floor(F.col(x) / side).alias("cx"), F.floor(F.col(y) / side).alias("cy"))
    cells = stored(cells)
    p = F.struct("k", "x", "y")
    outer = [f(p, F.col("x") * i + F.col("y") * j) for i, j in ((1, 0), (0, 1), (1, 1), (1, -1)) for f in (F.min_by, F.max_by)]
    own = durable(cells.groupBy("cx", "cy").agg(F.min("k").alias("root"), F.array_distinct(F.array(*outer)).alias("ps"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    within = cells.join(small(own.select("cx", "cy", "root")), ["cx", "cy"]).filter("k != root").select("k", "root")  # one row for each cell
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0) and abs(dx) + abs(dy) < 4])).alias("d")
    left = own.select("*", steps).select((F.col("cx") + F.col("d.dx")).alias("nx"), (F.col("cy") + F.col("d.dy")).alias("ny"), *[F.col(c).alias(f"a_{c}") for c in own.columns])
    right = own.select(*[F.col(c).alias(f"b_{c}") for c in own.columns])
    both = left.join(right, (F.col("nx") == F.col("b_cx")) & (F.col("ny") == F.col("b_cy")))
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"))
    close = lambda u, v: (u["x"] - v["x"]) * (u["x"] - v["x"]) + (u["y"] - v["y"]) * (u["y"] - v["y"]) <= eps * eps
    met = F.exists("a_ps", lambda u: F.exists("b_ps", lambda v: close(u, v)))
    both = durable(both.filter(gap("x") * gap("x") + gap("y") * gap("y") <= eps * eps).withColumn("met", met))
    joined = both.filter("met").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    open_ = both.filter("not met").select("a_cx", "a_cy", "b_cx", "b_cy", "a_root", "b_root", *[f"{n}_{c}{i}" for n in "ab" for c in "xy" for i in "01"])

    def near(name: str, other: str) -> DataFrame:
        """The places of the cell ``name`` of each open pair that reach the other cell's box, once each."""
        away = lambda c: F.greatest(F.lit(0.0), F.col(f"{other}_{c}0") - F.col(c), F.col(c) - F.col(f"{other}_{c}1"))
        met = cells.select(F.col("cx").alias(f"{name}_cx"), F.col("cy").alias(f"{name}_cy"), "x", "y").join(small(open_), [f"{name}_cx", f"{name}_cy"])
        met = met.filter(away("x") * away("x") + away("y") * away("y") <= eps * eps * (1 + 1e-9))
        return met.select("a_root", "b_root", "x", "y").distinct().select("a_root", "b_root", F.struct("x", "y").alias(f"{name}_p"))

    full = near("a", "b").join(near("b", "a"), ["a_root", "b_root"]).filter(close(F.col("a_p"), F.col("b_p")))
    return within, joined.unionByName(full.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())


def grid_edges(points: DataFrame, key: str, x: str, y: str, eps: float) -> DataFrame:
    """Edges (a, b) that connect points as all pairs within ``eps`` would."""
    within, edges = grid_cells(points, key, x, y, eps)
    return edges.unionByName(within.select(F.col("root").alias("a"), F.col("k").alias("b")))


def grid_components(points: DataFrame, key: str, x: str, y: str, eps: float) -> DataFrame:
    """(node, component) as ``components`` of ``grid_edges``, whose rounds here run over cells, not points."""
    within, edges = grid_cells(points, key, x, y, eps)
    roots = durable(components(edges)).toDF("root", "component")
    filled = within.select("root").distinct()
    named = durable(filled.join(roots, "root", "full").select("root", F.coalesce("component", "root").alias("component")))
    return within.join(small(named), "root").select(F.col("k").alias("node"), "component").unionByName(named.withColumnRenamed("root", "node"))


#: Cells along a radius, and points of a block, of ``neighbour_counts``.
CELLS, BLOCK = 16, 1 << 17


def near_on_lines(qx: np.ndarray, qy: np.ndarray, dx: np.ndarray, dy: np.ndarray, n: np.ndarray, eps: float) -> np.ndarray:
    """For each point q the number of points d within ``eps``, d being distinct and ``n`` times there, found by bisection on each line of equal y.

    The bounds of a line are set right by the distance itself, as rounding may put them a point off.
    """
    order = np.lexsort((dx, dy))
    dx, dy, before = dx[order], dy[order], np.concatenate(([0], np.cumsum(n[order])))
    ys, start = np.unique(dy, return_index=True)
    end = np.append(start[1:], len(dy))
    by_line = np.lexsort((qx, qy))
    out = np.zeros(len(qx), np.int64)
    for some in np.split(by_line, np.flatnonzero(np.diff(qy[by_line])) + 1):
        xs, y = qx[some], qy[some[0]]
        rise = (y - ys) ** 2
        for j in np.flatnonzero(rise <= eps * eps):
            low, high = span_on_line(xs, dx[start[j] : end[j]], rise[j], eps)
            out[some] += before[start[j] + high] - before[start[j] + low]
    return out


def span_on_line(xs: np.ndarray, line: np.ndarray, rise: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """For each x the first place in ``line`` (distinct, in order) that lies within ``eps``, and the place after the last; ``rise`` is the square of the distance of the lines."""
    near = lambda i: (i >= 0) & (i < len(line)) & ((xs - line[np.clip(i, 0, len(line) - 1)]) ** 2 + rise <= eps * eps)
    wide = np.sqrt(max(eps * eps - rise, 0.0))
    low, high = np.searchsorted(line, xs - wide, "left"), np.searchsorted(line, xs + wide, "right")
    while (more := near(low - 1)).any():
        low = low - more
    while (less := (low < high) & ~near(low)).any():
        low = low + less
    while (more := near(high)).any():
        high = high + more
    while (less := (low < high) & ~near(high - 1)).any():
        high = high - less
    return low, high


#: Points of which ``line_runs`` makes runs at a time, and those of a tile that a task asks for.
RUNS, ASKED = 1 << 18, 1 << 21


def line_runs(eps: float, side: float, parts: dict[tuple[int, int], int], most: int):
    """Batches of points (k, x, y) to runs (tx, ty, part, y, ks, xs): the points of a line in a tile with their keys, for one part of the tile; and the xs of those in reach of the tiles around and of the tile itself, for all parts of it."""

    def runs(k: np.ndarray, x: np.ndarray, y: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        tx, ty = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
        order = np.lexsort((x, tx, y))
        k, x, y, tx, ty = (a[order] for a in (k, x, y, tx, ty))
        begin = np.flatnonzero((np.diff(tx, prepend=tx[0] - 1) != 0) | (np.diff(y, prepend=np.nan) != 0))
        rows: list[tuple[int, int, int, float, int, int, bool]] = []
        for a, b in zip(begin, np.append(begin[1:], len(x)), strict=True):
            at = int(tx[a]), int(ty[a])
            rows.append((*at, hash(float(y[a])) % parts.get(at, 1), y[a], a, b, True))
            for j in (-1, 0, 1):
                away = max(0.0, (at[1] + j) * side - y[a], y[a] - (at[1] + j + 1) * side)
                if away > eps * (1 + 1e-9):
                    continue
                reach = np.sqrt(max(eps * eps - away * away, 0.0)) + 1e-9 * (eps + abs(x[a]) + abs(x[b - 1]) + abs(y[a]))
                for i in (-1, 0, 1):
                    left, right = (at[0] + i) * side - reach, (at[0] + i + 1) * side + reach
                    u, v = a + np.searchsorted(x[a:b], left, "left"), a + np.searchsorted(x[a:b], right, "right")
                    if u < v:
                        to = at[0] + i, at[1] + j
                        rows += [(*to, part, y[a], u, v, False) for part in range(parts.get(to, 1))]
        own = [r[6] for r in rows]
        place = [np.arange(r[4], r[5]) for r in rows]
        ends = np.concatenate(([0], np.cumsum([len(i) for i in place]))).astype(np.int32)
        keys = np.concatenate(([0], np.cumsum([len(i) if o else 0 for i, o in zip(place, own, strict=True)]))).astype(np.int32)
        asked = np.concatenate([i for i, o in zip(place, own, strict=True) if o])
        ks = pa.ListArray.from_arrays(pa.array(keys), pa.array(k[asked], kind))
        xs = pa.ListArray.from_arrays(pa.array(ends), pa.array(x[np.concatenate(place)]))
        heads = [pa.array([r[c] for r in rows], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()), (3, pa.float64()))]
        return pa.RecordBatch.from_arrays([*heads, pa.array(own), ks, xs], ["tx", "ty", "part", "y", "asks", "ks", "xs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in "kxy"])
                size += batch.num_rows
            if size >= most:
                yield runs(*map(np.concatenate, zip(*held, strict=True)), batch.column("k").type)
                held, size = [], 0
        if held:
            yield runs(*map(np.concatenate, zip(*held, strict=True)), batch.column("k").type)

    return run


def line_links(eps: float):
    """Runs of ``line_runs`` in the order of tile, part, asked ones first, and line, to (k, links); a task holds what a part asks for, and one line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asks, links, line, at, kind = None, {}, {}, [], None, None

        def met() -> None:
            """The line is counted for all asked lines in reach."""
            places, n = np.unique(np.concatenate(line), return_counts=True)
            before = np.concatenate(([0], np.cumsum(n)))
            for y, (_, xs) in asks.items():
                if (rise := (y - at) ** 2) <= eps * eps:
                    low, high = span_on_line(xs, places, rise, eps)
                    links[y] += before[high] - before[low]

        def told() -> Iterator[pa.RecordBatch]:
            for y, (ks, _) in asks.items():
                for i in range(0, len(ks), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(ks[i : i + (1 << 16)], kind), pa.array(links[y][i : i + (1 << 16)] - 1)], ["k", "links"])  # itself is not counted

        for batch in batches:
            kind = batch.column("ks").type.value_type
            heads = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tx", "ty", "part", "y", "asks")]
            for i, (tx, ty, part, y, asking) in enumerate(zip(*heads, strict=True)):
                if line and (asking or y != at or (tx, ty, part) != tile):
                    met()
                    line = []
                if (tx, ty, part) != tile:
                    yield from told()
                    tile, asks, links = (tx, ty, part), {}, {}
                xs = batch.column("xs")[i].values.to_numpy()
                if asking:
                    asks.setdefault(y, []).append((batch.column("ks")[i].values.to_numpy(zero_copy_only=False), xs))
                    continue
                if not links:
                    for known, runs in asks.items():
                        ks, own = (np.concatenate(c) for c in zip(*runs, strict=True))
                        order = np.argsort(own, kind="stable")
                        asks[known], links[known] = (ks[order], own[order]), np.zeros(len(own), np.int64)
                if asks:
                    line, at = [*line, xs], y
        if line:
            met()
        yield from told()

    return run


def line_counts(points: DataFrame, eps: float, side: float, asked: int = ASKED, most: int = RUNS) -> DataFrame:
    """(k, links) of points (k, x, y) on few lines of equal y, as ``neighbour_counts``: no run of a line is compared point by point, and a point is shuffled once for each tile in reach.

    Tiles of more than ``asked`` points are asked for in parts, by line.
    """
    tiles = points.groupBy(F.floor(F.col("x") / side).alias("tx"), F.floor(F.col("y") / side).alias("ty")).agg(F.count(F.lit(1)).alias("n"))
    parts = {(r["tx"], r["ty"]): -(-r["n"] // asked) for r in tiles.filter(F.col("n") > asked).collect()}  # at most points / asked rows
    kind = dict(points.dtypes)["k"]
    runs = points.mapInArrow(line_runs(eps, side, parts, most), f"tx bigint, ty bigint, part int, y double, asks boolean, ks array<{kind}>, xs array<double>")
    dealt = runs.repartition(8 * partitions(points), "tx", "ty", "part").sortWithinPartitions("tx", "ty", "part", F.desc("asks"), "y")
    return dealt.mapInArrow(line_links(eps), f"k {kind}, links bigint")


def near_in_blocks(qx: np.ndarray, qy: np.ndarray, dx: np.ndarray, dy: np.ndarray, n: np.ndarray, eps: float, m: int) -> np.ndarray:
    """For each point q the number of points d within ``eps``, d being distinct and ``n`` times there.

    Points on few lines of equal y are found by line (``near_on_lines``), others by cells.

    Cells have the side eps / m.  Cells that lie in reach whole are added up by prefix sums along
    their rows; only the points of cells that the circle can cut are compared.
    """
    if len(np.unique(dy)) ** 2 <= len(dy):
        return near_on_lines(qx, qy, dx, dy, n, eps)
    side = eps / m
    left, low = int(np.floor(dx.min() / side)), int(np.floor(dy.min() / side))
    cx, cy = np.floor(dx / side).astype(np.int64) - left, np.floor(dy / side).astype(np.int64) - low
    wide, high = int(cx.max()) + 1, int(cy.max()) + 1
    order = np.argsort(cy * wide + cx, kind="stable")
    dx, dy, n = dx[order], dy[order], n[order]
    before = np.concatenate(([0], np.cumsum(n)))
    start = np.concatenate(([0], np.cumsum(np.bincount(cy * wide + cx, minlength=wide * high))))  # of each cell in the sorted points
    steps = np.arange(-m - 1, m + 2)
    room = lambda n: np.sqrt(np.maximum(m * m - n * n, 0)).astype(np.int64)
    # a little less than what must lie in reach, and a little more than what may
    whole = np.where(np.abs(steps) + 1 < m, room(np.abs(steps) + 1) - 2, -1)
    part = room(np.maximum(np.abs(steps) - 1, 0)) + 2
    out = np.zeros(len(qx), np.int64)
    ux, uy = np.floor(qx / side).astype(np.int64) - left, np.floor(qy / side).astype(np.int64) - low
    by_cell = np.lexsort((ux, uy))
    change = np.flatnonzero((np.diff(ux[by_cell]) != 0) | (np.diff(uy[by_cell]) != 0)) + 1
    for some in np.split(by_cell, change):
        x, y = int(ux[some[0]]), int(uy[some[0]])
        ok = (y + steps >= 0) & (y + steps < high)
        row, inner, outer = (y + steps[ok]) * wide, whole[ok], part[ok]
        at = lambda v: start[row + np.clip(v, 0, wide)]  # noqa: B023, E731  the first point of a row from column v on
        has = inner >= 0
        i0, i1 = np.where(has, x - inner, x), np.where(has, x + inner + 1, x)
        out[some] += (before[at(i1)] - before[at(i0)]).sum()
        begin, end = np.concatenate([at(x - outer), at(i1)]), np.concatenate([at(i0), at(x + outer + 1)])
        count = np.maximum(end - begin, 0)
        total = int(count.sum())
        if total:
            ends = np.cumsum(count)
            near = np.repeat(begin - ends + count, count) + np.arange(total)
            for i in range(0, len(some), step := max(1, (1 << 21) // total)):
                q = some[i : i + step]
                apart = (qx[q][:, None] - dx[near][None]) ** 2 + (qy[q][:, None] - dy[near][None]) ** 2
                out[q] += (apart <= eps * eps) @ n[near]
    return out


def neighbour_counts(queries: DataFrame, points: DataFrame, key: str, x: str, y: str, eps: float, m: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(key, links): how many other points lie within ``eps`` of each query, exactly; queries are all or some of the points.

    Points in one place are merged first.  The places are dealt to tiles a little wider than ``eps``, in blocks
    of about ``block``, so that a dense tile spreads over many tasks; a block meets the blocks of its tile and of
    the eight around it.  A pair of blocks is counted by lines or by cells (``near_in_blocks``), and no pair of
    points becomes a row.  Where all points are asked for and lie on few lines of equal y, ``line_counts`` counts them.
    Points without coordinates have no links.
    """
    side = eps / m * (m + 1)

    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def dealt(df: DataFrame) -> DataFrame:
        """(tx, ty, xs, ys, ns): a row for each block of ``block`` places or so, with the number of points in each."""
        places = plain(df).filter("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
        placed = stored(places.withColumn("tx", F.floor(F.col("x") / side)).withColumn("ty", F.floor(F.col("y") / side)))
        tiles = placed.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        placed = placed.join(small(tiles), ["tx", "ty"]).withColumn("b", F.pmod(F.xxhash64("x", "y"), F.col("blocks")))
        return placed.groupBy("tx", "ty", "b").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"), F.collect_list("n").alias("ns"))

    if queries is points:
        there = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
        rows = plain(points)
        n, lines = rows.filter(there).agg(F.count(F.lit(1)), F.count_distinct("y")).first()
        if n and lines**2 <= n:
            apart = rows.filter(~there).select("k", F.lit(0).cast("bigint").alias("links"))
            return line_counts(rows.filter(there), eps, 1.5 * eps).unionByName(apart).select(F.col("k").alias(key), "links")
    there = dealt(points)
    asked = there if queries is points else dealt(queries)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("n")
    asking = asked.select("*", around).select((F.col("tx") + F.col("n.i")).alias("tx"), (F.col("ty") + F.col("n.j")).alias("ty"), F.col("xs").alias("qx"), F.col("ys").alias("qy"))
    met = asking.join(there.select("tx", "ty", "xs", "ys", "ns"), ["tx", "ty"]).select("qx", "qy", "xs", "ys", "ns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qx, qy, dx, dy, n = (batch.column(c)[i].values.to_numpy() for c in ("qx", "qy", "xs", "ys", "ns"))
                links = near_in_blocks(qx, qy, dx, dy, n, eps, m)
                for at in range(0, len(qx), 1 << 16):
                    yield pa.RecordBatch.from_pydict({"x": qx[at : at + (1 << 16)], "y": qy[at : at + (1 << 16)], "links": links[at : at + (1 << 16)]})

    # a row is a pair of blocks: pairs are dealt anew, so that those of a dense tile spread
    met = met.repartition(4 * partitions(points))
    found = stored(met.mapInArrow(run, "x double, y double, links bigint").groupBy("x", "y").agg((F.sum("links") - 1).alias("links")))  # itself is not counted
    return plain(queries).join(small(found), ["x", "y"], "left").select(F.col("k").alias(key), F.coalesce("links", F.lit(0)).alias("links"))


def fingerprints(fact: DataFrame, times: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per vendor: histograms of price to estimate (5 buckets) and of hours (24), co-bidders, wins by category, and a digest of the histograms.

    ``times`` (vendor_id, at) are the moments of a vendor's acts; ``pairs`` are those of ``co_bids``;
    without them there are no co-bidders.  A vendor's co-bidders are at most all vendors, in one row.
    """
    per = F.when((F.col("estimated_value") > 0) & (F.col("total_amount") > 0), F.col("total_amount") / F.col("estimated_value"))
    bucket = F.when(per < 0.7, 0).when(per < 0.9, 1).when(per < 1.05, 2).when(per < 1.3, 3).when(per >= 1.3, 4)
    n = F.count(F.lit(1))
    total = F.count(bucket)
    a = fact.groupBy("vendor_id").agg(F.array(*[F.coalesce(F.count(F.when(bucket == i, 1)) / F.when(total > 0, total), F.lit(0.0)) for i in range(5)]).alias("prices"), n.alias("bids"))
    hours = times.groupBy("vendor_id").agg(F.array(*[F.count(F.when(F.hour("at") == h, 1)).cast("double") for h in range(24)]).alias("hours"))
    won = fact.filter(F.lower("status").isin("awarded", "won", "l1")).groupBy("vendor_id", "category").agg(n.alias("n"))
    won = won.groupBy("vendor_id").agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("wins"))
    out = a.join(hours, "vendor_id", "left").join(won, "vendor_id", "left")
    out = out.withColumn("hours", F.coalesce("hours", F.array_repeat(F.lit(0.0), 24))).withColumn("wins", F.coalesce("wins", F.array().cast(dict(won.dtypes)["wins"])))
    if pairs is not None:
        others = both_ways(pairs).groupBy(F.col("node").alias("vendor_id")).agg(F.array_sort(F.collect_list("other")).alias("co_bidders"))
        out = out.join(others, "vendor_id", "left").withColumn("co_bidders", F.coalesce("co_bidders", F.array().cast(dict(others.dtypes)["co_bidders"])))
    acts = F.aggregate("hours", F.lit(0.0), lambda s, v: s + v)
    shares = F.transform("hours", lambda h: F.format_number(F.coalesce(h / F.when(acts > 0, acts), F.lit(0.0)), 4))
    text = F.concat_ws("|", F.concat_ws(",", F.transform("prices", lambda x: F.format_number(x, 4))), F.concat_ws(",", F.slice(shares, 1, 12)))
    return out.withColumn("digest", F.substring(F.sha2(text, 256), 1, 16))


#: Nodes of a block of ``neighbour_jaccard``, and columns that are multiplied at a time.
NODES, WIDE = 512, 8192


def shared_neighbours(pairs: pa.Table, lists: pa.Table) -> pa.Table:
    """(a, b, co) of the pairs (a, b, ra, rb) of two blocks, from the lists (rank, others) of their nodes."""
    rank, others = lists.column("rank").to_numpy(), lists.column("others").combine_chunks()
    ends = others.offsets.to_numpy()
    size = np.diff(ends)
    row = np.repeat(np.arange(len(rank)), size)
    columns, code = np.unique(others.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True)
    order = np.argsort(rank)
    x, y = (order[np.searchsorted(rank, pairs.column(c).to_numpy(), sorter=order)] for c in ("ra", "rb"))
    xs, ys = np.unique(x), np.unique(y)
    both = np.zeros((len(xs), len(ys)))
    for low in range(0, len(columns), WIDE):
        some = (code >= low) & (code < low + WIDE)
        has = np.zeros((len(rank), min(WIDE, len(columns) - low)), np.float32)
        has[row[some], code[some] - low] = 1
        both += has[xs] @ has[ys].T
    common = both[np.searchsorted(xs, x), np.searchsorted(ys, y)]
    return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "co": common / (size[x] + size[y] - common)})


def neighbour_jaccard(pairs: DataFrame, block: int = NODES) -> DataFrame:
    """(a, b, co): for each of the distinct pairs the Jaccard index of the neighbours of its ends, exactly.

    Nodes are put in blocks by component and in their order, so that blocks of different components have no pairs.  A node's neighbours go to the pairs of blocks that have
    pairs, once each, not to its pairs; there they are counted by products of 0/1 matrices.
    """
    pairs = stored(pairs.select("a", "b"))
    ranks, _ = ranked(components(pairs), [], [F.col("component"), F.col("node")], small_keys=True)
    ranks = durable(ranks.select("node", F.col("rank").cast("int").alias("rank")))
    side = lambda end: small(ranks).toDF(end, f"r{end}")
    placed = stored(pairs.join(side("a"), "a").join(side("b"), "b"))
    near = placed.select(F.explode(F.array(F.struct(F.col("ra").alias("rank"), F.col("rb").alias("other")), F.struct(F.col("rb").alias("rank"), F.col("ra").alias("other")))).alias("e")).select("e.*")
    lists = near.groupBy("rank").agg(F.collect_list("other").alias("others")).withColumn("block", F.floor(F.col("rank") / block))
    placed = placed.withColumn("ba", F.floor(F.col("ra") / block)).withColumn("bb", F.floor(F.col("rb") / block))
    used = placed.select("ba", "bb").distinct().select("ba", "bb", F.explode(F.array_distinct(F.array("ba", "bb"))).alias("block"))
    sent = used.join(lists, "block").select(F.col("ba").alias("xa"), F.col("bb").alias("xb"), "rank", "others")
    return placed.groupBy("ba", "bb").cogroup(sent.groupBy("xa", "xb")).applyInArrow(lambda p, q: shared_neighbours(p, q), f"a {dict(pairs.dtypes)['a']}, b {dict(pairs.dtypes)['b']}, co double")


def cosine(a: str, b: str) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)
