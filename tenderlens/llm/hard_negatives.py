"""Operator 13: hard negatives from a multiway hyperplane tree with ranges between siblings (after GNAT).

**Tree.** The split points come from a bounded sample of the rows (the ``SAMPLE`` least hashes of
vec_id).  A node's ``fan`` split points are chosen one after another, each the sample row farthest
from those before it; a row goes to the nearest split point, so that hyperplanes part the siblings.
Every row of the table is put in its leaf, and for each node all rows of each child give the range of
their distances to every split point of the node, and the range of their lengths.  The tree and its
ranges (at most ``LEAVES`` leaves and fan x fan ranges a node) travel with the tasks.

**Search.** Rows wanted by an anchor lie in a window of inner products, hence, with the lengths of a
subtree, in an annulus around the anchor.  At a node the distances of the anchor to the split
points are taken; a child goes if, for any split point, its range does not meet the annulus.  What
is left is a set of leaves, which are compared exactly.  Leaves are put in shards of bounded size, and an
anchor is sent once to each shard that holds any of its leaves; a task reads a shard's rows and then its
anchors, a few at a time.  A leaf of more than ``CHUNK`` rows is cut in chunks by vec_id, so that groups of
equal vectors spread.

**Passes.** The anchor's own leaf gives a first bound for its positives, the tree gives all rows
that can reach it; then the same two steps find the negatives of each positive, in its window
[positive / 2, 95 % of positive], tightened by what the own leaf gave.  All results are exact.

A row takes part with a label and a vector of finite components (rows whose length is not the most common one take no part).  Null vec_ids can't be named or ordered: such rows take no part.  Rows that repeat vec_id, label
and vector count once; where only vec_id repeats, each counts, but never as a partner of its own id.
Ties of score go to the smaller vec_id.  A label's only row has no positives, hence no rows.  An empty
table gives an empty result; extra columns are left out.  A component beyond 2^23 after scaling is
refused with an error, since products would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, partitions, ship

ship(__name__)

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A window of scores in percent of the positive's.
WINDOW = (50, 95)
SAMPLE, FAN, LEAF, LEAVES, CHUNK = 8192, 12, 512, 2048, 4096
LIMIT = 1 << 23
#: Numbers of a shard's vectors that a task holds, and scores that it holds at a time.
SHARD, SCORES = 1 << 21, 1 << 20
#: Room for the rounding of distances, as a share of them.
SLACK = 1e-9


class Node:
    """Split points with ranges to the sibling subtrees; ``first`` to ``last`` are the leaves below."""

    __slots__ = ("centers", "children", "first", "high", "last", "long", "low", "short")


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y."""
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def spread_out(x: np.ndarray, fan: int) -> np.ndarray:
    """Up to ``fan`` distinct rows, each the farthest from those before it."""
    chosen = [0]
    near = gaps(x, x[:1])[:, 0]
    while len(chosen) < fan and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, gaps(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def grow(sample: np.ndarray, leaves: int, fan: int, counter: list[int]) -> Node | int:
    """A tree over the sample with about ``leaves`` leaves; a leaf is its number."""
    if leaves > 1 and len(sample) > 1:
        centers = spread_out(sample, min(fan, leaves))
        if len(centers) > 1:
            node = Node()
            node.centers, node.first = centers, counter[0]
            side = gaps(sample, centers).argmin(axis=1)
            node.children = [grow(sample[side == i], round(leaves * (side == i).mean()), fan, counter) for i in range(len(centers))]
            node.last = counter[0] - 1
            return node
    counter[0] += 1
    return counter[0] - 1


def inner_nodes(tree: Node | int) -> list[Node]:
    return [] if isinstance(tree, int) else [tree, *(n for c in tree.children for n in inner_nodes(c))]


def descend(tree: Node | int, x: np.ndarray, note=None) -> np.ndarray:
    """The leaf of each row; ``note(node, distances, children)`` sees each node's part of the rows."""
    leaf = np.zeros(len(x), np.int64)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            leaf[rows] = node
        elif len(rows):
            d = gaps(x[rows], node.centers)
            side = d.argmin(axis=1)
            if note:
                note(node, d, side, rows)
            todo += [(c, rows[side == i]) for i, c in enumerate(node.children)]
    return leaf


def survivors(tree: Node | int, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """For each anchor the leaves that may hold rows with an inner product in [low, high]."""
    square = (q * q).sum(axis=1)
    found: list[tuple[np.ndarray, int]] = []
    todo = [(tree, np.flatnonzero(low <= high))]
    while todo:
        node, rows = todo.pop()
        if isinstance(node, int):
            found.append((rows, node))
            continue
        if not len(rows):
            continue
        d = gaps(q[rows], node.centers)
        for i, child in enumerate(node.children):
            if node.long[i] < 0:  # no row ever came here
                continue
            # |q - v|^2 = |q|^2 + |v|^2 - 2 q v, with the lengths of the child's rows
            reach = np.sqrt(np.maximum(square[rows] + node.long[i] ** 2 - 2 * low[rows], 0))
            clear = np.sqrt(np.maximum(square[rows] + node.short[i] ** 2 - 2 * high[rows], 0))
            slack = SLACK * (1 + reach + d.max(axis=1) + node.high[:, i].max())
            gap = np.maximum(node.low[:, i][None] - d, d - node.high[:, i][None]).max(axis=1)
            most = (d + node.high[:, i][None]).min(axis=1)
            product = np.abs(np.sqrt(square[rows])) * node.long[i]
            keep = (gap <= reach + slack) & (most >= clear - slack) & (low[rows] <= product * (1 + SLACK) + 1) & (high[rows] >= -product * (1 + SLACK) - 1)
            todo.append((child, rows[keep]))
    row = np.concatenate([np.zeros(0, np.int64), *(r for r, _ in found)])
    leaf = np.repeat(np.array([n for _, n in found], np.int64), [len(r) for r, _ in found])
    order = np.lexsort((leaf, row))
    return np.split(leaf[order], np.searchsorted(row[order], np.arange(1, len(q))))


def vectors_of(column: pa.Array) -> np.ndarray:
    """Integer vectors as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def usable(vectors: DataFrame, scale: int, vector: str) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, as integers; labels that are divisible by 7 have moved."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size(vector) > 0) & fine)
    as_int = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    return rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint").alias("label"), as_int.alias("vector"))


def plant(rows: DataFrame, n: int, sample: int, fan: int, leaf: int) -> Node | int:
    """The tree, from a bounded sample; ranges are still missing."""
    some = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector").limit(sample).collect()]
    return grow(np.array(some, np.float64), min(LEAVES, max(1, n // leaf)), fan, [0])


def measure(rows: DataFrame, tree: Node | int) -> None:
    """Sets the ranges of all nodes from all rows."""
    nodes = inner_nodes(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[float, float]] = {}

        def put(key: tuple[int, int, int], lo: float, hi: float) -> None:
            a, b = held.get(key, (lo, hi))
            held[key] = (min(a, lo), max(b, hi))

        mine = inner_nodes(tree)
        at = {id(n): i for i, n in enumerate(mine)}
        for batch in batches:
            x = vectors_of(batch.column("vector"))
            size = np.sqrt((x * x).sum(axis=1))

            def note(node, d, side, where, size=size):
                for i in np.unique(side).tolist():
                    part = d[side == i]
                    for j, (lo, hi) in enumerate(zip(part.min(axis=0).tolist(), part.max(axis=0).tolist(), strict=True)):
                        put((at[id(node)], i, j), lo, hi)
                    put((at[id(node)], i, -1), float(size[where[side == i]].min()), float(size[where[side == i]].max()))

            descend(tree, x, note)
        keys = list(held)
        cols = [pa.array([k[c] for k in keys], pa.int64()) for c in range(3)] + [pa.array([held[k][c] for k in keys], pa.float64()) for c in range(2)]
        yield pa.RecordBatch.from_arrays(cols, ["node", "child", "center", "low", "high"])

    for n in nodes:
        m = len(n.centers)
        n.low, n.high, n.short, n.long = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -1.0)
    found = rows.select("vector").mapInArrow(run, "node bigint, child bigint, center bigint, low double, high double")
    for r in found.groupBy("node", "child", "center").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # fan x fan rows a node
        node, i, j = nodes[r["node"]], r["child"], r["center"]
        if j < 0:
            node.short[i], node.long[i] = r["low"], r["high"]
        else:
            node.low[j, i], node.high[j, i] = r["low"], r["high"]


def placed(rows: DataFrame, tree: Node | int) -> DataFrame:
    """The rows with their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = descend(tree, vectors_of(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "vector")), pa.array(leaf)], ["vec_id", "label", "vector", "leaf"])

    return rows.mapInArrow(run, "vec_id bigint, label bigint, vector array<int>, leaf bigint")


def visits(anchors: DataFrame, tree: Node | int, first: np.ndarray, last: np.ndarray, own_leaf: bool) -> DataFrame:
    """The anchors (anchor_id, label, vector, leaf, low, high; several windows each), a row for each ``shard`` with the ``leaves`` that they visit there; all windows of a row share its visits.

    The chunks of a leaf lie in the shards from ``first`` to ``last`` of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if own_leaf:
                    row, leaf = np.arange(part.num_rows), part.column("leaf").to_numpy()
                else:
                    lows, highs = part.column("low"), part.column("high")
                    owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(lows).to_numpy(zero_copy_only=False))
                    q = vectors_of(part.column("vector"))[owner]
                    each = survivors(tree, q, lows.flatten().to_numpy(zero_copy_only=False).astype(float), highs.flatten().to_numpy(zero_copy_only=False).astype(float))
                    row, leaf = np.repeat(owner, [len(x) for x in each]), np.concatenate([np.zeros(0, np.int64), *each])
                spread = last[leaf] - first[leaf] + 1
                row, leaf, shard = np.repeat(row, spread), np.repeat(leaf, spread), np.repeat(first[leaf], spread)
                shard = shard + np.arange(len(shard)) - np.repeat(np.cumsum(spread) - spread, spread)
                seen = np.unique(np.column_stack([row, shard, leaf]), axis=0)
                begin = np.flatnonzero((np.diff(seen[:, 0], prepend=-1) != 0) | (np.diff(seen[:, 1], prepend=-1) != 0))
                leaves = pa.ListArray.from_arrays(pa.array(np.append(begin, len(seen)), pa.int32()), pa.array(seen[:, 2].astype(np.int32)))
                again = pa.array(seen[begin, 0])
                yield pa.RecordBatch.from_arrays([*(c.take(again) for c in part.columns), pa.array(seen[begin, 1]), leaves], [*part.schema.names, "shard", "leaves"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInArrow(run, f"{fields}, shard bigint, leaves array<int>")


def firsts(most: int, ask: np.ndarray, window: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each window of each anchor the ``most`` rows with the highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, window, ask))
    ask, window, ids, score = ask[order], window[order], ids[order], score[order]
    at = np.arange(len(ask))
    new = (np.diff(ask, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 0)
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < most
    return ask[keep], window[keep], ids[keep], score[keep]


class Shard:
    """The rows of a shard by leaf."""

    def __init__(self, rows: pa.Table):
        leaf, ids, label = (rows.column(c).to_numpy() for c in ("leaf", "vec_id", "label"))
        x = vectors_of(rows.column("vector"))
        self.leaves = {}
        order = np.lexsort((ids, leaf))  # ties go by vec_id
        for some in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            i, y, v = ids[some], label[some], x[some]
            if (i[1:] == i[:-1]).any():
                _, one = np.unique(np.column_stack([i, y, v]), axis=0, return_index=True)
                i, y, v = (a[np.sort(one)] for a in (i, y, v))
            self.leaves[int(leaf[some[0]])] = i, y, v

    def best(self, asks: pa.RecordBatch, same: bool, most: int) -> pa.RecordBatch:
        """The best ``most`` rows in each window of each anchor."""
        aid, alabel, q = asks.column("anchor_id").to_numpy(), asks.column("label").to_numpy(), vectors_of(asks.column("vector"))
        count = pc.list_value_length(asks.column("low")).to_numpy(zero_copy_only=False)
        wide = np.arange(count.max(initial=0)) < count[:, None]
        low, high = np.full(wide.shape, np.inf), np.full(wide.shape, -np.inf)
        low[wide], high[wide] = (asks.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("low", "high"))
        to = asks.column("leaves").flatten().to_numpy(zero_copy_only=False)
        who = np.repeat(np.arange(len(aid)), pc.list_value_length(asks.column("leaves")).to_numpy(zero_copy_only=False))
        order = np.argsort(to, kind="stable")
        out = []
        for all_ in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else []:
            if (leaf := int(to[all_[0]])) not in self.leaves:
                continue
            ids, label, x = self.leaves[leaf]
            for at in range(0, len(all_), step := max(1, SCORES // len(ids))):
                a = who[all_[at : at + step]]
                score = q[a] @ x.T
                fit = ((label[None] == alabel[a][:, None]) == same) & (ids[None] != aid[a][:, None])
                for w in range(low.shape[1]):
                    good = np.where(fit & (score >= low[a, w][:, None]) & (score <= high[a, w][:, None]), score, -np.inf)
                    bar = np.partition(good, len(ids) - most, axis=1)[:, len(ids) - most] if len(ids) > most else np.full(len(a), -np.inf)
                    i, j = np.nonzero((good >= bar[:, None]) & (good > -np.inf))
                    out.append(firsts(most, a[i], np.full(len(i), w), ids[j], np.rint(good[i, j]).astype(np.int64)))
        a, w, ids, score = (np.concatenate([np.zeros(0, np.int64), *(o[c] for o in out)]) for c in range(4))
        a, w, ids, score = firsts(most, a, w, ids, score)
        return pa.RecordBatch.from_arrays([pa.array(aid[a]), pa.array(w), pa.array(ids), pa.array(score)], ["anchor_id", "window", "vec_id", "score"])


def scan(same: bool, most: int, asked: int = 512):
    """Shards in order, each with its rows (anchor_id null) before its anchors; gives the best ``most`` rows in each window of each anchor.

    A task holds a shard's rows and ``asked`` anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, shard = None, [], None
        for batch in batches:
            key, is_row = batch.column("shard").to_numpy(), pc.is_null(batch.column("anchor_id")).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((key[1:] != key[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
                if a == b:
                    continue
                if key[a] != number:
                    number, rows, shard = key[a], [], None
                if is_row[a]:
                    rows.append(pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ROW], ROW))
                    continue
                if shard is None and rows:
                    shard, rows = Shard(pa.Table.from_batches(rows)), []
                for at in range(a, b, asked):
                    if shard is not None:
                        yield shard.best(batch.slice(at, min(asked, b - at)), same, most)

    return run


ROW = ["leaf", "vec_id", "label", "vector"]


def search(rows: DataFrame, shards: tuple[np.ndarray, np.ndarray], anchors: DataFrame, tree: Node | int, same: bool, most: int, own_leaf: bool) -> DataFrame:
    """(anchor_id, window, vec_id, score): the best ``most`` rows in each window of each anchor."""
    none = lambda kind: F.lit(None).cast(kind)
    asks = visits(anchors, tree, *shards, own_leaf).select("shard", none("int").alias("leaf"), "anchor_id", none("bigint").alias("vec_id"), "label", "vector", "low", "high", "leaves")
    held = rows.select("shard", F.col("leaf").cast("int").alias("leaf"), none("bigint").alias("anchor_id"), "vec_id", "label", "vector", none("array<bigint>").alias("low"), none("array<bigint>").alias("high"), none("array<int>").alias("leaves"))
    tasks = max(partitions(rows), int(shards[1].max(initial=0)) + 1)  # a shard each
    both = held.unionByName(asks).repartition(tasks, "shard").sortWithinPartitions("shard", F.col("anchor_id").asc_nulls_first())
    found = both.mapInArrow(scan(same, most), "anchor_id bigint, window bigint, vec_id bigint, score bigint").distinct()
    turn = F.row_number().over(W.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", turn).filter(F.col("rank") <= most)


def sharded(rows: DataFrame, leaves: int, n: int, wide: int, chunk: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """The rows with their ``shard``, and each leaf's first and last shard: leaves in order, or chunks of a large leaf, fill shards of about equal size."""
    size = np.zeros(leaves, np.int64)
    for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``LEAVES`` rows
        size[r["leaf"]] = r["n"]
    most = max(1, min(SHARD // wide, max(chunk, -(-n // (2 * partitions(rows))))))
    chunks = np.maximum(1, -(-size // chunk))
    each = -(-size // chunks)
    before = np.cumsum(size) - size
    first, last = before // most, (before + (chunks - 1) * each) // most
    told = rows.sparkSession.createDataFrame([tuple(map(int, x)) for x in zip(range(leaves), before, chunks, each, strict=True)], "leaf bigint, before bigint, chunks bigint, each bigint")
    at = F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("chunks")) * F.col("each")
    return rows.join(F.broadcast(told), "leaf").withColumn("shard", F.floor(at / most)).drop("before", "chunks", "each"), (first, last)


def hard_negatives(vectors: DataFrame, every: int = 50, noisy: int = 7, labels: int = 10, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, vector: str = "embedding", sample: int = SAMPLE, fan: int = FAN, leaf: int = LEAF, chunk: int = CHUNK) -> DataFrame:
    """One row per anchor (vec_id divisible by ``every``), positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Where vec_id is divisible by ``noisy`` the label first becomes (label + 1) % ``labels``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale, vector)
    moved = F.when(F.pmod("vec_id", F.lit(noisy)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    rows = durable(rows.withColumn("label", moved))
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if usual is None:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("vector") == usual["d"])
    most = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    if most["most"] > LIMIT:
        raise ValueError(f"a component exceeds {LIMIT} after scaling")
    rows = rows.withColumn("vector", F.col("vector").cast("array<int>"))
    tree = plant(rows, most["n"], sample, fan, leaf)
    measure(rows, tree)
    rows = durable(placed(rows, tree))
    rows, shards = sharded(rows, 1 if isinstance(tree, int) else tree.last + 1, most["n"], usual["d"], chunk)
    anchors = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vector", "leaf")
    anchors = durable(anchors.groupBy("anchor_id").agg(F.min(F.struct("label", "vector", "leaf")).alias("a")).select("anchor_id", "a.*"))
    top = 1 << 62

    def windows(low, high):
        return anchors.withColumn("low", F.array(F.lit(low).cast("bigint"))).withColumn("high", F.array(F.lit(high).cast("bigint")))

    first = search(rows, shards, windows(-top, top), tree, True, positives, own_leaf=True)
    bound = first.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) == positives, F.min("score")).alias("bound"))
    asked = anchors.join(bound, "anchor_id", "left").withColumn("low", F.array(F.coalesce("bound", F.lit(-top)))).withColumn("high", F.array(F.lit(top))).drop("bound")
    chosen = durable(search(rows, shards, asked, tree, True, positives, own_leaf=False).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 50 p <= 100 n <= 95 p: n from ceil(50 p / 100) to floor(95 p / 100), in whole numbers
    lo, hi = F.expr(f"-((-{window[0]} * positive_score - pmod(-{window[0]} * positive_score, 100)) div 100)"), F.expr(f"({window[1]} * positive_score - pmod({window[1]} * positive_score, 100)) div 100")
    pair = F.array_sort(F.collect_list(F.struct((-F.col("positive_score")).alias("order"), "positive_id", "positive_score", lo.alias("low"), hi.alias("high"))))  # at most ``positives`` of them
    pairs = durable(chosen.groupBy("anchor_id").agg(pair.alias("pairs")).join(anchors, "anchor_id").withColumn("low", F.col("pairs.low")).withColumn("high", F.col("pairs.high")))
    plain = pairs.drop("pairs")
    near = search(rows, shards, plain, tree, False, negatives, own_leaf=True)
    known = near.groupBy("anchor_id", "window").agg(F.when(F.count(F.lit(1)) == negatives, F.min("score")).alias("bound")).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "bound"))).alias("bounds"))
    tight = F.transform("low", lambda x, i: F.greatest(x, F.col("bounds")[i.cast("bigint")]))
    asked = plain.join(known, "anchor_id", "left").withColumn("low", F.when(F.col("bounds").isNotNull(), tight).otherwise(F.col("low"))).drop("bounds")
    found = search(rows, shards, asked, tree, False, negatives, own_leaf=False)
    named = found.join(pairs.select("anchor_id", "pairs"), "anchor_id").withColumn("pair", F.get("pairs", F.col("window")))
    return named.select("anchor_id", F.col("pair.positive_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("pair.positive_score").alias("positive_score"), F.col("score").alias("negative_score"))
