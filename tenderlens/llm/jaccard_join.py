"""Operator 12: n-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

A text (A-Z lowered) becomes the set of its distinct four-word shingles, as 64-bit hashes; equal sets
are one node.  Two nodes link if their Jaccard index is 0.85 or more; every link is found.

1. *Where can links be?*  In any fixed order of shingles, two linked sets of sizes s share one of
   their first s - ceil(0.85 s) + 1 (the order here is that of the hashes).  Nodes that share such a
   shingle meet in a tile; tiles of equal members, known by count and two hashes of the members, are
   one.  In a tile each node brings a bitmap: a bit is the parity of the shingles that hash to it, so
   the bits in which two bitmaps differ bound the difference of the sets from below, hence the overlap
   from above.  Pairs that the bound lets pass join nodes into groups (stars only leave a task).
2. *Links.*  No link leaves a group.  Each group's sets are read once; a group of more than ``LOAD``
   shingles is cut in bands of sizes (a link stays in a band or goes to the next one) and blocks,
   and tiles are pairs of blocks.  In a tile sizes and bitmaps come first, then the sorted arrays of
   what is left are intersected exactly.  What leaves a task is one row per linked node: its number
   of links and the least node of its part.  Components follow by large-star / small-star rounds.

Results: n_links is the number of other rows that a row links with, copies included.  Counting the
links of a group of g near copies of different texts takes g^2 / 2 bitmap tests, in tiles, and no row
per pair.  Hashes of 64 bits stand for shingles and sets.

Null and empty texts and texts without words have no shingles, link with nothing and are their own
component; fewer words than four make one shingle; very long texts are read whole.  Equal sets link.
Null doc_ids name a component only where it has no other; repeated rows are rows of their own.  An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, partitions, ship, slices, small
from .simhash import HEAVY, components, least_linked, name_of, spread, word_shingles

ship(__name__)

WORDS, NEAR = 4, (85, 100)
#: Members of a tile of bitmaps, and shingles of a block of sets, beyond which they are cut in bands and blocks.
MEMBERS, LOAD = 4096, 1 << 19
#: A bitmap that is shuffled has a bit for so many shingles or fewer.
SHIPPED = 2
#: Pairs that are tested at once, and words of bitmaps.
PAIRS, BITMAP_WORDS = 1 << 18, 1 << 21
#: Blocks of a band, at most; the band is the upper part of a block's number.
BLOCKS = 1 << 20


def bitmap(held: np.ndarray, share: int = 1) -> np.ndarray:
    """The parities of a set's shingles by their lowest bits: as many bits as the next power of two of its size / ``share``, 64 at least."""
    size = max(64, 1 << max(0, (len(held) - 1) // share).bit_length())
    odd = np.bincount((held & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def prefix(size: int, near: tuple[int, int]) -> int:
    """How many of the first shingles of a set hold one that it shares with any linked set."""
    return size + (-near[0] * size) // near[1] + 1


def signed(docs: DataFrame, words: int, near: tuple[int, int]) -> DataFrame:
    """One row per row: doc_id, tkey (of the text), node (of its set), size, its first shingles and its bitmap."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [word_shingles(t.as_py(), words) for t in part.column("text")]
                first = [x[: prefix(len(x), near)].view(np.int64) if len(x) else x.view(np.int64) for x in sets]
                cols = [
                    pa.array([name_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(first, pa.list_(pa.int64())), pa.array([bitmap(x, SHIPPED).tobytes() for x in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), *cols], ["doc_id", "tkey", "node", "size", "prefix", "bits"])

    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, f"doc_id {kind}, tkey bigint, node bigint, size bigint, prefix array<bigint>, bits binary")


def tiles(rows: DataFrame, group: str, total: Column, load: Column, most: int, near: tuple[int, int]) -> DataFrame:
    """Deals rows (group, node, size, ...) to tiles (x, y); ``own`` is a row's block.

    Pairs of a tile count if their blocks differ or x = y, so that any two rows of a group whose
    sizes can link meet in one tile as such a pair.  A group whose ``total`` is at most ``most`` is one tile.
    """
    width = math.log(near[1] / (near[0] - 1))  # a little more than a link spans
    banded = rows.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / width))
    big = banded.filter(total > most)
    loads = big.groupBy(group, "band").agg(F.ceil(F.sum(load) / most).alias("k"))
    near_bands = [loads.select(group, (F.col("band") + s).alias("band"), F.col("k").alias(name)) for s, name in ((1, "below"), (-1, "above"))]
    loads = durable(loads.join(near_bands[0], [group, "band"], "left").join(near_bands[1], [group, "band"], "left"))  # rows / most x bands of a group
    cut = big.join(small(loads), [group, "band"]).withColumn("own", F.col("band") * BLOCKS + F.pmod(F.xxhash64("node"), F.col("k")))

    def blocks(k: str, step: int) -> Column:
        """The blocks of the band that lies ``step`` further."""
        first = (F.col("band") + step) * BLOCKS
        return F.when(F.col(k).isNotNull(), F.sequence(first, first + F.col(k) - 1)).otherwise(F.array().cast("array<bigint>"))

    cut = cut.withColumn("with", F.explode(F.concat(blocks("k", 0), blocks("below", -1), blocks("above", 1))))
    cut = cut.select(*rows.columns, "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    zero = F.lit(0).cast("bigint")
    return rows.filter(total <= most).select("*", zero.alias("own"), zero.alias("x"), zero.alias("y")).unionByName(cut)


def passing(tile: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, size: np.ndarray, bits: np.ndarray, begin: np.ndarray, near: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of equal tile, by sizes and bitmaps, some at a time; rows are sorted by tile and size."""
    up, down = near
    key = tile << np.int64(32) | size
    end = np.searchsorted(key, tile << np.int64(32) | size * down // up, "right")
    count = end - np.arange(len(key)) - 1
    ends = np.cumsum(count)
    wide = np.diff(np.append(begin, len(bits)))
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(at, to), count[at:to])
        j = spread(np.arange(at, to) + 1, count[at:to])
        at = to
        keep = (own[i] != own[j]) | (x[i] == y[i])
        i, j = i[keep], j[keep]
        fine = np.zeros(len(i), bool)
        for w in np.unique(wide[i]).tolist():
            for fold in (False, True):
                pick = np.flatnonzero((wide[i] == w) & ((wide[j] != w) == fold))
                for p in range(0, len(pick), step := max(1, BITMAP_WORDS // w)):
                    some = pick[p : p + step]
                    left, right = begin[i[some]][:, None] + np.arange(w), begin[j[some]][:, None] + np.arange(w)
                    other = bits[right] ^ bits[right + w] if fold else bits[right]
                    apart = np.bitwise_count(bits[left] ^ other).sum(axis=1, dtype=np.int64)
                    fine[some] = apart * (up + down) <= (down - up) * (size[i[some]] + size[j[some]])
        if fine.any():
            yield i[fine], j[fine]


def by_tile(work):
    """Applies ``work`` to whole tiles of sorted rows (key, x, y, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last tile, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("key", "x", "y")]
            last = [k[-1] for k in keys]
            cut = int(np.argmax(np.logical_and.reduce([k == v for k, v in zip(keys, last, strict=True)])))
            same = bool(held) and cut == 0 and all(held[-1].column(c)[0].as_py() == v for c, v in zip(("key", "x", "y"), last, strict=True))
            if not same:
                yield work(pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema).combine_chunks())
                held = []
            held.append(batch.slice(0 if same else cut))
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def frame(held: pa.Table) -> tuple[np.ndarray, ...]:
    """tile (gapless), x, y, own, size and node of sorted rows."""
    key, x, y, own, size, node = (held.column(c).to_numpy() for c in ("key", "x", "y", "own", "size", "node"))
    change = np.ones(len(key), np.int64)
    change[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return np.cumsum(change) - 1, x, y, own, size, node


def flat_bits(maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All bitmaps in a row and where each begins."""
    ends = np.cumsum([len(m) for m in maps])
    return np.concatenate(maps), np.concatenate(([0], ends[:-1])).astype(np.int64)


def joined(near: tuple[int, int]):
    """Tiles of bitmaps to the edges (a, b) of what may link."""

    def work(held: pa.Table) -> pa.RecordBatch:
        if not held.num_rows:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        tile, x, y, own, size, node = frame(held)
        label = np.arange(len(node))
        bits, begin = flat_bits([np.frombuffer(b.as_py(), np.uint64) for b in held.column("bits")])
        for i, j in passing(tile, x, y, own, size, bits, begin, near):
            label = least_linked(len(label), np.concatenate([i, np.arange(len(label))]), np.concatenate([j, label]))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return by_tile(work)


def linked(near: tuple[int, int]):
    """Tiles of sets to rows (node, root, links) of the nodes that link: with how many rows, and the first node of its part."""
    up, down = near

    def work(held: pa.Table) -> pa.RecordBatch:
        if not held.num_rows:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["node", "root", "links"])
        tile, x, y, own, size, node = frame(held)
        copies = held.column("copies").to_numpy()
        sets = [np.frombuffer(b.as_py(), np.uint64) for b in held.column("shingles")]
        bits, begin = flat_bits([bitmap(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        starts = ends - size
        mark = np.zeros(len(codes), np.uint8)
        label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
        for i, j in passing(tile, x, y, own, size, bits, begin, near):
            both = np.zeros(len(i), np.int64)
            pivots, first = np.unique(i, return_index=True)
            for p, a, b in zip(pivots.tolist(), first.tolist(), [*first[1:].tolist(), len(i)], strict=True):
                mine, theirs = codes[starts[p] : ends[p]], j[a:b]
                mark[mine] = 1
                if 2 * len(theirs) > theirs[-1] - theirs[0]:  # nearly all of a run
                    run = mark[codes[starts[theirs[0]] : ends[theirs[-1]]]]
                    each = np.add.reduceat(run, starts[theirs[0] : theirs[-1] + 1] - starts[theirs[0]], dtype=np.int64)
                    both[a:b] = each[theirs - theirs[0]]
                else:
                    run = mark[codes[spread(starts[theirs], size[theirs])]]
                    both[a:b] = np.add.reduceat(run, np.cumsum(size[theirs]) - size[theirs], dtype=np.int64)
                mark[mine] = 0
            near_enough = down * both >= up * (size[i] + size[j] - both)
            i, j = i[near_enough], j[near_enough]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = least_linked(len(label), np.concatenate([i, np.arange(len(label))]), np.concatenate([j, label]))
        found = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(node[label[found]]), pa.array(links[found])], ["node", "root", "links"])

    return by_tile(work)


def tiled(rows: DataFrame) -> DataFrame:
    """Rows by tile and size, whole tiles together."""
    n = partitions(rows)
    return rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "size", "node")


def groups(nodes: DataFrame, members: int, near: tuple[int, int]) -> DataFrame:
    """(node, root) of all nodes that may link with another; no link leaves the nodes of a root."""
    first = nodes.select(F.explode("prefix").alias("key"), "node", "size")
    met = first.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("u"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("v"))
    met = durable(met.filter("n > 1").groupBy("n", "u", "v").agg(F.min("key").alias("key")).select("key", "n"))
    rows = first.join(small(met), "key")
    dealt = tiles(rows, "key", F.col("n"), F.lit(1), members, near).select("key", "x", "y", "own", "node", "size")
    # who finds no size in its tile that it can link with needs no bitmap; a tile has 2 x members rows or so
    by_size = W.partitionBy("key", "x", "y").orderBy("size", "node")
    before, after = near[1] * F.lag("size").over(by_size) >= near[0] * F.col("size"), near[0] * F.lead("size").over(by_size) <= near[1] * F.col("size")
    dealt = dealt.withColumn("met", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).filter("met").drop("met")
    with_bits = tiled(dealt.join(nodes.select("node", "bits"), "node"))
    return components(with_bits.mapInArrow(joined(near), "a bigint, b bigint"))


def shingles_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted`` (doc_id, tkey, node), from the texts of those rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([word_shingles(t.as_py(), words).tobytes() for t in part.column("text")], pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    texts = texts.join(small(wanted), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("tkey"))).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(run, "node bigint, shingles binary")


def jaccard_join(docs: DataFrame, words: int = WORDS, near: tuple[int, int] = NEAR, members: int = MEMBERS, load: int = LOAD) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links."""
    rows = durable(signed(docs.select("doc_id", "text"), words, near))
    who = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tkey"))
    nodes = rows.filter("size > 0").groupBy("node").agg(who.alias("who"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    nodes = durable(nodes.select("node", "who.doc_id", "who.tkey", "copies", "size", "prefix", "bits"))
    maybe = groups(nodes, members, near).withColumnRenamed("root", "key")
    maybe = maybe.join(nodes.select("node", "doc_id", "tkey", "copies", "size"), "node")
    totals = maybe.groupBy("key").agg(F.sum("size").alias("total"))
    maybe = durable(maybe.join(totals, "key"))
    dealt = tiles(maybe, "key", F.col("total"), F.col("size"), load, near).select("key", "x", "y", "own", "node", "size", "copies")
    sets = shingles_of(docs, durable(maybe.select("doc_id", "tkey", "node")), words)
    found = durable(tiled(dealt.join(sets, "node")).mapInArrow(linked(near), "node bigint, root bigint, links bigint"))
    roots = durable(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    ids = nodes.select("node", "doc_id", "copies")
    least = ids.join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    known = roots.join(least, "root").join(links, "node").select("node", "component_id", "links")
    more = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    per_node = durable(ids.join(known, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), more.alias("n_links"), "copies"))
    # sets of more than rows / HEAVY rows are fewer than HEAVY: they are broadcast, so that no group of copies meets in a task
    bar = rows.count() / HEAVY
    heavy = F.broadcast(per_node.filter(F.col("copies") > bar).drop("copies"))
    light = per_node.filter(F.col("copies") <= bar).drop("copies")
    out = ["doc_id", F.col("size").alias("n_shingles"), "component_id", "n_links"]
    full, bare = rows.filter("size > 0").select("doc_id", "node", "size"), rows.filter("size = 0")
    empty = bare.select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return full.join(heavy, "node").select(*out).unionByName(full.join(heavy, "node", "left_anti").join(light, "node").select(*out)).unionByName(empty)
