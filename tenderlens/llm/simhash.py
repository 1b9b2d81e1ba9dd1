"""Operator 10: SimHash near-duplicates, searched with a Gray-order hierarchical index.

Texts are lower-cased (A-Z), cut in words and hashed by word shingles (XXH64, seed 42,
unsigned; repeats count).  A fingerprint bit is 1 if it is set in over half of the hashes.

Equal fingerprints are first merged, so groups of copies cost one row.  Two fingerprints within
``radius`` bits agree on at least one of radius + 1 blocks of bits; distinct fingerprints are
dealt by (block, value), and a block value that gathers more than ``hot`` of them is dealt again
by blocks of its remaining bits, which stays exact.  Each task sorts a dealt group by Gray rank;
upper nodes hold the bits that all fingerprints below share, and a search adds up differences on
those masked bits on its way down and drops whole nodes beyond the radius.  What leaves a task
is one row per linked fingerprint, pointing to the least of its local group, never all pairs.
Those stars are joined into components by large-star / small-star rounds.

Two bits of 64 find texts that differ in a word or so.  ``keep_one`` drops near copies: texts whose
sets of five-word shingles have a Jaccard index of 0.8 or more.  Candidates come from fingerprints of
those shingles.  The Gray-order index links what differs in two bits; for the others a fingerprint of
256 bits puts a text in a number of tables by some of its bits each, and where texts meet in a
table each points to the two least ones that differ from it in at most ``far`` bits; once what these link is
known, texts that meet within ``far`` bits and are not yet in one component point to the least that they
are connected to, and what these pointers connect is compared in blocks, each text with all others.  Bits and tables follow from the number of texts and from the
``recall`` that is asked for two texts that just reach 0.8; a full table key is dealt again by further
bits.  Every candidate is verified exactly on the texts, so that no other documents go.

Null and empty texts have fingerprint zero and link like any other; very long texts are hashed
whole.  component_id is the least doc_id reachable, so ties and repeated rows meet in one component;
null doc_ids are never an id of a component unless it has no other.  ``keep_one`` keeps rows without a
doc_id and repeats of the row that stays.  An empty table gives an empty result.  ``near_groups`` reads
doc_id and text only, and ``keep_one`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, partitions, ship, slices, small

ship(__name__)

SHINGLE, RADIUS, HOT, HEAVY = 3, 2, 20_000, 4096
#: Near copies of ``keep_one``: words of a shingle, and the Jaccard index as a fraction.
NEAR_WORDS, NEAR = 5, (4, 5)
#: Expected share of such pairs that meet in a table, and standard deviations from their expected distance that still count as near.
RECALL, DEVIATIONS = 0.99, 2.5
#: Texts that share a key by chance, and candidates that a text takes from a table.
LOAD, PARENTS = 16, 2
#: Shingles of a block of texts that are compared with each other, texts from which on a group is cut in blocks, and blocks that a group is cut in for its texts' number.
BLOCK, CUT, SPREAD = 1 << 19, 256, 8
#: Tables and bits that a full key is dealt again by.
AGAIN, AGAIN_BITS = 24, 10
#: Odd multipliers: the first joins the hashes of words, the others make further hashes of a shingle (fixed values of this module).
MIXES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
LANES = ("f0", "f1", "f2", "f3")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Sizes of index nodes, from the top.
FANS = (4096, 512, 64, 8, 1)


def signs(hashes: np.ndarray) -> int:
    """The signed 64-bit number of the bits that over half of the hashes set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, size: int) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    last = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    return signs(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:last].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, last))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of all rows, fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), size) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code in Gray order: the prefix XOR of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] values each, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def links(fps: np.ndarray, group: np.ndarray, radius: int, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions i < j of equal ``group`` and at most ``radius`` bits apart; rows are sorted by group and Gray rank."""
    n = len(fps)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((begin, [n])))
    start_of = np.repeat(begin, sizes)
    place = np.arange(n) - start_of
    levels = []
    for fan in FANS:
        node = np.flatnonzero(place % fan == 0)
        shared = ~(np.bitwise_and.reduceat(fps, node) ^ np.bitwise_or.reduceat(fps, node))
        levels.append((node, shared, fps[node]))
    index_of = [np.cumsum(place % fan == 0) - 1 for fan in FANS]
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    for at in range(0, n, step):
        q = np.arange(at, min(n, at + step))
        q = q[size_of[q] > 1]
        first, last = index_of[0][start_of[q]], index_of[0][start_of[q] + size_of[q] - 1]
        query, node = np.repeat(q, last - first + 1), spread(first, last - first + 1)
        seen, spent = np.zeros(len(query), np.uint64), np.zeros(len(query), np.int64)
        for depth, fan in enumerate(FANS):
            begins, shared, pattern = levels[depth]
            mask = shared[node]
            spent = spent + np.bitwise_count((fps[query] ^ pattern[node]) & mask & ~seen)
            keep = (spent <= radius) & (begins[node] + fan > query)
            query, node, seen, spent = query[keep], node[keep], mask[keep], spent[keep]
            if fan > 1:
                under = index_of[depth + 1]
                top = begins[node]
                end = np.minimum(top + fan, start_of[top] + size_of[top]) - 1
                count = under[end] - under[top] + 1
                query, seen, spent = (np.repeat(x, count) for x in (query, seen, spent))
                node = spread(under[top], count)
        keep = levels[-1][0][node] > query
        left.append(query[keep])
        right.append(levels[-1][0][node][keep])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n positions the least position that the pairs connect it to."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def search(radius: int):
    """Rows (block, value, part, key, fp, name) sorted by group to the edges of what links in a group, each as the name of a row and of its root."""

    def edges(held: pa.Table) -> pa.RecordBatch:
        fps, names = held.column("fp").to_numpy().view(np.uint64), held.column("name").to_numpy()
        change = np.zeros(held.num_rows, bool)
        for name in ("block", "value", "part", "key"):
            x = held.column(name).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        group = np.cumsum(change)
        order = np.lexsort((gray_rank(fps), group))
        fps, names = fps[order], names[order]
        root = least_linked(len(fps), *links(fps, group[order], radius))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            keys = [held.column(c).to_numpy() for c in ("block", "value", "part", "key")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                yield edges(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield edges(held)

    return run


def cuts(bits: list[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` runs of nearly equal length."""
    n = len(bits)
    return [bits[n * i // parts : n * (i + 1) // parts] for i in range(parts)]


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def similar_edges(distinct: DataFrame, radius: int = RADIUS, hot: int = HOT, name: str = "fp") -> DataFrame:
    """Edges (a, b) that connect the ``fp`` of ``distinct`` as all pairs within ``radius`` bits would, by the numbers in ``name``."""
    n = partitions(distinct)
    blocks = cuts(list(range(64)), radius + 1)
    dealt = distinct.select("fp", F.col(name).alias("name"), F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask_of(b))) for b in blocks])).alias("block", "value"))
    full = dealt.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("block", "value", F.lit(True).alias("full"))
    sized = dealt.join(small(durable(full)), ["block", "value"], "left")  # one row of ``full`` for each ``hot`` fingerprints at most
    rest = [[b for b in range(64) if b not in block] for block in blocks]
    again = F.lit(None)
    for i, bits in enumerate(rest):
        again = F.when(F.col("block") == i, F.array(*[F.col("fp").bitwiseAND(F.lit(mask_of(c))) for c in cuts(bits, radius + 1)])).otherwise(again)
    keys = F.when(F.col("full"), again).otherwise(F.array(F.lit(0).cast("bigint")))
    many = sized.select("fp", "name", "block", "value", F.posexplode(keys).alias("part", "key"))
    group = ["block", "value", "part", "key"]
    return many.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(search(radius), "a bigint, b bigint")


def starred(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) with ``m``, the least v of their u: one shuffle."""
    each = W.partitionBy("u").orderBy("v")
    return pairs.select("u", "v", F.first("v").over(each).alias("m"), F.lag("v").over(each).alias("before")).filter("before is null or before != v").drop("before")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): for each node of the edges (a, b) the least node connected to it, by large-star and small-star rounds of one shuffle each."""
    pairs = durable(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = pairs.selectExpr("inline(array(struct(u, v), struct(v as u, u as v)))")
        large = starred(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # a pair may come from several tasks: the next round drops repeats, and stars have none
        pairs = durable(starred(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id."""
    rows = durable(fingerprints(docs, size))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    edges = similar_edges(distinct, radius, hot)
    roots = durable(components(edges))
    named = distinct.join(roots, distinct["fp"] == roots["node"])
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = named.join(whole, "root").select("fp", "component_id")
    per_code = durable(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    # fingerprints of more than rows / HEAVY rows are fewer than HEAVY: they are broadcast, so that no group of copies meets in a task
    least = (distinct.agg(F.sum("n").alias("rows")).first()["rows"] or 0) / HEAVY
    heavy = F.broadcast(per_code.filter(F.col("n") > least).select("fp", "component_id"))
    hot = rows.join(heavy, "fp")
    cold = rows.join(heavy, "fp", "left_anti").join(per_code.filter(F.col("n") <= least).select("fp", "component_id"), "fp")
    return hot.unionByName(cold).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def word_shingles(text: str | None, size: int = NEAR_WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``size`` words (of all words where there are fewer)."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    last = len(words) - k + 1
    made = np.zeros(last, np.uint64)
    for i in range(k):
        made = made * np.uint64(MIXES[0]) + each[i : i + last]
    return np.unique(made ^ made >> np.uint64(29))


def name_of(held: np.ndarray) -> int:
    """The signed 64-bit name of a set of shingles."""
    return xxhash.xxh64_intdigest(held.tobytes()) - (1 << 63)


def lanes_of(held: np.ndarray) -> list[int]:
    """Four fingerprints of a set of shingles."""
    folded = [held, *((held ^ held >> np.uint64(29)) * np.uint64(m) for m in MIXES[1:])]
    return [signs(x ^ x >> np.uint64(32)) for x in folded]


def wide_rows(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, tkey (of the text), node (of its set of five-word shingles) and the set's 256 bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [word_shingles(t.as_py()) for t in part.column("text")]
                made = [lanes_of(x) for x in sets]
                cols = [pa.array([name_of(x) for x in sets], pa.int64()), *(pa.array([m[i] for m in made], pa.int64()) for i in range(len(LANES)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tkey"), *cols], ["doc_id", "tkey", "node", *LANES])

    fields = ", ".join(f"{x} bigint" for x in ("tkey", "node", *LANES))
    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, f"doc_id {kind}, {fields}")


def layout(texts: int, recall: float) -> tuple[int, int, int]:
    """(bits of a key, tables, greatest distance) for a number of texts."""
    up, down = NEAR
    same = 1 - math.acos(2 * up / (up + down)) / math.pi  # the share of equal bits at a Jaccard index of NEAR
    bits = max(6, math.ceil(math.log2(max(1, texts / LOAD))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same**bits))
    size = 64 * len(LANES)
    return bits, tables, math.ceil(size * (1 - same) + DEVIATIONS * math.sqrt(size * same * (1 - same)))


def table_keys(tables: int, bits: int, names: list[str]):
    """(node, f0 to f3, maybe root: ``names``) to a row with a key for each table."""
    rng = np.random.default_rng(2024)
    chosen = [rng.permutation(64 * len(LANES))[:bits] for _ in range(tables)]
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lanes = np.stack([part.column(x).to_numpy() for x in LANES], axis=1)
                each = np.unpackbits(lanes.astype(">i8").view(np.uint8), axis=1)
                keys = np.concatenate([each[:, c] @ powers | np.int64(i) << np.int64(bits) for i, c in enumerate(chosen)])
                again = pa.array(np.tile(np.arange(part.num_rows), tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(part.column(x).take(again) for x in names)], ["key", *names])

    return run


def attach(begin: np.ndarray, lanes: list[np.ndarray], far: int, most: int = PARENTS) -> tuple[np.ndarray, np.ndarray]:
    """(row, parent): for each row the first rows of its group, which begins at ``begin``, within ``far`` bits; at most ``most``."""
    place = np.arange(len(begin)) - begin
    found = np.zeros(len(begin), np.int64)
    active = np.flatnonzero(place > 0)
    rows, parents = [], []
    turn = 0
    while len(active):
        pivot = begin[active] + turn
        near = sum(np.bitwise_count(x[active] ^ x[pivot]).astype(np.int64) for x in lanes) <= far
        rows.append(active[near])
        parents.append(pivot[near])
        found[active[near]] += 1
        turn += 1
        active = active[(found[active] < most) & (place[active] > turn)]
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*parents, np.zeros(0, np.int64)])


def across(begin: np.ndarray, root: np.ndarray, lanes: list[np.ndarray], far: int, step: int = 1 << 20, few: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other): all rows of a group, which begins at ``begin``, within ``far`` bits of each other and of different ``root``, in parts.

    Groups of up to ``few`` rows are compared together; in a larger one the rows of the commonest root meet the others only,
    about ``step`` pairs at a time.
    """
    starts = np.flatnonzero(np.diff(begin, prepend=-1))
    sizes = np.diff(starts, append=len(begin))
    place = np.arange(len(begin)) - begin
    active = np.flatnonzero((place > 0) & (np.repeat(sizes, sizes) <= few))
    turn = 0
    while len(active):
        pivot = begin[active] + turn
        near = sum(np.bitwise_count(x[active] ^ x[pivot]).astype(np.int16) for x in lanes) <= far
        near &= root[active] != root[pivot]
        yield active[near], pivot[near]
        turn += 1
        active = active[place[active] > turn]
    for low, size in zip(starts[sizes > few], sizes[sizes > few], strict=True):
        high = low + size
        own, code, count = np.unique(root[low:high], return_inverse=True, return_counts=True)
        rest = low + np.flatnonzero(code != count.argmax())
        turn_of = np.full(size, size)  # of the rows that are compared with all; a pair of these is taken once
        turn_of[rest - low] = np.arange(len(rest))
        for at in range(0, len(rest), per := max(1, step // size)):
            some = rest[at : at + per]
            near = sum(np.bitwise_count(x[some][:, None] ^ x[low:high][None]).astype(np.int16) for x in lanes) <= far
            near &= (root[some][:, None] != root[low:high][None]) & (turn_of[None] > np.arange(at, at + len(some))[:, None])
            row, other = np.nonzero(near)
            yield some[row], low + other


def stars(n: int, parts: Iterator[tuple[np.ndarray, np.ndarray]], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(row, least): of n rows those that the pairs of ``parts`` connect to a lesser one, and the least one; about ``step`` pairs are held at a time."""
    each = np.arange(n)
    label, held, size = each, [], 0
    for pair in parts:
        held.append(pair)
        size += len(pair[0])
        if size >= step:
            label, held, size = merged(label, held), [], 0
    label = merged(label, held)
    moved = np.flatnonzero(label != each)
    return moved, label[moved]


def merged(label: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least positions that ``label`` and the pairs together connect each position to."""
    each = np.arange(len(label))
    return least_linked(len(label), np.concatenate([each, *(a for a, _ in held)]), np.concatenate([label, *(b for _, b in held)]))


def meet(far: int, rooted: bool = False):
    """Rows (key, node, f0 to f3) sorted by key and node to candidate pairs (a, b), b the lesser.

    With ``root``, pairs of different roots are told by what they connect: a row for each node, to the least one.
    """

    def pairs(held: pa.Table) -> Iterator[pa.RecordBatch]:
        keys, nodes = held.column("key").to_numpy(), held.column("node").to_numpy()
        begin = np.searchsorted(keys, keys, "left")
        lanes = [held.column(x).to_numpy().view(np.uint64) for x in LANES]
        rows, parents = stars(len(keys), across(begin, held.column("root").to_numpy(), lanes, far)) if rooted else attach(begin, lanes, far)
        a, b = nodes[rows], nodes[parents]
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key")
            if held and keys[batch.num_rows - 1] == held[-1].column("key")[0]:
                held.append(batch)
                continue
            cut = int(np.searchsorted(keys.to_numpy(), keys[batch.num_rows - 1].as_py(), "left"))
            yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
            held = [batch.slice(cut)]
        if held:
            yield from pairs(pa.Table.from_batches(held).combine_chunks())

    return run


def table_pairs(nodes: DataFrame, hot: int, recall: float = RECALL) -> DataFrame:
    """Candidate pairs (a, b), a > b, of nodes that meet in a table within the distance of near copies.

    A node takes the first ``PARENTS`` of a table; where nodes have a ``root``, the least one that pairs of different roots connect it to.
    """
    bits, tables, far = layout(nodes.count(), recall)
    rooted = "root" in nodes.columns
    names = ["node", *LANES, *["root"] * rooted]
    keyed = lambda df: df.select(*names).mapInArrow(table_keys(tables, bits, names), ", ".join(f"{x} bigint" for x in ("key", *names)))
    # full keys are told from every 16th node; they are only dealt otherwise
    some = keyed(nodes.filter(F.pmod(F.xxhash64("node"), F.lit(16)) == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    full = durable(some.filter(F.col("n") * 16 > hot).select("key", F.lit(True).alias("full")))
    rng = np.random.default_rng(2025)
    masks = [[mask_of(np.flatnonzero(rng.permutation(64 * len(LANES)).reshape(len(LANES), 64)[k] < AGAIN_BITS).tolist()) for k in range(len(LANES))] for _ in range(AGAIN)]
    parts = F.array(*[F.xxhash64("key", F.lit(i), *[F.col(x).bitwiseAND(F.lit(m)) for x, m in zip(LANES, row, strict=True)]) for i, row in enumerate(masks)])
    dealt = keyed(nodes).join(small(full), "key", "left").withColumn("key", F.explode(F.when(F.col("full"), parts).otherwise(F.array("key")))).drop("full")
    return dealt.repartition(partitions(nodes), "key").sortWithinPartitions("key", "node").mapInArrow(meet(far, rooted), "a bigint, b bigint")


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, x, y) whose texts x and y have a Jaccard index of NEAR or more, as (a, b)."""
    up, down = NEAR
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = word_shingles(x.as_py()), word_shingles(y.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(down * both >= up * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text): a text of each node of ``wanted`` (node, tkey)."""
    return docs.select(F.xxhash64("text").alias("tkey"), "text").join(small(durable(wanted)), "tkey").select("node", "text").dropDuplicates(["node"])


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' five-word Jaccard index is NEAR or more; only their texts are shuffled."""
    pairs = durable(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node").select("node", "tkey")
    texts = texts_of(docs, wanted)
    full = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return durable(full.mapInArrow(near_pairs, "a bigint, b bigint"))


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text) as (node, n, held): the number of shingles and their hashes."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [word_shingles(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "held"])


def joining(label: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of positions whose sets have a Jaccard index of NEAR or more, as many as join the labels that all such pairs join.

    Sets of the commonest label are not compared with each other.
    """
    up, down = NEAR
    n, size = len(sets), np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")]
    count = np.bincount(code, minlength=1)
    start = np.cumsum(count) - count
    label = np.unique(label, return_inverse=True)[1]
    for x in np.flatnonzero(label != np.bincount(label).argmax()):
        own = code[ends[x] - size[x] : ends[x]]
        both = np.bincount(holders[spread(start[own], count[own])], minlength=n)
        near = np.flatnonzero((down * both >= up * (size[x] + size - both)) & (label != label[x]))
        others, first = np.unique(label[near], return_index=True)
        yield from ((x, y) for y in near[first])
        label[np.isin(label, others)] = label[x]


def tile_links(tile: pa.Table) -> pa.Table:
    """Rows (node, root, held) to edges (a, b) that join their roots."""
    nodes = tile.column("node").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in tile.column("held")]
    found = np.array(list(joining(tile.column("root").to_numpy(), sets)), np.int64).reshape(-1, 2)
    a, b = nodes[found[:, 0]], nodes[found[:, 1]]
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def group_links(docs: DataFrame, rooted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verified edges (a, b) that join the roots of all texts which ``candidates`` connect.

    A group is compared in pairs of blocks of at most about ``BLOCK`` shingles each, and no pair of texts
    leaves a task but those that join two roots.  Small groups share a tile: what is compared beyond the candidates is exact too.
    """
    groups = components(candidates).toDF("node", "team")
    wanted = durable(groups.join(rooted.select("node", "tkey", "root"), "node"))
    sets = texts_of(docs, wanted.select("node", "tkey")).mapInArrow(set_rows, "node bigint, n bigint, held binary")
    held = durable(wanted.drop("tkey").join(sets, "node"))
    sized = durable(held.groupBy("team").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.lit(SPREAD), F.ceil(F.col("texts") / CUT)))
    large = sized.select("team", blocks.alias("blocks")).filter("blocks > 1")
    tiles = max(1, math.ceil((sized.agg(F.sum("n").alias("n")).first()["n"] or 0) / BLOCK))
    block = F.pmod(F.xxhash64("node"), "blocks")
    cut = held.join(small(durable(large)), "team", "left").withColumn("block", block)
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), F.col("block"))))
    dealt = cut.withColumn("other", other).select(
        F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("team"), F.lit(tiles))).otherwise(F.col("team")).alias("team"),
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "root", "held",
    )
    return durable(dealt.groupBy("team", "low", "high").applyInArrow(tile_links, "a bigint, b bigint"))


def near_links(docs: DataFrame, rows: DataFrame, radius: int, hot: int) -> DataFrame:
    """Verified edges (a, b) between nodes whose five-word Jaccard index is NEAR or more.

    Each node's least candidate is verified first, which joins large groups by stars.  All other
    candidates that are in different components by then, and those of the tables beyond the first ones, are
    compared by groups, so that none is dropped by a number.
    """
    nodes = durable(rows.groupBy("node").agg(F.min("tkey").alias("tkey"), *[F.min(x).alias(x) for x in LANES]))
    codes = durable(nodes.groupBy(F.col("f0").alias("fp")).agg(F.min("node").alias("least")))
    coded = similar_edges(codes, radius, hot, "least").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    same = nodes.join(codes, nodes["f0"] == codes["fp"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    pairs = durable(table_pairs(nodes, hot).unionByName(coded).unionByName(same).filter("a != b").distinct())
    found = verified(docs, nodes, pairs.groupBy("a").agg(F.min("b").alias("b")))
    rooted = durable(nodes.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")))
    root = rooted.select("node", "root")
    left = pairs.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").filter("ra != rb").select("a", "b")
    return found.unionByName(group_links(docs, rooted, table_pairs(rooted, hot).unionByName(left)))


def keep_one(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` but those whose doc_id is not the least of their component of near copies; null doc_ids stay.

    Near copies are texts whose sets of five-word shingles have a Jaccard index of 0.8 or more,
    up to collisions of 64-bit hashes.  No other pair links; of those pairs, the share that is
    found is measured in the tests.
    """
    rows = durable(wide_rows(docs))
    roots = components(near_links(docs, rows, radius, hot))
    per_node = durable(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")).join(roots, "node", "left"))
    linked = per_node.filter("root is not null")
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(whole, "root").select("node", "component_id")
    alone = per_node.filter("root is null and rows > 1").select("node", F.col("least").alias("component_id"))
    lost = rows.join(named.unionByName(alone), "node").filter(F.col("doc_id") != F.col("component_id"))
    lost = small(durable(lost.select(F.col("doc_id").alias("__sh_id"), F.col("tkey").alias("__sh_key")).distinct()))
    return docs.join(lost, (docs["doc_id"] == F.col("__sh_id")) & (F.xxhash64(docs["text"]) == F.col("__sh_key")), "left_anti")
