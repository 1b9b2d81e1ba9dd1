"""Operator 9: shortest-pack-first packing over the histogram of piece lengths.

Texts are tokenized by distinct words: a batch's words are dictionary-encoded, each distinct
word is encoded once, and the ids are gathered back; white space never joins words, so this
equals encoding whole texts.  A document's ids, then id 1, are cut into full sequences and a
rest.  The histogram of rest lengths (at most ``width`` bins) is packed on the driver: lengths
go longest first into the pack with the most room, counting packs of equal pattern together.
Pieces get a rank among those of their length, and the patterns' rank intervals give each
piece its sequence and offset, in batches, against a bounded table.

Null and empty texts are one piece of one token; very long texts become as many full pieces as
they need.  Repeated rows are packed once per row, and equal ones may exchange places; ties of a
length go by doc_id, start and checksum, null doc_ids among them.  An empty table gives an empty
result; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ranked, ship

ship(__name__)

WIDTH, END = 2048, 1
#: Pre-token pattern of the vocabulary file, for lower-cased plain words, and the end of a word's row (fixed value).
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|\n|[^a-z0-9ß-öø-ſ\n]+")
#: What plain words do not hold: signs beyond ASCII and Latin letters, a capital whose lower case is two signs, and the start of special tokens.
ODD = re.compile(r"[^\n\x21-\x7EÀ-įı-ſ]|<\|")


class Words:
    """Ids of distinct words under a word-end BPE vocabulary file.

    Words of plain Latin letters, digits and ASCII signs go through a byte-pair encoder built
    from the same vocabulary, with byte 0 standing for the end of a piece; all other words go
    through the vocabulary's own tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.own = path, None
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks: dict[bytes, int] = {}
        for token, i in vocab.items():
            body, end = (token[:-4], b"\0") if token.endswith("</w>") else (token, b"")
            if not token.startswith("<|") and (code := bytes(chars[c] for c in body) + end) != b"\0":
                ranks[code] = i
        ranks[b"\0"] = max(vocab.values()) + 1
        self.line = ranks[b"\n\0"]
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def plain(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids per word) of plain words, each ended by a line feed."""
        ids = np.asarray(self.fast.encode_to_numpy("\0".join(PIECES.findall(lines.lower())) + "\0"), dtype=np.uint32)
        stops = np.flatnonzero(ids == self.line)
        return np.delete(ids, stops), np.diff(np.concatenate(([-1], stops))) - 1

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py() + "\n"
        if not ODD.search(lines):
            return self.plain(lines)
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path)
        rows = lines.split("\n")[:-1]
        odd = [i for i, w in enumerate(rows) if ODD.search(w)]
        found = [np.asarray(e.ids, np.uint32) for e in self.own.encode_batch([rows[i] for i in odd], add_special_tokens=False)]
        for i in odd:
            rows[i] = ""
        ids, counts = self.plain("\n".join(rows) + "\n")
        starts = np.cumsum(counts) - counts
        parts, at = [], 0
        for i, own in zip(odd, found, strict=True):
            parts += [ids[at : starts[i]], own]
            at = starts[i]
            counts[i] = len(own)
        return np.concatenate([*parts, ids[at:]]), counts


def cut_pieces(path: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        end = np.array([END], np.uint32).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            coded = lists.flatten().dictionary_encode()
            flat, count = words(coded.dictionary)
            start = np.cumsum(count) - count
            codes, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            row, begin, size, crc, total = [], [], [], [], []
            at = 0
            while at < batch.num_rows:  # documents of about a million words at a time
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 1_000_000, "right")) - 1)
                mine = codes[offsets[at] : offsets[to]]
                lens = count[mine]
                ends = np.cumsum(lens)
                ids = flat[np.repeat(start[mine] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4")
                bounds = np.concatenate(([0], ends))[offsets[at : to + 1] - offsets[at]]
                for i in range(at, to):
                    own = ids[bounds[i - at] : bounds[i - at + 1]]
                    n = len(own) + 1
                    for s in range(0, n, width):
                        code = zlib.crc32(own[s : s + width].tobytes())
                        length = min(width, n - s)
                        row.append(i)
                        begin.append(s)
                        size.append(length)
                        crc.append(zlib.crc32(end, code) if s + length == n else code)
                        total.append(n)
                at = to
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (begin, size, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def shortest_first(histogram: dict[int, int], width: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, number of such sequences) for the histogram of lengths."""
    packs: list[tuple[int, int, list[int], int]] = []  # (-room, age, lengths, number), most room first
    age = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                room, _, lengths, number = heapq.heappop(packs)
                used = min(left, number)
                if number > used:
                    heapq.heappush(packs, (room, age, lengths, number - used))
                heapq.heappush(packs, (room + length, age + 1, [*lengths, length], used))
            else:
                used = left
                heapq.heappush(packs, (length - width, age + 1, [length], used))
            age += 2
            left -= used
    return [(lengths, number) for _, _, lengths, number in sorted(packs, key=lambda p: p[1])]


def intervals(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): pieces of a length, in rank order, to sequences."""
    out, base = [], 0
    used: dict[int, int] = {}
    for lengths, number in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + number
            offset += length
        base += number
    return sorted(out)


def placed(table: list[tuple[int, int, int, int]]):
    keys, firsts, bases, offsets = (np.array(x, np.int64) for x in zip(*table, strict=True)) if table else (np.zeros(0, np.int64),) * 4
    bounds = keys << np.int64(44) | firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(bounds, batch.column("length").to_numpy() << np.int64(44) | rank, "right") - 1
            sequence, offset = bases[at] + rank - firsts[at], offsets[at]
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, tokenizer: str, width: int = WIDTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = docs.select("doc_id", "text").mapInArrow(cut_pieces(tokenizer, width), fields)
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")]
    rows, counts = ranked(pieces, ["length"], order, small_keys=True)
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most ``width`` rows
    table = intervals(shortest_first(histogram, width))
    return rows.mapInArrow(placed(table), fields + ", sequence_id bigint, offset bigint")
