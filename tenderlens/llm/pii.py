"""Operator 5: personal data, found in the text as written and behind disguises, with source offsets.

Base spans are the matches of four patterns on the text itself.  The disguised ones are found
on a normalised text: homoglyphs fold one to one, then a transducer rewrites runs of spelled
digits ("four one" to 41, "plus" before them to +) and at/dot disguises ("[at]", " at ", "(dot)",
" dot ") and keeps, for every stretch it rewrites, where it came from.  Matches on the normalised
text map back to source characters; those that overlap no base span of their kind are added.

Bare words are weak disguises ("look at the dot com"): an address with a bare " at " or " dot "
counts only if it ends in a known top-level domain and neither side is an everyday word.

All searches take time linear in the text, so one very long word, number or run of spaces is
read like any other text.  Spans are (kind, start, end) in code points, end exclusive, sorted by
start and then kind.  Null and empty texts have no spans; null doc_ids pass through; repeated
rows give equal rows; an empty table gives an empty result; columns besides doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

ship(__name__)

#: The kinds in the order of the contract, and their patterns (fixed values).  Possessive
#: repeats and the test before a number only spare vain attempts; they change no match.
KINDS = ("email", "ip", "card", "phone")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
EMAIL_CHARS = NAME_CHARS | {"."}
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Look-alikes of Latin letters and signs, each for one character (fixed values).
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅοινΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。｡∙﹒﹫", "aeopcyxijsdhqwABEKMHOPCTXIJSoivABEZHIKMNOPTYX.....@", strict=True))
FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
FOLDED = re.compile("[" + "".join(map(re.escape, map(chr, FOLD))) + "]")

#: Spelled digits (fixed values).
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
NAMES = "|".join(DIGITS)
SPELLED = re.compile(rf"(?<![a-z])(?:plus[ -]++)?(?:{NAMES}|(?<![0-9])[0-9]++)(?:(?:[ -]++|[ ]*+[,.][ ]*+|[ ]++(?:dot|point)[ ]++)(?:{NAMES}|[0-9]++))+(?![a-z])", re.I)
TOKEN = re.compile(rf"(?P<plus>plus[ -]+)|(?P<name>{NAMES})|(?P<digits>[0-9]+)|(?P<dot>[ ]++(?:dot|point)[ ]+|[ ]*+[.][ ]*)|(?P<gap>[ -]+|[ ]*,[ ]*)", re.I)
#: What SPELLED needs besides digits.
NAMED = re.compile(NAMES, re.I)
#: An at sign, plain or in disguise; the spaces around a disguise belong to it.
AT = re.compile(r"[\[({<][ ]*+(?:at|@)[ ]*+[\])}>]|(?<= )at(?= )|_at_|@", re.I)
#: A dot in disguise, with its spaces.
DOT = re.compile(r"[ ]*+[\[({<][ ]*+(?:dot|\.)[ ]*+[\])}>][ ]*+|[ ]++dot[ ]++|[ ]*+_dot_[ ]*+", re.I)
MASKED_HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{DOT.pattern})[A-Za-z0-9-]++)+", re.I)
#: Top-level domains that a bare " at " or " dot " may lead to, and everyday words that are no part of an address there (fixed values).
DOMAINS = frozenset("com org net edu gov mil int info biz name io co ai app dev eu uk de fr es nl pl pt br ru cn jp kr ch se dk fi cz gr ie au nz ca mx za tr".split())
EVERYDAY = frozenset("a all an and are available based be been best by found go good he her here his hosted i if is it its live lives look looked looking looks me meet my noon not of on one only or our out page she site so that the their them then there they this to us visit was we website were what where which who will with work worked works you your".split())

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def back(text: str, at: int, floor: int, chars: frozenset[str] | str) -> int:
    """The start of the run of ``chars`` that ends at ``at``."""
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def addresses(text: str) -> list[Span]:
    """E-mail addresses: for each at sign in turn, the run of name characters before it and the host after it."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = back(text, at, done, EMAIL_CHARS)
        if start < at and (host := HOST.match(text, at + 1)):
            done = host.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return found


def plain_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    found = addresses(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() > 11 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


class Rewriter:
    """A text under rewriting; pieces remember the source characters that they stand for."""

    def __init__(self, text: str):
        self.source, self.out, self.at, self.length = text, [], 0, 0
        self.starts: list[int] = []  # in the new text
        self.pieces: list[tuple[int, int, bool]] = []  # source start and end; True if copied

    def put(self, new: str, start: int, end: int, copied: bool) -> None:
        if new:
            self.starts.append(self.length)
            self.pieces.append((start, end, copied))
            self.out.append(new)
            self.length += len(new)

    def replace(self, start: int, end: int, new: str) -> None:
        """``new`` stands for source[start:end]; what lies before is copied."""
        self.put(self.source[self.at : start], self.at, start, True)
        self.put(new, start, end, False)
        self.at = end

    def text(self) -> str:
        self.put(self.source[self.at :], self.at, len(self.source), True)
        self.at = len(self.source)
        return "".join(self.out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source characters of new[start:end]."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        first, last = self.pieces[i], self.pieces[j]
        return (first[0] + start - self.starts[i] if first[2] else first[0]), (last[0] + end - self.starts[j] if last[2] else last[1])


def digits_in(run: str) -> str:
    out = []
    for m in TOKEN.finditer(run):
        kind = m.lastgroup
        out.append({"plus": "+", "dot": ".", "gap": ""}.get(kind) if kind in ("plus", "dot", "gap") else DIGITS.get(m[0].lower(), m[0]))
    return "".join(out)


def dot_before(text: str, at: int, floor: int) -> int | None:
    """The start of the dot sign, plain or in disguise, that ends at ``at`` within a name."""
    if text[at : at + 5].lower() == "_dot_" and text[at + 5 : at + 6] in NAME_CHARS and (start := back(text, at, floor, " ")) < at:
        return start
    end = back(text, at, floor, " ")
    if end == floor:
        return None
    if text[end - 1] == "." and end == at:
        return at - 1
    if text[end - 1] in "])}>":
        inner = back(text, end - 1, floor, " ")
        word = 1 if text[inner - 1 : inner] == "." else 3 if text[max(floor, inner - 3) : inner].lower() == "dot" else 0
        start = back(text, inner - word, floor, " ")
        return back(text, start - 1, floor, " ") if word and start > floor and text[start - 1] in "[({<" else None
    if text[max(floor, end - 5) : end].lower() == "_dot_" and end < at:
        return back(text, end - 5, floor, " ")
    if text[max(floor, end - 3) : end].lower() == "dot" and end < at and (start := back(text, end - 3, floor, " ")) < end - 3:
        return start
    return None


def name_before(text: str, end: int, floor: int) -> int:
    """The start of the name (words joined by dots) that ends at ``end``; ``end`` itself where there is none."""
    start = back(text, end, floor, NAME_CHARS)
    while start < end and (dot := dot_before(text, start, floor)) is not None:
        word = back(text, dot, floor, NAME_CHARS)
        if word == dot:
            break
        start = word
    return start


def believable(sign: str, dots: list[str], first: str, host: str) -> bool:
    """A bare " at " or " dot " counts only before a known top-level domain and between words that are not everyday ones."""
    if sign.lower() != "at" and not any(d.strip(" ").lower() == "dot" for d in dots):
        return True
    labels = re.findall(r"[A-Za-z0-9-]+", DOT.sub(".", host))
    return labels[-1].lower() in DOMAINS and labels[0].lower() not in EVERYDAY and first.lower() not in EVERYDAY


def masked_signs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sign) of the disguised signs of all addresses; a host is looked at once, a name only before a host."""
    edits: list[tuple[int, int, str]] = []
    floor = 0
    for m in AT.finditer(text):
        start, end = m.span()
        if start < floor:
            continue
        if m[0] != "@":
            start = back(text, start, floor, " ")
            while end < len(text) and text[end] == " ":
                end += 1
        host = MASKED_HOST.match(text, end)
        if host is None:
            continue
        name = name_before(text, start, floor)
        if name == start:
            continue
        dots = [*DOT.finditer(text, name, start), *DOT.finditer(text, end, host.end())]
        if believable(m[0], [d[0] for d in dots], text[name:start], host[0]):
            edits += [(d.start(), d.end(), ".") for d in dots]
            if m[0] != "@":
                edits.append((start, end, "@"))
            floor = host.end()
    return edits


def normalised(text: str) -> Rewriter | None:
    """The transducer's work on ``text``, or None where it has nothing to do."""
    folded = text if text.isascii() or not FOLDED.search(text) else text.translate(FOLD)
    edits = masked_signs(folded)
    if NAMED.search(folded):
        edits += [(m.start(), m.end(), new) for m in SPELLED.finditer(folded) if NAMED.search(m[0]) and len(new := digits_in(m[0])) > 6]
    if folded is text and not edits:
        return None
    made, end = Rewriter(folded), 0
    for start, stop, new in sorted(edits):
        if start >= end:
            if len(new) == 1:
                made.replace(start, stop, new)
            else:  # a run of digits: each sign stands for the whole run's stretch, cut at its words
                for a, b, sign in words_of(folded, start, stop):
                    made.replace(a, b, sign)
            end = stop
    return made


def words_of(text: str, start: int, stop: int) -> list[tuple[int, int, str]]:
    out = []
    for m in TOKEN.finditer(text, start, stop):
        kind = m.lastgroup
        new = {"plus": "+", "dot": ".", "gap": ""}[kind] if kind in ("plus", "dot", "gap") else DIGITS.get(m[0].lower(), m[0])
        if kind == "digits":
            continue  # copied as it is
        out.append((m.start(), m.end(), new))
    return out


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base, all) spans, each by start and then kind."""
    order = lambda s: (s[1], KINDS.index(s[0]))
    base = sorted(plain_spans(text), key=order)
    made = normalised(text)
    if made is None:
        return base, base
    ends = {k: [e for kind, _, e in base if kind == k] for k in KINDS}  # spans of a kind don't overlap
    starts = {k: [s for kind, s, _ in base if kind == k] for k in KINDS}
    more = []
    for kind, start, end in plain_spans(made.text()):
        a, b = made.back(start, end)
        after = bisect_right(ends[kind], a)
        if after == len(ends[kind]) or starts[kind][after] >= b:
            more.append((kind, a, b))
    return base, sorted(base + more, key=order)


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base and found (arrays of kind, start, end)."""

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [spans(t.as_py() or "") for t in batch.column("text")]
            cols = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x[i]] for x in both], span) for i in (0, 1)]
            digest = [hashlib.sha256(joined(x[0]).encode()).hexdigest() for x in both]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols, pa.array(digest, pa.string()), pa.array([joined(x[1]) for x in both], pa.string())], ["doc_id", "base", "found", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spanned = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {spanned}, found {spanned}, base_sha256 string, spans string")
