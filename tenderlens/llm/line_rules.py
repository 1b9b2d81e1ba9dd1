"""Operator 8: line-first cleaning, with Spark functions only.

Every line with a word is judged alone: it must hold the end of a sentence and not shout
(punctuation), not be a run of links or table cells (navigation), and not be a known notice
(boilerplate).  Failed lines go; a document that keeps too small a part of its word
characters is rejected, and so is one that fails the base rules.

Null and empty texts have no words and fail; very long texts and lines are read whole.  Null doc_ids pass
through; repeated rows give equal rows; of equal lines or windows all but the first line count as
copies, and all windows.  An empty table gives an empty result; columns besides doc_id and text
are ignored, whatever their names.  Windows of five words are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let

WINDOW, LEAST_KEPT = 5, 0.5
SYMBOLS = r"[#*$%&|<>]"
#: Notices that fail a line (fixed values).
BOILERPLATE = r"(?i)lorem ipsum|cookie policy|accept (all )?cookies|privacy policy|terms of (use|service)|all rights reserved|enable javascript|click here|subscribe to our|sign up for our|skip to (main )?content|read more$"
NAVIGATION = r"^[^|»›>]{0,60}([|»›>][^|»›>]{0,60}){3,}$"
#: The same for Java, whose matcher else recurses once per cell: parts are disjoint, so nothing is ever given back.
NAVIGATION_NOW = r"^[^|»›>]{0,60}+(?:[|»›>][^|»›>]{0,60}+){3,}+$"
ENDING = r"[.!?:;…。！？][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of ``size`` words that occur twice or more, the first time included."""
    last = F.size(words) - size
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
            return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(let(pairs, places), total)

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))
    return F.when(last < 1, F.lit(0).cast("bigint")).otherwise(found)


def line_kept(line: Column) -> Column:
    shouted = F.regexp_count(line, F.lit(r"![\x20\x09-\x0D]")) * 3 > F.regexp_count(line, F.lit(SPACES)) + 1
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) * 10 > F.char_length(line)
    return line.rlike(ENDING) & ~shouted & ~symbols & ~line.rlike(NAVIGATION_NOW) & ~line.rlike(BOILERPLATE)


def size_of(text: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.regexp_replace(text, SPACES, "")).cast("bigint")


def line_rules(docs: DataFrame, least_kept: float = LEAST_KEPT) -> DataFrame:
    """One row per input row: the base measures and verdict, the cleaned text and the method's verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def measures(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"), F.char_length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def by_line(ls: Column) -> Column:
        return F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"), F.array_join(F.filter(ls, line_kept), "\n").alias("clean_text"))

    m = docs.select("doc_id", let(words_of(text), measures).alias("w"), let(lines, by_line).alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"))
    failed = (F.col("w.n_words") < 10) | (100 * F.col("w.n_repeat_words") > 20 * F.col("w.n_words"))
    kept_chars = size_of(F.col("l.clean_text"))
    return m.select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"),
        (~failed & (kept_chars >= F.lit(least_kept) * F.col("w.word_chars"))).alias("kept"), kept_chars.alias("kept_chars"), F.col("l.clean_text"),
    )
