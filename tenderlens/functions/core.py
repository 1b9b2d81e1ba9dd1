"""Column helpers with the null rules of the domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters, digits and underscores, equal in Spark and DuckDB.
WORDS = r"[\p{L}\p{N}_]+"


def ladder(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that ``value`` is below; ``last`` above all."""
    out = None
    for bound, label in steps:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return out.otherwise(last)


def above(value: Column, steps: Sequence[tuple[float, str]], last: str) -> Column:
    """The label of the first bound that ``value`` reaches; ``last`` below all."""
    out = None
    for bound, label in steps:
        out = F.when(value >= bound, label) if out is None else out.when(value >= bound, label)
    return out.otherwise(last)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or ``empty`` where b is null or zero."""
    return F.coalesce(a / F.when(b != 0, b), F.lit(empty))


def share(a: Column, b: Column) -> Column:
    return 100.0 * ratio(a.cast("double"), b.cast("double"))


def count_if(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("bigint")


def avg0(value: Column) -> Column:
    """Average of what is not null, 0 where nothing is."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


def same(a: Column, b) -> Column:
    """Equality in which null equals null."""
    return a.eqNullSafe(b)


def different(a: Column, b) -> Column:
    return ~a.eqNullSafe(b)


def holds(a: Column, part: str) -> Column:
    """Case-insensitive substring test (percent signs of the pattern are dropped), false for null."""
    return F.coalesce(F.contains(F.lower(a), F.lit(part.replace("%", "").lower())), F.lit(False))


def compare(a: Column, op: str, b) -> Column:
    """<, <=, >, >= with null as false."""
    test = {"<": a.__lt__, "<=": a.__le__, ">": a.__gt__, ">=": a.__ge__}[op](b)
    return F.coalesce(test, F.lit(False))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are equal."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(both > 0, both))
