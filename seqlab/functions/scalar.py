"""Scalar and array helpers (X-05..X-09), all JVM-side expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Volume numerals searched in this order, with the number each
# one maps to.  The Bopomofo letter U+3127 is what the published dictionary
# uses for "one"; the ordinary numeral U+4E00 is accepted unless strict.
VOLUME_NUMERALS = [("六", 6), ("五", 5), ("四", 4), ("三", 3), ("二", 2), ("ㄧ", 1)]
PLAIN_ONE = "一"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def volume_code(col, strict: bool = False) -> Column:
    """X-05: first numeral (in dictionary order) contained in the name, else 0."""
    name = _c(col)
    expr = None
    pairs = list(VOLUME_NUMERALS)
    if not strict:
        pairs.append((PLAIN_ONE, 1))
    for ch, num in pairs:
        cond = F.coalesce(name.contains(ch), F.lit(False))
        expr = F.when(cond, F.lit(num)) if expr is None else expr.when(cond, F.lit(num))
    return expr.otherwise(F.lit(0)).cast("int")


def answer_letter(col) -> Column:
    """X-06 / G-15: the third character of an answer string."""
    return F.substring(_c(col), 3, 1)


def array_text(col, sep: str = ",") -> Column:
    """Array -> text with nulls written as 'null' (hash-stable array output)."""
    return F.array_join(F.transform(_c(col), lambda x: F.coalesce(x.cast("string"), F.lit("null"))), sep)


def safe_get(col, pos1: int) -> Column:
    """Q-04: 1-based element or null when the array is shorter (no ANSI error)."""
    return F.get(_c(col), pos1 - 1)


def count_value(col, value) -> Column:
    """X-08: number of elements equal to ``value``."""
    return F.size(F.filter(_c(col), lambda x: x == F.lit(value)))


def all_equal_first(col) -> Column:
    """F-12: every element equals the first one (null-safe)."""
    return F.forall(_c(col), lambda x: x.eqNullSafe(F.get(_c(col), 0)))
