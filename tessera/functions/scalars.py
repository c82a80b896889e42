"""Column functions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def round6(x: Column) -> Column:
    """Half-up rounding to six places, the same in every engine."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Lower-case tokens in order, empty for a null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def contains(field: Column, term: str) -> Column:
    """Case-insensitive literal substring; false for a null."""
    return F.coalesce(F.contains(F.lower(field), F.lit(term.lower())), F.lit(False))


def missing(field: Column) -> Column:
    return field.isNull() | (field == "")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision and in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def years(text: Column) -> Column:
    """Distinct years 1800 to 2099 named in a text, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:18|19|20)\d{2}\b"), F.lit(0))))


#: Words by which a log line tells its level, the first level that fits: fixed values.
LEVELS = {
    "error": ("error", "failed", "exception", "traceback"),
    "warning": ("warning", "warn"),
    "success": ("complete", "success", "done", "finished"),
    "primary": ("===", "starting", "begin", "---"),
}


def level_of(message: Column) -> Column:
    """The level a log line speaks of."""
    low = F.lower(message)
    found = [F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), level) for level, words in LEVELS.items()]
    return F.coalesce(*found, F.lit("info"))
