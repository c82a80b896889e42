"""Column functions over running text: token variants, windows, snippets, repeated sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not tell what a question asks for: fixed values.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "were", "was", "are", "how", "what", "when", "where", "why", "did", "does", "who", "into",
    "over", "between", "within", "their", "which", "these", "those", "have", "has", "about", "than", "then", "such", "also", "would", "could",
    "should", "during", "across", "under", "after", "before", "based",
)
#: Phrases of printed forms: fixed values.
FORM_PHRASES = ("questions to be asked", "have you ever", "are you now in good health", "do you", "i hereby apply", "i hereby certify")
#: A year, and a capitalised name: fixed values.
NAME = r"\b[A-Z][A-Za-z&.\-]{2,}\b"
YEAR = r"\b(?:18|19|20)\d{2}\b"


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def ascii_tokens(text: Column, least: int = 1) -> Column:
    """Runs of at least ``least`` letters a to z and digits, in lower case."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)), F.array().cast("array<string>"))


def plain_words(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of over two characters once all but a to z and digits is blank, without stop words; repeats stay."""
    blank = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^a-z0-9\s]", " ")
    left = F.array(*[F.lit(w) for w in stop])
    return F.filter(F.split(blank, r"\s+"), lambda w: (F.char_length(w) > 2) & ~F.array_contains(left, w))


def content_words(text: Column, most: int = 6, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """The ``most`` longest words of at least three letters that are no stop words, equals in order."""
    left = F.array(*[F.lit(w) for w in stop])
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z][a-z'-]{2,}"), F.lit(0)), lambda w: ~F.array_contains(left, w))
    ranked = F.sort_array(F.transform(words, lambda w, i: F.struct((-F.char_length(w)).alias("short"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda x: x["w"]), 1, most)


def cap_words(text: Column, most: int) -> Column:
    """The first words of a text, with an ellipsis where some are left out."""
    words = F.split(text, " ")
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("…"))).otherwise(text)


def labelled_year(text: Column) -> Column:
    """The first year after a label of a date ("Date:", "Dated", "Date of Injury"), as a number."""
    return F.nullif(F.regexp_extract(text, r"(?i)\bdate[d]?(?:\s+of\s+\w+)?\s*:?\s*[^\n]{0,30}?\b((?:18|19|20)\d{2})\b", 1), F.lit("")).cast("int")


def evidence_score(text: Column, question: str) -> Column:
    """Points of a text as evidence for a question.

    One for each of its words of three letters or more in the text, two for each capitalised name
    and each year, two less for a phrase of a printed form, one less for three question marks.
    """
    import re

    low = F.lower(F.coalesce(text, F.lit("")))
    held = lambda words, n: sum((F.when(F.contains(low, F.lit(w)), n).otherwise(0) for w in sorted(words)), F.lit(0))
    words = set(re.findall(r"[a-z0-9]{3,}", question.lower()))
    names = {w.lower() for w in set(re.findall(NAME, question))}
    years = set(re.findall(YEAR, question))
    less = F.when(any_of(low, FORM_PHRASES), 2).otherwise(0) + F.when(F.char_length(low) - F.char_length(F.replace(low, F.lit("?"), F.lit(""))) >= 3, 1).otherwise(0)
    return F.when((low == "") | F.lit(not words), 0).otherwise(held(words, 1) + held(names, 2) + held(years, 2) - less)


def best_window(text: Column, words: list[str], before: int = 300, after: int = 400, plain: int = 700) -> Column:
    """The text around the first hit of the longest word that it holds, else its start."""
    low = F.lower(text)
    ordered = sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))
    places = [F.nullif(F.locate(w, low), F.lit(0)) for w in ordered]
    at = F.coalesce(*places) - 1 if places else F.lit(None).cast("int")
    start = F.greatest(F.lit(0), at - before)
    return F.when(at.isNull(), F.left(text, F.lit(plain))).otherwise(F.substring(text, start + 1, at + after - start))


def split_sentences(text: Column) -> Column:
    """Sentences that end in a full stop, exclamation or question mark before white space."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s != "")


def first_text(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v.cast("string")), F.lit("")) for v in values])


def json_number(value: Column) -> Column:
    """A number that JSON can hold: null for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def whole_number(value: Column) -> Column:
    """A whole number from a number or a numeric string; null for anything else."""
    return value.cast("string").try_cast("double").try_cast("int")


def unfenced_json(text: Column) -> Column:
    """JSON text without the fence of a Markdown block around it."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*```$", ""))
