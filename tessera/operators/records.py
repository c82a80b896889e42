"""Cleaning, numbering and checking of records: names, types, batches, validation, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import contains, round6, tokens
from tessera.operators.numbering import place_in_group

#: Other names of entity types: fixed values.
TYPE_ALIASES = {"COMPANY": "ORG", "ORGANIZATION": "ORG", "ORGANISATION": "ORG", "LOCATION": "GPE", "PLACE": "GPE", "PERSON_NAME": "PERSON", "EMPLOYEEID": "EMPLOYEE_ID"}


def strip_extensions(name: Column) -> Column:
    """A file name without its stacked extensions."""
    return F.regexp_replace(name, r"(?i)(\.(json|jpe?g|png|tiff?|pdf))+$", "")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def entity_type(name: Column, aliases: dict[str, str] = TYPE_ALIASES) -> Column:
    """The type in capitals and underscores, under its usual name; UNKNOWN if there is none."""
    plain = F.translate(F.upper(F.trim(name)), "- ", "__")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.when(F.coalesce(plain, F.lit("")) == "", "UNKNOWN").otherwise(F.coalesce(F.try_element_at(known, plain), plain))


def person_folder(folder: Column) -> Column:
    """Number and name of a folder called ``number-name``; nulls for any other."""
    pick = lambda i: F.nullif(F.regexp_extract(folder, r"^(\d+)-(.+)$", i), F.lit(""))
    return F.struct(pick(1).alias("person_id"), pick(2).alias("person_name"))


def research_lens(text: Column, most: int = 10) -> Column:
    """Entries between commas or line ends, trimmed, each once whatever its case, in order."""
    entries = F.filter(F.transform(F.split(text, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(entries, F.lower)
    return F.slice(F.filter(entries, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def heuristic_score(*measures: tuple[Column, float]) -> Column:
    """The sum of up to 25 points for each measure, scaled so that its full value earns them."""
    return sum((F.least(F.lit(25.0), 25.0 * value / full) for value, full in measures), F.lit(0.0))


def copies(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The first key of each distinct text and how many rows have it."""
    return docs.groupBy(F.xxhash64(text).alias("h"), F.md5(text).alias("digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies")).drop("h", "digest")


def number_in_group(rows: DataFrame, group: str, order: str, size: int, groups: int) -> DataFrame:
    """``batch`` (so many rows each) and ``turn`` (dealt in turn) of each row in its group."""
    place = F.col("__place")
    return place_in_group(rows, group, order, name="__place").withColumns({"batch": F.floor(place / size).cast("int"), "turn": (place % groups).cast("int")}).drop("__place")


def overlaps(chunks: DataFrame, doc: str, index: str, text: str, length: int) -> DataFrame:
    """What ends the chunk before and what starts the one after."""
    by = Window.partitionBy(doc).orderBy(index)
    return chunks.withColumns({"overlap_previous": F.right(F.lag(text).over(by), F.lit(length)), "overlap_next": F.left(F.lead(text).over(by), F.lit(length))})


def length_stats(rows: DataFrame, length: Column) -> DataFrame:
    """Count, sum, smallest, upper median and largest, from one row for each distinct length."""
    counts = rows.where(length.isNotNull()).groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("n").over(running), "all": F.sum("n").over(Window.partitionBy())})
    return ranked.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("length")).alias("total"),
        F.min("length").alias("least"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("length"))).alias("p50"),
        F.max("length").alias("most"),
    )


def keyword_fallback(docs: DataFrame, key: str, text: str, words: list[str], limit: int) -> DataFrame:
    """Documents with any of the words, those with most of them first."""
    hits = sum((contains(F.col(text), w).cast("int") for w in words), F.lit(0))
    return docs.select(key, hits.alias("matched")).where("matched > 0").orderBy(F.desc("matched"), key).limit(limit)


def text_checks(text: Column, least_words: int, least_years: int) -> Column:
    """Words and years of a text and whether both are enough."""
    n_words = F.size(tokens(text))
    n_years = F.coalesce(F.regexp_count(text, F.lit(r"\b(?:18|19|20)\d{2}\b")), F.lit(0))
    return F.struct(n_words.cast("long").alias("n_words"), n_years.cast("long").alias("n_years"), ((n_words >= least_words) & (n_years >= least_years)).alias("enough"))


def without_repeated_sentences(essays: DataFrame, key: str, text: str, parting: str = "\n\n") -> DataFrame:
    """Essays whose sentences stand once each, whatever their case: ``key``, ``n_paragraphs``, ``essay``.

    Sentences repeat if an earlier place of the same essay has them. A paragraph stays if at least
    half of its sentences, and one, are left. ``parting`` stands between paragraphs.
    """
    from tessera.functions.texts import split_sentences

    paragraphs = essays.select(key, F.posexplode(F.split(text, parting)).alias("p", "paragraph"))
    cut = paragraphs.select(key, "p", split_sentences(F.col("paragraph")).alias("s")).select(key, "p", F.size("s").alias("n"), F.posexplode("s").alias("i", "sentence"))
    copy = F.row_number().over(Window.partitionBy(key, F.lower("sentence")).orderBy("p", "i"))
    left = cut.withColumn("copy", copy).where("copy = 1").groupBy(key, "p", "n").agg(F.array_sort(F.collect_list(F.struct("i", "sentence"))).alias("s"))
    left = left.where(F.size("s") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).select(key, "p", F.array_join("s.sentence", " ").alias("paragraph"))
    return left.groupBy(key).agg(F.count(F.lit(1)).alias("n_paragraphs"), F.array_join(F.array_sort(F.collect_list(F.struct("p", "paragraph")))["paragraph"], parting).alias("essay"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of equal keys the row that comes first, whole."""
    first = rows.groupBy(F.xxhash64(key).alias("h"), F.md5(key).alias("digest")).agg(F.min(order).alias(order)).select(order)
    return rows.join(first, order, "left_semi")
