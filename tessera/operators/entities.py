"""Rule-based entities, names, and fuzzy links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def employee_ids(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z]*\d{3,5}[A-Z]?\b"), F.lit(0))))


def parse_name(name: Column) -> Column:
    """First, middle and last name of "Last, First M" or "First M Last", and the full name.

    A single word is a first name. Only the second word of several is a middle name. The full name
    keeps two blanks where there is no middle name.
    """
    plain = F.trim(name)
    comma = F.contains(plain, F.lit(","))
    words = lambda x: F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
    rest = words(F.regexp_extract(plain, r"(?s)^[^,]*,(.*)$", 1))
    every = words(plain)
    at = lambda x, i: F.coalesce(F.get(x, F.lit(i)), F.lit(""))
    first = F.when(comma, at(rest, 0)).otherwise(at(every, 0))
    middle = F.when(comma, at(rest, 1)).otherwise(F.when(F.size(every) > 2, every[1]).otherwise(""))
    last = F.when(comma, F.trim(F.substring_index(plain, ",", 1))).otherwise(F.when(F.size(every) > 1, F.element_at(every, -1)).otherwise(""))
    return F.struct(first.alias("first"), middle.alias("middle"), last.alias("last"), F.trim(F.concat_ws(" ", first, middle, last)).alias("full"))


def aggregate_entities(mentions: DataFrame) -> DataFrame:
    """Per entity: how many documents mention it, the first and last of them."""
    return mentions.groupBy(F.lower("ent").alias("term"), "type").agg(F.count(F.lit(1)).alias("frequency"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))


def normalise_label(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"[.\-]", " "), r"\s+", " "))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * (longest common subsequence) / (sum of lengths)."""
    if not a and not b:
        return 100.0
    # Bits of `row` mark where the longest common subsequence of a[:i] and the read part of b grows.
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def fuzzy_links(terms: DataFrame, references: DataFrame, least: float = 90.0) -> DataFrame:
    """The best reference for each term by :func:`indel_ratio`, among those that share a block.

    Two strings within the threshold differ in length by a bounded share, so lengths fall in the
    same or a neighbouring band; a block is a band and a pair of letters of both. Every pair over
    the threshold with at least four letters shares one.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype=float)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(name) - 1, F.lit(1))), lambda i: F.substring(F.col(name), i, F.lit(2))))
        return df.select(name, F.explode(pairs).alias("block"))

    met = blocks(terms.select("term").distinct(), "term").join(blocks(references.select("reference").distinct(), "reference"), "block").select("term", "reference").distinct()
    short, long = F.least(F.char_length("term"), F.char_length("reference")), F.greatest(F.char_length("term"), F.char_length("reference"))
    near = met.where(200 * short >= least * (short + long)).withColumn("score", score("term", "reference")).where(F.col("score") >= least)
    best = Window.partitionBy("term").orderBy(F.desc("score"), "reference")
    return near.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")


def link_terms(terms: DataFrame, references: DataFrame, least: float = 90.0) -> DataFrame:
    """Terms (``term, frequency``) with an entry of a knowledge base (``reference, kb_id``): ``term, kb_id, how, score, frequency``.

    An equal reference links exactly, else the best one of :func:`fuzzy_links`, else the term gets an
    id of its own, made from its letters. Frequencies of equal terms are added, each counted once;
    of several entries for a reference the one with the smallest id counts.
    """
    counted = terms.where("term is not null and term <> ''").groupBy("term").agg(F.sum("frequency").alias("frequency"))
    known = references.where("reference is not null").groupBy("reference").agg(F.min("kb_id").alias("kb_id"))
    exact = counted.join(known, F.col("term") == F.col("reference")).select("term", "kb_id", F.lit("exact").alias("how"), F.lit(100.0).alias("score"), "frequency")
    open_ = counted.join(known, F.col("term") == F.col("reference"), "left_anti")
    near = fuzzy_links(open_.select("term"), known.select("reference"), least)
    linked = open_.join(near, "term", "left").join(known, "reference", "left")
    own = F.concat(F.lit("own:"), F.substring(F.md5(F.col("term").cast("binary")), 1, 16))
    rest = linked.select("term", F.coalesce("kb_id", own).alias("kb_id"), F.when(F.col("kb_id").isNull(), "new").otherwise("fuzzy").alias("how"), "score", "frequency")
    return exact.unionByName(rest)
