"""Exploration of a corpus: people's histories, batches, notebook merges, findings and evidence."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tessera.functions.scalars import contains, round6

# Kinds of event that start and that end a person's employment.
STARTS = ("hire", "application", "start")
ENDS = ("resignation", "furlough", "death", "separation", "termination")


def ordered_distinct(value: Column, place: Column) -> Column:
    """Aggregate: distinct values that are not blank, in order of first place."""
    rows = F.array_sort(F.collect_list(F.when(F.coalesce(value, F.lit("")) != "", F.struct(place.alias("p"), value.alias("v")))))
    return F.array_distinct(F.transform(rows, lambda r: r["v"]))


def employment(events: DataFrame) -> DataFrame:
    """Per ``person`` of ``person, place, kind, year, position, division``: what a career comes to.

    Positions and divisions once each in order, the earliest year of a starting event, the latest
    of an ending one and its kind (the first of equals; unknown without any).
    """
    kind = F.lower("kind")
    start = F.when(kind.isin(*STARTS), F.col("year"))
    ended = F.when(kind.isin(*ENDS) & F.col("year").isNotNull(), F.struct("year", (-F.col("place")).alias("place"), kind.alias("kind")))
    done = events.groupBy("person").agg(ordered_distinct(F.col("position"), F.col("place")).alias("positions"), ordered_distinct(F.col("division"), F.col("place")).alias("divisions"), F.min(start).alias("hire_year"), F.max(ended).alias("e"))
    return done.select("person", F.get("positions", F.lit(0)).alias("primary"), "positions", F.get("divisions", F.lit(0)).alias("division"), "hire_year", F.col("e.year").alias("separation_year"), F.coalesce("e.kind", F.lit("unknown")).alias("separation_type"))


def injuries(rows: DataFrame) -> DataFrame:
    """Per ``person`` of ``person, place, kind, payments`` (array of ``days, amount`` as text): counts and sums.

    A payment counts its days and amount if they are numbers; from the first that is not, the rest
    of that payment is left out.
    """
    each = rows.withColumn("pays", F.transform(F.coalesce("payments", F.array().cast("array<struct<days:string,amount:string>>")), lambda p: F.struct(F.coalesce(p["days"], F.lit("0")).try_cast("bigint").alias("days"), F.coalesce(p["amount"], F.lit("0")).try_cast("double").alias("amount"))))
    days = F.aggregate("pays", F.lit(0).cast("bigint"), lambda s, p: s + F.coalesce(p["days"], F.lit(0)))
    amount = F.aggregate("pays", F.lit(0.0), lambda s, p: s + F.when(p["days"].isNotNull(), F.coalesce(p["amount"], F.lit(0.0))).otherwise(0.0))
    done = each.groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.sum(days).alias("days"), F.sum(amount).alias("amount"), ordered_distinct(F.col("kind"), F.col("place")).alias("kinds"))
    return done.select("person", "n", "days", (F.floor(F.col("amount") * 100 + 0.5) / 100).alias("amount"), "kinds")


def batch_facets(docs: DataFrame, batch: str, facets: dict[str, Column], year: Column) -> DataFrame:
    """Per batch and facet value, the number of documents and their first and last year; one pass."""
    rows = docs.select(F.col(batch).alias("batch"), year.alias("year"), F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), v.cast("string").alias("value")) for n, v in facets.items()])).alias("x"))
    kept = rows.where("x.value is not null and x.value <> ''")
    return kept.groupBy("batch", F.col("x.facet").alias("facet"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("earliest"), F.max("year").alias("latest"))


def corpus_map(docs: DataFrame, year: Column) -> DataFrame:
    """Documents by decade, with the decade's share and whether it is the peak (the first of equals)."""
    by = docs.select((F.floor(year / 10) * 10).cast("long").alias("decade")).where("decade is not null").groupBy("decade").agg(F.count(F.lit(1)).alias("n"))
    ranked = by.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("n"), "decade")))
    return ranked.select("decade", "n", round6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"), (F.col("nth") == 1).alias("peak"))


def merge_patterns(found: DataFrame, high: int = 20, medium: int = 10) -> DataFrame:
    """Equal patterns of ``pattern, seq, evidence`` (an array) as one: its evidence, first text and confidence."""
    keyed = found.withColumn("key", F.lower(F.trim("pattern")))
    counted = keyed.select("key", F.explode("evidence").alias("entry")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_evidence"))
    done = keyed.groupBy("key").agg(F.min_by("pattern", "seq").alias("pattern"), F.count(F.lit(1)).alias("times")).join(counted, "key", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    level = F.when(F.col("n_evidence") >= high, "high").when(F.col("n_evidence") >= medium, "medium").otherwise("low")
    return done.withColumn("confidence", level)


def split_cached(batch: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a batch whose finding is known, with it, and those whose is not."""
    joined = batch.join(cache.select(key, F.col("finding").alias("known")), key, "left")
    return joined.where("known is not null").withColumnRenamed("known", "finding"), joined.where("known is null").drop("known")


def findings_in_batch(findings: DataFrame, batch: DataFrame) -> DataFrame:
    """Findings (``finding``, ``blocks``) with the documents of those of their blocks that are in the batch.

    A block is "document::block". Blocks outside the batch are dropped, and findings left without any.
    """
    each = findings.select("finding", F.posexplode("blocks").alias("i", "block")).withColumn("doc", F.split_part("block", F.lit("::"), F.lit(1)))
    inside = each.join(batch.select(F.col("block")).distinct(), "block", "left_semi")
    return inside.groupBy("finding").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "doc"))), lambda x: x["doc"])).alias("docs"))


def needs_repair(n_docs: Column, n_entities: Column, n_patterns: Column) -> Column:
    return (n_docs >= 6) & ((n_entities < 5) | (n_patterns < 2))


def evidence_pack(sources: DataFrame, most: int = 15) -> DataFrame:
    """The first ``most`` distinct documents of each question's references in order of ``source, seq``."""
    named = sources.withColumn("doc", F.split_part("ref", F.lit("::"), F.lit(1))).where("doc <> ''")
    first = named.groupBy("id", "doc").agg(F.min(F.struct("source", "seq")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("at", "doc"))).where(F.col("place") <= most).select("id", "doc", "place")


def evidence_cluster(seeds: DataFrame, hits: DataFrame, most_seeds: int = 5, most: int = 12) -> DataFrame:
    """Seeds (score 1) and then retrieved documents by score, each once, per query: ``query_id, doc, score, place``."""
    first = seeds.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("seq"))).where(F.col("nth") <= most_seeds)
    both = first.select("query_id", "doc", F.lit(1.0).alias("score"), F.lit(0).alias("kind"), "nth").unionByName(hits.select("query_id", "doc", "score", F.lit(1).alias("kind"), F.lit(0).alias("nth")))
    once = both.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "doc").orderBy("kind", "nth", F.desc("score")))).where("copy = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("kind", "nth", F.desc("score"), "doc"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("query_id", "doc", "score", "place")


def document_scores(hits: DataFrame) -> DataFrame:
    """Per query and document the best of score, fused rank, or one over the rank where there is no score."""
    value = F.coalesce("score", "rrf", 1 / F.col("rank"))
    return hits.groupBy("query_id", "doc").agg(round6(F.max(value)).alias("score"))


def pack_batches(docs: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Consecutive rows of each group in batches of at most ``budget``, at least one row each: adds ``batch``.

    Greedy packing is a fold, not a window: each group's sizes, two numbers a row, are folded in
    order. A group has to fit a task; split long ones into shards beforehand.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        batch, used, out = -1, budget + 1, []
        for n in pdf[size]:
            if used + n > budget or batch < 0:
                batch, used = batch + 1, 0
            used += n
            out.append(batch)
        return pdf.assign(batch=out)

    slim = docs.select(group, order, size)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    return slim.groupBy(group).applyInPandas(fold, f"{schema}, batch int")


def keyset_batches(docs: DataFrame, key: str, size: int) -> DataFrame:
    """``docs`` in batches of ``size`` by ascending key: adds ``batch``. Ranges are numbered first, so no
    task sorts the whole table."""
    ordered = docs.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).count()
    first = counts.select("part", (F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("first"))
    ranked = ordered.withColumn("part", part).join(F.broadcast(first), "part")  # one row for each partition
    return ranked.withColumn("batch", F.floor((F.col("first") + F.col("at").bitwiseAND(2**33 - 1)) / size).cast("int")).drop("at", "part", "first")


def employee_links(mentions: DataFrame) -> DataFrame:
    """Entities of ``entity, ids`` (an array) that share an employee id, at any remove, as one: ``entity, linked``."""
    from tessera.operators.components import connected_components

    held = mentions.select("entity", F.explode("ids").alias("id"))
    least = held.groupBy("id").agg(F.min("entity").alias("least"))
    parts = connected_components(held.join(least, "id").select("entity", "least"), "entity", "least")
    return mentions.select("entity").distinct().join(parts, F.col("entity") == F.col("vertex"), "left").select("entity", F.coalesce("component", "entity").alias("linked"))


def entity_groups(rows: DataFrame, order: list[str]) -> DataFrame:
    """Entities of ``doc, type, text, resolved``: once for each type and text whatever its case, resolved ones first.

    ``place`` numbers a document's entities by the order of types, other types by name, then text.
    """
    best = F.row_number().over(Window.partitionBy("doc", "type", F.lower("text")).orderBy(F.desc("resolved"), "text"))
    once = rows.where("text is not null and trim(text) <> ''").withColumn("nth", best).where("nth = 1").drop("nth")
    known = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("type"))
    rank = F.when(known > 0, known).otherwise(len(order) + 1)
    return once.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(rank, "type", F.lower("text"), "text")))


def metadata_filter(wanted: dict) -> Column:
    """A predicate from field to list (any of), dict of $gte, $gt, $lte, $lt (a range), or a value."""
    tests = {"$gte": Column.__ge__, "$gt": Column.__gt__, "$lte": Column.__le__, "$lt": Column.__lt__}
    out = F.lit(True)
    for field, value in wanted.items():
        column = F.col(field)
        if isinstance(value, list):
            out = out & column.isin(value)
        elif isinstance(value, dict):
            for sign, bound in value.items():
                out = out & tests[sign](column, bound)
        else:
            out = out & (column == value)
    return out


def optional_column(df: DataFrame, *names: str) -> Column:
    """The first of the columns that ``df`` has, else an empty text."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(""))


def json_fields(docs: DataFrame, text: str) -> DataFrame:
    """Field, type and presence count of a column of flat JSON objects."""
    held = docs.select(F.from_json(text, "map<string,string>").alias("x"), F.col(text).alias("raw")).where("x is not null").select(F.explode("x").alias("field", "value"))
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?\d+$"), "int").when(F.col("value").rlike(r"^-?\d+\.\d+$"), "double").when(F.col("value").isin("true", "false"), "bool").otherwise("str")
    return held.groupBy("field", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


#: Texts that say nothing: fixed values.
EMPTY_TEXTS = ("", "N/A", "null", "None")


def cleaned(value: Column, kind: DataType) -> Column:
    """A value without what is empty at any depth; null if nothing is left of it."""
    if kind.typeName() == "string":
        return F.when(~value.isin(*EMPTY_TEXTS), value)
    if kind.typeName() == "struct":
        fields = [(f.name, cleaned(value[f.name], f.dataType)) for f in kind.fields]
        some = reduce(lambda a, b: a | b, [c.isNotNull() for _, c in fields], F.lit(False))
        return F.when(value.isNotNull() & some, F.struct(*[c.alias(n) for n, c in fields]))
    if kind.typeName() == "array":
        kept = F.filter(F.transform(value, lambda x: cleaned(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if kind.typeName() == "map":
        kept = F.map_filter(F.transform_values(value, lambda _, x: cleaned(x, kind.valueType)), lambda _, x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    return value


def without_empty(df: DataFrame) -> Column:
    """A row as JSON without nulls, texts that say nothing, and lists and objects that this leaves empty, at any depth."""
    kept = [cleaned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "true"})


def keyword_retriever(docs: DataFrame, query: str, fields: list[str], where: dict | None = None, limit: int = 20, key: str = "doc_id") -> DataFrame:
    """Documents that hold the whole query in any of the fields and fit the metadata filter, by key."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | contains(F.col(f), query)
    return docs.where(hit & metadata_filter(where or {})).select(key).orderBy(key).limit(limit)
