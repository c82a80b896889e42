"""A research notebook as tables: findings of a batch are merged into what earlier batches left, in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTITY_STATE = "key string, name string, type string, document_count long, contexts array<string>, first_block string, last_block string"


def merge_entities(findings: DataFrame, state: DataFrame | None = None, per_merge: int = 3, most: int = 10) -> DataFrame:
    """Entities by lower-case trimmed name: the columns of ``ENTITY_STATE``.

    ``findings`` has ``seq, name, type, contexts, first_block, last_block``; ``state`` is an earlier
    result, which comes before all findings. Every finding counts once. The first one (or the
    state) gives name and type and all its contexts; each later one adds its first ``per_merge``,
    and once something was added ``most`` contexts stay. Blocks are the first and the last that are
    named. Null and empty names and contexts are left out. Contexts are ranked before they are
    gathered, so a name that a third of all findings have is no array of that size.
    """
    new = findings.where("name is not null and name <> ''").select(
        F.lower(F.trim("name")).alias("key"), F.struct(F.lit(1).alias("late"), F.col("seq").cast("long").alias("seq")).alias("place"), "name", F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")).alias("type"),
        F.lit(1).cast("long").alias("document_count"), "contexts", F.nullif("first_block", F.lit("")).alias("first_block"), F.nullif("last_block", F.lit("")).alias("last_block"),
    )
    if state is not None:
        known = state.select("key", F.struct(F.lit(0).alias("late"), F.lit(0).cast("long").alias("seq")).alias("place"), "name", "type", "document_count", "contexts", "first_block", "last_block")
        new = known.unionByName(new)
    named = lambda column, pick: pick(F.when(F.col(column).isNotNull(), F.struct("place", column)))[column].alias(column)
    merged = new.groupBy("key").agg(
        F.min_by("name", "place").alias("name"), F.min_by("type", "place").alias("type"), F.sum("document_count").alias("document_count"), F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"),
        named("first_block", F.min), named("last_block", F.max),
    )
    said = new.select("key", "place", F.filter("contexts", lambda c: c.isNotNull() & (c != "")).alias("contexts")).select("key", "place", F.posexplode("contexts").alias("at", "context"))
    said = said.join(merged.select("key", "first", "rows"), "key").where((F.col("at") < per_merge) | (F.col("place") == F.col("first")))
    ranked = said.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("place", "at"))).where((F.col("nth") <= most) | (F.col("rows") == 1))
    kept = ranked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "context"))).alias("kept"))
    contexts = F.coalesce(F.transform("kept", lambda x: x["context"]), F.array().cast("array<string>"))
    return merged.join(kept, "key", "left").select("key", "name", "type", "document_count", contexts.alias("contexts"), "first_block", "last_block")


def merge_counts(batch: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The corpus map's counts, ``kind, name, n``, with those of an earlier map added.

    Counts by ``year`` also count for their decade; names of years that are no numbers have none.
    """
    rows = batch.select("kind", "name", F.col("n").cast("long").alias("n"))
    decade = F.expr("try_cast(name as int)")
    decades = rows.where("kind = 'year'").select(F.lit("decade").alias("kind"), F.floor(decade / 10) * 10, "n").toDF("kind", "name", "n").where("name is not null").withColumn("name", F.col("name").cast("string"))
    every = rows.unionByName(decades)
    if state is not None:
        every = every.unionByName(state.select("kind", "name", "n"))
    return every.groupBy("kind", "name").agg(F.sum("n").alias("n"))


def coverage(counts: DataFrame) -> DataFrame:
    """First and last year, gaps in decades and the fullest decade of a corpus map: one row."""
    years = counts.where("kind = 'year'").select(F.expr("try_cast(name as int)").alias("year")).where("year is not null")
    span = years.agg(F.min("year").alias("start"), F.max("year").alias("end"))
    decades = counts.where("kind = 'decade'").select(F.col("name").cast("int").alias("decade"), "n")
    peak = decades.agg(F.max_by("decade", F.struct("n", (-F.col("decade")).alias("early"))).alias("peak"))
    first, last = ((F.floor(F.col(c) / 10) * 10).cast("int") for c in ("start", "end"))
    every = span.select(F.explode(F.sequence(first, last, F.lit(10))).alias("decade"))
    gaps = every.join(decades, "decade", "left_anti").agg(F.array_join(F.sort_array(F.collect_list("decade")), ",").alias("gaps"))
    return span.crossJoin(peak).crossJoin(gaps)


def merge_indicators(findings: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Evidence of group indicators, each document once: ``key, type, label, doc``, with that of an earlier state.

    ``findings`` has ``type, label, evidence`` (an array of documents or document::block). Indicators
    without a label or of an unknown type are left out. The label is the first one in letter order.
    """
    kind, label = F.lower(F.coalesce("type", F.lit("unknown"))), F.trim(F.coalesce("label", F.lit("")))
    rows = findings.select(kind.alias("type"), label.alias("label"), F.explode_outer("evidence").alias("entry")).where("label <> '' and type <> 'unknown'")
    rows = rows.select(F.concat("type", F.lit(":"), F.lower("label")).alias("key"), "type", "label", F.nullif(F.split_part("entry", F.lit("::"), F.lit(1)), F.lit("")).alias("doc"))
    every = rows if state is None else rows.unionByName(state.select("key", "type", "label", "doc"))
    return every.groupBy("key", "type", "doc").agg(F.min("label").alias("label")).select("key", "type", "label", "doc")


def indicator_levels(evidence: DataFrame, high: int = 5, medium: int = 3) -> DataFrame:
    """Indicators with the number of their documents and what that says: ``key, type, label, n_documents, confidence``."""
    n = evidence.groupBy("key", "type").agg(F.min("label").alias("label"), F.count("doc").alias("n_documents"))
    return n.withColumn("confidence", F.when(F.col("n_documents") >= high, "high").when(F.col("n_documents") >= medium, "medium").otherwise("low"))


def summary(entities: DataFrame, patterns: DataFrame, top: int = 20) -> DataFrame:
    """What a notebook shows first: its ``top`` entities by count and its patterns of high confidence, as ``part, name, n``."""
    first = entities.orderBy(F.desc("document_count"), "key").limit(top).select(F.lit("entity").alias("part"), F.col("name"), F.col("document_count").alias("n"))
    sure = patterns.where("confidence = 'high'").select(F.lit("pattern").alias("part"), F.col("pattern").alias("name"), F.col("n_evidence").cast("long").alias("n"))
    totals = entities.agg(F.lit("total").alias("part"), F.lit("entities").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(patterns.agg(F.lit("total").alias("part"), F.lit("patterns").alias("name"), F.count(F.lit(1)).alias("n")))
    return totals.unionByName(first).unionByName(sure)
