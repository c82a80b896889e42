"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How each source's weight moves from the start of training to its end, by place in the list of
#: weights: w(u) = w * (1 + tilt * (2 u - 1)). Heavy sources lead, light ones follow.
TILTS = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, tilts=TILTS) -> DataFrame:
    """Per source: ``source_size``, ``weight``, ``tilt`` and ``target``.

    ``sizes`` has ``source`` and ``size``. Sources in code point order, null last, take the
    weights in turn. ``share`` of all sizes is dealt by weight; a target stops at ``most`` times
    its source's size and the excess is dealt again by weight until none is above. That is a
    common level of target per weight, found by going through sources in order of cap per
    weight. One row per source is all that meets in a task.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("place") % len(values) + 1).cast("int"))
    total = total.withColumn("place", place).withColumns({"weight": pick(weights), "tilt": pick(tilts), "cap": F.col("source_size") * float(most)})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(Window.partitionBy()) * float(share)
    level = (budget - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = total.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("full"), F.col("cap")).otherwise(shared * F.col("weight"))
    return total.select("source", "source_size", "weight", "tilt", target.alias("target"))


def training_time(demand: Column, target: Column, tilt: Column) -> Column:
    """The time u in [0, 1] at which a source's cumulative demand reaches ``demand``.

    The integral of its schedule is target * (u + tilt * (u^2 - u)).
    """
    part = F.least(F.lit(1.0), demand / target)
    root = (tilt - 1 + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * part)) / (2 * tilt)
    return F.when(target > 0, F.when(tilt == 0, part).otherwise(root))


def plan_mixture(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, tilts=TILTS, id_col: str = "doc_id") -> DataFrame:
    """What the mix takes of each document and when.

    Returns every column of ``docs`` in a struct ``doc``, and ``size`` (words), ``source_size``,
    ``target``, ``copies`` (0 to ``most``), ``taken`` (copies times size) and ``times`` (the
    training position of each copy). A source runs through its documents in a fixed shuffled
    order (MD5 of the id), again from the start up to ``most`` times; a copy is taken if its
    middle lies before the target, so a source misses its target by at most half a document.

    Null texts have size 0; null sources are one source; rows with equal ids are separate
    documents, in order of size and then text; rows without an id are ordered by a hash of their
    text. A very long text is one row. An empty table gives no rows. ``docs``' columns stay in the
    struct, so none can clash. Running sums are taken in two steps, over 4,096 ranges of the order and inside
    each, so that a source with a third of all rows meets in no task.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.col("doc.source").alias("source"), word_count(F.col("doc.text")).alias("size"), F.md5(F.coalesce(F.col(f"doc.{id_col}").cast("string"), F.md5(F.col("doc.text").cast("binary")), F.lit("")).cast("binary")).alias("turn"))
    rows = rows.withColumn("range", F.substring("turn", 1, 3))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("size"))
    targets = source_targets(sums, weights, share, most, tilts)
    before = F.sum("size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    bases = sums.select("source", F.col("range").alias("base_range"), before.alias("base"))
    targets = targets.withColumnRenamed("source", "target_source")
    bases = bases.join(targets, bases.source.eqNullSafe(targets.target_source)).drop("source")
    joined = rows.join(bases, rows.source.eqNullSafe(bases.target_source) & (rows.range == bases.base_range)).drop("target_source", "base_range")
    inside = Window.partitionBy("source", "range").orderBy("turn", F.col(f"doc.{id_col}"), "size", F.xxhash64("doc.text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = joined.withColumn("start", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    starts = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.col("start") + e * F.col("source_size")),
        lambda s: s + F.col("size") / 2 < F.col("target"),
    )
    joined = joined.withColumn("starts", starts)
    return joined.select(
        "doc",
        "size",
        "source_size",
        "target",
        F.size("starts").alias("copies"),
        (F.size("starts") * F.col("size")).cast("long").alias("taken"),
        F.transform("starts", lambda s: training_time(s, F.col("target"), F.col("tilt"))).alias("times"),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mixture itself: one row per copy taken, with ``docs``' columns, range-sorted by
    training position, ties by id and then text.

    Nulls, repeated rows, long texts and empty tables are as in :func:`plan_mixture`.
    """
    plan = plan_mixture(docs, id_col=id_col, **how).select("doc", F.explode("times").alias("time"))
    order = ["time", F.col(f"doc.{id_col}"), F.xxhash64("doc.text")]
    return plan.repartitionByRange(*order).sortWithinPartitions(*order).select("doc.*")
