"""Consecutive numbers over whole tables without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize


def number_rows(df: DataFrame, *order, name: str = "no") -> DataFrame:
    """``df`` with numbers from 0 in the order of the columns ``order``.

    Range partitions are sorted side by side, and each is shifted by the sizes of those before
    it: only these sizes, one row for a partition, meet in one task. Ties are in any order, the
    same one whenever the result is read.
    """
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    number = (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).cast("long")
    return ranged.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, number).drop("__part", "__before", "__at")


def place_in_group(df: DataFrame, group: str, *order, name: str = "place") -> DataFrame:
    """``df`` with each row's place in its group, from 0, in the order of the columns ``order``.

    A group of any size is spread over range partitions; only its first number is looked up.
    """
    numbered = number_rows(df, group, *order, name="__no")
    first = numbered.groupBy(F.col(group).alias("__group")).agg(F.min("__no").alias("__first"))
    return numbered.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__no") - F.col("__first")).drop("__no", "__group", "__first")


def running_sums(df: DataFrame, group: str, order: list[str], sums: dict, block: int = 1 << 16) -> DataFrame:
    """``df`` with running sums within each group, up to and with the row, in the order ``order``.

    ``sums`` names columns and what they add up. Rows are numbered, a block of numbers is summed
    in one task, and what stands before a block of a group comes from the blocks' totals, so a
    group is never in one task.
    """
    rows = number_rows(df.withColumns({f"__{name}": value for name, value in sums.items()}), group, *order, name="__no")
    rows = rows.withColumn("__block", F.floor(F.col("__no") / block))
    earlier = Window.partitionBy("__group").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(group).alias("__group"), F.col("__block").alias("__at")).agg(*[F.sum(f"__{name}").alias(f"__{name}") for name in sums])
    before = totals.select("__group", "__at", *[F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__before_{name}") for name in sums])
    inside = Window.partitionBy(group, "__block").orderBy("__no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__{name}": F.sum(f"__{name}").over(inside) for name in sums})
    done = rows.join(before, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__block") == F.col("__at")))
    return done.select(*df.columns, *[(F.col(f"__{name}") + F.col(f"__before_{name}")).alias(name) for name in sums])
