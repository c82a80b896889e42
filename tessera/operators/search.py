"""Fielded document search, paging and schema discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.scalars import contains, missing
from tessera.operators.numbering import number_rows


def search_predicate(rows: list[tuple[str, str, str]]) -> Column:
    """At most three rows (field, operator, term): AND and NOT rows are all required, of the OR
    rows one is. NOT also holds where the field is missing. Rows with another operator are
    dropped. The term ``missing`` asks for fields that are null or empty."""

    def test(field: str, term: str) -> Column:
        return missing(F.col(field)) if term == "missing" else contains(F.col(field), term)

    needed = [~test(f, t) if op == "NOT" else test(f, t) for f, op, t in rows[:3] if op in ("AND", "NOT")]
    either = [test(f, t) for f, op, t in rows[:3] if op == "OR"]
    if either:
        needed.append(reduce(lambda a, b: a | b, either))
    return reduce(lambda a, b: a & b, needed, F.lit(True))


def search(docs: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    return docs.where(search_predicate(rows))


def page(df: DataFrame, order: list, number: int = 1, per_page: int = 50) -> DataFrame:
    """One page of ordered results; the order must be total."""
    return df.orderBy(*order).offset((max(1, number) - 1) * per_page).limit(per_page)


def neighbours_in_order(df: DataFrame, key: str, order: str, group: str | None = None) -> DataFrame:
    """Each key with its place's columns, ``previous`` and ``next``, the keys beside it in its result list.

    Rows are numbered by range partitions and meet the rows one number before and after, so a
    list of any length is never in one task.
    """
    columns = [key, order] + ([group] if group else [])
    numbered = number_rows(df.select(*columns), *([group] if group else []), order, key, name="__no")
    same = F.lit(True) if group is None else F.col(group).eqNullSafe(F.col("__group"))

    def beside(step: int, name: str) -> DataFrame:
        return numbered.select((F.col("__no") + step).alias("__at"), F.col(key).alias(name), *([F.col(group).alias("__group")] if group else []))

    done = numbered.join(beside(1, "previous"), (F.col("__no") == F.col("__at")) & same, "left").select(*columns, "__no", "previous")
    return done.join(beside(-1, "next"), (F.col("__no") == F.col("__at")) & same, "left").select(*columns, "previous", "next")


def field_presence(df: DataFrame) -> DataFrame:
    """``field`` and how many rows have it, in one pass; fields of nested structs by their path."""
    leaves = _leaves(df.schema)
    counts = df.agg(*[F.count(reduce(lambda value, name: value[name], path[1:], F.col(path[0]))).alias(f"n{i}") for i, path in enumerate(leaves)])
    pairs = F.array(*[F.struct(F.lit(".".join(path)).alias("field"), F.col(f"n{i}").alias("n")) for i, path in enumerate(leaves)])
    return counts.select(F.inline(pairs))


def _leaves(kind: StructType, above: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    return [leaf for f in kind.fields for leaf in (_leaves(f.dataType, (*above, f.name)) if isinstance(f.dataType, StructType) else [(*above, f.name)])]


def dropdown(df: DataFrame, field: str) -> DataFrame:
    """Distinct values that are not blank, and ``missing``."""
    values = df.where(F.trim(field) != "").select(F.col(field).alias("value")).distinct()
    return values.union(df.sparkSession.range(1).select(F.lit("missing").alias("value"))).distinct()


def any_leaf_contains(df: DataFrame, term: str) -> Column:
    """Whether any value of a row, at any depth of arrays and maps, holds the term."""
    return reduce(lambda a, b: a | b, [contains(_text(F.col(f.name), f.dataType.typeName()), term) for f in df.schema.fields])


def _text(column: Column, kind: str) -> Column:
    if kind == "array":
        return F.array_join(F.transform(column, lambda x: x.cast("string")), "\n")
    if kind == "map":
        return F.array_join(F.transform(F.map_values(column), lambda x: x.cast("string")), "\n")
    return column.cast("string")


def page_with_totals(df: DataFrame, order: list, number: int = 1, per_page: int = 50) -> DataFrame:
    """A page with ``total`` rows and ``total_pages`` beside each of its rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    sized = page(df, order, number, per_page).crossJoin(F.broadcast(total))
    return sized.withColumn("total_pages", F.ceil(F.col("total") / per_page).cast("long"))
