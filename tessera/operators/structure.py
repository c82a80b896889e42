"""The structure of nested JSON documents: paths, types, presence, and the first-wins merge of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def kind_of(value: Column) -> Column:
    """``object``, ``array`` or the type of a single value: ``str, int, float, bool, null``."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "str").when(name == "BOOLEAN", "bool").when(name == "VOID", "null")
        .when((name == "BIGINT") | name.rlike(r"^DECIMAL\(\d+,0\)$"), "int").otherwise("float")
    )


def document_paths(docs: DataFrame, json: str = "document", order: str = "doc_id") -> DataFrame:
    """Every field of every document: ``order, path, type``, the path as an array of names.

    A list is known by its first element, as in a schema by example: its type is ``list``,
    ``list<str>`` and so on, and the fields of a first element that is an object follow below
    ``[]``. Documents are opened level by level, each level one join with the fields of its
    objects, until none is left. What is no JSON object has no fields; of a key that a document
    repeats no field is lost.
    """
    value = F.try_parse_json(json)
    opened = docs.select(F.col(order).alias("order"), F.array().cast("array<string>").alias("path"), value.alias("value")).where("value is not null").withColumn("kind", kind_of(F.col("value"))).where("kind = 'object'").drop("kind")
    found = []
    while True:
        tvf = docs.sparkSession.tvf.variant_explode(F.col("value").outer())
        inside = opened.lateralJoin(tvf.select(F.col("key"), F.col("value").alias("field")))
        fields = inside.select("order", F.concat("path", F.array("key")).alias("path"), F.col("field").alias("value")).withColumn("kind", kind_of(F.col("value")))
        head = F.try_variant_get("value", "$[0]", "variant")
        fields = fields.withColumn("head", F.when(F.col("kind") == "array", head))
        inner = F.when(F.col("head").isNotNull(), kind_of(F.col("head")))
        name = F.when(F.col("kind") != "array", F.col("kind")).when(inner.isNull(), "list").otherwise(F.concat(F.lit("list<"), F.when(inner == "array", "list").otherwise(inner), F.lit(">")))
        level = materialize(fields.withColumn("type", name).select("order", "path", "type", F.when(F.col("type") == "object", F.col("value")).when(F.col("type") == "list<object>", F.col("head")).alias("value")), "document-paths")
        found.append(level.select("order", "path", "type"))
        opened = level.where("value is not null").select("order", F.when(F.col("type") == "object", F.col("path")).otherwise(F.concat("path", F.array(F.lit("[]")))).alias("path"), "value")
        if opened.isEmpty():
            break
    every = found[0]
    for level in found[1:]:
        every = every.unionByName(level)
    return every


def merged_structure(paths: DataFrame) -> DataFrame:
    """One structure from :func:`document_paths`: ``path, type, first, documents``.

    A field has the type that the first document with it has, by ``order``; ``documents`` counts
    those with the field. Fields below a name whose first type is neither an object nor a list of
    objects are left out, so an early document decides. The result does not depend on partitions.
    """
    fields = materialize(paths.groupBy("path").agg(F.min_by("type", "order").alias("type"), F.min("order").alias("first"), F.count_distinct("order").alias("documents")), "structure-fields")
    # A path's parents, with the type that each must have, are looked up all at once.
    parent = F.when(F.element_at("path", -2) == "[]", F.slice("path", 1, F.size("path") - 2)).otherwise(F.slice("path", 1, F.size("path") - 1))
    need = F.when(F.element_at("path", -2) == "[]", "list<object>").otherwise("object")
    kept = fields.where(F.size("path") == 1)
    done = [kept]
    while True:
        below = fields.where(F.size("path") > 1).withColumns({"parent": parent, "need": need}).join(kept.select(F.col("path").alias("parent"), F.col("type").alias("need")), ["parent", "need"], "left_semi").drop("parent", "need")
        kept = materialize(below, "structure-level")
        if kept.isEmpty():
            break
        done.append(kept)
    every = done[0]
    for level in done[1:]:
        every = every.unionByName(level)
    return every


def extend_structure(known: DataFrame, paths: DataFrame) -> DataFrame:
    """A known structure (as of :func:`merged_structure`) with the fields of later documents: what is known stays."""
    both = paths.select("order", "path", "type", F.lit(1).alias("late")).unionByName(known.select(F.col("first").alias("order"), "path", "type", F.lit(0).alias("late")))
    place = F.struct("late", "order")
    return merged_structure(both.select(place.alias("order"), "path", "type")).select("path", "type", "first.order").withColumnRenamed("order", "first")


def shown_path(path: Column) -> Column:
    """A path as one text: names joined by dots, lists marked by ``[]``."""
    return F.replace(F.array_join(path, "."), F.lit(".[]"), F.lit("[]"))
