"""Loaders, the mention view of the order tables, and ingestion by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import enough_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ``doc``, ``ent``, ``type``: each order mentions the suppliers and brands of its
    lines, its customer's nation and its priority."""
    lines = table(spark, sf_dir, "lineitem")
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    supplier = lines.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("SUPPLIER:"), "l_suppkey").alias("ent"), F.lit("SUPPLIER").alias("type"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    brand = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("BRAND:"), "p_brand").alias("ent"), F.lit("BRAND").alias("type"))
    where = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    place = where.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("NATION:"), "n_name").alias("ent"), F.lit("NATION").alias("type"))
    urgency = orders.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("PRIORITY:"), "o_orderpriority").alias("ent"), F.lit("PRIORITY").alias("type"))
    # Two mentions a line, dealt by document at once: few are repeated, so nothing is gained by comparing them before.
    n = enough_partitions(spark, 2 * lines.count())
    return supplier.union(brand).union(place).union(urgency).repartition(n, "doc").distinct()


def read_raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON and text files below ``path``: ``file_path``, ``file_hash`` and ``content``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,txt}").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("file_path"), F.sha2("value", 256).alias("file_hash"), F.col("value").alias("content"))


def clean_json(content):
    """The text between the first brace and the last, without control characters."""
    plain = F.regexp_replace(content, r"[\x00-\x1F\x7F]", "")
    return F.regexp_extract(plain, r"(?s)\{.*\}", 0)


def combined_hash(files: DataFrame) -> DataFrame:
    """One hash over all file hashes in order of path."""
    rows = F.array_sort(F.collect_list(F.struct("file_path", "file_hash")))
    return files.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["file_hash"]), ""), 256).alias("combined_hash"))


def new_documents(incoming: DataFrame, known: DataFrame, key: str = "file_hash") -> DataFrame:
    """Rows whose key is not known yet, one for each key."""
    return incoming.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def merge_latest(existing: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: for each key the row with the largest version, a batch's row before an old one."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    latest = Window.partitionBy(key).orderBy(F.desc_nulls_last(version), F.desc("__new"))
    return both.withColumn("__rank", F.row_number().over(latest)).where("__rank = 1").drop("__rank", "__new")


def export_csv(docs: DataFrame, ids: DataFrame, path: str, key: str = "doc_id") -> None:
    """Selected documents as CSV: the key, a summary and the whole document as JSON."""
    chosen = docs.join(ids.select(key).distinct(), key, "left_semi")
    chosen.select(key, F.coalesce(F.substring("text", 1, 200), F.lit("N/A")).alias("summary"), F.to_json(F.struct(*docs.columns)).alias("document")).write.mode("overwrite").csv(path, header=True, escape='"')
