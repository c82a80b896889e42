"""A training-corpus pipeline: quality, lines, near duplicates, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.lines import remove_similar_lines
from tessera.llm.mixing import mix_sources
from tessera.llm.packing import pack
from tessera.llm.quality import classify
from tessera.llm.shingles import near_copy_groups
from tessera.session import discard, materialize, materialize_alone

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither scorer rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).where("keep").select(*[F.col(f"doc.{c}").alias(c) for c in COLUMNS])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines similar to earlier ones. A document of which none is left goes."""
    done = remove_similar_lines(docs, threshold=0.8).where("n_removed = 0 or kept_text rlike '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]'")
    text = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return done.select(*[text.get(c, F.col(f"doc.{c}")).alias(c) for c in COLUMNS])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles are 0.8 alike: the smallest by id, then by content.

    Rows are told apart by number, not by id: equal ids may hold different texts. A row without an
    id stays only if its group has no row with one.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "near-copies-rows")
    # Rows that tie in all but their number are equal, so it does not matter which of them stays.
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("key"), F.xxhash64("lang", "source", "n_chars").alias("rest"), "row")
    kept = near_copy_groups(rows, shingle=5, threshold=0.8).join(rows.select("row", order.alias("order")), "row").groupBy("group").agg(F.min("order").alias("first"))
    return rows.join(kept.select(F.col("first.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy that the mixture takes, in order of training."""
    return mix_sources(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1,024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("packing", packing),
]

#: No SQL expresses the trained classifier, so nor what follows it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next reads it, and what it wrote on the way goes then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
