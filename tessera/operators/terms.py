"""Term counts and terms associated with an anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import round6, tokens


def unique_terms(docs: DataFrame, field: str = "text", phrases: bool = False) -> DataFrame:
    """``term``, ``field``, ``type`` and ``frequency`` of words, or of pairs of neighbours."""
    words = docs.select(tokens(F.col(field)).alias("words"))
    if phrases:
        # Neighbours are counted as two words; only what is counted becomes one text.
        beside = F.arrays_zip(F.slice("words", 1, F.size("words") - 1).alias("a"), F.slice("words", 2, F.size("words")).alias("b"))
        pairs = words.where(F.size("words") > 1).select(F.inline(beside))
        counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("frequency")).select(F.concat("a", F.lit(" "), "b").alias("term"), "frequency")
    else:
        counted = words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    return counted.select("term", F.lit(field).alias("field"), F.lit("phrase" if phrases else "word").alias("type"), "frequency")


def term_lift(docs: DataFrame, anchor: str, field: str = "text", min_doc_freq: int = 5, min_co_docs: int = 3) -> DataFrame:
    """Terms that occur more in documents with the anchor: counts of documents, smoothed lift and
    its binary logarithm. Both counts come from one aggregate; there is no self-join."""
    sets = docs.select(F.array_distinct(tokens(F.col(field))).alias("words")).withColumn("hit", F.array_contains("words", anchor))
    totals = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_anchor"))
    counts = sets.select("hit", F.explode("words").alias("term")).where(F.col("term") != anchor).groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"), F.count_if("hit").alias("co_docs"))
    counts = counts.where((F.col("co_docs") >= min_co_docs) & (F.col("doc_freq") >= min_doc_freq))
    lift = ((F.col("co_docs") + 1) / (F.col("n_anchor") + 2)) / ((F.col("doc_freq") + 1) / (F.col("n") + 2))
    return counts.crossJoin(F.broadcast(totals)).select("term", "doc_freq", "co_docs", round6(lift).alias("lift"), round6(F.log2(lift)).alias("log2_lift"))


def search_terms(docs: DataFrame, part: str, per_type: int = 50, field: str = "text") -> DataFrame:
    """The commonest words and phrases that hold ``part``, with the numbers of all that do."""
    both = unique_terms(docs, field).unionByName(unique_terms(docs, field, phrases=True)).where(F.contains("term", F.lit(part.lower())))
    # Two kinds of term, so two rows of totals.
    totals = both.groupBy("type").agg(F.count(F.lit(1)).alias("total")).withColumn("total_records", F.sum("total").over(Window.partitionBy()))
    numbered = both.withColumn("nth", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("frequency"), "term"))).where(F.col("nth") <= per_type)
    return numbered.join(F.broadcast(totals), "type").select("type", "term", "frequency", "total", "total_records")
