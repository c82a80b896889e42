"""Chunks, vector and keyword retrieval, rank fusion, snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import contains, round6
from tessera.operators.matching import nearest_rows


def cosine_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` rows with the highest cosine for each query row: ``query_id, vec_id, score, rank``.

    A zero vector has cosine 0 with all. Blocks of queries meet blocks of rows, and only the best
    of each pair of blocks are merged.
    """
    return nearest_rows(vectors, queries, k)


def keyword_hits(docs: DataFrame, query: str, limit: int = 20, id_col: str = "doc_id") -> DataFrame:
    return docs.where(contains(F.col("text"), query)).select(id_col).orderBy(id_col).limit(limit)


def reciprocal_rank_fusion(lists: DataFrame, k: int = 60) -> DataFrame:
    """``lists`` has ``query_id, doc, rank``: the sum of 1 / (k + rank) over lists, ranked."""
    fused = lists.groupBy("query_id", "doc").agg(round6(F.sum(1.0 / (k + F.col("rank")))).alias("rrf"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "doc")))


def rerank_score(cross: Column, recency: Column, authority: Column) -> Column:
    return 0.85 / (1 + F.exp(-cross)) + 0.10 * recency + 0.05 * authority


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, id_col: str = "doc_id") -> DataFrame:
    """Chunks of ``size`` characters that overlap: ``chunk_id``, ``chunk_index``, ``text``,
    ``token_count`` (a quarter of the characters) and neighbours' overlaps."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.char_length("text") - overlap) / step)).cast("int")
    cut = docs.where("text is not null and text <> ''").select(id_col, "text", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("chunk_index", "i"))
    cut = cut.select(id_col, "chunk_index", F.substring("text", F.col("i") * step + 1, F.lit(size)).alias("text"))
    return cut.select(F.format_string("%d_chunk_%03d", id_col, "chunk_index").alias("chunk_id"), id_col, "chunk_index", "text", F.floor(F.char_length("text") / 4).alias("token_count"))


def snippet_score(text: Column, words: list[str]) -> Column:
    """One point for each query word in the text, two for a year, minus one for three "?"."""
    low = F.lower(text)
    points = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    return points + F.when(text.rlike(r"\b(?:18|19|20)\d{2}\b"), 2).otherwise(0) - F.when(F.regexp_count(text, F.lit(r"\?")) >= 3, 1).otherwise(0)


def meaning_buckets(scores: DataFrame) -> DataFrame:
    """How many hits of each query are strong, fair and weak, and the span of scores."""
    s = F.col("score")
    return scores.groupBy("query_id").agg(F.count_if(s >= 0.8).alias("strong"), F.count_if((s >= 0.65) & (s < 0.8)).alias("fair"), F.count_if(s < 0.65).alias("weak"), round6(F.avg("score")).alias("mean"), F.max("score").alias("best"), F.min("score").alias("worst"))


def small_to_big(hits: DataFrame, chunks: DataFrame, id_col: str = "doc_id", most: int = 4000) -> DataFrame:
    """The whole parent text of each hit from its chunks in order, else the hit's own text."""
    parents = chunks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"))
    whole = F.substring(F.array_join(F.transform("parts", lambda p: p["text"]), "\n"), 1, most)
    return hits.join(parents, id_col, "left").select(*[c for c in hits.columns if c != "text"], F.coalesce(whole, F.col("text")).alias("text"))
