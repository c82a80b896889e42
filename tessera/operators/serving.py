"""Search results as they are served, their parent documents, what is still to be embedded, and the agenda of a set of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.matching import assign_to, close_pairs, first_fit, nearest_rows
from tessera.operators.numbering import number_rows
from tessera.session import materialize


def semantic_search(chunks: DataFrame, queries: DataFrame, docs: DataFrame, top_k: int = 20) -> DataFrame:
    """Chunks (``vec_id, embedding, doc_id, text``) nearest to each query (``vec_id, embedding``), as a page shows them.

    ``top_k`` is kept within 1 and 100. Scores and distances have four decimals, ``content`` is the
    first 400 characters; ``title, date, source`` come from ``docs`` (``doc_id`` and these), empty
    where they are missing. A chunk without a vector is never found.
    """
    near = nearest_rows(chunks.select("vec_id", "embedding"), queries, max(1, min(top_k, 100)), own=True)
    four = lambda x: F.floor(x * 1e4 + 0.5) / 1e4
    found = near.join(chunks.select("vec_id", "doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("content")), "vec_id")
    named = found.join(docs.select("doc_id", "title", "date", "source"), "doc_id", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return named.select("query_id", F.col("vec_id").alias("chunk_id"), "rank", four(F.col("score")).alias("score"), four(1 - F.col("score")).alias("distance"), "content", text("title"), text("date"), text("source"), "doc_id")


def parents(hits: DataFrame, most: int = 5) -> DataFrame:
    """The first ``most`` different documents of each query's hits (``query_id, doc_id, rank``), in order: adds ``place``."""
    first = hits.where("doc_id is not null").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))
    return first.withColumn("place", place).where(F.col("place") <= most)


def backfill(docs: DataFrame, embedded: DataFrame, id_col: str = "doc_id", limit: int | None = None, batch: int = 100) -> DataFrame:
    """Documents that no chunk belongs to yet, in order of id, in batches: the id and ``batch``.

    Ids are compared as text, as chunks keep them; ``limit`` takes the first ones only.
    """
    known = embedded.select(F.col("document_id").cast("string").alias("known")).where("known is not null").distinct()
    left = docs.select(id_col).where(F.col(id_col).isNotNull()).join(known, F.col(id_col).cast("string") == F.col("known"), "left_anti")
    numbered = number_rows(left if limit is None else left.orderBy(id_col).limit(limit), id_col, name="no")
    return numbered.select(id_col, F.floor(F.col("no") / batch).cast("long").alias("batch"))


def agenda(questions: DataFrame, themes: DataFrame, least: float = 0.2, candidates: int = 7, alike: float = 0.86, subs: int = 6) -> DataFrame:
    """What each theme asks: ``theme, role, place, vec_id`` with its number of questions.

    ``questions`` has ``vec_id, embedding, score``, ``themes`` ``vec_id, embedding, theme``. A
    theme's best question by score, then id, is its ``overview``; of the ``candidates`` after it those
    are left out that are ``alike`` an earlier one that stayed, and the first ``subs`` are ``sub``.
    Only these few of each theme are compared with each other. Questions of no theme are in none.
    """
    placed = materialize(assign_to(questions.select("vec_id", "embedding"), themes, least).where("theme <> 'other'").join(questions.select("vec_id", "score"), "vec_id"), "agenda")
    counted = placed.groupBy("theme").agg(F.count(F.lit(1)).alias("n_questions"))
    order = Window.partitionBy("theme").orderBy(F.desc_nulls_last("score"), "vec_id")
    top = placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= candidates + 1)
    top = materialize(number_rows(top.select("theme", "nth", "vec_id"), "theme", "nth", name="no"), "agenda-top")
    some = top.where("nth > 1")
    pairs, groups = close_pairs(some.join(questions.select("vec_id", "embedding"), "vec_id").select(F.col("no").alias("place"), "embedding"), alike)
    # Equal vectors are one row of ``groups``; its places are links too.
    of = groups.select(F.col("first"), F.explode("places").alias("no"))
    both = pairs.unionByName(groups.where(F.exists("embedding", lambda x: x != 0)).select(F.col("first").alias("early"), F.col("first").alias("late"), F.lit(1.0).alias("score")))
    spread = both.join(of.select(F.col("first").alias("early"), F.col("no").alias("a")), "early").join(of.select(F.col("first").alias("late"), F.col("no").alias("b")), "late").where("a <> b")
    theme = some.select("no", "theme")
    inside = spread.join(theme.select(F.col("no").alias("a"), F.col("theme").alias("theme_a")), "a").join(theme.select(F.col("no").alias("b"), F.col("theme").alias("theme_b")), "b").where("theme_a = theme_b")
    links = inside.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"), "score").distinct()
    kept = first_fit(some.select(F.col("no").alias("place")), links).where("place = leader").select(F.col("place").alias("no"))
    sub = some.join(kept, "no", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("theme").orderBy("nth"))).where(F.col("place") <= subs)
    chosen = top.where("nth = 1").select("theme", F.lit("overview").alias("role"), F.lit(0).alias("place"), "vec_id").unionByName(sub.select("theme", F.lit("sub").alias("role"), "place", "vec_id"))
    return chosen.join(counted, "theme")
