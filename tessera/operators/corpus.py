"""People statistics, strata of a corpus, and exploration state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import round6


def group_counts(df: DataFrame, key: Column, name: str, unknown: str = "unknown") -> DataFrame:
    """Counts by a label; null and blank labels are one group."""
    return df.groupBy(F.coalesce(F.nullif(key, F.lit("")), F.lit(unknown)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def decades(year: Column) -> Column:
    return F.floor(year / 10).cast("long") * 10


def conditional_summary(df: DataFrame, value: Column, holds: Column) -> DataFrame:
    """Sum, mean where a condition holds, how often it does, and the largest."""
    return df.agg(round6(F.sum(value)).alias("total"), round6(F.avg(F.when(holds, value))).alias("mean_where"), F.count_if(holds).alias("n_where"), F.max(value).alias("largest"))


def strata(docs: DataFrame, keys: list[str], cap: int = 100, min_count: int = 1) -> DataFrame:
    """Per facet in ``keys``, each value with its count and sample size, in one pass."""
    sets = docs.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    facet = F.coalesce(*[F.when(F.col("g").bitwiseAND(1 << (len(keys) - 1 - i)) == 0, F.lit(k)) for i, k in enumerate(keys)])
    value = F.coalesce(*[F.col(k).cast("string") for k in keys])
    return sets.select(facet.alias("facet"), value.alias("value"), "n", F.least("n", F.lit(cap)).alias("sample_size")).where((F.col("n") >= min_count) & F.col("value").isNotNull())


def trim_to_budget(found: DataFrame, budget: int, order: list) -> DataFrame:
    """Strata in order while their samples fit the budget; the last is clipped."""
    before = F.coalesce(F.sum("sample_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("before", before).where(F.col("before") < budget).withColumn("sample_size", F.least("sample_size", budget - F.col("before"))).drop("before")


def sample_strata(docs: DataFrame, key: str, id_col: str, size: int, seed: str = "s") -> DataFrame:
    """A repeatable sample of each stratum, in order of a hash of the id."""
    w = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary")), id_col)
    return docs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).drop("rank")


def decade_gaps(docs: DataFrame, year: Column) -> DataFrame:
    """Decades between the first and the last that no document has."""
    seen = docs.select(decades(year).alias("decade")).where("decade is not null").distinct()
    span = seen.agg(F.explode(F.sequence(F.min("decade"), F.max("decade"), F.lit(10))).alias("decade"))
    return span.join(seen, "decade", "left_anti")


def merge_entities(found: DataFrame) -> DataFrame:
    """Mentions in batches merged by normalised name: how many, the first and last batch."""
    key = F.lower(F.trim("name"))
    return found.groupBy(key.alias("key")).agg(F.min_by("name", "seq").alias("name"), F.count(F.lit(1)).alias("document_count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def confidence(evidence: Column, high: int = 20, medium: int = 10) -> Column:
    return F.when(evidence >= high, "high").when(evidence >= medium, "medium").otherwise("low")


def validation_status(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 70, "good").when(score >= 60, "acceptable").when(score >= 50, "needs_refinement").otherwise("rejected")


def similar_questions(questions: DataFrame, least: float = 0.85) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``id, text`` whose sets of lower-case words, parted by white space, have
    at least this Jaccard similarity.

    Words are ordered by how many texts use them; only the first n - ceil(least * n) + 1 of each
    text, the rarest, make candidates, so a common word pairs no two texts by itself. Texts
    without words pair with none (see :func:`is_duplicate_question`).
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    sets = questions.select("id", words.alias("w")).where(F.size("w") > 0)
    each = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
    used = each.groupBy("word").agg(F.count(F.lit(1)).alias("used"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("used", "word"))
    prefix = each.join(used, "word").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).select("id", "n", "word")
    a, b = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "word"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "word")
    met = a.join(b, "word").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb"))).select("a", "b").distinct()
    both = met.join(sets.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    shared = F.size(F.array_intersect("wa", "wb"))
    score = shared / (F.size("wa") + F.size("wb") - shared)
    return both.select("a", "b", score.alias("score")).where(F.col("score") >= least).select("a", "b", round6(F.col("score")).alias("jaccard"))


def is_duplicate_question(questions: DataFrame, existing: DataFrame, least: float = 0.85) -> DataFrame:
    """``id`` and ``duplicate`` of each new question: near one of ``existing``, or without words."""
    named = questions.select("id", "text", F.lit(1).alias("kind")).unionByName(existing.select("id", "text", F.lit(0).alias("kind")))
    keyed = named.select(F.struct("kind", "id").alias("id"), "text")
    pairs = similar_questions(keyed, least).where("a.kind = 0 and b.kind = 1").select(F.col("b.id").alias("id")).distinct()
    blank = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")) == 0
    return questions.join(pairs.withColumn("near", F.lit(True)), "id", "left").select("id", (blank | F.col("near").isNotNull()).alias("duplicate"))
