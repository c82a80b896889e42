"""Research questions: predicates, critique, scores, filters, ranking and gaps, all per row or per list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.texts import any_of, content_words
from tessera.operators.numbering import number_rows

# Openings of questions about a single person's record, words that a kind of question
# has to hold, and words of a subject that stand for each other.
FACTOID_OPENINGS = (
    "what is the date of birth", "what is the occupation of", "what is the nature of", "what is the name of", "what is the disability of",
    "what is the cause of death", "what is the age of", "what is the address of", "what is the salary of", "what is the wage of",
    "what was the date of birth", "what was the occupation of", "what was the nature of", "who is ", "who was ", "when was ", "where was ",
    "where does ", "where did ",
)
#: A question about something a named person has: a fixed value.
POSSESSIVE = r"(?i)^(what|who|when|where|how)\b.{0,40}\b[A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+(?:'s|s')\s+\w+"
#: A question what a name is: a fixed value.
WHAT_IS = r"(?i)^what\s+(?:is|was|are|were)\s+(?:the\s+)?(?:\w+\s+){0,2}(?:of\s+)?[A-Z]"
#: Capitalised words that are no names: fixed values.
COMMON_WORDS = (
    "what", "who", "when", "where", "how", "why", "the", "a", "an", "is", "was", "are", "were", "of", "in", "at", "by", "for", "to",
    "relief", "department", "railroad", "baltimore", "ohio", "company",
)
MARKERS = {
    "causal": ("why", "how", "what explains", "what caused", "what led", "what contributed", "what resulted"),
    "comparative": ("between", "compare", "difference", "differ", "versus", "vs."),
    "distributional": ("who", "which group", "differ", "difference", "distribution", "disproportion"),
    "institutional": ("criteria", "rule", "policy", "procedure", "eligibility", "requirement", "standard"),
    "scope_conditions": ("where", "when", "under what conditions", "scope", "limits", "apply"),
}
LENS_FAMILIES = (
    ("injury", "injuries", "accident", "disablement", "disabled", "wound"),
    ("job", "occupation", "department", "laborer", "brakeman", "conductor", "worker", "track"),
    ("process", "procedure", "workflow", "review", "approval", "adjudication", "paperwork", "timeline", "delay", "administrative", "record", "filing", "certification"),
)
#: A part that a form left open: a fixed value.
PLACEHOLDER = r"\[[^\]]+\]|\{[^}]+\}"

#: An id and a person's name in a question: fixed values.
HEX_ID, TWO_NAMES = r"\b[a-f0-9]{8,}\b", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"


def is_factoid(question: Column) -> Column:
    """Whether a question asks for one person's record, or is empty."""
    text = F.coalesce(question, F.lit(""))
    low = F.trim(F.lower(text))
    opens = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in FACTOID_OPENINGS])
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    common = F.array(*[F.lit(w) for w in COMMON_WORDS])
    # A capital is a first letter that lowering changes.
    later = F.exists(F.slice(words, 2, 1_000_000), lambda w: (F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1))) & ~F.array_contains(common, F.rtrim(F.lower(w), F.lit("?.,;:'\""))) & (F.char_length(w) > 1))
    what = text.rlike(WHAT_IS) & later & (F.size(words) < 15)
    return (low == "") | opens | text.rlike(POSSESSIVE) | what


def critique(question: Column, kind: Column, has_pattern: Column) -> Column:
    """What is wrong with a question: ``empty``, ``placeholder``, ``not_<kind>`` or ``vague_pattern``; null if nothing."""
    low = F.trim(F.lower(F.coalesce(question, F.lit(""))))
    found = F.when(low == "", "empty").when(low.rlike(PLACEHOLDER), "placeholder")
    for name, words in MARKERS.items():
        found = found.when((kind == name) & ~any_of(low, words), f"not_{name}")
    return found.when(F.contains(low, F.lit("pattern")) & ~has_pattern, "vague_pattern")


def heuristic_scores(question: Column, kind: Column, evidence: Column, has_source: Column, has_window: Column, has_entities: Column) -> Column:
    """Four measures of up to 25 points each and their sum."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    long = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != "")) > 10
    parts = {
        "answerability": F.least(F.lit(25), 5 + 2 * evidence),
        "significance": F.least(F.lit(25), 10 + points(kind.isin("causal", "comparative"), 6) + points(has_source, 5)),
        "specificity": F.least(F.lit(25), 8 + points(has_window, 6) + points(has_entities, 6) + points(long, 4)),
        "evidence_based": F.least(F.lit(25), 6 + points(has_source, 8) + F.least(F.lit(11), evidence)),
    }
    total = F.least(F.lit(100), sum(parts.values(), F.lit(0)))
    return F.struct(total.cast("long").alias("total"), *[v.cast("long").alias(k) for k, v in parts.items()])


def lens_terms(lens: list[str], most: int = 20) -> list[str]:
    """Terms of a lens in lower case, once each, and the family of each word that they name."""
    terms = list(dict.fromkeys(t for t in (x.strip().lower() for x in lens) if t))
    for family in LENS_FAMILIES:
        if any(word in term for term in terms for word in family):
            terms += [word for word in family if word not in terms]
    return terms[:most]


def lens_score(question: Column, terms: list[str]) -> Column:
    """Three points for each term in the question, else one for each of its words of four letters or more."""
    low = F.lower(F.coalesce(question, F.lit("")))
    score = F.lit(0)
    for term in terms:
        parts = sum((F.contains(low, F.lit(w)).cast("int") for w in term.split() if len(w) >= 4), F.lit(0))
        score = score + F.when(F.contains(low, F.lit(term)), 3).otherwise(parts)
    return score


def else_all(rows: DataFrame, keep: Column) -> DataFrame:
    """Rows that pass, or all of them if none does."""
    kept = rows.where(keep)
    none = kept.agg((F.count(F.lit(1)) == 0).alias("none"))
    return kept.unionByName(rows.join(F.broadcast(none), F.col("none")).drop("none"))


def enough_evidence(rows: DataFrame, least: int) -> DataFrame:
    """Questions with ``least`` documents of evidence; two are enough beside a contradiction."""
    return rows.where(F.col("evidence") >= F.when(F.col("has_contradiction"), 2).otherwise(least))


def rank_questions(rows: DataFrame, terms: list[str], target: int, lens_share: float = 0.7) -> DataFrame:
    """The ``target`` best questions by lens, score and evidence, each text once.

    At most ``lens_share`` of the places go to questions that touch the lens, unless there are too
    few others to fill the rest. ``place`` is the order of selection.
    """
    key = F.trim(F.lower("question"))
    best = [F.desc("lens"), F.desc("score"), F.desc("evidence"), "id"]
    scored = rows.withColumn("lens", lens_score(F.col("question"), terms)).withColumn("key", key)
    once = scored.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(*best))).where("copy = 1").drop("copy")
    # No more than the target's number of either kind can be among the best.
    touched = F.col("lens") > 0
    once = once.where(touched).orderBy(*best).limit(target).unionByName(once.where(~touched).orderBy(*best).limit(target))
    within = F.row_number().over(Window.partitionBy(touched).orderBy(*best))
    late = touched & (within > max(1, int(target * lens_share))) if terms else F.lit(False)
    ordered = once.withColumn("late", late).withColumn("place", F.row_number().over(Window.orderBy("late", *best)))
    return ordered.where(F.col("place") <= target).drop("key", "late")


def diverse(rows: DataFrame, least_kinds: int) -> DataFrame:
    """All questions if they have ``least_kinds`` kinds, else one of each kind first, then the others in order."""
    kinds = rows.select("kind").distinct().agg((F.count(F.lit(1)) >= least_kinds).alias("enough"))
    first = rows.groupBy(F.col("kind").alias("__kind")).agg(F.min("id").alias("__first"))
    marked = rows.join(first, F.col("kind").eqNullSafe(F.col("__kind"))).crossJoin(F.broadcast(kinds))
    late = F.when(F.col("enough"), False).otherwise(~F.col("id").eqNullSafe(F.col("__first")))
    numbered = number_rows(marked.withColumn("__late", late), "__late", "id", name="place")
    return numbered.withColumn("place", (F.col("place") + 1).cast("int")).drop("__kind", "__first", "enough", "__late")


def gaps(texts: DataFrame, axes: dict[str, tuple[str, ...]]) -> DataFrame:
    """Axes of which no text holds a keyword, with the keywords that are missing."""
    low = F.lower(F.coalesce("text", F.lit("")))
    seen = texts.agg(*[F.coalesce(F.bool_or(any_of(low, words)), F.lit(False)).alias(name) for name, words in axes.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("axis"), F.lit(", ".join(w)).alias("missing"), F.col(n).alias("seen")) for n, w in axes.items()])
    return seen.select(F.inline(rows)).where("not seen").drop("seen")


def theme_of(text: Column, themes: dict[str, tuple[str, ...]]) -> Column:
    """The theme with most keywords in the text, the first of equals; ``other`` without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("theme")) for i, (name, words) in enumerate(themes.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["theme"]).otherwise("other")


def too_specific(question: Column, n_actors: Column) -> Column:
    """Whether a grand question names an id, a person in few words, or only one or two actors."""
    words = F.size(F.filter(F.split(question, r"\s+"), lambda w: w != ""))
    return (F.coalesce(question, F.lit("")) == "") | F.lower(question).rlike(HEX_ID) | (question.rlike(TWO_NAMES) & (words < 18)) | n_actors.between(1, 2)


def answerability(questions: DataFrame, chunks: DataFrame, least: int = 5, most: int = 200, limit: int = 50) -> DataFrame:
    """How many documents hold any of a question's six longest words, and whether that is enough.

    ``questions`` has ``id, question``; ``chunks`` has ``doc, text``. Of the chunks that match, the
    first ``limit`` in order of document count. Words meet whole words, on an index of words, so
    no question is compared with every chunk.
    """
    words = questions.select("id", F.explode(F.array_distinct(content_words(F.col("question")))).alias("word"))
    held = chunks.select("doc", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z'-]{2,}"), F.lit(0)))).alias("word"))
    hits = words.join(held, "word").select("id", "doc").distinct()
    first = hits.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("doc"))).where(F.col("nth") <= limit)
    n = questions.select("id").join(first.groupBy("id").agg(F.count(F.lit(1)).alias("n_docs")), "id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return n.withColumn("status", F.when(F.col("n_docs") < least, "too_few").when(F.col("n_docs") > most, "too_many").otherwise("ok"))
