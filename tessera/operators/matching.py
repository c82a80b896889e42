"""Similar texts and vectors: candidates by exact filters, first-fit groups by rounds of joins, nearest rows by blocks."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialize


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over all characters, as the standard library finds blocks of ``a`` in ``b``."""

    def ratio(left: pa.Array, right: pa.Array) -> pa.Array:
        matcher, out = SequenceMatcher(None), []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            if x is None or y is None:
                out.append(None)
                continue
            if matcher.b != y:
                # The matcher keeps what it knows of its second text.
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        return pa.array(out, pa.float64())

    ratio.__annotations__ = {"left": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(ratio, "double")(a, b)


def _pairs_of_letters(text: Column) -> Column:
    """Neighbouring pairs of characters, each with how often it came before."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    counted = F.aggregate(pairs, F.struct(F.create_map().cast("map<string,int>").alias("seen"), F.array().cast("array<string>").alias("out")), lambda s, p: F.struct(
        F.map_concat(F.map_filter(s["seen"], lambda k, _: k != p), F.create_map(p, F.coalesce(F.try_element_at(s["seen"], p), F.lit(0)) + 1)).alias("seen"),
        F.concat(s["out"], F.array(F.concat(p, F.lit("#"), F.coalesce(F.try_element_at(s["seen"], p), F.lit(0)).cast("string")))).alias("out"),
    ))
    return counted["out"]


def similar_texts(texts: DataFrame, least: float) -> DataFrame:
    """Pairs of different texts (``text, place``) with a :func:`sequence_ratio` of ``least``: ``early, late, ratio``.

    ``late`` is the place of the text that comes after and is matched against the earlier one.
    Candidates are exact: texts of that ratio differ by a bounded number of characters taken out
    and put in, each of which spoils at most two pairs of letters, so the rarest pairs of both,
    one more than can be spoilt, share one. Lengths and counts of shared pairs are compared before
    any text is matched. Texts too short for that bound are compared among themselves by length.
    """
    share = 2 * (1 - least) / least
    rows = texts.select("place", "text", F.char_length("text").alias("n")).withColumn("pairs", _pairs_of_letters(F.col("text")))
    rows = rows.withColumn("spoilt", 2 * F.floor(F.col("n") * share + 1e-9).cast("int"))
    rows = materialize(rows, "similar-texts")
    often = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("f"))
    each = rows.select("place", "n", "spoilt", F.size("pairs").alias("size"), F.explode("pairs").alias("pair")).join(often, "pair")
    rarity = F.row_number().over(Window.partitionBy("place").orderBy("f", "pair"))
    first = each.withColumn("nth", rarity).where(F.col("nth") <= F.col("spoilt") + 1).select("place", "n", "pair")
    # Where every pair of a short text may be spoilt, length alone makes candidates.
    tiny = rows.where(F.size("pairs") <= F.col("spoilt")).select("place", "n", F.explode(F.sequence(F.floor(F.col("n") / (1 + share)).cast("int"), F.ceil(F.col("n") * (1 + share)).cast("int"))).alias("m"))
    side = lambda df, name: df.select(F.col("place").alias(name), F.col("n").alias(f"n_{name}"), *[c for c in df.columns if c not in ("place", "n")])
    near = 2.0 * F.least("n_early", "n_late") >= least * (F.col("n_early") + F.col("n_late")) - 1e-9
    met = side(first, "early").join(side(first, "late"), "pair").where((F.col("early") < F.col("late")) & near).select("early", "late")
    short = side(tiny, "x").join(rows.select(F.col("place").alias("y"), F.col("n").alias("m")), "m").where("x <> y").select(F.least("x", "y").alias("early"), F.greatest("x", "y").alias("late"))
    both = met.unionByName(short).distinct()
    text = lambda name: rows.select(F.col("place").alias(name), F.col("text").alias(f"{name}_text"), F.col("pairs").alias(f"{name}_pairs"))
    full = both.join(text("early"), "early").join(text("late"), "late")
    shared = F.size(F.array_intersect("early_pairs", "late_pairs"))
    enough = shared >= F.greatest(F.size("early_pairs"), F.size("late_pairs")) - F.floor(2 * (1 - least) * (F.char_length("early_text") + F.char_length("late_text")) + 1e-9)
    scored = full.where(enough).select("early", "late", sequence_ratio(F.col("late_text"), F.col("early_text")).alias("ratio"))
    return scored.where(F.col("ratio") >= least)


def first_fit(items: DataFrame, links: DataFrame, best: bool = False) -> DataFrame:
    """Groups of ``items`` (``place``) taken in order: ``place, leader``.

    An item joins the first leader before it that ``links`` (``early, late, score``) names, or with
    ``best`` the one with the highest score, the first of equals; without one it leads a group.
    That is the fold over a list, but in rounds: an item whose linked predecessors are all decided
    is decided, and one with a leader among them is settled at once. Each round is two joins over
    the links that are still open, so no task sees a whole list.
    """
    links = materialize(links.select("early", "late", "score"), "fit-links")
    late = links.select(F.col("late").alias("place")).distinct()
    leaders = materialize(items.select("place").distinct().join(late, "place", "left_anti"), "fit-leaders")
    found, open_ = [leaders], materialize(late.join(items.select("place").distinct(), "place", "left_semi"), "fit-open")
    while not open_.isEmpty():
        led = links.join(found[-1].select(F.col("place").alias("early")), "early", "left_semi").select(F.col("late").alias("place")).distinct()
        left = materialize(open_.join(led, "place", "left_anti"), "fit-open")
        waiting = links.join(left.select(F.col("place").alias("early")), "early", "left_semi").select(F.col("late").alias("place")).distinct()
        found.append(materialize(left.join(waiting, "place", "left_anti"), "fit-leaders"))
        before, open_ = open_, materialize(left.join(found[-1], "place", "left_anti"), "fit-open")
        discard(before)
        discard(left)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    every = materialize(every, "fit-leaders")
    to = links.join(every.select(F.col("place").alias("early")), "early").join(every.select(F.col("place").alias("late")), "late", "left_anti")
    chosen = to.groupBy(F.col("late").alias("place")).agg(F.max_by("early", F.struct("score", (-F.col("early")).alias("early"))).alias("leader") if best else F.min("early").alias("leader"))
    return every.select("place", F.col("place").alias("leader")).unionByName(chosen)


def _blocks(rows: DataFrame, id_col: str, vec_col: str, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows packed by hash into blocks of about ``size``: ``dim, block, ids, rows``; null vectors are left out."""
    kept = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    n = max(1, -(-kept.count() // size))
    packed = kept.groupBy(F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
    return packed.select("dim", "block", F.transform("rows", lambda r: r["id"]).alias(f"{name}_ids"), F.flatten(F.transform("rows", lambda r: r["vec"])).alias(f"{name}_rows")), n


def _matrix(batch: pa.RecordBatch, i: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(batch.schema.get_field_index(f"{name}_ids"))[i].values.to_numpy(zero_copy_only=False)
    flat = np.nan_to_num(batch.column(batch.schema.get_field_index(f"{name}_rows"))[i].values.to_numpy(zero_copy_only=False), nan=0.0)
    return ids, flat.reshape(len(ids), -1)


def _cosines(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, summed from first to last component; 0 with a zero vector."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 14):
        a, b = left[i[at : at + (1 << 14)]], right[j[at : at + (1 << 14)]]
        last = lambda x: np.cumsum(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
        size = np.sqrt(last(a * a)) * np.sqrt(last(b * b))
        out[at : at + (1 << 14)] = np.where(size > 0, last(a * b) / np.where(size > 0, size, 1), 0.0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def nearest_rows(vectors: DataFrame, queries: DataFrame, k: int, least: float | None = None, own: bool = False, vec_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """The ``k`` rows of ``vec_id, embedding`` with the highest cosine for each row of ``queries``
    (same columns): ``query_id, vec_id, score, rank``, ties to the smaller id.

    Both sides are packed into blocks by a hash of the id; each pair of blocks is one matrix
    product, of which only each query's best rows go on, and the best of all blocks are merged.
    With ``least`` lower scores are left out; a query's own id is left out unless ``own``. Scores
    are rounded to six places before they are ranked. Null ids and vectors take no part, null
    components count as 0, and vectors of another length are not compared.
    """
    left, _ = _blocks(vectors, "vec_id", "embedding", vec_rows, "v")
    right, n = _blocks(queries, "vec_id", "embedding", query_rows, "q")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (ids, rows), (names, asked) = _matrix(batch, at, "v"), _matrix(batch, at, "q")
                near = _unit(asked) @ _unit(rows).T
                if not own:
                    near[names[:, None] == ids[None, :]] = -np.inf
                # What is within rounding of the last place is scored exactly before it is ranked.
                bar = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
                bar = np.where(np.isfinite(bar), bar, -2.0) - 3e-6
                i, j = np.nonzero((near >= bar[:, None]) & np.isfinite(near) & (near >= -2.0 if least is None else near >= least - 3e-6))
                score = np.floor(_cosines(asked, rows, i, j) * 1e6 + 0.5) / 1e6
                if least is not None:
                    good = score >= least
                    i, j, score = i[good], j[good], score[good]
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(names[i[keep]].astype(np.int64)), pa.array(ids[j[keep]].astype(np.int64)), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    pairs = left.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(right.withColumnRenamed("block", "asked"), ["dim", "asked"])
    found = pairs.mapInArrow(match, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def close_pairs(vectors: DataFrame, least: float, rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Pairs of different vectors of ``place, embedding`` with a cosine of ``least``: ``early, late, score``.

    Equal vectors are compared once, by the first of them: the second frame returned has each
    vector's ``first`` and all its ``places``. Each pair of blocks is one matrix product.
    """
    same = vectors.where("place is not null and embedding is not null").select("place", F.col("embedding").cast("array<double>").alias("embedding"))
    groups = materialize(same.groupBy("embedding").agg(F.min("place").alias("first"), F.collect_list("place").alias("places")), "close-groups")
    left, n = _blocks(groups, "first", "embedding", rows, "v")
    left = materialize(left, "close-blocks")
    right = left.select("dim", F.col("block").alias("asked"), F.col("v_ids").alias("q_ids"), F.col("v_rows").alias("q_rows"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (ids, a), (others, b) = _matrix(batch, at, "v"), _matrix(batch, at, "q")
                i, j = np.nonzero(_unit(a) @ _unit(b).T >= least - 3e-6)
                good = ids[i] < others[j] if batch.column(batch.schema.get_field_index("same"))[at].as_py() else np.ones(len(i), bool)
                i, j = i[good], j[good]
                score = np.floor(_cosines(a, b, i, j) * 1e6 + 0.5) / 1e6
                good = score >= least
                x, y = ids[i[good]].astype(np.int64), others[j[good]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score[good])], names=["early", "late", "score"])

    met = left.withColumn("asked", F.explode(F.sequence(F.col("block"), F.lit(n - 1)))).join(right, ["dim", "asked"]).withColumn("same", F.col("block") == F.col("asked"))
    return met.mapInArrow(match, "early long, late long, score double"), groups


def threshold_clusters(vectors: DataFrame, least: float) -> DataFrame:
    """First-fit clusters of ``place, embedding`` by cosine: ``place, leader``.

    Each row, in order of place, joins the first leader with a cosine of ``least`` (rounded to six
    places), else leads a cluster. Equal vectors end in the cluster of the first of them; a zero
    vector is alone.
    """
    pairs, groups = close_pairs(vectors, least)
    led = first_fit(groups.select(F.col("first").alias("place")), pairs)
    members = groups.select("first", F.explode("places").alias("place"), F.exists("embedding", lambda x: x != 0).alias("real"))
    done = members.join(led.withColumnRenamed("place", "first"), "first")
    return done.select("place", F.when(F.col("real"), F.col("leader")).otherwise(F.col("place")).alias("leader"))


def seed_clusters(items: DataFrame, seeds: int) -> DataFrame:
    """Items (``vec_id, embedding, score``) with the nearest of the ``seeds`` best by score: ``vec_id, seed, similarity``.

    Seeds are ranked by score, then by id; of equally near ones the better ranked wins, and a seed
    is its own.
    """
    best = materialize(items.orderBy(F.desc_nulls_last("score"), "vec_id").limit(seeds).select("vec_id", "embedding"), "seeds")
    ranked = best.join(items.select("vec_id", "score"), "vec_id").withColumn("seed_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "vec_id")))
    ranked = materialize(ranked.select("seed_rank", F.col("vec_id").alias("seed"), "embedding"), "seeds")
    near = nearest_rows(ranked.select(F.col("seed_rank").cast("long").alias("vec_id"), "embedding"), items.join(best, "vec_id", "left_anti"), 1, own=True)
    others = near.join(F.broadcast(ranked.select(F.col("seed_rank").alias("vec_id"), "seed")), "vec_id").select(F.col("query_id").alias("vec_id"), "seed", F.col("score").alias("similarity"))
    return ranked.select(F.col("seed").alias("vec_id"), "seed", F.lit(1.0).alias("similarity")).unionByName(others)


def assign_to(items: DataFrame, themes: DataFrame, least: float = 0.2) -> DataFrame:
    """Each item (``vec_id, embedding``) with the most similar theme (``vec_id, embedding, theme``) or ``other``
    below ``least``: ``vec_id, theme, similarity``; the first of equals by the theme's id."""
    near = nearest_rows(themes.select("vec_id", "embedding"), items, 1, own=True)
    names = themes.select("vec_id", "theme").join(near.withColumnRenamed("query_id", "item"), "vec_id")
    return names.select(F.col("item").alias("vec_id"), F.when(F.col("score") >= least, F.col("theme")).otherwise("other").alias("theme"), F.col("score").alias("similarity"))


def normal_text(text: Column) -> Column:
    """Lower-case letters, digits and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def merge_similar_patterns(found: DataFrame, least: float = 0.9) -> DataFrame:
    """Patterns (``pattern, seq``) with the kept pattern each is merged into: ``seq, pattern, merged``.

    In order of ``seq``, a pattern is merged into the kept one whose plain text is most similar, if
    that is ``least`` or more, the first of equals; else it is kept itself. Equal plain texts are
    one text. Similarity is that of :func:`sequence_ratio`.
    """
    plain = found.where("pattern is not null").select("seq", "pattern", normal_text(F.col("pattern")).alias("text"))
    texts = materialize(plain.groupBy("text").agg(F.min("seq").alias("place")), "pattern-texts")
    led = first_fit(texts.select("place"), similar_texts(texts, least).withColumnRenamed("ratio", "score"), best=True)
    kept = led.join(plain.select(F.col("seq").alias("leader"), F.col("pattern").alias("merged")), "leader")
    return plain.join(texts.join(kept, "place"), "text").select("seq", "pattern", "merged")


#: Numbers and years that tell claims apart: fixed values.
LONG_NUMBER, CLAIM_YEAR = r"\b\d{3,}\b", r"(18\d{2}|19\d{2}|20\d{2})"


def contradiction_type(claim_a: Column, claim_b: Column) -> Column:
    """What kind of contradiction two claims are, and how sure: ``type, confidence``.

    Claims of a ratio of 0.85 in their letters, digits and spaces are variants of a name; then
    differing numbers of three digits or more beside "certificate", then differing years.
    """
    a, b = F.lower(F.coalesce(claim_a, F.lit(""))), F.lower(F.coalesce(claim_b, F.lit("")))
    bare = lambda c: F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", ""))
    ratio = F.when((bare(a) != "") & (bare(b) != ""), sequence_ratio(bare(a), bare(b)))
    every = lambda c, pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))))
    differ = lambda pattern: (F.size(every(a, pattern)) > 0) & (F.size(every(b, pattern)) > 0) & (every(a, pattern) != every(b, pattern))
    named = F.contains(a, F.lit("certificate")) | F.contains(b, F.lit("certificate"))
    kind = F.when(ratio >= 0.85, "name_variant_or_ocr").when(differ(LONG_NUMBER) & named, "certificate_number_conflict").when(differ(CLAIM_YEAR), "date_conflict").otherwise("true_conflict")
    return F.struct(kind.alias("type"), F.when(kind.isin("name_variant_or_ocr", "certificate_number_conflict"), "medium").otherwise("low").alias("confidence"))

