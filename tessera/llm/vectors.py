"""Near-duplicate vectors by sorted projection passes, and nearest neighbours by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import materialize


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, passes: int = 10, bits: int = 24, window: int = 512, seed: int = 7) -> DataFrame:
    """Per row of ``vec_id, embedding, label``: ``n_links``, ``component_id`` and ``kept``.

    Rows with equal labels link if their cosine is at least ``threshold``. Each pass orders the
    vectors of each label by a string of random hyperplane hashes, cuts the order into blocks by
    rank and compares each vector with the ``window`` that follow it. There are at least ``passes``,
    and as many as :func:`passes_needed` says for the largest label; where that exceeds the window,
    further rounds of as many passes follow until one joins no two components. Verified pairs of
    all passes are united into components. Inside each component all pairs are then compared in
    blocks, so a group denser than the window keeps every link.

    A null label, or a vector that :func:`usable` refuses, links with nothing: no links, itself
    as component, kept. Equal vectors with equal labels are compared once and count each other.
    Ids name vectors; a row with a null id takes no part. Vectors of different lengths are never
    compared. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    valid = rows.where(able)
    classes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    passes, bits = passes_needed(largest, threshold, passes, bits, window)
    parts = connected_components(_pass_links(classes, threshold, passes, bits, window, seed))
    # A label within the window is compared whole by one pass; in larger ones a pass can miss.
    while largest > window + 1:
        seed += 1
        parts = materialize(parts, "vector-parts")
        ends = [parts.select(F.col("vertex").alias(c), F.col("component").alias(f"{c}_part")) for c in ("src", "dst")]
        more = _pass_links(classes, threshold, passes, bits, window, seed).join(ends[0], "src", "left").join(ends[1], "dst", "left")
        more = materialize(more.where(F.coalesce("src_part", "src") != F.coalesce("dst_part", "dst")).select("src", "dst"), "vector-links")
        if more.isEmpty():
            break
        parts = connected_components(parts.select(F.col("vertex").alias("src"), F.col("component").alias("dst")).union(more))
    grouped = classes.join(parts, classes.rep == parts.vertex).select("rep", "n", "embedding", "component")
    counted = _count_links(grouped, threshold)
    known = classes.join(counted.withColumnRenamed("rep", "linked"), F.col("rep") == F.col("linked"), "left").select(
        F.col("label").alias("class_label"), F.col("embedding").alias("class_vector"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    done = valid.join(known, (F.col("label") == F.col("class_label")) & (F.col("embedding") == F.col("class_vector"))).select("vec_id", "n_links", "component_id")
    rest = rows.where(~able).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def passes_needed(largest: int, threshold: float, passes: int, bits: int, window: int, missed: float = 1e-3) -> tuple[int, int]:
    """Passes and bits such that a pair at ``threshold`` is missed with a chance of at most ``missed``.

    A pass brings a pair together if it agrees in so many leading bits that no more than ``window``
    vectors of the label share them: log2(largest / window), and two more for uneven shares. This
    takes directions to be spread; where they crowd, further rounds have to find what is left.
    """
    if largest <= window + 1:
        return passes, bits
    depth = np.log2(largest / window) + 2
    meet = (1 - np.arccos(threshold) / np.pi) ** depth
    return max(passes, int(np.ceil(np.log(missed) / np.log1p(-meet)))), min(62, max(bits, int(np.ceil(depth)) + 4))


def _pass_links(classes: DataFrame, threshold: float, passes: int, bits: int, window: int, seed: int) -> DataFrame:
    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                x = _stack(part["embedding"])
                planes = np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))
                sides = (x @ planes > 0).reshape(len(x), passes, bits)
                code = (sides * (1 << np.arange(bits)[::-1])).sum(axis=2)
                for p in range(passes):
                    yield part[["rep", "label", "embedding"]].assign(turn=p, dim=dim, code=code[:, p])

    kinds = dict(classes.dtypes)
    coded = classes.select("rep", "label", "embedding").mapInPandas(codes, f"rep long, label {kinds['label']}, embedding {kinds['embedding']}, turn int, dim int, code long")
    keys = ["turn", "label", "dim", "code", "rep"]
    ordered = coded.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = materialize(ordered, "vector-order").withColumn("part", F.shiftright("at", 33))
    # One count per partition of the order, not per row, tells where each partition's ranks begin.
    counts = ordered.groupBy("part").count()
    first = counts.select("part", (F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("first"))
    size = 2 * window
    ranked = ordered.join(first, "part").withColumn("rank", F.col("first") + F.col("at").bitwiseAND(2**33 - 1))
    block = F.floor(F.col("rank") / size)
    also = F.when((F.col("rank") % size < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    ranked = ranked.select("rep", "label", "dim", "turn", "embedding", "rank", F.explode(also).alias("block"))

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby(["turn", "label", "dim"]):
            part = part.sort_values("rank")
            rank, rep = part["rank"].to_numpy(), part["rep"].to_numpy()
            x = _unit(_stack(part["embedding"]))
            own = rank // size == key[0]
            gap = rank[None, :] - rank[own][:, None]
            near = (x[own] @ x.T >= threshold) & (gap > 0) & (gap <= window)
            name, left = rep.copy(), np.flatnonzero(own)
            i, j = np.nonzero(near)
            i = left[i]
            while len(i):
                low = np.minimum(name[i], name[j])
                if (name[i] == low).all() and (name[j] == low).all():
                    break
                np.minimum.at(name, i, low)
                np.minimum.at(name, j, low)
            moved = name != rep
            out.append(pd.DataFrame({"src": name[moved], "dst": rep[moved]}))
        return pd.concat(out)

    return ranked.groupBy("block").applyInPandas(compare, "src long, dst long")


def _count_links(grouped: DataFrame, threshold: float, chunk: int = 512) -> DataFrame:
    """Links of each vector inside its component, weighted by copies: all pairs, in blocks."""
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = grouped.join(sizes, "component").withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    small = F.struct(F.pmod(F.xxhash64("component"), F.lit(4096)).alias("group"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.col("component").alias("group"), F.least("mine", k).alias("a"), F.greatest("mine", k).alias("b")))
    rows = rows.withColumn("unit", F.explode(F.when(F.col("chunks") == 1, F.array(small)).otherwise(pairs)))
    rows = rows.select("component", "rep", "n", "embedding", "chunks", "mine", (F.col("chunks") > 1).alias("large"), "unit.group", "unit.a", "unit.b")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for component, part in pdf.groupby("component"):
            x, n, rep = _unit(_stack(part["embedding"])), part["n"].to_numpy(), part["rep"].to_numpy()
            left = part["mine"].to_numpy() == key[2] if key[0] else np.ones(len(part), bool)
            right = part["mine"].to_numpy() == key[3] if key[0] else left
            near = x[left] @ x[right].T >= threshold
            same = rep[left][:, None] == rep[right][None, :]
            near &= ~same
            found = [(rep[left], near @ n[right])]
            if key[0] and key[2] != key[3]:
                found.append((rep[right], near.T @ n[left]))
            out += [pd.DataFrame({"rep": r, "links": c, "component": component}) for r, c in found]
        return pd.concat(out)

    counted = rows.groupBy("large", "group", "a", "b").applyInPandas(count, "rep long, links long, component long")
    return counted.groupBy("rep").agg(F.sum("links").alias("links"), F.min("component").alias("component"))


class Tree:
    """A vantage-point tree over one shard, for largest inner products.

    Rows get one more coordinate that makes all lengths equal, so that the nearest row of a query
    by distance is the one with the largest inner product. Equal rows are one point with the
    sorted ids of its rows.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 256) -> None:
        order = np.argsort(ids, kind="stable")
        self.rows, place = np.unique(rows[order], axis=0, return_inverse=True)
        by_point = np.argsort(place.ravel(), kind="stable")
        self.ids, self.first = ids[order][by_point], np.searchsorted(place.ravel()[by_point], np.arange(len(self.rows) + 1))
        squared = (self.rows**2).sum(axis=1)
        self.length = squared.max()
        self.lengths = np.sqrt(squared)
        self.wide = np.column_stack([self.rows, np.sqrt(np.maximum(0, self.length - squared))])
        self.leaf = leaf
        # Where squares overflow no distance prunes, and the whole shard is one leaf.
        every = np.arange(len(self.rows))
        self.root = self._build(every, np.random.default_rng(len(self.rows))) if np.isfinite(4 * self.length) else every

    def _build(self, at: np.ndarray, rng):
        if len(at) <= self.leaf:
            return at
        vantage = at[rng.integers(len(at))]
        rest = at[at != vantage]
        far = np.sqrt(((self.wide[rest] - self.wide[vantage]) ** 2).sum(axis=1))
        middle = np.median(far)
        inside = far <= middle
        if inside.all():
            return at
        return vantage, middle, self._build(rest[inside], rng), self._build(rest[~inside], rng)

    def search(self, queries: np.ndarray, keep: int, factor: float = 1.0) -> np.ndarray:
        """Points with the largest inner products, ``keep`` for each query (-1: none left).

        Inner products are compared as summed from first to last component, ties by smallest id.
        """
        self.q, self.factor = queries, factor
        squared = (queries**2).sum(axis=1)
        # What summing in another order can change in an inner product, per length of the point.
        self.doubt = 4 * queries.shape[1] * np.finfo(float).eps * np.sqrt(squared)
        self.norm = squared + self.length
        # What rounding can change in a difference of distances: the root of that in their squares.
        self.slack = 4 * np.sqrt(4 * (queries.shape[1] + 1) * np.finfo(float).eps * self.norm)
        self.best = np.full((len(queries), keep), -np.inf)
        self.point = np.full((len(queries), keep), -1)
        self._visit(self.root, np.arange(len(queries)))
        return self.point

    def _offer(self, who: np.ndarray, points: np.ndarray) -> np.ndarray:
        keep = self.best.shape[1]
        near = self.q[who] @ self.rows[points].T
        doubt = self.doubt[who][:, None] * self.lengths[points]
        last = self.best[who, -1]
        least = np.where(np.isnan(last), np.inf, last)
        if len(points) > keep:
            sure = near - doubt
            least = np.maximum(least, np.partition(np.where(np.isnan(sure), -np.inf, sure), -keep, axis=1)[:, -keep])
        # Not below, rather than above: a bound that is not a number rules nothing out.
        i, j = np.nonzero(~(near + doubt < least[:, None]))
        if len(i):
            new = np.concatenate([np.cumsum(self.q[who[i[at : at + 65536]]] * self.rows[points[j[at : at + 65536]]], axis=1)[:, -1] for at in range(0, len(i), 65536)])
            some, slot = np.unique(i, return_inverse=True)
            mine = who[some]
            group = np.concatenate([np.repeat(np.arange(len(mine)), keep), slot])
            score = np.concatenate([self.best[mine].ravel(), new])
            point = np.concatenate([self.point[mine].ravel(), points[j]])
            name = self.ids[self.first[np.maximum(point, 0)]]
            order = np.lexsort((name, -score, ~np.isnan(score), point < 0, group))
            begin = np.searchsorted(group[order], np.arange(len(mine)))
            take = order[begin[:, None] + np.arange(keep)]
            self.best[mine], self.point[mine] = score[take], point[take]
        return near

    def _visit(self, node, who: np.ndarray) -> None:
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            for at in range(0, len(node), self.leaf):
                self._offer(who, node[at : at + self.leaf])
            return
        vantage, middle, inner, outer = node
        far = np.sqrt(np.maximum(0, self.norm[who] - 2 * self._offer(who, np.array([vantage]))[:, 0]))
        gap = far - middle
        inside = gap <= 0
        for mine, first, second in ((inside, inner, outer), (~inside, outer, inner)):
            self._visit(first, who[mine])
            # By the triangle inequality nothing beyond the shell is nearer than the gap.
            radius = np.sqrt(np.maximum(0, self.norm[who[mine]] - 2 * self.best[who[mine], -1]))
            open_ = ~(np.abs(gap[mine]) > self.factor * radius + self.slack[who[mine]])
            self._visit(second, who[mine][open_])


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """The ``k`` rows of ``vec_id, embedding`` with the largest inner product for each query row.

    Returns ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, ties to the smaller id. Rows
    are dealt into shards, each with a vantage-point tree; blocks of queries visit every shard
    and each shard's best are merged. ``factor`` scales the search radius: at 1 pruning by the
    triangle inequality is exact, smaller values visit fewer nodes and may miss neighbours.

    Rows with a null id or a vector that :func:`usable` refuses take no part on either side, nor
    does the query's own id. Fewer than ``k`` are returned if there are no more. Queries whose
    length differs from the rows' find nothing there. Other columns are ignored.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), "embedding", F.size("embedding").alias("dim"))
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), "embedding", F.size("embedding").alias("dim"))
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // query_rows))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "rows": [_stack(pdf["embedding"]).tobytes()]})

    packed = "dim int, part int, ids binary, rows binary"
    deal = lambda df, parts: df.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).groupBy("dim", "part").applyInPandas(pack, packed)
    left = deal(rows, shards).select("dim", F.col("ids").alias("ids"), F.col("rows").alias("rows"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = deal(asked, blocks).select("dim", F.col("part").alias("block"), F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, asking = np.frombuffer(row.ids, np.int64), np.frombuffer(row.query_ids, np.int64)
                tree = Tree(ids, np.frombuffer(row.rows, np.float64).reshape(len(ids), -1))
                questions = np.frombuffer(row.query_rows, np.float64).reshape(len(asking), -1)
                # One more than k, for the query itself.
                points = tree.search(questions, k + 1, factor)
                for i in range(len(asking)):
                    found = points[i][points[i] >= 0]
                    score = np.cumsum(questions[i] * tree.rows[found], axis=1)[:, -1]
                    counts = np.minimum(tree.first[found + 1] - tree.first[found], k + 1)
                    who = np.concatenate([tree.ids[tree.first[p] : tree.first[p] + c] for p, c in zip(found, counts)])
                    score = np.repeat(score, counts)
                    other = who != asking[i]
                    who, score = who[other], score[other]
                    top = np.lexsort((who, -score))[:k]
                    yield pd.DataFrame({"query_id": asking[i], "vec_id": who[top], "score": score[top]})

    pairs = left.join(right, ["dim", "block"]).repartition("block", F.xxhash64("ids"))
    found = pairs.mapInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
