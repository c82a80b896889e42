"""Closed-form network statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import round6
from tessera.operators.components import connected_components
from tessera.operators.network import symmetric
from tessera.session import materialize, small


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("node", "node_type").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))


def degree_summary(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.min("degree").alias("min"), F.max("degree").alias("max"), round6(F.avg("degree")).alias("mean"),
        round6(F.percentile("degree", 0.5)).alias("median"), round6(F.stddev_samp("degree")).alias("stdev"),
    )


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def hubs(edges: DataFrame, limit: int = 30, sigma: float = 2) -> DataFrame:
    """Nodes at least ``sigma`` standard deviations above the mean degree."""
    d = degrees(edges)
    bar = d.agg((F.avg("degree") + sigma * F.stddev_samp("degree")).alias("bar"))
    return d.crossJoin(F.broadcast(bar)).where("degree >= bar").drop("bar", "node_type").orderBy(F.desc("degree"), "node").limit(limit)


def gini(edges: DataFrame) -> DataFrame:
    """Inequality of degrees. Equal degrees share their ranks, so only the histogram is ordered."""
    h = degree_histogram(edges)
    before = F.coalesce(F.sum("n").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = h.withColumn("ranks", F.col("n") * before + F.col("n") * (F.col("n") - 1) / 2)
    total, size = F.sum(F.col("degree") * F.col("n")), F.sum("n")
    return ranked.agg(round6(F.coalesce(F.try_divide(2 * F.sum(F.col("degree") * F.col("ranks")) + (1 - size) * total, size * total), F.lit(0.0))).alias("gini"))


def powerlaw_alpha(edges: DataFrame, least: int = 20) -> DataFrame:
    """A power law through the degrees, from the smallest on, and how far the degrees are from it.

    ``alpha`` is the maximum-likelihood exponent and ``ks`` the Kolmogorov-Smirnov distance
    between the degrees' and the law's distribution functions, taken on both sides of each step of
    the histogram. ``p_value`` is that of the asymptotic one-sample test, and the law is
    ``plausible`` above 0.1. Under ``least`` nodes, or where all degrees are equal, all but ``n``
    and ``xmin`` is null.
    """
    ordered = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    h = degree_histogram(edges).withColumns({"upto": F.sum("n").over(ordered), "all": F.sum("n").over(Window.partitionBy()), "xmin": F.min("degree").over(Window.partitionBy())})
    spread = F.sum(F.col("n") * F.log(F.col("degree") / F.col("xmin"))).over(Window.partitionBy())
    h = h.withColumn("alpha", F.when((F.col("all") >= least) & (spread > 0), 1 + F.col("all") / spread))
    law = 1 - F.pow(F.col("degree") / F.col("xmin"), 1 - F.col("alpha"))
    gap = F.greatest(F.abs(F.col("upto") / F.col("all") - law), F.abs((F.col("upto") - F.col("n")) / F.col("all") - law))
    fit = h.agg(F.coalesce(F.max("all"), F.lit(0)).alias("n"), F.max("xmin").alias("xmin"), F.max("alpha").alias("alpha"), F.max(gap).alias("ks"))
    scaled = F.sqrt("n") * F.col("ks")
    # The series settles at once but for tiny distances, where the value is 1.
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(50)), F.lit(0.0), lambda s, j: s + 2 * F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * scaled * scaled))
    p = F.when(F.col("ks").isNotNull(), F.when(scaled < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))))
    return fit.select("n", "xmin", round6(F.col("alpha")).alias("alpha"), round6(F.col("ks")).alias("ks"), round6(p).alias("p_value"), (p > 0.1).alias("plausible"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, components, and the largest component's size."""
    n = degrees(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    sizes = connected_components(edges.select("src", "dst")).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    parts = sizes.agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"))
    return n.crossJoin(m).crossJoin(parts).select("n_nodes", "n_edges", round6(F.coalesce(F.try_divide(2 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), F.lit(0.0))).alias("density"), "n_components", "largest")


def mixing(edges: DataFrame) -> DataFrame:
    """Weight between categories, what is expected by chance, and the Pearson residual.

    Each ordered pair of categories is a row. Weights within a category count once, those between
    two count in both orders, and the total is half the sum of all. The expected weight is twice
    the total times both categories' shares of the nodes; ``notable`` are residuals beyond 2.
    """
    cells = edges.groupBy("src_type", "dst_type").agg(F.sum("weight").alias("w"))
    both = F.array(F.struct(F.col("src_type").alias("a"), F.col("dst_type").alias("b")), F.struct(F.col("dst_type").alias("a"), F.col("src_type").alias("b")))
    sides = F.when(F.col("src_type") == F.col("dst_type"), F.slice(both, 1, 1)).otherwise(both)
    observed = cells.select(F.explode(sides).alias("x"), "w").groupBy("x.a", "x.b").agg(F.sum("w").alias("weight"))
    sizes = degrees(edges).groupBy("node_type").agg(F.count(F.lit(1)).alias("size")).withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy()))
    # One row for each category: at most a few dozen are asked for.
    ends = sizes.select(F.col("node_type").alias("a"), F.col("share").alias("pa")).crossJoin(sizes.select(F.col("node_type").alias("b"), F.col("share").alias("pb")))
    full = ends.join(observed, ["a", "b"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    full = full.withColumn("expected", F.col("pa") * F.col("pb") * F.sum("weight").over(Window.partitionBy()))
    residual = F.try_divide(F.col("weight") - F.col("expected"), F.sqrt("expected"))
    return full.select("a", "b", "weight", round6(F.col("expected")).alias("expected"), round6(residual).alias("residual"), (F.abs(residual) > 2).alias("notable"))


def assortativity(edges: DataFrame) -> DataFrame:
    """(trace - sum a b) / (1 - sum a b) of the matrix of edge ends by type."""
    e = symmetric(edges).groupBy("node_type", "other_type").agg(F.count(F.lit(1)).alias("n"))
    total = e.agg(F.sum("n").alias("total"))
    trace = e.agg(F.sum(F.when(F.col("node_type") == F.col("other_type"), F.col("n")).otherwise(0)).alias("same"))
    ends = e.groupBy("node_type").agg(F.sum("n").alias("end")).agg(F.sum(F.col("end").cast("double") * F.col("end")).alias("square"))
    row = total.crossJoin(trace).crossJoin(ends)
    by_chance = F.try_divide("square", F.col("total").cast("double") * F.col("total"))
    return row.select(round6(F.try_divide(F.try_divide(F.col("same"), "total") - by_chance, 1 - by_chance)).alias("coefficient"))


def modularity(edges: DataFrame) -> DataFrame:
    """Unweighted modularity of the partition by type."""
    inside = edges.where("src_type = dst_type").groupBy(F.col("src_type").alias("type")).agg(F.count(F.lit(1)).alias("l"))
    ends = symmetric(edges).groupBy(F.col("node_type").alias("type")).agg(F.count(F.lit(1)).alias("d"))
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    terms = ends.join(inside, "type", "left").crossJoin(F.broadcast(m))
    return terms.agg(round6(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - (F.col("d") / (2 * F.col("m"))) * (F.col("d") / (2 * F.col("m"))))).alias("modularity"))


def ranked_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered by degree, then name (``node``, ``degree``, ``rank``), and edges between
    numbers, ``lo`` < ``hi``, so that no hub starts many."""
    nodes = degrees(edges).select("node", "degree").repartitionByRange("degree", "node").sortWithinPartitions("degree", "node")
    nodes = materialize(nodes.withColumn("rank", F.monotonically_increasing_id()), "node-ranks")
    ends = [small(nodes.select(F.col("node").alias(c), F.col("rank").alias(f"{c}_rank"))) for c in ("src", "dst")]
    joined = edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst")
    return nodes, materialize(joined.select(F.least("src_rank", "dst_rank").alias("lo"), F.greatest("src_rank", "dst_rank").alias("hi")), "ranked-edges")


#: Edges that one task should hold to find triangles.
EDGES_A_BLOCK = 3_000_000


def corners(ranked: DataFrame) -> DataFrame:
    """How many triangles each node has a part in: ``rank, triangles``; nodes without are left out.

    Nodes are dealt into groups by hash, and each edge goes to the blocks of its two groups with
    every group, so that each triangle has all of its edges in the block of its nodes' groups. An
    edge is sent once for each group, of which there are as many as the square root of the edges
    asks for, while paths of two edges, which grow faster, are only made and tested within a block.
    """
    n = ranked.count()
    # A few groups more let small graphs be worked on side by side.
    groups = max(math.ceil(math.sqrt(6 * n / EDGES_A_BLOCK)) if n > EDGES_A_BLOCK else 1, min(4, math.ceil(math.sqrt(16 * n / EDGES_A_BLOCK))))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    sides = ranked.select("lo", "hi", group("lo").alias("i"), group("hi").alias("j"))
    met = sides.select("lo", "hi", "i", "j", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("k"))
    block = F.array_sort(F.array("i", "j", "k"))
    sent = met.select("lo", "hi", (F.col("i") == F.col("j")).alias("same"), (F.get(block, F.lit(0)) * groups * groups + F.get(block, F.lit(1)) * groups + F.get(block, F.lit(2))).cast("long").alias("block"))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one = groups * groups + groups + 1
        nodes, found = _block_corners(pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), None if key[0] % one == 0 else pdf["same"].to_numpy())
        return pd.DataFrame({"rank": nodes, "triangles": found})

    blocks = groups * (groups + 1) * (groups + 2) // 6
    return sent.repartition(blocks, "block").groupBy("block").applyInPandas(count, "rank long, triangles long").groupBy("rank").agg(F.sum("triangles").alias("triangles"))


def _block_corners(lo: np.ndarray, hi: np.ndarray, same: np.ndarray | None, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a block's edges and their triangles. Triangles of three edges marked ``same`` belong to another block."""
    nodes, ends = np.unique(np.concatenate((lo, hi)), return_inverse=True)
    size = len(nodes)
    key = ends[: len(lo)].astype(np.int64) * size + ends[len(lo) :]
    order = np.argsort(key)
    key = key[order]
    inside = None if same is None else same[order]
    del ends, order
    x, y = key // size, key % size
    stop = np.searchsorted(x, x, side="right")
    # Each edge meets the later edges of its first node; the third side is looked up.
    after = stop - np.arange(len(key)) - 1
    del stop
    upto = np.concatenate(([0], np.cumsum(after)))
    found = np.zeros(size, np.int64)
    begin = 0
    while begin < len(key):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + most, side="right")) - 1)
        one = np.repeat(np.arange(begin, end), after[begin:end])
        two = one + 1 + np.arange(len(one)) - (upto[one] - upto[begin])
        asked = y[one] * size + y[two]
        third = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        good = key[third] == asked
        if inside is not None:
            good &= ~(inside[one] & inside[two] & inside[third])
        for corner in (x[one[good]], y[one[good]], y[two[good]]):
            found += np.bincount(corner, minlength=size)
        begin = end
    some = found > 0
    return nodes[some], found[some]


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles, connected triples and transitivity (null without triples)."""
    nodes, ranked = ranked_edges(edges)
    closed = corners(ranked).agg(F.coalesce((F.sum("triangles") / 3).cast("long"), F.lit(0).cast("long")).alias("n_triangles"))
    triples = nodes.agg(F.coalesce(F.sum((F.col("degree") * (F.col("degree") - 1) / 2).cast("bigint")), F.lit(0).cast("bigint")).alias("n_triples"))
    return closed.crossJoin(triples).select("n_triangles", "n_triples", round6(F.try_divide(3 * F.col("n_triangles"), "n_triples")).alias("transitivity"))


def local_clustering(edges: DataFrame) -> DataFrame:
    """Mean clustering over nodes with two neighbours or more, and over all nodes."""
    nodes, ranked = ranked_edges(edges)
    c = F.when(F.col("degree") > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1)))
    each = nodes.join(corners(ranked), "rank", "left").withColumn("c", c)
    return each.agg(F.count(F.lit(1)).alias("n"), round6(F.avg("c")).alias("mean_of_connected"), round6(F.avg(F.coalesce("c", F.lit(0.0)))).alias("mean_of_all"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information of two labels, 2 I / (H(a) + H(b))."""
    joint = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    joint = joint.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b")), "total": F.sum("n").over(Window.partitionBy())})
    p, pa, pb = F.col("n") / F.col("total"), F.col("na") / F.col("total"), F.col("nb") / F.col("total")
    sums = joint.agg(F.sum(p * F.log(p / (pa * pb))).alias("i"), (-F.sum(p * F.log(pa))).alias("ha"), (-F.sum(p * F.log(pb))).alias("hb"))
    return sums.select(round6(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("i") / (F.col("ha") + F.col("hb"))).otherwise(F.lit(0.0))).alias("nmi"))
