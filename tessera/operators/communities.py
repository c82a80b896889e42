"""Communities by modularity: nodes move to the neighbouring community that gains most, then the graph is contracted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import round6
from tessera.operators.network import symmetric
from tessera.operators.numbering import number_rows
from tessera.session import discard, materialize


def numbered_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A weighted graph as numbers: names (``node, u``), both ways of each edge (``u, v, w``), and
    nodes (``u, k, loop``) with their weighted degree and the weight inside them."""
    both = symmetric(edges).where("node is not null and other is not null and node <> other").select("node", "other", "weight")
    names = materialize(number_rows(both.select("node").distinct(), "node", name="u"), "graph-names")
    adjacent = both.join(names, "node").join(names.select(F.col("node").alias("other"), F.col("u").alias("v")), "other").groupBy("u", "v").agg(F.sum("weight").alias("w"))
    adjacent = materialize(adjacent, "graph-edges")
    nodes = materialize(adjacent.groupBy("u").agg(F.sum("w").alias("k")).withColumn("loop", F.lit(0).cast("long")), "graph-nodes")
    return names, adjacent, nodes


def community_votes(adjacent: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The weight between each node and each community next to it: ``u, k, a, c, w``, ``a`` its own
    community, which always has a row."""
    met = adjacent.join(labels.select(F.col("u").alias("v"), "c"), "v").select("u", "c", "w")
    voted = met.unionByName(labels.select("u", "c", F.lit(0).cast("long").alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
    return voted.join(labels.withColumnRenamed("c", "a").join(nodes.select("u", "k"), "u"), "u")


def modularity_gains(votes: DataFrame, total: float) -> DataFrame:
    """Each node's move that raises modularity most, if there is one: ``u, a, c, gain, swap``.

    ``a`` is the community left and ``c`` the one joined, the smaller of equals. ``swap`` marks a
    node on its own that joins another single node of a larger label, which may join it instead.
    """
    size = votes.where("a = c").groupBy("c").agg(F.sum("k").alias("inside"), F.count(F.lit(1)).alias("members"))
    each = votes.join(size, "c")
    # Twice the total times the gain of joining, over what leaving costs alike for all.
    value = F.lit(total) * F.col("w") - F.col("k").cast("double") * (F.col("inside") - F.when(F.col("a") == F.col("c"), F.col("k")).otherwise(0))
    each = each.withColumn("value", value)
    best = each.groupBy("u", "a").agg(F.max(F.struct("value", (-F.col("c")).alias("c"), "members")).alias("best"), F.max(F.when(F.col("a") == F.col("c"), F.struct("value", "members"))).alias("stay"))
    moved = best.where("best.value > stay.value")
    gain = 2 * (F.col("best.value") - F.col("stay.value")) / (total * total)
    swap = (F.col("stay.members") == 1) & (F.col("best.members") == 1) & (-F.col("best.c") > F.col("a"))
    return moved.select("u", "a", (-F.col("best.c")).alias("c"), gain.alias("gain"), swap.alias("swap"))


def _independent(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch one community: together they gain what each does alone."""
    order = F.struct("gain", (-F.col("u")).alias("u"))
    first = moves.select(F.explode(F.array_distinct(F.array("a", "c"))).alias("x"), order.alias("order")).groupBy("x").agg(F.max("order").alias("order"))
    won = first.select((-F.col("order.u")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return moves.join(won.select("u"), "u", "left_semi")


def _moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return materialize(labels.join(moves.select("u", F.col("c").alias("to")), "u", "left").select("u", F.coalesce("to", "c").alias("c")), "community-labels")


def _quality(votes: DataFrame, loops: int, total: float) -> float:
    own = votes.where("a = c").groupBy("c").agg(F.sum("k").alias("k"), F.sum("w").alias("w"))
    inside, squares = own.agg(F.sum("w"), F.sum(F.col("k").cast("double") * F.col("k"))).first()
    return (inside + loops) / total - squares / (total * total)


def _best_share(moves: DataFrame, share: float) -> DataFrame:
    """Of the moves between two communities the ``share`` that gain most, at least one."""
    bar = moves.groupBy("a", "c").agg(F.percentile_approx("gain", F.lit(1 - share), F.lit(1000)).alias("bar"))
    return moves.join(bar, ["a", "c"]).where("gain >= bar").drop("bar")


def local_moves(adjacent: DataFrame, nodes: DataFrame, labels: DataFrame, total: float, least: float = 1e-7) -> tuple[DataFrame, float]:
    """``labels`` after rounds of moves, and their modularity; no round lowers it.

    In a round, of the nodes that gain by moving from one community to another the share with the
    largest gains moves, all at once. Where moves made together lower modularity, the round is
    undone and a smaller share moves; at last only moves that do not touch each other, which gain
    for sure. Rounds end when no node gains by a move, or a round gains under ``least``.
    """
    loops = nodes.agg(F.sum("loop")).first()[0] or 0
    best, before, share = None, None, 0.5
    while True:
        votes = materialize(community_votes(adjacent, nodes, labels), "community-votes")
        quality = _quality(votes, loops, total)
        if before is not None and quality <= best:
            discard(votes)
            share /= 4
            if share >= 1 / 256:
                labels = _moved(before[0], _best_share(before[1], share))
            else:
                labels, before = _moved(before[0], _independent(before[1])), None
            continue
        if before is not None and quality - best < least:
            return labels, quality
        best = quality if best is None else max(best, quality)
        wanted = materialize(modularity_gains(votes, total), "community-moves")
        discard(votes)
        n, plain = wanted.agg(F.count(F.lit(1)), F.count_if(~F.col("swap"))).first()
        if not n:
            return labels, quality
        share = min(0.5, 2 * max(share, 1 / 256))
        before = labels, materialize(wanted.where(~F.col("swap")), "community-moves") if plain else wanted
        labels = _moved(labels, _best_share(before[1], share))


def _contracted(adjacent: DataFrame, nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose nodes are the communities."""
    ends = adjacent.join(labels.select("u", F.col("c").alias("a")), "u").join(labels.select(F.col("u").alias("v"), F.col("c").alias("b")), "v")
    between = materialize(ends.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), "graph-edges")
    inside = between.where("u = v").select("u", F.col("w").alias("within"))
    merged = nodes.join(labels, "u").groupBy(F.col("c").alias("u")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
    merged = merged.join(inside, "u", "left").select("u", "k", (F.col("loop") + F.coalesce("within", F.lit(0))).alias("loop"))
    return materialize(between.where("u <> v"), "graph-edges"), materialize(merged, "graph-nodes")


def communities(edges: DataFrame, least: float = 1e-7) -> DataFrame:
    """Communities of a weighted graph by modularity: ``node, label``, the label its smallest node's name.

    Moves of single nodes and contraction alternate until a contracted graph has nothing left to
    merge; then single nodes move once more, from what was found, and all is repeated until that
    changes nothing. Everything is a join or an aggregate over edges or nodes, each step is
    written to shared storage, and only sums reach the driver. Nodes are numbered by name and ties
    go to the smaller number, so reruns agree. Null ends and loops are ignored; a graph without
    edges has no rows.
    """
    names, adjacent, nodes = numbered_graph(edges)
    total = nodes.agg(F.sum("k")).first()[0]
    if not total:
        return names.select("node", F.col("node").alias("label"))
    found, reached = nodes.select("u", F.col("u").alias("c")), None
    while True:
        found, quality = local_moves(adjacent, nodes, found, float(total), least)
        if reached is not None and quality - reached <= least:
            break
        reached = quality
        level, size = (adjacent, nodes, found), nodes.count()
        while True:
            small, merged = _contracted(*level)
            fewer = merged.count()
            if fewer == size:
                break
            size = fewer
            labels, reached = local_moves(small, merged, merged.select("u", F.col("u").alias("c")), float(total), least)
            found = materialize(found.withColumnRenamed("c", "s").join(labels.select(F.col("u").alias("s"), "c"), "s").select("u", "c"), "community-labels")
            level = small, merged, labels
    named = found.join(names, "u").select("node", "c")
    return named.join(named.groupBy("c").agg(F.min("node").alias("label")), "c").select("node", "label")


def improving_moves(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Single moves by which nodes would raise the modularity of a partition (``node, label``):
    ``node``, the label left, the label joined and the gain. A node without a label is on its own."""
    names, adjacent, nodes = numbered_graph(edges)
    total = float(nodes.agg(F.sum("k")).first()[0] or 0)
    known = names.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    start = materialize(known.join(known.groupBy("label").agg(F.min("u").alias("c")), "label").select("u", "c", "label"), "community-labels")
    moves = modularity_gains(community_votes(adjacent, nodes, start.select("u", "c")), total or 1.0)
    # A label is named by its smallest node's number, so numbers lead back to labels.
    label = start.select("c", "label").distinct()
    named = moves.join(names, "u").join(label.select(F.col("c").alias("a"), F.col("label").alias("left")), "a").join(label.select("c", F.col("label").alias("joined")), "c")
    return named.select("node", F.col("left").alias("from_label"), F.col("joined").alias("to_label"), round6(F.col("gain")).alias("gain"))
