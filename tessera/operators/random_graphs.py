"""Comparison of a network with random graphs of the same degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import round6
from tessera.operators.graphs import distances, label_propagation
from tessera.operators.network import symmetric
from tessera.operators.numbering import number_rows
from tessera.operators.statistics import corners, degrees, ranked_edges
from tessera.session import materialize


def configuration_graphs(edges: DataFrame, replicates: int, seed: str = "s") -> DataFrame:
    """``replicates`` graphs with the degrees of ``edges`` by stub matching: ``replicate, src, dst``.

    Every node has as many stubs as neighbours. A replicate orders all stubs by a hash and joins
    the first with the second, the third with the fourth and so on; loops are dropped and repeated
    edges count once. Stubs are numbered by range partitions, as all replicates have the same even
    number of them. Reruns agree; a graph without edges gives no rows.
    """
    stubs = degrees(edges.withColumn("weight", F.lit(1))).groupBy("node").agg(F.sum("degree").alias("degree")).select("node", F.explode(F.sequence(F.lit(1).cast("long"), F.col("degree"))).alias("stub"))
    dealt = stubs.select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), "node", "stub")
    order = F.md5(F.concat_ws(":", F.lit(seed), "replicate", "node", "stub").cast("binary"))
    numbered = number_rows(dealt.withColumn("order", order), "replicate", "order", "node", "stub")
    pairs = numbered.groupBy("replicate", F.shiftright("no", 1).alias("pair")).agg(F.min("node").alias("src"), F.max("node").alias("dst"))
    return pairs.where("src < dst").select("replicate", "src", "dst").distinct()


def replicate_metrics(graphs: DataFrame, nodes: DataFrame, sources: DataFrame, rounds: int = 3) -> DataFrame:
    """Measures of each graph of ``replicate, src, dst`` over the same ``nodes`` (``node``): ``replicate, metric, value``.

    ``clustering`` is the mean over all nodes, 0 where there are no two neighbours; ``modularity``
    is that of the communities by label propagation; ``path_length`` the mean hops from
    ``sources`` (``source``, a stated set) to the nodes that they reach. All graphs are measured
    at once, as parts of one graph whose nodes are named by replicate.
    """
    key = lambda c: F.concat(F.col("replicate").cast("string"), F.lit("|"), F.col(c))
    union = materialize(graphs.select(key("src").alias("src"), key("dst").alias("dst"), F.lit("N").alias("src_type"), F.lit("N").alias("dst_type"), F.lit(1).cast("long").alias("weight")), "replicates")
    part = lambda c: F.split_part(c, F.lit("|"), F.lit(1)).cast("int").alias("replicate")

    ranks, ranked = ranked_edges(union)
    local = ranks.join(corners(ranked), "rank").select(part(F.col("node")), (2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).alias("c"))
    summed = graphs.select("replicate").distinct().join(local.groupBy("replicate").agg(F.sum("c").alias("c")), "replicate", "left")
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    clustering = summed.crossJoin(F.broadcast(n)).select("replicate", F.lit("clustering").alias("metric"), (F.coalesce("c", F.lit(0.0)) / F.col("n")).alias("value"))

    labels = label_propagation(union, rounds)
    ends = union.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").select("a", "b")
    inside = ends.where("a = b").groupBy(F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("inside"))
    shares = ends.select(F.explode(F.array("a", "b")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("degree")).join(inside, "label", "left").select(part(F.col("label")), "inside", "degree")
    sizes = graphs.groupBy("replicate").agg(F.count(F.lit(1)).alias("m"))
    share = F.col("degree") / (2 * F.col("m"))
    modularity = shares.join(F.broadcast(sizes), "replicate").groupBy("replicate").agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - share * share).alias("value")).select("replicate", F.lit("modularity").alias("metric"), "value")

    starts = graphs.select("replicate").distinct().crossJoin(F.broadcast(sources.select(F.col("source").alias("at")))).select(key("at").alias("source"))
    hops = distances(union, starts).where("hops > 0").select(part(F.col("source")), "hops").groupBy("replicate").agg(F.avg("hops").alias("value")).select("replicate", F.lit("path_length").alias("metric"), "value")
    return clustering.unionByName(modularity).unionByName(hops)


def compare_to_random(edges: DataFrame, replicates: int = 20, sources: int = 8, seed: str = "s", least: int = 20) -> DataFrame:
    """Clustering, modularity and path length against random graphs of the same degrees.

    Per metric: ``observed``, the replicates' ``null_mean`` and ``null_std``, ``z``, whether it is
    ``significant`` (beyond 1.96), its ``direction`` and the number of replicates. Paths start at
    ``sources`` nodes, the first by a hash of their names. A network of under ``least`` nodes or
    edges gives no rows.
    """
    plain = materialize(symmetric(edges).where("node < other").select(F.lit(0).alias("replicate"), F.col("node").alias("src"), F.col("other").alias("dst")).distinct(), "observed")
    nodes = materialize(plain.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "observed-nodes")
    typed = plain.select("src", "dst", F.lit("N").alias("src_type"), F.lit("N").alias("dst_type"))
    chosen = nodes.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "node").cast("binary")), "node").limit(sources).select(F.col("node").alias("source"))
    chosen = materialize(chosen, "observed-sources")
    graphs = materialize(plain.unionByName(configuration_graphs(typed, replicates, seed)), "random-graphs")
    values = replicate_metrics(graphs, nodes, chosen)
    seen = F.max(F.when(F.col("replicate") == 0, F.col("value")))
    null = F.when(F.col("replicate") > 0, F.col("value"))
    by = values.groupBy("metric").agg(seen.alias("seen"), F.avg(null).alias("mean"), F.stddev_samp(null).alias("std"), F.count(null).alias("n_simulations"))
    z = F.try_divide(F.col("seen") - F.col("mean"), F.greatest("std", F.lit(1e-10)))
    size = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(plain.agg(F.count(F.lit(1)).alias("m")))
    return by.crossJoin(F.broadcast(size)).where((F.col("n") >= least) & (F.col("m") >= least)).select(
        "metric", round6(F.col("seen")).alias("observed"), round6(F.col("mean")).alias("null_mean"), round6(F.col("std")).alias("null_std"), round6(z).alias("z"),
        (F.abs(z) > 1.96).alias("significant"), F.when(z > 0, "higher").otherwise("lower").alias("direction"), "n_simulations",
    )
