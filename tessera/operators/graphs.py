"""Graph views and measures that walk or compare edges: filtered graphs, paths, communities, tests by chance."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import round6
from tessera.operators.network import symmetric, without_rare_persons
from tessera.operators.numbering import number_rows
from tessera.operators.statistics import assortativity, degrees, gini, graph_summary, modularity, triangles
from tessera.session import discard, materialize, small


def filtered_graph(edges: DataFrame, mentions: DataFrame, types: list[str] | None = None, min_weight: int = 1, max_edges: int = 50_000, least_mentions: int = 1, kind: str = "PERSON") -> DataFrame:
    """The heaviest edges between entities of ``types``; rare entities of ``kind`` go after that cut."""
    kept = edges.where(F.col("weight") >= min_weight)
    if types:
        kept = kept.where(F.col("src_type").isin(types) & F.col("dst_type").isin(types))
    return without_rare_persons(kept.orderBy(F.desc("weight"), "src", "dst").limit(max_edges), mentions, least_mentions, kind)


def node_attributes(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """``nodes`` (``node``) with a map of the attributes (``node, name, value``) that are not empty."""
    named = attributes.where("value is not null and value <> ''").groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    return nodes.join(named, "node", "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def categorical_attributes(attributes: DataFrame, most: int = 50) -> DataFrame:
    """Attributes with 2 to ``most`` different values, by name."""
    n = attributes.where("value is not null").groupBy("name").agg(F.count_distinct("value").alias("n_values"))
    return n.where(F.col("n_values").between(2, most))


def degree_percentiles(edges: DataFrame) -> DataFrame:
    """The degree at place int(n * q) of the ascending list, for 0.9, 0.95 and 0.99; null for lists
    of at most 10, 20 and 100. Degrees are ordered as a histogram, not node by node."""
    h = degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)
    upto = h.withColumns({"upto": F.sum("n").over(ordered), "all": F.sum("n").over(Window.partitionBy())})
    pick = lambda q, least: F.min(F.when((F.col("all") > least) & (F.col("upto") > F.floor(F.col("all") * q)), F.col("degree")))
    return upto.agg(pick(0.9, 10).alias("p90"), pick(0.95, 20).alias("p95"), pick(0.99, 100).alias("p99"))


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """Hops from each of ``sources`` (``source``, a stated set) to every node it reaches: ``source, node, hops``.

    Each round joins the newest frontier with the edges and drops what is known, until nothing is
    new. A node behind the newest frontier lies on it or on the one before, so only these two are
    compared. With ``most``, an error is raised where a path has more hops.
    """
    both = materialize(symmetric(edges).select("node", "other"), "both-ways")
    before, front = None, materialize(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct(), "distances")
    known, hop = [front], 0
    while True:
        hop += 1
        near = front if before is None else front.unionByName(before)
        reached = front.join(both, "node").select("source", F.col("other").alias("node")).distinct().join(near.select("source", "node"), ["source", "node"], "left_anti")
        before, front = front, materialize(reached.withColumn("hops", F.lit(hop)), "distances")
        if front.isEmpty():
            break
        if most is not None and hop > most:
            raise ValueError(f"there are paths of more than {most} hops")
        known.append(front)
    folders = [f for part in known for f in part.inputFiles()]
    return edges.sparkSession.read.schema(front.schema).parquet(*folders) if folders else front


def harmonic(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Sum of 1 / hops to every other node, divided by the other nodes' number, and the mean hops."""
    n = degrees(edges).agg(F.count(F.lit(1)).alias("n"))
    far = distances(edges, sources).where("hops > 0").groupBy("source").agg(F.sum(1 / F.col("hops")).alias("near"), F.avg("hops").alias("hops"), F.count(F.lit(1)).alias("reached"))
    return far.crossJoin(F.broadcast(n)).select("source", "reached", round6(F.try_divide("near", F.col("n") - 1)).alias("harmonic"), round6(F.col("hops")).alias("mean_hops"))


def betweenness(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """Shortest-path betweenness of every node, from the paths that start at ``sources``.

    Counts of shortest paths run outward by hops, shares of paths run back. With all nodes as
    sources it is exact; else it is scaled by nodes to sources. Paths are counted in both
    directions and divided by (n - 1)(n - 2), as for a normalised undirected graph.
    """
    both = materialize(symmetric(edges).select("node", "other"), "both-ways")
    hops = materialize(distances(edges, sources, most), "path-hops")
    deepest = hops.agg(F.max("hops")).first()[0] or 0
    layer = lambda h: hops.where(F.col("hops") == h).select("source", "node")
    paths = [materialize(layer(0).withColumn("paths", F.lit(1.0)), "paths")]
    steps = []
    for h in range(1, deepest + 1):
        step = paths[-1].join(both, "node").select("source", F.col("node").alias("via"), "paths", F.col("other").alias("node")).join(layer(h), ["source", "node"])
        steps.append(materialize(step, "path-steps"))
        paths.append(materialize(steps[-1].groupBy("source", "node").agg(F.sum("paths").alias("paths")), "paths"))
    share = None
    shares_ = []
    for h in range(deepest, 0, -1):
        end = paths[h].select("source", "node", F.col("paths").alias("all_paths"))
        end = end.withColumn("share", F.lit(0.0)) if share is None else end.join(share, ["source", "node"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        back = steps[h - 1].join(end, ["source", "node"]).groupBy("source", F.col("via").alias("node")).agg(F.sum(F.col("paths") / F.col("all_paths") * (1 + F.col("share"))).alias("share"))
        share = materialize(back, "path-shares")
        shares_.append(share)
    nodes = degrees(edges).select("node", "degree")
    n = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(sources.agg(F.count_distinct("source").alias("k")))
    if not shares_:
        return nodes.select("node", "degree", F.lit(0.0).alias("betweenness"))
    every = shares_[0]
    for part in shares_[1:]:
        every = every.unionByName(part)
    summed = every.where("source <> node").groupBy("node").agg(F.sum("share").alias("share"))
    value = F.coalesce("share", F.lit(0.0)) * F.col("n") / F.col("k")
    return nodes.join(summed, "node", "left").crossJoin(F.broadcast(n)).select("node", "degree", F.coalesce(F.try_divide(value, (F.col("n") - 1) * (F.col("n") - 2)), F.lit(0.0)).alias("betweenness"))


def gatekeepers(edges: DataFrame, sources: DataFrame, limit: int = 30) -> DataFrame:
    """Nodes by betweenness over the logarithm of their degree and one."""
    found = betweenness(edges, sources).withColumn("bridge", F.col("betweenness") / F.log(F.col("degree") + 1))
    rounded = found.select("node", "degree", round6(F.col("betweenness")).alias("betweenness"), round6(F.col("bridge")).alias("bridge"))
    return rounded.orderBy(F.desc("bridge"), "node").limit(limit)


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities: every node takes the label with most weight among its neighbours, all at once.

    Ties go to the smaller label; a node's own label counts as one more neighbour of weight one, so
    that two sides of a pair do not swap for ever. ``node, label``.
    """
    both = materialize(symmetric(edges).select("node", "other", "weight"), "both-ways")
    labels = both.select("node").distinct().withColumn("label", F.col("node"))
    for turn in range(rounds):
        said = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label", "weight").unionByName(labels.select("node", "label", F.lit(1).cast("long").alias("weight")))
        votes = said.groupBy("node", "label").agg(F.sum("weight").alias("weight"))
        order = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "label"))
        before, labels = labels, materialize(votes.withColumn("nth", order).where("nth = 1").select("node", "label"), "labels")
        if turn:
            discard(before)
    return labels


def community_modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a partition (``node, label``), edges unweighted, with its number of communities."""
    ends = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").select("a", "b")
    inside = ends.where("a = b").groupBy(F.col("a").alias("label")).agg(F.count(F.lit(1)).alias("inside"))
    degree = ends.select(F.explode(F.array("a", "b")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("degree"))
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    part = degree.join(inside, "label", "left").crossJoin(F.broadcast(m))
    share = F.col("degree") / (2 * F.col("m"))
    return part.agg(F.count(F.lit(1)).alias("n_communities"), round6(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - share * share)).alias("modularity"))


def community_summaries(edges: DataFrame, labels: DataFrame, top: int = 5) -> DataFrame:
    """Per community: size, edges inside, and its ``top`` members by edges inside."""
    labels = materialize(labels.select("node", "label"), "community-labels")
    ends = edges.select("src", "dst")
    for end, side in (("src", "a"), ("dst", "b")):
        ends = ends.join(small(labels.select(F.col("node").alias(end), F.col("label").alias(side))), end)
    degree = ends.where("a = b").select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    members = labels.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranked = members.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("degree"), "node")))
    return ranked.groupBy("label").agg(
        F.count(F.lit(1)).alias("size"),
        (F.sum("degree") / 2).cast("long").alias("internal_edges"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= top, F.struct("nth", "node")))), lambda x: x["node"]), ",").alias("top_members"),
    )


def community_composition(labels: DataFrame, attributes: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` values of an attribute (``node, value``) in each community (``node, label``): ``label, value, n, rank``.

    Empty values do not count; equally common values are ranked by name.
    """
    held = labels.join(attributes.where("value is not null and value <> ''"), "node").groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "value"))
    return held.withColumn("rank", rank).where(F.col("rank") <= top)


def permutation_test(edges: DataFrame, rounds: int = 20, seed: str = "p") -> DataFrame:
    """Assortativity by type against ``rounds`` shuffles of the types over the nodes.

    A round orders nodes by a hash of round and name and deals the types of the nodes in order of
    name in that order, so reruns agree. Returns the observed coefficient, the shuffles' mean and
    deviation, the z score and the share of shuffles at least as far from zero.
    """
    nodes = degrees(edges).select("node", "node_type")
    by_name = number_rows(nodes, "node", name="place").select("place", F.col("node_type").alias("dealt"))
    dealt = nodes.select(F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), "node")
    order = F.md5(F.concat(F.lit(seed), F.col("round").cast("string"), F.lit(":"), F.col("node")).cast("binary"))
    # Every round deals all nodes, so numbers over all rounds give the place in each.
    numbered = number_rows(dealt.withColumn("order", order), "round", "order", "node")
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    placed = numbered.crossJoin(F.broadcast(n)).select("round", "node", (F.col("no") % F.col("n")).alias("place"))
    # A node has its types of all rounds in one row, so that edges meet nodes once and not once a round.
    dealt = placed.join(by_name, "place").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("round", "dealt"))).alias("dealt"))
    dealt = materialize(dealt, "dealt-types")
    ends = edges.select("src", "dst")
    for end, side in (("src", "a"), ("dst", "b")):
        ends = ends.join(small(dealt.select(F.col("node").alias(end), F.col("dealt").alias(side)), rounds), end)
    met = ends.select(F.explode(F.arrays_zip("a", "b")).alias("x")).groupBy(F.col("x.a.round").alias("round"), F.col("x.a.dealt").alias("a"), F.col("x.b.dealt").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sides = met.select("round", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "n").groupBy("round", "x.a", "x.b").agg(F.sum("n").alias("n"))
    by_end = sides.groupBy("round", "a").agg(F.sum("n").alias("end")).groupBy("round").agg(F.sum(F.col("end").cast("double") * F.col("end")).alias("square"))
    same = sides.groupBy("round").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"), F.sum("n").alias("total")).join(by_end, "round")
    chance = F.col("square") / (F.col("total").cast("double") * F.col("total"))
    each = same.select(F.try_divide(F.col("same") / F.col("total") - chance, 1 - chance).alias("x")).crossJoin(F.broadcast(assortativity(edges)))
    return each.agg(
        F.first("coefficient").alias("observed"), round6(F.avg("x")).alias("mean"), round6(F.stddev_samp("x")).alias("deviation"),
        round6(F.try_divide(F.first("coefficient") - F.avg("x"), F.stddev_samp("x"))).alias("z"),
        round6(F.avg((F.abs("x") >= F.abs("coefficient")).cast("double"))).alias("p"),
    )


def network_statistics(edges: DataFrame, least_nodes: int = 10, most_types: int = 25) -> DataFrame:
    """All closed-form statistics as rows ``metric, value, status``.

    ``status`` is ``ok``, ``too_small`` (fewer nodes than ``least_nodes``) or, for measures by type,
    ``no_categories`` outside 2 to ``most_types`` types; then ``value`` is null. A graph without
    edges gives rows, not an error.
    """
    d = degrees(edges)
    size = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_type").alias("types"))
    of = lambda df, column, name, by_type=False: df.select(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"), F.lit(by_type).alias("by_type"))
    summary = graph_summary(edges)
    rows = of(summary, "n_nodes", "nodes").unionByName(of(summary, "n_edges", "edges")).unionByName(of(summary, "density", "density")).unionByName(of(summary, "n_components", "components")).unionByName(of(summary, "largest", "largest"))
    rows = rows.unionByName(of(gini(edges), "gini", "gini")).unionByName(of(triangles(edges), "transitivity", "transitivity"))
    rows = rows.unionByName(of(assortativity(edges), "coefficient", "assortativity", True)).unionByName(of(modularity(edges), "modularity", "modularity", True))
    status = F.when(F.col("n") < least_nodes, "too_small").when(F.col("by_type") & ~F.col("types").between(2, most_types), "no_categories").otherwise("ok")
    done = rows.crossJoin(F.broadcast(size)).withColumn("status", status)
    return done.select("metric", F.when(F.col("status") == "ok", F.col("value")).alias("value"), "status")


def matching(field: Column, term: str) -> Column:
    """Whether a name matches a pattern, whatever its case.

    Nothing matches a pattern of under two characters, nor one that is no pattern.
    """
    if len(term) < 2:
        return F.lit(False)
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile("(?i)" + term)
    except IllegalArgumentException:
        return F.lit(False)
    return F.coalesce(field.rlike("(?i)" + term), F.lit(False))
