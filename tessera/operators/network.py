"""Co-occurrence networks: edges, views and related documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import round6
from tessera.session import MOST_BROADCAST, discard, enough_partitions, materialize, small

#: As many edges are sent to every executor at once when their documents are listed.
EDGES_A_BLOCK = MOST_BROADCAST


def numbered_mentions(mentions: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Mentions as ``doc, no`` in stretches of neighbouring documents, ``names`` (``no, ent, type``) and the number of stretches.

    Entities are numbered in order of their names. Null documents and entities meet nothing and are left out.
    """
    kept = mentions.where("doc is not null and ent is not null and type is not null").select("doc", "ent", "type")
    names = kept.select("ent", "type").distinct().repartitionByRange("ent", "type").sortWithinPartitions("ent", "type")
    names = materialize(names.withColumn("no", F.monotonically_increasing_id()), "entities")
    numbered = materialize(kept.join(small(names), ["ent", "type"]).select("doc", "no"), "mention-numbers")
    n = enough_partitions(mentions.sparkSession, 2 * numbered.count())
    return numbered.repartitionByRange(n, "doc"), names, n


def numbers_of_documents(numbered: DataFrame) -> DataFrame:
    """The numbers that a document mentions, in order, where they are two or more: ``doc, all``."""
    return numbered.groupBy("doc").agg(F.sort_array(F.collect_list("no")).alias("all")).where(F.size("all") > 1)


def pairs_of_numbers(held: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Each pair ``a < b`` of a document's numbers, with ``doc``; with ``low`` and ``high`` those whose ``a`` lies from the one to the other."""
    first = held.select("doc", "all", F.posexplode("all").alias("at", "a"))
    first = first if low is None else first.where(F.col("a").between(low, high))
    return first.select("doc", "a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b")).where("a < b")


def pairs_of_entities(numbered: DataFrame) -> DataFrame:
    """Each pair ``a < b`` of the numbers that a document mentions, with ``doc``.

    Documents near each other often share entities: pairs are made in stretches of documents, so
    that counts of them shrink before they are exchanged.
    """
    return pairs_of_numbers(numbers_of_documents(numbered))


def with_ends(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with names and types of both ends; two types of one entity are no pair."""
    for n, e in (("a", "src"), ("b", "dst")):
        pairs = pairs.join(small(names.select(F.col("no").alias(n), F.col("ent").alias(e), F.col("type").alias(f"{e}_type"))), n)
    return pairs.where("src < dst")


def cooccurrence_edges(mentions: DataFrame, min_weight: int = 2, max_mentions: int | None = None) -> DataFrame:
    """Undirected edges ``src`` < ``dst`` with types and ``weight``, the documents they share.

    Entities with over ``max_mentions`` documents, and documents with a single entity, make no
    pairs; both are dropped before entities meet.
    """
    kept = mentions
    if max_mentions is not None:
        few = mentions.groupBy("ent").count().where(F.col("count") <= max_mentions).select("ent")
        kept = kept.join(few, "ent", "left_semi")
    # Entities meet as numbers in order of their names; names and types are joined to the edges.
    numbered, names, n = numbered_mentions(kept)
    counted = pairs_of_entities(numbered).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)
    return with_ends(materialize(counted, "entity-pairs", n), names).select("src", "dst", "src_type", "dst_type", "weight")


def _numbers_of_edges(mentions: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Numbers by document of the entities of ``edges``, the edges as pairs of them, names, and a number of partitions."""
    ends = materialize(edges.select(F.explode(F.array("src", "dst")).alias("ent")).distinct(), "edge-ends")
    kept = mentions.join(small(ends), "ent", "left_semi").select("doc", "ent", F.lit("").alias("type"))
    numbered, names, n = numbered_mentions(kept)
    wanted = edges.select("src", "dst").distinct()
    for no, e in (("a", "src"), ("b", "dst")):
        wanted = wanted.join(small(names.select(F.col("no").alias(no), F.col("ent").alias(e))), e)
    wanted = materialize(wanted.select("a", "b"), "edge-pairs")
    # An entity may be mentioned under two types.
    return numbered.distinct(), wanted, names, n


def _blocks(wanted: DataFrame) -> list[tuple]:
    """The pairs ``wanted`` in blocks of neighbours, each with its least and its largest ``a``; a single block has no bounds."""
    k = -(-wanted.count() // EDGES_A_BLOCK)
    if k <= 1:
        return [(wanted, None, None)]
    dealt = materialize(wanted.repartitionByRange(k, "a", "b").withColumn("block", F.spark_partition_id()), "edge-blocks")
    ends = dealt.groupBy("block").agg(F.min("a").alias("low"), F.max("a").alias("high")).collect()
    return [(dealt.where(F.col("block") == r.block), r.low, r.high) for r in ends]


def edge_documents(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """The documents behind each edge (``src`` < ``dst``), one row each: ``src, dst, doc``.

    Entities meet within documents, so no entity's documents meet all of its edges. These pairs
    are not exchanged: the edges are sent to them, one block after another.
    """
    numbered, wanted, names, n = _numbers_of_edges(mentions, edges)
    held = materialize(numbers_of_documents(numbered), "document-numbers", n)
    discard(numbered)
    met = None
    for block, low, high in _blocks(wanted):
        part = materialize(pairs_of_numbers(held, low, high).join(F.broadcast(block), ["a", "b"], "left_semi"), "edge-documents")
        met = part if met is None else met.union(part)
    discard(held)
    return with_ends(met, names).select("src", "dst", "doc")


def edge_spans(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """How many documents are behind each edge, the first and the last: ``src, dst, n_docs, first_doc, last_doc``.

    The same as counting :func:`edge_documents`, counted before pairs are exchanged.
    """
    numbered, wanted, names, n = _numbers_of_edges(mentions, edges)
    counted = pairs_of_entities(numbered).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    met = materialize(counted.join(small(wanted), ["a", "b"], "left_semi"), "edge-spans", n)
    return with_ends(met, names).select("src", "dst", "n_docs", "first_doc", "last_doc")


def build_counters(mentions: DataFrame, min_weight: int = 2) -> DataFrame:
    """What building a network counts: documents processed and skipped (with one entity), pairs, edges kept and below the weight."""
    sizes = mentions.groupBy("doc").agg(F.count_distinct("ent").alias("n"))
    docs = sizes.agg(F.count_if(F.col("n") >= 2).alias("processed"), F.count_if(F.col("n") < 2).alias("skipped"), F.coalesce(F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)), F.lit(0)).cast("long").alias("pairs"))
    weights = cooccurrence_edges(mentions, 1).agg(F.count_if(F.col("weight") >= min_weight).alias("written"), F.count_if(F.col("weight") < min_weight).alias("below"))
    return docs.crossJoin(weights)


def type_pair_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_type", "dst_type").agg(F.count(F.lit(1)).alias("n_edges"), round6(F.avg("weight")).alias("avg_weight"), F.max("weight").alias("max_weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: ``node``, ``other`` and their types."""
    one = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.col("src_type").alias("node_type"), F.col("dst_type").alias("other_type"), "weight")
    two = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.col("dst_type").alias("node_type"), F.col("src_type").alias("other_type"), "weight")
    return one.union(two)


def neighbours_of(mentions: DataFrame, nodes: DataFrame, min_weight: int = 2) -> DataFrame:
    """Edges of the entities in ``nodes`` (column ``node``), from the documents that mention them alone."""
    own = mentions.join(nodes.select("node").distinct(), F.col("ent") == F.col("node"), "left_semi").select("doc", F.col("ent").alias("node"), F.col("type").alias("node_type"))
    met = own.join(mentions.select("doc", F.col("ent").alias("other"), F.col("type").alias("other_type")), "doc").where("node <> other")
    return met.groupBy("node", "node_type", "other", "other_type").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)


def ego_network(mentions: DataFrame, node: str, limit: int = 50, min_weight: int = 2, types: list[str] | None = None, docs: DataFrame | None = None) -> DataFrame:
    """The strongest neighbours of a node, with the number of all of them and the weight shown.

    ``types`` keeps neighbours of these types; ``docs`` (column ``doc``) counts only these
    documents. ``degree`` counts all that match, ``weighted_degree`` sums the rows returned.
    """
    kept = mentions if docs is None else mentions.join(docs.select("doc").distinct(), "doc", "left_semi")
    near = neighbours_of(kept, mentions.sparkSession.range(1).select(F.lit(node).alias("node")), min_weight)
    near = near if types is None else near.where(F.col("other_type").isin(types))
    degree = near.agg(F.count(F.lit(1)).alias("degree"))
    top = near.orderBy(F.desc("weight"), "other").limit(limit)
    shown = top.withColumn("weighted_degree", F.sum("weight").over(Window.partitionBy()))
    return shown.crossJoin(F.broadcast(degree)).select("other", "other_type", "weight", "degree", "weighted_degree")


def without_rare_persons(edges: DataFrame, mentions: DataFrame, least: int, kind: str = "PERSON") -> DataFrame:
    """Edges without those that end in an entity of type ``kind`` with under ``least`` documents.

    A threshold of one or less keeps all. Entities without mentions count as zero.
    """
    if least <= 1:
        return edges
    often = mentions.where(F.col("type") == kind).groupBy(F.col("ent").alias("often")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("often")
    for end in ("src", "dst"):
        named = edges.join(often, edges[end] == F.col("often"), "left").where((F.col(f"{end}_type") != kind) | F.col("often").isNotNull())
        edges = named.drop("often")
    return edges


def edges_in_documents(mentions: DataFrame, docs: DataFrame, min_weight: int = 1) -> DataFrame:
    """Edges counted over the documents in ``docs`` (column ``doc``), such as those with a term."""
    return cooccurrence_edges(mentions.join(docs.select("doc").distinct(), "doc", "left_semi"), min_weight)


def with_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends' names from ``names`` (``ent``, ``name``), Unknown where there is none."""
    for end in ("src", "dst"):
        edges = edges.join(names.select(F.col("ent").alias(end), F.col("name").alias(f"{end}_name")), end, "left")
    return edges.withColumns({f"{end}_name": F.coalesce(f"{end}_name", F.lit("Unknown")) for end in ("src", "dst")})


#: How edges are ranked in the viewer: most cross-type first, strong for a rare pair of types,
#: rare pairs of types, or by weight alone.
RANK_MODES = ("most_cross_type", "rare_but_strong", "low_frequency_pairs", "weight")


def ranked_edges(edges: DataFrame, mode: str = "weight") -> DataFrame:
    """Edges with ``rank`` from 1 in one of the :data:`RANK_MODES`, ties by types and names.

    ``pair_count`` is the number of edges between the two types. The edges are a bounded view.
    """
    counted = edges.withColumn("pair_count", F.count(F.lit(1)).over(Window.partitionBy("src_type", "dst_type")))
    heavy, rare = F.desc("weight"), F.col("pair_count")
    keys = {
        "most_cross_type": [F.col("src_type") == F.col("dst_type"), heavy, rare],
        "rare_but_strong": [F.desc(F.col("weight") / rare), heavy, rare],
        "low_frequency_pairs": [rare, heavy],
        "weight": [heavy, rare],
    }[mode]
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(*keys, "src_type", "dst_type", "src", "dst")))


def global_network(edges: DataFrame, types: list[str], min_weight: int = 3, limit: int = 500, strict: bool = True) -> DataFrame:
    a, b = F.col("src_type").isin(types), F.col("dst_type").isin(types)
    return edges.where((a & b if strict else a | b) & (F.col("weight") >= min_weight)).orderBy(F.desc("weight"), "src", "dst").limit(limit)


def global_network_page(edges: DataFrame, mentions: DataFrame, types: list[str], min_weight: int = 3, limit: int = 500, strict: bool = True, least_mentions: int = 1, kind: str = "PERSON", docs: DataFrame | None = None) -> DataFrame:
    """The heaviest edges as served: cut at ``limit`` first, then without rare entities of ``kind`` and, with ``docs``
    (column ``doc``), without edges between entities that these documents do not mention. ``total`` counts all edges before the cut."""
    a, b = F.col("src_type").isin(types), F.col("dst_type").isin(types)
    fit = edges.where((a & b if strict else a | b) & (F.col("weight") >= min_weight))
    total = fit.agg(F.count(F.lit(1)).alias("total"))
    shown = without_rare_persons(fit.orderBy(F.desc("weight"), "src", "dst").limit(limit), mentions, least_mentions, kind)
    if docs is not None:
        inside = mentions.join(docs.select("doc").distinct(), "doc", "left_semi").select("ent").distinct()
        for end in ("src", "dst"):
            shown = shown.join(inside.withColumnRenamed("ent", end), end, "left_semi")
    return shown.select("src", "dst", "src_type", "dst_type", "weight").crossJoin(F.broadcast(total))


def document_network(mentions: DataFrame, doc: int, min_weight: int = 2) -> DataFrame:
    """Edges between the entities of one document, weighed over all documents."""
    inside = mentions.where(F.col("doc") == doc).select("ent").distinct()
    return cooccurrence_edges(mentions.join(inside, "ent", "left_semi"), min_weight)


def entity_metrics(edges: DataFrame) -> DataFrame:
    """Degree, weighted degree and strongest neighbour of every node; of equals the one with the last name."""
    both = symmetric(edges)
    summed = materialize(both.groupBy("node", "node_type").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"), F.max("weight").alias("max_weight")), "entity-metrics")
    # Names are compared only among the heaviest edges: Spark sorts what it takes the largest name of.
    top = small(summed.select(F.col("node").alias("n"), F.col("node_type").alias("t"), F.col("max_weight").alias("w")))
    own = lambda rows: rows.node.eqNullSafe(F.col("n")) & rows.node_type.eqNullSafe(F.col("t"))
    best = both.join(top, own(both) & (both.weight == F.col("w"))).groupBy("n", "t").agg(F.max("other").alias("strongest"))
    return summed.join(best, own(summed)).drop("n", "t")


def related_documents(mentions: DataFrame, doc: int, limit: int = 10, max_neighbours: int = 100, folders: DataFrame | None = None) -> DataFrame:
    """Documents with entities that neighbour those of ``doc``, by shared and neighbouring entities.

    With ``folders`` (``doc, folder``) documents of the same folder as ``doc`` are left out; those
    without a folder stay.
    """
    own = mentions.where(F.col("doc") == doc).select("ent").distinct()
    near = neighbours_of(mentions, own.withColumnRenamed("ent", "node")).groupBy(F.col("other").alias("ent")).agg(F.max("weight").alias("w"))
    near = near.join(own, "ent", "left_anti").orderBy(F.desc("w"), "ent").limit(max_neighbours)
    marked = own.select("ent", F.lit(1).alias("shared"), F.lit(0).alias("network")).union(near.select("ent", F.lit(0), F.lit(1)))
    found = mentions.where(F.col("doc") != doc).join(marked, "ent").groupBy("doc").agg(F.sum("shared").alias("shared"), F.sum("network").alias("network"))
    if folders is not None:
        own_folder = folders.where((F.col("doc") == doc) & F.col("folder").isNotNull()).select("folder")
        found = found.join(folders.join(own_folder, "folder", "left_semi").select("doc"), "doc", "left_anti")
    return found.orderBy(F.desc("shared"), F.desc("network"), "doc").limit(limit)


def shared_entities(mentions: DataFrame, doc: int, least: int = 1) -> DataFrame:
    """Documents that share at least ``least`` entities with ``doc``, and which."""
    own = mentions.where(F.col("doc") == doc).select("ent").distinct()
    met = mentions.where(F.col("doc") != doc).join(own, "ent", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_set("ent")).alias("all"))
    return met.where(F.size("all") >= least).select("doc", F.array_join("all", ",").alias("shared"))


def viewer_documents(edges: DataFrame, mentions: DataFrame, preset: str = "cross_type_only", limit: int = 200, min_weight: int = 3) -> DataFrame:
    """Documents behind the strongest edges: score (sum of weights), edges and entities of each."""
    test = {"cross_type_only": "src_type <> dst_type", "within_type": "src_type = dst_type", "all_pairs": "true"}[preset]
    top = edges.where(test).where(F.col("weight") >= min_weight).orderBy(F.desc("weight"), "src", "dst").limit(limit)
    top = materialize(top, "viewer-edges")
    hit = materialize(edge_documents(mentions, top).join(F.broadcast(top), ["src", "dst"]), "viewer-documents")
    ends = F.explode(F.array("src", "dst")).alias("ent")
    entities = hit.select("doc", ends).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_entities"))
    return hit.groupBy("doc").agg(F.sum("weight").alias("score"), F.count(F.lit(1)).alias("n_edges")).join(entities, "doc")


def ranked_viewer_documents(edges: DataFrame, mentions: DataFrame, preset: str = "cross_type_only", limit: int = 200, min_weight: int = 3, docs_per_edge: int = 50, most: int = 2000) -> DataFrame:
    """The documents that a viewer shows, in its order: score, edges and entities of each, and ``place``.

    Edges are taken from the heaviest on, each with its first ``docs_per_edge`` documents; the first
    ``most`` documents so met are shown, by entities, then score, then edges, then number.
    """
    test = {"cross_type_only": "src_type <> dst_type", "within_type": "src_type = dst_type", "all_pairs": "true"}[preset]
    top = edges.where(test).where(F.col("weight") >= min_weight).orderBy(F.desc("weight"), "src", "dst").limit(limit)
    top = top.withColumn("edge", F.row_number().over(Window.orderBy(F.desc("weight"), "src", "dst")))
    top = materialize(top, "viewer-edges")
    hit = edge_documents(mentions, top).join(F.broadcast(top), ["src", "dst"])
    nth = F.row_number().over(Window.partitionBy("edge").orderBy("doc"))
    hit = materialize(hit.withColumn("nth", nth).where(F.col("nth") <= docs_per_edge), "viewer-documents")
    met = hit.groupBy("doc").agg(F.min(F.struct("edge", "nth")).alias("met"), F.sum("weight").alias("score"), F.count(F.lit(1)).alias("n_edges"))
    shown = met.orderBy("met").limit(most)
    ends = F.explode(F.array("src", "dst")).alias("ent")
    entities = hit.select("doc", ends).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_entities"))
    place = F.row_number().over(Window.orderBy(F.desc("n_entities"), F.desc("score"), F.desc("n_edges"), "doc"))
    return shown.join(entities, "doc").select("doc", "score", "n_edges", "n_entities").withColumn("place", place)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
