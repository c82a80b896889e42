import random
from collections import Counter
from itertools import combinations

import pytest

from tessera import catalog
from tessera.operators import graphs, network, statistics


def _mentions(spark):
    rows = [(doc, f"E{ent}", "A" if ent % 2 else "B") for doc in range(60) for ent in range(12) if (doc * 7 + ent * 5) % 4 == 0]
    rows += [(1, "E0", "C"), (1, "E0", "B"), (None, "E1", "A"), (2, None, "A"), (3, "E3", None)]
    return rows, spark.createDataFrame(rows, "doc long, ent string, type string")


def test_documents_behind_edges(spark):
    rows, mentions = _mentions(spark)
    held = {}
    for doc, ent, kind in rows:
        if doc is not None and ent is not None and kind is not None:
            held.setdefault(doc, set()).add(ent)
    behind = {}
    for doc, ents in held.items():
        for pair in combinations(sorted(ents), 2):
            behind.setdefault(pair, []).append(doc)
    wanted = sorted(behind)[::2]
    edges = spark.createDataFrame([*wanted, ("E0", "none")], "src string, dst string")
    got = Counter((r.src, r.dst, r.doc) for r in network.edge_documents(mentions, edges).collect())
    assert got == Counter((*pair, doc) for pair in wanted for doc in behind[pair])
    spans = {(r.src, r.dst): (r.n_docs, r.first_doc, r.last_doc) for r in network.edge_spans(mentions, edges).collect()}
    assert spans == {pair: (len(behind[pair]), min(behind[pair]), max(behind[pair])) for pair in wanted}


def test_documents_behind_edges_meet_within_documents(spark):
    # A hub in 2,000 documents with an edge in each: joined by the hub these would be 4,000,000 rows.
    rows = [(doc, ent) for doc in range(2000) for ent in ("hub", f"leaf{doc}")]
    mentions = spark.createDataFrame([(d, e, "A") for d, e in rows], "doc long, ent string, type string")
    edges = mentions.where("ent <> 'hub'").selectExpr("'hub' as src", "ent as dst")
    done = network.edge_documents(mentions, edges)
    assert done.count() == 2000
    # What is left to do is to name the pairs, which were written.
    assert any("edge-documents" in f for f in done.inputFiles())


def test_query_lists_every_document_of_an_edge(spark):
    there = "/root/testdata/sf0.001"
    listed = catalog.queries()["edge_documents"](spark, there)
    assert sorted(listed.columns) == ["doc", "dst", "src"]
    # An edge weighs as many documents as mention both of its ends.
    got = Counter((r.src, r.dst) for r in listed.collect())
    assert got == {(r.src, r.dst): r.weight for r in catalog.queries()["cooc_edges"](spark, there).collect()}
    assert max(got.values()) > 2


@pytest.mark.parametrize("most", [1, 3, 7])
def test_documents_behind_edges_of_blocks(spark, monkeypatch, most):
    _, mentions = _mentions(spark)
    edges = network.cooccurrence_edges(mentions, 2)
    once = Counter(map(tuple, network.edge_documents(mentions, edges).collect()))
    monkeypatch.setattr(network, "EDGES_A_BLOCK", most)
    done = network.edge_documents(mentions, edges)
    assert Counter(map(tuple, done.collect())) == once and set(once.values()) == {1}
    # Each block is written by itself.
    assert len({f.rsplit("/", 2)[1] for f in done.inputFiles() if "edge-documents" in f}) > 1


def test_edges_count_repeated_mentions_as_pairs(spark):
    mentions = spark.createDataFrame([(1, "a", "A"), (1, "a", "A"), (1, "b", "B"), (2, "a", "A"), (2, "b", "B"), (None, "a", "A"), (None, "b", "B")], "doc long, ent string, type string")
    assert [tuple(r) for r in network.cooccurrence_edges(mentions, 1).collect()] == [("a", "b", "A", "B", 3)]


@pytest.mark.parametrize("most", [10_000, 150, 20])
def test_triangles_of_blocks(spark, monkeypatch, most):
    # The smaller a block, the more groups: every triangle is counted in one block alone.
    monkeypatch.setattr(statistics, "EDGES_A_BLOCK", most)
    rng = random.Random(3)
    edges = [(a, b) for a, b in combinations(range(40), 2) if rng.random() < 0.4]
    linked = set(edges)
    want = Counter(v for t in combinations(range(40), 3) if all(p in linked for p in combinations(t, 2)) for v in t)
    got = statistics.corners(spark.createDataFrame(edges, "lo long, hi long")).collect()
    assert {r["rank"]: r["triangles"] for r in got} == dict(want)


def _typed(spark):
    rows = [(f"E{a:02}", f"E{b:02}", f"T{a % 3}", f"T{b % 3}", (a * b) % 5 + 1) for a, b in combinations(range(14), 2) if (a + b) % 3]
    return rows, spark.createDataFrame(rows, "src string, dst string, src_type string, dst_type string, weight long")


def _joins(spark, build):
    """Sort-merge joins of the plan where nothing is sent to every executor unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = build()
        return df, df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_metrics_sort_no_edges(spark):
    rows, edges = _typed(spark)
    df, plan = _joins(spark, lambda: network.entity_metrics(edges))
    assert "max_by" not in plan
    near = {}
    for a, b, t, u, w in rows:
        near.setdefault((a, t), []).append((w, b))
        near.setdefault((b, u), []).append((w, a))
    want = {(*k, len(v), sum(w for w, _ in v), *max(v)) for k, v in near.items()}
    assert {tuple(r) for r in df.collect()} == want


def test_summaries_exchange_no_edges(spark):
    _, edges = _typed(spark)
    labels = spark.createDataFrame([(f"E{i:02}", i % 2) for i in range(14)], "node string, label long")
    _, plan = _joins(spark, lambda: graphs.community_summaries(edges, labels))
    assert "hashpartitioning(src" not in plan and "hashpartitioning(dst" not in plan


def test_permutations_meet_nodes_once(spark):
    _, edges = _typed(spark)
    df, plan = _joins(spark, lambda: graphs.permutation_test(edges, 4))
    assert "hashpartitioning(src" not in plan and "hashpartitioning(dst" not in plan
    assert df.first()["deviation"] is not None


def test_viewer_documents_are_found_within_documents(spark):
    rows = [(doc, ent, ent[0]) for doc in range(50) for ent in ("a1", "b1", *(["b2"] if doc % 2 else []))]
    mentions = spark.createDataFrame(rows, "doc long, ent string, type string")
    done = network.ranked_viewer_documents(network.cooccurrence_edges(mentions), mentions, docs_per_edge=5)
    # Edge a1-b1 has documents 0 to 4, edge a1-b2 the odd ones from 1 to 9.
    assert {(r.doc, r.n_edges, r.n_entities) for r in done.collect()} == {(0, 1, 2), (1, 2, 3), (2, 1, 2), (3, 2, 3), (4, 1, 2), (5, 1, 2), (7, 1, 2), (9, 1, 2)}
    assert any("viewer-documents" in f for f in done.inputFiles())


def test_partitions_grow_with_mentions(spark, monkeypatch):
    from tessera import session
    from tessera.sources import tables

    monkeypatch.setattr(session, "ROWS_A_PARTITION", 500)
    lines = tables.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    # A task's share of the mentions stays the same, however many there are.
    assert tables.mentions(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-2 * lines // 500) > 8
