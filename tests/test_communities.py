import itertools
import random

import pytest

from tessera.operators.communities import communities, improving_moves, numbered_graph
from tessera.operators.graphs import distances, label_propagation, matching
from tessera.operators.numbering import number_rows
from tessera.operators.random_graphs import compare_to_random, configuration_graphs, replicate_metrics

SCHEMA = "src string, dst string, src_type string, dst_type string, weight long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "X", "X", w) for a, b, w in edges], SCHEMA)


def modularity(edges, label):
    total = 2 * sum(w for _, _, w in edges)
    inside, ends = {}, {}
    for a, b, w in edges:
        for v in (a, b):
            ends[label[v]] = ends.get(label[v], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + 2 * w
    return sum(inside.get(c, 0) / total - (k / total) ** 2 for c, k in ends.items())


def best_partition(edges):
    """The highest modularity of all partitions, by trying them all."""
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    best = -1.0

    def place(i, labels, used):
        nonlocal best
        if i == len(nodes):
            best = max(best, modularity(edges, dict(zip(nodes, labels))))
            return
        for c in range(used + 1):
            place(i + 1, [*labels, c], max(used, c + 1))

    place(0, [], 0)
    return best


def clique(names, w=1):
    return [(a, b, w) for a, b in itertools.combinations(sorted(names), 2)]


def test_communities_of_small_graphs(spark):
    ring = [e for i in range(3) for e in clique([f"{i}{c}" for c in "abcd"])] + [(f"{i}a", f"{(i + 1) % 3}b", 1) for i in range(3)]
    pair = clique("abcd") + clique("wxyz") + [("a", "w", 1)]
    rng = random.Random(3)
    loose = [(a, b, rng.randint(1, 5)) for a, b in itertools.combinations("abcdefg", 2) if rng.random() < 0.45]
    for edges, want in ((pair, best_partition(pair)), (ring, modularity(ring, {v: v[0] for a, b, _ in ring for v in (a, b)})), (loose, best_partition(loose))):
        rows = communities(frame(spark, edges), least=0).collect()
        label = {r.node: r.label for r in rows}
        assert set(label) == {v for a, b, _ in edges for v in (a, b)}
        assert all(label[name] == name for name in label.values()) and all(v >= c for v, c in label.items())
        assert modularity(edges, label) >= want - 0.02
        if edges is not loose:
            assert modularity(edges, label) == pytest.approx(want)
        if edges is pair:
            assert label == {r.node: r.label for r in communities(frame(spark, edges[::-1]).repartition(5), least=0).collect()}


def test_communities_beat_label_propagation(spark):
    rng = random.Random(8)
    nodes = [f"n{i:03d}" for i in range(60)]
    edges = [(a, b, rng.randint(1, 3)) for a, b in itertools.combinations(nodes, 2) if rng.random() < (0.3 if int(a[1:]) % 3 == int(b[1:]) % 3 else 0.02)]
    data = frame(spark, edges)
    label = {r.node: r.label for r in communities(data, least=0).collect()}
    other = {r.node: r.label for r in label_propagation(data, 5).collect()}
    assert modularity(edges, label) >= modularity(edges, other)
    # No node gains by a move, and the operator that lists gains agrees.
    found = spark.createDataFrame(list(label.items()), "node string, label string")
    assert improving_moves(data, found).count() == 0
    near = {v: {x for a, b, _ in edges if v in (a, b) for x in (a, b)} for v in label}
    now = modularity(edges, label)
    assert all(modularity(edges, {**label, v: label[x]}) <= now + 1e-12 for v in label for x in near[v])


def test_improving_moves(spark):
    edges = clique("abcd") + clique("wxyz") + [("a", "w", 1)]
    start = {v: ("L" if v in "abcdw" else "R") for v in "abcdwxyz"}
    got = improving_moves(frame(spark, edges), spark.createDataFrame(list(start.items()), "node string, label string")).collect()
    want = modularity(edges, {**start, "w": "R"}) - modularity(edges, start)
    assert [(r.node, r.from_label, r.to_label) for r in got] == [("w", "L", "R")] and got[0].gain == pytest.approx(want, abs=1e-6)
    empty = frame(spark, [])
    assert communities(empty).count() == 0 and improving_moves(empty, spark.createDataFrame([], "node string, label string")).count() == 0
    odd = spark.createDataFrame([("a", "a", "X", "X", 1), (None, "b", "X", "X", 1), ("c", "d", "X", "X", 2)], SCHEMA)
    assert {r.node: r.label for r in communities(odd).collect()} == {"c": "c", "d": "c"}


def test_numbers_are_consecutive(spark):
    rows = [(random.Random(i).randint(0, 50), i) for i in range(500)]
    data = spark.createDataFrame(rows, "k int, i int").repartition(7)
    got = [(r.k, r.i) for r in number_rows(data, "k", "i").orderBy("no").collect()]
    assert got == sorted(rows)
    assert [r.no for r in number_rows(data, "k").orderBy("no").collect()] == list(range(500))
    assert number_rows(data.limit(0), "k").count() == 0


def test_a_chain_is_reached_whole(spark):
    edges = frame(spark, [(f"{i:02d}", f"{i + 1:02d}", 1) for i in range(20)])
    start = spark.createDataFrame([("00",)], "source string")
    assert {r.node: r.hops for r in distances(edges, start).collect()} == {f"{i:02d}": i for i in range(21)}
    with pytest.raises(ValueError):
        distances(edges, start, most=16)
    assert distances(edges, start, most=20).count() == 21


def test_invalid_pattern_matches_nothing(spark):
    names = spark.createDataFrame([("a(b",), ("x",), (None,)], "name string")
    for term, n in (("a(", 0), ("[", 0), ("a\\(", 1), ("A.B", 1), ("x", 0)):
        assert names.where(matching(names.name, term)).count() == n, term


def test_random_graphs_keep_degrees(spark):
    rng = random.Random(2)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(a, b, 1) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.2]
    degree = {v: sum(v in e[:2] for e in edges) for v in nodes}
    rows = configuration_graphs(frame(spark, edges), 3).collect()
    for r in (1, 2, 3):
        mine = [(x.src, x.dst) for x in rows if x.replicate == r]
        assert len(set(mine)) == len(mine) and all(a < b for a, b in mine) and len(mine) <= len(edges)
        assert all(sum(v in e for e in mine) <= degree[v] for v in nodes) and len(mine) > 0.6 * len(edges)
    assert sorted(rows) == sorted(configuration_graphs(frame(spark, edges).repartition(3), 3).collect())
    assert {tuple(sorted((x.src, x.dst) for x in rows if x.replicate == r)) for r in (1, 2, 3)}.__len__() == 3


def test_clustered_network_differs_from_chance(spark):
    edges = [e for i in range(8) for e in clique([f"{i}{c}" for c in "abcde"])] + [(f"{i}a", f"{i + 1}b", 1) for i in range(7)]
    got = {r.metric: r for r in compare_to_random(frame(spark, edges), replicates=6).collect()}
    assert set(got) == {"clustering", "modularity", "path_length"}
    assert got["clustering"].significant and got["clustering"].direction == "higher" and got["clustering"].n_simulations == 6
    assert got["path_length"].direction == "higher" and got["modularity"].direction == "higher"
    assert compare_to_random(frame(spark, edges[:10]), replicates=2).count() == 0

    def clustering(pairs, nodes):
        near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in nodes}
        c = [sum(y in near[x] for x, y in itertools.combinations(near[v], 2)) * 2 / (len(near[v]) * (len(near[v]) - 1)) if len(near[v]) > 1 else 0 for v in nodes]
        return sum(c) / len(c)

    pairs = [e[:2] for e in edges]
    nodes = sorted({v for e in pairs for v in e})
    one = spark.createDataFrame([(0, a, b) for a, b in pairs] + [(1, "0a", "0b"), (1, "0b", "0c"), (1, "0a", "0c"), (1, "0c", "1a")], "replicate int, src string, dst string")
    values = {(r.replicate, r.metric): r.value for r in replicate_metrics(one, spark.createDataFrame([(v,) for v in nodes], "node string"), spark.createDataFrame([("0a",)], "source string")).collect()}
    assert values[0, "clustering"] == pytest.approx(clustering(pairs, nodes))
    assert values[1, "clustering"] == pytest.approx(clustering([("0a", "0b"), ("0b", "0c"), ("0a", "0c"), ("0c", "1a")], nodes))
    assert values[1, "path_length"] == pytest.approx(4 / 3)
    names, adjacent, numbers = numbered_graph(frame(spark, edges))
    assert names.count() == numbers.count() == 40 and adjacent.count() == 2 * len(edges)
