import random
from collections import deque

from tessera.operators import graphs


def brute(edges, sources):
    near, share = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys(near, 0.0)
    for s in sources:
        hops, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in hops:
                    hops[w], paths[w] = hops[v] + 1, 0
                    queue.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if hops[v] == hops[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    n = len(near)
    return {v: x * n / len(sources) / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample([f"v{i:02d}" for i in range(18)], 2))) for _ in range(26)})
    table = spark.createDataFrame([(a, b, "X", "X", 1) for a, b in edges], "src string, dst string, src_type string, dst_type string, weight long")
    nodes = sorted({v for e in edges for v in e})
    sources = spark.createDataFrame([(v,) for v in nodes], "source string")
    want = brute(edges, nodes)
    got = {r.node: r.betweenness for r in graphs.betweenness(table, sources).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    top = graphs.gatekeepers(table, sources, 3).collect()
    assert len(top) == 3 and top[0].bridge >= top[1].bridge


def test_clusters_and_batches(spark):
    from tessera.operators.exploration import pack_batches
    from tessera.operators.matching import threshold_clusters

    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1]), (3, [0.7, 0.7])], "place long, embedding array<double>")
    assert [r.leader for r in threshold_clusters(rows, 0.8).orderBy("place").collect()] == [0, 1, 0, 3]
    docs = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 20), ("a", 4, 1), ("b", 1, 99)], "g string, i int, size int")
    assert [r.batch for r in pack_batches(docs, "g", "i", "size", 11).orderBy("g", "i").collect()] == [0, 0, 1, 2, 0]
