import random

import pytest
from oracle import connect, differences

from tessera import catalog
from tessera.operators import statistics
from tessera.operators.components import connected_components
from tessera.operators.entities import fuzzy_links, indel_ratio
from tessera.operators.corpus import is_duplicate_question
from tessera.operators.retrieval import cosine_neighbours
from tessera.operators.search import search
from tessera.sources.tables import combined_hash, merge_latest, new_documents, read_raw_documents
from tessera.streaming import events as stream

SMALL = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables, and are held against their SQL on larger ones.
RARE = {"term_lift": "/root/testdata/sf0.01"}


@pytest.fixture(scope="session")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, con, name):
    if name not in catalog.oracle_sql():
        assert catalog.queries()[name](spark, SMALL).count() > 0
        return
    there = RARE.get(name, SMALL)
    assert differences(spark, connect(there) if name in RARE else con, catalog.queries()[name], catalog.oracle_sql()[name], there) == ""


def test_components_of_a_random_graph(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(9, 9), (None, 3)]
    root = {v: v for e in edges for v in e if v is not None}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    linked = {v for a, b in edges if a is not None and b is not None and a != b for v in (a, b)}
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: find(v) for v in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_search_rows(spark):
    docs = spark.createDataFrame([(1, "Fire brakeman", "a"), (2, "fire", None), (3, "water", ""), (4, None, "b")], "id int, text string, kind string")
    ids = lambda rows: sorted(r.id for r in search(docs, rows).collect())
    assert ids([("text", "AND", "FIRE")]) == [1, 2]
    assert ids([("text", "NOT", "fire")]) == [3, 4]
    assert ids([("kind", "AND", "missing")]) == [2, 3]
    assert ids([("text", "OR", "water"), ("text", "OR", "brake"), ("kind", "XOR", "b")]) == [1, 3]


def test_ingestion(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('\x01junk {"x": 1} tail')
    (tmp_path / "sub" / "b.txt").write_text("hello")
    files = read_raw_documents(spark, str(tmp_path))
    assert files.count() == 2 and combined_hash(files).first()[0]
    assert new_documents(files, files.limit(0)).count() == 2 and new_documents(files, files).count() == 0
    old = spark.createDataFrame([("k", 1, "old"), ("m", 1, "m")], "key string, v int, x string")
    new = spark.createDataFrame([("k", 1, "new"), ("n", 1, "n")], "key string, v int, x string")
    assert {r.key: r.x for r in merge_latest(old, new, "key", "v").collect()} == {"k": "new", "m": "m", "n": "n"}


def test_fuzzy_links(spark):
    assert indel_ratio("abcd", "abcd") == 100 and indel_ratio("", "") == 100 and indel_ratio("abc", "xyz") == 0
    assert round(indel_ratio("lewenstein", "levenshtein"), 6) == round(200 * 9 / 21, 6)
    terms = spark.createDataFrame([("brakeman",), ("fireman",), ("zzz",)], "term string")
    refs = spark.createDataFrame([("brakemen",), ("brakeman",), ("firemann",)], "reference string")
    assert {r.term: r.reference for r in fuzzy_links(terms, refs, 85).collect()} == {"brakeman": "brakeman", "fireman": "firemann"}


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_stream_equals_batch(spark, tmp_path, kind):
    view = {"tumbling": stream.windowed, "sliding": lambda e: stream.windowed(e, "1 hour", "30 minutes"), "session": stream.sessions}[kind]
    source = spark.read.parquet(f"{SMALL}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    stream.run_to_end(view(live), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in view(source).collect()}
    assert got and got <= want  # the newest windows stay open until the watermark passes them


def test_statistics_of_small_graphs(spark):
    empty = spark.createDataFrame([], "src string, dst string, src_type string, dst_type string, weight long")
    one = spark.createDataFrame([("a", "b", "X", "X", 2)], empty.schema)
    for edges in (empty, one):
        for f in (statistics.triangles, statistics.assortativity, statistics.powerlaw_alpha, statistics.graph_summary, statistics.gini, statistics.local_clustering):
            assert f(edges).count() == 1
    zero = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.score for r in cosine_neighbours(zero, zero, 1).collect()] == [0.0, 0.0]


def test_new_questions(spark):
    known = spark.createDataFrame([(1, "Why did wages fall in the yard")], "id int, text string")
    new = spark.createDataFrame([(1, "why did WAGES fall in the yard"), (2, "who was he"), (3, " "), (4, None)], "id int, text string")
    assert {r.id: r.duplicate for r in is_duplicate_question(new, known).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_linked_terms(spark):
    from tessera.operators.entities import link_terms

    terms = spark.createDataFrame([("brakeman", 2), ("brakeman", 3), ("fireman", 1), ("zzz", 4), ("", 1), (None, 1)], "term string, frequency int")
    refs = spark.createDataFrame([("brakeman", "k2"), ("brakeman", "k1"), ("firemann", "k3"), (None, "k4")], "reference string, kb_id string")
    got = {r.term: (r.kb_id, r.how, r.frequency) for r in link_terms(terms, refs).collect()}
    assert got["brakeman"] == ("k1", "exact", 5) and got["fireman"] == ("k3", "fuzzy", 1)
    assert got["zzz"][0].startswith("own:") and got["zzz"][1:] == ("new", 4) and len(got) == 3
    assert link_terms(terms, refs.limit(0)).where("how <> 'new'").count() == 0
