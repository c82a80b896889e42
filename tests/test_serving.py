import numpy as np

from tessera.operators.serving import agenda, backfill, parents, semantic_search


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.floor((a @ b / size if size else 0.0) * 1e6 + 0.5) / 1e6)


def test_agenda_equals_the_fold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 4)).round(1)
    x[60:] = x[:60] + rng.normal(size=(60, 4)).round(1) * rng.choice([0, 0.3], (60, 1))
    rows = [(i, [float(v) for v in x[i]], float(i * 13 % 17) if i % 6 else None) for i in range(120)]
    themes = [(200 + i, [float(v) for v in x[i * 7]], f"t{i}") for i in range(5)]
    want = {}
    for i, v, s in rows:
        score, _, name = max((cosine(v, t[1]), -t[0], t[2]) for t in themes)
        if score >= 0.2:
            want.setdefault(name, []).append((s is None, -(s or 0), i))
    out = set()
    for name, members in want.items():
        order = [i for _, _, i in sorted(members)]
        out.add((name, "overview", 0, order[0], len(order)))
        kept = []
        for i in order[1:8]:
            if all(cosine(x[i], x[j]) < 0.86 for j in kept):
                kept.append(i)
        out |= {(name, "sub", n, i, len(order)) for n, i in enumerate(kept[:6], 1)}
    got = agenda(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double"), spark.createDataFrame(themes, "vec_id long, embedding array<double>, theme string")).collect()
    assert {(r.theme, r.role, r.place, r.vec_id, r.n_questions) for r in got} == out


def test_search_results_and_parents(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], 7, "x" * 500), (2, [0.9, 0.1], 7, None), (3, [0.0, 1.0], 8, "y"), (4, None, 9, "z")], "vec_id long, embedding array<double>, doc_id long, text string")
    docs = spark.createDataFrame([(7, "T", None, "s")], "doc_id long, title string, date string, source string")
    asked = spark.createDataFrame([(50, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = semantic_search(chunks, asked, docs, 1000).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.distance, len(r.content), r.title, r.date, r.source) for r in got] == [(1, 1.0, 0.0, 400, "T", "", "s"), (2, 0.9939, 0.0061, 0, "T", "", "s"), (3, 0.0, 1.0, 1, "", "", "")]
    assert semantic_search(chunks, asked, docs, -3).count() == 1
    assert [(r.doc_id, r.place) for r in parents(semantic_search(chunks, asked, docs)).orderBy("place").collect()] == [(7, 1), (8, 2)]
    assert parents(semantic_search(chunks, asked, docs), 1).count() == 1


def test_backfill(spark):
    docs = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7)] + [(None,)], "doc_id long")
    done = spark.createDataFrame([("3",), ("x",), (None,)], "document_id string")
    assert [(r.doc_id, r.batch) for r in backfill(docs, done, batch=2).orderBy("doc_id").collect()] == [(1, 0), (5, 0), (7, 1), (9, 1)]
    assert [r.doc_id for r in backfill(docs, done, limit=2).orderBy("doc_id").collect()] == [1, 5]
