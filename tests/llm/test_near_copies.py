import random

import pytest

pytest.importorskip("public_tokenizers")


def words(n, rng):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def changed(base, share, rng):
    return [w if rng.random() > share else "x" + w for w in base]


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def test_groups_equal_brute_force(spark):
    from tessera.llm.shingles import near_copy_groups

    rng = random.Random(5)
    texts = [None, "", " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d f"]
    for k in range(12):
        base = words(rng.choice((40, 300, 1000)), rng)
        texts += [" ".join(changed(base, rng.choice((0.0, 0.005, 0.01, 0.02, 0.04)), rng)) for _ in range(12)]
    sets = [grams(t or "") for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (alike(sets[i], sets[j]) if sets[i] or sets[j] else True) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    assert {r.row: r.group for r in near_copy_groups(rows).collect()} == dict(enumerate(part))
    assert near_copy_groups(rows.limit(0)).count() == 0


def test_stage_drops_near_copies(spark):
    from corpus_pipeline import near_copies

    rng = random.Random(6)
    rows, want = [], []
    for k in range(40):
        base = words(300, rng)
        copy = changed(base, 0.015, rng)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want += [2 * k] + [2 * k + 1] * (not alike(grams(rows[-2][1]), grams(rows[-1][1])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in near_copies(spark, docs, "").collect()) == want


def test_stage_chooses_rows_not_ids(spark):
    from corpus_pipeline import near_copies

    rng = random.Random(7)
    a, b, c, d, e = (" ".join(words(200, rng)) for _ in range(5))
    rows = [(1, a), (1, b), (1, b), (2, b), (2, c), (3, a + " more"), (None, a), (None, d), (None, d), (None, d + " more"), (4, e), (None, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in near_copies(spark, docs.repartition(5), "").collect()]
    assert sorted(x for x in got if x[0]) == sorted([(1, a), (1, b), (2, c), (4, e)])
    assert len([x for x in got if x[0] is None]) == 1 and [x for x in got if x[0] is None][0][1] in (d, d + " more")
    assert sorted(got, key=str) == sorted(((r.doc_id, r.text) for r in near_copies(spark, docs.repartition(3), "").collect()), key=str)


def test_fingerprints_find_candidates(spark, monkeypatch):
    from tessera.llm import shingles
    from tessera.llm.simhash import _simhash

    # Without buckets, what fingerprints within two bits lead to is still found, and verified.
    monkeypatch.setattr(shingles, "_buckets", lambda value, flip, times: [])
    rng = random.Random(8)
    rows, want = [], []
    while len(want) < 6:
        base = words(300, rng)
        pair = " ".join(base), " ".join(base[:-1] + ["last"])
        rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
        if (_simhash(pair[0], 5) ^ _simhash(pair[1], 5)).bit_count() <= 2:
            want.append((rows[-1][0], rows[-2][0]))
    got = {(r.row, r.group) for r in shingles.near_copy_groups(spark.createDataFrame(rows, "row long, text string")).where("row <> group").collect()}
    assert got == set(want)
