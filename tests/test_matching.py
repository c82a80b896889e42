import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.matching import assign_to, contradiction_type, first_fit, merge_similar_patterns, nearest_rows, seed_clusters, sequence_ratio, similar_texts, threshold_clusters


def words(rng, n, alphabet="abcde "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def changed(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text) + 1)
        text = text[:at] + rng.choice(["", "x", "é"]) + text[at + rng.randint(0, 1) :]
    return text


def test_sequence_ratio(spark):
    rng = random.Random(2)
    pairs = [(words(rng, rng.randint(0, 40)), words(rng, rng.randint(0, 40))) for _ in range(200)] + [("", ""), ("a", ""), (None, "a"), ("x" * 300, "x" * 250 + "y")]
    pairs += [(a, changed(rng, a, 3)) for a, _ in pairs[:100] if a]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r.r == (None if r.a is None else SequenceMatcher(None, r.a, r.b).ratio())


@pytest.mark.parametrize("least", [0.9, 0.8, 0.6])
def test_similar_texts_find_all_pairs(spark, least):
    rng = random.Random(7)
    texts = ["", "a", "ab", "ba", "abc", "aaaaaaaa", "aaaaaaaaa", "the same text twice over"]
    for _ in range(25):
        base = words(rng, rng.randint(1, 60))
        texts += [base] + [changed(rng, base, rng.randint(1, 8)) for _ in range(3)]
    texts = list(dict.fromkeys(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    got = {(r.early, r.late): r.ratio for r in similar_texts(rows, least).collect()}
    want = {(i, j): SequenceMatcher(None, texts[j], texts[i]).ratio() for j in range(len(texts)) for i in range(j)}
    assert got == {k: v for k, v in want.items() if v >= least}


def test_first_fit_equals_the_fold(spark):
    rng = random.Random(3)
    links = {(i, j): rng.choice([0.7, 0.8, 0.9]) for j in range(80) for i in range(j) if rng.random() < 0.06}
    links.update({(i, i + 1): 0.9 for i in range(100, 112)})
    places = [*range(80), *range(100, 113), 200]
    data = spark.createDataFrame([(i, j, s) for (i, j), s in links.items()], "early long, late long, score double")
    items = spark.createDataFrame([(p,) for p in places], "place long")
    for best in (False, True):
        leaders, want = [], {}
        for p in places:
            near = [q for q in leaders if (q, p) in links]
            want[p] = (max(near, key=lambda q: (links[q, p], -q)) if best else near[0]) if near else p
            if not near:
                leaders.append(p)
        assert {r.place: r.leader for r in first_fit(items, data, best).collect()} == want
    assert first_fit(items.limit(0), data.limit(0)).count() == 0


def test_merge_similar_patterns(spark):
    rng = random.Random(11)
    plain = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t.lower())).strip()
    bases = [words(rng, 40, "abcdefgh  ") for _ in range(6)]
    found = [(i, changed(rng, rng.choice(bases), rng.randint(0, 5)).upper() if i % 3 else rng.choice(bases) + "!") for i in range(70)] + [(70, ""), (71, "??"), (72, None)]
    keys, want = [], {}
    for seq, text in found:
        if text is None:
            continue
        scores = [(SequenceMatcher(None, plain(text), plain(k)).ratio(), -i, k) for i, k in enumerate(keys)]
        top = max(scores, default=(0, 0, None))
        if top[0] >= 0.9:
            want[seq] = top[2]
        else:
            keys.append(text)
            want[seq] = text
    got = {r.seq: r.merged for r in merge_similar_patterns(spark.createDataFrame(found, "seq long, pattern string"), 0.9).collect()}
    assert got == want and len(set(want.values())) < 60


def test_contradictions(spark):
    claims = [
        ("John Smith, brakeman", "Jon Smith brakeman", "name_variant_or_ocr", "medium"), ("certificate 1234 was issued here", "he held the number 9999 by then", "certificate_number_conflict", "medium"),
        ("hired in 1899 at the yard", "left the road for good, 1905", "date_conflict", "low"), ("he was dismissed", "promoted to foreman after the strike", "true_conflict", "low"),
        ("certificate 1234 was issued here", "it bore number 1234, they said so", "true_conflict", "low"), ("", "", "true_conflict", "low"), (None, "x", "true_conflict", "low"),
    ]
    got = spark.createDataFrame([c[:2] for c in claims], "a string, b string").select(contradiction_type(F.col("a"), F.col("b")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [c[2:] for c in claims]


def cosine(a, b):
    a, b = np.nan_to_num(np.array(a, float)), np.nan_to_num(np.array(b, float))
    size = np.sqrt((a * a).cumsum()[-1]) * np.sqrt((b * b).cumsum()[-1])
    return float(np.floor(((a * b).cumsum()[-1] / size if size else 0.0) * 1e6 + 0.5) / 1e6)


def vectors(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).round(2)
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)).round(2) * rng.choice([0, 0.1, 0.5], (n - n // 2, 1))
    x[3] = 0
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_nearest_rows(spark):
    rows = vectors(1, 90) + [(500, None), (501, [1.0, 2.0]), (None, [0.0] * 6)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    real = [(i, v) for i, v in rows if i is not None and v is not None]
    for k, least, own in ((4, None, False), (200, 0.3, True), (1, 0.9, False)):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest_rows(data, data.where("vec_id % 3 = 0"), k, least, own, vec_rows=16, query_rows=7).collect()}
        want = {}
        for q, a in real:
            if q % 3 == 0:
                near = sorted((-cosine(a, b), i) for i, b in real if len(a) == len(b) and (own or i != q))
                near = [(s, i) for s, i in near if least is None or -s >= least][:k]
                want.update({(q, n + 1): (i, -s) for n, (s, i) in enumerate(near)})
        assert got == want
    assert nearest_rows(data.limit(0), data, 3).count() == 0 and nearest_rows(data, data.limit(0), 3).count() == 0
    plan = nearest_rows(data, data, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_threshold_clusters(spark):
    rows = vectors(4, 120, 4) + [(300, vectors(4, 120, 4)[0][1]), (301, [0.0] * 4)]
    heads, want = [], {}
    for p, v in rows:
        near = [h for h in heads if cosine(dict(rows)[h], v) >= 0.78]
        want[p] = near[0] if near else p
        if not near:
            heads.append(p)
    got = {r.place: r.leader for r in threshold_clusters(spark.createDataFrame(rows, "place long, embedding array<double>"), 0.78).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_seeds_and_themes(spark):
    rows = [(i, v, float(i * 7 % 11) if i % 5 else None) for i, v in vectors(6, 60)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    seeds = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))[:5]
    want = {}
    for i, v, _ in rows:
        own = [s[0] for s in seeds]
        want[i] = (i, 1.0) if i in own else max(((s[0], cosine(v, s[1])) for s in seeds), key=lambda x: (x[1], -own.index(x[0])))
    assert {r.vec_id: (r.seed, r.similarity) for r in seed_clusters(data, 5).collect()} == want
    themes = [(i, rows[i][1], f"t{i}") for i in (4, 9, 14)]
    got = {r.vec_id: (r.theme, r.similarity) for r in assign_to(data.select("vec_id", "embedding"), spark.createDataFrame(themes, "vec_id long, embedding array<double>, theme string"), 0.2).collect()}
    for i, v, _ in rows:
        score, _, name = max((cosine(v, t[1]), -t[0], t[2]) for t in themes)
        assert got[i] == (name if score >= 0.2 else "other", score)
