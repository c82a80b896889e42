import random

from tessera.operators.notebook import coverage, indicator_levels, merge_counts, merge_entities, merge_indicators, summary

FOUND = "seq long, name string, type string, contexts array<string>, first_block string, last_block string"


def plain(findings):
    out = {}
    for _, name, kind, contexts, first, last in findings:
        if not name:
            continue
        contexts = [c for c in contexts or [] if c]
        key = name.lower().strip(" ")
        if key not in out:
            out[key] = [name, kind or "unknown", 1, contexts, first or None, last or None]
            continue
        known = out[key]
        known[2] += 1
        known[3] = (known[3] + contexts[:3])[:10]
        known[4] = known[4] or first or None
        known[5] = last or known[5]
    return out


def test_entities_merge_as_the_fold(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Ann", " ann", "BOB ", "Cy", "", None, "hot", "hot", f"n{i % 30}"]), rng.choice(["PERSON", "", None]), [f"c{i}{j}" if rng.random() < 0.8 else rng.choice(["", None]) for j in range(rng.randint(0, 14))] if i % 9 else None, rng.choice([None, "", f"{i}::0"]), rng.choice([None, "", f"{i}::1"])) for i in range(300)]
    want = plain(rows)
    for cut in (0, 120, 300):
        state = merge_entities(spark.createDataFrame(rows[:cut], FOUND)) if cut else None
        done = merge_entities(spark.createDataFrame(rows[cut:], FOUND).repartition(3), state).collect()
        got = {r.key: [r.name, r.type, r.document_count, r.contexts, r.first_block, r.last_block] for r in done}
        # Empty contexts are left out before the first three are counted, in a state as in a batch.
        assert got.keys() == want.keys()
        for key in got:
            assert [got[key][i] for i in (0, 1, 2, 4, 5)] == [want[key][i] for i in (0, 1, 2, 4, 5)], key
            assert got[key][3] == want[key][3], key


def test_counts_and_coverage(spark):
    batch = spark.createDataFrame([("year", "1901", 2), ("year", "1923", 5), ("year", "undated", 1), ("type", "card", 4)], "kind string, name string, n int")
    once = merge_counts(batch)
    twice = merge_counts(batch, once)
    assert {(r.kind, r.name): r.n for r in twice.collect()} == {("year", "1901"): 4, ("year", "1923"): 10, ("year", "undated"): 2, ("type", "card"): 8, ("decade", "1900"): 4, ("decade", "1920"): 10}
    assert tuple(coverage(twice).first()) == (1901, 1923, 1920, "1910")
    assert tuple(coverage(merge_counts(batch.limit(0))).first())[:3] == (None, None, None)


def test_indicators_and_summary(spark):
    schema = "type string, label string, evidence array<string>"
    one = spark.createDataFrame([("Job", " Fireman", ["1::0", "1::5", "2"]), ("job", "FIREMAN ", ["3"]), ("job", "", ["9"]), (None, "x", ["9"]), ("place", "Yard", None)], schema)
    state = merge_indicators(one)
    two = merge_indicators(spark.createDataFrame([("JOB", "fireman", ["2::9", "4", "5"])], schema), state)
    assert {r.key: (r.n_documents, r.confidence) for r in indicator_levels(state).collect()} == {"job:fireman": (3, "medium"), "place:yard": (0, "low")}
    assert {r.key: (r.n_documents, r.confidence) for r in indicator_levels(two).collect()} == {"job:fireman": (5, "high"), "place:yard": (0, "low")}
    entities = spark.createDataFrame([("a", "A", 5), ("b", "B", 9), ("c", "C", 1)], "key string, name string, document_count long")
    patterns = spark.createDataFrame([("p", 30, "high"), ("q", 2, "low")], "pattern string, n_evidence int, confidence string")
    assert {tuple(r) for r in summary(entities, patterns, 2).collect()} == {("total", "entities", 3), ("total", "patterns", 2), ("entity", "B", 9), ("entity", "A", 5), ("pattern", "p", 30)}
