import random
import re
from collections import Counter

import pytest

from tessera.llm.phrases import collocations


def plain(docs, least, top):
    counts, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in found.items()):
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = ["a", "b", "B", "a\x01", "é", "漢", "the", "of", "x\x1fy", "x\x85", "\xa0"] + ["r%d" % i for i in range(40)]
    prose = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", ";", "\r"]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und", ""]), prose(rng.randint(0, 120))) for _ in range(120)]
    rows += [("en", "one two three four five"), ("en", "one two three four five")] * 20 + [("fr", None), ("fr", ""), ("de", "hot pair " * 3000), ("en", "hot " * 4000), ("solo", "never often")]
    rows += [("en", "the same words, the same words; a b c d e f g h " + prose(5))] * 12
    return rows, spark.createDataFrame([(lang, t, 1, "x", 0) for lang, t in rows], "lang string, text string, f int, word string, block int")


@pytest.mark.parametrize("least,top,block_bytes,parts", [(5, 40, 300, 7), (3, 10_000, 4 << 20, 3), (30, 2000, 2000, 16)])
def test_collocations(spark, docs, least, top, block_bytes, parts):
    rows, frame = docs
    got = [tuple(r) for r in collocations(frame.repartition(parts), least, top, block_bytes=block_bytes).collect()]
    assert sorted(got) == sorted(plain(rows, least, top))


def test_few_rows(spark, docs):
    frame = docs[1]
    assert collocations(frame.limit(0)).count() == 0
    assert collocations(frame.where("lang = 'solo' or text is null")).count() == 0


def test_runs_that_cross_batches_and_partitions(spark, docs):
    rows, frame = docs
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = [tuple(r) for r in collocations(frame.repartition(5), 4, 10_000, block_bytes=100).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(got) == sorted(plain(rows, 4, 10_000))
