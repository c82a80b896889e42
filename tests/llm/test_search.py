import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import search
from tessera.llm.search import WaveletTree, ranked_search, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """Scores of all documents for all items."""
    bags = [(i, Counter(split(t)), len(split(t))) for i, t in docs]
    n, total = sum(1 for _, _, size in bags if size), sum(size for _, _, size in bags)
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            score = 0
            for t in set(split(text)):
                if bag[t]:
                    df = sum(1 for _, b, _ in bags if b[t])
                    m = 100 - 90 + 90 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_terms():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("aZ09 \x00/:@[`{\x7f\x80é漢😀İK_-\n\x85\xa0 ") for _ in range(12))
        assert [w.decode() for w in terms(text)] == split(text)


@pytest.mark.parametrize("n_docs", [1, 2, 7, 64, 300])
def test_tree_finds_the_best(n_docs):
    rng = np.random.default_rng(n_docs)
    for wide in (1, 5, 64):
        pairs = np.unique(rng.integers(0, [[20, n_docs]], (600, 2)), axis=0)
        impact = rng.integers(1, 6, len(pairs))
        tree = WaveletTree(pairs[:, 0], pairs[:, 1], impact, 20, n_docs)
        for _ in range(40):
            place = rng.choice(20, rng.integers(1, 9), replace=False)
            weight = rng.integers(1, 4, len(place))
            sums = np.zeros(n_docs, int)
            for p, w in zip(place, weight):
                np.add.at(sums, pairs[pairs[:, 0] == p, 1], w * impact[pairs[:, 0] == p])
            want = np.lexsort((np.arange(n_docs), -sums))[:5]
            want = want[sums[want] > 0]
            docs, scores = tree.search(place, weight, 5, wide=wide)
            assert docs.tolist() == want.tolist() and scores.tolist() == sums[want].tolist()


def test_a_tree_opens_few_nodes():
    """Bounds of subtrees prune: a rare term's documents are found without opening the others."""
    n = 4096
    term, doc = np.concatenate([np.zeros(n, int), np.ones(3, int)]), np.concatenate([np.arange(n), [5, 900, 4000]])
    tree = WaveletTree(term, doc, np.concatenate([np.full(n, 10), [500, 400, 300]]), 2, n)
    opened = []
    tree.bounds = lambda level, *rest, f=tree.bounds: opened.append(len(level)) or f(level, *rest)
    assert tree.search(np.array([0, 1]), np.array([1, 1]), 3, wide=4)[0].tolist() == [5, 900, 4000]
    assert sum(opened) < 400


@pytest.mark.parametrize("most", [search.MOST_BROADCAST, 300])
def test_search(spark, monkeypatch, most):
    monkeypatch.setattr(search, "MOST_BROADCAST", most)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, prose(rng.randint(0, 30))) for i in range(150)] + [(500 + i, "hot copy of words") for i in range(60)]
    docs += [(700, None), (701, ""), (702, "..."), (None, "hot copy of words"), (3, prose(12)), (3, prose(12)), (900, prose(20000)), (901, "x" * 50000)]
    items = [(1, prose(8)), (2, "hot copy"), (2, "hot, COPY; words"), (3, None), (4, "nowhere_seen"), (None, prose(3)), (6, "a" * 3 + " " + "x" * 50000)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, item_id string, rank int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in ranked_search(frame, asked, k=10, shard_rows=16, shard_bytes=4000).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain(docs, items, 10), key=key)
    assert ranked_search(frame.limit(0), asked).count() == 0 and ranked_search(frame, asked.limit(0)).count() == 0
