import numpy as np
import pytest

from tessera.llm.vectors import Tree


def expected(ids, rows, query, keep):
    score = np.cumsum(query * rows, axis=1)[:, -1]
    return list(ids[np.lexsort((ids, -score))[:keep]])


@pytest.mark.parametrize("kind", ["plain", "one long", "overflow", "ties", "same length"])
def test_tree_equals_brute_force(kind):
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((3000, 16))
    if kind == "one long":
        rows[17] *= 1e10
    elif kind == "overflow":
        rows[17] *= 1e160
    elif kind == "ties":
        # All differ (the first components only name them), none of which the query sees.
        rows[:, 8:] = rng.integers(0, 2, (3000, 8))
    elif kind == "same length":
        rows = rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))
    queries = rows[100:130].copy()
    if kind == "ties":
        queries[:, :8] = 0
    ids = rng.permutation(3000) * 3
    with np.errstate(all="ignore"):
        tree = Tree(ids, rows)
        points = tree.search(queries, 21)
        for q, found in zip(queries, points):
            assert [tree.ids[tree.first[p]] for p in found] == expected(ids, rows, q, 21)
