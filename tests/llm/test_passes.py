import numpy as np


def test_passes_grow_with_the_label():
    from tessera.llm.vectors import passes_needed

    assert passes_needed(513, 0.93, 10, 24, 512) == (10, 24)
    for largest in (20_000, 300_000, 1_500_000, 10**9):
        passes, bits = passes_needed(largest, 0.93, 10, 24, 512)
        depth = np.log2(largest / 512)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** depth) ** passes < 1e-3 and bits > depth


def test_planted_pairs_beyond_the_window(spark):
    from tessera.llm.vectors import near_duplicate_vectors

    rng = np.random.default_rng(12)
    base = rng.standard_normal((600, 64))
    base /= np.sqrt((base**2).sum(axis=1, keepdims=True))
    side = rng.standard_normal((600, 64))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.sqrt((side**2).sum(axis=1, keepdims=True))
    both = np.concatenate([base, 0.94 * base + np.sqrt(1 - 0.94**2) * side])
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(both)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in near_duplicate_vectors(rows, window=2).collect()}
    assert [i for i in range(600) if got[600 + i] != i] == []
