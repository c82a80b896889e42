"""Groups of near copies: texts whose sets of word shingles have a high Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.simhash import fold, hamming_links, shingle_hashes
from tessera.operators.components import connected_components
from tessera.session import materialize

# A pair of similarity s shares a bucket with probability 1 - (1 - s ** ROWS) ** BANDS: 0.99993 at 0.8.
BANDS, ROWS = 24, 5


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle)[1])


def _buckets(value: np.ndarray, flip: np.ndarray, times: np.ndarray) -> list[int]:
    """One hash for each band of ROWS smallest values."""
    least = np.full(len(flip), 2**64 - 1, np.uint64)
    for i in range(0, len(value), 1024):
        least = np.minimum(least, ((value[i : i + 1024, None] ^ flip) * times).min(axis=0))
    return [xxhash.xxh64_intdigest(band.tobytes(), seed) - 2**63 for seed, band in enumerate(least.reshape(BANDS, ROWS))]


def near_copy_groups(rows: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``row`` and ``group``: the smallest row that each row of ``row, text`` reaches by links.

    ``row`` is a long, unique and stable. Words are as in :mod:`tessera.llm.simhash`. Two rows link
    if their words are equal or the Jaccard similarity of their sets of ``shingle`` words is at
    least ``threshold``. Rows with equal words are one vertex. Candidates have SimHash fingerprints
    that are equal or linked by :func:`tessera.llm.simhash.hamming_links`, which most near copies
    of long texts are not, or share one of ``BANDS`` buckets of min-hashes; each is verified on its
    whole sets. Rows of one fingerprint meet the smallest of them. A bucket's members meet its smallest
    first, and then only members that no link has joined yet meet each other, so a large group
    costs a pair for each member and no pair of a bucket is left out.
    """
    rng = np.random.default_rng(5)
    flip = rng.integers(0, 2**64, BANDS * ROWS, np.uint64)
    times = rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, text in zip(pdf["row"], pdf["text"]):
                line, every = shingle_hashes(text, shingle)
                value = np.unique(every)
                out.append((row, xxhash.xxh3_128_digest(line), len(value), fold(every) - 2**63, _buckets(value, flip, times) if len(value) else []))
            yield pd.DataFrame(out, columns=["row", "words", "n", "fp", "buckets"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"v": pdf["row"], "s": [_shingles(t, shingle).view(np.int64) for t in pdf["text"]]})

    signed = materialize(rows.select("row", "text").mapInPandas(sign, "row long, words binary, n int, fp long, buckets array<long>"), "copies-signed")
    classes = signed.groupBy("words").agg(F.min("row").alias("v"))
    classed = materialize(signed.join(classes, "words").select("row", "v", "n", "fp", F.when(F.col("row") == F.col("v"), F.col("buckets")).alias("buckets")), "copies-classes")
    placed = classed.where("row = v").select("v", "n", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("v").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    placed = materialize(placed.join(shared, "bucket"), "copies-buckets")
    prints = classed.where("row = v and n > 0").select("v", "n", "fp")
    first = materialize(prints.groupBy("fp").agg(F.min(F.struct("v", "n")).alias("of")).select("fp", F.col("of.v").alias("hub"), F.col("of.n").alias("hub_n")), "copies-prints")
    same = prints.join(first, "fp").where("v <> hub").select("hub", "v", "n", "hub_n")
    ends = [first.select(F.col("fp").alias(c), F.col("hub").alias(v), F.col("hub_n").alias(n)) for c, v, n in (("src", "hub", "hub_n"), ("dst", "v", "n"))]
    near = hamming_links(first.select("fp")).join(ends[0], "src").join(ends[1], "dst").select("hub", "v", "n", "hub_n")
    # No pair whose sizes differ more can be similar enough.
    sized = lambda x, y: F.least(x, y) >= F.lit(threshold) * F.greatest(x, y) - 1e-9
    printed = materialize(same.unionByName(near).where(sized(F.col("n"), F.col("hub_n"))), "copies-printed")
    asked = placed.select(F.col("v").alias("row")).union(printed.select("hub")).union(printed.select("v")).distinct()
    held = materialize(rows.join(asked, "row", "left_semi").select("row", "text").mapInPandas(sets, "v long, s array<long>"), "copies-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        right = pairs.join(held.select(F.col("v").alias("b"), F.col("s").alias("t")), "b")
        both = right.join(held.select(F.col("v").alias("a"), "s"), "a")
        common = F.size(F.array_intersect("s", "t"))
        return both.where(common >= F.lit(threshold) * (F.size("s") + F.size("t") - common) - 1e-9).select("a", "b")

    hubs = placed.select(F.col("v").alias("hub"), F.col("n").alias("hub_n")).distinct()
    first = placed.where("v <> hub").select("hub", "v", "n").distinct().join(hubs, "hub").where(sized(F.col("n"), F.col("hub_n")))
    first = first.select("hub", "v").union(printed.select("hub", "v")).distinct()
    links = materialize(verified(first.select(F.col("hub").alias("a"), F.col("v").alias("b"))), "copies-links")
    parts = materialize(connected_components(links, "a", "b"), "copies-parts")
    rest = placed.where("size > 2 and v <> hub").join(parts, F.col("v") == F.col("vertex"), "left").select("bucket", "v", "n", F.coalesce("component", "v").alias("part"))
    other = rest.select("bucket", F.col("v").alias("w"), F.col("n").alias("m"), F.col("part").alias("other"))
    second = rest.join(other, "bucket").where((F.col("v") < F.col("w")) & (F.col("part") != F.col("other")) & sized(F.col("n"), F.col("m")))
    links = links.union(verified(second.select(F.col("v").alias("a"), F.col("w").alias("b")).distinct()))
    parts = connected_components(links, "a", "b")
    return classed.join(parts, F.col("v") == F.col("vertex"), "left").select("row", F.coalesce("component", "v").alias("group"))
