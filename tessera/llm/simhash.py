"""SimHash fingerprints and near duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import materialize

BITS = 64


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The 64-bit SimHash of each whole text, as ``fp`` beside the id.

    Letters A to Z are lowered; words are runs of bytes other than space and 0x09 to 0x0D. Each
    run of ``shingle`` words (all words, if fewer), repeats included, is hashed with XXH64, seed
    42. A bit is set if over half of the hashes have it. Null texts and texts without words have
    fingerprint zero. One row is returned for each input row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fp": np.array([_simhash(t, shingle) for t in pdf["text"]], np.uint64).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def shingle_hashes(text: str | None, shingle: int) -> tuple[bytes, np.ndarray]:
    """The words in one line, and the hashes of their shingles (of all words, if fewer), repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    line = b" ".join(words)
    if not words:
        return line, np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return line, np.array([digest(line, 42)], np.uint64)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    return line, np.array([digest(line[a:b], 42) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist())], np.uint64)


def fold(value: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is set if over half of them have it."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(value), 4096):
        part = value[i : i + 4096].astype(">u8").view(np.uint8)
        count += np.unpackbits(part).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(value)).tobytes(), "big")


def _simhash(text: str | None, shingle: int) -> int:
    return fold(shingle_hashes(text, shingle)[1])


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks such that any two values that differ in at most ``radius`` bits agree under one.

    Each bit gets a non-zero vector of radius + 1 bits; each non-zero vector v makes a mask of
    the bits whose vector has an odd inner product with v. The vectors of ``radius`` bits leave a
    v at right angles to all of them, and that v's mask omits exactly such bits.
    """
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def hamming_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that differ in at most two bits.

    Returns ``src`` and ``dst``; their components are those of all such pairs. Every pair within
    the radius meets in a bucket of some table of :func:`covering_masks`. A bucket of two is
    judged there. Members of larger buckets, however large, meet at a value at most one bit from
    both: at most 65 fingerprints share one, and each links to the smallest of them.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    reach = [F.lit(0).cast("long")] + [F.lit(_signed(1 << i)).cast("long") for i in range(BITS)]
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("kept")) for t, m in enumerate(covering_masks(radius))])
    placed = prints.select("fp", F.inline(tables))
    buckets = placed.groupBy("table", "kept").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst")).where("n > 1")
    buckets = materialize(buckets, "simhash-buckets")
    pairs = buckets.where("n = 2").select("src", "dst")
    crowd = placed.join(buckets.where("n > 2").select("table", "kept"), ["table", "kept"], "left_semi").select("fp").distinct()
    met = crowd.select("fp", F.explode(F.array(*reach)).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("at"))
    if radius == 1:
        near = met.join(crowd.select(F.col("fp").alias("at")), "at", "left_semi").select(F.col("fp").alias("src"), F.col("at").alias("dst"))
    else:
        near = met.groupBy("at").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1).select(F.array_min("all").alias("src"), F.explode("all").alias("dst"))
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= radius
    return pairs.union(near).where(F.col("src") != F.col("dst")).where(close).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, ``fp`` and ``component_id``, the smallest id reachable by links.

    Two documents link if their fingerprints differ in at most ``radius`` bits. Equal
    fingerprints are one vertex, so copies cost a row each and no pairs. A null id is returned
    with its group's smallest id and is never that id unless the group has no other.
    """
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash")
    vertices = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    parts = connected_components(hamming_links(vertices.select("fp"), radius))
    joined = vertices.join(parts, vertices.fp == parts.vertex, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    joined = materialize(joined, "simhash-parts")
    smallest = joined.groupBy("part").agg(F.min("least").alias("component_id"))
    named = joined.join(smallest, "part").select("fp", "component_id")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")
