"""Packing documents into fixed windows, filled with lexical neighbours found by BM25."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix
from tessera.session import materialize


#: How byte-level BPE cuts text before merging: a fixed value of that tokenizer family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of whole texts by a tokenizer file.

    A byte-level BPE file whose ids follow its merges is also run by a faster library, from the
    same vocabulary. The tokenizer itself encodes what that library refuses, such as a million
    blanks in a row, and every thousandth text; where these differ it takes over for good.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        self.fast = self._fast(json.loads(Path(path).read_text()))
        self.seen = 0

    def _fast(self, spec: dict):
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if not plain or model.get("type") != "BPE":
            return None
        import tiktoken

        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        self.seen += 1
        exact = self.tokenizer.encode(text, add_special_tokens=False).ids if self.fast is None or self.seen % 1000 == 1 else None
        if self.fast is None:
            return np.array(exact, np.uint32)
        try:
            ids = self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
        except BaseException as error:
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            # The library's own panics are no Exception.
            exact = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(exact, np.uint32)
        if exact is not None and ids.tolist() != exact:
            self.fast = None
            return np.array(exact, np.uint32)
        return ids


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, shard: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut all texts' token ids (each text's followed by ``end_id``) into sequences of ``window``.

    Returns one row per piece: the id, ``start``, ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` and ``ids`` (unsigned 32-bit little-endian). Whole windows of a long document are
    sequences of their own. The rest of each document is packed by retrieval: documents are
    ordered by a min-hash of their token triples and cut into shards; in each, a BM25 index over
    token pairs ranks the unused documents for each seed (longest first), which fill the seed's
    window in order of score; where none fits whole, the best is cut. What remains of a shard at
    the end is cut into powers of two, which need no padding.

    A null text is empty and gives ``end_id`` alone. Rows with equal or null ids are separate
    documents; rows with one id share a window only where nothing else is left, so copies of a
    document do not stand side by side. Rows stay in Arrow batches: nothing grows with the size
    of a group, and a very long text is cut as it is encoded. An empty table gives no rows; other
    columns are ignored, so none can clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 32
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                rows = []
                for name, text in zip(part["id"], part["text"]):
                    ids = np.append(coder.encode(text if isinstance(text, str) else ""), np.uint32(end_id))
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        whole = len(piece) == window
                        rows.append((name, at, len(ids), sequence if whole else None, 0 if whole else _minhash(piece), piece.astype(coder.kind).tobytes()))
                        sequence += whole
                out = pd.DataFrame(rows, columns=["id", "start", "doc_tokens", "sequence_id", "near", "ids"])
                out["sequence_id"] = out["sequence_id"].astype("Int64")
                yield out.astype({"id": part["id"].dtype}) if len(out) else out

    schema = f"id {kind}, start long, doc_tokens long, sequence_id long, near long, ids binary"
    cuts = materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, schema), "packing-cuts")
    width = 2 if _vocabulary(tokenizer) <= 65536 else 4
    schema = f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [np.frombuffer(b, f"<u{width}") for b in pdf["ids"]]
            yield pdf.assign(length=[len(x) for x in ids], offset=0, ids=[x.astype("<u4").tobytes() for x in ids])[["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = (1 << 62) + (TaskContext.get().partitionId() << 32)
        for pdf in batches:
            for i in range(0, len(pdf), shard):
                part = pdf.iloc[i : i + shard]
                ids = [np.frombuffer(b, f"<u{width}") for b in part["ids"]]
                rows = fill_windows(ids, window, part["id"])
                at = np.array([r[0] for r in rows])
                picked = part.iloc[at]
                yield pd.DataFrame(
                    {
                        "id": picked["id"].array,
                        "start": picked["start"].to_numpy() + [r[1] for r in rows],
                        "length": [r[2] for r in rows],
                        "doc_tokens": picked["doc_tokens"].array,
                        "sequence_id": [sequence + r[3] for r in rows],
                        "offset": [r[4] for r in rows],
                        "ids": [ids[r[0]][r[1] : r[1] + r[2]].astype("<u4").tobytes() for r in rows],
                    }
                )
                sequence += 1 + max(r[3] for r in rows)

    whole = cuts.where("sequence_id is not null").mapInPandas(widen, schema)
    rest = cuts.where("sequence_id is null").repartitionByRange("near", "id", "start").sortWithinPartitions("near", "id", "start").mapInPandas(fill, schema)
    return whole.unionByName(rest).withColumnRenamed("id", id_col)


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _minhash(ids: np.ndarray) -> int:
    x = ids.astype(np.uint64)
    if len(x) > 2:
        x = x[:-2] << np.uint64(32) | x[1:-1] << np.uint64(16) ^ x[2:]
    return int(mix(x).min() >> np.uint64(1))


class Index:
    """BM25 postings of one shard: terms are pairs of neighbouring tokens."""

    def __init__(self, ids: list[np.ndarray], k1: float = 1.2, b: float = 0.75) -> None:
        terms = [np.unique(x[:-1].astype(np.uint64) << np.uint64(32) | x[1:].astype(np.uint64), return_counts=True) for x in ids]
        length = np.array([len(x) for x in ids], float)
        doc = np.repeat(np.arange(len(ids)), [len(t) for t, _ in terms])
        term, place = np.unique(np.concatenate([t for t, _ in terms]), return_inverse=True)
        count = np.concatenate([c for _, c in terms]).astype(float)
        found = np.bincount(place, minlength=len(term))
        norm = k1 * (1 - b + b * length / max(1.0, length.mean()))
        weight = np.log1p((len(ids) - found + 0.5) / (found + 0.5))[place] * count * (k1 + 1) / (count + norm[doc])
        order = np.argsort(place, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.concatenate(([0], np.cumsum(found)))
        shared = found[place] > 1
        ends = np.concatenate(([0], np.cumsum([len(t) for t, _ in terms])))
        self.terms = [place[a:z][shared[a:z]] for a, z in zip(ends[:-1], ends[1:])]
        self.n = len(ids)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the terms of ``seed``."""
        terms = self.terms[seed]
        start, count = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill_windows(ids: list[np.ndarray], window: int, names=None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover all ids of a shard.

    Documents of one name are kept out of each other's windows while there are others.
    """
    index = Index(ids)
    # Rows without a name are no copies of each other.
    named = np.arange(len(ids)) if names is None else np.where(pd.isna(names), -1 - np.arange(len(ids)), pd.factorize(np.asarray(names))[0])
    left, start = np.array([len(x) for x in ids]), np.zeros(len(ids), int)
    rows, sequence = [], 0
    for seed in np.argsort(-left, kind="stable"):
        if not left[seed]:
            continue
        pieces, room, ranked = [], window, None
        take = int(seed)
        while True:
            length = min(room, left[take])
            pieces.append((take, int(start[take]), int(length)))
            start[take] += length
            left[take] -= length
            room -= length
            if not room or not left.any():
                break
            if ranked is None:
                ranked = np.argsort(-index.scores(seed), kind="stable")
            unused = ranked[left[ranked] > 0]
            others = unused[~np.isin(named[unused], named[[p[0] for p in pieces]])]
            unused = others if len(others) else unused
            fits = left[unused] <= room
            take = int(unused[np.argmax(fits)])
        if room:
            sizes = [1 << i for i in range(window.bit_length()) if (window - room) >> i & 1][::-1]
        else:
            sizes = [window]
        offset = 0
        for doc, at, length in pieces:
            while length:
                part = min(length, sizes[0] - offset)
                rows.append((doc, at, part, sequence, offset))
                at, length, offset = at + part, length - part, offset + part
                if offset == sizes[0]:
                    sizes.pop(0)
                    sequence, offset = sequence + 1, 0
    return rows

