"""Removal of word passages that repeat across documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import Words, double, sliding_argmin, steps

#: Bytes of text that one block of documents and one bucket of hashes stand for.
BLOCK_BYTES, BUCKET_BYTES = 1_500_000, 16_000_000


def remove_repeats(docs: DataFrame, window: int = 13, shortest: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of words that also starts in an earlier document.

    A window is ``window`` consecutive words of one text; it goes if the same sequence of words
    starts in a document with a smaller id. Windows are judged on the input. Returns the id,
    ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    Levels double: windows of ``shortest`` words (each longer window is represented by the one
    in it with the smallest hash) that occur in one document alone end there; only those that
    repeat are extended to twice the length, at last to ``window``. At each level a block of
    documents sends every distinct hash once, packed by hash bucket, and gets one bit back for
    each, so a passage in a third of all documents costs one hash for each block.

    Null or empty texts have no words. Rows with a null id keep every word and count as no one's
    earlier document; rows with equal ids are no earlier than each other. Other columns are
    ignored. Windows are compared by 96 bits of hash.
    """
    if not 1 <= shortest <= window:
        raise ValueError("shortest must be between 1 and window")
    levels = [n for n in steps(window) if n >= shortest] or [window]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(8, size // BLOCK_BYTES), int(max(12, size // BUCKET_BYTES))
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(int(blocks))))
    schema = "block long, level int, bucket int, hashes binary, lane binary, owner binary, ids binary"
    replies = None
    for level in range(len(levels)):
        last = level == len(levels) - 1

        if replies is None:
            sent = rows.groupBy("block").applyInPandas(_first_sender(levels, buckets), schema)
        else:
            sent = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(_sender(levels, level, buckets), schema)
        reply = sent.groupBy("level", "bucket").applyInPandas(_judge_owners if last else _judge_repeats, "block long, level int, bucket int, bits binary")
        replies = reply if replies is None else replies.unionByName(reply)
    return (
        rows.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInPandas(_cutter(levels, buckets), "doc_id long, n_words long, n_removed long, kept_text string")
        .withColumnRenamed("doc_id", id_col)
    )


def _first_sender(levels: list[int], buckets: int):
    def send(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _Block(pdf, levels).send(0, None, key[0], buckets)

    return send


def _sender(levels: list[int], level: int, buckets: int):
    def send(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _Block(pdf, levels).send(level, answers, key[0], buckets)

    return send


def _cutter(levels: list[int], buckets: int):
    def cut(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return _Block(pdf, levels).cut(answers, buckets)

    return cut


class _Block:
    """The windows of one block of documents, narrowed level by level."""

    def __init__(self, pdf: pd.DataFrame, levels: list[int]) -> None:
        self.pdf, self.levels, self.window = pdf.reset_index(drop=True), levels, levels[-1]
        self.words = Words(self.pdf["text"])
        valid = self.pdf["doc_id"].notna().to_numpy()
        self.ids = self.pdf["doc_id"].fillna(0).to_numpy(np.int64)
        first, text = self.words.first, self.words.text
        n = max(0, len(text) - self.window + 1)
        self.open = (text[:n] == text[self.window - 1 : self.window - 1 + n]) & valid[text[:n]] if n else np.zeros(0, bool)
        self.hash, self.lane = {}, None
        value, lane = self.words.hashes(), self.words.hashes(second=True)
        at = 1
        for longer in steps(self.window):
            if longer > 1:
                value, lane = double(value, at, longer), double(lane, at, longer, 1)
            at = longer
            self.hash[at] = value
        self.lane = (lane >> np.uint64(32)).astype(np.uint32)
        assert first[-1] == len(text)

    def anchors(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Open windows, and for each the position of the shorter window that stands for it."""
        length = self.levels[level]
        at = np.flatnonzero(self.open)
        if length == self.window:
            return at, at
        return at, sliding_argmin(self.hash[length], self.window - length + 1)[at] if len(at) else at

    def distinct(self, level: int):
        """Open windows' hashes: sorted and distinct, the place of each window, its document."""
        at, anchor = self.anchors(level)
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        value, index, place = np.unique(self.hash[self.levels[level]][anchor], return_index=True, return_inverse=True)
        return at, value, anchor[index], place

    def narrow(self, level: int, answers: pd.DataFrame | None, buckets: int) -> None:
        at, value, _, place = self.distinct(level)
        known = self.repeated_here(at, len(value), place) | self.bits(level, value, answers, buckets)
        self.open[at[~known[place]]] = False

    def repeated_here(self, at, n, place) -> np.ndarray:
        """Which distinct hashes occur in two documents of this block."""
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        owner = self.ids[self.words.text[at]] if len(at) else np.zeros(0, np.int64)
        np.minimum.at(low, place, owner)
        np.maximum.at(high, place, owner)
        self.low, self.owner = low, owner
        return low < high

    def bits(self, level, value, answers, buckets) -> np.ndarray:
        out = np.zeros(len(value), bool)
        mine = answers[answers["level"] == level] if answers is not None else ()
        if len(mine):
            where_of = _by_bucket(value, buckets)
            for b, packed in zip(mine["bucket"], mine["bits"]):
                where = where_of(b)
                out[where] = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(where)).astype(bool)
        return out

    def send(self, level: int, answers, block: int, buckets: int) -> pd.DataFrame:
        for earlier in range(level):
            self.narrow(earlier, answers, buckets)
        at, value, position, place = self.distinct(level)
        where_of = _by_bucket(value, buckets)
        last = level == len(self.levels) - 1
        if last:
            self.repeated_here(at, len(value), place)
            ids = np.unique(self.low)
            who = np.searchsorted(ids, self.low).astype(np.uint32)
        out = []
        for b in where_of():
            where = where_of(b)
            row = [block, level, int(b), value[where].tobytes()]
            out.append(row + ([self.lane[position[where]].tobytes(), who[where].tobytes(), ids.tobytes()] if last else [None, None, None]))
        return pd.DataFrame(out, columns=["block", "level", "bucket", "hashes", "lane", "owner", "ids"])

    def cut(self, answers, buckets: int) -> pd.DataFrame:
        last = len(self.levels) - 1
        for level in range(last):
            self.narrow(level, answers, buckets)
        at, value, _, place = self.distinct(last)
        self.repeated_here(at, len(value), place)
        elsewhere = self.bits(last, value, answers, buckets)
        gone = elsewhere[place] | (self.low[place] < self.owner) if len(at) else np.zeros(0, bool)
        words = self.words
        edge = np.zeros(len(words.text) + 1, np.int32)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + self.window, -1)
        dropped = np.cumsum(edge[:-1]) > 0
        counts = np.add.reduceat(np.append(dropped, False), words.first[:-1]) * (np.diff(words.first) > 0) if len(self.pdf) else np.zeros(0, int)
        texts = []
        for i in range(len(self.pdf)):
            lo, hi = words.first[i], words.first[i + 1]
            if hi == lo:
                texts.append("")
            elif not counts[i]:
                texts.append(b" ".join(words.bytes[words.start[lo] : words.end[hi - 1]].split()).decode("utf-8", "surrogatepass"))
            else:
                keep = np.flatnonzero(~dropped[lo:hi]) + lo
                texts.append(b" ".join([words.word(k) for k in keep]).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"doc_id": self.pdf["doc_id"].astype("Int64"), "n_words": np.diff(words.first), "n_removed": counts, "kept_text": texts})


def _by_bucket(value: np.ndarray, buckets: int):
    """A function from bucket to the places of its hashes, in order; without one, all buckets met."""
    bucket = (value % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    met, first = np.unique(bucket[order], return_index=True)
    last = np.append(first[1:], len(order))
    at = {int(b): order[i:j] for b, i, j in zip(met, first, last)}
    return lambda b=None: list(at) if b is None else at.get(int(b), order[:0])


def _runs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a bucket and the row that sent each."""
    parts = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _answer(pdf: pd.DataFrame, sender: np.ndarray, yes: np.ndarray) -> pd.DataFrame:
    ends = np.searchsorted(sender, np.arange(len(pdf) + 1))
    bits = [np.packbits(yes[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
    return pd.DataFrame({"block": pdf["block"], "level": pdf["level"], "bucket": pdf["bucket"], "bits": bits})


def _judge_repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each hash, whether two blocks sent it."""
    value, sender = _runs(pdf)
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    same = np.zeros(len(value) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    yes = np.zeros(len(value), bool)
    yes[order] = same[1:] | same[:-1]
    return _answer(pdf, sender, yes)


def _judge_owners(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each hash, whether another block has it in a document with a smaller id."""
    value, sender = _runs(pdf)
    lane = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["lane"]])
    owner = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(w, np.uint32)] for i, w in zip(pdf["ids"], pdf["owner"])])
    order = np.lexsort((owner, lane, value))
    ranked, lanes = value[order], lane[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (ranked[1:] != ranked[:-1]) | (lanes[1:] != lanes[:-1])
    least = owner[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    yes = np.zeros(len(value), bool)
    yes[order] = least < owner[order]
    return _answer(pdf, sender, yes)
