"""Phrase collocations: id n-grams in fixed-width keys, range-partitioned, sorted and counted by runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialize

#: A-Z to a-z, tab to space, and what ends a piece to a byte that UTF-8 never holds.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
_U = np.uint64


def _tokens(text: bytes) -> list[bytes]:
    """Words of a folded text; an empty one stands for each end of a piece."""
    out: list[bytes] = []
    for piece in text.split(b"\xff"):
        # Not split(), which would also split at other controls.
        out += [w for w in piece.split(b" ") if w]
        out.append(b"")
    return out


def _portions(text: bytes, most: int) -> Iterator[bytes]:
    """A folded text in portions of at least ``most`` bytes, cut at ends of pieces."""
    at = 0
    while len(text) - at > most:
        cut = text.find(b"\xff", at + most)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 4 << 20) -> DataFrame:
    """Texts as blocks of one language each: ``words`` and ``counts`` of the block, and its ``codes``.

    A code is the place of a word in ``words``, or -1 at the end of a piece, as packed integers.
    A block is cut within a task when its language has ``block_bytes`` of text, or when all
    languages together have four times as much.
    """
    schema = "block long, lang string, words array<binary>, counts array<long>, codes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: dict[str, tuple[_Vocabulary, list, int]] = {}

        def emit(lang: str) -> pa.RecordBatch:
            nonlocal block
            words, parts, _ = held.pop(lang)
            codes = np.concatenate(parts)
            counts = np.bincount(codes[codes >= 0], minlength=len(words))[1:]
            values = [block, lang, list(words)[1:], counts, (codes - 1).astype(np.int32).tobytes()]
            block += 1
            types = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["block", "lang", "words", "counts", "codes"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, text = lang.as_py(), text.as_py()
                for portion in _portions(text.encode("utf-8", "surrogatepass").translate(_FOLD), block_bytes) if text else ():
                    words, parts, size = held.get(lang) or (_Vocabulary({b"": 0}), [], 0)
                    split = _tokens(portion)
                    parts.append(np.fromiter(map(words.__getitem__, split), np.int32, len(split)))
                    held[lang] = words, parts, size + len(portion) + 1
                    if held[lang][2] >= block_bytes:
                        yield emit(lang)
                if sum(size for _, _, size in held.values()) >= 4 * block_bytes:
                    for name in list(held):
                        yield emit(name)
        for name in list(held):
            yield emit(name)

    lang = F.coalesce(F.col(lang_col), F.lit("und")).alias("lang")
    return docs.select(lang, F.col(text_col).alias("text")).mapInArrow(cut, schema)


def dictionary(blocks: DataFrame, least: int) -> DataFrame:
    """Words that occur ``least`` times in their language, numbered from 1: ``id, lang, word, f``.

    Numbers follow the range partitions of language and word, so no task sees all words.
    """
    counted = blocks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n")))).groupBy("lang", "word").agg(F.sum("n").alias("f"))
    ranged = materialize(counted.where(F.col("f") >= least).repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").withColumn("at", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("at", 33)
    # A row for each partition of the table, at most.
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    return ranged.withColumn("part", part).join(F.broadcast(before), "part").select(number.alias("id"), "lang", "word", "f")


def _encoded(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Blocks as packed numbers of frequent words, 0 for any other word and for the end of a piece.

    A block asks for each of its words once, however often it holds it.
    """
    asked = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    known = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("known"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column(1)[i].as_py(), np.int32)
                known = batch.column(2)[i].values
                table = np.zeros(int(codes.max(initial=0)) + 2, np.uint32)
                if known is not None:
                    place, number = known.field(0).to_numpy(), known.field(1).to_numpy()
                    if len(number) and number.max() >= 1 << 32:
                        raise ValueError("more than 2^32 frequent words do not fit the keys")
                    table[place] = number
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([table[codes].tobytes()], pa.binary())], names=["block", "ids"])

    return blocks.select("block", "codes").join(known, "block").mapInArrow(encode, "block long, ids binary")


def _grouped(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of several columns, in order, with their counts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.diff(np.append(at, len(order)))


def _windows(encoded: DataFrame) -> DataFrame:
    """The two to four frequent words from each place on, counted in each block: ``hi, lo, n``.

    ``hi`` holds the first two numbers and ``lo`` the next two, 0 where a piece or a run of
    frequent words ends, so a window holds all phrases that begin at its place.
    """

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.append(np.frombuffer(batch.column(0)[i].as_py(), np.uint32), np.zeros(3, np.uint32)).astype(_U)
                at = np.flatnonzero((ids[:-3] > 0) & (ids[1:-2] > 0))
                third = ids[at + 2]
                fourth = np.where(third > 0, ids[at + 3], _U(0))
                (hi, lo), n = _grouped([(ids[at] << _U(32) | ids[at + 1]).view(np.int64), (third << _U(32) | fourth).view(np.int64)])
                for at in range(0, len(hi), 1 << 16):
                    to = at + (1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(hi[at:to]), pa.array(lo[at:to]), pa.array(n[at:to])], names=["hi", "lo", "n"])

    return encoded.select("ids").mapInArrow(window, "hi long, lo long, n long")


def _run_lengths(windows: DataFrame, least: int) -> DataFrame:
    """Counts of phrases of two to four words from sorted windows: ``hi, lo, f``.

    A phrase is a run of windows with equal first numbers: ``hi`` for two words, also the upper
    half of ``lo`` for three, all of it for four. Of the run that a batch leaves open only key and
    count are kept. The first and the last run of a partition may be parts of a longer one; they
    are passed on whatever their count, and sums over equal keys settle them.
    """
    masks = (0, ~((1 << 32) - 1), -1)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple | None] = [None] * 3
        first = [True] * 3

        def rows(hi, lo, f) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (hi, lo, f)], names=["hi", "lo", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, n = (batch.column(j).to_numpy() for j in range(3))
            for level, mask in enumerate(masks):
                key = lo & np.int64(mask)
                start = np.flatnonzero(np.append(True, (hi[1:] != hi[:-1]) | (key[1:] != key[:-1])))
                sums = np.add.reduceat(n, start)
                heads, tails = hi[start], key[start]
                if open_[level] is not None:
                    if open_[level][:2] == (heads[0], tails[0]):
                        sums[0] += open_[level][2]
                    else:
                        heads, tails, sums = (np.append(x, y) for x, y in zip(open_[level], (heads, tails, sums)))
                open_[level] = heads[-1], tails[-1], sums[-1]
                keep = sums[:-1] >= least
                if len(keep):
                    keep[0] |= first[level]
                    first[level] = False
                # A window whose last number is 0 is no phrase of that many words.
                keep &= level == 0 or (tails[:-1] & np.int64(0xFFFFFFFF if level == 2 else mask)) != 0
                yield rows(heads[:-1][keep], tails[:-1][keep], sums[:-1][keep])
        for level, last in enumerate(open_):
            if last is not None and (level == 0 or last[1] & np.int64(0xFFFFFFFF if level == 2 else masks[level])):
                yield rows([last[0]], [last[1]], [last[2]])

    partial = windows.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo").mapInArrow(runs, "hi long, lo long, f long")
    return partial.groupBy("hi", "lo").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrase_counts(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 4 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of one to four words that occur ``least`` times in their language.

    Returns the dictionary (``id, lang, word, f``), the phrases (``w1`` to ``w4`` as numbers, 0
    where there is no word, and ``f``) and each language's number of words (``lang, n``).
    """
    blocks = materialize(word_blocks(docs, text_col, lang_col, block_bytes), "phrase-blocks")
    totals = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    totals = materialize(totals, "phrase-totals")
    words = materialize(dictionary(blocks, least), "phrase-dictionary")
    encoded = materialize(_encoded(blocks, words), "phrase-ids")
    discard(blocks)
    windows = materialize(_windows(encoded), "phrase-windows")
    discard(encoded)
    low = (1 << 32) - 1
    upper = lambda c: F.shiftrightunsigned(c, 32)
    lower = lambda c: F.col(c).bitwiseAND(low)
    none = F.lit(0).cast("long")
    one = words.select(F.col("id").alias("w1"), none.alias("w2"), none.alias("w3"), none.alias("w4"), "f")
    more = _run_lengths(windows, least).select(upper("hi").alias("w1"), lower("hi").alias("w2"), upper("lo").alias("w3"), lower("lo").alias("w4"), "f")
    return words, materialize(one.unionByName(more), "phrase-counts"), totals


_W = ["w1", "w2", "w3", "w4"]


def _part(start: int, size: int) -> list[Column]:
    return [F.col(f"w{start + j}") if j < size else F.lit(0).cast("long") for j in range(4)]


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang", block_bytes: int = 4 << 20) -> DataFrame:
    """The ``top`` phrases of two to four words of each language (null: ``und``) by cohesion.

    Returns ``lang, rank, phrase, a, l, r, n, score``. Texts are cut into pieces at
    ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs, A-Z lower-cased; a phrase
    lies within a piece and occurs ``least`` times. Of its cuts into two parts the one with the
    lowest ``score``, floor(2000000 a / (l + r)), counts, then the shortest first part; ``l``
    and ``r`` are the parts' counts, ``n`` all words of the language. A phrase inside a longer one
    (kept or not) with four fifths of its count is dropped. Equal scores are ranked by count, then
    by phrase in byte order.

    No word of a frequent phrase is rarer than the phrase: texts are read as numbers of frequent
    words, and each place gives one window of up to four of them, which counts for all phrases
    that begin there. Windows are counted in blocks first, then sorted by range and counted by runs.

    A null or empty text has no words. Rows with equal or null ids are separate texts and repeated
    rows count again; no id is read. A very long text is cut at ends of pieces. An empty table
    gives no rows. Other columns are ignored, so none can clash.
    """
    words, counts, totals = phrase_counts(docs, least, text_col, lang_col, block_bytes)
    size = sum((F.col(c) > 0).cast("int") for c in _W)
    phrases = counts.withColumn("size", size).where("size >= 2").withColumnRenamed("f", "a")

    # Each cut asks for the counts of both its parts.
    cuts = [F.struct(F.lit(k).alias("k"), F.array(*_part(1, k)).alias("left"), F.array(*(F.col(f"w{k + 1 + j}") if k + 1 + j <= 4 else F.lit(0).cast("long") for j in range(4))).alias("right")) for k in (1, 2, 3)]
    cut = phrases.select(*_W, "a", "size", F.explode(F.filter(F.array(*cuts), lambda c: c["k"] < F.col("size"))).alias("cut"))
    part = counts.select(F.array(*_W).alias("part"), "f")
    sides = cut.select(*_W, "a", F.col("cut.k").alias("k"), F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("cut.left").alias("part")), F.struct(F.lit(False).alias("first"), F.col("cut.right").alias("part")))).alias("side")).select(*_W, "a", "k", "side.first", "side.part")
    both = sides.join(part, "part").groupBy(*_W, "a", "k").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    # The product may pass 64 bits.
    scored = both.withColumn("score", F.expr("cast(a as decimal(38, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)"))
    lowest = scored.groupBy(*_W, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = [F.struct(*[c.alias(f"v{j + 1}") for j, c in enumerate(_part(s, n))], F.lit(s + n - 1).alias("to"), F.lit(n).alias("size")) for n in (2, 3) for s in range(1, 5 - n + 1)]
    held = phrases.where("size >= 3").select(F.col("a").alias("longer"), F.explode(F.filter(F.array(*inside), lambda x: (x["to"] <= F.col("size")) & (x["size"] < F.col("size")))).alias("x"))
    most = held.groupBy(*[F.col(f"x.v{j}").alias(f"w{j}") for j in range(1, 5)]).agg(F.max("longer").alias("longer"))
    kept = lowest.join(most, _W, "left").where("longer is null or 100 * cast(longer as decimal(20, 0)) < 80 * cast(a as decimal(20, 0))")

    found = kept.select(*_W, "a", "cut.*").select(F.posexplode(F.filter(F.array(*_W), lambda w: w > 0)).alias("at", "id"), F.struct(*_W).alias("key"), "a", "l", "r", "score")
    named = found.join(words.select("id", "lang", F.decode("word", "utf-8").alias("word")), "id").groupBy("key", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = named.select("lang", "phrase", "a", "l", "r", "score").withColumn("rank", order).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
