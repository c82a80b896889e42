"""Ranked lexical search: exact best documents from dual-sorted wavelet trees, one for each shard."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Bytes of terms: digits, letters (A-Z lower-cased) and all beyond ASCII; the rest is space.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Most bytes of packed queries that are broadcast at once; more are asked in turns.
MOST_BROADCAST = 8 << 20


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shard_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 8192, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per shard: what an index over some thousand documents is built from.

    ``ids`` and ``lengths`` (terms with repeats) by document; ``words`` and ``found`` (documents
    that hold it) by term; ``sizes`` (different terms of each document), ``places`` and ``tf`` by
    posting, as packed integers. Documents stay where they were read: a shard is cut within a
    task, at ``shard_rows`` documents or ``shard_bytes`` of text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"ids array<{kind}>, n_docs long, n_terms long, words array<binary>, found array<int>, lengths binary, sizes binary, places binary, tf binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, ids, lengths, sizes, places, tf, words, size = None, [], [], [], [], [], _Vocabulary(), 0

        def shard() -> pa.RecordBatch:
            at = np.array(places, np.uint32)
            found = np.bincount(at, minlength=len(words)).astype(np.int32)
            values = [ids, sum(n > 0 for n in lengths), sum(lengths), list(words), found, np.array(lengths, np.int64).tobytes(), np.array(sizes, np.uint32).tobytes(), at.tobytes(), np.array(tf, np.uint32).tobytes()]
            types = [pa.list_(id_type), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["ids", "n_docs", "n_terms", "words", "found", "lengths", "sizes", "places", "tf"])

        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0), batch.column(1)):
                split = terms(text.as_py())
                if size and (len(ids) >= shard_rows or size + 8 * len(split) > shard_bytes):
                    yield shard()
                    ids, lengths, sizes, places, tf, words, size = [], [], [], [], [], _Vocabulary(), 0
                counts = Counter(split)
                ids.append(name.as_py())
                lengths.append(len(split))
                sizes.append(len(counts))
                places.extend(map(words.__getitem__, counts))
                tf.extend(counts.values())
                size += 8 * len(split) + 1
        if ids:
            yield shard()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


class WaveletTree:
    """Postings sorted twice: by term and falling impact, and down the levels by document.

    The root holds the documents of all posting lists, one list after the other, each by falling
    impact. A node sends its postings to the left or right half of its documents, in order, so
    that a list is one range in every node, and the first posting of the range has the largest
    impact that the list gives to any document of the node.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int) -> None:
        order = np.lexsort((doc, -impact, term))
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        doc, impact = doc[order].astype(np.uint16 if n_docs <= 1 << 16 else np.uint32), impact[order].astype(np.int32)
        self.levels = max(1, int(n_docs - 1).bit_length()) if n_docs else 1
        self.n = len(doc)
        upto = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=1 << self.levels)))) if self.n else np.zeros((1 << self.levels) + 1, np.int64)
        #: Where each node of each level begins.
        self.starts = [upto[:: 1 << (self.levels - level)].astype(np.int64) for level in range(self.levels + 1)]
        zeros, impacts = [], []
        for level in range(self.levels):
            shift = self.levels - 1 - level
            zeros.append(np.concatenate(([0], np.cumsum((doc >> shift) & 1 == 0, dtype=np.int32))))
            impacts.append(impact)
            down = np.argsort(doc >> shift, kind="stable")
            doc, impact = doc[down], impact[down]
        impacts.append(impact)
        # All levels in one array, so that nodes of different levels are opened together.
        self.zeros = np.concatenate(zeros).astype(np.int32)
        self.impacts = np.concatenate(impacts + [np.zeros(1, np.int32)])

    def bounds(self, level: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The most that any document of each node can score; for a single document, its score."""
        first = self.impacts[np.minimum(level[:, None] * self.n + low, len(self.impacts) - 1)]
        return np.where(low < high, first, 0).astype(np.int64) @ weight

    def search(self, place: np.ndarray, weight: np.ndarray, k: int, least: int = 1, wide: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the ``k`` largest sums of weight times impact, and these sums.

        Equal sums go to the smaller document. Only sums of ``least`` or more are looked for. The
        nodes with the largest bounds are opened first, some at a time, until none that is left
        can hold a better document.
        """
        level, node = np.zeros(1, np.int64), np.zeros(1, np.int64)
        low, high = self.first[place][None, :], self.first[place + 1][None, :]
        bound = self.bounds(level, low, high, weight)
        best_doc, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(node):
            # Of a node's documents the first is the smallest.
            smallest = node << (self.levels - level)
            if len(best) == k:
                alive = (bound > best[-1]) | (bound == best[-1]) & (smallest < best_doc[-1])
            else:
                alive = bound >= max(1, least)
            if not alive.all():
                level, node, low, high, bound, smallest = level[alive], node[alive], low[alive], high[alive], bound[alive], smallest[alive]
                if not len(node):
                    break
            order = np.lexsort((smallest, -bound))
            take, rest = order[:wide], order[wide:]
            at, up = level[take], node[take]
            base = at * (self.n + 1)
            begin = np.empty(len(take), np.int64)
            middle = np.empty(len(take), np.int64)
            for one in np.unique(at):
                mine = at == one
                begin[mine] = self.starts[one][up[mine]]
                middle[mine] = self.starts[one + 1][2 * up[mine] + 1]
            gone = self.zeros[base + begin].astype(np.int64)[:, None]
            left = [begin[:, None] + self.zeros[base[:, None] + x[take]] - gone for x in (low, high)]
            right = [middle[:, None] + (x[take] - begin[:, None]) - (self.zeros[base[:, None] + x[take]] - gone) for x in (low, high)]
            new_level, new_node = np.concatenate([at + 1, at + 1]), np.concatenate([2 * up, 2 * up + 1])
            new_low, new_high = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
            new_bound = self.bounds(new_level, new_low, new_high, weight)
            leaf = new_level == self.levels
            done = leaf & (new_bound >= max(1, least))
            if done.any():
                best_doc, best = np.concatenate([best_doc, new_node[done]]), np.concatenate([best, new_bound[done]])
                ranked = np.lexsort((best_doc, -best))[:k]
                best_doc, best = best_doc[ranked], best[ranked]
            more = ~leaf & (new_bound >= max(1, least))
            level, node, bound = np.concatenate([level[rest], new_level[more]]), np.concatenate([node[rest], new_node[more]]), np.concatenate([bound[rest], new_bound[more]])
            low, high = np.concatenate([low[rest], new_low[more]]), np.concatenate([high[rest], new_high[more]])
        return best_doc, best


def _tree(row: dict, total_docs: int, total_terms: int) -> tuple[WaveletTree, list, dict]:
    """The tree of one shard with documents numbered by id (null last), their ids, and the words' places."""
    ids, lengths = row["ids"], np.frombuffer(row["lengths"], np.int64)
    by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    number = np.empty(len(ids), np.int64)
    number[by_id] = np.arange(len(ids))
    place, tf = np.frombuffer(row["places"], np.uint32), np.frombuffer(row["tf"], np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), np.frombuffer(row["sizes"], np.uint32))
    m = 100 - 90 + np.array([90 * int(n) * total_docs // max(1, total_terms) for n in lengths], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[owner])
    words = {w: i for i, w in enumerate(row["words"])}
    return WaveletTree(place, number[owner], impact, len(words), len(ids)), [ids[i] for i in by_id], words


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_rows: int = 8192, shard_bytes: int = 8 << 20) -> DataFrame:
    """The ``k`` documents with the highest scores for each row of ``items``, exactly.

    Returns the item's id, ``rank`` from 1, the document's id and ``score``. A term is a maximal
    run of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A score sums,
    over the item's different terms, weight (from the share of all documents that hold the term)
    times impact (from its occurrences in the document and the document's length). Equal scores
    are ranked by id, null ids last.

    Documents are indexed in shards where they are read; counts of documents and terms cover all
    of them. The queries, packed, are broadcast in pieces of at most ``MOST_BROADCAST`` bytes; a
    shard's tree is built once for each piece, and a task carries its best scores from shard to
    shard, so that later ones open fewer nodes.

    A null text has no terms; a document without terms is not counted and never found, an item
    without terms gives no rows. Items of one id, or null, are answered one by one, repeated rows
    of ``docs`` rank side by side, and an empty table on either side gives no rows. A very long
    text is a shard of its own. Other columns are ignored, so none can clash.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    shards = materialize(shard_postings(docs, id_col, text_col, shard_rows, shard_bytes), "search-postings")
    totals = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("all_docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("all_terms"))

    asked = materialize(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()), "search-items")
    split = F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_PATTERN), F.lit(0)))
    wanted = asked.select("row", F.explode(F.transform(split, lambda w: w.cast("binary"))).alias("word"))
    held = shards.select(F.inline(F.arrays_zip(F.col("words").alias("word"), "found"))).join(wanted.select("word").distinct(), "word").groupBy("word").agg(F.sum("found").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.col("all_docs") + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = wanted.join(held, "word").crossJoin(F.broadcast(totals)).select("row", "word", weight.alias("weight"))
    queries = materialize(weighed.where("weight > 0").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("terms")), "search-queries")
    size = queries.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + 16 + F.octet_length(t["word"])))).first()[0] or 0
    pieces = max(1, -(-size // MOST_BROADCAST))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, best = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names) if name != "queries" or asking is None}
                if asking is None:
                    asking = [(q["row"], [t["word"] for t in q["terms"]], np.array([t["weight"] for t in q["terms"]], np.int64)) for q in row["queries"]]
                tree, ids, places = _tree(row, row["all_docs"], row["all_terms"])
                for name, words, weights in asking:
                    here = [j for j, w in enumerate(words) if w in places]
                    if not here:
                        continue
                    mine = best.get(name, [])
                    # A document of equal score may have the smaller id, so it is looked for too.
                    found, scores = tree.search(np.array([places[words[j]] for j in here]), weights[here], k, mine[-1][2] if len(mine) == k else 1)
                    if len(found):
                        mine = mine + [(ids[d] is None, ids[d], int(s)) for d, s in zip(found, scores)]
                        best[name] = sorted(mine, key=lambda x: (-x[2], x[0], 0 if x[0] else x[1]))[:k]
        rows = [(name, doc, score) for name, found in best.items() for _, doc, score in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], names=["row", "id", "score"])

    id_type = _arrow_type(docs, id_col)
    found = None
    for piece in range(pieces):
        packed = queries.where(F.pmod(F.xxhash64("row"), F.lit(pieces)) == piece).agg(F.collect_list(F.struct("row", "terms")).alias("queries")).where(F.size("queries") > 0)
        part = shards.drop("n_docs", "n_terms", "found").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(packed)).mapInArrow(search, f"row long, id {kind}, score long")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    top = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(asked.select("row", "item"), "row").select(F.col("item").cast(item_kind).alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
