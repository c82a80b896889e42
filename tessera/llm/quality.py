"""A weak-label quality model: overlapping heuristic labellers, weighed by expectation-maximisation,
whose posterior labels train a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

#: Insults in English: fixed values, used with those found in labelled documents.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
JUNK = ("symbols", "repeats", "variety", "pipes", "runs", "capitals")
TOXIC = ("lexicon_a", "lexicon_b", "lexicon_twice", "lexicon_dense")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lexicon:
    """Words and, marked by a star, stems of four or five letters."""

    def __init__(self, terms: frozenset[str]) -> None:
        self.words = {t for t in terms if not t.endswith("*")}
        self.four = {t[:-1] for t in terms if t.endswith("*") and len(t) == 5}
        self.five = {t[:-1] for t in terms if t.endswith("*") and len(t) == 6}

    def has(self, word: str) -> bool:
        return word in self.words or word[:4] in self.four or word[:5] in self.five


class Shares:
    """What labellers and scorers measure of one whole text."""

    def __init__(self, text: str | None, lexicon: Lexicon) -> None:
        text = text if isinstance(text, str) else ""
        tokens, words = text.split(), words_of(text)
        n = self.n = len(tokens)
        self.solid = sum(map(len, tokens))
        self.letters, self.n_words = sum(map(len, words)), len(words)
        self.words = set(words)
        self.odd = sum(map(text.count, "$%&*#@^~|<>{}[]\\=+_")) / max(1, self.solid)
        self.same = sum(map(str.__eq__, tokens, tokens[1:])) / max(1, n - 1)
        self.variety = len(set(tokens)) / max(1, n)
        self.bars = tokens.count("|") / max(1, n)
        # Words that end in a doubled symbol; dots do not count.
        ends = Counter([t[-2:] for t in tokens if len(t) > 2])
        self.runs = sum(c for e, c in ends.items() if e[0] == e[1] != "." and not e[0].isalnum()) / max(1, n)
        small = text.lower()
        self.capitals = 0.0
        if len(small) == len(text):
            changed = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) != np.frombuffer(small.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.capitals = int(changed.sum()) / max(1, self.letters)
        bad = {w for w in self.words if lexicon.has(w)}
        self.hits = [w for w in words if w in bad] if bad else []

    @property
    def short(self) -> float:
        """Long texts repeat words: what variety is held against."""
        return min(1.0, 400 / max(1, self.n))


def votes(x: Shares) -> tuple[list[int], list[int]]:
    """What each labeller says: 1 for bad, 0 for good, -1 for nothing.

    Junk: share of symbols, repeated neighbours, variety of words, bars between words, words that
    end in a doubled symbol, capitals. Toxic: words of either half of the lexicon, at least two,
    one in 200 words.
    """
    if not x.n:
        return [1, -1, -1, -1, -1, -1], [0, 0, 0, 0]
    junk = [
        1 if x.odd > 0.08 or x.letters < 0.5 * x.solid else 0 if x.odd < 0.03 else -1,
        1 if x.same > 0.2 else 0 if x.same < 0.05 else -1,
        (1 if x.variety < 0.2 * x.short else 0 if x.variety > 0.3 * x.short else -1) if x.n >= 20 else -1,
        1 if x.bars > 0.15 else 0 if x.bars < 0.03 else -1,
        1 if x.runs > 0.3 else 0 if x.runs < 0.05 else -1,
        1 if x.capitals > 0.5 else 0 if x.capitals < 0.2 else -1,
    ]
    half = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % 2 for w in x.hits]
    none = -1 if x.hits else 0
    toxic = [1 if 0 in half else none, 1 if 1 in half else none, 1 if len(half) > 1 else none, 1 if half and len(half) * 200 >= x.n_words else 0]
    return junk, toxic


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior that each pattern of votes (rows; 1, 0 or -1) is bad.

    Labellers are independent given the class, each with its own rate of votes for bad and for
    nothing in either class. The start is a lean towards any vote for bad, which also settles
    which class is the bad one.
    """
    state = patterns + 1
    said = (patterns >= 0).sum(1)
    bad = np.where(said > 0, (patterns == 1).sum(1) / np.maximum(1, said), 0.05)
    bad = np.clip(np.where((patterns == 1).any(1), np.maximum(bad, 0.6), bad * 0.2), 0.01, 0.99)
    for _ in range(rounds):
        logs = []
        for part in (bad, 1 - bad):
            weight = part * counts
            log = np.full(len(patterns), np.log((weight.sum() + 1) / (counts.sum() + 2)))
            for j in range(patterns.shape[1]):
                rate = np.bincount(state[:, j], weight, 3) + 0.1
                log += np.log(rate / rate.sum())[state[:, j]]
            logs.append(log)
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))
        done = np.abs(new - bad).max() < 1e-6
        bad = new
        if done:
            break
    return bad


def features(x: Shares, bits: int) -> np.ndarray:
    """Distinct hashed features: words, steps of a few shares, hits of the lexicon."""
    marks = {"odd": x.odd, "same": x.same, "bars": x.bars, "runs": x.runs, "capitals": x.capitals / 4}
    names = [f"\x00{k}{min(9, int(v * 10))}" for k, v in marks.items()] + [f"\x00{k}+" for k, v in marks.items() if v > 0.05]
    names += [f"\x00variety{min(9, int(x.variety / x.short * 10))}"] + [f"\x00hits{i}" for i in (1, 2) if len(x.hits) >= i]
    hashed = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in (*names, *x.words)]
    return np.unique(np.array(hashed, np.uint32) >> np.uint32(32 - bits))


def train(rows: list[np.ndarray], label: np.ndarray, bits: int, rounds: int = 150, l2: float = 2e-4) -> np.ndarray:
    """Weights (bias last) of a logistic scorer, by gradient steps with adapted rates."""
    size = 1 << bits
    flat = np.concatenate([r.astype(np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    rare = np.bincount(flat, minlength=size) < 4
    scale = np.where(rare, 0.0, 1.0)
    weight, moved = np.zeros(size + 1), np.full(size + 1, 1e-8)
    share = np.clip(label.mean(), 0.02, 0.98) if len(label) else 0.5
    importance = np.where(label > 0.5, 0.5 / share, 0.5 / (1 - share))
    for _ in range(rounds):
        z = np.bincount(doc, weight[flat], len(rows)) + weight[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * importance / max(1, len(rows))
        gradient = np.append(np.bincount(flat, error[doc], size) * scale + l2 * weight[:-1], error.sum())
        moved += gradient**2
        weight -= 0.3 * gradient / np.sqrt(moved)
    return weight.astype(np.float32)


def toxic_lexicon(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> frozenset[str]:
    """Words and stems that mark toxic documents in a sample of at most ``most_labelled`` rows.

    A word, or its first four or five letters with a star, counts if it follows at least eight
    different words in toxic documents (copies of one document do not make it count) and 98% of
    its uses are in toxic documents. The lexicon goes to every task; it is bounded by the words of
    the sample. Without labels only :data:`INSULTS` are left.
    """
    named = labels.select(F.col(id_col).alias("id"), "toxic").where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    named = named.orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    # The sample's ids are at most most_labelled rows, so they go to the texts, not the texts to them.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(named), "id")
    words = texts.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
    words = materialize(words, "labelled-words")
    terms = F.explode(F.array("word", F.concat(F.substring("word", 1, 4), F.lit("*")), F.concat(F.substring("word", 1, 5), F.lit("*")))).alias("term")
    used = words.where("toxic = 1").select(F.explode(F.arrays_zip(F.col("words").alias("word"), F.concat(F.array(F.lit("")), "words").alias("before"))).alias("x")).where("x.word is not null")
    used = used.select(F.col("x.word").alias("word"), F.col("x.before").alias("before")).select(terms, "before").distinct().groupBy("term").count().where("count >= 8")
    uses = words.select("toxic", F.explode("words").alias("word")).select("toxic", terms).join(used.select("term"), "term", "left_semi")
    found = uses.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).where("bad >= 0.98 * n")
    return frozenset(INSULTS) | {r["term"] for r in found.collect()}


def classify(docs: DataFrame, labels: DataFrame, sample: int = 12_000, bits: int = 17, most_labelled: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` in a struct ``doc``, the id, scores ``junk`` and ``toxic``, ``keep``.

    Labellers vote on every whole text; the counts of each pattern of votes, at most 3^6 and 3^4
    rows, are all that expectation-maximisation needs. The two scorers learn the posteriors on
    about ``sample`` documents with the smallest id hashes (of which only hashed features reach
    the driver) and score every document; ``keep`` is false where either score is over one half.
    Labels help only to find words that mark toxicity, from a bounded sample.

    Null and empty texts are junk. Equal or null ids are separate documents, told apart by their
    texts where the sample is drawn; copies of one row that share a place in it are cut at
    twice ``sample``. A very long text is one row of its batch and read whole. An empty table
    gives no rows. Columns of ``docs`` stay inside the struct, so none can clash.
    """
    lexicon = Lexicon(toxic_lexicon(docs, labels, most_labelled, id_col=id_col, text_col=text_col))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [votes(Shares(t, lexicon)) for t in pdf["text"]]
            yield pd.DataFrame({"junk": [j for j, _ in both], "toxic": [t for _, t in both]})

    patterns = rows.select("text").mapInPandas(vote, "junk array<int>, toxic array<int>").groupBy("junk", "toxic").count().collect()
    posterior = {}
    for task in ("junk", "toxic"):
        counts: dict[tuple, int] = {}
        for r in patterns:
            counts[tuple(r[task])] = counts.get(tuple(r[task]), 0) + r["count"]
        keys = sorted(counts)
        bad = expectation_maximisation(np.array(keys), np.array([counts[k] for k in keys], float)) if keys else []
        posterior[task] = dict(zip(keys, bad))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shares = [Shares(t, lexicon) for t in pdf["text"]]
            both = [votes(x) for x in shares]
            yield pd.DataFrame(
                {
                    "place": pdf["place"],
                    "junk": [posterior["junk"][tuple(j)] for j, _ in both],
                    "toxic": [posterior["toxic"][tuple(t)] for _, t in both],
                    "features": [features(x, bits).astype(np.int32).tobytes() for x in shares],
                }
            )

    n = sum(r["count"] for r in patterns)
    part = max(1, n // sample)
    place = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.lit(11))
    # About ``sample`` rows, fewer than twice as many, or in order of place where copies share one.
    chosen = rows.select("text", place.alias("place")).where(F.pmod("place", F.lit(part)) == 0).mapInPandas(learn, "place long, junk double, toxic double, features binary")
    chosen = chosen.orderBy("place", "features").limit(2 * sample).toPandas()
    x = [np.frombuffer(b, np.int32) for b in chosen["features"]]
    weights = {task: train(x, chosen[task].to_numpy(float), bits) for task in ("junk", "toxic")}
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # two vectors of 2^bits numbers

    @F.pandas_udf("junk double, toxic double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for texts in batches:
            found = [features(Shares(t, lexicon), bits) for t in texts]
            out = {task: np.array([w[task][f].sum() + w[task][-1] for f in found]) for task in ("junk", "toxic")}
            yield pd.DataFrame({task: 1 / (1 + np.exp(-np.clip(v, -30, 30))) for task, v in out.items()})

    scored = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), score(docs[text_col]).alias("score"))
    return scored.select("doc", F.col(f"doc.{id_col}").alias(id_col), "score.junk", "score.toxic", ((F.col("score.junk") <= 0.5) & (F.col("score.toxic") <= 0.5)).alias("keep"))
