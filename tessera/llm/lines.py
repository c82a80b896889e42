"""Removal of lines similar to earlier ones, by an exact set-similarity join in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialize

#: Slots of the table of word counts. Its size is fixed; words that share a slot share a rarity.
SLOTS = 1 << 16
#: As many line numbers or pairs are sent to every executor (16 MB); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Each line of a family is held against so many of the earliest with one of its rare words before all pairs are made.
HEADS = 4
#: Lines may be of one family if they are apart by so many times what similar ones may be.
KIN = 2
#: Bits of a token below its rarity.
LOW = 56


def _split(line: Column) -> Column:
    # Translating costs far more than looking for the rare characters to translate.
    odd = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    return F.split(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line), " ")


def line_words(line: Column) -> Column:
    """Distinct words of a line: runs of characters other than space and 0x09 to 0x0D."""
    return F.array_remove(F.array_distinct(_split(line)), "")


def has_words(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_key(line: Column) -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64(line).alias("key"), F.xxhash64(F.lit("second"), line).alias("key2")]


def rarity_table(lines: DataFrame) -> Column:
    """For each of the slots, twice the binary logarithm of how often all of ``line`` uses it.

    The words of all lines are counted in Spark by slot; the counts' logarithms become a constant.
    """
    slots = lines.select(F.explode(_split(F.col("line"))).alias("word")).select(F.xxhash64("word").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))
    counted = slots.groupBy("slot").agg(F.floor(2 * F.log2(F.count(F.lit(1)))).cast("int").alias("rarity")).collect()
    known = {r["slot"]: r["rarity"] for r in counted}
    return F.from_json(F.lit(str([known.get(i, 0) for i in range(SLOTS)])), "array<bigint>")


def tokenised(lines: DataFrame, table: Column, threshold: float) -> DataFrame:
    """``lines`` with ``n`` (distinct words), ``sketch`` and ``sketchb``, ``prefix`` and ``ends``.

    A token is a word's rarity above 56 bits of its hash, so tokens in order are words by rarity.
    ``prefix`` holds the first n - ceil(threshold * n) + 1 of them. The sketches are 128 parities
    of the words: each word that only one of two lines has flips one of them. ``ends`` are two
    hashes, of the two smallest and of the two largest word hashes.
    """
    empty = F.xxhash64(F.lit(""))
    hashes = F.sort_array(F.array_distinct(F.transform(_split(F.col("line")), lambda w: F.xxhash64(w))))
    hashed = lines.withColumn("hashes", F.array_remove(hashes, empty))
    low = F.lit((1 << LOW) - 1)
    token = lambda h: F.shiftleft(F.get(table, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")), LOW).bitwiseOR(h.bitwiseAND(low))
    n = F.size("hashes")
    one = F.lit(1).cast("long")
    # A word flips a bit of the one sketch or of the other, by one more bit of its hash.
    flip = lambda h, lane: F.call_function("shiftleft", F.shiftright(h, 6).bitwiseAND(one).bitwiseXOR(F.lit(1 - lane).cast("long")), h.bitwiseAND(F.lit(63)).cast("int"))
    parities = lambda lane: F.aggregate("hashes", F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(flip(h, lane)))
    keep = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    prefix = F.slice(F.sort_array(F.transform("hashes", token)), F.lit(1), keep)
    ends = F.array(F.xxhash64(F.slice("hashes", 1, 2)), F.xxhash64(F.slice("hashes", -F.least(n, F.lit(2)), F.lit(2))))
    return hashed.select("*", n.alias("n"), parities(0).alias("sketch"), parities(1).alias("sketchb"), prefix.alias("prefix"), ends.alias("ends")).drop("hashes")


def _earlier(a: str, b: str) -> Column:
    """Whether the place in columns ``owner, pos, no`` with prefix ``a`` is before that with ``b``."""
    owner, pos, no = (F.col(f"{a}{c}") for c in ("owner", "pos", "no"))
    owner2, pos2, no2 = (F.col(f"{b}{c}") for c in ("owner", "pos", "no"))
    return (owner < owner2) | ((owner == owner2) & ((pos < pos2) | ((pos == pos2) & (no < no2))))


def similar_lines(lines: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Which distinct lines are similar to an earlier one.

    ``lines`` has ``no``, a unique number, ``owner`` and ``pos``, the place of its first
    occurrence, ``line`` and the columns of :func:`tokenised`. Returns ``no`` of every line whose
    set of words has a Jaccard similarity of at least ``threshold`` with that of an earlier line;
    of two at one place, the one with the smaller number is earlier.

    Two similar lines share a word among the prefixes of both. Pairs that do, and that pass the
    length and positional filters and the one of the sketches, which differ in no more bits than
    the threshold allows words, are verified. The work goes in rounds, since one similar earlier
    line settles a line for good. The first compares each line with the earliest line that has one
    of its two ``ends``, so members of a large group of near copies meet one line and not each
    other. The second takes those that are apart from that line by up to :data:`KIN` times what
    similar lines may be, which most members of a family without a centre are, and compares each
    with the :data:`HEADS` earliest of them that have a word of its prefix. These two only settle
    lines early. The third joins the prefixes of all lines by word, the later side without settled
    lines, and verifies the likeliest pair of each line; the fourth, the other pairs of lines still open that
    wider sketches leave.
    """
    n, m = F.col("n"), F.col("m")
    apart = F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch2"))) + F.bit_count(F.col("sketchb").bitwiseXOR(F.col("sketchb2")))
    most = F.lit((1 - threshold) / (1 + threshold)) * (n + m)
    possible = (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - 1e-9) & (apart <= most + 1e-6)
    akin = apart <= KIN * most

    def hashed(line: Column) -> Column:
        return F.array_distinct(F.transform(_split(line), lambda w: F.when(w != "", F.xxhash64(w))))

    def verify(pairs: DataFrame) -> DataFrame:
        """The later lines of the pairs that are similar. A later text is sent once, an earlier one for each pair."""
        sent = F.broadcast(pairs) if pairs.count() <= MOST_BROADCAST else pairs
        late = lines.select(F.col("no").alias("later"), F.col("line").alias("a")).join(sent.select("later"), "later", "left_semi")
        early = lines.select(F.col("no").alias("earlier"), F.col("line").alias("b")).join(sent, "earlier")
        both = late.join(early.select("later", "b"), "later")
        # Blank pieces hash to null, which is no word.
        sets = [F.array_compact(hashed(F.col(c))) for c in "ab"]
        shared = F.size(F.array_intersect(*sets))
        # The test is aggregated before it filters, or Spark would work the sets out again for each use.
        tested = both.select("later", (shared >= F.lit(threshold) * (F.size(sets[0]) + F.size(sets[1]) - shared) - 1e-9).alias("similar"))
        return tested.groupBy(F.col("later").alias("no")).agg(F.max("similar").alias("similar")).where("similar").select("no")

    def sharper(pairs: DataFrame) -> DataFrame:
        """The pairs that sketches of 512 parities leave: those of 128 tell long lines apart badly.

        Only lines of these pairs are sketched again, and 80 bytes of each are sent, not its text.
        """
        ends = pairs.select(F.explode(F.array("later", "earlier")).alias("no")).distinct()
        few = ends.count() <= MOST_BROADCAST
        texts = lines.select("no", "line").join(F.broadcast(ends) if few else ends, "no", "left_semi")
        words = texts.select("no", F.explode(hashed(F.col("line"))).alias("h")).where("h is not null")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
        slot = F.shiftright("h", 6).bitwiseAND(F.lit(7))
        wide = words.groupBy("no").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.when(slot == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(8)])
        wide = materialize(wide, "line-sketches")
        sides = [wide.select(F.col("no").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("n", *[f"s{k}" for k in range(8)])]) for c in ("later", "earlier")]
        differ = sum((F.bit_count(F.col(f"later_s{k}").bitwiseXOR(F.col(f"earlier_s{k}"))) for k in range(8)), F.lit(0))
        left = pairs.join(sides[0], "later").join(sides[1], "earlier")
        return left.where(differ <= F.lit((1 - threshold) / (1 + threshold)) * (F.col("later_n") + F.col("earlier_n")) + 1e-6).select("later", "earlier")

    keyed = lines.select("no", "owner", "pos", "n", "sketch", "sketchb", F.explode(F.array_distinct("ends")).alias("end"))
    hubs = keyed.groupBy("end").agg(F.min(F.struct("owner", "pos", "no", "n", "sketch", "sketchb")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hubs = hubs.select("end", F.col("hub.no").alias("earlier"), F.col("hub.n").alias("m"), F.col("hub.sketch").alias("sketch2"), F.col("hub.sketchb").alias("sketchb2"))
    star = keyed.join(hubs, "end").where("earlier <> no").where(akin)
    star = materialize(star.select(F.col("no").alias("later"), "earlier", apart.alias("apart"), possible.alias("possible")), "line-kin")
    likely = star.where("possible").groupBy("later").agg(F.min_by("earlier", "apart").alias("earlier"))
    settled = materialize(verify(materialize(likely, "line-stars")), "lines-settled")

    kin = star.select(F.explode(F.array("later", "earlier")).alias("no")).distinct()
    kin = materialize(kin.join(settled.withColumn("done", F.lit(True)), "no", "left"), "line-kin-open")
    few = kin.count() <= MOST_BROADCAST
    kin = lines.select("no", "owner", "pos", "n", "sketch", "sketchb", "prefix").join(F.broadcast(kin) if few else kin, "no")
    kin = kin.select("no", "owner", "pos", "n", "sketch", "sketchb", F.col("done").isNull().alias("open"), F.explode("prefix").alias("token"))
    nth = F.row_number().over(Window.partitionBy("token").orderBy("owner", "pos", "no"))
    heads = kin.withColumn("nth", nth).where(F.col("nth") <= HEADS)
    heads = heads.select("token", *[F.col(c).alias(f"early_{c}") for c in ("no", "owner", "pos")], F.col("n").alias("m"), F.col("sketch").alias("sketch2"), F.col("sketchb").alias("sketchb2"))
    late = kin.where("open").select("token", *[F.col(c).alias(f"late_{c}") for c in ("no", "owner", "pos")], "n", "sketch", "sketchb")
    near = late.join(heads, "token").where(possible & _earlier("early_", "late_"))
    near = near.groupBy(F.col("late_no").alias("later")).agg(F.min_by("early_no", F.struct(apart, "early_no")).alias("earlier"))
    settled = settled.union(materialize(verify(materialize(near, "line-heads")), "lines-settled-by-heads"))

    few = settled.count() <= MOST_BROADCAST
    marked = settled.withColumn("settled", F.lit(True))
    flagged = lines.select("no", "owner", "pos", "n", "sketch", "sketchb", "prefix").join(F.broadcast(marked) if few else marked, "no", "left")
    # A settled line has a negative size, which fails the filter of lengths on the later side: told
    # apart there, not before the exchange, so that both sides of the join read one shuffle.
    size = F.when(F.isnull("settled"), n).otherwise(-n).alias("m")
    words = flagged.select("no", "owner", "pos", n, size, "sketch", "sketchb", F.posexplode("prefix").alias("at", "token"))
    # Columns that cannot be null keep Spark from adding a filter to one side alone.
    sure = {c: F.coalesce(c, F.lit(0)) for c in ("token", "m", "sketch", "sketchb")}
    words = words.withColumn("left", n - F.col("at")).withColumns(sure).select("token", "no", "owner", "pos", "m", "left", "sketch", "sketchb").repartition("token")
    early = words.select("token", *[F.col(c).alias(f"early_{c}") for c in ("no", "owner", "pos", "left")], F.abs("m").alias("n"), "sketch", "sketchb")
    late = words.select("token", *[F.col(c).alias(f"late_{c}") for c in ("no", "owner", "pos", "left")], "m", F.col("sketch").alias("sketch2"), F.col("sketchb").alias("sketchb2"))
    left = F.least("early_left", "late_left") >= F.lit(threshold / (1 + threshold)) * (n + m) - 1e-6
    met = early.join(late, "token").where(possible & left & _earlier("early_", "late_"))
    met = materialize(met.select(F.col("late_no").alias("later"), F.col("early_no").alias("earlier"), apart.alias("apart")), "line-pairs")
    likely = met.groupBy("later").agg(F.min_by("earlier", F.struct("apart", "earlier")).alias("earlier"))
    likely = materialize(likely, "line-likely")
    found = materialize(verify(likely), "lines-found")
    few = found.count() <= MOST_BROADCAST
    found_ids = found.select(F.col("no").alias("later"))
    rest = met.select("later", "earlier").join(F.broadcast(found_ids) if few else found_ids, "later", "left_anti").distinct().join(likely, ["later", "earlier"], "left_anti")
    rest = materialize(rest, "line-rest")
    return settled.union(found).union(verify(materialize(sharper(rest), "line-last")))


def remove_similar_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each line that is similar to an earlier one, in an earlier document or above it.

    Lines are parted by \\n. A line goes if its set of words has a Jaccard similarity of at least
    ``threshold`` with that of a line in a document with a smaller id, or further up in its own;
    lines are judged on the input, whether or not the earlier one stays. Equal lines are similar.
    Lines without words stay. Returns every column of ``docs`` in a struct ``doc``, the id,
    ``n_lines``, ``n_removed`` and ``kept_text`` (null for a null text, empty for an empty one).

    A null id is later than all others. Rows with equal ids are one document to each other: a
    line is not removed for standing in both, and the smaller of its positions counts. Copies of
    a line become one row before the join, so no group of copies meets in one task. Lines are
    identified by 128 bits of hash and a line's words by 64; the verification reads words. Work
    on a row is linear in its text, but for the sorting of its lines.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    text = F.col(f"doc.{text_col}")
    owner = F.coalesce(F.col(f"doc.{id_col}").cast("long"), F.lit(2**63 - 1)).alias("owner")
    rows = rows.select("doc", owner, F.xxhash64(text).alias("row"), F.xxhash64(F.lit("second"), text).alias("row2"))

    def parted(df: DataFrame) -> DataFrame:
        """``df`` with its text's lines. Called on either side of a join, for its exchange to move the text alone."""
        # A line without words gets its number behind a line end, so that array_distinct keeps it.
        apart = F.transform("lines", lambda line, i: F.when(has_words(line), line).otherwise(F.concat(line, F.lit("\n"), i)))
        df = df.withColumn("lines", F.split(text, "\n")).withColumn("repeats", F.size(F.array_distinct("lines")) < F.size("lines"))
        return df.withColumn("distinct", F.when(F.col("repeats"), F.array_distinct(apart)).otherwise(F.col("lines")))

    each = parted(rows).select("owner", "row", "row2", F.posexplode("distinct").alias("pos", "line")).where(has_words(F.col("line")) & ~F.col("line").contains("\n"))
    table = rarity_table(each.select("line"))

    keyed = each.select(*line_key(F.col("line")), "owner", "pos", "line")
    nth = F.row_number().over(Window.partitionBy("key", "key2").orderBy("owner", "pos"))
    first = keyed.withColumn("nth", nth).where("nth = 1").drop("nth")
    lines = tokenised(first, table, threshold).withColumn("no", F.monotonically_increasing_id())
    lines = materialize(lines, "lines")

    gone = materialize(similar_lines(lines, threshold), "lines-gone").withColumn("gone", F.lit(True))
    judged = lines.select("no", "key", "key2", F.col("owner").alias("first")).join(gone, "no", "left").drop("no")
    places = each.select(*line_key(F.col("line")), "owner", "row", "row2", "pos")
    removed = places.join(judged, ["key", "key2"]).where("gone or first < owner")
    names = {c: f"of_{c}" for c in ("owner", "row", "row2")}
    removed = removed.groupBy(*[F.col(c).alias(a) for c, a in names.items()]).agg(F.collect_set("pos").alias("removed"))
    # From here on places are all that is needed: the texts of the lines make room for the documents.
    removed = materialize(removed, "lines-removed")
    discard(lines)
    joined = parted(rows.join(removed, [F.col(c) == F.col(a) for c, a in names.items()], "left"))
    # Generated, since a caller's filter would otherwise be pushed below with the split inside its lambda, for each line.
    joined = joined.select("doc", "removed", F.explode(F.array(F.struct("lines", "repeats", "distinct"))).alias("parts")).select("doc", "removed", "parts.*")
    left = F.array_except(F.sequence(F.lit(0), F.size("distinct") - 1), F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.transform(left, lambda i: F.get("distinct", i))
    kept = F.when(F.col("repeats"), F.transform(kept, lambda line: F.substring_index(line, "\n", 1))).otherwise(kept)
    return joined.withColumn("kept", kept).select(
        "doc",
        F.col(f"doc.{id_col}").alias(id_col),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("lines").isNotNull(), F.array_join("kept", "\n")).alias("kept_text"),
    )
