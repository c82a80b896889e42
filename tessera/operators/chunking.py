"""Chunks of whole texts: by separators with overlap, by marked sections, by paragraphs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType

#: Separators from coarse to fine, fixed values.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ": ", ", ", " ", "")
#: Fields whose text is chunked, in order: fixed values.
TEXT_FIELDS = ("title", "content", "ocr_text", "summary", "description")
#: Fields that a chunk keeps of its document: fixed values.
METADATA_FIELDS = (
    "title", "name", "document_title", "date", "year", "document_date", "source", "archive", "collection", "document_type", "type",
    "author", "creator", "location", "place", "filename", "file_path",
)
#: Labels that begin a section of a printed report, by kind: fixed values.
MARKERS = {
    "header": r"(?:Employee Name|Date of Injury|Location|Department|Division):",
    "injury": r"(?:Injury Description|Nature of Injury|How Injured):",
    "treatment": r"(?:Medical Treatment|Doctor|Hospital|Treatment):",
    "witness": r"(?:Witness|Statement|Testimony):",
    "disposition": r"(?:Disposition|Outcome|Compensation|Claim):",
}
_SPACE = r"[\s\x1c-\x1f]"


def quarter(text: str) -> int:
    """About how many tokens a text has."""
    return len(text) // 4


def _pieces(text: str, begin: int, end: int, finest: int, separators: tuple[str, ...]) -> tuple[list[tuple[int, int]], int]:
    """A stretch of a text cut before each occurrence of the first separator that it holds, from
    ``finest`` on, and the number of the separator after that one."""
    for number in range(finest, len(separators)):
        mark = separators[number]
        if not mark:
            return [(i, i + 1) for i in range(begin, end)], len(separators)
        at = text.find(mark, begin, end)
        if at >= 0:
            cuts = [begin]
            while at >= 0:
                cuts.append(at)
                at = text.find(mark, at + len(mark), end)
            return [(a, z) for a, z in zip(cuts, [*cuts[1:], end]) if a < z], number + 1
    return [(begin, end)], len(separators)


def split_at_separators(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS, measure: Callable[[str], int] = quarter) -> list[str]:
    """Chunks of at most ``size`` by ``measure`` that begin with what ended the chunk before.

    A stretch is cut before each occurrence of the coarsest separator that it holds. Neighbouring
    pieces under ``size`` are joined while they fit; the next chunk repeats last pieces of up to
    ``overlap``. Larger pieces are cut by finer separators, and a piece that none cuts is a chunk
    whatever its size. White space around a chunk goes, and so do chunks of nothing else.
    """
    out: list[str] = []

    def join(small: list[tuple[int, int]]) -> None:
        held: deque[tuple[int, int, int]] = deque()
        total = 0

        def write() -> None:
            chunk = text[held[0][0] : held[-1][1]].strip()
            if chunk:
                out.append(chunk)

        for a, z in small:
            n = measure(text[a:z])
            if held and total + n > size:
                write()
                while total > overlap or total and total + n > size:
                    total -= held.popleft()[2]
            held.append((a, z, n))
            total += n
        if held:
            write()

    def cut(begin: int, end: int, finest: int) -> None:
        pieces, finer = _pieces(text, begin, end, finest, separators)
        small: list[tuple[int, int]] = []
        for a, z in pieces:
            if measure(text[a:z]) < size:
                small.append((a, z))
                continue
            join(small)
            small = []
            if finer < len(separators):
                cut(a, z, finer)
            else:
                out.append(text[a:z])
        join(small)

    if text:
        cut(0, len(text), 0)
    return out


def join_paragraphs(text: str, most: int = 2000) -> list[str]:
    """Paragraphs, between blank lines, joined in order while a block stays within ``most`` characters.

    Each paragraph counts two more for what joins it, but for the first after a full block. A
    longer paragraph is a block of its own; a text without paragraphs is one block.
    """
    blocks: list[list[str]] = []
    used = 0
    for paragraph in (p.strip() for p in _between_blank_lines(text)):
        if not paragraph:
            continue
        if not blocks:
            blocks, used = [[paragraph]], len(paragraph) + 2
        elif used + len(paragraph) + 2 > most:
            blocks.append([paragraph])
            used = len(paragraph)
        else:
            blocks[-1].append(paragraph)
            used += len(paragraph) + 2
    return ["\n\n".join(b) for b in blocks] or [text]


def _between_blank_lines(text: str) -> Iterator[str]:
    at = 0
    while (end := text.find("\n\n", at)) >= 0:
        yield text[at:end]
        at = end + 2
        while text.startswith("\n", at):
            at += 1
    yield text[at:]


#: Texts that are cut at once: what a batch holds beyond them is not unpacked yet, or packed already.
TEXTS_AT_ONCE = 64


def _packed(texts: pa.Array, split: Callable[[str], list[str]]) -> Iterator[pa.Array]:
    """The pieces of a batch of texts, a few texts at a time."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        yield pa.array([None if t is None else split(t) for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()], pa.list_(pa.string()))


def _texts_udf(split: Callable[[str], list[str]]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from _packed(texts, split)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<string>")


def paragraphs(text: Column, most: int = 2000) -> Column:
    """The blocks of :func:`join_paragraphs` as an array."""
    return _texts_udf(lambda t: join_paragraphs(t, most))(text)


def strip(text: Column) -> Column:
    """A text without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}++|(?<!{_SPACE}){_SPACE}++\z", "")


def combined_text(docs: DataFrame, fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """The fields that a table has, as one text with a blank line between: lists joined by spaces,
    values of maps and structs too; null and empty fields are left out."""
    parts = []
    for name in fields:
        if name not in docs.columns:
            continue
        kind = docs.schema[name].dataType
        column = F.col(name)
        if isinstance(kind, ArrayType):
            column = F.array_join(F.transform(column, lambda x: x.cast("string")), " ", "None")
        elif kind.typeName() == "map":
            column = F.array_join(F.transform(F.map_values(column), lambda x: x.cast("string")), " ", "None")
        elif kind.typeName() == "struct":
            column = F.concat_ws(" ", *[F.coalesce(column[f].cast("string"), F.lit("None")) for f in kind.fieldNames()])
        elif not isinstance(kind, StringType):
            continue
        parts.append(F.nullif(column, F.lit("")))
    return strip(F.concat_ws("\n\n", *parts)) if parts else F.lit("")


def chunk_metadata(docs: DataFrame, fields: tuple[str, ...] = METADATA_FIELDS) -> Column:
    """Whitelisted fields as a map of strings: a list of one as that value, a longer one as JSON of its first ten."""
    entries = []
    for name in fields:
        if name not in docs.columns:
            continue
        kind, column = docs.schema[name].dataType, F.col(name)
        if isinstance(kind, ArrayType):
            value = F.when(F.size(column) == 1, column[0].cast("string")).when(F.size(column) > 1, F.to_json(F.slice(column, 1, 10)))
        elif isinstance(kind, (StringType, NumericType)) or kind.typeName() == "boolean":
            value = column.cast("string")
        else:
            continue
        entries.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
    if "extracted_entities" in docs.columns:
        names = F.filter(F.transform("extracted_entities", lambda e: e["text"]), lambda t: t.isNotNull())
        entries.append(F.struct(F.lit("entities").alias("key"), F.when(F.size(names) > 0, F.to_json(F.slice(names, 1, 10))).alias("value")))
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def separator_chunks(docs: DataFrame, text: Column, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS, measure: Callable[[str], int] = quarter, id_col: str = "doc_id", metadata: Column | None = None) -> DataFrame:
    """Chunks of ``text`` by :func:`split_at_separators`, one row each.

    ``chunk_id`` (document and index), the id, ``chunk_index``, ``text``, ``token_count`` (a
    quarter of the characters), and the ``overlap`` characters before and after it; null at the
    ends. A document without text has no rows.
    """
    rows = docs.select(F.col(id_col), _texts_udf(lambda t: split_at_separators(t, size, overlap, separators, measure))(text).alias("parts"), (F.create_map().cast("map<string,string>") if metadata is None else metadata).alias("metadata"))
    each = rows.select(id_col, "parts", "metadata", F.posexplode("parts").alias("chunk_index", "text"))
    before, after = F.get("parts", F.col("chunk_index") - 1), F.get("parts", F.col("chunk_index") + 1)
    last = F.when(F.char_length(before) > overlap, F.right(before, F.lit(overlap))).otherwise(before)
    return each.select(
        F.format_string("%s_chunk_%03d", F.coalesce(F.col(id_col).cast("string"), F.lit("unknown")), "chunk_index").alias("chunk_id"), id_col, "chunk_index", "text",
        F.floor(F.char_length("text") / 4).alias("token_count"), "metadata",
        *([last.alias("overlap_previous"), F.substring(after, 1, overlap).alias("overlap_next")] if overlap > 0 else [F.lit(None).cast("string").alias("overlap_previous"), F.lit(None).cast("string").alias("overlap_next")]),
    )


def marked_sections(text: Column) -> Column:
    """Sections of a report, each from one marker to the next, as an array of ``kind, text``.

    What stands before the first marker is in none. The array is empty without markers.
    """
    # "Treatment:" within "Medical Treatment:" is no marker of its own.
    every = "|".join(MARKERS.values()).replace("|Treatment)", "|(?<!Medical )Treatment)")
    def kind(part: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(MARKERS.items()):
            out = F.when(part.rlike(r"(?iu)\A" + pattern), name).otherwise(out)
        return out

    parts = F.split(text, f"(?iu)(?={every})")
    sections = F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), strip(p).alias("text")))
    return F.filter(sections, lambda s: s["kind"].isNotNull() & (s["text"] != ""))


def looks_like_table(text: Column) -> Column:
    """Six bars or tabs, or a line of hyphens or equal signs."""
    held = lambda c: F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))
    return (held("|") >= 6) | (held("\t") >= 6) | text.rlike(rf"(?U)\n{_SPACE}*[-=]{{3,}}{_SPACE}*\n")


def semantic_blocks(docs: DataFrame, text: Column, kind: Column | None = None, most_chars: int = 2000, most_blocks: int = 12, fallback: str = "separators", chunk_size: int = 1200, chunk_overlap: int = 150, id_col: str = "doc_id") -> DataFrame:
    """Logical blocks of each document: ``block_id``, the id, ``block_index``, ``block_type`` and ``text``.

    A table is one block; a report (by ``kind`` or its markers) is cut into its sections, a short
    text is one block, and a long one is cut by ``fallback``: ``separators`` or ``paragraphs``.
    Blocks lose white space around them and what is beyond ``most_chars``; of more than
    ``most_blocks`` the last ones are merged into one, cut in the same way. Only long texts go
    through Python. A null or blank text has no rows.
    """
    body = F.when(text.rlike(r"(?U)[^\s\x1c-\x1f]"), text)
    rows = docs.select(F.col(id_col), body.alias("__text"), (F.lit("") if kind is None else F.lower(F.coalesce(kind, F.lit("")))).alias("__kind")).where("__text is not null")
    sections = marked_sections(F.col("__text"))
    table = looks_like_table(F.col("__text"))
    rows = rows.withColumns({"__table": table, "__sections": F.when(~table, sections)})
    marked = F.size("__sections") > 0
    whole = lambda name: F.array(F.struct(F.lit(name).alias("kind"), F.col("__text").alias("text")))
    long = ~F.col("__table") & ~marked & ~F.contains("__kind", F.lit("injury")) & (F.char_length("__text") > most_chars)
    cut = _texts_udf((lambda t: split_at_separators(t, chunk_size, chunk_overlap)) if fallback == "separators" else (lambda t: join_paragraphs(t, most_chars)))
    rows = rows.withColumn("__parts", cut(F.when(long, F.col("__text"))))
    segments = F.transform("__parts", lambda p: F.struct(F.lit("segment").alias("kind"), p.alias("text")))
    chosen = F.when(F.col("__table"), whole("table")).when(marked, F.col("__sections")).when(long, segments).otherwise(whole("full_document"))
    short = lambda t: F.substring(strip(t), 1, most_chars)
    rows = rows.select(id_col, F.transform(chosen, lambda b: F.struct(b["kind"].alias("kind"), short(b["text"]).alias("text"))).alias("__blocks"))
    kept = max(0, most_blocks - 1)
    rest = F.slice("__blocks", kept + 1, F.greatest(F.size("__blocks") - kept, F.lit(0)))
    merged = F.struct(F.lit("merged").alias("kind"), short(F.array_join(F.transform(rest, lambda b: b["text"]), "\n\n")).alias("text"))
    first = F.slice("__blocks", 1, kept) if kept else F.filter("__blocks", lambda _: F.lit(False))
    capped = F.when(F.size("__blocks") <= most_blocks, F.col("__blocks")).otherwise(F.concat(first, F.array(merged)))
    each = rows.select(id_col, F.posexplode(capped).alias("block_index", "block"))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("unknown")), F.lit("::b"), F.col("block_index").cast("string"))
    return each.select(name.alias("block_id"), id_col, "block_index", F.col("block.kind").alias("block_type"), F.col("block.text").alias("text"))
