import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking
from tessera.operators.chunking import MARKERS, SEPARATORS, chunk_metadata, combined_text, join_paragraphs, marked_sections, quarter, semantic_blocks, separator_chunks, split_at_separators


def plain_split(text, size, overlap, separators, measure):
    """The splitter by its definition, on strings."""
    mark, finer = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            mark, finer = s, separators[i + 1 :]
            break
    if mark == "":
        parts = list(text)
    else:
        first, *rest = text.split(mark)
        parts = [p for p in [first, *(mark + r for r in rest)] if p]
    out, small = [], []

    def flush():
        window = []
        for p in small:
            if window and sum(map(measure, window)) + measure(p) > size:
                out.append("".join(window))
                while window and (sum(map(measure, window)) > overlap or sum(map(measure, window)) and sum(map(measure, window)) + measure(p) > size):
                    window.pop(0)
            window.append(p)
        if window:
            out.append("".join(window))
        small.clear()

    for p in parts:
        if measure(p) < size:
            small.append(p)
            continue
        flush()
        if finer:
            out.extend((x, True) for x in plain_split(p, size, overlap, finer, measure))
        else:
            out.append((p, True))
    flush()
    done = []
    for x in out:
        if isinstance(x, tuple):
            done.append(x[0])
        elif x.strip():
            done.append(x.strip())
    return done


def prose(rng, n):
    return "".join(rng.choice(["a", "bc", "déf", "漢", "long" * 3, " ", " ", ". ", "! ", "? ", "; ", ": ", ", ", "\n", "\n\n", "\n\n\n", "\t"]) for _ in range(n))


@pytest.mark.parametrize("measure", [len, quarter])
def test_splitter_equals_its_definition(measure):
    rng = random.Random(6)
    for _ in range(3000):
        text = prose(rng, rng.randint(1, 60))
        size = rng.randint(1, 30)
        overlap = rng.randint(0, size)
        separators = rng.choice([SEPARATORS, ("\n\n", "\n", " ", ""), (". ",), ("\n", " ")])
        assert split_at_separators(text, size, overlap, separators, measure) == plain_split(text, size, overlap, separators, measure), (text, size, overlap, separators)
    assert split_at_separators("") == []


def test_chunks_keep_every_word():
    rng = random.Random(1)
    text = prose(rng, 4000)
    assert all(len(c) <= 50 for c in split_at_separators(text, 50, 10, measure=len))
    assert "".join("".join(split_at_separators(text, 50, 0, measure=len)).split()) == "".join(text.split())


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for text in ("word " * 300_000, "\n\n" * 500_000, "x" * 1_000_000, "a. b; c: d, " * 100_000):
        split_at_separators(text, 100, 20)
        join_paragraphs(text)
    assert time.time() - began < 30


def test_chunk_rows(spark):
    rng = random.Random(9)
    texts = [(i, prose(rng, rng.randint(0, 200))) for i in range(30)] + [(100, None), (101, ""), (102, " \n "), (None, "no id here. " * 20), (3, "twice. " * 30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = separator_chunks(docs, F.col("text"), 20, 5).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.chunk_id.split("_")[0]), []).append(r)
    for i, t in texts:
        want = split_at_separators(t or "", 20, 5)
        if i == 3:
            continue
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.chunk_index)
        assert [r.text for r in rows] == want
        assert [r.token_count for r in rows] == [len(c) // 4 for c in want]
        assert [r.overlap_previous for r in rows] == [None if j == 0 else want[j - 1][-5:] for j in range(len(want))]
        assert [r.overlap_next for r in rows] == [None if j == len(want) - 1 else want[j + 1][:5] for j in range(len(want))]
        assert [r.chunk_id for r in rows] == [f"{'unknown' if i is None else i}_chunk_{j:03d}" for j in range(len(want))]
    assert separator_chunks(docs.limit(0), F.col("text")).count() == 0


def test_combined_text_and_metadata(spark):
    rows = [(1, " Title ", ["a", "b"], {"x": "1"}, None, 1900, ["one"], list("abcdefghijkl")), (2, "", [], None, "d", None, [], None)]
    docs = spark.createDataFrame(rows, "id int, title string, content array<string>, ocr_text map<string,string>, summary string, year int, source array<string>, place array<string>")
    assert [r.t for r in docs.select(combined_text(docs).alias("t")).collect()] == ["Title \n\na b\n\n1", "d"]
    got = [r.m for r in docs.select(chunk_metadata(docs).alias("m")).collect()]
    assert got[0] == {"title": " Title ", "year": "1900", "source": "one", "place": '["a","b","c","d","e","f","g","h","i","j"]'} and got[1] == {"title": ""}


def plain_blocks(text, kind="", most_chars=2000, most_blocks=12, split=None):
    if not text or not text.strip():
        return []
    block = lambda k, t: (k, t.strip()[:most_chars])
    if text.count("|") >= 6 or text.count("\t") >= 6 or re.search(r"\n\s*[-=]{3,}\s*\n", text):
        return [block("table", text)]
    found = sorted((m.start(), k) for k, p in MARKERS.items() for m in re.finditer(p, text, re.IGNORECASE))
    if found or "injury" in kind.lower():
        parts = [(k, text[at:end].strip()) for (at, k), end in zip(found, [f[0] for f in found[1:]] + [len(text)])]
        blocks = [block(k, t) for k, t in parts if t] or [block("full_document", text)]
    elif len(text) <= most_chars:
        return [block("full_document", text)]
    else:
        blocks = [block("segment", t) for t in split(text)]
    if len(blocks) > most_blocks:
        keep = max(0, most_blocks - 1)
        blocks = blocks[:keep] + [block("merged", "\n\n".join(t for _, t in blocks[keep:]))]
    return blocks


@pytest.mark.parametrize("fallback", ["separators", "paragraphs"])
@pytest.mark.parametrize("most_blocks", [12, 3, 1])
def test_semantic_blocks(spark, fallback, most_blocks):
    rng = random.Random(5)
    labels = ["Employee Name:", "date of injury:", "LOCATION:", "How Injured:", "Medical Treatment:", "Treatment:", "medical treatment:", "Doctor:", "Witness:", "Claim:", "Outcome:", "Location", "Medical  Treatment:"]
    texts = []
    for i in range(120):
        parts = [prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            parts = [rng.choice(labels) + p for p in parts]
        texts.append(rng.choice(["", "\n", "\n\n"]).join(parts))
    texts += [None, "", " \n\t", "a | b | c | d | e | f | g", "x\n  ----- \ny", "x\n\xa0===\x1c\ny", "p\n\n" * 80, "Claim: " * 20, "para graph one.\n\n" * 20 + "y" * 150, "  Doctor: \x1f x  "]
    kinds = ["Injury report" if i % 5 == 0 else None for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, kinds))], "doc_id long, text string, type string")
    split = (lambda t: split_at_separators(t, 15, 3)) if fallback == "separators" else (lambda t: join_paragraphs(t, 60))
    rows = semantic_blocks(docs, F.col("text"), F.col("type"), 60, most_blocks, fallback, 15, 3).collect()
    for i, (t, k) in enumerate(zip(texts, kinds)):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.block_index)
        assert [(r.block_type, r.text) for r in mine] == plain_blocks(t, k or "", 60, most_blocks, split), (i, t)
        assert [r.block_id for r in mine] == [f"{i}::b{j}" for j in range(len(mine))]


def test_paragraphs():
    rng = random.Random(4)

    def plain(text, most):
        out, now, used = [], [], 0
        for p in [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()]:
            if used + len(p) + 2 > most and now:
                out.append("\n\n".join(now))
                now, used = [p], len(p)
            else:
                now.append(p)
                used += len(p) + 2
        return out + ["\n\n".join(now)] * bool(now) or [text]

    for _ in range(1000):
        text = prose(rng, rng.randint(0, 80))
        assert join_paragraphs(text, 20) == plain(text, 20)
    assert chunking.TEXT_FIELDS[0] == "title" and marked_sections


def test_batches_are_cut_a_few_texts_at_a_time(spark):
    import pyarrow as pa

    from tessera.operators import chunking

    texts = pa.array([None if i % 7 == 0 else "" if i % 11 == 0 else f"{i}\n\nmore" for i in range(300)])
    parts = list(chunking._packed(texts, lambda t: t.split("\n\n")))
    assert max(map(len, parts)) <= chunking.TEXTS_AT_ONCE < len(texts)
    assert [x for part in parts for x in part.to_pylist()] == [None if t is None else t.split("\n\n") for t in texts.to_pylist()]
    # Rows and their pieces stay together across the parts of a batch.
    rows = spark.range(300).selectExpr("id as doc_id", "if(id % 7 = 0, null, concat('text ', id)) as text").coalesce(1)
    got = {r.doc_id: r.text for r in chunking.separator_chunks(rows, rows.text).collect()}
    assert got == {i: f"text {i}" for i in range(300) if i % 7}
