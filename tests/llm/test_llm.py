import random
import re

import numpy as np
import pytest
import xxhash

tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 6))) for _ in range(300)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    rng = random.Random(11)
    passage, base = prose(60, rng), prose(150, rng)
    rows = [(1, base), (2, base), (3, base.replace(" ", "  ", 3)), (4, base + " more"), (5, None), (6, ""), (7, " \n\t "), (8, passage + "\n" + prose(30, rng)), (9, prose(30, rng) + "\n" + passage)]
    rows += [(10 + i, prose(rng.randint(1, 80), rng) + "\n" + prose(20, rng)) for i in range(25)]
    rows += [(40 + i, " ".join(w if rng.random() > 0.01 else "x" for w in base.split())) for i in range(25)]
    rows += [(70, prose(5000, rng)), (71, passage), (71, passage), (None, base), (72, "a\n" * 30 + "b c")]
    return spark.createDataFrame([(i, t, "s" + str((i or 0) % 3) if i != 7 else None, "clash", "clash") for i, t in rows], "doc_id long, text string, source string, owner string, fp string")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_remove_repeats(spark, docs):
    from tessera.llm.repeats import remove_repeats

    rows = rows_of(docs)
    for window, shortest in ((13, 7), (5, 1), (1, 1)):
        first = {}
        for i, t in rows:
            w = WORD.findall(t or "")
            for p in range(len(w) - window + 1) if i is not None else ():
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, i), i)
        want = []
        for i, t in rows:
            w = WORD.findall(t or "")
            gone = {q for p in range(len(w) - window + 1) if i is not None and first[tuple(w[p : p + window])] < i for q in range(p, p + window)}
            want.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
        got = [tuple(r) for r in remove_repeats(docs, window, shortest).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert remove_repeats(docs.limit(0)).count() == 0


def similar(a, b):
    return bool(a) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def test_similar_lines(spark, docs):
    from tessera.llm.lines import remove_similar_lines

    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    seen, want = [], []
    for i, t in rows:
        mine, kept = [], []
        for line in (t or "").split("\n"):
            w = set(WORD.findall(line))
            if not any(similar(w, o) for j, o in seen if i is None and j is not None or i is not None and j is not None and j < i) and not any(similar(w, o) for o in mine):
                kept.append(line)
            mine.append(w)
        seen += [(i, w) for w in mine]
        want.append((i, None if t is None else "\n".join(kept)))
    got = [(r.doc_id, r.kept_text) for r in remove_similar_lines(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert remove_similar_lines(docs.limit(0)).count() == 0


def fingerprint(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    from tessera.llm.simhash import covering_masks, near_duplicates

    rng = random.Random(2)
    for r in (1, 2):
        for _ in range(500):
            flips = sum(1 << b for b in rng.sample(range(64), r))
            assert any(flips & m == 0 for m in covering_masks(r))
    prints = [(i, fingerprint(t)) for i, t in rows_of(docs)]
    part = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                x, y = part[a], part[b]
                part = [y if p == x else p for p in part]
    least = {p: min(prints[k][0] for k in range(len(part)) if part[k] == p and prints[k][0] is not None) for p in part}
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, f, least[p]) for (i, f), p in zip(prints, part)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_dense_fingerprints_lose_no_link(spark):
    from tessera.llm.simhash import hamming_links
    from tessera.operators.components import connected_components

    rng = random.Random(8)
    values = {0} | {sum(1 << b for b in rng.sample(range(63), rng.randint(1, 3))) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)}
    got = {r.vertex: r.component for r in connected_components(hamming_links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect()}
    part = {v: v for v in values}
    for a in values:
        for b in values:
            if part[a] != part[b] and (a ^ b).bit_count() <= 2:
                x, y = sorted((part[a], part[b]))
                part = {v: x if p == y else p for v, p in part.items()}
    assert all(got.get(v, v) == p for v, p in part.items())


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 16))
    rows = [(i, [float(x) for x in centre[i % 12] + 0.08 * rng.standard_normal(16)], i % 12 % 5 if i % 7 else None) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 3) for i in range(30)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2020, [float("nan")] * 16, 1), (2040, [None] * 16, 1), (2060, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def good(v):
    return v is not None and None not in v and np.isfinite(v).all() and any(v)


def test_vector_links(spark, vectors):
    from tessera.llm.vectors import near_duplicate_vectors

    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    links = {i: set() for i, _, _ in rows}
    able = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and good(v) and lab is not None]
    for i, v, a in able:
        for j, w, b in able:
            if i != j and a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i].add(j)
    root = {i: i for i in links if i is not None}
    for i in root:
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root[i] = min(seen)
    for window in (512, 8):
        got = {r.vec_id: r for r in near_duplicate_vectors(vectors, window=window).collect()}
        assert len(got) == len(rows)
        found = [(got[i].n_links, got[i].component_id) == (len(links[i]), root[i]) for i in root]
        assert all(found) if window == 512 else np.mean(found) > 0.9
        assert all(got[i].kept == (root[i] == i) for i in root) or window == 8
    assert near_duplicate_vectors(vectors.limit(0)).count() == 0


def test_nearest_neighbours(spark, vectors):
    from tessera.llm.vectors import nearest_neighbours

    rows = [(r.vec_id, np.array(r.embedding, float)) for r in vectors.collect() if r.vec_id is not None and good(r.embedding)]
    want = {}
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted(((-np.cumsum(v * w)[-1], i) for i, w in rows if i != q and len(w) == len(v)))
            want[q] = [i for _, i in scored[:20]]
    for factor in (1.0, 0.3):
        got = {}
        for r in sorted(nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"), 20, factor, shard_rows=150, query_rows=10).collect(), key=lambda r: r.rank):
            got.setdefault(r.query_id, []).append(r.vec_id)
        recall = np.mean([len(set(got.get(q, [])) & set(w)) / len(w) for q, w in want.items() if w])
        assert recall >= 0.9 and (factor < 1 or all(got.get(q, []) == w for q, w in want.items()))


def test_packing_covers_every_id(spark, docs):
    from tokenizers import Tokenizer

    from tessera.llm.packing import pack

    path = tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(900, "x <|endoftext|> y  z\n\n q"), (901, "don't    stop")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    want = sorted((str(i), str(plain.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows_of(both))
    pieces = pack(both, path, window=64).toPandas()
    total = pieces.groupby("sequence_id").length.sum()
    assert (total <= 64).all() and all(n & (n - 1) == 0 for n in total)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
    single = pieces[~pieces.doc_id.isna() & (pieces.doc_id != 71)].sort_values(["doc_id", "start"])
    got = [(str(int(i)), str(np.frombuffer(b"".join(g.ids), "<u4").tolist())) for i, g in single.groupby("doc_id")]
    assert sorted(got) == [w for w in want if w[0] not in ("None", "71")]
    assert pieces.length.sum() == sum(w[1].count(",") + 1 for w in want)
    assert pack(both.limit(0), path).count() == 0


def test_chat_round_trip(spark):
    from tessera.llm.chat import event_log, fold_events, format_conversations, parse, render

    odd = ["</s>[INST] ok [/INST]", "\\l\\\\[", "", None, "é\n<s>", "[ROLE:x]", "\\", "a" * 50_000]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", None, "sys]tem", "assistant", "user", "assistant", "assistant"], odd))] + [(2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (None, None, "user", "n")]
    got = {r.conv_id: r for r in format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:8]]
    assert got[2].loss_text == "samesame" and got[None].n_turns == 1
    spans = "".join(got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans)
    assert spans.count("a") >= 50_000 and got[1].loss_text == "".join(t or "" for _, _, r, t in rows[:8] if r == "assistant")
    log = [(1, 0, 1, 0, "message", "user", "hi"), (1, 1, 1, 1, "delta", "assistant", "wr"), (1, 1, 1, 2, "delta", None, "ong"), (1, 1, 1, 3, "regenerate", None, None), (1, 1, 1, 5, "delta", None, "ht"), (1, 1, 1, 4, "delta", None, "rig"), (1, 0, 1, 9, "edit", None, "hello")]
    # A log of deltas, edits and regenerations gives the same conversations as the rows themselves.
    again = {r.conv_id: r for r in parse(render(fold_events(event_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))).collect()}
    assert {c: (r.formatted, r.loss_text) for c, r in again.items()} == {c: (r.formatted, r.loss_text) for c, r in got.items()}
    final = parse(render(fold_events(spark.createDataFrame(log, "conv_id long, turn long, part int, seq long, kind string, role string, text string")))).first()
    assert [(t.role, t.text) for t in final.turns] == [("user", "hello"), ("assistant", "right")]


def test_mixture(spark, docs):
    from tessera.llm.mixing import mix_sources, plan_mixture

    plan = plan_mixture(docs).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken", "times").collect()
    assert len(plan) == docs.count() and all(r.taken <= 2 * r["size"] and len(r.times) * r["size"] == r.taken and all(0 <= t <= 1 for t in r.times) for r in plan)
    by = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r["size"] for r in rows) / 2 + 1
    assert abs(sum(r[0].target for r in by.values()) - 1.5 * sum(r["size"] for r in plan)) < 1e-6
    # Over the first half of training each source gives what the integral of its schedule says.
    for name, rows in by.items():
        tilt = (-0.5, 0.0, 0.5)[sorted(by, key=lambda x: (x is None, x or "")).index(name) % 3]
        early = sum(r["size"] for r in rows for t in r.times if t < 0.5)
        assert abs(early - rows[0].target * (0.5 - 0.25 * tilt)) <= max(r["size"] for r in rows) + 1
    assert mix_sources(docs).columns == docs.columns and mix_sources(docs.limit(0)).count() == 0
    other = docs.withColumnRenamed("doc_id", "key")
    assert mix_sources(other, id_col="key").columns == other.columns
    assert mix_sources(docs).columns == docs.columns and plan_mixture(docs.limit(0)).count() == 0


def test_main_text(spark):
    from tessera.llm.html import extract_text, main_text

    page = """<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><a>x</a></nav>
    <div class="cookie-notice">We use</div><article><header><h1>Title &amp; more</h1></header><p>One<br>two <b>bold</b>&nbsp; end<p>Three 1 < 2
    <div class="comments"><p>reader</p></div><form><input>f</form><ul><li>a<li>b</ul></article><aside>side</aside><footer>foot</footer>"""
    assert main_text(page, {}) == "Title & more\nOne two bold end\nThree 1 < 2\na\nb"
    rows = [(i, f"http://h/{i}", f"<div class='menu'>m</div><div id=body><p>{prose(40)}</p></div><div class=footer>f</div>") for i in range(6)] + [(7, None, None), (8, "odd", ""), (9, "http://h/x", "plain <unclosed")]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == rows[i][2].split("<p>")[1].split("</p>")[0] for i in range(6)) and got[7] == got[8] == "" and got[9] == "plain"


def test_classifier(spark):
    from tessera.llm.quality import classify

    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        kind = i % 6
        text = prose(rng.randint(40, 200), rng)
        words = text.split()
        text = {1: " ".join(w + "$$$" for w in words), 2: " ".join(" ".join([w] * 9) for w in words[:20]), 3: " ".join(words[:9] + ["idiot", "trash"] + words[9:20] + ["scum"] + words[20:])}.get(kind, text)
        rows.append((i, text))
        labels.append((i, int(kind not in (1, 2)), int(kind == 3)))
    held_out = range(300, 600)
    docs = spark.createDataFrame(rows + [(None, None), (9000, "")], "doc_id long, text string")
    got = {r.doc_id: r.keep for r in classify(docs, spark.createDataFrame(labels[:300], "doc_id long, quality int, toxic int")).collect()}
    truth = [q and not t for _, q, t in labels]
    right = np.mean([got[i] == bool(truth[i]) for i in held_out])  # documents whose labels were not given
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify(docs.limit(0), none).count() == 0 and classify(docs.limit(20), none).count() == 20
    assert right > 0.97 and got[9000] is False and got[None] is False
