"""The pipeline's stages against plain Python on a small folder."""

import random

import numpy as np
import pandas as pd
import public_tokenizers as tokenizers
import pytest


WORDS = "the of river yard wages crew winter rain engine county letter office paper bridge harvest market".split()


def prose(n, rng):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, d = random.Random(11), tmp_path_factory.mktemp("tables")
    shared = prose(14, rng)
    rows = [(i, prose(rng.randint(30, 90), rng) + "\n" + (shared if i % 4 == 0 else prose(12, rng)), "en", f"src{i % 3}") for i in range(40)]
    twin = rows[3][1].split()
    twin[10] = "changed"
    rows += [(40, rows[2][1], "en", "src1"), (41, " ".join(twin), "de", None), (42, None, None, None), (43, "", "en", "src0"), (44, "$$$ ### %%% " * 30, "en", "src0"), (5, rows[5][1], "en", "src2"), (None, prose(50, rng), "en", "src1")]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    docs["n_chars"] = docs.text.str.len().astype("Int64")
    docs["score"] = 1.0  # another column
    docs.to_parquet(d / "documents.parquet")
    pd.DataFrame({"doc_id": np.arange(20), "quality": 1, "toxic": 0}).astype({"quality": "int32", "toxic": "int32"}).to_parquet(d / "labels.parquet")
    return str(d)


def test_stages(spark, folder):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*p.COLUMNS)
    kept = p.quality(spark, docs, folder)
    good = {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.columns == list(p.COLUMNS) and not any(not t or "$$$" in t for _, t in good) and len(good) == 43
    seen, want = [], []
    for r in sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)):
        me, left, mine = (r.doc_id is None, r.doc_id or 0), [], []
        for line in r.text.split("\n"):
            w = set(line.split())
            if not any(len(w & o) >= 0.8 * len(w | o) for who, o in seen if who < me) and not any(len(w & o) >= 0.8 * len(w | o) for o in mine):
                left.append(line)
            mine.append(w)
        seen += [(me, w) for w in mine]
        if left:
            want.append((r.doc_id, "\n".join(left), len("\n".join(left))))
    lined = p.lines(spark, kept, folder)
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in lined.collect()), key=str) == sorted(want, key=str)
    near = p.near_copies(spark, kept, folder)
    ids = sorted(r.doc_id for r in near.collect() if r.doc_id is not None)
    assert ids == sorted(i for i in range(40))  # 40 is a copy of 2, 41 a near copy of 3, one of the two rows of 5 stays
    mixed = p.mixture(spark, near, folder)
    assert mixed.columns == list(p.COLUMNS) and {r.doc_id for r in mixed.collect()} <= {*ids, None}


def test_run(spark, folder):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    assert 4 <= len(p.STAGES) <= 5
    pieces = p.run(spark, folder).toPandas()
    plain = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    assert len(pieces) and (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    texts = {plain.decode(np.frombuffer(b, "<u4")[:-1].tolist()) for b in pieces[(pieces.start == 0) & (pieces.length == pieces.doc_tokens)].ids}
    source = {t for t in pd.read_parquet(f"{folder}/documents.parquet").text.dropna()}
    assert texts and all(any(t in s or t.split("\n")[0] in s for s in source) for t in texts)


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    pd.DataFrame({"doc_id": pd.array([], "Int64"), "text": pd.array([], "string"), "lang": pd.array([], "string"), "source": pd.array([], "string"), "n_chars": pd.array([], "Int64")}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": pd.array([], "Int64"), "quality": pd.array([], "Int32"), "toxic": pd.array([], "Int32")}).to_parquet(tmp_path / "labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
