import random
import re
import time

import pytest

from tessera.llm.personal import find_personal, luhn, mod97, span_list, spans

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def confirmed(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    """The contract's patterns as they stand."""
    found = [(kind, *m.span()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "") if confirmed(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x", ".", "..", "-", " ", "+", "+1", "(", ")", "_", "%", "é", "漢", "😀", "1", "12", "255", "256", "0007", "4111111111111111", "4111 1111-1111 1111", "\n", "٣", "a@b.c", "a@b.c_d@e.f", "1.2.3.4", "+1 (234) 555-0000"]
    for _ in range(30000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s[:3] for s in spans(text) if s[0] in PLAIN] == plain(text), text


def test_checksums_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765431")
    assert [s[:3] for s in spans("Pay DE89 3704 0044 0532 0130 00 NOW please")] == [("iban", 4, 31)]
    assert spans("code 123-45-6789") == [] and [s[0] for s in spans("her SSN is 123-45-6789")] == ["ssn"]
    near, far = spans("call +1 (234) 555-0000")[0], spans("see +1 (234) 555-0000")[0]
    assert near[3] > far[3]


@pytest.mark.parametrize("run", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " (" * 200_000, "a@" * 200_000, "a.b@c." * 60_000, "+1-" * 130_000, "1 " * 200_000, "GB82" * 100_000, "a@b.c " * 60_000 + "DE89 3704 0044 0532 0130 00 " * 3000])
def test_long_texts_take_linear_time(run):
    began = time.time()
    spans(run)
    assert time.time() - began < 5


def test_rows(spark):
    rows = [(1, "write to ann@example.com or 10.0.0.1", "x"), (1, "write to ann@example.com or 10.0.0.1", "x"), (None, "+1 (234) 555-0000", None), (3, None, None), (4, "", "y"), (5, "é漢😀 4111 1111 1111 1111", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    done = find_personal(docs)
    got = sorted((r.doc_id or 0, ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)) for r in done.collect())
    assert got == sorted((i or 0, ",".join(f"{k}:{a}:{z}" for k, a, z in plain(t))) for i, t, _ in rows)
    assert {r["list"] for r in find_personal(docs).select(span_list("spans").alias("list")).collect()} == {g[1] for g in got}
    assert all(s.value for r in done.collect() for s in r.spans)
    assert find_personal(docs.limit(0)).count() == 0
