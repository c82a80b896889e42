"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of the contract, in its order, then those that this operator adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

# No pattern goes back over a run of characters that it has read: a run is entered at its first
# character only and is never given up in parts, so the time is linear in the text.
_LOCAL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL, _EMAIL_HERE = re.compile(r"(?<![A-Za-z0-9._%+-])" + _LOCAL), re.compile(_LOCAL)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")
_NO_DIGIT = re.compile("[^0-9]")

# Scores in hundredths: what a kind starts from, and what a word of its kind nearby adds.
PRIOR = {"email": 80, "ip": 60, "card": 75, "phone": 60, "iban": 90, "ssn": 35}
LIFT = 20
LEAST = 50
REACH = 40
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "cvv"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social security", "tax id"),
}
_NEAR = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(words) + ")") for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    """Whether the last digit checks those before it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number without spaces leaves one modulo 97, first four characters last."""
    left = 0
    for c in code[4:] + code[:4]:
        value = int(c, 36)
        left = (left * (10 if value < 10 else 100) + value) % 97
    return left == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        # What is left of a run that the match before ended in may start a match too.
        found = (_EMAIL_HERE.match(text, at) if at else None) or _EMAIL.search(text, at)
        if not found:
            return
        yield found.span()
        at = found.end()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        end = found.end()
        while not "0" <= text[end - 1] <= "9":
            end -= 1
        if end - found.start() >= 4:
            yield found.start(), end


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass their check; words in capitals that follow one are left off."""
    for found in _IBAN.finditer(text):
        whole = found[0]
        while len(whole) >= 15:
            if mod97(whole.replace(" ", "")):
                yield found.start(), found.start() + len(whole)
                break
            whole = whole[: max(0, whole.rfind(" "))]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of the four base kinds, by start, then by kind."""
    out = []
    if "@" in text:
        out += [("email", a, z) for a, z in _emails(text)]
    if _DIGIT.search(text):
        for found in _IP.finditer(text):
            parts = [p.lstrip("0") for p in found[0].split(".")]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                out.append(("ip", *found.span()))
        for found in _CARD.finditer(text):
            if len(found[0]) >= 12:
                digits = _NO_DIGIT.sub("", found[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *found.span()))
        if "+" in text:
            for a, z in _phones(text):
                if 9 <= len(_NO_DIGIT.sub("", text[a:z])) <= 15:
                    out.append(("phone", a, z))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def spans(text: str) -> list[tuple[str, int, int, int]]:
    """All spans with their scores: base ones always, added ones from a score of ``LEAST``.

    An added span that overlaps a base span is left out: what it holds is found already.
    """
    out = base_spans(text)
    starts, ends = [a for _, a, _ in out], list(accumulate((z for _, _, z in out), max))
    added = []
    if _DIGIT.search(text):
        added += [("iban", *s) for s in _ibans(text)]
        added += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    rows = []
    free = [s for s in added if not (n := bisect_left(starts, s[2])) or ends[n - 1] <= s[1]]
    for kind, a, z in sorted(out + free, key=lambda s: (s[1], KINDS.index(s[0]))):
        around = text[max(0, a - REACH) : a] + " " + text[z : z + REACH]
        score = min(100, PRIOR[kind] + LIFT * bool(_NEAR[kind].search(around.lower())))
        if kind in BASE or score >= LEAST:
            rows.append((kind, a, z, score))
    return rows


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.int32())]))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id and ``spans``: an array of kind, start, end (exclusive), value and score.

    Positions are in code points of the whole text. ``email``, ``ip``, ``card`` (Luhn) and
    ``phone`` are always returned once confirmed; ``iban`` (mod 97) and ``ssn`` are added where
    the score, raised by words of the kind within 40 characters, reaches 50. Spans are ordered by
    start, then by kind as listed; those of different base kinds may overlap.

    A null or empty text has no spans. Rows with equal or null ids stay separate rows, repeated
    rows repeat their result, and an empty table gives no rows. Time and memory are linear in a
    text, however long. Other columns are ignored, so none can clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py() or ""
                found.append([{"kind": k, "start": a, "end": z, "value": text[a:z], "score": s} for k, a, z, s in spans(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string,score:int>>"
    return rows.mapInArrow(find, schema).withColumnRenamed("id", id_col)


def span_list(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
