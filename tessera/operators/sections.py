"""Entities from documents with nested sections of fields, by six rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections as they are read from JSON: values keep their own types, so that only texts count.
SECTIONS = "array<struct<section_name:string,fields:array<map<string,variant>>>>"
# Names of fields, by kind, as keys of a field and as its ``field_name``: fixed values.
KEYS = {
    "GPE": (("division", "location", "department", "Division", "Location"), ("Division", "Location", "Department")),
    "DATE": (("date", "Date", "born", "Born"), ("Date", "Born")),
    "OCCUPATION": (("position", "Position", "occupation", "Occupation"), ("Position", "Occupation")),
}
PERSON_SECTION = "Personal Information"
EMPLOYEE_ID = r"\b[A-Z]*\d{3,5}[A-Z]?\b"


def sections_of(document: Column) -> Column:
    """The ``sections`` of a JSON document; fields that are no objects are null, a document without them has none.

    Each section and each field is read for itself, so that one of another shape spoils no other.
    """
    value = F.try_parse_json(document)
    parts = F.try_variant_get(value, "$.sections", "array<variant>")
    field = lambda f: F.try_variant_get(f, "$", "map<string,variant>")
    section = lambda s: F.struct(F.try_variant_get(s, "$.section_name", "string").alias("section_name"), F.transform(F.try_variant_get(s, "$.fields", "array<variant>"), field).alias("fields"))
    return F.transform(parts, section)


def _text(field: Column, key: str) -> Column:
    """A field's value under a key if it is a text that is not empty."""
    value = F.try_element_at(field, F.lit(key))
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")


def section_entities(docs: DataFrame, sections: Column, text: Column | None = None, organisation: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Entities of each document, each once: the id, ``type`` and ``name``.

    ``PERSON`` are names in the section of personal information; ``GPE``, ``DATE`` and
    ``OCCUPATION`` are fields by key or by ``field_name``, of over one character but for dates, an
    occupation not ``same``; ``EMPLOYEE_ID`` are codes in the text and in all texts of fields;
    ``ORG`` is the given organisation of every document. White space around a name goes. Null or
    missing sections, fields and values give nothing; a document without any has ``ORG`` alone.
    """
    rows = docs.select(F.col(id_col), sections.cast(SECTIONS).alias("__sections"), (F.lit(None).cast("string") if text is None else text).alias("__text"))
    fields = rows.select(id_col, F.inline("__sections")).select(id_col, "section_name", F.explode("fields").alias("field")).where("field is not null")
    named = lambda names: F.coalesce(_text(F.col("field"), "field_name").isin(*names), F.lit(False))
    value = _text(F.col("field"), "value")
    pairs = []
    person = F.coalesce(value, _text(F.col("field"), "name"))
    asked = named(("Name",)) | F.map_contains_key("field", F.lit("name"))
    pairs.append(F.struct(F.lit("PERSON").alias("type"), F.when((F.col("section_name") == PERSON_SECTION) & asked, person).alias("name")))
    for kind, (keys, names) in KEYS.items():
        for found in [_text(F.col("field"), k) for k in keys] + [F.when(named(names), value)]:
            good = found.isNotNull()
            if kind != "DATE":
                good &= F.char_length(found) > 1
            if kind == "OCCUPATION":
                good &= F.lower(found) != "same"
            pairs.append(F.struct(F.lit(kind).alias("type"), F.when(good, found).alias("name")))
    texts = F.transform(F.filter(F.map_values("field"), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    codes = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(EMPLOYEE_ID), F.lit(0))))
    every = F.concat(F.filter(F.array(*pairs), lambda p: p["name"].isNotNull()), F.transform(codes, lambda c: F.struct(F.lit("EMPLOYEE_ID").alias("type"), c.alias("name"))))
    found = fields.select(id_col, F.inline(every))
    in_text = rows.select(id_col, F.lit("EMPLOYEE_ID").alias("type"), F.explode(F.regexp_extract_all("__text", F.lit(EMPLOYEE_ID), F.lit(0))).alias("name"))
    done = found.unionByName(in_text)
    if organisation is not None:
        done = done.unionByName(rows.select(id_col, F.lit("ORG").alias("type"), F.lit(organisation).alias("name")))
    return done.select(id_col, "type", _strip(F.col("name")).alias("name")).distinct()
