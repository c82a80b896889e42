"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import event_log, fold_events, parse, render

    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(control).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    done = parse(render(fold_events(event_log(rows.unionByName(extra)))))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '[', '\l'), ']', '\r'), '<', '\g')) AS body,
    length(replace(replace(replace(replace(role, '\', '\\'), '[', '\l'), ']', '\r'), '<', '\g')) AS name FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN role = 'user' THEN 20 ELSE name + 14 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.repeats import remove_repeats

    done = remove_repeats(_read(spark, sf_dir, "documents"), window=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS p, w FROM d WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s FROM starts
), owners AS (
  SELECT s, min(doc_id) AS owner FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(p, p + 12)) AS p FROM windows JOIN owners USING (s) WHERE owner < doc_id
), flagged AS (
  SELECT x.doc_id, x.p, x.word, g.p IS NOT NULL AS cut
  FROM (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p
), done AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE cut) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT cut), '') AS kept
  FROM flagged GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN done USING (doc_id)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack

    done = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lines import remove_similar_lines

    done = remove_similar_lines(_read(spark, sf_dir, "documents"), threshold=0.8)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html import extract_text

    return extract_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import classify

    done = classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return done.select("doc_id", "junk", "toxic", "keep")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import plan_mixture

    plan = plan_mixture(_read(spark, sf_dir, "documents"))
    at = lambda i: F.floor(F.get("times", F.lit(i)) * 1e6 + 0.5) / 1e6
    rows = plan.select("doc.doc_id", "size", "source_size", "target", "taken", at(0).alias("first_time"), at(1).alias("second_time"))
    return rows.repartitionByRange("first_time", "doc_id").sortWithinPartitions("first_time", "doc_id")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS turn
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][place % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w
), t AS (
  SELECT source, source_size, [-0.5, 0.0, 0.5][place % 3 + 1]::DOUBLE AS tilt, CASE WHEN cap <= lev * weight THEN cap
    ELSE (SELECT min_by(lev, cap / weight) FROM l WHERE NOT cap <= lev * weight) * weight END AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (CASE WHEN start + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END
    + CASE WHEN start + source_size + size / 2.0::DOUBLE < target THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CASE WHEN start + size / 2.0::DOUBLE < target THEN floor(CASE WHEN tilt = 0 THEN least(1.0::DOUBLE, start / target)
    ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * least(1.0::DOUBLE, start / target))) / (2 * tilt) END * 1e6 + 0.5) / 1e6 END AS first_time,
  CASE WHEN start + source_size + size / 2.0::DOUBLE < target THEN floor(CASE WHEN tilt = 0 THEN least(1.0::DOUBLE, (start + source_size) / target)
    ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * least(1.0::DOUBLE, (start + source_size) / target))) / (2 * tilt) END * 1e6 + 0.5) / 1e6 END AS second_time
FROM r
"""


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.vectors import near_duplicate_vectors

    return near_duplicate_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.93)


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = r.vec_id) AS BIGINT) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reach r GROUP BY vec_id
"""


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.vectors import nearest_neighbours

    rows = _read(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), k=20, factor=1.0)


OP9_SQL = r"""
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_duplicates

    done = near_duplicates(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language by cohesion, as :func:`tessera.llm.phrases.collocations` defines them for nulls, empties and repeats."""
    from tessera.llm.phrases import collocations

    return collocations(_read(spark, sf_dir, "documents"), least=30, top=2000)


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), t AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, size, w[i:i + size - 1] AS g FROM (SELECT lang, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)
), f AS MATERIALIZED (
  SELECT lang, size, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), c AS (
  SELECT lang, size, g, f AS a, unnest(generate_series(1, size - 1)) AS k FROM f WHERE size >= 2
), s AS (
  SELECT c.lang, c.size, c.g, a, k, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * a // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:c.size]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.g ORDER BY score, k) = 1
), b AS (
  SELECT lang, g[i:i + m - 1] AS g, max(f) AS longer FROM (SELECT lang, g, f, m, unnest(generate_series(1, size - m + 1)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE size > m) GROUP BY ALL
), r AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM s LEFT JOIN b USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) QUALIFY rank <= 2000
"""


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, as :func:`tessera.llm.personal.find_personal` defines it for nulls, empties and repeats."""
    from tessera.llm.personal import BASE, find_personal, span_list

    done = find_personal(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return done.select("doc_id", *[count(kind) for kind in BASE], F.sha2(span_list(base), 256).alias("base_sha256"), span_list("spans").alias("spans"), scores.alias("scores"))


#: Base kinds only: the tables given hold none of the kinds that the operator adds. Those are tested without SQL.
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents
), p(kind, place, pattern, prior, near) AS (
  VALUES ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 80, '(?:^|[^a-z])(?:mail|contact|write to)'),
    ('ip', 2, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', 60, '(?:^|[^a-z])(?:ip|address|host|server|login)'),
    ('card', 3, '[0-9](?:[\x20-]?[0-9])+', 75, '(?:^|[^a-z])(?:card|visa|credit|payment|cvv)'),
    ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]', 60, '(?:^|[^a-z])(?:phone|tel|call|fax|mobile)')
), x AS (
  SELECT row, t, kind, place, prior, near, regexp_extract_all(t, pattern) AS m, regexp_split_to_array(t, pattern) AS g FROM d, p
), y AS (
  SELECT row, t, kind, place, prior, near, m, g, unnest(generate_series(1, len(m))) AS i FROM x
), z AS (
  SELECT row, t, kind, place, prior, near, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS n,
    CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS a FROM y
), s AS (
  SELECT row, kind, place, a, a + length(v) AS z, prior + CASE WHEN regexp_matches(lower(substring(t, greatest(a - 40, 0) + 1, least(a, 40)) || ' ' || substring(t, a + length(v) + 1, 40)), near) THEN 20 ELSE 0 END AS score FROM z
  WHERE CASE kind WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda q: CAST(q AS HUGEINT))) <= 255
    WHEN 'card' THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(generate_series(1, length(n)), lambda k:
      CASE WHEN (length(n) - k) % 2 = 0 THEN CAST(n[k] AS INTEGER) ELSE CAST(n[k] AS INTEGER) * 2 - CASE WHEN CAST(n[k] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(n) BETWEEN 9 AND 15 ELSE true END
), r AS (
  SELECT row, count(*) FILTER (WHERE kind = 'email') AS e, count(*) FILTER (WHERE kind = 'ip') AS i, count(*) FILTER (WHERE kind = 'card') AS c, count(*) FILTER (WHERE kind = 'phone') AS f,
    string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, place) AS spans, string_agg(CAST(least(score, 100) AS VARCHAR), ',' ORDER BY a, place) AS scores FROM s GROUP BY row
)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(f, 0) AS n_phone,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN r USING (row)
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each item, as :func:`tessera.llm.search.ranked_search` defines them for nulls, empties and repeats."""
    from tessera.llm.search import ranked_search

    return ranked_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), z AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d
), p AS (
  SELECT row, doc_id, CAST(len(w) AS BIGINT) AS size, unnest(w) AS t FROM d
), tf AS (
  SELECT row, doc_id, size, t, count(*) AS tf FROM p GROUP BY ALL
), q AS (
  SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
), df AS (
  SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY t
), s AS (
  SELECT i, item_id, row, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // l)))) AS BIGINT) AS score
  FROM q JOIN df USING (t) JOIN tf USING (t), z GROUP BY i, item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""


def queries() -> dict:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_packing": op3_packing,
        "op4_line_dedup": op4_line_dedup,
        "op5_html_extraction": op5_html_extraction,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_mixing": op7_mixing,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_nearest_neighbours": op9_nearest_neighbours,
        "op10_simhash": op10_simhash,
        "op11_collocations": op11_collocations,
        "op12_personal_data": op12_personal_data,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op7_mixing": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op9_nearest_neighbours": OP9_SQL, "op11_collocations": OP11_SQL, "op12_personal_data": OP12_SQL, "op13_ranked_search": OP13_SQL}
