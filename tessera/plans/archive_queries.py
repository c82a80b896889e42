"""Registered queries over chunks, structures, entities of sections, clusters and session progress, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import chunking, entities, exploration, matching, notebook, search, sections, serving, structure
from tessera.plans.queries import QUERIES, query, r6
from tessera.sources import archive
from tessera.sources.tables import table
from tessera.streaming import state


def unchecked(f):
    """Register a query that SQL cannot express; tests hold its operator against a plain version."""
    QUERIES[f.__name__] = f
    return f


# Chunks

@unchecked
def separator_chunks(spark, d):
    done = chunking.separator_chunks(table(spark, d, "documents"), F.col("text"), 250, 50)
    return done.select("chunk_id", "doc_id", "chunk_index", F.md5("text").alias("text_md5"), "token_count", F.md5("overlap_previous").alias("before"), F.md5("overlap_next").alias("after"))


def _reports(spark, d):
    """A printed report for each order line: some with sections, some tables, some plain."""
    line = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    label = lambda text, column: F.concat(F.lit(text), F.col(column).cast("string"), F.lit("\n"))
    marked = F.concat(F.lit("Form 12 "), label("Employee Name: Clerk ", "l_suppkey"), label("date of injury: ", "l_orderkey"), label(" Nature of Injury: ", "p_type"), F.repeat(label("Medical Treatment: ", "p_name"), F.lit(3)), label("Claim: ", "l_returnflag"))
    listed = F.concat(F.lit("| a | b | c |\n| "), F.col("p_brand"), F.lit(" | 1 | 2 |"))
    text = F.when(F.col("l_linenumber") == 1, marked).when(F.col("l_linenumber") == 2, listed).otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit("\n")))
    return line.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("doc_id"), text.alias("text"))


REPORTS = """x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS doc_id, CASE l_linenumber
  WHEN 1 THEN 'Form 12 Employee Name: Clerk ' || l_suppkey || chr(10) || 'date of injury: ' || l_orderkey || chr(10) || ' Nature of Injury: ' || p_type || chr(10) || repeat('Medical Treatment: ' || p_name || chr(10), 3) || 'Claim: ' || l_returnflag || chr(10)
  WHEN 2 THEN '| a | b | c |' || chr(10) || '| ' || p_brand || ' | 1 | 2 |' ELSE '  ' || p_name || chr(10) END AS text FROM lineitem JOIN part ON l_partkey = p_partkey)"""
MARKED = r"(Employee Name|Date of Injury|Location|Department|Division|Injury Description|Nature of Injury|How Injured|Medical Treatment|Doctor|Hospital|Treatment|Witness|Statement|Testimony|Disposition|Outcome|Compensation|Claim):"


@query(f"""WITH {REPORTS}, s AS (SELECT doc_id, text, length(text) - length(replace(text, '|', '')) >= 6 AS tabular, string_split(regexp_replace(text, '(?i){MARKED}', chr(1) || '\\1:', 'g'), chr(1)) AS parts FROM x),
n AS (SELECT doc_id, row_number() OVER () AS row, CASE WHEN tabular OR len(parts) = 1 THEN [text] ELSE parts[2:] END AS parts, CASE WHEN tabular THEN 'table' WHEN len(parts) = 1 THEN 'full_document' END AS whole FROM s),
b AS (SELECT doc_id, whole, unnest(generate_series(1, least(len(parts), 6))) AS i, parts FROM n),
t AS (SELECT doc_id, i - 1 AS block_index, CASE WHEN i = 6 AND len(parts) > 6 THEN 'merged' ELSE coalesce(whole, CASE WHEN regexp_matches(parts[i], '(?i)^(employee|date|location|dep|div)') THEN 'header' WHEN regexp_matches(parts[i], '(?i)^(inj|nature|how)') THEN 'injury' WHEN regexp_matches(parts[i], '(?i)^(med|doc|hos|tre)') THEN 'treatment' WHEN regexp_matches(parts[i], '(?i)^(wit|sta|tes)') THEN 'witness' ELSE 'disposition' END) END AS block_type,
  array_to_string(list_transform(CASE WHEN i = 6 THEN parts[6:] ELSE [parts[i]] END, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), chr(10) || chr(10)) AS text FROM b)
SELECT doc_id, CAST(block_index AS INTEGER) AS block_index, block_type, text FROM t""")
def report_blocks(spark, d):
    return chunking.semantic_blocks(_reports(spark, d), F.col("text"), most_blocks=6).select("doc_id", "block_index", "block_type", "text")


@unchecked
def semantic_blocks(spark, d):
    done = chunking.semantic_blocks(table(spark, d, "documents"), F.col("text"))
    return done.select("block_id", "doc_id", "block_index", "block_type", F.md5("text").alias("text_md5"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s]')),
f AS (SELECT doc_id, ps, 1 AS i, 0 AS block, length(ps[1]) + 2 AS used FROM p UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN used + length(ps[i + 1]) + 2 > 800 THEN block + 1 ELSE block END, CASE WHEN used + length(ps[i + 1]) + 2 > 800 THEN length(ps[i + 1]) ELSE used + length(ps[i + 1]) + 2 END FROM f WHERE i < len(ps))
SELECT doc_id, CAST(block AS INTEGER) AS block_index, md5(string_agg(ps[i], chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM f GROUP BY doc_id, block""")
def paragraph_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    parts = chunking.paragraphs(F.col("text"), 800)
    return docs.where(F.col("text").rlike(r"\S")).select("doc_id", F.posexplode(parts).alias("block_index", "text")).select("doc_id", "block_index", F.md5("text").alias("text_md5"))


# Structures and entities of sections

@query("""WITH j AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderkey % 7 AS r FROM orders), f AS (
  SELECT id, 'id' AS path, 'int' AS type FROM j UNION ALL SELECT id, 'price', 'float' FROM j UNION ALL SELECT id, 'tags', CASE WHEN r = 0 THEN 'list' ELSE 'list<str>' END FROM j
  UNION ALL SELECT id, 'customer', 'object' FROM j UNION ALL SELECT id, 'customer.name', 'str' FROM j UNION ALL SELECT id, 'customer.balance', 'float' FROM j WHERE r > 2
  UNION ALL SELECT id, 'status', CASE WHEN s = 'F' THEN 'object' ELSE 'str' END FROM j UNION ALL SELECT id, 'status.code', 'str' FROM j WHERE s = 'F' UNION ALL SELECT id, 'status.done', 'bool' FROM j WHERE s = 'F'
  UNION ALL SELECT id, 'lines', 'list<object>' FROM j WHERE r = 3 UNION ALL SELECT id, 'lines[].n', 'int' FROM j WHERE r = 3), m AS (SELECT path, min_by(type, id) AS type, min(id) AS first, count(*) AS documents FROM f GROUP BY path)
SELECT * FROM m WHERE NOT starts_with(path, 'status.') OR (SELECT type FROM m WHERE path = 'status') = 'object'""")
def document_structure(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    part = F.col("o_orderkey") % 7
    number = lambda c: F.format_string("%.2f", F.abs(c))
    status = F.when(F.col("o_orderstatus") == "F", F.lit('{"code": "F", "done": true}')).otherwise(F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')))
    customer = F.concat(F.lit('{"name": "'), F.col("c_name"), F.lit('"'), F.when(part > 2, F.concat(F.lit(', "balance": '), number(F.col("c_acctbal")))).otherwise(F.lit("")), F.lit("}"))
    lines = F.when(part == 3, F.lit(', "lines": [{"n": 1}, {"m": 2}]')).otherwise(F.lit(""))
    text = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "price": '), number(F.col("o_totalprice")), F.lit(', "tags": ['), F.when(part == 0, "").otherwise(F.lit('"a", 1')), F.lit('], "customer": '), customer, F.lit(', "status": '), status, lines, F.lit("}"))
    paths = structure.document_paths(rows.select(F.col("o_orderkey").alias("doc_id"), text.alias("document")))
    return structure.merged_structure(paths).select(structure.shown_path(F.col("path")).alias("path"), "type", "first", "documents")


@query("""WITH f AS (SELECT c_custkey AS doc_id, 'PERSON' AS type, c_name AS name FROM customer UNION ALL SELECT c_custkey, 'GPE', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE length(n_name) > 1
  UNION ALL SELECT c_custkey, 'GPE', 'Yard ' || c_nationkey FROM customer UNION ALL SELECT c_custkey, 'DATE', CAST(1850 + c_custkey % 70 AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'EMPLOYEE_ID', CAST(1850 + c_custkey % 70 AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 'OCCUPATION', c_mktsegment FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'EMPLOYEE_ID', 'PY' || (100 + c_custkey % 900) FROM customer UNION ALL SELECT c_custkey, 'ORG', 'The Road' FROM customer)
SELECT DISTINCT doc_id, type, name FROM f""")
def section_entities(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    year = (1850 + F.col("c_custkey") % 70).cast("string")
    held = lambda key, value: F.concat(F.lit('{"' + key + '": "'), value, F.lit('"}'))
    named = lambda name, value: F.concat(F.lit('{"field_name": "' + name + '", "value": "'), value, F.lit('"}'))
    work = F.when(F.col("c_custkey") % 3 > 0, held("Position", F.concat(F.lit(" "), F.col("c_mktsegment")))).otherwise(F.lit('{"Position": "Same"}'))
    fields = F.concat_ws(", ", named("Name", F.col("c_name")), named("Division", F.col("n_name")), held("location", F.concat(F.lit("Yard "), F.col("c_nationkey").cast("string"))), named("Born", year), work, F.lit('{"age": 4967}, "loose", null'))
    text = F.concat(F.lit('{"sections": [{"section_name": "Personal Information", "fields": ['), fields, F.lit(']}, {"section_name": "Other", "fields": [{"name": "Nobody"}]}, {"fields": null}]}'))
    docs = rows.select(F.col("c_custkey").alias("doc_id"), text.alias("document"), F.concat(F.lit("see PY"), (100 + F.col("c_custkey") % 900).cast("string")).alias("text"))
    return sections.section_entities(docs, sections.sections_of(F.col("document")), F.col("text"), "The Road")


# Clusters

def _scored(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") * 37 % 101).alias("score"))


COSINES = f"v AS (SELECT vec_id, label, vec_id * 37 % 101 AS score, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT a.vec_id AS a, b.vec_id AS b, b.score, {r6('list_inner_product(a.e, b.e) / (a.n * b.n)')} AS cosine FROM v a JOIN v b ON len(a.e) = len(b.e))"


@query(f"""WITH {COSINES}, s AS (SELECT vec_id FROM v ORDER BY score DESC, vec_id LIMIT 12) SELECT vec_id, vec_id AS seed, 1.0::DOUBLE AS similarity FROM s
UNION ALL SELECT a, b, cosine FROM c WHERE b IN (FROM s) AND a NOT IN (FROM s) QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, score DESC, b) = 1""")
def seed_clusters(spark, d):
    return matching.seed_clusters(_scored(spark, d), 12)


@query(f"""WITH {COSINES}, t AS (SELECT min(vec_id) AS vec_id, 'theme ' || label AS theme FROM v WHERE label IS NOT NULL GROUP BY label)
SELECT a AS vec_id, CASE WHEN cosine >= 0.2 THEN theme ELSE 'other' END AS theme, cosine AS similarity FROM c JOIN t ON t.vec_id = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) = 1""")
def theme_assignment(spark, d):
    rows = table(spark, d, "embeddings").where("embedding is not null")
    first = rows.where("label is not null").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    return matching.assign_to(rows.select("vec_id", "embedding"), first.select("vec_id", "embedding", F.concat(F.lit("theme "), F.col("label").cast("string")).alias("theme")))


@unchecked
def vector_clusters(spark, d):
    done = matching.threshold_clusters(table(spark, d, "embeddings").select(F.col("vec_id").alias("place"), "embedding"), 0.78)
    return done.select(F.col("place").alias("vec_id"), "leader")


@unchecked
def pattern_fuzzy_merge(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.col("p_name"), F.lit(" of "), F.lower("p_type"), F.when(F.col("p_size") % 5 == 0, "s!").otherwise("")).alias("pattern"), F.col("p_partkey").alias("seq"))
    return matching.merge_similar_patterns(rows, 0.9)


@unchecked
def contradiction_types(spark, d):
    line = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    claim = F.concat(F.col("p_name"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" certificate "), F.col("l_suppkey").cast("string"), F.lit("00"))).otherwise(F.lit(" of ")), F.lit(" in "), F.year("l_shipdate").cast("string"))
    rows = line.select("l_orderkey", "l_linenumber", "l_suppkey", claim.alias("claim"))
    one, two = rows.withColumnRenamed("claim", "claim_a"), rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("claim").alias("claim_b"))
    return one.join(two, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_suppkey", "claim_a", "claim_b", matching.contradiction_type(F.col("claim_a"), F.col("claim_b")).alias("x")).select("l_orderkey", "l_linenumber", "l_suppkey", "claim_a", "claim_b", "x.*")


# Progress

@query("""WITH g AS (SELECT *, coalesce(epoch_ms(ts) - lag(epoch_ms(ts)) OVER w >= 1800000, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id)),
s AS (SELECT *, CAST(sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS BIGINT) AS session FROM g)
SELECT user_id AS key, event_id, session, count(*) OVER w AS seen, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors FROM s WINDOW w AS (PARTITION BY user_id, session ORDER BY epoch_ms(ts), event_id ROWS UNBOUNDED PRECEDING)""")
def session_progress(spark, d):
    return state.session_progress(table(spark, d, "events"))



# Notebook

def _findings(spark, d):
    rows = table(spark, d, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.concat(F.lit(" "), F.col("event_type"), (F.col("user_id") % 40).cast("string")))
    contexts = F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 2 == 0, ""), F.concat(F.lit("e"), F.col("event_id").cast("string")), F.lit("a"), F.lit("b"))
    block = F.when(F.col("event_id") % 4 > 0, F.concat((F.col("event_id") % 9).cast("string"), F.lit("::"), F.col("event_id").cast("string")))
    return rows.select((F.col("event_id") % 2).alias("batch"), F.col("event_id").alias("seq"), name.alias("name"), F.when(F.col("event_id") % 5 > 0, "kind").alias("type"), contexts.alias("contexts"), block.alias("first_block"), block.alias("last_block"))


FINDINGS = """f AS (SELECT event_id % 2 AS batch, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE ' ' || event_type || user_id % 40 END AS name, CASE WHEN event_id % 5 > 0 THEN 'kind' ELSE 'unknown' END AS type,
  CASE WHEN event_id % 2 = 0 THEN ['u' || user_id, 'e' || event_id, 'a', 'b'] ELSE ['u' || user_id, 'e' || event_id, 'a', 'b'] END AS contexts, CASE WHEN event_id % 4 > 0 THEN event_id % 9 || '::' || event_id END AS block FROM events WHERE event_type <> ''),
k AS (SELECT lower(trim(name)) AS key, *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY batch, seq) AS nth, count(*) OVER (PARTITION BY lower(trim(name))) AS n FROM f)"""


@query(f"""WITH {FINDINGS}, c AS (SELECT key, n, nth, unnest(CASE WHEN nth = 1 THEN contexts ELSE contexts[1:3] END) AS context, unnest(generate_series(1, CASE WHEN nth = 1 THEN len(contexts) ELSE 3 END)) AS pos FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY nth, pos) AS place FROM c QUALIFY place <= 10 OR n = 1), t AS (SELECT key, string_agg(context, ',' ORDER BY place) AS contexts FROM r GROUP BY key)
SELECT key, first(name ORDER BY nth) AS name, first(type ORDER BY nth) AS type, count(*) AS document_count, any_value(t.contexts) AS contexts, first(block ORDER BY nth) FILTER (WHERE block IS NOT NULL) AS first_block, last(block ORDER BY nth) FILTER (WHERE block IS NOT NULL) AS last_block
FROM k JOIN t USING (key) GROUP BY key""")
def notebook_entities(spark, d):
    found = _findings(spark, d)
    state = notebook.merge_entities(found.where("batch = 0"))
    done = notebook.merge_entities(found.where("batch = 1"), state)
    return done.withColumn("contexts", F.array_join("contexts", ","))


@query("""WITH c AS (SELECT 'year' AS kind, CAST(CASE WHEN p_size % 11 = 0 THEN 'undated' ELSE CAST(1850 + p_size * p_size % 97 AS VARCHAR) END AS VARCHAR) AS name, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_brand, count(*) FROM part GROUP BY 2),
e AS (SELECT kind, name, n FROM c UNION ALL SELECT 'decade', CAST(TRY_CAST(name AS INTEGER) // 10 * 10 AS VARCHAR), n FROM c WHERE kind = 'year' AND TRY_CAST(name AS INTEGER) IS NOT NULL) SELECT kind, name, CAST(2 * sum(n) AS BIGINT) AS n FROM e GROUP BY kind, name""")
def corpus_map_merge(spark, d):
    parts = table(spark, d, "part")
    year = F.when(F.col("p_size") % 11 == 0, "undated").otherwise((1850 + F.col("p_size") * F.col("p_size") % 97).cast("string"))
    batch = parts.groupBy(F.lit("year").alias("kind"), year.alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(parts.groupBy(F.lit("type").alias("kind"), F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    return notebook.merge_counts(batch, notebook.merge_counts(batch))


@query("""WITH f AS (SELECT lower(event_type) AS type, 'Label ' || user_id % 30 AS label, unnest([event_id % 50 || '::' || event_id, CAST(user_id % 7 AS VARCHAR)]) AS entry FROM events WHERE event_type <> ''), e AS (SELECT DISTINCT type || ':' || lower(label) AS key, type, label, split_part(entry, '::', 1) AS doc FROM f)
SELECT key, type, min(label) AS label, count(*) AS n_documents, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM e GROUP BY key, type""")
def group_indicators(spark, d):
    rows = table(spark, d, "events")
    evidence = F.array(F.concat((F.col("event_id") % 50).cast("string"), F.lit("::"), F.col("event_id").cast("string")), (F.col("user_id") % 7).cast("string"))
    found = rows.where("event_type <> ''").select((F.col("event_id") % 2).alias("batch"), F.upper("event_type").alias("type"), F.concat(F.lit("Label "), (F.col("user_id") % 30).cast("string"), F.lit(" ")).alias("label"), evidence.alias("evidence"))
    state = notebook.merge_indicators(found.where("batch = 0"))
    return notebook.indicator_levels(notebook.merge_indicators(found.where("batch = 1"), state))


def _nested(spark, d):
    part = table(spark, d, "part")
    empty = lambda n, value: F.when(F.col("p_size") % n > 0, value)
    about = F.struct(empty(2, F.col("p_brand")).alias("brand"), F.when(F.col("p_size") % 3 == 0, "N/A").otherwise(F.col("p_type")).alias("kind"))
    return part.select("p_partkey", empty(7, F.struct(about.alias("about"), F.lit("").alias("note"))).alias("inner"), F.array(F.lit(""), empty(4, F.col("p_name")), F.lit("None")).alias("names"))


@query("SELECT 'p_partkey' AS field, count(*) AS n FROM part UNION ALL SELECT 'inner.about.brand', count(*) FILTER (WHERE p_size % 7 > 0 AND p_size % 2 > 0) FROM part UNION ALL SELECT 'inner.about.kind', count(*) FILTER (WHERE p_size % 7 > 0) FROM part UNION ALL SELECT 'inner.note', count(*) FILTER (WHERE p_size % 7 > 0) FROM part UNION ALL SELECT 'names', count(*) FROM part")
def nested_presence(spark, d):
    return search.field_presence(_nested(spark, d))


@query("""WITH a AS (SELECT *, CASE WHEN p_size % 2 > 0 THEN '"brand":"' || p_brand || '"' END AS b, CASE WHEN p_size % 3 > 0 THEN '"kind":"' || p_type || '"' END AS k FROM part)
SELECT p_partkey, '{"p_partkey":' || p_partkey || CASE WHEN p_size % 7 > 0 AND coalesce(b, k) IS NOT NULL THEN ',"inner":{"about":{' || concat_ws(',', b, k) || '}}' ELSE '' END || CASE WHEN p_size % 4 > 0 THEN ',"names":["' || p_name || '"]' ELSE '' END || '}' AS cleaned FROM a""")
def clean_nested(spark, d):
    rows = _nested(spark, d)
    return rows.select("p_partkey", exploration.without_empty(rows).alias("cleaned"))


@unchecked
def linked_terms(spark, d):
    """Types of parts, some of them misspelt, against all types as they are."""
    part = table(spark, d, "part")
    spelt = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit("s"))).when(F.col("p_partkey") % 7 == 0, F.reverse("p_type")).otherwise(F.col("p_type"))
    known = part.select(F.col("p_type").alias("reference"), F.md5(F.col("p_type").cast("binary")).alias("kb_id"))
    return entities.link_terms(part.select(spelt.alias("term"), F.lit(1).alias("frequency")), known)


# Served results

def _chunk_vectors(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("vec_id") * 7 % 300).alias("doc_id")).join(docs, "doc_id")


SERVED = f"""{COSINES}, q AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM c WHERE a % 50 = 0 AND b * 7 % 300 IN (SELECT doc_id FROM documents) QUALIFY rank <= 8)"""


@query(f"WITH {SERVED} SELECT a AS query_id, b AS chunk_id, CAST(rank AS INTEGER) AS rank, floor(cosine * 1e4 + 0.5) / 1e4 AS score, floor((1 - cosine) * 1e4 + 0.5) / 1e4 AS distance, md5(substring(coalesce(text, ''), 1, 400)) AS content, coalesce(lang, '') AS title, '' AS date, coalesce(source, '') AS source, doc_id FROM q JOIN documents ON doc_id = b * 7 % 300")
def semantic_search(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), F.lit(None).cast("string").alias("date"), "source")
    done = serving.semantic_search(_chunk_vectors(spark, d), table(spark, d, "embeddings").where("vec_id % 50 = 0").select("vec_id", "embedding"), docs, 8)
    return done.withColumn("content", F.md5("content"))


@query(f"WITH {SERVED}, p AS (SELECT a AS query_id, b * 7 % 300 AS doc_id, min(rank) AS rank FROM q GROUP BY ALL) SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS INTEGER) AS place FROM p QUALIFY place <= 5")
def parent_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("").alias("title"), F.lit("").alias("date"), "source")
    hits = serving.semantic_search(_chunk_vectors(spark, d), table(spark, d, "embeddings").where("vec_id % 50 = 0").select("vec_id", "embedding"), docs, 8)
    return serving.parents(hits)


@query("WITH k AS (SELECT DISTINCT CAST(vec_id * 3 AS VARCHAR) AS k FROM embeddings), l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT k FROM k)) SELECT doc_id, n // 64 AS batch FROM l")
def embedding_backfill(spark, d):
    done = table(spark, d, "embeddings").select((F.col("vec_id") * 3).cast("string").alias("document_id"))
    return serving.backfill(table(spark, d, "documents"), done, batch=64)


@unchecked
def question_agenda(spark, d):
    rows = table(spark, d, "embeddings").where("embedding is not null")
    first = rows.where("label is not null").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id"))
    themes = first.select("vec_id", "embedding", F.concat(F.lit("theme "), F.col("label").cast("string")).alias("theme"))
    return serving.agenda(_scored(spark, d), themes)


# Archives

def _listing(spark, d):
    """Paths of records and images as an archive of the parts would have them."""
    p = F.col("p_partkey")
    folder = F.concat(F.lit("/arc/"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Relief Record Scans/JPG/Box "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("Microfilm Digitization/Microfilm "), F.col("p_size").cast("string"))), F.lit("/"), p.cast("string"), F.lit("-"), F.col("p_brand"), F.lit("/RD"), p.cast("string"))
    kind = p % 4
    ends = F.array(
        F.when(kind == 0, "_jpg.txt").when(kind == 1, ".png.json").otherwise(".json"),
        F.when((kind == 0) & (p % 3 > 0), ".jpg"), F.when((kind == 0) & (p % 5 == 0), ".JPG"), F.when((kind == 1) & (p % 3 == 1), ".png"), F.when((kind > 1) & (p % 3 == 2), ".tif"), F.when((kind > 1) & (p % 5 == 1), ".jpeg"),
    )
    return table(spark, d, "part").select(folder.alias("folder"), F.explode(F.filter(ends, lambda e: e.isNotNull())).alias("end")).select(F.concat("folder", "end").alias("path"))


LISTED = """x AS (SELECT p_partkey AS p, p_size, p_brand, p_partkey % 4 AS kind, '/arc/' || CASE WHEN p_size % 3 = 0 THEN 'Relief Record Scans/JPG/Box ' || p_size ELSE 'Microfilm Digitization/Microfilm ' || p_size END || '/' || p_partkey || '-' || p_brand AS folder FROM part),
y AS (SELECT *, folder || '/RD' || p AS base, CASE WHEN kind = 0 AND p % 3 > 0 THEN '.jpg' WHEN kind = 0 AND p % 5 = 0 THEN '.JPG' WHEN kind = 1 AND p % 3 = 1 THEN '.png' WHEN kind > 1 AND p % 5 = 1 THEN '.jpeg' WHEN kind > 1 AND p % 3 = 2 THEN '.tif' END AS best,
  (kind = 0 AND p % 3 > 0)::INT + (kind = 0 AND p % 5 = 0)::INT + (kind = 1 AND p % 3 = 1)::INT + (kind > 1 AND p % 3 = 2)::INT + (kind > 1 AND p % 5 = 1)::INT AS images FROM x)"""


@query(f"""WITH {LISTED} SELECT base || CASE kind WHEN 0 THEN '_jpg.txt' WHEN 1 THEN '.png.json' ELSE '.json' END AS path, base || best AS image, p || '-' || p_brand AS person_folder, CAST(p AS VARCHAR) AS person_id, p_brand AS person_name,
CASE WHEN p_size % 3 = 0 THEN 'Relief Record Scans' ELSE 'Microfilm Digitization' END AS collection, CASE WHEN p_size % 3 = 0 THEN 'JPG' END AS format, CASE WHEN p_size % 3 = 0 THEN 'Box ' || p_size END AS physical_box, CASE WHEN p_size % 3 > 0 THEN 'Microfilm ' || p_size END AS series FROM y""")
def archive_records(spark, d):
    return archive.paired_images(_listing(spark, d)).select("path", "image", archive.path_metadata(F.col("path")).alias("m")).select("path", "image", "m.*")


@query(f"WITH {LISTED} SELECT folder AS directory, images, CASE WHEN kind = 1 AND images > 0 THEN 1 ELSE 0 END AS complete, 0 AS text_only, CASE WHEN kind = 1 THEN 0 ELSE images END AS needs_processing, CASE WHEN kind = 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS completion_rate FROM y WHERE images > 0")
def archive_status(spark, d):
    return archive.directory_status(_listing(spark, d)).where("directory is not null")
