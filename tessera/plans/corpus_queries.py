"""Registered queries over people, batches, notebooks and evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.texts import ascii_tokens
from tessera.operators import corpus, exploration as X, records, search
from tessera.plans.queries import TOKENS, query, r6
from tessera.sources.tables import table

KINDS = ["hire", "resignation", "Start", "death", "promotion"]


@query("""WITH v AS (SELECT o_custkey AS person, o_orderkey AS place, ['hire', 'resignation', 'start', 'death', 'promotion'][o_orderkey % 5 + 1] AS kind, CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) END AS year,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS position, o_orderstatus AS division FROM orders),
p AS (SELECT person, position, min(place) AS p FROM v WHERE position <> '' GROUP BY ALL), q AS (SELECT person, string_agg(position, '|' ORDER BY p) AS positions, first(position ORDER BY p) AS "primary" FROM p GROUP BY person),
g AS (SELECT person, first(division ORDER BY place) FILTER (WHERE division <> '') AS division, min(year) FILTER (WHERE kind IN ('hire', 'start')) AS hire_year FROM v GROUP BY person),
e AS (SELECT person, year AS separation_year, kind AS separation_type FROM v WHERE kind IN ('resignation', 'death') AND year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY person ORDER BY year DESC, place) = 1)
SELECT g.person, q."primary", coalesce(q.positions, '') AS positions, division, CAST(hire_year AS INTEGER) AS hire_year, CAST(separation_year AS INTEGER) AS separation_year, coalesce(separation_type, 'unknown') AS separation_type FROM g LEFT JOIN q USING (person) LEFT JOIN e USING (person)""")
def employment_histories(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("person"), k.alias("place"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % 5 + 1).cast("int")).alias("kind"),
        F.when(k % 7 > 0, F.year("o_orderdate")).alias("year"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("position"), F.col("o_orderstatus").alias("division"),
    )
    return X.employment(rows).withColumn("positions", F.array_join("positions", "|"))


@query("""WITH l AS (SELECT l_orderkey, CASE l_linenumber WHEN 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS days, CASE l_linenumber WHEN 2 THEN 0 ELSE l_extendedprice END AS amount, l_linenumber FROM lineitem),
o AS (SELECT o_custkey AS person, o_orderkey, o_orderpriority AS kind FROM orders), s AS (SELECT person, count(*) AS n FROM o GROUP BY person),
t AS (SELECT person, CAST(sum(coalesce(days, 0)) AS BIGINT) AS days, sum(CASE WHEN l_linenumber = 3 THEN 0 ELSE amount END) AS amount FROM o JOIN l ON l_orderkey = o_orderkey GROUP BY person),
k AS (SELECT person, string_agg(kind, '|' ORDER BY p) AS kinds FROM (SELECT person, kind, min(o_orderkey) AS p FROM o GROUP BY ALL) GROUP BY person)
SELECT s.person, n, coalesce(days, 0) AS days, floor(coalesce(amount, 0) * 100 + 0.5) / 100 AS amount, kinds FROM s LEFT JOIN t USING (person) JOIN k USING (person)""")
def injury_histories(spark, d):
    n = F.col("l_linenumber")
    pays = F.struct(F.when(n == 3, "some").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("days"), F.when(n == 2, "much").otherwise(F.col("l_extendedprice").cast("string")).alias("amount"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(pays).alias("payments"))
    orders = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = orders.select(F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("kind"), "payments")
    return X.injuries(rows).withColumn("kinds", F.array_join("kinds", "|"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n, source LIMIT 1000")
def person_folders(spark, d):
    return table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "source").limit(1000)


@query("""WITH x AS (SELECT o_orderkey % 8 AS batch, year(o_orderdate) AS year, o_orderstatus AS s, nullif(o_orderpriority, '3-MEDIUM') AS p FROM orders),
f AS (SELECT batch, year, 'status' AS facet, s AS value FROM x UNION ALL SELECT batch, year, 'priority', p FROM x UNION ALL SELECT batch, year, 'year', CAST(year AS VARCHAR) FROM x)
SELECT batch, facet, value, count(*) AS n, CAST(min(year) AS INTEGER) AS earliest, CAST(max(year) AS INTEGER) AS latest FROM f WHERE value <> '' GROUP BY ALL""")
def batch_facets(spark, d):
    rows = table(spark, d, "orders").withColumn("batch", F.col("o_orderkey") % 8)
    return X.batch_facets(rows, "batch", {"status": F.col("o_orderstatus"), "priority": F.nullif("o_orderpriority", F.lit("3-MEDIUM")), "year": F.year("o_orderdate")}, F.year("o_orderdate"))


@query(f"WITH x AS (SELECT CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade, count(*) AS n FROM orders GROUP BY 1) SELECT decade, n, {r6('n / sum(n) OVER ()')} AS share, row_number() OVER (ORDER BY n DESC, decade) = 1 AS peak FROM x")
def corpus_map(spark, d):
    return X.corpus_map(table(spark, d, "orders"), F.year("o_orderdate"))


@query("""WITH f AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS pattern, l_orderkey * 10 + l_linenumber AS seq, [l_orderkey % 40, l_suppkey % 40] AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT lower(trim(pattern)) AS key, unnest(evidence) AS e FROM f), n AS (SELECT key, count(DISTINCT e) AS n FROM e GROUP BY key)
SELECT lower(trim(pattern)) AS key, first(pattern ORDER BY seq) AS pattern, count(*) AS times, CAST(any_value(n) AS INTEGER) AS n_evidence, CASE WHEN any_value(n) >= 20 THEN 'high' WHEN any_value(n) >= 10 THEN 'medium' ELSE 'low' END AS confidence
FROM f JOIN n ON n.key = lower(trim(pattern)) GROUP BY 1""")
def pattern_merge(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    return X.merge_patterns(rows.select(name.alias("pattern"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.array(F.col("l_orderkey") % 40, F.col("l_suppkey") % 40).alias("evidence")))


@query("SELECT count(*) FILTER (WHERE n >= 60) AS high, count(*) FILTER (WHERE n >= 40 AND n < 60) AS medium, count(*) FILTER (WHERE n < 40) AS low FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def confidence_distribution(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(corpus.confidence(F.count(F.lit(1)), 60, 40).alias("level"))
    return n.agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low")])


@query(f"WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]{{4,}}')) AS token FROM documents), c AS (SELECT source, token, count(*) AS n FROM t WHERE token NOT IN ('that', 'this') GROUP BY source, token) SELECT source, token, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, token) <= 6")
def cluster_keywords(spark, d):
    words = table(spark, d, "documents").select("source", F.explode(ascii_tokens(F.col("text"), 4)).alias("token")).where(~F.col("token").isin("that", "this"))
    n = words.groupBy("source", "token").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token"))
    return n.withColumn("nth", nth).where("nth <= 6").drop("nth")


@query("SELECT item_id, doc_id, hit FROM (SELECT b.item_id, b.item_id AS doc_id, l.doc_id IS NOT NULL AS hit FROM benchmark b LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = b.item_id)")
def cached_findings(spark, d):
    batch = table(spark, d, "benchmark").select("item_id", F.col("item_id").alias("doc_id"))
    cache = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("finding"))
    known, new = X.split_cached(batch, cache, "doc_id")
    return known.select("item_id", "doc_id", F.lit(True).alias("hit")).unionByName(new.select("item_id", "doc_id", F.lit(False).alias("hit")))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_syntheses(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(done, "c_custkey", "left_anti").distinct()


@query("""WITH f AS (SELECT l_orderkey AS finding, l_linenumber AS i, l_suppkey || '::' || l_linenumber AS block FROM lineitem), b AS (SELECT DISTINCT block FROM f WHERE CAST(split_part(block, '::', 1) AS INTEGER) % 3 = 0),
x AS (SELECT finding, split_part(block, '::', 1) AS doc, min(i) AS i FROM f JOIN b USING (block) GROUP BY ALL) SELECT finding, string_agg(doc, ',' ORDER BY i, doc) AS docs FROM x GROUP BY finding""")
def findings_of_batch(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("finding"), "l_linenumber", F.concat("l_suppkey", F.lit("::"), "l_linenumber").alias("block"))
    batch = rows.where(F.split_part("block", F.lit("::"), F.lit(1)).cast("int") % 3 == 0).select("block").distinct()
    found = rows.groupBy("finding").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.split_part("block", F.lit("::"), F.lit(1)), "block"))), lambda x: x["block"]).alias("blocks"))
    return X.findings_in_batch(found, batch).withColumn("docs", F.array_join("docs", ","))


@query("SELECT source, count(*) >= 6 AND (count(DISTINCT lang) < 5 OR count(*) FILTER (WHERE n_chars > 3000) < 2) AS repair FROM documents GROUP BY source")
def findings_repair(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("e"), F.count_if(F.col("n_chars") > 3000).alias("p"))
    return n.select("source", X.needs_repair(F.col("n"), F.col("e"), F.col("p")).alias("repair"))


@query("""WITH r AS (SELECT o_custkey AS id, o_orderkey % 3 AS source, o_orderkey AS seq, (o_orderkey % 30) || CASE WHEN o_orderkey % 2 = 0 THEN '::b' ELSE '' END AS ref FROM orders),
f AS (SELECT id, split_part(ref, '::', 1) AS doc, source, seq FROM r QUALIFY row_number() OVER (PARTITION BY id, split_part(ref, '::', 1) ORDER BY source, seq) = 1)
SELECT id, doc, CAST(row_number() OVER (PARTITION BY id ORDER BY source, seq, doc) AS INTEGER) AS place FROM f QUALIFY place <= 5""")
def evidence_pack(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (k % 3).alias("source"), k.alias("seq"), F.concat((k % 30).cast("string"), F.when(k % 2 == 0, "::b").otherwise("")).alias("ref"))
    return X.evidence_pack(rows, 5)


@query("""WITH s AS (SELECT o_custkey AS query_id, o_orderkey % 50 AS doc, o_orderkey AS seq FROM orders WHERE o_orderstatus = 'F'), h AS (SELECT o_custkey AS query_id, o_orderkey % 50 AS doc, o_totalprice / 1e6 AS score FROM orders WHERE o_orderstatus <> 'F'),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS nth FROM s QUALIFY nth <= 3), b AS (SELECT query_id, doc, 1.0::DOUBLE AS score, 0 AS kind, nth FROM f UNION ALL SELECT query_id, doc, score, 1, 0 FROM h),
o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY kind, nth, score DESC) = 1)
SELECT query_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY kind, nth, score DESC, doc) AS INTEGER) AS place FROM o QUALIFY place <= 6""")
def evidence_cluster(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 50).alias("doc"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 1e6).alias("score"), "o_orderstatus")
    # Of one seed document's rows, the first in order counts, as in the SQL.
    seeds = rows.where("o_orderstatus = 'F'").select("query_id", "doc", "seq")
    return X.evidence_cluster(seeds, rows.where("o_orderstatus <> 'F'").select("query_id", "doc", "score"), 3, 6)


@query(f"SELECT o_custkey AS query_id, o_orderkey % 20 AS doc, {r6('max(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1e6 WHEN o_orderkey % 3 = 1 THEN 1.0::DOUBLE / (60 + o_orderkey % 9) ELSE 1.0::DOUBLE / (1 + o_orderkey % 9) END)')} AS score FROM orders GROUP BY ALL")
def hybrid_document_scores(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), (k % 20).alias("doc"), F.when(k % 3 == 0, F.col("o_totalprice") / 1e6).alias("score"), F.when(k % 3 == 1, 1 / (60 + k % 9)).alias("rrf"), (1 + k % 9).alias("rank"))
    return X.document_scores(rows)


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 50 AS INTEGER) AS batch FROM documents")
def keyset_batches(spark, d):
    return X.keyset_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE source IS NOT NULL),
f AS (SELECT source, doc_id, n_chars, i, 0 AS batch, n_chars AS used FROM o WHERE i = 1
  UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.i, f.batch + CASE WHEN f.used + o.n_chars > 8000 THEN 1 ELSE 0 END, CASE WHEN f.used + o.n_chars > 8000 THEN o.n_chars ELSE f.used + o.n_chars END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
SELECT source, doc_id, n_chars, CAST(batch AS INTEGER) AS batch FROM f""")
def packed_batches(spark, d):
    return X.pack_batches(table(spark, d, "documents").where("source is not null"), "source", "doc_id", "n_chars", 8000)


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) <= 3")
def chat_history(spark, d):
    from tessera.operators.network import top_per_group

    return top_per_group(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn"), "role"], 3).drop("rank")


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS entity, [c_nationkey * 100 + c_custkey % 7, c_nationkey * 100 + c_custkey % 3] AS ids FROM customer), h AS (SELECT entity, unnest(ids) AS id FROM m),
r AS (SELECT entity, entity AS far FROM m UNION SELECT r.entity, b.entity FROM r JOIN h a ON a.entity = r.far JOIN h b ON b.id = a.id) SELECT entity, min(far) AS linked FROM r GROUP BY entity""")
def employee_id_links(spark, d):
    n = F.col("c_nationkey") * 100
    return X.employee_links(table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.array((n + F.col("c_custkey") % 7), (n + F.col("c_custkey") % 3)).alias("ids")))


@query("""WITH e AS (SELECT l_orderkey AS doc, CASE l_linenumber % 3 WHEN 0 THEN 'ORG' WHEN 1 THEN 'PERSON' ELSE 'DATE' END AS type, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS text, l_suppkey % 2 = 0 AS resolved FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT doc, type, lower(text) AS low, max(CAST(resolved AS INTEGER)) = 1 AS resolved FROM e GROUP BY ALL)
SELECT doc, type, low, resolved, CAST(row_number() OVER (PARTITION BY doc ORDER BY CASE type WHEN 'PERSON' THEN 1 WHEN 'ORG' THEN 2 ELSE 3 END, type, low) AS INTEGER) AS place FROM o""")
def document_entity_groups(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "ORG").when(n % 3 == 1, "PERSON").otherwise("DATE")
    rows = rows.select(F.col("l_orderkey").alias("doc"), kind.alias("type"), F.when(n % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("text"), (F.col("l_suppkey") % 2 == 0).alias("resolved"))
    return X.entity_groups(rows, ["PERSON", "ORG"]).select("doc", "type", F.lower("text").alias("low"), "resolved", "place")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 200 AND n_chars < 2000 AND source = 'src1'")
def metadata_filter(spark, d):
    return table(spark, d, "documents").where(X.metadata_filter({"lang": ["en", "de"], "n_chars": {"$gte": 200, "$lt": 2000}, "source": "src1"})).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(source), 'license')) AND lang IN ('en', 'fr', 'de', 'es') ORDER BY doc_id LIMIT 20")
def keyword_retriever(spark, d):
    return X.keyword_retriever(table(spark, d, "documents"), "License", ["text", "source"], {"lang": ["en", "fr", "de", "es"]})


@query("SELECT 'k' AS field, 'int' AS kind, count(*) AS n FROM events WHERE regexp_matches(props, '^\\{\"k\": -?[0-9]+\\}$')")
def json_fields(spark, d):
    return X.json_fields(table(spark, d, "events"), "props")


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ',"c_mktsegment":"' || c_mktsegment || '"' END || '}' AS cleaned FROM customer""")
def clean_records(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 6 == 0, "").when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return rows.select("c_custkey", X.without_empty(rows).alias("cleaned"))


@query("WITH x AS (SELECT doc_id FROM documents WHERE contains(lower(lang), 'en')) SELECT doc_id, (SELECT count(*) FROM x) AS total, CAST(ceil((SELECT count(*) FROM x) / 50.0) AS BIGINT) AS total_pages FROM x ORDER BY doc_id LIMIT 50")
def search_totals(spark, d):
    return search.page_with_totals(search.search(table(spark, d, "documents"), [("lang", "AND", "en")]).select("doc_id"), ["doc_id"])


@query(f"""WITH w AS (SELECT {TOKENS} AS w FROM documents), t AS (SELECT 'word' AS type, unnest(w) AS term FROM w UNION ALL SELECT 'phrase', w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM w WHERE len(w) > 1)),
c AS (SELECT type, term, count(*) AS frequency FROM t WHERE contains(term, 'lic') GROUP BY ALL), n AS (SELECT type, count(*) AS total FROM c GROUP BY type)
SELECT type, term, frequency, total, CAST((SELECT sum(total) FROM n) AS BIGINT) AS total_records FROM c JOIN n USING (type) QUALIFY row_number() OVER (PARTITION BY type ORDER BY frequency DESC, term) <= 20""")
def search_terms(spark, d):
    from tessera.operators.terms import search_terms as found

    return found(table(spark, d, "documents"), "lic", 20)


@query("SELECT min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_seen(spark, d):
    return records.first_seen(table(spark, d, "documents").where("text is not null"), "text", "doc_id").select("doc_id", "source")
