"""Registered queries over single records and their numbering, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import network, records, retrieval, statistics
from tessera.plans.queries import EDGES, TOKENS, edges, query, r6
from tessera.sources.tables import table


@query(r"SELECT doc_id, source || '.scan' AS name FROM documents")
def strip_extensions(spark, d):
    return table(spark, d, "documents").select("doc_id", records.strip_extensions(F.concat("source", F.lit(".scan.JPEG.tif.json"))).alias("name"))


@query("SELECT p_partkey, trim(regexp_replace(lower('* ' || p_type || ' / ' || p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", records.slug(F.concat(F.lit("* "), "p_type", F.lit(" / "), "p_name")).alias("slug"))


@query("""WITH x AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'company' WHEN 1 THEN ' place ' WHEN 2 THEN '' WHEN 3 THEN 'Organisation' WHEN 4 THEN 'person-name' ELSE c_mktsegment || '-kind' END AS t FROM customer)
SELECT c_custkey, CASE WHEN trim(t) = '' THEN 'UNKNOWN' WHEN trim(t) = 'company' THEN 'ORG' WHEN trim(t) = 'place' THEN 'GPE' WHEN t = 'Organisation' THEN 'ORG' WHEN t = 'person-name' THEN 'PERSON' ELSE replace(replace(upper(trim(t)), '-', '_'), ' ', '_') END AS type FROM x""")
def entity_type_alias(spark, d):
    key = F.col("c_custkey") % 6
    name = F.when(key == 0, "company").when(key == 1, " place ").when(key == 2, "").when(key == 3, "Organisation").when(key == 4, "person-name").otherwise(F.concat("c_mktsegment", F.lit("-kind")))
    return table(spark, d, "customer").select("c_custkey", records.entity_type(name).alias("type"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS person_id, source AS person_name FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 2 = 1")
def person_folder(spark, d):
    folder = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("-", "doc_id", "source")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", records.person_folder(folder).alias("x")).select("doc_id", "x.*")


@query("SELECT p_partkey, array_to_string(list_filter(list_distinct([lower(p_type)]), lambda x: x <> ''), '|') || '|b c|' || lower(p_brand) AS lens FROM part")
def research_lens(spark, d):
    text = F.concat(F.lower("p_type"), F.lit(", b c ,,B C\n"), F.lower("p_brand"), F.lit(","), F.upper("p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(records.research_lens(text), "|").alias("lens"))


@query("SELECT doc_id, sha256(concat_ws(':', doc_id, lang, source)) AS key FROM documents")
def cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", records.cache_key(F.col("doc_id"), F.col("lang"), F.col("source")).alias("key"))


@query(f"SELECT item_id, {r6('least(25.0::DOUBLE, 25.0::DOUBLE * length(text) / 400) + least(25.0::DOUBLE, 25.0::DOUBLE * (item_id % 7) / 5)')} AS score FROM benchmark")
def heuristic_score(spark, d):
    from tessera.functions.scalars import round6

    score = records.heuristic_score((F.char_length("text"), 400), (F.col("item_id") % 7, 5))
    return table(spark, d, "benchmark").select("item_id", round6(score).alias("score"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def first_seen_copies(spark, d):
    return records.copies(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT doc_id, source, CAST((row_number() OVER w - 1) // 10 AS INTEGER) AS batch, CAST((row_number() OVER w - 1) % 4 AS INTEGER) AS turn FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def batches(spark, d):
    return records.number_in_group(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 10, 4)


@query("SELECT user_id, event_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 3")
def newest_runs(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "ts")
    return network.top_per_group(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "rank")


@query("""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(1, ceil((length(text) - 200) / 800.0))::INT - 1)) AS i FROM documents WHERE text <> ''),
t AS (SELECT doc_id, i, substring(text, i * 800 + 1, 1000) AS x FROM c)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(right(lag(x) OVER w, 50)) AS before, md5(left(lead(x) OVER w, 50)) AS after FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def chunk_overlaps(spark, d):
    done = records.overlaps(retrieval.fixed_chunks(table(spark, d, "documents")), "doc_id", "chunk_index", "text", 50)
    return done.select("doc_id", "chunk_index", F.md5("overlap_previous").alias("before"), F.md5("overlap_next").alias("after"))


@query("SELECT count(n_chars) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, list_sort(list(n_chars))[count(n_chars) // 2 + 1] AS p50, max(n_chars) AS most FROM documents")
def chunk_length_stats(spark, d):
    return records.length_stats(table(spark, d, "documents"), F.col("n_chars"))


@query("SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'copyright') AS INT) + CAST(contains(lower(text), 'the') AS INT) AS matched FROM documents WHERE matched > 0 ORDER BY matched DESC, doc_id LIMIT 40")
def keyword_fallback(spark, d):
    return records.keyword_fallback(table(spark, d, "documents"), "doc_id", "text", ["license", "copyright", "the"], 40)


@query(f"""WITH {EDGES}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst),
k AS (SELECT node, count(*) AS t FROM (SELECT x AS node FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY node),
g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node),
c AS (SELECT CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (degree * (degree - 1)) END AS c FROM g LEFT JOIN k USING (node))
SELECT count(*) AS n, {r6('avg(c)')} AS mean_of_connected, {r6('avg(coalesce(c, 0))')} AS mean_of_all FROM c""")
def clustering(spark, d):
    return statistics.local_clustering(edges(spark, d))


@query(rf"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(text, '\b(?:18|19|20)\d{{2}}\b')) AS BIGINT) AS n_years, len({TOKENS}) >= 50 AND len(regexp_extract_all(text, '\b(?:18|19|20)\d{{2}}\b')) >= 1 AS enough FROM documents WHERE text IS NOT NULL")
def text_checks(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", records.text_checks(F.col("text"), 50, 1).alias("x")).select("doc_id", "x.*")


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE n_chars >= 100) AS complete FROM documents GROUP BY ROLLUP (source, lang)")
def directory_status(spark, d):
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") >= 100).alias("complete"))


@query(f"SELECT p_brand, count(*) AS n, {r6('sum(l_quantity)')} AS total FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0.05 GROUP BY p_brand ORDER BY total DESC, p_brand LIMIT 10")
def demo_injuries_by_occupation(spark, d):
    from tessera.functions.scalars import round6

    part = table(spark, d, "part").select("p_partkey", "p_brand")
    rows = table(spark, d, "lineitem").where("l_discount > 0.05").select("l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), round6(F.sum("l_quantity")).alias("total")).orderBy(F.desc("total"), "p_brand").limit(10)


@query("SELECT o_orderstatus AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def demo_separation_types(spark, d):
    return table(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS positive, count(*) FILTER (WHERE c_nationkey < 10) AS near, count(DISTINCT c_mktsegment) AS segments FROM customer")
def demo_build_summary(spark, d):
    return table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"), F.count_if(F.col("c_nationkey") < 10).alias("near"), F.count_distinct("c_mktsegment").alias("segments"))
