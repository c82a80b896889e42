"""The registered queries over the driver's tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import corpus, entities, network, retrieval, search, statistics, terms
from tessera.sources.tables import mentions as mention_view, table
from tessera.session import listing, materialize
from tessera.streaming import events as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


MENTIONS = """m AS (
  SELECT l_orderkey AS doc, 'SUPPLIER:' || l_suppkey AS ent, 'SUPPLIER' AS type FROM lineitem
  UNION SELECT l_orderkey, 'BRAND:' || p_brand, 'BRAND' FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION SELECT o_orderkey, 'NATION:' || n_name, 'NATION' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT o_orderkey, 'PRIORITY:' || o_orderpriority, 'PRIORITY' FROM orders)"""
EDGES = MENTIONS + """, e AS (
  SELECT a.ent AS src, b.ent AS dst, a.type AS src_type, b.type AS dst_type, count(*) AS weight
  FROM m a JOIN m b ON a.doc = b.doc AND a.ent < b.ent GROUP BY ALL HAVING count(*) >= 2)"""
BOTH = EDGES + """, s AS (SELECT src AS node, dst AS other, src_type AS node_type, dst_type AS other_type, weight FROM e
  UNION ALL SELECT dst, src, dst_type, src_type, weight FROM e), d AS (SELECT node, node_type, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM s GROUP BY ALL)"""
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


#: Mention and edge tables written so far, by application and state of the folder: like a stored network, each is built once.
_STORED: dict = {}


def _stored(spark, d, name, build):
    key = (spark.sparkContext.applicationId, name, listing(spark, *(f"{d}/{t}.parquet" for t in ("lineitem", "orders", "customer", "nation", "part"))))
    if key not in _STORED:
        _STORED[key] = materialize(build(), name)
    return _STORED[key]


def mentions(spark, d):
    return _stored(spark, d, "mentions", lambda: mention_view(spark, d))


def edges(spark, d):
    return _stored(spark, d, "edges", lambda: network.cooccurrence_edges(mentions(spark, d)))


# Search

@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') AND NOT coalesce(contains(lower(lang), 'fr'), false) AND (contains(lower(source), 'src1') OR contains(lower(source), 'src2'))")
def search_and_or_not(spark, d):
    wanted = search.search_predicate([("text", "AND", "license"), ("lang", "NOT", "fr"), ("source", "OR", "src1")]) | search.search_predicate([("text", "AND", "license"), ("lang", "NOT", "fr"), ("source", "OR", "src2")])
    return table(spark, d, "documents").where(wanted).select("doc_id", "lang")


@query("SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE event_type = 'error' OR event_type = ''")
def search_missing(spark, d):
    rows = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return search.search(rows, [("kind", "AND", "missing")])


@query("SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(lang), 'en') ORDER BY doc_id LIMIT 50 OFFSET 50")
def search_page(spark, d):
    rows = search.search(table(spark, d, "documents"), [("lang", "AND", "en")])
    return search.page(rows.select("doc_id", "source", "n_chars"), ["doc_id"], number=2)


@query("SELECT doc_id, lag(doc_id) OVER w AS previous, lead(doc_id) OVER w AS next FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)")
def prev_next_nav(spark, d):
    return search.neighbours_in_order(table(spark, d, "documents"), "doc_id", "n_chars", "source").select("doc_id", "previous", "next")


@query("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS field, unnest([count(doc_id), count(text), count(lang), count(source), count(n_chars)]) AS n FROM documents")
def field_presence(spark, d):
    return search.field_presence(table(spark, d, "documents"))


@query("SELECT DISTINCT lang AS value FROM documents WHERE trim(lang) <> '' UNION SELECT 'missing'")
def type_dropdown(spark, d):
    return search.dropdown(table(spark, d, "documents"), "lang")


# Terms

@query(f"SELECT term, 'text' AS field, 'word' AS type, count(*) AS frequency FROM (SELECT unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def unique_terms_words(spark, d):
    return terms.unique_terms(table(spark, d, "documents"))


@query(f"WITH t AS (SELECT {TOKENS} AS w FROM documents), p AS (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM t WHERE len(w) > 1) SELECT w[i] || ' ' || w[i + 1] AS term, 'text' AS field, 'phrase' AS type, count(*) AS frequency FROM p GROUP BY 1")
def unique_terms_bigrams(spark, d):
    return terms.unique_terms(table(spark, d, "documents"), phrases=True)


@query(f"SELECT term, 'text' AS field, 'word' AS type, count(*) AS frequency FROM (SELECT unnest({TOKENS}) AS term FROM documents) WHERE contains(term, 'th') GROUP BY term ORDER BY frequency DESC, term LIMIT 100")
def top_terms_page(spark, d):
    rows = terms.unique_terms(table(spark, d, "documents")).where(S.contains(F.col("term"), "th"))
    return search.page(rows, [F.desc("frequency"), "term"], per_page=100)


@query(f"""WITH t AS (SELECT list_distinct({TOKENS}) AS w FROM documents), x AS (SELECT list_contains(w, 'license') AS hit, unnest(w) AS term FROM t),
n AS (SELECT count(*) AS n, count(*) FILTER (WHERE list_contains(w, 'license')) AS na FROM t),
c AS (SELECT term, count(*) AS doc_freq, count(*) FILTER (WHERE hit) AS co_docs FROM x WHERE term <> 'license' GROUP BY term HAVING count(*) >= 5 AND count(*) FILTER (WHERE hit) >= 3),
l AS (SELECT term, doc_freq, co_docs, ((co_docs + 1)::DOUBLE / (na + 2)) / ((doc_freq + 1)::DOUBLE / (n + 2)) AS x FROM c, n)
SELECT term, doc_freq, co_docs, {r6('x')} AS lift, {r6('log2(x)')} AS log2_lift FROM l""")
def term_lift(spark, d):
    return terms.term_lift(table(spark, d, "documents"), "license")


# Network

@query(f"WITH {EDGES} SELECT * FROM e")
def cooc_edges(spark, d):
    return network.cooccurrence_edges(mentions(spark, d))


@query(f"WITH {EDGES} SELECT src_type, dst_type, count(*) AS n_edges, {r6('avg(weight)')} AS avg_weight, max(weight) AS max_weight FROM e GROUP BY ALL")
def network_type_pair_stats(spark, d):
    return network.type_pair_stats(edges(spark, d))


@query(f"WITH {BOTH} SELECT *, CAST(sum(weight) OVER () AS BIGINT) AS weighted_degree FROM (SELECT other, other_type, weight, (SELECT count(*) FROM s WHERE node = 'PRIORITY:1-URGENT') AS degree FROM s WHERE node = 'PRIORITY:1-URGENT' ORDER BY weight DESC, other LIMIT 50)")
def ego_network(spark, d):
    return network.ego_network(mentions(spark, d), "PRIORITY:1-URGENT")


@query(f"WITH {EDGES} SELECT * FROM e WHERE src_type IN ('SUPPLIER', 'NATION') AND dst_type IN ('SUPPLIER', 'NATION') AND weight >= 3 ORDER BY weight DESC, src, dst LIMIT 500")
def global_network(spark, d):
    return network.global_network(edges(spark, d), ["SUPPLIER", "NATION"])


@query(f"""WITH {MENTIONS}, o AS MATERIALIZED (SELECT DISTINCT ent FROM m WHERE doc = 1), k AS MATERIALIZED (SELECT m.* FROM m JOIN o USING (ent))
SELECT a.ent AS src, b.ent AS dst, a.type AS src_type, b.type AS dst_type, count(*) AS weight FROM k a JOIN k b ON a.doc = b.doc AND a.ent < b.ent GROUP BY ALL HAVING count(*) >= 2""")
def document_network(spark, d):
    return network.document_network(mentions(spark, d), 1)


@query(f"WITH {BOTH} SELECT node, node_type, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree, max(weight) AS max_weight, first(other ORDER BY weight DESC, other DESC) AS strongest FROM s GROUP BY ALL")
def entity_metrics(spark, d):
    return network.entity_metrics(edges(spark, d))


@query(f"""WITH {BOTH}, o AS (SELECT DISTINCT ent FROM m WHERE doc = 1),
n AS (SELECT other AS ent FROM s WHERE node IN (FROM o) AND other NOT IN (FROM o) GROUP BY other ORDER BY max(weight) DESC, other LIMIT 100),
k AS (SELECT ent, 1 AS shared, 0 AS network FROM o UNION ALL SELECT ent, 0, 1 FROM n)
SELECT doc, CAST(sum(shared) AS BIGINT) AS shared, CAST(sum(network) AS BIGINT) AS network FROM m JOIN k USING (ent) WHERE doc <> 1 GROUP BY doc ORDER BY shared DESC, network DESC, doc LIMIT 10""")
def related_documents(spark, d):
    return network.related_documents(mentions(spark, d), 1)


@query(f"""WITH {EDGES}, t AS (SELECT * FROM e WHERE src_type <> dst_type AND weight >= 3 ORDER BY weight DESC, src, dst LIMIT 200),
h AS (SELECT a.doc, t.src, t.dst, t.weight FROM t JOIN m a ON a.ent = t.src JOIN m b ON b.ent = t.dst AND b.doc = a.doc),
n AS (SELECT doc, count(DISTINCT x) AS n_entities FROM (SELECT doc, src AS x FROM h UNION SELECT doc, dst FROM h) GROUP BY doc)
SELECT doc, CAST(sum(weight) AS BIGINT) AS score, count(*) AS n_edges, any_value(n_entities) AS n_entities FROM h JOIN n USING (doc) GROUP BY doc""")
def viewer_documents(spark, d):
    return network.viewer_documents(edges(spark, d), mentions(spark, d))


@query(f"WITH {MENTIONS} SELECT type, count(DISTINCT ent) AS n FROM m GROUP BY type")
def entity_types(spark, d):
    return mentions(spark, d).select("type", "ent").distinct().groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BOTH} SELECT * FROM (SELECT node, other, weight, CAST(row_number() OVER (PARTITION BY node ORDER BY weight DESC, other) AS INTEGER) AS rank FROM s) WHERE rank <= 3")
def top_neighbours(spark, d):
    return network.top_per_group(network.symmetric(edges(spark, d)).select("node", "other", "weight"), ["node"], [F.desc("weight"), "other"], 3)


# Statistics

@query(f"WITH {BOTH} SELECT count(*) AS n, min(degree) AS min, max(degree) AS max, {r6('avg(degree)')} AS mean, {r6('median(degree)')} AS median, {r6('stddev_samp(degree)')} AS stdev FROM d")
def degree_distribution(spark, d):
    return statistics.degree_summary(edges(spark, d))


@query(f"WITH {BOTH} SELECT degree, count(*) AS n FROM d GROUP BY degree")
def degree_histogram(spark, d):
    return statistics.degree_histogram(edges(spark, d))


@query(f"WITH {BOTH}, r AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM d) SELECT {r6('sum((2 * i - n + 1) * degree)::DOUBLE / (any_value(n) * sum(degree))')} AS gini FROM r")
def gini(spark, d):
    return statistics.gini(edges(spark, d))


#: A sparse graph with hubs: customers and suppliers with their nations, nations with their regions.
STAR = """e AS (SELECT 'C' || c_custkey AS src, 'N' || c_nationkey AS dst, 'C' AS src_type, 'N' AS dst_type, 1 AS weight FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'N', 'S', 1 FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'N', 'R', 1 FROM nation),
s AS (SELECT src AS node, dst AS other, weight FROM e UNION ALL SELECT dst, src, weight FROM e), d AS (SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM s GROUP BY ALL)"""


def places(spark, d):
    edge = lambda name, a, src, b, dst: table(spark, d, name).select(F.concat(F.lit(a), src).alias("src"), F.concat(F.lit(b), dst).alias("dst"), F.lit(a).alias("src_type"), F.lit(b).alias("dst_type"), F.lit(1).cast("long").alias("weight"))
    return edge("customer", "C", "c_custkey", "N", "c_nationkey").unionByName(edge("supplier", "N", "s_nationkey", "S", "s_suppkey")).unionByName(edge("nation", "N", "n_nationkey", "R", "n_regionkey"))


@query(f"WITH {STAR} SELECT node, degree, weighted_degree FROM d WHERE degree >= (SELECT avg(degree) + 2 * stddev_samp(degree) FROM d) ORDER BY degree DESC, node LIMIT 30")
def hubs(spark, d):
    return statistics.hubs(places(spark, d))


@query(f"""WITH {BOTH}, x AS (SELECT min(degree) AS xmin, count(*)::DOUBLE AS n FROM d), a AS (SELECT any_value(xmin) AS xmin, any_value(n) AS n, 1 + any_value(n) / sum(ln(degree::DOUBLE / xmin)) AS alpha FROM d, x),
h AS (SELECT degree, count(*)::DOUBLE AS c FROM d GROUP BY degree), u AS (SELECT degree, c, sum(c) OVER (ORDER BY degree ROWS UNBOUNDED PRECEDING) AS upto FROM h),
k AS (SELECT any_value(n) AS n, any_value(xmin) AS xmin, any_value(alpha) AS alpha, max(greatest(abs(upto / n - (1 - pow(degree::DOUBLE / xmin, 1 - alpha))), abs((upto - c) / n - (1 - pow(degree::DOUBLE / xmin, 1 - alpha))))) AS ks FROM u, a),
p AS (SELECT *, least(1, greatest(0, list_sum(list_transform(generate_series(1, 50), lambda j: 2 * pow(-1.0::DOUBLE, j - 1) * exp(-2.0::DOUBLE * j * j * n * ks * ks))))) AS p FROM k)
SELECT CAST(n AS BIGINT) AS n, xmin, {r6('alpha')} AS alpha, {r6('ks')} AS ks, {r6('p')} AS p_value, p > 0.1 AS plausible FROM p""")
def powerlaw_alpha(spark, d):
    return statistics.powerlaw_alpha(edges(spark, d))


@query(f"""WITH RECURSIVE {BOTH}, r AS (SELECT node, node AS far FROM d UNION SELECT r.node, s.other FROM r JOIN s ON r.far = s.node),
c AS (SELECT node, min(far) AS root FROM r GROUP BY node), z AS (SELECT root, count(*) AS size FROM c GROUP BY root)
SELECT (SELECT count(*) FROM d) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, {r6('2.0::DOUBLE * (SELECT count(*) FROM e) / ((SELECT count(*) FROM d) * ((SELECT count(*) FROM d) - 1))')} AS density, count(*) AS n_components, max(size) AS largest FROM z""")
def graph_summary(spark, d):
    return statistics.graph_summary(edges(spark, d))


@query(f"""WITH {BOTH}, o AS (SELECT src_type AS a, dst_type AS b, weight FROM e UNION ALL SELECT dst_type, src_type, weight FROM e WHERE src_type <> dst_type),
w AS (SELECT a, b, CAST(sum(weight) AS BIGINT) AS weight FROM o GROUP BY ALL), p AS (SELECT node_type AS t, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM d GROUP BY node_type),
x AS (SELECT p.t AS a, q.t AS b, coalesce(w.weight, 0) AS weight, p.p * q.p * (SELECT sum(weight) FROM w) AS expected FROM p CROSS JOIN p q LEFT JOIN w ON w.a = p.t AND w.b = q.t)
SELECT a, b, weight, {r6('expected')} AS expected, {r6('(weight - expected) / sqrt(expected)')} AS residual, abs((weight - expected) / sqrt(expected)) > 2 AS notable FROM x""")
def mixing_matrix(spark, d):
    return statistics.mixing(edges(spark, d))


@query(f"WITH {BOTH}, p AS (SELECT sum(n * n) / pow(sum(n), 2) AS q FROM (SELECT node_type, count(*)::DOUBLE AS n FROM s GROUP BY node_type)), t AS (SELECT count(*) FILTER (WHERE node_type = other_type)::DOUBLE / count(*) AS x FROM s) SELECT {r6('(x - q) / (1 - q)')} AS coefficient FROM p, t")
def assortativity(spark, d):
    return statistics.assortativity(edges(spark, d))


@query(f"WITH {BOTH}, k AS (SELECT node_type AS t, count(*)::DOUBLE AS d FROM s GROUP BY 1), l AS (SELECT src_type AS t, count(*)::DOUBLE AS l FROM e WHERE src_type = dst_type GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS m FROM e) SELECT {r6('sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m)))')} AS modularity FROM k LEFT JOIN l USING (t), n")
def modularity_by_type(spark, d):
    return statistics.modularity(edges(spark, d))


@query(f"""WITH {BOTH}, t AS (SELECT count(*) AS n_triangles FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = a.src AND c.dst = b.dst),
p AS (SELECT CAST(sum(degree * (degree - 1) // 2) AS BIGINT) AS n_triples FROM d) SELECT n_triangles, n_triples, {r6('3.0::DOUBLE * n_triangles / n_triples')} AS transitivity FROM t, p""")
def transitivity(spark, d):
    return statistics.triangles(edges(spark, d))


@query(f"""WITH j AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM j)
SELECT {r6('2 * sum(p * ln(p / (pa * pb))) / (-sum(p * ln(pa)) - sum(p * ln(pb)))')} AS nmi FROM p""")
def nmi(spark, d):
    return statistics.mutual_information(table(spark, d, "labels"), "quality", "toxic")


# People and strata

@query("SELECT coalesce(nullif(c_mktsegment, ''), 'unknown') AS label, count(*) AS n FROM customer GROUP BY 1")
def demo_counts(spark, d):
    return corpus.group_counts(table(spark, d, "customer"), F.col("c_mktsegment"), "label")


@query("SELECT coalesce(nullif(p_type, ''), 'unknown') AS occupation, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, occupation LIMIT 20")
def demo_top_occupations(spark, d):
    return corpus.group_counts(table(spark, d, "part"), F.col("p_type"), "occupation").orderBy(F.desc("n"), "occupation").limit(20)


@query("SELECT CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS decade, count(*) AS n FROM orders GROUP BY 1")
def demo_decades(spark, d):
    return table(spark, d, "orders").groupBy(corpus.decades(F.year("o_orderdate")).alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {r6('sum(l_quantity)')} AS total, {r6('avg(l_quantity) FILTER (WHERE l_discount > 0.05)')} AS mean_where, count(*) FILTER (WHERE l_discount > 0.05) AS n_where, max(l_quantity) AS largest FROM lineitem")
def demo_injury_stats(spark, d):
    return corpus.conditional_summary(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_discount") > 0.05)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%customer%' AND c_acctbal > 0 ORDER BY c_name NULLS FIRST, c_custkey LIMIT 25 OFFSET 25")
def demo_people_page(spark, d):
    rows = table(spark, d, "customer").where(F.col("c_name").ilike("%customer%") & (F.col("c_acctbal") > 0))
    return search.page(rows.select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_custkey"], 2, 25)


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n, least(count(*), 100) AS sample_size FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*), least(count(*), 100) FROM documents WHERE source IS NOT NULL GROUP BY source")
def strata_facets(spark, d):
    return corpus.strata(table(spark, d, "documents"), ["lang", "source"])


@query("""WITH s AS (SELECT 'lang' AS facet, lang AS value, count(*) AS n, least(count(*), 100) AS sample_size FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*), least(count(*), 100) FROM documents WHERE source IS NOT NULL GROUP BY source),
b AS (SELECT *, coalesce(sum(sample_size) OVER (ORDER BY facet, n DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT facet, value, n, CAST(least(sample_size, 450 - before) AS BIGINT) AS sample_size FROM b WHERE before < 450""")
def strata_balanced_trim(spark, d):
    return corpus.trim_to_budget(corpus.strata(table(spark, d, "documents"), ["lang", "source"]), 450, ["facet", F.desc("n"), "value"])


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('s' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 5")
def strata_sample(spark, d):
    return corpus.sample_strata(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@query("WITH y AS (SELECT DISTINCT p_size * p_size // 10 * 10 AS decade FROM part) SELECT CAST(x AS BIGINT) AS decade FROM (SELECT unnest(generate_series((SELECT min(decade) FROM y), (SELECT max(decade) FROM y), 10)) AS x) WHERE x NOT IN (SELECT decade FROM y)")
def decade_gaps(spark, d):
    return corpus.decade_gaps(table(spark, d, "part"), F.col("p_size") * F.col("p_size"))


@query("SELECT lower(trim(event_type)) AS key, first(event_type ORDER BY event_id) AS name, count(*) AS document_count, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY 1")
def notebook_entity_merge(spark, d):
    return corpus.merge_entities(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq")))


@query("SELECT source, CASE WHEN count(*) >= 60 THEN 'high' WHEN count(*) >= 40 THEN 'medium' ELSE 'low' END AS confidence FROM documents GROUP BY source")
def pattern_confidence(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(corpus.confidence(F.count(F.lit(1)), 60, 40).alias("confidence"))


@query("SELECT item_id, CASE WHEN s >= 80 THEN 'excellent' WHEN s >= 70 THEN 'good' WHEN s >= 60 THEN 'acceptable' WHEN s >= 50 THEN 'needs_refinement' ELSE 'rejected' END AS status FROM (SELECT item_id, length(text) % 101 AS s FROM benchmark)")
def validation_status(spark, d):
    return table(spark, d, "benchmark").select("item_id", corpus.validation_status(F.char_length("text") % 101).alias("status"))


@query(f"""WITH z AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT 1000000 + item_id, 'Really ' || text || ' then?' FROM benchmark WHERE item_id % 3 = 0),
s AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM z), j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS u FROM s a JOIN s b ON a.id < b.id)
SELECT a, b, {r6('n::DOUBLE / u')} AS jaccard FROM j WHERE n::DOUBLE / u >= 0.85""")
def question_near_dup(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    again = rows.where("id % 3 = 0").select(F.col("id") + 1000000, F.concat(F.lit("Really "), "text", F.lit(" then?")))
    return corpus.similar_questions(rows.union(again), 0.85)


# Retrieval

KNN = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings),
p AS (SELECT q.vec_id AS query_id, v.vec_id, {r6('list_inner_product(q.e, v.e) / (q.n * v.n)')} AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)"""


def _neighbours(spark, d, k):
    rows = table(spark, d, "embeddings")
    return retrieval.cosine_neighbours(rows, rows.where("vec_id % 20 = 0"), k)


@query(f"WITH {KNN} SELECT * FROM k WHERE rank <= 5")
def knn_cosine(spark, d):
    return _neighbours(spark, d, 5)


@query(f"WITH {KNN} SELECT query_id, count(*) FILTER (WHERE score >= 0.8) AS strong, count(*) FILTER (WHERE score >= 0.65 AND score < 0.8) AS fair, count(*) FILTER (WHERE score < 0.65) AS weak, {r6('avg(score)')} AS mean, max(score) AS best, min(score) AS worst FROM k WHERE rank <= 20 GROUP BY query_id")
def meaning_buckets(spark, d):
    return retrieval.meaning_buckets(_neighbours(spark, d, 20))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under') ORDER BY doc_id LIMIT 20")
def keyword_retrieve(spark, d):
    return retrieval.keyword_hits(table(spark, d, "documents"), "Licensed under")


@query(f"""WITH {KNN}, l AS (SELECT query_id, vec_id AS doc, rank FROM k WHERE rank <= 10 UNION ALL SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS INTEGER) FROM k WHERE rank <= 20 AND vec_id % 3 = 0),
f AS (SELECT query_id, doc, {r6('sum(1.0::DOUBLE / (60 + rank))')} AS rrf FROM l GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc) AS INTEGER) AS rank FROM f""")
def rrf_fusion(spark, d):
    near = _neighbours(spark, d, 20)
    one = near.where("rank <= 10").select("query_id", F.col("vec_id").alias("doc"), "rank")
    order = network.top_per_group(near.where("vec_id % 3 = 0").drop("rank", "score"), ["query_id"], ["vec_id"], 20)
    return retrieval.reciprocal_rank_fusion(one.unionByName(order.withColumnRenamed("vec_id", "doc")))


@query(f"SELECT event_id, {r6('0.85 / (1 + exp(-value / 50)) + 0.10 * 0.5 + 0.05 * 0.5')} AS score FROM events")
def rerank_sigmoid(spark, d):
    return table(spark, d, "events").select("event_id", S.round6(retrieval.rerank_score(F.col("value") / 50, F.lit(0.5), F.lit(0.5))).alias("score"))


@query("""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(1, ceil((length(text) - 200) / 800.0))::INT - 1)) AS i FROM documents WHERE text <> '')
SELECT printf('%d_chunk_%03d', doc_id, i) AS chunk_id, doc_id, CAST(i AS INTEGER) AS chunk_index, md5(substring(text, i * 800 + 1, 1000)) AS digest, CAST(length(substring(text, i * 800 + 1, 1000)) // 4 AS BIGINT) AS token_count FROM c""")
def chunk_fixed(spark, d):
    return retrieval.fixed_chunks(table(spark, d, "documents")).select("chunk_id", "doc_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("digest"), "token_count")


@query(r"SELECT doc_id, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'the') AS INT) + CASE WHEN regexp_matches(text, '\b(?:18|19|20)\d{2}\b') THEN 2 ELSE 0 END - CASE WHEN len(text) - len(replace(text, '?', '')) >= 3 THEN 1 ELSE 0 END AS score FROM documents")
def snippet_scoring(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.snippet_score(F.col("text"), ["license", "the"]).alias("score"))


# Entities

@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b[A-Z]*\d{3,5}[A-Z]?\b'))), ',') AS ids FROM documents")
def employee_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(entities.employee_ids(F.col("text")), ",").alias("ids"))


#: Parts' names and brands as people's names in the forms that are parsed.
NAMES = """n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ', ' || p_name WHEN 2 THEN p_brand WHEN 3 THEN p_name || '  ' || p_brand WHEN 4 THEN p_brand || ', A, B' ELSE ' ' || p_type || ',' END AS x FROM part)"""


@query(f"""WITH {NAMES}, w AS (SELECT p_partkey, trim(x) AS x, list_filter(string_split_regex(trim(x), '\\s+'), lambda y: y <> '') AS w,
  list_filter(string_split_regex(trim(substring(trim(x), instr(trim(x), ',') + 1)), '\\s+'), lambda y: y <> '') AS r, contains(x, ',') AS c FROM n),
p AS (SELECT p_partkey, coalesce(CASE WHEN c THEN r[1] ELSE w[1] END, '') AS first, coalesce(CASE WHEN c THEN r[2] WHEN len(w) > 2 THEN w[2] END, '') AS middle,
  CASE WHEN c THEN trim(split_part(x, ',', 1)) WHEN len(w) > 1 THEN w[-1] ELSE '' END AS last FROM w)
SELECT *, trim(first || ' ' || middle || ' ' || last) AS "full" FROM p""")
def name_parse(spark, d):
    k = F.col("p_partkey") % 6
    x = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_brand", F.lit(", "), "p_name")).when(k == 2, F.col("p_brand")).when(k == 3, F.concat("p_name", F.lit("  "), "p_brand"))
    x = x.when(k == 4, F.concat("p_brand", F.lit(", A, B"))).otherwise(F.concat(F.lit(" "), "p_type", F.lit(",")))
    return table(spark, d, "part").select("p_partkey", entities.parse_name(x).alias("x")).select("p_partkey", "x.*")


@query(f"WITH {MENTIONS} SELECT lower(ent) AS term, type, count(*) AS frequency, min(doc) AS first_doc, max(doc) AS last_doc FROM m GROUP BY 1, 2")
def entity_aggregate(spark, d):
    return entities.aggregate_entities(mentions(spark, d))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type), '[.\-]', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM part")
def occupation_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", entities.normalise_label(F.col("p_type")).alias("label"))


# Streams, run here over the whole table

@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, {r6('sum(value)')} AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return stream.windowed(table(spark, d, "events"))


@query(f"WITH x AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events) SELECT window_start, event_type, count(*) AS n, {r6('sum(value)')} AS total FROM x GROUP BY ALL")
def events_sliding(spark, d):
    return stream.windowed(table(spark, d, "events"), "1 hour", "30 minutes")


@query("""WITH f AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k""")
def events_session(spark, d):
    return stream.sessions(table(spark, d, "events"))


@query("SELECT event_id, user_id, count(*) OVER w AS seen, CAST(sum(CAST(event_type = 'error' AS INT)) OVER w AS BIGINT) AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_progress(spark, d):
    return stream.running_progress(table(spark, d, "events"))


@query("""WITH x AS (SELECT event_id, lower(CASE event_id % 7 WHEN 0 THEN 'Traceback (most recent' WHEN 1 THEN 'All DONE' WHEN 2 THEN '=== begin' WHEN 3 THEN 'Finished' WHEN 4 THEN 'Exception!' ELSE event_type END) AS m FROM events)
SELECT event_id, CASE WHEN regexp_matches(m, 'error|failed|exception|traceback') THEN 'error' WHEN contains(m, 'warn') THEN 'warning' WHEN regexp_matches(m, 'complete|success|done|finished') THEN 'success'
  WHEN regexp_matches(m, '===|starting|begin|---') THEN 'primary' ELSE 'info' END AS level FROM x""")
def log_level_inference(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("Traceback (most recent", "All DONE", "=== begin", "Finished", "Exception!")]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.level_of(F.when(F.col("event_id") % 7 < 5, said).otherwise(F.col("event_type"))).alias("level"))
