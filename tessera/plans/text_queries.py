"""Registered queries over running text and research questions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import texts as T
from tessera.operators import questions as Q
from tessera.plans.queries import query
from tessera.sources.tables import table

#: Questions made of the documents' fields, in the forms that the predicates tell apart.
QUESTIONS = """q AS (SELECT doc_id AS id, CASE doc_id % 8
  WHEN 0 THEN 'Why did wages in ' || coalesce(source, 'none') || ' fall compared to the relief department of ' || coalesce(lang, 'none') || '?'
  WHEN 1 THEN 'What was the occupation of ' || coalesce(source, 'none')
  WHEN 2 THEN 'How did rules and criteria at ' || coalesce(source, 'none') || ' change between 1890 and 1910 for injured brakeman crews?'
  WHEN 3 THEN 'Who is John Smith'
  WHEN 4 THEN 'Which group benefited under what conditions in the pattern of [name]?'
  WHEN 5 THEN 'What happened to Mary A. Jones''s family in ' || coalesce(lang, 'none') || '?'
  WHEN 6 THEN 'What was the Yard of Camden'
  ELSE '' END AS question,
  ['causal', 'comparative', 'distributional', 'institutional', 'scope_conditions', 'change_over_time'][doc_id % 6 + 1] AS kind,
  CAST(n_chars % 30 AS INTEGER) AS evidence, CAST(n_chars % 101 AS INTEGER) AS score, doc_id % 5 = 0 AS has_pattern, doc_id % 7 = 0 AS has_contradiction,
  doc_id % 3 = 0 AS has_window, doc_id % 4 = 0 AS has_entities FROM documents)"""
LENS = ["Injury claims", "wages"]
THEMES = {"labour": ("wage", "brakeman", "crew"), "family": ("family", "mary"), "rules": ("rule", "criteria", "group")}
AXES = {"women": ("women", "female", "mary"), "money": ("dollar", "payout"), "race": ("race", "ethnicity")}


def questions(spark, d):
    text = lambda x: F.coalesce(x, F.lit("none"))
    forms = [
        F.concat(F.lit("Why did wages in "), text("source"), F.lit(" fall compared to the relief department of "), text("lang"), F.lit("?")),
        F.concat(F.lit("What was the occupation of "), text("source")),
        F.concat(F.lit("How did rules and criteria at "), text("source"), F.lit(" change between 1890 and 1910 for injured brakeman crews?")),
        F.lit("Who is John Smith"),
        F.lit("Which group benefited under what conditions in the pattern of [name]?"),
        F.concat(F.lit("What happened to Mary A. Jones's family in "), text("lang"), F.lit("?")),
        F.lit("What was the Yard of Camden"),
        F.lit(""),
    ]
    kinds = F.array(*[F.lit(k) for k in ("causal", "comparative", "distributional", "institutional", "scope_conditions", "change_over_time")])
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        n.alias("id"), F.element_at(F.array(*forms), (n % 8 + 1).cast("int")).alias("question"), F.element_at(kinds, (n % 6 + 1).cast("int")).alias("kind"),
        (F.col("n_chars") % 30).cast("int").alias("evidence"), (F.col("n_chars") % 101).cast("int").alias("score"), (n % 5 == 0).alias("has_pattern"),
        (n % 7 == 0).alias("has_contradiction"), (n % 3 == 0).alias("has_window"), (n % 4 == 0).alias("has_entities"),
    )


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _count(text: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + ")"


# Text functions

@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]{1,}')) AS BIGINT) AS any, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS BIGINT) AS three, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]{4,}'), ' ')) AS four FROM documents WHERE text IS NOT NULL")
def ascii_token_variants(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.ascii_tokens(x)).cast("long").alias("any"), F.size(T.ascii_tokens(x, 3)).cast("long").alias("three"), F.md5(F.array_join(T.ascii_tokens(x, 4), " ")).alias("four"))


@query(rf"SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(regexp_replace(lower(trim(coalesce(text, ''))), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: len(w) > 2 AND NOT list_contains({_list(T.STOP_WORDS)}, w)), ' ')) AS words FROM documents")
def plain_word_list(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(T.plain_words(F.col("text")), " ")).alias("words"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]{{2,}}'), lambda w: NOT list_contains({_list(T.STOP_WORDS)}, w)) AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(word) DESC, i) AS r FROM x)
SELECT doc_id, string_agg(word, ' ' ORDER BY r) AS words FROM r WHERE r <= 6 GROUP BY doc_id""")
def longest_content_words(spark, d):
    words = F.array_join(T.content_words(F.col("text")), " ")
    return table(spark, d, "documents").select("doc_id", words.alias("words")).where("words <> ''")


@query("SELECT doc_id, md5(CASE WHEN len(string_split(text, ' ')) > 20 THEN array_to_string(string_split(text, ' ')[1:20], ' ') || '…' ELSE text END) AS head FROM documents WHERE text IS NOT NULL")
def capped_words(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.cap_words(F.col("text"), 20)).alias("head"))


@query(r"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Date: June ' || year(o_orderdate) WHEN 1 THEN 'Dated ' || year(o_orderdate) || ' at 2001' WHEN 2 THEN 'Date of Injury: 3/' || year(o_orderdate) ELSE 'In ' || year(o_orderdate) END AS x FROM orders)
SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(x, '(?i)\bdate[d]?(?:\s+of\s+\w+)?\s*:?\s*[^\n]{0,30}?\b((?:18|19|20)\d{2})\b', 1), '') AS INTEGER) AS year FROM s""")
def labelled_years(spark, d):
    y, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    x = F.when(k == 0, F.concat(F.lit("Date: June "), y)).when(k == 1, F.concat(F.lit("Dated "), y, F.lit(" at 2001"))).when(k == 2, F.concat(F.lit("Date of Injury: 3/"), y)).otherwise(F.concat(F.lit("In "), y))
    return table(spark, d, "orders").select("o_orderkey", T.labelled_year(x).alias("year"))


ASKED = "How did the License of Thorn and St. change in 1905 under the rest?"


@query("""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE """ + _count("t", ["1905", "and", "change", "how", "license", "rest", "the", "thorn", "under"]) + " + 2 * " + _count("t", ["how", "license", "thorn"]) + " + 2 * " + _count("t", ["1905"]) + " - CASE WHEN " + _any("t", T.FORM_PHRASES) + " THEN 2 ELSE 0 END - CASE WHEN len(t) - len(replace(t, '?', '')) >= 3 THEN 1 ELSE 0 END END AS score FROM x")
def evidence_scores(spark, d):
    return table(spark, d, "documents").select("doc_id", T.evidence_score(F.col("text"), ASKED).alias("score"))


@query("""WITH x AS (SELECT doc_id, text, coalesce(nullif(instr(lower(text), 'licensed'), 0), nullif(instr(lower(text), 'thing'), 0), nullif(instr(lower(text), 'the'), 0)) - 1 AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN i IS NULL THEN left(text, 700) ELSE substring(text, greatest(0, i - 300) + 1, i + 400 - greatest(0, i - 300)) END) AS part FROM x""")
def evidence_windows(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.best_window(F.col("text"), ["the", "licensed", "thing"])).alias("part"))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS para, unnest(generate_series(1, len(string_split(text, chr(10))))) AS p FROM documents WHERE text <> ''),
s AS (SELECT doc_id, p, list_filter(list_transform(string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM p),
e AS (SELECT doc_id, p, len(s) AS n, unnest(s) AS sentence, unnest(generate_series(1, len(s))) AS i FROM s WHERE len(s) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(sentence) ORDER BY p, i) AS copy FROM e),
g AS (SELECT doc_id, p, count(*) AS kept, string_agg(sentence, ' ' ORDER BY i) AS para FROM k WHERE copy = 1 GROUP BY doc_id, p HAVING count(*) >= greatest(1, any_value(n) // 2))
SELECT doc_id, count(*) AS n_paragraphs, md5(string_agg(para, chr(10) ORDER BY p)) AS essay FROM g GROUP BY doc_id""")
def repeated_sentences(spark, d):
    from tessera.operators.records import without_repeated_sentences

    done = without_repeated_sentences(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", "\n")
    return done.select("doc_id", "n_paragraphs", F.md5("essay").alias("essay"))


@query("SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END), ''), nullif(trim(c_name), '')) AS text, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS number FROM customer")
def entity_text(spark, d):
    n = F.col("c_custkey")
    number = F.when(n % 10 == 0, float("nan")).when(n % 5 == 0, float("inf")).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", T.first_text(F.when(n % 3 == 0, "  ").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("text"), T.json_number(number).alias("number"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 2 THEN CAST(trunc(p_retailprice) AS INTEGER) END AS score FROM part")
def coerced_scores(spark, d):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, F.concat(F.lit(" "), "p_size", F.lit(".0"))).when(k == 2, F.col("p_retailprice").cast("string")).otherwise("eighty")
    return table(spark, d, "part").select("p_partkey", T.whole_number(said).alias("score"))


@query("""SELECT p_partkey, p_name AS name, p_size AS size FROM part WHERE p_partkey % 5 <> 4 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 5 = 4""")
def fenced_json(spark, d):
    body = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "size": '), "p_size", F.lit("}"))
    k = F.col("p_partkey") % 5
    said = F.when(k < 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("``` "), body, F.lit("```"))).when(k == 3, body).otherwise("no json")
    read = F.from_json(T.unfenced_json(said), "name string, size int")
    return table(spark, d, "part").select("p_partkey", read.alias("x")).select("p_partkey", "x.name", "x.size")


# Questions

@query(f"""WITH {QUESTIONS}, w AS (SELECT *, list_filter(string_split_regex(question, '\\s+'), lambda w: w <> '') AS w FROM q)
SELECT id, trim(question) = '' OR {' OR '.join(f"starts_with(trim(lower(question)), '{p}')" for p in Q.FACTOID_OPENINGS)} OR regexp_matches(question, '{Q.POSSESSIVE.replace("'", "''")}')
  OR (regexp_matches(question, '{Q.WHAT_IS}') AND len(w) < 15 AND len(list_filter(w[2:], lambda x: substring(x, 1, 1) <> lower(substring(x, 1, 1)) AND NOT list_contains({_list(Q.COMMON_WORDS)}, rtrim(lower(x), '?.,;:''"')) AND len(x) > 1)) > 0) AS factoid FROM w""")
def factoid_questions(spark, d):
    return questions(spark, d).select("id", Q.is_factoid(F.col("question")).alias("factoid"))


@query(f"WITH {QUESTIONS}, x AS (SELECT *, trim(lower(question)) AS l FROM q) SELECT id, CASE WHEN l = '' THEN 'empty' WHEN regexp_matches(l, '\\[[^\\]]+\\]') THEN 'placeholder' " + " ".join(f"WHEN kind = '{k}' AND NOT {_any('l', w)} THEN 'not_{k}'" for k, w in Q.MARKERS.items()) + " WHEN contains(l, 'pattern') AND NOT has_pattern THEN 'vague_pattern' END AS fault FROM x")
def question_critique(spark, d):
    return questions(spark, d).select("id", Q.critique(F.col("question"), F.col("kind"), F.col("has_pattern")).alias("fault"))


@query(f"""WITH {QUESTIONS}, x AS (SELECT id, least(25, 5 + 2 * evidence) AS answerability, least(25, 10 + CASE WHEN kind IN ('causal', 'comparative') THEN 6 ELSE 0 END + CASE WHEN has_pattern OR has_contradiction THEN 5 ELSE 0 END) AS significance,
  least(25, 8 + CASE WHEN has_window THEN 6 ELSE 0 END + CASE WHEN has_entities THEN 6 ELSE 0 END + CASE WHEN len(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> '')) > 10 THEN 4 ELSE 0 END) AS specificity,
  least(25, 6 + CASE WHEN has_pattern OR has_contradiction THEN 8 ELSE 0 END + least(11, evidence)) AS evidence_based FROM q)
SELECT id, CAST(least(100, answerability + significance + specificity + evidence_based) AS BIGINT) AS total, CAST(answerability AS BIGINT) AS answerability, CAST(significance AS BIGINT) AS significance, CAST(specificity AS BIGINT) AS specificity, CAST(evidence_based AS BIGINT) AS evidence_based FROM x""")
def question_scores(spark, d):
    x = Q.heuristic_scores(F.col("question"), F.col("kind"), F.col("evidence"), F.col("has_pattern") | F.col("has_contradiction"), F.col("has_window"), F.col("has_entities"))
    return questions(spark, d).select("id", x.alias("x")).select("id", "x.*")


TERMS = Q.lens_terms(LENS)
LENS_SQL = "(" + " + ".join(f"CASE WHEN contains(lower(question), '{t}') THEN 3 ELSE " + (" + ".join(f"CAST(contains(lower(question), '{w}') AS INTEGER)" for w in t.split() if len(w) >= 4) or "0") + " END" for t in TERMS) + ")"


@query(f"WITH {QUESTIONS} SELECT id, {LENS_SQL} AS lens FROM q")
def question_lens(spark, d):
    return questions(spark, d).select("id", Q.lens_score(F.col("question"), TERMS).alias("lens"))


@query(f"WITH {QUESTIONS} SELECT id FROM q WHERE score >= 60 AND evidence >= CASE WHEN has_contradiction THEN 2 ELSE 10 END")
def question_filters(spark, d):
    return Q.enough_evidence(Q.else_all(questions(spark, d), F.col("score") >= 60), 10).select("id")


@query(f"WITH {QUESTIONS} SELECT id FROM q WHERE (SELECT max(score) FROM q) < 1000")
def question_filter_fallback(spark, d):
    return Q.else_all(questions(spark, d), F.col("score") >= 1000).select("id")


@query(f"""WITH {QUESTIONS}, l AS (SELECT *, {LENS_SQL} AS lens FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY trim(lower(question)) ORDER BY lens DESC, score DESC, evidence DESC, id) AS copy FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY lens > 0 ORDER BY lens DESC, score DESC, evidence DESC, id) AS within FROM o WHERE copy = 1),
r AS (SELECT *, row_number() OVER (ORDER BY lens > 0 AND within > 7, lens DESC, score DESC, evidence DESC, id) AS place FROM u)
SELECT id, lens, score, evidence, CAST(place AS INTEGER) AS place FROM r WHERE place <= 10""")
def question_ranking(spark, d):
    return Q.rank_questions(questions(spark, d), TERMS, 10).select("id", "lens", "score", "evidence", "place")


@query(f"""WITH {QUESTIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) > 1 AS later, (SELECT count(DISTINCT kind) FROM q) >= 9 AS enough FROM q)
SELECT id, kind, CAST(row_number() OVER (ORDER BY CASE WHEN enough THEN false ELSE later END, id) AS INTEGER) AS place FROM f""")
def question_diversity(spark, d):
    return Q.diverse(questions(spark, d), 9).select("id", "kind", "place")


@query(f"WITH {QUESTIONS} " + " UNION ALL ".join(f"SELECT '{a}' AS axis, '{', '.join(w)}' AS missing WHERE NOT (SELECT bool_or({_any('lower(question)', w)}) FROM q)" for a, w in AXES.items()))
def question_gaps(spark, d):
    return Q.gaps(questions(spark, d).select(F.col("question").alias("text")), AXES)


@query(f"""WITH {QUESTIONS}, s AS (SELECT id, lower(question) AS l FROM q), n AS (SELECT id, {', '.join(f"{_count('l', w)} AS {t}" for t, w in THEMES.items())} FROM s)
SELECT id, CASE WHEN greatest(labour, family, rules) = 0 THEN 'other' WHEN labour >= family AND labour >= rules THEN 'labour' WHEN family >= rules THEN 'family' ELSE 'rules' END AS theme FROM n""")
def question_themes(spark, d):
    return questions(spark, d).select("id", Q.theme_of(F.col("question"), THEMES).alias("theme"))


@query(f"WITH {QUESTIONS} SELECT id, question = '' OR regexp_matches(lower(question), '\\b[a-f0-9]{{8,}}\\b') OR (regexp_matches(question, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b') AND len(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> '')) < 18) OR evidence BETWEEN 1 AND 2 AS specific FROM q")
def too_specific_questions(spark, d):
    return questions(spark, d).select("id", Q.too_specific(F.col("question"), F.col("evidence")).alias("specific"))


@query(rf"""WITH a AS (SELECT item_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z][a-z''-]{{2,}}'), lambda w: NOT list_contains({_list(T.STOP_WORDS)}, w)) AS w FROM benchmark),
x AS (SELECT id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(word) DESC, i) AS r FROM x),
c AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z''-]{{2,}}')) AS w FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id AS doc, unnest(w) AS word FROM c),
m AS (SELECT id, least(50, count(DISTINCT doc)) AS n_docs FROM r JOIN h USING (word) WHERE r <= 6 GROUP BY id)
SELECT a.id, coalesce(n_docs, 0) AS n_docs, CASE WHEN coalesce(n_docs, 0) < 5 THEN 'too_few' WHEN n_docs > 200 THEN 'too_many' ELSE 'ok' END AS status FROM a LEFT JOIN m USING (id)""")
def question_answerability(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return Q.answerability(asked, table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))
