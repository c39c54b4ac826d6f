"""Phrase extraction and value matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundscope.operators import match, profile
from groundscope.operators.joins import join_few
from groundscope.plans import inputs
from groundscope.plans.registry import query
from groundscope.session import cut_lineage
from groundscope.sources.tables import read_table

PHRASE_STOP = "['what','which','where','when','whose','show','list','give','find','return','with','from','that','this','have','has','had','each','every','their','there','than','then','into','about']"
CONCEPT_STOP = "['what','which','who','where','when','please','give','show','list','find','return','have','with','from','that','this','them','their','being','all','the','and','for','are','was','were','had','has','how','many','much','of','in','to','is','a','an','on','by','at','as']"


def _runs(column: str, width: int) -> str:
    return (
        f"list_transform(range(1, greatest(len({column}) - {width - 2}, 1)), lambda i: "
        f"array_to_string({column}[i:i + {width - 1}], ' '))"
    )


PHRASES_SQL = f"""q AS (SELECT question_id, trim(string_split(question, 'Benchmark evidence:')[1]) AS spoken FROM asked),
w AS (SELECT *, list_filter(regexp_extract_all(spoken, '[A-Za-z][A-Za-z0-9_.-]+'),
 lambda x: (NOT list_contains({PHRASE_STOP}, lower(x)))) AS words,
 list_filter(regexp_extract_all(spoken, '[A-Za-z][A-Za-z0-9_-]*'),
 lambda x: (NOT list_contains({CONCEPT_STOP}, lower(x)) AND length(x) > 2)) AS useful FROM q),
c AS (SELECT question_id, spoken, useful, list_concat(regexp_extract_all(spoken, '[''"]([^''"\\n]{{1,120}})[''"]', 1),
 list_concat(regexp_extract_all(spoken, '[$£€¥]?[+-]?\\d[\\d,.]*(?:\\s*%)?|\\b\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}\\b'),
 list_concat(regexp_extract_all(spoken, '\\b[A-Z][\\w.-]*(?:\\s+[A-Z][\\w.-]*){{0,3}}\\b'),
 list_concat(words, list_concat({_runs('words', 2)}, {_runs('words', 3)}))))) AS l FROM w),
e AS (SELECT question_id, spoken, i::INT - 1 AS pos, trim(l[i::INT]) AS phrase FROM c, range(1, 400) r(i) WHERE i <= len(l)),
f AS (SELECT question_id, lower(phrase) AS normalized, min(pos) AS pos, arg_min(phrase, pos) AS phrase,
 any_value(spoken) AS spoken FROM e WHERE length(phrase) >= 2 GROUP BY 1, 2),
base AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY pos) <= 80)"""


@query(
    "phrases",
    f"WITH asked AS ({inputs.PART_QUESTIONS_SQL} UNION ALL {inputs.CUSTOMER_QUESTIONS_SQL}), {PHRASES_SQL} "
    "SELECT question_id, pos, phrase, normalized FROM base",
)
def phrases(spark, sf):
    """T6, T11, W4 over the question of every part and customer."""
    asked = inputs.part_questions(spark, sf).unionByName(inputs.customer_questions(spark, sf))
    return match.question_phrases(asked).select("question_id", "pos", "phrase", "normalized")


@query(
    "concept_phrases",
    f"""WITH asked AS ({inputs.PART_QUESTIONS_SQL} UNION ALL {inputs.CUSTOMER_QUESTIONS_SQL}), {PHRASES_SQL},
m AS (SELECT question_id, spoken, list_concat(useful, list_concat({_runs('useful', 2)}, {_runs('useful', 3)})) AS l FROM c),
more AS (SELECT question_id, spoken, 1000000 + i::INT - 1 AS pos, l[i::INT] AS phrase FROM m, range(1, 400) r(i) WHERE i <= len(l)),
u AS (SELECT question_id, spoken, pos, phrase, lower(phrase) AS normalized FROM more
 UNION ALL SELECT question_id, spoken, pos, phrase, normalized FROM base),
k AS (SELECT question_id, normalized, min(pos) AS pos, arg_min(phrase, pos) AS phrase FROM u
 WHERE NOT list_contains({CONCEPT_STOP}, normalized) AND length(normalized) > 0
 AND (length(normalized) >= 2 OR regexp_full_match(normalized, '[0-9]+'))
 AND (NOT regexp_full_match(normalized, '[0-9]+') OR
 regexp_matches(spoken, '(^|[^A-Za-z0-9])' || normalized || '($|[^A-Za-z0-9])')) GROUP BY 1, 2)
SELECT question_id, pos, phrase, normalized FROM k
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY pos) <= 100""",
)
def concept_phrases(spark, sf):
    """T7 over the same questions."""
    asked = inputs.part_questions(spark, sf).unionByName(inputs.customer_questions(spark, sf))
    return match.concept_phrases(asked)


@query("spoken_phrases")
def spoken_phrases(spark, sf):
    """T7 over every user turn, whole texts in four languages."""
    return match.concept_phrases(inputs.spoken_questions(spark, sf))


LADDER_SQL = f"""WITH idx AS ({inputs.INDEX_SQL}), ph AS ({inputs.NAME_PHRASES_SQL}),
pairs AS (SELECT l, r FROM (SELECT DISTINCT normalized AS l FROM ph), (SELECT DISTINCT normalized AS r FROM idx)),
g AS (SELECT l, r, list_distinct(regexp_extract_all(l, '[a-z0-9]+')) AS lt, list_distinct(regexp_extract_all(r, '[a-z0-9]+')) AS rt,
 regexp_replace(l, '[^a-z0-9]+', '', 'g') AS lc, regexp_replace(r, '[^a-z0-9]+', '', 'g') AS rc FROM pairs),
h AS (SELECT *, CASE WHEN length(lc) < 3 THEN [lc] ELSE list_distinct(list_transform(range(1, length(lc) - 1), lambda i: lc[i:i + 2])) END AS lg,
 CASE WHEN length(rc) < 3 THEN [rc] ELSE list_distinct(list_transform(range(1, length(rc) - 1), lambda i: rc[i:i + 2])) END AS rg FROM g),
s AS (SELECT l, r, CASE WHEN l = r THEN 'exact_normalized_value'
 WHEN length(l) >= 3 AND (contains(r, l) OR contains(l, r)) AND least(length(l), length(r)) >= 0.75 * greatest(length(l), length(r))
 THEN 'contained_normalized_value' WHEN regexp_matches(l || r, '[0-9]') THEN NULL
 WHEN len(list_intersect(lt, rt)) >= 0.5 * len(list_distinct(list_concat(lt, rt))) THEN 'value_token_overlap'
 WHEN len(list_intersect(lg, rg)) >= 0.65 * len(list_distinct(list_concat(lg, rg))) THEN 'value_character_similarity' END AS rule FROM h),
scored AS (SELECT l, r, rule, CASE rule WHEN 'exact_normalized_value' THEN 0.99 WHEN 'contained_normalized_value' THEN 0.91
 WHEN 'value_token_overlap' THEN 0.84 ELSE 0.78 END::DOUBLE AS score FROM s WHERE rule IS NOT NULL)
"""


@query("match_ladder", LADDER_SQL + 'SELECT l AS "left", r AS "right", rule, score FROM scored')
def match_ladder(spark, sf):
    """T8, all rungs over distinct phrases and distinct stored values."""
    lefts = inputs.name_phrases(spark, sf).select(F.col("normalized").alias("left")).distinct()
    rights = inputs.text_index(spark, sf).select(F.col("normalized").alias("right")).distinct()
    return match.scored_pairs(lefts, rights).select("left", "right", "rule", "score")


@query(
    "match_contained",
    LADDER_SQL
    + """, hit AS (SELECT l, r FROM pairs WHERE l = r OR (length(l) >= 3 AND contains(r, l)) OR (length(r) >= 3 AND contains(l, r)))
SELECT question_id, arg_min(phrase, pos) AS phrase, table_name, column_name, original, frequency
FROM ph JOIN hit ON ph.normalized = l JOIN idx ON idx.normalized = r GROUP BY question_id, table_name, column_name, original, frequency""",
)
def match_contained(spark, sf):
    """J7, E10 value facts: equal or contained either way, first phrase kept."""
    found = match.phrase_values(inputs.name_phrases(spark, sf), inputs.text_index(spark, sf))
    return found.select("question_id", "phrase", "table_name", "column_name", "original", "frequency")


@query(
    "match_terms",
    f"""WITH idx AS ({inputs.INDEX_SQL}), ph AS ({inputs.NAME_PHRASES_SQL}),
vt AS (SELECT DISTINCT table_name, column_name, original, unnest(regexp_extract_all(normalized, '[a-z0-9]+')) AS term FROM idx)
SELECT DISTINCT question_id, table_name, column_name, original FROM ph JOIN vt ON vt.term = ph.normalized""",
)
def match_terms(spark, sf):
    """Index join through the inverted token terms."""
    terms = profile.value_terms(inputs.text_index(spark, sf)).filter("term_type = 'token'")
    wanted = inputs.name_phrases(spark, sf).select("question_id", F.col("normalized").alias("term")).distinct()
    return join_few(wanted, terms, "term").select("question_id", "table_name", "column_name", "original").distinct()


@query(
    "best_phrase_per_value",
    LADDER_SQL
    + """, hits AS (SELECT question_id, pos, phrase, r, rule, score FROM ph JOIN scored ON ph.normalized = l),
said AS (SELECT question_id, list(normalized) AS spoken, list_distinct(flatten(list(regexp_extract_all(normalized, '[a-z0-9]{2,}')))) AS words
 FROM ph GROUP BY 1),
ok AS (SELECT h.* FROM hits h JOIN said USING (question_id) WHERE rule <> 'value_character_similarity'
 OR len(list_intersect(words, regexp_extract_all(r, '[a-z0-9]+'))) > 0
 OR len(list_filter(spoken, lambda p: (length(p) >= 3 AND contains(r, p)) OR (length(r) >= 3 AND contains(p, r)))) > 0),
best AS (SELECT question_id, r, arg_max(phrase, score * 1000000 - pos) AS phrase, max(score) AS score,
 arg_max(rule, score * 1000000 - pos) AS rule FROM ok GROUP BY 1, 2)
SELECT question_id, phrase, score, rule, table_name, column_name, original, frequency FROM best JOIN idx ON idx.normalized = r""",
)
def best_phrase_per_value(spark, sf):
    """E2, flagship: which stored values do the phrases of every part mean?"""
    found = match.literal_matches(cut_lineage(inputs.name_phrases(spark, sf)), inputs.text_index(spark, sf))
    return found.select("question_id", "phrase", "score", "rule", "table_name", "column_name", "original", "frequency")


def _seasons(spark, sf):
    """Order years as printed ranges, an index of its own."""
    year = F.year("o_orderdate")
    return profile.value_index(profile.top_values(profile.value_counts({
        "orders": read_table(spark, sf, "orders").select(
            F.concat(year.cast("string"), F.lit("/"), (year + 1).cast("string")).alias("season")
        )
    })))


@query(
    "season_mapping",
    f"""WITH asked AS ({inputs.PART_QUESTIONS_SQL}), q AS (SELECT question_id, regexp_extract(question, '\\b(?:19|20)\\d{{2}}\\b') AS year
 FROM asked WHERE contains(lower(question), 'season')),
s AS (SELECT year(o_orderdate)::VARCHAR || '/' || (year(o_orderdate) + 1) AS original, count(*) AS n FROM orders GROUP BY 1)
SELECT question_id, year AS phrase, 'orders' AS table_name, 'season' AS column_name, original, 0.94::DOUBLE AS score
FROM q JOIN s ON right(original, 4) = year""",
)
def season_mapping(spark, sf):
    """T9, E3."""
    found = match.season_matches(inputs.part_questions(spark, sf), _seasons(spark, sf))
    return found.select("question_id", "phrase", "table_name", "column_name", "original", "score")


def priority_profile(spark, sf):
    """A profile of the order status whose value description carries the meaning of the codes."""
    counts = profile.value_counts({"orders": read_table(spark, sf, "orders").select("o_orderstatus")})
    described = profile.column_counts(counts).select("table_name", "column_name", "categorical").withColumn(
        "value_description",
        F.lit("F means finished urgent orders; P stands for partial customers orders\nO: open customers account"),
    )
    return profile.value_index(profile.top_values(counts)), described


@query(
    "encoded_values",
    f"""WITH asked AS ({inputs.CUSTOMER_QUESTIONS_SQL}),
q AS (SELECT question_id, list_distinct(list_transform(regexp_extract_all(lower(replace(
 string_split(question, 'Benchmark evidence:')[1], '_', ' ')), '[a-z0-9]+'),
 lambda w: (CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END))) AS terms FROM asked),
v AS (SELECT o_orderstatus AS original, lower(o_orderstatus) AS norm, count(*) AS frequency FROM orders GROUP BY 1, 2),
seg AS (SELECT * FROM (VALUES (0, 'f means finished urgent orders', ['f', 'mean', 'finished', 'urgent', 'order']),
 (1, 'p stands for partial customers orders', ['p', 'stand', 'for', 'partial', 'customer', 'order']),
 (2, 'o: open customers account', ['o', 'open', 'customer', 'account'])) AS t(no, segment, words)),
vs AS (SELECT *, regexp_matches(segment, '(^|[^a-z0-9])' || norm || '\\s*(:|=|means|indicates|stands for|refers to)')
 OR regexp_matches(segment, '(:|=|means|indicates|stands for|refers to)\\s*' || norm || '([^a-z0-9]|$)') AS explicit
 FROM v, seg WHERE contains(segment, norm)),
hit AS (SELECT question_id, original, norm, frequency, no, segment, explicit, list_sort(list_filter(list_intersect(terms, words),
 lambda x: (x <> norm AND NOT list_contains({CONCEPT_STOP} || ['common','evidence','refer','mean','indicate','value','table','character','user','score','attribute'], x)))) AS concept
 FROM q, vs),
ok AS (SELECT * FROM hit WHERE (explicit AND len(concept) >= 2) OR (len(concept) > 0 AND regexp_matches(segment,
 '\\b' || array_to_string(concept, '|') || '\\b\\s*:\\s*([<>]=?|at least|at most)\\s*' || norm || '\\b')))
SELECT question_id, array_to_string(arg_min(concept, no), ' ') AS phrase, original, frequency FROM ok GROUP BY question_id, original, frequency""",
)
def encoded_values(spark, sf):
    """Codes explained by a description segment that shares words with the question."""
    index, described = priority_profile(spark, sf)
    found = match.encoded_matches(inputs.customer_questions(spark, sf), index, described)
    return found.select("question_id", "phrase", "original", "frequency")


@query(
    "probe_like",
    """WITH ph AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS phrase FROM part),
counts AS (SELECT p_name AS value, count(*) AS frequency FROM part GROUP BY 1)
SELECT phrase, value, frequency, rank FROM (SELECT phrase, value, frequency,
 row_number() OVER (PARTITION BY phrase ORDER BY frequency DESC, value) AS rank
 FROM ph JOIN counts ON contains(lower(value), lower(phrase))) WHERE rank <= 5""",
)
def probe_like(spark, sf):
    """The most frequent names that contain a word."""
    part = read_table(spark, sf, "part")
    asked = part.select(F.split("p_name", " ")[0].alias("phrase")).distinct().withColumn("question_id", F.lit(0))
    return match.probe_containing(asked, profile.value_counts({"part": part.select("p_name")})).select(
        "phrase", "value", "frequency", "rank"
    )
