"""Question-log and error-text classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundscope.functions import text
from groundscope.operators import match, profile, questions
from groundscope.plans import evidence, inputs
from groundscope.plans.registry import query
from groundscope.sources.tables import PRIMARY_KEYS, catalog_columns, read_table

ASKED = f"({inputs.PART_QUESTIONS_SQL} UNION ALL {inputs.CUSTOMER_QUESTIONS_SQL})"


def asked(spark, sf):
    return inputs.part_questions(spark, sf).unionByName(inputs.customer_questions(spark, sf))


@query("intent_flags", f"WITH q AS (SELECT question_id, ' ' || replace(lower(question), '_', ' ') || ' ' AS t FROM {ASKED}) SELECT question_id, " + ", ".join(
    f"regexp_matches(t, '{p}') AS {n}" for n, p in questions.INTENT_PATTERNS.items()
) + " FROM q")
def intent_flags(spark, sf):
    """G1."""
    return asked(spark, sf).select("question_id", *[c.alias(n) for n, c in questions.intent_flags().items()])


@query("spoken_flags", "WITH q AS (SELECT doc_id, ' ' || replace(replace(lower(text), 'ß', 'ss'), '_', ' ') || ' ' AS t FROM documents) SELECT doc_id, " + ", ".join(
    f"regexp_matches(t, '(^|[^a-z0-9_]){p[2:-2]}([^a-z0-9_]|$)') AS {n}" for n, p in questions.INTENT_PATTERNS.items()
) + " FROM q")
def spoken_flags(spark, sf):
    """G1 over whole documents."""
    return read_table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in questions.intent_flags("text").items()])


def _like(terms):
    return "(" + " OR ".join(f"contains(t, '{term}')" for term in terms) + ")"


@query("plan_flags", f"WITH q AS (SELECT question_id, ' ' || replace(lower(string_split(question, 'Benchmark evidence:')[1]), '_', ' ') || ' ' AS t FROM {ASKED}), a AS (SELECT *, CASE " + " ".join(
    f"WHEN {_like(v)} THEN '{k}'" for k, v in questions.AGGREGATION_TERMS.items()
) + f""" END AS aggregation FROM q) SELECT question_id, aggregation, aggregation IS NOT NULL AND {_like(questions.GROUPING_TERMS)} AS grouping, {_like(questions.ORDERING_TERMS)} AS ordering,
 regexp_matches(t, '\\b(top|bottom)\\s+\\d+\\b|\\b(first|last|single)\\b') OR {_like(questions.LIMIT_TERMS)} AS "limit", {_like([" percentage ", " percent ", "%"])} AS percentage,
 {_like([" percentage ", " percent ", "%", " ratio ", " proportion ", " divided by "])} AS ratio, {_like([" distinct ", " unique ", " different "])} AS "distinct",
 CASE WHEN contains(t, 'year') THEN 'year' WHEN contains(t, 'month') THEN 'month' WHEN contains(t, 'day') THEN 'day' WHEN contains(t, 'date') THEN 'date' END AS date_unit, {_like(questions.OUTPUT_TERMS)} AS asks_output FROM a""")
def plan_flags(spark, sf):
    """G2."""
    return asked(spark, sf).select("question_id", *[c.alias(n) for n, c in questions.plan_flags().items()])


@query("question_plan")
def question_plan(spark, sf):
    """The whole plan of every question over the described catalog."""
    columns = catalog_columns(spark, evidence.described_tables(spark, sf), PRIMARY_KEYS)
    plans = questions.question_plan(inputs.questions(spark, sf), columns)
    arrays = [n for n, t in plans.dtypes if t.startswith("array")]
    return plans.withColumns({n: F.array_join(n, "|") for n in arrays})


@query("plan_literals", f"""WITH q AS (SELECT question_id, string_split(question, 'Benchmark evidence:') AS p FROM {ASKED}) SELECT question_id,
 array_to_string(list_concat(regexp_extract_all(p[1], '[''"]([^''"\\n]{{1,120}})[''"]', 1), regexp_extract_all(coalesce(p[2], ''), '(?i)(?:=|refers to)\\s*[''"]([^''"\\n]{{1,120}})[''"]', 1)), '|') AS literals,
 CASE WHEN contains(coalesce(p[2], ''), '>=') THEN '>=' ELSE '' END AS operators, CASE WHEN contains(p[1], ' highest ') OR contains(p[1], ' top ') THEN 'desc' END AS direction FROM q""")
def plan_literals(spark, sf):
    """Literals and operators of question and evidence, order direction."""
    return asked(spark, sf).select(
        "question_id", F.array_join(questions.literals(), "|").alias("literals"), F.array_join(questions.operators(), "|").alias("operators"),
        questions.plan_direction().alias("direction"),
    )


@query("plan_filters", f"""WITH q AS ({inputs.CUSTOMER_QUESTIONS_SQL}), v AS (SELECT DISTINCT c_mktsegment AS v, 'customer.c_mktsegment' AS c FROM customer UNION SELECT DISTINCT n_name, 'nation.n_name' FROM nation
 UNION SELECT DISTINCT o_orderpriority, 'orders.o_orderpriority' FROM orders)
 SELECT DISTINCT question_id, c AS "column" FROM q JOIN v ON contains(lower(question), lower(v))""")
def plan_filters(spark, sf):
    """Filter columns from stored values that a question mentions."""
    questions_ = inputs.customer_questions(spark, sf)
    counts = profile.value_counts({
        "customer": read_table(spark, sf, "customer").select("c_mktsegment"), "nation": read_table(spark, sf, "nation").select("n_name"),
        "orders": read_table(spark, sf, "orders").select("o_orderpriority"),
    })
    index = profile.value_index(profile.top_values(counts))
    whole = questions_.select("question_id", F.lit(0).alias("pos"), F.col("question").alias("phrase"), text.normalize("question").alias("normalized"))
    pairs = match.phrase_values(whole, index).select("question_id", "table_name", "column_name", "original")
    return questions.filter_columns(questions_, index, pairs)


def _evidence_text():
    """Evidence texts made of part attributes, in several styles."""
    style = F.col("p_partkey") % 6
    return (
        F.when(style == 0, F.concat(F.lit("percentage = sum of "), "p_name")).when(style == 1, F.concat(F.lit("size in thousand units, code 1 means "), "p_type"))
        .when(style == 2, F.concat(F.lit("`p_brand` column refers to '"), "p_brand", F.lit("'"))).when(style == 3, F.concat(F.lit("stored as text; related to "), "p_name"))
        .when(style == 4, F.lit("")).otherwise(F.concat(F.lit("the "), "p_name", F.lit(" of that fiscal year")))
    )


EVIDENCE_TEXT = """CASE p_partkey % 6 WHEN 0 THEN 'percentage = sum of ' || p_name WHEN 1 THEN 'size in thousand units, code 1 means ' || p_type WHEN 2 THEN '`p_brand` column refers to ''' || p_brand || ''''
 WHEN 3 THEN 'stored as text; related to ' || p_name WHEN 4 THEN '' ELSE 'the ' || p_name || ' of that fiscal year' END"""


@query("evidence_types", f"WITH e AS (SELECT p_partkey AS case_id, {EVIDENCE_TEXT} AS ev, lower({EVIDENCE_TEXT}) AS t, CASE WHEN p_size % 2 = 0 THEN 'list the top parts' ELSE 'list parts' END AS q FROM part), l AS (SELECT case_id, ev, list_filter([" + ", ".join(
    "CASE WHEN regexp_matches(t, '" + p.replace("'", "''") + f"') THEN '{n}' END" for n, p in questions.EVIDENCE_PATTERNS.items()
) + ", CASE WHEN regexp_matches(q, '\\b(top|bottom|most|least|highest|lowest|rank|each|per|among)\\b') THEN 'multi_step_logic' END], lambda x: (x IS NOT NULL)) AS f FROM e) "
    "SELECT case_id, CASE WHEN len(f) = 0 AND ev <> '' THEN 'domain_rule' ELSE array_to_string(f, ',') END AS types FROM l")
def evidence_types(spark, sf):
    """G5."""
    question = F.when(F.col("p_size") % 2 == 0, "list the top parts").otherwise("list parts")
    types = questions.evidence_types(question, _evidence_text())
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), F.array_join(types, ",").alias("types"))


@query("recoverability")
def recoverability(spark, sf):
    """G6 for every part's evidence text against the described catalog."""
    columns = catalog_columns(spark, evidence.described_tables(spark, sf), PRIMARY_KEYS)
    names = columns.agg(F.array_distinct(F.flatten(F.collect_list(text.identifier_tokens(F.concat_ws(" ", "table_name", "column_name"))))))
    question = F.when(F.col("p_size") % 2 == 0, "list the top parts").otherwise("list parts")
    cases = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("case_id"), F.array_distinct(text.identifier_tokens(_evidence_text())).alias("evidence_terms"),
        names.scalar().alias("identifier_terms"), F.array_distinct(text.identifier_tokens(F.concat_ws(" ", "p_name", "p_type", F.lit("size unit")))).alias("description_terms"),
        questions.evidence_types(question, _evidence_text()).alias("types"), (F.col("p_partkey") % 6 == 2).alias("literal_exists"),
        (F.col("p_size") % 3 == 0).alias("has_joins"), F.lit(True).alias("has_foreign_keys"), (F.col("p_size") % 5 == 0).alias("has_transformations"),
    )
    return questions.recoverability(cases).withColumn("sources", F.array_join("sources", ","))


MESSAGES = ["Deadline exceeded", "no such column: ", "parse error near ", "Not authorized to use function ", "too many columns on ", "result exceeds 10000 rows in ", "other "]


def _message():
    return F.concat(F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % 7 + 1).cast("int")), "event_type")


MESSAGE_SQL = f"SELECT event_id, lower({MESSAGES}[event_id % 7 + 1] || event_type) AS m FROM events"


@query("error_category", f"""WITH e AS ({MESSAGE_SQL}) SELECT event_id, CASE WHEN contains(m, 'interrupted') OR contains(m, 'deadline') THEN 'timeout' WHEN contains(m, 'no such column') OR contains(m, 'no such table') THEN 'schema_mismatch'
 WHEN contains(m, 'syntax') OR contains(m, 'parse error') THEN 'syntax_error' WHEN regexp_matches(m, 'prohibited|unsafe|not allowed|select|denied|authorized') THEN 'safety_rejection' ELSE 'validation_or_execution_error' END AS category FROM e""")
def error_category(spark, sf):
    """G7."""
    return read_table(spark, sf, "events").select("event_id", questions.error_category(_message()).alias("category"))


@query("reference_category", f"""WITH e AS ({MESSAGE_SQL}) SELECT event_id, CASE WHEN contains(m, 'too many columns') THEN 'schema_column_limit' WHEN contains(m, 'not authorized to use function') THEN 'function_authorizer'
 WHEN contains(m, 'interrupted') OR contains(m, 'deadline') THEN 'deadline' WHEN contains(m, 'exceeds') AND (contains(m, 'rows') OR contains(m, 'budget')) THEN 'result_budget'
 WHEN contains(m, 'no such table') OR contains(m, 'no such column') THEN 'schema_reference_mismatch' ELSE 'other_reference_failure' END AS category FROM e""")
def reference_category(spark, sf):
    """G8."""
    return read_table(spark, sf, "events").select("event_id", questions.reference_category(_message()).alias("category"))
