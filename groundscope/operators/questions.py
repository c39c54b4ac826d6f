"""Classifying question logs and error texts (G1-G8), all in codegen-able column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundscope.functions import text

# Intent patterns over " question " in folded form, underscores as spaces.
INTENT_PATTERNS = {
    "asks_count": r"\b(how many|number of|count)\b",
    "asks_average": r"\b(average|avg|mean)\b",
    "asks_sum": r"\b(total|sum|combined)\b",
    "asks_each": r"\b(each|every|per|for each|by each)\b",
    "asks_list": r"\b(list|show|give|find|which|what are|return)\b",
    "asks_top_k": r"\b(top|highest|lowest|most|least|largest|smallest)\b",
    "asks_distinct": r"\b(distinct|different|unique)\b",
}

# Plan terms, searched as substrings of the padded folded question.
AGGREGATION_TERMS = {
    "count": ["how many", "number of", "count"], "sum": ["total", "sum"], "average": ["average", "mean"],
    "max": ["maximum", "highest", "most"], "min": ["minimum", "lowest", "least"],
}
GROUPING_TERMS = [" each ", " per ", " by ", "for every", "for each"]
ORDERING_TERMS = ["highest", "lowest", "top ", "bottom ", "most ", "least ", "order", "sorted", "rank"]
LIMIT_TERMS = [" the most ", " the least ", " highest ", " lowest "]
OUTPUT_TERMS = ["list ", "show ", "which ", "who ", "what ", "state ", "give "]
OUTPUT_NAMES = ["name", "code", "title", "id", "currency", "language", "product"]
METRIC_NAMES = ["amount", "quantity", "count", "total", "price", "revenue", "score", "number", "average", "value"]
NUMERIC_TAGS = ["currency_text", "thousands_separator", "percentage_text", "plus_suffix", "numeric_text"]

# Evidence taxonomy over the folded evidence, in label order.
EVIDENCE_PATTERNS = {
    "numeric_formula": r"\b(percent|percentage|ratio|difference|increase|decrease|sum|average|subtract|divide|multiply)\b|[+*/]",
    "numeric_scaling_or_unit": r"\b(thousand|million|billion|unit|scale|decimal)\b",
    "date_interpretation": r"\b(fiscal|date|year|month|day|quarter|semester)\b",
    "cast_or_storage_rule": r"\b(cast|stored as|text|integer|real|numeric|string)\b",
    "join_meaning": r"\b(join|relationship|related|references?)\b",
    "exact_value": r"[`'\"]",
    "encoded_category": r"\b(0|1|y|n|yes|no|true|false|code|status)\b.*\b(mean|indicat|refer|represent|denot)",
    "synonym_or_concept_mapping": r"\b(synonym|same as|also called|refers to|means)\b",
    "column_semantics": r"\b(column|field|attribute)\b|`[^`]+`",
}
MULTI_STEP = r"\b(top|bottom|most|least|highest|lowest|rank|each|per|among)\b"
RECOVERY_STOP = [
    "the", "a", "an", "is", "are", "of", "to", "in", "for", "and", "or", "that", "this", "refers", "means", "value", "values", "return",
    "find", "give", "show",
]

# Error categories in order of precedence, as substrings of the lower-cased message.
ERROR_TERMS = {
    "timeout": ["interrupted", "deadline"], "schema_mismatch": ["no such column", "no such table"], "syntax_error": ["syntax", "parse error"],
    "safety_rejection": ["prohibited", "unsafe", "not allowed", "select", "denied", "authorized"],
}


def _any(value: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(value, F.lit(term))
    return found


def padded(question="question") -> Column:
    return F.concat(F.lit(" "), F.replace(text.fold(question), F.lit("_"), F.lit(" ")), F.lit(" "))


def intent_flags(question="question") -> dict[str, Column]:
    """G1: seven booleans."""
    value = padded(question)
    return {name: value.rlike(pattern) for name, pattern in INTENT_PATTERNS.items()}


def plan_flags(question="question") -> dict[str, Column]:
    """Aggregation, grouping, ordering, limit, ratio, percentage, distinct and date unit."""
    natural = F.split(F.col(question), text.EVIDENCE_MARKER, 2)[0]
    value = F.concat(F.lit(" "), F.replace(text.fold(natural), F.lit("_"), F.lit(" ")), F.lit(" "))
    aggregation, unit = None, None
    for name, terms in AGGREGATION_TERMS.items():
        aggregation = F.when(_any(value, terms), name) if aggregation is None else aggregation.when(_any(value, terms), name)
    for name in ("year", "month", "day", "date"):
        unit = F.when(F.contains(value, F.lit(name)), name) if unit is None else unit.when(F.contains(value, F.lit(name)), name)
    percentage = _any(value, [" percentage ", " percent ", "%"])
    return {
        "aggregation": aggregation, "grouping": aggregation.isNotNull() & _any(value, GROUPING_TERMS), "ordering": _any(value, ORDERING_TERMS),
        "limit": value.rlike(r"\b(top|bottom)\s+\d+\b|\b(first|last|single)\b") | _any(value, LIMIT_TERMS), "percentage": percentage,
        "ratio": percentage | _any(value, [" ratio ", " proportion ", " divided by "]), "distinct": _any(value, [" distinct ", " unique ", " different "]),
        "date_unit": unit, "asks_output": _any(value, OUTPUT_TERMS),
    }


def plan_direction(question="question") -> Column:
    """Requested order direction."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(text.fold(text.natural_part(question)), r"(?U)\s+", " "), F.lit(" "))
    return F.when(_any(spaced, [" highest ", " top ", " most ", " descending "]), "desc").when(
        _any(spaced, [" lowest ", " bottom ", " least ", " ascending "]), "asc"
    )


def literals(question="question") -> Column:
    """At most ten quoted literals of the question and of its evidence."""
    natural = F.split(F.col(question), text.EVIDENCE_MARKER, 2)[0]
    spoken = F.regexp_extract_all(natural, F.lit("['\"]([^'\"\\n]{1,120})['\"]"), 1)
    defined = F.regexp_extract_all(text.evidence_part(question), F.lit("(?i)(?:=|refers to)\\s*['\"]([^'\"\\n]{1,120})['\"]"), 1)
    return F.slice(F.array_distinct(F.concat(spoken, defined)), 1, 10)


def operators(question="question") -> Column:
    """Comparison operators written in the evidence, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(text.evidence_part(question), F.lit("(?<![<>!=])(?:<=|>=|<>|!=|=|<|>)(?!=)"), 0)))


def _stems(value) -> Column:
    return F.array_distinct(F.transform(text.words(value), lambda w: F.rtrim(w, F.lit("s"))))


def plan_columns(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """Per question the columns whose whole name is spoken, in catalog order, and what is required of them.

    ``columns``: table_name, column_name, ordinal. A name meets the question through one of its stems and
    counts when all of them are present.
    """
    names = columns.select("table_name", "column_name", "ordinal", _stems("column_name").alias("stems")).filter(F.size("stems") > 0)
    asked = questions.select("question_id", F.explode(_stems(text.natural_part("question"))).alias("stem"))
    parts = names.select("table_name", "column_name", "ordinal", F.size("stems").alias("need"), F.explode("stems").alias("stem"))
    spoken = asked.join(parts, "stem").groupBy("question_id", "table_name", "column_name", "ordinal", "need").agg(F.count("*").alias("have")).filter("have = need")
    name = F.concat_ws(".", "table_name", "column_name")
    metric = F.arrays_overlap(text.words(name), F.array(*[F.lit(m) for m in METRIC_NAMES]))
    return spoken.select("question_id", "ordinal", name.alias("column"), metric.alias("is_metric"), "table_name")


def question_plan(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """G2-G4 in one row per question: flags, spoken columns, required outputs, literals, operators."""
    flags = plan_flags()
    base = questions.select(
        "question_id", *[c.alias(n) for n, c in flags.items()], literals().alias("expected_literals"), operators().alias("comparison_operators"),
        plan_direction().alias("ordering_direction"),
    )
    spoken = plan_columns(questions, columns).groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("table_name", "ordinal", "column", "is_metric"))).alias("spoken")
    )
    none = F.array().cast("array<string>")
    joined = base.join(spoken, "question_id", "left")
    exact = F.coalesce(F.transform("spoken", lambda s: s["column"]), none)
    plain = F.coalesce(F.transform(F.filter("spoken", lambda s: ~s["is_metric"]), lambda s: s["column"]), none)
    required = F.when(F.col("aggregation").isNotNull(), plain).otherwise(exact)
    tables = F.coalesce(F.array_distinct(F.transform("spoken", lambda s: s["table_name"])), none)
    return joined.select(
        *base.columns, exact.alias("candidate_output_columns"), F.when(F.col("asks_output"), F.slice(required, 1, 8)).otherwise(none).alias("required_output_columns"),
        F.when(F.col("asks_output") & (F.size(required) > 0), F.size(required)).alias("expected_projection_count"), (F.size(tables) > 1).alias("join_required"),
    )


def filter_columns(questions: DataFrame, index: DataFrame, pairs: DataFrame) -> DataFrame:
    """Columns with a stored value that the question or its evidence mentions.

    ``pairs``: question_id, table_name, column_name, original from a value match. Values shorter than
    three characters count only when quoted.
    """
    quoted = F.transform(literals(), lambda v: text.fold(v))
    context = text.fold(F.replace("question", F.lit(text.EVIDENCE_MARKER), F.lit(" ")))
    joined = pairs.join(questions.select("question_id", quoted.alias("quoted"), context.alias("context")), "question_id")
    value = text.strip(text.fold("original"))
    relevant = F.array_contains("quoted", value) | ((F.length(value) >= 3) & F.contains("context", value))
    return joined.filter(relevant).select("question_id", F.concat_ws(".", "table_name", "column_name").alias("column")).distinct()


def needs_cleanup(plans: DataFrame, relevant: DataFrame) -> DataFrame:
    """Columns that need numeric cleanup for questions with an aggregation, an order or a ratio.

    ``relevant``: question_id, table_name, column_name, format_tags.
    """
    wanting = plans.filter("aggregation IS NOT NULL OR ordering OR ratio").select("question_id")
    tagged = relevant.filter(F.arrays_overlap("format_tags", F.array(*[F.lit(t) for t in NUMERIC_TAGS])))
    return tagged.join(wanting, "question_id", "left_semi").select("question_id", F.concat_ws(".", "table_name", "column_name").alias("column"))


def evidence_types(question: Column, evidence: Column) -> Column:
    """Taxonomy labels of an evidence text; text without a label is a domain rule."""
    lowered = text.fold(evidence)
    labels = [F.when(lowered.rlike(pattern), F.lit(name)) for name, pattern in EVIDENCE_PATTERNS.items()]
    labels.append(F.when(text.fold(F.split(question, text.EVIDENCE_MARKER, 2)[0]).rlike(MULTI_STEP), F.lit("multi_step_logic")))
    found = F.array_compact(F.array(*labels))
    return F.when((F.size(found) == 0) & (F.length(text.strip(evidence)) > 0), F.array(F.lit("domain_rule"))).otherwise(found)


def recoverability(cases: DataFrame) -> DataFrame:
    """From which sources the needed knowledge of a case could be recovered.

    ``cases``: case_id, evidence_terms, identifier_terms, description_terms, types (arrays), literal_exists,
    has_joins, has_foreign_keys, has_transformations.
    """
    stop = F.array(*[F.lit(w) for w in RECOVERY_STOP])
    terms = F.filter(F.array_except("evidence_terms", stop), lambda t: F.length(t) > 2)
    typed = lambda *names: F.arrays_overlap("types", F.array(*[F.lit(n) for n in names]))
    sources = F.array_compact(F.array(
        F.when(F.arrays_overlap(terms, "identifier_terms"), "schema_identifier"),
        F.when(F.size(F.array_intersect(terms, "description_terms")) >= 2, "database_description"), F.when(F.col("literal_exists"), "database_values"),
        F.when(F.col("has_joins") & F.col("has_foreign_keys"), "foreign_keys"),
        F.when(F.col("has_transformations") | typed("numeric_scaling_or_unit", "cast_or_storage_rule"), "value_distribution_or_statistics"),
        F.when(typed("numeric_formula", "multi_step_logic"), "reasoning_derived"),
    ))
    marked = cases.withColumn("_s", sources).withColumn("_d", F.array_remove("_s", "reasoning_derived"))
    final = (
        F.when(F.size("_s") == 0, F.array(F.lit("not_recoverable_without_external_knowledge")))
        .when(F.size("_d") > 1, F.array_append("_s", F.lit("combination"))).otherwise(F.col("_s"))
    )
    return marked.select("case_id", final.alias("sources"), (F.size("_d") > 0).alias("database_recoverable"))


def error_category(message="message") -> Column:
    """Category of an execution error."""
    lowered = F.lower(message)
    result = None
    for name, terms in ERROR_TERMS.items():
        result = F.when(_any(lowered, terms), name) if result is None else result.when(_any(lowered, terms), name)
    return result.otherwise("validation_or_execution_error")


def reference_category(message="message") -> Column:
    """Category of a failed reference statement."""
    lowered = F.lower(message)
    has = lambda *terms: _any(lowered, list(terms))
    return (
        F.when(has("too many columns"), "schema_column_limit").when(has("not authorized to use function"), "function_authorizer")
        .when(has("interrupted", "deadline"), "deadline").when(has("exceeds") & has("rows", "budget"), "result_budget")
        .when(has("no such table", "no such column"), "schema_reference_mismatch").otherwise("other_reference_failure")
    )
