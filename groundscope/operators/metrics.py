"""Scoring whole runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(condition: Column) -> Column:
    """Share of all rows for which a condition holds; unknown counts as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def micro(hits: str, total: str, empty: float | None = 0.0) -> Column:
    """Sum of hits over sum of totals."""
    value = F.try_divide(F.sum(hits), F.sum(total))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def macro(hits: str, total: str, empty: float | None = 0.0) -> Column:
    """Mean of per-case ratios over the cases with a nonzero total."""
    value = F.avg(F.when(F.col(total) > 0, F.col(hits) / F.col(total)))
    return value if empty is None else F.coalesce(value, F.lit(float(empty)))


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """One row per case from its attempts: first and last status, counts, timeouts."""
    return attempts.groupBy("case_id").agg(
        F.count("*").alias("attempts"), F.min_by("status", "attempt").alias("first_status"),
        F.max_by("status", "attempt").alias("last_status"), F.min_by("correct", "attempt").alias("first_correct"),
        F.max_by("correct", "attempt").alias("last_correct"),
        F.bool_or(F.coalesce(F.col("category") == "timeout", F.lit(False))).alias("timed_out"),
        F.count_if(F.col("status") != "executed").alias("rejected"),
    )


# named measures over one row per case; every denominator is the full set of cases.
CASE_METRICS = {
    "execution_accuracy": lambda: rate(F.col("last_correct")),
    "completion": lambda: rate(F.col("last_status") == "executed"),
    "first_attempt_accuracy": lambda: rate(F.col("first_correct")),
    "correct_recovery_fraction": lambda: rate(F.col("last_correct") & (F.col("attempts") > 1) & ~F.col("first_correct")),
    "timeout_fraction": lambda: rate(F.col("timed_out")),
    "reference_coverage": lambda: rate(F.col("scorable")),
}


def case_metrics(cases: DataFrame, summary: DataFrame, keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """M1, M2: measures by name over cases left-joined with their attempts."""
    joined = cases.join(summary, "case_id", "left").withColumn(
        "last_correct", F.coalesce(F.col("last_correct") & F.col("scorable"), F.lit(False))
    )
    chosen = names or list(CASE_METRICS)
    return joined.groupBy(*keys).agg(F.count("*").alias("cases"), *[CASE_METRICS[n]().alias(n) for n in chosen])


def recovery(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M3: initial execution failures, recovered runs and the conditional rate (null without failures)."""
    initial = F.col("first_status") != "executed"
    recovered = (F.col("attempts") > 1) & (F.col("last_status") == "executed")
    return summary.groupBy(*keys).agg(
        F.count_if(initial).alias("initial_failures"), F.count_if(recovered).alias("recovered"),
        F.try_divide(F.count_if(recovered), F.count_if(initial)).alias("conditional_rate"),
    )


def outcome_category() -> Column:
    """M4: precedence of the outcome labels."""
    return (
        F.when(~F.col("scorable"), "gold_unscorable")
        .when(F.coalesce(F.col("last_status") != "executed", F.lit(True)), "application_failure")
        .when(~F.col("last_correct"), "execution_mismatch")
        .otherwise("correct")
    )


def outcomes(cases: DataFrame, summary: DataFrame) -> DataFrame:
    """M4: category and attempt facts per case; ids must align one to one."""
    from groundscope.operators.relational import aligned

    executed = F.col("last_status") == "executed"
    return aligned(cases, summary, "case_id").select(
        *cases.columns, outcome_category().alias("category"), executed.alias("executed"), "attempts", "rejected",
        (executed & (F.col("attempts") > 1)).alias("execution_recovered"),
        (F.col("scorable") & executed & F.col("last_correct")).alias("correct"),
    )


def failure_rollup(outcome: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M5: counts per setting."""
    return outcome.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(F.col("rejected") > 0).alias("initial_execution_failures"),
        F.count_if("execution_recovered").alias("recovered_execution"),
        F.count_if(F.col("execution_recovered") & F.col("correct")).alias("recovered_correct"),
        F.count_if(F.col("execution_recovered") & (F.col("category") == "gold_unscorable")).alias("recovered_unscorable"),
        *[F.count_if(F.col("category") == c).alias(c) for c in ("correct", "execution_mismatch", "application_failure", "gold_unscorable")],
    )


def accuracy_by(scored: DataFrame, category: str, mode: str, modes: Sequence[str], correct: str = "correct") -> DataFrame:
    """M6: accuracy by category with one column per mode."""
    return scored.groupBy(category).pivot(mode, list(modes)).agg(F.avg(F.col(correct).cast("int")))


def schema_recall(cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """M7: recall of required tables and columns; references absent from the schema are counted apart.

    Input arrays per case: required_tables, required_columns, selected_tables, selected_columns,
    known_tables, known_columns, and parsed.
    """
    valid_tables = F.array_intersect("required_tables", "known_tables")
    valid_columns = F.array_intersect("required_columns", "known_columns")
    rows = cases.select(
        *keys, "parsed",
        F.when(F.col("parsed"), F.size(F.array_intersect(valid_tables, "selected_tables"))).otherwise(0).alias("table_hits"),
        F.when(F.col("parsed"), F.size(valid_tables)).otherwise(0).alias("table_total"),
        F.when(F.col("parsed"), F.size(F.array_intersect(valid_columns, "selected_columns"))).otherwise(0).alias("column_hits"),
        F.when(F.col("parsed"), F.size(valid_columns)).otherwise(0).alias("column_total"),
        (F.col("parsed") & (F.size(valid_tables) > 1)).alias("path_required"),
        (F.size(F.array_except(valid_tables, "selected_tables")) == 0).alias("path_covered"),
        F.when(F.col("parsed"), F.size(F.array_except("required_tables", "known_tables"))).otherwise(0).alias("bad_tables"),
        F.when(F.col("parsed"), F.size(F.array_except("required_columns", "known_columns"))).otherwise(0).alias("bad_columns"),
    )
    return rows.groupBy(*keys).agg(
        micro("table_hits", "table_total").alias("schema_table_recall"),
        micro("column_hits", "column_total").alias("schema_column_recall"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("path_required") & F.col("path_covered")), F.count_if("path_required")), F.lit(1.0)
        ).alias("foreign_key_path_coverage"),
        rate(F.col("parsed")).alias("reference_parse_coverage"),
        F.sum("bad_tables").alias("invalid_reference_tables"), F.sum("bad_columns").alias("invalid_reference_columns"),
    )


def evidence_recall(cases: DataFrame) -> DataFrame:
    """M8: macro recall of tables, columns and literals from per-case arrays."""
    parts = {}
    for kind in ("tables", "columns", "literals"):
        required, supplied = F.array_distinct(f"required_{kind}"), f"supplied_{kind}"
        parts[f"{kind}_hits"] = F.size(F.array_intersect(required, supplied))
        parts[f"{kind}_total"] = F.size(required)
    rows = cases.select(*[c.alias(n) for n, c in parts.items()])
    return rows.agg(
        macro("tables_hits", "tables_total").alias("evidence_table_recall"),
        macro("columns_hits", "columns_total").alias("evidence_column_recall"),
        macro("literals_hits", "literals_total").alias("evidence_literal_recall"),
        F.count_if(F.col("literals_total") > 0).alias("scorable_literal_cases"),
    )


def evidence_metrics(cases: DataFrame, facts: DataFrame, literals: DataFrame, transformations: DataFrame | None = None) -> DataFrame:
    """M9 per group: literal recall, precision, value-column accuracy and transformation recall.

    ``cases``: case_id, group, and weight if one case stands for several with the same facts and gold. ``facts``: case_id, fact_no, table_name, column_name, value,
    transformation. ``literals`` (gold): case_id, table_name (null = any table), column_name, value.
    Matching is an equi-join on (case, value); the table only filters.
    """
    gold = literals.select("case_id", F.col("table_name").alias("gold_table"), F.col("column_name").alias("gold_column"), "value").distinct()
    valued = facts.filter("value IS NOT NULL")
    pairs = valued.join(gold, ["case_id", "value"])
    match = (F.col("column_name") == F.col("gold_column")) & (
        F.col("gold_table").isNull() | (F.col("gold_table") == F.col("table_name"))
    )
    hit_literals = (
        pairs.filter(match)
        .select("case_id", "gold_table", "gold_column", "value").distinct()
        .groupBy("case_id").agg(F.count("*").alias("recovered"))
    )
    fact_flags = pairs.groupBy("case_id", "fact_no").agg(F.bool_or(match).alias("relevant"))
    per_fact = fact_flags.groupBy("case_id").agg(
        F.count("*").alias("mapping_candidates"), F.count_if("relevant").alias("relevant")
    )
    rows = (
        cases.join(gold.groupBy("case_id").agg(F.count("*").alias("required")), "case_id", "left")
        .join(hit_literals, "case_id", "left")
        .join(valued.groupBy("case_id").agg(F.count("*").alias("supplied")), "case_id", "left")
        .join(per_fact, "case_id", "left")
    )
    measures = ["required", "recovered", "supplied", "mapping_candidates", "relevant"]
    if transformations is not None:
        wanted = transformations.select("case_id", "transformation").distinct()
        given = facts.select("case_id", "transformation").filter("transformation IS NOT NULL").distinct().withColumn("given", F.lit(1))
        found = wanted.join(given, ["case_id", "transformation"], "left").groupBy("case_id").agg(
            F.count("*").alias("required_transformations"), F.count("given").alias("found_transformations")
        )
        rows = rows.join(found, "case_id", "left")
        measures += ["required_transformations", "found_transformations"]
    weighted = "weight" in cases.columns
    totals = rows.fillna(0, measures).groupBy("group").agg(
        (F.sum("weight") if weighted else F.count("*")).alias("cases"), *[F.sum(F.col(m) * F.col("weight") if weighted else m).alias(m) for m in measures]
    )

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    scored = totals.withColumns({
        "literal_recall": share("recovered", "required"), "evidence_precision": share("relevant", "supplied"),
        "value_column_accuracy": share("relevant", "mapping_candidates"),
    })
    if transformations is not None:
        scored = scored.withColumn("transformation_recall", share("found_transformations", "required_transformations"))
    return scored


def gap_recovery(none: Column, oracle: Column, generated: Column) -> Column:
    """Recovered share of the gap between no evidence and perfect evidence; null without a gap."""
    return F.when(oracle > none, (generated - none) / (oracle - none))


TRANSITIONS = ["both_correct", "wrong_to_correct", "correct_to_wrong", "both_wrong"]


def transition(left: Column, right: Column) -> Column:
    return (
        F.when(left & right, "both_correct").when(left, "correct_to_wrong").when(right, "wrong_to_correct").otherwise("both_wrong")
    )


def transitions(paired: DataFrame, left: str, right: str, keys: Sequence[str] = ()) -> DataFrame:
    """All four cells, zero-filled."""
    cell = transition(F.col(left), F.col(right))
    return paired.withColumn("_cell", cell).groupBy(*keys).agg(*[F.count_if(F.col("_cell") == t).alias(t) for t in TRANSITIONS])


def help_group(without: Column, oracle: Column) -> Column:
    """A helped, B right anyway, C never right, D harmed."""
    return F.when(without & oracle, "B").when(without, "D").when(oracle, "A").otherwise("C")


def help_groups(paired: DataFrame, none: str, oracle: str, generated: str) -> DataFrame:
    """Accuracy per help group; recovered and regressed ids are a second table (``help_changes``)."""
    return (
        paired.withColumn("help_group", help_group(F.col(none), F.col(oracle)))
        .groupBy("help_group")
        .agg(
            F.count("*").alias("cases"), rate(F.col(none)).alias("no_evidence_ex"), rate(F.col(generated)).alias("generated_ex"),
            rate(F.col(oracle)).alias("oracle_ex"), F.count_if(~F.col(none) & F.col(generated)).alias("recoveries"),
            F.count_if(F.col(none) & ~F.col(generated)).alias("regressions"),
        )
    )


def help_changes(paired: DataFrame, none: str, oracle: str, generated: str) -> DataFrame:
    """One row per recovered or regressed case, so long id lists stay distributed."""
    change = F.when(F.col(generated), "recovery").otherwise("regression")
    return paired.filter(F.col(none) != F.col(generated)).select(
        "case_id", help_group(F.col(none), F.col(oracle)).alias("help_group"), change.alias("change")
    )


COMPONENTS = ["projection", "predicate", "join", "aggregate", "grain", "ordering"]


def component_accuracy(families: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of cases whose difference list does not name the component."""
    return families.groupBy(*keys).agg(
        *[F.avg((~F.array_contains("families", c)).cast("int")).alias(f"structural_{c}_accuracy") for c in COMPONENTS]
    )


def intent_accuracy(checks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean over the booleans of all cases that carry an intent; an error when none does."""
    values = F.explode(F.array(*[F.col(n) for n in names]))
    scored = checks.filter("has_intent").select(values.alias("ok")).agg(
        F.count("*").alias("checks"), F.avg(F.col("ok").cast("int")).alias("intent_accuracy")
    )
    return scored.filter(F.assert_true(F.col("checks") > 0, F.lit("no prediction carries an intent")).isNull())


def rule_calibration(checks: DataFrame, minimum_precision: float = 0.90) -> DataFrame:
    """checks(case_id, rule, passed, correct); how often a failed rule meant a wrong answer."""
    return (
        checks.groupBy("rule")
        .agg(F.count_if(~F.col("passed")).alias("flagged"), F.count_if(~F.col("passed") & ~F.col("correct")).alias("true_flags"))
        .withColumn("precision", F.try_divide("true_flags", "flagged"))
        .withColumn("allowed", F.coalesce(F.col("precision") >= minimum_precision, F.lit(False)))
    )


def detector_calibration(detections: DataFrame) -> DataFrame:
    """Per detected family; precision, repair success and regressions decide whether it is enabled."""
    return (
        detections.filter("family IS NOT NULL")
        .groupBy("family")
        .agg(
            F.count("*").alias("flagged"), F.count_if("hit").alias("hits"), F.count_if(~F.col("correct_before")).alias("wrong_attempts"),
            F.count_if(~F.col("correct_before") & F.coalesce("correct_after", F.lit(False))).alias("repaired"),
            F.count_if(F.col("correct_before") & F.coalesce(~F.col("correct_after"), F.lit(False))).alias("regressions"),
        )
        .withColumn("precision", F.try_divide("hits", "flagged"))
        .withColumn("repair_success", F.try_divide("repaired", "wrong_attempts"))
        .withColumn(
            "enabled",
            (F.col("flagged") >= 2) & (F.col("precision") >= 0.80) & F.coalesce(F.col("repair_success") >= 0.50, F.lit(False))
            & (F.col("regressions") == 0),
        )
    )


def transition_audit(paired: DataFrame, left_effects: DataFrame, right_effects: DataFrame, utilization: DataFrame) -> DataFrame:
    """Changed cases with the effect kinds whose counts changed and the relevance of the evidence.

    ``utilization`` holds one row per fact: case_id, label, relevant.
    """
    changed = paired.filter(F.col("left_correct") != F.col("right_correct")).select(
        "case_id", F.when(F.col("right_correct"), "recovery").otherwise("regression").alias("transition")
    )
    counts = (
        left_effects.select("case_id", "kind", F.lit(1).alias("w"))
        .unionByName(right_effects.select("case_id", "kind", F.lit(-1).alias("w")))
        .join(changed.select("case_id"), "case_id", "left_semi")
        .groupBy("case_id", "kind").agg(F.sum("w").alias("w"))
    )
    components = counts.filter("w <> 0").groupBy("case_id").agg(F.sort_array(F.collect_list("kind")).alias("components"))
    facts = utilization.groupBy("case_id").agg(
        F.count("*").alias("facts"), F.count_if("relevant").alias("relevant_facts"),
        F.count_if(F.col("label") == "correctly_used").alias("used"),
    )
    relevance = (
        F.when(F.col("relevant_facts") == F.col("facts"), "yes").when(F.col("relevant_facts") > 0, "partly").otherwise("no")
    )
    return (
        changed.join(components, "case_id", "left").join(facts, "case_id", "left")
        .fillna(0, ["facts", "relevant_facts", "used"])
        .select(
            "case_id", "transition", F.coalesce("components", F.array(F.lit("expression_or_binding"))).alias("components"),
            "facts", relevance.alias("evidence_relevant"), (F.col("used") > 0).alias("used_relevant_evidence"),
        )
    )
