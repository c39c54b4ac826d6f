"""Comparing the structure of statements over a ``query_effects`` table.

One effect row: case_id, side, kind, table_name, column_name, operator, value, position. A join effect
names one end in table_name.column_name and the other end as ``table.column`` in value. Everything
gathered per case is the content of one statement, so it is small whatever the number of cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundscope.functions import text
from groundscope.operators.ranking import top_k
from groundscope.operators.relational import changed_fields

# Structure fields and the label of a difference in each.
FAMILY_LABELS = {
    "tables": "table", "columns": "column", "projection_count": "projection", "aggregates": "aggregate", "grouping": "grain",
    "having": "having", "distinct": "distinct", "ordering": "ordering", "ordering_direction": "ordering_direction",
    "limit": "limit", "joins": "join", "subquery": "subquery", "set_operation": "set_operation",
}

# Restoring patch of each error family.
FAMILY_PATCHES = {
    "operation": "restore_requested_operation", "grain": "restore_result_grain", "predicate": "restore_predicate_binding",
    "join": "restore_join_relationship",
}

# The checks that count as hard failures.
HARD_CHECKS = [
    "known_tables", "known_columns", "requested_projection", "requested_filters", "aggregation", "grouping", "filtering",
    "ordering", "limit", "joins", "foreign_key_connectivity", "literal_values", "comparison_operators", "join_predicates",
    "distinct", "ratio", "percentage", "numeric_cleanup", "ordering_direction", "unnecessary_limit",
]


def _has(kind: str) -> Column:
    return F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False))


def _set(value: Column) -> Column:
    return F.sort_array(F.collect_set(value))


def shape_class(effects: DataFrame, keys: Sequence[str] = ("case_id", "side")) -> DataFrame:
    """K1: set_or_subquery > join > aggregate > ordering > simple."""
    flags = effects.groupBy(*keys).agg(
        (_has("subquery") | _has("set_operation")).alias("s"), _has("join").alias("j"), (_has("aggregation") | _has("grouping")).alias("a"),
        (_has("ordering") | _has("limit")).alias("o"),
    )
    shape = (
        F.when(F.col("s"), "set_or_subquery").when(F.col("j"), "join").when(F.col("a"), "aggregate").when(F.col("o"), "ordering")
        .otherwise("simple")
    )
    return flags.select(*keys, shape.alias("shape"))


def structure(effects: DataFrame, keys: Sequence[str] = ("case_id", "side")) -> DataFrame:
    """K2: thirteen-field record per statement, plus the effect sets of predicates and joins."""
    named = F.when(F.col("kind") != "limit", F.col("table_name"))
    columns = F.when(F.col("kind").isin("projection", "aggregation", "predicate", "join", "grouping", "ordering", "conversion"), F.col("column_name"))
    other_end = F.when(F.col("kind") == "join", F.col("value"))
    ends = F.sort_array(F.array(F.concat_ws(".", "table_name", "column_name"), other_end))
    predicate = F.when(F.col("kind") == "predicate", F.concat_ws("|", "table_name", "column_name", "operator", F.coalesce("value", F.lit("\\N"))))
    direction = F.max(F.when(F.col("kind") == "ordering", F.when(F.col("value") == "desc", 2).otherwise(1)))
    return effects.groupBy(*keys).agg(
        _set(named).alias("_t"), _set(F.substring_index(other_end, ".", 1)).alias("_jt"), _set(columns).alias("_c"),
        _set(F.substring_index(other_end, ".", -1)).alias("_jc"), F.count_if(F.col("kind").isin("projection", "aggregation")).alias("projection_count"),
        F.count_if(F.col("kind") == "projection").alias("plain_projections"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "aggregation", F.col("value")))).alias("aggregates"),
        F.min_by(F.when(F.col("kind") == "aggregation", F.col("value")), F.when(F.col("kind") == "aggregation", F.col("position"))).alias("first_aggregate"),
        F.min_by(F.when(F.col("kind") == "aggregation", F.col("column_name") == "*"), F.when(F.col("kind") == "aggregation", F.col("position"))).alias("first_is_star"),
        _has("grouping").alias("grouping"), _has("having").alias("having"), _has("distinct").alias("distinct"), _has("ordering").alias("ordering"),
        F.when(direction == 2, "desc").when(direction == 1, "asc").alias("ordering_direction"), _has("limit").alias("limit"),
        F.count_if(F.col("kind") == "join").alias("joins"), _has("subquery").alias("subquery"), _has("conversion").alias("conversion"),
        F.coalesce(F.max(F.when(F.col("kind") == "set_operation", F.col("value"))), F.lit("none")).alias("set_operation"),
        _set(predicate).alias("predicates"), _set(F.when(F.col("kind") == "join", F.array_join(ends, "="))).alias("join_pairs"),
        _set(F.when(F.col("kind") == "predicate", F.col("column_name"))).alias("where_columns"),
        _set(F.when(F.col("kind").isin("projection", "aggregation"), F.col("column_name"))).alias("projection_columns"),
        _set(F.when(F.col("kind") == "predicate", F.col("value"))).alias("literals"),
        _set(F.when(F.col("kind") == "predicate", F.col("operator"))).alias("operators"),
    ).withColumns({
        "tables": F.sort_array(F.array_union("_t", "_jt")), "columns": F.sort_array(F.array_union("_c", "_jc")),
    }).drop("_t", "_jt", "_c", "_jc")


def paired_structures(structures: DataFrame) -> DataFrame:
    """Reference and prediction structures of each case as two structs; a missing one is null."""
    fields = F.struct(*[c for c in structures.columns if c not in ("case_id", "side")])
    return structures.groupBy("case_id").agg(
        F.any_value(F.when(F.col("side") == "reference", fields), True).alias("reference"),
        F.any_value(F.when(F.col("side") == "prediction", fields), True).alias("prediction"),
    )


def error_families(pairs: DataFrame) -> DataFrame:
    """K3: labels of the differing fields; equal structures differ in meaning only."""
    labels = F.array_compact(F.array(*[
        F.when(~F.col(f"reference.{f}").eqNullSafe(F.col(f"prediction.{f}")), F.lit(label)) for f, label in FAMILY_LABELS.items()
    ]))
    families = (
        F.when(F.col("prediction").isNull(), F.array(F.lit("application_failure")))
        .when(F.size(labels) == 0, F.array(F.lit("result_semantics"))).otherwise(labels)
    )
    return pairs.filter("reference IS NOT NULL").select("case_id", families.alias("families"))


def true_families(pairs: DataFrame) -> DataFrame:
    """K4: which of operation, grain, predicate and join differ; a missing prediction differs in all."""
    def differs(field: str) -> Column:
        return ~F.col(f"reference.{field}").eqNullSafe(F.col(f"prediction.{field}"))

    missing = F.col("prediction").isNull()
    rules = {
        "operation": differs("aggregates"),
        "grain": differs("grouping") | ((F.size("reference.aggregates") > 0) & differs("projection_count")),
        "predicate": differs("predicates"),
        "join": differs("joins") | differs("join_pairs"),
    }
    families = F.array_compact(F.array(*[F.when(missing | rule, F.lit(name)) for name, rule in rules.items()]))
    return pairs.filter("reference IS NOT NULL").select("case_id", families.alias("families"))


def _failed(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(passed, F.lit(False)), F.lit(n)) for n, passed in checks.items()]))


def connected(tables: Column, edges: Column) -> Column:
    """K6: are the used tables connected by foreign keys among themselves?

    ``edges`` is the catalog's undirected edge array of structs (a, b). The reached set grows by its
    neighbours once per table, which is enough for any path.
    """
    def grow(reached: Column, _step: Column) -> Column:
        neighbour = F.filter(
            tables, lambda t: F.exists(edges, lambda e: (e["a"] == t) & F.array_contains(reached, e["b"]))
        )
        return F.array_union(reached, neighbour)

    start = F.slice(tables, 1, 1)
    reached = F.aggregate(tables, start, grow)
    return (F.size(tables) <= 1) | (F.size(F.array_except(tables, reached)) == 0)


def edge_array(fks: DataFrame) -> Column:
    """The undirected edge list of a catalog as one array value (catalog metadata, bounded)."""
    both = fks.select(F.col("src_table").alias("a"), F.col("dst_table").alias("b")).union(
        fks.select(F.col("dst_table").alias("a"), F.col("src_table").alias("b"))
    ).distinct()
    return both.agg(F.sort_array(F.collect_list(F.struct("a", "b")))).scalar()


def coverage_checks(rows: DataFrame) -> DataFrame:
    """K5: twelve requirements of a question against its statement.

    ``rows`` carry the structure fields and the plan: known_tables, known_columns, mentioned_columns,
    required_outputs, required_filters (arrays), aggregation (kind or null), aggregate_required,
    group_required, order_required, filter_required, limit_required, join_required, is_connected.
    """
    def within(a: str, b: str) -> Column:
        return F.size(F.array_except(a, b)) == 0

    def meets(a: str, b: str) -> Column:
        return (F.size(a) == 0) | F.arrays_overlap(a, b)

    extremum = F.coalesce(F.col("aggregation").isin("max", "min"), F.lit(False)) & F.col("ordering") & F.col("limit")
    checks = {
        "known_tables": within("tables", "known_tables"), "known_columns": within("columns", "known_columns"),
        "mentioned_columns": within("mentioned_columns", "columns"), "requested_projection": meets("required_outputs", "projection_columns"),
        "requested_filters": meets("required_filters", "where_columns"),
        "aggregation": ~F.col("aggregate_required") | (F.size("aggregates") > 0) | extremum,
        "grouping": ~F.col("group_required") | F.col("grouping"), "filtering": ~F.col("filter_required") | (F.size("where_columns") > 0),
        "ordering": ~F.col("order_required") | F.col("ordering"), "limit": ~F.col("limit_required") | F.col("limit"),
        "joins": ~F.col("join_required") | (F.col("joins") > 0), "foreign_key_connectivity": ~F.col("join_required") | F.col("is_connected"),
    }
    return rows.withColumn("failed_checks", _failed(checks)).withColumn("covered", F.size("failed_checks") == 0)


def semantic_checks(rows: DataFrame) -> DataFrame:
    """K7: the coverage checks plus ten more; risk is hard failures over twenty.

    Further columns: expected_projection_count, expected_literals, expected_operators (arrays), invalid_join,
    distinct_required, ratio_required, percentage_required, cleanup_required, has_arithmetic, has_cleanup,
    wanted_direction.
    """
    covered = coverage_checks(rows)
    more = {
        "projection_count": F.col("expected_projection_count").isNull() | (F.col("projection_count") >= F.col("expected_projection_count")),
        "literal_values": F.size(F.array_except("expected_literals", "literals")) == 0,
        "comparison_operators": (F.size("expected_operators") == 0) | F.arrays_overlap("expected_operators", "operators"),
        "join_predicates": ~F.col("invalid_join"), "distinct": ~F.col("distinct_required") | F.col("distinct"),
        "ratio": ~F.col("ratio_required") | F.col("has_arithmetic"), "percentage": ~F.col("percentage_required") | F.col("has_arithmetic"),
        "numeric_cleanup": ~F.col("cleanup_required") | F.col("has_cleanup"),
        "ordering_direction": F.col("wanted_direction").isNull() | F.col("wanted_direction").eqNullSafe(F.col("ordering_direction")),
        "unnecessary_limit": F.col("limit_required") | ~F.col("limit"),
    }
    hard = F.array_intersect("diagnostics", F.array(*[F.lit(n) for n in HARD_CHECKS]))
    return (
        covered.withColumn("diagnostics", F.concat("failed_checks", _failed(more)))
        .withColumn("hard_diagnostics", hard)
        .withColumn("semantic_risk", F.size("hard_diagnostics") / F.lit(len(HARD_CHECKS)))
        .withColumn("passed", F.size("hard_diagnostics") == 0)
    )


def invalid_joins(effects: DataFrame, fks: DataFrame, primary_keys: DataFrame | None = None) -> DataFrame:
    """Cases with a join between FK-related tables that is not on a declared key.

    An implicit target column resolves to the target's first primary key; unresolved keys are dropped.
    """
    resolved = fks
    if primary_keys is not None:
        targets = primary_keys.select("db_id", F.col("table_name").alias("dst_table"), "pk_column")
        resolved = fks.join(targets, ["db_id", "dst_table"], "left").withColumn("dst_column", F.coalesce("dst_column", "pk_column"))
    resolved = resolved.filter("dst_column IS NOT NULL")
    a = F.concat_ws(".", "src_table", "src_column")
    b = F.concat_ws(".", "dst_table", "dst_column")
    declared = resolved.select(a.alias("l"), b.alias("r")).union(resolved.select(b.alias("l"), a.alias("r"))).distinct()
    related = resolved.select(F.col("src_table").alias("lt"), F.col("dst_table").alias("rt")).union(
        resolved.select(F.col("dst_table").alias("lt"), F.col("src_table").alias("rt"))
    ).distinct()
    joins = effects.filter("kind = 'join'").select(
        "case_id", "side", F.concat_ws(".", "table_name", "column_name").alias("l"), F.col("value").alias("r"),
        F.col("table_name").alias("lt"), F.substring_index("value", ".", 1).alias("rt"),
    )
    checked = joins.join(related, ["lt", "rt"], "left_semi").join(declared.withColumn("ok", F.lit(True)), ["l", "r"], "left")
    return checked.groupBy("case_id", "side").agg(F.bool_or(F.col("ok").isNull()).alias("invalid_join"))


def intent_critic(rows: DataFrame, calibrated: Sequence[str] | None = None) -> DataFrame:
    """K8: nineteen checks of a grounded intent; failed ones are actionable only for calibrated rules.

    Further columns: intent_projections, required_projection, required_filters, expected_literals,
    expected_aggregates, selected_tables, high_confidence, grain, intent_grouping, intent_having,
    intent_distinct, intent_ordering, intent_direction, intent_limit, intent_subquery, intent_set_operation,
    result_rows.
    """
    def within(a: str, b: str) -> Column:
        return F.size(F.array_except(a, b)) == 0

    grain = text.fold("grain")
    scalar = grain.rlike("scalar|entire|global")
    grouped = F.col("intent_grouping") | grain.rlike("per |each |one row per")
    no_result = F.col("result_rows").isNull()
    checks = {
        "known_tables": within("tables", "known_tables"), "required_tables": ~F.col("high_confidence") | within("selected_tables", "tables"),
        "projection_count": (F.col("intent_projections") == 0) | (F.col("projection_count") == F.col("intent_projections")),
        "projection_bindings": within("required_projection", "projection_columns"), "filter_bindings": within("required_filters", "where_columns"),
        "literal_values": within("expected_literals", "literals"), "aggregate_functions": within("expected_aggregates", "aggregates"),
        "grouping_grain": ~grouped | F.col("grouping"), "global_scalar_grain": ~scalar | ~F.col("grouping"),
        "having": ~F.col("intent_having") | F.col("having"), "distinct": ~F.col("intent_distinct") | F.col("distinct"),
        "ordering": ~F.col("intent_ordering") | F.col("ordering"),
        "ordering_direction": ~F.col("intent_ordering") | (F.col("intent_direction") == "unknown")
        | F.coalesce(F.col("intent_direction") == F.col("ordering_direction"), F.lit(False)),
        "limit": F.col("intent_limit").isNull() | F.col("limit"), "unnecessary_limit": F.col("intent_limit").isNotNull() | ~F.col("limit"),
        "subquery": ~F.col("intent_subquery") | F.col("subquery"),
        "set_operation": (F.col("intent_set_operation") == "none") | (F.col("intent_set_operation") == F.col("set_operation")),
        "result_shape": no_result | ~scalar | (F.col("result_rows") <= 1),
        "result_limit_shape": no_result | F.col("intent_limit").isNull() | (F.col("result_rows") <= F.col("intent_limit")),
    }
    always = [n for n in checks if n not in ("required_tables", "projection_bindings", "filter_bindings", "subquery", "grouping_grain", "global_scalar_grain")]
    if calibrated:
        rules = F.array(*[F.lit(n) for n in calibrated])
    else:
        rules = F.array_compact(F.array(
            *[F.lit(n) for n in always], F.when(F.col("high_confidence"), "required_tables"),
            F.when(F.size("required_projection") > 0, "projection_bindings"), F.when(F.size("required_filters") > 0, "filter_bindings"),
        ))
    return (
        rows.withColumn("_failed", _failed(checks)).withColumn("_rules", rules)
        .withColumn("actionable", F.array_intersect("_failed", "_rules")).withColumn("telemetry", F.array_except("_failed", "_rules"))
        .withColumn("risk", F.size("actionable") / F.greatest(F.size("_rules"), F.lit(1)))
        .withColumn("passed", F.size("actionable") == 0).drop("_failed", "_rules")
    )


# The dimensions in which two candidates may differ.
DIVERSITY_DIMENSIONS = [
    "tables", "columns", "projection_count", "predicates", "join_pairs", "aggregates", "grouping", "having", "distinct",
    "ordering_direction", "limit", "subquery", "set_operation",
]


def diversity(pairs: DataFrame, left: str = "reference", right: str = "prediction") -> DataFrame:
    """K9: names of the differing dimensions of two statements."""
    return pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).select(
        "case_id", changed_fields(left, right, DIVERSITY_DIMENSIONS).alias("dimensions")
    ).withColumn("different", F.size("dimensions") > 0)


def similarity(left: str, right: str) -> Column:
    """0.45 flag overlap + 0.20 role overlap + 0.35 share of equal shape fields."""
    fields = ["has_aggregate", "group_by", "join_count", "projection_count", "predicate_count"]
    equal = sum((F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")).cast("int") for f in fields), F.lit(0)) / len(fields)
    flags = text.jaccard(F.col(f"{left}.flags"), F.col(f"{right}.flags"))
    roles = text.jaccard(F.col(f"{left}.roles"), F.col(f"{right}.roles"))
    return F.lit(0.45) * flags + F.lit(0.20) * roles + F.lit(0.35) * equal


def memory_lookup(signatures: DataFrame, memory: DataFrame, limit: int = 3) -> DataFrame:
    """Most similar remembered errors of the same family.

    Signatures are few distinct shapes, so both sides are reduced to distinct signatures; a remembered
    signature only needs its ``limit`` smallest identities, because ties are broken by identity.
    """
    asked = signatures.select("family", "signature").distinct()
    remembered = top_k(memory, ["family", "signature"], [F.col("identity")], limit, rank="_r").drop("_r")
    shapes = remembered.select("family", F.col("signature").alias("other")).distinct()
    scored = asked.join(shapes, "family").withColumn("similarity", F.round(similarity("signature", "other"), 9))
    options = scored.join(remembered.withColumnRenamed("signature", "other"), ["family", "other"]).drop("other")
    best = top_k(options, ["family", "signature"], [F.col("similarity").desc(), F.col("identity")], limit)
    return signatures.join(best, ["family", "signature"]).drop("signature")


def record_identity(*parts: str) -> Column:
    """Digest of a record in a fixed field order."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def detect(cases: DataFrame, effects: DataFrame, facts: DataFrame) -> DataFrame:
    """The first error rule that fires per case, otherwise no row (abstain).

    ``cases``: case_id, question, flags array, and structure fields of the prediction with
    first_aggregate. ``facts``: case_id, type, phrase, table_name, column_name, db_value, target_table,
    target_column. ``effects``: prediction effects.
    """
    def asks(flag: str) -> Column:
        return F.array_contains("flags", flag)

    requested = F.when(asks("asks_count"), "count").when(asks("asks_average"), "avg").when(asks("asks_sum"), "sum")
    has_aggregate = F.size("aggregates") > 0
    rules = F.array_compact(F.array(
        F.when(
            requested.isNotNull() & has_aggregate & (F.col("first_aggregate") != requested),
            F.struct(F.lit(1).alias("rule"), F.lit(0).cast("long").alias("at"), F.lit("operation").alias("family"), F.lit("wrong_aggregate").alias("subtype"),
                     F.lit(0.96).alias("confidence"), F.concat(F.lit("replace_aggregate:"), requested).alias("patch")),
        ),
        F.when(
            requested.isNull() & asks("asks_list") & has_aggregate & ~F.col("grouping") & (F.col("projection_count") == 1)
            & ~F.col("first_is_star"),
            F.struct(F.lit(2).alias("rule"), F.lit(0).cast("long").alias("at"), F.lit("operation").alias("family"), F.lit("unrequested_aggregate").alias("subtype"),
                     F.lit(0.95).alias("confidence"), F.lit("remove_aggregate").alias("patch")),
        ),
        F.when(
            asks("asks_each") & has_aggregate & ~F.col("grouping") & (F.col("plain_projections") > 0),
            F.struct(F.lit(3).alias("rule"), F.lit(0).cast("long").alias("at"), F.lit("grain").alias("family"), F.lit("missing_group").alias("subtype"),
                     F.lit(0.93).alias("confidence"), F.lit("group_by_nonaggregate_projections").alias("patch")),
        ),
    ))
    shape_hits = cases.select("case_id", F.explode(rules).alias("d")).select("case_id", "d.*")

    used = cases.select("case_id", "tables", "question")
    code = F.col("db_value").rlike("[A-Za-z]") & F.col("db_value").rlike("[0-9]")
    safe = F.col("type").isin("encoded_value", "normalization") | ((F.col("type") == "literal_value") & code)
    value_facts = (
        facts.filter(F.col("db_value").isNotNull() & F.col("column_name").isNotNull() & safe)
        .join(used, "case_id").filter(F.contains(text.normalize("question"), text.normalize("phrase")))
        .select("case_id", text.normalize("db_value").alias("value"), F.col("table_name").alias("fact_table"), F.col("column_name").alias("fact_column"), "tables")
    )
    compared = effects.filter((F.col("kind") == "predicate") & ~F.col("operator").isin("like", "in") & F.col("value").isNotNull()).select(
        "case_id", "position", "column_name", text.normalize("value").alias("value")
    )
    predicate_hits = (
        compared.join(value_facts, ["case_id", "value"])
        .groupBy("case_id", "position", "column_name")
        .agg(F.count("*").alias("n"), F.first("fact_table").alias("t"), F.first("fact_column").alias("c"), F.first("tables").alias("tables"))
        .filter((F.col("n") == 1) & (F.lower("c") != F.lower("column_name")) & F.array_contains("tables", F.lower("t")))
        .select("case_id", F.lit(4).alias("rule"), F.col("position").cast("long").alias("at"), F.lit("predicate").alias("family"),
                F.lit("wrong_filter_column").alias("subtype"), F.lit(0.97).alias("confidence"),
                F.concat_ws(":", F.lit("predicate_column"), "t", "c").alias("patch"))
    )
    join_facts = (
        facts.filter("type = 'join_relationship' AND column_name IS NOT NULL AND target_table IS NOT NULL AND target_column IS NOT NULL")
        .select("case_id", F.lower("table_name").alias("s"), F.lower("column_name").alias("sc"), F.lower("target_table").alias("d"), F.lower("target_column").alias("dc"))
        .join(used, "case_id").filter(F.array_contains("tables", F.col("s")) & F.array_contains("tables", F.col("d"))).drop("question", "tables")
    )
    joins = effects.filter("kind = 'join'").select(
        "case_id", "position", F.col("table_name").alias("joined"),
        F.sort_array(F.array("column_name", F.substring_index("value", ".", -1))).alias("actual"),
    )
    join_hits = (
        joins.join(join_facts, "case_id").filter((F.col("joined") == F.col("s")) | (F.col("joined") == F.col("d")))
        .groupBy("case_id", "position", "actual")
        .agg(F.count("*").alias("n"), F.first(F.struct("s", "sc", "d", "dc")).alias("f"))
        .filter((F.col("n") == 1) & (F.col("actual") != F.sort_array(F.array("f.sc", "f.dc"))))
        .select("case_id", F.lit(5).alias("rule"), F.col("position").cast("long").alias("at"), F.lit("join").alias("family"),
                F.lit("wrong_join_predicate").alias("subtype"), F.lit(0.95).alias("confidence"),
                F.concat_ws(":", F.lit("join"), "f.s", "f.sc", "f.d", "f.dc").alias("patch"))
    )
    hits = shape_hits.unionByName(predicate_hits).unionByName(join_hits)
    return hits.groupBy("case_id").agg(
        F.min_by(F.struct("family", "subtype", "confidence", "patch"), F.struct("rule", "at")).alias("d")
    ).select("case_id", "d.*")


def differing_mutants(mutants: DataFrame, verdicts: DataFrame, limit: int | None = None, order: Sequence[str] = ("case_id",)) -> DataFrame:
    """Mutants whose captured result differs from the gold result; ``limit`` is the memory size."""
    kept = mutants.join(verdicts.filter("multiset_equal"), "case_id", "left_anti")
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def utilization(facts: DataFrame, effects: DataFrame) -> DataFrame:
    """How each fact was used: expected and observed roles and a label.

    ``facts``: case_id, fact_no, type, table_name, column_name, db_value, target_table, target_column.
    ``effects``: both sides of every case.
    """
    key = ["case_id", "fact_no"]
    plain = facts.filter("type <> 'join_relationship'")
    # A fact without a stored value is compared with the text of a missing value.
    wanted = text.normalize(F.coalesce("db_value", F.lit("None")))
    same_table = (
        (F.coalesce("fact_table", F.lit("")) == "") | (F.coalesce("table_name", F.lit("")) == "") | (F.col("fact_table") == F.col("table_name"))
    )
    touched = (
        plain.select(*key, "type", F.lower("table_name").alias("fact_table"), F.lower("column_name").alias("column_name"),
                     F.col("db_value").isNotNull().alias("valued"), wanted.alias("wanted"))
        .join(effects.filter("kind <> 'join'"), ["case_id", "column_name"]).filter(same_table)
    )
    exact = (F.col("kind") == "predicate") & F.coalesce(F.col("value") == F.col("wanted"), F.lit(False))
    reference, prediction = F.col("side") == "reference", F.col("side") == "prediction"
    numeric = (F.col("type") != "numeric_or_storage") | F.col("kind").isin("conversion", "predicate", "aggregation")
    found = touched.groupBy(*key).agg(
        F.sort_array(F.collect_set(F.when(reference & numeric, F.col("kind")))).alias("ref_kinds"),
        F.bool_or(reference & exact).alias("ref_exact"),
        F.sort_array(F.collect_set(F.when(prediction, F.col("kind")))).alias("pred_kinds"),
        F.bool_or(prediction & exact).alias("pred_exact"), F.bool_or(prediction & (F.col("kind") == "predicate")).alias("pred_predicate"),
    )
    source = F.concat_ws(".", F.lower("f.table_name"), F.lower("f.column_name"))
    target = F.concat_ws(".", F.lower("f.target_table"), F.lower("f.target_column"))
    here, there = F.concat_ws(".", "e.table_name", "e.column_name"), F.col("e.value")
    linked = (
        facts.filter("type = 'join_relationship'").alias("f").join(effects.filter("kind = 'join'").alias("e"), "case_id")
        .filter(((here == source) & (there == target)) | ((here == target) & (there == source)))
        .groupBy("case_id", "f.fact_no").agg(F.bool_or(reference).alias("ref_join"), F.bool_or(prediction).alias("pred_join"))
    )
    none = F.array().cast("array<string>")
    only_predicate = F.array(F.lit("predicate"))
    is_join, valued = F.col("type") == "join_relationship", F.col("db_value").isNotNull()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    expected = (
        F.when(is_join, F.when(yes("ref_join"), F.array(F.lit("join"))).otherwise(none))
        .when(valued, F.when(yes("ref_exact"), only_predicate).otherwise(none)).otherwise(F.coalesce("ref_kinds", none))
    )
    observed = (
        F.when(is_join, F.when(yes("pred_join"), F.array(F.lit("join"))).otherwise(none))
        .when(valued & yes("pred_exact"), only_predicate).otherwise(F.coalesce("pred_kinds", none))
    )
    some_e, some_o = F.size("expected_roles") > 0, F.size("observed_roles") > 0
    contradicted = F.array_contains("expected_roles", "predicate") & yes("pred_predicate") & ~yes("pred_exact")
    label = (
        F.when(contradicted, "contradicted").when(F.arrays_overlap("expected_roles", "observed_roles"), "correctly_used")
        .when(some_e & some_o, "misapplied").when(some_e, "ignored").when(some_o, "unnecessarily_used").otherwise("ignored")
    )
    return (
        facts.join(found, key, "left").join(linked, key, "left")
        .withColumn("expected_roles", expected).withColumn("observed_roles", observed)
        .select(*key, "type", "expected_roles", "observed_roles", label.alias("label"), some_e.alias("relevant"))
    )


def utilization_rates(used: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy over relevant facts and unnecessary use over irrelevant ones; null without any."""
    return used.groupBy(*keys).agg(
        F.count_if("relevant").alias("relevant_facts"), F.count_if(~F.col("relevant")).alias("irrelevant_facts"),
        F.try_divide(F.count_if(F.col("label") == "correctly_used"), F.count_if("relevant")).alias("utilization_accuracy"),
        F.try_divide(F.count_if(F.col("label") == "unnecessarily_used"), F.count_if(~F.col("relevant"))).alias("unnecessary_use_rate"),
    )


def natural_errors(cases: DataFrame, families: DataFrame) -> DataFrame:
    """Wrong predictions with a statement whose true family is a single one, with its patch label."""
    patch = F.create_map(*[F.lit(x) for pair in FAMILY_PATCHES.items() for x in pair])
    return (
        cases.filter(~F.col("correct") & F.col("has_statement")).join(families.filter(F.size("families") == 1), "case_id")
        .select("case_id", F.col("families")[0].alias("family"), patch[F.col("families")[0]].alias("minimal_patch"))
    )


def correction_overlay(cases: DataFrame, detections: DataFrame, patched: DataFrame, enabled: Sequence[str]) -> DataFrame:
    """Use a patched result only if its family is enabled and the patch executed; give the reason.

    ``cases``: case_id, result. ``patched``: case_id, patched_result, executed.
    """
    joined = cases.join(detections.select("case_id", "family"), "case_id", "left").join(patched, "case_id", "left")
    fired = F.coalesce(F.col("family").isin(list(enabled)), F.lit(False))
    reason = (
        F.when(~fired, "detector_abstained").when(F.col("executed").isNull(), "localized_patch_unavailable")
        .when(F.col("executed"), "calibrated_local_patch").otherwise("patch_execution_failed_original_retained")
    )
    return joined.withColumn("selection_reason", reason).select(
        "case_id", "selection_reason",
        F.when(F.col("selection_reason") == "calibrated_local_patch", F.col("patched_result")).otherwise(F.col("result")).alias("result"),
    )
