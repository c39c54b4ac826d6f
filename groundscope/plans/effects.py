"""Structural comparison queries over effects derived from the orders of each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundscope.operators import metrics, results, structure
from groundscope.plans import evaluation
from groundscope.plans.registry import query
from groundscope.sources.tables import FOREIGN_KEYS, catalog_fks, read_table

KINDS = ["projection", "aggregation", "predicate", "join", "grouping", "ordering", "limit"]
OTHERS = ["having", "distinct", "subquery", "conversion"]
AGGREGATES = ["count", "sum", "avg", "min", "max"]
OPERATORS = ["eq", "gt", "lt", "like"]
TABLES = ["orders", "customer", "lineitem"]
COLUMNS = ["status", "price", "day"]
JOINS = [
    ("orders", "o_custkey", "customer.c_custkey"), ("customer", "c_custkey", "orders.o_custkey"),
    ("orders", "o_orderkey", "customer.c_custkey"), ("lineitem", "l_orderkey", "orders.o_orderkey"),
]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def query_effects(spark, sf):
    """Every order is one effect of its customer's statement: F = reference, O = prediction, P = both."""
    key = F.col("o_orderkey")
    a, b, c = key % 8, F.floor(key / 8), F.floor(key / 32)
    kind = F.when(a < 7, _pick(KINDS, F.least(a, F.lit(6)))).otherwise(_pick(OTHERS, b % 4))
    join = a == 3
    side = F.explode(
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("reference"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("prediction")))
        .otherwise(F.array(F.lit("reference"), F.lit("prediction")))
    )
    return read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), side.alias("side"), kind.alias("kind"),
        F.when(join, _pick([j[0] for j in JOINS], b % 4)).otherwise(_pick(TABLES, b % 3)).alias("table_name"),
        F.when(join, _pick([j[1] for j in JOINS], b % 4)).otherwise(_pick(COLUMNS, c % 3)).alias("column_name"),
        F.when(a == 2, _pick(OPERATORS, b % 4)).when(join, "eq").alias("operator"),
        F.when(a == 1, _pick(AGGREGATES, b % 5)).when(a == 2, F.concat(F.lit("v"), (c % 4).cast("string")))
        .when(join, _pick([j[2] for j in JOINS], b % 4)).when(a == 5, _pick(["asc", "desc"], b % 2)).alias("value"),
        key.alias("position"),
    )


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


EFFECTS = f"""o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS a, o_orderkey // 8 AS b, o_orderkey // 32 AS c, o_custkey, o_orderstatus FROM orders),
ef0 AS (SELECT o_custkey AS case_id, o_orderstatus AS st, CASE WHEN a < 7 THEN {_list(KINDS)}[a + 1] ELSE {_list(OTHERS)}[b % 4 + 1] END AS kind,
 CASE WHEN a = 3 THEN {_list([j[0] for j in JOINS])}[b % 4 + 1] ELSE {_list(TABLES)}[b % 3 + 1] END AS table_name,
 CASE WHEN a = 3 THEN {_list([j[1] for j in JOINS])}[b % 4 + 1] ELSE {_list(COLUMNS)}[c % 3 + 1] END AS column_name,
 CASE WHEN a = 2 THEN {_list(OPERATORS)}[b % 4 + 1] WHEN a = 3 THEN 'eq' END AS operator,
 CASE WHEN a = 1 THEN {_list(AGGREGATES)}[b % 5 + 1] WHEN a = 2 THEN 'v' || (c % 4) WHEN a = 3 THEN {_list([j[2] for j in JOINS])}[b % 4 + 1]
 WHEN a = 5 THEN ['asc', 'desc'][b % 2 + 1] END AS value, k AS position FROM o),
ef AS (SELECT case_id, 'reference' AS side, * EXCLUDE (case_id, st) FROM ef0 WHERE st IN ('F', 'P')
 UNION ALL SELECT case_id, 'prediction', * EXCLUDE (case_id, st) FROM ef0 WHERE st IN ('O', 'P'))"""

STRUCTURES = EFFECTS + """,
st AS (SELECT case_id, side, list_sort(list_distinct(list_concat(coalesce(list(table_name) FILTER (kind <> 'limit'), []), coalesce(list(split_part(value, '.', 1)) FILTER (kind = 'join'), [])))) AS tables,
 list_sort(list_distinct(list_concat(coalesce(list(column_name) FILTER (kind IN ('projection', 'aggregation', 'predicate', 'join', 'grouping', 'ordering', 'conversion')), []),
 coalesce(list(split_part(value, '.', 2)) FILTER (kind = 'join'), [])))) AS columns,
 count(*) FILTER (kind IN ('projection', 'aggregation')) AS projection_count, count(*) FILTER (kind = 'projection') AS plain_projections,
 coalesce(list_sort(list(value) FILTER (kind = 'aggregation')), []) AS aggregates, arg_min(value, position) FILTER (kind = 'aggregation') AS first_aggregate,
 bool_or(kind = 'grouping') AS grouping, bool_or(kind = 'having') AS having_, bool_or(kind = 'distinct') AS distinct_, bool_or(kind = 'ordering') AS ordering,
 CASE WHEN bool_or(kind = 'ordering' AND value = 'desc') THEN 'desc' WHEN bool_or(kind = 'ordering') THEN 'asc' END AS ordering_direction, bool_or(kind = 'limit') AS limit_,
 count(*) FILTER (kind = 'join') AS joins, bool_or(kind = 'subquery') AS subquery, bool_or(kind = 'conversion') AS conversion, 'none' AS set_operation,
 coalesce(list_sort(list_distinct(list(table_name || '|' || column_name || '|' || operator || '|' || value) FILTER (kind = 'predicate'))), []) AS predicates,
 coalesce(list_sort(list_distinct(list(least(table_name || '.' || column_name, value) || '=' || greatest(table_name || '.' || column_name, value)) FILTER (kind = 'join'))), []) AS join_pairs,
 coalesce(list_distinct(list(column_name) FILTER (kind = 'predicate')), []) AS where_columns,
 coalesce(list_distinct(list(column_name) FILTER (kind IN ('projection', 'aggregation'))), []) AS projection_columns,
 coalesce(list_distinct(list(value) FILTER (kind = 'predicate')), []) AS literals, coalesce(list_distinct(list(operator) FILTER (kind = 'predicate')), []) AS operators
 FROM ef GROUP BY 1, 2)"""
PAIRS = STRUCTURES + """, pr AS (SELECT r.case_id, r AS r, p AS p, p.case_id IS NULL AS missing FROM (SELECT * FROM st WHERE side = 'reference') r
 LEFT JOIN (SELECT * FROM st WHERE side = 'prediction') p ON r.case_id = p.case_id)"""
_SQL_FIELD = {"having": "having_", "distinct": "distinct_", "limit": "limit_"}
FAMILIES = PAIRS + """, fam AS (SELECT case_id, CASE WHEN missing THEN ['application_failure'] ELSE list_filter([""" + ", ".join(
    f"CASE WHEN r.{_SQL_FIELD.get(f, f)} IS DISTINCT FROM p.{_SQL_FIELD.get(f, f)} THEN '{label}' END" for f, label in structure.FAMILY_LABELS.items()
) + """], lambda x: (x IS NOT NULL)) END AS f FROM pr), fams AS (SELECT case_id, CASE WHEN len(f) = 0 THEN ['result_semantics'] ELSE f END AS families FROM fam)"""
TRUE_FAMILIES = PAIRS + """, tf AS (SELECT case_id, list_filter([CASE WHEN missing OR r.aggregates <> p.aggregates THEN 'operation' END,
 CASE WHEN missing OR r.grouping <> p.grouping OR (len(r.aggregates) > 0 AND r.projection_count <> p.projection_count) THEN 'grain' END,
 CASE WHEN missing OR r.predicates <> p.predicates THEN 'predicate' END, CASE WHEN missing OR r.joins <> p.joins OR r.join_pairs <> p.join_pairs THEN 'join' END],
 lambda x: (x IS NOT NULL)) AS families FROM pr)"""


def structures(spark, sf):
    return structure.structure(query_effects(spark, sf))


def pairs(spark, sf):
    return structure.paired_structures(structures(spark, sf))


@query("shape_class", f"""WITH {EFFECTS} SELECT case_id, side, CASE WHEN bool_or(kind = 'subquery') THEN 'set_or_subquery' WHEN bool_or(kind = 'join') THEN 'join'
 WHEN bool_or(kind IN ('aggregation', 'grouping')) THEN 'aggregate' WHEN bool_or(kind IN ('ordering', 'limit')) THEN 'ordering' ELSE 'simple' END AS shape FROM ef GROUP BY 1, 2""")
def shape_class(spark, sf):
    """K1."""
    return structure.shape_class(query_effects(spark, sf))


@query("structure_record", f"""WITH {STRUCTURES} SELECT case_id, side, array_to_string(tables, ',') AS tables, array_to_string(columns, ',') AS columns, projection_count,
 array_to_string(aggregates, ',') AS aggregates, grouping, having_ AS has_having, distinct_ AS is_distinct, ordering, ordering_direction, limit_ AS has_limit, joins, subquery,
 array_to_string(predicates, ',') AS predicates, array_to_string(join_pairs, ',') AS join_pairs FROM st""")
def structure_record(spark, sf):
    """K2."""
    joined = [F.array_join(c, ",").alias(c) for c in ("tables", "columns", "aggregates", "predicates", "join_pairs")]
    return structures(spark, sf).select(
        "case_id", "side", *joined, "projection_count", "grouping", F.col("having").alias("has_having"), F.col("distinct").alias("is_distinct"),
        "ordering", "ordering_direction", F.col("limit").alias("has_limit"), "joins", "subquery",
    )


@query("error_families", f"WITH {FAMILIES} SELECT case_id, array_to_string(families, ',') AS families FROM fams")
def error_families(spark, sf):
    """K3, U3."""
    return structure.error_families(pairs(spark, sf)).select("case_id", F.array_join("families", ",").alias("families"))


@query("true_families", f"WITH {TRUE_FAMILIES} SELECT case_id, array_to_string(families, ',') AS families FROM tf")
def true_families(spark, sf):
    """K4."""
    return structure.true_families(pairs(spark, sf)).select("case_id", F.array_join("families", ",").alias("families"))


@query("candidate_diversity", f"""WITH {PAIRS} SELECT case_id, array_to_string(list_filter([""" + ", ".join(
    f"CASE WHEN r.{_SQL_FIELD.get(f, f)} IS DISTINCT FROM p.{_SQL_FIELD.get(f, f)} THEN '{f}' END" for f in structure.DIVERSITY_DIMENSIONS
) + "], lambda x: (x IS NOT NULL)), ',') AS dimensions FROM pr WHERE NOT missing")
def candidate_diversity(spark, sf):
    """K9."""
    return structure.diversity(pairs(spark, sf)).select("case_id", F.array_join("dimensions", ",").alias("dimensions"))


@query("component_accuracy", f"WITH {FAMILIES} SELECT " + ", ".join(
    f"round(avg((NOT list_contains(families, '{c}'))::INT), 9) AS structural_{c}_accuracy" for c in metrics.COMPONENTS
) + " FROM fams")
def component_accuracy(spark, sf):
    """M13."""
    found = metrics.component_accuracy(structure.error_families(pairs(spark, sf)))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


EDGES = sorted({(s, d) for s, _, d, _ in FOREIGN_KEYS} | {(d, s) for s, _, d, _ in FOREIGN_KEYS})


@query("connectivity", f"""WITH {STRUCTURES}, u AS (SELECT case_id, side, list_filter(list_distinct(list_concat(tables, CASE WHEN projection_count % 2 = 0 THEN ['nation'] ELSE [] END)), lambda x: (x IS NOT NULL)) AS used FROM st)
 SELECT case_id, side, array_to_string(list_sort(used), ',') AS used, len(used) <= 1 OR (NOT list_contains(used, 'nation') AND (len(used) = 2 AND (NOT list_contains(used, 'lineitem') OR list_contains(used, 'orders')) OR len(used) = 3))
 OR (list_contains(used, 'nation') AND list_contains(used, 'customer') AND (NOT list_contains(used, 'lineitem') OR list_contains(used, 'orders'))) AS is_connected FROM u""")
def connectivity(spark, sf):
    """K6: connectivity of the tables each statement uses."""
    edges = structure.edge_array(catalog_fks(spark, FOREIGN_KEYS))
    extra = F.when(F.col("projection_count") % 2 == 0, F.array(F.lit("nation"))).otherwise(F.array().cast("array<string>"))
    used = structures(spark, sf).select("case_id", "side", F.sort_array(F.array_union("tables", extra)).alias("used"), edges.alias("edges"))
    marked = used.withColumn("is_connected", structure.connected(F.col("used"), F.col("edges")))
    return marked.select("case_id", "side", F.array_join(marked["used"], ",").alias("used"), "is_connected")


@query("invalid_joins", f"""WITH {EFFECTS} SELECT case_id, side, bool_or(column_name = 'o_orderkey') AS invalid_join FROM ef WHERE kind = 'join' GROUP BY 1, 2""")
def invalid_joins(spark, sf):
    """Joins of FK-related tables that are not on a declared key."""
    return structure.invalid_joins(query_effects(spark, sf), catalog_fks(spark, FOREIGN_KEYS))


def planned(spark, sf):
    """Predicted statements with a plan taken from the reference statement of the same customer."""
    def strings(*values):
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    edges = structure.edge_array(catalog_fks(spark, FOREIGN_KEYS))
    both = pairs(spark, sf).filter("reference IS NOT NULL AND prediction IS NOT NULL")
    rows = both.select("case_id", "prediction.*", F.col("reference").alias("ref"))
    rows = rows.withColumns({
        "known_tables": strings("orders", "customer", "nation"), "known_columns": strings("status", "price", "day", "o_custkey", "c_custkey", "o_orderkey"),
        "mentioned_columns": F.slice("ref.columns", 1, 1), "required_outputs": F.col("ref.projection_columns"),
        "required_filters": F.col("ref.where_columns"), "aggregation": F.col("ref.first_aggregate"),
        "aggregate_required": F.size("ref.aggregates") > 0, "group_required": F.col("ref.grouping"), "order_required": F.col("ref.ordering"),
        "filter_required": F.size("ref.where_columns") > 0, "limit_required": F.col("ref.limit"), "join_required": F.col("ref.joins") > 0,
        "expected_projection_count": F.when(F.col("ref.projection_count") > 0, F.col("ref.projection_count")),
        "expected_literals": F.col("ref.literals"), "expected_operators": F.col("ref.operators"), "distinct_required": F.col("ref.distinct"),
        "ratio_required": F.col("ref.subquery"), "percentage_required": F.lit(False), "cleanup_required": F.col("ref.conversion"),
        "has_arithmetic": F.col("subquery"), "has_cleanup": F.col("conversion"), "wanted_direction": F.col("ref.ordering_direction"),
        "_edges": edges,
    })
    bad = structure.invalid_joins(query_effects(spark, sf), catalog_fks(spark, FOREIGN_KEYS)).filter("side = 'prediction'").drop("side")
    return (
        rows.withColumn("is_connected", structure.connected(F.col("tables"), F.col("_edges"))).drop("_edges")
        .join(bad, "case_id", "left").fillna(False, ["invalid_join"])
    )


_MISSING = "len(list_filter({a}, lambda x: (NOT list_contains({b}, x)))) = 0"
PLANNED = PAIRS + """, bad AS (SELECT case_id, bool_or(column_name = 'o_orderkey') AS invalid_join FROM ef WHERE kind = 'join' AND side = 'prediction' GROUP BY 1),
pl AS (SELECT pr.case_id, p, r, coalesce(invalid_join, false) AS invalid_join FROM pr LEFT JOIN bad USING (case_id) WHERE NOT missing),
ck AS (SELECT *, [CASE WHEN NOT """ + _MISSING.format(a="p.tables", b="['orders', 'customer', 'nation']") + """ THEN 'known_tables' END,
 CASE WHEN NOT """ + _MISSING.format(a="p.columns", b="['status', 'price', 'day', 'o_custkey', 'c_custkey', 'o_orderkey']") + """ THEN 'known_columns' END,
 CASE WHEN NOT """ + _MISSING.format(a="r.columns[1:1]", b="p.columns") + """ THEN 'mentioned_columns' END,
 CASE WHEN NOT (len(r.projection_columns) = 0 OR list_has_any(r.projection_columns, p.projection_columns)) THEN 'requested_projection' END,
 CASE WHEN NOT (len(r.where_columns) = 0 OR list_has_any(r.where_columns, p.where_columns)) THEN 'requested_filters' END,
 CASE WHEN NOT (len(r.aggregates) = 0 OR len(p.aggregates) > 0 OR (coalesce(r.first_aggregate IN ('max', 'min'), false) AND p.ordering AND p.limit_)) THEN 'aggregation' END,
 CASE WHEN r.grouping AND NOT p.grouping THEN 'grouping' END, CASE WHEN len(r.where_columns) > 0 AND len(p.where_columns) = 0 THEN 'filtering' END,
 CASE WHEN r.ordering AND NOT p.ordering THEN 'ordering' END, CASE WHEN r.limit_ AND NOT p.limit_ THEN 'limit' END,
 CASE WHEN r.joins > 0 AND p.joins = 0 THEN 'joins' END,
 CASE WHEN r.joins > 0 AND NOT (len(p.tables) <= 1 OR len(p.tables) = 3 OR list_contains(p.tables, 'orders')) THEN 'foreign_key_connectivity' END] AS c FROM pl),
cv AS (SELECT *, list_filter(c, lambda x: (x IS NOT NULL)) AS failed FROM ck)"""


@query("coverage_checks", f"WITH {PLANNED} SELECT case_id, array_to_string(failed, ',') AS failed_checks, len(failed) = 0 AS covered FROM cv")
def coverage_checks(spark, sf):
    """K5."""
    return structure.coverage_checks(planned(spark, sf)).select("case_id", F.array_join("failed_checks", ",").alias("failed_checks"), "covered")


@query("semantic_checks", f"""WITH {PLANNED}, sm AS (SELECT case_id, list_concat(failed, list_filter([CASE WHEN r.projection_count > 0 AND p.projection_count < r.projection_count THEN 'projection_count' END,
 CASE WHEN NOT """ + _MISSING.format(a="r.literals", b="p.literals") + """ THEN 'literal_values' END,
 CASE WHEN len(r.operators) > 0 AND NOT list_has_any(r.operators, p.operators) THEN 'comparison_operators' END, CASE WHEN invalid_join THEN 'join_predicates' END,
 CASE WHEN r.distinct_ AND NOT p.distinct_ THEN 'distinct' END, CASE WHEN r.subquery AND NOT p.subquery THEN 'ratio' END, CASE WHEN r.conversion AND NOT p.conversion THEN 'numeric_cleanup' END,
 CASE WHEN r.ordering_direction IS NOT NULL AND r.ordering_direction IS DISTINCT FROM p.ordering_direction THEN 'ordering_direction' END,
 CASE WHEN p.limit_ AND NOT r.limit_ THEN 'unnecessary_limit' END], lambda x: (x IS NOT NULL))) AS d FROM cv)
 SELECT case_id, array_to_string(d, ',') AS diagnostics, len(list_filter(d, lambda x: (x NOT IN ('mentioned_columns', 'projection_count'))))::INT AS hard,
 round(len(list_filter(d, lambda x: (x NOT IN ('mentioned_columns', 'projection_count')))) / 20, 6) AS semantic_risk FROM sm""")
def semantic_checks(spark, sf):
    """K7."""
    found = structure.semantic_checks(planned(spark, sf))
    return found.select(
        "case_id", F.array_join("diagnostics", ",").alias("diagnostics"), F.size("hard_diagnostics").alias("hard"),
        F.round("semantic_risk", 6).alias("semantic_risk"),
    )


def critic_rows(spark, sf):
    """Predicted statements with an intent read from the reference statement."""
    rows = planned(spark, sf)
    return rows.withColumns({
        "intent_projections": F.col("ref.projection_count"), "required_projection": F.col("required_outputs"),
        "expected_aggregates": F.array_distinct("ref.aggregates"), "selected_tables": F.col("ref.tables"),
        "high_confidence": F.col("case_id") % 2 == 0,
        "grain": F.when(F.col("ref.grouping"), "one row per status").when(F.size("ref.aggregates") > 0, "scalar").otherwise("list"),
        "intent_grouping": F.col("ref.grouping"), "intent_having": F.col("ref.having"), "intent_distinct": F.col("ref.distinct"),
        "intent_ordering": F.col("ref.ordering"), "intent_direction": F.coalesce("ref.ordering_direction", F.lit("unknown")),
        "intent_limit": F.when(F.col("ref.limit"), F.lit(2)), "intent_subquery": F.col("ref.subquery"), "intent_set_operation": F.lit("none"),
        "result_rows": F.when(F.col("case_id") % 3 != 0, F.col("case_id") % 4),
    })


@query("intent_critic", f"""WITH {PLANNED}, it AS (SELECT case_id, p, r, case_id % 2 = 0 AS hc, NOT r.grouping AND len(r.aggregates) > 0 AS scalar_,
 CASE WHEN case_id % 3 <> 0 THEN case_id % 4 END AS rr FROM pl),
fl AS (SELECT case_id, p, r, hc, list_filter([CASE WHEN NOT """ + _MISSING.format(a="p.tables", b="['orders', 'customer', 'nation']") + """ THEN 'known_tables' END,
 CASE WHEN hc AND NOT """ + _MISSING.format(a="r.tables", b="p.tables") + """ THEN 'required_tables' END,
 CASE WHEN r.projection_count > 0 AND p.projection_count <> r.projection_count THEN 'projection_count' END,
 CASE WHEN NOT """ + _MISSING.format(a="r.projection_columns", b="p.projection_columns") + """ THEN 'projection_bindings' END,
 CASE WHEN NOT """ + _MISSING.format(a="r.where_columns", b="p.where_columns") + """ THEN 'filter_bindings' END,
 CASE WHEN NOT """ + _MISSING.format(a="r.literals", b="p.literals") + """ THEN 'literal_values' END,
 CASE WHEN NOT """ + _MISSING.format(a="r.aggregates", b="p.aggregates") + """ THEN 'aggregate_functions' END,
 CASE WHEN r.grouping AND NOT p.grouping THEN 'grouping_grain' END, CASE WHEN scalar_ AND p.grouping THEN 'global_scalar_grain' END,
 CASE WHEN r.having_ AND NOT p.having_ THEN 'having' END, CASE WHEN r.distinct_ AND NOT p.distinct_ THEN 'distinct' END, CASE WHEN r.ordering AND NOT p.ordering THEN 'ordering' END,
 CASE WHEN r.ordering AND r.ordering_direction IS DISTINCT FROM p.ordering_direction THEN 'ordering_direction' END, CASE WHEN r.limit_ AND NOT p.limit_ THEN 'limit' END,
 CASE WHEN p.limit_ AND NOT r.limit_ THEN 'unnecessary_limit' END, CASE WHEN r.subquery AND NOT p.subquery THEN 'subquery' END,
 CASE WHEN coalesce(scalar_ AND rr > 1, false) THEN 'result_shape' END, CASE WHEN coalesce(r.limit_ AND rr > 2, false) THEN 'result_limit_shape' END], lambda x: (x IS NOT NULL)) AS f FROM it),
ac AS (SELECT *, list_filter(f, lambda x: (CASE WHEN x IN ('subquery', 'grouping_grain', 'global_scalar_grain') THEN false WHEN x = 'required_tables' THEN hc
 WHEN x = 'projection_bindings' THEN len(r.projection_columns) > 0 WHEN x = 'filter_bindings' THEN len(r.where_columns) > 0 ELSE true END)) AS a,
 13 + hc::INT + (len(r.projection_columns) > 0)::INT + (len(r.where_columns) > 0)::INT AS rules FROM fl)
SELECT case_id, array_to_string(a, ',') AS actionable, len(f)::INT - len(a)::INT AS telemetry, round(len(a) / rules, 6) AS risk FROM ac""")
def intent_critic(spark, sf):
    """K8."""
    found = structure.intent_critic(critic_rows(spark, sf))
    return found.select(
        "case_id", F.array_join("actionable", ",").alias("actionable"), F.size("telemetry").alias("telemetry"), F.round("risk", 6).alias("risk")
    )


@query("intent_accuracy", f"""WITH {PAIRS} SELECT count(*) * 5 AS checks, round(avg(((r.projection_count = p.projection_count)::INT + ((len(r.aggregates) > 0) = (len(p.aggregates) > 0))::INT +
 (r.grouping = p.grouping)::INT + (r.having_ = p.having_)::INT + (r.limit_ = p.limit_)::INT) / 5), 9) AS intent_accuracy FROM pr WHERE NOT missing""")
def intent_accuracy(spark, sf):
    """Five of the booleans over every case with both statements."""
    rows = pairs(spark, sf).filter("reference IS NOT NULL AND prediction IS NOT NULL")

    def same(field):
        return (F.col(f"reference.{field}") == F.col(f"prediction.{field}")).alias(f"same_{field}")

    checks = rows.select(
        F.lit(True).alias("has_intent"), same("projection_count"), same("grouping"), same("having"), same("limit"),
        ((F.size("reference.aggregates") > 0) == (F.size("prediction.aggregates") > 0)).alias("same_aggregates"),
    )
    found = metrics.intent_accuracy(checks, [c for c in checks.columns if c.startswith("same_")])
    return found.withColumn("intent_accuracy", F.round("intent_accuracy", 9))


def fact_rows(spark, sf):
    """Evidence facts per customer: predicted predicates as values, plus a join and a storage fact."""
    effects = query_effects(spark, sf).filter("side = 'prediction'")
    values = effects.filter("kind = 'predicate'").select(
        "case_id", F.col("position").alias("fact_no"), F.lit("literal_value").alias("type"), "table_name", "column_name",
        F.col("value").alias("db_value"), F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("string").alias("target_column"),
    )
    storage = effects.filter("kind = 'ordering'").select(
        "case_id", F.col("position").alias("fact_no"), F.lit("numeric_or_storage").alias("type"), "table_name", "column_name",
        F.lit(None).cast("string").alias("db_value"), F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("string").alias("target_column"),
    )
    joins = effects.filter("kind = 'limit'").select(
        "case_id", F.col("position").alias("fact_no"), F.lit("join_relationship").alias("type"), F.lit("orders").alias("table_name"),
        F.lit("o_custkey").alias("column_name"), F.lit(None).cast("string").alias("db_value"), F.lit("customer").alias("target_table"),
        F.lit("c_custkey").alias("target_column"),
    )
    return values.unionByName(storage).unionByName(joins)


UTILIZATION = EFFECTS + """, fc AS (SELECT case_id, position AS fact_no, CASE kind WHEN 'predicate' THEN 'literal_value' WHEN 'ordering' THEN 'numeric_or_storage' ELSE 'join_relationship' END AS type,
 CASE WHEN kind = 'limit' THEN 'orders' ELSE table_name END AS t, CASE WHEN kind = 'limit' THEN 'o_custkey' ELSE column_name END AS c, CASE WHEN kind = 'predicate' THEN value END AS v
 FROM ef WHERE side = 'prediction' AND kind IN ('predicate', 'ordering', 'limit')),
jr AS (SELECT case_id, side, bool_or(least(table_name || '.' || column_name, value) = 'customer.c_custkey' AND greatest(table_name || '.' || column_name, value) = 'orders.o_custkey') AS hit FROM ef WHERE kind = 'join' GROUP BY 1, 2),
tc AS (SELECT fc.case_id, fact_no, type, v, e.side, e.kind, e.value FROM fc JOIN ef e ON e.case_id = fc.case_id AND e.column_name = fc.c AND e.table_name = fc.t AND e.kind <> 'join' WHERE type <> 'join_relationship'),
rl AS (SELECT fc.case_id, fc.fact_no, fc.type, fc.v,
 CASE WHEN fc.type = 'join_relationship' THEN CASE WHEN (SELECT coalesce(bool_or(hit), false) FROM jr WHERE jr.case_id = fc.case_id AND side = 'reference') THEN ['join'] ELSE [] END
 WHEN fc.v IS NOT NULL THEN CASE WHEN bool_or(tc.side = 'reference' AND tc.kind = 'predicate' AND tc.value = fc.v) THEN ['predicate'] ELSE [] END
 ELSE coalesce(list_sort(list_distinct(list(tc.kind) FILTER (tc.side = 'reference' AND tc.kind IN ('conversion', 'predicate', 'aggregation')))), []) END AS e,
 CASE WHEN fc.type = 'join_relationship' THEN CASE WHEN (SELECT coalesce(bool_or(hit), false) FROM jr WHERE jr.case_id = fc.case_id AND side = 'prediction') THEN ['join'] ELSE [] END
 WHEN fc.v IS NOT NULL AND bool_or(tc.side = 'prediction' AND tc.kind = 'predicate' AND tc.value = fc.v) THEN ['predicate']
 ELSE coalesce(list_sort(list_distinct(list(tc.kind) FILTER (tc.side = 'prediction'))), []) END AS o,
 coalesce(bool_or(tc.side = 'prediction' AND tc.kind = 'predicate'), false) AS pp, coalesce(bool_or(tc.side = 'prediction' AND tc.kind = 'predicate' AND tc.value = fc.v), false) AS px
 FROM fc LEFT JOIN tc ON tc.case_id = fc.case_id AND tc.fact_no = fc.fact_no GROUP BY 1, 2, 3, 4),
us AS (SELECT case_id, fact_no, type, array_to_string(e, ',') AS expected_roles, array_to_string(o, ',') AS observed_roles, len(e) > 0 AS relevant,
 CASE WHEN list_contains(e, 'predicate') AND pp AND NOT px THEN 'contradicted' WHEN list_has_any(e, o) THEN 'correctly_used' WHEN len(e) > 0 AND len(o) > 0 THEN 'misapplied'
 WHEN len(e) > 0 THEN 'ignored' WHEN len(o) > 0 THEN 'unnecessarily_used' ELSE 'ignored' END AS label FROM rl)"""


def used_facts(spark, sf):
    return structure.utilization(fact_rows(spark, sf), query_effects(spark, sf))


@query("utilization", f"WITH {UTILIZATION} SELECT * FROM us")
def utilization(spark, sf):
    """K15."""
    return used_facts(spark, sf).select(
        "case_id", "fact_no", "type", F.array_join("expected_roles", ",").alias("expected_roles"),
        F.array_join("observed_roles", ",").alias("observed_roles"), "label", "relevant",
    )


@query("utilization_rates", f"""WITH {UTILIZATION} SELECT type, count(*) FILTER (relevant) AS relevant_facts, count(*) FILTER (NOT relevant) AS irrelevant_facts,
 round(count(*) FILTER (label = 'correctly_used') / nullif(count(*) FILTER (relevant), 0), 9) AS utilization_accuracy,
 round(count(*) FILTER (label = 'unnecessarily_used') / nullif(count(*) FILTER (NOT relevant), 0), 9) AS unnecessary_use_rate FROM us GROUP BY type""")
def utilization_rates(spark, sf):
    """K16."""
    found = structure.utilization_rates(used_facts(spark, sf), ["type"])
    return found.withColumns({c: F.round(c, 9) for c in ("utilization_accuracy", "unnecessary_use_rate")})


@query("evidence_metrics", f"""WITH {EFFECTS}, cs AS (SELECT DISTINCT case_id, case_id % 4 AS g FROM ef), f AS (SELECT case_id, position, table_name AS t, column_name AS c, value AS v FROM ef WHERE side = 'prediction' AND kind = 'predicate'),
 l AS (SELECT DISTINCT case_id, CASE WHEN position % 3 = 0 THEN NULL ELSE table_name END AS t, column_name AS c, value AS v FROM ef WHERE side = 'reference' AND kind = 'predicate'),
 fx AS (SELECT f.*, EXISTS (SELECT 1 FROM l WHERE l.case_id = f.case_id AND l.v = f.v) AS cand, EXISTS (SELECT 1 FROM l WHERE l.case_id = f.case_id AND l.v = f.v AND l.c = f.c AND (l.t IS NULL OR l.t = f.t)) AS rel FROM f),
 lx AS (SELECT l.*, EXISTS (SELECT 1 FROM f WHERE l.case_id = f.case_id AND l.v = f.v AND l.c = f.c AND (l.t IS NULL OR l.t = f.t)) AS hit FROM l),
 fa AS (SELECT case_id, count(*) AS supplied, count(*) FILTER (cand) AS mapping_candidates, count(*) FILTER (rel) AS relevant FROM fx GROUP BY 1),
 la AS (SELECT case_id, count(*) AS required, count(*) FILTER (hit) AS recovered FROM lx GROUP BY 1),
 t AS (SELECT g AS "group", count(*) AS cases, coalesce(sum(required), 0)::BIGINT AS required, coalesce(sum(recovered), 0)::BIGINT AS recovered, coalesce(sum(supplied), 0)::BIGINT AS supplied,
 coalesce(sum(mapping_candidates), 0)::BIGINT AS mapping_candidates, coalesce(sum(relevant), 0)::BIGINT AS relevant FROM cs LEFT JOIN la USING (case_id) LEFT JOIN fa USING (case_id) GROUP BY 1)
 SELECT *, round(coalesce(recovered / nullif(required, 0), 0), 9) AS literal_recall, round(coalesce(relevant / nullif(supplied, 0), 0), 9) AS evidence_precision,
 round(coalesce(relevant / nullif(mapping_candidates, 0), 0), 9) AS value_column_accuracy FROM t""")
def evidence_metrics(spark, sf):
    """M9: gold predicates against supplied values; every third gold column is unqualified."""
    effects = query_effects(spark, sf)
    cases = effects.select("case_id").distinct().withColumn("group", F.col("case_id") % 4)
    predicates = effects.filter("kind = 'predicate'")
    facts = predicates.filter("side = 'prediction'").select(
        "case_id", F.col("position").alias("fact_no"), "table_name", "column_name", "value", F.lit(None).cast("string").alias("transformation")
    )
    gold = predicates.filter("side = 'reference'").select(
        "case_id", F.when(F.col("position") % 3 != 0, F.col("table_name")).alias("table_name"), "column_name", "value"
    )
    found = metrics.evidence_metrics(cases, facts, gold)
    return found.withColumns({c: F.round(c, 9) for c in ("literal_recall", "evidence_precision", "value_column_accuracy")})


@query("schema_recall", f"""WITH {PAIRS}, v AS (SELECT case_id % 3 AS mode, list_filter(r.tables, lambda x: (x <> 'lineitem')) AS vt, list_filter(r.columns, lambda x: (x <> 'day')) AS vc, r, p, NOT missing AS parsed FROM pr),
 h AS (SELECT mode, parsed, CASE WHEN parsed THEN len(list_intersect(vt, p.tables)) ELSE 0 END AS th, CASE WHEN parsed THEN len(vt) ELSE 0 END AS tt, CASE WHEN parsed THEN len(list_intersect(vc, p.columns)) ELSE 0 END AS ch,
 CASE WHEN parsed THEN len(vc) ELSE 0 END AS ct, parsed AND len(vt) > 1 AS need, coalesce(len(list_intersect(vt, p.tables)) = len(vt), false) AS cov, CASE WHEN parsed THEN len(r.tables) - len(vt) ELSE 0 END AS bt,
 CASE WHEN parsed THEN len(r.columns) - len(vc) ELSE 0 END AS bc FROM v)
 SELECT mode, round(sum(th) / sum(tt), 9) AS schema_table_recall, round(sum(ch) / sum(ct), 9) AS schema_column_recall, round(count(*) FILTER (need AND cov) / count(*) FILTER (need), 9) AS foreign_key_path_coverage,
 round(avg(parsed::INT), 9) AS reference_parse_coverage, sum(bt)::BIGINT AS invalid_reference_tables, sum(bc)::BIGINT AS invalid_reference_columns FROM h GROUP BY mode""")
def schema_recall(spark, sf):
    """M7: tables and columns of the reference found by the prediction."""
    rows = pairs(spark, sf).filter("reference IS NOT NULL").select(
        (F.col("case_id") % 3).alias("mode"), F.col("prediction").isNotNull().alias("parsed"), F.col("reference.tables").alias("required_tables"),
        F.col("reference.columns").alias("required_columns"), F.col("prediction.tables").alias("selected_tables"),
        F.col("prediction.columns").alias("selected_columns"), F.array(F.lit("orders"), F.lit("customer")).alias("known_tables"),
        F.array(*[F.lit(c) for c in ("status", "price", "o_custkey", "c_custkey", "o_orderkey", "l_orderkey")]).alias("known_columns"),
    )
    found = metrics.schema_recall(rows, ["mode"])
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.endswith(("recall", "coverage"))})


@query("evidence_recall", f"""WITH {PAIRS}, m AS (SELECT len(list_intersect(r.tables, p.tables)) AS th, len(r.tables) AS tt, len(list_intersect(r.columns, p.columns)) AS ch, len(r.columns) AS ct,
 len(list_intersect(r.literals, p.literals)) AS lh, len(r.literals) AS lt FROM pr WHERE NOT missing)
 SELECT round(avg(th / tt) FILTER (tt > 0), 9) AS evidence_table_recall, round(avg(ch / ct) FILTER (ct > 0), 9) AS evidence_column_recall, round(avg(lh / lt) FILTER (lt > 0), 9) AS evidence_literal_recall,
 count(*) FILTER (lt > 0) AS scorable_literal_cases FROM m""")
def evidence_recall(spark, sf):
    """M8."""
    names = {}
    for kind in ("tables", "columns", "literals"):
        names[f"required_{kind}"] = F.col(f"reference.{kind}")
        names[f"supplied_{kind}"] = F.col(f"prediction.{kind}")
    rows = pairs(spark, sf).filter("reference IS NOT NULL AND prediction IS NOT NULL").select(*[c.alias(n) for n, c in names.items()])
    found = metrics.evidence_recall(rows)
    return found.withColumns({c: F.round(c, 9) for c in found.columns if c.endswith("recall")})


def signatures(spark, sf):
    """Error signatures of the predictions, family = shape class."""
    shape = F.struct(
        F.array_compact(F.array(
            F.when(F.col("ordering"), "asks_list"), F.when(F.size("aggregates") > 0, "asks_count"), F.when(F.col("limit"), "asks_top_k"),
            F.when(F.col("distinct"), "asks_distinct"),
        )).alias("flags"),
        F.array_compact(F.array(F.when(F.size("literals") > 0, "filter_value"), F.when(F.col("joins") > 0, "join"))).alias("roles"),
        (F.size("aggregates") > 0).alias("has_aggregate"), F.col("grouping").alias("group_by"), F.col("joins").alias("join_count"),
        "projection_count", F.size("predicates").cast("long").alias("predicate_count"),
    )
    classes = structure.shape_class(query_effects(spark, sf))
    return structures(spark, sf).join(classes, ["case_id", "side"]).select("case_id", "side", F.col("shape").alias("family"), shape.alias("signature"))


@query("memory_topk", f"""WITH {STRUCTURES}, k AS (SELECT case_id, side, CASE WHEN bool_or(kind = 'subquery') THEN 'set_or_subquery' WHEN bool_or(kind = 'join') THEN 'join'
 WHEN bool_or(kind IN ('aggregation', 'grouping')) THEN 'aggregate' WHEN bool_or(kind IN ('ordering', 'limit')) THEN 'ordering' ELSE 'simple' END AS family FROM ef GROUP BY 1, 2),
 sg AS (SELECT case_id, side, family, list_filter([CASE WHEN ordering THEN 'asks_list' END, CASE WHEN len(aggregates) > 0 THEN 'asks_count' END, CASE WHEN limit_ THEN 'asks_top_k' END, CASE WHEN distinct_ THEN 'asks_distinct' END], lambda x: (x IS NOT NULL)) AS fl,
 list_filter([CASE WHEN len(literals) > 0 THEN 'filter_value' END, CASE WHEN joins > 0 THEN 'join' END], lambda x: (x IS NOT NULL)) AS ro,
 len(aggregates) > 0 AS ha, grouping AS gb, joins AS jc, projection_count AS pc, len(predicates) AS pd FROM st JOIN k USING (case_id, side)),
 sc AS (SELECT a.case_id, b.case_id AS identity, round(0.45::DOUBLE * (len(list_intersect(a.fl, b.fl)) / greatest(1, len(list_distinct(list_concat(a.fl, b.fl))))) + 0.20::DOUBLE * (len(list_intersect(a.ro, b.ro)) / greatest(1, len(list_distinct(list_concat(a.ro, b.ro)))))
 + 0.35::DOUBLE * (((a.ha = b.ha)::INT + (a.gb = b.gb)::INT + (a.jc = b.jc)::INT + (a.pc = b.pc)::INT + (a.pd = b.pd)::INT) / 5), 9) AS similarity
 FROM sg a JOIN sg b ON a.family = b.family AND a.side = 'prediction' AND b.side = 'reference')
 SELECT case_id, identity, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, identity) AS rank FROM sc) WHERE rank <= 3""")
def memory_topk(spark, sf):
    """The three most similar reference signatures of the same family per prediction."""
    all_signatures = signatures(spark, sf)
    asked = all_signatures.filter("side = 'prediction'").drop("side")
    memory = all_signatures.filter("side = 'reference'").select("family", "signature", F.col("case_id").alias("identity"))
    return structure.memory_lookup(asked, memory).select("case_id", "identity", "similarity", "rank")


@query("record_identity", f"""WITH {STRUCTURES} SELECT case_id, side, sha256('{{"case_id":' || case_id || ',"side":"' || side || '","joins":' || joins || '}}') AS identity FROM st""")
def record_identity(spark, sf):
    """K14."""
    return structures(spark, sf).select("case_id", "side", structure.record_identity("case_id", "side", "joins").alias("identity"))


def detections(spark, sf):
    predicted = structures(spark, sf).filter("side = 'prediction'").drop("side")
    flags = F.when(F.col("case_id") % 3 == 0, F.array(F.lit("asks_count"))).when(F.col("case_id") % 3 == 1, F.array(F.lit("asks_list"))).otherwise(
        F.array(F.lit("asks_each"))
    )
    cases = predicted.withColumns({"flags": flags, "question": F.lit("rows with v0 v1 v2 and v3")})
    effects = query_effects(spark, sf).filter("side = 'prediction'")
    facts = fact_rows(spark, sf).withColumn("phrase", F.col("db_value")).withColumn(
        "column_name", F.when((F.col("type") == "literal_value") & (F.col("fact_no") % 5 == 0), "other").otherwise(F.col("column_name"))
    )
    return structure.detect(cases, effects, facts)


@query("detect_rules", f"""WITH {STRUCTURES}, p AS (SELECT *, case_id % 3 AS m FROM st WHERE side = 'prediction'),
 pf AS (SELECT case_id, position AS fact_no, table_name AS t, CASE WHEN position % 5 = 0 THEN 'other' ELSE column_name END AS c, value AS v FROM ef WHERE side = 'prediction' AND kind = 'predicate'),
 ph AS (SELECT e.case_id, e.position, e.column_name, count(*) AS n, any_value(pf.t) AS t, any_value(pf.c) AS c FROM ef e JOIN pf ON pf.case_id = e.case_id AND pf.v = e.value
 WHERE e.side = 'prediction' AND e.kind = 'predicate' AND e.operator <> 'like' GROUP BY 1, 2, 3 HAVING count(*) = 1),
 jf AS (SELECT case_id, count(*) AS n FROM ef WHERE side = 'prediction' AND kind = 'limit' GROUP BY 1),
 jh AS (SELECT e.case_id, e.position FROM ef e JOIN jf USING (case_id) JOIN p USING (case_id) WHERE e.side = 'prediction' AND e.kind = 'join' AND jf.n = 1 AND list_contains(p.tables, 'orders') AND list_contains(p.tables, 'customer')
 AND e.table_name IN ('orders', 'customer') AND least(e.column_name, split_part(e.value, '.', 2)) || greatest(e.column_name, split_part(e.value, '.', 2)) <> 'c_custkeyo_custkey'),
 h AS (SELECT case_id, 1 AS rule, 0 AS pos, 'operation' AS family, 'wrong_aggregate' AS subtype, 0.96::DOUBLE AS confidence, 'replace_aggregate:count' AS patch FROM p WHERE m = 0 AND len(aggregates) > 0 AND first_aggregate <> 'count'
 UNION ALL SELECT case_id, 2, 0, 'operation', 'unrequested_aggregate', 0.95, 'remove_aggregate' FROM p WHERE m = 1 AND len(aggregates) > 0 AND NOT grouping AND projection_count = 1
 UNION ALL SELECT case_id, 3, 0, 'grain', 'missing_group', 0.93, 'group_by_nonaggregate_projections' FROM p WHERE m = 2 AND len(aggregates) > 0 AND NOT grouping AND plain_projections > 0
 UNION ALL SELECT case_id, 4, position, 'predicate', 'wrong_filter_column', 0.97, 'predicate_column:' || t || ':' || c FROM ph WHERE c <> column_name
 UNION ALL SELECT case_id, 5, position, 'join', 'wrong_join_predicate', 0.95, 'join:orders:o_custkey:customer:c_custkey' FROM jh)
 SELECT case_id, family, subtype, confidence, patch FROM h QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY rule, pos) = 1""")
def detect_rules(spark, sf):
    """K12."""
    return detections(spark, sf)


@query("mutant_filter", evaluation.SUPPLIER_RESULTS + "SELECT case_id, case_id % 4 AS kind FROM verdict WHERE NOT multiset_equal")
def mutant_filter(spark, sf):
    """Perturbed results that differ from their gold result."""
    cases, gold, predicted = evaluation.supplier_results(spark, sf)
    verdicts = results.multiset_equal(cases, gold, predicted)
    return structure.differing_mutants(cases.select("case_id", (F.col("case_id") % 4).alias("kind")), verdicts)


@query("natural_errors", f"""WITH {TRUE_FAMILIES} SELECT case_id, families[1] AS family, CASE families[1] WHEN 'operation' THEN 'restore_requested_operation' WHEN 'grain' THEN 'restore_result_grain'
 WHEN 'predicate' THEN 'restore_predicate_binding' ELSE 'restore_join_relationship' END AS minimal_patch FROM tf WHERE len(families) = 1 AND case_id % 5 <> 0""")
def natural_errors(spark, sf):
    """K17."""
    both = pairs(spark, sf)
    cases = both.filter("reference IS NOT NULL").select(
        "case_id", (F.col("case_id") % 5 == 0).alias("correct"), F.col("prediction").isNotNull().alias("has_statement")
    )
    return structure.natural_errors(cases, structure.true_families(both))


@query("correction_overlay", f"""WITH {TRUE_FAMILIES} SELECT case_id, CASE WHEN NOT coalesce(families[1] IN ('operation', 'predicate'), false) THEN 'detector_abstained' WHEN case_id % 4 = 0 THEN 'localized_patch_unavailable'
 WHEN case_id % 3 <> 0 THEN 'calibrated_local_patch' ELSE 'patch_execution_failed_original_retained' END AS selection_reason,
 CASE WHEN coalesce(families[1] IN ('operation', 'predicate'), false) AND case_id % 4 <> 0 AND case_id % 3 <> 0 THEN 'patched-' || case_id ELSE 'original-' || case_id END AS result FROM tf""")
def correction_overlay(spark, sf):
    """Patched results replace the original only where calibrated and executed."""
    families = structure.true_families(pairs(spark, sf))
    key = F.col("case_id")
    cases = families.select("case_id", F.concat(F.lit("original-"), key.cast("string")).alias("result"))
    found = families.select("case_id", F.try_element_at("families", F.lit(1)).alias("family"))
    patched = families.filter(key % 4 != 0).select(
        "case_id", F.concat(F.lit("patched-"), key.cast("string")).alias("patched_result"), (key % 3 != 0).alias("executed")
    )
    return structure.correction_overlay(cases, found, patched, ["operation", "predicate"])


@query("transition_audit", f"""WITH {UTILIZATION}, pc AS (SELECT DISTINCT case_id, case_id % 2 = 0 AS l, case_id % 3 = 0 AS r FROM ef), ch AS (SELECT case_id, CASE WHEN r THEN 'recovery' ELSE 'regression' END AS transition FROM pc WHERE l <> r),
 kc AS (SELECT case_id, kind FROM ef GROUP BY 1, 2 HAVING count(*) FILTER (side = 'reference') <> count(*) FILTER (side = 'prediction')), kk AS (SELECT case_id, string_agg(kind, ',' ORDER BY kind) AS components FROM kc GROUP BY 1),
 fa AS (SELECT case_id, count(*) AS facts, count(*) FILTER (relevant) AS rel, count(*) FILTER (label = 'correctly_used') AS used FROM us GROUP BY 1)
 SELECT case_id, transition, coalesce(components, 'expression_or_binding') AS components, coalesce(facts, 0) AS facts, CASE WHEN coalesce(rel, 0) = coalesce(facts, 0) THEN 'yes' WHEN rel > 0 THEN 'partly' ELSE 'no' END AS evidence_relevant,
 coalesce(used, 0) > 0 AS used_relevant_evidence FROM ch LEFT JOIN kk USING (case_id) LEFT JOIN fa USING (case_id)""")
def transition_audit(spark, sf):
    """M17."""
    effects = query_effects(spark, sf)
    paired = effects.select("case_id").distinct().select(
        "case_id", (F.col("case_id") % 2 == 0).alias("left_correct"), (F.col("case_id") % 3 == 0).alias("right_correct")
    )
    audit = metrics.transition_audit(
        paired, effects.filter("side = 'reference'"), effects.filter("side = 'prediction'"), used_facts(spark, sf)
    )
    return audit.withColumn("components", F.array_join("components", ","))
