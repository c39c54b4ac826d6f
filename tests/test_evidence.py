"""Evidence, notes, closure and metrics on small fixtures with known outcomes."""

import pytest
from pyspark.sql import functions as F

from groundscope.operators import catalog, evidence, match, metrics, probe, profile, results, structure
from groundscope.sources.tables import catalog_columns, catalog_fks


def packet(spark, tables, keys, question, descriptions=None, fks=(), mode="all"):
    columns = catalog_columns(spark, tables, keys)
    notes = None
    if descriptions:
        notes = spark.createDataFrame(descriptions, "table_name string, column_name string, display_name string, description string, value_description string")
    counts = profile.value_counts(tables)
    described = profile.column_profile(counts, columns, notes)
    index = profile.value_index(profile.top_values(counts))
    asked = spark.createDataFrame([("q", question)], "question_id string, question string")
    relevance = evidence.column_relevance(asked, described)
    phrases = match.concept_phrases(asked)
    probed = evidence.explicit_probes(phrases, index, relevance, counts)
    facts = evidence.gather([
        evidence.literal_facts(phrases, index, relevance, probed), evidence.normalization_facts(asked, index, relevance),
        evidence.storage_facts(asked, described, relevance), evidence.semantics_facts(described, relevance), evidence.encoded_facts(asked, index, described),
    ])
    edges = catalog_fks(spark, list(fks))
    return evidence.assemble(facts, edges, mode), counts, edges


@pytest.mark.parametrize("mode, joins", [("literals", False), ("normalization", False), ("descriptions", True), ("all", True)])
def test_join_facts_belong_to_described_routes(spark, mode, joins):
    fields = {f: None for f in evidence.FACT_COLUMNS} | {"question_id": "q", "phrase": "kind", "confidence": 0.9, "column_relevance": 1}
    rows = []
    for name in ("parent", "child"):
        for kind in ("literal_value", "column_semantics", "normalization"):
            rows.append({**fields, "type": kind, "table_name": name, "column_name": "kind", "db_value": "PRI" if kind == "literal_value" else None, "transformation": "t"})
    kinds = {"confidence": "double", "column_relevance": "long", "target_table": "string"}
    facts = spark.createDataFrame([tuple(r[c] for c in evidence.FACT_COLUMNS) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in evidence.FACT_COLUMNS))
    edges = catalog_fks(spark, [("child", "parent_id", "parent", "id")])
    packed = evidence.assemble(facts, edges, mode)
    assert bool(packed.filter("type = 'join_relationship'").count()) == joins
    identities = {r["identity"] for r in evidence.packet_identity(packed.unionByName(packed.withColumn("question_id", F.lit("other"))), mode).collect()}
    assert len(identities) == 2


def test_encoded_values_and_seasons(spark):
    schools = spark.createDataFrame(
        [(1, "PRI", "2015/2016", "$1,200"), (2, "PUB", "2014/2015", "900"), (3, "PUB", "2015/2016", "1,050")],
        "id int, school_type string, season string, amount string",
    )
    packed, counts, edges = packet(
        spark, {"schools": schools}, {"schools": "id"}, "Which private schools competed in the 2016 season?",
        [("schools", "school_type", "type", "kind of school", "PRI means private school; PUB means public school")],
    )
    rows = packed.collect()
    assert ("encoded_value", "PRI") in {(r["type"], r["db_value"]) for r in rows}
    assert ("normalization", "2015/2016") in {(r["type"], r["db_value"]) for r in rows}
    assert len(rows) <= 12 and rows[0]["bytes_used"] <= 4096
    assert not [r for r in rows if r["column_name"] == "id" and r["transformation"] == "numeric_text_cast"]
    scoped = evidence.scope(packed)
    assert scoped.filter("type = 'encoded_value'").first()["allowed"] == "predicate"
    verified = probe.verify(scoped, counts, edges).filter("probe_kind IS NOT NULL").collect()
    assert len(verified) <= 4 and all(r["verified"] for r in verified if r["probe_kind"] == "value_existence")


def test_value_outside_the_index_is_found(spark):
    items = spark.range(150).select(F.col("id").cast("int"), F.format_string("ZZZ%03d", "id").alias("code"))
    rows = packet(spark, {"items": items}, {"items": "id"}, "Find item code ZZZ149")[0].collect()
    assert "ZZZ149" in {r["db_value"] for r in rows if r["type"] == "literal_value"}
    rows = packet(spark, {"items": items}, {"items": "id"}, "List item records")[0].collect()
    assert not [r for r in rows if r["type"] == "encoded_value"]


def test_join_and_numeric_probes(spark):
    tables = {"parent": spark.createDataFrame([(1, 2.5)], "id int, amount double"), "child": spark.createDataFrame([(1,)], "parent_id int")}
    counts = profile.value_counts(tables)
    edges = catalog_fks(spark, [("child", "parent_id", "parent", "id")])
    assert probe.join_cardinality(edges.drop("db_id"), counts).first()["joined_row_count"] == 1
    assert probe.numeric_storage(counts).filter("column_name = 'amount'").first()["native_numeric_count"] == 1


def test_counts_of_both_ends_meet_in_many_tasks(spark):
    # Both ends were sorted and joined by name and text, in as few tasks as the planner merged them to.
    tables = {
        "parent": spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int"),
        "child": spark.createDataFrame([(1, 2), (2, 2), (2, None), (9, 7)], "parent_id long, other_id int"),
    }
    keys = [("child", "parent_id", "parent", "id"), ("child", "other_id", "parent", "id"), ("parent", "id", "child", "parent_id"), ("parent", "id", "none", "id")]
    joined = probe.join_cardinality(catalog_fks(spark, keys).drop("db_id"), profile.value_counts(tables))
    assert {(r[0], r[1], r[2], r[3]): r[4] for r in joined.collect()} == dict(zip(keys, [5, 4, 5, 0]))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert f"], {spark.conf.get('spark.sql.shuffle.partitions')}" in plan and "RepartitionByExpression [edge" in plan


def test_bridges_are_closed_over(spark):
    tables = {t: spark.createDataFrame([], f"{t}_id int") for t in ("start", "bridge_a", "bridge_b", "target", "other", "spare")}
    columns = catalog_columns(spark, tables, {})
    paths = catalog.shortest_paths(catalog_fks(spark, [("start", "x", "bridge_a", "y"), ("bridge_a", "x", "bridge_b", "y"), ("bridge_b", "x", "target", "y")]))
    asked = spark.createDataFrame([("q", "start target other")], "question_id string, question string")
    assert set(catalog.link_tables(asked, columns, paths).first()["tables"]) == {"start", "bridge_a", "bridge_b", "target", "other"}


def notes_fixture(spark):
    return spark.createDataFrame(
        [("frpm", "CDSCode", "a", "", [], ["01", "02"], ["01", "02"], True), ("frpm", "Enrollment (K-12)", "b", "number of students", [], [], [], False),
         ("frpm", "County", "c", "", [], ["Alameda", "Fresno"], ["Alameda", "Fresno"], True)],
        "table_name string, column_name string, schema_pos string, note string, format_tags array<string>, categorical_values array<string>, sample_values array<string>, holds_text boolean",
    )


def test_sql_ready_notes(spark):
    asked = spark.createDataFrame(
        [("a", "Schools in Alameda with students?"), ("b", "Is Fresnoville a county?"), ("c", "nothing here")], "question_id string, question string"
    )
    kept, counts = catalog.column_notes_sql_ready(asked, notes_fixture(spark))
    lines = {}
    for r in kept.collect():
        lines.setdefault(r["question_id"], []).append(r["line"])
    assert any("stored values matching the question: 'Alameda'" in line for line in lines["a"])
    assert any('"Enrollment (K-12)" in table frpm' in line for line in lines["a"])
    assert not any("matching the question" in line for line in lines["b"])
    assert "c" not in lines
    assert {r["question_id"]: r["truncated"] for r in counts.collect()} == {"a": 0, "b": 0}


def test_notes_respect_a_small_budget(spark):
    asked = spark.createDataFrame([("a", "County of Alameda")], "question_id string, question string")
    whole = catalog.column_notes(asked, notes_fixture(spark)).count()
    small = catalog.column_notes(asked, notes_fixture(spark), byte_budget=80).collect()
    assert whole == 3 and len(small) < 3 and all(r["bytes_used"] <= 80 for r in small)


def result(spark, rows, side=None):
    data = [("c", i, str(v), 1) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "case_id string, row_no long, row_key string, n_cols int")


@pytest.mark.parametrize("other, multiset, ordered, as_set", [([2, 1, 1], True, False, True), ([1, 2], False, False, True), ([1, 1, 2], True, True, True), ([3], False, False, False)])
def test_result_comparison(spark, other, multiset, ordered, as_set):
    cases = spark.createDataFrame([("c", False)], "case_id string, ordered boolean")
    row = results.equality(cases, result(spark, [1, 1, 2]), result(spark, other)).first()
    assert (row["multiset_equal"], row["ordered_equal"], row["set_equal"]) == (multiset, ordered, as_set)


def test_two_empty_results_are_equal(spark):
    cases = spark.createDataFrame([("c", True)], "case_id string, ordered boolean")
    row = results.equality(cases, result(spark, []), result(spark, [])).first()
    assert row["equal"] and row["set_equal"]


def test_voting(spark):
    rows = [("a", 1, "x", 0, 0.1, 5, "p"), ("a", 2, "x", 0, 0.2, 4, "q"), ("a", 3, "y", 0, 0.0, 1, "r"), ("b", 1, "x", 0, 0.1, 5, "p"), ("b", 2, "y", 0, 0.1, 4, "q")]
    df = spark.createDataFrame(rows, "case_id string, candidate_no int, result_hash string, diagnostics int, risk double, sql_length int, path string")
    got = {r["case_id"]: r for r in results.majority_vote(df).collect()}
    assert got["a"]["candidate_no"] == 1 and not got["a"]["needs_review"]
    assert got["b"]["candidate_no"] == 2 and got["b"]["needs_review"]


def test_evidence_metrics_numbers(spark):
    cases = spark.createDataFrame([("c", "all")], "case_id string, group string")
    facts = spark.createDataFrame([("c", 1, "schools", "school_type", "pri", None), ("c", 2, "schools", "school_type", "pub", None)],
                                  "case_id string, fact_no int, table_name string, column_name string, value string, transformation string")
    gold = spark.createDataFrame([("c", "schools", "school_type", "pri")], "case_id string, table_name string, column_name string, value string")
    row = metrics.evidence_metrics(cases, facts, gold).first()
    assert (row["literal_recall"], row["evidence_precision"], row["value_column_accuracy"]) == (1.0, 0.5, 1.0)
    gap = spark.range(1).select(metrics.gap_recovery(F.lit(0.3), F.lit(0.525), F.lit(0.435)).alias("g")).first()["g"]
    assert abs(gap - 0.6) < 1e-9


def test_utilization_labels(spark):
    effects = spark.createDataFrame(
        [("used", "reference", "predicate", "s", "kind", "eq", "pri"), ("used", "prediction", "predicate", "s", "kind", "eq", "pri"),
         ("absent", "reference", "predicate", "s", "kind", "eq", "pri"), ("contra", "reference", "predicate", "s", "kind", "eq", "pri"),
         ("contra", "prediction", "predicate", "s", "kind", "eq", "pub"), ("extra", "prediction", "predicate", "s", "state", "eq", "ca")],
        "case_id string, side string, kind string, table_name string, column_name string, operator string, value string",
    )
    facts = spark.createDataFrame(
        [(c, 1, "literal_value", "s", "state" if c == "extra" else "kind", "CA" if c == "extra" else "PRI", None, None) for c in ("used", "absent", "contra", "extra")],
        "case_id string, fact_no int, type string, table_name string, column_name string, db_value string, target_table string, target_column string",
    )
    used = structure.utilization(facts, effects)
    assert {r["case_id"]: r["label"] for r in used.collect()} == {
        "used": "correctly_used", "absent": "ignored", "contra": "contradicted", "extra": "unnecessarily_used"
    }
    rates = structure.utilization_rates(used.filter("case_id IN ('used', 'absent')")).first()
    assert rates["utilization_accuracy"] == 0.5 and rates["unnecessary_use_rate"] is None


def test_rule_calibration_keeps_precise_rules(spark):
    rows = [(i, rule, passed, correct) for rule, flags in (("projection_count", [False, False, True]), ("numeric_cleanup", [False, True, False]))
            for i, (passed, correct) in enumerate(zip(flags, [False, False, True]))]
    df = spark.createDataFrame(rows, "case_id int, rule string, passed boolean, correct boolean")
    allowed = {r["rule"]: r["allowed"] for r in metrics.rule_calibration(df, 0.9).collect()}
    assert allowed == {"projection_count": True, "numeric_cleanup": False}


def test_compact_schema_keeps_keys_and_fails_without_room(spark):
    tables = {"orders": spark.createDataFrame([], "id int, note string"), "items": spark.createDataFrame([], "order_id int, name string, filler string")}
    columns = catalog_columns(spark, tables, {"orders": "id"})
    fks = catalog_fks(spark, [("items", "order_id", "orders", "id")])
    asked = spark.createDataFrame([("q", "item name")], "question_id string, question string")
    everything = catalog.compact_schema(asked, columns, fks).collect()
    assert len(everything) == 5
    some = catalog.compact_schema(asked, columns, fks, byte_budget=190).collect()
    assert {r["column_name"] for r in some} >= {"id", "order_id", "name"} and len(some) < 5
    with pytest.raises(Exception, match="budget"):
        catalog.compact_schema(asked, columns, fks, byte_budget=60).collect()


def test_one_case_counts_for_those_like_it(spark):
    alike = spark.createDataFrame([("a", "all"), ("b", "all"), ("c", "all")], "case_id string, group string")
    said = "case_id string, fact_no int, table_name string, column_name string, value string, transformation string"
    given = [(c, 1, "schools", "school_type", "pri", None) for c in "abc"] + [("c", 2, "schools", "name", "pri", None)]
    wanted = [("a", "schools", "school_type", "pri"), ("b", "schools", "school_type", "pri"), ("c", "schools", "name", "pri")]
    facts, gold = spark.createDataFrame(given, said), spark.createDataFrame(wanted, "case_id string, table_name string, column_name string, value string")
    few = spark.createDataFrame([("a", "all", 2), ("c", "all", 1)], "case_id string, group string, weight long")
    rest = [df.filter("case_id <> 'b'") for df in (facts, gold)]
    assert [tuple(r) for r in metrics.evidence_metrics(few, *rest).collect()] == [tuple(r) for r in metrics.evidence_metrics(alike, facts, gold).collect()]
