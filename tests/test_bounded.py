"""The bounded packet on small tables: order, restriction, probes, modes, limits."""

import json

import pytest
from pyspark.sql import functions as F

from groundscope.operators import bounded, profile
from groundscope.session import cut_lineage
from groundscope.sources.tables import catalog_columns

FACTS = {}  # by question and selection: several tests pack the same facts
NAMES = [f"item{i:03d}" for i in range(200)]


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(i, name, "red" if i % 2 else "blue", "2020-01-02" if i else None) for i, name in enumerate(NAMES)]
    rows += [(200, "xy77z", "blue", None), (201, "ab77", "blue", None), (202, "ab77", "red", None)]
    goods = spark.createDataFrame(rows, "id int, name string, tint string, made string")
    shops = spark.createDataFrame([(1, "corner 77 shop"), (2, None)], "shop_id int, label string")
    tables = {"goods": goods, "shops": shops}
    columns = catalog_columns(spark, tables, {"goods": "id", "shops": "shop_id"})
    counts = profile.value_counts(tables)
    index = profile.value_index(profile.top_values(counts))
    return index, profile.column_profile(counts, columns), columns, counts


def packets(spark, parts, question, mode="generated", selected=None, paths=None, **limits):
    index, described, columns, counts = parts
    asked = spark.createDataFrame([("q", question)], "question_id string, question string")
    key = repr((question, selected, paths, limits.get("fact_limit")))
    chosen = selected and spark.createDataFrame([("q", *s) for s in selected], "question_id string, table_name string, column_name string")
    led = paths and spark.createDataFrame([("q", i, p) for i, p in enumerate(paths)], "question_id string, path_no int, tables array<string>")
    if key not in FACTS:
        FACTS[key] = bounded.gather(asked, index, described, columns, counts, led, chosen, fact_limit=limits.get("fact_limit", bounded.FACT_LIMIT))
    facts = FACTS[key]
    row = bounded.packet_texts(asked, bounded.pack(facts, mode, **limits), mode).first()
    assert row["n_bytes"] == len(row["text"].encode()) and row["n_facts"] == len(json.loads(row["text"]))
    return json.loads(row["text"]), row


def test_values_paths_and_columns_in_order(spark, parts):
    facts, _ = packets(spark, parts, "how many red goods by tint", paths=[["goods", "shops"]] * 6)
    kinds = [f["kind"] for f in facts]
    assert kinds == sorted(kinds, key=bounded.PRIORITY.get) and kinds.count("join_path") == 4
    red = next(f for f in facts if f["kind"] == "value")
    assert (red["printed_value"], red["matched_phrase"], red["frequency"], red["pattern"]) == ("red", "red", 101, None)
    tint = next(f for f in facts if f["kind"] == "column" and f["column"] == "tint")
    assert tint["types"] == {"text": 203} and "tint" in tint["matched_terms"]


def test_a_stored_date_is_told(spark, parts):
    facts, _ = packets(spark, parts, "made on '2020-01-02'")
    assert [f["date_value"] for f in facts if f["reason"] == "exact_or_normalized_value"] == ["2020-01-02"]


def test_phrases_without_a_match_are_probed_in_order(spark, parts):
    """77 is in no indexed value as a whole: the name column answers first, the shop label is not asked any more."""
    facts, _ = packets(spark, parts, "77", selected=[("goods", "name"), ("shops", "label")])
    probed = [f for f in facts if f.get("reason") == "bounded_read_only_probe"]
    assert [(f["column"], f["printed_value"], f["frequency"]) for f in probed] == [("name", "ab77", 2), ("name", "item077", 1), ("name", "item177", 1), ("name", "xy77z", 1)]
    facts, _ = packets(spark, parts, "77", selected=[("goods", "tint"), ("shops", "label")])
    assert [f["printed_value"] for f in facts] == ["corner 77 shop"]


def test_four_probes_at_most(spark, parts):
    """Two phrases of two columns each use up the probes, so the third phrase is not asked."""
    facts, _ = packets(spark, parts, "88888 99999 77", selected=[("goods", "name"), ("goods", "tint")])
    assert not [f for f in facts if f["kind"] == "value"]
    facts, _ = packets(spark, parts, "88888 77", selected=[("goods", "name"), ("goods", "tint")])
    assert len([f for f in facts if f["kind"] == "value"]) == 4


def test_no_probe_once_the_facts_are_enough(spark, parts):
    facts, _ = packets(spark, parts, "red 77", selected=[("goods", "name"), ("goods", "tint")], fact_limit=1)
    assert [f["printed_value"] for f in facts] == ["red"]


def test_modes(spark, parts):
    question = "red goods\nBenchmark evidence: " + "tint says it; " * 200
    none, row = packets(spark, parts, question, "none")
    assert none == [] and row["text"] == "[]" and row["n_bytes"] == 2
    oracle, told = packets(spark, parts, question, "oracle")
    generated, _ = packets(spark, parts, question, "generated")
    assert oracle[0]["kind"] == "oracle_benchmark_evidence" and len(oracle[0]["text"]) == 1200 and oracle[1:] == generated[: len(oracle) - 1]
    assert told["identity"] != row["identity"]
    with pytest.raises(ValueError):
        packets(spark, parts, question, "other")


def test_bytes_and_facts_are_bounded(spark, parts):
    facts, row = packets(spark, parts, "red goods by tint and name", byte_budget=400)
    assert row["n_bytes"] <= 400 and facts
    facts, _ = packets(spark, parts, "red goods by tint and name", fact_limit=2)
    assert len(facts) == 2


def test_empty_tables(spark, parts):
    index, described, columns, counts = parts
    nobody = spark.createDataFrame([], "question_id string, question string")
    assert bounded.gather(nobody, index, described, columns, counts).count() == 0
    asked = spark.createDataFrame([("q", None), ("r", "")], "question_id string, question string")
    facts = bounded.gather(asked, index.limit(0), described.limit(0), columns.limit(0), counts.limit(0))
    assert [tuple(r) for r in bounded.packet_texts(asked, bounded.pack(facts), "generated").select("text", F.col("n_facts")).collect()] == [("[]", 0)] * 2


def test_modes_are_packed_together(spark, parts):
    index, described, columns, counts = parts
    asked = spark.createDataFrame([("a", "Find item007 with red tint\nBenchmark evidence: tint is made"), ("b", "item"), ("c", None)], "question_id string, question string")
    facts = cut_lineage(bounded.gather(asked, index, described, columns, counts))
    together = bounded.packets(asked, facts)
    assert together._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # facts and questions, each once
    alone = [tuple(r) for mode in bounded.MODES for r in bounded.packet_texts(asked, bounded.pack(facts, mode), mode).collect()]
    assert sorted(map(tuple, together.collect())) == sorted(alone) and len(alone) == 9
