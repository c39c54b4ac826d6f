"""Joins of many rows with few: no row of the many is sent to every task, whatever their file size says."""

import pytest
from pyspark.sql import functions as F

from groundscope import session
from groundscope.operators import catalog, evidence, joins, match, retrieve


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many(spark, tmp_path):
    """Equal questions: a file of a few KB that explodes into many words."""
    said = F.concat(F.lit("How many 'red ring' parts were ordered in the 1995 season with "), F.repeat(F.lit("word "), F.lit(50)))
    spark.range(20000).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("question_id"), said.alias("question")).write.parquet(str(tmp_path / "q"))
    return spark.read.parquet(str(tmp_path / "q"))


@pytest.fixture
def names(spark):
    return spark.createDataFrame(
        [("red ring", 1, "column", "part", "red ring", "part red ring", "small"), ("bolt", 2, "column", "part", "bolt", "part bolt", "small")],
        "doc_id string, position long, kind string, table_name string, column_name string, text string, description string",
    )


def test_the_few_are_sent_not_the_many(spark, many, names):
    # The few sides have no size that the planner knows, so a guess would send the questions.
    few = spark.createDataFrame(names.rdd, names.schema)
    for ranking, rows in ((retrieve.exact_ranking(many, few), 20000), (retrieve.lexical_ranking(many, few), 40000)):
        plan = _plan(ranking)
        assert "BuildRight" in plan and "BuildLeft" not in plan
        assert ranking.count() == rows


def test_two_sides_that_grow_are_exchanged(spark, many):
    joined = joins.join_many(many, many.withColumnRenamed("question", "again"), "question_id")
    assert "Broadcast" not in _plan(joined) and joined.count() == 20000


def test_too_many_rows_are_not_sent(spark, many, monkeypatch):
    monkeypatch.setattr(joins, "FEW_ROWS", 10)
    joined = joins.join_few(many, spark.range(20).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("question_id")), "question_id")
    assert "Broadcast" not in _plan(joined) and joined.count() == 20


def test_notes_do_not_send_the_questions(spark, many):
    notes = spark.createDataFrame(
        [("part", "p_name", 1, "name of parts", [], ["red ring"], True, ["red ring"])],
        "table_name string, column_name string, schema_pos int, note string, format_tags array<string>, sample_values array<string>, holds_text boolean, categorical_values array<string>",
    )
    kept = catalog.column_notes_sql_ready(many, spark.createDataFrame(notes.rdd, notes.schema))[0]
    assert "BuildLeft" not in _plan(kept) and kept.count() == 20000


def test_contained_texts_are_ranked_once_per_text(spark):
    counts = spark.createDataFrame(
        [("t", "c", "text", v, None, n) for v, n in (("Red ring", 3), ("red bolt", 3), ("infrared", 9), ("blue", 1))],
        "table_name string, column_name string, storage string, value string, number double, frequency long",
    )
    asked = spark.createDataFrame([("a", "red"), ("b", "RED"), ("b", "blue")], "question_id string, phrase string")
    found = match.probe_containing(asked, counts, 2)
    rows = sorted((r["question_id"], r["phrase"], r["rank"], r["value"], r["frequency"]) for r in found.collect())
    assert rows == [
        ("a", "red", 1, "infrared", 9), ("a", "red", 2, "Red ring", 3), ("b", "RED", 1, "infrared", 9), ("b", "RED", 2, "Red ring", 3), ("b", "blue", 1, "blue", 1),
    ]


def test_what_one_question_finds_is_given_to_all_like_it(spark):
    said = [("a", "red", 1), ("b", "red", 1), ("c", "red", 2), ("d", None, 1), ("e", None, 1), ("f", "none found", 1)]
    questions = spark.createDataFrame(said, "question_id string, question string, kind int")
    asked = joins.one_of_each(questions, ["question", "kind"])
    assert sorted(r["question_id"] for r in asked.collect()) == ["a", "c", "d", "f"]
    found = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("c", 1, "y"), ("d", 1, "z")], "question_id string, position int, fact string")
    given = joins.for_all(found, questions, asked, ["question", "kind"])
    assert given.columns == found.columns and "Broadcast" not in _plan(given)
    rows = sorted((tuple(r) for r in given.collect()), key=repr)
    assert rows == sorted([("a", 1, "x"), ("a", 2, None), ("b", 1, "x"), ("b", 2, None), ("c", 1, "y"), ("d", 1, "z"), ("e", 1, "z")], key=repr)


def test_written_rows_are_read_back(spark):
    rows = spark.createDataFrame([("a", 1, [1.5]), (None, None, None)], "x string, n long, v array<double>")
    assert sorted(map(repr, session.written(rows).collect())) == sorted(map(repr, rows.collect()))
    assert session.written(rows.limit(0)).count() == 0 and session.written(rows).schema == rows.schema


def test_facts_are_exchanged_once_to_be_packed(spark):
    kinds = {"confidence": "double", "column_relevance": "long"}
    facts = spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in evidence.FACT_COLUMNS))
    packed = evidence.assemble(facts, None, "literals")
    assert _plan(packed).count("Exchange hashpartitioning") == 1
