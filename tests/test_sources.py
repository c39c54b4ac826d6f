"""Readers, store checks and incremental capture."""

import json

import pytest
from pyspark.sql import functions as F

from groundscope.sources import benchmark, runs
from groundscope.sources.store import KnowledgeStore, StoreError, read_vectors, write_once, write_vectors
from groundscope.sources.tables import catalog_columns, catalog_fks
from groundscope.streaming.capture import capture


def test_benchmark_array_and_lines(spark, tmp_path):
    rows = [{"question_id": "1", "db_id": "d", "question": "q", "evidence": "e", "SQL": "select a ORDER BY a"}, {"question_id": "2", "db_id": "d", "question": "q2", "query": "select 1"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    known = spark.createDataFrame([("d",)], "db_id string")
    for name, array in (("a.json", True), ("b.jsonl", False)):
        cases = benchmark.load_benchmark(benchmark.read_records(spark, str(tmp_path / name), benchmark.RECORD, array), known).orderBy("case_id").collect()
        assert [(c["input"], c["statement"], c["ordered"]) for c in cases] == [("q\nBenchmark evidence: e", "select a ORDER BY a", True), ("q2", "select 1", False)]
    with pytest.raises(Exception, match="missing benchmark database"):
        benchmark.load_benchmark(benchmark.read_records(spark, str(tmp_path / "a.json"), benchmark.RECORD, True), known.limit(0)).collect()


def test_descriptions(spark, tmp_path):
    head = "original_column_name,column_name,column_description,data_format,value_description\n"
    (tmp_path / "Schools.csv").write_text("﻿" + head + 'School_Type,type,"kind, of school",text,"PRI means private\nPUB means public"\n,,,,\n', encoding="utf-8")
    rows = benchmark.read_descriptions(spark, str(tmp_path)).collect()
    assert [(r["table_name"], r["column_name"], r["description"]) for r in rows] == [("schools", "school_type", "kind, of school")]
    note = benchmark.notes_of(benchmark.read_descriptions(spark, str(tmp_path))).first()["note"]
    assert note == "kind, of school PRI means private PUB means public"


def test_store_hit_load_and_change(spark, tmp_path):
    tables = {"t": spark.createDataFrame([(1, "A"), (2, "B")], "id int, v string")}
    catalog, fks = catalog_columns(spark, tables, {"t": "id"}), catalog_fks(spark, [("t", "id", "u", "id")])
    store = KnowledgeStore(spark, str(tmp_path / "store"))
    with pytest.raises(StoreError):
        store.load(tables, catalog)
    identity = store.build(tables, catalog, fks)
    assert store.build(tables, catalog, fks) == identity
    loaded = store.load(tables, catalog)
    assert loaded["values_index"].count() == 4 and loaded["relationships"].count() == 1
    with pytest.raises(StoreError):
        store.load({"t": tables["t"].withColumn("v", F.lit("C"))}, catalog)
    spark.createDataFrame([("x", "y", "z", "w")], loaded["relationships"].schema).write.mode("append").parquet(store.path(identity, "relationships"))
    with pytest.raises(StoreError, match="changed"):
        store.load(tables, catalog)


def test_write_once_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, v string")
    path = str(tmp_path / "once")
    assert write_once(df, path, "d") and not write_once(df, path, "d")
    with pytest.raises(StoreError):
        write_once(df.withColumn("v", F.lit("b")), path, "d")
    docs = spark.createDataFrame([("d1", "text")], "doc_id string, text string")
    write_vectors(docs.select("doc_id", F.array(F.lit(1.0)).alias("vector")), str(tmp_path / "vec"))
    assert read_vectors(docs, str(tmp_path / "vec")).count() == 1
    with pytest.raises(Exception, match="do not match"):
        read_vectors(docs.limit(0), str(tmp_path / "vec")).collect()


def test_incomplete_newest_run_is_refused(spark):
    reports = spark.createDataFrame([("m", "r1", 1, "complete"), ("m", "r2", 2, "partial")], "mode string, run_id string, created_at int, capture_status string")
    assert runs.latest_runs(reports.filter("run_id = 'r1'")).first()["run_id"] == "r1"
    with pytest.raises(Exception, match="incomplete run"):
        runs.latest_runs(reports).collect()


def test_capture_resumes(spark, tmp_path):
    arriving, captured, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"case_id": f"c{n}", "mode": "m", "run_id": "r", "status": "completed"}) + "\n")
        capture(spark, arriving, captured, state).awaitTermination()
    assert sorted(r["case_id"] for r in spark.read.parquet(captured).collect()) == ["c0", "c1"]


def test_descriptions_by_header_and_encoding(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes("﻿original_column_name,column_name,column_description,data_format,value_description\nKind,school kind,what,text,PRI means private\n".encode())
    (tmp_path / "two.csv").write_bytes("Value_Description,original_column_name,column_description\ncafé,Town,where\n".encode("cp1252"))
    rows = {r["table_name"]: r for r in benchmark.read_descriptions(spark, str(tmp_path)).collect()}
    assert (rows["one"]["column_name"], rows["one"]["display_name"], rows["one"]["description"]) == ("kind", "school kind", "what")
    assert (rows["two"]["column_name"], rows["two"]["description"], rows["two"]["value_description"]) == ("town", "where", "café")


def test_known_state_reads_no_row_and_a_changed_file_is_found(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a table {1}"
    spark.range(400).select(F.col("id"), (F.col("id") % 3).cast("string").alias("v")).repartition(4).write.parquet(str(folder))
    fks = spark.createDataFrame([], "db_id string, src_table string, src_column string, dst_table string, dst_column string")
    catalog = spark.createDataFrame([("main", "t", "v", 0, "string", True, False)], "db_id string, table_name string, column_name string, ordinal int, type string, nullable boolean, is_pk boolean")

    def tables():
        return {"t": spark.read.parquet(str(folder).replace("{", "\\{").replace("}", "\\}")).select("v")}

    store = KnowledgeStore(spark, str(tmp_path / "store"))
    identity = store.build(tables(), catalog, fks)
    with monkeypatch.context() as patch:
        patch.setattr(KnowledgeStore, "identity", lambda *a: pytest.fail("rows were read"))
        patch.setattr(KnowledgeStore, "_checks", lambda *a: pytest.fail("datasets were read"))
        assert store.build(tables(), catalog, fks) == identity
        assert store.load(tables(), catalog)["values_index"].count() == 3
    # The same rows in other files: another state, the same identity.
    part = sorted(folder.glob("part-*"))[0]
    part.rename(folder / "part-renamed.snappy.parquet")
    assert store.build(tables(), catalog, fks) == identity
    # One file with other rows.
    spark.createDataFrame([(1, "new")], "id long, v string").coalesce(1).write.mode("append").parquet(str(folder))
    other = store.build(tables(), catalog, fks)
    assert other != identity and store.load(tables(), catalog)["values_index"].filter("original = 'new'").count() == 1
    # Frames that do not tell their content are read.
    assert store.state({"t": spark.createDataFrame([("1",)], "v string")}, catalog) is None
    assert store.state({"t": tables()["t"].withColumn("r", F.rand())}, catalog) is None
