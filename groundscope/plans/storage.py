"""Sink and source queries: what is written is read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from groundscope.plans.registry import query
from groundscope.sources import benchmark, runs
from groundscope.sources.store import KnowledgeStore
from groundscope.sources.tables import FOREIGN_KEYS, PRIMARY_KEYS, catalog_columns, catalog_fks, read_table


def _scratch(spark, name: str) -> str:
    """A fresh folder beside the checkpoints; a temporary one only for a local master."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    if shared is None:
        return tempfile.mkdtemp(prefix=f"groundscope-{name}-")
    return f"{shared.rstrip('/')}/{name}-{spark.range(1).select(F.uuid()).first()[0]}"


@query("knowledge_store", """SELECT table_name, count(*) AS "values", sum(frequency)::BIGINT AS covered FROM (
 SELECT 'part' AS table_name, p_type AS v, count(*) AS frequency FROM part GROUP BY 2 UNION ALL SELECT 'orders', o_orderpriority, count(*) FROM orders GROUP BY 2) GROUP BY table_name""")
def knowledge_store(spark, sf):
    """Build the store, hit it again, load it with its checks."""
    tables = {"part": read_table(spark, sf, "part").select("p_type"), "orders": read_table(spark, sf, "orders").select("o_orderpriority")}
    catalog, fks = catalog_columns(spark, tables, PRIMARY_KEYS), catalog_fks(spark, FOREIGN_KEYS)
    store = KnowledgeStore(spark, _scratch(spark, "store"))
    store.build(tables, catalog, fks)
    store.build(tables, catalog, fks)
    return store.load(tables, catalog)["values_index"].groupBy("table_name").agg(F.count("*").alias("values"), F.sum("frequency").alias("covered"))


@query("benchmark_cases", """SELECT 'd-' || doc_id AS case_id, source AS db_id, doc_id % 3 = 0 AS ordered, length(lang || ' question' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Benchmark evidence: about ' || lang ELSE '' END) AS input_length FROM documents""")
def benchmark_cases(spark, sf):
    """Benchmark records written as JSON lines and read back as cases."""
    doc = read_table(spark, sf, "documents")
    number = F.col("doc_id")
    records = doc.select(
        F.concat(F.lit("d-"), number.cast("string")).alias("question_id"), F.col("source").alias("db_id"), F.concat("lang", F.lit(" question")).alias("question"),
        F.when(number % 2 == 0, F.concat(F.lit("about "), "lang")).alias("evidence"),
        F.when(number % 3 == 0, F.lit("SELECT 1 ORDER BY 1")).alias("SQL"), F.lit("SELECT 2").alias("query"),
    )
    path = _scratch(spark, "records")
    benchmark.write_jsonl(records, path, "overwrite")
    cases = benchmark.load_benchmark(benchmark.read_records(spark, path, benchmark.RECORD, array=False), doc.select(F.col("source").alias("db_id")))
    return cases.select("case_id", "db_id", "ordered", F.length("input").alias("input_length"))


@query("run_scan", """SELECT count(*) AS predictions, count(DISTINCT doc_id) AS cases, 'r2' AS run_id FROM labels""")
def run_scan(spark, sf):
    """An interrupted run is resumed, captured and found through its report."""
    cases = read_table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("case_id"))
    path = _scratch(spark, "runs")

    def predictions(rows, run_id):
        return rows.select("case_id", F.lit("control").alias("mode"), F.lit(run_id).alias("run_id"), F.lit("completed").alias("status"))

    runs.append_predictions(predictions(cases.filter(F.length("case_id") < 3), "r1"), path)
    runs.append_predictions(predictions(cases.filter(F.length("case_id") < 3), "r2"), path)
    rest = runs.remaining_cases(cases, spark.read.parquet(path), "r2")
    runs.append_predictions(predictions(rest, "r2"), path)
    captured = spark.read.parquet(path)
    reports = captured.groupBy("mode", "run_id").agg(F.count("*").alias("captured")).withColumns({
        "created_at": F.col("run_id"), "capture_status": F.when(F.col("run_id") == "r2", "complete").otherwise("partial"),
    })
    found = runs.read_run(spark, path, reports, "control")
    return found.groupBy("run_id").agg(F.count("*").alias("predictions"), F.count_distinct("case_id").alias("cases"))
