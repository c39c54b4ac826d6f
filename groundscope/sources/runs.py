"""Immutable run captures: append, resume and scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def remaining_cases(cases: DataFrame, captured: DataFrame | None, run_id: str) -> DataFrame:
    """The cases of a run that have no captured prediction yet."""
    if captured is None:
        return cases
    done = captured.filter(F.col("run_id") == run_id).select("case_id").distinct()
    return cases.join(done, "case_id", "left_anti")


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Append captures; one directory per mode and run."""
    predictions.write.mode("append").partitionBy("mode", "run_id").parquet(path)


def latest_runs(reports: DataFrame) -> DataFrame:
    """The newest report of every mode; an incomplete one fails the job.

    ``reports``: mode, run_id, created_at, capture_status and measures.
    """
    rest = [c for c in reports.columns if c != "mode"]
    newest = reports.groupBy("mode").agg(F.max_by(F.struct(*rest), F.struct("created_at", "run_id")).alias("r")).select("mode", "r.*")
    complete = F.assert_true(F.col("capture_status") == "complete", F.concat(F.lit("incomplete run: "), F.col("run_id")))
    return newest.filter(complete.isNull())


def read_run(spark: SparkSession, path: str, reports: DataFrame, mode: str, run_id: str | None = None) -> DataFrame:
    """Predictions of one run, the newest one unless named; only its partition is read."""
    chosen = reports.filter(F.col("mode") == mode)
    if run_id is not None:
        chosen = chosen.filter(F.col("run_id") == run_id)
    pointer = latest_runs(chosen).first()
    if pointer is None:
        raise ValueError(f"no run of mode {mode}")
    return spark.read.parquet(path).filter((F.col("mode") == mode) & (F.col("run_id") == pointer["run_id"]))
