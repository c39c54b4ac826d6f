"""Comparing stored query results and choosing between candidates.

A stored result is one row per result row: case_id, row_no, row_key (the encoded row) and n_cols.
Comparisons aggregate over (case, row) with map-side combine; rows are compared as encoded text, never
by hash alone, and no result is gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_DIGITS = 15


def encode_row(columns: Sequence[str], numeric: Sequence[str] = ()) -> Column:
    """A row as text: numbers compare across integer and real, nulls equal nulls, names are ignored."""
    cells = [
        F.coalesce(F.col(c).cast("double").cast("string") if c in numeric else F.to_json(F.struct(F.col(c).alias("v"))), F.lit("null"))
        for c in columns
    ]
    return F.concat_ws("\u001f", *cells)


def _both(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    columns = ["case_id", "row_no", "row_key", "n_cols"]
    return gold.select(*columns, F.lit(1).alias("side")).unionByName(predicted.select(*columns, F.lit(-1).alias("side")))


def _verdict(cases: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Cases with two empty results have no rows to disagree on."""
    return cases.select("case_id").join(found, "case_id", "left").select(
        "case_id", F.coalesce(name, F.lit(True)).alias(name)
    )


def multiset_equal(cases: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """V1: same column count and the same rows with the same multiplicity, in any order."""
    per_row = _both(gold, predicted).groupBy("case_id", "row_key").agg(
        F.sum("side").alias("balance"), F.min("n_cols").alias("low"), F.max("n_cols").alias("high")
    )
    found = per_row.groupBy("case_id").agg(
        ((F.max(F.abs("balance")) == 0) & (F.min("low") == F.max("high"))).alias("multiset_equal")
    )
    return _verdict(cases, found, "multiset_equal")


def ordered_equal(cases: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """V2: the same rows in the same places."""
    per_place = _both(gold, predicted).groupBy("case_id", "row_no").agg(
        ((F.sum("side") == 0) & (F.min("row_key") == F.max("row_key")) & (F.min("n_cols") == F.max("n_cols"))).alias("same")
    )
    return _verdict(cases, per_place.groupBy("case_id").agg(F.min("same").alias("ordered_equal")), "ordered_equal")


def set_equal(cases: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """V3: the same distinct rows; duplicates, order and column count do not matter."""
    per_row = _both(gold, predicted).groupBy("case_id", "row_key").agg(
        (F.min("side") != F.max("side")).alias("shared")
    )
    return _verdict(cases, per_row.groupBy("case_id").agg(F.min("shared").alias("set_equal")), "set_equal")


def equality(cases: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """V1 or V2 as the case demands, together with V3."""
    joined = (
        cases.join(multiset_equal(cases, gold, predicted), "case_id")
        .join(ordered_equal(cases, gold, predicted), "case_id")
        .join(set_equal(cases, gold, predicted), "case_id")
    )
    return joined.withColumn("equal", F.when(F.col("ordered"), F.col("ordered_equal")).otherwise(F.col("multiset_equal")))


def hash_sum(encoded: Column) -> Column:
    """Order-free fingerprint part of one row: 60 bits of its digest, summed exactly as a decimal."""
    return F.conv(F.left(F.md5(encoded), F.lit(HEX_DIGITS)), 16, 10).cast("decimal(38,0)")


def result_signals(rows: DataFrame, cells: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """V4: size, null share, duplicate rate, numeric range and two fingerprints per case.

    Both fingerprints are sums over rows, so they combine map-side; the ordered one digests the row
    number together with the row.
    """
    encoded = rows.withColumn("row_key", encode_row(cells, numeric))
    nulls = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in cells), F.lit(0))
    low = F.least(*[F.col(c).cast("double") for c in numeric]) if len(numeric) > 1 else F.col(numeric[0]).cast("double")
    high = F.greatest(*[F.col(c).cast("double") for c in numeric]) if len(numeric) > 1 else F.col(numeric[0]).cast("double")
    per_row = encoded.groupBy("case_id", "row_key").agg(
        F.count("*").alias("copies"), F.sum(nulls).alias("nulls"), F.min(low).alias("low"), F.max(high).alias("high"),
        F.sum(hash_sum(F.col("row_key"))).alias("free"),
        F.sum(hash_sum(F.concat(F.col("row_no").cast("string"), F.lit(":"), F.col("row_key")))).alias("placed"),
    )
    width = len(cells)
    return per_row.groupBy("case_id").agg(
        F.sum("copies").alias("row_count"), F.lit(width).alias("column_count"),
        (F.sum("nulls") / (F.sum("copies") * width)).alias("null_proportion"),
        (1 - F.count("*") / F.sum("copies")).alias("duplicate_rate"), F.min("low").alias("numeric_min"),
        F.max("high").alias("numeric_max"), F.sum("free").cast("string").alias("unordered_hash"),
        F.sum("placed").cast("string").alias("ordered_hash"),
    )


def sample_rows(rows: DataFrame, n: int = 3) -> DataFrame:
    """V4: the first rows of each result by row number."""
    return rows.filter(F.col("row_no") <= n)


def scorer_agreement(verdicts: DataFrame) -> DataFrame:
    """V5: share of comparable cases on which both comparisons agree; 0 without comparable cases."""
    return verdicts.agg(
        F.count("*").alias("comparable"),
        F.coalesce(F.avg((F.col("equal") == F.col("set_equal")).cast("int")), F.lit(0.0)).alias("agreement"),
    )


def majority_vote(candidates: DataFrame) -> DataFrame:
    """V6: largest group of equal results if it has two members, then the least suspicious candidate.

    Candidates carry case_id, candidate_no, result_hash, diagnostics, risk, sql_length and path. Equal
    results are reduced to one row per (case, hash) first. A tie between groups goes to the group seen
    first.
    """
    quality = F.struct("diagnostics", "risk", "sql_length", "path", "candidate_no")
    groups = candidates.groupBy("case_id", "result_hash").agg(
        F.count("*").alias("votes"), F.min("candidate_no").alias("first_no"), F.min(quality).alias("best")
    )
    return (
        groups.groupBy("case_id")
        .agg(
            F.count("*").alias("groups"),
            F.max(F.struct(F.col("votes"), (-F.col("first_no")).alias("early"), "best", "result_hash")).alias("largest"),
            F.min(F.struct("best", "result_hash")).alias("alone"),
        )
        .withColumn("majority", F.col("largest.votes") > 1)
        .select(
            "case_id",
            F.when(F.col("majority"), F.col("largest.best.candidate_no")).otherwise(F.col("alone.best.candidate_no")).alias("candidate_no"),
            F.when(F.col("majority"), F.col("largest.result_hash")).otherwise(F.col("alone.result_hash")).alias("selected_group"),
            F.when(F.col("majority"), "majority_result_then_intent_critic").otherwise("intent_critic_no_result_majority").alias("reason"),
            (
                (~F.col("majority") & (F.col("groups") > 1))
                | (F.when(F.col("majority"), F.col("largest.best.diagnostics")).otherwise(F.col("alone.best.diagnostics")) > 0)
            ).alias("needs_review"),
        )
    )


def best_candidate(candidates: DataFrame) -> DataFrame:
    """V7: executed, then passed, then fewest hard diagnostics, lowest risk, shortest; first one wins ties."""
    rank = F.struct(
        "executed", "passed", (-F.col("hard")).alias("hard"), (-F.col("risk")).alias("risk"),
        (-F.col("sql_length")).alias("length"), (-F.col("candidate_no")).alias("no"),
    )
    return candidates.groupBy("case_id").agg(F.max_by("candidate_no", rank).alias("candidate_no"))


def disagreement(candidates: DataFrame) -> DataFrame:
    """V8: do the executed candidates of a case return different results?"""
    executed = candidates.filter("executed").select("case_id", "result_hash").distinct()
    return executed.groupBy("case_id").agg((F.count("*") > 1).alias("disagreement"))


def oracle_gain(candidates: DataFrame) -> DataFrame:
    """V9: accuracy of the first candidate, of a perfect choice, and the gap."""
    per_case = candidates.groupBy("case_id").agg(
        F.min_by("correct", "candidate_no").alias("first"), F.bool_or("correct").alias("any")
    )
    return per_case.agg(
        F.count("*").alias("cases"), F.avg(F.col("first").cast("int")).alias("first_candidate_accuracy"),
        F.avg(F.col("any").cast("int")).alias("candidate_oracle"),
        (F.avg(F.col("any").cast("int")) - F.avg(F.col("first").cast("int"))).alias("oracle_gain"),
    )


def complementarity(candidates: DataFrame) -> DataFrame:
    """Correct cases per path, in their union, and in none."""
    solved = candidates.groupBy("case_id", "path").agg(F.bool_or("correct").alias("ok"))
    per_path = solved.groupBy("path").agg(F.count_if("ok").alias("cases"))
    per_case = solved.groupBy("case_id").agg(F.bool_or("ok").alias("ok"))
    union = per_case.agg(F.count_if("ok").alias("cases")).select(F.lit("union").alias("path"), "cases")
    none = per_case.agg(F.count_if(~F.col("ok")).alias("cases")).select(F.lit("none").alias("path"), "cases")
    return per_path.unionByName(union).unionByName(none)
