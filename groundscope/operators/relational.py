"""Relational helpers around plain DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The result budget.
MAX_ROWS = 10_000
MAX_COLUMNS = 64
MAX_BYTES = 2 * 1024 * 1024


class BudgetError(ValueError):
    """A result is larger than its budget; it is refused, never truncated."""


def check_budget(df: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Q10: return ``df`` unchanged if it fits the budget, otherwise raise.

    The count stops after ``max_rows + 1`` rows, so checking an oversized result stays cheap.
    """
    if len(df.columns) > max_columns:
        raise BudgetError(f"result has more than {max_columns} columns")
    encoded = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(encoded + 1), F.lit(0)).alias("b")).first()
    if seen["n"] > max_rows:
        raise BudgetError(f"result has more than {max_rows} rows")
    if seen["b"] > max_bytes:
        raise BudgetError(f"result exceeds {max_bytes} bytes")
    return df


def bounded_cross(left: DataFrame, right: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """A product, admitted only when it fits the row budget."""
    n = left.limit(max_rows + 1).count()
    m = right.limit(max_rows + 1).count()
    if n * m > max_rows:
        raise BudgetError(f"product of {n} and {m} rows exceeds {max_rows}")
    return left.join(right)


def chain_join(tables: dict[str, DataFrame], path: Sequence[str], edges: Sequence[tuple[str, str, str, str]]) -> DataFrame | None:
    """Inner joins along a table path, each hop by its foreign key in either direction."""
    if not path:
        return None
    joined = tables[path[0]]
    for here, there in zip(path, path[1:]):
        hop = next(((s, sc, d, dc) for s, sc, d, dc in edges if (s, d) == (here, there) and dc), None)
        hop = hop or next(((s, sc, d, dc) for s, sc, d, dc in edges if (s, d) == (there, here) and dc), None)
        if hop is None:
            return None
        source, source_column, target, target_column = hop
        left, right = (source_column, target_column) if source == here else (target_column, source_column)
        joined = joined.join(tables[there], F.col(left) == F.col(right))
    return joined


def aligned(cases: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """One-to-one join of cases with outcomes; a missing or repeated id fails the job."""
    left = cases.withColumn("_in_cases", F.lit(1))
    right = outcomes.withColumn("_in_outcomes", F.lit(1))
    both = left.join(right, key, "full_outer")
    checked = F.assert_true(
        F.col("_in_cases").isNotNull() & F.col("_in_outcomes").isNotNull(), F.lit("case and outcome ids differ")
    )
    return both.filter(checked.isNull()).drop("_in_cases", "_in_outcomes")


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Fails the job when a key occurs twice; otherwise the distinct keys with a count of one."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"))
    return counted.filter(F.assert_true(F.col("n") == 1, F.lit("duplicate ids")).isNull())


def exclude(df: DataFrame, *exclusions: tuple[DataFrame, str]) -> DataFrame:
    """Anti-joins against several key lists in turn."""
    for keys, key in exclusions:
        df = df.join(keys.select(key).distinct(), key, "left_anti")
    return df


def restrict(df: DataFrame, allowed: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Keep allowed keys only; no list, or an empty one, means no restriction."""
    if allowed is None or allowed.isEmpty():
        return df
    return df.join(allowed.select(*keys).distinct(), list(keys), "left_semi")


def overlay(layers: Sequence[DataFrame], key: str) -> DataFrame:
    """Later layers replace earlier ones per id."""
    stacked = None
    for priority, layer in enumerate(layers):
        part = layer.withColumn("_priority", F.lit(priority))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    rest = [c for c in stacked.columns if c not in (key, "_priority")]
    newest = stacked.groupBy(key).agg(F.max_by(F.struct(*rest), "_priority").alias("v"))
    return newest.select(key, "v.*")


def first_occurrence(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The first row per key in input order, as an aggregate so that hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*position)).alias("v")).select(*keys, "v.*")


def counter(df: DataFrame, keys: Sequence[str], category: str, out: str = "counts") -> DataFrame:
    """A5: categories and their counts as one map per key."""
    counted = df.groupBy(*keys, category).agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, "n")))).alias(out)
    return counted.groupBy(*keys).agg(pairs)


def contains_all(actual: Column, required: Column) -> Column:
    """Required is a subset of actual; an empty requirement always holds."""
    return F.size(F.array_except(required, actual)) == 0


def changed_fields(left: str, right: str, fields: Sequence[str]) -> Column:
    """Names of the struct fields in which two records differ, nulls equal to nulls."""
    return F.array_compact(
        F.array(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields])
    )
