"""Bootstrap intervals, gates and winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundscope.operators.ranking import hash_rank, value_at_rank


#: Groups of a resample that are sent to every task, some ten MB.
SENT_GROUPS = 500_000


def _draw(seed: int, *parts: Column) -> Column:
    """A reproducible draw: 32 bits of a digest of the seed and the position."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("long")


def _interval(resampled: DataFrame, point: DataFrame, samples: int) -> DataFrame:
    """Bounds at fixed sorted positions of the at most ``samples`` resampled values."""
    bounds = resampled.agg(F.sort_array(F.collect_list("value")).alias("v")).select(
        F.col("v")[int(0.025 * samples)].alias("low"), F.col("v")[int(0.975 * samples)].alias("high")
    )
    return point.withColumn("_one", F.lit(1)).join(bounds.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumn(
        "samples", F.lit(samples)
    )


def group_bootstrap(
    scored: DataFrame, group: str, left: str, right: str, samples: int = 2000, seed: int = 20260911
) -> DataFrame:
    """Paired difference resampled over whole groups.

    Groups are reduced to (sum of differences, size) before any draw, so the work is samples x groups
    however many cases a group holds. The draws are numbered rows dealt over all tasks, no row holds a list of
    them; up to ``SENT_GROUPS`` groups are sent to every task, so only sums per resample are exchanged.
    """
    spark = scored.sparkSession
    difference = F.col(right).cast("double") - F.col(left).cast("double")
    groups = scored.groupBy(group).agg(F.sum(difference).alias("d"), F.count("*").alias("n"))
    numbered = hash_rank(groups.withColumn("_h", F.md5(F.col(group).cast("string"))), [], "_h", "no", [group]).select(
        (F.col("no") - 1).alias("pick"), "d", "n"
    )
    total = groups.count()
    draws = spark.range(samples * total).select(
        F.expr(f"id div {max(1, total)}").alias("b"), F.pmod(_draw(seed, F.expr(f"id div {max(1, total)}"), F.col("id") % max(1, total)), F.lit(max(1, total))).alias("pick")
    )
    numbered = F.broadcast(numbered) if total <= SENT_GROUPS else numbered
    resampled = draws.join(numbered, "pick").groupBy("b").agg((F.sum("d") / F.sum("n")).alias("value"))
    point = groups.agg((F.sum("d") / F.sum("n")).alias("delta"), F.count("*").alias("groups"))
    return _interval(resampled, point, samples)


def case_bootstrap(scored: DataFrame, case: str, outcome: Column, samples: int = 300, seed: int = 20260911) -> DataFrame:
    """Percentile interval of a mean of small-domain outcomes (correct, or a paired -1/0/1).

    Cases with equal outcomes are interchangeable, so a draw only has to pick an outcome by its share.
    Every case contributes one draw per resample; draws are summed map-side and never shuffled.
    """
    outcomes = scored.select(F.col(case).alias("case"), outcome.cast("double").alias("x"))
    shares = outcomes.groupBy("x").agg(F.count("*").alias("n"))
    table = shares.agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("t")).select(
        F.aggregate(
            "t",
            F.array().cast("array<struct<x:double,upto:bigint>>"),
            lambda acc, s: F.array_append(
                acc,
                F.struct(
                    s["x"].alias("x"),
                    (F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["upto"]).otherwise(F.lit(0)) + s["n"]).alias("upto"),
                ),
            ),
        ).alias("t")
    )
    drawn = (
        outcomes.select("case", table.scalar().alias("t"))
        .select("case", "t", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))
        .withColumn("u", F.pmod(_draw(seed, F.col("b"), F.col("case")), F.try_element_at("t", F.lit(-1))["upto"]))
        .select("b", F.filter("t", lambda s: s["upto"] > F.col("u"))[0]["x"].alias("x"))
    )
    resampled = drawn.groupBy("b").agg(F.avg("x").alias("value"))
    point = outcomes.agg(F.avg("x").alias("delta"), F.count("*").alias("cases"))
    return _interval(resampled, point, samples)


def p95_nearest(df: DataFrame, keys: Sequence[str], value: str, out: str = "p95_nearest") -> DataFrame:
    """Nearest rank, the value at position ceil(0.95 n)."""
    return value_at_rank(df, keys, value, lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(0.95))), out)


def p95_index(df: DataFrame, keys: Sequence[str], value: str, out: str = "p95_index") -> DataFrame:
    """Zero-based index int(0.95 n), capped at the last value."""
    return value_at_rank(df, keys, value, lambda n: F.least(n, F.floor(n * F.lit(0.95)) + 1), out)


def gate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The names of the failed rules and whether none failed; a null condition counts as failed."""
    failed = F.array_compact(
        F.array(*[F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)) for name, passed in rules.items()])
    )
    return df.withColumn("failed_rules", failed).withColumn("passed", F.size("failed_rules") == 0)


def winner(df: DataFrame, name: str, eligible: Column, order: Sequence[Column]) -> DataFrame:
    """The best eligible row by a tuple of measures; null when none is eligible."""
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.agg(
        F.max_by(F.when(eligible, F.col(name)), F.when(eligible, ranked)).alias("winner"), F.count_if(eligible).alias("eligible")
    )


def comparable(runs: DataFrame, same: Sequence[str], finite: Sequence[str]) -> DataFrame:
    """Do all runs share these identities, and are their measures finite?"""
    checks = [(F.count_distinct(c) == 1).alias(f"same_{c}") for c in same]
    checks += [
        F.bool_and(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))).alias(f"finite_{c}") for c in finite
    ]
    flags = runs.agg(*checks)
    every = None
    for c in flags.columns:
        every = F.col(c) if every is None else every & F.col(c)
    return flags.withColumn("comparable", every)


def assert_recorded(df: DataFrame, recorded: str, recomputed: str, tolerance: float = 1e-9) -> DataFrame:
    """Fails the job when a recorded aggregate differs from the recomputed one."""
    close = F.abs(F.col(recorded) - F.col(recomputed)) <= tolerance
    return df.filter(F.assert_true(close, F.lit("recorded aggregate disagrees with case scores")).isNull())
