"""Ranking that never sends a whole hot group to one task.

Plain ``row_number() over (partition by key)`` sorts each group in a single task. The helpers here
give the same numbers from bounded pieces: a two-stage top-k, an exact value at a rank found through
a monotone histogram, and a full row number for hash-ordered rows found through hash-prefix buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.session import cut_lineage


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", spread: int = 32
) -> DataFrame:
    """O2: first ``k`` rows per key under a total order.

    Stage one ranks inside (key, salt) and keeps k rows of each salt; stage two ranks the at most
    ``k * spread`` survivors. The literal bound lets Spark drop rows map-side before each exchange.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(spread)))
    inner = W.partitionBy(*keys, "_salt").orderBy(*order)
    outer = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_inner", F.row_number().over(inner))
        .filter(F.col("_inner") <= k)
        .drop("_inner", "_salt")
        .withColumn(rank, F.row_number().over(outer))
        .filter(F.col(rank) <= k)
    )


def _bucket(value: Column) -> Column:
    """A monotone map of doubles onto at most a few tens of thousands of buckets."""
    return F.floor(F.signum(value) * F.log2(F.abs(value) + 1.0) * 256.0).cast("long")


#: Rows of a bucket that one task may order, and pieces that a larger bucket is opened into.
TASK_ROWS, PIECES = 1_000_000, 1024


def value_at_rank(df: DataFrame, keys: Sequence[str], value: str, rank_of, out: str, most: int = TASK_ROWS) -> DataFrame:
    """The exact value at a one-based rank per key; ``rank_of`` maps the group size to the rank.

    A histogram over monotone buckets is combined map-side and locates the one bucket that holds the
    rank. While such a bucket has more than ``most`` rows, it is opened into ``PIECES`` of equal width between its
    least and greatest value, and the piece that holds the rank takes its place; a bucket of equal doubles is
    never larger for the last step, which counts distinct values. So no task orders an unbounded bucket, and the
    rounds follow the digits of the values, not the rows. The value keeps its type; buckets are found by its double.
    """
    number = F.col(value).cast("double")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), number.alias("_d"))
    state = _holding(rows.select(*keys, "_d", _bucket(F.col("_d")).alias("_b")), keys, rank_of(F.sum("_n").over(W.partitionBy(*keys))))
    state = cut_lineage(state)
    while not state.filter((F.col("_size") > most) & (F.col("_low") < F.col("_high"))).isEmpty():
        wide = state.filter((F.col("_size") > most) & (F.col("_low") < F.col("_high")))
        share = (F.col("_d") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        piece = F.least(F.floor(share * PIECES), F.lit(PIECES - 1)).cast("long")
        inside = _within(rows, wide, keys).select(*keys, "_need", "_d", piece.alias("_b"))
        state = cut_lineage(
            _holding(inside, keys, F.col("_need"), ["_need"]).unionByName(state.filter((F.col("_size") <= most) | (F.col("_low") >= F.col("_high"))))
        )
    counted = _within(rows, state, keys).groupBy(*keys, "_need", "_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_v"))
    return counted.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_need")).groupBy(*keys).agg(F.min("_v").alias(out))


def _within(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows between the ends of the bucket of their key. Null keys are a key."""
    ends = state.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_low", "_high", "_need")
    # Without keys there is one bucket, so one row.
    ends, same = ends if keys else F.broadcast(ends), F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(ends, same & F.col("_d").between(F.col("_low"), F.col("_high"))).drop(*[f"_k{i}" for i in range(len(keys))])


def _holding(rows: DataFrame, keys: Sequence[str], rank: Column, carried: Sequence[str] = ()) -> DataFrame:
    """Per key the bucket that holds the rank: its ends, its rows and the rank inside it."""
    histogram = rows.groupBy(*keys, *carried, "_b").agg(F.count("*").alias("_n"), F.min("_d").alias("_low"), F.max("_d").alias("_high"))
    running = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    located = histogram.withColumns({"_upto": F.sum("_n").over(running), "_rank": rank})
    before = F.col("_upto") - F.col("_n")
    return located.filter((F.col("_upto") >= F.col("_rank")) & (before < F.col("_rank"))).select(
        *keys, "_low", "_high", F.col("_n").alias("_size"), (F.col("_rank") - before).cast("long").alias("_need")
    )


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Row numbers from 0 in a total order, without one task that sees all rows.

    The rows are sorted by ranges and written; a row's number is its place in its range plus the rows of the
    ranges before it.
    """
    ranges = cut_lineage(df.orderBy(*order))
    placed = ranges.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    counts, offsets, total = dict(placed.groupBy("_p").count().collect()), [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(F.lit(total))
        total += counts.get(p, 0)
    offset = F.get(F.array(*offsets), F.col("_p")) if offsets else F.lit(0)
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return placed.withColumn(out, (offset + local).cast("long")).drop("_p", "_m")


def first_by_hash(df: DataFrame, keys: Sequence[str], hashed: str, ties: Sequence[str], quota: str, out: str, digits: int = 3) -> DataFrame:
    """The first rows per key in the order of a hex hash, as many as their column ``quota`` says, with their number.

    Hash prefixes split every group evenly, so counts per prefix tell which prefixes hold these rows; only their
    rows are moved, and each is ordered with the rows of its own prefix only.
    """
    rows = df.withColumn("_prefix", F.left(F.col(hashed), F.lit(digits)))
    counts = rows.groupBy(*keys, quota, "_prefix").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    wanted = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_offset") < F.col(quota))
    local = W.partitionBy(*keys, "_prefix").orderBy(hashed, *ties)
    return (
        rows.join(wanted.select(*keys, "_prefix", "_offset"), [*keys, "_prefix"])
        .withColumn(out, F.col("_offset") + F.row_number().over(local))
        .filter(F.col(out) <= F.col(quota))
        .drop("_prefix", "_offset")
    )


def hash_rank(df: DataFrame, keys: Sequence[str], hashed: str, out: str, ties: Sequence[str], digits: int = 3) -> DataFrame:
    """Row number per key in the order of a hex hash, without one sort per key.

    Hash prefixes split every group evenly. A prefix's offset is the number of rows in smaller
    prefixes, so the number of a row is its place inside its prefix plus that offset.
    """
    rows = df.withColumn("_prefix", F.left(F.col(hashed), F.lit(digits)))
    counts = rows.groupBy(*keys, "_prefix").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_prefix").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = W.partitionBy(*keys, "_prefix").orderBy(hashed, *ties)
    return (
        rows.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_prefix"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_prefix", "_local", "_offset")
    )


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Running total per key in an order that ``bucket`` coarsens, without one sort per key.

    Each (key, bucket) is summed first; a bucket starts from the total of the earlier buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_t"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    local = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        rows.withColumn("_local", F.sum(value).over(local))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )
