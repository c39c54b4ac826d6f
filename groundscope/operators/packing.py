"""Byte-budget packing (B1, B2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.operators.ranking import top_k


def greedy_pack(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    size: str,
    budget: int,
    limit: int | None = None,
    separator: int = 0,
    base: int = 0,
) -> DataFrame:
    """B1: scan each group in order and keep what still fits; a misfit is skipped, not a stop.

    The scan is sequential, so it is a fold over an array. The array is bounded without changing the
    result: if an item is kept, every earlier item of the same or smaller size was kept too, because it
    was offered when less was used. Hence an item with ``k`` earlier equals can only enter while
    ``k < limit`` and ``k * size`` fits, and all later ones of that size are dropped before the fold.
    Survivors per group depend on the budget alone, not on the data.
    """
    room = budget - base
    per_size = room // (1 + separator) + 1 if limit is None else limit
    columns = df.columns
    keyed = df.withColumns({f"_o{i}": c for i, c in enumerate(order)}).filter(F.col(size) <= room)
    keys = [f"_o{i}" for i in range(len(order))]
    costly = keyed if separator or limit is not None else keyed.filter(F.col(size) > 0)
    survivors = top_k(costly, [*group, size], [F.col(k) for k in keys], per_size, rank="_r").filter(
        (F.col("_r") - 1) * F.greatest(F.col(size) + separator, F.lit(1)) <= room
    )
    if costly is not keyed:  # rows without any cost always fit
        survivors = survivors.unionByName(keyed.filter(F.col(size) == 0).withColumn("_r", F.lit(1)))
    row = F.struct(*keys, F.struct(*[c for c in columns if c not in group]).alias("row"))
    item_type = f"array<{_row_type(df, [c for c in columns if c not in group])}>"

    def step(state: Column, item: Column) -> Column:
        cost = item["row"][size] + F.when(state["n"] > 0, separator).otherwise(0)
        fits = state["used"] + cost <= budget
        if limit is not None:
            fits = fits & (state["n"] < limit)
        grown = F.struct(
            (state["used"] + cost).cast("long").alias("used"),
            (state["n"] + 1).alias("n"),
            F.array_append(state["kept"], item["row"]).alias("kept"),
        )
        return F.when(fits, grown).otherwise(state)

    start = F.struct(
        F.lit(base).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast(item_type).alias("kept")
    )
    return (
        survivors.groupBy(*group)
        .agg(F.sort_array(F.collect_list(row)).alias("_items"))
        .withColumn("_state", F.aggregate("_items", start, step))
        .select(*group, F.col("_state.used").alias("bytes_used"), F.posexplode("_state.kept").alias("_p", "_row"))
        .select(*group, (F.col("_p") + 1).alias("position"), "bytes_used", "_row.*")
    )


def _row_type(df: DataFrame, columns: Sequence[str]) -> str:
    return df.select(*columns).schema.simpleString()


def prefix_pack(df: DataFrame, group: Sequence[str], order: Sequence[Column], size: str, budget: int, separator: int = 0) -> DataFrame:
    """B2: keep rows in order until the first one that overflows the budget.

    Rows with a cost are cut by the two-stage top-k before the running sum: sizes are whole numbers, so no
    more than budget / cost of them can fit. Rows without any cost (size 0, no separator) are kept up to the
    first overflowing row, however many they are.
    """
    keys = {f"_o{i}": c for i, c in enumerate(order)}
    keyed = df.withColumns(keys)
    by, place = [F.col(k) for k in keys], F.struct(*keys)
    costly = keyed if separator else keyed.filter(F.col(size) > 0)
    most = budget // max(1, separator) + 2
    first = top_k(costly, group, by, most, rank="_p")
    running = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)
    used = first.withColumn("_used", F.sum(F.col(size) + F.when(F.col("_p") > 1, separator).otherwise(0)).over(running))
    kept = used.filter(F.col("_used") <= budget).drop("_p", "_used")
    if costly is not keyed:
        stop = used.filter(F.col("_used") > budget).groupBy(*group).agg(F.min(place).alias("_stop"))
        free = keyed.filter(F.col(size) == 0).join(stop, list(group), "left").filter(F.col("_stop").isNull() | (place < F.col("_stop")))
        kept = kept.unionByName(free.drop("_stop"))
    ordered = W.partitionBy(*group).orderBy(*by)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    return kept.withColumn("position", F.row_number().over(ordered)).withColumn(
        "bytes_used", F.sum(F.col(size)).over(upto) + separator * (F.col("position") - 1)
    ).drop(*keys)
