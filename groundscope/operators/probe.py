"""Verifying facts against the data (X1-X5), all facts of all questions in one pass over value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.operators.joins import join_few, join_many
from groundscope.operators.profile import KEY

PROBE_LIMIT = 4


def value_existence(facts: DataFrame, counts: DataFrame) -> DataFrame:
    """Matching rows per (table, column, value); zero when the value is absent."""
    stored = counts.filter("value IS NOT NULL").select(*KEY, F.col("value").alias("db_value"), F.col("frequency").alias("match_count"))
    asked = facts.filter("db_value IS NOT NULL AND column_name IS NOT NULL").select(*KEY, "db_value").distinct()
    found = join_many(asked, stored, [*KEY, "db_value"], "left").fillna(0, ["match_count"])
    return found.withColumn("verified", F.col("match_count") > 0)


def numeric_storage(counts: DataFrame) -> DataFrame:
    """Per column, how many values are native numbers or parse as numbers, and their range.

    ``forced_min``/``forced_max`` follow the cast that turns text without a number into zero.
    """
    present = counts.filter("value IS NOT NULL")
    number = F.col("value").try_cast("double")
    forced = F.coalesce(F.nullif(F.regexp_extract("value", r"^\s*([+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return present.groupBy(*KEY).agg(
        F.sum("frequency").alias("non_null_count"),
        F.sum(F.when(F.col("storage").isin("integer", "real"), F.col("frequency")).otherwise(0)).alias("native_numeric_count"),
        F.sum(F.when(number.isNotNull(), F.col("frequency")).otherwise(0)).alias("parsed_count"),
        F.min(number).alias("numeric_min"), F.max(number).alias("numeric_max"), F.min(forced).alias("forced_min"), F.max(forced).alias("forced_max"),
    )


def join_cardinality(fks: DataFrame, counts: DataFrame) -> DataFrame:
    """Joined rows per foreign key, from key counts of both ends; no row-level join is formed.

    The counts of both ends meet in one aggregate by key and value. Its rows are dealt over all shuffle partitions, as small
    ones would be merged until one task holds a whole column.
    """
    edge = ["src_table", "src_column", "dst_table", "dst_column"]
    numbered = fks.select(*edge).distinct().withColumn("edge", F.row_number().over(W.orderBy(*edge)))
    ends = [
        numbered.select("edge", F.col(f"{side}_table").alias("table_name"), F.col(f"{side}_column").alias("column_name"), F.lit(side == "src").alias("from"))
        for side in ("src", "dst")
    ]
    present = counts.filter("value IS NOT NULL").select(*KEY, "value", "frequency")
    rows = present.join(F.broadcast(ends[0].unionByName(ends[1])), KEY).select("edge", "value", "from", "frequency")
    dealt = rows.repartition(int(fks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "edge", "value")
    n, m = F.sum(F.when(F.col("from"), F.col("frequency"))), F.sum(F.when(~F.col("from"), F.col("frequency")))
    met = dealt.groupBy("edge", "value").agg(n.alias("n"), m.alias("m"))
    joined = numbered.join(met.groupBy("edge").agg(F.sum(F.col("n") * F.col("m")).alias("joined_row_count")), "edge").select(*edge, "joined_row_count")
    return fks.select(*edge).join(joined, edge, "left").fillna(0, ["joined_row_count"])


def verify(scoped: DataFrame, counts: DataFrame, fks: DataFrame) -> DataFrame:
    """The first four probeable facts of a packet get an observation; only those can be verified."""
    kind = (
        F.when(F.col("db_value").isNotNull() & F.col("column_name").isNotNull(), "value_existence")
        .when((F.col("type") == "numeric_or_storage") & F.col("column_name").isNotNull(), "numeric_storage")
        .when((F.col("type") == "join_relationship") & F.col("column_name").isNotNull(), "join_cardinality")
    )
    probed = scoped.withColumn("probe_kind", kind)
    order = W.partitionBy("question_id", F.col("probe_kind").isNotNull()).orderBy("fact_position")
    numbered = probed.withColumn("probe_no", F.when(F.col("probe_kind").isNotNull(), F.row_number().over(order)))
    numbered = numbered.withColumn("probe_kind", F.when(F.col("probe_no") <= PROBE_LIMIT, F.col("probe_kind")))
    values = value_existence(scoped, counts).drop("verified")
    numbers = numeric_storage(counts).select(*KEY, "non_null_count")
    joins = join_cardinality(fks, counts).select(
        F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name"), F.col("dst_table").alias("target_table"),
        F.col("dst_column").alias("target_column"), "joined_row_count",
    )
    joined = (
        join_few(join_few(join_many(numbered, values, [*KEY, "db_value"], "left"), numbers, KEY, "left"), joins, [*KEY, "target_table", "target_column"], "left")
    )
    observed = (
        F.when(F.col("probe_kind") == "value_existence", F.col("match_count")).when(F.col("probe_kind") == "numeric_storage", F.col("non_null_count"))
        .when(F.col("probe_kind") == "join_cardinality", F.col("joined_row_count"))
    )
    return joined.withColumn("observed", F.when(F.col("probe_kind").isNotNull(), F.coalesce(observed, F.lit(0)))).withColumn(
        "verified", F.coalesce(F.col("observed") > 0, F.lit(False))
    ).withColumn("probe_id", F.when(F.col("probe_kind").isNotNull(), F.concat(F.lit("P"), F.col("probe_no").cast("string")))).select(
        "question_id", "fact_position", "evidence_id", "type", *KEY, "db_value", "probe_id", "probe_kind", "observed", "verified"
    )
