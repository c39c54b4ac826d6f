"""Reading the analysed tables and describing them as a catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_COLUMNS = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("is_pk", T.BooleanType()),
])
CATALOG_FKS = T.StructType([
    T.StructField(c, T.StringType()) for c in ("db_id", "src_table", "src_column", "dst_table", "dst_column")
])

PRIMARY_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey",
}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One read-only table; projections and filters of the caller reach the parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def register_views(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Temporary views, so that admitted SELECT statements run as they are."""
    for name in names:
        read_table(spark, folder, name).createOrReplaceTempView(name)


def catalog_columns(
    spark: SparkSession, tables: dict[str, DataFrame], primary_keys: dict[str, str], db_id: str = "main"
) -> DataFrame:
    """One row per column, from table metadata alone (no data is read)."""
    rows = [
        (db_id, table, field.name, i, field.dataType.simpleString(), field.nullable, primary_keys.get(table) == field.name)
        for table, df in tables.items()
        for i, field in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG_COLUMNS).coalesce(1)


def catalog_fks(
    spark: SparkSession, edges: Iterable[tuple[str, str, str, str | None]], db_id: str = "main"
) -> DataFrame:
    """Declared foreign keys as an edge list; an implicit target column is null."""
    return spark.createDataFrame([(db_id, *edge) for edge in edges], CATALOG_FKS).coalesce(1)


def primary_key_of(catalog: DataFrame) -> DataFrame:
    """First primary-key column per table."""
    return (
        catalog.filter("is_pk").groupBy("db_id", "table_name").agg(F.min_by("column_name", "ordinal").alias("pk_column"))
    )
