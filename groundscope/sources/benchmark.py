"""Reading benchmark cases, captures and column descriptions."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundscope.functions import text

RECORD = T.StructType([
    T.StructField(c, T.StringType()) for c in ("question_id", "db_id", "question", "evidence", "SQL", "query", "difficulty")
])
PREDICTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("sql", T.StringType()),
    T.StructField("latency_seconds", T.DoubleType()),
    T.StructField("attempts", T.ArrayType(T.StructType([
        T.StructField("attempt", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("category", T.StringType()),
    ]))),
])


def read_records(spark: SparkSession, path: str, schema: T.StructType, array: bool) -> DataFrame:
    """JSON lines, or one JSON array per file; blank lines carry no row."""
    reader = spark.read.schema(schema)
    return (reader.option("multiLine", True) if array else reader).json(path).filter(
        F.coalesce(*[F.col(f"`{f.name}`").cast("string") if not isinstance(f.dataType, T.ArrayType) else F.to_json(f.name) for f in schema.fields]).isNotNull()
    )


def load_benchmark(records: DataFrame, databases: DataFrame) -> DataFrame:
    """Cases from benchmark records; a record of an unknown database fails the job.

    The statement is ``SQL`` or else ``query``; evidence is appended behind the marker; a case is ordered
    when its statement contains "order by" anywhere.
    """
    known = databases.select("db_id").distinct().withColumn("_known", F.lit(True))
    statement = F.coalesce(F.nullif("SQL", F.lit("")), "query")
    evidence = F.when(F.length(F.coalesce("evidence", F.lit(""))) > 0, F.concat(F.lit(f"\n{text.EVIDENCE_MARKER} "), "evidence")).otherwise("")
    joined = records.join(known, "db_id", "left")
    checked = joined.filter(F.assert_true(F.col("_known").isNotNull(), F.concat(F.lit("missing benchmark database: "), F.col("db_id"))).isNull())
    return checked.select(
        F.col("question_id").alias("case_id"), F.concat("question", evidence).alias("input"), statement.alias("statement"),
        F.contains(F.lower(statement), F.lit("order by")).alias("ordered"), "db_id", F.coalesce("difficulty", F.lit("all")).alias("difficulty"),
    )


DESCRIPTION_FIELDS = ["original_column_name", "column_name", "column_description", "value_description"]


def _described(batches):
    """Rows of description files, by the header of each file."""
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            content = bytes(content)
            try:
                said = content.decode("utf-8-sig")
            except UnicodeDecodeError:
                said = content.decode("cp1252", "replace")
            for row in csv.DictReader(io.StringIO(said, newline="")):
                named = {(k or "").strip().lstrip("\ufeff").lower(): v for k, v in row.items() if k is not None}
                rows.append((path, *((named.get(c) or "").replace("\ufeff", "").strip() for c in DESCRIPTION_FIELDS)))
        yield pd.DataFrame(rows, columns=["path", *DESCRIPTION_FIELDS])


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Column-description CSV files; the file stem is the table, columns are found by header in lower case.

    Each file is read by its own header, so files may order their columns differently. A byte order mark is
    tolerated; a file that is not UTF-8 is read as cp1252. Short rows have empty fields, none is dropped but
    those without a column name. Files are small: one per table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path", "content")
    named = files.mapInPandas(_described, ", ".join(f"{c} string" for c in ["path", *DESCRIPTION_FIELDS]))
    name = F.coalesce(F.nullif("original_column_name", F.lit("")), F.nullif("column_name", F.lit("")))
    stem = F.regexp_extract("path", r"([^/\\]+)\.csv$", 1)
    return named.withColumn("_name", name).filter("_name IS NOT NULL").select(
        F.lower(stem).alias("table_name"), F.lower("_name").alias("column_name"), F.col("column_name").alias("display_name"),
        F.col("column_description").alias("description"), "value_description",
    )


def notes_of(descriptions: DataFrame) -> DataFrame:
    """S5, note form: description and value description on one line, cut to 160 characters."""
    joined = F.concat_ws(" ", F.nullif(text.squeeze("description"), F.lit("")), F.nullif(text.squeeze("value_description"), F.lit("")))
    return descriptions.select("table_name", "column_name", F.left(joined, F.lit(160)).alias("note")).filter(F.length("note") > 0)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S8."""
    df.write.mode(mode).json(path)
