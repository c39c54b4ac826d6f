"""S13 as a stream: predictions that arrive as JSON lines are captured once, with resume.

The query reads new files only and commits with its own checkpoint, so a restarted capture continues
where it stopped. It processes what has arrived and ends.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

ARRIVING = T.StructType([
    T.StructField("case_id", T.StringType()), T.StructField("mode", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("sql", T.StringType()), T.StructField("latency_seconds", T.DoubleType()),
])


def capture(spark: SparkSession, arriving: str, captured: str, checkpoint: str) -> StreamingQuery:
    """Append the arrived predictions to the captured runs and return the started query."""
    rows = spark.readStream.schema(ARRIVING).json(arriving).filter(F.col("case_id").isNotNull())
    return (
        rows.writeStream.format("parquet").option("path", captured).option("checkpointLocation", checkpoint)
        .partitionBy("mode", "run_id").outputMode("append").trigger(availableNow=True).start()
    )
