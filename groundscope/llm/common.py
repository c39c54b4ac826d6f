"""Small helpers of the training-data operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundscope.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, mod 3; -1 for a null id, which is never learned from and never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(-1))


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == 1


def learnable(doc_id: Column) -> Column:
    return remainder(doc_id).isin(0, 2)


def shelve(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet in the shared checkpoint folder and read it back: lineage ends there.

    The folder is the one of ``spark.checkpoint.dir``; a session without it gets the one that
    ``cut_lineage`` sets (local masters only).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    path = f"{context.getCheckpointDir()}/shelf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def balanced_sample(rows: DataFrame, label: str, bound: int, key: str = "doc_id") -> DataFrame:
    """About ``bound`` rows of each label value, chosen by a digest of the key.

    The share of each value follows from its count over all rows, so no value is ordered or gathered.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.limit(0)
    steps = 1_000_000
    limit = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(steps * min(1.0, bound / n))))])
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(steps)) < limit[F.col(label)])


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about ``limit`` bytes together, one row at least."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(sizes[at:])
            n = max(1, int(np.searchsorted(total, limit, side="right")))
            part = batch.slice(at, n)
            yield part, [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
            at += n


def stable(text: str, size: int = 8) -> int:
    """A digest of a string that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest(), "little")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
