"""Knowledge store: parquet datasets keyed by a content identity."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundscope.operators.integrity import fold_fingerprint, snapshot, table_fingerprint
from groundscope.operators.profile import column_profile, top_values, value_counts, value_index, value_terms
from groundscope.session import cut_lineage

VERSION = "groundscope-knowledge-1"
# Partitioning of each dataset: readers of one table or one term type prune the rest.
LAYOUT = {"columns": [], "values_index": ["table_name"], "value_terms": ["term_type"], "relationships": []}


class StoreError(RuntimeError):
    """A store is missing, belongs to other content, or was changed."""


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_once(df: DataFrame, path: str, name: str, partition_by: list[str] | None = None) -> bool:
    """Write a dataset unless it is there; existing equal content passes, other content is refused.

    Returns whether anything was written.
    """
    spark = df.sparkSession
    if _exists(spark, f"{path}/_SUCCESS"):
        stored = spark.read.parquet(path).select(*df.columns)
        ours, theirs = table_fingerprint(df, name).first(), table_fingerprint(stored, name).first()
        if ours["fingerprint"] != theirs["fingerprint"]:
            raise StoreError(f"{path} already holds different content")
        return False
    writer = df.write.mode("overwrite" if _exists(spark, path) else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return True


def file_state(spark: SparkSession, files: list[str]) -> str:
    """Digest of the paths, sizes and times of files; they are listed, not read."""
    if not files:
        return hashlib.sha256(b"").hexdigest()
    # Listed by Spark, so any store that it reads will do; escaped, as a path may hold the signs of a pattern.
    escaped = [re.sub(r"([\\[\]{}*?\\\\])", r"\\\1", unquote(f)) for f in files]
    listed = spark.read.format("binaryFile").load(escaped).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    lines = listed.select(F.sha2(F.concat_ws("\t", "path", "length", "at"), 256).alias("leaf"))
    return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("leaf")), "\n"), 256)).first()[0]


def frame_state(df: DataFrame) -> str | None:
    """What a frame is made of: its plan and the state of its files; None if that does not tell its content.

    Frames of rows, of functions in Python, of chance and of the current time have no state.
    """
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().toString())
    if re.search(r"LocalRelation|LogicalRDD|ExternalRDD|Range \(|UDF|[Pp]ython|rand|uuid|shuffle|current_|now\(|monotonically|spark_partition_id", plan):
        return None
    # Every source must be a table of files whose names Spark tells.
    files = df.inputFiles()
    if not files or len(re.findall(r"Relation ", plan)) != len(re.findall(r"Relation .*? (?:parquet|orc|csv|json|text|avro)\b", plan)):
        return None
    return hashlib.sha256(f"{plan}\n{df.schema.json()}\n{file_state(df.sparkSession, files)}".encode()).hexdigest()


class KnowledgeStore:
    """Profiles, value index, terms and relationships of a set of tables, never written into the tables.

    A store belongs to a content identity, the digest of all rows. Beside the stores lies a ledger of states, digests of
    the plans of the tables and of the paths, sizes and times of their files: while the state is a known one, the
    identity is looked up and no row is read. A new state (a file added, removed or written anew) is read in full.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def identity(self, tables: dict[str, DataFrame], catalog: DataFrame, descriptions: DataFrame | None = None) -> str:
        """Digest of table contents, catalog, descriptions and version."""
        parts = snapshot(tables).unionByName(table_fingerprint(catalog, "_catalog"))
        if descriptions is not None:
            parts = parts.unionByName(table_fingerprint(descriptions, "_descriptions"))
        return fold_fingerprint(parts.select("name", "fingerprint"), [VERSION]).first()["identity"]

    def state(self, tables: dict[str, DataFrame], catalog: DataFrame, descriptions: DataFrame | None = None) -> str | None:
        """Digest of what the tables are made of, without reading them; None if that cannot be told.

        Catalog and descriptions are small and told by content.
        """
        parts = [f"{name}={frame_state(df)}" for name, df in sorted(tables.items())]
        if any(p.endswith("=None") for p in parts):
            return None
        small = {"_catalog": catalog} | ({} if descriptions is None else {"_descriptions": descriptions})
        parts += [f"{name}={table_fingerprint(df, name).first()['fingerprint']}" for name, df in small.items()]
        return hashlib.sha256("\n".join([VERSION, *parts]).encode()).hexdigest()

    def known(self, state: str | None) -> str | None:
        """The identity that the ledger has for a state."""
        if state is None or not _exists(self.spark, f"{self.root}/_states/{state}/_SUCCESS"):
            return None
        return self.spark.read.text(f"{self.root}/_states/{state}").first()["value"]

    def path(self, identity: str, dataset: str) -> str:
        return f"{self.root}/{identity}/{dataset}"

    def build(
        self, tables: dict[str, DataFrame], catalog: DataFrame, fks: DataFrame, descriptions: DataFrame | None = None, force: bool = False
    ) -> str:
        """Write the four datasets and a manifest under the identity; a complete store is a hit.

        A hit of a known state reads no row; the state is taken before the rows are read, so files that change
        meanwhile are found by the next call.
        """
        state = self.state(tables, catalog, descriptions)
        identity = self.known(state) or self.identity(tables, catalog, descriptions)
        if _exists(self.spark, f"{self.path(identity, 'manifest')}/_SUCCESS") and not force:
            self._note(state, identity)
            return identity
        counts = cut_lineage(value_counts(tables))
        index = value_index(top_values(counts))
        self._write(identity, "columns", column_profile(counts, catalog, descriptions))
        self._write(identity, "values_index", index)
        self._write(identity, "value_terms", value_terms(self.read(identity, "values_index")))
        self._write(identity, "relationships", fks.drop("db_id"))
        checks = self._checks(identity).withColumns({"identity": F.lit(identity), "version": F.lit(VERSION), "files": F.lit(self._files(identity))})
        checks.coalesce(1).write.mode("overwrite").parquet(self.path(identity, "manifest"))
        self._note(state, identity)
        return identity

    def _note(self, state: str | None, identity: str) -> None:
        if state is not None and self.known(state) != identity:
            frame = self.spark.createDataFrame([(identity,)], "value string")
            frame.coalesce(1).write.mode("overwrite").text(f"{self.root}/_states/{state}")

    def _files(self, identity: str) -> str:
        return file_state(self.spark, [f for name in LAYOUT for f in self.read(identity, name).inputFiles()])

    def _write(self, identity: str, dataset: str, df: DataFrame) -> None:
        writer = df.write.mode("overwrite")
        if LAYOUT[dataset]:
            writer = writer.partitionBy(*LAYOUT[dataset])
        writer.parquet(self.path(identity, dataset))

    def _checks(self, identity: str) -> DataFrame:
        return snapshot({name: self.read(identity, name) for name in LAYOUT})

    def read(self, identity: str, dataset: str) -> DataFrame:
        return self.spark.read.parquet(self.path(identity, dataset))

    def load(self, tables: dict[str, DataFrame], catalog: DataFrame, descriptions: DataFrame | None = None) -> dict[str, DataFrame]:
        """The datasets of exactly this content; identity, version and fingerprints are checked.

        Datasets whose files are those that the manifest was written for are not read again; others are.
        """
        identity = self.known(self.state(tables, catalog, descriptions)) or self.identity(tables, catalog, descriptions)
        if not _exists(self.spark, f"{self.path(identity, 'manifest')}/_SUCCESS"):
            raise StoreError("knowledge store is missing for the current content")
        manifest = self.read(identity, "manifest")
        if not manifest.filter((F.col("version") != VERSION) | (F.col("identity") != identity)).isEmpty():
            raise StoreError("knowledge store has another version")
        if manifest.select("files").first()[0] == self._files(identity):
            return {name: self.read(identity, name) for name in LAYOUT}
        stored = manifest.select("name", F.col("fingerprint").alias("expected"))
        wrong = self._checks(identity).join(stored, "name", "full_outer").filter(~F.col("fingerprint").eqNullSafe(F.col("expected")))
        if not wrong.isEmpty():
            raise StoreError("knowledge store was changed")
        return {name: self.read(identity, name) for name in LAYOUT}


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Document vectors keyed by id, so that no positions have to align."""
    vectors.select("doc_id", "vector").write.mode("errorifexists").parquet(path)


def read_vectors(documents: DataFrame, path: str) -> DataFrame:
    """Documents with their vectors; a document without one, or a stray vector, fails the job."""
    vectors = documents.sparkSession.read.parquet(path)
    left = documents.withColumn("_d", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), "doc_id", "full_outer")
    both = F.col("_d").isNotNull() & F.col("_v").isNotNull()
    return left.filter(F.assert_true(both, F.lit("vectors do not match the documents")).isNull()).drop("_d", "_v")
