"""Fingerprints, change lists, exposure and budget ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundscope.operators.profile import printed
from groundscope.operators.ranking import running_sum
from groundscope.operators.results import hash_sum


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A row as text; nulls are marked so that they differ from empty strings."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.concat_ws("\u001f", *[F.coalesce(printed(F.col(f"`{c}`"), types[c]), F.lit("\\N")) for c in columns or df.columns])


def table_fingerprint(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a table: row count and the exact sum of 60-bit row digests."""
    return df.agg(
        F.count("*").alias("row_count"), F.coalesce(F.sum(hash_sum(row_text(df, columns))), F.lit(0)).cast("string").alias("digest_sum")
    ).select(F.lit(name).alias("name"), "row_count", F.sha2(F.concat_ws(":", "row_count", "digest_sum"), 256).alias("fingerprint"))


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    result = None
    for name, df in tables.items():
        part = table_fingerprint(df, name)
        result = part if result is None else result.unionByName(part)
    return result


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names whose fingerprint was added, removed or changed."""
    old = before.select("name", F.col("fingerprint").alias("old"))
    new = after.select("name", F.col("fingerprint").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return old.join(new, "name", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select("name", kind.alias("change"))


def fold_fingerprint(parts: DataFrame, versions: Sequence[str] = ()) -> DataFrame:
    """One digest over named part fingerprints in name order and version strings."""
    listed = F.sort_array(F.collect_list(F.struct("name", "fingerprint")))
    lines = F.transform(listed, lambda p: F.concat(p["name"], F.lit("="), p["fingerprint"]))
    return parts.agg(lines.alias("lines")).select(
        F.sha2(F.array_join(F.concat(F.array(*[F.lit(v) for v in sorted(versions)]).cast("array<string>"), "lines"), "\n"), 256).alias("identity")
    )


class LockedRoleError(ValueError):
    """A role that must stay unopened was requested."""


def check_exposure(log: DataFrame, role: str, locked: Sequence[str]) -> int:
    """Number of earlier openings of a role; locked roles are refused before anything is read."""
    if role in locked:
        raise LockedRoleError(f"role {role} is locked")
    return log.filter(F.col("role") == role).count()


def exposure_report(log: DataFrame) -> DataFrame:
    """Who opened which role, how often and when first."""
    return log.groupBy("role", "actor").agg(F.count("*").alias("openings"), F.min("opened_at").alias("first_opened"))


def ledger(log: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], seconds: str, ceiling) -> DataFrame:
    """I4: running charge per budget and whether each charge still fits under the ceiling."""
    spent = running_sum(log, keys, bucket, order, seconds, "spent")
    return spent.withColumn("within", F.col("spent") <= F.lit(ceiling))


def portable_fingerprint(records: DataFrame, path: str, contents: DataFrame, name: str) -> DataFrame:
    """Fingerprint of records in which file paths are replaced by the digest of the file's content.

    ``contents``: path, fingerprint. An unknown path fails the job.
    """
    known = contents.select(F.col("path").alias(path), F.col("fingerprint").alias("_content"))
    replaced = records.join(known, path, "left")
    checked = replaced.filter(F.assert_true(F.col("_content").isNotNull(), F.lit("unknown file path")).isNull())
    return table_fingerprint(checked.withColumn(path, F.col("_content")).select(*records.columns), name)
