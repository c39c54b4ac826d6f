"""Operator 8: minimax contiguous partition of ordered atomic groups into shards.

Rows with equal texts form one atomic group; groups are ordered by their 64-bit hash (texts that share a
hash share a group, so equal texts always stay together). The largest shard is made as small as it can
be: the capacity is binary-searched and each candidate is checked greedily over the ordered sizes.

The ordered sizes never reach the driver whole. It holds a summary of at most ``SEGMENTS`` contiguous
hash ranges. A range is known by its sum only; greedy passes over whole ranges (none can be cut) and over
fluid ranges (all can be cut anywhere) bound the optimal capacity and the place of every cut, and only
ranges in which a cut can still fall are opened into smaller ranges, down to single groups. The found
capacity is therefore exact over all groups, whatever their number.

A group above the fair share of the shards gets a shard of its own first; the rest is partitioned over
the remaining shards. Among the cuts that respect the smallest capacity those nearest to equal sizes win.

Defined results: null text counts as no bytes (size 8, crc 0) and joins the group of the empty text; an
empty table gives an empty result; fewer groups than shards leave shards empty; repeated rows each get a
slot of their own; only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from groundscope.llm.common import table
from groundscope.llm.registry import query
from groundscope.session import cut_lineage

SEGMENTS = 65_536
#: Rows that one task of the slot numbering handles.
SLOT_ROWS = 200_000
BITS = 64


class Segments:
    """Contiguous key ranges in order: width in bits, bytes and groups of each."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)  # (low key, bits, bytes, groups)
        self.prefix = np.concatenate([[0], np.cumsum([r[2] for r in self.rows], dtype=np.int64)]).tolist()
        self.atomic = [r[3] == 1 for r in self.rows]
        self.total = self.prefix[-1]

    def greedy(self, capacity: int, shards: int, start: int = 0) -> list[int] | None:
        """Segment indexes after which a greedy pass cuts, whole segments only; None if it needs more shards."""
        at, cuts = start, []
        for _ in range(shards):
            after = bisect_right(self.prefix, self.prefix[at] + capacity) - 1
            if after >= len(self.rows):
                cuts.append(len(self.rows))
                return cuts
            if after == at:
                return None
            cuts.append(after)
            at = after
        return None

    def fluid(self, capacity: int, shards: int) -> list[int] | None:
        """Positions in bytes of a greedy pass that may cut everywhere but in single groups."""
        at, cuts = 0, []
        for _ in range(shards):
            at += capacity
            if at >= self.total:
                cuts.append(self.total)
                return cuts
            inside = bisect_right(self.prefix, at) - 1
            if self.atomic[inside]:
                if cuts and self.prefix[inside] <= cuts[-1]:
                    return None
                at = self.prefix[inside]
            cuts.append(at)
        return None

    def smallest(self, feasible, low: int, high: int) -> int:
        while low < high:
            middle = (low + high) // 2
            if feasible(middle):
                high = middle
            else:
                low = middle + 1
        return low


def _summary(groups: DataFrame, open_ranges: list[tuple[int, int]] | None, bits: int) -> list[tuple[int, int, int, int]]:
    """Sums of the key ranges of 2**bits keys, of all groups or of those in the open ranges."""
    base = F.shiftleft(F.shiftright("key", bits), bits) if bits else F.col("key")
    rows = groups
    if open_ranges is not None:
        spark = groups.sparkSession
        width = open_ranges[0][1]
        wanted = spark.createDataFrame([(low,) for low, _ in open_ranges], "low long")
        rows = groups.withColumn("low", F.shiftleft(F.shiftright("key", width), width)).join(wanted, "low", "left_semi")
    found = rows.groupBy(base.alias("base")).agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("only"))
    return [(r["only"] if r["n"] == 1 else r["base"], bits, r["bytes"], r["n"]) for r in found.collect()]


def boundaries(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of the 2nd, 3rd, ... shard, and the smallest capacity. ``groups``: key, bytes."""
    width = BITS - SEGMENTS.bit_length() + 1
    segments = Segments(_summary(groups, None, width))
    if not segments.rows:
        return [], 0
    while True:
        total, biggest = segments.total, max(r[2] for r in segments.rows if r[3] == 1) if any(segments.atomic) else 0
        floor = max(-(-total // shards), biggest)
        high = segments.smallest(lambda c: segments.greedy(c, shards) is not None, floor, total)
        low = segments.smallest(lambda c: segments.fluid(c, shards) is not None, floor, high)
        if low > floor:
            low -= 1
        far, near = segments.fluid(high, shards) or [total], []
        at = 0
        for _ in range(shards):
            at = max(at, bisect_right(segments.prefix, segments.prefix[at] + low) - 1)
            near.append(segments.prefix[at])
            if at >= len(segments.rows):
                break
        opened = set()
        for k, end in enumerate(far):
            first = bisect_right(segments.prefix, near[min(k, len(near) - 1)]) - 1
            last = bisect_right(segments.prefix, end) - 1
            opened |= {i for i in range(first, min(last + 1, len(segments.rows))) if not segments.atomic[i]}
        if not opened:
            break
        # The widest open ranges first: all opened at once have one width, so one scan refines them.
        widest = max(segments.rows[i][1] for i in opened)
        chosen = [i for i in opened if segments.rows[i][1] == widest]
        inside = sum(segments.rows[i][3] for i in chosen)
        finer = 0 if inside <= SEGMENTS else max(0, widest - max(1, (SEGMENTS // len(chosen)).bit_length() - 1))
        lows = [(segments.rows[i][0] >> widest << widest, widest) for i in chosen]
        kept = [r for i, r in enumerate(segments.rows) if i not in set(chosen)]
        segments = Segments(kept + _summary(groups, lows, finer))
    # The end of the last shard of the smallest capacity is fixed; cuts nearest to equal sizes under it.
    at, keys = 0, []
    for left in range(shards, 1, -1):
        if at >= len(segments.rows):
            break
        goal = segments.prefix[at] + (segments.total - segments.prefix[at]) / left
        near = bisect_right(segments.prefix, goal) - 1
        if near + 1 < len(segments.prefix) and segments.prefix[near + 1] - goal < goal - segments.prefix[near]:
            near += 1
        most = bisect_right(segments.prefix, segments.prefix[at] + high) - 1
        cut = max(at + 1, min(near, most))
        if cut > most or segments.greedy(high, left - 1, cut) is None and cut < len(segments.rows):
            cut = most
        if cut >= len(segments.rows):
            break
        keys.append(segments.rows[cut][0])
        at = cut
    return keys, high


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): equal texts together, largest shard minimal."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").cast("long").alias("bytes"), F.count("*").alias("rows")))
    totals = groups.agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("rows").alias("rows")).first()
    left, total, alone = shards, totals["bytes"] or 0, []
    for row in groups.orderBy(F.desc("bytes"), "key").limit(shards).collect():
        if left > 1 and row["bytes"] > total / left:
            alone.append(row["key"])
            total, left = total - row["bytes"], left - 1
    keys, _ = boundaries(groups.filter(~F.col("key").isin(alone)) if alone else groups, left)
    shard: Column = F.lit(0)
    for number, first in enumerate(keys, 1):
        shard = F.when(F.col("key") >= first, F.lit(number)).otherwise(shard)
    for number, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(left + number)).otherwise(shard)
    # Slots: buckets of a shard by a hash of the row, their counts as a bounded prefix table, ranks inside.
    buckets = max(1, -(-(totals["rows"] or 0) // (SLOT_ROWS * shards)) * 4)
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int")
    )
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(_window("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(_window("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        dealt.withColumn("within", within)
        .join(starts, ["shard", "bucket"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _window(*columns: str) -> WindowSpec:
    return Window.partitionBy(*columns)


@query("op8_sharding")
def op8_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"))
