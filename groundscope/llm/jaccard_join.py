"""Operator 4: join of texts whose word 5-gram sets have Jaccard similarity 0.8 or more, by MinHash bands.

Texts with equal sets are one node from the start; the node counts its copies. Each node gets one label per
band, made of the band's minimum hashes, and nodes that share a label meet. A band has as many hashes as leave
a pair at exactly the threshold a shared label with probability ``RECALL``, at most ``DEEPEST``; all higher
similarities are found more surely. The length is fixed by these constants, which gives 6: this is plain
banding, not an LSH forest, and a text that met nobody is not looked for again with fewer hashes.

Meeting nodes are only tied to the smallest node of the label; connected components of these ties hold every
candidate pair. Sets travel once to their component, where similarities are counted exactly: components are
cut into blocks of about ``BLOCK`` nodes and each pair of blocks is one unit of work, so no group has to fit
one task. Pairs are never listed: a unit returns, for each node, the number of documents it is linked to and
one tie along a search tree, and the ties give the classes.

Defined results: words are runs of letters, digits and underscores of the lower-cased text; a text of fewer
than five words has its whole word run as its only gram; texts without words are linked to equal texts only;
null and empty texts have no links and a class of their own; repeated rows are copies; class ids are the
smallest document id of the class; an empty table gives no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import shelve, stable, table
from groundscope.llm.registry import query
from groundscope.operators.dataset import components

THRESHOLD, WORDS, TREES, DEEPEST, RECALL, BLOCK = 0.8, 5, 32, 10, 0.9999, 1500
#: Word hashes remembered by a task at once.
REMEMBERED = 200_000
WORD = re.compile(r"\w+")
_ODD, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The longest prefix, from the deepest down, that reaches the target recall at the threshold."""
    for d in range(deepest, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def grams(text: str, known: dict[str, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(known) > REMEMBERED:
        known.clear()
    for w in set(words).difference(known):
        known[w] = stable(w)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        out = (out ^ (out >> np.uint64(29))) * _ODD + h[j : j + len(out)]
    return np.unique((out ^ (out >> np.uint64(32))) * _M)


def labels(found: np.ndarray, xor: np.ndarray, odd: np.ndarray, d: int) -> np.ndarray:
    """One prefix label of each tree."""
    h = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(xor), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(h), 4096):
        low = np.minimum(low, ((h[None, at : at + 4096] ^ xor[:, None]) * odd[:, None]).min(axis=1))
    paths = low.reshape(-1, d).astype(np.uint64)
    out = np.arange(1, len(paths) + 1, dtype=np.uint64) * _M
    for j in range(d):
        out = (out ^ (out >> np.uint64(31))) * _ODD + paths[:, j]
    return ((out ^ (out >> np.uint64(30))) * _M).view(np.int64)


def _signatures(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, known = np.random.default_rng(99), {}
        xor = rng.integers(0, 1 << 32, TREES * d, dtype=np.uint64).astype(np.uint32)
        odd = rng.integers(0, 1 << 31, TREES * d, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        for batch in batches:
            keys, trees = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                found = grams(text, known)
                raw = found.tobytes() if len(found) else b"text" + text.encode("utf-8", "surrogatepass")
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if text else None)
                trees.append(labels(found, xor, odd, d) if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(trees, pa.list_(pa.int64()))],
                ["doc_id", "h", "node", "trees"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        packed = [grams(t.as_py() or "", known).tobytes() for t in batch.column(batch.num_columns - 1)]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())], [*batch.schema.names[:-1], "grams"])


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold."""
    sizes = np.array([len(s) for s in sets])
    n = len(sets)
    shared = np.zeros((n, n))
    if n <= 6:
        for i in range(n):
            for j in range(i):
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        row = np.repeat(np.arange(n), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Grams of one set only cannot be shared; the others are renumbered and counted in slices of columns.
        number = np.cumsum(times > 1) - 1
        some = times[column] > 1
        row, column = row[some], number[column[some]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = max(256, min(8192, 16_000_000 // n))
        for first in range(0, int(number[-1]) + 1, width):
            a, b = np.searchsorted(column, [first, first + width])
            grid = np.zeros((n, width), dtype=np.float32)
            grid[row[a:b], column[a:b] - first] = 1.0
            shared += grid @ grid.T
    either = sizes[:, None] + sizes[None, :] - shared
    close = shared >= threshold * either - 1e-9
    np.fill_diagonal(close, False)
    return close


def _verify(threshold: float) -> Callable:
    """Units of work in a sorted partition, one at a time; a unit may go on in the next batch."""
    def solve(unit: dict[bytes, tuple], one_block: bool) -> list[tuple]:
        keys = sorted(unit)
        close = similar([np.frombuffer(unit[k][1], dtype=np.uint64) for k in keys], threshold)
        if not one_block:
            block = np.array([unit[k][2] for k in keys])
            close &= block[:, None] != block[None, :]
        copies = np.array([unit[k][0] for k in keys])
        links = close @ copies
        out = [(keys[i], int(links[i]), keys[i]) for i in np.flatnonzero(links)]
        # Ties along a search tree hold a class together.
        seen = np.zeros(len(keys), dtype=bool)
        for start in np.flatnonzero(links):
            if seen[start]:
                continue
            seen[start], todo = True, [start]
            while todo:
                i = todo.pop()
                fresh = np.flatnonzero(close[i] & ~seen)
                seen[fresh] = True
                todo += fresh.tolist()
                out += [(keys[j], 0, keys[start]) for j in fresh]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["node", "links", "other"], [pa.binary(), pa.int64(), pa.binary()]
        key, unit = None, {}
        rows: list[tuple] = []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", "i", "j", "node", "copies", "grams", "block")]
            for part, i, j, node, copies, found, block in zip(*columns):
                if (part, i, j) != key:
                    if len(unit) > 1:
                        rows += solve(unit, key[1] == key[2])
                    key, unit = (part, i, j), {}
                unit[node] = (copies, found, block)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, types)], names)
            rows = []
        if len(unit) > 1:
            rows = solve(unit, key[1] == key[2])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, types)], names)

    return run


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, h, class_id, n_links, class_key) of every row; h tells texts apart, class_key is null for empty texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.xxhash64("text", F.lit(1)).alias("h"), "text")
    signed = shelve(slim.mapInArrow(_signatures(depth(threshold)), f"doc_id {kind}, h long, node binary, trees array<long>"))
    nodes = shelve(
        signed.filter("node is not null").groupBy("node").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("one"), F.first("trees").alias("trees")
        )
    )
    met = nodes.select("node", F.explode("trees").alias("label"))
    shared = met.groupBy("label").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    ties = met.join(shared, "label").filter("node <> leader").select("node", "leader").distinct()
    parts = components(ties, "node", "leader").withColumnRenamed("label", "part")
    sizes = parts.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = shelve(
        parts.join(sizes, "part").join(nodes.drop("trees"), "node")
        .select("part", "blocks", "node", "copies", "one.doc_id", "one.h", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    )
    # Always a merge join: the plan is the same at every size, and neither side has a bounded size.
    wanted = placed.alias("p").hint("merge")
    texts = slim.alias("t").join(
        wanted, F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.h") == F.col("p.h"))
    ).select("p.part", "p.blocks", "p.node", "p.copies", "p.block", "t.text")
    sets = texts.mapInArrow(_sets, "part binary, blocks int, node binary, copies long, block int, grams binary")
    units = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "grams", "block"
    )
    found = shelve(
        units.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")
        .mapInArrow(_verify(threshold), "node binary, links long, other binary")
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select("node", "other"), "node", "other").withColumnRenamed("label", "class_key")
    whole = nodes.drop("trees", "one").join(links, "node", "left").join(joined, "node", "left").select(
        "node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_key", "node").alias("class_key")
    )
    least = whole.groupBy("class_key").agg(F.min("least").alias("class_id"))
    result = whole.join(least, "class_key").select("node", "class_key", "class_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"))
    return signed.select("doc_id", "h", "node").join(result, "node", "left").select(
        "doc_id", "h", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "class_key",
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one row of each class, the one with the smallest id; empty texts stay."""
    found = classes(docs, threshold)
    first = found.filter("class_key is not null").groupBy("class_key").agg(F.min(F.struct("doc_id", "h")).alias("one"))
    keep = shelve(
        first.select("one.doc_id", "one.h", F.lit(True).alias("once")).unionByName(
            found.filter("class_key is null").select("doc_id", "h", F.lit(False).alias("once")).distinct()
        )
    )
    # A kept row may occur several times; those ids are few or none.
    rows = docs.withColumn("_join_hash", F.xxhash64("text", F.lit(1)))
    k = keep.select(F.col("doc_id").alias("_join_id"), F.col("h").alias("_join_h"), F.col("once").alias("_join_once"))
    kept = rows.join(k, rows["doc_id"].eqNullSafe(k["_join_id"]) & (rows["_join_hash"] == k["_join_h"]))
    times = found.filter("class_key is not null").groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1")
    if times.isEmpty():
        return kept.select(*[rows[c] for c in docs.columns])
    once = kept.filter("_join_once").dropDuplicates(["_join_id", "_join_h"])
    return once.unionByName(kept.filter("not _join_once")).select(*docs.columns)


@query("op4_jaccard_join")
def op4_jaccard_join(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
