"""Operator 7: nearest neighbours by multi-index hashing over learned rotated binary codes.

Learning: on at most about ``SAMPLE`` vectors, chosen by a digest over all, principal axes and a rotation
that brings the rotated vectors close to the corners of a cube (alternating between signs and an orthogonal
fit). A vector's code is the signs, ``BITS`` of them. The Hamming radius is the one within which the sample
finds ``TARGET`` of its true neighbours; neighbours are farther apart in a sample than in the whole table,
so the share over all rows is larger.

Index: every distinct vector, in blocks of about ``BLOCK``. Each block sorts its codes by each of ``PARTS``
substrings. A query probes, in each substring, all values within radius // PARTS bits: by the pigeonhole
principle that retrieves every code within the radius. Codes within the radius are reranked by the float
vectors. Each pair of a query block and an index block returns at most ``k`` rows a query; the last step
merges them. Queries whose radius held too few rows are widened in the same block until ``k`` are found or
the radius covers all bits, so no query comes back short.

Equal vectors have equal distances, ties go to the smaller id, so of a group of equal vectors only the
``k + 1`` smallest ids can ever be returned: the index keeps these, however large the group is, and nothing
is lost.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do
null ids; vectors of different lengths are searched apart, each query among those of its own; with fewer
candidates than ``k`` all are returned; an id that occurs twice with different vectors is one candidate for each; only ``vec_id``
and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundscope.llm.common import table
from groundscope.llm.registry import query
from groundscope.session import cut_lineage

#: Code bits, substrings, neighbours, rows of the learning sample, its queries, wanted share, vectors of a block.
BITS, PARTS, K, SAMPLE, SAMPLE_QUERIES, TARGET, BLOCK = 64, 4, 10, 12_000, 300, 0.97, 20_000


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    )
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.filter(F.exists("v", lambda x: x != 0))


def learn(sample: np.ndarray, bits: int = BITS, k: int = K) -> dict:
    """Centre, projection to code bits, and the radius."""
    rng = np.random.default_rng(2)
    mean = sample.mean(axis=0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[: min(bits, len(axes))]
    # With fewer axes than bits, further rotations of the same axes give the other bits.
    parts, done = [], 0
    while done < bits:
        z = x @ axes.T
        r = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0]
        for _ in range(25):
            u, _, w = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ w).T
        parts.append(axes.T @ r)
        done += len(axes)
    model = {"mean": mean, "turn": np.hstack(parts)[:, :bits], "radius": bits}
    if len(x) > k + 1:
        asked = rng.permutation(len(x))[:SAMPLE_QUERIES]
        codes = encode(model, sample)
        far = []
        for i in asked:
            d = ((sample - sample[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argpartition(d, k)[:k]
            far.append(np.bitwise_count(codes[near] ^ codes[i]))
        model["radius"] = int(np.quantile(np.concatenate(far), TARGET, method="higher"))
    return model


def encode(model: dict, v: np.ndarray) -> np.ndarray:
    bits = (v - model["mean"]) @ model["turn"] > 0
    padded = np.zeros((len(v), 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()


def substrings(codes: np.ndarray) -> np.ndarray:
    return codes.view("<u2").reshape(-1, PARTS)


def probes(reach: int) -> np.ndarray:
    """All 16-bit differences of at most ``reach`` bits."""
    every = np.arange(1 << (BITS // PARTS), dtype=np.uint16)
    return every[np.bitwise_count(every) <= reach]


class Index:
    """Substring tables of one block: for each value of a substring, the rows that have it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for values in substrings(codes).T:
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.searchsorted(values[order], np.arange((1 << 16) + 1))))

    def within(self, code: np.ndarray, radius: int, differences: np.ndarray) -> np.ndarray:
        """Rows whose code is within the radius of the query's."""
        hit = np.zeros(len(self.codes), dtype=bool)
        for value, (order, starts) in zip(substrings(code)[0], self.tables):
            wanted = (differences ^ value).astype(np.int64)
            first, size = starts[wanted], starts[wanted + 1] - starts[wanted]
            some = size > 0
            first, size = first[some], size[some]
            run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            hit[order[np.repeat(first, size) + run]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code[0]) <= radius]


def search_block(model: dict, queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest candidates of the block for each query. ``block`` has one row per kept id."""
    x, ids = np.stack(block["v"].to_numpy()), block["vec_id"].to_numpy()
    index = Index(encode(model, x))
    asked = np.stack(queries["v"].to_numpy())
    codes = encode(model, asked)
    differences = {}
    out = []
    for i, own in enumerate(queries["vec_id"]):
        radius = model["radius"]
        while True:
            reach = radius // PARTS
            if reach not in differences:
                differences[reach] = probes(reach)
            rows = index.within(codes[i : i + 1], radius, differences[reach])
            rows = rows[ids[rows] != own]
            if len(rows) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + PARTS)
        d = np.sqrt(((x[rows] - asked[i]) ** 2).sum(axis=1))
        if len(rows) > k:
            edge = np.partition(d, k - 1)[k - 1]
            rows, d = rows[d <= edge], d[d <= edge]
        best = np.lexsort((ids[rows], d))[:k]
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids[rows[best]], "score": d[best]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(rows: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``; each vector length has its own model and index."""
    good = usable(rows)
    lengths = sorted(r["n"] for r in good.select(F.size("v").alias("n")).distinct().collect())
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths:
        found = found.union(search_length(good.filter(F.size("v") == n), k, every))
    return found


def search_length(good: DataFrame, k: int, every: int) -> DataFrame:
    """The search among vectors of one length."""
    # The k + 1 smallest ids of each distinct vector; the ids of a group meet in bounded lists only.
    salted = good.distinct().select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    thin = salted.withColumn("r", F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    kept = thin.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    kept = cut_lineage(kept.select("vec_id", "v", "r"))
    distinct = kept.filter("r = 1").count()
    share = min(1.0, SAMPLE / max(1, distinct))
    digest = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(1_000_000))
    sample = kept.filter("r = 1").filter(digest < int(share * 1_000_000)).select("v", F.xxhash64("v").alias("h")).toPandas()
    if sample.empty:
        sample = kept.limit(1).select("v", F.xxhash64("v").alias("h")).toPandas()
    sample = sample.sort_values("h", kind="stable")
    model = learn(np.stack(sample["v"].to_numpy()), k=k)
    blocks = max(1, -(-distinct // BLOCK))
    asked = good.filter(F.col("vec_id") % every == 0).distinct()
    n_asked = asked.count()
    sides = max(1, -(-n_asked // 500))
    # Each index block meets each query block in one group; both sides have a bounded size there.
    block_of = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(blocks)).cast("int")
    side_of = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(sides)).cast("int")
    index = kept.select("vec_id", "v", block_of.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
    asks = asked.select("vec_id", "v", side_of.alias("side"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        left = left.sort_values("vec_id", ignore_index=True)
        return search_block(model, left, right.sort_values("vec_id", ignore_index=True), k)

    found = asks.groupBy("block", "side").cogroup(index.groupBy("block", "side")).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query("op7_ann")
def op7_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
