"""Operator 13: exact top-k inner products by columnar branch-and-bound.

Vectors are turned into integers and packed into blocks of about ``BLOCK``, each in vertical layout: one
contiguous array per dimension. Every pack of queries meets every block once, as one row of a join of packs. For
a query, the dimensions are taken ``STEP`` at a time, those of its greatest components first. After each step
the rest of a candidate's score is at most the product of the two remaining masses (the roots of the sums of
squares of the dimensions not yet read); candidates whose partial score plus that bound stays below the k-th
greatest score known are dropped, and the survivors are compacted, so later steps read less of each dimension.
The known k-th score comes from the exact scores of the ``2k`` best partial ones and from the lower bounds.
A block returns at most ``k`` rows a query; the last step merges them.

All arithmetic is on whole numbers: in doubles while every sum stays below 2^53, else in unbounded integers
without bounds. The bounds are rounded up, so no candidate is lost.

Defined results: null vectors, those with null or non-finite components and rows without an id take no part;
zero vectors and those of length 0 do. Vectors are compared with those of equal length. Repeated rows count once;
an id with several vectors is one candidate, and one query, for each, and never a candidate of its own. With fewer
candidates than ``k`` all are returned. Components of 2^53 and more are cut to the ends of a 64-bit integer, scores
likewise. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import shelve, table
from groundscope.llm.registry import query
from groundscope.operators.ranking import top_k

#: Neighbours, vectors of a block, queries of a pack, dimensions of a step, factor of the components.
K, BLOCK, PACK, STEP, FACTOR = 10, 16_384, 1_024, 8, 1024.0
EXACT = 1 << 53
PACKED = "dims int, {number} int, ids binary, tags binary, columns binary"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part as floor(FACTOR * x), repeated rows once."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(FACTOR)).cast("long")).alias("v")).distinct()


def packed(rows: DataFrame, number: str, count: int) -> DataFrame:
    """Rows of (dims, number) with the ids and the dimensions of about an equal share of the rows, one after another."""
    dealt = rows.withColumns({"dims": F.size("v"), number: F.pmod(F.xxhash64("vec_id", "v"), F.lit(count)).cast("int")})

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        dims = int(group["dims"].iloc[0])
        columns = np.stack(group["v"].to_numpy()).astype(np.int64) if dims else np.empty((len(group), 0), dtype=np.int64)
        return pd.DataFrame({
            "dims": [dims], number: [int(group[number].iloc[0])], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
            "tags": [group["tag"].to_numpy(np.int64).tobytes()], "columns": [np.ascontiguousarray(columns.T).tobytes()],
        })

    # The tag tells vectors of one id apart.
    return dealt.withColumn("tag", F.xxhash64("v")).groupBy("dims", number).applyInPandas(pack, PACKED.format(number=number))


def kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def survivors(asked: np.ndarray, columns: np.ndarray, rows: np.ndarray, masses: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among ``rows`` that can be of the k best of one query, with their exact scores."""
    order = np.argsort(-np.abs(asked), kind="stable")
    rest = np.append(np.cumsum((asked[order] ** 2)[::-1])[::-1], 0.0)
    partial, mass, known = np.zeros(len(rows)), masses[rows], -np.inf
    for at in range(0, len(order), STEP):
        dims = order[at : at + STEP]
        values = columns[dims] if len(rows) == columns.shape[1] else columns[dims][:, rows]
        partial = partial + asked[dims] @ values
        mass = mass - (values * values).sum(axis=0)
        left = rest[min(at + STEP, len(order))]
        if left == 0 or len(rows) <= 2 * k:
            if left:
                others = order[at + STEP :]
                partial = partial + asked[others] @ columns[others][:, rows]
            break
        bound = np.ceil(np.sqrt(left * np.maximum(mass, 0.0)) * (1 + 1e-9))
        likely = rows[np.argpartition(partial, len(rows) - 2 * k)[-2 * k :]]
        known = max(known, kth(asked @ columns[:, likely], k), kth(partial - bound, k))
        stay = partial + bound >= known
        if stay.sum() < 0.8 * len(rows):
            rows, partial, mass = rows[stay], partial[stay], mass[stay]
    return rows, partial


def search_block(asked_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, columns: np.ndarray, k: int) -> list[tuple]:
    """(number of the query, ids, scores) of the k best candidates of a block for each query."""
    most = int(max(abs(int(columns.min(initial=0))), abs(int(columns.max(initial=0))), abs(int(asked.min(initial=0))), abs(int(asked.max(initial=0)))))
    small = most * most * max(1, len(columns)) < EXACT
    if small:
        columns, asked = columns.astype(np.float64), asked.astype(np.float64)
        masses = (columns * columns).sum(axis=0)
    else:
        columns, asked = columns.astype(object), asked.astype(object)
    out = []
    for i, own in enumerate(asked_ids):
        rows = np.flatnonzero(ids != own)
        if not len(rows):
            continue
        if small:
            rows, score = survivors(asked[i], columns, rows, masses, k)
        else:
            score = asked[i] @ columns[:, rows] if len(columns) else np.zeros(len(rows))
        if len(rows) > k and small:
            near = score >= kth(score, k)
            rows, score = rows[near], score[near]
        best = np.lexsort((ids[rows], -score)) if small else np.array(sorted(range(len(rows)), key=lambda r: (-score[r], ids[rows[r]])))
        best = best[:k]
        out.append((i, ids[rows[best]], score[best]))
    return out


def search(rows: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products for the rows whose id is divisible by ``every``."""
    whole = shelve(whole_vectors(rows))
    is_query = F.col("vec_id") % every == 0
    total, queries = whole.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, sides = max(1, -(-total // BLOCK)), max(1, -(-queries // PACK))
    # (dims, block, side) is unique on either side of the join: each pair of packs is one row of it.
    index = packed(whole, "block", blocks).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    asks = packed(whole.filter(is_query), "side", sides).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asks = asks.select("dims", "side", "block", F.col("ids").alias("asked_ids"), F.col("tags").alias("asked_tags"), F.col("columns").alias("asked"))
    pairs = index.join(asks, ["dims", "block", "side"]).select("dims", "ids", "columns", "asked_ids", "asked_tags", "asked")
    low, high = -(1 << 63), (1 << 63) - 1

    def run(frames):
        for frame in frames:
            for dims, ids, columns, asked_ids, tags, asked in frame.itertuples(index=False):
                ids, asked_ids, tags = (np.frombuffer(x, dtype=np.int64) for x in (ids, asked_ids, tags))
                columns = np.frombuffer(columns, dtype=np.int64).reshape(dims, len(ids))
                asked = np.frombuffer(asked, dtype=np.int64).reshape(dims, len(asked_ids)).T
                found = search_block(asked_ids, asked, ids, columns, k)
                for i, near, score in found:
                    yield pd.DataFrame({"query_id": asked_ids[i], "tag": tags[i], "vec_id": near, "score": [min(max(int(s), low), high) for s in score]})

    found = pairs.mapInPandas(run, "query_id long, tag long, vec_id long, score long")
    return top_k(found, ["query_id", "tag"], [F.col("score").desc(), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""


@query("op13_topk", ORACLE)
def op13_topk(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
