"""Operator 9: text quality by a factorisation machine.

A document is a sparse vector: its hashed words (square roots of their shares, length one), statistics of
its structure and its length, each statistic as a cell of a quantile grid learned from the learning rows.
The score is w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2): the sum-of-squares identity
gives all pairwise interactions in time linear in the entries of the vector. Weights are learned by AdaGrad
on the logistic loss in numpy.

Learning rows: at most about ``PER_CLASS`` rows of each label, chosen by a digest over all learnable labels
(crc32 of the id mod 3 is not 1). Language, source and id are never inputs; ``n_chars`` is not read either,
the length is taken from the text.

Defined results: null text is scored as the empty text; without learnable labels all scores are 0.5;
repeated rows repeat the result; conflicting labels of an id take the larger; only ``doc_id`` and ``text``
are read from the documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundscope.llm.common import balanced_sample, chunks, held_out, learnable, sigmoid, table
from groundscope.llm.registry import query

#: Hashed word cells, quantile cells of a statistic, rank, learning rows of a label, passes over them.
WORDS, CELLS, RANK, PER_CLASS, PASSES = 1 << 15, 12, 6, 3000, 6
#: Byte classes: lower, upper, digit, space, line end, sentence end, other ASCII sign, non-ASCII.
_CLASS = np.full(256, 7, dtype=np.uint8)
_CLASS[:128] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32], _CLASS[10] = 0, 1, 2, 3, 4
for _c in b".,;?":
    _CLASS[_c] = 5
#: Words remembered by a task at once.
REMEMBERED = 400_000


def statistics(text: str, words: list[str]) -> list[float]:
    """Structure of a text: character shares, word and line shapes, repetition, length."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    share = np.bincount(_CLASS[raw], minlength=8) / max(1, len(raw))
    lines = text.split("\n")
    n = max(1, len(words))
    return [
        *share.tolist(), len(text) / n, len(set(words)) / n, len(set(lines)) / len(lines), len(words) / len(lines),
        float(np.log1p(len(words))), float(np.log1p(len(text))), text.count(".") / n,
    ]


STATS = 15


def entries(texts: list[str], seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, word cells and values of the sparse word part; the statistics."""
    cells, sizes, stats = [], [], []
    for text in texts:
        words = text.lower().split()
        stats.append(statistics(text, words))
        for w in set(words).difference(seen):
            seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
        cells.append(np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words)))
        sizes.append(len(words))
        if len(seen) > REMEMBERED:
            seen.clear()
    keys = np.concatenate(cells) + WORDS * np.repeat(np.arange(len(texts)), sizes) if cells else np.zeros(0, np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    row, cell = keys // WORDS, keys % WORDS
    return row, cell, np.sqrt(counts / np.maximum(1, np.array(sizes))[row]), np.array(stats)


def _collected(batches):
    seen: dict[str, int] = {}
    for batch in batches:
        for part, texts in chunks([batch], "text"):
            row, cell, value, stats = entries(texts, seen)
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([cell[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(ends, ends[1:])], pa.binary()),
                pa.array([s.tobytes() for s in stats], pa.binary()),
            ], ["label", "cells", "weights", "stats"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(label, text) of the bounded learning sample; the sample's ids are a bounded, broadcast side."""
    known = (
        labels.filter(learnable(F.col("doc_id")) & F.col(column).isNotNull())
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    )
    sample = balanced_sample(known, "label", per_class)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")


def features(cell: np.ndarray, value: np.ndarray, row: np.ndarray, stats: np.ndarray, edges: np.ndarray):
    """The whole sparse vectors, sorted by row: words, then one cell of each statistic."""
    n = len(stats)
    grid = np.stack([np.searchsorted(edges[:, j], stats[:, j]) for j in range(stats.shape[1])], axis=1)
    grid = WORDS + grid + CELLS * np.arange(stats.shape[1])
    row = np.concatenate([row, np.repeat(np.arange(n), stats.shape[1])])
    cell = np.concatenate([cell, grid.ravel()])
    value = np.concatenate([value, np.full(grid.size, 0.5)])
    order = np.argsort(row, kind="stable")
    return row[order], cell[order], value[order]


def raw_score(model: dict, row: np.ndarray, cell: np.ndarray, value: np.ndarray):
    """Linear part plus pairwise part by the sum-of-squares identity; every row has entries."""
    starts = np.searchsorted(row, np.arange(row[-1] + 1))
    vx = model["v"][cell] * value[:, None]
    total = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat(vx * vx, starts, axis=0)
    linear = np.add.reduceat(model["w"][cell] * value, starts)
    return model["w0"] + linear + 0.5 * (total**2 - squares).sum(axis=1), vx, total


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = PER_CLASS) -> dict | None:
    frame = labelled(docs, labels, column, per_class).mapInArrow(
        _collected, "label int, cells binary, weights binary, stats binary"
    ).toPandas()
    if frame.empty or frame["label"].nunique() < 2:
        return None
    frame = frame.sort_values(["label", "cells", "stats"], kind="stable").reset_index(drop=True)
    y = frame["label"].to_numpy(dtype=float)
    cells = [np.frombuffer(b, dtype=np.int32).astype(np.int64) for b in frame["cells"]]
    values = [np.frombuffer(b, dtype=np.float32).astype(float) for b in frame["weights"]]
    stats = np.stack([np.frombuffer(b, dtype=np.float64) for b in frame["stats"]])
    edges = np.quantile(stats, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0)
    size = WORDS + CELLS * stats.shape[1]
    rng = np.random.default_rng(3)
    model = {"w0": 0.0, "w": np.zeros(size), "v": rng.normal(0, 0.02, (size, RANK)), "edges": edges}
    # AdaGrad keeps a sum of squares per weight.
    gw, gv, g0, rate, decay = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6, 0.08, 1e-5
    for _ in range(PASSES):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            row = np.repeat(np.arange(len(pick)), [len(cells[i]) for i in pick])
            r, c, x = features(
                np.concatenate([cells[i] for i in pick]), np.concatenate([values[i] for i in pick]), row, stats[pick], edges
            )
            out, vx, total = raw_score(model, r, c, x)
            error = (sigmoid(out) - y[pick]) / len(pick)
            used, back = np.unique(c, return_inverse=True)
            dw = np.bincount(back, error[r] * x, len(used)) + decay * model["w"][used]
            each = (error[r] * x)[:, None] * (total[r] - vx)
            dv = np.stack([np.bincount(back, each[:, f], len(used)) for f in range(RANK)], axis=1) + decay * model["v"][used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += error.sum() ** 2
            model["w"][used] -= rate * dw / np.sqrt(gw[used])
            model["v"][used] -= 0.3 * rate * dv / np.sqrt(gv[used])
            model["w0"] -= rate * error.sum() / np.sqrt(g0)
    model["w"], model["v"] = model["w"].astype(np.float32), model["v"].astype(np.float32)
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            for part, texts in chunks([batch], "text", 2 << 20):
                if model is None:
                    p = np.full(len(texts), 0.5)
                else:
                    row, cell, value, stats = entries(texts, seen)
                    p = sigmoid(raw_score(model, *features(cell, value, row, stats, model["edges"]))[0].astype(float))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)),
                ], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


@query("op9_quality")
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
