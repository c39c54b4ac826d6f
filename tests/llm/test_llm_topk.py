"""Operator 13 against all inner products in Python's integers."""

import math

import numpy as np

from groundscope.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, k=10, every=100):
    good = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, v in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
            out.setdefault(q, []).extend((r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]))
    return {q: sorted(x) for q, x in out.items() if x}


def found(spark, rows, **more):
    out = {}
    for r in topk.search(spark.createDataFrame([(i, v, 1, "s") for i, v in rows], SCHEMA), **more).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def test_whole_table_in_one_and_in_many_blocks(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table.collect()]
    wanted = brute(rows, every=10)
    assert found(spark, rows, every=10) == wanted
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "PACK", 7)
    assert found(spark, rows, every=10) == wanted


def test_bounds_drop_candidates_and_keep_the_best():
    rng = np.random.default_rng(4)
    columns = np.floor(rng.normal(size=(64, 5000)) * 100 * np.exp(-np.arange(64) / 8)[:, None])
    for _ in range(20):
        asked = np.floor(rng.normal(size=64) * 100 * np.exp(-np.arange(64) / 8))
        rows, score = topk.survivors(asked, columns, np.arange(5000), (columns * columns).sum(axis=0), 10)
        exact = asked @ columns
        assert (score == exact[rows]).all() and len(rows) < 2500
        assert set(np.flatnonzero(exact >= topk.kth(exact, 10))) <= set(rows)


def test_ties_copies_lengths_and_bad_vectors(spark):
    same = [0.5, 0.25, 1.0]
    rows = [(i, same) for i in range(1, 301)] + [(0, same), (0, same), (300, None), (400, [0.0, 0.0, 0.0]), (500, [1.0, None, 2.0])]
    rows += [(600, [math.nan, 1.0, 1.0]), (700, [math.inf, 1.0, 1.0]), (800, [1.0]), (801, [-2.0]), (900, []), (901, []), (None, same), (1000, [7.0, 7.0])]
    rows += [(1100, [-0.0004, 0.3, -5.0]), (1101, [0.3, -0.3]), (1102, [0.1, 0.2])]
    assert found(spark, rows) == brute(rows)


def test_great_numbers_are_exact(spark):
    rows = [(0, [1e9, 3e8, -1e9]), (1, [1e9, 1.0, 1e9]), (2, [1e9, 2.0, 1e9]), (3, [1e12, -1e12, 1e-3]), (100, [2e6, 1.0, 0.0])]
    wanted = {q: [(r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for r, i, s in x] for q, x in brute(rows).items()}
    assert {q: {(i, s) for _, i, s in x} for q, x in found(spark, rows).items()} == {q: {(i, s) for _, i, s in x} for q, x in wanted.items()}


def test_few_and_none(spark):
    assert found(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])]) == brute([(0, [1.0, 2.0]), (1, [1.0, 3.0])])
    assert topk.search(spark.createDataFrame([], SCHEMA)).collect() == []
