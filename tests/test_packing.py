"""Packing, ranking and similarity search against sequential references."""

import random

import numpy as np
from pyspark.sql import functions as F

from groundscope.operators import packing, ranking, retrieve, stats


def fold(items, budget, limit, separator, base):
    used, kept = base, []
    for key, size in items:
        cost = size + (separator if kept else 0)
        if (limit is None or len(kept) < limit) and used + cost <= budget:
            used += cost
            kept.append(key)
    return kept


def test_greedy_pack_equals_fold(spark):
    rng = random.Random(7)
    rows = [(g, i, rng.choice([3, 5, 8, 13, 40])) for g in range(6) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, size int").repartition(7)
    for limit, separator, base in [(12, 1, 0), (None, 0, 10), (5, 1, 2)]:
        got = {}
        for r in packing.greedy_pack(df, ["g"], [F.col("i")], "size", 100, limit, separator, base).orderBy("g", "position").collect():
            got.setdefault(r["g"], []).append(r["i"])
        expected = {g: fold([(i, s) for gg, i, s in rows if gg == g], 100, limit, separator, base) for g in range(6)}
        assert got == expected


def test_prefix_pack_stops_at_overflow(spark):
    df = spark.createDataFrame([(1, 0, 60), (1, 1, 50), (1, 2, 1)], "g int, i int, size int")
    got = packing.prefix_pack(df, ["g"], [F.col("i")], "size", 100, separator=1).collect()
    assert [r["i"] for r in got] == [0]


def test_value_at_rank_is_exact(spark):
    rng = random.Random(3)
    values = [(k, rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-2, 4)) for k in "ab" for _ in range(999)]
    df = spark.createDataFrame(values, "k string, v double").repartition(5)
    got = {r["k"]: r["p"] for r in stats.p95_nearest(df, ["k"], "v", "p").collect()}
    for k in "ab":
        ordered = sorted(v for kk, v in values if kk == k)
        assert got[k] == ordered[int(np.ceil(0.95 * len(ordered))) - 1]


def test_hash_rank_and_running_sum(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    ranked = ranking.hash_rank(df, ["k"], "h", "r", ["id"]).collect()
    for k in (0, 1):
        ordered = sorted((r["h"], r["id"]) for r in ranked if r["k"] == k)
        assert [i for _, i in ordered] == [r["id"] for r in sorted((r for r in ranked if r["k"] == k), key=lambda r: r["r"])]
    sums = ranking.running_sum(df, ["k"], F.floor(F.col("id") / 100), ["id"], "id", "s").filter("id = 2001").first()
    assert sums["s"] == sum(range(1, 2002, 2))


def test_blocked_dense_ranking_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    docs, asked = rng.normal(size=(90, 8)), rng.normal(size=(40, 8))
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "doc_id int, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "question_id int, vector array<double>")
    expected = {i: np.argsort(-(docs @ v), kind="stable")[:5].tolist() for i, v in enumerate(asked)}
    for block in (4096, 16):
        monkeypatch.setattr(retrieve, "BLOCK_ROWS", block)
        got = {}
        for r in retrieve.dense_ranking(q, d, 5).orderBy("question_id", "rank").collect():
            got.setdefault(r["question_id"], []).append(r["doc_id"])
        assert got == expected


def test_fusion_constant(spark):
    ranking_a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "question_id int, doc_id string, rank int")
    ranking_b = spark.createDataFrame([(1, "y", 1)], "question_id int, doc_id string, rank int")
    scores = {r["doc_id"]: r["score"] for r in retrieve.fuse({"a": ranking_a, "b": ranking_b}).collect()}
    assert abs(scores["x"] - 1 / 61) < 1e-12 and abs(scores["y"] - (1 / 62 + 1 / 61)) < 1e-12


def test_bootstrap_is_deterministic_and_brackets(spark):
    rows = [(f"g{i % 9}", i, i % 3 == 0, i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int, l boolean, r boolean")
    first, second = (stats.group_bootstrap(df.repartition(n), "g", "l", "r", 200).first() for n in (2, 7))
    assert first == second and first["low"] <= first["delta"] <= first["high"] and first["groups"] == 9
    case = stats.case_bootstrap(df, "id", F.col("r").cast("int"), 100).first()
    assert case["low"] <= case["delta"] <= case["high"]


def test_rows_without_cost_are_never_cut(spark):
    rows = [(0, i, 0) for i in range(30)] + [(0, 30, 5), (0, 31, 6), (0, 32, 0)]
    df = spark.createDataFrame(rows, "g int, i int, size int")
    got = packing.prefix_pack(df, ["g"], [F.col("i")], "size", 10).collect()
    assert sorted((r["i"], r["position"], r["bytes_used"]) for r in got) == [*((i, i + 1, 0) for i in range(30)), (30, 31, 5)]
    kept = packing.greedy_pack(df, ["g"], [F.col("i")], "size", 10).collect()
    assert sorted(r["i"] for r in kept) == [*range(31), 32]


def test_rows_of_size_zero_pay_the_separator(spark):
    df = spark.createDataFrame([(0, i, 0) for i in range(30)], "g int, i int, size int")
    got = packing.prefix_pack(df, ["g"], [F.col("i")], "size", 10, separator=1).collect()
    assert sorted(r["i"] for r in got) == list(range(11)) and max(r["bytes_used"] for r in got) == 10


def test_percentiles_keep_long_values(spark):
    base = 1 << 60
    df = spark.createDataFrame([(0, base + i) for i in range(100)], "k int, v long")
    assert stats.p95_nearest(df, ["k"], "v", "p").first()["p"] == base + 94


def test_bootstrap_of_many_groups(spark):
    df = spark.range(100_000).select(F.col("id").cast("string").alias("g"), (F.col("id") % 3 == 0).alias("l"), (F.col("id") % 2 == 0).alias("r"))
    got = stats.group_bootstrap(df, "g", "l", "r", 40).first()
    assert got["groups"] == 100_000 and abs(got["delta"] - 1 / 6) < 1e-4
    assert got["low"] < got["delta"] < got["high"] and got["high"] - got["low"] < 0.02
