import numpy as np

from groundscope.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=10, every=100):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.float32(w).astype(float) - np.float32(v).astype(float)) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = near[:k]
    return out


def test_recall_and_order(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    wanted, got = brute(rows, every=10), {}
    for r in sorted(ann.search(table, every=10).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert got.keys() == wanted.keys()
    hits = sum(len({i for _, i in wanted[q]} & {i for _, i in got[q]}) for q in wanted)
    assert hits >= 0.9 * sum(map(len, wanted.values()))
    for near in got.values():
        assert len(near) == 10 and near == sorted(near)


def test_blocks_return_the_same(spark, monkeypatch):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one = {(r["query_id"], r["rank"]): r["score"] for r in ann.search(table).collect()}
    monkeypatch.setattr(ann, "BLOCK", 30)
    several = {(r["query_id"], r["rank"]): r["score"] for r in ann.search(table).collect()}
    assert one.keys() == several.keys() and all(several[k] <= one[k] + 1e-12 for k in one)


def test_ties_and_bad_vectors(spark):
    same = [0.5, 0.25, 1.0]
    rows = [(i, same, 0, "s") for i in range(300)] + [(300, None, 0, None), (400, [0.0, 0.0, 0.0], 1, None), (500, [1.0, None, 2.0], 1, None)]
    rows += [(600, [float("nan"), 1.0, 1.0], 1, None), (700, [float("inf"), 1.0, 1.0], 1, None), (800, [1.0], 1, None), (803, [3.0], 1, None), (None, same, 1, None), (801, [], 1, None), (0, same, 0, "s")]
    got = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(i, 0.0) for i in range(1, 11)], 100: [(i, 0.0) for i in range(10)], 200: [(i, 0.0) for i in range(10)], 800: [(803, 2.0)]}
    few = spark.createDataFrame([(0, [1.0, 2.0], 0, ""), (1, [1.0, 3.0], 0, ""), (2, [4.0, 2.0], 0, "")], SCHEMA)
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.search(few).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 3.0)]
    assert ann.search(few.limit(0)).count() == 0


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist(), 0, "") for i in range(300)] + [(1000 + i, rng.normal(size=2).tolist(), 0, "") for i in range(200)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == {0, 100, 200, 1000, 1100}
    assert all(len(near) == 10 and {i >= 1000 for i in near} == {q >= 1000} for q, near in got.items())
