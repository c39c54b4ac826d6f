"""Selection and grouping against sequential references."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundscope.operators import dataset, integrity
from groundscope.operators.relational import BudgetError, aligned, check_budget, restrict


def test_greedy_dedupe_equals_scan(spark):
    rng = random.Random(11)
    rows = [(i, f"q{rng.randint(0, 40)}", f"s{rng.randint(0, 40)}", rng.random() > 0.1) for i in range(400)]
    rows += [(1000 + i, "hot", f"s{i}", True) for i in range(200)]
    seen_q, seen_s, kept = set(), set(), []
    for i, q, s, valid in sorted(rows):
        if valid and q not in seen_q and s not in seen_s:
            seen_q.add(q), seen_s.add(s), kept.append(i)
    df = spark.createDataFrame(rows, "idx int, k1 string, k2 string, valid boolean").repartition(6)
    assert sorted(r["idx"] for r in dataset.greedy_dedupe(df).collect()) == kept


def test_near_duplicates_join_copies_and_close_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(80)] for _ in range(6)]
    texts, truth = [], {}
    for n, b in enumerate(base):
        for copy in range(5):
            changed = list(b)
            if copy >= 2:
                changed[copy * 7] = "changed"
            texts.append((len(texts), ("  " if copy == 1 else "") + " ".join(changed)))
            truth[len(texts) - 1] = n
    got = {r["id"]: r["group_id"] for r in dataset.near_duplicate_groups(spark.createDataFrame(texts, "id long, text string")).collect()}
    for i in truth:
        assert got[i] == min(j for j in truth if truth[j] == truth[i])


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 150)]
    labels = {r["node"]: r["label"] for r in dataset.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {labels[i] for i in range(31)} == {0} and {labels[i] for i in (100, 150, 200)} == {100}


def test_roles_do_not_depend_on_input_order(spark):
    names = [(f"db{i}",) for i in range(58)]
    roles = [("train", 45), ("validation", 6), ("development", 7)]
    results = []
    for rows in (names, names[::-1]):
        df = spark.createDataFrame(rows, "db string")
        results.append({r["db"]: r["role"] for r in dataset.assign_roles(df, "db", roles, 20260923).collect()})
    assert results[0] == results[1]
    counted = list(results[0].values())
    assert [counted.count(r) for r, _ in roles] == [45, 6, 7]


def test_group_crossing_roles_fails(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "b")], "group_id string, role string")
    with pytest.raises(Exception, match="crosses"):
        dataset.assert_disjoint(df, "group_id").collect()


def test_diversity_and_alignment_fail_loudly(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "case_id int, db string")
    assert dataset.assert_diverse(df, "db", 2, 2).first()["databases"] == 2
    with pytest.raises(Exception, match="diverse"):
        dataset.assert_diverse(df, "db", 3).collect()
    with pytest.raises(Exception, match="ids differ"):
        aligned(df, spark.createDataFrame([(1, "x")], "case_id int, o string"), "case_id").collect()


def test_budget_refuses_instead_of_truncating(spark):
    assert check_budget(spark.range(10)).count() == 10
    with pytest.raises(BudgetError):
        check_budget(spark.range(10_001))
    with pytest.raises(BudgetError):
        check_budget(spark.range(1).select(*[F.lit(1).alias(f"c{i}") for i in range(65)]))


def test_empty_restriction_means_all(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert restrict(df, df.limit(0), ["k"]).count() == 2
    assert restrict(df, df.filter("k = 1"), ["k"]).count() == 1


def test_fingerprint_ignores_order_and_notices_change(spark):
    df = spark.createDataFrame([(i, f"v{i}", None if i % 3 else "") for i in range(50)], "i int, v string, n string")
    prints = [integrity.table_fingerprint(d, "t").first()["fingerprint"] for d in (df, df.repartition(5), df.withColumn("v", F.lit("x")))]
    assert prints[0] == prints[1] != prints[2]


def test_locked_roles_and_unknown_paths_are_refused(spark):
    log = spark.createDataFrame([("development", "me")], "role string, actor string")
    assert integrity.check_exposure(log, "development", ["final"]) == 1
    with pytest.raises(integrity.LockedRoleError):
        integrity.check_exposure(log, "final", ["final"])
    records = spark.createDataFrame([(1, "/a/x.db")], "id int, path string")
    contents = spark.createDataFrame([("/b/x.db", "f")], "path string, fingerprint string")
    with pytest.raises(Exception, match="unknown file path"):
        integrity.portable_fingerprint(records, "path", contents, "r").collect()


def test_chains_of_near_copies_stay_whole(spark):
    import random

    rng, texts = random.Random(5), []
    for n in range(20):
        words = [f"c{n}w{i}" for i in range(40)]
        first, second = words[:], words[:]
        first[0], second[-1] = "x", "y"
        texts += [(10 * n, " ".join(first)), (10 * n + 1, " ".join(words)), (10 * n + 2, " ".join(second))]
    rng.shuffle(texts)
    frame = spark.createDataFrame(texts, "id long, text string")
    got = {r["id"]: r["group_id"] for r in dataset.near_duplicate_groups(frame, 0.9).collect()}
    assert all(got[i] == i // 10 * 10 for i, _ in texts)


def test_bands_of_many_texts_at_once_are_those_of_each_text():
    rng = np.random.default_rng(3)
    factor, shift = (rng.integers(1, 1 << 62, dataset.BANDS * dataset.BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    sizes = [1, 5, dataset.HASHED_RUNS, 2, dataset.HASHED_RUNS + 1, 7, 1]
    rows = [np.unique(rng.integers(-(1 << 62), 1 << 62, n)) for n in sizes]
    found = dataset._minimum_bands(rows, factor, shift)
    assert dataset._minimum_bands([], factor, shift) == [] and len(found) == len(rows)
    for row, got in zip(rows, found):
        mixed = [(row.view(np.uint64) ^ s) * f for f, s in zip(factor, shift)]
        least = np.array([(m ^ (m >> np.uint64(32))).min() for m in mixed]).reshape(dataset.BANDS, dataset.BAND_ROWS)
        digest = np.arange(dataset.BANDS, dtype=np.uint64)
        for part in least.T:
            digest = (digest ^ part) * np.uint64(0x9E3779B97F4A7C15)
            digest ^= digest >> np.uint64(29)
        assert got.tolist() == digest.view(np.int64).tolist()
