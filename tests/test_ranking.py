"""Exact ranks, numbers and quotas where one bucket or one group holds the rows."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from groundscope.operators import catalog, dataset, ranking, retrieve, stats


def test_rank_inside_one_bucket_of_times(spark):
    rng = np.random.default_rng(1)
    times = 1_700_000_000_000_000 + rng.integers(0, 3_600_000_000, 60_000)
    values = [("a", int(t)) for t in times] + [("b", int(t)) for t in times[:7]] + [(None, 5), ("c", None)] + [("d", 3)] * 5000
    df = spark.createDataFrame(values, "k string, v long")
    for rank_of, place in ((lambda n: F.ceil(n * F.lit(0.95)), lambda n: -(-n * 95 // 100)), (lambda n: F.lit(1), lambda n: 1), (lambda n: n, lambda n: n)):
        got = {r["k"]: r["out"] for r in ranking.value_at_rank(df, ["k"], "v", rank_of, "out", most=500).collect()}
        groups = {k: sorted(v for g, v in values if g == k and v is not None) for k in ("a", "b", None, "d")}
        assert got == {k: g[place(len(g)) - 1] for k, g in groups.items()}


def test_rank_without_keys_and_of_reals(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=3000), -rng.lognormal(3, 9, 3000), np.full(3000, 0.125)]).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = ranking.value_at_rank(df, [], "v", lambda n: F.floor(n / 3), "out", most=100).first()["out"]
    assert got == sorted(values)[len(values) // 3 - 1]
    assert stats.p95_nearest(df.limit(0), [], "v").first()[0] is None


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(f"d{(i * 37) % 1000:04d}",) for i in range(1000)], "name string").repartition(5)
    got = {r["name"]: r["no"] for r in ranking.numbered(df, ["name"], "no").collect()}
    assert got == {f"d{i:04d}": i for i in range(1000)}
    assert ranking.numbered(df.limit(0), ["name"], "no").collect() == []


def test_quota_of_one_large_group(spark):
    n, quota = 1_000_000, 100_000
    rows = spark.range(n).select("id", F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.lit(quota).alias("quota"))
    got = ranking.first_by_hash(rows, ["lang"], "h", ["id"], "quota", "no")
    total, least, most, ranks, digest = got.agg(F.count("*"), F.min("no"), F.max("no"), F.count_distinct("no"), F.sum(F.col("id") * F.col("no") % 1_000_003)).first()
    order = sorted((hashlib.sha256(str(i).encode()).hexdigest(), i) for i in range(n))[:quota]
    assert (total, least, most, ranks) == (quota, 1, quota, quota)
    assert digest == sum(i * (r + 1) % 1_000_003 for r, (_, i) in enumerate(order))


def test_long_chain_of_duplicates_ends_in_few_rounds(spark, monkeypatch):
    n, cuts = 10_000, []
    own = dataset.cut_lineage
    monkeypatch.setattr(dataset, "cut_lineage", lambda df: cuts.append(1) or own(df))
    # Each row shares one key with the row before it and the other with the row after it.
    rows = spark.range(n).select(
        F.col("id").alias("idx"), F.floor(F.col("id") / 2).cast("string").alias("k1"), F.floor((F.col("id") + 1) / 2).cast("string").alias("k2"), F.lit(True).alias("valid")
    )
    kept = sorted(r["idx"] for r in dataset.greedy_dedupe(rows).collect())
    assert kept == list(range(0, n, 2)) and len(cuts) <= 2 * dataset.ROUNDS + 2


def test_null_keys_are_a_key(spark):
    rows = [(1, None, "a"), (2, None, "b"), (3, "x", None), (4, "y", None), (5, "x", "a"), (6, "z", "c")]
    df = spark.createDataFrame([(*r, True) for r in rows], "idx long, k1 string, k2 string, valid boolean")
    for rounds in (0, 9):
        assert sorted(r["idx"] for r in dataset.greedy_dedupe(df, rounds=rounds).collect()) == [1, 3, 6]


def test_paths_stay_in_their_database(spark):
    links = [("a", "x", "k", "y", "k"), ("a", "y", "k", "z", "k"), ("b", "x", "k", "w", "k"), ("b", "w", "k", "v", "k"), ("b", "v", "k", "z", "k"), ("b", "u", "k", "u", "k")]
    fks = spark.createDataFrame(links, "db_id string, src_table string, src_column string, dst_table string, dst_column string")
    paths = {(r["db_id"], r["start"], r["stop"]): r["path"] for r in catalog.shortest_paths(fks).collect()}
    assert paths["a", "x", "z"] == ["x", "y", "z"] and paths["b", "x", "z"] == ["x", "w", "v", "z"] and paths["b", "u", "u"] == ["u"]
    seeds = spark.createDataFrame([(1, "a", "x"), (1, "a", "z"), (2, "b", "x"), (2, "b", "z"), (3, "b", "lonely")], "question_id int, db_id string, table_name string")
    closed = {r["question_id"]: r["tables"] for r in catalog.closure(seeds, catalog.shortest_paths(fks)).collect()}
    assert closed == {1: ["x", "y", "z"], 2: ["v", "w", "x", "z"], 3: ["lonely"]}


def documents(spark, columns, described):
    rng = np.random.default_rng(columns)
    words = ["price", "order", "nation", "customer", "total", "name"]
    rows = []
    for i in range(columns):
        name = "_".join(rng.choice(words, 2, replace=False))
        rows.append((f"column:{i:03d}", "column", f"t{i % 4}", name, i, f"schema column {name}", f"the {rng.choice(words)}" if described or i % 3 else ""))
    rows += [(f"table:t{i}", "table", f"t{i}", None, 1000 + i, f"schema table {words[i % 6]}", "the table" if described else "") for i in range(9)]
    return spark.createDataFrame(rows, "doc_id string, kind string, table_name string, column_name string, position int, text string, description string")


def test_selection_from_blocks_equals_the_whole_lists(spark):
    asked = spark.createDataFrame([
        (1, "What is the total price of the schema?"), (2, "order total by customer name"), (3, "nothing at all"), (4, "schema"), (5, "Which nation name has the price_order?"), (6, "the"),
    ], "question_id int, question string")
    for columns, described in ((30, True), (120, True), (120, False)):
        docs = documents(spark, columns, described)
        fused = retrieve.fuse({
            "exact_identifier": retrieve.exact_ranking(asked, docs), "token_overlap": retrieve.lexical_ranking(asked, docs), "description_match": retrieve.description_ranking(asked, docs),
        }).withColumn("score", F.round("score", 12))
        wanted = retrieve.select_documents(fused, asked, docs).collect()
        got = retrieve.best_documents(asked, docs).collect()

        def plain(rows):
            return sorted((r["question_id"], r["kind"], r["rank"], r["doc_id"], r["score"], ",".join(r["reasons"] or [])) for r in rows)

        assert plain(got) == plain(wanted)
