"""Profiles, value index and formats on small fixtures with known numbers."""

import re

from pyspark.sql import functions as F

from groundscope.functions import text
from groundscope.operators import profile


def schools(spark):
    return spark.createDataFrame(
        [(1, "PRI", "2015/2016", "$1,200"), (2, "PUB", "2014/2015", "900"), (3, "PUB", "2015/2016", "1,050")],
        "id int, school_type string, season string, amount string",
    )


def test_counts_and_values(spark):
    counts = profile.value_counts({"schools": schools(spark)})
    row = profile.column_counts(counts).filter("column_name = 'school_type'").first()
    assert (row["row_count"], row["distinct_count"], row["categorical"], row["null_count"]) == (3, 2, True, 0)
    values = profile.top_values(counts).filter("column_name = 'school_type'").collect()
    assert {(v["value"], v["frequency"], v["scope"]) for v in values} == {("PUB", 2, "all_distinct"), ("PRI", 1, "all_distinct")}
    number = profile.column_counts(counts).filter("column_name = 'id'").first()
    assert (number["numeric_min"], number["numeric_max"]) == (1.0, 3.0)


def test_native_numbers_are_never_printed_numbers(spark):
    index = profile.value_index(profile.top_values(profile.value_counts({"schools": schools(spark)})))
    assert index.filter("column_name = 'id' AND pattern IS NOT NULL").count() == 0
    amounts = {r["original"]: (r["pattern"], r["numeric_value"]) for r in index.filter("column_name = 'amount'").collect()}
    assert amounts == {"$1,200": ("currency", 1200.0), "900": ("numeric_text", 900.0), "1,050": ("numeric_text", 1050.0)}


def test_many_distinct_values_keep_the_first_25(spark):
    items = spark.range(150).select(F.col("id").cast("int"), F.format_string("ZZZ%03d", "id").alias("code"))
    top = profile.top_values(profile.value_counts({"items": items})).filter("column_name = 'code'").collect()
    assert sorted(r["value"] for r in top) == [f"ZZZ{i:03d}" for i in range(25)]
    assert {r["scope"] for r in top} == {"top_frequency"}


def test_nulls_types_and_clash_after_cut(spark):
    long = "x" * 600
    df = spark.createDataFrame([(None,), (long + "a",), (long + "b",), (long + "b",)], "t string")
    counts = profile.value_counts({"t": df})
    types = {r["type"]: r["n"] for r in profile.type_histogram(counts).collect()}
    assert types == {"null": 1, "text": 3}
    index = profile.value_index(profile.top_values(counts)).collect()
    assert [(len(r["original"]), r["frequency"]) for r in index] == [(500, 2)]


def test_format_tags(spark):
    apps = spark.createDataFrame(
        [("1,000+", "0", "$1,200.00", "2026/08/01"), ("900+", "1.99", "$900.00", "2026/08/02")], "installs string, price string, salary string, created string"
    )
    row = apps.agg(*[text.format_tags(F.collect_list(c)).alias(c) for c in apps.columns]).first()
    assert set(row["installs"]) >= {"thousands_separator", "plus_suffix"}
    assert "currency_text" in row["salary"] and "date_text" in row["created"] and "numeric_text" in row["price"]


def test_interpretation_edge_cases(spark):
    df = spark.createDataFrame([("12.3.4%",), ("US$57,500.00",), ("2020-1-2 10:00",), ("9:30 PM",), ("+5",), (" $ 7 ",)], "v string")
    rows = {r["v"]: (r["p"], r["n"]) for r in df.select("v", text.value_pattern("v").alias("p"), text.value_number("v").alias("n")).collect()}
    assert rows["12.3.4%"] == ("percentage", None)
    assert rows["US$57,500.00"] == (None, None)
    assert rows["2020-1-2 10:00"] == ("date", None)
    assert rows["9:30 PM"] == ("time", None)
    assert rows["+5"] == ("numeric_text", 5.0)
    assert rows[" $ 7 "] == ("currency", 7.0)


def test_text_functions(spark):
    df = spark.createDataFrame([("  Yes \n  No ", "userNames_idStreets", "Straße")], "a string, b string, c string")
    row = df.select(
        text.normalize("a").alias("a"), text.identifier_tokens("b").alias("b"), text.normalize("c").alias("c"),
        text.char_ngrams("c").alias("g"), text.char_ngrams("a", 9).alias("short"),
    ).first()
    assert row["a"] == "yes no"
    assert row["b"] == ["user", "name", "id", "street"]
    assert row["c"] == "strasse"
    assert row["g"] == sorted({"str", "tra", "ras", "ass", "sse"})
    assert row["short"] == ["yesno"]


def test_sampled_profile(spark):
    df = spark.createDataFrame([(i, "v%d" % (i % 3) if i % 5 else None) for i in range(120)], "id int, v string")
    row = profile.sampled_profile(df, "t", ["id"], ["v"]).first()
    assert (row["row_count"], row["sample_size"], row["distinct_count"], row["distinct_count_is_sampled"]) == (120, 100, 3, True)
    assert row["null_fraction"] == 0.2 and row["sample_values"] == ["v1", "v2", "v0"]


def test_relevant_profiles(spark):
    prof = spark.createDataFrame(
        [("stores", "region", [], ["WI", "CA"], ["WI", "CA"]), ("apps", "price", ["numeric_text"], ["0"], ["0"]), ("apps", "name", [], ["Alpha"], ["Alpha"])],
        "table_name string, column_name string, format_tags array<string>, categorical_values array<string>, sample_values array<string>",
    )
    asked = spark.createDataFrame([("q", "which region has alpha")], "question_id string, question string")
    rows = profile.relevant_profiles(asked, prof).orderBy("rank").collect()
    assert [(r["table_name"], r["column_name"], r["score"]) for r in rows] == [("stores", "region", 4), ("apps", "name", 3), ("apps", "price", 1)]


def test_value_counts_equal_a_plain_count(spark):
    # Few and many values, exactly the limit and one more, nulls, quotes, long texts, both zeros, nested values.
    rows = [
        (i % 100, i % 101, i, f"it's \\ {i % 3}" if i % 4 else None, "x" * (300 if i == 7 else 3), 0.0 if i % 2 else -0.0, 2e7 * (i % 2), bool(i % 2), [i % 5], None)
        for i in range(1500)
    ]
    schema = "few long, more int, key long, quoted string, long string, zero double, great double, flag boolean, nested array<int>, empty string"
    df = spark.createDataFrame(rows, schema).withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("key") % 7).cast("int")))
    got = {}
    for r in profile.value_counts({"t": df}).collect():
        assert (r["column_name"], r["value"]) not in got
        got[r["column_name"], r["value"]] = (r["frequency"], r["storage"], r["number"])
    expected = {}
    for f in df.schema.fields:
        if f.name != "nested":
            shown = F.when(F.col("zero") == 0, "0.0") if f.name == "zero" else profile.printed(F.col(f.name), f.dataType)
            number = F.col(f.name).cast("double") if f.name in ("few", "more", "key", "zero", "great") else F.lit(None).cast("double")
            for r in df.groupBy(shown.alias("v"), F.abs(number).alias("x")).count().collect():
                expected[f.name, r["v"]] = (r["count"], profile.storage_class(f.dataType), r["x"])
    nested = [v for (c, _), v in got.items() if c == "nested"]
    assert nested == [(300, "unsupported", None)] * 5
    assert {k: v for k, v in got.items() if k[0] != "nested"} == expected


def test_many_values_are_exchanged_by_themselves(spark):
    # Rows that carry the names and empty places of other kinds took most of the time and of a task's memory.
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    df = spark.range(300).select("id", (F.col("id") / 4).alias("part"), day.alias("day"), day.cast("timestamp_ntz").alias("at"), F.when(F.col("id") > 1, F.col("id").cast("decimal(9,2)")).alias("exact"))
    counts = profile.value_counts({"t": df})
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    assert plan.count("Aggregate [v#") == 5 and "Aggregate [table_name" not in plan
    for f in df.schema.fields:
        number = F.col(f.name).cast("double") if f.name in ("id", "part", "exact") else F.lit(None).cast("double")
        expected = df.groupBy(profile.printed(F.col(f.name), f.dataType).alias("value"), number.alias("number")).count().collect()
        got = counts.filter(F.col("column_name") == f.name).select("value", "number", "frequency").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, expected)))


def test_tasks_of_a_column_follow_its_size(spark, monkeypatch):
    # Tens of millions of values of a key came to one task, as small partitions are merged.
    monkeypatch.setattr(profile, "TASK_ROWS", 1000)
    monkeypatch.setattr(profile, "TASK_BYTES", 20_000)
    i = F.col("id")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (i % 500).cast("int"))
    real = F.when(i % 3 == 0, 0.0).when(i % 3 == 1, -0.0).when(i % 5 == 0, float("nan")).when(i % 7 != 0, i / 4)
    monkeypatch.setattr(profile, "DEALT", 2)
    df = spark.range(8000).select(
        "id", real.alias("real"), F.when(i % 2 == 0, i % 400).alias("hot"), day.alias("day"), day.cast("timestamp_ntz").alias("at"),
        F.concat(F.lit("x" * 30), (i % 300).cast("string")).alias("name"), (i % 9).alias("few"), i.cast("decimal(9,2)").alias("exact"), F.array(i % 300).alias("nested"),
        F.concat(F.lit("y" * 300), (i % 300).cast("string")).alias("long"),
    )
    counts = profile.value_counts({"t": df})
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    tasks = sorted(int(n) for n in re.findall(r"RepartitionByExpression \[.*\], (\d+)", plan))
    # Numbers of values are estimated; hot, day, at and name have few enough for one task.
    assert len(tasks) == 5 and tasks[0] == 4 and 7 <= tasks[1] <= tasks[2] <= 9 and tasks[3] == 26 and 115 <= tasks[4] <= 125
    for f in df.schema.fields:
        zero = F.when(F.col("real") == 0, 0.0).otherwise(F.col("real")) if f.name == "real" else F.col(f.name)
        shown = profile.printed(zero, f.dataType)
        expected = df.groupBy((F.sha2(shown, 256) if f.name == "nested" else shown).alias("value")).count().collect()
        got = counts.filter(F.col("column_name") == f.name).select("value", "frequency").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, expected))), f.name
    assert counts._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") == 4


def test_a_profile_prints_texts_only(spark, monkeypatch):
    # All values were printed, written and ranked, though only texts have printed shapes.
    df = spark.range(300).select("id", (F.col("id") / 7).alias("part"), F.when(F.col("id") > 2, F.concat(F.lit("$"), F.col("id"))).alias("price"), (F.col("id") > 9).alias("flag"))
    ranked = []
    top = profile.top_values
    monkeypatch.setattr(profile, "top_values", lambda counts: (ranked.append({r[0] for r in counts.select("column_name").distinct().collect()}), top(counts))[1])
    counts = profile.value_counts({"t": df})
    plan = counts.groupBy("column_name").agg(F.count_if("present"))._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(20,0)" not in plan
    catalog = spark.createDataFrame([("t", c, "x") for c in (*df.columns, "none")], "table_name string, column_name string, type string")
    rows = {r["column_name"]: r for r in profile.column_profile(counts, catalog).collect()}
    assert ranked == [{"price"}]
    assert {c: r["types"] for c, r in rows.items()} == {
        "id": {"integer": 300}, "part": {"real": 300}, "price": {"null": 3, "text": 297}, "flag": {"integer": 300}, "none": None,
    }
    assert {c: (r["currency_rate"], r["distinct_count"], r["numeric_max"]) for c, r in rows.items()} == {
        "id": (0.0, 300, 299.0), "part": (0.0, 300, 299 / 7), "price": (1.0, 297, None), "flag": (0.0, 2, None), "none": (0.0, 0, None),
    }
