"""Column profiles and the value index.

Values are counted in two steps. One aggregate per table, without an exchange of values, sketches the frequent
values of every column; columns with few values come out of it whole, and a second scan proves that by counting
what the list does not hold. Only the other columns are exchanged, each by itself: a task holds the values of one
column in their own type, without the names of table and column, combines them map-side, and prints each distinct
value once. Every statistic below reads these counts. A column of more than about ``TASK_ROWS`` values or ``TASK_BYTES`` of
long texts is exchanged over a number of tasks that follows its size, which adaptive coalescing leaves alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundscope.functions import text
from groundscope.operators.joins import join_few, spread
from groundscope.operators.ranking import top_k
from groundscope.session import cut_lineage

KEY = ["table_name", "column_name"]
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
REAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)

# Index size rules.
CATEGORICAL_LIMIT = 100
TOP_VALUES = 25
ORIGINAL_LENGTH = 500

#: Frequent values asked from a sketch, values that it tracks, and the longest text that it holds.
SKETCH_VALUES, SKETCH_SIZE, SKETCHED_LENGTH = 128, 1024, 256
#: Rows that may show before the sketch that a column has too many values for a list.
HEAD_ROWS = 20_000
#: Values of a column, and bytes of their long texts, that one task counts.
TASK_ROWS, TASK_BYTES = 500_000, 1 << 26
#: Times ``TASK_ROWS`` rows at most for a task, if a column needs several: values that recur may hardly be combined before.
DEALT = 8


def storage_class(data_type: T.DataType) -> str | None:
    """The storage class of a Spark type; nested types have none and count as unsupported."""
    if isinstance(data_type, INTEGER_TYPES):
        return "integer"
    if isinstance(data_type, REAL_TYPES):
        return "real"
    if isinstance(data_type, T.BinaryType):
        return "blob"
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return None
    return "text"


def printed(column: Column, data_type: T.DataType) -> Column:
    """A value as text. Whole doubles above 1e7 are printed without an exponent."""
    if isinstance(data_type, T.BinaryType):
        return F.hex(column)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    plain = column.cast("string")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        whole = (F.abs(column) >= 1e7) & (F.abs(column) < 1e15) & (column == F.floor(column))
        return F.when(whole, F.concat(column.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(plain)
    return plain


def _fields(df: DataFrame, columns: Sequence[str] | None) -> list[T.StructField]:
    return [f for f in df.schema.fields if columns is None or f.name in columns]


def _own(name: str) -> Column:
    return F.col(f"`{name}`")


def _sketched(field: T.StructField) -> str | None:
    """The values of a column that a sketch may hold, as SQL: long texts are left out, the two zeros are one."""
    name = f"`{field.name}`"
    if isinstance(field.dataType, T.StringType):
        return f"CASE WHEN length({name}) <= {SKETCHED_LENGTH} THEN {name} END"
    if isinstance(field.dataType, T.DoubleType):
        return f"CASE WHEN {name} = 0 THEN 0.0D ELSE {name} END"
    return name if isinstance(field.dataType, (*INTEGER_TYPES, T.DateType)) else None


def _quoted(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _many_values(tables: dict[str, DataFrame], fields: dict[str, list[T.StructField]]) -> set[tuple[str, str]]:
    """Columns with more than ``CATEGORICAL_LIMIT`` values in some rows of the table already: they need no sketch."""
    heads = []
    for t, df in tables.items():
        if some := [f for f in fields[t] if _sketched(f)]:
            head = df.selectExpr(*[f"{_sketched(f)} AS `{f.name}`" for f in some]).limit(HEAD_ROWS)
            found = ", ".join(f"struct({_quoted(f.name)} AS column_name, size(collect_set(`{f.name}`)) AS n)" for f in some)
            heads.append(head.selectExpr(f"{_quoted(t)} AS table_name", f"array({found}) AS columns"))
    rows = _union(heads).collect() if heads else []
    return {(row["table_name"], r["column_name"]) for row in rows for r in row["columns"] if r["n"] > CATEGORICAL_LIMIT}


def _size(field: T.StructField, many: bool) -> str:
    """Two estimates for a column, as SQL: how many values, never far too few, and how many bytes of those that are not short."""
    if storage_class(field.dataType) is None:
        return "count(*) AS values, count(*) * 64 AS size"
    column = _sketched(field)
    values = f"approx_count_distinct({column or f'`{field.name}`'})" if many or column is None else "count(*)"
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        long = f"octet_length(`{field.name}`) > {SKETCHED_LENGTH}"
        more = f" + count_if({long})" if column else ""
        return f"{values}{more} AS values, coalesce(sum(CASE WHEN {long} THEN bigint(octet_length(`{field.name}`)) END), 0L) AS size"
    return f"{values} AS values, 0L AS size"


def _frequent(df: DataFrame, table: str, fields: Sequence[T.StructField], many: set[tuple[str, str]]) -> DataFrame:
    """One row: for each column the rows, the non-null rows, its size and, unless it has ``many`` values, the frequent ones with
    estimated counts, by one aggregate."""
    found = []
    for f in fields:
        column = None if (table, f.name) in many else _sketched(f)
        top = "null" if column is None else f"approx_top_k({column}, {SKETCH_VALUES}, {SKETCH_SIZE})"
        found.append(
            f"struct({_quoted(f.name)} AS column_name, count(*) AS rows, count(`{f.name}`) AS present, {_size(f, (table, f.name) in many)},"
            f" CAST({top} AS array<struct<item: string, count: bigint>>) AS items)"
        )
    return df.selectExpr(f"{_quoted(table)} AS table_name", f"array({', '.join(found)}) AS columns")


def _shown(raw: str, data_type: T.DataType) -> str:
    """``printed`` for a value that is text already."""
    if isinstance(data_type, T.DoubleType) and 1e7 <= abs(float(raw)) < 1e15 and float(raw).is_integer():
        return f"{int(float(raw))}.0"
    return raw


def _few_values(
    tables: dict[str, DataFrame], columns: Sequence[str] | None
) -> tuple[dict[tuple[str, str], tuple[int, dict[str, int]]], dict[tuple[str, str], int]]:
    """(nulls, rows of each value) of the columns whose sketch holds every value, at most ``CATEGORICAL_LIMIT`` of them;
    and the number of tasks that every column is counted in.

    A sketched count is never too small. So if no row has a value outside the list, and the counts add up to
    the rows, each of them is exact.
    """
    fields = {t: _fields(df, columns) for t, df in tables.items()}
    many = _many_values(tables, fields)
    likely, tasks = {}, {}
    for row in _union([_frequent(df, t, fields[t], many) for t, df in tables.items()]).collect():
        for r in row["columns"]:
            key = row["table_name"], r["column_name"]
            tasks[key] = max(1, math.ceil(r["values"] / TASK_ROWS), math.ceil(r["size"] / TASK_BYTES))
            if tasks[key] > 1:
                tasks[key] = max(tasks[key], math.ceil(r["rows"] / (DEALT * TASK_ROWS)))
            # The sketch counts nulls like a value.
            items = None if r["items"] is None else {x["item"]: x["count"] for x in r["items"] if x["item"] is not None}
            if r["present"] == 0 or items is not None and len(items) <= CATEGORICAL_LIMIT and sum(items.values()) == r["present"]:
                likely[key] = (r["rows"] - r["present"], items or {})
    checks = []
    for t, df in tables.items():
        outside = []
        for f in fields[t]:
            if values := likely.get((t, f.name), (0, {}))[1]:
                listed = ", ".join(f"CAST({_quoted(raw)} AS {f.dataType.simpleString()})" for raw in values)
                outside.append(f"struct({_quoted(f.name)} AS column_name, count_if(`{f.name}` IS NOT NULL AND coalesce({_sketched(f)} NOT IN ({listed}), true)) AS n)")
        if outside:
            checks.append(df.selectExpr(f"{_quoted(t)} AS table_name", f"array({', '.join(outside)}) AS columns"))
    more = {(row["table_name"], r["column_name"]) for row in _union(checks).collect() for r in row["columns"] if r["n"]} if checks else set()
    return {k: r for k, r in likely.items() if k not in more}, tasks


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _combine(real: bool) -> Callable:
    """Rows per value of ``TASK_ROWS`` rows or ``TASK_BYTES`` at a time; a double is known by its bits, the two zeros are one."""
    most_rows, most_bytes = TASK_ROWS, TASK_BYTES

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(held).group_by("v", use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        for batch in found.select(["v", "count_all"]).to_batches():
            v, n = batch.columns
            if real:
                v = pc.add(v, 0.0)
                v = pc.if_else(pc.is_nan(v), float("nan"), v)
            yield pa.RecordBatch.from_arrays([v.view(pa.int64()) if real else v, v, n], ["k", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= most_rows or size >= most_bytes:
                yield from counted(held)
                held, rows, size = [], 0, 0
        if held:
            yield from counted(held)

    return run


def _frequencies(values: DataFrame, tasks: int) -> DataFrame:
    """(v, frequency) of the column ``v``, counted in so many tasks.

    If the values fit one task, a plain aggregate combines them in the scan. For more of them it would leave the number of
    tasks to the planner, which merges them until a column of tens of millions of values is in one. Rows are combined
    before they are dealt, so a frequent value sends a few rows to its task.
    """
    if tasks == 1:
        return values.groupBy("v").agg(F.count("*").alias("frequency"))
    kind = values.schema["v"].dataType
    real = isinstance(kind, T.DoubleType)
    # Grouped by its bits, as grouping by a double is not seen to agree with how its rows were dealt.
    parts = values.mapInArrow(_combine(real), f"k {'long' if real else kind.simpleString()}, v {kind.simpleString()}, n long")
    dealt = parts.select("k", "v", "n") if real else parts.select(F.col("v").alias("k"), "n")
    counted = dealt.repartition(tasks, "k").groupBy("k").agg(F.sum("n").alias("frequency"), *([F.first("v").alias("v")] if real else []))
    return counted.select("v" if real else F.col("k").alias("v"), "frequency")


def _rows_per_value(df: DataFrame, table: str, field: T.StructField, tasks: int) -> DataFrame:
    """Rows per distinct value of one column, counted in its own type; nested values are known by their digest."""
    kind, own = storage_class(field.dataType), _own(field.name)
    native = isinstance(field.dataType, (*INTEGER_TYPES, T.DoubleType, T.DateType, T.TimestampNTZType)) and not isinstance(field.dataType, T.BooleanType)
    if kind is None:
        key = F.sha2(printed(own, field.dataType), 256)
    else:
        key = own if native else printed(own, field.dataType).cast("string")
    shown = printed(F.col("v"), field.dataType) if native else F.col("v")
    number = F.lit(None) if kind not in ("integer", "real") else F.col("v") if native else F.col("v").try_cast("double")
    return _frequencies(df.select(key.alias("v")), tasks).select(
        F.lit(table).alias("table_name"), F.lit(field.name).alias("column_name"), F.lit(kind or "unsupported").alias("storage"),
        shown.alias("value"), number.cast("double").alias("number"), "frequency", F.col("v").isNotNull().alias("present"),
    )


def value_counts(tables: dict[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per distinct value of every column, nulls included as a null value; ``number`` is the numeric value.

    ``present`` tells the values from null, so that who only counts them need not print them.
    """
    spark = next(iter(tables.values())).sparkSession
    wanted = {t: df for t, df in tables.items() if _fields(df, columns)}
    few, tasks = _few_values(wanted, columns) if wanted else ({}, {})
    listed, counted = [], []
    for t, df in wanted.items():
        for f in _fields(df, columns):
            if (t, f.name) not in few:
                counted.append(_rows_per_value(df, t, f, tasks[t, f.name]))
                continue
            nulls, values = few[t, f.name]
            storage = storage_class(f.dataType) or "unsupported"
            numeric = storage in ("integer", "real") and not isinstance(f.dataType, T.BooleanType)
            listed += [(t, f.name, storage, _shown(raw, f.dataType), float(raw) if numeric else None, n, True) for raw, n in values.items()]
            listed += [(t, f.name, storage, None, None, nulls, False)] if nulls else []
    schema = "table_name string, column_name string, storage string, value string, number double, frequency long, present boolean"
    return _union([spark.createDataFrame(listed, schema), *counted])


def column_counts(counts: DataFrame) -> DataFrame:
    """The scalar statistics of every column."""
    present = F.col("present") if "present" in counts.columns else F.col("value").isNotNull()
    numeric = F.col("number") if "number" in counts.columns else F.when(F.col("storage").isin("integer", "real"), F.col("value").try_cast("double"))
    return (
        counts.groupBy(*KEY, "storage")
        .agg(
            F.sum("frequency").alias("row_count"),
            F.coalesce(F.sum(F.when(~present, F.col("frequency"))), F.lit(0)).alias("null_count"),
            F.count_if(present).alias("distinct_count"),
            F.min(numeric).alias("numeric_min"),
            F.max(numeric).alias("numeric_max"),
        )
        .withColumn(
            "categorical", (F.col("distinct_count") > 0) & (F.col("distinct_count") <= CATEGORICAL_LIMIT)
        )
        .withColumn("status", F.when(F.col("storage") == "unsupported", "partial").otherwise("complete"))
    )


def approximate_distinct(df: DataFrame, table: str, columns: Sequence[str], error: float = 0.02) -> DataFrame:
    """P4, named variant: sketched distinct counts in one pass without a shuffle of values."""
    sketched = df.agg(*[F.approx_count_distinct(c, error).alias(c) for c in columns])
    return sketched.unpivot([], list(columns), "column_name", "approx_distinct").select(
        F.lit(table).alias("table_name"), "column_name", "approx_distinct"
    )


def type_histogram(counts: DataFrame) -> DataFrame:
    """Rows per storage class, null as a class of its own."""
    kind = F.when(F.col("value").isNull(), "null").otherwise(F.col("storage"))
    return counts.groupBy(*KEY, kind.alias("type")).agg(F.sum("frequency").alias("n"))


def type_map(histogram: DataFrame) -> DataFrame:
    return histogram.groupBy(*KEY).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("types")
    )


def top_values(counts: DataFrame) -> DataFrame:
    """All values of a column with at most 100 of them, else the 25 most frequent."""
    present = counts.drop("present").filter(F.col("value").isNotNull() & ~F.col("storage").isin("blob", "unsupported"))
    sizes = present.groupBy(*KEY).agg(F.count("*").alias("distinct_count"))
    order = [F.col("frequency").desc(), F.col("value").asc()]
    scope = F.when(F.col("distinct_count") <= CATEGORICAL_LIMIT, "all_distinct").otherwise("top_frequency")
    return (
        top_k(present, KEY, order, CATEGORICAL_LIMIT)
        .join(sizes, KEY)
        .withColumn("scope", scope)
        .filter((F.col("scope") == "all_distinct") | (F.col("rank") <= TOP_VALUES))
    )


def interpreted_values(top: DataFrame) -> DataFrame:
    """P7, P8 before key clashes are resolved; printed shapes are read from stored text only."""
    original = F.left(F.col("value"), F.lit(ORIGINAL_LENGTH))
    is_text = F.col("storage") == "text"
    return top.select(
        *KEY, "rank", original.alias("original"), text.normalize(original).alias("normalized"), "frequency",
        F.when(is_text, text.value_pattern(original)).alias("pattern"),
        F.when(is_text, text.value_number(original)).alias("numeric_value"), "scope",
    )


def value_index(top: DataFrame) -> DataFrame:
    """One row per stored value; after the length cut the more frequent value wins a clash."""
    rest = ["normalized", "frequency", "pattern", "numeric_value", "scope"]
    return (
        interpreted_values(top)
        .groupBy(*KEY, "original")
        .agg(F.min_by(F.struct(*rest), "rank").alias("v"))
        .select(*KEY, "original", "v.*")
    )


def pattern_rates(top: DataFrame) -> DataFrame:
    """Share of each printed shape, weighted by frequency over the indexed values only."""
    seen = interpreted_values(top).groupBy(*KEY).agg(
        F.sum("frequency").alias("observed"),
        *[
            F.sum(F.when(F.col("pattern") == name, F.col("frequency")).otherwise(0)).alias(name)
            for name in ("numeric_text", "date", "percentage", "currency")
        ],
    )
    return seen.select(
        *KEY, *[(F.col(n) / F.col("observed")).alias(f"{n}_rate") for n in ("numeric_text", "date", "percentage", "currency")]
    )


def value_terms(index: DataFrame) -> DataFrame:
    """Inverted index of word tokens and character trigrams."""
    terms = F.concat(
        F.transform(text.word_tokens("original"), lambda t: F.struct(F.lit("token").alias("term_type"), t.alias("term"))),
        F.transform(text.char_ngrams("original"), lambda t: F.struct(F.lit("trigram").alias("term_type"), t.alias("term"))),
    )
    return index.select(*KEY, "original", F.explode(terms).alias("t")).select("t.*", *KEY, "original")


def column_profile(counts: DataFrame, catalog: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """The profile table, catalog order of columns kept by name, descriptions attached.

    All counts are read once, those of texts again: no other storage has a printed shape, and types follow from the statistics.
    """
    stats = cut_lineage(column_counts(counts))
    of_type = F.struct(F.col("storage").alias("type"), (F.col("row_count") - F.col("null_count")).alias("n"))
    of_null = F.struct(F.lit("null").alias("type"), F.col("null_count").alias("n"))
    histogram = stats.select(*KEY, F.inline(F.array(of_type, of_null))).filter("n > 0").groupBy(*KEY, "type").agg(F.sum("n").alias("n"))
    rates = ["numeric_text_rate", "date_rate", "percentage_rate", "currency_rate"]
    joined = (
        catalog.select(*KEY, F.col("type").alias("declared_type"))
        .join(stats.drop("storage"), KEY, "left")
        .join(type_map(histogram), KEY, "left")
        .join(pattern_rates(top_values(counts.filter("storage = 'text'"))), KEY, "left")
        .fillna(0.0, rates)
        .fillna(0, ["row_count", "null_count", "distinct_count"])
        .fillna("partial", ["status"])
        .fillna(False, ["categorical"])
    )
    if descriptions is None:
        blank = F.lit("")
        return joined.withColumns({"display_name": blank, "description": blank, "value_description": blank})
    limits = {"display_name": 300, "description": 2000, "value_description": 2000}
    notes = descriptions.select(
        F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c"),
        *[F.left(F.col(c), F.lit(n)).alias(c) for c, n in limits.items()],
    )
    match = (F.lower("table_name") == F.col("_t")) & (F.lower("column_name") == F.col("_c"))
    return joined.join(notes, match, "left").drop("_t", "_c").fillna("", list(limits))


def sampled_profile(
    df: DataFrame, table: str, order: Sequence[str], columns: Sequence[str] | None = None, sample: int = 100
) -> DataFrame:
    """Profile of the first ``sample`` rows under an explicit order."""
    chosen = list(columns or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    first = df.orderBy(*order).limit(sample)
    numbered = first.select(
        F.struct(*order, F.xxhash64(*chosen)).alias("_pos"),
        F.explode(F.array(*[
            F.struct(
                F.lit(c).alias("column_name"), F.lit(storage_class(types[c]) or "unsupported").alias("storage"),
                printed(F.col(c), types[c]).alias("value"),
            )
            for c in chosen
        ])).alias("cell"),
    ).select("_pos", "cell.*")
    short = F.left(F.col("value"), F.lit(160))
    gathered = numbered.groupBy("column_name").agg(
        F.count("*").alias("sample_size"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.max("storage").alias("storage"),
        F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("_pos", short.alias("v"))))).alias("_seen"),
    )
    total = df.agg(F.count("*").alias("n")).scalar()
    samples = F.array_distinct(F.transform("_seen", lambda s: s["v"]))
    return (
        gathered.withColumn("samples", samples)
        .withColumn("row_count", total)
        .select(
            F.lit(table).alias("table_name"), "column_name", "storage", "row_count", "sample_size",
            (F.col("nulls") / F.col("sample_size")).alias("null_fraction"),
            (F.col("sample_size") - F.col("nulls")).alias("typed_count"),
            F.size("samples").alias("distinct_count"),
            (F.col("row_count") > F.col("sample_size")).alias("distinct_count_is_sampled"),
            text.format_tags(F.col("samples")).alias("format_tags"),
            F.when(F.size("samples") <= 100, F.slice("samples", 1, 25))
            .otherwise(F.array().cast("array<string>")).alias("categorical_values"),
            F.slice("samples", 1, 5).alias("sample_values"),
        )
    )


def relevant_profiles(questions: DataFrame, profile: DataFrame, limit: int = 12) -> DataFrame:
    """Profile rows that matter for a question.

    score = 4 * shared name terms + 3 * (any value contains a question term) + (has format tags).
    Distinct question terms meet distinct values through shared character grams, never pairwise.
    """
    terms = spread(questions).select("question_id", F.explode(F.array_distinct(text.words("question"))).alias("term"))
    vocabulary = terms.select("term").distinct()
    names = profile.select(
        *KEY, F.explode(F.array_distinct(text.words(F.concat_ws(" ", "table_name", "column_name")))).alias("term")
    )
    name_hits = join_few(terms, names, "term").select("question_id", *KEY, F.lit(4).alias("points"), F.lit(None).cast("string").alias("value"))
    values = profile.select(*KEY, F.posexplode("categorical_values").alias("pos", "value"))
    folded = text.fold("value")
    value_grams = values.select("value").distinct().select(
        "value",
        F.explode(F.array_distinct(F.concat(*[text.grams_of(folded, n) for n in (1, 2, 3)]))).alias("gram"),
    )
    containing = (
        join_few(vocabulary.select("term", F.left("term", F.lit(3)).alias("gram")), value_grams, "gram")
        .filter(F.contains(text.fold("value"), F.col("term")))
        .select("term", "value")
        .distinct()
    )
    value_hits = (
        join_few(join_few(terms, containing, "term").select("question_id", "value").distinct(), values, "value")
        .select("question_id", *KEY, "pos", "value")
    )
    matched = (
        top_k(value_hits, ["question_id", *KEY], [F.col("pos")], 5)
        .groupBy("question_id", *KEY)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("matches"))
    )
    named = name_hits.groupBy("question_id", *KEY).agg(F.sum("points").alias("points"))
    hits = join_few(
        named.join(matched, ["question_id", *KEY], "full_outer"), profile.select(*KEY, F.size("format_tags").alias("tags")), KEY
    )
    tagged = profile.filter(F.size("format_tags") > 0).select(F.struct(*KEY).alias("k"))
    first_tagged = tagged.agg(F.slice(F.sort_array(F.collect_list("k")), 1, limit).alias("ks"))
    filler = (
        questions.select("question_id")
        .withColumn("k", F.explode(first_tagged.scalar()))
        .select("question_id", "k.*", F.lit(1).alias("score"), F.lit(None).cast("array<string>").alias("matches"))
    )
    scored = hits.select(
        "question_id", *KEY,
        (F.coalesce("points", F.lit(0)) + F.when(F.col("matches").isNotNull(), 3).otherwise(0)
         + F.when(F.col("tags") > 0, 1).otherwise(0)).cast("int").alias("score"),
        "matches",
    )
    best = (
        scored.unionByName(filler)
        .groupBy("question_id", *KEY)
        .agg(F.max("score").alias("score"), F.max("matches").alias("matches"))
    )
    ranked = top_k(best, ["question_id"], [F.col("score").desc(), F.col("table_name"), F.col("column_name")], limit)
    shown = profile.select(*KEY, "format_tags", "sample_values")
    return join_few(ranked, shown, KEY).select(
        "question_id", "rank", *KEY, "score", "format_tags",
        F.coalesce("matches", F.slice("sample_values", 1, 3)).alias("values"),
    )
