"""Profiling and value-index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundscope.functions import text
from groundscope.operators import profile
from groundscope.plans.registry import query
from groundscope.session import cut_lineage
from groundscope.sources.tables import catalog_columns, PRIMARY_KEYS, read_table, read_tables

#: All columns of the given tables by storage class and declared type.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
    " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
CLASSES = {"int": "integer", "bigint": "integer", "double": "real", "string": "text", "timestamp_ntz": "text", "array<float>": "unsupported"}
EVERY_COLUMN = [(t, *column.split()) for t, columns in COLUMNS.items() for column in columns.split(", ")]
TEXT_COLUMNS = {
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "part": ["p_name", "p_brand", "p_type"],
    "nation": ["n_name"],
}


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _counts_sql(t, c, declared):
    number = f"min({c})::DOUBLE AS numeric_min, max({c})::DOUBLE AS numeric_max"
    none = "NULL::DOUBLE AS numeric_min, NULL::DOUBLE AS numeric_max"
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
 count(DISTINCT {c}) AS distinct_count, {number if CLASSES[declared] in ("integer", "real") else none},
 count(DISTINCT {c}) BETWEEN 1 AND 100 AS categorical, '{"partial" if CLASSES[declared] == "unsupported" else "complete"}' AS status FROM {t}"""


COUNTS_SQL = _union(_counts_sql(*column) for column in EVERY_COLUMN)


@query("profile_counts", COUNTS_SQL)
def profile_counts(spark, sf):
    """All columns of all tables."""
    return profile.column_counts(profile.value_counts(read_tables(spark, sf, COLUMNS))).drop("storage")


@query(
    "profile_types",
    _union(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
 CASE WHEN {e} IS NULL THEN 'null' ELSE '{kind}' END AS type, count(*) AS n FROM {t} GROUP BY 3"""
        for t, c, e, kind in (
            ("customer", "c_mktsegment", "nullif(c_mktsegment, 'BUILDING')", "text"),
            ("customer", "c_nationkey", "nullif(c_nationkey, 3)", "integer"),
            ("events", "event_type", "nullif(event_type, 'error')", "text"),
            ("events", "value", "CASE WHEN value < 5 THEN NULL ELSE value END", "real"),
        )
    ),
)
def profile_types(spark, sf):
    """Storage-class histogram with nulls as a class."""
    customer = read_table(spark, sf, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.nullif("c_nationkey", F.lit(3)).alias("c_nationkey"),
    )
    events = read_table(spark, sf, "events").select(
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
    )
    return profile.type_histogram(profile.value_counts({"customer": customer, "events": events}))


def _text_counts(spark, sf):
    return profile.value_counts(
        read_tables(spark, sf, TEXT_COLUMNS), [c for columns in TEXT_COLUMNS.values() for c in columns]
    )


VALUES_CTE = f"""WITH counted AS (
{_union(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value, count(*) AS frequency FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cs in TEXT_COLUMNS.items() for c in cs)}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY table_name, column_name) AS d,
 row_number() OVER (PARTITION BY table_name, column_name ORDER BY frequency DESC, value) AS rank FROM counted),
kept AS (SELECT *, CASE WHEN d <= 100 THEN 'all_distinct' ELSE 'top_frequency' END AS scope FROM ranked
 WHERE d <= 100 OR rank <= 25)
"""


@query("top_values", VALUES_CTE + "SELECT table_name, column_name, value, frequency, rank, scope FROM kept")
def top_values(spark, sf):
    """P6."""
    return profile.top_values(_text_counts(spark, sf)).select(
        "table_name", "column_name", "value", "frequency", "rank", "scope"
    )


@query(
    "value_index",
    VALUES_CTE
    + """SELECT table_name, column_name, left(value, 500) AS original,
 lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS normalized, frequency, NULL::VARCHAR AS pattern,
 NULL::DOUBLE AS numeric_value, scope FROM kept""",
)
def value_index(spark, sf):
    """The stored-value index over the text columns."""
    return profile.value_index(profile.top_values(_text_counts(spark, sf)))


@query(
    "value_terms",
    VALUES_CTE
    + """, c AS (SELECT table_name, column_name, value AS original, lower(value) AS norm,
 regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS compact FROM kept)
SELECT DISTINCT 'token' AS term_type, unnest(regexp_extract_all(norm, '[a-z0-9]+')) AS term, table_name, column_name,
 original FROM c
UNION ALL
SELECT DISTINCT 'trigram', CASE WHEN length(compact) < 3 THEN compact ELSE substr(compact, i::INT, 3) END,
 table_name, column_name, original
FROM c, range(1, 501) AS r(i) WHERE compact <> '' AND i <= greatest(length(compact) - 2, 1)""",
)
def value_terms(spark, sf):
    """P12, T4, T5."""
    return profile.value_terms(profile.value_index(profile.top_values(_text_counts(spark, sf))))


def _printed_orders(spark, sf):
    """Order facts as printed text: money, thousands, percent, plus counts, dates and times."""
    price = F.col("o_totalprice")
    return read_table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("$"), F.format_number(price, 2)).alias("price_text"),
        F.format_number(F.floor(price), 0).alias("thousands_text"),
        F.concat(F.format_number(F.floor(price), 0), F.lit("+")).alias("plus_text"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("percent_text"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("date_text"),
        F.concat((F.col("o_custkey") % 24).cast("string"), F.lit(":30")).alias("time_text"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority_text"),
    )


PRINTED_CTE = """WITH printed AS (SELECT o_orderkey,
 '$' || format('{:,.2f}', o_totalprice) AS price_text,
 format('{:,}', floor(o_totalprice)::BIGINT) AS thousands_text,
 format('{:,}', floor(o_totalprice)::BIGINT) || '+' AS plus_text,
 (o_custkey % 100)::VARCHAR || '%' AS percent_text,
 strftime(o_orderdate, '%Y/%m/%d') AS date_text,
 (o_custkey % 24)::VARCHAR || ':30' AS time_text,
 nullif(o_orderpriority, '5-LOW') AS priority_text FROM orders)
"""
PRINTED = ["price_text", "thousands_text", "plus_text", "percent_text", "date_text", "time_text", "priority_text"]
TAG_SQL = {
    "currency_text": r"[$£€¥]\s*[+-]?[\d,]+(\.\d+)?",
    "thousands_separator": r"[+-]?\d{1,3}(,\d{3})+(\.\d+)?\+?",
    "percentage_text": r"[+-]?[\d,.]+%",
    "plus_suffix": r"[\d,]+\+",
    "date_text": r"\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T].*)?",
    "time_text": r"\d{1,2}:\d{2}(:\d{2})?(\s*[APap][Mm])?",
    "numeric_text": r"[+-]?[\d,.]+",
}


@query(
    "format_tags",
    PRINTED_CTE
    + _union(
        f"SELECT '{c}' AS column_name, '{tag}' AS tag, count(DISTINCT {c}) AS values_tagged, count(*) AS rows_tagged "
        f"FROM printed WHERE regexp_full_match({c}, '{shape}') HAVING count(*) > 0"
        for c in PRINTED
        for tag, shape in TAG_SQL.items()
    ),
)
def format_tags(spark, sf):
    """P14 over every printed value, counted per tag."""
    counts = profile.value_counts({"printed": _printed_orders(spark, sf)}, PRINTED).filter("value IS NOT NULL")
    return (
        counts.select("column_name", "frequency", F.explode(text.format_tags(F.array("value"))).alias("tag"))
        .groupBy("column_name", "tag")
        .agg(F.count("*").alias("values_tagged"), F.sum("frequency").alias("rows_tagged"))
    )


@query(
    "pattern_rates",
    PRINTED_CTE
    + f""", counted AS ({_union(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS frequency FROM printed WHERE {c} IS NOT NULL GROUP BY {c}" for c in PRINTED)}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY column_name) AS d,
 row_number() OVER (PARTITION BY column_name ORDER BY frequency DESC, value) AS rank FROM counted),
shaped AS (SELECT *, CASE WHEN regexp_full_match(value, '[$£€¥]\\s*[+-]?[\\d,]+(\\.\\d+)?') THEN 'currency'
 WHEN regexp_full_match(value, '[+-]?[\\d,.]+\\s*%') THEN 'percentage'
 WHEN regexp_full_match(value, '[+-]?[\\d,]+(\\.\\d+)?') THEN 'numeric_text'
 WHEN regexp_full_match(value, '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}([ T].*)?') THEN 'date' END AS pattern
 FROM ranked WHERE d <= 100 OR rank <= 25)
SELECT 'printed' AS table_name, column_name,
 round(coalesce(sum(frequency) FILTER (pattern = 'numeric_text'), 0) / sum(frequency), 6) AS numeric_text_rate,
 round(coalesce(sum(frequency) FILTER (pattern = 'date'), 0) / sum(frequency), 6) AS date_rate,
 round(coalesce(sum(frequency) FILTER (pattern = 'percentage'), 0) / sum(frequency), 6) AS percentage_rate,
 round(coalesce(sum(frequency) FILTER (pattern = 'currency'), 0) / sum(frequency), 6) AS currency_rate
FROM shaped GROUP BY column_name""",
)
def pattern_rates(spark, sf):
    """P8, P9."""
    counts = profile.value_counts({"printed": _printed_orders(spark, sf)}, PRINTED)
    rates = profile.pattern_rates(profile.top_values(counts))
    return rates.select(
        "table_name", "column_name", *[F.round(c, 6).alias(c) for c in rates.columns if c.endswith("_rate")]
    )


@query(
    "normalize_interpret",
    PRINTED_CTE
    + """SELECT o_orderkey, lower(price_text) AS normalized, 'currency' AS pattern,
 replace(replace(price_text, '$', ''), ',', '')::DOUBLE AS number,
 regexp_extract(date_text, '^[0-9]{4}')::INT AS year_number,
 CASE WHEN regexp_full_match(coalesce(priority_text, ''), '[0-9]-.*') THEN 'code' ELSE 'none' END AS priority_kind,
 (o_orderkey % 100 < 100 AND percent_text LIKE '%\\%' ESCAPE '\\') AS is_percent,
 replace(percent_text, '%', '')::DOUBLE AS percent_number FROM printed""",
)
def normalize_interpret(spark, sf):
    """T1, T3 on printed values of every order."""
    p = _printed_orders(spark, sf)
    return p.select(
        "o_orderkey", text.normalize("price_text").alias("normalized"), text.value_pattern("price_text").alias("pattern"),
        text.value_number("price_text").alias("number"),
        F.try_element_at(text.years("date_text"), F.lit(1)).cast("int").alias("year_number"),
        F.when(F.coalesce("priority_text", F.lit("")).rlike("^[0-9]-.*$"), "code").otherwise("none").alias("priority_kind"),
        (text.value_pattern("percent_text") == "percentage").alias("is_percent"),
        text.value_number("percent_text").alias("percent_number"),
    )


@query(
    "identifier_tokens",
    """WITH n AS (SELECT p_partkey, p_name || '_' || p_brand || ' ' || p_type || 'Types' AS name FROM part),
w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'),
 '_', ' ')), '[a-z0-9]+')) AS w FROM n)
SELECT p_partkey, CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END AS token,
 count(*) AS n FROM w GROUP BY 1, 2""",
)
def identifier_tokens(spark, sf):
    """T2."""
    name = F.concat("p_name", F.lit("_"), "p_brand", F.lit(" "), "p_type", F.lit("Types"))
    return (
        read_table(spark, sf, "part")
        .select("p_partkey", F.explode(text.identifier_tokens(name)).alias("token"))
        .groupBy("p_partkey", "token")
        .agg(F.count("*").alias("n"))
    )


@query(
    "sampled_profile",
    """WITH s AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100), u AS (
 SELECT o_orderkey, 'o_orderpriority' AS column_name, nullif(o_orderpriority, '5-LOW') AS value FROM s
 UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM s
 UNION ALL SELECT o_orderkey, 'o_totalprice', o_totalprice::VARCHAR FROM s),
f AS (SELECT column_name, value, min(o_orderkey) AS first FROM u WHERE value IS NOT NULL GROUP BY 1, 2),
v AS (SELECT column_name, count(*) AS distinct_count, array_to_string(list(value ORDER BY first)[:5], '|') AS samples
 FROM f GROUP BY 1)
SELECT column_name, (SELECT count(*) FROM orders) AS row_count, count(*) AS sample_size,
 round((count(*) - count(value)) / count(*), 6) AS null_fraction, any_value(distinct_count) AS distinct_count,
 (SELECT count(*) FROM orders) > count(*) AS distinct_count_is_sampled, any_value(samples) AS samples,
 CASE column_name WHEN 'o_totalprice' THEN 'numeric_text' ELSE '' END AS tags
FROM u JOIN v USING (column_name) GROUP BY column_name""",
)
def sampled_profile(spark, sf):
    """The first 100 orders by key are the feature; the row count is the whole table."""
    orders = read_table(spark, sf, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    sampled = profile.sampled_profile(orders, "orders", ["o_orderkey"], ["o_orderpriority", "o_orderstatus", "o_totalprice"])
    return sampled.select(
        "column_name", "row_count", "sample_size", F.round("null_fraction", 6).alias("null_fraction"), "distinct_count",
        "distinct_count_is_sampled", F.array_join("sample_values", "|").alias("samples"),
        F.array_join("format_tags", ",").alias("tags"),
    )


PATTERNS = {
    "currency": r"[$£€¥]\s*[+-]?[\d,]+(\.\d+)?", "percentage": r"[+-]?[\d,.]+\s*%", "numeric_text": r"[+-]?[\d,]+(\.\d+)?",
    "date": r"\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T].*)?",
}
_SHAPE = " ".join(f"WHEN regexp_full_match(trim(left(value, 500)), '{shape}') THEN '{name}'" for name, shape in PATTERNS.items())
_TEXTS = _union(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS frequency FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
    for t, c, declared in EVERY_COLUMN if CLASSES[declared] == "text"
)
_DECLARED = ", ".join(f"('{t}', '{c}', '{declared}', '{CLASSES[declared]}')" for t, c, declared in EVERY_COLUMN)
PROFILE_SQL = f"""WITH c AS ({COUNTS_SQL}), d(table_name, column_name, declared_type, kind) AS (VALUES {_DECLARED}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY table_name, column_name) AS d,
 row_number() OVER (PARTITION BY table_name, column_name ORDER BY frequency DESC, value) AS rank FROM ({_TEXTS})),
shaped AS (SELECT *, CASE {_SHAPE} END AS pattern FROM ranked WHERE d <= 100 OR rank <= 25),
rates AS (SELECT table_name, column_name, {", ".join(
    f"coalesce(sum(frequency) FILTER (pattern = '{name}'), 0) / sum(frequency) AS {name}_rate" for name in PATTERNS
)} FROM shaped GROUP BY table_name, column_name)
SELECT c.*, declared_type,
 '{{' || array_to_string(list_filter([CASE WHEN kind = 'integer' AND row_count > null_count THEN '"integer":' || (row_count - null_count) END,
 CASE WHEN null_count > 0 THEN '"null":' || null_count END,
 CASE WHEN kind <> 'integer' AND row_count > null_count THEN '"' || kind || '":' || (row_count - null_count) END], lambda x: x IS NOT NULL), ',') || '}}' AS types,
 {", ".join(f"round(coalesce({name}_rate, 0), 6)::DOUBLE AS {name}_rate" for name in PATTERNS)},
 CASE WHEN column_name LIKE '%_mktsegment' THEN 'segment' ELSE '' END AS display_name,
 CASE WHEN column_name LIKE '%_mktsegment' THEN 'market segment of the customer' ELSE '' END AS description, '' AS value_description
FROM c JOIN d USING (table_name, column_name) LEFT JOIN rates USING (table_name, column_name)"""


@query("column_profile", PROFILE_SQL)
def column_profile(spark, sf):
    """The complete profile of all columns of all tables with descriptions joined in."""
    tables = read_tables(spark, sf, COLUMNS)
    catalog = catalog_columns(spark, tables, PRIMARY_KEYS)
    notes = catalog.filter("column_name LIKE '%_mktsegment'").select(
        "table_name", "column_name", F.lit("segment").alias("display_name"),
        F.lit("market segment of the customer").alias("description"), F.lit("").alias("value_description"),
    )
    # Those of texts are read three times, so they are made once; the others are counted without being printed.
    counts = profile.value_counts(tables)
    texts = cut_lineage(counts.filter("storage = 'text'"))
    result = profile.column_profile(texts.unionByName(counts.filter("storage <> 'text'")), catalog, notes)
    return result.withColumns({"types": F.to_json("types")} | {f"{name}_rate": F.round(f"{name}_rate", 6) for name in PATTERNS})
