"""Derived inputs of the named queries, all computed by Spark from the driver tables.

Each view has the same statement for the oracle next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundscope.operators import profile
from groundscope.sources.tables import read_table, read_tables

TEXT_COLUMNS = {
    "customer": ["c_name", "c_mktsegment"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "part": ["p_name", "p_brand", "p_type"],
    "nation": ["n_name"],
}


def part_questions(spark: SparkSession, sf: str, **more: Column) -> DataFrame:
    """One question per part; ``more`` are columns made from the part."""
    year = (F.lit(1992) + F.col("p_partkey") % 7).cast("string")
    return read_table(spark, sf, "part").select(
        F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("question_id"),
        F.concat(
            F.lit("How many '"), F.col("p_name"), F.lit("' parts of type "), F.col("p_type"), F.lit(" with Brand#"),
            (F.col("p_size") % 25 + 1).cast("string"), F.lit(" were ordered per customer nation in the "), year,
            F.lit(" season?"),
        ).alias("question"),
        *[c.alias(name) for name, c in more.items()],
    )


PART_QUESTIONS_SQL = """SELECT 'p-' || p_partkey AS question_id, 'How many ''' || p_name || ''' parts of type ' || p_type
 || ' with Brand#' || (p_size % 25 + 1) || ' were ordered per customer nation in the ' || (1992 + p_partkey % 7)
 || ' season?' AS question FROM part"""


def customer_questions(spark: SparkSession, sf: str, **more: Column) -> DataFrame:
    """One question per customer, some with attached evidence; ``more`` are columns made from the customer."""
    evidence = F.when(
        F.col("c_custkey") % 2 == 0,
        F.concat(F.lit("\nBenchmark evidence: urgent refers to '1-URGENT'; balance >= "),
                 F.floor("c_acctbal").cast("string")),
    ).otherwise("")
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("question_id"),
        F.concat(
            F.lit("List the top 5 "), F.lower("c_mktsegment"), F.lit(" customers of NATION_"),
            F.col("c_nationkey").cast("string"),
            F.when(F.col("c_custkey") % 3 == 0, " with the highest account balance").otherwise(
                " and the total price of urgent orders by year"
            ),
            evidence,
        ).alias("question"),
        *[c.alias(name) for name, c in more.items()],
    )


CUSTOMER_QUESTIONS_SQL = """SELECT 'c-' || c_custkey AS question_id, 'List the top 5 ' || lower(c_mktsegment)
 || ' customers of NATION_' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN ' with the highest account balance'
 ELSE ' and the total price of urgent orders by year' END || CASE WHEN c_custkey % 2 = 0 THEN
 chr(10) || 'Benchmark evidence: urgent refers to ''1-URGENT''; balance >= ' || floor(c_acctbal)::BIGINT ELSE '' END
 AS question FROM customer"""


def spoken_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn of the conversations, whole texts."""
    return read_table(spark, sf, "conversations").filter("role = 'user'").select(
        F.concat(F.lit("v-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("question"),
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return part_questions(spark, sf).unionByName(customer_questions(spark, sf)).unionByName(spoken_questions(spark, sf))


QUESTIONS_SQL = f"""{PART_QUESTIONS_SQL} UNION ALL {CUSTOMER_QUESTIONS_SQL} UNION ALL
 SELECT 'v-' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user'"""


def text_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_counts(
        read_tables(spark, sf, TEXT_COLUMNS), [c for columns in TEXT_COLUMNS.values() for c in columns]
    )


def text_index(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_index(profile.top_values(text_counts(spark, sf)))


_COUNTED = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS original, count(*) AS frequency FROM {t}"
    f" WHERE {c} IS NOT NULL GROUP BY {c}"
    for t, columns in TEXT_COLUMNS.items()
    for c in columns
)
INDEX_SQL = f"""SELECT table_name, column_name, original, lower(original) AS normalized, frequency,
 CASE WHEN d <= 100 THEN 'all_distinct' ELSE 'top_frequency' END AS scope FROM (
 SELECT *, count(*) OVER (PARTITION BY table_name, column_name) AS d, row_number() OVER (PARTITION BY table_name,
 column_name ORDER BY frequency DESC, original) AS rank FROM ({_COUNTED})) WHERE d <= 100 OR rank <= 25"""


def name_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases per part: its whole name, each word of it, and its type."""
    phrase = F.explode(F.concat(F.array("p_name", F.lower("p_type")), F.split("p_name", " "), F.array(F.lit("urgent"))))
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.posexplode(
        F.concat(F.array("p_name", F.lower("p_type")), F.split("p_name", " "), F.array(F.lit("urgent")))
    ).alias("pos", "phrase")).withColumn("normalized", F.lower("phrase"))


NAME_PHRASES_SQL = """SELECT question_id, i::INT - 1 AS pos, l[i::INT] AS phrase, lower(l[i::INT]) AS normalized FROM (
 SELECT p_partkey AS question_id, list_concat([p_name, lower(p_type)], list_concat(string_split(p_name, ' '), ['urgent']))
 AS l FROM part), range(1, 20) AS r(i) WHERE i <= len(l)"""
