"""The admitted SELECT surface as DataFrame queries, whole tables throughout."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.functions import scalar as S
from groundscope.operators import relational
from groundscope.operators.ranking import top_k
from groundscope.plans.registry import query
from groundscope.sources.tables import FOREIGN_KEYS, read_table, read_tables, register_views


@query("surface_select", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
 round(l_quantity + l_tax, 2) AS padded, -l_quantity AS negated FROM lineitem""")
def surface_select(spark, sf):
    """Q1."""
    return read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
        F.round(F.col("l_quantity") + F.col("l_tax"), 2).alias("padded"), (-F.col("l_quantity")).alias("negated"),
    )


@query("surface_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def surface_distinct(spark, sf):
    """Q2."""
    return read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity").distinct()


@query("surface_filter", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000
 AND o_orderstatus <> 'F' AND o_orderdate > TIMESTAMP '1995-01-01'""")
def surface_filter(spark, sf):
    """Q3: all predicates reach the parquet scan."""
    return read_table(spark, sf, "orders").filter(
        (F.col("o_totalprice") >= 100000) & (F.col("o_totalprice") < 200000) & (F.col("o_orderstatus") != "F")
        & (F.col("o_orderdate") > F.lit("1995-01-01").cast("timestamp_ntz"))
    ).select("o_orderkey", "o_totalprice")


@query("surface_like", """SELECT doc_id, text ILIKE '%the%' AS has_the, text ILIKE '%!_%' ESCAPE '!' AS has_underscore,
 source GLOB '*1*' AS glob_hit FROM documents""")
def surface_like(spark, sf):
    """Q4: LIKE ignores ASCII case, with ESCAPE; GLOB keeps it."""
    return read_table(spark, sf, "documents").select(
        "doc_id", S.like("text", "%the%").alias("has_the"), S.like("text", "%!_%", "!").alias("has_underscore"),
        S.glob("source", "*1*").alias("glob_hit"),
    )


@query("surface_in_between", """SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
 AND c_acctbal BETWEEN 0 AND 5000""")
def surface_in_between(spark, sf):
    """Q5."""
    return read_table(spark, sf, "customer").filter(
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_acctbal").between(0, 5000)
    ).select("c_custkey", "c_acctbal")


@query("surface_nulls", """SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') IS NULL AS low,
 coalesce(nullif(o_orderstatus, 'P'), '?') AS status, ifnull(nullif(o_custkey, 7), -1) AS cust FROM orders""")
def surface_nulls(spark, sf):
    """Q6."""
    return read_table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).isNull().alias("low"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("?")).alias("status"),
        F.ifnull(F.nullif("o_custkey", F.lit(7)), F.lit(-1)).alias("cust"),
    )


CTE_SQL = """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey),
 big AS (SELECT o_custkey, spent FROM spend WHERE spent > 500000)
 SELECT c_mktsegment, count(*) AS customers, round(sum(spent), 2) AS spent FROM big JOIN customer ON c_custkey = o_custkey
 GROUP BY c_mktsegment"""


@query("surface_cte", CTE_SQL)
def surface_cte(spark, sf):
    """Q7: the admitted statement itself, run by Spark SQL."""
    register_views(spark, sf, ["orders", "customer"])
    return spark.sql(CTE_SQL)


SUBQUERY_SQL = """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""


@query("surface_subquery", SUBQUERY_SQL)
def surface_subquery(spark, sf):
    """Q8: scalar and IN subquery."""
    register_views(spark, sf, ["orders", "customer"])
    return spark.sql(SUBQUERY_SQL)


@query("surface_case_cast", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band,
 CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS brand_no,
 CAST(replace(replace(format('${:,.2f}', p_retailprice), '$', ''), ',', '') AS DOUBLE) AS price, p_size // 7 AS weeks FROM part""")
def surface_case_cast(spark, sf):
    """Q9: CASE, IIF, CAST and cleanup of printed numbers; integer division truncates."""
    size = F.col("p_size")
    return read_table(spark, sf, "part").select(
        "p_partkey", F.when(size < 10, "small").otherwise(S.iif(size < 30, F.lit("medium"), F.lit("large"))).alias("band"),
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("int").alias("brand_no"),
        S.number(F.concat(F.lit("$"), F.format_number("p_retailprice", 2))).alias("price"),
        S.integer_divide(size, F.lit(7)).alias("weeks"),
    )


@query("surface_budget", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def surface_budget(spark, sf):
    """Q10: a result that fits its budget passes unchanged; an oversized one raises."""
    return relational.check_budget(read_table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")))


@query("surface_inner", """SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders
 JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
 GROUP BY r_name, n_name""")
def surface_inner(spark, sf):
    """Facts are summed per customer before the dimension joins, so the big join is on reduced rows."""
    t = read_tables(spark, sf, ["orders", "customer", "nation", "region"])
    spend = t["orders"].groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("spent"))
    return (
        spend.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("orders").alias("orders"), F.round(F.sum("spent"), 2).alias("spent"))
    )


@query("surface_anti", """SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders
 WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01') ON o_custkey = c_custkey
 WHERE o_custkey IS NULL""")
def surface_anti(spark, sf):
    """Customers without a finished order in one year."""
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1997-01-01"))
    done = read_table(spark, sf, "orders").filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)
    )
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_name")
    return customer.join(done.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("surface_cross", """SELECT c_mktsegment, o_orderpriority, count(o_orderkey) AS n FROM
 (SELECT DISTINCT c_mktsegment FROM customer) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
 LEFT JOIN (SELECT c_mktsegment, o_orderpriority, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey) f
 USING (c_mktsegment, o_orderpriority) GROUP BY c_mktsegment, o_orderpriority""")
def surface_cross(spark, sf):
    """A complete grid of two small domains, refused beyond the row budget."""
    t = read_tables(spark, sf, ["orders", "customer"])
    per_customer = t["orders"].groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    facts = (
        per_customer.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(F.sum("n").alias("n"))
    )
    grid = relational.bounded_cross(
        t["customer"].select("c_mktsegment").distinct(), t["orders"].select("o_orderpriority").distinct()
    )
    return grid.join(facts, ["c_mktsegment", "o_orderpriority"], "left").fillna(0, ["n"])


@query("surface_chain", """SELECT p_type, n_name, count(*) AS lines FROM part JOIN lineitem ON p_partkey = l_partkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY p_type, n_name""")
def surface_chain(spark, sf):
    """Part - lineitem - supplier - nation along declared foreign keys."""
    names = ["part", "lineitem", "supplier", "nation"]
    joined = relational.chain_join(read_tables(spark, sf, names), names, FOREIGN_KEYS)
    return joined.groupBy("p_type", "n_name").agg(F.count("*").alias("lines"))


@query("surface_aggregate", """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc,
 min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
 FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def surface_aggregate(spark, sf):
    """A1."""
    return read_table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"),
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
    )


@query("surface_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY event_type")
def surface_count_distinct(spark, sf):
    """A2: distinct pairs first, so a hot type spreads over its users."""
    pairs = read_table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return pairs.groupBy("event_type").agg(F.count("user_id").alias("users"), F.sum("n").alias("n"))


@query("surface_having", """SELECT l_partkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey
 HAVING sum(l_quantity) > 700""")
def surface_having(spark, sf):
    """A3."""
    grouped = read_table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty")
    )
    return grouped.filter(F.col("qty") > 700)


@query("surface_total", """SELECT c_mktsegment, coalesce(sum(CASE WHEN c_acctbal > 100000 THEN c_acctbal END), 0.0) AS none,
 round(sum(c_acctbal), 2) AS balance, (SELECT string_agg(n::VARCHAR, ',' ORDER BY n::VARCHAR) FROM (SELECT DISTINCT c_nationkey AS n
 FROM customer i WHERE i.c_mktsegment = o.c_mktsegment)) AS nations FROM customer o GROUP BY c_mktsegment""")
def surface_total(spark, sf):
    """A4: total of no rows is 0.0; group_concat of the distinct nations."""
    customer = read_table(spark, sf, "customer")
    per_nation = customer.groupBy("c_mktsegment", "c_nationkey").agg(
        F.sum(F.when(F.col("c_acctbal") > 100000, F.col("c_acctbal"))).alias("rich"), F.sum("c_acctbal").alias("balance")
    )
    return per_nation.groupBy("c_mktsegment").agg(
        S.total("rich").alias("none"), F.round(F.sum("balance"), 2).alias("balance"),
        S.group_concat(F.col("c_nationkey").cast("string")).alias("nations"),
    )


@query("surface_counter", """SELECT lang, string_agg(source || '=' || n, ',' ORDER BY source) AS counts
 FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY lang""")
def surface_counter(spark, sf):
    """A5: category counts as one map per group, printed."""
    counts = relational.counter(read_table(spark, sf, "documents"), ["lang"], "source")
    printed = F.transform(
        F.sort_array(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return counts.select("lang", F.array_join(printed, ",").alias("counts"))


def _monthly(spark, sf):
    """Revenue per nation and month: bounded by nations and months, so windows over it are small."""
    t = read_tables(spark, sf, ["orders", "customer"])
    per_customer = t["orders"].groupBy("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.sum("o_totalprice").alias("revenue")
    )
    return (
        per_customer.join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "month")
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    )


MONTHLY = """WITH m AS (SELECT c_nationkey, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue
 FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) """


@query("surface_rank", MONTHLY + """SELECT c_nationkey, month, row_number() OVER w AS row_no, rank() OVER (PARTITION BY c_nationkey ORDER BY left(month, 4)) AS rnk,
 dense_rank() OVER (PARTITION BY c_nationkey ORDER BY left(month, 4)) AS dense, ntile(4) OVER w AS quarter
 FROM m WINDOW w AS (PARTITION BY c_nationkey ORDER BY revenue DESC, month)""")
def surface_rank(spark, sf):
    """W1."""
    w = W.partitionBy("c_nationkey").orderBy(F.col("revenue").desc(), "month")
    by_year = W.partitionBy("c_nationkey").orderBy(F.left("month", F.lit(4)))
    return _monthly(spark, sf).select(
        "c_nationkey", "month", F.row_number().over(w).alias("row_no"), F.rank().over(by_year).alias("rnk"),
        F.dense_rank().over(by_year).alias("dense"), F.ntile(4).over(w).alias("quarter"),
    )


@query("surface_lag_lead", MONTHLY + """SELECT c_nationkey, month, lag(revenue) OVER w AS before, lead(revenue, 2, 0) OVER w AS later,
 first_value(month) OVER w AS first_month, last_value(month) OVER w AS last_month FROM m WINDOW w AS (PARTITION BY c_nationkey ORDER BY month)""")
def surface_lag_lead(spark, sf):
    """The default frame ends at the current row, so last_value is the row itself."""
    w = W.partitionBy("c_nationkey").orderBy("month")
    frame = w.rangeBetween(W.unboundedPreceding, W.currentRow)
    return _monthly(spark, sf).select(
        "c_nationkey", "month", F.lag("revenue").over(w).alias("before"), F.lead("revenue", 2, 0.0).over(w).alias("later"),
        F.first("month").over(frame).alias("first_month"), F.last("month").over(frame).alias("last_month"),
    )


@query("surface_agg_over", MONTHLY + """SELECT c_nationkey, month, round(sum(revenue) OVER (PARTITION BY c_nationkey ORDER BY month), 2) AS running,
 round(avg(revenue) OVER (PARTITION BY c_nationkey ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS smooth,
 count(*) OVER (PARTITION BY c_nationkey) AS months, max(revenue) OVER (PARTITION BY c_nationkey ORDER BY month) AS best FROM m""")
def surface_agg_over(spark, sf):
    """W3."""
    w = W.partitionBy("c_nationkey").orderBy("month")
    return _monthly(spark, sf).select(
        "c_nationkey", "month", F.round(F.sum("revenue").over(w), 2).alias("running"),
        F.round(F.avg("revenue").over(w.rowsBetween(-2, W.currentRow)), 4).alias("smooth"),
        F.count("*").over(W.partitionBy("c_nationkey")).alias("months"), F.max("revenue").over(w).alias("best"),
    )


@query("surface_first_occurrence", """SELECT user_id, event_type, event_id, value FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def surface_first_occurrence(spark, sf):
    """An aggregate, not a window, so hot users combine map-side."""
    events = read_table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return relational.first_occurrence(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("surface_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def surface_topk(spark, sf):
    """O1: a top-k report."""
    return read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.col("o_totalprice").desc(), "o_orderkey"
    ).limit(25)


@query("surface_top_per_group", """SELECT o_orderpriority, o_orderkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (
 PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""")
def surface_top_per_group(spark, sf):
    """O2: five hot groups, ranked in two stages."""
    orders = read_table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return top_k(orders, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("surface_set_ops", """SELECT 'both' AS kind, c_nationkey AS k FROM (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT
 SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only_customer', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'any', c_nationkey FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'all', c_nationkey FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'except_all', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""")
def surface_set_ops(spark, sf):
    """U1."""
    customer = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_mktsegment")
    supplier = read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    keys = customer.select("k")
    parts = {
        "both": customer.filter("c_mktsegment = 'BUILDING'").select("k").intersect(supplier),
        "only_customer": keys.subtract(supplier),
        "any": keys.union(supplier).distinct(),
        "all": keys.union(supplier),
        "except_all": keys.exceptAll(supplier),
    }
    result = None
    for kind, part in parts.items():
        tagged = part.select(F.lit(kind).alias("kind"), "k")
        result = tagged if result is None else result.union(tagged)
    return result


@query("surface_containment", """WITH f AS (SELECT o_custkey, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F')) AS a,
 list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O')) AS b FROM orders GROUP BY 1),
 g AS (SELECT o_custkey, coalesce(a, []) AS a, coalesce(b, []) AS b FROM f)
 SELECT o_custkey, len(list_filter(b, lambda x: (NOT list_contains(a, x)))) = 0 AS covered, len(list_intersect(a, b)) > 0 AS overlaps,
 len(list_filter(b, lambda x: (NOT list_contains(a, x)))) + len(list_filter(a, lambda x: (NOT list_contains(b, x)))) AS changed FROM g""")
def surface_containment(spark, sf):
    """Priorities of finished and open orders per customer."""
    def chosen(status):
        return F.collect_set(F.when(F.col("o_orderstatus") == status, F.col("o_orderpriority")))

    sets = read_table(spark, sf, "orders").groupBy("o_custkey").agg(chosen("F").alias("a"), chosen("O").alias("b"))
    return sets.select(
        "o_custkey", relational.contains_all(F.col("a"), F.col("b")).alias("covered"), F.arrays_overlap("a", "b").alias("overlaps"),
        (F.size(F.array_except("b", "a")) + F.size(F.array_except("a", "b"))).alias("changed"),
    )


@query("surface_overlay", """SELECT doc_id, coalesce(l.toxic, d.n_chars % 2)::BIGINT AS outcome, CASE WHEN l.doc_id IS NULL THEN 'first' ELSE 'second' END AS layer
 FROM (SELECT doc_id, n_chars FROM documents) d FULL JOIN labels l USING (doc_id)""")
def surface_overlay(spark, sf):
    """Label outcomes replace the earlier ones per document."""
    first = read_table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 2).cast("long").alias("outcome"), F.lit("first").alias("layer")
    )
    second = read_table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("long").alias("outcome"), F.lit("second").alias("layer"))
    return relational.overlay([first, second], "doc_id")


@query("surface_exclusion", """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
 AND source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source HAVING count(*) > 4)""")
def surface_exclusion(spark, sf):
    """Anti-joins by id and by group."""
    documents = read_table(spark, sf, "documents").select("doc_id", "source")
    labels = read_table(spark, sf, "labels")
    weak = (
        documents.join(labels.filter("quality = 0"), "doc_id").groupBy("source").agg(F.count("*").alias("n")).filter("n > 4")
    )
    return relational.exclude(documents, (labels.filter("toxic = 1"), "doc_id"), (weak, "source"))


@query("surface_strings", """SELECT doc_id, length(text) AS n, instr(text, 'an') AS at, substr(text, 1, 12) AS head, right(text, 5) AS tail,
 translate(lang, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, replace(source, 'a', 'A') AS swapped, trim('  ' || lang || '  ') AS trimmed,
 ltrim('  ' || lang) AS ltrimmed, rtrim(lang || '  ') AS rtrimmed, hex(lang) AS hexed, unicode(text) AS code FROM documents""")
def surface_strings(spark, sf):
    """2.10, text functions over whole documents."""
    padded = F.concat(F.lit("  "), F.col("lang"), F.lit("  "))
    return read_table(spark, sf, "documents").select(
        "doc_id", F.char_length("text").alias("n"), S.instr("text", "an").alias("at"), S.substr("text", 1, 12).alias("head"),
        S.substr("text", -5).alias("tail"), S.upper("lang").alias("up"), F.replace("source", F.lit("a"), F.lit("A")).alias("swapped"),
        F.trim(padded).alias("trimmed"), F.ltrim(F.concat(F.lit("  "), F.col("lang"))).alias("ltrimmed"),
        F.rtrim(F.concat(F.col("lang"), F.lit("  "))).alias("rtrimmed"), F.hex("lang").alias("hexed"), S.unicode("text").alias("code"),
    )


@query("surface_dates", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt,
 epoch_us(ts) // 1000000 AS epoch, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 6) AS julian, strftime(ts, '%Y/%j') AS year_day,
 strftime(ts, '%w') AS weekday FROM events""")
def surface_dates(spark, sf):
    """2.10, date functions."""
    return read_table(spark, sf, "events").select(
        "event_id", S.date("ts").alias("d"), S.time("ts").alias("t"), S.datetime("ts").alias("dt"), S.unixepoch("ts").alias("epoch"),
        F.round(S.julianday("ts"), 6).alias("julian"), S.strftime("%Y/%j", "ts").alias("year_day"), S.strftime("%w", "ts").alias("weekday"),
    )


@query("surface_numerics", """SELECT c_custkey, abs(c_acctbal) AS magnitude, round(c_acctbal, 1) AS rounded, c_custkey // 7 AS div,
 CASE WHEN nullif(c_nationkey, 3) IS NULL THEN NULL ELSE greatest(c_nationkey, 10) END AS high,
 CASE WHEN nullif(c_nationkey, 3) IS NULL THEN NULL ELSE least(c_nationkey, 10) END AS low,
 CASE WHEN nullif(c_nationkey, 3) IS NULL THEN 'null' ELSE 'integer' END AS kind, c_acctbal > 0 AS positive FROM customer""")
def surface_numerics(spark, sf):
    """2.10, numeric functions; two-argument max and min are NULL when an argument is."""
    nation = F.nullif("c_nationkey", F.lit(3))
    return read_table(spark, sf, "customer").select(
        "c_custkey", F.abs("c_acctbal").alias("magnitude"), F.round("c_acctbal", 1).alias("rounded"),
        S.integer_divide("c_custkey", F.lit(7)).alias("div"), S.greatest(nation, F.lit(10)).alias("high"),
        S.least(nation, F.lit(10)).alias("low"), S.typeof(nation, "integer").alias("kind"),
        S.likelihood(F.col("c_acctbal") > 0, 0.9).alias("positive"),
    )
