"""Catalog, retrieval, evidence and probe queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundscope.functions import text
from groundscope.functions.encoder import hashed_encoder, l2_normalize
from groundscope.operators import bounded, catalog, evidence, match, metrics, probe, profile, retrieve, stats
from groundscope.operators.joins import for_all, one_of_each
from groundscope.operators.packing import greedy_pack, prefix_pack
from groundscope.plans import inputs
from groundscope.plans.grounding import CONCEPT_STOP, PHRASES_SQL
from groundscope.plans.profiling import EVERY_COLUMN, PROFILE_SQL
from groundscope.plans.registry import query
from groundscope.session import cut_lineage, written
from groundscope.sources.store import KnowledgeStore
from groundscope.sources.tables import FOREIGN_KEYS, PRIMARY_KEYS, STAR_TABLES, catalog_columns, catalog_fks, read_table, read_tables

STAR_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                 "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}
_EDGE_VALUES = ", ".join(f"('{s}', '{d}')" for s, _, d, _ in FOREIGN_KEYS)
PATHS_SQL = f"""edge AS (SELECT a, b FROM (VALUES {_EDGE_VALUES}) t(a, b) UNION SELECT b, a FROM (VALUES {_EDGE_VALUES}) t(a, b)),
walk AS (SELECT DISTINCT a AS start, a AS stop, [a] AS path FROM edge UNION ALL SELECT start, b, list_append(path, b) FROM walk JOIN edge ON stop = a WHERE NOT list_contains(path, b)),
paths AS (SELECT start, stop, arg_min(path, len(path)) AS path FROM walk GROUP BY 1, 2)"""


def star(spark, sf):
    """(catalog, foreign keys, shortest paths) of the seven star tables."""
    columns = catalog_columns(spark, read_tables(spark, sf, STAR_TABLES), PRIMARY_KEYS)
    fks = catalog_fks(spark, FOREIGN_KEYS)
    return columns, fks, catalog.shortest_paths(fks)


SEEDS = {"1": ("customer", "part"), "2": ("nation", "lineitem"), "3": ("region", "supplier"), "4": ("orders", "nation"), "5": ("part", "region")}


def order_seeds(spark, sf):
    """Two seed tables per order, chosen by its priority."""
    first = F.left("o_orderpriority", F.lit(1))
    tables = None
    for digit, pair in SEEDS.items():
        array = F.array(*[F.lit(t) for t in pair])
        tables = F.when(first == digit, array) if tables is None else tables.when(first == digit, array)
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), F.explode(tables).alias("table_name"))


_SEED_CASE = "CASE left(o_orderpriority, 1) " + " ".join(f"WHEN '{d}' THEN ['{a}', '{b}']" for d, (a, b) in SEEDS.items()) + " END"


@query("fk_closure", f"""WITH RECURSIVE {PATHS_SQL}, s AS (SELECT o_orderkey AS question_id, {_SEED_CASE} AS seeds FROM orders),
 d AS (SELECT DISTINCT seeds FROM s), c AS (SELECT seeds, list_sort(list_distinct(flatten(list(path)))) AS tables FROM d, paths WHERE list_contains(seeds, start) AND list_contains(seeds, stop) GROUP BY 1)
 SELECT question_id, array_to_string(tables, ',') AS tables FROM s JOIN c USING (seeds)""")
def fk_closure(spark, sf):
    """Tables on the shortest foreign-key paths between the seeds of every order."""
    _, _, paths = star(spark, sf)
    return catalog.closure(order_seeds(spark, sf), paths).select("question_id", F.array_join("tables", ",").alias("tables"))


@query("retained_keys", f"""WITH RECURSIVE {PATHS_SQL}, s AS (SELECT o_orderkey AS question_id, {_SEED_CASE} AS seeds FROM orders),
 d AS (SELECT DISTINCT seeds FROM s), c AS (SELECT seeds, list_distinct(flatten(list(path))) AS tables FROM d, paths WHERE list_contains(seeds, start) AND list_contains(seeds, stop) GROUP BY 1),
 fk AS (SELECT * FROM (VALUES {", ".join(repr(e) for e in FOREIGN_KEYS)}) t(s, sc, d, dc)), pk AS (SELECT * FROM (VALUES {", ".join(repr(e) for e in PRIMARY_KEYS.items())}) t(s, sc)),
 k AS (SELECT seeds, s || '.' || sc AS col FROM c, pk WHERE list_contains(tables, s) UNION SELECT seeds, s || '.' || sc FROM c, fk WHERE list_contains(tables, s) AND list_contains(tables, d)
 UNION SELECT seeds, d || '.' || dc FROM c, fk WHERE list_contains(tables, s) AND list_contains(tables, d))
 SELECT question_id, count(*) AS keys, string_agg(col, ',' ORDER BY col) AS cols FROM s JOIN k USING (seeds) GROUP BY 1""")
def retained_keys(spark, sf):
    """Keys kept for the closed tables."""
    columns, fks, paths = star(spark, sf)
    kept = catalog.retained_keys(catalog.closure(order_seeds(spark, sf), paths), columns, fks)
    name = F.concat_ws(".", "table_name", "column_name")
    return kept.groupBy("question_id").agg(F.count("*").alias("keys"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("cols"))


#: Two databases whose tables have the same names, linked differently.
TWO_DATABASES = {"main": FOREIGN_KEYS, "other": [("orders", "o_part", "part", "p_partkey"), ("part", "p_nation", "nation", "n_nationkey"),
                 ("nation", "n_customer", "customer", "c_custkey"), ("lineitem", "l_nation", "nation", "n_nationkey"), ("supplier", "s_region", "region", "r_regionkey")]}
_TWO_EDGES = ", ".join(f"('{db}', '{s}', '{d}')" for db, fks in TWO_DATABASES.items() for s, _, d, _ in fks)
_TWO_FKS = ", ".join(repr((db, *fk)) for db, fks in TWO_DATABASES.items() for fk in fks)


@query("closure_by_database", f"""WITH RECURSIVE links AS (SELECT * FROM (VALUES {_TWO_EDGES}) t(db, a, b)), edge AS (SELECT db, a, b FROM links UNION SELECT db, b, a FROM links),
 walk AS (SELECT DISTINCT db, a AS start, a AS stop, [a] AS path FROM edge UNION ALL SELECT walk.db, start, b, list_append(path, b) FROM walk JOIN edge ON walk.db = edge.db AND stop = a WHERE NOT list_contains(path, b)),
 paths AS (SELECT db, start, stop, min(path) AS path FROM (SELECT *, min(len(path)) OVER (PARTITION BY db, start, stop) AS least FROM walk) WHERE len(path) = least GROUP BY 1, 2, 3),
 s AS (SELECT o_orderkey AS question_id, unnest(['main', 'other']) AS db, {_SEED_CASE} AS seeds FROM orders), d AS (SELECT DISTINCT db, seeds FROM s),
 c AS (SELECT d.db, seeds, list_sort(list_distinct(list_concat(seeds, coalesce(flatten(list(path) FILTER (path IS NOT NULL)), [])))) AS tables
  FROM d LEFT JOIN paths ON paths.db = d.db AND list_contains(seeds, start) AND list_contains(seeds, stop) GROUP BY 1, 2),
 fk AS (SELECT * FROM (VALUES {_TWO_FKS}) t(db, s, sc, d, dc)), pk AS (SELECT * FROM (VALUES {", ".join(repr(e) for e in PRIMARY_KEYS.items())}) t(s, sc)),
 k AS (SELECT db, seeds, s || '.' || sc AS col FROM c, pk WHERE list_contains(tables, s) UNION SELECT c.db, seeds, s || '.' || sc FROM c JOIN fk USING (db) WHERE list_contains(tables, s) AND list_contains(tables, d)
 UNION SELECT c.db, seeds, d || '.' || dc FROM c JOIN fk USING (db) WHERE list_contains(tables, s) AND list_contains(tables, d)),
 g AS (SELECT db, seeds, string_agg(col, ',' ORDER BY col) AS cols FROM k GROUP BY 1, 2)
 SELECT question_id, s.db AS db_id, array_to_string(tables, ',') AS tables, cols FROM s JOIN c USING (db, seeds) JOIN g USING (db, seeds)""")
def closure_by_database(spark, sf):
    """R7 over two databases with the same table names: each order asks both."""
    columns, fks = None, None
    for db, links in TWO_DATABASES.items():
        own = catalog_columns(spark, read_tables(spark, sf, STAR_TABLES), PRIMARY_KEYS, db), catalog_fks(spark, links, db)
        columns, fks = own if columns is None else (columns.unionByName(own[0]), fks.unionByName(own[1]))
    seeds = order_seeds(spark, sf).withColumn("db_id", F.explode(F.array(*[F.lit(db) for db in TWO_DATABASES])))
    closed = catalog.closure(seeds, catalog.shortest_paths(fks))
    name = F.concat_ws(".", "table_name", "column_name")
    cols = catalog.retained_keys(closed, columns, fks).groupBy("question_id", "db_id").agg(F.array_join(F.sort_array(F.collect_list(name)), ",").alias("cols"))
    return closed.join(cols, ["question_id", "db_id"]).select("question_id", "db_id", F.array_join("tables", ",").alias("tables"), "cols")


_TABLE_WORDS = ", ".join(f"('{t}', '{(t + ' ' + ' '.join(cs)).replace('_', ' ')}')" for t, cs in STAR_COLUMNS.items())
_ALL_TABLES = "[" + ", ".join(f"'{t}'" for t in sorted(STAR_COLUMNS)) + "]"


@query("link_tables", f"""WITH RECURSIVE {PATHS_SQL}, q AS ({inputs.PART_QUESTIONS_SQL} UNION ALL {inputs.CUSTOMER_QUESTIONS_SQL}),
 qw AS (SELECT DISTINCT question_id, rtrim(unnest(regexp_extract_all(lower(question), '\\w+')), 's') AS w FROM q), tw AS (SELECT DISTINCT t, rtrim(unnest(string_split(names, ' ')), 's') AS w FROM (VALUES {_TABLE_WORDS}) v(t, names)),
 sc AS (SELECT question_id, t, count(*) AS s FROM qw JOIN tw USING (w) GROUP BY 1, 2), h AS (SELECT question_id, list(t ORDER BY s DESC, t) AS hits FROM sc GROUP BY 1),
 z AS (SELECT q.question_id, list_concat(coalesce(hits, []), list_filter({_ALL_TABLES}, lambda x: (NOT list_contains(coalesce(hits, []), x))))[1:3] AS seeds FROM q LEFT JOIN h USING (question_id)),
 n AS (SELECT question_id, list_sort(seeds) AS seeds FROM z), d AS (SELECT DISTINCT seeds FROM n),
 c AS (SELECT seeds, list_sort(list_distinct(flatten(list(path)))) AS tables FROM d, paths WHERE list_contains(seeds, start) AND list_contains(seeds, stop) GROUP BY 1)
 SELECT question_id, array_to_string(seeds, ',') AS seeds, array_to_string(tables, ',') AS tables FROM n JOIN c USING (seeds)""")
def link_tables(spark, sf):
    """C9."""
    columns, _, paths = star(spark, sf)
    asked = inputs.part_questions(spark, sf).unionByName(inputs.customer_questions(spark, sf))
    linked = catalog.link_tables(asked, columns, paths)
    return linked.select("question_id", F.array_join("seeds", ",").alias("seeds"), F.array_join("tables", ",").alias("tables"))


@query("budget_schema")
def budget_schema(spark, sf):
    """C10 over every question, with a budget that forces a choice of width."""
    columns, fks, paths = star(spark, sf)
    asked = inputs.questions(spark, sf)
    return catalog.budget_width(catalog.link_tables(asked, columns, paths), asked, columns, fks, byte_budget=1150).withColumn("tables", F.array_join("tables", ","))


DESCRIPTIONS = [
    ("orders", "o_orderstatus", "order status", "status of the order", "F means finished urgent orders; P stands for partial customers orders\nO: open customers account"),
    ("orders", "o_orderpriority", "priority", "how urgent an order is", "1-URGENT: most urgent orders"),
    ("orders", "total_text", "total price", "printed price of the order", ""),
    ("customer", "c_mktsegment", "segment", "market segment of the customer", ""),
    ("part", "p_type", "type of part", "product line", ""),
    ("nation", "n_name", "nation", "nation of a customer", ""),
]
_DESCRIPTION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("table_name", "column_name", "display_name", "description", "value_description")])


#: Columns of the described tables in schema order, with the SQL of those that are printed.
_PRINTED = {"total_text": "format('{:,.2f}', o_totalprice)", "season": "year(o_orderdate) || '/' || (year(o_orderdate) + 1)"}
DESCRIBED_COLUMNS = {
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "customer": ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "total_text", "season"], "nation": ["n_nationkey", "n_name"],
}
_TYPES = {(t, c): declared for t, c, declared in EVERY_COLUMN}
_DESCRIBED_ROWS = ", ".join(
    f"('{t}', '{c}', {i}, '{_TYPES.get((t, c), 'string')}', {PRIMARY_KEYS[t] == c})" for t, cs in DESCRIBED_COLUMNS.items() for i, c in enumerate(cs)
)
_DESCRIBED_VALUES = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, ({_PRINTED.get(c, c)})::VARCHAR AS value, count(*) AS frequency FROM {t} WHERE {_PRINTED.get(c, c)} IS NOT NULL GROUP BY 3"
    for t, cs in DESCRIBED_COLUMNS.items() for c in cs
)
_DESCRIBED_LINKS = ", ".join(repr(e) for e in FOREIGN_KEYS if e[0] in DESCRIBED_COLUMNS and e[2] in DESCRIBED_COLUMNS)
#: Identifier tokens (T2) of a text, each once.
_TOKENS = "list_distinct(list_transform(regexp_extract_all(translate(replace(lower(replace(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), 'ß', 'ss'), 'ςſ', 'σs'), '[a-z0-9]+'), lambda w: (CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)))"


def described_tables(spark, sf):
    """The tables whose values and columns the questions are grounded in, with printed columns."""
    year = F.year("o_orderdate")
    t = read_tables(spark, sf, ["part", "customer", "orders", "nation"])
    return {
        "part": t["part"].select("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
        "customer": t["customer"].select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"),
        "orders": t["orders"].select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
            F.format_number("o_totalprice", 2).alias("total_text"), F.concat(year.cast("string"), F.lit("/"), (year + 1).cast("string")).alias("season"),
        ),
        "nation": t["nation"].select("n_nationkey", "n_name"),
    }


def knowledge(spark, sf):
    """(counts, profile, index, fks) of the described tables, materialised as the knowledge store would be."""
    tables = described_tables(spark, sf)
    counts = written(profile.value_counts(tables))
    columns = catalog_columns(spark, tables, PRIMARY_KEYS)
    notes = spark.createDataFrame(DESCRIPTIONS, _DESCRIPTION_SCHEMA).coalesce(1)
    described = cut_lineage(profile.column_profile(counts, columns, notes))
    fks = catalog_fks(spark, [e for e in FOREIGN_KEYS if e[0] in tables and e[2] in tables])
    return counts, described, cut_lineage(profile.value_index(profile.top_values(counts))), fks


def _sampled(spark, sf):
    """Sampled profiles of the described tables, in schema order, with short notes."""
    union = None
    for table, df in described_tables(spark, sf).items():
        part = profile.sampled_profile(df, table, [PRIMARY_KEYS[table]])
        union = part if union is None else union.unionByName(part)
    notes = spark.createDataFrame(DESCRIPTIONS, _DESCRIPTION_SCHEMA).coalesce(1).select(
        "table_name", "column_name", F.left(text.squeeze(F.concat_ws(" ", "description", "value_description")), F.lit(160)).alias("note")
    )
    listed = [f"{t}.{c}" for t, cs in DESCRIBED_COLUMNS.items() for c in cs]
    place = F.array_position(F.array(*[F.lit(c) for c in listed]), F.concat_ws(".", "table_name", "column_name"))
    return cut_lineage(union.join(notes, ["table_name", "column_name"], "left").fillna("", ["note"]).withColumns({
        "holds_text": (F.col("storage") == "text") & (F.col("typed_count") > 0), "schema_pos": place,
    }))


@query("relevant_profiles")
def relevant_profiles(spark, sf):
    """P15 for every question."""
    asked = inputs.part_questions(spark, sf).unionByName(inputs.customer_questions(spark, sf))
    found = profile.relevant_profiles(asked, _sampled(spark, sf))
    return found.withColumns({"format_tags": F.array_join("format_tags", ","), "values": F.array_join("values", "|")})


@query("column_notes")
def column_notes(spark, sf):
    """C6, B1 for every question."""
    return catalog.column_notes(inputs.questions(spark, sf), _sampled(spark, sf), byte_budget=800)


@query("column_notes_sql_ready")
def column_notes_sql_ready(spark, sf):
    """C7, C8, B1 for every question."""
    return catalog.column_notes_sql_ready(inputs.questions(spark, sf), _sampled(spark, sf), byte_budget=500)[0]


@query("compact_schema")
def compact_schema(spark, sf):
    """C5 for every part and customer question."""
    tables = described_tables(spark, sf)
    columns = catalog_columns(spark, tables, PRIMARY_KEYS)
    fks = catalog_fks(spark, [e for e in FOREIGN_KEYS if e[0] in tables and e[2] in tables])
    notes = spark.createDataFrame(DESCRIPTIONS, _DESCRIPTION_SCHEMA).coalesce(1)
    asked = inputs.part_questions(spark, sf).unionByName(inputs.customer_questions(spark, sf))
    return catalog.compact_schema(asked, columns, fks, notes, byte_budget=900)


@query("catalog_docs", f"""WITH cat(t, c, o, type, pk) AS (VALUES {_DESCRIBED_ROWS}), fk(t, c, d, dc) AS (VALUES {_DESCRIBED_LINKS}), v AS ({_DESCRIBED_VALUES}),
 ex AS (SELECT t, c, 'values ' || string_agg(value, ', ' ORDER BY frequency DESC, value) AS description FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY t, c ORDER BY frequency DESC, value) <= 3) GROUP BY 1, 2),
 near AS (SELECT t, string_agg(DISTINCT d, ' ' ORDER BY d) AS near FROM fk GROUP BY 1)
 SELECT 'main' AS db_id, 'table:' || t AS doc_id, 'table' AS kind, t AS table_name, NULL AS column_name, -1 AS ordinal, 'table ' || t || '; columns ' || string_agg(c, ' ' ORDER BY o) || '; related tables ' || coalesce(any_value(near), '') AS "text", '' AS description
 FROM cat LEFT JOIN near USING (t) GROUP BY t
 UNION ALL SELECT 'main', 'column:' || t || '.' || c, 'column', t, c, o, 'column ' || t || '.' || c || '; type ' || type || CASE WHEN pk THEN '; primary key' ELSE '' END || coalesce(CASE WHEN pk THEN ' ' ELSE '; ' END || 'foreign key to ' || d || '.' || dc, '')
 || coalesce('; ' || description, ''), coalesce(description, '') FROM cat LEFT JOIN fk USING (t, c) LEFT JOIN ex USING (t, c)""")
def catalog_docs(spark, sf):
    """Schema documents whose descriptions list the most frequent stored values."""
    tables = described_tables(spark, sf)
    columns = catalog_columns(spark, tables, PRIMARY_KEYS)
    fks = catalog_fks(spark, [e for e in FOREIGN_KEYS if e[0] in tables and e[2] in tables])
    index = profile.value_index(profile.top_values(profile.value_counts(tables)))
    order = F.struct((-F.col("frequency")).alias("f"), "original")
    examples = index.groupBy("table_name", "column_name").agg(F.sort_array(F.collect_list(order)).alias("v")).select(
        "table_name", "column_name", F.lit("").alias("display_name"),
        F.concat(F.lit("values "), F.array_join(F.transform(F.slice("v", 1, 3), lambda s: s["original"]), ", ")).alias("description"),
        F.lit("").alias("value_description"),
    )
    return catalog.schema_documents(columns, fks, examples)


@query("full_selection", f"""WITH q AS ({inputs.CUSTOMER_QUESTIONS_SQL}), c AS (SELECT t, unnest(cs) AS c FROM (VALUES {", ".join(f"('{t}', {cs})" for t, cs in STAR_COLUMNS.items())}) v(t, cs))
 SELECT question_id, t AS table_name, c AS column_name, contains(' ' || replace(lower(question), '_', ' ') || ' ', ' ' || replace(c, '_', ' ') || ' ') AS exact_match FROM q, c""")
def full_selection(spark, sf):
    """C11."""
    columns, _, _ = star(spark, sf)
    return catalog.full_selection(inputs.customer_questions(spark, sf), columns).drop("is_pk")


@query("value_hints", f"""WITH q AS ({inputs.CUSTOMER_QUESTIONS_SQL}), t AS (SELECT question_id, CASE WHEN contains(question, 'refers to') THEN '1-URGENT' END AS term FROM q),
 v AS (SELECT DISTINCT o_orderpriority AS value FROM orders) SELECT question_id, value, rank FROM (SELECT question_id, value, row_number() OVER (PARTITION BY question_id ORDER BY value) AS rank
 FROM t JOIN v ON contains(lower(value), lower(term))) WHERE rank <= 3""")
def value_hints(spark, sf):
    """Distinct stored values that contain a quoted or defined term."""
    from groundscope.operators.ranking import top_k

    terms = inputs.customer_questions(spark, sf).select("question_id", F.explode(catalog.value_hint_terms()).alias("phrase"))
    counts = profile.value_counts({"orders": read_table(spark, sf, "orders").select("o_orderpriority")})
    found = match.probe_containing(terms, counts, 3).select("question_id", "value").distinct()
    return top_k(found, ["question_id"], [F.col("value")], 3)


# ---------------------------------------------------------------- retrieval


def name_documents(spark, sf):
    """Part names as documents, in name order of first use."""
    named = read_table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("position"), F.min("p_type").alias("description"))
    return named.select(
        F.col("p_name").alias("doc_id"), "position", F.lit("column").alias("kind"), F.lit("part").alias("table_name"), F.col("p_name").alias("column_name"),
        F.concat(F.lit("part "), "p_name").alias("text"), "description",
    )


RANKINGS = f"""WITH q AS ({inputs.PART_QUESTIONS_SQL}), dd AS (SELECT p_name AS doc_id, min(p_partkey) AS position, min(p_type) AS description FROM part GROUP BY 1),
 tok AS (SELECT question_id, list_transform(regexp_extract_all(lower(replace(regexp_replace(question, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '[a-z0-9]+'), lambda w: (CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)) AS t FROM q),
 dt AS (SELECT *, list_transform(regexp_extract_all('part ' || doc_id, '[a-z0-9]+'), lambda w: (CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)) AS t,
 list_transform(regexp_extract_all(doc_id, '[a-z0-9]+'), lambda w: (CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)) AS n,
 list_transform(regexp_extract_all(lower(description), '[a-z0-9]+'), lambda w: (CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)) AS e FROM dd),
 x AS (SELECT question_id, doc_id, position, len(list_intersect(tok.t, dt.t)) AS lo, len(list_intersect(tok.t, dt.e)) AS deo, contains(' ' || array_to_string(tok.t, ' ') || ' ', ' ' || array_to_string(n, ' ') || ' ') AS ex FROM tok, dt),
 lex AS (SELECT question_id, doc_id, lo AS overlap, row_number() OVER (PARTITION BY question_id ORDER BY lo DESC, doc_id) AS rank FROM x WHERE lo > 0),
 des AS (SELECT question_id, doc_id, deo AS overlap, row_number() OVER (PARTITION BY question_id ORDER BY deo DESC, doc_id) AS rank FROM x WHERE deo > 0),
 exa AS (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY position, doc_id) AS rank FROM x WHERE ex) """


@query("lexical_ranking", RANKINGS + "SELECT question_id, doc_id, overlap, rank FROM lex")
def lexical_ranking(spark, sf):
    """R2."""
    return retrieve.lexical_ranking(inputs.part_questions(spark, sf), name_documents(spark, sf)).select("question_id", "doc_id", "overlap", "rank")


@query("exact_ranking", RANKINGS + "SELECT question_id, doc_id, rank FROM exa")
def exact_ranking(spark, sf):
    """R3."""
    return retrieve.exact_ranking(inputs.part_questions(spark, sf), name_documents(spark, sf)).select("question_id", "doc_id", "rank")


@query("description_ranking", RANKINGS + "SELECT question_id, doc_id, overlap, rank FROM des")
def description_ranking(spark, sf):
    """R4."""
    return retrieve.description_ranking(inputs.part_questions(spark, sf), name_documents(spark, sf)).select("question_id", "doc_id", "overlap", "rank")


def _fused(spark, sf):
    asked, documents = inputs.part_questions(spark, sf), name_documents(spark, sf)
    return retrieve.fuse({
        "exact_identifier": retrieve.exact_ranking(asked, documents), "token_overlap": retrieve.lexical_ranking(asked, documents),
        "description_match": retrieve.description_ranking(asked, documents),
    })


FUSED = RANKINGS + """, u AS (SELECT question_id, doc_id, rank, 'token_overlap' AS reason FROM lex UNION ALL SELECT question_id, doc_id, rank, 'exact_identifier' FROM exa UNION ALL SELECT question_id, doc_id, rank, 'description_match' FROM des),
 fu AS (SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, string_agg(reason, ',' ORDER BY reason) AS reasons, min(rank) FILTER (reason = 'exact_identifier') AS exact_rank FROM u GROUP BY 1, 2) """


@query("rank_fusion", FUSED + "SELECT question_id, doc_id, round(score, 9) AS score, reasons FROM fu")
def rank_fusion(spark, sf):
    """R5, R8."""
    return _fused(spark, sf).select("question_id", "doc_id", F.round("score", 9).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query("select_documents", FUSED + """, al AS (SELECT q.question_id, d.doc_id, coalesce(round(score, 12), 0) AS score, exact_rank FROM q CROSS JOIN dd d LEFT JOIN fu ON fu.question_id = q.question_id AND fu.doc_id = d.doc_id)
 SELECT question_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN (SELECT count(*) FROM dd) > 40 THEN coalesce(exact_rank, 2147483647) ELSE 0 END, score DESC, doc_id) AS rank FROM al)
 WHERE rank <= CASE WHEN (SELECT count(*) FROM dd) <= 40 THEN (SELECT count(*) FROM dd) ELSE 32 END""")
def select_documents(spark, sf):
    """Exact hits first, then the best fused documents, from lists in blocks."""
    return retrieve.best_documents(inputs.part_questions(spark, sf), name_documents(spark, sf)).select("question_id", "doc_id", "rank")


@query("dense_topk", """WITH p AS (SELECT label, i::INT AS i, avg(embedding[i::INT]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM p GROUP BY 1),
 u AS (SELECT label, list(m / norm ORDER BY i) AS v FROM p JOIN n USING (label) GROUP BY 1), s AS (SELECT vec_id, u.label, list_dot_product(embedding::DOUBLE[], v) AS d FROM embeddings, u)
 SELECT vec_id AS question_id, label AS doc_id, round(d, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, label) AS rank FROM s) WHERE rank <= 3""")
def dense_topk(spark, sf):
    """Every embedding against the prototypes of all labels."""
    rows = read_table(spark, sf, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    prototypes = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("v")).select(
        F.col("label").alias("doc_id"), l2_normalize(F.col("v")).alias("vector")
    )
    asked = rows.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return retrieve.dense_ranking(asked, prototypes, 3).withColumn("similarity", F.round("similarity", 6))


@query("hybrid_ranking")
def hybrid_ranking(spark, sf):
    """Fusion with the default encoder for every part question."""
    asked, documents = inputs.part_questions(spark, sf), name_documents(spark, sf)
    dense = retrieve.dense_ranking(
        asked.select("question_id", hashed_encoder("question").alias("vector")), documents.select("doc_id", hashed_encoder("text").alias("vector"))
    )
    fused = retrieve.fuse({
        "exact_identifier": retrieve.exact_ranking(asked, documents), "dense_similarity": dense, "token_overlap": retrieve.lexical_ranking(asked, documents),
    })
    return fused.select("question_id", "doc_id", F.round("score", 9).alias("score"), F.array_join("reasons", ",").alias("reasons"))


CONCEPTS = ["part name", "customer nation", "orders", "order total price", "mktsegment", "zzz"]


def concepts(spark, sf):
    pick = F.element_at(F.array(*[F.lit(c) for c in CONCEPTS]), (F.col("p_size") % 6 + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(c) for c in CONCEPTS]), ((F.col("p_partkey") % 6) + 1).cast("int"))
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("question_id"), F.explode(F.array_distinct(F.array(pick, other))).alias("concept"))


_STEM = "lambda w: (CASE WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)"
GROUNDED = f"""WITH c AS (SELECT DISTINCT p_partkey AS question_id, unnest([{CONCEPTS}[p_size % 6 + 1], {CONCEPTS}[p_partkey % 6 + 1]]) AS concept FROM part),
 cat AS (SELECT t, unnest(cs) AS c FROM (VALUES {", ".join(f"('{t}', {cs})" for t, cs in STAR_COLUMNS.items())}) v(t, cs)),
 tk AS (SELECT t, c, list_distinct(list_transform(regexp_extract_all(replace(t || ' ' || c, '_', ' '), '[a-z0-9]+'), {_STEM})) AS a, list_sort(list_distinct(list_transform(regexp_extract_all(replace(c, '_', ' '), '[a-z0-9]+'), {_STEM}))) AS ct,
 list_sort(list_distinct(list_transform(regexp_extract_all(t, '[a-z0-9]+'), {_STEM}))) AS tt FROM cat),
 co AS (SELECT concept, list_sort(list_distinct(list_transform(regexp_extract_all(concept, '[a-z0-9]+'), {_STEM}))) AS k FROM (SELECT DISTINCT concept FROM c)),
 sc AS (SELECT concept, t, c AS col, 8 * (k = ct)::INT + 5 * (k = tt)::INT + 3 * len(list_intersect(k, a)) + 1 AS score, CASE WHEN k = ct THEN 'high' WHEN len(list_intersect(k, a)) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM co, tk),
 b AS (SELECT question_id, concept, t AS table_name, col AS column_name, score::INT AS score, confidence, row_number() OVER (PARTITION BY question_id, concept ORDER BY score DESC, t || '.' || col) AS rank FROM c JOIN sc USING (concept)),
 kept AS (SELECT * FROM b WHERE rank <= 2) """


def _bindings(spark, sf):
    columns, _, _ = star(spark, sf)
    no_evidence = spark.createDataFrame([], "question_id long, table_name string, column_name string, phrase string, description string")
    return retrieve.ground_concepts(concepts(spark, sf), columns, no_evidence)


@query("ground_concepts", GROUNDED + "SELECT * FROM kept")
def ground_concepts(spark, sf):
    """R9."""
    return _bindings(spark, sf)


@query("grounding_summary", GROUNDED + """, m AS (SELECT question_id, concept, max(score) AS a, min(score) AS z, count(*) AS n, arg_min(confidence, rank) AS cf FROM kept GROUP BY 1, 2)
 SELECT question_id, 0::BIGINT AS ungrounded, count(*) FILTER (n > 1 AND a - z <= 2) AS ambiguous, bool_and(NOT (n > 1 AND a - z <= 2) AND cf = 'high') AS high_confidence FROM m GROUP BY question_id""")
def grounding_summary(spark, sf):
    """R9, W6."""
    return retrieve.grounding_summary(concepts(spark, sf), _bindings(spark, sf))


# ---------------------------------------------------------------- packing


@query("greedy_pack", """WITH RECURSIVE n AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
 st AS (SELECT lang, 0::BIGINT AS i, NULL::BIGINT AS doc_id, 0::BIGINT AS used, 0 AS cnt, false AS kept FROM (SELECT DISTINCT lang FROM documents)
 UNION ALL SELECT n.lang, n.i, n.doc_id, CASE WHEN cnt < 40 AND used + n_chars + CASE WHEN cnt > 0 THEN 1 ELSE 0 END <= 20000 THEN used + n_chars + CASE WHEN cnt > 0 THEN 1 ELSE 0 END ELSE used END,
 CASE WHEN cnt < 40 AND used + n_chars + CASE WHEN cnt > 0 THEN 1 ELSE 0 END <= 20000 THEN cnt + 1 ELSE cnt END, cnt < 40 AND used + n_chars + CASE WHEN cnt > 0 THEN 1 ELSE 0 END <= 20000
 FROM st JOIN n ON n.lang = st.lang AND n.i = st.i + 1)
 SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position, max(used) OVER (PARTITION BY lang) AS bytes_used FROM st WHERE kept""")
def greedy_pack_documents(spark, sf):
    """Documents of a language packed into 20,000 characters and 40 places, misfits skipped."""
    doc = read_table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    packed = greedy_pack(doc, ["lang"], [F.col("doc_id")], "n_chars", 20000, limit=40, separator=1)
    return packed.select("lang", "doc_id", "position", "bytes_used")


@query("prefix_pack", """SELECT lang, doc_id, position, bytes_used FROM (SELECT lang, doc_id, row_number() OVER w AS position, (sum(n_chars) OVER w + row_number() OVER w - 1)::BIGINT AS bytes_used FROM documents
 WINDOW w AS (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE bytes_used <= 20000""")
def prefix_pack_documents(spark, sf):
    """B2: documents of a language until the first that overflows."""
    doc = read_table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return prefix_pack(doc, ["lang"], [F.col("doc_id")], "n_chars", 20000, separator=1).select("lang", "doc_id", "position", "bytes_used")


# ---------------------------------------------------------------- evidence


@query("column_relevance", f"""WITH asked AS ({inputs.QUESTIONS_SQL}), cat(t, c, o, type, pk) AS (VALUES {_DESCRIBED_ROWS}), notes(t, c, display, description, explained) AS (VALUES {", ".join(str(n).replace(chr(92) + "n", " ") for n in DESCRIPTIONS)}),
 d AS (SELECT t, c, coalesce(display || ' ' || description || ' ' || explained, '') AS said FROM cat LEFT JOIN notes USING (t, c)),
 w AS (SELECT t, c, unnest({_TOKENS.format("t || ' ' || c || ' ' || said")}) AS term, 1 AS weight, false AS s, false AS n FROM d UNION ALL SELECT t, c, unnest({_TOKENS.format("t || ' ' || c")}), 2, false, true FROM d
 UNION ALL SELECT t, c, unnest({_TOKENS.format("said")}), 0, true, false FROM d UNION ALL SELECT t, cat.c, term, 1, false, false FROM cat JOIN (SELECT DISTINCT t, unnest({_TOKENS.format("c || ' ' || said")}) AS term FROM d) USING (t)),
 terms AS (SELECT t, c, term, sum(weight) AS weight, bool_or(s) AS s, bool_or(n) AS n FROM w GROUP BY 1, 2, 3),
 q AS (SELECT question_id, unnest(list_filter({_TOKENS.format("string_split(question, 'Benchmark evidence:')[1]")}, lambda x: (NOT list_contains({CONCEPT_STOP}, x)))) AS term FROM asked)
 SELECT question_id, t AS table_name, c AS column_name, sum(weight)::BIGINT AS column_relevance, coalesce(string_agg(term, ' ' ORDER BY term) FILTER (s), '') AS said, coalesce(string_agg(term, ' ' ORDER BY term) FILTER (n), '') AS named
 FROM q JOIN terms USING (term) GROUP BY 1, 2, 3""")
def column_relevance(spark, sf):
    """E1 for every question."""
    _, described, _, _ = knowledge(spark, sf)
    found = evidence.column_relevance(inputs.questions(spark, sf), described)
    return found.withColumns({"said": F.array_join("said", " "), "named": F.array_join("named", " ")})


def fact_parts(spark, sf, asked):
    counts, described, index, fks = knowledge(spark, sf)
    relevance = cut_lineage(evidence.column_relevance(asked, described))
    phrases = cut_lineage(match.concept_phrases(asked))
    probed = evidence.explicit_probes(phrases, index, relevance, counts)
    parts = [
        evidence.literal_facts(phrases, index, relevance, probed), evidence.normalization_facts(asked, index, relevance),
        evidence.storage_facts(asked, described, relevance), evidence.semantics_facts(described, relevance), evidence.encoded_facts(asked, index, described),
    ]
    return evidence.gather(parts), fks, counts


def packet(spark, sf, mode="all"):
    """(packed, fks, counts, to_all): the packed facts of one question for each natural text, which is all that facts follow
    from, and what gives rows of those questions to all questions."""
    questions = inputs.part_questions(spark, sf).unionByName(inputs.customer_questions(spark, sf)).select("question_id", text.natural_part("question").alias("question"))
    asked = one_of_each(questions, ["question"])
    facts, fks, counts = fact_parts(spark, sf, asked)
    return evidence.assemble(facts, fks, mode), fks, counts, lambda found: for_all(found, questions, asked, ["question"])


@query("evidence_packet")
def evidence_packet(spark, sf):
    """The packed facts of every question."""
    packed, _, _, to_all = packet(spark, sf)
    return to_all(packed.select("question_id", "position", "bytes_used", "type", "phrase", "table_name", "column_name", "db_value", "confidence", "line"))


@query("packet_identity")
def packet_identity(spark, sf):
    """The identity covers the knowledge that a packet was drawn from."""
    tables = described_tables(spark, sf)
    notes = spark.createDataFrame(DESCRIPTIONS, _DESCRIPTION_SCHEMA).coalesce(1)
    drawn_from = KnowledgeStore(spark, "").identity(tables, catalog_columns(spark, tables, PRIMARY_KEYS), notes)
    packed, _, _, to_all = packet(spark, sf)
    return evidence.lines_identity(to_all(evidence.packet_lines(packed)), "all", drawn_from)


@query("scoped_packet")
def scoped_packet(spark, sf):
    """E11, B2."""
    packed, _, _, to_all = packet(spark, sf)
    return to_all(evidence.scope(packed).select("question_id", "fact_position", "evidence_id", "allowed", "forbidden", "section", "bytes_used"))


@query("verified_packet")
def verified_packet(spark, sf):
    """The first four probeable facts of every packet verified against all stored values."""
    packed, fks, counts, to_all = packet(spark, sf)
    return to_all(probe.verify(evidence.scope(packed), counts, fks))


_DESCRIBED = sorted(inputs.TEXT_COLUMNS)
_PACKET_FKS = [e for e in FOREIGN_KEYS if e[0] in _DESCRIBED and e[2] in _DESCRIBED]
_PACKET_TEXTS = [("customer", "c_name"), ("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority")]
_SMALL_PARTS = [("part", "p_name"), ("part", "p_type"), ("customer", "c_name")]
_CUSTOMERS = [("customer", "c_name"), ("customer", "c_mktsegment"), ("nation", "n_name")]


def _pairs(columns) -> str:
    return ", ".join(f"('{t}', '{c}')" for t, c in columns)


def _json(*fields: str) -> str:
    return "to_json({" + ", ".join(fields) + "})::VARCHAR"


_EVERY_TEXT = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c} AS value, count(*) AS frequency FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t, cs in inputs.TEXT_COLUMNS.items() for c in cs)
BOUNDED_SQL = f"""WITH RECURSIVE asked AS ({inputs.PART_QUESTIONS_SQL} UNION ALL {inputs.CUSTOMER_QUESTIONS_SQL}), {PHRASES_SQL}, idx AS ({inputs.INDEX_SQL}), prof AS ({PROFILE_SQL}),
sel AS (SELECT 'p-' || p_partkey AS question_id, s.* FROM part, (VALUES {_pairs(_SMALL_PARTS)}) s(t, c) WHERE p_size <= 25 UNION ALL SELECT 'c-' || c_custkey, s.* FROM customer, (VALUES {_pairs(_CUSTOMERS)}) s(t, c)),
limited AS (SELECT DISTINCT question_id FROM sel),
met AS (SELECT l, r FROM (SELECT DISTINCT normalized AS l FROM base), (SELECT DISTINCT normalized AS r FROM idx) WHERE l = r OR (length(l) >= 3 AND contains(r, l)) OR (length(r) >= 3 AND contains(l, r))),
val AS (SELECT question_id, table_name AS t, column_name AS c, original, idx.normalized, frequency, arg_min(phrase, pos) AS phrase FROM base JOIN met ON l = base.normalized JOIN idx ON idx.normalized = r
 WHERE question_id NOT IN (FROM limited) OR (question_id, table_name, column_name) IN (FROM sel) GROUP BY 1, 2, 3, 4, 5, 6),
qt AS (SELECT question_id, unnest({_TOKENS.format("question")}) AS term FROM asked), ct AS (SELECT table_name AS t, column_name AS c, unnest({_TOKENS.format("table_name || ' ' || column_name || ' ' || description")}) AS term FROM prof WHERE table_name IN {tuple(_DESCRIBED)}),
col AS (SELECT question_id, t, c, list_sort(list(term)) AS terms FROM qt JOIN ct USING (term) WHERE question_id NOT IN (FROM limited) OR (question_id, t, c) IN (FROM sel) GROUP BY 1, 2, 3),
path AS (SELECT question_id, no, tables FROM asked, (VALUES {", ".join(f"({i}, ['{s}', '{d}'])" for i, (s, _, d, _) in enumerate(_PACKET_FKS))}) p(no, tables)),
have AS (SELECT question_id, sum(n)::BIGINT AS facts FROM (SELECT question_id, count(*) AS n FROM val GROUP BY 1 UNION ALL SELECT question_id, count(*) FROM col GROUP BY 1 UNION ALL SELECT question_id, count(*) FROM path GROUP BY 1) GROUP BY 1),
miss AS (SELECT question_id, phrase, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS i FROM base WHERE (question_id, normalized) NOT IN (SELECT (question_id, lower(phrase)) FROM val) QUALIFY i <= 4),
txt AS (SELECT t, c, row_number() OVER () AS o FROM (VALUES {_pairs([*_PACKET_TEXTS, ("nation", "n_name"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type")])}) v(t, c)), every AS (SELECT t, c, CASE t WHEN 'customer' THEN 1 WHEN 'nation' THEN 2 WHEN 'orders' THEN 3 ELSE 4 END * 100 + o AS o FROM txt),
pc AS (SELECT question_id, t, c, row_number() OVER (PARTITION BY question_id ORDER BY o) AS j FROM (SELECT question_id, t, c, o FROM sel JOIN every USING (t, c) UNION ALL SELECT question_id, t, c, o FROM asked, every WHERE question_id NOT IN (FROM limited)) QUALIFY j <= 4),
every_text AS ({_EVERY_TEXT}), words AS (SELECT DISTINCT phrase, t, c FROM miss JOIN pc USING (question_id)),
hit AS (SELECT phrase, words.t, words.c, value, frequency FROM words JOIN every_text e ON e.t = words.t AND e.c = words.c AND contains(lower(value), lower(phrase)) QUALIFY row_number() OVER (PARTITION BY phrase, words.t, words.c ORDER BY frequency DESC, value) <= 5),
pair AS (SELECT question_id, i, j, n, row_number() OVER (PARTITION BY question_id ORDER BY i, j) AS step FROM (SELECT question_id, i, j, (SELECT count(*) FROM hit WHERE hit.phrase = miss.phrase AND hit.t = pc.t AND hit.c = pc.c) AS n FROM miss JOIN pc USING (question_id))),
walk AS (SELECT question_id, 0::BIGINT AS step, 0 AS probes, coalesce(facts, 0) AS facts, 0::BIGINT AS answered, 0::BIGINT AS i, 0::BIGINT AS j, false AS made FROM asked LEFT JOIN have USING (question_id)
 UNION ALL SELECT question_id, pair.step, CASE WHEN go THEN probes + 1 ELSE probes END, CASE WHEN go THEN facts + n ELSE facts END, CASE WHEN go AND n > 0 THEN pair.i ELSE answered END, pair.i, pair.j, go AND n > 0
 FROM (SELECT w.question_id, w.probes, w.facts, w.answered, p.step, p.i, p.j, p.n, probes < 4 AND facts < 12 AND answered <> p.i AS go FROM walk w JOIN pair p ON p.question_id = w.question_id AND p.step = w.step + 1) pair),
fact AS (SELECT question_id, 1 AS priority, t, c, 0 AS stage, 0::BIGINT AS f1, -frequency AS f2, original AS f3, {_json("kind: 'value'", "'table': t", "'column': c", "printed_value: original", "normalized_value: normalized", "frequency: frequency", "pattern: NULL", "numeric_value: NULL", "date_value: NULL", "matched_phrase: phrase", "reason: 'exact_or_normalized_value'")} AS fact FROM val
 UNION ALL SELECT question_id, 1, t, c, 1, i, -frequency, value, {_json("kind: 'value'", "'table': t", "'column': c", "printed_value: value", "normalized_value: lower(value)", "frequency: frequency", "matched_phrase: phrase", "reason: 'bounded_read_only_probe'")} FROM walk JOIN miss USING (question_id, i) JOIN pc USING (question_id, j) JOIN hit USING (phrase, t, c) WHERE made
 UNION ALL SELECT question_id, 2, '', '', 0, no, 0, '', {_json("kind: 'join_path'", "tables: tables", "reason: 'foreign_key_closure'")} FROM path
 UNION ALL SELECT question_id, 3, t, c, 0, 0, 0, '', {_json("kind: 'column'", "'table': t", "'column': c", "description: description", "declared_type: declared_type", "types: types::JSON", "numeric_min: numeric_min", "numeric_max: numeric_max", "reason: 'question_description_overlap'", "matched_terms: terms")} FROM col JOIN prof ON t = table_name AND c = column_name
 UNION ALL SELECT question_id, 0, '', '', 0, 0, 0, '', {_json("kind: 'oracle_benchmark_evidence'", "text: left(said, 1200)", "reason: 'diagnostic_only'")} FROM (SELECT question_id, trim(string_split(question, 'Benchmark evidence:')[2], ' ' || chr(10)) AS said FROM asked) WHERE length(said) > 0),
line AS (SELECT question_id, mode, fact, strlen(fact) AS b, row_number() OVER (PARTITION BY question_id, mode ORDER BY priority, t, c, stage, f1, f2, f3) AS k FROM fact JOIN (VALUES ('oracle', 0), ('generated', 1)) m(mode, least) ON priority >= least),
fold AS (SELECT question_id, mode, 0::BIGINT AS k, 2::BIGINT AS used, 0 AS cnt, '' AS body FROM asked, (VALUES ('none'), ('oracle'), ('generated')) m(mode)
 UNION ALL SELECT f.question_id, f.mode, l.k, CASE WHEN cnt < 12 AND used + b + (cnt > 0)::INT <= 4096 THEN used + b + (cnt > 0)::INT ELSE used END, CASE WHEN cnt < 12 AND used + b + (cnt > 0)::INT <= 4096 THEN cnt + 1 ELSE cnt END,
 CASE WHEN cnt < 12 AND used + b + (cnt > 0)::INT <= 4096 THEN body || CASE WHEN cnt > 0 THEN ',' ELSE '' END || fact ELSE body END FROM fold f JOIN line l ON l.question_id = f.question_id AND l.mode = f.mode AND l.k = f.k + 1 WHERE cnt < 12)
SELECT question_id, mode, arg_max(cnt, k) AS n_facts, arg_max(used, k) AS n_bytes, '[' || arg_max(body, k) || ']' AS "text" FROM fold GROUP BY question_id, mode"""


@query("bounded_packet", BOUNDED_SQL)
def bounded_packet(spark, sf):
    """The bounded packets of all questions in all modes; customers and small parts ask about selected columns only."""
    chooser = F.when(F.col("p_size") <= 25, "part")
    questions = inputs.part_questions(spark, sf, chooser=chooser).unionByName(inputs.customer_questions(spark, sf, chooser=F.lit("customer")))
    # A packet follows from the whole text and the selection.
    kind = ["question", "chooser"]
    asked = one_of_each(questions, kind)
    tables = read_tables(spark, sf, _DESCRIBED)
    columns = catalog_columns(spark, tables, PRIMARY_KEYS)
    counts = profile.value_counts(tables)
    # Values are looked for among texts only; the others are counted for the profile and not kept.
    texts = written(counts.filter("storage = 'text'"))
    notes = columns.filter("column_name LIKE '%_mktsegment'").select(
        "table_name", "column_name", F.lit("segment").alias("display_name"), F.lit("market segment of the customer").alias("description"), F.lit("").alias("value_description")
    )
    described = cut_lineage(profile.column_profile(texts.unionByName(counts.filter("storage <> 'text'")), columns, notes))

    def chosen(listed):
        return F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name")) for t, c in listed])

    listed = F.when(F.col("chooser") == "part", chosen(_SMALL_PARTS)).when(F.col("chooser") == "customer", chosen(_CUSTOMERS))
    selected = asked.select("question_id", F.explode(listed).alias("c")).select("question_id", "c.*")
    links = F.explode(F.array(*[F.struct(F.lit(i).alias("path_no"), F.array(F.lit(s), F.lit(d)).alias("tables")) for i, (s, _, d, _) in enumerate(_PACKET_FKS)]))
    paths = asked.select("question_id", links.alias("p")).select("question_id", "p.*")
    facts = bounded.gather(asked, inputs.text_index(spark, sf), described, columns, texts, paths, selected)
    return for_all(bounded.packets(asked, facts).drop("identity"), questions, asked, kind)


@query("route_ablation")
def route_ablation(spark, sf):
    """The four routing modes scored against the values each question was made from."""
    questions = inputs.part_questions(spark, sf, name=F.col("p_name"), kind=F.col("p_type"))
    # Parts with the same question and the same values are one case that counts as often as they are.
    asked = cut_lineage(questions.groupBy("question", "name", "kind").agg(F.min("question_id").alias("question_id"), F.count("*").alias("weight")))
    facts_found, fks, _ = fact_parts(spark, sf, asked.select("question_id", "question"))
    gold = asked.select(
        F.col("question_id").alias("case_id"), F.explode(F.array(
            F.struct(F.lit("p_name").alias("column_name"), F.col("name").alias("value")), F.struct(F.lit("p_type").alias("column_name"), F.lower("kind").alias("value")),
        )).alias("g"),
    ).select("case_id", F.lit("part").alias("table_name"), "g.*")
    cases = asked.select(F.col("question_id").alias("case_id"), F.lit("all").alias("group"), "weight")
    report = None
    for mode in evidence.MODES:
        packed = evidence.assemble(facts_found, fks, mode)
        facts = packed.select(
            F.col("question_id").alias("case_id"), F.col("position").alias("fact_no"), "table_name", "column_name", text.normalize("db_value").alias("value"),
            "transformation",
        )
        scored = metrics.evidence_metrics(cases, facts, gold).withColumn("mode", F.lit(mode))
        report = scored if report is None else report.unionByName(scored)
    judged = stats.gate(report, {"literal_recall": F.col("literal_recall") >= 0.6, "evidence_precision": F.col("evidence_precision") >= 0.5})
    return judged.withColumn("failed_rules", F.array_join("failed_rules", ","))


# ---------------------------------------------------------------- probes


@query("probe_existence", """WITH f AS (SELECT DISTINCT 'part' AS table_name, 'p_name' AS column_name, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' x' END AS db_value FROM part
 UNION SELECT DISTINCT 'orders', 'o_orderpriority', o_orderpriority FROM orders), v AS (SELECT 'part' AS t, p_name AS v, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'orders', o_orderpriority, count(*) FROM orders GROUP BY 2)
 SELECT table_name, column_name, db_value, coalesce(n, 0) AS match_count, coalesce(n, 0) > 0 AS verified FROM f LEFT JOIN v ON t = table_name AND v = db_value""")
def probe_existence(spark, sf):
    """X1."""
    part, orders = read_table(spark, sf, "part"), read_table(spark, sf, "orders")
    facts = part.select(
        F.lit("part").alias("table_name"), F.lit("p_name").alias("column_name"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x"))).alias("db_value"),
    ).unionByName(orders.select(F.lit("orders").alias("table_name"), F.lit("o_orderpriority").alias("column_name"), F.col("o_orderpriority").alias("db_value")))
    counts = profile.value_counts({"part": part.select("p_name"), "orders": orders.select("o_orderpriority")})
    return probe.value_existence(facts, counts)


@query("probe_numeric", """WITH v AS (SELECT 'o_totalprice' AS column_name, o_totalprice::VARCHAR AS t, 1 AS native FROM orders UNION ALL SELECT 'total_text', format('{:,.2f}', o_totalprice), 0 FROM orders
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, 0 FROM orders) SELECT 'orders' AS table_name, column_name, count(*) AS non_null_count, sum(native)::BIGINT AS native_numeric_count, count(try_cast(t AS DOUBLE)) AS parsed_count,
 min(try_cast(t AS DOUBLE)) AS numeric_min, max(try_cast(t AS DOUBLE)) AS numeric_max, min(coalesce(try_cast(nullif(regexp_extract(t, '^[0-9]+(\\.[0-9]*)?'), '') AS DOUBLE), 0)) AS forced_min,
 max(coalesce(try_cast(nullif(regexp_extract(t, '^[0-9]+(\\.[0-9]*)?'), '') AS DOUBLE), 0)) AS forced_max FROM v GROUP BY column_name""")
def probe_numeric(spark, sf):
    """Native numbers, printed numbers and codes."""
    orders = read_table(spark, sf, "orders").select("o_totalprice", F.format_number("o_totalprice", 2).alias("total_text"), "o_orderpriority")
    return probe.numeric_storage(profile.value_counts({"orders": orders}))


@query("probe_join", "\nUNION ALL\n".join(
    f"SELECT '{s}' AS src_table, '{sc}' AS src_column, '{d}' AS dst_table, '{dc}' AS dst_column, count(*) AS joined_row_count FROM {s} JOIN {d} ON {sc} = {dc}" for s, sc, d, dc in FOREIGN_KEYS
))
def probe_join(spark, sf):
    """X3 for all declared foreign keys at once."""
    keys = sorted({c for s, sc, d, dc in FOREIGN_KEYS for c in (sc, dc)})
    counts = profile.value_counts(read_tables(spark, sf, STAR_TABLES), keys)
    return probe.join_cardinality(catalog_fks(spark, FOREIGN_KEYS).drop("db_id"), counts)
