"""Catalog documents, table linking and budgeted schema renderings.

The catalog itself is metadata. Whatever depends on the number of questions is a join or a fold over
questions; per question only catalog-sized arrays are carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.functions import text
from groundscope.operators.joins import join_few, join_many, spread
from groundscope.operators.packing import greedy_pack
from groundscope.operators.profile import KEY
from groundscope.operators.ranking import top_k
from groundscope.session import cut_lineage

# Headers and names of the renderings.
SCHEMA_HEADER = "[Database: SQLite; schema-format: m-schema-sqlite-v1]"
NOTES_HEADER = "### Column notes"
NOTES_HEADER_SQL_READY = "### Column notes (identifiers are written exactly as they must appear in SQL)"
WIDTHS = [32, 20, 12, 6, 0]


def adjacency(fks: DataFrame) -> DataFrame:
    """Undirected table neighbours."""
    there = fks.select("db_id", F.col("src_table").alias("a"), F.col("dst_table").alias("b"))
    back = fks.select("db_id", F.col("dst_table").alias("a"), F.col("src_table").alias("b"))
    return there.union(back).distinct()


def shortest_paths(fks: DataFrame) -> DataFrame:
    """Shortest table path between every ordered pair of a database: (db_id, start, stop, path).

    Each round extends the paths of the last round by one edge of their own database and keeps those that reach a
    table for the first time. Of equally short paths the first by names is kept, which is the one a search
    finds that visits neighbours in name order. Rounds are as many as the longest shortest path.
    """
    near = cut_lineage(adjacency(fks).withColumnRenamed("a", "stop"))
    found = frontier = cut_lineage(near.select("db_id", F.col("stop").alias("start"), "stop", F.array("stop").alias("path")).distinct())
    while not frontier.isEmpty():
        longer = frontier.join(near, ["db_id", "stop"]).groupBy("db_id", "start", F.col("b").alias("stop")).agg(
            F.min(F.concat("path", F.array("b"))).alias("path")
        )
        frontier = cut_lineage(longer.join(found.select("db_id", "start", "stop"), ["db_id", "start", "stop"], "left_anti"))
        found = found.union(frontier)
    return found


def _database(*frames: DataFrame) -> list[str]:
    """The database as a key of its own, where all frames tell it; frames of one database may leave it out."""
    return ["db_id"] if all("db_id" in f.columns for f in frames) else []


def closure(seeds: DataFrame, paths: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """Tables on the shortest paths between the seed tables of each question, within its database.

    ``seeds``: keys, db_id (unless there is one database only), table_name. Questions share few distinct seed
    sets, so each set is closed once.
    """
    db = _database(seeds, paths)
    sets = seeds.groupBy(*keys, *db).agg(F.sort_array(F.collect_set("table_name")).alias("seeds"))
    distinct = sets.select(*db, "seeds").distinct()
    starts = distinct.select(*db, "seeds", F.explode("seeds").alias("start"))
    between = (
        starts.join(paths.select(*db, "start", "stop", "path"), [*db, "start"])
        .filter(F.array_contains("seeds", F.col("stop")))
        .groupBy(*db, "seeds")
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("path")))).alias("on_paths"))
    )
    closed = distinct.join(between, [*db, "seeds"], "left").select(
        *db, "seeds", F.sort_array(F.array_union("seeds", F.coalesce("on_paths", F.array().cast("array<string>")))).alias("tables")
    )
    return sets.join(closed, [*db, "seeds"]).select(*keys, *db, "seeds", "tables")


def retained_keys(closed: DataFrame, catalog: DataFrame, fks: DataFrame, keys: Sequence[str] = ("question_id",)) -> DataFrame:
    """Primary keys of the closed tables and both ends of the foreign keys among them, within each database."""
    db = _database(closed, catalog, fks)
    distinct = closed.select(*db, "tables").distinct()
    opened = distinct.select(*db, "tables", F.explode("tables").alias("table_name"))
    primary = opened.join(catalog.filter("is_pk").select(*db, *KEY), [*db, "table_name"]).select(*db, "tables", *KEY)
    linked = opened.join(
        fks.select(*db, F.col("src_table").alias("table_name"), "src_column", "dst_table", "dst_column"), [*db, "table_name"]
    ).filter(F.array_contains("tables", F.col("dst_table")))
    source = linked.select(*db, "tables", "table_name", F.col("src_column").alias("column_name"))
    target = linked.filter("dst_column IS NOT NULL").select(
        *db, "tables", F.col("dst_table").alias("table_name"), F.col("dst_column").alias("column_name")
    )
    kept = primary.union(source).union(target).distinct()
    return closed.select(*keys, *db, "tables").join(kept, [*db, "tables"]).select(*keys, *db, *KEY)


def _described(catalog: DataFrame, descriptions: DataFrame | None) -> DataFrame:
    if descriptions is None:
        blank = F.lit("")
        return catalog.withColumns({"display_name": blank, "description": blank, "value_description": blank})
    notes = descriptions.select(
        F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c"), "display_name", "description", "value_description"
    )
    match = (F.lower("table_name") == F.col("_t")) & (F.lower("column_name") == F.col("_c"))
    return catalog.join(notes, match, "left").drop("_t", "_c").fillna("", ["display_name", "description", "value_description"])


def schema_documents(catalog: DataFrame, fks: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """C4: one text per table and one per column, empty parts dropped."""
    neighbours = fks.groupBy("db_id", F.col("src_table").alias("table_name")).agg(
        F.array_join(F.sort_array(F.collect_set("dst_table")), " ").alias("near")
    )
    columns = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"])
    tables = (
        catalog.groupBy("db_id", "table_name").agg(F.array_join(columns, " ").alias("columns"))
        .join(neighbours, ["db_id", "table_name"], "left")
        .select(
            "db_id", F.concat(F.lit("table:"), "table_name").alias("doc_id"), F.lit("table").alias("kind"), "table_name",
            F.lit(None).cast("string").alias("column_name"), F.lit(-1).alias("ordinal"),
            F.concat(F.lit("table "), "table_name", F.lit("; columns "), "columns", F.lit("; related tables "), F.coalesce("near", F.lit(""))).alias("text"),
            F.lit("").alias("description"),
        )
    )
    links = fks.select("db_id", F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name"),
                       F.concat_ws(".", "dst_table", "dst_column").alias("target"))
    role = F.concat_ws(
        " ", F.when(F.col("is_pk"), "primary key"), F.when(F.col("target").isNotNull(), F.concat(F.lit("foreign key to "), "target"))
    )
    parts = F.array(
        F.concat(F.lit("column "), "table_name", F.lit("."), "column_name"), F.concat(F.lit("type "), F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown"))),
        role, F.col("display_name"), F.col("description"), F.col("value_description"),
    )
    described = _described(catalog, descriptions).join(links, ["db_id", "table_name", "column_name"], "left").select(
        "db_id", F.concat(F.lit("column:"), "table_name", F.lit("."), "column_name").alias("doc_id"), F.lit("column").alias("kind"),
        "table_name", "column_name", "ordinal", F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "; ").alias("text"), "description",
    )
    return tables.unionByName(described)


def _stems(value) -> Column:
    """Words with every trailing s removed, as a set."""
    return F.array_distinct(F.transform(
        F.regexp_extract_all(F.lower(F.replace(value if isinstance(value, Column) else F.col(value), F.lit("_"), F.lit(" "))), F.lit(r"(?U)\w+"), 0),
        lambda w: F.rtrim(w, F.lit("s")),
    ))


def link_tables(questions: DataFrame, catalog: DataFrame, paths: DataFrame, seeds: int = 3) -> DataFrame:
    """The best ``seeds`` tables by shared words, closed over foreign keys; small schemas stay whole.

    A table without a shared word scores zero and ranks in catalog order behind all hits.
    """
    tables = catalog.groupBy("table_name").agg(F.concat_ws(" ", F.first("table_name"), F.concat_ws(" ", F.collect_list("column_name"))).alias("names"))
    listed = catalog.agg(F.sort_array(F.collect_set("table_name")).alias("t")).scalar()
    # Words are compared as in the question: the question keeps its underscores.
    asked = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("question"), F.lit(r"(?U)\w+"), 0), lambda w: F.rtrim(w, F.lit("s"))))
    terms = spread(questions).select("question_id", F.explode(asked).alias("term"))
    words = tables.select("table_name", F.explode(_stems("names")).alias("term"))
    scores = join_few(terms, words, "term").groupBy("question_id", "table_name").agg(F.count("*").alias("score"))
    hits = scores.groupBy("question_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "table_name"))), lambda h: h["table_name"]).alias("hits")
    )
    ranked = questions.select("question_id").join(hits, "question_id", "left").select(
        "question_id", F.coalesce("hits", F.array().cast("array<string>")).alias("hits"), listed.alias("all_tables")
    )
    chosen = F.when(F.size("all_tables") <= seeds, F.col("all_tables")).otherwise(
        F.slice(F.array_distinct(F.concat("hits", "all_tables")), 1, seeds)
    )
    return closure(ranked.select("question_id", F.explode(chosen).alias("table_name")), paths)


def _fk_cost(fks: DataFrame) -> DataFrame:
    """Bytes of each rendered foreign-key clause."""
    clause = F.concat(
        F.lit('FOREIGN KEY ("'), "src_column", F.lit('") REFERENCES "'), "dst_table", F.lit('" ("'), F.coalesce("dst_column", F.lit("")), F.lit('")')
    )
    return fks.select(F.col("src_table").alias("table_name"), "dst_table", (F.octet_length(clause) + 2).alias("b"))


def budget_width(
    linked: DataFrame, questions: DataFrame, catalog: DataFrame, fks: DataFrame, byte_budget: int = 10000
) -> DataFrame:
    """The widest rendering of the closed tables that fits: whole schema, else 32, 20, 12, 6 or 0
    ranked columns per table besides the keys. Fails the job when the keys alone do not fit.

    Sizes are added up per (question, table) from column costs; nothing is rendered to be measured.
    """
    statement = F.concat(F.lit('"'), F.replace("column_name", F.lit('"'), F.lit('""')), F.lit('" '), F.col("type"))
    cost = catalog.select(*KEY, "ordinal", "is_pk", F.octet_length(statement).alias("bytes"))
    opening = F.octet_length(F.concat(F.lit('CREATE TABLE "'), "table_name", F.lit('" ();'))) + 1
    pieces = cost.select((F.col("bytes") + 2).alias("b")).union(cost.select("table_name").distinct().select(opening)).union(_fk_cost(fks).select("b"))
    whole = pieces.agg(F.sum("b")).scalar()
    terms = questions.select("question_id", F.array_distinct(F.regexp_extract_all(F.lower(F.replace("question", F.lit("_"), F.lit(" "))), F.lit(r"(?U)\w+"), 0)).alias("terms"))
    keys = retained_keys(linked, catalog, fks).withColumn("required", F.lit(True))
    opened = join_many(join_few(linked.select("question_id", F.explode("tables").alias("table_name")), cost, "table_name"), terms, "question_id")
    opened = opened.join(keys, ["question_id", *KEY], "left")
    relevance = F.size(F.array_intersect("terms", F.regexp_extract_all(F.lower(F.replace("column_name", F.lit("_"), F.lit(" "))), F.lit(r"(?U)\w+"), 0)))
    per_table = opened.groupBy("question_id", "table_name").agg(
        F.sort_array(F.collect_list(F.struct((-relevance).alias("r"), "ordinal", (F.col("bytes") + 2).alias("b"), F.coalesce("required", F.lit(False)).alias("k")))).alias("cols")
    )
    fk_bytes = (
        linked.select("tables").distinct().select("tables", F.explode("tables").alias("table_name")).join(_fk_cost(fks), "table_name")
        .filter(F.array_contains("tables", F.col("dst_table"))).groupBy("tables").agg(F.sum("b").alias("fk_bytes"))
    )

    def taken(width: int) -> Column:
        kept = F.filter("cols", lambda c, i: (i < width) | c["k"])
        return F.aggregate(kept, F.lit(0), lambda acc, c: acc + c["b"])

    sizes = per_table.groupBy("question_id").agg(*[F.sum(taken(w) + opening).alias(f"w{w}") for w in WIDTHS])
    sized = linked.join(sizes, "question_id").join(fk_bytes, "tables", "left").withColumn("whole_bytes", whole).fillna(0, ["fk_bytes"])
    width = F.when(F.col("whole_bytes") <= byte_budget, F.lit(-1))
    used = F.when(F.col("whole_bytes") <= byte_budget, F.col("whole_bytes"))
    for w in WIDTHS:
        fits = F.col(f"w{w}") + F.col("fk_bytes") <= byte_budget
        width, used = width.when(fits, F.lit(w)), used.when(fits, F.col(f"w{w}") + F.col("fk_bytes"))
    found = sized.select("question_id", "tables", width.alias("width"), used.alias("bytes"))
    return found.filter(F.assert_true(F.col("width").isNotNull(), F.lit("required join keys exceed the schema budget")).isNull())


def _overlap(questions: DataFrame, documents: DataFrame, asked: Column, said: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """Number of shared terms per (question, document): an equi-join on the term."""
    left = spread(questions).select("question_id", F.explode(asked).alias("term"))
    right = documents.select(*keys, F.explode(said).alias("term"))
    return join_few(left, right, "term").groupBy("question_id", *keys).agg(F.count("*").alias("overlap"))


def compact_schema(
    questions: DataFrame, catalog: DataFrame, fks: DataFrame, descriptions: DataFrame | None = None, profiles: DataFrame | None = None,
    selected: DataFrame | None = None, byte_budget: int = 10000,
) -> DataFrame:
    """Per question the column lines of the compact schema that fit the budget.

    Keys and selected columns enter first whatever the budget, and fail the job if they do not fit; the
    rest enters by priority while it fits. The first line of a table also pays for its header. The fold
    state carries the opened tables.
    """
    links = fks.groupBy("db_id", F.col("src_table").alias("table_name"), F.col("src_column").alias("column_name")).agg(
        F.max(F.concat(F.lit("FK->"), "dst_table", F.lit("."), F.coalesce("dst_column", F.lit("")))).alias("fk")
    )
    headers = catalog.select("db_id", "table_name").distinct().join(
        fks.groupBy("db_id", F.col("src_table").alias("table_name")).agg(F.array_join(F.sort_array(F.collect_set("dst_table")), ",").alias("near")),
        ["db_id", "table_name"], "left",
    ).select(
        "table_name",
        F.concat(F.lit("[Table] "), "table_name", F.when(F.col("near").isNotNull(), F.concat(F.lit("; neighbours="), "near")).otherwise("")).alias("header"),
    )
    lines = _described(catalog, descriptions).join(links, ["db_id", *KEY], "left")
    if profiles is not None:
        lines = lines.join(profiles.select(*KEY, "format_tags", "values"), KEY, "left")
    else:
        none = F.array().cast("array<string>")
        lines = lines.withColumns({"format_tags": none, "values": none})
    roles = F.concat_ws("/", F.when(F.col("is_pk"), "PK"), F.col("fk"))
    shown = F.concat(F.lit("["), F.array_join(F.transform(F.slice("values", 1, 3), text.quoted), ", "), F.lit("]"))
    extras = F.array(
        roles, F.left("description", F.lit(300)), F.when(F.size("format_tags") > 0, F.concat(F.lit("storage="), F.array_join("format_tags", ","))),
        F.when(F.size("values") > 0, F.concat(F.lit("examples="), shown)),
    )
    kept_extras = F.filter(extras, lambda e: F.length(F.coalesce(e, F.lit(""))) > 0)
    line = F.concat(
        F.lit("  - "), "column_name", F.lit(" "), F.coalesce(F.nullif("type", F.lit("")), F.lit("UNKNOWN")),
        F.when(F.size(kept_extras) > 0, F.concat(F.lit(" | "), F.array_join(kept_extras, " | "))).otherwise(""),
    )
    rendered = lines.join(headers, "table_name").select(
        *KEY, "ordinal", "header", line.alias("line"), (F.length(roles) > 0).alias("has_role"),
        F.array_distinct(text.words(F.concat_ws(" ", "table_name", "column_name", "description"))).alias("words"),
    )
    shared = _overlap(questions, rendered, F.array_distinct(text.words("question")), F.col("words"))
    # The catalog is metadata: it rides along as one array instead of a product with the questions.
    all_lines = rendered.agg(F.collect_list(F.struct(*KEY, "ordinal", "header", "line", "has_role"))).scalar()
    wide = questions.select("question_id", F.explode(all_lines).alias("c")).select("question_id", "c.*").join(shared, ["question_id", *KEY], "left")
    if selected is not None:
        wide = wide.join(selected.select("question_id", *KEY).distinct().withColumn("_sel", F.lit(True)), ["question_id", *KEY], "left")
    else:
        wide = wide.withColumn("_sel", F.lit(None).cast("boolean"))
    chosen = F.coalesce("_sel", F.lit(False))
    priority = F.when(chosen, 100).otherwise(0) + F.when(F.col("has_role"), 20).otherwise(0) + 5 * F.coalesce("overlap", F.lit(0))
    wide = wide.select("question_id", *KEY, "ordinal", "header", "line", priority.alias("priority"), (F.col("has_role") | chosen).alias("required"))
    item = F.struct(
        F.when(F.col("required"), 0).otherwise(1).alias("optional"), (-F.col("priority")).alias("p"), "table_name", "column_name",
        F.octet_length("line").alias("b"), F.octet_length("header").alias("h"), "line", "priority", "ordinal",
    )
    arrays = wide.groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum(F.octet_length("line") + 1).alias("all_lines"))
    item_type = dict(arrays.dtypes)["items"]

    def cost(state: Column, i: Column) -> Column:
        # "\n\n" opens a table block after the header line, "\n" precedes every column line.
        return i["b"] + 1 + F.when(F.array_contains(state["opened"], i["table_name"]), 0).otherwise(i["h"] + 2)

    def step(state: Column, i: Column) -> Column:
        total = state["used"] + cost(state, i)
        grown = F.struct(
            total.alias("used"), F.array_union(state["opened"], F.array(i["table_name"])).alias("opened"), F.array_append(state["kept"], i).alias("kept")
        )
        return F.when((i["optional"] == 0) | (total <= byte_budget), grown).otherwise(state)

    start = F.struct(
        F.lit(len(SCHEMA_HEADER.encode())).alias("used"), F.array().cast("array<string>").alias("opened"), F.array().cast(item_type).alias("kept")
    )
    packed = arrays.select("question_id", F.aggregate("items", start, step).alias("s")).filter(
        F.assert_true(F.col("s.used") <= byte_budget, F.lit("required keys exceed the schema budget")).isNull()
    )
    return packed.select("question_id", F.col("s.used").alias("bytes_used"), F.explode("s.kept").alias("k")).select(
        "question_id", "bytes_used", "k.table_name", "k.column_name", "k.ordinal", "k.priority", "k.line"
    )


def _plain_name(value) -> Column:
    return F.regexp_replace(text.fold(value), "[^a-z0-9]", "")


def _note_parts(name: str = "column_name") -> tuple[Column, Column, Column]:
    said = F.when((F.length("note") > 0) & (_plain_name("note") != _plain_name(name)), F.col("note"))
    formats = F.when(F.col("holds_text") & (F.size("format_tags") > 0), F.concat(F.lit("stored as text: "), F.array_join("format_tags", ", ")))
    listed = F.array_join(F.transform(F.slice("sample_values", 1, 3), lambda v: text.quoted(F.left(v, F.lit(40)))), ", ")
    examples = F.when(F.col("holds_text") & (F.size("sample_values") > 0), F.concat(F.lit("examples: "), listed))
    return said, formats, examples


def column_notes(questions: DataFrame, notes: DataFrame, byte_budget: int = 6000) -> DataFrame:
    """Note lines that fit the budget, most relevant first; output keeps the schema position.

    ``notes``: table_name, column_name, schema_pos, note, format_tags, sample_values, holds_text.
    """
    said, formats, examples = _note_parts()
    parts = F.array_compact(F.array(said, formats, examples))
    lines = notes.withColumn("parts", parts).filter(F.size("parts") > 0).select(
        *KEY, "schema_pos", F.when(F.col("holds_text") & (F.size("format_tags") > 0), 3).otherwise(0).alias("base"),
        F.concat(F.lit("- "), "table_name", F.lit("."), "column_name", F.lit(": "), F.array_join("parts", " | ")).alias("line"),
        F.array_distinct(text.words(F.concat_ws(" ", "table_name", "column_name", "note"))).alias("words"),
    )
    shared = _overlap(questions, lines, F.array_distinct(text.words("question")), F.col("words"))
    # Lines without a shared word rank alike for all questions. Of equally long ones only as many as fit
    # the budget can ever be kept, so the filler every question sees is bounded by the budget.
    base = len(NOTES_HEADER.encode()) + 1
    sized = lines.withColumn("bytes", (F.octet_length("line") + 1).cast("long"))
    place = W.partitionBy("bytes").orderBy(F.col("base").desc(), "schema_pos")
    filler = sized.withColumn("_r", F.row_number().over(place)).filter(F.col("_r") * F.col("bytes") <= byte_budget - base)
    every = filler.agg(F.collect_list(F.struct(*KEY, "schema_pos", "base", "line", "bytes"))).scalar()
    plain = questions.select("question_id", F.explode(every).alias("c")).select("question_id", "c.*", F.lit(0).cast("long").alias("overlap"))
    spoken = join_few(shared, sized.drop("words"), KEY).select(*plain.columns)
    ranked = (
        plain.unionByName(spoken).groupBy("question_id", *KEY, "schema_pos", "base", "line", "bytes").agg(F.max("overlap").alias("overlap"))
        .withColumn("priority", F.col("base") + 2 * F.col("overlap")).drop("base", "overlap")
    )
    order = [-F.col("priority"), F.col("schema_pos")]
    return greedy_pack(ranked, ["question_id"], order, "bytes", byte_budget, base=base)


def column_notes_sql_ready(questions: DataFrame, notes: DataFrame, byte_budget: int = 3000) -> tuple[DataFrame, DataFrame]:
    """Only relevant columns, identifiers as they must be written, matching stored values first.

    Returns the kept lines and, per question, candidates, kept and truncated counts. A stored value
    matches as a whole word; candidates meet through the first word of the value, never pairwise.
    """
    values = notes.filter("holds_text").select(*KEY, F.posexplode("categorical_values").alias("vpos", "value")).filter(F.length("value") >= 2)
    first_word = F.regexp_extract(text.fold("value"), "[a-z0-9]+", 0)
    # A value without any ASCII word character can follow any text and is looked up under the empty word.
    keyed = values.withColumn("word", first_word)
    asked = spread(questions).select("question_id", text.fold("question").alias("lowered"))
    spoken = asked.select(
        "question_id", "lowered", F.explode(F.array_union(F.regexp_extract_all("lowered", F.lit("[a-z0-9]+"), 0), F.array(F.lit("")))).alias("word")
    )
    shape = F.concat(F.lit("(?<![a-z0-9])\\Q"), text.fold("value"), F.lit("\\E(?![a-z0-9])"))
    hits = join_few(spoken, keyed, "word").filter(F.rlike("lowered", shape)).select("question_id", *KEY, "vpos", "value")
    matched = top_k(hits, ["question_id", *KEY], [F.col("vpos")], 3).groupBy("question_id", *KEY).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("vpos", "value"))), lambda s: s["value"]).alias("matches")
    )
    shared = _overlap(questions, notes, text.note_terms("question"), text.note_terms(F.concat_ws(" ", "column_name", "note")))
    relevant = join_few(shared.join(matched, ["question_id", *KEY], "full_outer"), notes, KEY)
    relevance = F.coalesce("overlap", F.lit(0)) + 3 * F.coalesce(F.size("matches"), F.lit(0))
    said, formats, examples = _note_parts()
    match_text = F.concat(
        F.lit("stored values matching the question: "), F.array_join(F.transform("matches", lambda v: text.quoted(F.left(v, F.lit(40)))), ", ")
    )
    parts = F.array_compact(F.array(said, formats, F.when(F.col("matches").isNotNull(), match_text).otherwise(examples)))
    lines = relevant.withColumn("parts", parts).filter(F.size("parts") > 0).select(
        "question_id", *KEY, "schema_pos", (relevance + F.when(formats.isNotNull(), 2).otherwise(0)).alias("priority"),
        F.concat(F.lit("- "), text.sql_identifier("column_name"), F.lit(" in table "), text.sql_identifier("table_name"), F.lit(": "),
                 F.array_join("parts", " | ")).alias("line"),
    ).withColumn("bytes", F.octet_length("line") + 1)
    base = len(NOTES_HEADER_SQL_READY.encode()) + 1
    kept = greedy_pack(lines, ["question_id"], [-F.col("priority"), F.col("schema_pos")], "bytes", byte_budget, base=base)
    counts = lines.groupBy("question_id").agg(F.count("*").alias("candidates")).join(
        kept.groupBy("question_id").agg(F.count("*").alias("kept")), "question_id", "left"
    ).fillna(0, ["kept"]).withColumn("truncated", F.col("candidates") - F.col("kept"))
    return kept, counts


def full_selection(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """C11: every column for every question, marked when its name is spoken between spaces."""
    asked = questions.select("question_id", F.concat(F.lit(" "), F.replace(text.fold("question"), F.lit("_"), F.lit(" ")), F.lit(" ")).alias("padded"))
    listed = catalog.agg(F.collect_list(F.struct(*KEY, "is_pk"))).scalar()
    spoken = F.concat(F.lit(" "), F.replace(text.fold("column_name"), F.lit("_"), F.lit(" ")), F.lit(" "))
    return (
        asked.select("question_id", "padded", F.explode(listed).alias("c")).select("question_id", "padded", "c.*")
        .select("question_id", *KEY, "is_pk", F.contains("padded", spoken).alias("exact_match"))
    )


def value_hint_terms(question: str = "question") -> Column:
    """At most two quoted or defined terms of a question."""
    quoted_terms = F.regexp_extract_all(question, F.lit("['\"]([^'\"\\n]{1,60})['\"]"), 1)
    defined = F.regexp_extract_all(text.evidence_part(question), F.lit("(?i)(?:=|refers to)\\s*['\"]?([A-Za-z][^;'\"\\n]{1,40})"), 1)
    cleaned = F.filter(F.transform(F.concat(quoted_terms, defined), text.strip), lambda t: F.length(t) > 0)
    return F.slice(F.array_distinct(cleaned), 1, 2)
