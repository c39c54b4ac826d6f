"""Evidence facts per question: candidates, suppression, order, rendering and packing.

All facts share one flat row shape (``FACT_COLUMNS``). Every candidate set is a join keyed by terms or
normalised values; per question only budget-sized lists are folded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.functions import text
from groundscope.operators import match
from groundscope.operators.joins import join_few, join_many, spread
from groundscope.operators.packing import greedy_pack, prefix_pack
from groundscope.operators.profile import KEY
from groundscope.operators.ranking import top_k
from groundscope.session import cut_lineage

FACT_COLUMNS = [
    "question_id", "phrase", "type", "table_name", "column_name", "db_value", "confidence", "source", "column_relevance",
    "transformation", "description", "target_table", "target_column",
]

# Type order, confidences and limits.
TYPE_PRIORITY = {
    "literal_value": 0, "encoded_value": 1, "normalization": 2, "numeric_or_storage": 3, "column_semantics": 4, "join_relationship": 5,
}
MODES = {
    "literals": ["literal_value"], "descriptions": ["column_semantics", "encoded_value"], "normalization": ["normalization", "numeric_or_storage"],
    "all": ["literal_value", "normalization", "numeric_or_storage", "column_semantics", "encoded_value"],
}
JOIN_MODES = ("descriptions", "all")
FACT_LIMIT, BYTE_BUDGET, MINIMUM_CONFIDENCE, PROBE_LIMIT = 12, 4096, 0.70, 4
NUMERIC_WORDS = [
    "percent", "percentage", "average", "ratio", "rate", "total", "sum", "less", "over", "more", "least", "most", "year", "date", "time",
]
EFFECTS_ALLOWED = {
    "literal_value": "predicate", "encoded_value": "predicate", "normalization": "predicate", "numeric_or_storage": "conversion",
    "join_relationship": "join", "column_semantics": "identifier_binding",
}
ALWAYS_FORBIDDEN = "projection,aggregation,grouping,ordering,limit"


def column_terms(profile: DataFrame) -> DataFrame:
    """Terms of a column's text, identifier and table context: (table, column, term, weight, in_text, in_name)."""
    described = F.concat_ws(" ", "display_name", "description", "value_description")
    text_terms = profile.select(*KEY, F.explode(F.array_distinct(text.identifier_tokens(F.concat_ws(" ", *KEY, described)))).alias("term"), F.lit(1).alias("w"))
    names = profile.select(*KEY, F.explode(F.array_distinct(text.identifier_tokens(F.concat_ws(" ", *KEY)))).alias("term"), F.lit(2).alias("w"))
    said = profile.select(*KEY, F.explode(F.array_distinct(text.identifier_tokens(described))).alias("term"))
    context = profile.select(
        "table_name", F.explode(F.array_distinct(text.identifier_tokens(F.concat_ws(" ", "column_name", described)))).alias("term")
    ).distinct().join(profile.select(*KEY), "table_name").select(*KEY, "term", F.lit(1).alias("w"))
    weights = (
        text_terms.withColumn("kind", F.lit("text")).unionByName(names.withColumn("kind", F.lit("name")))
        .unionByName(context.withColumn("kind", F.lit("context"))).unionByName(said.withColumns({"w": F.lit(0), "kind": F.lit("said")}))
    )
    return weights.groupBy(*KEY, "term").agg(
        F.sum("w").alias("weight"), F.bool_or(F.col("kind") == "said").alias("in_text"), F.bool_or(F.col("kind") == "name").alias("in_name")
    )


def column_relevance(questions: DataFrame, profile: DataFrame) -> DataFrame:
    """Relevance and the sorted shared terms, for every column that shares a term with a question."""
    terms = spread(questions).select("question_id", F.explode(text.question_terms("question")).alias("term"))
    return join_few(terms, column_terms(profile), "term").groupBy("question_id", *KEY).agg(
        F.sum("weight").alias("column_relevance"),
        F.sort_array(F.collect_set(F.when(F.col("in_text"), F.col("term")))).alias("said"),
        F.sort_array(F.collect_set(F.when(F.col("in_name"), F.col("term")))).alias("named"),
    )


def _facts(df: DataFrame, **columns) -> DataFrame:
    """Fill the fact row shape; columns that are not given come from the input or are null."""
    none = F.lit(None).cast("string")
    defaults = {c: (F.col(c) if c in df.columns else none) for c in FACT_COLUMNS}
    defaults["column_relevance"] = F.col("column_relevance") if "column_relevance" in df.columns else F.lit(0)
    picked = {**defaults, **columns}
    return df.select(*[
        (picked[c].cast("long") if c == "column_relevance" else picked[c].cast("double") if c == "confidence" else picked[c]).alias(c)
        for c in FACT_COLUMNS
    ])


def literal_facts(phrases: DataFrame, index: DataFrame, relevance: DataFrame, probed: DataFrame | None = None) -> DataFrame:
    """One fact per question and matched stored value. ``probed`` adds values found outside the index."""
    found = match.literal_matches(phrases, index).select("question_id", "phrase", "score", *KEY, "original")
    if probed is not None:
        found = found.unionByName(probed.withColumn("score", F.lit(0.99)).select("question_id", "phrase", "score", *KEY, "original"))
        found = found.groupBy("question_id", *KEY, "original").agg(F.max_by(F.struct("phrase", "score"), "score").alias("b")).select(
            "question_id", *KEY, "original", "b.*"
        )
    joined = join_many(found, relevance.select("question_id", *KEY, "column_relevance"), ["question_id", *KEY], "left").fillna(0, ["column_relevance"])
    return _facts(joined, type=F.lit("literal_value"), db_value=F.col("original"), confidence=F.col("score"), source=F.lit("database_value"))


def explicit_probes(phrases: DataFrame, index: DataFrame, relevance: DataFrame, counts: DataFrame) -> DataFrame:
    """Exact values outside the index. The first four (phrase, relevant column) pairs of a
    question are looked up among all distinct values; phrases go in order, columns by relevance, columns
    with "id" in their name earlier for code-like phrases.
    """
    known = index.select("normalized").distinct().withColumn("_known", F.lit(True))
    code = F.col("phrase").rlike("^[A-Za-z]+[0-9]+$")
    telling = F.col("phrase").rlike("[0-9]") | F.col("phrase").rlike("(?U)^\\p{Lu}") | F.contains("phrase", F.lit(" "))
    explicit = join_few(phrases, known, "normalized", "left").filter((F.col("_known").isNull() | code) & telling).select("question_id", "pos", "phrase", code.alias("code"))
    first = top_k(explicit, ["question_id"], [F.col("pos")], PROBE_LIMIT, rank="_p")
    both = relevance.filter("column_relevance > 0").withColumn("code", F.explode(F.array(F.lit(True), F.lit(False))))
    adjusted = F.col("column_relevance") + F.when(F.col("code") & F.contains(F.lower("column_name"), F.lit("id")), 4).otherwise(0)
    columns = top_k(
        both.select("question_id", *KEY, "code", adjusted.alias("rel")), ["question_id", "code"], [F.col("rel").desc(), *[F.col(c) for c in KEY]], PROBE_LIMIT, rank="_c"
    )
    order = W.partitionBy("question_id").orderBy("_p", "_c")
    tried = first.join(columns, ["question_id", "code"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= PROBE_LIMIT)
    values = counts.filter("value IS NOT NULL").select(*KEY, F.col("value").alias("phrase"), "frequency")
    return join_many(tried, values, [*KEY, "phrase"]).select("question_id", "phrase", *KEY, F.col("phrase").alias("original"), "frequency")


def normalization_facts(questions: DataFrame, index: DataFrame, relevance: DataFrame) -> DataFrame:
    """E3."""
    found = join_many(
        match.season_matches(questions, index), relevance.select("question_id", *KEY, "column_relevance"), ["question_id", *KEY], "left"
    ).fillna(0, ["column_relevance"])
    return _facts(
        found, type=F.lit("normalization"), db_value=F.col("original"), confidence=F.col("score"), source=F.lit("database_value_pattern"),
        transformation=F.lit("season_end_year"),
    )


def _description() -> Column:
    return F.concat_ws(" ", "display_name", "description", "value_description")


def storage_facts(questions: DataFrame, profile: DataFrame, relevance: DataFrame) -> DataFrame:
    """Columns stored as printed numbers or dates, and described columns of numeric questions."""
    storage = (
        F.when(F.col("numeric_text_rate") >= 0.8, "numeric_text_cast").when(F.col("percentage_rate") >= 0.5, "printed_percentage")
        .when(F.col("date_rate") >= 0.5, "date_text")
    )
    columns = profile.select(
        *KEY, storage.alias("transformation"), F.left(_description(), F.lit(500)).alias("description"), (F.length("value_description") > 0).alias("explained")
    )
    spoken = relevance.filter(F.size("said") > 0).select("question_id", *KEY, "said")
    wants = questions.select(
        "question_id", F.arrays_overlap(text.question_terms("question"), F.array(*[F.lit(w) for w in NUMERIC_WORDS])).alias("numeric")
    )
    # Columns with a storage format concern every question; they are catalog metadata.
    stored = columns.filter("transformation IS NOT NULL").agg(F.collect_list(F.struct(*KEY))).scalar()
    filler = questions.select("question_id", F.explode(stored).alias("c")).select("question_id", "c.*")
    offered = join_many(join_few(filler.join(spoken, ["question_id", *KEY], "full_outer"), columns, KEY), wants, "question_id")
    said = F.coalesce("said", F.array().cast("array<string>"))
    chosen = offered.withColumn("said", said).filter(F.col("transformation").isNotNull() | ((F.size("said") > 0) & F.col("numeric")))
    return _facts(
        chosen, type=F.lit("numeric_or_storage"), source=F.lit("column_profile_and_description"),
        phrase=F.when(F.size("said") > 0, F.array_join("said", " ")).otherwise(F.coalesce("transformation", F.lit("storage"))),
        confidence=F.when((F.size("said") > 0) & F.col("explained"), 0.90).otherwise(0.76),
    )


def semantics_facts(profile: DataFrame, relevance: DataFrame) -> DataFrame:
    """E5: columns whose name or description shares a term with the question."""
    touched = join_few(
        relevance.filter((F.size("said") > 0) | (F.size("named") > 0)).drop("column_relevance"),
        profile.select(*KEY, F.left(_description(), F.lit(700)).alias("description")), KEY,
    )
    confidence = F.least(F.lit(0.95), F.lit(0.72) + F.lit(0.04) * F.size("said") + F.lit(0.03) * F.size("named"))
    return _facts(
        touched, type=F.lit("column_semantics"), phrase=F.array_join(F.when(F.size("said") > 0, F.col("said")).otherwise(F.col("named")), " "),
        confidence=F.round(confidence, 6), source=F.when(F.length(F.trim("description")) > 0, "database_description").otherwise("schema_identifier"),
    )


def encoded_facts(questions: DataFrame, index: DataFrame, profile: DataFrame) -> DataFrame:
    """E6."""
    found = match.encoded_matches(questions, index, profile)
    return _facts(
        found, type=F.lit("encoded_value"), db_value=F.col("original"), confidence=F.col("score"), source=F.lit("database_value_description"),
        transformation=F.col("operator"), description=F.left("segment", F.lit(500)),
    )


def join_facts(facts: DataFrame, fks: DataFrame) -> DataFrame:
    """Foreign keys that touch a table with a fact of at least 0.80 confidence."""
    tables = facts.filter("confidence >= 0.80").select("question_id", "table_name").distinct()
    edges = fks.select("src_table", "src_column", "dst_table", "dst_column")
    ends = edges.withColumn("table_name", F.explode(F.array("src_table", "dst_table")))
    touched = join_few(tables, ends, "table_name").drop("table_name").distinct()
    return _facts(
        touched, phrase=F.lit("foreign-key path"), type=F.lit("join_relationship"), table_name=F.col("src_table"), column_name=F.col("src_column"),
        confidence=F.lit(0.92), source=F.lit("declared_foreign_key"), target_table=F.col("dst_table"), target_column=F.col("dst_column"),
    )


def render_fact() -> Column:
    """One line per fact."""
    place = F.concat_ws(".", "table_name", "column_name")
    mapped = F.concat(F.lit("- "), text.quoted("phrase"), F.lit(" maps to "), place, F.lit(" = "), text.quoted("db_value"), F.lit("."))
    joined = F.concat(F.lit("- Join "), place, F.lit(" to "), "target_table", F.lit("."), F.coalesce("target_column", F.lit("")))
    detail = F.coalesce(F.nullif("description", F.lit("")), "transformation", F.lit("schema match"))
    related = F.concat(F.lit("- "), text.quoted("phrase"), F.lit(" relates to "), place, F.lit(": "), detail)
    return F.when(F.col("db_value").isNotNull(), mapped).when(F.col("type") == "join_relationship", joined).otherwise(related)


def suppress(facts: DataFrame) -> DataFrame:
    """Of equal literals or normalisations keep those of the most relevant columns.

    A group holds one row per column, so these windows are bounded by the catalog. Facts of other types
    form groups of their own place and always stay.
    """
    literal, normalization = F.col("type") == "literal_value", F.col("type") == "normalization"
    place = F.concat_ws(".", "table_name", "column_name")
    group = (
        F.when(literal, text.normalize(F.coalesce("db_value", F.lit("")))).when(normalization, F.coalesce("transformation", F.lit(""))).otherwise(place)
    )
    same = W.partitionBy("question_id", "type", "_phrase", "_group")
    marked = facts.withColumns({"_phrase": text.normalize("phrase"), "_group": group}).withColumns({
        "_best": F.max("column_relevance").over(same), "_n": F.count("*").over(same)
    })
    kept = (
        ~(literal | normalization) | (F.col("_best") == 0) | (literal & (F.col("_n") == 1)) | (F.col("column_relevance") == F.col("_best"))
    )
    return marked.filter(kept).select(*FACT_COLUMNS)


def fact_order() -> list[Column]:
    """O3: ascending sort keys."""
    priority = F.create_map(*[F.lit(x) for pair in TYPE_PRIORITY.items() for x in pair])
    return [
        -F.col("confidence"), -F.col("column_relevance"), F.coalesce(priority[F.col("type")], F.lit(9)), F.col("table_name"),
        F.coalesce("column_name", F.lit("")), F.coalesce("db_value", F.lit("")),
    ]


def gather(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of candidate facts, materialised once because routing, join facts and packing all read it."""
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part)
    return cut_lineage(facts)


def assemble(
    gathered: DataFrame, fks: DataFrame, mode: str = "all", byte_budget: int = BYTE_BUDGET, fact_limit: int = FACT_LIMIT,
    minimum: float = MINIMUM_CONFIDENCE,
) -> DataFrame:
    """Route, add joins, floor, suppress, deduplicate, order and pack. One row per kept fact.

    Join facts belong to the routes that describe the schema.
    """
    facts = gathered.filter(F.col("type").isin(MODES[mode]))
    if mode in JOIN_MODES:
        facts = facts.unionByName(join_facts(facts, fks))
    # Dealt by question once: no later step is keyed by less, so none exchanges the rows again.
    candidates = suppress(spread(facts.filter(F.col("confidence") >= minimum)))
    identity = [F.lower("table_name"), F.lower(F.coalesce("column_name", F.lit(""))), text.normalize(F.coalesce("db_value", F.lit(""))), F.coalesce("transformation", F.lit("\u0000"))]
    order = fact_order()
    keyed = candidates.withColumns({f"_k{i}": c for i, c in enumerate(identity)}).withColumns({f"_s{i}": c for i, c in enumerate(order)})
    rest = F.struct(*FACT_COLUMNS[1:])
    unique = keyed.groupBy("question_id", "type", *[f"_k{i}" for i in range(len(identity))]).agg(
        F.min_by(rest, F.struct(*[f"_s{i}" for i in range(len(order))], "phrase", F.coalesce("target_table", F.lit("")))).alias("f")
    ).select("question_id", "f.*")
    lines = unique.withColumn("line", render_fact()).withColumn("bytes", F.octet_length("line"))
    return greedy_pack(lines, ["question_id"], fact_order(), "bytes", byte_budget, limit=fact_limit, separator=1)


def packet_identity(packed: DataFrame, mode: str, knowledge: str = "") -> DataFrame:
    """One digest per question over the question, the knowledge it was drawn from and its packed lines in order."""
    return lines_identity(packet_lines(packed), mode, knowledge)


def packet_lines(packed: DataFrame) -> DataFrame:
    """The packed lines of each question in order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda p: p["line"])
    return packed.groupBy("question_id").agg(lines.alias("lines"))


def lines_identity(listed: DataFrame, mode: str, knowledge: str = "") -> DataFrame:
    """E13 over the lines of ``packet_lines``."""
    return listed.select(
        "question_id", F.array_join("lines", "\n").alias("text"), F.sha2(
            F.to_json(F.struct(F.lit(mode).alias("mode"), "question_id", F.lit(knowledge).alias("knowledge"), "lines")), 256
        ).alias("identity")
    )


def scope(packed: DataFrame, byte_budget: int = BYTE_BUDGET) -> DataFrame:
    """What each fact may and may not do, an id, and the prefix of sections that fits the budget."""
    allowed = F.create_map(*[F.lit(x) for pair in EFFECTS_ALLOWED.items() for x in pair])[F.col("type")]
    place = F.concat_ws(".", "table_name", "column_name")
    forbidden = (
        F.when(F.col("type") == "numeric_or_storage", "aggregation,grouping,ordering,limit")
        .when(F.col("type") == "column_semantics", F.lit("predicate," + ALWAYS_FORBIDDEN)).otherwise(ALWAYS_FORBIDDEN)
    )
    instruction = (
        F.when(
            F.col("db_value").isNotNull(),
            F.concat(F.lit("Use only to map the question concept to a predicate on "), place, F.lit(". It does not request a result column or an aggregate.")),
        )
        .when(
            F.col("type") == "numeric_or_storage",
            F.concat(F.lit("Use only to convert "), place, F.lit(
                " when the question already requires numeric, date, or percentage comparison/arithmetic. "
                "Storage format does not imply SUM, AVG, COUNT, or GROUP BY."
            )),
        )
        .when(F.col("type") == "join_relationship", "Use only as an available join predicate when both related tables are otherwise required.")
        .otherwise(F.concat(F.lit("Use only to bind a question concept to "), place, F.lit(
            ". The description does not imply filtering, aggregation, grouping, ordering, or projection."
        )))
    )
    digest = F.left(F.sha2(F.to_json(F.struct(*FACT_COLUMNS[1:])), 256), F.lit(8))
    scoped = packed.withColumns({
        "evidence_id": F.concat(F.lit("E"), F.col("position").cast("string"), F.lit("-"), digest), "allowed": allowed, "forbidden": forbidden,
        "instruction": instruction,
    })
    def escaped(name: str) -> Column:
        """The JSON form of a text: control characters and everything beyond ASCII as code points."""
        listed = F.to_json(F.array(name), {"writeNonAsciiCharacterAsCodePoint": "true"})
        return F.when(F.col(name).isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))

    mapping = F.concat(place, F.coalesce(F.concat(F.lit(" = "), escaped("db_value")), F.lit("")))
    section = F.concat(
        F.lit("["), "evidence_id", F.lit("] type="), "type", F.lit("; concept="), escaped("phrase"), F.lit("; mapping="), mapping, F.lit("; allowed="),
        "allowed", F.lit("; forbidden="), "forbidden", F.lit(". "), "instruction",
    )
    sized = scoped.withColumn("section", section).withColumn("section_bytes", F.octet_length("section")).drop("bytes_used")
    ordered = sized.withColumnRenamed("position", "fact_position")
    return prefix_pack(ordered, ["question_id"], [F.col("fact_position")], "section_bytes", byte_budget, separator=1)
