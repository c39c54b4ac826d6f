"""The bounded packet - stored values, join paths and columns a question touches, as one JSON list under limits.

Values and columns meet their questions by joins. Phrases that no indexed value answers are probed among all
stored texts, for all questions in one pass. How many probes a question makes depends on what the earlier ones
found: that is a fold, over ``PROBES`` x ``PROBES`` pairs at most, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundscope.functions import text
from groundscope.operators import match
from groundscope.operators.joins import join_few, join_many, spread
from groundscope.operators.packing import greedy_pack
from groundscope.operators.profile import KEY
from groundscope.operators.ranking import top_k
from groundscope.session import cut_lineage

MODES = ("none", "oracle", "generated")
BYTE_BUDGET, FACT_LIMIT, PROBES, PROBE_ROWS, PATHS, EVIDENCE = 4096, 12, 4, 5, 4, 1200
# Order of the kinds of facts.
PRIORITY = {"oracle_benchmark_evidence": 0, "value": 1, "join_path": 2, "column": 3}
ORDER = ["priority", "table_name", "column_name", "_stage", "_first", "_second", "_text"]


def allowed(rows: DataFrame, selected: DataFrame | None) -> DataFrame:
    """J10 per question: the selected columns only; a question without a selection keeps all."""
    if selected is None:
        return rows
    chosen = selected.select("question_id", *KEY).distinct().withColumn("_in", F.lit(True))
    limited = selected.select("question_id").distinct().withColumn("_limited", F.lit(True))
    marked = rows.join(chosen, ["question_id", *KEY], "left").join(limited, "question_id", "left")
    return marked.filter(F.col("_limited").isNull() | F.col("_in")).drop("_in", "_limited")


def _fact(rows: DataFrame, kind: str, fields: dict[str, Column | str], stage: int = 0, first="0", second="0", said="''") -> DataFrame:
    """Facts of one kind as JSON, fields without a value shown as null, and their place among the others."""
    body = F.struct(F.lit(kind).alias("kind"), *[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()])
    place = [F.col(c) if c in rows.columns else F.lit("").alias(c) for c in KEY]
    return rows.select(
        "question_id", F.lit(PRIORITY[kind]).alias("priority"), *place, F.lit(stage).alias("_stage"), F.expr(first).cast("long").alias("_first"),
        F.expr(second).cast("long").alias("_second"), F.expr(said).alias("_text"), F.to_json(body, {"ignoreNullFields": "false"}).alias("fact"),
    )


def column_matches(questions: DataFrame, profile: DataFrame) -> DataFrame:
    """Columns whose table, name or description shares a word with the question, and the sorted shared words."""
    asked = spread(questions).select("question_id", F.explode(F.array_distinct(text.identifier_tokens("question"))).alias("term"))
    said = profile.select(*KEY, F.explode(F.array_distinct(text.identifier_tokens(F.concat_ws(" ", *KEY, "description")))).alias("term"))
    return join_few(asked, said, "term").groupBy("question_id", *KEY).agg(F.sort_array(F.collect_set("term")).alias("matched_terms"))


def probe_columns(asked: DataFrame, catalog: DataFrame, selected: DataFrame | None) -> DataFrame:
    """The first text columns of each question's selection, or of the schema, numbered from 1."""
    texts = catalog.filter(F.col("type").rlike("(?i)text|char|clob|string")).select(*KEY, "ordinal")
    listed = F.slice(F.sort_array(F.collect_list(F.struct("table_name", "ordinal", "column_name"))), 1, PROBES)
    first = texts.agg(listed.alias("c")).scalar()
    free = asked if selected is None else asked.join(selected.select("question_id").distinct(), "question_id", "left_anti")
    every = free.select("question_id", F.posexplode(first).alias("j", "c")).select("question_id", (F.col("j") + 1).alias("j"), *[f"c.{k}" for k in KEY])
    if selected is None:
        return every
    own = join_few(join_many(asked, selected.select("question_id", *KEY).distinct(), "question_id"), texts, KEY)
    own = top_k(own, ["question_id"], [F.col("table_name"), F.col("ordinal")], PROBES, rank="j")
    return every.unionByName(own.select("question_id", F.col("j").cast("int").alias("j"), *KEY))


def probe_missing(missing: DataFrame, catalog: DataFrame, counts: DataFrame, found: DataFrame, selected: DataFrame | None, fact_limit: int) -> DataFrame:
    """Stored texts that contain a phrase without a match: phrases in order, columns in order until one answers.

    ``found`` holds the number of facts of each question so far. A question stops after ``PROBES`` probes and
    begins no phrase once it has ``fact_limit`` facts.
    """
    first = top_k(missing, ["question_id"], [F.col("pos")], PROBES, rank="i").select("question_id", "phrase", F.col("i").cast("int").alias("i"))
    first = cut_lineage(first)
    tried = cut_lineage(join_many(first, probe_columns(first.select("question_id").distinct(), catalog, selected), "question_id"))
    reach = join_few(counts, tried.select(*KEY).distinct(), KEY, "left_semi")
    stored = match.probe_containing(first.select("question_id", "phrase"), reach, PROBE_ROWS)
    hits = cut_lineage(join_many(stored, tried, ["question_id", "phrase", *KEY]))
    sizes = hits.groupBy("question_id", "i", "j").agg(F.count("*").alias("n"))
    pairs = tried.join(sizes, ["question_id", "i", "j"], "left").fillna(0, ["n"]).groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("i", "j", "n"))).alias("pairs")
    ).join(found, "question_id", "left").fillna(0, ["facts"])

    def step(state: Column, pair: Column) -> Column:
        probed = F.struct(
            (state["probes"] + 1).alias("probes"), (state["facts"] + pair["n"]).alias("facts"),
            F.when(pair["n"] > 0, pair["i"]).otherwise(state["answered"]).alias("answered"),
            F.when(pair["n"] > 0, F.array_append(state["kept"], F.struct(pair["i"].alias("i"), pair["j"].alias("j")))).otherwise(state["kept"]).alias("kept"),
        )
        goes_on = (state["probes"] < PROBES) & (state["facts"] < fact_limit) & (state["answered"] != pair["i"])
        return F.when(goes_on, probed).otherwise(state)

    start = F.struct(
        F.lit(0).alias("probes"), F.col("facts").alias("facts"), F.lit(0).alias("answered"),
        F.array().cast("array<struct<i:int,j:int>>").alias("kept"),
    )
    made = pairs.select("question_id", F.explode(F.aggregate("pairs", start, step)["kept"]).alias("p")).select("question_id", "p.*")
    return join_many(hits, made, ["question_id", "i", "j"])


def gather(
    questions: DataFrame, index: DataFrame, profile: DataFrame, catalog: DataFrame, counts: DataFrame, paths: DataFrame | None = None,
    selected: DataFrame | None = None, fact_limit: int = FACT_LIMIT,
) -> DataFrame:
    """All facts of all questions, attached evidence included; ``pack`` chooses by mode and limits.

    Facts are not materialised, as ``packets`` reads them once for all modes.
    ``index`` as from ``value_index``, ``profile`` as from ``column_profile``, ``counts`` with every stored value,
    ``paths``: question_id, path_no, tables. ``selected``: question_id, table_name, column_name.
    """
    phrases = cut_lineage(match.question_phrases(questions))
    values = cut_lineage(allowed(match.phrase_values(phrases, index), selected))
    columns = cut_lineage(allowed(column_matches(questions, profile), selected))
    place = {"table": "table_name", "column": "column_name"}
    value_facts = _fact(values, "value", place | {
        "printed_value": "original", "normalized_value": "normalized", "frequency": "frequency", "pattern": "pattern", "numeric_value": "numeric_value",
        "date_value": F.when(F.col("pattern") == "date", text.strip("original")), "matched_phrase": "phrase", "reason": F.lit("exact_or_normalized_value"),
    }, second="-frequency", said="original")
    column_facts = _fact(join_few(columns, profile, KEY), "column", place | {
        "description": F.coalesce("description", F.lit("")), "declared_type": "declared_type", "types": "types", "numeric_min": "numeric_min",
        "numeric_max": "numeric_max", "reason": F.lit("question_description_overlap"), "matched_terms": "matched_terms",
    })
    size = F.count("*").alias("n")
    sizes = values.groupBy("question_id").agg(size).unionByName(columns.groupBy("question_id").agg(size))
    facts = value_facts.unionByName(column_facts)
    if paths is not None:
        led = top_k(paths, ["question_id"], [F.col("path_no")], PATHS, rank="_r")
        facts = facts.unionByName(_fact(led, "join_path", {"tables": "tables", "reason": F.lit("foreign_key_closure")}, first="_r"))
        sizes = sizes.unionByName(led.groupBy("question_id").agg(size))
    found = sizes.groupBy("question_id").agg(F.sum("n").alias("facts"))
    matched = values.select("question_id", text.normalize("phrase").alias("normalized")).distinct()
    missing = phrases.join(matched, ["question_id", "normalized"], "left_anti")
    probed = probe_missing(missing, catalog, counts, found, selected, fact_limit)
    probe_facts = _fact(probed, "value", place | {
        "printed_value": F.left("value", F.lit(300)), "normalized_value": text.normalize("value"), "frequency": "frequency", "matched_phrase": "phrase",
        "reason": F.lit("bounded_read_only_probe"),
    }, stage=1, first="i", second="-frequency", said="value")
    said = questions.select("question_id", F.left(text.evidence_part("question"), F.lit(EVIDENCE)).alias("said")).filter(F.length("said") > 0)
    evidence = _fact(said, "oracle_benchmark_evidence", {"text": "said", "reason": F.lit("diagnostic_only")})
    return facts.unionByName(probe_facts).unionByName(evidence)


def pack(facts: DataFrame, mode: str = "generated", byte_budget: int = BYTE_BUDGET, fact_limit: int = FACT_LIMIT) -> DataFrame:
    """The facts that fit, in order: none in mode ``none``, attached evidence in mode ``oracle`` only."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode != "oracle":
        facts = facts.filter(F.col("priority") > 0 if mode == "generated" else F.lit(False))
    return _packed(spread(facts), ["question_id"], byte_budget, fact_limit)


def _packed(facts: DataFrame, group: list[str], byte_budget: int, fact_limit: int) -> DataFrame:
    sized = facts.withColumn("bytes", F.octet_length("fact"))
    order = [F.col(c) for c in [*ORDER, "fact"]]
    return greedy_pack(sized, group, order, "bytes", byte_budget, limit=fact_limit, separator=1, base=2)


def _listed() -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct("position", "fact"))), lambda p: p["fact"]).alias("facts")


def packets(
    questions: DataFrame, facts: DataFrame, modes: Sequence[str] = MODES, byte_budget: int = BYTE_BUDGET, fact_limit: int = FACT_LIMIT, knowledge: str = ""
) -> DataFrame:
    """``pack`` and ``packet_texts`` in several modes: facts are dealt by question once, and no later step deals them again."""
    none = F.array().cast("array<string>")
    taking = F.when(F.col("priority") > 0, F.array(*[F.lit(m) for m in modes if m != "none"])).otherwise(F.array(F.lit("oracle")) if "oracle" in modes else none)
    offered = spread(facts).select("*", F.explode(taking).alias("mode"))
    lists = _packed(offered, ["question_id", "mode"], byte_budget, fact_limit).groupBy("question_id", "mode").agg(_listed())
    by_question = lists.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("mode", "facts"))).alias("lists"))
    asked = questions.select("question_id", text.natural_part("question").alias("natural")).join(by_question, "question_id", "left")
    each = asked.select("question_id", "natural", "lists", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    return _texts(each.withColumn("facts", F.try_element_at("lists", F.col("mode"))), knowledge)


def packet_texts(questions: DataFrame, packed: DataFrame, mode: str, knowledge: str = "") -> DataFrame:
    """One row per question: the JSON list (empty without facts), its size, and a digest of what it was made from."""
    lists = packed.groupBy("question_id").agg(_listed())
    joined = questions.select("question_id", text.natural_part("question").alias("natural")).join(lists, "question_id", "left")
    return _texts(joined.withColumn("mode", F.lit(mode)), knowledge)


def _texts(joined: DataFrame, knowledge: str) -> DataFrame:
    facts = F.coalesce("facts", F.array().cast("array<string>"))
    whole = F.concat(F.lit("["), F.array_join(facts, ","), F.lit("]"))
    basis = F.to_json(F.struct(F.lit(knowledge).alias("knowledge"), F.col("natural").alias("question"), "mode", whole.alias("facts")))
    return joined.select(
        "question_id", "mode", F.size(facts).alias("n_facts"), F.octet_length(whole).alias("n_bytes"), whole.alias("text"),
        F.sha2(basis, 256).alias("identity"),
    )
