"""Rankings of schema documents for questions and their fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.functions import text
from groundscope.operators.joins import join_few, join_many, spread
from groundscope.operators.ranking import numbered, top_k
from groundscope.session import cut_lineage

# Sizes of a selection.
WHOLE_LIMIT, SELECTED_COLUMNS, SELECTED_TABLES = 40, 32, 5
RRF_CONSTANT = 60

BLOCK_ROWS = 4096


def dense_ranking(queries: DataFrame, documents: DataFrame, k: int | None = None) -> DataFrame:
    """The ``k`` documents with the largest inner product per query, or all of them; ties by document id.

    ``queries``: question_id, vector; ``documents``: doc_id, vector. Vectors are unit length. Blocks of queries
    meet blocks of documents in separate tasks; each pair of blocks returns at most ``k`` rows per query.
    """
    blocks = max(1, -(-documents.count() // BLOCK_ROWS))
    chunks = max(1, -(-queries.count() // BLOCK_ROWS))
    left = queries.withColumn("q", F.pmod(F.xxhash64("question_id"), F.lit(chunks))).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = documents.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    )

    def score(a: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        columns = ["question_id", "doc_id", "similarity"]
        if a.empty or d.empty:
            return pd.DataFrame(columns=columns)
        d = d.sort_values("doc_id", ignore_index=True)
        products = _matrix(a["vector"]) @ _matrix(d["vector"]).T
        rows, places = _best(products, k)
        return pd.DataFrame({
            "question_id": a["question_id"].to_numpy()[rows], "doc_id": d["doc_id"].to_numpy()[places], "similarity": products[rows, places],
        }, columns=columns)

    types = dict(queries.dtypes)["question_id"], dict(documents.dtypes)["doc_id"]
    scored = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInPandas(
        score, f"question_id {types[0]}, doc_id {types[1]}, similarity double"
    )
    order = [F.col("similarity").desc(), F.col("doc_id")]
    return _ranked(scored, order) if k is None else top_k(scored, ["question_id"], order, k)


def _best(products: np.ndarray, k: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest (or all) products per row; equal ones keep the column order."""
    keep = np.argsort(-products, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(products)), keep.shape[1]), keep.ravel()


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _shared_terms(questions: DataFrame, documents: DataFrame, said) -> DataFrame:
    asked = spread(questions).select("question_id", F.explode(F.array_distinct(text.identifier_tokens("question"))).alias("term"))
    spoken = documents.select("doc_id", F.explode(F.array_distinct(text.identifier_tokens(said))).alias("term"))
    return join_few(asked, spoken, "term").groupBy("question_id", "doc_id").agg(F.count("*").alias("overlap"))


def _ranked(scored: DataFrame, order: Sequence) -> DataFrame:
    """All rows of a question numbered in order: questions are many and each has at most a catalog of rows."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(*order)))


def lexical_ranking(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """R2: by shared terms with the document text, then id; documents without a shared term are absent."""
    return _ranked(_shared_terms(questions, documents, "text"), [F.col("overlap").desc(), F.col("doc_id")])


def description_ranking(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """By shared terms with the description, then id."""
    described = documents.filter(F.length("description") > 0)
    return _ranked(_shared_terms(questions, described, "description"), [F.col("overlap").desc(), F.col("doc_id")])


def exact_ranking(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose whole name is spoken, in catalog order.

    Names meet questions through their first token and are then verified as a phrase.
    """
    name = text.identifier_tokens(F.coalesce("column_name", "table_name"))
    names = documents.select("doc_id", "position", name.alias("tokens")).filter(F.size("tokens") > 0).select(
        "doc_id", "position", F.col("tokens")[0].alias("term"), F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).alias("phrase")
    )
    asked = spread(questions).select("question_id", text.identifier_tokens("question").alias("tokens")).select(
        "question_id", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")).alias("padded"), F.explode(F.array_distinct("tokens")).alias("term")
    )
    hits = join_few(asked, names, "term").filter(F.contains("padded", F.col("phrase"))).select("question_id", "doc_id", "position").distinct()
    return _ranked(hits, [F.col("position"), F.col("doc_id")])


def fuse(rankings: dict[str, DataFrame]) -> DataFrame:
    """Reciprocal rank fusion over named rankings, with the names as reasons."""
    union = None
    for name, ranking in rankings.items():
        part = ranking.select("question_id", "doc_id", "rank", F.lit(name).alias("reason"))
        union = part if union is None else union.unionByName(part)
    first = union.groupBy("question_id", "doc_id", "reason").agg(F.min("rank").alias("rank"))
    return first.groupBy("question_id", "doc_id").agg(
        F.sum(1.0 / (RRF_CONSTANT + F.col("rank"))).alias("score"), F.sort_array(F.collect_list("reason")).alias("reasons"),
        F.min(F.when(F.col("reason") == "exact_identifier", F.col("rank"))).alias("exact_rank"),
    )


def select_documents(fused: DataFrame, questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Whole catalogs up to 40 columns, else exact hits first and then the best fused ones up to 32;
    the five best tables are added. Unscored documents rank by id behind the scored ones.

    An unscored document can only fill up a selection, so at most the first 37 ids are offered as filler.
    """
    columns = documents.filter("kind = 'column'")
    total = columns.count()
    limit = total if total <= WHOLE_LIMIT else SELECTED_COLUMNS
    filler_ids = documents.groupBy("kind").agg(F.slice(F.sort_array(F.collect_set("doc_id")), 1, max(limit, SELECTED_TABLES)).alias("ids"))
    filler_list = filler_ids.agg(F.flatten(F.collect_list("ids"))).scalar()
    filler = questions.select("question_id", F.explode(filler_list).alias("doc_id")).select(
        "question_id", "doc_id", F.lit(0.0).alias("score"), F.lit(None).cast("array<string>").alias("reasons"), F.lit(None).cast("int").alias("exact_rank")
    )
    offered = (
        fused.select("question_id", "doc_id", "score", "reasons", F.col("exact_rank").cast("int").alias("exact_rank")).unionByName(filler)
        .groupBy("question_id", "doc_id").agg(F.max("score").alias("score"), F.max("reasons").alias("reasons"), F.max("exact_rank").alias("exact_rank"))
    )
    offered = join_few(offered, documents.select("doc_id", "kind", "table_name", "column_name"), "doc_id")
    order = [F.coalesce("exact_rank", F.lit(2147483647)) if total > WHOLE_LIMIT else F.lit(0), F.col("score").desc(), F.col("doc_id")]
    best_columns = top_k(offered.filter("kind = 'column'"), ["question_id"], order, limit)
    best_tables = top_k(offered.filter("kind = 'table'"), ["question_id"], [F.col("score").desc(), F.col("doc_id")], SELECTED_TABLES)
    return best_columns.unionByName(best_tables)


def term_list(questions: DataFrame, documents: DataFrame, said: str) -> tuple[DataFrame, DataFrame]:
    """R2, R4 in blocks: (listed, whole) instead of a row for each question and document.

    ``documents`` carries ``number``, its place by id. A term that every document says adds the same to all of them, so
    it decides no order: ``listed`` (question_id, number, rank) holds only documents that share another
    term, and ``whole`` (question_id) the questions that share such a common term, whose list goes on with all other
    documents in id order.
    """
    spoken = documents.select("number", F.explode(F.array_distinct(text.identifier_tokens(said))).alias("term"))
    held = spoken.groupBy("term").agg(F.count("*").alias("held"))
    total = documents.agg(F.count("*").alias("n")).scalar()
    common = held.filter(F.col("held") == total).select("term")
    asked = spread(questions).select("question_id", F.explode(F.array_distinct(text.identifier_tokens("question"))).alias("term"))
    telling = spoken.join(common, "term", "left_anti")
    shared = join_few(asked, telling, "term").groupBy("question_id", "number").agg(F.count("*").alias("overlap"))
    listed = _ranked(shared, [F.col("overlap").desc(), F.col("number")]).drop("overlap")
    return listed, join_few(asked, common, "term", "left_semi").select("question_id").distinct()


def best_documents(questions: DataFrame, documents: DataFrame, description: bool = True) -> DataFrame:
    """R5, R6 from lists in blocks: the selection of ``select_documents`` over the exact, the token and the description list.

    A document that no list of a question names comes later in all of its lists the greater its id is. So the named
    documents and the first unnamed ones by id, as many as a selection can hold, are the only candidates; in a list
    that goes on with all other documents, a candidate's rank is its place by id among those that the list does not
    name. Rows are the named documents and a selection for each question, not questions x documents.
    """
    placed = cut_lineage(numbered(documents, ["doc_id"], "number"))
    sizes = dict(placed.groupBy("kind").count().collect())
    total = sizes.get("column", 0)
    limits = {"column": total if total <= WHOLE_LIMIT else SELECTED_COLUMNS, "table": SELECTED_TABLES}
    exact = join_few(exact_ranking(questions, placed), placed.select("doc_id", "number"), "doc_id").select("question_id", "number", "rank")
    lists = {"exact_identifier": (exact, None), "token_overlap": term_list(questions, placed, "text")}
    if description:
        described = placed.filter(F.length("description") > 0)
        # The description list names documents that have one; it goes on with all others only where all have one.
        lists["description_match"] = term_list(questions, described, "description")
        if described.count() < placed.count():
            lists["description_match"] = (join_few(description_ranking(questions, placed), placed.select("doc_id", "number"), "doc_id").select("question_id", "number", "rank"), None)
    named = None
    for reason, (listed, _) in lists.items():
        part = listed.select("question_id", "number", F.lit(reason).alias("reason"), F.col("rank").cast("long").alias("rank"))
        named = part if named is None else named.unionByName(part)
    ranks = [F.min(F.when(F.col("reason") == reason, F.col("rank"))).alias(reason) for reason in lists]
    named = cut_lineage(named.groupBy("question_id", "number").agg(*ranks))
    # Enough unnamed documents of each kind: at most as many are named as there are named documents.
    wanted = questions.select("question_id").distinct().join(named.groupBy("question_id").agg(F.count("*").alias("n")), "question_id", "left").fillna(0, ["n"])
    places = placed.select("number", "kind", F.col("number").alias("place"))
    if len(sizes) > 1:
        of_kind = [numbered(placed.select("number", "kind").filter(F.col("kind") == kind), ["number"], "place") for kind in sorted(sizes)]
        places = reduce(DataFrame.unionByName, of_kind)
    first = wanted.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in limits]))).withColumn(
        "limit", F.when(F.col("kind") == "column", limits["column"]).otherwise(limits["table"])
    ).select("question_id", "kind", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + F.col("limit") - 1)).alias("place"))
    filler = join_few(first, places, ["kind", "place"]).select("question_id", "number")
    offered = named.unionByName(filler, allowMissingColumns=True).groupBy("question_id", "number").agg(*[F.min(r).alias(r) for r in lists])
    earlier = W.partitionBy("question_id").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy("question_id")
    score, reasons = F.lit(0.0), []
    for reason, (_, whole) in lists.items():
        rank = F.col(reason)
        if whole is not None:
            offered = offered.join(whole.withColumn(f"_{reason}", F.lit(True)), "question_id", "left")
            before = F.coalesce(F.count(reason).over(earlier), F.lit(0))
            rank = F.coalesce(rank, F.when(F.col(f"_{reason}"), F.count(reason).over(every) + F.col("number") + 1 - before))
        offered = offered.withColumn(f"{reason}_rank", rank)
        score = score + F.coalesce(1.0 / (RRF_CONSTANT + F.col(f"{reason}_rank")), F.lit(0.0))
        reasons.append(F.when(F.col(f"{reason}_rank").isNotNull(), F.lit(reason)))
    scored = join_few(offered.select(
        "question_id", "number", F.round(score, 12).alias("score"), F.sort_array(F.array_compact(F.array(*reasons))).alias("reasons"),
        F.col("exact_identifier").cast("int").alias("exact_rank"),
    ), placed.select("number", "doc_id", "kind", "table_name", "column_name"), "number").drop("number")
    order = [F.coalesce("exact_rank", F.lit(2147483647)) if total > WHOLE_LIMIT else F.lit(0), F.col("score").desc(), F.col("doc_id")]
    best_columns = top_k(scored.filter("kind = 'column'"), ["question_id"], order, max(1, limits["column"]))
    best_tables = top_k(scored.filter("kind = 'table'"), ["question_id"], [F.col("score").desc(), F.col("doc_id")], SELECTED_TABLES)
    return best_columns.unionByName(best_tables)


def ground_concepts(concepts: DataFrame, catalog: DataFrame, evidence: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """The two best columns per concept with score and confidence.

    score = 8 exact column + 5 exact table + 3 per shared term + 4 evidence match + 1 if selected.
    ``concepts``: question_id, concept. ``evidence``: question_id, table_name, column_name, phrase,
    description. ``selected``: question_id, table_name, column_name; none means every column is selected.
    Distinct concepts are matched once, not per question. A column without any hit still scores 1 when
    selected; only the first two such columns by name can matter and serve as filler.
    """
    key = ["table_name", "column_name"]
    vocabulary = concepts.select("concept").distinct().withColumn("tokens", F.array_distinct(text.identifier_tokens("concept")))
    names = catalog.select(
        *key, F.array_distinct(text.identifier_tokens(F.concat_ws(" ", *key))).alias("all_tokens"),
        F.sort_array(F.array_distinct(text.identifier_tokens("column_name"))).alias("column_tokens"),
        F.sort_array(F.array_distinct(text.identifier_tokens("table_name"))).alias("table_tokens"),
    )
    terms = vocabulary.select("concept", F.explode("tokens").alias("term"))
    named = terms.join(names.select(*key, F.explode("all_tokens").alias("term")), "term").groupBy("concept", *key).agg(
        F.sort_array(F.collect_set("term")).alias("shared")
    )
    base = concepts.select("question_id", "concept").distinct()
    from_names = join_few(base, named, "concept")
    described = evidence.select("question_id", *key, F.explode(F.array_distinct(text.identifier_tokens(F.coalesce("description", F.lit(""))))).alias("term"))
    from_evidence = join_many(join_few(base, terms, "concept"), described, ["question_id", "term"]).groupBy("question_id", "concept", *key).agg(
        F.sort_array(F.collect_set("term")).alias("shared")
    )
    spoken = evidence.filter("phrase IS NOT NULL").select("question_id", *key, text.normalize("phrase").alias("n")).distinct()
    matched = base.withColumn("n", text.normalize("concept")).join(spoken, ["question_id", "n"]).select(
        "question_id", "concept", *key, F.lit(True).alias("evidence_match")
    ).distinct()
    hits = from_names.unionByName(from_evidence).groupBy("question_id", "concept", *key).agg(
        F.array_distinct(F.flatten(F.collect_list("shared"))).alias("shared")
    ).join(matched, ["question_id", "concept", *key], "full_outer")
    if selected is None:
        listed = catalog.agg(F.slice(F.sort_array(F.collect_set(F.struct(*key))), 1, 2)).scalar()
        filler = base.withColumn("c", F.explode(listed)).select("question_id", "concept", "c.*")
        chosen = None
    else:
        ranked = top_k(selected.select("question_id", *key).distinct(), ["question_id"], [F.col(c) for c in key], 2, rank="_r").drop("_r")
        filler = base.join(ranked, "question_id").select("question_id", "concept", *key)
        chosen = selected.select("question_id", *key).distinct().withColumn("chosen", F.lit(True))
    none = F.array().cast("array<string>")
    offered = hits.unionByName(filler, allowMissingColumns=True).groupBy("question_id", "concept", *key).agg(
        F.max("shared").alias("shared"), F.bool_or(F.coalesce("evidence_match", F.lit(False))).alias("evidence_match")
    )
    offered = join_few(join_few(offered, names, key), vocabulary, "concept")
    offered = offered.withColumn("chosen", F.lit(True)) if chosen is None else offered.join(chosen, ["question_id", *key], "left").fillna(False, ["chosen"])
    overlap = F.size(F.coalesce("shared", none))
    own = F.sort_array("tokens")
    exact_column = (F.size("tokens") > 0) & (own == F.col("column_tokens"))
    exact_table = (F.size("tokens") > 0) & (own == F.col("table_tokens"))
    score = (
        8 * exact_column.cast("int") + 5 * exact_table.cast("int") + 3 * overlap + 4 * F.col("evidence_match").cast("int") + F.col("chosen").cast("int")
    )
    confidence = F.when(exact_column | F.col("evidence_match"), "high").when(overlap >= 2, "medium").otherwise("low")
    scored = offered.withColumns({"score": score, "confidence": confidence}).filter("score > 0").select(
        "question_id", "concept", *key, "score", "confidence", F.lower(F.concat_ws(".", *key)).alias("_id")
    )
    return top_k(scored, ["question_id", "concept"], [F.col("score").desc(), F.col("_id")], 2).drop("_id")


def grounding_summary(concepts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Per question the ungrounded and ambiguous concepts and the overall confidence.

    A concept is ambiguous when its runner-up is at most two points behind.
    """
    per_concept = bindings.groupBy("question_id", "concept").agg(
        F.count("*").alias("n"), F.max("score").alias("best"), F.min("score").alias("second"), F.min_by("confidence", "rank").alias("confidence")
    )
    joined = concepts.select("question_id", "concept").distinct().join(per_concept, ["question_id", "concept"], "left")
    ungrounded = F.col("n").isNull()
    ambiguous = F.coalesce((F.col("n") > 1) & (F.col("best") - F.col("second") <= 2), F.lit(False))
    return joined.groupBy("question_id").agg(
        F.count_if(ungrounded).alias("ungrounded"), F.count_if(ambiguous).alias("ambiguous"),
        F.bool_and(~ungrounded & ~ambiguous & F.coalesce(F.col("confidence") == "high", F.lit(False))).alias("high_confidence"),
    )
