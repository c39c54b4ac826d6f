"""Matching phrases of questions to stored values.

Phrases and values are reduced to distinct normalised texts first, which are written once. Candidate pairs come
from equi-joins on a rarest character gram (containment) or on a rarity-ordered prefix of a set (similarity); both
are exact filters, so nothing that the score ladder would accept is lost and no pairwise product is formed. Items of
the many texts that no text of the few holds are dropped where the many are scanned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.functions import text
from groundscope.operators.joins import join_few, join_many, spread
from groundscope.operators.profile import KEY
from groundscope.operators.ranking import top_k
from groundscope.session import cut_lineage

# How many phrases of one question are considered.
PHRASE_LIMIT = 80
CONCEPT_LIMIT = 100

# The score ladder.
SCORES = {
    "exact_normalized_value": 0.99,
    "contained_normalized_value": 0.91,
    "value_token_overlap": 0.84,
    "value_character_similarity": 0.78,
}
CONTAINMENT_RATIO = 0.75
TOKEN_SIMILARITY = 0.5
GRAM_SIMILARITY = 0.65
SEASON_SCORE = 0.94

# Words too general to tie a code to its meaning.
GENERIC_MEANINGS = [
    "common", "evidence", "refer", "mean", "indicate", "value", "table", "character", "user", "score", "attribute",
]
RELATION_WORDS = ":|=|means|indicates|stands for|refers to"


def _first_spelling(exploded: DataFrame, limit: int) -> DataFrame:
    """Earliest spelling per normalised phrase, then the first ``limit`` of a question."""
    unique = exploded.groupBy("question_id", "normalized").agg(F.min(F.struct("pos", "phrase", "standalone")).alias("f"))
    order = W.partitionBy("question_id").orderBy("pos")
    return (
        unique.select("question_id", "normalized", "f.*")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )


def _exploded(questions: DataFrame, kept: Column, candidates: Callable[[str, str], Column]) -> DataFrame:
    """Phrase rows of each question; a bare number must stand alone in the text.

    The kept words are a column of their own, so the several runs built from them do not extract them again.
    """
    shape = F.concat(F.lit("(?<![A-Za-z0-9])"), F.col("normalized"), F.lit("(?![A-Za-z0-9])"))
    digits = F.col("normalized").rlike("^[0-9]+$")
    return (
        questions.select("question_id", text.natural_part("question").alias("natural"))
        .withColumn("kept", kept)
        .select("question_id", "natural", F.posexplode(candidates("natural", "kept")).alias("pos", "raw"))
        .select(
            "question_id", "pos", text.strip("raw").alias("phrase"),
            text.normalize("raw").alias("normalized"), "natural",
        )
        .withColumn("standalone", ~digits | F.rlike("natural", shape))
        .drop("natural")
    )


def _spoken_phrases(spread: DataFrame) -> DataFrame:
    found = _exploded(spread, text.phrase_words("natural"), text.phrase_candidates).filter(F.length("phrase") >= 2)
    return _first_spelling(found, PHRASE_LIMIT)


def _concept_runs(kept: str) -> Column:
    return F.concat(F.col(kept), text.shingles(F.col(kept), 2), text.shingles(F.col(kept), 3))


def question_phrases(questions: DataFrame) -> DataFrame:
    """Up to 80 unique phrases per question: quotes, numbers, names, words, 2- and 3-word runs."""
    return _spoken_phrases(spread(questions))


def concept_phrases(questions: DataFrame) -> DataFrame:
    """The phrases of T6 followed by content words and their runs, up to 100."""
    dealt = spread(questions)
    base = _spoken_phrases(dealt)
    # Content words are ASCII, start with a letter, have three characters at least and are no stop words: they and their runs
    # are in normal form but for upper case, and usable by what they are.
    more = (
        dealt.select("question_id", text.natural_part("question").alias("natural"))
        .select("question_id", text.concept_words("natural").alias("kept"))
        .select("question_id", F.posexplode(_concept_runs("kept")).alias("pos", "phrase"))
        .select("question_id", (F.col("pos") + 1_000_000).alias("pos"), "phrase", F.lower("phrase").alias("normalized"), F.lit(True).alias("standalone"))
    )
    usable = (
        ~F.col("normalized").isin(text.CONCEPT_STOP_WORDS)
        & (F.length("normalized") > 0)
        & ((F.length("normalized") >= 2) | F.col("normalized").rlike("^[0-9]+$"))
        & F.col("standalone")
    )
    kept = _first_spelling(base.filter(usable).unionByName(more), CONCEPT_LIMIT)
    return kept.select("question_id", "pos", "phrase", "normalized")


#: Items of a vocabulary that may be sent to every task (some ten MB), and texts of a posting list that meet in one piece.
BROADCAST_ITEMS, POSTING = 200_000, 10_000


def _item_sets(name: str, thresholds: dict[str, float]) -> dict[str, Column]:
    """The item sets of a text by kind: its grams, and its words and compact trigrams where a similarity asks for them."""
    column = F.col(name)
    wordy = ~F.rlike(column, F.lit("[0-9]"))
    empty = F.array().cast("array<string>")
    found = {"gram": F.when(F.length(column) >= 3, text.grams_of(column)).otherwise(empty)}
    if "token" in thresholds:
        found["token"] = F.when(wordy, text.word_tokens(column)).otherwise(empty)
    if "trigram" in thresholds:
        found["trigram"] = F.when(wordy, text.char_ngrams(column)).otherwise(empty)
    return found


def _items(texts: DataFrame, name: str, thresholds: dict[str, float]) -> DataFrame:
    """(text, kind, n, item): the items of each set, ``n`` their number."""
    sets = texts.select(name, *[c.alias(f"_{kind}") for kind, c in _item_sets(name, thresholds).items()])

    def offered(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda i: F.struct(F.lit(kind).alias("kind"), F.size(f"_{kind}").alias("n"), i.alias("item")))

    return sets.select(name, F.explode(F.concat(*map(offered, ["gram", *thresholds]))).alias("x")).select(name, "x.*")


def candidate_pairs(lefts: DataFrame, rights: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Pairs that may contain each other or reach a set similarity; a superset with no false drops.

    Two exact filters share one equi-join on (role, item):

    * containment - whatever is contained has all its grams in the other text, so the contained side
      offers only the gram that is rarest on the other side, and the containing side all of its grams;
    * similarity ``t`` - with items ordered from rare to frequent, two sets that reach ``t`` share an
      item among the first ``size - ceil(t * size) + 1`` of each, so only those prefixes meet.

    ``rights`` should be the side with fewer distinct items: up to ``BROADCAST_ITEMS`` of them are sent to every
    task, so what occurs on the left only is dropped where it is scanned and never exchanged; more are joined by
    an exchange. Rarity is counted on both sides, and the posting list of an item that many texts offer is
    dealt over pieces.
    """
    thresholds = thresholds or {}
    right_items = _items(rights, "right", thresholds)
    vocabulary = cut_lineage(right_items.groupBy("kind", "item").agg(F.count("*").alias("right_df")))
    small = vocabulary.count() <= BROADCAST_ITEMS
    left_items = _items(lefts, "left", thresholds).join(F.broadcast(vocabulary) if small else vocabulary, ["kind", "item"])
    on_left = left_items.groupBy("kind", "item").agg(F.count("*").alias("left_df"))
    df = vocabulary.join(on_left, ["kind", "item"], "left").fillna(0, ["left_df"])
    df = F.broadcast(df) if small else df

    left_out = "n - size(s)"
    kept = " ".join(f"WHEN '{kind}' THEN greatest(n - CAST(ceil({t}D * n) AS int) + 1 - ({left_out}), 0)" for kind, t in thresholds.items())

    def offers(items: DataFrame, name: str, own: str, other: str, posting: str) -> DataFrame:
        """What a side offers: its rarest gram in role ``own``, all grams in role ``other``, and its prefixes.

        Items stand from rare to frequent; those that the vocabulary lacks come before all others. An item is offered
        in every piece of the other side's posting list, or in the piece of its own text.
        """
        pieces = "transform(sequence(0, CAST(ceil({df} / {posting}) AS int) - 1), salt -> struct({role} AS role, {item} AS item, salt))"
        piece = "struct({role} AS role, x.item AS item, CAST(pmod(xxhash64(`{name}`), ceil(greatest(x.{df}, 1) / {posting})) AS int) AS salt)"
        # A gram that the other side lacks cannot be inside any of its texts.
        rarest = pieces.format(df="rarest.df", posting=POSTING, role=f"'{own}'", item="rarest.item")
        whole = piece.format(role=f"'{other}'", name=name, df=f"{name}_df", posting=POSTING)
        if name == "right":
            prefix = f"transform(prefix, x -> {piece.format(role='kind', name=name, df='right_df', posting=POSTING)})"
        else:
            prefix = f"flatten(transform(prefix, x -> {pieces.format(df='x.right_df', posting=POSTING, role='kind', item='x.item')}))"
        gram = f"concat(if(size(s) = n AND rarest.df > 0, {rarest}, array()), transform(s, x -> {whole}))"
        return (
            items.join(df, ["kind", "item"]).groupBy(name, "kind")
            .agg(F.sort_array(F.collect_list(F.struct("right_df", "item", "left_df"))).alias("s"), F.first("n").alias("n"))
            .selectExpr(
                name, "kind", "n", "s", f"array_min(transform(s, x -> struct(x.{posting} AS df, x.item AS item))) AS rarest",
                f"slice(s, 1, {f'CASE kind {kept} ELSE 0 END' if kept else '0'}) AS prefix",
            )
            .selectExpr(name, f"if(kind = 'gram', null, n) AS {name}_size", f"explode(if(kind = 'gram', {gram}, {prefix})) AS x")
            .select(name, f"{name}_size", "x.*")
        )

    joined = offers(left_items.drop("right_df"), "left", "inside", "around", "right_df").join(
        offers(right_items, "right", "around", "inside", "left_df"), ["role", "item", "salt"]
    )
    plausible = ((F.col("role") == "inside") & F.contains("right", F.col("left"))) | (
        (F.col("role") == "around") & F.contains("left", F.col("right"))
    )
    for kind, threshold in thresholds.items():
        n, m = F.col("left_size"), F.col("right_size")
        plausible = plausible | ((F.col("role") == kind) & (n >= F.lit(threshold) * m) & (m >= F.lit(threshold) * n))
    return joined.filter(plausible).select("left", "right").distinct()


def contained_pairs(lefts: DataFrame, rights: DataFrame) -> DataFrame:
    """Pairs (left, right) where one text of at least three characters contains the other."""
    return candidate_pairs(lefts, rights)


def value_score(left: Column, right: Column) -> Column:
    """The ladder for one pair of normalised texts: struct(score, rule), or null."""
    shorter = F.least(F.length(left), F.length(right))
    longer = F.greatest(F.length(left), F.length(right))
    contained = (
        (F.length(left) >= 3)
        & (F.contains(right, left) | F.contains(left, right))
        & (shorter >= F.lit(CONTAINMENT_RATIO) * longer)
    )
    digits = F.concat(left, right).rlike("[0-9]")
    token_hit = text.jaccard(text.word_tokens(left), text.word_tokens(right)) >= TOKEN_SIMILARITY
    gram_hit = text.jaccard(text.char_ngrams(left), text.char_ngrams(right)) >= GRAM_SIMILARITY

    def rung(rule: str) -> Column:
        return F.struct(F.lit(SCORES[rule]).alias("score"), F.lit(rule).alias("rule"))

    return (
        F.when((F.length(left) == 0) | (F.length(right) == 0), None)
        .when(left == right, rung("exact_normalized_value"))
        .when(contained, rung("contained_normalized_value"))
        .when(digits, None)
        .when(token_hit, rung("value_token_overlap"))
        .when(gram_hit, rung("value_character_similarity"))
    )


def scored_pairs(lefts: DataFrame, rights: DataFrame) -> DataFrame:
    """T8 over two columns of distinct normalised texts: (left, right, score, rule)."""
    lefts, rights = cut_lineage(lefts), cut_lineage(rights)
    exact = join_few(lefts, rights, F.col("left") == F.col("right")).select("left", "right")
    similarity = {"token": TOKEN_SIMILARITY, "trigram": GRAM_SIMILARITY}
    candidates = exact.union(candidate_pairs(lefts, rights, similarity)).distinct()
    return candidates.withColumn("s", value_score(F.col("left"), F.col("right"))).filter("s IS NOT NULL").select(
        "left", "right", "s.*"
    )


def literal_matches(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """Per question and stored value the best score, its rule and the first phrase that reached it.

    ``phrases`` are read several times, so they should be materialised.
    Character similarity alone does not retrieve a value: some phrase of the question has to share a
    word with it or contain it.
    """
    index = cut_lineage(index)
    lefts = phrases.select(F.col("normalized").alias("left")).distinct()
    rights = index.select(F.col("normalized").alias("right")).distinct()
    pairs = scored_pairs(lefts, rights)
    hits = join_few(phrases, pairs, F.col("normalized") == F.col("left")).select(
        "question_id", "pos", "phrase", "right", "score", "rule"
    )
    weak = F.col("rule") == "value_character_similarity"
    spoken = phrases.groupBy("question_id").agg(F.collect_list("normalized").alias("spoken"))
    words = F.filter(
        F.flatten(F.transform("spoken", lambda p: F.regexp_extract_all(p, F.lit("[a-z0-9]+"), 0))), lambda w: F.length(w) >= 2
    )
    value = F.col("right")
    contained = F.exists(
        "spoken",
        lambda p: ((F.length(p) >= 3) & F.contains(value, p)) | ((F.length(value) >= 3) & F.contains(p, value)),
    )
    supported = (
        join_many(hits.filter(weak), spoken, "question_id")
        .filter(F.arrays_overlap(words, text.word_tokens(value)) | contained)
        .drop("spoken")
    )
    best = (
        hits.filter(~weak)
        .unionByName(supported)
        .groupBy("question_id", "right")
        .agg(F.max_by(F.struct("phrase", "score", "rule"), F.struct(F.col("score"), -F.col("pos"))).alias("b"))
    )
    return join_few(best, index, F.col("right") == F.col("normalized")).select(
        "question_id", "b.*", *KEY, "original", "normalized", "frequency", "scope"
    )


def phrase_values(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """E10, value part: stored values equal to, inside or around a phrase; the first phrase is kept."""
    index = cut_lineage(index)
    lefts = cut_lineage(phrases.select(F.col("normalized").alias("left")).distinct())
    rights = cut_lineage(index.select(F.col("normalized").alias("right")).distinct())
    exact = join_few(lefts, rights, F.col("left") == F.col("right")).select("left", "right")
    pairs = exact.union(contained_pairs(lefts, rights)).distinct()
    first = (
        join_few(phrases, pairs, F.col("normalized") == F.col("left"))
        .groupBy("question_id", "right")
        .agg(F.min_by("phrase", "pos").alias("phrase"))
    )
    return join_few(first, index, F.col("right") == F.col("normalized")).drop("right")


def season_matches(questions: DataFrame, index: DataFrame) -> DataFrame:
    """A question about a season names the last year of a stored year range."""
    asked = questions.select(
        "question_id", text.natural_part("question").alias("natural")
    ).filter(F.contains(text.fold("natural"), F.lit("season")))
    asked = asked.select("question_id", F.try_element_at(text.years("natural"), F.lit(1)).alias("year")).filter(
        "year IS NOT NULL"
    )
    ranges = index.withColumn("year", F.try_element_at(text.years("original"), F.lit(-1))).filter("year IS NOT NULL")
    return (
        join_few(asked, ranges, "year")
        .filter(F.col("year") != F.col("normalized"))
        .select("question_id", F.col("year").alias("phrase"), *KEY, "original", "normalized", F.lit(SEASON_SCORE).alias("score"))
    )


def value_segments(index: DataFrame, profile: DataFrame) -> DataFrame:
    """T10, question-free part: description segments of a categorical column that mention a stored value."""
    described = profile.filter("categorical").select(
        *KEY, F.posexplode(F.split("value_description", "[;\\n\\r•]+")).alias("segment_no", "segment")
    )
    described = described.withColumn("segment", text.strip("segment")).filter(F.length("segment") > 0)
    escaped = F.concat(F.lit("\\Q"), F.col("normalized"), F.lit("\\E"))
    before = F.concat(F.lit("(^|[^a-z0-9])"), escaped, F.lit(rf"\s*(?:{RELATION_WORDS})"))
    after = F.concat(F.lit(rf"(?:{RELATION_WORDS})\s*"), escaped, F.lit("([^a-z0-9]|$)"))
    return (
        index.join(described, KEY)
        .withColumn("norm_segment", text.normalize("segment"))
        .filter(F.contains("norm_segment", F.col("normalized")))
        .withColumn("explicit", F.rlike("norm_segment", before) | F.rlike("norm_segment", after))
    )


def encoded_matches(questions: DataFrame, index: DataFrame, profile: DataFrame) -> DataFrame:
    """Stored codes whose description segment speaks the words of the question."""
    segments = value_segments(index, profile)
    terms = questions.select("question_id", F.explode(text.question_terms("question")).alias("term"))
    segment_terms = segments.select(
        *KEY, "segment_no", F.explode(F.array_distinct(text.identifier_tokens("segment"))).alias("term")
    ).distinct()
    concepts = (
        join_few(terms, segment_terms, "term")
        .filter(~F.col("term").isin(GENERIC_MEANINGS))
        .groupBy("question_id", *KEY, "segment_no")
        .agg(F.sort_array(F.collect_set("term")).alias("shared"))
    )
    joined = join_few(concepts, segments, [*KEY, "segment_no"]).withColumn(
        "concept", F.array_except("shared", text.identifier_tokens("normalized"))
    )
    threshold_shape = F.concat(
        F.lit("\\b"), F.array_join("concept", "|"), F.lit(r"\b\s*:\s*(?:[<>]=?|at least|at most)\s*\Q"),
        F.col("normalized"), F.lit(r"\E\b"),
    )
    threshold = (F.size("concept") > 0) & F.rlike("norm_segment", threshold_shape)
    accepted = joined.withColumn("threshold", threshold).filter(
        F.col("threshold") | (F.col("explicit") & (F.size("concept") >= 2))
    )
    operator = F.when(F.col("threshold"), F.nullif(F.regexp_extract("norm_segment", "[<>]=?", 0), F.lit("")))
    return (
        accepted.groupBy("question_id", *KEY, "original", "normalized", "frequency")
        .agg(
            F.min_by(
                F.struct(F.array_join("concept", " ").alias("phrase"), operator.alias("operator"), "segment"), "segment_no"
            ).alias("m")
        )
        .select("question_id", "m.*", *KEY, "original", "normalized", "frequency", F.lit(0.94).alias("score"))
    )


def probe_containing(phrases: DataFrame, counts: DataFrame, limit: int = 5) -> DataFrame:
    """For phrases without an indexed match, the most frequent stored texts that contain them.

    ``counts`` holds every distinct value, not the bounded index.
    """
    values = counts.filter((F.col("storage") == "text") & F.col("value").isNotNull())
    lefts = phrases.select(F.lower("phrase").alias("left")).distinct()
    rights = values.select(F.lower("value").alias("right")).distinct()
    long = contained_pairs(lefts, rights).filter(F.contains("right", F.col("left")))
    short_grams = rights.select(
        "right", F.explode(F.array_distinct(F.concat(text.grams_of(F.col("right"), 1), text.grams_of(F.col("right"), 2)))).alias("left")
    )
    short = lefts.filter(F.length("left") < 3).join(short_grams, "left").filter(F.contains("right", F.col("left")))
    pairs = long.select("left", "right").union(short.select("left", "right"))
    # The order and the limit are those of the text alone, so each distinct text is ranked once for all its questions.
    stored = pairs.join(values.withColumn("right", F.lower("value")), "right").select("left", *KEY, "value", "frequency")
    best = top_k(stored, ["left", *KEY], [F.col("frequency").desc(), F.col("value")], limit)
    return join_few(phrases.withColumn("left", F.lower("phrase")), best, "left").select(
        "question_id", "phrase", *KEY, "value", "frequency", "rank"
    )
