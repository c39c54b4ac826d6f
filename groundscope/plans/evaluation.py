"""Result comparison, voting, scoring and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from groundscope.operators import metrics, results, stats
from groundscope.plans.registry import query
from groundscope.sources.tables import read_table

# ---------------------------------------------------------------- stored results per supplier


def supplier_results(spark, sf):
    """(cases, gold, predicted): six-row results per supplier and a perturbed copy of each."""
    grouped = read_table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("case_id"), "l_returnflag", "l_linestatus"
    ).agg(F.sum("l_quantity").cast("long").alias("q"))
    place = W.partitionBy("case_id").orderBy("l_returnflag", "l_linestatus")
    rows = grouped.withColumn("row_no", F.row_number().over(place).cast("long"))
    kind = F.pmod(F.col("case_id"), F.lit(4))
    key = ["l_returnflag", "l_linestatus", "q"]
    gold = rows.select("case_id", "row_no", results.encode_row(key, ["q"]).alias("row_key"), F.lit(3).alias("n_cols"))
    shifted = rows.withColumn("q", F.when((kind == 2) & (F.col("l_returnflag") == "R"), F.col("q") + 1).otherwise(F.col("q")))
    renumbered = shifted.withColumn("row_no", F.when(kind == 0, 100 - F.col("row_no")).otherwise(F.col("row_no")))
    copies = renumbered.withColumn(
        "row_no", F.explode(F.when(kind == 1, F.array(F.col("row_no"), F.col("row_no") + 50)).otherwise(F.array("row_no")))
    )
    predicted = copies.select("case_id", "row_no", results.encode_row(key, ["q"]).alias("row_key"), F.lit(3).alias("n_cols"))
    cases = read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("case_id"), (F.col("s_suppkey") % 2 == 1).alias("ordered")
    )
    return cases, gold, predicted


SUPPLIER_RESULTS = """WITH r AS (SELECT l_suppkey AS case_id, l_returnflag AS f, l_linestatus AS s, sum(l_quantity)::BIGINT AS q,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag, l_linestatus) AS row_no FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT case_id, row_no, f || s || q AS k FROM r),
p0 AS (SELECT case_id, CASE WHEN case_id % 4 = 0 THEN 100 - row_no ELSE row_no END AS row_no,
 f || s || (q + CASE WHEN case_id % 4 = 2 AND f = 'R' THEN 1 ELSE 0 END) AS k FROM r),
p AS (SELECT * FROM p0 UNION ALL SELECT case_id, row_no + 50, k FROM p0 WHERE case_id % 4 = 1),
c AS (SELECT s_suppkey AS case_id, s_suppkey % 2 = 1 AS ordered FROM supplier),
ms AS (SELECT case_id, bool_and(n = 0) AS eq FROM (SELECT case_id, k, sum(w) AS n FROM (SELECT case_id, k, 1 AS w FROM g
 UNION ALL SELECT case_id, k, -1 FROM p) GROUP BY 1, 2) GROUP BY 1),
od AS (SELECT case_id, bool_and(g.k IS NOT DISTINCT FROM p.k AND g.k IS NOT NULL) AS eq FROM g FULL JOIN p USING (case_id, row_no) GROUP BY 1),
st AS (SELECT case_id, bool_and(gk IS NOT NULL AND pk IS NOT NULL) AS eq FROM (SELECT DISTINCT case_id, k, k AS gk FROM g)
 FULL JOIN (SELECT DISTINCT case_id, k, k AS pk FROM p) USING (case_id, k) GROUP BY 1),
v AS (SELECT c.case_id, ordered, coalesce(ms.eq, true) AS multiset_equal, coalesce(od.eq, true) AS ordered_equal,
 coalesce(st.eq, true) AS set_equal FROM c LEFT JOIN ms USING (case_id) LEFT JOIN od USING (case_id) LEFT JOIN st USING (case_id)),
verdict AS (SELECT *, CASE WHEN ordered THEN ordered_equal ELSE multiset_equal END AS equal FROM v)
"""


@query("result_equality", SUPPLIER_RESULTS + "SELECT * FROM verdict")
def result_equality(spark, sf):
    """V1, V2, V3 for every supplier's result."""
    return results.equality(*supplier_results(spark, sf))


@query("multiset_equal", SUPPLIER_RESULTS + "SELECT case_id, multiset_equal FROM verdict")
def multiset_equal(spark, sf):
    """V1."""
    return results.multiset_equal(*supplier_results(spark, sf))


@query("ordered_equal", SUPPLIER_RESULTS + "SELECT case_id, ordered_equal FROM verdict")
def ordered_equal(spark, sf):
    """V2."""
    return results.ordered_equal(*supplier_results(spark, sf))


@query("set_equal", SUPPLIER_RESULTS + "SELECT case_id, set_equal FROM verdict")
def set_equal(spark, sf):
    """V3."""
    return results.set_equal(*supplier_results(spark, sf))


@query("scorer_agreement", SUPPLIER_RESULTS + """SELECT count(*) AS comparable,
 round(avg((equal = set_equal)::INT), 9) AS agreement FROM verdict""")
def scorer_agreement(spark, sf):
    """V5."""
    agreed = results.scorer_agreement(results.equality(*supplier_results(spark, sf)))
    return agreed.select("comparable", F.round("agreement", 9).alias("agreement"))


@query("result_signals", """WITH l AS (SELECT l_returnflag || l_linestatus AS case_id, l_orderkey AS row_no, l_returnflag AS f, l_quantity AS q,
 nullif(l_discount, 0) AS d, '{"v":"' || l_returnflag || '"}' || chr(31) || l_quantity::VARCHAR || chr(31) ||
 coalesce(nullif(l_discount, 0)::VARCHAR, 'null') AS k FROM lineitem)
SELECT case_id, count(*) AS row_count, 3 AS column_count, round(sum((d IS NULL)::INT) / (count(*) * 3), 9) AS null_proportion,
 round(1 - count(DISTINCT k) / count(*), 9) AS duplicate_rate, least(min(q), min(d)) AS numeric_min, greatest(max(q), max(d)) AS numeric_max,
 sum(('0x' || left(md5(k), 15))::BIGINT)::VARCHAR AS unordered_hash,
 sum(('0x' || left(md5(row_no || ':' || k), 15))::BIGINT)::VARCHAR AS ordered_hash FROM l GROUP BY case_id""")
def result_signals(spark, sf):
    """V4 over six results that together hold every line item."""
    rows = read_table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("case_id"), F.col("l_orderkey").alias("row_no"), "l_returnflag",
        "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
    )
    found = results.result_signals(rows, ["l_returnflag", "l_quantity", "l_discount"], ["l_quantity", "l_discount"])
    return found.withColumns({c: F.round(c, 9) for c in ("null_proportion", "duplicate_rate")})


# ---------------------------------------------------------------- candidates: the orders of a customer


def order_candidates(spark, sf):
    return read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("candidate_no"), F.col("o_orderstatus").alias("result_hash"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("diagnostics"), F.round(F.col("o_totalprice") / 1e6, 6).alias("risk"),
        F.length("o_orderpriority").alias("sql_length"), F.col("o_orderpriority").alias("path"),
        (F.col("o_orderstatus") != "P").alias("executed"), (F.col("o_orderpriority") > "3").alias("passed"),
        (F.length("o_orderpriority") % 4).alias("hard"), (F.col("o_totalprice") > 250000).alias("correct"),
    )


CANDIDATES = """WITH c AS (SELECT o_custkey AS case_id, o_orderkey AS candidate_no, o_orderstatus AS result_hash, (o_orderpriority = '1-URGENT')::INT AS diagnostics,
 round(o_totalprice / 1e6::DOUBLE, 6) AS risk, length(o_orderpriority) AS sql_length, o_orderpriority AS path, o_orderstatus <> 'P' AS executed,
 o_orderpriority > '3' AS passed, length(o_orderpriority) % 4 AS hard, o_totalprice > 250000 AS correct FROM orders) """


@query("majority_vote", CANDIDATES + """, g AS (SELECT case_id, result_hash, count(*) AS votes, min(candidate_no) AS first_no FROM c GROUP BY 1, 2),
 top AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, first_no) AS r, count(*) OVER (PARTITION BY case_id) AS groups FROM g),
 pool AS (SELECT c.*, t.votes, t.groups FROM c JOIN top t ON c.case_id = t.case_id AND t.r = 1 WHERE t.votes = 1 OR c.result_hash = t.result_hash)
 SELECT case_id, candidate_no, result_hash AS selected_group, CASE WHEN votes > 1 THEN 'majority_result_then_intent_critic' ELSE
 'intent_critic_no_result_majority' END AS reason, (votes = 1 AND groups > 1) OR diagnostics > 0 AS needs_review FROM pool
 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY diagnostics, risk, sql_length, path, candidate_no) = 1""")
def majority_vote(spark, sf):
    """V6."""
    return results.majority_vote(order_candidates(spark, sf))


@query("candidate_rank", CANDIDATES + """SELECT case_id, candidate_no FROM c QUALIFY row_number() OVER (PARTITION BY case_id
 ORDER BY executed DESC, passed DESC, hard, risk, sql_length, candidate_no) = 1""")
def candidate_rank(spark, sf):
    """V7."""
    return results.best_candidate(order_candidates(spark, sf))


@query("candidate_disagreement", CANDIDATES + "SELECT case_id, count(DISTINCT result_hash) > 1 AS disagreement FROM c WHERE executed GROUP BY case_id")
def candidate_disagreement(spark, sf):
    """V8."""
    return results.disagreement(order_candidates(spark, sf))


@query("oracle_gain", CANDIDATES + """, p AS (SELECT case_id, arg_min(correct, candidate_no)::INT AS f, bool_or(correct)::INT AS a FROM c GROUP BY 1)
 SELECT count(*) AS cases, round(avg(f), 9) AS first_candidate_accuracy, round(avg(a), 9) AS candidate_oracle, round(avg(a) - avg(f), 9) AS oracle_gain FROM p""")
def oracle_gain(spark, sf):
    """V9."""
    gain = results.oracle_gain(order_candidates(spark, sf))
    return gain.select("cases", *[F.round(c, 9).alias(c) for c in gain.columns if c != "cases"])


@query("complementarity", CANDIDATES + """, s AS (SELECT case_id, path, bool_or(correct) AS ok FROM c GROUP BY 1, 2), u AS (SELECT case_id, bool_or(ok) AS ok FROM s GROUP BY 1)
 SELECT path, count(*) FILTER (ok) AS cases FROM s GROUP BY 1 UNION ALL SELECT 'union', count(*) FILTER (ok) FROM u UNION ALL SELECT 'none', count(*) FILTER (NOT ok) FROM u""")
def complementarity(spark, sf):
    """V10, A8."""
    return results.complementarity(order_candidates(spark, sf))


# ---------------------------------------------------------------- attempts: the turns of a conversation


def attempts(spark, sf):
    n = F.length("text")
    failed = n % 3 == 0
    return read_table(spark, sf, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("attempt"), F.when(failed, "failed").otherwise("executed").alias("status"),
        F.when(failed & (n % 2 == 0), "timeout").when(failed, "syntax_error").alias("category"), (~failed & (n % 5 != 0)).alias("correct"),
    )


def attempt_cases(spark, sf):
    return read_table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(
        F.min_by("role", "turn").alias("opened_by")
    ).withColumn("scorable", F.col("case_id") % 17 != 0)


ATTEMPTS = """WITH a AS (SELECT conv_id AS case_id, turn AS attempt, CASE WHEN length(text) % 3 = 0 THEN 'failed' ELSE 'executed' END AS status,
 CASE WHEN length(text) % 6 = 0 THEN 'timeout' WHEN length(text) % 3 = 0 THEN 'syntax_error' END AS category,
 length(text) % 3 <> 0 AND length(text) % 5 <> 0 AS correct FROM conversations),
c AS (SELECT conv_id AS case_id, arg_min(role, turn) AS opened_by, conv_id % 17 <> 0 AS scorable FROM conversations GROUP BY conv_id),
s AS (SELECT case_id, count(*) AS attempts, arg_min(status, attempt) AS first_status, arg_max(status, attempt) AS last_status,
 arg_min(correct, attempt) AS first_correct, arg_max(correct, attempt) AS last_correct0, bool_or(coalesce(category = 'timeout', false)) AS timed_out,
 count(*) FILTER (status <> 'executed') AS rejected FROM a GROUP BY 1),
j AS (SELECT c.*, s.* EXCLUDE (case_id), scorable AND last_correct0 AS last_correct FROM c JOIN s USING (case_id))
"""


@query("case_metrics", ATTEMPTS + """SELECT opened_by, count(*) AS cases, round(avg(last_correct::INT), 9) AS execution_accuracy,
 round(avg((last_status = 'executed')::INT), 9) AS completion, round(avg(first_correct::INT), 9) AS first_attempt_accuracy,
 round(avg((last_correct AND attempts > 1 AND NOT first_correct)::INT), 9) AS correct_recovery_fraction, round(avg(timed_out::INT), 9) AS timeout_fraction,
 round(avg(scorable::INT), 9) AS reference_coverage FROM j GROUP BY opened_by""")
def case_metrics(spark, sf):
    """M1, M2, A6 over full denominators."""
    found = metrics.case_metrics(attempt_cases(spark, sf), metrics.attempt_summary(attempts(spark, sf)), ["opened_by"])
    return found.select("opened_by", "cases", *[F.round(c, 9).alias(c) for c in metrics.CASE_METRICS])


@query("recovery", ATTEMPTS + """SELECT count(*) FILTER (first_status <> 'executed') AS initial_failures,
 count(*) FILTER (attempts > 1 AND last_status = 'executed') AS recovered, round(count(*) FILTER (attempts > 1 AND last_status = 'executed')
 / count(*) FILTER (first_status <> 'executed'), 9) AS conditional_rate FROM j""")
def recovery(spark, sf):
    """M3."""
    found = metrics.recovery(metrics.attempt_summary(attempts(spark, sf)))
    return found.withColumn("conditional_rate", F.round("conditional_rate", 9))


OUTCOMES = ATTEMPTS + """, o AS (SELECT case_id, opened_by, scorable, CASE WHEN NOT scorable THEN 'gold_unscorable' WHEN last_status <> 'executed' THEN 'application_failure'
 WHEN NOT last_correct THEN 'execution_mismatch' ELSE 'correct' END AS category, last_status = 'executed' AS executed, attempts, rejected,
 last_status = 'executed' AND attempts > 1 AS execution_recovered, scorable AND last_status = 'executed' AND last_correct AS correct FROM j) """


def _outcomes(spark, sf):
    return metrics.outcomes(attempt_cases(spark, sf), metrics.attempt_summary(attempts(spark, sf)))


@query("outcomes", OUTCOMES + "SELECT * FROM o")
def outcomes(spark, sf):
    """M4, J8."""
    return _outcomes(spark, sf)


@query("failure_rollup", OUTCOMES + """SELECT opened_by, count(*) AS cases, count(*) FILTER (rejected > 0) AS initial_execution_failures,
 count(*) FILTER (execution_recovered) AS recovered_execution, count(*) FILTER (execution_recovered AND correct) AS recovered_correct,
 count(*) FILTER (execution_recovered AND category = 'gold_unscorable') AS recovered_unscorable, count(*) FILTER (category = 'correct') AS correct,
 count(*) FILTER (category = 'execution_mismatch') AS execution_mismatch, count(*) FILTER (category = 'application_failure') AS application_failure,
 count(*) FILTER (category = 'gold_unscorable') AS gold_unscorable FROM o GROUP BY 1""")
def failure_rollup(spark, sf):
    """M5."""
    return metrics.failure_rollup(_outcomes(spark, sf), ["opened_by"])


# ---------------------------------------------------------------- paired outcomes: labels per document


def paired(spark, sf):
    """Control (quality), perfect-evidence and candidate (not toxic) outcomes per labelled document."""
    documents = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read_table(spark, sf, "labels")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("case_id"), "lang", "source", "n_chars", (F.col("quality") == 1).alias("left_correct"),
        (F.col("toxic") == 0).alias("right_correct"), ((F.col("quality") == 1) | (F.col("n_chars") % 2 == 0)).alias("oracle_correct"),
    )


PAIRED = """WITH p AS (SELECT doc_id AS case_id, lang, source, n_chars, quality = 1 AS left_correct, toxic = 0 AS right_correct,
 quality = 1 OR n_chars % 2 = 0 AS oracle_correct FROM labels JOIN documents USING (doc_id)) """


@query("accuracy_by_category", PAIRED + """SELECT lang, avg(left_correct::INT) AS control, avg(right_correct::INT) AS candidate, avg(oracle_correct::INT) AS oracle FROM p GROUP BY lang""")
def accuracy_by_category(spark, sf):
    """M6."""
    modes = F.explode(F.array(*[
        F.struct(F.lit(mode).alias("mode"), F.col(f"{side}_correct").alias("correct"))
        for mode, side in (("control", "left"), ("candidate", "right"), ("oracle", "oracle"))
    ])).alias("m")
    rows = paired(spark, sf).select("lang", modes).select("lang", "m.*")
    return metrics.accuracy_by(rows, "lang", "mode", ["control", "candidate", "oracle"])


@query("micro_macro", """SELECT lang, round(sum(length(text) - length(replace(text, 'e', ''))) / sum(length(text)), 9) AS micro,
 round(avg((length(text) - length(replace(text, 'e', ''))) / nullif(length(text), 0)), 9) AS macro FROM documents GROUP BY lang""")
def micro_macro(spark, sf):
    """Share of one letter, weighted by length and per document."""
    rows = read_table(spark, sf, "documents").select(
        "lang", (F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))).alias("hits"), F.length("text").alias("total")
    )
    return rows.groupBy("lang").agg(
        F.round(metrics.micro("hits", "total"), 9).alias("micro"), F.round(metrics.macro("hits", "total"), 9).alias("macro")
    )


@query("transitions", PAIRED + """SELECT lang, count(*) FILTER (left_correct AND right_correct) AS both_correct, count(*) FILTER (NOT left_correct AND right_correct) AS wrong_to_correct,
 count(*) FILTER (left_correct AND NOT right_correct) AS correct_to_wrong, count(*) FILTER (NOT left_correct AND NOT right_correct) AS both_wrong FROM p GROUP BY lang""")
def transitions(spark, sf):
    """M11."""
    return metrics.transitions(paired(spark, sf), "left_correct", "right_correct", ["lang"])


@query("gap_recovery", PAIRED + """SELECT source, round(CASE WHEN avg(oracle_correct::INT) > avg(left_correct::INT) THEN (avg(right_correct::INT) - avg(left_correct::INT))
 / (avg(oracle_correct::INT) - avg(left_correct::INT)) END, 6) AS gap_recovery FROM p GROUP BY source""")
def gap_recovery(spark, sf):
    """M10."""
    rates = paired(spark, sf).groupBy("source").agg(
        metrics.rate(F.col("left_correct")).alias("n"), metrics.rate(F.col("oracle_correct")).alias("o"),
        metrics.rate(F.col("right_correct")).alias("g"),
    )
    return rates.select("source", F.round(metrics.gap_recovery(F.col("n"), F.col("o"), F.col("g")), 6).alias("gap_recovery"))


HELP = PAIRED + """, h AS (SELECT *, CASE WHEN left_correct AND oracle_correct THEN 'B' WHEN left_correct THEN 'D' WHEN oracle_correct THEN 'A' ELSE 'C' END AS help_group FROM p) """


@query("help_groups", HELP + """SELECT help_group, count(*) AS cases, avg(left_correct::INT) AS no_evidence_ex, avg(right_correct::INT) AS generated_ex,
 avg(oracle_correct::INT) AS oracle_ex, count(*) FILTER (NOT left_correct AND right_correct) AS recoveries, count(*) FILTER (left_correct AND NOT right_correct) AS regressions
 FROM h GROUP BY help_group""")
def help_groups(spark, sf):
    """M12."""
    return metrics.help_groups(paired(spark, sf), "left_correct", "oracle_correct", "right_correct")


@query("help_changes", HELP + """SELECT case_id, help_group, CASE WHEN right_correct THEN 'recovery' ELSE 'regression' END AS change FROM h WHERE left_correct <> right_correct""")
def help_changes(spark, sf):
    """M12, recovered and regressed ids."""
    return metrics.help_changes(paired(spark, sf), "left_correct", "oracle_correct", "right_correct")


def rule_checks(spark, sf):
    """Rules over documents: language, length bands and an even source; the label is correctness."""
    rules = {
        "is_english": F.col("lang") == "en", "not_short": F.col("n_chars") >= 200, "not_long": F.col("n_chars") < 5000,
        "clean": F.col("right_correct"),
    }
    exploded = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("passed")) for n, c in rules.items()])).alias("r")
    return paired(spark, sf).select("case_id", F.col("left_correct").alias("correct"), exploded).select("case_id", "correct", "r.*")


@query("rule_calibration", PAIRED + """, r AS (SELECT 'is_english' AS rule, lang = 'en' AS passed, left_correct FROM p UNION ALL SELECT 'not_short', n_chars >= 200, left_correct FROM p
 UNION ALL SELECT 'not_long', n_chars < 5000, left_correct FROM p UNION ALL SELECT 'clean', right_correct, left_correct FROM p),
 g AS (SELECT rule, count(*) FILTER (NOT passed) AS flagged, count(*) FILTER (NOT passed AND NOT left_correct) AS true_flags FROM r GROUP BY 1)
 SELECT rule, flagged, true_flags, round(true_flags / nullif(flagged, 0), 9) AS precision, coalesce(true_flags / nullif(flagged, 0) >= 0.9, false) AS allowed FROM g""")
def rule_calibration(spark, sf):
    """M15."""
    return metrics.rule_calibration(rule_checks(spark, sf)).withColumn("precision", F.round("precision", 9))


@query("detector_calibration", PAIRED + """, d AS (SELECT CASE WHEN n_chars % 5 = 0 THEN NULL WHEN lang = 'en' THEN 'operation' WHEN lang = 'de' THEN 'grain' WHEN lang = 'fr' THEN 'predicate' ELSE 'join' END AS family,
 NOT left_correct OR n_chars % 3 = 0 AS hit, left_correct AS b, CASE WHEN n_chars % 7 <> 0 THEN right_correct END AS a FROM p),
 g AS (SELECT family, count(*) AS flagged, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT b) AS wrong_attempts, count(*) FILTER (NOT b AND coalesce(a, false)) AS repaired,
 count(*) FILTER (b AND coalesce(NOT a, false)) AS regressions FROM d WHERE family IS NOT NULL GROUP BY 1)
 SELECT *, round(hits / flagged, 9) AS precision, round(repaired / nullif(wrong_attempts, 0), 9) AS repair_success,
 flagged >= 2 AND hits / flagged >= 0.8 AND coalesce(repaired / nullif(wrong_attempts, 0) >= 0.5, false) AND regressions = 0 AS enabled FROM g""")
def detector_calibration(spark, sf):
    """M16."""
    n = F.col("n_chars")
    detections = paired(spark, sf).select(
        F.when(n % 5 == 0, None).when(F.col("lang") == "en", "operation").when(F.col("lang") == "de", "grain")
        .when(F.col("lang") == "fr", "predicate").otherwise("join").alias("family"),
        (~F.col("left_correct") | (n % 3 == 0)).alias("hit"), F.col("left_correct").alias("correct_before"),
        F.when(n % 7 != 0, F.col("right_correct")).alias("correct_after"),
    )
    found = metrics.detector_calibration(detections)
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "repair_success")})


# ---------------------------------------------------------------- latency and intervals


@query("p95_nearest", """SELECT event_type, value AS p95_nearest FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
 count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = greatest(1, ceil(n * 0.95::DOUBLE))""")
def p95_nearest(spark, sf):
    """M18, nearest rank; exact without sorting a group in one task."""
    return stats.p95_nearest(read_table(spark, sf, "events"), ["event_type"], "value")


@query("p95_index", """SELECT event_type, value AS p95_index FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r,
 count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = least(n, floor(n * 0.95::DOUBLE) + 1)""")
def p95_index(spark, sf):
    """M18, index form."""
    return stats.p95_index(read_table(spark, sf, "events"), ["event_type"], "value")


DRAW = "('0x' || left(md5('20260911:' || b || ':' || {k}), 8))::BIGINT"
GROUP_BOOT = PAIRED + f""", g AS (SELECT source, sum(right_correct::INT - left_correct::INT)::DOUBLE AS d, count(*) AS n FROM p GROUP BY 1),
 num AS (SELECT *, row_number() OVER (ORDER BY md5(source), source) - 1 AS pick, count(*) OVER () AS groups FROM g),
 dr AS (SELECT b, {DRAW.format(k='k')} % (SELECT count(*) FROM g) AS pick FROM range(2000) t(b), range((SELECT count(*) FROM g)) u(k)),
 s AS (SELECT b, sum(d) / sum(n) AS v FROM dr JOIN num USING (pick) GROUP BY b),
 o AS (SELECT list(v ORDER BY v) AS l FROM s)
 SELECT round((SELECT sum(d) / sum(n) FROM g), 9) AS delta, (SELECT count(*) FROM g) AS groups, 2000 AS samples, round(l[51], 9) AS low, round(l[1951], 9) AS high FROM o"""


@query("group_bootstrap", GROUP_BOOT)
def group_bootstrap(spark, sf):
    """2000 paired resamples of whole sources."""
    found = stats.group_bootstrap(paired(spark, sf), "source", "left_correct", "right_correct")
    return found.select("groups", "samples", *[F.round(c, 9).alias(c) for c in ("delta", "low", "high")])


@query("case_bootstrap", PAIRED + f""", x AS (SELECT case_id, (right_correct::INT - left_correct::INT)::DOUBLE AS x FROM p),
 sh AS (SELECT x, sum(count(*)) OVER (ORDER BY x) AS upto, sum(count(*)) OVER (ORDER BY x) - count(*) AS low FROM x GROUP BY x),
 dr AS (SELECT b, {DRAW.format(k='case_id')} % (SELECT count(*) FROM x) AS u FROM x, range(300) t(b)),
 s AS (SELECT b, avg(x) AS v FROM dr JOIN sh ON u >= low AND u < upto GROUP BY b), o AS (SELECT list(v ORDER BY v) AS l FROM s)
 SELECT round((SELECT avg(x) FROM x), 9) AS delta, (SELECT count(*) FROM x) AS cases, 300 AS samples, round(l[8], 9) AS low, round(l[293], 9) AS high FROM o""")
def case_bootstrap(spark, sf):
    """300 resamples of single cases."""
    difference = F.col("right_correct").cast("int") - F.col("left_correct").cast("int")
    found = stats.case_bootstrap(paired(spark, sf), "case_id", difference)
    return found.select("cases", "samples", *[F.round(c, 9).alias(c) for c in ("delta", "low", "high")])


# ---------------------------------------------------------------- runs: one per source of documents


def runs(spark, sf):
    """Run-level measures: accuracy, completion and latency per source."""
    return paired(spark, sf).groupBy("source").agg(
        F.count("*").alias("cases"), metrics.rate(F.col("right_correct")).alias("accuracy"), metrics.rate(F.col("left_correct")).alias("control"),
        metrics.rate(F.col("n_chars") > 100).alias("completion"), F.round(F.avg("n_chars"), 4).alias("latency"),
        F.count_if(F.col("right_correct") & ~F.col("left_correct")).alias("recoveries"),
        F.count_if(~F.col("right_correct") & F.col("left_correct")).alias("regressions"),
    )


RUNS = PAIRED + """, r AS (SELECT source, count(*) AS cases, avg(right_correct::INT) AS accuracy, avg(left_correct::INT) AS control, avg((n_chars > 100)::INT) AS completion,
 round(avg(n_chars), 4) AS latency, count(*) FILTER (right_correct AND NOT left_correct) AS recoveries, count(*) FILTER (NOT right_correct AND left_correct) AS regressions FROM p GROUP BY 1) """


@query("gates", RUNS + """, f AS (SELECT source, concat_ws(',', CASE WHEN NOT accuracy - control >= 0.03 THEN 'lift' END, CASE WHEN NOT recoveries > regressions THEN 'recoveries_exceed_regressions' END,
 CASE WHEN NOT completion >= 0.95 THEN 'completion' END, CASE WHEN NOT latency <= 2000 THEN 'latency' END) AS failed_rules FROM r) SELECT source, failed_rules, failed_rules = '' AS passed FROM f""")
def gates(spark, sf):
    """B6."""
    judged = stats.gate(runs(spark, sf), {
        "lift": F.col("accuracy") - F.col("control") >= 0.03, "recoveries_exceed_regressions": F.col("recoveries") > F.col("regressions"),
        "completion": F.col("completion") >= 0.95, "latency": F.col("latency") <= 2000,
    })
    return judged.select("source", F.array_join("failed_rules", ",").alias("failed_rules"), "passed")


@query("winner", RUNS + """SELECT (SELECT source FROM r WHERE completion >= 0.5 ORDER BY accuracy DESC, completion DESC, latency LIMIT 1) AS winner,
 count(*) FILTER (completion >= 0.5) AS eligible FROM r""")
def winner(spark, sf):
    """B7."""
    return stats.winner(
        runs(spark, sf), "source", F.col("completion") >= 0.5, [F.col("accuracy"), F.col("completion"), -F.col("latency")]
    )


@query("comparable", RUNS + """SELECT count(DISTINCT cases > 0) = 1 AS same_captured, count(DISTINCT cases % 2) = 1 AS same_parity, true AS finite_accuracy, true AS finite_latency,
 count(DISTINCT cases > 0) = 1 AND count(DISTINCT cases % 2) = 1 AS comparable FROM r""")
def comparable(spark, sf):
    """B8."""
    tagged = runs(spark, sf).withColumns({"captured": F.col("cases") > 0, "parity": F.col("cases") % 2})
    return stats.comparable(tagged, ["captured", "parity"], ["accuracy", "latency"])


@query("recorded_metrics", PAIRED + "SELECT source, round(avg(right_correct::INT), 9) AS recomputed, count(*) AS cases FROM p GROUP BY source")
def recorded_metrics(spark, sf):
    """The recorded per-run accuracy must equal the mean of the case scores, or the job fails."""
    recorded = runs(spark, sf).select("source", "cases", F.col("accuracy").alias("recorded"))
    recomputed = paired(spark, sf).groupBy("source").agg((F.count_if("right_correct") / F.count("*")).alias("recomputed"))
    checked = stats.assert_recorded(recorded.join(recomputed, "source"), "recorded", "recomputed")
    return checked.select("source", "cases", F.round("recomputed", 9).alias("recomputed"))


@query("comparison_report", PAIRED + """SELECT lang, count(*) AS cases, printf('%.4f', avg(left_correct::INT)) AS control, printf('%.4f', avg(right_correct::INT)) AS candidate,
 printf('%+.4f', avg(right_correct::INT) - avg(left_correct::INT)) AS delta FROM p GROUP BY lang""")
def comparison_report(spark, sf):
    """The printed comparison table."""
    rates = paired(spark, sf).groupBy("lang").agg(
        F.count("*").alias("cases"), metrics.rate(F.col("left_correct")).alias("l"), metrics.rate(F.col("right_correct")).alias("r")
    )
    return rates.select(
        "lang", "cases", F.format_string("%.4f", "l").alias("control"), F.format_string("%.4f", "r").alias("candidate"),
        F.format_string("%+.4f", F.col("r") - F.col("l")).alias("delta"),
    )
