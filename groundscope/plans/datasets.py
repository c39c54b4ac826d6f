"""Dataset freezing and integrity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundscope.functions import text
from groundscope.operators import dataset, integrity
from groundscope.plans.registry import query
from groundscope.sources.tables import read_table, read_tables

SEED = 20260923


def document_rows(spark, sf):
    """Documents as cases: question = first line, statement = source and language, database = source."""
    doc = read_table(spark, sf, "documents")
    return doc.select(
        F.col("doc_id").alias("idx"), F.col("source").alias("db_id"), (F.col("doc_id") % 97).alias("group_id"),
        F.concat(F.left("lang", F.lit(2)), F.lit("-"), (F.col("n_chars") % 401).cast("string")).alias("question_key"),
        F.concat(F.col("source"), F.lit("-"), (F.col("n_chars") % 53).cast("string")).alias("statement_key"),
        (F.col("n_chars") % 11 != 0).alias("valid"),
    )


DOC_ROWS = """d AS (SELECT doc_id AS idx, source AS db_id, doc_id % 97 AS group_id, left(lang, 2) || '-' || (n_chars % 401) AS question_key,
 source || '-' || (n_chars % 53) AS statement_key, n_chars % 11 <> 0 AS valid FROM documents)"""


@query("question_keys", """SELECT doc_id, md5(trim(regexp_replace(replace(lower(lang || ' : ' || source || ' - "' || n_chars || '"'), 'ß', 'ss'), '\\W+', ' ', 'g'))) AS question_key,
 md5(trim(regexp_replace(lower('  SELECT  ' || source || chr(10) || chr(9) || 'FROM ' || lang), '\\s+', ' ', 'g'))) AS statement_key FROM documents""")
def question_keys(spark, sf):
    """T12."""
    question = F.concat("lang", F.lit(" : "), "source", F.lit(' - "'), F.col("n_chars").cast("string"), F.lit('"'))
    statement = F.concat(F.lit("  SELECT  "), "source", F.lit("\n\tFROM "), "lang")
    return read_table(spark, sf, "documents").select(
        "doc_id", F.md5(text.question_key(question)).alias("question_key"), F.md5(text.statement_key(statement)).alias("statement_key")
    )


@query("greedy_dedupe", f"""WITH RECURSIVE {DOC_ROWS}, n AS (SELECT *, row_number() OVER (ORDER BY idx) AS i FROM d WHERE valid),
 st AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS idx, false AS kept, []::VARCHAR[] AS q, []::VARCHAR[] AS s
 UNION ALL SELECT n.i, n.idx, NOT list_contains(q, question_key) AND NOT list_contains(s, statement_key),
 CASE WHEN NOT list_contains(q, question_key) AND NOT list_contains(s, statement_key) THEN list_append(q, question_key) ELSE q END,
 CASE WHEN NOT list_contains(q, question_key) AND NOT list_contains(s, statement_key) THEN list_append(s, statement_key) ELSE s END
 FROM st JOIN n ON n.i = st.i + 1) SELECT idx FROM st WHERE kept""")
def greedy_dedupe(spark, sf):
    """The rows a sequential two-key scan keeps, found by rounds of parallel minima."""
    return dataset.greedy_dedupe(document_rows(spark, sf), "idx", "question_key", "statement_key", "valid").select("idx")


def _exposures(spark, sf):
    labels = read_table(spark, sf, "labels")
    rows = document_rows(spark, sf)
    toxic = rows.join(labels.filter("toxic = 1").select(F.col("doc_id").alias("idx")), "idx", "left_semi")
    busiest = rows.groupBy("db_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "db_id").limit(1)
    return busiest, toxic.select((F.col("group_id") % 7).alias("group_id")), toxic, toxic


@query("exclude_reasons", f"""WITH RECURSIVE {DOC_ROWS}, tox AS (SELECT d.* FROM d JOIN labels ON doc_id = idx WHERE toxic = 1),
 top AS (SELECT db_id FROM d GROUP BY 1 ORDER BY count(*) DESC, db_id LIMIT 1),
 e AS (SELECT *, CASE WHEN db_id IN (SELECT db_id FROM top) THEN 'excluded_database' WHEN group_id IN (SELECT group_id % 7 FROM tox)
 OR question_key IN (SELECT question_key FROM tox) THEN 'exposed_question_group' WHEN statement_key IN (SELECT statement_key FROM tox)
 THEN 'exposed_statement' END AS ex FROM d), n AS (SELECT *, row_number() OVER (ORDER BY idx) AS i FROM e),
 st AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS idx, NULL::VARCHAR AS reject_reason, []::VARCHAR[] AS q, []::VARCHAR[] AS s
 UNION ALL SELECT i, idx, r, CASE WHEN r IS NULL THEN list_append(q, question_key) ELSE q END, CASE WHEN r IS NULL THEN list_append(s, statement_key) ELSE s END
 FROM (SELECT n.i, n.idx, question_key, statement_key, q, s, CASE WHEN ex IS NOT NULL THEN ex WHEN list_contains(q, question_key) THEN 'duplicate_question'
 WHEN list_contains(s, statement_key) THEN 'duplicate_statement' WHEN NOT valid THEN 'invalid_source' END AS r FROM st JOIN n ON n.i = st.i + 1))
 SELECT idx, reject_reason FROM st WHERE i > 0""")
def exclude_reasons(spark, sf):
    """Exclusion and duplicate reasons in order of precedence."""
    found = dataset.exclusion_reasons(document_rows(spark, sf), *_exposures(spark, sf))
    return found.select("idx", "reject_reason")


@query("near_duplicates", """WITH RECURSIVE k AS (SELECT doc_id AS id, trim(regexp_replace(replace(translate(lower(text), 'ςſ', 'σs'), 'ß', 'ss'), '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+', ' ', 'g')) AS key FROM documents),
 e AS (SELECT key, min(id) AS rep FROM k GROUP BY key), w AS (SELECT rep, key, string_split(key, ' ') AS ws FROM e),
 s AS (SELECT rep, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) ELSE [key] END) AS runs FROM w),
 x AS (SELECT rep, len(runs) AS n, unnest(runs) AS run FROM s),
 p AS (SELECT a.rep AS a, b.rep AS b, a.n AS n, b.n AS m, count(*) AS c FROM x a JOIN x b ON a.run = b.run AND a.rep < b.rep GROUP BY ALL HAVING count(*) >= 0.7::DOUBLE * (a.n + b.n - count(*))),
 edges AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 reach AS (SELECT rep AS id, rep AS r FROM e UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
 g AS (SELECT id AS rep, min(r) AS group_id FROM reach GROUP BY 1)
 SELECT id, group_id FROM k JOIN e USING (key) JOIN g USING (rep)""")
def near_duplicates(spark, sf):
    """Groups of equal and nearly equal documents, whole texts."""
    return dataset.near_duplicate_groups(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("exact_groups", """SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies FROM documents""")
def exact_groups(spark, sf):
    """T13, equality part, grouped by digest so that long texts are not shuffled twice."""
    doc = read_table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = doc.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return doc.join(groups, "h").select("doc_id", "first_id", "copies")


@query("one_per_group", """SELECT text_group, doc_id FROM (SELECT source || lang AS text_group, min(doc_id) AS doc_id FROM documents
 WHERE source || lang NOT IN (SELECT source || lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY 1)""")
def one_per_group(spark, sf):
    """D3: one document per group, groups seen with a toxic label blocked."""
    doc = read_table(spark, sf, "documents").select("doc_id", F.concat("source", "lang").alias("text_group"))
    used = doc.join(read_table(spark, sf, "labels").filter("toxic = 1"), "doc_id").select("text_group")
    return dataset.one_per_group(doc, "text_group", ["doc_id"], used).select("text_group", "doc_id")


@query("assign_roles", f"""SELECT source, place, CASE WHEN place <= 12 THEN 'train' WHEN place <= 16 THEN 'validation' WHEN place <= 20 THEN 'development' END AS role
 FROM (SELECT source, row_number() OVER (ORDER BY sha256('{SEED}:' || source), source) AS place FROM (SELECT DISTINCT source FROM documents))""")
def assign_roles(spark, sf):
    """Sources to roles."""
    doc = read_table(spark, sf, "documents")
    return dataset.assign_roles(doc, "source", [("train", 12), ("validation", 4), ("development", 4)], SEED)


QUOTAS = {"en": 60, "fr": 40, "de": 40, "es": 100000}


def _quota(spark, sf):
    doc = read_table(spark, sf, "documents").select("doc_id", "lang", dataset.token_length("text").alias("tokens"))
    quotas = doc.select("lang").distinct().withColumn(
        "quota", F.when(F.col("lang") == "en", QUOTAS["en"]).when(F.col("lang") == "es", QUOTAS["es"]).otherwise(40)
    )
    return dataset.quota_fill(doc, ["lang"], quotas, F.col("tokens") <= 200, SEED, "doc_id")


QUOTA_CTE = f"""WITH d AS (SELECT doc_id, lang, len(regexp_extract_all(text, '\\S+')) AS tokens, sha256('{SEED}:' || doc_id) AS h,
 CASE lang WHEN 'en' THEN 60 WHEN 'es' THEN 100000 ELSE 40 END AS quota FROM documents),
 w AS (SELECT *, coalesce(sum((tokens <= 200)::INT) OVER (PARTITION BY lang ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS taken FROM d),
 seen AS (SELECT * FROM w WHERE taken < quota) """


@query("quota_fill", QUOTA_CTE + "SELECT doc_id, lang, tokens, taken + 1 AS accept_rank FROM seen WHERE tokens <= 200")
def quota_fill(spark, sf):
    """Documents in digest order with a length limit, until the language quota is met."""
    return _quota(spark, sf)[0].select("doc_id", "lang", F.col("tokens").cast("long").alias("tokens"), "accept_rank")


@query("quota_report", QUOTA_CTE + """SELECT lang, max(quota) AS quota, count(*) FILTER (tokens <= 200) AS accepted, count(*) AS considered,
 count(*) FILTER (tokens > 200) AS overlength, round(count(*) FILTER (tokens <= 200) / count(*), 9) AS coverage FROM seen GROUP BY lang""")
def quota_report(spark, sf):
    """Coverage per stratum."""
    return _quota(spark, sf)[1].withColumn("coverage", F.round("coverage", 9))


@query("round_robin", f"""SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}:' || source || ':' || doc_id), doc_id) AS turn FROM documents)
 ORDER BY turn, source LIMIT 200""")
def round_robin(spark, sf):
    """200 documents, one per source and turn (the sample size is the feature)."""
    doc = read_table(spark, sf, "documents").select("doc_id", "source", dataset.seeded(SEED, "source", "doc_id").alias("h"))
    return dataset.round_robin(doc, "source", 200, [F.col("h"), F.col("doc_id")]).select("doc_id", "source", "turn")


@query("seeded_sample", f"SELECT doc_id, lang FROM documents ORDER BY sha256('{SEED}:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf):
    """A sample of exactly 100 (the sample size is the feature)."""
    return dataset.seeded_sample(read_table(spark, sf, "documents").select("doc_id", "lang"), 100, SEED, "doc_id")


@query("split_ranges", f"""WITH g AS (SELECT doc_id, source, row_number() OVER (ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS place FROM documents),
 r AS (SELECT *, CASE WHEN place <= 40 THEN 'reproduction' WHEN place <= 100 THEN 'calibration' WHEN place <= 200 THEN 'selection' END AS role FROM g)
 SELECT doc_id, place, role FROM r""")
def split_ranges(spark, sf):
    """Contiguous roles over the digest order of every document; the rest has no role."""
    from groundscope.operators.ranking import hash_rank

    doc = read_table(spark, sf, "documents").select("doc_id", dataset.seeded(SEED, "doc_id").alias("h"))
    placed = hash_rank(doc, [], "h", "place", ["doc_id"])
    roles = dataset.split_ranges(placed, "place", [("reproduction", 40), ("calibration", 60), ("selection", 100)])
    checked = dataset.assert_disjoint(roles.filter("role IS NOT NULL"), "doc_id").select("doc_id", "role")
    return roles.drop("role").join(checked, "doc_id", "left").select("doc_id", "place", "role")


@query("disjoint_groups", f"""SELECT source AS group_id, CASE WHEN place <= 12 THEN 'train' WHEN place <= 16 THEN 'validation' ELSE 'development' END AS role, n AS rows FROM
 (SELECT source, count(*) AS n, row_number() OVER (ORDER BY sha256('{SEED}:' || source), source) AS place FROM documents GROUP BY source)""")
def disjoint_groups(spark, sf):
    """D8 check: every source keeps one role, or the job fails."""
    doc = read_table(spark, sf, "documents").select("doc_id", "source")
    roles = dataset.assign_roles(doc, "source", [("train", 12), ("validation", 4), ("development", 4)], SEED).select("source", "role")
    return dataset.assert_disjoint(doc.join(roles, "source").withColumnRenamed("source", "group_id"), "group_id")


@query("stratified", f"""WITH c AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'B' WHEN quality = 0 AND toxic = 0 THEN 'A' ELSE 'C' END AS stratum FROM labels)
 SELECT doc_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS r FROM c)
 WHERE stratum = 'A' OR (stratum = 'B' AND r <= 6) OR (stratum = 'C' AND r <= 5)""")
def stratified(spark, sf):
    """All of A, six of B, five of C."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    cases = read_table(spark, sf, "labels").select(
        "doc_id", F.when(good & ~toxic, "B").when(~good & ~toxic, "A").otherwise("C").alias("stratum")
    )
    return dataset.stratified(cases, "stratum", {"A": None, "B": 6, "C": 5}, SEED, "doc_id").select("doc_id", "stratum")


@query("exposed_ids", "SELECT doc_id AS id FROM labels UNION SELECT conv_id FROM conversations UNION SELECT item_id FROM benchmark")
def exposed_ids(spark, sf):
    """Ids seen by any of three captures."""
    names = {"labels": "doc_id", "conversations": "conv_id", "benchmark": "item_id"}
    return dataset.exposed_ids([read_table(spark, sf, t).select(F.col(c).alias("id")) for t, c in names.items()])


@query("diversity", 'SELECT count(*) AS "rows", count(DISTINCT source) AS databases FROM documents')
def diversity(spark, sf):
    """D11."""
    return dataset.assert_diverse(read_table(spark, sf, "documents"), "source", 8)


@query("length_tokens", """SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS tokens, length(text) AS chars FROM documents""")
def length_tokens(spark, sf):
    """Whole texts."""
    return read_table(spark, sf, "documents").select(
        "doc_id", dataset.token_length("text").cast("long").alias("tokens"), F.length("text").alias("chars")
    )


@query("assemble_records", """SELECT c_custkey AS case_id, md5('### Database Schema' || chr(10) || 'CREATE TABLE orders (o_orderkey, o_custkey)' || chr(10) || chr(10) || '### Question' || chr(10) ||
 'Total spend of ' || c_name || '?' || chr(10) || chr(10) || '### Scoped Database Evidence' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '(none)' ELSE c_mktsegment END || chr(10) || chr(10) || '### SQL') AS content_md5,
 'SELECT sum(o_totalprice) FROM orders WHERE o_custkey = ' || c_custkey AS completion FROM customer""")
def assemble_records(spark, sf):
    """One record per customer."""
    key = F.col("c_custkey")
    cases = read_table(spark, sf, "customer").select(
        key.alias("case_id"), F.concat(F.lit("Total spend of "), "c_name", F.lit("?\nBenchmark evidence: spend is the price")).alias("question"),
        F.lit("CREATE TABLE orders (o_orderkey, o_custkey)").alias("schema_text"),
        F.when(key % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("evidence_text"),
        F.concat(F.lit("SELECT sum(o_totalprice) FROM orders WHERE o_custkey = "), key.cast("string")).alias("statement"),
    )
    built = dataset.assemble_records(cases)
    return built.select("case_id", F.md5(F.col("messages")[1]["content"]).alias("content_md5"), "completion")


FINGERPRINTS = """SELECT name, n AS row_count, sha256(n || ':' || s) AS fingerprint FROM (
 SELECT 'customer' AS name, count(*) AS n, sum(('0x' || left(md5(concat_ws(chr(31), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)), 15))::BIGINT) AS s FROM customer
 UNION ALL SELECT 'labels', count(*), sum(('0x' || left(md5(concat_ws(chr(31), doc_id, quality, toxic)), 15))::BIGINT) FROM labels
 UNION ALL SELECT 'conversations', count(*), sum(('0x' || left(md5(concat_ws(chr(31), conv_id, turn, role, text)), 15))::BIGINT) FROM conversations)"""


@query("fingerprint", FINGERPRINTS)
def fingerprint(spark, sf):
    """Order-free table fingerprints."""
    return integrity.snapshot(read_tables(spark, sf, ["customer", "labels", "conversations"]))


@query("fold_fingerprint", f"SELECT sha256('v1' || chr(10) || string_agg(name || '=' || fingerprint, chr(10) ORDER BY name)) AS identity FROM ({FINGERPRINTS})")
def fold_fingerprint(spark, sf):
    """One identity over all parts and a version."""
    return integrity.fold_fingerprint(integrity.snapshot(read_tables(spark, sf, ["customer", "labels", "conversations"])), ["v1"])


@query("changed_tables", "SELECT 'labels' AS name, 'changed' AS change UNION ALL SELECT 'customer', 'removed' UNION ALL SELECT 'region', 'added'")
def changed_tables(spark, sf):
    """One altered, one removed, one added table against a snapshot."""
    before = read_tables(spark, sf, ["customer", "labels", "conversations"])
    after = {
        "labels": before["labels"].withColumn("toxic", F.when(F.col("doc_id") % 50 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))),
        "conversations": before["conversations"].repartition(5), "region": read_table(spark, sf, "region"),
    }
    return integrity.changed(integrity.snapshot(before), integrity.snapshot(after))


@query("exposure_log", """SELECT event_type AS role, user_id AS actor, count(*) AS openings, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_opened FROM events GROUP BY 1, 2""")
def exposure_log(spark, sf):
    """Events as openings of roles by users."""
    log = read_table(spark, sf, "events").select(F.col("event_type").alias("role"), F.col("user_id").alias("actor"), F.col("ts").alias("opened_at"))
    return integrity.exposure_report(log).withColumn("first_opened", F.date_format("first_opened", "yyyy-MM-dd HH:mm:ss"))


@query("ledger", """SELECT event_id, event_type, spent, spent <= 5000 AS within FROM (SELECT event_id, event_type, sum(value::DECIMAL(18, 2)) OVER (PARTITION BY event_type ORDER BY ts, event_id
 ROWS UNBOUNDED PRECEDING)::DOUBLE AS spent FROM events)""")
def ledger(spark, sf):
    """I4: running charge per event type, hour buckets first."""
    log = read_table(spark, sf, "events").select("event_id", "event_type", "ts", F.col("value").cast("decimal(18,2)").alias("seconds"))
    spent = integrity.ledger(log, ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"], "seconds", 5000)
    return spent.select("event_id", "event_type", F.col("spent").cast("double").alias("spent"), "within")


@query("portable_fingerprint", """SELECT 'pages' AS name, n AS row_count, sha256(n || ':' || s) AS fingerprint FROM (SELECT count(*) AS n,
 sum(('0x' || left(md5(concat_ws(chr(31), page_id, md5(html))), 15))::BIGINT) AS s FROM pages)""")
def portable_fingerprint(spark, sf):
    """Page addresses replaced by the digest of the page."""
    pages = read_table(spark, sf, "pages")
    records = pages.select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"))
    contents = pages.select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.md5("html").alias("fingerprint"))
    return integrity.portable_fingerprint(records, "path", contents, "pages").select("name", "row_count", "fingerprint")
