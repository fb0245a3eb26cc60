"""Queries of stores, jobs and links. Orders stand for records of customers, events for the log of jobs (user_id)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import jobs, links, store
from lexloom.plans.registry import Registry, table
from lexloom.session import shared_folder

R = Registry()
orders = lambda spark, d: table(spark, d, "orders")
documents = lambda spark, d: table(spark, d, "documents").select("doc_id", "text")


# Every ninth text becomes one no-break space, which is blank too.
@R.query("submit_text", f"SELECT doc_id, text FROM documents WHERE doc_id % 9 <> 0 AND regexp_matches(text, '[^{tx.WS}]')")
def submit_text(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.lit("\u00a0")).otherwise(F.col("text")))
    return rows.where((F.col("text") != "") & ~tx.is_blank(F.col("text")))


@R.query("latest_record", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_record(spark, sf_dir):
    return store.latest_record(orders(spark, sf_dir), "o_custkey", "o_orderkey")


@R.query("history_list", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders")
def history_list(spark, sf_dir):
    return store.history(orders(spark, sf_dir), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@R.query("append_record", "SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def append_record(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey")
    incoming = o.where("o_orderkey % 3 = 0").unionByName(o.where("o_orderkey % 9 = 0"))
    return store.new_rows(o.where("o_orderkey % 2 = 0"), incoming, "o_orderkey", table(spark, sf_dir, "customer").select("c_custkey"), "o_custkey").select("o_orderkey", "o_custkey")


@R.query("fk_check", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def fk_check(spark, sf_dir):
    return store.orphans(orders(spark, sf_dir), "o_custkey", table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey").select("o_orderkey")


@R.query("check_lineage", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 3 DAY")
def check_lineage(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return line.join(orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate < o_orderdate + INTERVAL 3 DAYS").select("l_orderkey", "l_linenumber")


@R.query("child_count", "SELECT o_orderkey, count(l_orderkey) AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def child_count(spark, sf_dir):
    return store.child_counts(orders(spark, sf_dir), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


@R.query("keyset_page", "WITH m AS (SELECT max(o_orderkey) // 2 AS b FROM orders), g AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders, m WHERE o_orderkey < b) SELECT o_orderkey, o_totalprice, (SELECT min(o_orderkey) FROM g WHERE n = 50 AND (SELECT count(*) FROM g) > 50) AS next_before FROM g WHERE n <= 50")
def keyset_page(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    return store.keyset_page(o, "o_orderkey", o.agg(F.max("o_orderkey")).first()[0] // 2, 50)


@R.query("report_get", "SELECT o_orderkey, o_custkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def report_get(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    shown = F.array_join(F.transform("x", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",")
    return orders(spark, sf_dir).join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", shown.alias("lines"))


@R.query("blob_put", "SELECT 'sha256:' || sha256(text) AS blob_id, any_value(strlen(text)) AS size FROM documents WHERE text IS NOT NULL GROUP BY 1")
def blob_put(spark, sf_dir):
    return store.blobs(documents(spark, sf_dir), F.col("text")).select("blob_id", "size")


@R.query("blob_get", "SELECT doc_id, 'sha256:' || sha256(text) AS blob_id, text AS content FROM documents WHERE text IS NOT NULL")
def blob_get(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("blob_id")).join(store.blobs(d, F.col("text")).drop("size"), "blob_id")


@R.query("blob_faults", "SELECT 'sha256:' || sha256(text) AS blob_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING bool_or(doc_id % 5 = 0)")
def blob_faults(spark, sf_dir):
    """All blobs are checked; those of every fifth document were damaged on purpose."""
    d = documents(spark, sf_dir)
    damaged = d.where("doc_id % 5 = 0").select(F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("damaged_id")).where("damaged_id IS NOT NULL").distinct()
    stored = store.blobs(d, F.col("text")).join(damaged, F.col("blob_id") == F.col("damaged_id"), "left")
    return store.blob_faults(stored.withColumn("content", F.when(F.col("damaged_id").isNotNull(), F.concat("content", F.lit("x"))).otherwise(F.col("content")))).select("blob_id")


@R.query(
    "restore_blobs",
    """WITH b AS (SELECT 'sha256:' || sha256(text) AS blob_id, any_value(strlen(text)) AS size, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1),
f AS (SELECT *, CASE WHEN first % 7 = 0 THEN 'missing' WHEN first % 5 = 0 THEN 'damaged' END AS stored_fault FROM b)
SELECT doc_id, f.blob_id, coalesce(stored_fault, CASE WHEN doc_id % 11 = 0 THEN 'size' END) AS fault, CASE WHEN coalesce(stored_fault, CASE WHEN doc_id % 11 = 0 THEN 'size' END) IS NULL THEN text END AS content
FROM documents d JOIN f ON f.blob_id = 'sha256:' || sha256(d.text)""",
)
def restore_blobs(spark, sf_dir):
    """Every document's text by its manifest; some blobs are taken away or damaged, and some sizes wrong, on purpose by the number of the first document."""
    d = documents(spark, sf_dir).where("text IS NOT NULL").withColumn("blob_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)))
    first = d.groupBy("blob_id").agg(F.min("doc_id").alias("first"))
    stored = store.blobs(d, F.col("text")).join(first, "blob_id").where("first % 7 <> 0")
    stored = stored.select("blob_id", F.when(F.col("first") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    size = F.octet_length("text").cast("long") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    return store.restore_blobs(d.select("doc_id", "blob_id", size.alias("size")), stored).select("doc_id", "blob_id", "fault", "content")


@R.query("cache_join", "SELECT o_orderkey, o_orderkey % 4 = 0 AS cached FROM orders")
def cache_join(spark, sf_dir):
    plan = orders(spark, sf_dir).select("o_orderkey")
    cache = plan.where("o_orderkey % 4 = 0")
    return plan.join(cache, "o_orderkey", "left_semi").withColumn("cached", F.lit(True)).unionByName(plan.join(cache, "o_orderkey", "left_anti").withColumn("cached", F.lit(False)))


@R.query("json_export", "SELECT o_orderkey, '{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || '}' AS json FROM orders")
def json_export(spark, sf_dir):
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("o_orderstatus"))
    return store.export_json(o, "o_orderkey")


@R.query("strict_json_scan", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def strict_json_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@R.query("restore_run", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS run_id FROM lineitem")
def restore_run(spark, sf_dir):
    """Two runs are published, one of them tried twice, and read back by their commits; their rows are hashed again."""
    root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    for run, rows in (("even", line.where("l_orderkey % 2 = 0")), ("odd", line.where("l_orderkey % 2 <> 0")), ("even", line.limit(0))):
        store.commit_run(spark, rows, root, run)
    return store.restore_run(spark, root, "even").unionByName(store.restore_run(spark, root, "odd"))


LOG = "log AS (SELECT user_id AS job_id, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'interrupted' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state, value AS progress FROM events)"


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "interrupted").when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return e.select(F.col("user_id").alias("job_id"), "event_id", "ts", state.alias("state"), F.col("value").alias("progress"))


@R.query("job_state", f"WITH {LOG} SELECT job_id, arg_max(state, event_id) AS state, max(event_id) AS event_id, count(*) AS events FROM log GROUP BY 1")
def job_state(spark, sf_dir):
    return jobs.job_states(log(spark, sf_dir))


@R.query("job_illegal_transitions", f"WITH {LOG}, b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY job_id ORDER BY event_id), 'start') AS before FROM log) SELECT job_id, event_id, before, state FROM b WHERE (before, state) NOT IN (('start', 'queued'), ('queued', 'running'), ('queued', 'interrupted'), ('running', 'done'), ('running', 'failed'), ('running', 'interrupted'), ('failed', 'queued'), ('interrupted', 'queued'))")
def job_illegal_transitions(spark, sf_dir):
    return jobs.illegal_transitions(log(spark, sf_dir))


@R.query("job_claims", f"WITH {LOG}, t AS (SELECT *, count(*) FILTER (state = 'queued') OVER (PARTITION BY job_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM log) SELECT job_id, attempt, min(event_id) AS winner, count(*) AS claimants FROM t WHERE state = 'running' GROUP BY 1, 2")
def job_claims(spark, sf_dir):
    return jobs.claims(log(spark, sf_dir))


@R.query("job_progress", f"WITH {LOG}, t AS (SELECT *, coalesce(lag(progress) OVER (PARTITION BY job_id ORDER BY event_id) > progress, false) AS fell FROM log) SELECT job_id, max(progress) AS done, NOT bool_or(fell) AS monotone FROM t GROUP BY 1")
def job_progress(spark, sf_dir):
    return jobs.progress(log(spark, sf_dir))


@R.query("job_consistency", f"WITH {LOG}, s AS (SELECT job_id, arg_max(state, event_id) AS state FROM log GROUP BY 1), r AS (SELECT DISTINCT o_custkey AS job_id FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus = 'F') SELECT coalesce(s.job_id, r.job_id) AS job_id, CASE WHEN state = 'done' AND r.job_id IS NULL THEN 'done_without_run' ELSE 'run_of_unfinished_job' END AS rule FROM s FULL JOIN r USING (job_id) WHERE (state = 'done' AND r.job_id IS NULL) OR (coalesce(state, '') <> 'done' AND r.job_id IS NOT NULL)")
def job_consistency(spark, sf_dir):
    runs = orders(spark, sf_dir).where("o_custkey % 3 = 0 AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("job_id")).distinct()
    return jobs.inconsistent(jobs.job_states(log(spark, sf_dir)), runs)


@R.query("job_list", f"WITH {LOG} SELECT job_id, event_id, state, row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) AS place FROM log WHERE state <> 'queued'")
def job_list(spark, sf_dir):
    return store.history(log(spark, sf_dir).where("state <> 'queued'"), "job_id", "event_id").select("job_id", "event_id", "state", "place")


# Reports: the documents with the line end after a full stop doubled; every third has CRLF line ends.
REP = "rep AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, replace(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10), chr(13) || chr(10)) FROM documents WHERE doc_id % 3 = 0)"


def reports(spark, sf_dir):
    doubled = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    return documents(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.replace(doubled, F.lit("\n"), F.lit("\r\n"))).otherwise(doubled))


WSQ = tx.WS
PARAS = REP + f", pp AS (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS p FROM (SELECT doc_id, string_split(text, CASE WHEN doc_id % 3 = 0 THEN chr(13) || chr(10) || chr(13) || chr(10) ELSE chr(10) || chr(10) END) AS l FROM rep)), par AS (SELECT doc_id, 'P' || row_number() OVER (PARTITION BY doc_id ORDER BY p) AS paragraph, text FROM (SELECT doc_id, p, regexp_replace(t, '^[{WSQ}]+|[{WSQ}]+$', '', 'g') AS text FROM pp) WHERE text <> '')"


@R.query("report_split", f"WITH {PARAS} SELECT * FROM par")
def report_split(spark, sf_dir):
    return links.report_paragraphs(reports(spark, sf_dir))


@R.query("check_report", f"WITH {PARAS}, w AS (SELECT doc_id, len(regexp_extract_all(text, '[^{WSQ}]+')) AS words FROM rep), n AS (SELECT doc_id, count(*) AS paragraphs FROM par GROUP BY 1) SELECT doc_id, words, coalesce(paragraphs, 0) AS paragraphs, CASE WHEN words = 0 THEN 'empty' WHEN coalesce(paragraphs, 0) <> 2 THEN 'paragraphs' WHEN words > 400 THEN 'words' END AS rule FROM w LEFT JOIN n USING (doc_id)")
def check_report(spark, sf_dir):
    return links.check_reports(reports(spark, sf_dir))


@R.query("word_paragraph_count", f"WITH {PARAS} SELECT doc_id, len(regexp_extract_all(rep.text, '[^{WSQ}]+')) AS words, count(par.text) AS paragraphs FROM rep LEFT JOIN par USING (doc_id) GROUP BY doc_id, rep.text")
def word_paragraph_count(spark, sf_dir):
    return links.check_reports(reports(spark, sf_dir)).drop("rule")


PASS = f"ps AS (SELECT doc_id, unnest(l) AS piece, unnest(range(len(l))) AS p FROM (SELECT doc_id, regexp_extract_all(text, '{links.PASSAGE}') AS l FROM documents)), pt AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) - length(piece) + length(piece) - length(regexp_replace(piece, '^[{WSQ}]+', '')) AS start, regexp_replace(piece, '^[{WSQ}]+|[{WSQ}]+$', '', 'g') AS text FROM ps)"


@R.query("candidate_passages", f"WITH {PASS} SELECT doc_id, start::BIGINT AS start, (start + length(text))::BIGINT AS \"end\", text FROM pt WHERE text <> '' AND NOT regexp_matches(text, '^[.!?]')")
def candidate_passages(spark, sf_dir):
    return links.candidate_passages(documents(spark, sf_dir))


@R.query("tail_drop_to_budget", "WITH r AS (SELECT source AS query, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank, doc_id, text FROM documents), u AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM r) SELECT query, rank, doc_id, used::BIGINT AS used FROM u WHERE used <= 262144")
def tail_drop_to_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("query"), "n_chars", "doc_id", "text")
    return links.tail_drop(rows, ["n_chars", "doc_id"], 256 * 1024).drop("n_chars")


@R.query("strip_fence", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"id\":' || doc_id || '}' ELSE 'see {\"id\":' || doc_id || '}' END AS answer FROM documents")
def strip_fence(spark, sf_dir):
    said = F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit("}"))
    answer = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(F.concat(F.lit(" see "), said))
    return documents(spark, sf_dir).select("doc_id", tx.strip_fence(answer).alias("answer"))


# Links from the first paragraph of a report to the document after it; faults of each kind are made by the number.
LINKS = f"""{PARAS}, lk AS (SELECT doc_id, doc_id AS link, CASE WHEN doc_id % 11 = 0 THEN 'P99' ELSE 'P1' END AS paragraph, 0 AS r_start, 5 AS r_end, CASE WHEN doc_id % 7 = 0 THEN '?' ELSE substring(par.text, 1, 5) END AS r_text,
  doc_id + 1 AS block_id, 2 AS q_start, 8 AS q_end, CASE WHEN doc_id % 5 = 0 THEN '?' ELSE substring(b.text, 3, 6) END AS q_text, CASE WHEN doc_id % 13 = 0 THEN 'maybe' ELSE 'supports' END AS status
  FROM par LEFT JOIN (SELECT doc_id - 1 AS doc_id, text FROM documents) b USING (doc_id) WHERE paragraph = 'P1'),
ld AS (SELECT * FROM lk UNION ALL SELECT * REPLACE (link + 1000000000 AS link) FROM lk WHERE doc_id % 3 = 0),
lj AS (SELECT ld.*, par.text AS p_text, b.text AS b_text FROM ld LEFT JOIN par USING (doc_id, paragraph) LEFT JOIN documents b ON b.doc_id = block_id),
lr AS (SELECT *, CASE WHEN p_text IS NULL THEN 'unknown_paragraph' WHEN b_text IS NULL THEN 'unknown_block' WHEN coalesce(substring(p_text, 1, 5) <> r_text, true) THEN 'report_citation' WHEN coalesce(substring(b_text, 3, 6) <> q_text, true) THEN 'block_citation' WHEN status = 'maybe' THEN 'status' END AS reason0 FROM lj)"""


@R.query("verify_links", f"WITH {LINKS} SELECT link, doc_id, block_id, CASE WHEN reason0 IS NULL AND row_number() OVER (PARTITION BY doc_id, paragraph, block_id, reason0 IS NULL ORDER BY link) > 1 THEN 'duplicate' ELSE reason0 END AS reason FROM lr")
def verify_links(spark, sf_dir):
    docs = documents(spark, sf_dir)
    paras = links.report_paragraphs(reports(spark, sf_dir))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("b"))
    first = paras.where("paragraph = 'P1'").join(nxt, "doc_id", "left")
    n = F.col("doc_id")
    made = first.select(
        "doc_id", n.alias("link"), F.when(n % 11 == 0, "P99").otherwise("P1").alias("paragraph"), F.lit(0).alias("r_start"), F.lit(5).alias("r_end"), F.when(n % 7 == 0, "?").otherwise(F.substring("text", 1, 5)).alias("r_text"),
        (n + 1).alias("block_id"), F.lit(2).alias("q_start"), F.lit(8).alias("q_end"), F.when(n % 5 == 0, "?").otherwise(F.substring("b", 3, 6)).alias("q_text"), F.when(n % 13 == 0, "maybe").otherwise("supports").alias("status"),
        F.lit("").alias("rationale"), F.array().cast("array<string>").alias("alternatives"),
    )
    twice = made.unionByName(made.where("doc_id % 3 = 0").withColumn("link", F.col("link") + 1_000_000_000))
    return links.verify_links(twice, paras, docs.select(F.col("doc_id").alias("block_id"), "text")).select("link", "doc_id", "block_id", "reason")


# Pieces of 91 code points: 100 without the 7 of the prefix and 2 special tokens. The last one of a whole report may be blank, and then joins the one before.
@R.query("query_set")
def query_set(spark, sf_dir):
    q = links.query_set(reports(spark, sf_dir), 100)
    return q.select("doc_id", "query", "origin", "start", "end", F.sha2("text", 256).alias("sha256"), "tokens")
