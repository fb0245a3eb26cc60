"""Queries of sentence marks, clipping, gold spans and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import links, segment
from lexloom.plans.registry import Registry, table
from lexloom.plans.segmentation import SENTENCES, TOKENS, crlf

R = Registry()


@R.query("sentence_start_mark", f"WITH {SENTENCES} SELECT t.doc_id, t.ord, s.doc_id IS NOT NULL AS starts FROM tokens t LEFT JOIN sentences s ON s.doc_id = t.doc_id AND s.w_start = t.w_start")
def sentence_start_mark(spark, sf_dir):
    return segment.sentence_starts(segment.sentence_lists(crlf(spark, sf_dir)))


@R.query("paragraph_clip", f"WITH {SENTENCES} SELECT doc_id, ord::BIGINT AS ord, greatest(w_start, 100)::BIGINT AS start, least(w_end, 2000)::BIGINT AS \"end\" FROM paragraphs WHERE least(w_end, 2000) > greatest(w_start, 100)")
def paragraph_clip(spark, sf_dir):
    return segment.clip_paragraphs(segment.paragraphs(crlf(spark, sf_dir)), 100, 2000)


@R.query("check_gold", f"WITH {TOKENS} SELECT doc_id, w_start::BIGINT AS start, 'text' AS rule FROM tokens WHERE ord % 35 = 0 AND text <> '?'")
def check_gold(spark, sf_dir):
    """Every fifth token is gold; every seventh of those has another text on purpose."""
    docs = crlf(spark, sf_dir)
    t = segment.tokens(docs).where("ord % 5 = 0")
    gold = t.select("doc_id", F.col("w_start").alias("start"), F.col("w_end").alias("end"), F.when(F.col("ord") % 7 == 0, "?").otherwise(F.col("text")).alias("text"))
    return segment.check_gold(gold, docs)


@R.query("legacy_prep", "SELECT doc_id, sha256(substring(source || chr(10) || text, 1, 2000)) AS sha256, greatest(0, length(source) + 1 + length(text) - 2000)::BIGINT AS omitted FROM documents WHERE text IS NOT NULL")
def legacy_prep(spark, sf_dir):
    headed = F.concat("source", F.lit("\n"), "text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.substring(headed, 1, 2000), 256).alias("sha256"), F.greatest(F.lit(0), F.length(headed) - 2000).cast("long").alias("omitted"))


@R.query("llm_response_parse", "SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 4) THEN source || ' ' || doc_id END AS content, CASE doc_id % 5 WHEN 1 THEN 'choices' WHEN 2 THEN 'finish_reason' WHEN 3 THEN 'refusal' END AS fault FROM documents")
def llm_response_parse(spark, sf_dir):
    k = F.col("doc_id") % 5
    message = F.struct(F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("content"), F.when(k == 3, "no").alias("refusal"))
    choice = F.struct(F.when(k == 2, "length").otherwise("stop").alias("finish_reason"), message.alias("message"))
    answer = F.to_json(F.struct(F.when(k == 1, F.array(choice, choice)).otherwise(F.array(choice)).alias("choices")))
    return links.parse_responses(table(spark, sf_dir, "documents").select("doc_id", answer.alias("json")))


@R.query("model_catalog_lookup", "SELECT event_id AS model, CASE event_type WHEN 'view' THEN 'json_schema' WHEN 'click' THEN 'json_object' ELSE 'text' END AS format FROM events")
def model_catalog_lookup(spark, sf_dir):
    able = F.when(F.col("event_type") == "view", F.array(F.lit("structured_outputs"), F.lit("response_format"))).when(F.col("event_type") == "click", F.array(F.lit("response_format"))).otherwise(F.array(F.lit("tools")))
    return links.answer_format(table(spark, sf_dir, "events").select(F.col("event_id").alias("model"), able.alias("capabilities")))
