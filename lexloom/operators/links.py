"""Reports, candidate passages and the verification of literal citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import WS
from lexloom.operators.vectors import code_points, plan_chunks
from lexloom.session import cut

PASSAGE = r"[^.!?\n]+[.!?]*|[.!?\n]+"
# Limits of a link.
LINKS, FIELD, ALTERNATIVES = 24, 4096, 8
# Rows of a frame that goes back from Python.
OUT = 4096
STATUSES = ("supports", "contradicts", "related")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^" + WS + "]+")).cast("long")


def report_paragraphs(reports: DataFrame) -> DataFrame:
    """(doc_id, paragraph, text): blank lines part paragraphs; LF, CRLF and a lone CR end lines; trimmed, ids P1, P2..."""
    return placed_paragraphs(reports).select("doc_id", "paragraph", "text")


def placed_paragraphs(reports: DataFrame) -> DataFrame:
    """``report_paragraphs`` with start and end in the report.

    Line ends inside a paragraph stay as they are: a break of a LF stands for each end while paragraphs are cut, and a
    mark that no text holds keeps its kind.
    """
    # U+FFFE and U+FFFF are no characters; the one stands behind the LF of a CRLF, the other behind that of a lone CR.
    marked = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n\ufffe")), F.lit("\r"), F.lit("\n\uffff"))
    blank = r"\n[\ufffe\uffff]?(?:[ \t]*\n[\ufffe\uffff]?)+"
    parts = reports.select("doc_id", F.posexplode(F.arrays_zip(F.split(marked, blank, -1).alias("text"), F.regexp_extract_all(marked, F.lit(blank), F.lit(0)).alias("gap"))).alias("p", "x")).select("doc_id", "p", "x.text", "x.gap")
    # A lone CR has become two characters.
    size = lambda c: F.coalesce(F.length(c) - F.regexp_count(c, F.lit("\uffff")), F.lit(0)).cast("long")
    order = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("at", F.sum(size(F.col("text")) + size(F.col("gap"))).over(order) - size(F.col("text")) - size(F.col("gap")))
    parts = parts.withColumn("text", F.replace(F.replace("text", F.lit("\n\ufffe"), F.lit("\r\n")), F.lit("\n\uffff"), F.lit("\r")))
    start = F.col("at") + F.length("text") - F.length(F.regexp_replace("text", "^[" + WS + "]+", ""))
    trimmed = parts.withColumn("start", start).withColumn("text", F.regexp_replace("text", "^[" + WS + "]+|[" + WS + "]+$", "")).where("text <> ''")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("p"))
    return trimmed.select("doc_id", F.concat(F.lit("P"), number.cast("string")).alias("paragraph"), "start", (F.col("start") + F.length("text")).alias("end"), "text")


def _chunked(batches: Iterator[pd.DataFrame], tokenize: Callable[[str], list[tuple[int, int]]], room: int, head: int) -> Iterator[pd.DataFrame]:
    """The pieces of origins (doc_id, origin, shift, text): many short paragraphs share a frame, and long reports do not pile up."""
    columns = ["doc_id", "query", "origin", "start", "end", "text", "tokens"]
    for pdf in batches:
        rows = []
        for doc, origin, shift, text in zip(pdf.doc_id, pdf.origin, pdf["shift"], pdf.text, strict=True):
            chunks = plan_chunks(text, tokenize, room, [])
            names = [origin] if len(chunks) == 1 else [f"{origin}.{k}" for k in range(1, len(chunks) + 1)]
            rows += [(doc, name, origin, shift + a, shift + b, text[a:b], head + len(tokenize(text[a:b]))) for name, (a, b) in zip(names, chunks, strict=True)]
            if len(rows) >= OUT:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def query_set(reports: DataFrame, limit: int, margin: int = 0, tokenize: Callable[[str], list[tuple[int, int]]] = code_points, prefix: str = "query: ", specials: int = 2) -> DataFrame:
    """(doc_id, query, origin, start, end, text, tokens): every paragraph and the whole report, each in pieces that fit a model's input.

    Pieces are contiguous and cover their origin; each has at most ``limit`` - ``margin`` tokens, prefix and special ones counted.
    A piece is named after its origin, with a number from 1 where there are several. Places are those in the report. Reports of
    nothing but white space have no pieces.
    """
    whole = reports.where("text IS NOT NULL").select("doc_id", F.lit("report").alias("origin"), F.lit(0).cast("long").alias("shift"), "text")
    origins = placed_paragraphs(reports).select("doc_id", F.col("paragraph").alias("origin"), F.col("start").alias("shift"), "text").unionByName(whole)
    head = specials + len(tokenize(prefix))
    room = limit - margin - head
    if room < 1:
        raise ValueError("limit and margin leave no room")

    run = lambda batches: _chunked(batches, tokenize, room, head)
    return origins.where("doc_id IS NOT NULL").mapInPandas(run, "doc_id long, query string, origin string, start long, end long, text string, tokens long")


def check_reports(reports: DataFrame) -> DataFrame:
    """(doc_id, words, paragraphs, rule): rule is null for a valid report."""
    n = report_paragraphs(reports).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"))
    rows = reports.select("doc_id", words(F.col("text")).alias("words")).join(n, "doc_id", "left").withColumn("paragraphs", F.coalesce("paragraphs", F.lit(0)))
    return rows.withColumn("rule", F.when(F.col("words") == 0, "empty").when(F.col("paragraphs") != 2, "paragraphs").when(F.col("words") > 400, "words"))


def candidate_passages(texts: DataFrame) -> DataFrame:
    """(doc_id, start, end, text): runs up to sentence ends or line ends, trimmed, with offsets."""
    parts = texts.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(PASSAGE), F.lit(0))).alias("p", "piece"))
    order = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.length("piece").cast("long")).over(order) - F.length("piece")
    cut = parts.withColumn("at", at).withColumn("left", F.length("piece") - F.length(F.regexp_replace("piece", "^[" + WS + "]+", ""))).withColumn("text", F.regexp_replace("piece", "^[" + WS + "]+|[" + WS + "]+$", ""))
    return cut.where((F.col("text") != "") & ~F.col("text").rlike(r"^[.!?]")).select("doc_id", (F.col("at") + F.col("left")).alias("start"), (F.col("at") + F.col("left") + F.length("text")).alias("end"), "text")


def tail_drop(rows: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The head of each ranking of rows (query, text, and the columns of ``order``) whose texts fit the budget of bytes, with rank and used.

    Texts are replaced by their sizes first. Sums by query and range of the order come before any window, and only the
    ranges that begin within the budget are ranked row by row, so the rest of a hot query is never gathered.
    """
    sized = rows.withColumn("bytes", F.octet_length("text").cast("long")).drop("text")
    place = F.struct(*order)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(sized.repartitionByRange(n, "query", *order).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("query", "range").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("query").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("query", "range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0")).where(F.col("b0") <= budget)
    within = Window.partitionBy("query", "range").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    head = ranged.join(starts, ["query", "range"]).withColumn("used", F.col("b0") + F.sum("bytes").over(within)).withColumn("rank", (F.col("k0") + F.count(F.lit(1)).over(within)).cast("long"))
    return head.where(F.col("used") <= budget).drop("range", "bytes", "b0", "k0")


def verify_links(links: DataFrame, paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each link with its reason: null if accepted.

    ``links`` is (doc_id, paragraph, r_start, r_end, r_text, block_id, q_start, q_end, q_text, status, rationale,
    alternatives). The first failing rule is the reason; of equal links all but the first are duplicates.
    """
    p = paragraphs.select("doc_id", "paragraph", F.col("text").alias("p_text"))
    b = blocks.select("block_id", F.col("text").alias("b_text"))
    rows = links.join(p, ["doc_id", "paragraph"], "left").join(b, "block_id", "left")

    def literal(text: str, start: str, end: str, said: str) -> Column:
        return F.coalesce(F.substring(text, (F.col(start) + 1).cast("int"), (F.col(end) - F.col(start)).cast("int")) == F.col(said), F.lit(False)) & (F.col(start) < F.col(end))

    reason = (
        F.when(F.col("p_text").isNull(), "unknown_paragraph").when(F.col("b_text").isNull(), "unknown_block").when(~literal("p_text", "r_start", "r_end", "r_text"), "report_citation")
        .when(~literal("b_text", "q_start", "q_end", "q_text"), "block_citation").when(~F.col("status").isin(*STATUSES), "status").when(F.length("rationale") > FIELD, "field_length").when(F.size("alternatives") > ALTERNATIVES, "alternatives")
    )
    judged = rows.withColumn("reason", reason).drop("p_text", "b_text")
    key = ["doc_id", "paragraph", "r_start", "r_end", "block_id", "q_start", "q_end"]
    nth = F.row_number().over(Window.partitionBy(*key, F.col("reason").isNull()).orderBy("link"))
    return judged.withColumn("reason", F.when(F.col("reason").isNull() & (nth > 1), "duplicate").otherwise(F.col("reason")))


RESPONSE = "choices array<struct<finish_reason:string,message:struct<content:string,refusal:string>>>"


def parse_responses(rows: DataFrame) -> DataFrame:
    """(doc_id, content, fault) of model answers (doc_id, json): one choice that stopped by itself, without a refusal."""
    r = rows.withColumn("r", F.from_json("json", RESPONSE))
    one = F.get("r.choices", 0)
    fault = (
        F.when(F.col("r.choices").isNull(), "syntax").when(F.size("r.choices") != 1, "choices").when(~F.coalesce(one["finish_reason"] == "stop", F.lit(False)), "finish_reason")
        .when(one["message"]["refusal"].isNotNull(), "refusal").when(F.coalesce(one["message"]["content"], F.lit("")) == "", "empty")
    )
    return r.select("doc_id", F.when(fault.isNull(), one["message"]["content"]).alias("content"), fault.alias("fault"))


def answer_format(models: DataFrame) -> DataFrame:
    """(model, format) from (model, capabilities): the strictest format that a model offers."""
    c = F.col("capabilities")
    return models.select("model", F.when(F.array_contains(c, "structured_outputs"), "json_schema").when(F.array_contains(c, "response_format"), "json_object").otherwise("text").alias("format"))
