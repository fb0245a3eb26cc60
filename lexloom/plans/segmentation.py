"""Queries of preparation, span maps, segmentation and context units over ``documents``.

The texts have no CRLF and no blank lines, so the queries derive them: every line end becomes two CRLFs, which
makes each line a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions.text import CLOSERS, OPENERS, PARAGRAPH_BREAK, TITLES, TOKEN_PATTERN, WS
from lexloom.operators import context, segment, spans
from lexloom.plans.registry import Registry, table

R = Registry()


def plain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def crlf(spark, sf_dir):
    return plain(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n\r\n")))


CRLF = "docs AS (SELECT doc_id, replace(text, chr(10), chr(13) || chr(10) || chr(13) || chr(10)) AS text FROM documents WHERE text IS NOT NULL)"
quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
PIECES = CRLF + f""",
p0 AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_PATTERN.replace("'", "''")}') AS l FROM docs)),
p1 AS (SELECT doc_id, pos, text, sum(length(text)) OVER w - length(text) AS w_start, sum(length(text)) OVER w AS w_end, regexp_matches(text, '^[{WS}]+$') AS space
       FROM p0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
p2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, space ORDER BY pos) - 1 AS ord,
              sum(CASE WHEN space AND regexp_matches(text, '{PARAGRAPH_BREAK}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM p1)"""
TOKENS = PIECES + f""",
t0 AS (SELECT *, lag(text) OVER w AS b, lag(w_end) OVER w = w_start AS adj, lead(text) OVER w AS a, lead(w_start) OVER w = w_end AS touch,
              first_value(CASE WHEN text NOT IN ({quoted((*CLOSERS, *OPENERS))}) THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, block ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS content
       FROM p2 WHERE NOT space WINDOW w AS (PARTITION BY doc_id, block ORDER BY pos)),
t1 AS (SELECT *, content IS NULL OR regexp_matches(regexp_extract(content, '\\p{{L}}'), '^\\p{{Lu}}') AS resumes,
              regexp_full_match(text, '[.!?]+') AS punct,
              text IN ({quoted(CLOSERS)}) AND (text NOT IN ('"', '''') OR coalesce(adj, false)) AS closer FROM t0),
t2 AS (SELECT *, (lower(text) = 'etc.' AND resumes) OR (punct AND NOT regexp_full_match(text, '\\.{{2,}}') AND NOT coalesce(text = '.' AND coalesce(adj, false) AND (
                lower(b) IN ({quoted(TITLES)}) OR (lower(b) = 'etc' AND NOT resumes) OR (regexp_matches(b, '\\p{{N}}$') AND coalesce(touch AND regexp_matches(a, '^\\p{{N}}'), false))), false)) AS cand,
              sum(CASE WHEN punct OR closer THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, block ORDER BY pos) AS island FROM t1),
t3 AS (SELECT *, max(cand::INT) OVER (PARTITION BY doc_id, block, island) AS term FROM t2),
t4 AS (SELECT *, lag(island) OVER w AS li, lag(term) OVER w AS lt FROM t3 WINDOW w AS (PARTITION BY doc_id, block ORDER BY pos)),
tokens AS (SELECT doc_id, pos, ord, text, w_start, w_end, term,
                  sum(CASE WHEN li IS NULL THEN 1 ELSE 0 END) OVER w - 1 AS paragraph_ord,
                  sum(CASE WHEN li IS NULL OR (li <> island AND lt = 1) THEN 1 ELSE 0 END) OVER w - 1 AS sentence_ord
           FROM t4 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
SENTENCES = TOKENS + """,
s0 AS (SELECT doc_id, sentence_ord AS ord, min(paragraph_ord) AS paragraph_ord, min(w_start) AS w_start, max(w_end) AS w_end, count(*) AS tokens, max(term) AS term FROM tokens GROUP BY ALL),
sentences AS (SELECT s.doc_id, ord, paragraph_ord, w_start, w_end, substring(text, w_start::BIGINT + 1, (w_end - w_start)::BIGINT) AS text, tokens,
                     CASE WHEN term = 1 THEN 'terminal' ELSE 'paragraph_end' END AS end_rule FROM s0 s JOIN docs USING (doc_id)),
paragraphs AS (SELECT doc_id, paragraph_ord AS ord, min(w_start) AS w_start, max(w_end) AS w_end, count(DISTINCT sentence_ord) AS sentences, count(*) AS tokens FROM tokens GROUP BY ALL)"""
WINDOWS = SENTENCES + """,
windows AS (
  SELECT *, min(ord) OVER f AS win_first, max(ord) OVER f AS win_last, min(w_start) OVER f AS win_start, max(w_end) OVER f AS win_end, max(ord) OVER (PARTITION BY doc_id) AS last
  FROM sentences WINDOW f AS (PARTITION BY doc_id, paragraph_ord ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@R.query("prepare_literal", "SELECT doc_id, 1::BIGINT AS version, length(text) AS length, sha256(text) AS sha256, CASE WHEN length(text) > 0 THEN 1 ELSE 0 END::BIGINT AS pieces, text FROM documents WHERE text IS NOT NULL")
def prepare_literal(spark, sf_dir):
    return spans.prepare_literal(plain(spark, sf_dir))


@R.query("prepare_crlf", f"WITH {CRLF}, w AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM docs) SELECT doc_id, 2::BIGINT AS version, length(text) AS length, sha256(text) AS sha256, text FROM w")
def prepare_crlf(spark, sf_dir):
    return spans.prepare_crlf(crlf(spark, sf_dir))


MAP = CRLF + """,
parts AS (SELECT doc_id, unnest(l) AS copy, unnest(range(len(l))) AS part FROM (SELECT doc_id, string_split(text, chr(13) || chr(10)) AS l FROM docs)),
placed AS (SELECT doc_id, part, length(copy) AS n, coalesce(sum(length(copy)) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM parts),
every AS (SELECT doc_id, 2 * part AS k, 'copy' AS kind, b + part AS w_start, b + part + n AS w_end, b + 2 * part AS o_start, b + 2 * part + n AS o_end, NULL::BIGINT AS change FROM placed WHERE n > 0
          UNION ALL SELECT doc_id, 2 * part - 1, 'technical', b + part - 1, b + part, b + 2 * part - 2, b + 2 * part, part FROM placed WHERE part > 0),
span_map AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS piece, kind, w_start, w_end, o_start, o_end, change FROM every)"""


@R.query("span_map", f"WITH {MAP} SELECT * FROM span_map")
def span_map(spark, sf_dir):
    return spans.span_map(crlf(spark, sf_dir))


# Each token of the original, mapped to the copy and back.
@R.query("map_spans_inverse", f"WITH {TOKENS}, lens AS (SELECT doc_id, ord, w_start AS o_start, w_end AS o_end, (SELECT NULL) AS z FROM tokens) SELECT l.doc_id, l.ord AS span, o_start, o_end, length(replace(substring(text, 1, o_start::BIGINT), chr(13) || chr(10), chr(10))) AS w_start, length(replace(substring(text, 1, o_end::BIGINT), chr(13) || chr(10), chr(10))) AS w_end FROM lens l JOIN docs USING (doc_id)")
def map_spans_inverse(spark, sf_dir):
    docs = crlf(spark, sf_dir)
    tokens = F.transform(F.filter("u", lambda x: ~x["space"]), lambda x: F.struct(x["ord"].alias("span"), x["w_start"].alias("o_start"), x["w_end"].alias("o_end")))
    return spans.map_listed_inverse(segment.unit_lists(docs).select("doc_id", "text", tokens.alias("spans")))


# Every five code points of the copy, mapped to the original: a line end inside the copy is two code points there.
@R.query(
    "map_spans",
    f"""WITH {CRLF}, w AS (SELECT doc_id, text AS o, replace(text, chr(13) || chr(10), chr(10)) AS t FROM docs),
s AS (SELECT doc_id, t, i AS span, 50 * i AS w_start, least(50 * i + 50, length(t)) AS w_end FROM w, range(0, length(t) // 50 + 1) AS r(i) WHERE 50 * i < length(t))
SELECT doc_id, span, w_start, w_end, w_start + length(regexp_replace(substring(t, 1, w_start), '[^\\n]', '', 'g')) AS o_start,
       w_end + length(regexp_replace(substring(t, 1, w_end), '[^\\n]', '', 'g')) AS o_end FROM s""",
)
def map_spans(spark, sf_dir):
    docs = crlf(spark, sf_dir)
    n = F.length(F.replace("text", F.lit("\r\n"), F.lit("\n"))).cast("long")
    steps = docs.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor(n / 50))).alias("span")).where("50 * span < n")
    return spans.map_spans(steps.select("doc_id", "span", (F.col("span") * 50).alias("w_start"), F.least(F.col("span") * 50 + 50, "n").alias("w_end")), spans.span_map(docs))


@R.query("check_preparation", "SELECT doc_id, '' AS rule FROM documents WHERE false")
def check_preparation(spark, sf_dir):
    docs = crlf(spark, sf_dir)
    return spans.check_preparation(docs, spans.span_map(docs))


# The same check finds faults made on purpose: the first technical piece of every third document ends too late.
@R.query("check_preparation_faulty", f"WITH {MAP}, t AS (SELECT doc_id, min(piece) AS piece FROM span_map WHERE kind = 'technical' AND doc_id % 3 = 0 GROUP BY 1) SELECT doc_id, 'piece_size' AS rule FROM t UNION ALL SELECT doc_id, 'contiguous' FROM t JOIN span_map s USING (doc_id) WHERE s.piece = t.piece + 1 UNION ALL SELECT doc_id, 'coverage' FROM t WHERE piece = (SELECT max(piece) FROM span_map s WHERE s.doc_id = t.doc_id)")
def check_preparation_faulty(spark, sf_dir):
    docs = crlf(spark, sf_dir)
    first = F.min(F.when(F.col("kind") == "technical", F.col("piece"))).over(Window.partitionBy("doc_id"))
    broken = spans.span_map(docs).withColumn("first", first).withColumn("w_end", F.when((F.col("doc_id") % 3 == 0) & (F.col("piece") == F.col("first")), F.col("w_end") + 1).otherwise(F.col("w_end"))).drop("first")
    return spans.check_preparation(docs, broken)


# Borders of the copy, as empty spans: each start of a piece, and the end of the text.
@R.query("map_span_single", f"WITH {MAP} SELECT doc_id, piece AS span, w_start AS w, o_start AS o FROM span_map UNION ALL SELECT doc_id, -1, max(w_end), max(o_end) FROM span_map GROUP BY 1")
def map_span_single(spark, sf_dir):
    docs = crlf(spark, sf_dir)
    pieces = spans.span_map(docs)
    lengths = docs.where("text IS NOT NULL").select("doc_id", F.length(F.replace("text", F.lit("\r\n"), F.lit("\n"))).cast("long").alias("w_length"), F.length("text").cast("long").alias("o_length"))
    ends = pieces.groupBy("doc_id").agg(F.max("w_end").alias("w")).select("doc_id", F.lit(-1).cast("long").alias("span"), "w")
    return spans.map_points(pieces.select("doc_id", F.col("piece").alias("span"), F.col("w_start").alias("w")).unionByName(ends), pieces, lengths)


@R.query("token_offsets", f"WITH {PIECES} SELECT doc_id, pos::INT AS pos, text, w_start::BIGINT AS w_start, w_end::BIGINT AS w_end, space FROM p1")
def token_offsets(spark, sf_dir):
    return segment.pieces(crlf(spark, sf_dir))


@R.query("tokenize", f"WITH {TOKENS} SELECT doc_id, ord, text, w_start::BIGINT AS w_start, w_end::BIGINT AS w_end, paragraph_ord::BIGINT AS paragraph_ord, sentence_ord::BIGINT AS sentence_ord FROM tokens")
def tokenize(spark, sf_dir):
    return segment.tokens(crlf(spark, sf_dir))


@R.query("separators", f"WITH {PIECES} SELECT doc_id, ord, text, w_start::BIGINT AS w_start, w_end::BIGINT AS w_end FROM p2 WHERE space")
def separators(spark, sf_dir):
    return segment.separators(crlf(spark, sf_dir))


@R.query("sentence_split", f"WITH {SENTENCES} SELECT doc_id, ord::BIGINT AS ord, paragraph_ord::BIGINT AS paragraph_ord, w_start::BIGINT AS w_start, w_end::BIGINT AS w_end, text, tokens, end_rule FROM sentences")
def sentence_split(spark, sf_dir):
    return segment.sentences(crlf(spark, sf_dir)).drop("gap")


@R.query("paragraph_split", f"WITH {SENTENCES} SELECT doc_id, ord::BIGINT AS ord, w_start::BIGINT AS w_start, w_end::BIGINT AS w_end, sentences, tokens FROM paragraphs")
def paragraph_split(spark, sf_dir):
    return segment.paragraphs(crlf(spark, sf_dir))


@R.query("sentence_neighbors", f"WITH {SENTENCES} SELECT doc_id, ord::BIGINT AS ord, lag(ord) OVER w::BIGINT AS previous, lead(ord) OVER w::BIGINT AS next FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def sentence_neighbors(spark, sf_dir):
    return segment.sentence_neighbors(segment.sentences(crlf(spark, sf_dir)))


@R.query("tile_union", f"WITH {CRLF} SELECT doc_id, length(text) AS covered, sha256(text) AS sha256 FROM docs WHERE text <> ''")
def tile_union(spark, sf_dir):
    return segment.tiled(segment.unit_lists(crlf(spark, sf_dir))).select("doc_id", "covered", F.sha2("text", 256).alias("sha256"))


@R.query("check_segmentation", "SELECT doc_id, '' AS rule FROM documents WHERE false")
def check_segmentation(spark, sf_dir):
    return segment.check_segmentation(crlf(spark, sf_dir))


# The same check finds faults made on purpose: the third token of every fourth document has another text.
@R.query("check_segmentation_faulty", f"WITH {TOKENS} SELECT doc_id, unnest(['rebuilt', 'differs']) AS rule FROM tokens WHERE ord = 2 AND doc_id % 4 = 0 AND text <> '#'")
def check_segmentation_faulty(spark, sf_dir):
    docs = crlf(spark, sf_dir)
    hash_ = lambda x: x.withField("text", F.when(~x["space"] & (x["ord"] == 2), "#").otherwise(x["text"]))
    broken = segment.unit_lists(docs, ordered=True).withColumn("u", F.when(F.col("doc_id") % 4 == 0, F.transform("u", hash_)).otherwise(F.col("u")))
    return segment.check_segmentation(docs, broken)


# The texts as they are: lines end by one LF, so a text is one paragraph, however long.
PLAIN = SENTENCES.replace(CRLF, "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)")


@R.query("sentences_as_is", f"WITH {PLAIN} SELECT doc_id, ord::BIGINT AS ord, w_start::BIGINT AS w_start, w_end::BIGINT AS w_end, sha256(text) AS sha256, tokens, end_rule FROM sentences")
def sentences_as_is(spark, sf_dir):
    return segment.sentences(plain(spark, sf_dir)).select("doc_id", "ord", "w_start", "w_end", F.sha2("text", 256).alias("sha256"), "tokens", "end_rule")


@R.query(
    "context_window",
    f"""WITH {WINDOWS} SELECT w.doc_id, ord::BIGINT AS ord, paragraph_ord::BIGINT AS paragraph_ord, win_first::BIGINT AS win_first, win_last::BIGINT AS win_last, w_start::BIGINT AS focus_start, w_end::BIGINT AS focus_end,
       win_start::BIGINT AS win_start, win_end::BIGINT AS win_end, sha256(w.text) AS focus_sha256, sha256(substring(d.text, win_start::BIGINT + 1, (win_end - win_start)::BIGINT)) AS window_sha256,
       CASE WHEN ord - win_first = 1 THEN 'radius_met' WHEN win_first = 0 THEN 'document_start' ELSE 'paragraph_boundary' END AS previous_reason,
       CASE WHEN win_last - ord = 1 THEN 'radius_met' WHEN win_last = last THEN 'document_end' ELSE 'paragraph_boundary' END AS next_reason
FROM windows w JOIN docs d USING (doc_id)""",
)
def context_window(spark, sf_dir):
    return context.context_units(segment.sentences(crlf(spark, sf_dir)))


@R.query("window_limit_reason", f"WITH {WINDOWS} SELECT CASE WHEN ord - win_first = 1 THEN 'radius_met' WHEN win_first = 0 THEN 'document_start' ELSE 'paragraph_boundary' END AS previous_reason, CASE WHEN win_last - ord = 1 THEN 'radius_met' WHEN win_last = last THEN 'document_end' ELSE 'paragraph_boundary' END AS next_reason, count(*) AS n FROM windows GROUP BY ALL")
def window_limit_reason(spark, sf_dir):
    return context.context_units(segment.sentences(crlf(spark, sf_dir))).groupBy("previous_reason", "next_reason").agg(F.count(F.lit(1)).alias("n"))


_PLACE = "'{\"paragraph\":{\"end\":' || p_end::BIGINT || ',\"start\":' || p_start::BIGINT || '},\"sentence\":{\"end\":' || w_end::BIGINT || ',\"start\":' || w_start::BIGINT || '}}'"


@R.query(
    "logical_id",
    f"""WITH {SENTENCES}, j AS (SELECT s.doc_id, s.ord, s.paragraph_ord, s.w_start, s.w_end, p.w_start AS p_start, p.w_end AS p_end FROM sentences s JOIN paragraphs p ON s.doc_id = p.doc_id AND s.paragraph_ord = p.ord),
k AS (SELECT doc_id, ord, {_PLACE} AS focus, string_agg({_PLACE}, ',') OVER (PARTITION BY doc_id, paragraph_ord ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS w FROM j)
SELECT doc_id, ord::BIGINT AS ord, sha256('{{"document":{{"id":' || doc_id || ',"sha256":"' || sha256(text) || '"}},"focus":' || focus || ',"policy":{{"after":1,"before":1,"crossing":false,"id":"sentence_window","version":"1.0.0"}},"version":"1.0.0","window":[' || w || ']}}') AS logical_id
FROM k JOIN docs USING (doc_id)""",
)
def logical_id(spark, sf_dir):
    docs = crlf(spark, sf_dir)
    return context.logical_ids(segment.sentences(docs), None, docs)


@R.query("planned_cost", f"WITH {SENTENCES}, r AS (SELECT doc_id, count(*) OVER f AS refs, max(w_end) OVER f - min(w_start) OVER f AS chars FROM sentences WINDOW f AS (PARTITION BY doc_id, paragraph_ord ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT doc_id, count(*) AS units, sum(refs)::BIGINT AS sentence_refs, sum(chars)::BIGINT AS window_chars FROM r GROUP BY doc_id")
def planned_cost(spark, sf_dir):
    return context.planned_cost(segment.sentences(crlf(spark, sf_dir)))


@R.query("cost_guard", f"WITH {SENTENCES}, r AS (SELECT doc_id, count(*) OVER f AS refs, max(w_end) OVER f - min(w_start) OVER f AS chars FROM sentences WINDOW f AS (PARTITION BY doc_id, paragraph_ord ORDER BY ord ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), c AS (SELECT doc_id, count(*) AS units, sum(refs)::BIGINT AS sentence_refs, sum(chars)::BIGINT AS window_chars FROM r GROUP BY doc_id) SELECT *, CASE WHEN units > 40 THEN 'units' WHEN sentence_refs > 90 THEN 'sentence_refs' WHEN window_chars > 9000 THEN 'window_chars' END AS \"limit\" FROM c WHERE units > 40 OR sentence_refs > 90 OR window_chars > 9000")
def cost_guard(spark, sf_dir):
    return context.cost_guard(context.planned_cost(segment.sentences(crlf(spark, sf_dir))), units=40, refs=90, chars=9000)


@R.query("context_report", f"WITH {SENTENCES} SELECT count(*) AS units, count(DISTINCT doc_id) AS docs, sum(tokens)::BIGINT AS tokens, count(*) FILTER (end_rule = 'terminal') AS terminal FROM sentences")
def context_report(spark, sf_dir):
    s = segment.sentences(crlf(spark, sf_dir))
    return s.agg(F.count(F.lit(1)).alias("units"), F.count_distinct("doc_id").alias("docs"), F.sum("tokens").alias("tokens"), F.count_if(F.col("end_rule") == "terminal").alias("terminal"))
