"""Queries of search, fragments and evaluation.

Queries are the texts of ``benchmark``; turns of ``conversations`` are fragments whose blocks are the conversations.
Vectors come from ``embeddings``: one in a hundred is a query, and a text goes with the vector of its number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import _ACCENTED, _PLAIN, STOP_TERMS, fold_terms
from lexloom.functions.vectors import doubles
from lexloom.operators import evaluate, fragments, search
from lexloom.plans.registry import Registry, table

R = Registry()
STOP = ", ".join(f"'{x}'" for x in STOP_TERMS)


def folded(text: str) -> str:
    return f"list_filter(regexp_extract_all(replace(translate(lower({text}), '{_ACCENTED}', '{_PLAIN}'), 'ß', 'ss'), '\\p{{L}}+'), lambda t: length(t) > 1 AND t NOT IN ({STOP}))"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "conv_id", "text")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), doubles(F.col("embedding")).alias("v"), "label")


@R.query("fold_terms", f"SELECT doc_id, len(t) AS terms, sha256(array_to_string(t, ' ')) AS sha256 FROM (SELECT doc_id, {folded('text')} AS t FROM documents)")
def fold(spark, sf_dir):
    t = documents(spark, sf_dir).withColumn("t", fold_terms(F.col("text")))
    return t.select("doc_id", F.size("t").cast("long").alias("terms"), F.sha2(F.array_join("t", " "), 256).alias("sha256"))


INDEX = f"ex AS (SELECT doc_id AS id, unnest({folded('text')}) AS term FROM documents), idx AS (SELECT id, term, count(*) AS tf FROM ex GROUP BY ALL), len AS (SELECT doc_id AS id, coalesce(len({folded('text')}), 0) AS length FROM documents)"


@R.query("bm25_index", f"WITH {INDEX} SELECT * FROM idx")
def bm25_index(spark, sf_dir):
    return search.postings(documents(spark, sf_dir))


@R.query("document_frequency", f"WITH {INDEX} SELECT term, count(*) AS df FROM idx GROUP BY term")
def document_frequency(spark, sf_dir):
    return search.document_frequency(search.postings(documents(spark, sf_dir)))


@R.query("bm25_stats", f"WITH {INDEX} SELECT count(*) AS documents, round(coalesce(avg(length), 1), 6) AS mean_length FROM len")
def bm25_stats(spark, sf_dir):
    return search.corpus_stats(search.lengths(documents(spark, sf_dir))).withColumn("mean_length", F.round("mean_length", 6))


@R.query("term_postings", f"WITH {INDEX}, q AS (SELECT DISTINCT item_id AS query, unnest({folded('text')}) AS term FROM benchmark) SELECT query, id, tf, term FROM idx JOIN q USING (term)")
def term_postings(spark, sf_dir):
    asked = benchmark(spark, sf_dir).select(F.col("query_id").alias("query"), F.explode(F.array_distinct(fold_terms(F.col("text")))).alias("term"))
    return search.postings(documents(spark, sf_dir)).join(asked, "term")


def bm25(docs: str, number: str) -> str:
    return f"""ex AS (SELECT {number} AS id, unnest({folded('text')}) AS term FROM {docs}), idx AS (SELECT id, term, count(*) AS tf FROM ex GROUP BY ALL), len AS (SELECT {number} AS id, coalesce(len({folded('text')}), 0) AS length FROM {docs}),
st AS (SELECT count(*) AS n, coalesce(avg(length), 1) AS mean FROM len), df AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
q AS (SELECT DISTINCT item_id AS query, unnest({folded('text')}) AS term FROM benchmark),
bm AS (SELECT query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM idx JOIN df USING (term) JOIN q USING (term) JOIN len USING (id), st GROUP BY ALL)"""


@R.query("bm25_score", f"WITH {bm25('documents', 'doc_id')} SELECT query, id, round(score, 6) AS score FROM bm")
def bm25_score(spark, sf_dir):
    return search.bm25_scores(documents(spark, sf_dir), benchmark(spark, sf_dir)).withColumn("score", F.round("score", 6))


@R.query("bm25_topk", f"WITH {bm25('documents', 'doc_id')}, r AS (SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank FROM bm) SELECT * FROM r WHERE rank <= 50")
def bm25_topk(spark, sf_dir):
    return search.ranked(bm25_score(spark, sf_dir)).where("rank <= 50")


DENSE = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), dn AS (SELECT q.id AS query, c.id, round(list_inner_product(q.v, c.v), 6) AS score FROM e q, e c WHERE q.id % 100 = 0), dr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM dn)"


@R.query("dense_score", f"WITH {DENSE} SELECT query, id, score, rank FROM dr WHERE rank <= 50")
def dense_score(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return search.dense_scores(v, v.where("id % 100 = 0").select(F.col("id").alias("query"), "v"))


HYBRID = f"""WITH {bm25('conversations', 'conv_id * 1000 + turn')},
sp AS (SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank, 'bm25' AS method FROM bm WHERE score > 0),
e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
ev AS (SELECT v, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM e),
dn AS (SELECT b.item_id AS query, f.id, round(list_inner_product(q.v, c.v), 6) AS score FROM benchmark b JOIN ev q ON q.k = b.item_id % q.n, (SELECT DISTINCT conv_id * 1000 + turn AS id FROM conversations) f JOIN ev c ON c.k = f.id % c.n),
de AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, 'dense' AS method FROM dn),
bl AS (SELECT DISTINCT conv_id * 1000 + turn AS id, conv_id AS block FROM conversations),
br AS (SELECT query, method, block, min(rank) AS first, max(score) AS best FROM (SELECT * FROM sp WHERE rank <= 50 UNION ALL SELECT * FROM de WHERE rank <= 50) JOIN bl USING (id) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query, method ORDER BY first) AS block_rank FROM br),
fu AS (SELECT query, block, round(sum(1.0::DOUBLE / (60 + block_rank)), 9) AS rrf, count(*) AS methods FROM rk GROUP BY ALL)"""


def _hybrid_parts(spark, sf_dir):
    t = turns(spark, sf_dir).dropDuplicates(["doc_id"])
    sparse = search.bm25_scores(turns(spark, sf_dir), benchmark(spark, sf_dir))
    # Every turn and every query has a vector: that of its number, counted round the table (vec_id has no gaps).
    v = vectors(spark, sf_dir).select(F.col("id").alias("k"), "v")
    n = v.count()
    corpus = t.select(F.col("doc_id").alias("id"), (F.col("doc_id") % n).alias("k")).join(v, "k").select("id", "v")
    asked = benchmark(spark, sf_dir).select(F.col("query_id").alias("query"), (F.col("query_id") % n).alias("k")).join(v, "k").select("query", "v")
    return sparse, search.dense_scores(corpus, asked), t.select(F.col("doc_id").alias("id"), F.col("conv_id").alias("block"))


@R.query("hybrid_rrf", HYBRID + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, block) AS position FROM fu) WHERE position <= 12")
def hybrid_rrf(spark, sf_dir):
    return search.hybrid(*_hybrid_parts(spark, sf_dir))


@R.query("block_rank", HYBRID + " SELECT query, method, block, first, best, block_rank FROM rk")
def block_rank(spark, sf_dir):
    sparse, near, blocks = _hybrid_parts(spark, sf_dir)
    sparse = search.ranked(sparse.where("score > 0").withColumn("score", F.round("score", 6))).where("rank <= 50").withColumn("method", F.lit("bm25"))
    return search.block_ranks(sparse.unionByName(near.withColumn("method", F.lit("dense"))), blocks)


FRAG = """frag AS (SELECT doc_id AS block_id, k AS frag_no, 300 * k AS start, least(300 * k + 400, length(text)) AS "end", [k + 1, k + 2] AS pages, substring(text, 300 * k + 1, 400) AS text, source || ' — section ' || k AS header
  FROM documents, range(0, 1 + greatest(0, ceil((length(text) - 400) / 300.0))::BIGINT) AS r(k) WHERE length(text) > 0)"""


def frags(spark, sf_dir):
    return fragments.cut_fragments(table(spark, sf_dir, "documents"))


@R.query("fragment_block", f"WITH {FRAG} SELECT block_id, frag_no, start, \"end\", sha256(header || chr(10) || text) AS input_sha256 FROM frag")
def fragment_block(spark, sf_dir):
    return frags(spark, sf_dir).select("block_id", "frag_no", "start", "end", F.sha2(F.concat("header", F.lit("\n"), "text"), 256).alias("input_sha256"))


@R.query("block_rebuild", f"WITH {FRAG} SELECT doc_id AS block_id, d.text, n AS fragments FROM documents d JOIN (SELECT block_id, count(*) AS n FROM frag GROUP BY 1) ON block_id = doc_id")
def block_rebuild(spark, sf_dir):
    return fragments.rebuild_blocks(frags(spark, sf_dir))


@R.query("check_blocks", "SELECT doc_id AS block_id, '' AS rule FROM documents WHERE false")
def check_blocks(spark, sf_dir):
    return fragments.check_blocks(frags(spark, sf_dir))


# The same check finds faults made on purpose: fragment 1 of every third block is lost.
@R.query("check_blocks_faulty", f"WITH {FRAG} SELECT block_id, 'ordinal' AS rule FROM frag WHERE block_id % 3 = 0 AND frag_no > 1")
def check_blocks_faulty(spark, sf_dir):
    return fragments.check_blocks(frags(spark, sf_dir).where("block_id % 3 <> 0 OR frag_no <> 1"))


@R.query("pages_union", f"WITH {FRAG} SELECT block_id, max(frag_no) + 2 AS pages, (max(frag_no) + 2) * (max(frag_no) + 3) // 2 AS total FROM frag GROUP BY 1")
def pages_union(spark, sf_dir):
    p = fragments.block_pages(frags(spark, sf_dir))
    return p.select("block_id", F.size("pages").cast("long").alias("pages"), F.aggregate("pages", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@R.query("title_strip", f"WITH {FRAG} SELECT block_id, frag_no, regexp_replace(header, ' — section \\d+$', '') AS title FROM frag")
def title_strip(spark, sf_dir):
    from lexloom.functions.text import title_strip as strip

    return frags(spark, sf_dir).select("block_id", "frag_no", strip(F.col("header"), F.concat(F.lit("section "), F.col("frag_no").cast("string"))).alias("title"))


@R.query("block_lookup", f"WITH {FRAG} SELECT block_id, count(*) AS fragments, min(start) AS start, max(\"end\") AS \"end\", sha256(d.text) AS sha256 FROM frag JOIN documents d ON doc_id = block_id GROUP BY block_id, d.text")
def block_lookup(spark, sf_dir):
    f = frags(spark, sf_dir)
    ends = f.groupBy("block_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return fragments.rebuild_blocks(f).join(ends, "block_id").select("block_id", "fragments", "start", "end", F.sha2("text", 256).alias("sha256"))


# A citation of the middle of each text, listed with the fragments 0 and 1, which need not meet or cover it.
@R.query(
    "citation_block",
    f"""WITH {FRAG}, c AS (SELECT doc_id AS block_id, length(text) // 4 AS c_start, length(text) // 2 AS c_end FROM documents WHERE length(text) > 3),
m AS (SELECT c.*, f.frag_no, greatest(start, c_start) AS lo, least("end", c_end) AS hi FROM c, (VALUES (0), (1)) l(k) LEFT JOIN frag f ON f.block_id = c.block_id AND f.frag_no = k),
g AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY block_id ORDER BY lo NULLS FIRST, hi NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c_start) AS frontier FROM m)
SELECT block_id, c_start, c_end, count(*) AS fragments, bool_and(coalesce(hi > lo, false)) AS all_meet, max(hi) = c_end AND bool_and(coalesce(lo <= frontier, false)) AS covered FROM g GROUP BY 1, 2, 3""",
)
def citation_block(spark, sf_dir):
    n = F.length("text")
    cited = documents(spark, sf_dir).where(n > 3).select(F.col("doc_id").alias("block_id"), F.floor(n / 4).alias("c_start"), F.floor(n / 2).alias("c_end"), F.array(F.lit(0), F.lit(1)).alias("frag_nos"))
    return fragments.citation_cover(cited, frags(spark, sf_dir))


EVAL = f"""WITH {DENSE}, gd AS (SELECT q.id AS query, c.id, CASE WHEN c.label = q.label THEN 1 + c.id % 3 ELSE 0 END AS grade FROM e q, e c WHERE q.id % 100 = 0 AND q.id <> c.id),
rk AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM dr WHERE query <> id AND rank <= 50),
tot AS (SELECT query, count(*) AS relevant, max(grade) AS best FROM gd WHERE grade > 0 GROUP BY 1),
ideal AS (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS pos FROM gd WHERE grade > 0),
ks AS (SELECT unnest([1, 3, 10]) AS k),
got AS (SELECT query, k, sum((grade > 0)::INT) / any_value(relevant) AS recall, coalesce(max(CASE WHEN grade > 0 THEN 1.0::DOUBLE / rank END), 0) AS mrr, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg
        FROM rk JOIN gd USING (query, id) JOIN tot USING (query), ks WHERE rank <= k GROUP BY ALL),
ide AS (SELECT query, k, sum((pow(2, grade) - 1) / log2(pos + 1)) AS idcg FROM ideal, ks WHERE pos <= k GROUP BY ALL),
me AS (SELECT query, k, recall, mrr, dcg / idcg AS ndcg FROM got JOIN ide USING (query, k))"""


def _measures(spark, sf_dir):
    v = vectors(spark, sf_dir)
    asked = v.where("id % 100 = 0").select(F.col("id").alias("query"), "v", F.col("label").alias("q_label"))
    near = search.ranked(search.dense_scores(v, asked).where("query <> id").drop("rank"))
    # Relevant are the vectors of the query's label, with grades 1 to 3.
    graded = v.select("id", "label").join(asked.select("query", "q_label"), F.col("label") == F.col("q_label")).where("query <> id").select("query", "id", (1 + F.col("id") % 3).alias("grade"))
    return evaluate.retrieval_measures(near, graded)


@R.query("eval_retrieval", EVAL + " SELECT query, k, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM me")
def eval_retrieval(spark, sf_dir):
    return _measures(spark, sf_dir).select("query", "k", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@R.query("ir_macro_mean", EVAL + " SELECT k, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS queries FROM me GROUP BY k")
def ir_macro_mean(spark, sf_dir):
    return evaluate.macro_mean(_measures(spark, sf_dir))


@R.query("backend_agreement", """WITH p AS (SELECT embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: round(x, 3)) AS b FROM embeddings),
m AS (SELECT list_cosine_similarity(a, b) AS c, list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))) AS rm, list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) ** 2)) AS rs, len(a) AS n,
      list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] / sqrt(list_inner_product(a, a)) - b[i] / sqrt(list_inner_product(b, b))))) AS um FROM p)
SELECT count(*) AS vectors, round(min(c), 9) AS min_cosine, round(avg(c), 9) AS mean_cosine, round(max(rm), 9) AS raw_max, round(sqrt(sum(rs) / sum(n)), 9) AS raw_rms, round(max(um), 9) AS unit_max, bool_and(c > 0.99) AS agree FROM m""")
def backend_agreement(spark, sf_dir):
    return evaluate.backend_agreement(vectors(spark, sf_dir).select(F.col("v").alias("a"), F.transform("v", lambda x: F.round(x, 3)).alias("b")))


@R.query("gold_accuracy", "SELECT field, count(*) AS targets, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS accuracy FROM (SELECT 'quality' AS field, (quality = CASE WHEN n_chars % 5 = 0 THEN 0 ELSE 1 END)::INT AS hit FROM labels JOIN documents USING (doc_id) UNION ALL SELECT 'toxic', (toxic = CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END)::INT FROM labels JOIN documents USING (doc_id)) GROUP BY field")
def gold_accuracy(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("gold_quality"), F.col("toxic").alias("gold_toxic"))
    said = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 5 == 0, 0).otherwise(1).alias("quality"), F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0).alias("toxic"))
    return evaluate.gold_accuracy(gold.join(said, "doc_id"), ("quality", "toxic"))
