"""Hybrid search: BM25 over an inverted index, exact cosine in blocks, rank fusion over blocks of fragments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import fold_terms
from lexloom.functions.vectors import bm25_idf

K1, B = 1.2, 0.75
RRF, TOP_FRAGMENTS, TOP_BLOCKS = 60, 50, 12
#: Rows of a block of the exact product.
BLOCK = 4096


def postings(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, term, tf): one shuffle, with partial counts before it."""
    return texts.select(F.col(id_col).alias("id"), F.explode(fold_terms(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(texts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, length) in terms, for every text, without a shuffle."""
    return texts.select(F.col(id_col).alias("id"), F.coalesce(F.size(fold_terms(F.col("text"))), F.lit(0)).cast("long").alias("length"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(sizes: DataFrame) -> DataFrame:
    """One row: documents and their mean length (1 for an empty corpus)."""
    return sizes.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean_length"))


def bm25_scores(texts: DataFrame, queries: DataFrame, id_col: str = "doc_id", query_col: str = "query_id") -> DataFrame:
    """(query, id, score) for every text that shares a term with a query.

    Only postings of query terms are kept: they meet by an equi-join on the term, and the statistics of the corpus are one
    row, brought in as literals.
    """
    asked = queries.select(F.col(query_col).alias("query"), F.explode(F.array_distinct(fold_terms(F.col("text")))).alias("term"))
    index = postings(texts, id_col)
    sizes = lengths(texts, id_col)
    stats = corpus_stats(sizes).first()
    wanted = index.join(asked.select("term").distinct(), "term", "left_semi")
    df = document_frequency(wanted)
    rows = wanted.join(df, "term").join(asked, "term").join(sizes, "id")
    tf, weight = F.col("tf"), bm25_idf(F.lit(stats.documents), F.col("df"))
    part = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(float(stats.mean_length) or 1.0)))
    return rows.groupBy("query", "id").agg(F.sum(part).alias("score"))


def dense_scores(corpus: DataFrame, queries: DataFrame, top: int = TOP_FRAGMENTS, block: int = BLOCK) -> DataFrame:
    """(query, id, score): for each query (query, v) the ``top`` rows of ``corpus`` (id, v) by dot product; ties to smaller ids.

    Both sides are cut into blocks that meet by a join on the pair of blocks: a stated query set against all rows, one
    matrix product for each pair. Scores are rounded to 6 places before ranking, so that ties are ties.
    """
    vector_blocks = max(1, -(-corpus.count() // block))
    query_blocks = max(1, -(-queries.count() // block))
    left = queries.select("query", F.col("v").alias("v"), F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))).alias("vb"))
    right = corpus.select("id", F.col("v").alias("v"), F.pmod(F.xxhash64("id"), F.lit(vector_blocks)).cast("int").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query": [], "id": [], "score": []}).astype({"query": "int64", "id": "int64", "score": "float64"})
        c = c.sort_values("id")
        x, y = np.array(q.v.tolist(), np.float64), np.array(c.v.tolist(), np.float64)
        scores = np.round(x @ y.T, 6)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :top]
        return pd.DataFrame({"query": np.repeat(q["query"].to_numpy(), order.shape[1]), "id": c.id.to_numpy()[order.ravel()], "score": np.take_along_axis(scores, order, 1).ravel()})

    met = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(meet, "query long, id long, score double")
    return ranked(met).where(F.col("rank") <= top)


def ranked(scores: DataFrame) -> DataFrame:
    """Adds rank from 1: best score first, then the smaller id."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")).cast("long"))


def block_ranks(fragments: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query, method, block, block_rank): blocks in the order of their first fragment."""
    first = fragments.join(blocks, "id").groupBy("query", "method", "block").agg(F.min("rank").alias("first"), F.max("score").alias("best"))
    return first.withColumn("block_rank", F.row_number().over(Window.partitionBy("query", "method").orderBy("first")).cast("long"))


def hybrid(bm25: DataFrame, dense: DataFrame, blocks: DataFrame, top: int = TOP_FRAGMENTS, most: int = TOP_BLOCKS) -> DataFrame:
    """(query, block, rrf, position): reciprocal rank fusion over the blocks of both rankings.

    BM25 keeps positive scores only. One contribution for each query, method and block; ties to the smaller block.
    """
    sparse = ranked(bm25.where("score > 0").withColumn("score", F.round("score", 6))).where(F.col("rank") <= top).withColumn("method", F.lit("bm25"))
    near = dense.where(F.col("rank") <= top).select("query", "id", "score", "rank", F.lit("dense").alias("method"))
    ranks = block_ranks(sparse.select("query", "id", "score", "rank", "method").unionByName(near), blocks)
    fused = ranks.groupBy("query", "block").agg(F.round(F.sum(1 / (F.lit(RRF) + F.col("block_rank"))), 9).alias("rrf"), F.count(F.lit(1)).alias("methods"))
    order = Window.partitionBy("query").orderBy(F.desc("rrf"), "block")
    return fused.withColumn("position", F.row_number().over(order).cast("long")).where(F.col("position") <= most)
