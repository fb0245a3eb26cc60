"""Evaluation: ranking measures, gold comparison, agreement of vector sources, resource totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.vectors import dot, doubles, l2_normalize, ndcg_gain, norm


def retrieval_measures(ranking: DataFrame, relevance: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """(query, k, recall, mrr, ndcg) from ranking (query, id, rank) and relevance (query, id, grade).

    Grades join by query and id, 0 where there is none. The ideal order is that of the grades.
    """
    good = relevance.where("grade > 0")
    totals = good.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"), F.max("grade").alias("best"))
    ideal = good.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id"))).where(F.col("pos") <= max(ks)).select("query", "pos", F.col("grade").alias("ideal"))
    rows = ranking.where(F.col("rank") <= max(ks)).join(good, ["query", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    each = rows.join(totals, "query").select("query", "rank", "grade", "relevant", "best")
    gain = lambda g: ndcg_gain(F.col(g).cast("double"), F.col("best").cast("double"))
    marks = each.select("query", "rank", "relevant", (F.col("grade") > 0).cast("int").alias("hit"), (gain("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.explode(F.array(*map(F.lit, ks))).alias("k")).where("rank <= k")
    got = marks.groupBy("query", "k").agg((F.sum("hit") / F.first("relevant")).alias("recall"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"), F.sum("dcg").alias("dcg"))
    best = ideal.join(totals, "query").select("query", (gain("ideal") / F.log2(F.col("pos") + 1)).alias("dcg"), "pos", F.explode(F.array(*map(F.lit, ks))).alias("k")).where("pos <= k").groupBy("query", "k").agg(F.sum("dcg").alias("idcg"))
    return got.join(best, ["query", "k"]).select("query", "k", "recall", "mrr", (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def macro_mean(measures: DataFrame) -> DataFrame:
    return measures.groupBy("k").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")], F.count(F.lit(1)).alias("queries"))


def gold_pairs(gold: DataFrame, predicted: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Gold targets and predictions of one span (doc_id, start, end), with gold_<field> and <field>; a span that only one side has gives no pair."""
    g = gold.select("doc_id", "start", "end", *[F.col(f).alias(f"gold_{f}") for f in fields])
    return g.join(predicted.select("doc_id", "start", "end", *fields), ["doc_id", "start", "end"])


def gold_accuracy(pairs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(field, targets, hits, accuracy) from pairs with gold_<field> and <field>; nulls are misses unless both are null."""
    each = pairs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).eqNullSafe(F.col(f"gold_{f}")).alias("hit")) for f in fields])).alias("x"))
    return each.groupBy("x.field").agg(F.count(F.lit(1)).alias("targets"), F.count_if("x.hit").alias("hits"), F.round(F.avg(F.col("x.hit").cast("int")), 6).alias("accuracy"))


def backend_agreement(pairs: DataFrame, threshold: float = 0.99) -> DataFrame:
    """One row comparing vectors a and b of ``pairs``: cosines, errors before and after normalising, and whether all cosines exceed the threshold."""
    a, b = doubles(F.col("a")), doubles(F.col("b"))
    gap = lambda x, y: F.array_max(F.zip_with(x, y, lambda p, q: F.abs(p - q)))
    square = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    rows = pairs.select((dot(a, b) / (norm(a) * norm(b))).alias("cosine"), gap(a, b).alias("raw_max"), square(a, b).alias("raw_square"), gap(l2_normalize(a), l2_normalize(b)).alias("unit_max"), F.size(a).alias("n"))
    return rows.agg(
        F.count(F.lit(1)).alias("vectors"), F.round(F.min("cosine"), 9).alias("min_cosine"), F.round(F.avg("cosine"), 9).alias("mean_cosine"), F.round(F.max("raw_max"), 9).alias("raw_max"),
        F.round(F.sqrt(F.sum("raw_square") / F.sum("n")), 9).alias("raw_rms"), F.round(F.max("unit_max"), 9).alias("unit_max"), F.every(F.col("cosine") > threshold).alias("agree"),
    )


def vector_bytes(artifacts: DataFrame) -> DataFrame:
    """(format, artifacts, bytes, dimensions) over distinct artifacts (artifact_id, format, dim)."""
    width = F.when(F.col("format") == "float16", 2).when(F.col("format") == "float32", 4).otherwise(8)
    return artifacts.dropDuplicates(["artifact_id"]).groupBy("format").agg(F.count(F.lit(1)).alias("artifacts"), F.sum(width * F.col("dim")).cast("long").alias("bytes"), F.count_distinct("dim").alias("dimensions"))
