"""Corpus fragments in blocks: rebuilding, checks and citation cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_fragments(docs: DataFrame, size: int = 400, step: int = 300) -> DataFrame:
    """(block_id, frag_no, start, end, pages, text, header): overlapping fragments that cover each text."""
    n = F.length("text")
    at = docs.where(n > 0).select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int")))).alias("k"))
    start = F.col("k") * step
    return at.select(
        F.col("doc_id").alias("block_id"), F.col("k").cast("long").alias("frag_no"), start.cast("long").alias("start"), F.least(start + size, n).cast("long").alias("end"),
        F.array(F.col("k") + 1, F.col("k") + 2).alias("pages"), F.substring("text", start + 1, F.lit(size)).alias("text"), F.concat("source", F.lit(" — section "), F.col("k").cast("string")).alias("header"),
    )


def rebuild_blocks(fragments: DataFrame) -> DataFrame:
    """(block_id, text, fragments): each fragment adds what lies beyond the ends before it."""
    order = Window.partitionBy("block_id").orderBy("start", "frag_no")
    covered = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tails = fragments.withColumn("covered", covered).select("block_id", "start", "frag_no", F.when(F.col("end") > F.col("covered"), F.substring("text", F.greatest(F.lit(0), F.col("covered") - F.col("start")).cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))).otherwise("").alias("tail"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "frag_no", "tail"))), lambda x: x["tail"]), "")
    return tails.groupBy("block_id").agg(text.alias("text"), F.count(F.lit(1)).alias("fragments"))


def check_blocks(fragments: DataFrame) -> DataFrame:
    """Violations (block_id, rule): ordinals without gaps from 0, no gap in the text, equal overlaps, length of the slice."""
    order = Window.partitionBy("block_id").orderBy("start", "frag_no")
    seen = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = fragments.select(
        "block_id", "frag_no", "start", "end", "text", seen.alias("seen"), (F.row_number().over(order) - 1).alias("nth"), F.lag("text").over(order).alias("before"), F.lag("start").over(order).alias("b_start"), F.lag("end").over(order).alias("b_end")
    )
    shared = (F.least("end", "b_end") - F.col("start")).cast("int")
    differ = F.substring("text", F.lit(1), shared) != F.substring("before", (F.col("start") - F.col("b_start")).cast("int") + 1, shared)
    reason = (
        F.when(F.col("frag_no") != F.col("nth"), "ordinal").when(F.col("start") > F.col("seen"), "gap").when(F.length("text") != F.col("end") - F.col("start"), "length").when((shared > 0) & differ, "overlap")
    )
    return rows.select("block_id", reason.alias("rule")).where("rule IS NOT NULL")


def block_pages(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("block_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))


def citation_cover(citations: DataFrame, fragments: DataFrame) -> DataFrame:
    """(block_id, c_start, c_end, fragments, all_meet, covered) for citations listed with their fragments.

    ``citations`` is (block_id, c_start, c_end, frag_nos). Every listed fragment has to meet the citation, and together
    they have to cover it: a running end of the clipped intervals shows gaps.
    """
    listed = citations.select("block_id", "c_start", "c_end", F.explode("frag_nos").alias("frag_no"))
    met = listed.join(fragments.select("block_id", "frag_no", "start", "end"), ["block_id", "frag_no"], "left")
    lo, hi = F.greatest("start", "c_start"), F.least("end", "c_end")
    clipped = met.select("block_id", "c_start", "c_end", lo.alias("lo"), hi.alias("hi"), F.coalesce(hi > lo, F.lit(False)).alias("meets"))
    order = Window.partitionBy("block_id", "c_start", "c_end").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    steps = clipped.withColumn("frontier", F.coalesce(F.max("hi").over(order), F.col("c_start")))
    return steps.groupBy("block_id", "c_start", "c_end").agg(
        F.count(F.lit(1)).alias("fragments"), F.every("meets").alias("all_meet"), ((F.max("hi") == F.col("c_end")) & F.every(F.coalesce(F.col("lo") <= F.col("frontier"), F.lit(False)))).alias("covered")
    )
