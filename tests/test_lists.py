"""Sentences with lists of their tokens: the same rows as from tokens, and no token is sorted, grouped or shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom import plans
from lexloom.operators import annotate, context, recheck, references, rules, segment, store
from lexloom.plans import annotation
from lexloom.plans import references as references_plan

PIECES = (*"  .!?\"'”“)(»«a3É_", " ", " ", " ", "\n", "\r\n\r\n", "\n \n", "...", "?!", "etc", "etc.", "ETC.", "Dr", "1.5", "Fim", "x@y.z", "😀")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40)))) for i in range(600)] + [(9999, None)], "doc_id long, text string")


def same(a, b):
    b = b.select(*a.columns)
    assert a.dtypes == b.dtypes
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_lists_hold_the_units(docs):
    u = segment.units(docs).cache()
    same(segment.tokens(docs), u.where("NOT space"))
    same(segment.sentences(docs), segment.sentences_of(u))
    same(segment.paragraphs(docs), segment.paragraphs_of(u))


def test_segmentation_is_checked_by_lists(spark, docs):
    u, lists = segment.units(docs).drop("term", "inner"), segment.unit_lists(docs)
    same(lists.select("doc_id", F.explode("u").alias("x")).select("doc_id", "x.*"), u)
    assert segment.check_segmentation(docs).isEmpty() and segment.check_segmentation(docs, lists).isEmpty() and segment.check_segmentation(docs, u).isEmpty()
    plan = segment.check_segmentation(docs, segment.unit_lists(docs, ordered=True))._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line and "Sort [doc_id" not in line]
    assert not sorts and "Window" not in plan and "ObjectHashAggregate" not in plan and plan.count("Exchange hashpartitioning") == 3  # both sides' texts, and what was found
    at = lambda c, value: F.when(F.col("pos") == 4, value).otherwise(F.col(c))
    for column, value, rules in (("ord", F.lit(99), {"dense"}), ("w_end", F.col("w_start"), {"tiling"}), ("text", F.lit("#"), {"rebuilt"}), ("sentence_ord", F.lit(0), set())):
        rows = u.where("doc_id = 3").withColumn(column, at(column, value).cast(dict(u.dtypes)[column]))
        one = docs.where("doc_id = 3")
        assert rules <= {r.rule for r in segment.check_segmentation(one, rows).collect()}


@pytest.mark.parametrize("name", ["check_entities", "syntax_coverage"])
def test_entities_need_no_row_for_each_token(spark, docs, tmp_path, name):
    docs.where(F.col("doc_id") < 40).write.parquet(str(tmp_path / "documents.parquet"))
    plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Sort [") == plan.count("Sort [doc_id") and plan.count("Exchange") == plan.count("Scan parquet") == plan.count("regexp_extract_all")


def test_sentence_starts_need_no_join(spark, docs):
    got = segment.sentence_starts(segment.sentence_lists(docs))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == plan.count("regexp_extract_all") == 1
    same(got, segment.sentence_starts(segment.tokens(docs), segment.sentences(docs)))


def test_entities_are_checked_by_lists(spark, docs):
    units = segment.unit_lists(docs, ordered=True)
    e = references_plan.entities(units).select("doc_id", F.transform("e", lambda x: x.withField("token_ords", F.when(x["ord"] == 1, F.array(F.lit(777).cast("long"))).otherwise(x["token_ords"])).withField("text", F.when(x["ord"] == 2, "?").otherwise(x["text"]))).alias("e"))
    rows = recheck.check_entities(e.select("doc_id", F.explode("e").alias("x")).select("doc_id", "x.*"), recheck.spaced(segment.units(docs)), ("NAME",))
    got = recheck.check_entities(e, units, ("NAME",))
    same(got, rows)
    assert {r.rule for r in got.collect()} == {"unknown_token", "text"}


def test_operators_take_lists_and_rows(spark, docs):
    lists = annotation.annotated_lists(spark, None, docs)
    rows = annotate.token_rows(lists).cache()
    for of in (annotate.clauses, annotate.coverage, annotate.missing_fields, annotate.children, annotate.check_tree, annotate.subtrees):
        same(of(lists), of(rows))


@pytest.mark.parametrize("name", ["tokenize", "tree_ownership", "check_dependency_tree", "head_children", "annotation_coverage"])
def test_no_token_is_sorted(spark, docs, tmp_path, name):
    docs.where(F.col("doc_id") < 40).write.parquet(str(tmp_path / "documents.parquet"))
    plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line and "Sort [doc_id" not in line]
    assert not sorts and "Window" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert plan.count("regexp_extract_all") == 1 and plan.count("Exchange") == 1


def test_links_and_references_need_no_row_for_each_token(spark, docs):
    lists = annotation.annotated_lists(spark, None, docs)
    rows = annotate.token_rows(lists).cache()
    links = rows.select("doc_id", F.lit("token").alias("kind"), (F.col("ord") - 3).alias("target"), "ord").unionByName(rows.select("doc_id", F.lit("token").alias("kind"), (F.col("ord") + 2).alias("target"), "ord"))
    same(references.resolve_tokens(links, lists.select("doc_id", "sentence_ord", "start", F.size("r").alias("n"))), references.resolve(links, token=rows.select("doc_id", F.col("ord").alias("id"), "sentence_ord")))
    windows = context.context_units(segment.sentences(docs))
    layer = rows.where("lemma IS NOT NULL").select("doc_id", "sentence_ord", F.col("ord").alias("id"))
    listed = lists.select("doc_id", "sentence_ord", F.transform(F.filter("r", lambda x: x["lemma"].isNotNull()), lambda x: x["ord"]).alias("morphology"))
    same(references.annotation_refs(windows, listed), references.annotation_refs(windows, morphology=layer))


def test_rules_take_lists_and_rows(spark, docs):
    lists = annotation.annotated_lists(spark, None, docs.where("doc_id % 3 = 0"))
    assert "ObjectHashAggregate" not in rules.enriched(lists)._jdf.queryExecution().executedPlan().toString()
    same(rules.occurrences(lists), rules.occurrences(annotate.token_rows(lists).cache()))


def test_rules_over_documents_group_no_tokens(spark, docs, tmp_path):
    docs.where(F.col("doc_id") < 12).write.parquet(str(tmp_path / "documents.parquet"))
    plan = plans.QUERIES["rule_states"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "head_ord" in plan and not re.search(r"collect_list\(struct\(ord, ord#\d+L?, head_ord", plan)


def test_differences_shuffle_each_side_once(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "x"), (2, None), (3, "y"), (None, None)], "i long, t string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (4, "z"), (None, None)], "i long, t string")
    got = store.differences(a, b)
    assert sorted(map(str, got.collect())) == sorted(map(str, a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b"))).collect()))
    assert store.differences(a, b)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and store.differences(a, a).isEmpty()
