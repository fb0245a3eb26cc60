"""Queries do their whole job, and what they list within documents equals what is told from rows."""

import pytest
from pyspark.sql import functions as F

from lexloom import plans
from lexloom.functions.arrays import groups, let, spread
from lexloom.operators import annotate, evidence, linkage, recheck, rules, segment, spans
from lexloom.plans import annotation

TEXTS = ["Um dois. Três quatro? Cinco. Seis. Sete.", "a b c d e f. g h. i. j k l m n o p q r s t u v w x y z. " * 3, "", None, "x " * 70]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, TEXTS[i % 5]) for i in range(30)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_pendings_of_every_token_are_inherited(spark, folder):
    got = plans.QUERIES["pending_inherit"](spark, folder).select("doc_id", "ord", "rule", "field").distinct()
    every = plans.QUERIES["rule_pending"](spark, folder).select("doc_id", "ord", "rule", "field")
    assert every.count() == got.count() and every.exceptAll(got).isEmpty()


def test_scopes_of_every_document(spark, folder):
    scopes = lambda name: {(r.doc_id, r.ord) for r in plans.QUERIES[name](spark, folder).select("doc_id", "ord").collect()}
    assert scopes("versioned_scopes") == scopes("negation_scopes") and any(d % 13 == 0 for d, _ in scopes("versioned_scopes"))


@pytest.mark.parametrize("name", ["rule_occurrences", "occurrence_order", "contiguous_fragments", "rule_links_in_context", "check_versioned_scopes", "structural_pending", "rule_notes"])
def test_occurrences_need_texts_alone(spark, folder, name):
    plan = plans.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Window", "Sort", "Aggregate", "ExistingRDD")) and plan.count("Exchange") == plan.count("regexp_extract_all") == 1


def test_a_local_name_copies_nothing(spark):
    named = spark.range(3).select(let(F.sequence(F.lit(0), "id"), lambda x: F.size(x) + F.element_at(x, -1)).alias("v"))
    assert "transform(" not in named._jdf.queryExecution().optimizedPlan().toString() and [r.v for r in named.collect()] == [1, 3, 5]


def test_links_are_not_compared_with_each_other(spark, folder):
    """Rows are told apart by comparing each with all others, so only those of one occurrence are."""
    plan = plans.QUERIES["rule_links_enriched"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan and plan.count("array_distinct(") <= plans.QUERIES["rule_links"](spark, folder)._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(")


def test_groups_of_places(spark):
    row = spark.createDataFrame([([2, 2, 3, 6],), ([],)], "k array<bigint>").select(groups(F.col("k")).alias("g")).select("g", spread(F.col("g")).alias("s")).collect()
    assert [tuple(x) for x in row[0].g] == [(2, 0, 2), (3, 2, 1), (6, 3, 1)] and row[0].s == [0, 1, None, None, 2] and row[1].s == []


def same(a, b):
    b = b.select(*a.columns)
    assert a.count() > 9 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_pendings_and_versions_equal_those_of_rows(spark, folder):
    version = F.when(F.col("doc_id") % 7 == 0, "9").when(F.col("doc_id") % 2 == 0, rules.VERSIONS[0]).otherwise(rules.VERSIONS[1])
    d = annotation.quoted_documents(spark, folder, version=version)
    rows = annotate.token_rows(annotation.annotated_lists(spark, folder, quoted=True)).withColumn("version", version)
    e = rules.enriched(rows.drop("version"))
    same(linkage.structural_pendings(annotation.quoted_documents(spark, folder)), linkage.structural_pending(e, rules.regions(e)))
    same(recheck.check_present_negations(d), recheck.check_negations(rules.negation_scopes(rows.drop("version")), rows))


def test_fragments_of_lists_equal_those_of_rows(spark):
    odd = [" a b.\r\n\r\nC d\n\r\ne f. ", "x\r\r\ny z\n", "\r\n\t\r\nu v. w etc. x y\u00a0z 1.5 ", "", "é\u0085 😀 b\r\nc "]
    original = spark.createDataFrame([(i, odd[i % 5] * (i % 7)) for i in range(40)] + [(99, None)], "doc_id long, text string")
    copy = spans.prepare_crlf(original).select("doc_id", "text")
    _, members = evidence.evidence_tokens(annotation.annotated_documents(spark, None, copy))
    got = evidence.fragments_of(annotation.annotated_documents(spark, None, copy.join(original.withColumnRenamed("text", "original"), "doc_id")))
    same(got, evidence.fragments(members, original))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Window", "Aggregate"))


def test_rules_are_checked_with_multiplicity(spark, folder):
    d = annotation.annotated_documents(spark, folder)
    stored = rules.occurrence_lists(d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.slice("l", 1, 2), "l")).when(F.col("doc_id") % 3 == 1, F.slice("l", 3, 9)).otherwise(F.reverse("l")).alias("l")).where("doc_id <> 11")
    rows = stored.select("doc_id", F.explode("l").alias("x")).select("doc_id", "x.*")
    same(recheck.check_rules(stored, d), recheck.check_rules(rows, d))
    plan = plans.QUERIES["check_rules"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == plan.count("Sort [doc_id") and plan.count("Exchange") == plan.count("regexp_extract_all")


def test_listed_spans_equal_those_of_rows(spark):
    docs = spark.createDataFrame([(0, "a\r\nb \r\n\r\nc"), (1, "\r\n"), (2, "x" * 9), (3, "\r\r\n\né")], "doc_id long, text string")
    ends = [(s, e) for s in range(14) for e in range(s, s + 3)]
    spans_ = docs.select("doc_id", "text", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("span"), F.lit(s).cast("long").alias("o_start"), F.lit(e).cast("long").alias("o_end")) for k, (s, e) in enumerate(ends) if e == s + 1])).alias("x"))
    got = spans.map_listed_inverse(spans_.groupBy("doc_id", "text").agg(F.sort_array(F.collect_list("x")).alias("spans")))
    same(got, spans.map_spans_inverse(spans_.select("doc_id", "x.*"), spans.span_map(docs)))


@pytest.mark.parametrize("name", ["tile_union", "map_spans_inverse"])
def test_tiles_and_spans_need_texts_alone(spark, folder, name):
    plan = plans.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Window", "Sort", "Aggregate")) and plan.count("Exchange") == plan.count("regexp_extract_all") == 1
    assert segment.tiled(segment.unit_lists(spark.createDataFrame([(1, " a\n b "), (2, ""), (3, None)], "doc_id long, text string"))).collect() == [(1, 6, " a\n b ")]
