"""Scopes and links within documents' lists: no token is a row that is sorted, joined, shuffled or written."""

import pytest
from pyspark.sql import functions as F

from lexloom import plans
from lexloom.operators import annotate, evidence, members, quotes, rules
from lexloom.plans import annotation

TEXTS = ["Um dois. Três quatro? Cinco. Seis. Sete.", "a b c d e f. g h. i. j k l m n o p q r s t u v w x y z. " * 3, "", None, "x " * 70]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, TEXTS[i % 5]) for i in range(25)], "doc_id long, text string")


def same(a, b):
    b = b.select(*a.columns)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_regions_of_lists(spark, docs):
    d = annotation.annotated_documents(spark, None, docs, quoted=True)
    rows = annotate.token_rows(d.select("doc_id", F.explode(F.filter("s", lambda y: F.size(y["r"]) > 0)).alias("y")).select("doc_id", "y.*"))
    got = annotate.token_rows(d.select("doc_id", F.explode(F.filter(quotes.placed(F.col("s")), lambda y: F.size(y["r"]) > 0)).alias("y")).select("doc_id", "y.*"))
    assert got.where("region IS NOT NULL").count() > 9
    same(got.select("doc_id", "ord", "region", "closed"), rules.regions(rows))


def test_dependents(spark):
    heads = spark.createDataFrame([([0, 0, 0, 1, 5, 1],), ([2, 2, 2],)], "h array<int>")
    assert [r.k for r in heads.select(annotate.dependents(F.col("h")).alias("k")).collect()] == [[[1, 2], [3, 5], [], [], [], [4]], [[], [], [0, 1]]]


def test_pairs_within_a_sentence(spark, docs):
    e = rules.enriched(annotate.token_rows(annotation.annotated_lists(spark, None, docs, quoted=True)))
    found = rules.by_sentence(annotation.annotated_documents(spark, None, docs, quoted=True), lambda o, start, e: rules.paired(e, start))
    same(found.select("doc_id", F.explode(F.flatten("y")).alias("p")).select("doc_id", "p.first", "p.second"), rules.correlatives(e))


def test_scopes_are_runs():
    owner, head, region, kind = [1, 1, 1, 4, 4], [1, 1, 1, 4, 1], [-1, -1, 7, -1, -1], [0, 0, 0, 2, 0]
    asks = [[-1, 0, 0, -1, 1, 1], [-1, 1, 0, 0, 1, 1], [-1, 0, 0, 1, 0, 1], [-1, 0, 0, -1, 0], [7, 0, 0, -1, 2, 1, 4]]
    assert members._scopes(owner, head, region, kind, asks) == [[2, -1, 0, 1], [2, -1, 1, 2], [3, 3, 0, 0, 3, 4], [0, -1], [1, -1, 2, 2]]


@pytest.mark.parametrize("name", ["correlative_scopes", "negation_scopes", "modal_scopes", "versioned_scopes", "rule_links", "rule_links_enriched", "link_enrich"])
def test_nothing_is_written_but_texts(spark, docs, tmp_path, name):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Window", "Sort", "Aggregate", "ExistingRDD")) and plan.count("Exchange") == plan.count("regexp_extract_all") == 1


def test_evidence_needs_no_row_for_each_token(spark, docs):
    for rows in evidence.evidence_tokens(annotation.annotated_documents(spark, None, docs)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Join", "Window", "Sort", "Aggregate")) and plan.count("Exchange") == 1
