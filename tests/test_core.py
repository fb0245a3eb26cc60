"""The library's own operators on small texts."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import vectors as vf
from lexloom.operators import annotate, context, fragments, links, quotes, rules, segment, spans, store, vectors
from lexloom.operators import jobs as job_ops
from lexloom.sources import readers
from lexloom.streaming import jobs as live


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def sentence_texts(spark, text):
    return [r.text for r in segment.sentences(frame(spark, text)).orderBy("ord").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Um. Dois! Três?", ["Um.", "Dois!", "Três?"]),
        ("O Dr. Silva chegou. Fim.", ["O Dr. Silva chegou.", "Fim."]),
        ("Valor 3.14 e 10:30. Veja https://a.pt/x.y agora", ["Valor 3.14 e 10:30.", "Veja https://a.pt/x.y agora"]),
        ("pão, etc. e mais. Fim", ["pão, etc. e mais.", "Fim"]),
        ("pão, etc. Fim", ["pão, etc.", "Fim"]),
        ("Ele disse “sim.” Depois saiu", ["Ele disse “sim.”", "Depois saiu"]),
        ("Espere... não sei?! Sim", ["Espere... não sei?!", "Sim"]),
        ("a\r\n \r\nb c.\n\nd", ["a", "b c.", "d"]),
        ("  ", []),
        ("", []),
    ],
)
def test_sentences(spark, text, want):
    assert sentence_texts(spark, text) == want


def test_offsets_are_code_points(spark):
    text = "é😀 ok. fim"
    rows = segment.pieces(frame(spark, text)).orderBy("pos").collect()
    assert [text[r.w_start : r.w_end] for r in rows] == [r.text for r in rows]
    assert "".join(r.text for r in rows) == text
    assert segment.check_segmentation(frame(spark, text, "a. b", "")).count() == 0


def test_span_map_every_boundary(spark):
    text = "\r\na\r\n\r\nbc\rd\n\r\n"
    docs = frame(spark, text)
    pieces = spans.span_map(docs)
    assert spans.check_preparation(docs, pieces).count() == 0
    work = text.replace("\r\n", "\n")
    back, o = [], 0
    for c in work:
        back.append(o)
        o += 2 if text[o : o + 2] == "\r\n" else 1
    back.append(len(text))
    every = [(0, 100 * a + b, a, b) for a in range(len(work)) for b in range(a + 1, len(work) + 1)]
    got = spans.map_spans(spark.createDataFrame(every, "doc_id long, span long, w_start long, w_end long"), pieces).collect()
    assert {(r.w_start, r.w_end): (r.o_start, r.o_end) for r in got} == {(a, b): (back[a], back[b]) for _, _, a, b in every}
    broken = pieces.withColumn("w_start", F.when(F.col("piece") == 2, F.col("w_start") + 1).otherwise(F.col("w_start")))
    assert spans.check_preparation(docs, broken).count() > 0


def test_context_windows(spark):
    docs = frame(spark, "A um. B dois.\n\nC três. D quatro. E cinco.")
    s = segment.sentences(docs)
    rows = context.context_units(s, 1, 2).orderBy("ord").collect()
    assert [(r.win_first, r.win_last) for r in rows] == [(0, 1), (0, 1), (2, 4), (2, 4), (3, 4)]
    assert [r.previous_reason for r in rows] == ["document_start", "radius_met", "paragraph_boundary", "radius_met", "radius_met"]
    assert [r.next_reason for r in rows] == ["paragraph_boundary", "paragraph_boundary", "radius_met", "document_end", "document_end"]
    wide = context.context_units(s, 0, 9, crossing=True).orderBy("ord").collect()
    assert [(r.win_first, r.win_last, r.previous_reason) for r in wide] == [(i, 4, "radius_zero") for i in range(5)]
    with pytest.raises(ValueError):
        context.check_policy(True, 1, False)
    guarded = context.cost_guard(context.planned_cost(s), units=4).collect()
    assert [(g.units, g.limit) for g in guarded] == [(5, "units")]


def test_tree_and_rules(spark):
    # "não compra ... mas" with the verb as root
    rows = [(0, 0, 0, "Ela", "ela", "PRON", "nsubj", 2), (0, 0, 1, "não", "não", "ADV", "advmod", 2), (0, 0, 2, "compra", "comprar", "VERB", "ROOT", 2), (0, 0, 3, "nunca", "nunca", "ADV", "advmod", 2), (0, 0, 4, "hoje", "hoje", "ADV", "advmod", 2)]
    t = spark.createDataFrame(rows, "doc_id long, sentence_ord long, ord long, text string, lemma string, pos string, dep string, head_ord long")
    assert annotate.check_tree(t).count() == 0
    assert {r.owner for r in annotate.clauses(t).collect()} == {2}
    t = t.withColumn("verbform", F.when(F.col("pos") == "VERB", "Fin"))
    found = rules.occurrences(t)
    assert sorted((r.rule, r.ord) for r in found.collect()) == [("clause", 2), ("negation_nunca", 3), ("negation_não", 1), ("relative_time", 4), ("verb_inflection", 2)]
    assert [r.markers for r in rules.multiple_negation(found).collect()] == [2]
    circle = t.withColumn("head_ord", F.when(F.col("ord") == 3, 4).when(F.col("ord") == 4, 3).otherwise(F.col("head_ord")))
    assert [r.rule for r in annotate.check_tree(circle).collect()] == ["circle"]


def test_citation_cover(spark):
    frags = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 8, 20), (1, 2, 30, 40)], "block_id long, frag_no long, start long, end long")
    cited = spark.createDataFrame([(1, 5, 15, [0, 1]), (1, 5, 35, [0, 1, 2]), (1, 5, 9, [0, 2])], "block_id long, c_start long, c_end long, frag_nos array<long>")
    got = {(r.c_start, r.c_end): (r.all_meet, r.covered) for r in fragments.citation_cover(cited, frags).collect()}
    assert got == {(5, 15): (True, True), (5, 35): (True, False), (5, 9): (False, False)}


def test_reports(spark):
    got = {r.doc_id: (r.words, r.paragraphs, r.rule) for r in links.check_reports(frame(spark, "um dois\r\rtrês", "só um", " ", "a\r\n\r\nb\n \nc")).collect()}
    assert got == {0: (3, 2, None), 1: (2, 1, "paragraphs"), 2: (0, 0, "empty"), 3: (3, 3, "paragraphs")}


def test_crlf_ends_one_line(spark):
    got = [(r.doc_id, r.paragraph, r.text) for r in links.report_paragraphs(frame(spark, "one line\r\nsecond line", "a\r\n\t\r\nb\rc\n\r\n\rd")).orderBy("doc_id", "paragraph").collect()]
    assert got == [(0, "P1", "one line\r\nsecond line"), (1, "P1", "a"), (1, "P2", "b\rc"), (1, "P3", "d")]


def test_circles_are_an_error(spark):
    with pytest.raises(ValueError, match="derived from itself"):
        vectors.component_closure(spark.createDataFrame([(1, 2), (2, 1)], "artifact long, component long"))


def test_modal_and_temporal_rules(spark):
    # "Quando consegue sair, tem que esperar": an infinitive complement shows capacity, "ter que" obligation.
    words = [("Quando", "quando", "SCONJ", "mark", 1, None), ("consegue", "conseguir", "VERB", "advcl", 3, "Fin"), ("sair", "sair", "VERB", "xcomp", 1, "Inf"), ("tem", "ter", "VERB", "ROOT", 3, "Fin"), ("que", "que", "SCONJ", "mark", 5, None), ("esperar", "esperar", "VERB", "xcomp", 3, "Inf"), ("tudo", "tudo", None, "obj", 5, None)]
    rows = [(0, 0, i, *w[:4], w[4], w[5]) for i, w in enumerate(words)]
    t = spark.createDataFrame(rows, "doc_id long, sentence_ord long, ord long, text string, lemma string, pos string, dep string, head_ord long, verbform string")
    got = {(r.ord, r.rule, r.category) for r in rules.occurrences(t).collect() if r.family in ("time", "modality", "connectors") and r.category != "inflection"}
    assert got == {(0, "relative_time", "construction"), (0, "connector_quando", "time"), (1, "modal_verb", "capacity"), (3, "modal_verb", "obligation")}
    assert {(r.ord, r.rule) for r in rules.pending(t).collect()} == {(6, "clause"), (6, "verb_inflection"), (6, "modal_verb")}


def test_a_long_paragraph_is_read_in_one_go(spark):
    import time

    def took(n):
        docs = frame(spark, " ".join(f"w{i}" + ("." if i % 17 == 0 else "") for i in range(n)))
        began = time.time()
        segment.tokens(docs).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(5_000)
    short = min(took(5_000) for _ in range(2))
    assert took(20_000) < 5 * short + 1


def test_borders_map_to_points(spark):
    docs = frame(spark, "a\r\nb", "")
    pieces = spans.span_map(docs)
    lengths = spark.createDataFrame([(0, 3, 4), (1, 0, 0)], "doc_id long, w_length long, o_length long")
    points = spark.createDataFrame([(0, i, i) for i in range(5)] + [(1, 0, 0)], "doc_id long, span long, w long")
    assert sorted((r.doc_id, r.w, r.o) for r in spans.map_points(points, pieces, lengths).collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 3), (0, 3, 4), (1, 0, 0)]


def test_store_and_jobs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    root = str(tmp_path / "runs")
    assert store.commit_run(spark, rows, root, "r1") and not store.commit_run(spark, rows, root, "r1")
    assert store.differences(store.restore_run(spark, root, "r1").drop("run_id"), rows).count() == 0
    with pytest.raises(LookupError):
        store.restore_run(spark, root, "r2")
    page = store.keyset_page(spark.range(100).withColumnRenamed("id", "k"), "k", 50, 10).collect()
    assert ([r.k for r in page], {r.next_before for r in page}) == (list(range(49, 39, -1)), {40})
    log = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "running"), (1, 4, "done"), (2, 5, "done")], "job_id long, event_id long, state string")
    assert sorted(r.event_id for r in job_ops.illegal_transitions(log).collect()) == [3, 5]
    assert [(r.winner, r.claimants) for r in job_ops.claims(log.where("job_id = 1")).collect()] == [(2, 2)]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1e200, 1e200])], "id long, v array<double>")
    got = {r.id: (r.a, r.b) for r in v.select("id", vf.l2_normalize(F.col("v")).alias("a"), vf.scaled_normalize(F.col("v")).alias("b")).collect()}
    assert np.allclose(got[1][0], [0.6, 0.8]) and got[2] == (None, None) and got[3] == (None, None) and np.allclose(got[4][1], [2**-0.5] * 2)
    text = "abc def. ghi jkl. mno"
    for limit in (3, 5, 9, 30):
        chunks = vectors.plan_chunks(text, vectors.code_points, limit, [8, 17])
        assert chunks[0][0] == 0 and chunks[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(chunks, chunks[1:]))
    assert vectors.plan_chunks(text, vectors.code_points, 12, [8, 17])[0] == (0, 8)
    assert vectors.plan_chunks(" \n", vectors.code_points, 4, []) == []
    p = vectors.PROFILES
    assert (vectors.comparable(p["query"], p["passage"]), vectors.comparable(p["passage"], p["query"]), vectors.comparable(p["query"], p["symmetric"])) == ("retrieval", None, "symmetric")
    with pytest.raises(ValueError):
        vectors.component_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "artifact long, component long"), rounds=1)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfx\r\ny\r")
    (tmp_path / "b.txt").write_bytes(b"\xff")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.valid) for r in readers.read_literal(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a.txt": ("﻿x\r\ny\r", True), "b.txt": (None, False)}
    (tmp_path / "f.jsonl").write_text('{"k": 2}\n{"k": 1}\n')
    assert [tuple(r) for r in readers.read_json_lines(spark, str(tmp_path / "f.jsonl"), "k long").orderBy("row_idx").collect()] == [(0, 2), (1, 1)]
    said = spark.createDataFrame([('{"a": 1, "a": 2}',), ('{"a": NaN}',), ("{",), (json.dumps({"a": [1]}),)], "j string")
    assert [r.fault for r in readers.strict_json(said, "j").collect()] == ["repeated key", "constant", "syntax", None]
    np.save(tmp_path / "m.npy", np.eye(3, dtype=np.float32))
    assert readers.read_matrix(spark, str(tmp_path / "m.npy"), 3).count() == 3
    readers.write_new(said, str(tmp_path / "new"))
    with pytest.raises(Exception, match="(?i)exist"):
        readers.write_new(said, str(tmp_path / "new"))


def test_stream_gives_what_batch_gives(spark, tmp_path):
    docs = frame(spark, "a\r\nb", None, "c")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    live.run_to_end(live.prepared(stream), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert store.differences(spark.read.parquet(str(tmp_path / "out")).select("doc_id", "length", "sha256"), spans.prepare_crlf(docs).select("doc_id", "length", "sha256")).count() == 0


def test_quote_regions(spark):
    import random

    rng = random.Random(1)
    rows = [(d, k, rng.choice(["“", "”", "«", "»", '"', "a", "b"])) for d in range(20) for k in range(30)]
    t = spark.createDataFrame(rows, "doc_id long, ord long, text string")
    want, inside = set(), {}
    for d in range(20):
        stack, done = [], []
        for _, k, x in (r for r in rows if r[0] == d):
            if stack and quotes.PAIRS[stack[-1][1]] == x:
                done.append((stack.pop()[0], k))
            elif x in quotes.PAIRS:
                stack.append((k, x))
        done += [(k, None) for k, _ in stack]
        want |= {(d, a, b) for a, b in done}
        ends = {k for r in done for k in r}
        for k in range(30):
            inside[d, k] = None if k in ends else max((a for a, b in done if a < k and (b is None or k < b)), default=None)
    found = quotes.quote_regions(t)
    assert {(r.doc_id, r.open, r.close) for r in found.collect()} == want
    assert {(r.doc_id, r.ord): r.region for r in quotes.innermost(t).collect()} == inside


def test_blob_faults_checks_every_blob(spark, monkeypatch):
    from lexloom.operators import store as stores
    from lexloom.plans import store as queries

    checked, faults = [], stores.blob_faults
    monkeypatch.setattr(stores, "blob_faults", lambda stored: checked.append(stored.count()) or faults(stored))
    got = queries.blob_faults(spark, "/root/testdata/sf0.001").collect()
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if r.text is not None]
    assert checked == [len({r.text for r in rows})]
    assert {r.blob_id for r in got} == {"sha256:" + hashlib.sha256(r.text.encode()).hexdigest() for r in rows if r.doc_id % 5 == 0}
    assert len(got) == len({r.blob_id for r in got}) < checked[0]


def test_entry_imports_without_a_session():
    """In a fresh interpreter: no column is built before there is a session."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parent.parent)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
    assert min(map(int, said.stdout.split()[-2:])) > 100


def test_texts_are_taken_apart_once_and_sorted_once(spark):
    docs = frame(spark, "Dr. Bo, etc. Ele viu: etc. E 3.5!) «Sim»\n\n...\") Fim etc", "", " ", "\n\n")
    for got, sorts in ((segment.tokens(docs), 1), (segment.units(docs), 1)):
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("regexp_extract_all") == 1  # neither asked for before the texts are dealt nor twice
        assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == sorts
    u = segment.units(docs)
    assert segment.tokens(docs).exceptAll(u.where("NOT space").select("doc_id", "ord", "text", "w_start", "w_end", "paragraph_ord", "sentence_ord")).count() == 0
    assert segment.sentences(docs).exceptAll(segment.sentences_of(u)).count() == 0
    assert [r.text for r in segment.sentences(docs).orderBy("doc_id", "ord").collect()] == ["Dr. Bo, etc.", "Ele viu: etc.", "E 3.5!)", "«Sim»", "...\") Fim etc"]
    both = context.logical_ids(segment.sentences(docs), segment.paragraphs(docs), docs)
    assert both.exceptAll(context.logical_ids(segment.sentences(docs), None, docs)).count() == 0
