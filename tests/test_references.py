"""Reported speech, context references and the validators, on small hand-made records."""

import base64
import hashlib
import struct

from pyspark.sql import functions as F

from lexloom.functions.vectors import base64_float32
from lexloom.operators import evaluate, jobs, links, recheck, references, store, vectors

TOKEN = "doc_id long, sentence_ord long, ord long, text string, lemma string, pos string, dep string, head_ord long"


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_reported_speech(spark):
    # "Ela disse que veio porque chove": chove hangs from veio, veio is said.
    said = [(1, 0, 0, "Ela", "ela", "PRON", "nsubj", 1), (1, 0, 1, "disse", "dizer", "VERB", "ROOT", 1), (1, 0, 2, "que", "que", "SCONJ", "mark", 3), (1, 0, 3, "veio", "vir", "VERB", "ccomp", 1), (1, 0, 4, "porque", "porque", "SCONJ", "mark", 5), (1, 0, 5, "chove", "chover", "VERB", "advcl", 3)]
    # The same under a verb that is none of speech, and under one without a lemma.
    bare = [(3, *t[1:4], None if t[4] == "dizer" else t[4], *t[5:]) for t in said]
    other = [(2, t[1], t[2], t[3], "ver" if t[4] == "dizer" else t[4], *t[5:]) for t in said]
    got = references.reported_speech(spark.createDataFrame(said + other + bare, TOKEN))
    assert rows(got, "doc_id", "nucleus", "content", "speech") == [(1, 3, 3, 1), (1, 5, 3, 1)]
    assert references.reported_speech(spark.createDataFrame([], TOKEN)).count() == 0


def test_window_links_and_refs(spark):
    windows = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 2), (1, 2, 1, 2)], "doc_id long, ord long, win_first long, win_last long")
    links = spark.createDataFrame([(1, 1, 5, "token", 2), (1, 1, 6, "sentence", 2), (1, 2, 9, "token", 99)], "doc_id long, sentence_ord long, ord long, kind string, target long")
    tokens = spark.createDataFrame([(1, 2, 0), (1, 5, 1)], "doc_id long, id long, sentence_ord long")
    sentences = spark.createDataFrame([(1, i, i) for i in range(3)], "doc_id long, id long, sentence_ord long")
    got = references.window_links(windows, references.resolve(links, token=tokens, sentence=sentences))
    assert rows(got, "unit", "ord", "location") == [(0, 5, "in_window"), (0, 6, "outside"), (1, 5, "in_window"), (1, 6, "in_window"), (1, 9, "outside"), (2, 5, "outside"), (2, 6, "in_window"), (2, 9, "outside")]
    refs = references.annotation_refs(windows, words=tokens, none=tokens.where("false"))
    assert rows(refs.where("unit = 0"), "role", "sentence_ord", "words", "none") == [("focus", 0, [2], []), ("neighbour", 1, [5], [])]
    pending = spark.createDataFrame([(1, 0, 3, "r", "pos")], "doc_id long, sentence_ord long, ord long, rule string, field string")
    assert rows(references.inherited_pending(windows, pending), "unit", "role") == [(0, "focus"), (1, "neighbour")]


def test_check_entities(spark):
    tokens = spark.createDataFrame([(1, 0, "Ana", " ", 0, 3, 0), (1, 1, "Sá", " ", 4, 6, 0), (1, 2, "foi", "", 7, 10, 0), (1, 3, "Rui", "", 11, 14, 1)], "doc_id long, ord long, text string, gap string, w_start long, w_end long, sentence_ord long")

    def check(*entities):
        frame = spark.createDataFrame([(1, *e) for e in entities], "doc_id long, ord long, label string, w_start long, w_end long, text string, token_ords array<long>, sentence_ord long")
        return rows(recheck.check_entities(frame, tokens, ("P",)), "ord", "rule")

    good, last = (0, "P", 0, 6, "Ana Sá", [0, 1], 0), (1, "P", 11, 14, "Rui", [3], 1)
    assert check(good, last) == []
    assert check(good, (2, *last[1:])) == [(2, "ordinal")]
    assert check(good, (1, "P", 4, 6, "Sá", [1], 0)) == [(1, "overlap")]
    assert check((0, "Q", *good[2:])) == [(0, "label")]
    assert check((*good[:5], [1, 0], 0)) == [(0, "tokens")] and check((*good[:5], [], 0)) == [(0, "tokens")]
    assert check((0, "P", 0, 6, "Ana Sá", [8, 9], 0)) == [(0, "unknown_token")]
    assert check((0, "P", 0, 5, *good[4:])) == [(0, "span")]
    assert check((*good[:6], 1)) == [(0, "sentence")] and check((0, "P", 7, 14, "foi Rui", [2, 3], 0)) == [(0, "sentence")]
    assert check((*good[:4], "Ana  Sá", [0, 1], 0)) == [(0, "text")]
    assert check((0, None, *good[2:])) == [(0, "label")]


def test_check_annotation(spark):
    tokens = spark.createDataFrame([(1, i, "a", 0) for i in range(4)], "doc_id long, ord long, text string, sentence_ord long")
    schema = "doc_id long, ord long, text string, sentence_ord long, lemma string, pos string, morph map<string,string>, unresolved array<string>"
    stored = [(1, 0, "a", 0, "a", "X", {"k": "v"}, []), (1, 0, "a", 0, "a", "X", {}, []), (1, 1, "a", 0, None, None, None, ["lemma", "pos", "morph"]), (1, 2, "a", 0, None, "X", {}, []), (1, 7, "a", 0, "a", "X", {}, [])]
    assert rows(recheck.check_annotation(spark.createDataFrame(stored, schema), tokens), "ord", "rule") == [(0, "repeated"), (2, "unresolved"), (3, "missing"), (7, "unknown")]


def test_token_input_and_metadata(spark):
    h = hashlib.sha256(b"ab").hexdigest()
    fields = "id long, text string, input_ids array<int>, attention array<int>, special array<int>, starts array<int>, ends array<int>, sha256 string"
    good = ("ab", [0, 5, 6, 0], [1] * 4, [1, 0, 0, 1], [0, 0, 1, 0], [0, 1, 2, 0], h)
    cases = [(0, *good), (1, "ab", [-1, 5, 6, 0], *good[2:]), (2, "ab", good[1], [1, 1, 1], *good[3:]), (3, "ab", good[1], [1, 1, 1, 0], *good[3:]), (4, *good[:5], [0, 1, 3, 0], h), (5, *good[:6], "?"), (6, "ab", [], [], [], [], [], h), (7, None, *good[1:])]
    got = rows(recheck.check_token_input(spark.createDataFrame(cases, fields), ["id"]), "id", "rule")
    assert got == [(1, "ids"), (2, "mask"), (3, "padding"), (4, "offsets"), (5, "hash"), (6, "ids"), (7, "offsets")]
    prepared = spark.createDataFrame([(1, 1, 2, h)], "doc_id long, version long, length long, sha256 string")
    said = "doc_id long, said_id long, said_version long, said_length long, said_sha256 string"
    assert recheck.check_metadata(spark.createDataFrame([(1, None, None, None, None), (1, 1, 1, 2, h.upper())], said), prepared).count() == 0
    assert rows(recheck.check_metadata(spark.createDataFrame([(1, None, None, 3, None), (2, None, None, None, None)], said), prepared), "doc_id", "rule") == [(1, "length"), (2, "unknown")]


def test_base64_vectors(spark):
    frame = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [])], "id long, v array<double>")
    got = {r.id: r for r in base64_float32(frame, "v").collect()}
    data = struct.pack("<2f", 0.6, 0.8)
    assert (got[1].base64, got[1].sha256_bytes, got[1].bytes, got[1].dim) == (base64.b64encode(data).decode(), hashlib.sha256(data).hexdigest(), 8, 2)
    assert [got[k].base64 for k in (2, 3, 4, 5)] == [None] * 4


def test_reports_credentials_and_gold(spark):
    log = spark.createDataFrame([(1, 1, "register", "a"), (1, 2, "start", "b"), (1, 3, "start", "a"), (1, 4, "start", "a"), (1, 5, "interrupt", "a"), (1, 6, "finish", "a"), (2, 1, "start", "a"), (2, 2, "register", "a"), (3, 1, "register", None), (3, 2, "start", None)], "report_id long, event_id long, kind string, sha256 string")
    assert rows(jobs.report_states(log), "report_id", "state", "shown") == [(1, "interrupted", "error"), (2, "registered", "registered"), (3, "registered", "registered")]
    assert rows(jobs.rejected_report_events(log), "report_id", "event_id", "reason") == [(1, 2, "text"), (1, 4, "searched"), (1, 6, "not_running"), (2, 1, "unknown"), (3, 2, "text")]
    open_jobs = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (2, 1, "done")], "job_id long, event_id long, state string")
    assert rows(jobs.recovered(open_jobs), "job_id", "event_id", "state") == [(1, 3, "interrupted")]
    secret = spark.createDataFrame([('{"a": [{"API_KEY": 1, "b": "é"}], "Authorization": {}}',), ("no json",), (None,)], "j string")
    assert [r.j for r in secret.select(store.without_credentials(F.col("j")).alias("j")).collect()] == ['{"a":[{"b":"é"}]}', None, None]
    gold = spark.createDataFrame([(1, 0, 2, "x"), (1, 3, 5, "y")], "doc_id long, start long, end long, lemma string")
    predicted = spark.createDataFrame([(1, 0, 2, "x"), (1, 3, 4, "y")], "doc_id long, start long, end long, lemma string")
    assert rows(evaluate.gold_pairs(gold, predicted, ("lemma",)), "start", "gold_lemma", "lemma") == [(0, "x", "x")]


def test_manifests(spark):
    good = '{"model":"m","revision":"%s","dimension":4,"max_tokens":9,"fragments":1,"blocks":1,"margin":0,"normalization":"L2","vector_type":"float32","passage_prefix":"passage: ","query_prefix":"query: ","fragments_file":"f","vectors_file":"v"}' % ("a" * 40)
    cases = [good, good.replace('"v"', '"a/v"'), good.replace('"margin":0', '"margin":9'), good.replace('"blocks":1,', ""), "[]", None, good.replace('"model":"m",', "")]
    frame = spark.createDataFrame(list(enumerate(cases)), "k long, j string")
    assert rows(recheck.check_manifests(frame, "k", "j"), "k", "rule") == [(1, "file"), (2, "margin"), (3, "blocks"), (4, "model"), (5, "model"), (6, "model")]


def test_chunks_cover_the_text():
    text = "Um. Dois tres quatro. Cinco seis sete oito."
    stops = [3, 21, 43]
    chunks = vectors.plan_chunks(text, vectors.code_points, 20, stops)
    assert "".join(text[a:b] for a, b in chunks) == text and chunks[0] == (0, 3) and all(b - a <= 20 for a, b in chunks)
    long = "palavra " * 40_000
    assert "".join(long[a:b] for a, b in vectors.plan_chunks(long, vectors.code_points, 100, list(range(8, len(long), 8)))) == long


def test_pieces_of_many_paragraphs_share_a_frame():
    import pandas as pd

    origins = pd.DataFrame([(1, f"P{i}", 10 * i, "ab cd ef") for i in range(3000)] + [(1, "report", 0, "x" * 30000)], columns=["doc_id", "origin", "shift", "text"])
    frames = list(links._chunked(iter([origins]), vectors.code_points, 5, 2))
    assert len(frames) == 2 and sum(map(len, frames)) == 3000 * 2 + 6000
    assert list(frames[0].iloc[3]) == [1, "P1.2", "P1", 15, 18, " ef", 5]


def test_query_set(spark):
    texts = ["Um dois.\r\n\r\n  tres\rquatro\r\rcinco 😀 " + "a" * 40, " \n ", "", None, "um\r\ndois\n \t\nfim\n"]
    got = links.query_set(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 29, tokenize=vectors.code_points).collect()
    assert all(texts[r.doc_id][r.start : r.end] == r.text and r.tokens <= 29 for r in got)
    whole = {r.doc_id: "" for r in got}
    for r in sorted((r for r in got if r.origin == "report"), key=lambda r: r.start):
        whole[r.doc_id] += r.text
    assert whole == {0: texts[0], 4: texts[4]}
    assert [(r.query, r.text) for r in got if r.doc_id == 4] == [("P1", "um\r\ndois"), ("P2", "fim"), ("report", texts[4])]
    assert {r.query for r in got if r.doc_id == 0 and r.origin != "report"} == {"P1", "P2", "P3.1", "P3.2", "P3.3"}
