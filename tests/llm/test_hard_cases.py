"""Cases that once went wrong: ids with several texts, colliding words, large groups, parallel vectors, repeated labels, long lines, many sources."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import ann, common, ngram_join, substring_dedup

WORDS = [a + b + c for a in "bdfgklmn" for b in "aeiou" for c in ("rt", "st", "l", "")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_several_texts_under_one_id(spark):
    rng = random.Random(1)
    long, short, other = prose(rng, 80), prose(rng, 6), prose(rng, 70)
    near = " ".join([*long.split()[:-1], "changed"])
    rows = [(5, long), (5, short), (7, near), (8, short), (9, other), (3, other), (3, near), (4, None), (4, ""), (11, "alone words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.link_documents(docs, 4, 85).collect()), key=repr)
    assert got == sorted(ngram_join.brute_force(rows, 4, 85), key=repr)
    assert {c for i, _, c in got if i in (3, 5, 7, 8, 9)} == {3}


def test_large_groups_are_cut(spark, monkeypatch):
    """Blocks of a few members, for n-grams that the table of frequent ones does not hold."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rng = random.Random(2)
    base, far = prose(rng, 60).split(), prose(rng, 60).split()
    rows = []
    for i in range(60):
        words = list(base if i % 3 else far[:30] + base[30:])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((4, 85), (2, 60)):
        assert sorted(map(tuple, ngram_join.link_documents(docs, n, percent).collect())) == sorted(ngram_join.brute_force(rows, n, percent))
    links, _ = ngram_join.link_pairs(docs, 2, 60)
    sets = [{tuple(t.split()[p : p + 2]) for p in range(59)} for _, t in rows]
    first: dict = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    nodes = sorted(first.values())
    assert sorted(map(tuple, links.collect())) == [(a, b) for a in nodes for b in nodes if a < b and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]


def test_one_label_leads_to_no_pairs(spark):
    """After the heads round a group of near copies is one component, and none of its members is copied to a cell."""
    rng = random.Random(3)
    base = prose(rng, 60).split()
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(300)]
    join = ngram_join._Join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, "doc_id", "text")
    labels = join.nodes.select(F.col("node").alias("id"), F.lit(0).cast("long").alias("label"))
    assert join.candidates(labels, heads=False).count() == 0
    pairs = join.candidates(None, heads=True).count()
    assert 299 <= pairs <= 299 * 20


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_of_one_form_differ(spark):
    word, other = thue_morse(4096), thue_morse(4096, "b", "a")
    mixed = [word, other, thue_morse(2048), thue_morse(64), thue_morse(64, "b", "a"), "", "a", "ab", "abcdefgh", "abcdefghi", "x" * 300, "x" * 301, "x" * 257 + "y"]
    data = np.frombuffer(" ".join(mixed).encode(), np.uint8)
    hashes = common.word_hashes(data)
    assert len(hashes) == 12 and len(set(hashes.tolist())) == 12
    assert common.word_hashes(np.frombuffer(b"\tABCdefghiJ  Z " + b"Q" * 500, np.uint8), lower=True).tolist() == common.word_hashes(np.frombuffer(b"abcdefghij z " + b"q" * 500, np.uint8)).tolist()
    rng = random.Random(4)
    words = prose(rng, 60).split()
    rows = [(1, " ".join([*words[:30], word, *words[30:]])), (2, " ".join([*words[:30], other, *words[30:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.dedup_substrings(docs, 50).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 0}
    assert {c for *_, c in map(tuple, ngram_join.link_documents(docs, 4, 99).collect())} == {1, 2}


def test_parallel_vectors_need_little_memory():
    """All vectors tie with the k-th nearest: exact scores are made for a bounded number of them at a time."""
    import tracemalloc

    rng = np.random.default_rng(0)
    base, scale = rng.normal(size=64), rng.integers(1, 9, 4000).astype(float)
    v, ids = scale[:, None] * base, rng.permutation(4000).astype(np.int64)
    tracemalloc.start()
    q_id, v_id, score = ann.best_of_block(v[:500], ids[:500], v, ids, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(q_id) == 2500
    for q in (0, 1, 499):
        got = v_id[q_id == ids[q]].tolist()
        exact = (v[q] * v).sum(axis=1) / (np.sqrt((v[q] * v[q]).sum()) * np.sqrt((v * v).sum(axis=1)))
        want = [int(ids[j]) for j in np.lexsort((ids, -exact)) if ids[j] != ids[q]][:5]
        assert got == want


def test_repeated_labelled_ids_are_one_row(spark):
    from lexloom.llm import quality

    rng = random.Random(5)
    rows = [(i % 20, prose(rng, 30) if i % 2 else "!!! ### $$$ " * 20) for i in range(20)] + [(1, prose(rng, 30)) for _ in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert quality.fit_rows_of(docs, labels, 100).count() == 20


def test_long_lines(spark):
    """Lines of 100,000 characters, one edit apart, in a few seconds; and the contexts of lines of all lengths."""
    import time

    from lexloom.llm import line_dedup

    rng = random.Random(6)
    long = "".join(rng.choice("abcdé 🎉") for _ in range(100_000))
    rows = [(1, long), (2, long[:50_000] + "X" + long[50_001:]), (3, long[:-1]), (4, "Y" + long), (5, long[:10] + "QQ" + long[12:]), (6, long[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    line_dedup.dedup_lines(docs.where("doc_id = 6")).collect()
    began = time.time()
    found = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}
    assert time.time() - began < 60
    pairs = [(long[:n], v) for n in (512, 513, 544, 545, 1000) for k in (0, 31, 32, 63, n - 33, n - 1) for v in (long[:k] + "X" + long[k + 1 : n], long[:k] + "X" + long[k:n], long[:k] + long[k + 1 : n], long[:k] + "XY" + long[k + 2 : n], long[:k] + "X" + long[k + 1 : n - 5] + "Y" + long[n - 4 : n])]
    pairs += [(b, a) for a, b in pairs] + [("a" * 600, "a" * 601), ("a" * 600, "a" * 602), ("ab" * 300, "ba" * 300)]
    near = spark.createDataFrame(pairs, "a string, b string").select(line_dedup._within_one_edit(F.col("a"), F.col("b")).alias("near"), F.levenshtein("a", "b").alias("d")).collect()
    assert all(r.near == (r.d <= 1) for r in near) and {r.near for r in near} == {True, False}
    short = []
    for n in [*range(17, 70), 95, 96, 97, 127, 128, 129]:
        line = "".join(rng.choice("abcdefgh") for _ in range(n))
        k = rng.randrange(n)
        short += [line, rng.choice([line[:k] + "Z" + line[k + 1 :], line[:k] + "Z" + line[k:], line[:k] + line[k + 1 :]])]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(short)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(table).collect()} == {i: i % 2 for i in range(len(short))}


def test_many_lines_of_one_text(spark):
    from lexloom.llm import line_dedup

    text = "\n".join(["the same line again"] * 20_000 + [f"line {random.Random(i).random()}" for i in range(20_000)])
    found = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (found.n_lines, found.n_removed) == (40_000, 19_999)
