"""Spelling variant grouping by pivotal grams.

All bigrams have one order, rare ones first. A word's prefix holds its three first bigrams (and others equal to the third), and
its two pivots are the disjoint ones among them with the least total frequency, chosen by dynamic programming.
One edit can destroy only one of two disjoint bigrams. So of two words within one edit, the one whose prefix ends
earlier in the order has a pivot that stands, at a fitting place, in the other's prefix: the first one at the same place from the start,
with all before it equal, or else the second one at the same place from the end, with all after it equal.

Pivots and prefixes are joined on that: the gram, its place and what is equal beside it. Where that is a short part, the
longer rest is halved: one edit leaves either half equal. What meets is verified by edit distance, and each pair comes out
once, as a pair is taken from its first fitting key only.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import discard, most_frequent, stage

#: Characters of a word.
LETTERS = "A-Za-zÀ-ÿ"
#: Code points of a word and its occurrences, at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One in so many occurrences by hash loses a letter.
NOISE = 31
#: A form is so many times as frequent, at least.
TIMES = 10
#: Bigrams whose frequency orders them; others, each rarer than these, are ordered by their characters.
GRAMS = 1 << 16
#: Where fewer characters are equal beside a gram, itself included, the rest is halved.
WHOLE = 6
#: Different words that a task holds before it passes their counts on; characters of a text read at once.
HELD, PIECE = 300_000, 1 << 21

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _runs(text: str, find: re.Pattern):
    """All matches of a text, by pieces that end between runs."""
    if len(text) <= PIECE:
        yield from find.findall(text)
        return
    any_run, at = re.compile(f"[{LETTERS}]+"), 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text) and (m := any_run.match(text, end)):
            end = m.end()
        yield from find.findall(text[at:end])
        at = end


def noised(doc: str, run: str, noise: int = NOISE) -> str:
    """A lower-cased run of a document as it counts: by the crc32 of ``doc:run`` some lose one letter."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if noise and h % noise == 0:
        run = run[: h % len(run)] + run[h % len(run) + 1 :]
    return run


def _counts(least: int, noise: int):
    """(id, text) to (word, n): counts of a task's words, which Spark sums."""

    def run(batches):
        from collections import Counter

        find = re.compile(f"[{LETTERS}]{{{least},}}")
        total: dict[str, int] = {}

        def passed():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                own = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(_runs(text.encode().translate(_LOWER).decode(), find)).items():
                    if noise:
                        h = zlib.crc32(word.encode(), own)
                        if h % noise == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1 :]
                            if len(word) < least:
                                continue
                    total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield passed()
                    total = {}
        yield passed()

    return run


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, often: int = LEAST_COUNT, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``least`` code points with at least ``often`` occurrences."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counts(least, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _grams(batches):
    """(word) to (gram, words): how many words of a task hold each bigram."""
    found: dict[str, int] = {}
    for batch in batches:
        for word in batch.column(0).to_pylist():
            for gram in {word[i : i + 2] for i in range(len(word) - 1)}:
                found[gram] = found.get(gram, 0) + 1
        if len(found) > HELD:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])
            found = {}
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])


def gram_ranks(words: DataFrame, most: int = GRAMS) -> dict[str, tuple[int, int]]:
    """gram -> (rank, words that hold it), at most ``most`` of them; the rank rises with the number of words."""
    counted = stage(words.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    rows = sorted((r.n, r.gram) for r in most_frequent(counted, "n", most).collect())
    discard(counted)
    return {gram: (rank, n) for rank, (n, gram) in enumerate(rows)}


def two_disjoint(places: list[tuple[int, int]]) -> tuple[int, int]:
    """Of (place, weight) in the order of place, the two places at least two apart with the least total weight."""
    best, least, ready = None, None, 0
    for place, weight in places:
        while places[ready][0] + 2 <= place:  # the lightest of all that end before this one
            if least is None or places[ready][1] < least[1]:
                least = places[ready]
            ready += 1
        if least is not None and (best is None or least[1] + weight < best[0]):
            best = (least[1] + weight, least[0], place)
    return best[1], best[2]


def prefix_and_pivots(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[int], tuple[int, int], int]:
    """The places of a word's prefix, its two pivots, and the rank at which the prefix ends; for words of at least 4 characters."""
    order = []
    for i in range(len(word) - 1):
        known = ranks.get(word[i : i + 2])
        order.append((*(known or ((ord(word[i]) << 21 | ord(word[i + 1])) - (1 << 42), 0)), i))
    order.sort()
    last = order[2][0]
    prefix = sorted((i, n) for rank, n, i in order if rank <= last)
    return [i for i, _ in prefix], two_disjoint(prefix), last


def _keys(word: str, place: int, right: bool, whole: int):
    """(key, shared, rest, kind) under which a gram at ``place`` meets.

    Equal is what ends with the gram or, with ``right``, what begins with it: ``shared`` characters. The rest lies
    beyond; ``rest`` is the length of the shorter one of two words' rests, -1 where it does not count. kind 0: all; 1: the rest's half next to
    the shared part is equal; 2: the other half.
    """
    shared, rest = (word[place:], word[:place]) if right else (word[: place + 2], word[place + 2 :])
    tag = f"{'R' if right else 'L'}{len(shared)}:{shared}:"
    key = xxhash.xxh3_64_intdigest
    if len(shared) >= whole:
        yield key(tag), len(shared), -1, 0
        return
    for c in range(max(0, len(rest) - 1), len(rest) + 1):
        near, far = c // 2, c - c // 2
        parts = (rest[len(rest) - near :], rest[:far]) if right else (rest[:near], rest[len(rest) - far :])
        for kind, part in enumerate(parts, 1):
            yield key(f"{tag}{c}:{kind}:{part}"), len(shared), c, kind


def _index(ranks, pivots: bool, whole: int):
    """(word, n) to its keys: (key, word, n, last) of a prefix; of the pivots with right, shared, rest, kind and first, where the left pivot ends."""
    kinds = [("key", pa.uint64()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int64())] + [("right", pa.bool_()), ("shared", pa.int32()), ("rest", pa.int32()), ("kind", pa.int32()), ("first", pa.int32())] * pivots

    def run(batches):
        known = ranks.value

        def made(rows):
            arrays = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
            arrays[0] = arrays[0].view(pa.int64())
            return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in kinds])

        rows = []
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                prefix, (left, right), last = prefix_and_pivots(word, known)
                if pivots:
                    for place, side in ((left, False), (right, True)):
                        rows += [(key, word, n, last, side, shared, rest, kind, left + 2) for key, shared, rest, kind in _keys(word, place, side, whole)]
                else:
                    rows += [(key, word, n, last) for place in prefix for side in (False, True) for key, *_ in _keys(word, place, side, whole)]
                if len(rows) > 20_000:
                    yield made(rows)
                    rows = []
        yield made(rows)

    return run


# p: pivots, q: prefixes. Of two words, that with the prefix that ends first asks; the first key that fits counts.
_MEET = """
p.key = q.key AND (p.last < q.last OR (p.last = q.last AND p.word < q.word)) AND abs(length(p.word) - length(q.word)) <= 1
AND (p.kind = 0 OR p.rest = least(length(p.word), length(q.word)) - p.shared)
AND CASE WHEN p.right
  THEN right(p.word, p.shared) = right(q.word, p.shared) AND left(p.word, p.first) <> left(q.word, p.first)
    AND CASE p.kind WHEN 1 THEN right(p.word, p.shared + p.rest div 2) = right(q.word, p.shared + p.rest div 2)
      WHEN 2 THEN right(p.word, p.shared + p.rest div 2) <> right(q.word, p.shared + p.rest div 2) ELSE true END
  ELSE left(p.word, p.shared) = left(q.word, p.shared)
    AND CASE p.kind WHEN 1 THEN left(p.word, p.shared + p.rest div 2) = left(q.word, p.shared + p.rest div 2)
      WHEN 2 THEN left(p.word, p.shared + p.rest div 2) <> left(q.word, p.shared + p.rest div 2) ELSE true END
  END
AND levenshtein(p.word, q.word, 1) = 1
"""


def near_words(words: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n) at an edit distance of exactly one, once. Words have at least 4 code points."""
    ranks = words.sparkSession.sparkContext.broadcast(gram_ranks(words))  # at most GRAMS entries
    shape = "key long, word string, n long, last long"
    p = words.mapInArrow(_index(ranks, True, whole), f"{shape}, right boolean, shared int, rest int, kind int, first int").alias("p")
    q = words.mapInArrow(_index(ranks, False, whole), shape).alias("q")
    return p.join(q, F.expr(_MEET)).select(F.col("p.word").alias("a"), F.col("p.n").alias("a_n"), F.col("q.word").alias("b"), F.col("q.n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of ``forms`` (word, form) by pointer doubling: each round halves the way, which n bounds as it grows tenfold at each form."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("ahead"))
        moved = stage(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        done = moved.where("moved").isEmpty()
        discard(now)
        now = moved
        if done:
            return now.select("word", "root")


def group_variants(docs: DataFrame, least: int = LEAST_LENGTH, often: int = LEAST_COUNT, times: int = TIMES, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each word of ``docs``.

    Words are maximal runs of LETTERS, A-Z lower-cased, of at least ``least`` (4 or more) code points with at least ``often`` occurrences; with
    ``noise`` an occurrence whose hash it divides has lost one letter (0: none has). Two words are near if they differ by one code point
    inserted, deleted or replaced. ``form`` is the near word of largest n (ties: the first in code-point order), if its n is at least
    ``times`` the word's, else null; ``root`` ends the chain of forms. Null and empty texts have no words; a null id counts as an empty one;
    repeated rows count as often as they come; other columns are not read; an empty table gives no rows. Texts of any length are read whole.
    """
    if least < 4 or times < 2:
        raise ValueError("words of fewer than 4 code points may lack two disjoint bigrams; forms are at least twice as frequent")
    words = stage(word_counts(docs, least, often, noise, id_col, text_col), "words")
    pairs = near_words(words)
    both = F.array(F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("m"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("m"), F.col("a").alias("other")))
    near = pairs.select(F.explode(both).alias("x")).groupBy(F.col("x.word").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("x.m", "x.other")).alias("best"))
    good = -F.col("best.m") >= F.col("n") * times
    found = stage(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(found.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return found.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute_force(rows: list[tuple], least: int = LEAST_LENGTH, often: int = LEAST_COUNT, times: int = TIMES, noise: int = NOISE) -> set[tuple]:
    """The same rows from all pairs of words; for tests."""
    counts: dict[str, int] = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            word = noised("" if doc is None else doc, run, noise)
            if len(word) >= least:
                counts[word] = counts.get(word, 0) + 1
    words = {w: n for w, n in counts.items() if n >= often}

    def one_edit(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]

    form, near = {}, {}
    for w in words:
        others = [o for o in words if one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, near[w], words[form[w]] if form[w] is not None else None) for w, n in words.items()}


# crc32 by its table of 256, words within one edit by equal strings with one letter left out.
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE crcs AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
runs AS (
  SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER_SQL}, '[a-zÀ-ÿ]+')) AS word FROM documents)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY ALL),
bytes AS (
  SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || word, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64]::BIGINT[] END)) AS b FROM runs),
hashed AS (
  SELECT word, k, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295) AS h FROM bytes, crcs),
noised AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(word, (h % length(word))::INT) || substr(word, (h % length(word))::INT + 2) ELSE word END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM noised WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS x FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -x[1] >= {TIMES} * n THEN x[2] END AS form, CASE WHEN -x[1] >= {TIMES} * n THEN -x[1] END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS up FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.up)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word) WHERE up IS NULL
"""
