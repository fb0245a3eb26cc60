"""Substring dedup: windows of SIZE words that also start in an earlier document are removed.

Every window of a text has a Rabin-Karp hash. Counting them all would shuffle a row for each word of the
corpus, so a filter that loses nothing goes first: of the shorter k-grams in a window, the one with the
least hash (its minimiser) is the same wherever the window occurs. Only windows whose minimiser occurs in
two documents can repeat; for those, the window hash and 32 bits of the minimiser's, 96 together,
are counted in Spark. The repeats found are merged into maximal intervals of words and cut out of each text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import partitions, signed, text_bytes, window_hashes, word_hashes

SIZE = 50
#: Stands for a null id (the least long).
NO_ID = -(1 << 63)
#: A join key other than the grouping key: both sides are dealt anew, and AQE can split hot keys.
_OTHER = 0x5DEECE66D


def _minimisers(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` words, the place of its minimiser; and the k-gram hashes."""
    k = max(1, size // 2)
    grams = window_hashes(words, k)
    span = size - k + 1  # k-grams in a window
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams
    at = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(grams[lo : min(n, lo + (1 << 16)) + span - 1], span)
        at[lo : lo + len(part)] = lo + np.arange(len(part)) + part.argmin(axis=1)
    return at, grams


def _emit(size: int):
    """(id, version, text) to the distinct minimisers (gram, id, version, at) of each text."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for doc, version, data in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), text_bytes(batch.column(2)), strict=True):
                if data is None or len(data) < 2 * size - 1:
                    continue
                at, grams = _minimisers(word_hashes(data), size)
                at = np.unique(at)
                for column, values in zip(out, (signed(grams[at]), np.full(len(at), doc, np.int64), np.full(len(at), version, np.int32), at.astype(np.int32)), strict=True):
                    column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, kind)) for x, kind in zip(out, (np.int64, np.int64, np.int32, np.int32), strict=True)], names=["gram", "id", "version", "at"])

    return run


def _windows(size: int):
    """(id, version, text, ats) to the windows (gram, window, id, version, start) with a minimiser at one of ``ats``.

    Of the minimiser's hash 32 bits are kept; with the window's own 64 that makes a key of 96.
    """

    def run(batches):
        kinds, names = (np.int32, np.int64, np.int64, np.int32, np.int32), ["gram", "window", "id", "version", "start"]
        for batch in batches:
            out, held = [[] for _ in kinds], 0
            for doc, version, data, ats in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), text_bytes(batch.column(2)), batch.column(3), strict=True):
                words = word_hashes(data)
                at, grams = _minimisers(words, size)
                chosen = np.zeros(len(grams), bool)
                chosen[np.asarray(ats.values)] = True
                start = np.flatnonzero(chosen[at])
                short = (grams[at[start]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for column, values in zip(out, (short, signed(window_hashes(words, size)[start]), np.full(len(start), doc, np.int64), np.full(len(start), version, np.int32), start.astype(np.int32)), strict=True):
                    column.append(values)
                held += len(start)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=names)
                    out, held = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, kind)) for x, kind in zip(out, kinds, strict=True)], names=names)

    return run


def intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal word intervals [a, b) covered by windows at the sorted ``starts``."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > size)
    first = np.concatenate([starts[:1], starts[breaks + 1]])
    last = np.concatenate([starts[breaks], starts[-1:]])
    return [(int(a), int(b) + size) for a, b in zip(first, last, strict=True)]


def _cut(size: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, starts in zip(batch.column("id").to_pylist(), text_bytes(batch.column("text")), batch.column("starts"), strict=True):
                words = text.tobytes().split() if text is not None else []  # bytes.split knows just these six separators
                spans = intervals(np.sort(np.asarray(starts.values)), size) if starts.is_valid else []
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((doc, len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([[{"first": a, "end": b} for a, b in r[3]] for r in rows], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array([r[4] for r in rows], pa.string())],
                names=["id", "n_words", "n_removed", "removed", "kept"],
            )

    return run


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, version, starts): for each text the starts of its windows that also start in a smaller id.

    ``docs`` is (id, version, text) without nulls, NO_ID for no id; version tells apart different texts under one id.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    grams = docs.where(F.col("id") != NO_ID).mapInArrow(_emit(size), "gram long, id long, version int, at int")
    shared = grams.groupBy("gram").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select(F.col("gram").bitwiseXOR(F.lit(_OTHER)).alias("key"), "lo", "hi")
    met = grams.withColumn("key", F.col("gram").bitwiseXOR(F.lit(_OTHER))).join(shared, "key")
    # The last document with a minimiser lends no window to others, the first takes none; the lists are at most a text's words.
    candidates = met.groupBy("id", "version").agg(F.collect_set(F.when(F.col("id") < F.col("hi"), F.col("at"))).alias("lends"), F.collect_set(F.when(F.col("id") > F.col("lo"), F.col("at"))).alias("takes"))
    # No column is null, so no filter comes between scan and exchange, and all uses share one exchange of the texts.
    dealt = docs.repartition(n, "id", "version").join(candidates, ["id", "version"])

    def windows(which: str) -> DataFrame:
        return dealt.where(F.size(which) > 0).select("id", "version", "text", which).mapInArrow(_windows(size), "gram int, window long, id long, version int, start int")

    first = windows("lends").groupBy("gram", "window").agg(F.min("id").alias("lo")).select(F.col("gram").bitwiseXOR(F.lit(_OTHER & 0xFFFF)).alias("key"), "window", "lo")
    later = windows("takes").withColumn("key", F.col("gram").bitwiseXOR(F.lit(_OTHER & 0xFFFF))).join(first, ["key", "window"]).where("id > lo")
    return later.groupBy("id", "version").agg(F.collect_set("start").alias("starts"))


def dedup_substrings(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, removed, kept): one row for each row of ``docs``.

    Words are runs of characters other than U+0020 and U+0009 to U+000D. A word goes if a window of ``size``
    words over it has the same words as a window of a document with a smaller id; windows are judged on the
    input. ``removed`` holds the maximal intervals of words, ``kept`` the rest joined by one space. Null texts
    have no words; texts shorter than a window keep all; rows with a null id keep all and take nothing from
    others; repeated rows and rows with equal ids take nothing from each other and are judged alike; other
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.hash(F.col(text_col)).alias("version"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = repeated_windows(rows, size)
    dealt = rows.repartition(partitions(docs.sparkSession), "id", "version")
    return (
        dealt.join(found, ["id", "version"], "left")
        .select("id", "text", "starts")
        .mapInArrow(_cut(size), "id long, n_words long, n_removed long, removed array<struct<first:long,end:long>>, kept string")
        .withColumn("id", F.nullif("id", F.lit(NO_ID)))
        .withColumnRenamed("id", id_col)
    )


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], size: int = SIZE) -> list[tuple[int | None, int, int, str]]:
    """The same result from one dictionary of all windows; for tests."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, words in split:
        for p in range(len(words) - size + 1) if i is not None else ():
            key = tuple(words[p : p + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - size + 1) if i is not None else ():
            if first[tuple(words[p : p + size])] < i:
                gone.update(range(p, p + size))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
