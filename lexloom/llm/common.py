"""Shared folder, word splitting and rolling hashes used by the training-data operators."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs of characters other than U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 22
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are mixed eight by eight; a longer one is hashed in one call.
_LONG = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WORD_BASE = np.uint64(0xD1B54A32D192ED03)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\[]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{found.rstrip('/')}/lexloom"


def stage(df: DataFrame, name: str = "stage", **options) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: later plans start from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes the files of staged tables that no later plan reads."""
    for df in staged:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of ``counts``, a written table, with the largest ``column`` (positive): at most ``most``, and as many as a histogram of levels tells."""
    level = F.floor(F.log2(column) * 8)
    total, least = 0, None
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a row for each eighth of a power of two
        if (total := total + row["count"]) > most:
            break
        least = row.level
    return counts.where(F.lit(False) if least is None else level >= least)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits before it."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Rabin-Karp hashes of values[starts:ends) from one pass of prefix sums, modulo 2**64."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), dtype=np.uint64, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _powers(_inverse(base), n + 1)[starts])


def word_hashes(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each word of UTF-8 bytes; with ``lower``, A-Z are folded first.

    Eight bytes at a time are mixed in by a step that is not linear, so that no sequence of letters collides by its form alone.
    """
    if not len(data):
        return np.zeros(0, np.uint64)
    if len(data) > _CHUNK:  # bounded memory: long texts go piece by piece, cut between words
        found, at = [], 0
        while at < len(data):
            end = min(at + _CHUNK, len(data))
            while end < len(data) and not _SEPARATOR[data[end]]:
                end += 1
            found.append(_word_hashes(data[at:end], lower))
            at = end
        return np.concatenate(found)
    return _word_hashes(data, lower)


def _word_hashes(data: np.ndarray, lower: bool) -> np.ndarray:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SEPARATOR[data]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    lengths = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1 - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = _LOWER[data] if lower else data
    eights = np.ndarray(len(data), "<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    out = mix64((lengths.astype(np.uint64) * _SEED) ^ (eights[starts] & _MASK[np.minimum(lengths, 8)]))
    rest, at = np.flatnonzero(lengths > 8), 8
    while len(rest) and at < _LONG:
        left = lengths[rest] - at
        out[rest] = mix64((out[rest] * _SEED) ^ (eights[starts[rest] + at] & _MASK[np.minimum(left, 8)]))
        rest, at = rest[left > 8], at + 8
    for i in rest:
        out[i] ^= np.frombuffer(hashlib.blake2b(padded[starts[i] : starts[i] + lengths[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return _spans(words, starts, starts + size, _WORD_BASE)


def text_bytes(column: pa.Array):
    """The UTF-8 bytes of each text of an Arrow string column, as views; None for null."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield whole[at[i] : at[i + 1]] if valid[i] else None


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
