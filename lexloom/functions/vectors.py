"""Vector arithmetic as Column builders, in double precision, and the binary codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = {"float16": "<f2", "float32": "<f4", "float64": "<f8"}
# How far a norm may be from 1.
TOLERANCES = {"float16": 2e-3, "float32": 2e-6, "float64": 1e-12}


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(v: Column) -> Column:
    """Null for zero and non-finite vectors."""
    return _let(norm(v), lambda n: F.when(finite(v) & (n > 0), F.transform(v, lambda x: x / n)))


def scaled_normalize(v: Column) -> Column:
    """The same without overflow: components are divided by the largest first."""
    top = F.array_max(F.transform(v, F.abs))
    return _let(top, lambda t: F.when(finite(v) & (t > 0), _let(F.transform(v, lambda x: x / t), lambda u: _let(norm(u), lambda n: F.transform(u, lambda x: x / n)))))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors; the product held to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def ndcg_gain(grade: Column, best: Column) -> Column:
    """2 ** grade - 1 on a scale common to the query, without overflow."""
    ln2 = float(np.log(2))
    return F.exp((grade - best) * ln2) * -F.expm1(-grade * ln2)


def bm25_idf(documents: Column, holding: Column) -> Column:
    return F.log1p((documents - holding + 0.5) / (holding + 0.5))


def encode(kind: str):
    """A pandas UDF array<double> -> little-endian bytes; null for null or non-finite input."""
    dtype = FORMATS[kind]

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            with np.errstate(over="ignore"):
                x = np.asarray(v, np.float64).astype(dtype)
            return x.tobytes() if np.isfinite(x).all() else None

        return vectors.map(one)

    return pack


def base64_float32(rows: DataFrame, column: str, tolerance: float = 1e-5) -> DataFrame:
    """Adds format, dim, bytes, sha256_bytes and base64 of the unit vectors in ``column``; null where one is not finite in float32 or its norm there is not 1."""
    rounded = F.transform(column, lambda x: x.cast("float").cast("double"))
    sound = F.coalesce(finite(rounded) & (F.abs(norm(rounded) - 1) <= tolerance), F.lit(False))
    packed = rows.withColumn("bytes", encode("float32")(doubles(F.col(column)))).withColumn("sound", sound)
    said = {"format": F.lit("float32_le"), "dim": F.size(column), "sha256_bytes": F.sha2("bytes", 256), "base64": F.base64("bytes"), "bytes": F.octet_length("bytes")}
    return packed.select(*rows.columns, *[F.when(F.col("sound"), c).alias(n) for n, c in said.items()])


def decode(kind: str):
    """A pandas UDF bytes -> array<double>; null where the length is no multiple of the unit or a value is not finite."""
    dtype = FORMATS[kind]
    size = np.dtype(dtype).itemsize

    @F.pandas_udf("array<double>")
    def unpack(blobs: pd.Series) -> pd.Series:
        def one(b):
            if b is None or len(b) % size:
                return None
            x = np.frombuffer(b, dtype).astype(np.float64)
            return x.tolist() if np.isfinite(x).all() else None

        return blobs.map(one)

    return unpack
