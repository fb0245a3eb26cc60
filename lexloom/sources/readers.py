"""Literal sources: files as they are, strict JSON, JSON lines in order, and vector matrices."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_literal(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, valid): whole files, line ends and marks kept; text is null where the bytes are no UTF-8."""
    files = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    return files.select("path", F.when(F.is_valid_utf8(text), text).alias("text"), F.is_valid_utf8(text).alias("valid"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file in the order of its lines (row_idx from 0); a bad or blank line is an error when read."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("row_idx", "line"))
    parsed = F.when(F.trim("line") == "", F.raise_error(F.concat(F.lit("blank line "), F.col("row_idx").cast("string")))).otherwise(F.col("line"))
    return raw.select(F.col("row_idx").cast("long").alias("row_idx"), F.from_json(parsed, schema, {"mode": "FAILFAST"}).alias("r")).select("row_idx", "r.*")


def _repeats(pairs):
    keys = [k for k, _ in pairs]
    if len(keys) != len(set(keys)):
        raise ValueError("repeated key")
    return dict(pairs)


def strict_json(rows: DataFrame, column: str) -> DataFrame:
    """Adds fault: null for strict JSON, else "syntax", "repeated key" or "constant" (NaN and the infinities)."""

    @F.pandas_udf("string")
    def fault(values: pd.Series) -> pd.Series:
        def constant(_):
            raise ArithmeticError

        def one(v):
            try:
                json.loads(v, object_pairs_hook=_repeats, parse_constant=constant)
            except ArithmeticError:
                return "constant"
            except (ValueError, TypeError, RecursionError) as e:
                return "repeated key" if str(e) == "repeated key" else "syntax"

        return values.map(one)

    return rows.withColumn("fault", fault(column))


def read_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(row_idx, v) of .npy files of float32 rows; a wrong type or shape is an error when read."""

    def rows(frames):
        for pdf in frames:
            for content in pdf.content:
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.dtype != np.float32 or x.ndim != 2 or x.shape[1] != dim:
                    raise ValueError(f"matrix of {x.dtype} {x.shape}")
                for lo in range(0, len(x), 512):
                    part = x[lo : lo + 512]
                    yield pd.DataFrame({"row_idx": np.arange(lo, lo + len(part)), "v": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row_idx long, v array<float>")


def write_new(rows: DataFrame, path: str) -> None:
    """Creates ``path``; an existing one is an error."""
    rows.write.mode("errorifexists").parquet(path)
