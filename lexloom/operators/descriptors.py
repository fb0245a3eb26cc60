"""Descriptors of two backends compared path by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut


def paths(rows: DataFrame, depth: int = 32) -> DataFrame:
    """(id, path, value, leaf): every place of the JSON in ``rows`` (id, json), with its keys from the top and its JSON.

    Objects with members are opened level by level as variants; whatever else is a leaf: lists, empty objects, null. A null row has no
    places, malformed JSON or objects nested deeper than ``depth`` are errors. Numbers are equal by value, members in any order.
    """
    spark = rows.sparkSession
    inner = F.col("kind").startswith("OBJECT") & (F.col("kind") != "OBJECT<>")
    kinds = lambda level: level.withColumn("kind", F.schema_of_variant("v"))
    front = cut(kinds(rows.where("json IS NOT NULL").select("id", F.array().cast("array<string>").alias("path"), F.parse_json("json").alias("v"))))
    found = None
    for _ in range(depth):
        part = front.select("id", "path", F.to_json("v").alias("value"), (~inner).alias("leaf"))
        found = part if found is None else found.unionByName(part)
        opened = front.where(inner).select("id", F.col("path").alias("above"), F.col("v").alias("object"))
        members = opened.lateralJoin(spark.tvf.variant_explode(F.col("object").outer()))
        front = cut(kinds(members.select("id", F.concat("above", F.array("key")).alias("path"), F.col("value").alias("v"))))
        if front.isEmpty():
            return found
    raise ValueError(f"objects nested deeper than {depth}")


def compare(rows: DataFrame, depth: int = 32) -> DataFrame:
    """(id, path, in_a, in_b, a, b, equal) for every path that ends in a or in b of ``rows`` (id, a, b), both JSON.

    A path may end in one and lead on in the other. ``equal`` is null where either lacks the path or has null there: nothing is invented.
    """
    side = lambda name: paths(rows.select("id", F.col(name).alias("json")), depth).select("id", "path", F.col("value").alias(name), F.col("leaf").alias(f"leaf_{name}"))
    both = side("a").join(side("b"), ["id", "path"], "full").where("leaf_a OR leaf_b")
    told = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != "null") & (F.col("b") != "null")
    return both.select("id", "path", F.col("a").isNotNull().alias("in_a"), F.col("b").isNotNull().alias("in_b"), "a", "b", F.when(told, F.col("a") == F.col("b")).alias("equal"))
