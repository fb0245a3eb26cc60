"""Scopes within sentences: the tokens that a nucleus owns or that hang below one, cut at the edges of quotations."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.arrays import let
from lexloom.operators import rules
from lexloom.operators.annotate import QUOTES, _preorder

# How negators hang from what they negate.
NEGATING = ("advmod", "neg", "cc")


def ask(region: Column, owners: Column, tops: Column, anywhere: Column | None = None, marks: Column | None = None, itself: Column | None = None) -> Column:
    """What ``scoped`` is asked for one marker: the tokens that ``owners`` own and those below ``tops`` (arrays of places), of its region (or ``anywhere``),
    without quotation marks unless ``marks``, and without the place ``itself``."""
    flag = lambda c: F.lit(False) if c is None else c
    head = F.array(*[c.cast("long") for c in (F.coalesce(region, F.lit(-1)), flag(anywhere), flag(marks), F.lit(-1) if itself is None else itself, F.size(owners))])
    return F.concat(head, owners.cast("array<bigint>"), tops.cast("array<bigint>"))


def _scopes(owner: list[int], head: list[int], region: list[int], kind: list[int], asks: list[list[int]]) -> list[list[int]]:
    """For each of ``asks`` how many tokens it has, the first that denies (or -1), and the borders of the runs of consecutive ones. ``kind`` is 1 for marks, 2 for what denies."""
    own, tree = defaultdict(list), None
    for i, o in enumerate(owner):
        own[o].append(i)
    found = []
    for where, anywhere, marks, itself, n, *keys in asks:
        at = [i for k in keys[:n] for i in own.get(k, ())]
        if keys[n:] and tree is None:
            number, size = _preorder(head)
            tree = number, size, [i for _, i in sorted((k, i) for i, k in enumerate(number) if k is not None)]
        for top in keys[n:]:
            number, size, order = tree
            at += order[number[top] : number[top] + size[top]] if number[top] is not None else []
        at = sorted({i for i in at if i != itself and (anywhere or region[i] == where) and (marks or kind[i] != 1)})
        firsts = [i for k, i in enumerate(at) if k == 0 or at[k - 1] != i - 1]
        lasts = [i for k, i in enumerate(at) if k == len(at) - 1 or at[k + 1] != i + 1]
        found.append([len(at), next((i for i in at if kind[i] == 2), -1), *[x for run in zip(firsts, lasts, strict=True) for x in run]])
    return found


def numbers(e: rules.Sentence) -> Column:
    """What ``answered`` reads of a sentence: for each token the places of owner and head (-1 for none), region and kind."""
    kind = lambda x: F.when(x["text"].isin(*QUOTES), 1).when(x["form"].isin(*rules.NEGATORS) & x["base"].isin(*NEGATING), 2).otherwise(0).cast("long")
    local = lambda name: e.transform(lambda x: F.coalesce(x[name].cast("long"), F.lit(-1)))
    return F.struct(local("own").alias("owner"), local("head").alias("head_ord"), local("region").alias("region"), e.transform(kind).alias("kind"))


def answered(rows: DataFrame) -> DataFrame:
    """Rows with t (``numbers``) and asks, a list of ``ask``, with got (met, denier, slices): how many tokens each has, the place of the first that denies, and their runs [first, last]."""

    @F.pandas_udf("array<array<bigint>>")
    def scopes(owner: pd.Series, head: pd.Series, region: pd.Series, kind: pd.Series, asks: pd.Series) -> pd.Series:
        return pd.Series([_scopes(*[x.tolist() for x in lists], [x.tolist() for x in a]) if len(a) else [] for *lists, a in zip(owner, head, region, kind, asks, strict=True)], dtype=object)

    at = lambda i: i + F.col("start")
    none = F.array(*[F.lit(x).cast("long") for x in (-1, 0, 0, -1, 0)])
    runs = lambda g: F.transform(F.sequence(F.lit(1), F.floor((F.size(g) - 2) / 2).cast("int")), lambda k: F.struct(at(F.get(g, k * 2)).alias("first"), at(F.get(g, k * 2 + 1)).alias("last")))
    one = lambda g: F.struct(F.get(g, F.lit(0)).alias("met"), F.when(F.get(g, F.lit(1)) >= 0, at(F.get(g, F.lit(1)))).alias("denier"), F.when(F.get(g, F.lit(0)) > 0, runs(g)).alias("slices"))
    full = rows.withColumn("asks", F.transform("asks", lambda x: F.coalesce(x, none)))
    told = full.withColumn("got", scopes("t.owner", "t.head_ord", "t.region", "t.kind", "asks"))
    return told.withColumn("got", F.transform("got", one)).drop("t", "asks")


def asked(found):
    """What ``scoped`` keeps of a sentence: null where nothing is found."""
    return lambda ord_, start, e: let(found(e, start), lambda f: F.when(F.size(f) > 0, F.struct(ord_.alias("sentence_ord"), start.alias("start"), f.alias("found"), F.exists(e.e, lambda x: x["pos"].isNull()).alias("blocked"), numbers(e).alias("t"))))


def scoped(tokens: DataFrame, found) -> DataFrame:
    """(doc_id, sentence_ord, row, blocked, met, denier, slices): what ``found`` (e, start) lists of each sentence (``rules.by_sentence``), as structs
    of a row and what it asks for (``ask``, null for nothing), with what is ``answered``.

    ``blocked`` tells of a sentence in which a part of speech is missing. Only sentences in which something is found go on, as lists of numbers.
    """
    y = rules.by_sentence(tokens, asked(found)).select("doc_id", F.explode(let(F.col("y"), F.array_compact)).alias("y")).select("doc_id", "y.*")
    y = answered(y.withColumn("asks", F.transform("found", lambda x: x["ask"])))
    each = F.transform("found", lambda x, k: F.struct(x["row"].alias("row"), F.get("got", k).alias("got")))
    return y.select("doc_id", "sentence_ord", "blocked", F.explode(each).alias("x")).select("doc_id", "sentence_ord", "x.row", "blocked", "x.got.*")


def scoped_apart(tokens: DataFrame, found, told) -> DataFrame:
    """(doc_id, sentence_ord, fields of ``told``, side): what the version of the tokens makes of a sentence ("own") and not the present one ("present"), or the other way round.

    ``told`` makes a struct of what ``scoped`` gives (row, met, denier, slices, by name). Both are told side by side and compared within the sentence, in order, so that
    no row is joined or shuffled. A row comes once on a side, as it is about one token.
    """
    y = rules.by_sentence(tokens, asked(found), apart=True).select("doc_id", F.explode(let(F.col("y"), F.array_compact)).alias("y")).select("doc_id", "y.*")
    row = lambda side, x, got: F.struct(F.col(f"{side}.sentence_ord").alias("sentence_ord"), told(lambda name: x["row"] if name == "row" else got[name]).alias("told"))
    listed = lambda side: F.transform(f"{side}.found", lambda x, k: F.struct(row(side, x, F.get(f"got_{side}", k)).alias("x"), F.lit(side).alias("side")))
    sides = []
    for side in ("own", "present"):
        asks = F.coalesce(F.transform(f"{side}.found", lambda x: x["ask"]), F.array().cast("array<array<bigint>>"))
        y = answered(y.select("*", F.col(f"{side}.start").alias("start"), F.col(f"{side}.t").alias("t"), asks.alias("asks"))).withColumn(f"got_{side}", F.col("got")).drop("got", "start")
        each = listed(side)
        sides.append(F.coalesce(each, F.array().cast(y.select(each.alias("l")).schema["l"].dataType)))
    differs = lambda w: F.filter(w, lambda x, i: ~(F.coalesce(F.get(w, i - 1)["x"] == x["x"], F.lit(False)) | F.coalesce(F.get(w, i + 1)["x"] == x["x"], F.lit(False))))
    y = y.select("doc_id", F.explode(let(F.sort_array(F.concat(*sides)), differs)).alias("z"))
    return y.select("doc_id", "z.x.sentence_ord", "z.x.told.*", "z.side")
