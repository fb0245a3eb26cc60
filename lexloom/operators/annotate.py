"""Annotated tokens: vocabulary, coverage, and the dependency tree of each sentence.

Rows are (doc_id, sentence_ord, ord, text, lemma, pos, dep, head_ord). Null means not produced. What works within sentences also takes
rows (doc_id, sentence_ord, start, r), where r lists a sentence's tokens in order (ord, head_ord, text, ...): these are neither grouped nor sorted.
What works within documents takes rows (doc_id, s), where s lists a document's sentences (sentence_ord, start, r).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.arrays import depths, jump, let
from lexloom.functions.text import dep_base

# What a clause nucleus is made of.
VERBAL, AUXILIARY, SUBORDINATE = ("VERB", "AUX"), ("aux", "cop"), ("xcomp", "ccomp", "advcl", "acl", "csubj")
QUOTES = ('"', "'", "“", "”", "«", "»", "‘", "’")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(doc_id, ord, lemma, pos, grouped_by, form, n, forms): entries in the order of their first token.

    Punctuation and symbols are left out. Tokens group by lemma and part of speech, or, without a lemma, by form.
    """
    kept = tokens.where("pos IS NULL OR pos NOT IN ('PUNCT', 'SYM')")
    form = F.when(F.col("lemma").isNull(), F.col("text"))
    groups = kept.groupBy("doc_id", "lemma", "pos", form.alias("form")).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("seen"))
    forms = F.array_distinct(F.transform("seen", lambda x: x["text"]))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1
    return groups.select("doc_id", number.cast("long").alias("ord"), "lemma", "pos", F.when(F.col("lemma").isNull(), "form_pos").otherwise("lemma_pos").alias("grouped_by"), "form", "n", forms.alias("forms"))


def coverage(tokens: DataFrame) -> DataFrame:
    """(doc_id, tokens, sentences, in_vocabulary, without_lemma, without_pos)."""
    if "r" in tokens.columns:
        many = lambda name, rule: F.size(F.filter("r", rule)).alias(name)
        counted = tokens.select(
            "doc_id", F.size("r").alias("tokens"), F.lit(1).alias("sentences"), many("in_vocabulary", lambda x: F.coalesce(~x["pos"].isin("PUNCT", "SYM"), F.lit(True))), many("without_lemma", lambda x: x["lemma"].isNull()), many("without_pos", lambda x: x["pos"].isNull())
        )
        return counted.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in counted.columns[1:]])
    return tokens.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.count_distinct("sentence_ord").alias("sentences"), F.count_if(F.coalesce(~F.col("pos").isin("PUNCT", "SYM"), F.lit(True))).alias("in_vocabulary"),
        F.count_if(F.col("lemma").isNull()).alias("without_lemma"), F.count_if(F.col("pos").isNull()).alias("without_pos"),
    )


def missing_fields(tokens: DataFrame) -> DataFrame:
    """(doc_id, field, n, first): required fields that tokens lack."""
    each = token_rows(tokens).select("doc_id", "ord", F.explode(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("lemma", "pos", "dep")])).alias("field")).where("field IS NOT NULL")
    return each.groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def token_layers(tokens: DataFrame, morphology: DataFrame, syntax: DataFrame) -> DataFrame:
    """One row for each token with the columns of its layers; all three are dealt by the same key."""
    return tokens.join(morphology, ["doc_id", "ord"]).join(syntax, ["doc_id", "ord"])


def children(tokens: DataFrame) -> DataFrame:
    """(doc_id, ord, children): ordered dependents of each head.

    Sentences that list their tokens sort the pairs of head and dependent; each head's dependents are then a slice.
    """
    if "r" not in tokens.columns:
        return tokens.where("head_ord <> ord").groupBy("doc_id", F.col("head_ord").alias("ord")).agg(F.array_sort(F.collect_list("ord")).alias("children"))
    pairs = F.array_sort(F.transform(F.filter("r", lambda x: x["head_ord"] != x["ord"]), lambda x: F.struct(x["head_ord"].alias("head"), x["ord"].alias("ord"))))
    firsts = lambda p: F.array_compact(F.transform(p, lambda x, i: F.when((i == 0) | (F.get(p, i - 1)["head"] != x["head"]), i)))
    own = lambda p, at: F.transform(at, lambda i, k: F.struct(F.get(p, i)["head"].alias("ord"), F.transform(F.slice(p, i + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - i), lambda x: x["ord"]).alias("children")))
    return tokens.select("doc_id", F.explode(let(pairs, lambda p: let(firsts(p), lambda at: own(p, at)))).alias("x")).select("doc_id", "x.*")


def check_tree(tokens: DataFrame) -> DataFrame:
    """Violations (doc_id, sentence_ord, rule): one self-headed ROOT in a sentence, heads inside it, no circles."""
    s = sentence_arrays(tokens, "dep")

    def rule(t: Column) -> Column:
        outside = let(F.size(t), lambda n: F.exists(t, lambda x: (x["head"] < 0) | (x["head"] >= n)))
        roots = F.size(F.filter(t, lambda x: x["dep"] == "ROOT"))
        wrong_root = F.exists(t, lambda x: (x["dep"] == "ROOT") != (x["head"] == x["i"]))
        circle = let(jump(F.transform(t, lambda x: x["head"])), lambda ends: F.exists(ends, lambda e: F.get(t, e)["dep"] != "ROOT"))
        return F.when(outside, "head_outside").when(roots != 1, "roots").when(wrong_root, "self_head").when(circle, "circle")

    return s.select("doc_id", "sentence_ord", F.explode(F.array(let(F.col("t"), rule))).alias("rule")).where("rule IS NOT NULL")


def sentence_arrays(tokens: DataFrame, *columns: str, **made) -> DataFrame:
    """(doc_id, sentence_ord, start, t): a sentence's tokens in order, with places i and head in it. Bounded by the sentence.

    ``made`` gives more fields as functions of a token.
    """
    g = tokens
    if "r" not in tokens.columns:
        own = [c for c in tokens.columns if c not in ("doc_id", "sentence_ord", "ord", "head_ord")] if made else columns
        g = tokens.groupBy("doc_id", "sentence_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "head_ord", *own))).alias("r"), F.min("ord").alias("start"))
    row = lambda x, i: F.struct(i.alias("i"), (x["head_ord"] - F.col("start")).cast("int").alias("head"), *[x[c].alias(c) for c in columns], *[f(x).alias(c) for c, f in made.items()])
    return g.select("doc_id", "sentence_ord", "start", F.transform("r", row).alias("t"))


def token_rows(sentences: DataFrame) -> DataFrame:
    """The tokens, one in a row, of sentences that list them."""
    return sentences.select("doc_id", "sentence_ord", F.explode(F.when(F.size("r") > 0, F.col("r"))).alias("x")).select("doc_id", "sentence_ord", "x.*") if "r" in sentences.columns else sentences


def document_arrays(tokens: DataFrame) -> DataFrame:
    """(doc_id, s): each document with the list s of its sentences (sentence_ord, start, r), in order. Documents that list their sentences are neither grouped nor sorted."""
    if "s" in tokens.columns:
        return tokens
    own = [c for c in tokens.columns if c not in ("doc_id", "sentence_ord", "ord", "head_ord")]
    g = tokens if "r" in tokens.columns else tokens.groupBy("doc_id", "sentence_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "head_ord", *own))).alias("r"), F.min("ord").alias("start"))
    return g.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sentence_ord", "start", "r"))).alias("s"))


def dependents(heads: Column) -> Column:
    """For each place of a sentence the places that hang from it, in order: pairs sorted by head, of which each place has a slice."""
    one = 1 << 32  # a head and its dependent are sorted as one number
    pairs = F.sort_array(F.array_compact(F.transform(heads, lambda h, i: F.when(h != i, h * F.lit(one) + i))))
    # Places and heads sorted together: before place i stand i places, the rest are pairs of smaller heads.
    lows = lambda p: F.transform(F.array_compact(F.transform(F.sort_array(F.concat(F.transform(heads, lambda _, i: i.cast("long") * 2), F.transform(p, lambda x: F.shiftright(x, 32) * 2 + 1))), lambda v, k: F.when(v % 2 == 0, k))), lambda k, i: k - i)
    own = lambda p, lo, i: F.transform(F.slice(p, F.get(lo, i) + 1, F.coalesce(F.get(lo, i + 1), F.size(p)) - F.get(lo, i)), lambda x: (x % one).cast("int"))
    return let(pairs, lambda p: let(lows(p), lambda lo: F.transform(heads, lambda _, i: own(p, lo, i))))


def clause_arrays(t: Column, use, legacy: bool = False, base=lambda x: dep_base(x["dep"])) -> Column:
    """``use`` of the arrays (nuclei, owners) of a sentence ``t`` (i, head, text, pos, dep): whether a token is a clause's
    nucleus, and the place of the nearest nucleus at or above it.

    A nucleus is a verb or auxiliary whose dependency is neither auxiliary nor copula, or the head of a copula; quotation marks
    are none, unless, with ``legacy``, the tokens' field of that name is true. ``base`` gives a token's base dependency.
    """
    copula_heads = F.transform(F.filter(t, lambda x: base(x) == "cop"), lambda x: x["head"])
    verbal = lambda x: F.coalesce(x["pos"].isin(*VERBAL) & ~base(x).isin(*AUXILIARY), F.lit(False))
    nuclei = let(copula_heads, lambda cop: F.transform(t, lambda x: (verbal(x) | F.array_contains(cop, x["i"])) & (~x["text"].isin(*QUOTES) | (x["legacy"] if legacy else F.lit(False)))))
    owners = lambda n: let(jump(F.zip_with(t, n, lambda x, own: F.when(own, x["i"]).otherwise(x["head"]))), lambda ends: F.transform(ends, lambda e: F.when(F.get(n, e), e)))
    return let(nuclei, lambda n: let(owners(n), lambda o: use(n, o)))


def clauses(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence_ord, ord, nucleus, owner, parent): the nearest nucleus at or above a token, and the owner of its head."""
    s = sentence_arrays(tokens, "text", "pos", "dep")
    rows = lambda t: clause_arrays(t, lambda n, o: F.transform(t, lambda x: F.struct(x["i"].alias("i"), F.get(n, x["i"]).alias("nucleus"), F.get(o, x["i"]).alias("owner"), F.when(x["head"] != x["i"], F.get(o, x["head"])).alias("parent"))))
    y = s.select("doc_id", "sentence_ord", "start", F.explode(let(F.col("t"), rows)).alias("y"))
    at = lambda c: (F.col("start") + F.col(f"y.{c}")).cast("long").alias({"i": "ord"}.get(c, c))
    return y.select("doc_id", "sentence_ord", at("i"), "y.nucleus", at("owner"), at("parent"))


def _preorder(heads: list[int]) -> tuple[list[int | None], list[int | None]]:
    """For each token its number in preorder (children from left to right) and the size of its subtree; null where no root is above it."""
    n = len(heads)
    below: list[list[int]] = [[] for _ in range(n)]
    for i, h in enumerate(heads):
        if h != i and 0 <= h < n:
            below[h].append(i)
    number, size, order = [None] * n, [None] * n, []
    stack = [i for i in range(n - 1, -1, -1) if heads[i] == i]
    while stack:
        i = stack.pop()
        number[i] = len(order)
        order.append(i)
        stack.extend(reversed(below[i]))
    for i in reversed(order):
        size[i] = (size[i] or 0) + 1
        if heads[i] != i:
            size[heads[i]] = (size[heads[i]] or 0) + size[i]
    return number, size


def preorder(heads: Column) -> Column:
    """The tree of a sentence as intervals, in time linear in its tokens: a subtree is a run of the preorder."""

    @F.pandas_udf("struct<number:array<int>,size:array<int>>")
    def of(values: pd.Series) -> pd.DataFrame:
        found = [_preorder(h.tolist()) for h in values]
        return pd.DataFrame({"number": [x for x, _ in found], "size": [x for _, x in found]})

    return of(heads)


def tree_orders(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence_ord, start, number, size, order): for each sentence the tokens' preorder numbers and subtree sizes by place, and their
    places in preorder. What hangs below a token is a slice of ``order``. Tokens in circles, below no root, are in no order."""
    # Exploded, so that the heads are a column: within the function's argument Spark would not find them again.
    s = sentence_arrays(tokens).select("doc_id", "sentence_ord", "start", F.explode(F.array(F.transform("t", lambda x: x["head"]))).alias("heads")).withColumn("tree", preorder(F.col("heads")))
    placed = F.filter(F.transform("tree.number", lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: x["n"].isNotNull())
    return s.select("doc_id", "sentence_ord", "start", F.col("tree.number").alias("number"), F.col("tree.size").alias("size"), F.transform(F.array_sort(placed), lambda x: x["i"]).alias("order"))


def subtrees(tokens: DataFrame, wanted: str | None = None) -> DataFrame:
    """(doc_id, ord, descendant): all that hangs below a token, itself included; with ``wanted``, a column, only below those.

    A subtree is a slice of its sentence's preorder, so the work is that of the result, however deep the tree is.
    """
    rows = token_rows(tokens) if wanted is None else tokens.where(F.col(wanted))
    met = rows.select("doc_id", "sentence_ord", "ord").join(tree_orders(tokens), ["doc_id", "sentence_ord"]).withColumn("i", (F.col("ord") - F.col("start")).cast("int"))
    below = F.slice("order", F.get("number", F.col("i")) + 1, F.get("size", F.col("i")))
    return met.select("doc_id", "ord", "start", F.explode(below).alias("d")).select("doc_id", "ord", (F.col("start") + F.col("d")).cast("long").alias("descendant"))
