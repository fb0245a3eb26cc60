"""Quotation regions of a document, by one fold over its quotation marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.arrays import let, running

# Openers and their closers.
PAIRS = {"“": "”", "«": "»", "‘": "’", '"': '"', "'": "'"}


def _is_mark(text: Column) -> Column:
    return text.isin(*PAIRS, *PAIRS.values())


def _fold(marks: Column) -> Column:
    """s{stack, done, tops} of a document's marks (ord, text) in order; ``tops`` has the region that is open after each, whether the mark opens or closes one, whether that region is nested, and which mark opened it."""
    closers = F.create_map(*[F.lit(x) for pair in PAIRS.items() for x in pair])
    opened = "struct<closer:string,ord:bigint,nested:boolean,nth:int>"
    start = F.struct(F.array().cast(f"array<{opened}>").alias("stack"), F.array().cast("array<struct<open:bigint,close:bigint,nested:boolean>>").alias("done"), F.array().cast("array<struct<ord:bigint,region:bigint,acts:boolean,deep:boolean,nth:int>>").alias("tops"))

    def step(state, mark):
        stack, size = state["stack"], F.size(state["stack"])
        top = F.get(stack, size - 1)
        shut = (size > 0) & (top["closer"] == mark["text"])
        push = F.concat(stack, F.array(F.struct(closers[mark["text"]].alias("closer"), mark["ord"].alias("ord"), (size > 0).alias("nested"), F.size(state["tops"]).alias("nth"))))
        left = F.when(shut, F.slice(stack, F.lit(1), size - 1)).when(mark["text"].isin(*PAIRS), push).otherwise(stack)
        done = F.when(shut, F.concat(state["done"], F.array(F.struct(top["ord"].alias("open"), mark["ord"].alias("close"), top["nested"].alias("nested"))))).otherwise(state["done"])
        acts = F.coalesce(shut, F.lit(False)) | mark["text"].isin(*PAIRS)
        return let(left, lambda now: F.struct(now.alias("stack"), done.alias("done"), F.concat(state["tops"], F.array(F.struct(mark["ord"].alias("ord"), F.get(now, F.size(now) - 1)["ord"].alias("region"), acts.alias("acts"), (F.size(now) > 1).alias("deep"), F.get(now, F.size(now) - 1)["nth"].alias("nth")))).alias("tops")))

    return F.aggregate(marks, start, step)


def _folded(tokens: DataFrame) -> DataFrame:
    """(doc_id, s): one fold over a document's marks."""
    marks = tokens.where(_is_mark(F.col("text"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("marks"))
    return marks.select("doc_id", _fold(F.col("marks")).alias("s"))


def around(sentences: Column, use) -> Column:
    """``use`` (tops, at) of a document's sentences (sentence_ord, start, r): ``tops`` is what holds after each mark (the region and the sentence that it opens in, closed, acts, deep), and ``at(y, k)`` for each token of sentence y, the k-th, the place in it of the last mark up to that token, -1 before all.

    Only marks are folded. Between two marks of a sentence all tokens lie in one region, so no token is sorted or joined.
    """
    marks = F.flatten(F.transform(sentences, lambda y: F.transform(F.filter(y["r"], lambda x: _is_mark(x["text"])), lambda x: F.struct(x["ord"].alias("ord"), x["text"].alias("text"), y["sentence_ord"].alias("sentence_ord")))))

    def tops(marks: Column, f: Column) -> Column:
        still = F.transform(f["stack"], lambda x: x["ord"])
        return let(still, lambda open_: F.transform(f["tops"], lambda x: F.struct(F.get(marks, x["nth"])["sentence_ord"].alias("sentence_ord"), x["region"].alias("region"), (x["region"].isNull() | ~F.array_contains(open_, x["region"])).alias("closed"), x["acts"].alias("acts"), x["deep"].alias("deep"))))

    def last(r: Column, before: Column) -> Column:
        places = F.array_compact(F.transform(r, lambda x, i: F.when(_is_mark(x["text"]), i)))
        until = lambda at, p, j: F.array_repeat(before + j, (F.coalesce(F.get(at, j + 1), F.size(r)) - p).cast("int"))
        return let(places, lambda at: F.concat(F.array_repeat(before - 1, F.coalesce(F.get(at, F.lit(0)), F.size(r))), F.flatten(F.transform(at, lambda p, j: until(at, p, j)))))

    own = lambda y: F.size(F.filter(y["r"], lambda x: _is_mark(x["text"])))
    each = lambda t: let(running(F.transform(sentences, own)), lambda n: use(t, lambda y, k: let(F.get(n, k) - own(y), lambda before: last(y["r"], before))))
    return let(let(marks, lambda m: let(_fold(m), lambda f: tops(m, f))), each)


def region(x: Column, top: Column) -> Column:
    """The innermost region around a token x, of which ``top`` holds (``around``): null outside all and for the marks that open or close one."""
    return F.when(top["region"].isNotNull() & ~(_is_mark(x["text"]) & top["acts"]), top["region"])


def placed(sentences: Column) -> Column:
    """A document's sentences (sentence_ord, start, r) with region, closed and nested for each token of r: as ``innermost`` tells, whether that region is closed (true outside all), and whether it lies in another."""

    def token(x: Column, top: Column) -> Column:
        return let(region(x, top), lambda g: x.withField("region", g).withField("closed", g.isNull() | top["closed"]).withField("nested", g.isNotNull() & top["deep"]))

    def sentence(y: Column, w: Column, tops: Column) -> Column:
        return F.struct(y["sentence_ord"].alias("sentence_ord"), y["start"].alias("start"), F.transform(y["r"], lambda x, i: let(F.get(tops, F.get(w, i)), lambda top: token(x, top))).alias("r"))

    return around(sentences, lambda tops, at: F.transform(sentences, lambda y, k: let(at(y, k), lambda w: sentence(y, w, tops))))


def quote_regions(tokens: DataFrame) -> DataFrame:
    """(doc_id, open, close, nested): regions between whole-token marks; close is null for one that stays open.

    A mark equal to the closer of the innermost open region closes it; otherwise an opener opens a region, and any
    other mark is passed over. The stack goes on across sentences. Only a document's marks are folded, not its tokens.
    """
    still = F.transform("s.stack", lambda x: F.struct(x["ord"].alias("open"), F.lit(None).cast("bigint").alias("close"), x["nested"].alias("nested")))
    return _folded(tokens).select("doc_id", F.explode(F.concat("s.done", still)).alias("r")).select("doc_id", "r.*")


def innermost(tokens: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, region): the start of the innermost region around a token; null outside all and for the marks that open or close one.
    With ``of`` (doc_id, ord) only for those tokens.

    The region after each mark is carried along to the tokens behind it.
    """
    tops = _folded(tokens).select("doc_id", F.explode("s.tops").alias("x"), F.transform(F.concat("s.done.open", "s.done.close", "s.stack.ord"), lambda x: x).alias("ends")).select("doc_id", "x.*", F.array_contains("ends", F.col("x.ord")).alias("end"))
    rows = (tokens if of is None else of).select("doc_id", "ord", F.lit(1).alias("k"), F.lit(None).cast("struct<region:bigint>").alias("top"), F.lit(None).cast("boolean").alias("end"))
    both = rows.unionByName(tops.select("doc_id", "ord", F.lit(0).alias("k"), F.struct("region").alias("top"), "end"))
    order = Window.partitionBy("doc_id").orderBy("ord", "k")
    at_mark = F.lag(F.struct("ord", "end", "k")).over(order)
    found = both.withColumn("now", F.last("top", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("m", at_mark).where("k = 1")
    mine = F.coalesce((F.col("m.k") == 0) & (F.col("m.ord") == F.col("ord")) & F.col("m.end"), F.lit(False))
    return found.select("doc_id", "ord", F.when(~mine, F.col("now.region")).alias("region"))
