"""What occurrences rest on: their markers and nuclei, as fragments of the copy and of the original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.arrays import let, running
from lexloom.operators import rules, segment, spans
from lexloom.operators.annotate import AUXILIARY, QUOTES, dependents
from lexloom.operators.linkage import numbered
from lexloom.session import cut


def evidence_tokens(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences in their order (``rules.ordered``), and (doc_id, place, at): each one's marker tokens and nuclei, each token once.

    A clause's marker takes its auxiliaries and copulas, a correlative's all four words and both nuclei, "por isso" both words, "ter" the
    "que" or "de" of its verbal complements. A negator's nucleus may be a constituent. In a quotation a nucleus of another region is none.
    """
    sentence = lambda ord_, start, e: F.struct(ord_.alias("sentence_ord"), _found(e, start).alias("found"))
    d = rules.by_sentence(tokens, sentence)
    # Places are counted over a document's list, so no occurrence is sorted.
    every = F.flatten(F.transform("y", lambda y: F.transform(y["found"], lambda o: F.struct(y["sentence_ord"].alias("sentence_ord"), o.alias("o")))))
    met = d.select("doc_id", F.posexplode(let(every, lambda v: v)).alias("place", "x")).select("doc_id", "x.sentence_ord", "x.o.*", F.col("place").cast("long").alias("place"))
    return met.drop("at"), met.select("doc_id", "place", F.explode(let(F.col("at"), F.array_distinct)).alias("at"))


def _found(e: rules.Sentence, start: Column) -> Column:
    """The occurrences of a sentence, each with the tokens that it rests on."""
    row = lambda o, z: F.struct(*[o[c].alias(c) for c in ("ord", "rule", "family", "category", "nucleus")], _rests_on(o, e, z["pairs"], z["below"]).alias("at"))
    looked_up = F.struct(rules.paired(e, start).alias("pairs"), dependents(e.transform(lambda x: x["head"])).alias("below"))
    return let(looked_up, lambda z: F.transform(rules.listed(e, z["pairs"]), lambda o: row(o, z)))


def fragments_of(tokens: DataFrame) -> DataFrame:
    """``fragments`` of the occurrences of documents whose sentences keep their pieces (pieces, w_start, o_pieces, o_start: ``segment.paired_lists``).

    What an occurrence rests on lies in its sentence, so its fragments are runs of that sentence's pieces: nothing is sorted, joined, shuffled or written.
    """
    kept = ("w_start", "o_start", "pieces", "o_pieces")
    sentence = lambda ord_, start, e: F.struct(start.alias("start"), *[e.row[c].alias(c) for c in kept], F.transform(_found(e, start), lambda o: F.sort_array(F.array_distinct(o["at"]))).alias("found"))
    y = rules.by_sentence(tokens, sentence)
    y = y.select("doc_id", F.explode(numbered(F.col("y"), lambda x, base: F.struct(base.alias("base"), x.alias("x")))).alias("z")).select("doc_id", "z.base", "z.x.*")
    ends = lambda c: running(F.transform(c, lambda x: F.length(x)))
    # Where tokens lie among the pieces, and where pieces end.
    y = y.select("doc_id", "base", "start", "found", *kept, F.array_compact(F.transform("pieces", lambda x, i: F.when(~segment._blank(x), i))).alias("places"), ends("pieces").alias("w"), ends("o_pieces").alias("o"))
    firsts = lambda w: F.filter(w, lambda x, i: (i == 0) | (F.get(w, i - 1) != x - 1))
    lasts = lambda w: F.filter(w, lambda x, i: (i == F.size(w) - 1) | (F.get(w, i + 1) != x + 1))
    runs = lambda w: F.zip_with(firsts(w), lasts(w), lambda a, z: F.struct(a.alias("first"), z.alias("last")))

    y = y.withColumn("found", F.transform("found", runs))
    # Without functions of elements these steps are compiled as one, so that a sentence's lists are not copied for its rows.
    y = y.select("*", F.posexplode("found").alias("k", "r")).select("*", F.posexplode("r").alias("fragment", "x"))
    at = lambda name: F.get("places", (F.col(f"x.{name}") - F.col("start")).cast("int")).alias(name)
    y = y.select("doc_id", "base", "k", "fragment", "x", *kept, "w", "o", at("first"), at("last"))
    a, z = F.col("first"), F.col("last")
    begin = lambda name, pieces: (F.col(f"{name}_start") + F.get(name, a) - F.length(F.get(pieces, a))).cast("long").alias(f"{name}_start")
    end = lambda name: (F.col(f"{name}_start") + F.get(name, z)).cast("long").alias(f"{name}_end")
    text = lambda pieces: F.array_join(F.slice(pieces, a + 1, z - a + 1), "")
    return y.select(
        "doc_id", (F.col("base") + F.col("k")).alias("place"), F.col("fragment").cast("long").alias("fragment"), "x.first", "x.last", begin("w", "pieces"), end("w"), text("pieces").alias("text"), begin("o", "o_pieces"), end("o"), text("o_pieces").alias("o_text")
    )


def _rests_on(o: Column, e: rules.Sentence, pairs: Column, below: Column) -> Column:
    """The tokens of an occurrence o of ``rules.listed`` in its sentence e, with its ``paired`` and ``dependents``."""
    kids = lambda ord_: F.filter(F.transform(F.get(below, (ord_ - e.start).cast("int")), lambda i: F.get(e.e, i)), lambda k: ~k["text"].isin(*QUOTES))
    ords = lambda k: F.transform(k, lambda x: x["ord"])
    rule, none = o["rule"], F.array().cast("array<bigint>")

    def told(x: rules.Token) -> Column:
        denies = rule.startswith("negation_")
        marker = F.when(rule == "therefore", F.array(o["ord"] - 1, o["ord"])).otherwise(F.array(o["ord"]))
        nucleus = let(F.when(denies, rules.negated(F.lit(True), lambda c: x[c])[0]).otherwise(o["nucleus"]), lambda n: F.array(F.when(~denies | x["region"].isNull() | x["region"].eqNullSafe(e.get(n)["region"]), n)))
        both = F.flatten(F.transform(F.filter(pairs, lambda p: p["first"] == o["ord"]), lambda p: F.array(p["first"] + 1, p["second"], p["second"] + 1, p["other"])))
        verbal = F.filter(kids(o["ord"]), lambda k: k["pos"].isin("VERB", "AUX") & k["base"].isin("xcomp", "ccomp"))
        words = F.flatten(F.transform(verbal, lambda k: ords(F.filter(kids(k["ord"]), lambda w: w["form"].isin("que", "de") & w["base"].isin("mark", "case")))))
        helpers = ords(F.filter(kids(o["ord"]), lambda k: k["base"].isin(*AUXILIARY)))
        extra = F.when(rule == "correlative", both).when(rule == "clause", helpers).when((rule == "modal_verb") & (x["lemma"] == "ter"), words).otherwise(none)
        return F.array_compact(F.concat(marker, nucleus, extra))

    return let(e.get(o["ord"]).x, lambda x: told(rules.Token(x, e)))


def _worded(docs: DataFrame, side: str) -> DataFrame:
    """(doc_id, at, {side}_word, {side}_gap, {side}_start, {side}_end): each token with what lies between it and the next one."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    p = segment.pieces(docs).withColumn("gap", F.lead(F.when(F.col("space"), F.col("text")), 1).over(order)).withColumn("at", F.count_if(~F.col("space")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return p.where("NOT space").select("doc_id", "at", F.col("text").alias(f"{side}_word"), F.coalesce("gap", F.lit("")).alias(f"{side}_gap"), F.col("w_start").alias(f"{side}_start"), F.col("w_end").alias(f"{side}_end"))


def fragments(members: DataFrame, original: DataFrame) -> DataFrame:
    """(doc_id, place, fragment, first, last, w_start, w_end, text, o_start, o_end, o_text): runs of consecutive tokens of each occurrence.

    ``members`` are (doc_id, place, at), ``original`` (doc_id, text) the texts whose copy with CRLF as LF was tokenised; tokens are the same in
    both, as only separators differ. Spans of the copy are carried through the span map. Texts are put together from tokens and separators on
    either side, so a long document is not sliced for each fragment.
    """
    copy = spans.prepare_crlf(original).select("doc_id", "text")
    runs = members.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("doc_id", "place").orderBy("at")))
    met = runs.join(_worded(copy, "w"), ["doc_id", "at"]).join(_worded(original, "o").select("doc_id", "at", "o_word", "o_gap"), ["doc_id", "at"])

    def joined(side: str):
        rows = F.array_sort(F.collect_list(F.struct("at", F.col(f"{side}_word").alias("word"), F.col(f"{side}_gap").alias("gap"))))
        n = F.size(rows)
        return F.array_join(F.transform(rows, lambda x, i: F.when(i < n - 1, F.concat(x["word"], x["gap"])).otherwise(x["word"])), "")

    own = met.groupBy("doc_id", "place", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("w_start").alias("w_start"), F.max("w_end").alias("w_end"), joined("w").alias("text"), joined("o").alias("o_text"))
    number = F.row_number().over(Window.partitionBy("doc_id", "place").orderBy("first")) - 1
    own = cut(own.withColumn("fragment", number.cast("long")))
    placed = spans.map_spans(own.select("doc_id", F.struct("place", "fragment").alias("span"), "w_start", "w_end"), spans.span_map(original))
    mapped = placed.select("doc_id", "span.place", "span.fragment", "o_start", "o_end")
    return own.join(mapped, ["doc_id", "place", "fragment"]).select("doc_id", "place", "fragment", "first", "last", "w_start", "w_end", "text", "o_start", "o_end", "o_text")
