"""Segmentation of a text into tokens, separators, paragraphs and sentences.

Texts are dealt by doc_id before they are taken apart. Where sentences start is told from a text's list of pieces (``sentence_lists``), so no
token is sorted or shuffled; the windows of ``pieces`` and ``units`` are partitioned by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.arrays import let, running
from lexloom.functions.text import CLOSERS, OPENERS, PARAGRAPH_BREAK, TITLES, TOKEN_PATTERN, is_blank, starts_upper, terminal_punct


def _blank(text: F.Column) -> F.Column:
    """``is_blank`` of a piece, with the pattern only where its first byte does not tell."""
    return F.when(text == " ", True).when((text >= "0") & (text < "\x7f"), False).otherwise(is_blank(text))


def _lists(docs: DataFrame, ordered: bool = False) -> DataFrame:
    # A number of partitions is named, as adaptive execution would merge the small texts that soon are many rows.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.where("text IS NOT NULL").select("doc_id", "text").repartition(n, "doc_id")
    return (dealt.sortWithinPartitions("doc_id") if ordered else dealt).select("doc_id", "text", F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0)).alias("l"))


def _split(docs: DataFrame) -> DataFrame:
    return _lists(docs).select("doc_id", F.posexplode("l").alias("pos", "text")).withColumn("space", _blank(F.col("text")))


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, w_start, w_end, space): the total partition of each text, with offsets."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text").cast("long")).over(order)
    return _split(docs).select("doc_id", "pos", "text", (end - F.length("text")).alias("w_start"), end.alias("w_end"), "space")


def _breaks(piece: F.Column) -> F.Column:
    return piece.contains("\n") & piece.rlike(PARAGRAPH_BREAK)  # no token holds a line end


def _resumes(pieces: F.Column) -> F.Column:
    """For each piece, whether what follows may start a sentence: a paragraph break or nothing comes, or the next token that is no
    quotation mark starts in upper case. Linear in the pieces."""
    stop = lambda x: _breaks(x) | (~_blank(x) & ~x.isin(*CLOSERS, *OPENERS))
    stops = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: stop(F.get(pieces, i)))
    after = lambda x: x.isNull() | _breaks(x) | starts_upper(x)
    until = lambda at, j: F.array_repeat(F.coalesce(after(F.get(pieces, F.get(at, j + 1))), F.lit(True)), (F.coalesce(F.get(at, j + 1), F.size(pieces)) - F.get(at, j)).cast("int"))
    return let(stops, lambda at: F.concat(F.array_repeat(after(F.get(pieces, F.get(at, F.lit(0)))), F.get(at, F.lit(0))), F.flatten(F.transform(at, lambda p, j: until(at, j)))))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, text, space, fresh, absorbed, candidate): pieces, and what the rules say of them.

    A piece's neighbours are read from the text's list, so no window is needed; only texts with an "etc" are looked over for what comes
    after each piece.
    """
    none, text = F.lit(False), F.col("text")
    lists = _lists(docs).select("doc_id", "l", F.when(text.rlike("(?i)etc"), _resumes(F.col("l"))).alias("resumes"))
    # Not the bare column: Spark would ask for its size before the texts are dealt, and find all tokens there.
    p = lists.select("doc_id", "l", "resumes", F.posexplode(F.when(F.size("l") > 0, F.col("l"))).alias("pos", "text"))
    p = p.select("doc_id", "pos", "text", _blank(text).alias("space"), F.get("l", F.col("pos") - 1).alias("b"), F.get("l", F.col("pos") + 1).alias("a"), F.get("resumes", F.col("pos")).alias("resumes"))
    b, a, resumes, token = F.col("b"), F.col("a"), F.col("resumes"), ~F.col("space")
    spaced = F.coalesce(_blank(b), none)
    fresh = token & ((F.col("pos") == 0) | F.coalesce(_breaks(b), none) | ((F.col("pos") == 1) & spaced))
    absorbed, candidate = _said(text, b, a, resumes)
    return p.select("doc_id", "pos", "text", "space", fresh.alias("fresh"), (token & absorbed).alias("absorbed"), (token & F.coalesce(candidate, none)).alias("candidate"))


def _said(text: F.Column, b: F.Column, a: F.Column, resumes: F.Column) -> tuple[F.Column, F.Column]:
    """Whether a token between the pieces ``b`` and ``a`` belongs to the end before it, and whether a sentence may end with it."""
    none = F.lit(False)
    adjacent = b.isNotNull() & ~_blank(b)
    punct = (text < "@") & terminal_punct(text)
    closes = text.isin(*CLOSERS) & (~text.isin('"', "'") | adjacent)
    guarded = (text == ".") & adjacent & (F.lower(b).isin(*TITLES) | (resumes.isNotNull() & (F.lower(b) == "etc") & ~resumes) | (b.rlike(r"\p{N}$") & F.coalesce(~_blank(a) & a.rlike(r"^\p{N}"), none)))
    candidate = (resumes.isNotNull() & (F.lower(text) == "etc.") & resumes) | (punct & ~text.rlike(r"^\.{2,}$") & ~F.coalesce(guarded, none))
    return punct | closes, candidate


def _bounds(pieces: F.Column, resumes: F.Column) -> F.Column:
    """Where sentences start, in order, and at last the number of pieces: twice the place, and one more where a token before it may end a sentence.

    A sentence starts at a text's first token, behind a paragraph break, and at the first token behind one that may end a sentence that no
    end absorbs. Only marks and breaks are looked at closely: ends are runs of marks, each read once.
    """
    none = F.lit(False)
    letter = lambda x: ((x >= "A") & (x < "[")) | ((x >= "a") & (x < "{"))
    asked = lambda x: F.when(x == " ", False).when(letter(x), resumes.isNotNull() & (F.lower(x) == "etc.")).otherwise(x.isin(*CLOSERS) | ((x < "@") & terminal_punct(x)) | _breaks(x))
    places = F.array_compact(F.transform(pieces, lambda x, i: F.when(asked(x), i)))

    def told(i: F.Column, x: F.Column, b: F.Column, a: F.Column) -> F.Column:
        absorbed, candidate = _said(x, b, a, F.get(resumes, i))
        skip = F.coalesce(_blank(a), none).cast("int")
        return F.struct(i.alias("i"), _breaks(x).alias("breaks"), absorbed.alias("absorbed"), F.coalesce(candidate, none).alias("candidate"), (i + 1 + skip).alias("next"), F.coalesce(_breaks(a), none).alias("fresh"))

    seen = F.transform(places, lambda i: let(F.get(pieces, i), lambda x: let(F.get(pieces, i - 1), lambda b: let(F.get(pieces, i + 1), lambda a: told(i, x, b, a)))))
    goes_on = lambda x, y: F.coalesce((y["i"] == x["next"]) & y["absorbed"] & ~x["fresh"], none)
    ends = lambda m: F.array_compact(F.transform(m, lambda x, j: F.when(~goes_on(x, F.get(m, j + 1)), j)))
    run = lambda m, e, j, k: let(F.coalesce(F.get(e, k - 1), F.lit(-1)), lambda before: F.slice(m, before + 2, j - before))
    opened = lambda m: let(ends(m), lambda e: F.transform(e, lambda j, k: F.when(F.exists(run(m, e, j, k), lambda x: x["candidate"]), F.get(m, j)["next"] * 2 + 1)))
    broken = lambda s: F.transform(F.filter(s, lambda x: x["breaks"]), lambda x: (x["i"] + 1) * 2)
    edges = F.array(F.when(F.size(pieces) > 0, F.when(_blank(F.get(pieces, F.lit(0))), 2).otherwise(0)), F.size(pieces) * 2)
    every = let(seen, lambda s: F.concat(edges, broken(s), let(F.filter(s, lambda x: ~x["breaks"] & (x["absorbed"] | x["candidate"])), opened)))
    last = lambda v: F.filter(v, lambda x, i: F.coalesce(F.get(v, i + 1) - x > 1, F.lit(True)) | ((x % 2 == 1) & (F.get(v, i + 1) > x)))
    return let(F.array_sort(F.array_compact(every)), last)


def _resumed(docs: DataFrame, ordered: bool = False) -> DataFrame:
    return _lists(docs, ordered).select("doc_id", "text", "l", F.when(F.col("text").rlike("(?i)etc"), _resumes(F.col("l"))).alias("resumes"))


def _parted(pieces: F.Column, resumes: F.Column) -> F.Column:
    """The sentences of a text's list of pieces, in order."""

    def rows(pieces: F.Column, bounds: F.Column) -> F.Column:
        at = lambda k: F.floor(F.get(bounds, k) / 2).cast("int")
        parts = F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda b, k: let(at(k), lambda s: F.slice(pieces, s + 1, at(k + 1) - s)))
        chars = lambda p: F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + F.length(y)))
        counts = lambda p: F.transform(p, lambda x: F.size(F.filter(x, lambda y: ~_blank(y))))
        fresh = lambda p: F.transform(p, lambda _, k: F.when((k == 0) | _breaks(F.get(pieces, at(k) - 1)), 1).otherwise(0))
        lead = F.when(_blank(F.get(pieces, F.lit(0))), F.length(F.get(pieces, F.lit(0)))).otherwise(0)
        row = lambda x, k, c, ce, n, ne, f: F.struct(
            (F.get(f, k) - 1).cast("long").alias("paragraph_ord"), (F.get(ne, k) - F.get(n, k)).cast("long").alias("first"), F.get(n, k).alias("n"), (lead + F.get(ce, k) - F.get(c, k)).cast("long").alias("w_start"),
            (F.get(bounds, k + 1) % 2 == 1).alias("term"), x.alias("pieces"),
        )
        whole = lambda p, c, n: let(running(c), lambda ce: let(running(n), lambda ne: let(running(fresh(p)), lambda f: F.transform(p, lambda x, k: row(x, k, c, ce, n, ne, f)))))
        return let(parts, lambda p: let(chars(p), lambda c: let(counts(p), lambda n: whole(p, c, n))))

    return let(pieces, lambda l: let(resumes, lambda r: let(_bounds(l, r), lambda b: rows(l, b))))  # noqa: E741


def sentence_lists(docs: DataFrame, ordered: bool = False) -> DataFrame:
    """(doc_id, sentence_ord, paragraph_ord, first, n, w_start, term, pieces): each sentence with its pieces, the separator behind it included.

    ``first`` is the place of its first token in the text, ``n`` how many it has, ``term`` tells whether one may end a sentence. With ``ordered`` the
    texts are sorted by doc_id within their partitions, and so are the rows.
    """
    s = _resumed(docs, ordered).select("doc_id", F.posexplode(_parted(F.col("l"), F.col("resumes"))).alias("sentence_ord", "s"))
    return s.select("doc_id", F.col("sentence_ord").cast("long").alias("sentence_ord"), "s.*")


def paired_lists(docs: DataFrame) -> DataFrame:
    """``document_lists`` of texts (doc_id, text, original) that are copies of originals with CRLF as LF; each sentence also has its offset, and offset and pieces in the original: w_start, o_start, o_pieces.

    Tokens are the same in both, and what lies between two of them is one piece in either.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    all_of = lambda c: F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))
    dealt = docs.where("text IS NOT NULL").select("doc_id", "text", "original").repartition(n, "doc_id")
    lists = dealt.select("doc_id", "text", all_of("text").alias("l"), all_of("original").alias("o")).select("doc_id", "l", "o", F.when(F.col("text").rlike("(?i)etc"), _resumes(F.col("l"))).alias("resumes"))
    parted = lists.select("doc_id", "o", F.when(_blank(F.get("l", F.lit(0))), 1).otherwise(0).alias("lead"), _parted(F.col("l"), F.col("resumes")).alias("s"))
    ends = running(F.transform("s", lambda x: F.size(x["pieces"])))
    chars = lambda p: F.aggregate(p, F.lit(0), lambda s, y: s + F.length(y))
    own = lambda x, end: F.slice("o", F.col("lead") + end - F.size(x["pieces"]) + 1, F.size(x["pieces"]))
    row = lambda x, k, o: F.struct(k.cast("long").alias("sentence_ord"), x["paragraph_ord"].alias("paragraph_ord"), x["first"].alias("first"), x["pieces"].alias("pieces"), x["w_start"].alias("w_start"), o.alias("o_pieces"))
    listed = parted.select("doc_id", F.when(F.col("lead") == 1, F.length(F.get("o", F.lit(0)))).otherwise(0).alias("skipped"), let(ends, lambda e: F.transform("s", lambda x, k: row(x, k, own(x, F.get(e, k))))).alias("s"))
    lengths = F.transform("s", lambda x: chars(x["o_pieces"]))
    placed = let(lengths, lambda n: let(running(n), lambda e: F.transform("s", lambda x, k: x.withField("o_start", (F.col("skipped") + F.get(e, k) - F.get(n, k)).cast("long")))))
    return listed.select("doc_id", placed.alias("s"))


def document_lists(docs: DataFrame, ordered: bool = False) -> DataFrame:
    """(doc_id, s): each text with the list of its sentences (sentence_ord, paragraph_ord, first, pieces), as of ``sentence_lists``. With ``ordered`` the texts are sorted by doc_id within their partitions."""
    row = lambda x, k: F.struct(k.cast("long").alias("sentence_ord"), x["paragraph_ord"].alias("paragraph_ord"), x["first"].alias("first"), x["pieces"].alias("pieces"))
    return _resumed(docs, ordered).select("doc_id", F.transform(_parted(F.col("l"), F.col("resumes")), row).alias("s"))


def _sentenced(p: DataFrame) -> DataFrame:
    """Rows of ``_marked`` with opens, sentence_ord and paragraph_ord.

    A sentence goes on until a candidate and the closing marks behind it, or a paragraph's end; ``ended`` tells whether a candidate came
    since the last token that no mark absorbs.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    upto, before = doc.rowsBetween(Window.unboundedPreceding, 0), doc.rowsBetween(Window.unboundedPreceding, -1)
    token = ~F.col("space")
    ended = F.when(F.col("candidate"), 1).when(token & (~F.col("absorbed") | F.col("fresh")), 0)
    p = p.withColumn("paragraph_ord", F.count_if("fresh").over(upto) - 1).withColumn("ended", F.last(ended, ignorenulls=True).over(before))
    p = p.withColumn("opens", F.col("fresh") | (token & ~F.col("absorbed") & F.coalesce(F.col("ended") == 1, F.lit(False))))
    return p.withColumn("sentence_ord", F.count_if("opens").over(upto) - 1)


def units(docs: DataFrame) -> DataFrame:
    """``pieces`` with ord (among tokens, or among separators), paragraph_ord, sentence_ord and term.

    Separators carry the sentence of the token before them; ``inner`` tells that the next token is in it too; ``term`` is 1
    for a token that may end a sentence. Every window is a running one over the pieces of a document, forwards, so a paragraph of
    any length is read in one go.
    """
    doc = Window.partitionBy("doc_id").orderBy("pos")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    space, text = F.col("space"), F.col("text")
    p = _marked(docs).withColumn("w_end", F.sum(F.length(text).cast("long")).over(upto)).withColumn("spaces", F.count_if(space).over(upto))
    p = _sentenced(p).withColumn("inner", space & F.coalesce(~F.lead("opens").over(doc), F.lit(False)))
    ord_ = F.when(space, F.col("spaces") - 1).otherwise(F.col("pos") - F.col("spaces"))
    return p.select("doc_id", "pos", "space", ord_.alias("ord"), "text", (F.col("w_end") - F.length("text")).alias("w_start"), "w_end", "paragraph_ord", "sentence_ord", F.when(~space, F.col("candidate").cast("int")).alias("term"), "inner")


def spaced_tokens(docs: DataFrame, ordered: bool = False) -> DataFrame:
    """``tokens`` with gap, the separator that follows each."""
    one = 1 << 32  # lengths and numbers of tokens are summed as one
    sums = running(F.transform("pieces", lambda x: F.length(x) + F.when(_blank(x), 0).otherwise(one)))
    s = sentence_lists(docs, ordered).select("doc_id", "first", "paragraph_ord", "sentence_ord", "w_start", "pieces", sums.alias("sums"))
    t = s.select("*", F.posexplode(F.when(F.size("pieces") > 0, F.col("pieces"))).alias("i", "text")).where(~_blank(F.col("text")))
    t = t.select("*", F.get("sums", F.col("i")).alias("sum"), F.get("pieces", F.col("i") + 1).alias("a"))
    end = F.col("w_start") + F.col("sum") % one
    gap = F.when(_blank(F.col("a")), F.col("a")).otherwise("")
    return t.select("doc_id", (F.col("first") + F.floor(F.col("sum") / one) - 1).alias("ord"), "text", gap.alias("gap"), (end - F.length("text")).alias("w_start"), end.alias("w_end"), "paragraph_ord", "sentence_ord")


def tokens(docs: DataFrame, ordered: bool = True) -> DataFrame:
    """The tokens of ``units``, in the order of the text within a partition, unless ``ordered`` is false. Only texts are sorted, no tokens."""
    return spaced_tokens(docs, ordered).drop("gap")


def separators(docs: DataFrame) -> DataFrame:
    """What lies between, before and after the tokens."""
    return pieces(docs).where("space").select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("long").alias("ord"), "text", "w_start", "w_end")


def _joined(keep) -> F.Column:
    rows = F.array_sort(F.collect_list(F.when(keep, F.struct("pos", "text"))))
    return F.array_join(F.transform(rows, lambda x: x["text"]), "")


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, paragraph_ord, w_start, w_end, text, gap, tokens, end_rule); gap is the separator that follows.

    Texts are put together from their own pieces, so a long document is not sliced again for each sentence.
    """
    gap = let(F.element_at("pieces", -1), lambda x: F.when(_blank(x), x).otherwise(""))
    s = sentence_lists(docs).withColumn("gap", gap)
    text = F.array_join(F.when(F.col("gap") == "", F.col("pieces")).otherwise(F.slice("pieces", F.lit(1), F.size("pieces") - 1)), "")
    s = s.select("doc_id", F.col("sentence_ord").alias("ord"), "paragraph_ord", "w_start", text.alias("text"), "gap", F.col("n").cast("long").alias("tokens"), F.when(F.col("term"), "terminal").otherwise("paragraph_end").alias("end_rule"))
    return s.select("doc_id", "ord", "paragraph_ord", "w_start", (F.col("w_start") + F.length("text")).alias("w_end"), "text", "gap", "tokens", "end_rule")


def sentences_of(units: DataFrame) -> DataFrame:
    u = units.where("sentence_ord >= 0")
    token = ~F.col("space")
    s = u.groupBy("doc_id", "sentence_ord").agg(
        F.min(F.when(token, F.col("paragraph_ord"))).alias("paragraph_ord"), F.min(F.when(token, F.col("w_start"))).alias("w_start"), F.max(F.when(token, F.col("w_end"))).alias("w_end"),
        _joined(token | F.col("inner")).alias("text"), _joined(F.col("space") & ~F.col("inner")).alias("gap"), F.count_if(token).alias("tokens"), F.max("term").alias("term"),
    )
    return s.select("doc_id", F.col("sentence_ord").alias("ord"), "paragraph_ord", "w_start", "w_end", "text", "gap", "tokens", F.when(F.col("term") == 1, "terminal").otherwise("paragraph_end").alias("end_rule"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, w_start, w_end, sentences, tokens)."""
    s = sentences(docs).groupBy("doc_id", F.col("paragraph_ord").alias("ord"))
    return s.agg(F.min("w_start").alias("w_start"), F.max("w_end").alias("w_end"), F.count(F.lit(1)).alias("sentences"), F.sum("tokens").alias("tokens"))


def paragraphs_of(units: DataFrame) -> DataFrame:
    t = units.where("NOT space")
    return t.groupBy("doc_id", F.col("paragraph_ord").alias("ord")).agg(F.min("w_start").alias("w_start"), F.max("w_end").alias("w_end"), F.count_distinct("sentence_ord").alias("sentences"), F.count(F.lit(1)).alias("tokens"))


def sentence_neighbors(s: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("ord")
    return s.select("doc_id", "ord", F.lag("ord").over(order).alias("previous"), F.lead("ord").over(order).alias("next"))


def unit_lists(docs: DataFrame, ordered: bool = False) -> DataFrame:
    """(doc_id, text, u): each text with the list of its ``units`` (pos, space, ord, text, w_start, w_end, paragraph_ord, sentence_ord), in order.

    Numbers and offsets are summed up within a sentence, so no unit is sorted, grouped or shuffled. With ``ordered`` the texts are sorted by
    doc_id within their partitions.
    """
    one, none = 1 << 32, F.lit(-1).cast("long")  # lengths and numbers of tokens are summed as one
    long = lambda c: c.cast("long")

    def unit(x, i, s, sums, pos):
        chars, tokens, blank = F.get(sums, i) % one, F.shiftright(F.get(sums, i), 32), _blank(x)
        return let(s["w_start"] + chars, lambda end: let(s["first"] + tokens, lambda n: F.struct(
            (pos + i).alias("pos"), blank.alias("space"), F.when(blank, pos + i - n).otherwise(n - 1).alias("ord"), x.alias("text"), (end - F.length(x)).alias("w_start"), end.alias("w_end"), s["paragraph_ord"].alias("paragraph_ord"), long(s["ord"]).alias("sentence_ord"),
        )))

    sums = lambda s: running(F.transform(s["pieces"], lambda x: F.length(x) + F.when(_blank(x), 0).otherwise(F.lit(one))))
    own = lambda s, pos: let(sums(s), lambda v: F.transform(s["pieces"], lambda x, i: unit(x, i, s, v, pos)))
    lead = F.when(_blank(F.get("l", F.lit(0))), F.array(F.struct(
        F.lit(0).alias("pos"), F.lit(True).alias("space"), long(F.lit(0)).alias("ord"), F.get("l", F.lit(0)).alias("text"), long(F.lit(0)).alias("w_start"), long(F.length(F.get("l", F.lit(0)))).alias("w_end"), none.alias("paragraph_ord"), none.alias("sentence_ord"),
    )))
    parted = F.transform(_parted(F.col("l"), F.col("resumes")), lambda s, k: s.withField("ord", k))
    ends = lambda s: running(F.transform(s, lambda x: F.size(x["pieces"])))
    whole = lambda s: let(ends(s), lambda e: let(F.coalesce(lead, F.slice(F.array(lead[0]), 1, 0)), lambda z: F.concat(z, F.flatten(F.transform(s, lambda x, k: own(x, F.size(z) + F.get(e, k) - F.size(x["pieces"])))))))
    return _resumed(docs, ordered).select("doc_id", "text", let(parted, whole).alias("u"))


def tiled(units: DataFrame) -> DataFrame:
    """(doc_id, covered, text): each text of ``unit_lists`` put together again from its tokens and its separators, in their order, and how many code points they cover; texts without any are left out."""
    tiles = lambda u, space: F.transform(F.filter(u, lambda x: x["space"] == space), lambda x: F.struct(x["pos"].alias("pos"), x["text"].alias("text"), (x["w_end"] - x["w_start"]).alias("n")))
    union = let(F.col("u"), lambda u: F.sort_array(F.concat(tiles(u, F.lit(True)), tiles(u, F.lit(False)))))
    text = lambda t: F.array_join(F.transform(t, lambda x: x["text"]), "")
    row = let(union, lambda t: F.when(F.size(t) > 0, F.array(F.struct(F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("covered"), text(t).alias("text")))))
    # Exploded, as a filter on what is computed would be computed once more.
    return units.select("doc_id", F.explode(row).alias("x")).select("doc_id", "x.*")


UNIT = "array<struct<pos:int,space:boolean,ord:bigint,text:string,w_start:bigint,w_end:bigint,paragraph_ord:bigint,sentence_ord:bigint>>"


def check_segmentation(docs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Violations (doc_id, rule) of ``stored`` units (those of the texts, if not given): rows, or a document's list as of ``unit_lists``.

    Ordinals from 0 without gaps, tiling of the text, text equal to its slice, a sentence in one paragraph, and every field equal
    to what the segmentation gives again. All is told from a document's list; only units given as rows are grouped into one.
    """
    rows = unit_lists(docs, ordered=True)
    none = F.array().cast(UNIT)
    if stored is not None:
        if "u" not in stored.columns:
            stored = stored.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "space", "ord", "text", "w_start", "w_end", "paragraph_ord", "sentence_ord"))).alias("u"))
        rows = rows.select("doc_id", "text", F.col("u").alias("again")).join(stored.select("doc_id", F.col("u").cast(UNIT).alias("u")).hint("merge"), "doc_id", "full").withColumn("u", F.coalesce("u", none))
    parts = lambda v: F.sort_array(F.transform(F.filter(v, lambda x: ~x["space"]), lambda x: F.struct(x["sentence_ord"].alias("s"), x["paragraph_ord"].alias("p"))))
    # Sorted, so a sentence's last place is null only where it has no paragraph at all.
    apart = lambda q: F.exists(F.transform(q, lambda x, i: let(F.get(q, i + 1), lambda y: F.when(y["s"].eqNullSafe(x["s"]) & y.isNotNull(), x["p"] != y["p"]).otherwise(x["p"].isNull()))), lambda x: x)

    def rules(v):
        tiled = F.transform(v, lambda x, i: (F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(v, i - 1)["w_end"]) != x["w_start"]) | (x["w_end"] <= x["w_start"]))
        loose = lambda kind: let(F.transform(F.filter(v, lambda x: x["space"].eqNullSafe(F.lit(kind).cast("boolean"))), lambda x: x["ord"]), lambda w: F.array_max(w) != F.size(w) - 1)
        told = [
            F.when(F.exists(tiled, lambda x: x), "tiling"), *[F.when(loose(kind), "dense") for kind in (True, False, None)],
            F.when((F.size(v) > 0) & (F.array_join(F.transform(v, lambda x: x["text"]), "") != F.col("text")), "rebuilt"), F.when(let(parts(v), apart), "sentence_in_paragraph"),
        ]
        if stored is not None:
            told.append(F.when(~F.coalesce("again", none).eqNullSafe(v), "differs"))
        return F.concat_ws(",", *told)

    # Exploded, as a filter on what is computed would be pushed down to before the texts are dealt.
    found = rows.select("doc_id", F.explode(F.array(let(F.col("u"), rules))).alias("rules")).where("rules <> ''")
    return found.select("doc_id", F.explode(F.split("rules", ",")).alias("rule")).distinct()


def sentence_starts(tokens: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, starts): whether a token stands where a sentence starts. Of ``sentence_lists`` alone it is each one's first token, without a join."""
    if sentences is None:
        places = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i)
        return tokens.select("doc_id", "first", F.explode(places).alias("i")).select("doc_id", (F.col("first") + F.col("i")).alias("ord"), (F.col("i") == 0).alias("starts"))
    starts = sentences.select("doc_id", "w_start", F.lit(True).alias("starts"))
    return tokens.select("doc_id", "ord", "w_start").join(starts, ["doc_id", "w_start"], "left").select("doc_id", "ord", F.coalesce("starts", F.lit(False)).alias("starts"))


def clip_paragraphs(paragraphs: DataFrame, start: int, end: int) -> DataFrame:
    """(doc_id, ord, start, end): what of each paragraph lies in [start, end); others are left out."""
    lo, hi = F.greatest("w_start", F.lit(start)), F.least("w_end", F.lit(end))
    return paragraphs.select("doc_id", "ord", lo.cast("long").alias("start"), hi.cast("long").alias("end")).where(F.col("end") > F.col("start"))


def check_gold(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, start, rule) of gold spans (doc_id, start, end, text): overlapping the one before, or not the text's slice."""
    before = F.lag("end", 1, 0).over(Window.partitionBy("doc_id").orderBy("start", "end"))
    rows = gold.withColumn("before", before).join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id")
    same = F.substring("whole", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("text")
    rule = F.when(F.col("end") <= F.col("start"), "empty").when(F.col("start") < F.col("before"), "overlap").when(~same, "text")
    return rows.select("doc_id", "start", rule.alias("rule")).where("rule IS NOT NULL")
