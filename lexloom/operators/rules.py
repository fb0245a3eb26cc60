"""The rule catalogue: triggers over annotated tokens, their nuclei and scopes, suppression and the report.

Every rule is a predicate over a token, its neighbours in the sentence, and its clause; no rule resolves a date or
counts polarities.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.arrays import groups, jump, let, running, spread
from lexloom.functions.text import dep_base
from lexloom.operators import annotate, quotes
from lexloom.operators.annotate import AUXILIARY, QUOTES, VERBAL
from lexloom.session import cut

CATALOGUE_VERSION = "1.1.0"
# Records of the first version keep what it decided: marks may be nuclei and heads, and scopes outside quotations end at none.
VERSIONS = ("1.0.0", CATALOGUE_VERSION)
FAMILIES = ("clauses", "negation", "time", "modality", "connectors")
# The lexicons of the rules.
NEGATORS = {"não": ("simple", ("ADV", "PART"), ("advmod", "neg", "root")), "nunca": ("temporal", ("ADV",), ("advmod", "neg", "root")), "nem": ("additive", ("ADV", "PART", "CCONJ"), ("advmod", "neg", "root", "cc"))}
RELATIVE_TIME = ("ontem", "hoje", "amanhã")
MODAL_VERBS = {"poder": "possibility_open", "dever": "obligation", "precisar": "necessity", "necessitar": "necessity", "querer": "desire", "desejar": "desire", "duvidar": "doubt"}
ABLE_VERBS = ("conseguir", "saber")
MODAL_ADVERBS = {"talvez": "doubt", "possivelmente": "possibility", "provavelmente": "possibility"}
MODAL_ADJECTIVES = {"necessário": "necessity", "obrigatório": "obligation", "capaz": "capacity"}
# Category, part of speech, dependency, and the dependencies of its clause's nucleus.
CONNECTORS = {"porque": ("cause", ("SCONJ",), ("mark",), ("advcl", "ccomp", "root")), "se": ("condition", ("SCONJ",), ("mark",), ("advcl", "root")), "quando": ("time", ("SCONJ", "ADV"), ("mark", "advmod"), ("advcl",))}


def _pick(value, mapping):
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])[value]


class Sentence:
    """A sentence's tokens ``e``, of which the first is ``start``: structs (i, ord, head, own, nucleus, text, lemma, pos, verbform, base, form, infinitive, marked and what ``has`` names); head and own, its owner, are places."""

    def __init__(self, e: Column, start: Column, has: tuple[str, ...] = ()):
        self.e, self.start, self.has = e, start, has
        self.row: Column | None = None  # the sentence as it is listed

    def get(self, ord_: Column) -> Token:
        return Token(F.get(self.e, (ord_ - self.start).cast("int")), self)

    def place(self, i: Column) -> Token:
        return Token(F.get(self.e, i), self)

    def transform(self, use) -> Column:
        return F.transform(self.e, lambda x: use(Token(x, self)))

    def filter(self, use) -> Column:
        return F.filter(self.e, lambda x: use(Token(x, self)))


class Token:
    """A token ``x`` of a sentence. What rules ask of its head, owner and neighbours is looked up only where it is asked."""

    def __init__(self, x: Column, of: Sentence):
        self.x, self.of = x, of

    def __getitem__(self, name: str):
        x, e = self.x, self.of.e
        at = lambda i: (i + self.of.start).cast("long")
        parent = lambda y: F.when(y["head"] != y["i"], at(F.get(e, y["head"])["own"]))
        beside = lambda k: F.get(e, x["i"] + k)
        near = {"owner": lambda: at(x["own"]), "head_ord": lambda: at(x["head"]), "parent": lambda: parent(x), "o_base": lambda: F.get(e, x["own"])["base"], "o_parent": lambda: let(F.get(e, x["own"]), parent), "next": lambda: beside(1)["form"], "before": lambda: beside(-1)["form"]}
        if name in near:
            return near[name]()
        if name in ("next_row", "before_row"):
            y = beside(1 if name == "next_row" else -1)
            return {"ord": at(y["i"]), "pos": y["pos"], "base": y["base"], "owner": at(y["own"]), "head_ord": at(y["head"])}
        if name.startswith("h_"):
            return at(F.get(e, x["head"])["head"]) if name == "h_head" else F.get(e, x["head"])[name[2:]]
        if name in ("tense", "mood") and name not in self.of.has:
            return F.lit(None).cast("string")
        return F.lit(False) if name == "legacy" and name not in self.of.has else x[name]


def _sentence(r: Column, start: Column, has: list[str], use, place=None) -> Column:
    """``use`` of the ``Sentence`` of a list r of tokens with the fields ``has``; ``place(x, i, told)`` gives region, closed and nested to ``told``, by name. ``version`` tells what is legacy."""
    legacy = (lambda x: F.coalesce(x["version"] == VERSIONS[0], F.lit(False))) if "version" in has else None
    more = [c for c in ("tense", "mood") if c in has]
    text = lambda x, c: x[c] if c in has else F.lit(None).cast("string")
    known = (*more, *(["legacy"] if legacy else []), *(["region", "closed", "nested"] if place else []))

    def tokens(b: Column, h: Column, n: Column, o: Column, infinitives: Column, markers: Column) -> Column:
        def row(x: Column, i: Column, **where: Column) -> Column:
            fields = {
                "i": i, "ord": (i + start).cast("long"), "head": F.get(h, i), "own": F.get(o, i), "nucleus": F.get(n, i), **{c: text(x, c) for c in ("text", "lemma", "pos", "verbform", *more)}, **({"legacy": legacy(x)} if legacy else {}), "base": F.get(b, i), "form": F.lower(x["text"]),
                "infinitive": F.when(x["lemma"].isin(*ABLE_VERBS), F.array_contains(infinitives, i)), "marked": F.when(x["lemma"] == "ter", F.array_contains(markers, i)), **where,
            }
            return F.struct(*[c.alias(name) for name, c in fields.items()])

        return F.transform(r, lambda x, i: place(x, i, lambda **where: row(x, i, **where)) if place else row(x, i))

    def told(b: Column, h: Column) -> Column:
        copula_heads = F.array_compact(F.transform(b, lambda v, i: F.when(v == "cop", F.get(h, i))))
        verbal = lambda x, i: F.coalesce(x["pos"].isin(*VERBAL) & ~F.get(b, i).isin(*AUXILIARY), F.lit(False))
        unmarked = lambda x: ~x["text"].isin(*QUOTES) | (legacy(x) if legacy else F.lit(False))
        nuclei = let(copula_heads, lambda cop: F.transform(r, lambda x, i: (verbal(x, i) | F.array_contains(cop, i)) & unmarked(x)))
        owners = lambda n: let(jump(F.transform(h, lambda k, i: F.when(F.get(n, i), i).otherwise(k))), lambda ends: F.transform(ends, lambda k: F.when(F.get(n, k), k)))
        # Heads of infinitive complements, and heads of verbal complements with a marker.
        infinitives = F.array_compact(F.transform(r, lambda x, i: F.when((text(x, "verbform") == "Inf") & x["pos"].isin(*VERBAL) & (F.get(b, i) == "xcomp") & (F.get(h, i) != i), F.get(h, i))))
        complement = lambda k: F.get(r, k)["pos"].isin(*VERBAL) & F.get(b, k).isin("xcomp", "ccomp")
        markers = F.array_compact(F.transform(r, lambda x, i: F.when(F.get(b, i).isin("mark", "case") & F.lower(x["text"]).isin("que", "de") & complement(F.get(h, i)), F.get(h, F.get(h, i)))))
        whole = lambda n: let(F.struct(owners(n).alias("o"), infinitives.alias("inf"), markers.alias("mar")), lambda z: let(tokens(b, h, n, z["o"], z["inf"], z["mar"]), lambda e: use(Sentence(e, start, known))))
        return let(nuclei, whole)

    bases, heads = F.transform(r, lambda x: dep_base(x["dep"])), F.transform(r, lambda x: (x["head_ord"] - start).cast("int"))
    return let(bases, lambda b: let(heads, lambda h: told(b, h)))


def enriched(tokens: DataFrame) -> DataFrame:
    """Tokens with clause owner and parent, form, base dependency, neighbours, and what the rules ask of head, owner and dependents.

    ``tokens`` has verbform (and may have tense and mood, and version, of which a document has one: each record is read by the rules of its
    own; without it by the present ones). Head, owner, neighbours, complements and their markers are looked up in the sentence's array, in
    which all heads lie, so no token is joined, shuffled again or written. ``infinitive`` and ``marked`` are told for the lemmas that ask.
    """
    own = [c for c in tokens.columns if c not in ("doc_id", "sentence_ord", "ord", "head_ord")]
    g = tokens if "r" in tokens.columns else tokens.groupBy("doc_id", "sentence_ord").agg(F.array_sort(F.collect_list(F.struct("ord", "head_ord", *own))).alias("r"), F.min("ord").alias("start"))
    has = g.schema["r"].dataType.elementType.names

    def row(x: Token) -> Column:
        after, before = x["next_row"], x["before_row"]
        return F.struct(
            *[x[c].alias(c) for c in ("ord", "head_ord", "text", "lemma", "pos", "verbform", "tense", "mood", "legacy", "form", "base", "nucleus", "owner", "parent", "h_nucleus", "h_base", "h_pos", "h_text", "h_head", "o_base", "o_parent", "next", "before")],
            F.when(after["ord"].isNotNull(), F.struct(*[after[c].alias(c) for c in ("pos", "owner")])).alias("next_row"), F.when(before["ord"].isNotNull(), F.struct(*[before[c].alias(c) for c in ("ord", "pos", "base", "head_ord")])).alias("before_row"),
            *[x[c].alias(c) for c in ("infinitive", "marked")],
        )

    rows = _sentence(F.col("r"), F.col("start"), has, lambda s: s.transform(row))
    return g.select("doc_id", "sentence_ord", F.explode(rows).alias("y")).select("doc_id", "sentence_ord", "y.*")


def by_sentence(tokens: DataFrame, use, whence: bool = False, apart: bool = False) -> DataFrame:
    """(doc_id, y): ``use`` (sentence_ord, start, e) of each sentence with its tokens e (``Sentence``), with region, closed and nested (``quotes.placed``),
    with ``whence`` also the sentence in which that region opens.

    All is told from a document's list: no token is a row, none is sorted, joined, shuffled or written. Documents given as rows are grouped first.
    With ``apart`` y has what the version of the tokens makes of a sentence (own) and what the present one does (present), for the sentences that the two
    may read differently: those of an earlier version with a quotation mark, as all that changed is about marks; null for others.
    """
    d = annotate.document_arrays(tokens)
    has = d.schema["s"].dataType.elementType["r"].dataType.elementType.names

    def each(y: Column, place) -> Column:
        def told(e: Sentence) -> Column:
            e.row, e.has = y, (*e.has, *(["whence"] if whence else []))
            return use(y["sentence_ord"], y["start"], e)

        if not apart:
            return _sentence(y["r"], y["start"], has, told, place)
        both = F.struct(_sentence(y["r"], y["start"], has, told, place).alias("own"), _sentence(y["r"], y["start"], [c for c in has if c != "version"], told, place).alias("present"))
        return F.when((F.get(y["r"], F.lit(0))["version"] == VERSIONS[0]) & F.exists(y["r"], lambda x: x["text"].isin(*QUOTES)), both)

    def placed(tops: Column, w: Column):
        def place(x: Column, i: Column, told) -> Column:
            of = lambda top: let(quotes.region(x, top), lambda g: told(region=g, closed=g.isNull() | top["closed"], nested=g.isNotNull() & top["deep"], **({"whence": F.when(g.isNotNull(), top["sentence_ord"])} if whence else {})))
            return let(F.get(tops, F.get(w, i)), of)

        return place

    return d.select("doc_id", quotes.around(F.col("s"), lambda tops, at: F.transform("s", lambda y, k: let(at(y, k), lambda w: each(y, placed(tops, w))))).alias("y"))


def regions(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, region, closed) for tokens, or those in ``of``: the innermost quotation around each and whether it is closed (true outside all)."""
    closed = quotes.quote_regions(rows).where("close IS NOT NULL").select("doc_id", F.col("open").alias("region"), F.lit(True).alias("closed"))
    return quotes.innermost(rows, of).join(closed, ["doc_id", "region"], "left").select("doc_id", "ord", "region", (F.col("region").isNull() | F.coalesce("closed", F.lit(False))).alias("closed"))


def _matched(candidates) -> list[list[int]]:
    """Pairs of one sentence, linear in its candidates (second, ord, owner, parent of a coordinated owner or -1, region or -1), which come in order.

    Each first takes the earliest later second that no first before it took, in the same region, whose owner is its own or is
    coordinated with it.
    """
    of_owner, of_parent, taken, pairs = defaultdict(deque), defaultdict(deque), set(), []
    for second, place, owner, parent, region in candidates:
        if second:
            of_owner[region, owner].append(place)
            of_parent[region, parent].append(place)
    for second, place, owner, parent, region in candidates:
        if second:
            continue
        heads = []
        for queue in (of_owner[region, owner], of_parent[region, owner], of_owner[region, parent]):
            while queue and (queue[0] <= place + 1 or queue[0] in taken):
                queue.popleft()  # firsts come in order, so it is of no use to later ones either
            if queue:
                heads.append(queue[0])
        if heads:
            taken.add(min(heads))
            pairs.append([place, min(heads)])
    return pairs


def _halves(c) -> tuple[Column, Column, Column]:
    """Whether an ``enriched`` token, of which ``c`` gives a field, is the first or the second half's first word, and what both need."""
    a = (c("form") == "não") & c("next").isin("só", "somente", "apenas") & c("pos").isin("ADV", "PART") & c("base").isin("advmod", "neg")
    b = (c("form") == "mas") & (c("next") == "também") & (c("pos") == "CCONJ") & (c("base") == "cc") & (c("next_row")["owner"] == c("owner"))
    return a, b, (c("next_row")["pos"] == "ADV") & c("owner").isNotNull()


def paired(e: Sentence, start: Column) -> Column:
    """``owned_pairs`` (first, second, owner, other: the owners of both) of a sentence of ``by_sentence``, in order of the firsts.

    Only halves are compared, each first with the seconds of its sentence.
    """
    def half(x: Token) -> Column:
        a, b, whole = _halves(lambda name: x[name])
        near = e.place(x["own"])["region"]
        return (a | b) & whole & ((x["region"].eqNullSafe(near) & x["closed"]) | (x["legacy"] & x["region"].isNull()))

    parent = lambda x: F.when(x["o_base"] == "conj", x["o_parent"])
    word = lambda x: F.struct(x["ord"].alias("ord"), (x["form"] == "mas").alias("second"), x["owner"].alias("owner"), parent(x).alias("parent"), x["region"].alias("region"))
    words = F.transform(e.filter(half), lambda x: word(Token(x, e)))
    fits = lambda f, s: (s["ord"] > f["ord"] + 1) & s["region"].eqNullSafe(f["region"]) & ((s["owner"] == f["owner"]) | F.coalesce(s["parent"] == f["owner"], F.lit(False)) | F.coalesce(f["parent"] == s["owner"], F.lit(False)))
    none = F.array().cast("array<struct<first:bigint,second:bigint,owner:bigint,other:bigint>>")
    pair = lambda f, s: F.when(s.isNotNull(), F.array(F.struct(f["ord"].alias("first"), s["ord"].alias("second"), f["owner"].alias("owner"), s["owner"].alias("other"))))

    def match(firsts: Column, seconds: Column) -> Column:
        open_ = lambda done, f: F.get(F.filter(seconds, lambda s: fits(f, s) & ~F.exists(done, lambda d: d["second"] == s["ord"])), 0)
        return F.aggregate(firsts, none, lambda done, f: let(open_(done, f), lambda s: F.concat(done, F.coalesce(pair(f, s), none))))

    return let(words, lambda w: let(F.filter(w, lambda x: x["second"]), lambda seconds: F.when(F.size(seconds) > 0, match(F.filter(w, lambda x: ~x["second"]), seconds)).otherwise(none)))


def correlatives(rows: DataFrame) -> DataFrame:
    """(doc_id, sentence_ord, first, second) of ``owned_pairs``."""
    return owned_pairs(rows).drop("owner")


def owned_pairs(rows: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """(doc_id, sentence_ord, first, second, owner of the first): "não só" with a later "mas também" of its sentence, one to one.
    Regions are those of ``tokens``, if given, else of the rows, which have the same texts.

    The words have the parts of speech and dependencies of the construction, "mas também" one owner, and the owners of both halves are
    equal or coordinated. Each half stands in its owner's region, both in the same one, which is closed.
    """
    a, b, whole = _halves(F.col)
    halves = cut(rows.where((a | b) & whole).select("doc_id", "sentence_ord", "ord", "owner", "legacy", b.alias("is_second"), F.when(F.col("o_base") == "conj", F.col("o_parent")).alias("parent")))
    place = cut(regions(rows if tokens is None else tokens, halves.select("doc_id", F.explode(F.array("ord", "owner")).alias("ord")).distinct()))
    mine = halves.join(place, ["doc_id", "ord"]).join(place.select("doc_id", F.col("ord").alias("owner"), F.col("region").alias("o_region")), ["doc_id", "owner"]).where((F.col("region").eqNullSafe(F.col("o_region")) & F.col("closed")) | (F.col("legacy") & F.col("region").isNull()))
    none = F.lit(-1)
    row = F.array(F.col("ord"), F.col("is_second").cast("long"), F.col("owner"), F.coalesce("parent", none), F.coalesce("region", none))
    sentence = mine.groupBy("doc_id", "sentence_ord").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.array(x[1], x[0], x[2], x[3], x[4])).alias("halves"))

    @F.pandas_udf("array<array<bigint>>")
    def matched(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _matched([x.tolist() for x in v]))

    pairs = sentence.select("doc_id", "sentence_ord", F.explode(matched("halves")).alias("x")).select("doc_id", "sentence_ord", F.col("x")[0].alias("first"), F.col("x")[1].alias("second"))
    return pairs.join(halves.select("doc_id", F.col("ord").alias("first"), "owner"), ["doc_id", "first"]).select("doc_id", "sentence_ord", "first", "second", "owner")


def occurrences(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence_ord, ord, rule, family, category, nucleus): every marker that a rule finds.

    Members of a correlative are suppressed for negation and connectors. Told within sentences, as all of ``by_sentence`` is.
    """
    rows = _listed(tokens).select("doc_id", F.explode(let(F.col("y"), lambda y: y)).alias("y")).select("doc_id", "y.sentence_ord", F.explode("y.found").alias("x"))
    return rows.select("doc_id", "sentence_ord", *[f"x.{c}" for c in ("ord", "rule", "family", "category", "nucleus")])


def _listed(tokens: DataFrame) -> DataFrame:
    return by_sentence(tokens, lambda ord_, start, e: let(paired(e, start), lambda p: F.struct(ord_.alias("sentence_ord"), listed(e, p).alias("found"))))


def occurrence_lists(tokens: DataFrame) -> DataFrame:
    """(doc_id, l): the ``occurrences`` (sentence_ord, ord, rule, family, category, nucleus) of each document, as a list."""
    row = lambda y, x: F.struct(y["sentence_ord"].alias("sentence_ord"), *[x[c].alias(c) for c in ("ord", "rule", "family", "category", "nucleus")])
    return _listed(tokens).select("doc_id", F.flatten(F.transform("y", lambda y: F.transform(y["found"], lambda x: row(y, x)))).alias("l"))


def hits(c, family: str | None = None) -> list[Column]:
    """For each rule, or those of a family, its struct (rule, family, category) where it finds an ``enriched`` token, of which ``c`` gives a field; else null."""
    form, pos, base, lemma = c("form"), c("pos"), c("base"), c("lemma")
    found = []

    def add(when: Column, rule: str, of: str, category) -> None:
        if family in (None, of):
            found.append(F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(of).alias("family"), (F.lit(category) if isinstance(category, str) else category).alias("category"))))

    add(c("nucleus"), "clause", "clauses", "clause")
    for word, (category, tags, deps) in NEGATORS.items():
        add((form == word) & pos.isin(*tags) & base.isin(*deps), f"negation_{word}", "negation", category)
    add(form.isin(*RELATIVE_TIME) & (pos == "ADV") & base.isin("advmod", "obl", "npadvmod"), "relative_time", "time", "relative")
    add((form == "quando") & pos.isin("SCONJ", "ADV") & base.isin("mark", "advmod") & (c("o_base") == "advcl"), "relative_time", "time", "construction")
    verb = pos.isin(*VERBAL)
    add(verb & F.coalesce(c("tense"), c("mood"), c("verbform")).isNotNull(), "verb_inflection", "time", "inflection")
    add(verb & lemma.isin(*MODAL_VERBS), "modal_verb", "modality", _pick(lemma, MODAL_VERBS))
    add(verb & lemma.isin(*ABLE_VERBS) & c("infinitive"), "modal_verb", "modality", "capacity")
    add(verb & (lemma == "ter") & c("marked"), "modal_verb", "modality", "obligation")
    add((pos == "ADV") & base.isin("advmod", "discourse") & form.isin(*MODAL_ADVERBS), "modal_adverb", "modality", _pick(form, MODAL_ADVERBS))
    add((pos == "ADJ") & c("nucleus") & lemma.isin(*MODAL_ADJECTIVES), "modal_adjective", "modality", _pick(lemma, MODAL_ADJECTIVES))
    add((form == "mas") & (pos == "CCONJ") & (base == "cc") & c("h_nucleus") & (c("h_base") == "conj") & c("owner").isNotNull(), "connector_mas", "connectors", "contrast")
    for word, (category, tags, deps, clauses_) in CONNECTORS.items():
        add((form == word) & pos.isin(*tags) & base.isin(*deps) & c("o_base").isin(*clauses_), f"connector_{word}", "connectors", category)
    by = c("before_row")
    therefore = (form == "isso") & (c("before") == "por") & (by["pos"] == "ADP") & (by["base"] == "case") & (by["head_ord"] == c("ord")) & pos.isin("PRON", "ADV") & base.isin("obl", "advmod") & (by["ord"] < c("owner"))
    add(therefore, "therefore", "connectors", "consequence")
    return found


def found(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``occurrences`` from ``enriched`` rows and their ``correlatives``."""
    members = pairs.select("doc_id", F.explode(F.array("first", "second")).alias("ord")).withColumn("member", F.lit(True))
    each = rows.select("doc_id", "sentence_ord", "ord", F.col("owner").alias("nucleus"), F.explode(F.array_compact(F.array(*hits(F.col)))).alias("h"))
    single = each.select("doc_id", "sentence_ord", "ord", "h.rule", "h.family", "h.category", "nucleus")
    # Only the few columns of what was found meet the members.
    freed = F.col("rule").startswith("negation_") | F.col("rule").startswith("connector_")
    single = single.join(members, ["doc_id", "ord"], "left").where(F.col("member").isNull() | ~freed).select("doc_id", "sentence_ord", "ord", "rule", "family", "category", "nucleus")
    if "owner" not in pairs.columns:
        pairs = pairs.join(rows.select("doc_id", F.col("ord").alias("first"), "owner"), ["doc_id", "first"])
    both = pairs.select("doc_id", "sentence_ord", F.col("first").alias("ord"), F.lit("correlative").alias("rule"), F.lit("negation").alias("family"), F.lit("correlative_addition").alias("category"), F.col("owner").alias("nucleus"))
    return single.unionByName(both)


def ordered(found: DataFrame) -> DataFrame:
    """Occurrences with their place in the document: by marker, rule and category."""
    order = Window.partitionBy("doc_id").orderBy("ord", "rule", "category", F.col("nucleus").asc_nulls_first())
    return found.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def listed(e: Sentence, pairs: Column) -> Column:
    """``found`` of a sentence of ``by_sentence`` and its ``paired``, as structs (ord, rule, category, nucleus, family) in the order of ``ordered``."""
    row = lambda x, h: F.struct(x["ord"].alias("ord"), h["rule"].alias("rule"), h["category"].alias("category"), x["owner"].alias("nucleus"), h["family"].alias("family"))
    freed = lambda h: h["rule"].startswith("negation_") | h["rule"].startswith("connector_")
    members = F.flatten(F.transform(pairs, lambda p: F.array(p["first"], p["second"])))
    own = lambda m: F.flatten(e.transform(lambda x: F.transform(F.filter(F.array(*hits(lambda c: x[c])), lambda h: h.isNotNull() & ~(F.array_contains(m, x["ord"]) & freed(h))), lambda h: row(x, h))))
    both = F.transform(pairs, lambda p: F.struct(p["first"].alias("ord"), F.lit("correlative").alias("rule"), F.lit("correlative_addition").alias("category"), p["owner"].alias("nucleus"), F.lit("negation").alias("family")))
    return F.sort_array(F.concat(let(members, own), both))


def multiple_negation(found: DataFrame) -> DataFrame:
    """(doc_id, sentence_ord, nucleus, markers): nuclei with two negators or more."""
    negators = found.where("family = 'negation' AND rule LIKE 'negation_%' AND nucleus IS NOT NULL")
    return negators.groupBy("doc_id", "sentence_ord", "nucleus").agg(F.count(F.lit(1)).alias("markers")).where("markers >= 2")


def scopes(tokens: DataFrame, listed_runs: bool = True) -> DataFrame:
    """(doc_id, ord, rule, scope_tokens, fragments, slices): for each occurrence with a nucleus that one's own tokens, and the runs [first, last] of consecutive ones among them (left out without ``listed_runs``).

    A sentence's tokens are sorted by their nucleus, as numbers, so that each nucleus owns a stretch of them.
    """
    one = 1 << 32

    def sentence(ord_: Column, start: Column, e: Sentence) -> Column:
        own = F.sort_array(F.array_compact(e.transform(lambda x: x["own"] * F.lit(one) + x["i"])))
        mine = F.transform(F.filter(let(paired(e, start), lambda p: listed(e, p)), lambda o: o["nucleus"].isNotNull()), lambda o: F.struct(o["ord"].alias("ord"), o["rule"].alias("rule"), (o["nucleus"] - start).alias("key")))
        return F.struct(start.alias("start"), own.alias("v"), mine.alias("found"))

    run = lambda v: F.transform(v, lambda x, i: F.when((i > 0) & (F.get(v, i - 1) == x - 1), 0).otherwise(1))
    at = lambda x: (x % one + F.col("start")).cast("long")
    firsts = lambda w: F.filter(w, lambda x, i: (i == 0) | (F.get(w, i - 1) != x - 1))
    lasts = lambda w: F.filter(w, lambda x, i: (i == F.size(w) - 1) | (F.get(w, i + 1) != x + 1))
    slices = lambda v, g: let(F.slice(v, g["at"] + 1, g["n"]), lambda w: F.zip_with(firsts(w), lasts(w), lambda a, z: F.struct(at(a).alias("first"), at(z).alias("last"))))

    def scope(v: Column, runs: Column, g: Column) -> Column:
        count = F.get(runs, g["at"] + g["n"] - 1) - F.get(runs, g["at"]) + 1
        return F.struct(g["n"].cast("long").alias("scope_tokens"), count.cast("long").alias("fragments"), *([slices(v, g).alias("slices")] if listed_runs else []))

    def told(g: Column, each: Column, places: Column) -> Column:
        of = lambda o: F.get(each, F.get(places, (o["key"] - F.get(g, F.lit(0))["key"]).cast("int")))
        return F.transform("found", lambda o: F.struct(o["ord"].alias("ord"), o["rule"].alias("rule"), of(o).alias("z")))

    y = by_sentence(tokens, sentence).select("doc_id", F.explode(let(F.col("y"), lambda y: F.filter(y, lambda x: F.size(x["found"]) > 0))).alias("y")).select("doc_id", "y.*")
    y = y.select("doc_id", "start", "found", "v", running(run(F.col("v"))).alias("runs"), groups(F.transform("v", lambda x: F.shiftright(x, 32))).alias("g"))
    each = let(F.transform("g", lambda x: scope(F.col("v"), F.col("runs"), x)), lambda s: let(spread(F.col("g")), lambda places: told(F.col("g"), s, places)))
    return y.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.ord", "x.rule", "x.z.*")


def negated(allowed: Column, c=F.col) -> tuple[Column, Column]:
    """What a negator of ``enriched``, of which ``c`` gives a field, modifies, and whether that is a constituent rather than a clause's nucleus. Null with a delimiter, or a word of no part of speech, as its head."""
    head, delimited = c("head_ord") != c("ord"), c("h_text").isin(*QUOTES) & ~c("legacy")
    other = allowed & head & ~c("h_nucleus") & ~F.coalesce(c("h_base").isin(*AUXILIARY), F.lit(False)) & ~delimited
    return F.when(delimited, None).when(allowed & head & c("h_pos").isNull(), None).when(other, c("head_ord")).otherwise(c("owner")), other


def negation_scopes(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence_ord, ord, nucleus, constituent, allowed, region, scope_tokens, slices): what each negator modifies, and its scope.

    A negator that hangs from no clause's nucleus, nor from an auxiliary, negates that constituent, and its scope is the constituent's subtree; else
    it is what its clause's nucleus owns. Scopes end at the quotation: only tokens in the marker's region count, and no delimiters; there is no
    scope where the nucleus lies in another region or the marker's region stays open. In a quotation a word that is no negator by its
    annotations is mentioned, not allowed, and has neither nucleus nor scope. Without part of speech of the head, or with a delimiter as head, there is
    no nucleus. Members of a correlative are left out. ``slices`` are the runs [first, last] of consecutive tokens; null where there is no scope.

    In records of version 1.0.0 (column ``version``) marks may be nuclei and heads, scopes of markers outside quotations hold all tokens, and
    inside one the region's, with marks that open or close nothing.
    """

    from lexloom.operators import members  # it needs the rules

    return members.scoped(tokens, negators).select("doc_id", "sentence_ord", scope_row(F.col).alias("x")).select("doc_id", "sentence_ord", "x.*")


def scope_row(c) -> Column:
    """A row of ``negation_scopes`` from what ``members.scoped`` gives of ``negators``, of which ``c`` gives a field."""
    row = c("row")
    return F.struct(
        row["ord"].alias("ord"), row["nucleus"].alias("nucleus"), (row["constituent"] & row["nucleus"].isNotNull()).alias("constituent"), row["allowed"].alias("allowed"), row["region"].alias("region"),
        F.when(c("met") > 0, c("met")).alias("scope_tokens"), c("slices").alias("slices"),
    )


def negators(e: Sentence, start: Column) -> Column:
    """The negators of a sentence, as structs of a row and what is asked for its scope (``members.scoped``)."""
    from lexloom.operators import members  # it needs the rules

    none = F.array().cast("array<bigint>")

    def negator(x: Token, e: Sentence, start: Column) -> Column:
        form, c = x["form"], lambda name: x[name]
        allowed = F.coalesce(F.coalesce(*[F.when(form == w, x["pos"].isin(*tags) & x["base"].isin(*deps)) for w, (_, tags, deps) in NEGATORS.items()]), F.lit(False))

        def told(of: Column, other: Column) -> Column:
            same = of.isNotNull() & x["region"].eqNullSafe(e.get(of)["region"])
            asks = (same | (of.isNotNull() & x["legacy"] & x["region"].isNull())) & allowed & x["closed"]
            row = F.struct(x["ord"].alias("ord"), F.when(x["region"].isNull() | same, of).alias("nucleus"), other.alias("constituent"), allowed.alias("allowed"), x["region"].alias("region"))
            return F.struct(row.alias("row"), F.when(asks, members.ask(x["region"], F.when(other, none).otherwise(F.array(of - start)), F.when(other, F.array(of - start)).otherwise(none), x["legacy"] & x["region"].isNull(), x["legacy"])).alias("ask"))

        of, other = negated(allowed, c)
        return F.when(allowed | x["region"].isNotNull(), let(of, lambda n: let(F.coalesce(other & x["h_pos"].isNotNull(), F.lit(False)), lambda o: told(n, o))))

    paired_ = F.flatten(F.transform(paired(e, start), lambda p: F.array(p["first"], p["second"])))
    return let(paired_, lambda m: F.array_compact(F.transform(e.filter(lambda x: x["form"].isin(*NEGATORS) & ~F.array_contains(m, x["ord"])), lambda x: negator(Token(x, e), e, start))))


def pending(tokens: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, ord, columns to keep, rule, field): tokens whose missing annotation keeps a rule from deciding."""
    t = tokens.withColumn("form", F.lower("text"))
    no_pos = F.col("pos").isNull()
    words = (*NEGATORS, "só", "somente", "apenas", "mas", "também", *RELATIVE_TIME, *CONNECTORS, *MODAL_ADVERBS)
    ask = lambda rule, field: F.struct(F.lit(rule).alias("rule"), F.lit(field).alias("field"))
    verb = F.col("pos").isin(*VERBAL)
    asked = F.array(
        *[F.when(no_pos, ask(rule, "pos")) for rule in ("clause", "verb_inflection", "modal_verb")], F.when(no_pos & F.col("form").isin(*words), ask("word", "pos")),
        F.when(verb & F.col("lemma").isNull(), ask("modal_verb", "lemma")), F.when(verb & F.col("verbform").isNull(), ask("verb_inflection", "verbform")),
    )
    return t.select("doc_id", "ord", *keep, F.explode(F.filter(asked, lambda x: x.isNotNull())).alias("x")).select("doc_id", "ord", *keep, "x.*")


def report(found: DataFrame) -> DataFrame:
    """(family, category, n): totals for each family and category."""
    return found.groupBy("family", "category").agg(F.count(F.lit(1)).alias("n"))
