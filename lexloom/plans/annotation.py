"""Queries of annotated tokens. The tables hold no annotations, so the queries derive them from the tokens.

A token's form, lemma, part of speech and dependency come from a fixed list by a number that steps with its place; the
heads of a sentence form a binary heap (the first token is the root).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions.arrays import let
from lexloom.operators import annotate, quotes, rules, segment
from lexloom.plans.registry import Registry, table
from lexloom.plans.segmentation import TOKENS, crlf

R = Registry()
# Form, lemma, part of speech, dependency.
PALETTE = (
    ("não", "não", "ADV", "advmod"), ("só", "só", "ADV", "advmod"), ("compra", "comprar", "VERB", "conj"), ("mas", "mas", "CCONJ", "cc"), ("também", "também", "ADV", "advmod"), ("vende", "vender", "VERB", "conj"),
    ("nunca", "nunca", "ADV", "advmod"), ("nem", "nem", "CCONJ", "cc"), ("deve", "dever", "VERB", "xcomp"), ("pode", "poder", "AUX", "aux"), ("hoje", "hoje", "ADV", "advmod"), ("quando", "quando", "SCONJ", "mark"),
    ("foi", "ser", "AUX", "cop"), ("livro", "livro", "NOUN", "obj"), ("por", "por", "ADP", "case"), ("isso", "isso", "PRON", "obl"), ("porque", "porque", "SCONJ", "mark"), ("se", "se", "SCONJ", "mark"),
    ("talvez", "talvez", "ADV", "advmod"), ("casa", "casa", "NOUN", "nsubj"), (".", ".", "PUNCT", "punct"), ("disse", "dizer", "VERB", "ccomp"), ("xyz", None, None, "nmod"), ("não", "não", "ADV", "advmod"),
    ("necessário", "necessário", "ADJ", "advcl"), ("consegue", "conseguir", "VERB", "conj"), ("sair", "sair", "VERB", "xcomp"), ("tem", "ter", "VERB", "advcl"), ("que", "que", "SCONJ", "mark"), ("necessitou", None, "VERB", "ccomp"), ("só", None, None, "advmod"),
)

# What full stops of the derived tokens stand for, by their place.
MARKED = ("“", "«", "”", '"', "»", '"')


def annotated_lists(spark, sf_dir, docs=None, quoted=False):
    """Sentences with the list r of their tokens; with ``quoted`` full stops stand for quotation marks, by their place."""
    s = segment.sentence_lists(crlf(spark, sf_dir) if docs is None else docs)
    return s.select("doc_id", "sentence_ord", F.col("first").alias("start"), _annotated(F.col("pieces"), F.col("first"), quoted).alias("r"))


def annotated_documents(spark, sf_dir, docs=None, quoted=False, ordered=False, **more):
    """Documents with the list s of their sentences, of which each lists its tokens; ``more`` gives further fields of every token. Of ``docs`` with originals sentences keep their pieces (``segment.paired_lists``)."""
    paired = docs is not None and "original" in docs.columns
    d = segment.paired_lists(docs) if paired else segment.document_lists(crlf(spark, sf_dir) if docs is None else docs, ordered)
    kept = ("paragraph_ord", *(("pieces", "w_start", "o_pieces", "o_start") if paired else ()))
    return d.select("doc_id", F.transform("s", lambda y: F.struct(y["sentence_ord"].alias("sentence_ord"), y["first"].alias("start"), _annotated(y["pieces"], y["first"], quoted, **more).alias("r"), *[y[c].alias(c) for c in kept])).alias("s"))


def _annotated(pieces, start, quoted, **more):
    forms = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(("text", "lemma", "pos", "dep", "verbform"), (*p, _verbform(p)), strict=True)]) for p in PALETTE])

    def token(x, i):
        at, head = start + i, F.when(i == 0, start).otherwise(start + F.floor((i - 1) / 2))
        text = (lambda t: F.when(t == ".", F.get(F.array(*[F.lit(m) for m in MARKED]), (at % 6).cast("int"))).otherwise(t)) if quoted else (lambda t: t)
        form = F.get(forms, ((at + F.col("doc_id") + F.floor(F.length(x) / 4)) % len(PALETTE)).cast("int"))
        own = [c.alias(name) for name, c in more.items()]
        return let(form, lambda f: F.struct(at.alias("ord"), head.alias("head_ord"), text(f["text"]).alias("text"), f["lemma"].alias("lemma"), f["pos"].alias("pos"), F.when(i == 0, "ROOT").otherwise(f["dep"]).alias("dep"), f["verbform"].alias("verbform"), *own))

    return F.transform(F.filter(pieces, lambda x: ~segment._blank(x)), token)


def _verbform(entry):
    form, lemma, pos, _ = entry
    return None if pos not in ("VERB", "AUX") or lemma is None else "Inf" if lemma == form else "Fin"


def annotated(spark, sf_dir, docs=None):
    return annotate.token_rows(annotated_lists(spark, sf_dir, docs)).select("doc_id", "sentence_ord", "ord", "text", "lemma", "pos", "dep", "head_ord", "verbform")


_rows = ", ".join("(" + str(k) + ", " + ", ".join("NULL" if x is None else f"'{x}'" for x in p) + ")" for k, p in enumerate(PALETTE))
ANN = TOKENS + f""", pal(h, form, lemma, pos, dep) AS (VALUES {_rows}),
an0 AS (SELECT doc_id, sentence_ord::BIGINT AS sentence_ord, ord, min(ord) OVER (PARTITION BY doc_id, sentence_ord) AS start, (ord + doc_id + length(text) // 4) % {len(PALETTE)} AS h FROM tokens),
an AS (SELECT doc_id, sentence_ord, ord, form AS text, lemma, pos, CASE WHEN ord = start THEN 'ROOT' ELSE dep END AS dep, CASE WHEN ord = start THEN ord ELSE start + (ord - start - 1) // 2 END AS head_ord, CASE WHEN pos IN ('VERB', 'AUX') AND lemma IS NOT NULL THEN CASE WHEN lemma = form THEN 'Inf' ELSE 'Fin' END END AS verbform FROM an0 JOIN pal USING (h))"""
# Quotation marks are no nuclei, also where a copula hangs from one.
_MARKS = ", ".join("'" + q.replace("'", "''") + "'" for q in annotate.QUOTES)
CLAUSES = ANN + f""", nu AS (SELECT doc_id, ord, head_ord, sentence_ord, (coalesce(pos IN ('VERB', 'AUX') AND lower(dep) NOT IN ('aux', 'cop'), false) OR (doc_id, ord) IN (SELECT doc_id, head_ord FROM an WHERE dep = 'cop')) AND text NOT IN ({_MARKS}) AS nucleus FROM an),
climb(doc_id, ord, pl, found) AS (SELECT doc_id, ord, CASE WHEN nucleus THEN ord ELSE head_ord END, nucleus OR head_ord = ord FROM nu
  UNION ALL SELECT c.doc_id, c.ord, CASE WHEN n.nucleus THEN c.pl ELSE n.head_ord END, n.nucleus OR n.head_ord = n.ord FROM climb c JOIN nu n ON n.doc_id = c.doc_id AND n.ord = c.pl WHERE NOT c.found),
ow AS (SELECT c.doc_id, c.ord, CASE WHEN n.nucleus THEN c.pl END AS owner FROM climb c JOIN nu n ON n.doc_id = c.doc_id AND n.ord = c.pl WHERE c.found)"""


@R.query("vocabulary", f"WITH {ANN}, k AS (SELECT doc_id, lemma, pos, CASE WHEN lemma IS NULL THEN text END AS form, min(ord) AS first, count(*) AS n FROM an WHERE pos IS NULL OR pos NOT IN ('PUNCT', 'SYM') GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS ord, lemma, pos, CASE WHEN lemma IS NULL THEN 'form_pos' ELSE 'lemma_pos' END AS grouped_by, form, n FROM k")
def vocabulary(spark, sf_dir):
    return annotate.vocabulary(annotated(spark, sf_dir)).drop("forms")


@R.query("annotation_coverage", f"WITH {ANN} SELECT doc_id, count(*) AS tokens, count(DISTINCT sentence_ord) AS sentences, count(*) FILTER (coalesce(pos NOT IN ('PUNCT', 'SYM'), true)) AS in_vocabulary, count(*) FILTER (lemma IS NULL) AS without_lemma, count(*) FILTER (pos IS NULL) AS without_pos FROM an GROUP BY 1")
def annotation_coverage(spark, sf_dir):
    return annotate.coverage(annotated_lists(spark, sf_dir))


@R.query("missing_fields", f"WITH {ANN} SELECT doc_id, 'lemma' AS field, count(*) AS n, min(ord) AS first FROM an WHERE lemma IS NULL GROUP BY 1 UNION ALL SELECT doc_id, 'pos', count(*), min(ord) FROM an WHERE pos IS NULL GROUP BY 1")
def missing_fields(spark, sf_dir):
    return annotate.missing_fields(annotated_lists(spark, sf_dir))


@R.query("token_layers", f"WITH {ANN} SELECT doc_id, ord, text, lemma, pos, dep, head_ord FROM an")
def token_layers(spark, sf_dir):
    a = annotated(spark, sf_dir)
    return annotate.token_layers(a.select("doc_id", "ord", "text"), a.select("doc_id", "ord", "lemma", "pos"), a.select("doc_id", "ord", "dep", "head_ord"))


@R.query("head_children", f"WITH {ANN} SELECT doc_id, head_ord AS ord, count(*) AS n, string_agg(ord, ',' ORDER BY ord) AS children FROM an WHERE head_ord <> ord GROUP BY 1, 2")
def head_children(spark, sf_dir):
    c = annotate.children(annotated_lists(spark, sf_dir))
    return c.select("doc_id", "ord", F.size("children").cast("long").alias("n"), F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@R.query("check_dependency_tree", f"WITH {ANN} SELECT doc_id, sentence_ord, 'roots' AS rule FROM an WHERE dep = 'ROOT' AND ord % 5 = 0")
def check_dependency_tree(spark, sf_dir):
    """Roots at every fifth place are renamed on purpose; their sentences are the violations."""
    renamed = lambda x: x.withField("dep", F.when((x["dep"] == "ROOT") & (x["ord"] % 5 == 0), "dep").otherwise(x["dep"]))
    return annotate.check_tree(annotated_lists(spark, sf_dir).withColumn("r", F.transform("r", renamed)))


@R.query("tree_ownership", f"WITH RECURSIVE {CLAUSES} SELECT n.doc_id, n.sentence_ord, n.ord, n.nucleus, o.owner, CASE WHEN n.head_ord <> n.ord THEN p.owner END AS parent FROM nu n JOIN ow o ON o.doc_id = n.doc_id AND o.ord = n.ord JOIN ow p ON p.doc_id = n.doc_id AND p.ord = n.head_ord")
def tree_ownership(spark, sf_dir):
    return annotate.clauses(annotated_lists(spark, sf_dir))


@R.query("subtree", f"WITH RECURSIVE {ANN}, up(doc_id, ord, descendant) AS (SELECT doc_id, ord, ord FROM an UNION ALL SELECT u.doc_id, a.head_ord, u.descendant FROM up u JOIN an a ON a.doc_id = u.doc_id AND a.ord = u.ord WHERE a.head_ord <> a.ord) SELECT doc_id, ord, count(*) AS n, sum(descendant)::BIGINT AS total FROM up GROUP BY 1, 2")
def subtree(spark, sf_dir):
    return annotate.subtrees(annotated_lists(spark, sf_dir)).groupBy("doc_id", "ord").agg(F.count(F.lit(1)).alias("n"), F.sum("descendant").alias("total"))


_case = lambda c, m: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"
# Regions of tokens without quotation marks.
PLAIN = "plc AS (SELECT doc_id, ord, text, NULL::BIGINT AS region FROM an), reg AS (SELECT doc_id, ord AS open, ord AS close FROM an WHERE false)"
RULES = CLAUSES + f""",
en AS (SELECT an.*, o.owner, n.nucleus, lead(an.text) OVER w AS next, lag(an.text) OVER w AS before, lag(an.ord) OVER w AS b_ord, lag(an.dep) OVER w AS b_dep, lag(an.head_ord) OVER w AS b_head,
  h.nucleus AS h_nucleus, ha.dep AS h_dep, ha.pos AS h_pos, ha.head_ord AS h_head, lower(oa.dep) AS o_base
  FROM an JOIN ow o USING (doc_id, ord) JOIN nu n USING (doc_id, ord) JOIN nu h ON h.doc_id = an.doc_id AND h.ord = an.head_ord JOIN an ha ON ha.doc_id = an.doc_id AND ha.ord = an.head_ord LEFT JOIN an oa ON oa.doc_id = an.doc_id AND oa.ord = o.owner
  WINDOW w AS (PARTITION BY an.doc_id, an.sentence_ord ORDER BY an.ord)),
inf AS (SELECT DISTINCT doc_id, head_ord AS ord FROM en WHERE head_ord <> ord AND dep = 'xcomp' AND verbform = 'Inf'),
mrk AS (SELECT DISTINCT doc_id, h_head AS ord FROM en WHERE text = 'que' AND dep = 'mark' AND h_pos IN ('VERB', 'AUX') AND h_dep IN ('xcomp', 'ccomp')),
{PLAIN},
ca AS (SELECT e.doc_id, e.sentence_ord, e.ord, e.text, e.owner, CASE WHEN lower(oa.dep) = 'conj' AND oa.head_ord <> oa.ord THEN po.owner END AS cp, p.region
  FROM (SELECT *, lead(pos) OVER w AS next_pos, lead(owner) OVER w AS next_owner FROM en WINDOW w AS (PARTITION BY doc_id, sentence_ord ORDER BY ord)) e
  JOIN an oa ON oa.doc_id = e.doc_id AND oa.ord = e.owner JOIN ow po ON po.doc_id = oa.doc_id AND po.ord = oa.head_ord
  JOIN plc p ON p.doc_id = e.doc_id AND p.ord = e.ord JOIN plc q ON q.doc_id = e.doc_id AND q.ord = e.owner LEFT JOIN reg r ON r.doc_id = e.doc_id AND r.open = p.region
  WHERE p.region IS NOT DISTINCT FROM q.region AND (p.region IS NULL OR r.close IS NOT NULL) AND next_pos = 'ADV' AND (
    (e.text = 'não' AND next = 'só' AND e.pos = 'ADV' AND lower(e.dep) = 'advmod') OR (e.text = 'mas' AND next = 'também' AND e.pos = 'CCONJ' AND lower(e.dep) = 'cc' AND next_owner = e.owner))),
fi AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_ord ORDER BY ord) AS k FROM ca WHERE text = 'não'),
se AS (SELECT f.doc_id, f.sentence_ord, f.k, f.ord AS first, coalesce(list(s.ord ORDER BY s.ord) FILTER (s.ord IS NOT NULL), []) AS l FROM fi f LEFT JOIN ca s ON s.text = 'mas' AND s.doc_id = f.doc_id AND s.sentence_ord = f.sentence_ord
  AND s.ord > f.ord + 1 AND s.region IS NOT DISTINCT FROM f.region AND (s.owner = f.owner OR s.cp = f.owner OR f.cp = s.owner) GROUP BY ALL),
gr(doc_id, sentence_ord, k, first, second, used) AS (SELECT DISTINCT doc_id, sentence_ord, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[] FROM fi
  UNION ALL SELECT s.doc_id, s.sentence_ord, s.k, s.first, [x for x in s.l if NOT list_contains(g.used, x)][1], list_concat(g.used, [x for x in s.l if NOT list_contains(g.used, x)][:1])
  FROM gr g JOIN se s ON s.doc_id = g.doc_id AND s.sentence_ord = g.sentence_ord AND s.k = g.k + 1),
co AS (SELECT doc_id, sentence_ord, first, second FROM gr WHERE second IS NOT NULL),
me AS (SELECT doc_id, first AS ord FROM co UNION SELECT doc_id, second FROM co),
fr AS (SELECT *, (doc_id, ord) NOT IN (SELECT doc_id, ord FROM me) AS free, lower(dep) AS b FROM en),
oc AS (
  SELECT doc_id, sentence_ord, ord, 'clause' AS rule, 'clauses' AS family, 'clause' AS category, owner AS nucleus FROM fr WHERE nucleus
  UNION ALL SELECT doc_id, sentence_ord, ord, 'negation_' || text, 'negation', {_case('text', {k: v[0] for k, v in rules.NEGATORS.items()})}, owner FROM fr WHERE free AND ((text IN ('não', 'nunca') AND b IN ('advmod', 'neg', 'root')) OR (text = 'nem' AND b IN ('advmod', 'neg', 'root', 'cc')))
  UNION ALL SELECT doc_id, sentence_ord, ord, 'relative_time', 'time', 'relative', owner FROM fr WHERE text = 'hoje' AND b IN ('advmod', 'obl', 'npadvmod')
  UNION ALL SELECT doc_id, sentence_ord, ord, 'relative_time', 'time', 'construction', owner FROM fr WHERE text = 'quando' AND b = 'mark' AND o_base = 'advcl'
  UNION ALL SELECT doc_id, sentence_ord, ord, 'verb_inflection', 'time', 'inflection', owner FROM fr WHERE verbform IS NOT NULL
  UNION ALL SELECT doc_id, sentence_ord, ord, 'modal_verb', 'modality', {_case('lemma', rules.MODAL_VERBS)}, owner FROM fr WHERE lemma IN ('poder', 'dever')
  UNION ALL SELECT doc_id, sentence_ord, ord, 'modal_verb', 'modality', 'capacity', owner FROM fr JOIN inf USING (doc_id, ord) WHERE lemma = 'conseguir'
  UNION ALL SELECT doc_id, sentence_ord, ord, 'modal_verb', 'modality', 'obligation', owner FROM fr JOIN mrk USING (doc_id, ord) WHERE lemma = 'ter'
  UNION ALL SELECT doc_id, sentence_ord, ord, 'modal_adverb', 'modality', 'doubt', owner FROM fr WHERE text = 'talvez' AND b IN ('advmod', 'discourse')
  UNION ALL SELECT doc_id, sentence_ord, ord, 'modal_adjective', 'modality', 'necessity', owner FROM fr WHERE text = 'necessário' AND nucleus
  UNION ALL SELECT doc_id, sentence_ord, ord, 'connector_mas', 'connectors', 'contrast', owner FROM fr WHERE free AND text = 'mas' AND b = 'cc' AND h_nucleus AND h_dep = 'conj' AND owner IS NOT NULL
  UNION ALL SELECT doc_id, sentence_ord, ord, 'connector_' || text, 'connectors', {_case('text', {k: v[0] for k, v in rules.CONNECTORS.items()})}, owner FROM fr WHERE free AND b = 'mark' AND ((text = 'porque' AND o_base IN ('advcl', 'ccomp', 'root')) OR (text = 'se' AND o_base IN ('advcl', 'root')) OR (text = 'quando' AND o_base = 'advcl'))
  UNION ALL SELECT doc_id, sentence_ord, ord, 'therefore', 'connectors', 'consequence', owner FROM fr WHERE text = 'isso' AND before = 'por' AND b_dep = 'case' AND b_head = ord AND b IN ('obl', 'advmod') AND b_ord < owner
  UNION ALL SELECT co.doc_id, co.sentence_ord, first, 'correlative', 'negation', 'correlative_addition', o.owner FROM co JOIN ow o ON o.doc_id = co.doc_id AND o.ord = first)"""


@R.query("rule_occurrences", f"WITH RECURSIVE {RULES} SELECT * FROM oc")
def rule_occurrences(spark, sf_dir):
    return rules.occurrences(annotated_documents(spark, sf_dir))


@R.query("multi_negation", f"WITH RECURSIVE {RULES} SELECT doc_id, sentence_ord, nucleus, count(*) AS markers FROM oc WHERE rule LIKE 'negation_%' AND nucleus IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2")
def multi_negation(spark, sf_dir):
    return rules.multiple_negation(rule_occurrences(spark, sf_dir))


@R.query("rule_report", f"WITH RECURSIVE {RULES} SELECT family, category, count(*) AS n FROM oc GROUP BY 1, 2")
def rule_report(spark, sf_dir):
    return rules.report(rule_occurrences(spark, sf_dir))


@R.query("contiguous_fragments", f"WITH RECURSIVE {RULES}, ru AS (SELECT doc_id, owner, ord - row_number() OVER (PARTITION BY doc_id, owner ORDER BY ord) AS run FROM ow WHERE owner IS NOT NULL), sz AS (SELECT doc_id, owner AS nucleus, count(*) AS scope_tokens, count(DISTINCT run) AS fragments FROM ru GROUP BY 1, 2) SELECT doc_id, ord, rule, scope_tokens, fragments FROM oc JOIN sz USING (doc_id, nucleus)")
def contiguous_fragments(spark, sf_dir):
    return rules.scopes(annotated_documents(spark, sf_dir), listed_runs=False)


@R.query("rule_pending", f"WITH {ANN} SELECT doc_id, ord, unnest(['clause', 'verb_inflection', 'modal_verb']) AS rule, 'pos' AS field FROM an WHERE pos IS NULL UNION ALL SELECT doc_id, ord, 'word', 'pos' FROM an WHERE pos IS NULL AND text = 'só' UNION ALL SELECT doc_id, ord, unnest(['modal_verb', 'verb_inflection']), unnest(['lemma', 'verbform']) FROM an WHERE pos = 'VERB' AND lemma IS NULL")
def rule_pending(spark, sf_dir):
    return rules.pending(annotated(spark, sf_dir))


def quoted_tokens(spark, sf_dir):
    return quoted(spark, sf_dir).select("doc_id", "ord", "text")


_in = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
# The stack of open regions after each mark, one mark of every document in each round.
REGIONS = """
marks AS (SELECT doc_id, ord, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM qt WHERE text IN (%s)),
stk(doc_id, k, ord, stack, was) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, -1::BIGINT, []::STRUCT(o BIGINT, c VARCHAR)[], []::STRUCT(o BIGINT, c VARCHAR)[] FROM marks
  UNION ALL SELECT m.doc_id, m.k, m.ord, CASE WHEN len(stack) > 0 AND stack[-1].c = m.text THEN stack[:-2] WHEN m.text IN (%s) THEN list_append(stack, {o: m.ord, c: %s}) ELSE stack END, stack
  FROM stk s JOIN marks m ON m.doc_id = s.doc_id AND m.k = s.k + 1),
reg AS (
  SELECT doc_id, was[-1].o AS open, ord AS close, len(was) > 1 AS nested FROM stk WHERE len(stack) < len(was)
  UNION ALL SELECT doc_id, stack[i].o, NULL, i > 1 FROM (SELECT doc_id, arg_max(stack, k) AS stack FROM stk GROUP BY doc_id), range(1, len(stack) + 1) AS r(i)),
plc AS (
  SELECT t.doc_id, t.ord, t.text, CASE WHEN NOT coalesce(s.ord = t.ord AND len(s.stack) <> len(s.was), false) THEN s.stack[-1].o END AS region
  FROM qt t ASOF LEFT JOIN stk s ON s.doc_id = t.doc_id AND t.ord >= s.ord)""" % (_in({*quotes.PAIRS, *quotes.PAIRS.values()}), _in(quotes.PAIRS), "CASE m.text " + " ".join(f"WHEN {_in([k])} THEN {_in([v])}" for k, v in quotes.PAIRS.items()) + " END")
QUOTED = """qt AS (SELECT doc_id, ord, CASE WHEN text = '.' THEN ['“', '«', '”', '"', '»', '"'][ord % 6 + 1] ELSE text END AS text FROM an)"""


@R.query("quote_regions", f"WITH RECURSIVE {ANN}, {QUOTED}, {REGIONS} SELECT * FROM reg")
def quote_regions(spark, sf_dir):
    return quotes.quote_regions(quoted_tokens(spark, sf_dir))


@R.query("innermost_region", f"WITH RECURSIVE {ANN}, {QUOTED}, {REGIONS} SELECT doc_id, ord, region FROM plc")
def innermost_region(spark, sf_dir):
    return quotes.innermost(quoted_tokens(spark, sf_dir))


def quoted_documents(spark, sf_dir, **more):
    """``quoted`` as documents that list their sentences."""
    return annotated_documents(spark, sf_dir, quoted=True, **more)


def quoted(spark, sf_dir):
    """Annotated tokens whose full stops are quotation marks."""
    return annotate.token_rows(annotated_lists(spark, sf_dir, quoted=True)).select("doc_id", "sentence_ord", "ord", "text", "lemma", "pos", "dep", "head_ord", "verbform")


# The same rules over the quoted tokens: their texts take the place of the plain ones.
SCOPES = RULES.replace("nu AS (", "an AS (SELECT a.* REPLACE (q.text AS text) FROM an1 a JOIN qt q USING (doc_id, ord)), nu AS (", 1).replace("an AS (SELECT doc_id, sentence_ord, ord, form", "an1 AS (SELECT doc_id, sentence_ord, ord, form", 1).replace(", an AS (SELECT a.*", f", {QUOTED.replace('FROM an', 'FROM an1')}, an AS (SELECT a.*", 1).replace(PLAIN, REGIONS.lstrip(), 1)
NEGATED = SCOPES + f""",
neg AS (SELECT f.*, p.region, r.close IS NOT NULL AS closed, ha.text AS h_text,
    (text_ IN ('não', 'nunca') AND b IN ('advmod', 'neg', 'root') AND f.pos = 'ADV') OR (text_ = 'nem' AND b IN ('advmod', 'neg', 'root', 'cc') AND f.pos IN ('ADV', 'PART', 'CCONJ')) AS allowed
  FROM (SELECT *, text AS text_ FROM fr WHERE text IN ('não', 'nunca', 'nem') AND free) f JOIN plc p USING (doc_id, ord) LEFT JOIN reg r ON r.doc_id = f.doc_id AND r.open = p.region JOIN an ha ON ha.doc_id = f.doc_id AND ha.ord = f.head_ord),
nuc AS (SELECT *, allowed AND head_ord <> ord AND NOT h_nucleus AND lower(h_dep) NOT IN ('aux', 'cop') AND h_text NOT IN ({_in(annotate.QUOTES)}) AND h_pos IS NOT NULL AS con,
    CASE WHEN h_text IN ({_in(annotate.QUOTES)}) OR (allowed AND head_ord <> ord AND h_pos IS NULL) THEN NULL
      WHEN allowed AND head_ord <> ord AND NOT h_nucleus AND lower(h_dep) NOT IN ('aux', 'cop') THEN head_ord ELSE owner END AS n0 FROM neg WHERE allowed OR region IS NOT NULL),
got AS (SELECT n.doc_id, n.sentence_ord, n.ord, n.region, n.allowed, CASE WHEN n.region IS NULL OR q.region = n.region THEN n0 END AS nucleus, con,
    n0 IS NOT NULL AND q.region IS NOT DISTINCT FROM n.region AND n.allowed AND (n.region IS NULL OR n.closed) AS asks
  FROM nuc n LEFT JOIN plc q ON q.doc_id = n.doc_id AND q.ord = n.n0),
dn(doc_id, top, ord) AS (SELECT DISTINCT doc_id, nucleus, nucleus FROM got WHERE asks AND con UNION ALL SELECT d.doc_id, d.top, a.ord FROM dn d JOIN an a ON a.doc_id = d.doc_id AND a.head_ord = d.ord AND a.ord <> d.ord),
tk AS (SELECT g.doc_id, g.ord, x.pl FROM got g JOIN (SELECT doc_id, owner AS n, ord AS pl, false AS con FROM ow WHERE owner IS NOT NULL UNION ALL SELECT doc_id, top, ord, true FROM dn) x ON x.doc_id = g.doc_id AND x.n = g.nucleus AND x.con = g.con
  JOIN plc p ON p.doc_id = x.doc_id AND p.ord = x.pl WHERE g.asks AND p.region IS NOT DISTINCT FROM g.region AND p.text NOT IN ({_in(annotate.QUOTES)})),
rn AS (SELECT doc_id, ord, min(pl) AS a, max(pl) AS z, count(*) AS n FROM (SELECT *, pl - row_number() OVER (PARTITION BY doc_id, ord ORDER BY pl) AS run FROM tk) GROUP BY doc_id, ord, run),
sc AS (SELECT doc_id, ord, sum(n)::BIGINT AS scope_tokens, string_agg(a || '-' || z, ',' ORDER BY a) AS slices FROM rn GROUP BY doc_id, ord)"""


@R.query("negation_scopes", f"WITH RECURSIVE {NEGATED} SELECT g.doc_id, sentence_ord, g.ord, nucleus, con AND nucleus IS NOT NULL AS constituent, allowed, region, scope_tokens, slices FROM got g LEFT JOIN sc USING (doc_id, ord)")
def negation_scopes(spark, sf_dir):
    found = rules.negation_scopes(quoted_documents(spark, sf_dir))
    return found.withColumn("slices", F.array_join(F.transform("slices", lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["last"].cast("string"))), ","))
