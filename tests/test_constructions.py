"""Correlatives one to one, and the scopes of correlatives and modals."""

import random

from lexloom.operators import rules, scopes
from tests.test_scopes import SHAPE


def test_matching_is_greedy_and_one_to_one():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(40), rng.randint(1, 14)))
        rows = [[rng.randint(0, 1), at, rng.randint(0, 2), rng.choice([-1, 0, 1, 2]), rng.choice([-1, -1, 5])] for at in places]
        taken, wanted = set(), []
        for second, at, owner, parent, region in rows:
            if second:
                continue
            for s, a, o, p, r in rows:
                if s and a > at + 1 and a not in taken and r == region and (o == owner or p == owner or parent == o):
                    taken.add(a)
                    wanted.append([at, a])
                    break
        assert rules._matched(rows) == wanted


def sentence(doc, rows):
    return [(doc, 0, i, text, lemma, pos, dep, head, form) for i, (text, lemma, pos, dep, head, form) in enumerate(rows)]


def of(spark, *sentences):
    return spark.createDataFrame([r for d, s in enumerate(sentences) for r in sentence(d, s)], SHAPE)


def word(text, pos, dep, head, lemma=None, form=None):
    return (text, lemma or text, pos, dep, head, form)


def test_correlative_scopes(spark):
    def pair(first, second, head):
        return [word("não", "ADV", "advmod", head), word("só", "ADV", "advmod", head), word("compra", "VERB", *first), word("mas", "CCONJ", "cc", second[0]), word("também", "ADV", "advmod", second[0]), word("vende", "VERB", "conj", second[1])]

    joined = pair(("ROOT", 2), (5, 2), 2)
    apart = pair(("ROOT", 2), (5, 2), 2)
    apart[5] = word("vende", "VERB", "advcl", 2)
    twice = [word("não", "ADV", "advmod", 4), word("só", "ADV", "advmod", 4), word("não", "ADV", "advmod", 4), word("só", "ADV", "advmod", 4), word("compra", "VERB", "ROOT", 4), word("mas", "CCONJ", "cc", 7), word("também", "ADV", "advmod", 7), word("vende", "VERB", "conj", 4)]
    quoted = [word("“", "PUNCT", "punct", 3), *[(t, w, p, d, h + 1, f) for t, w, p, d, h, f in joined], word("”", "PUNCT", "punct", 3)]
    unknown = [*joined, ("xyz", None, None, "obj", 5, None)]
    found = {r.doc_id: (r.ord, r.second, list(r.nuclei), r.blocked, r.slices and [tuple(x) for x in r.slices]) for r in scopes.correlative_scopes(of(spark, joined, apart, twice, quoted, unknown)).collect()}
    assert found == {0: (0, 3, [2, 5], False, [(0, 5)]), 2: (0, 5, [4, 7], False, [(0, 7)]), 3: (1, 4, [3, 6], False, [(1, 6)]), 4: (0, 3, [2, 5], True, None)}


def test_modal_scopes(spark):
    aux = [word("eles", "PRON", "nsubj", 2), word("pode", "AUX", "aux", 2, "poder"), word("sair", "VERB", "ROOT", 2), word("hoje", "ADV", "advmod", 2)]
    wish = [word("não", "ADV", "advmod", 1), word("quer", "VERB", "ROOT", 1, "querer"), word("sair", "VERB", "xcomp", 1), word("nunca", "ADV", "advmod", 2), word("ele", "PRON", "nsubj", 1)]
    duty = [word("tem", "VERB", "ROOT", 0, "ter"), word("que", "SCONJ", "mark", 2), word("sair", "VERB", "xcomp", 0), word("casa", "NOUN", "obj", 0)]
    bare = [word("deve", "VERB", "ROOT", 0, "dever")]
    cut_ = [word("deve", "VERB", "ROOT", 0, "dever"), word("“", "PUNCT", "punct", 2), word("sair", "VERB", "xcomp", 0), word("”", "PUNCT", "punct", 2), word("hoje", "ADV", "obl", 0)]
    doubt = [word("talvez", "ADV", "advmod", 1), word("sai", "VERB", "ROOT", 1, "sair")]
    rows = scopes.modal_scopes(of(spark, aux, wish, duty, bare, cut_, doubt)).collect()
    found = {r.doc_id: (r.category, list(r.markers), list(r.complements), list(r.readings), r.denied, r.content_denied, r.slices and [tuple(x) for x in r.slices]) for r in rows}
    assert len(rows) == 6 and found == {
        0: ("possibility_open", [1], [2], ["possibility", "permission", "capacity"], False, False, [(0, 0), (2, 3)]),
        1: ("desire", [1], [2], [], True, True, [(2, 3)]),
        2: ("obligation", [0, 1], [2, 3], [], False, False, [(1, 3)]),
        3: ("obligation", [0], [], ["obligation", "epistemic_inference"], False, False, None),
        4: ("obligation", [0], [2, 4], ["obligation", "epistemic_inference"], False, False, [(4, 4)]),
        5: ("doubt", [0], [], [], False, False, [(0, 1)]),
    }


def test_no_tokens(spark):
    none = spark.createDataFrame([], SHAPE)
    assert scopes.correlative_scopes(none).isEmpty() and scopes.modal_scopes(none).isEmpty()


def test_evidence_fragments(spark):
    from lexloom.operators import evidence

    # Tokens of the copy: não só compra / mas também vende, with a CRLF inside of a fragment and one between the fragments.
    text = "não\r\nsó compra\r\nontem mas  também vende"
    rows = [word("não", "ADV", "advmod", 2), word("só", "ADV", "advmod", 2), word("compra", "VERB", "ROOT", 2), word("ontem", "ADV", "advmod", 2), word("mas", "CCONJ", "cc", 6), word("também", "ADV", "advmod", 6), word("vende", "VERB", "conj", 2)]
    found, members = evidence.evidence_tokens(of(spark, rows))
    original = spark.createDataFrame([(0, text)], "doc_id long, text string")
    got = evidence.fragments(members, original).join(found.select("doc_id", "place", "rule"), ["doc_id", "place"]).where("rule = 'correlative'").orderBy("fragment").collect()
    copy = text.replace("\r\n", "\n")
    assert [(r.first, r.last, r.text, r.o_text) for r in got] == [(0, 2, "não\nsó compra", "não\r\nsó compra"), (4, 6, "mas  também vende", "mas  também vende")]
    for r in got:
        assert copy[r.w_start : r.w_end] == r.text and text[r.o_start : r.o_end] == r.o_text


def test_rule_states(spark):
    from lexloom.operators import states

    listed = spark.createDataFrame([("a", "time", 0), ("b", "time", 1), ("c", "negation", 2)], "rule string, family string, step int")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, rule string")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long")
    got = states.rule_states(docs, listed, pairs((1, "a"), (1, "a"), (1, "b"), (2, "a"), (9, "a"), (1, "z")), pairs((1, "b"), (2, "b"), (2, "c")), pairs((2, "c"), (3, "a"), (3, "b"), (3, "c")), pairs((2, "a"), (3, "a")))
    assert {(r.doc_id, r.rule): (r.state, r.n, r.pending) for r in got.collect()} == {
        (1, "a"): ("executed", 2, 0), (1, "b"): ("executed_with_pending", 1, 1), (1, "c"): ("executed", 0, 0), (2, "a"): ("failed", 0, 0), (2, "b"): ("blocked", 0, 1), (2, "c"): ("disabled", 0, 0),
        (3, "a"): ("disabled", 0, 0), (3, "b"): ("disabled", 0, 0), (3, "c"): ("disabled", 0, 0),
    }
    assert {(r.doc_id, r.family): r.state for r in states.family_states(got).collect()} == {(1, "time"): "incomplete", (1, "negation"): "executed", (2, "time"): "incomplete", (2, "negation"): "disabled", (3, "time"): "disabled", (3, "negation"): "disabled"}
    assert {r.doc_id: r.ready for r in states.readiness(got).collect()} == {1: False, 2: False, 3: False}


def test_rows_of_rules_are_neither_joined_nor_shuffled_again(spark):
    rows = [(1, 0, 0, "Tem", "ter", "VERB", "ROOT", 0, "Fin"), (1, 0, 1, "que", "que", "SCONJ", "mark", 2, None), (1, 0, 2, "sair", "sair", "VERB", "xcomp", 0, "Inf"), (1, 1, 3, "Consegue", "conseguir", "VERB", "ROOT", 3, "Fin"), (1, 1, 4, "sair", "sair", "VERB", "xcomp", 3, "Inf")]
    tokens = spark.createDataFrame(rows, "doc_id long, sentence_ord long, ord long, text string, lemma string, pos string, dep string, head_ord long, verbform string")
    e = rules.enriched(tokens)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = {r.ord: r for r in e.collect()}
    assert got[0].marked and got[3].infinitive and got[0].next == "que" and got[0].before is None and got[2].next_row is None and got[3].before_row is None
    assert got[1].before_row.asDict() == {"ord": 0, "pos": "VERB", "base": "root", "head_ord": 0} and got[1].next_row.asDict() == {"pos": "VERB", "owner": 2}
