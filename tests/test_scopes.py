"""Scopes of negators, and subtrees as slices of a preorder."""

import random

from lexloom.operators import annotate, rules

SHAPE = "doc_id long, sentence_ord long, ord long, text string, lemma string, pos string, dep string, head_ord long, verbform string"


def test_preorder_is_an_interval():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(1, 30)
        heads = [0] + [rng.randrange(i) for i in range(1, n)]
        number, size = annotate._preorder(heads)
        for a in range(n):
            below = set()
            for d in range(n):
                i = d
                while i != a and i:
                    i = heads[i]
                below |= {d} if i == a else set()
            assert {d for d in range(n) if number[a] <= number[d] < number[a] + size[a]} == below
    assert annotate._preorder([0, 2, 1]) == ([0, None, None], [1, None, None])


def test_negation_scopes(spark):
    def sentence(doc, rows):
        return [(doc, 0, i, text, text, pos, dep, head, None) for i, (text, pos, dep, head) in enumerate(rows)]

    plain = [("eles", "PRON", "nsubj", 2), ("não", "ADV", "advmod", 2), ("compram", "VERB", "ROOT", 2), ("casas", "NOUN", "obj", 2)]
    named = [("nunca", "ADV", "advmod", 1), ("casas", "NOUN", "obj", 3), ("grandes", "ADJ", "amod", 1), ("compram", "VERB", "ROOT", 3)]
    inside = [("diz", "VERB", "ROOT", 0), ("“", "PUNCT", "punct", 3), ("não", "ADV", "advmod", 3), ("vai", "VERB", "ccomp", 0), ("”", "PUNCT", "punct", 3), ("hoje", "ADV", "advmod", 3)]
    opened = inside[:4] + [("x", "NOUN", "obj", 3)]
    across = [("diz", "VERB", "ROOT", 0), ("“", "PUNCT", "punct", 0), ("não", "ADV", "advmod", 0), ("”", "PUNCT", "punct", 0)]
    rows = [r for d, s in enumerate((plain, named, inside, opened, across)) for r in sentence(d, s)]
    found = {r.doc_id: (r.nucleus, r.constituent, r.scope_tokens, r.slices and [tuple(x) for x in r.slices]) for r in rules.negation_scopes(spark.createDataFrame(rows, SHAPE)).collect()}
    assert found == {0: (2, False, 4, [(0, 3)]), 1: (1, True, 3, [(0, 2)]), 2: (3, False, 2, [(2, 3)]), 3: (3, False, None, None), 4: (None, False, None, None)}
