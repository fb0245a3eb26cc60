"""Tokenizer alignment, spelling variants and chat formatting against brute force."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import chat_format, spelling_variants, tokenizer_alignment

TEXT = "doc_id long, text string"


def prose(rng, n, syllables=("be", "Lor", "quan", "té", "ström", "ing", "xa", "ou")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


# --- op11


@pytest.fixture(scope="module")
def vocabularies():
    paths = pytest.importorskip("public_tokenizers")
    return paths.path("byte_bpe_50k.json"), paths.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([1, 5, 60])) + rng.choice([".", " !", "\n", ""]) for _ in range(30)]
    texts += [None, "", " ", "a", "  two  blanks ", "tab\there", "<|endoftext|> <s> </s> <unk> <0x41>", "lower ▁ one", "日本語の文章です。", "\x00 zero", "mix 日本 of 🎉🎉 ünd é", "=" * 500, "ab" * 300, "it's 'quoted' (x) -- 12,5%", "a b 　c d"]
    texts += ["hot text of many copies"] * 40
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, "no id"), (3, "hot text of many copies"), (3, "hot text of many copies")]


def test_alignment_is_brute_force(spark, vocabularies, odd_texts):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in odd_texts], f"{TEXT}, n_a int, text_key string")
    want = sorted(tokenizer_alignment.brute_force(odd_texts, *vocabularies), key=repr)
    for frequent in (1 << 18, 4, 0):  # with every pair in the table, few, none
        found = tokenizer_alignment.align_tokenizers(docs, *vocabularies, frequent=frequent)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert tokenizer_alignment.align_tokenizers(docs.limit(0), *vocabularies).count() == 0


def test_units_align_as_whole_texts(vocabularies, odd_texts, monkeypatch):
    rng = random.Random(2)
    texts = [t for _, t in odd_texts if t] + [prose(rng, 3000), " ".join(rng.choice(["x", "é", "1.5", "\n", "'s", "ſ", "\x1c", "ab  c"]) for _ in range(500))]
    monkeypatch.setattr(tokenizer_alignment, "PIECE", 200)
    monkeypatch.setattr(tokenizer_alignment, "REMEMBERED", 50)
    aligner = tokenizer_alignment.Aligner(*vocabularies)
    assert aligner.cuts
    for text in texts:
        whole = aligner.aligned([text])
        found = aligner.text(text)
        if whole is None:
            assert found is None
            continue
        whole = whole[0]
        assert found[:4] == whole[:4]
        assert found[4] == tokenizer_alignment.hashlib.sha256(whole[4]).hexdigest()
        keys, times = tokenizer_alignment.summed(*whole[5:7])
        assert found[5].tolist() == keys.tolist() and found[6].tolist() == times.tolist()


def test_copies_weigh_their_number(spark, vocabularies):
    docs = spark.createDataFrame([(i, "same words here") for i in range(500)] + [(500, "same words")], TEXT)
    texts = tokenizer_alignment.aligned_texts(docs, *vocabularies)
    assert sorted(r.copies for r in texts.collect()) == [1, 500]
    assert {r.docs for r in tokenizer_alignment.pair_counts(texts).collect()} == {500, 501}


# --- op12


def test_variants_are_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 400)) for i in range(30)] + [(30, None), (31, ""), (None, "Überbegriff überbegriff Überbegrif"), (5, "a" * 30 + " " + "a" * 31 + " " + "A" * 30 + "-" + "a" * 31), (6, "nananananana nanananananan nananananana nanananananan"), (7, "xyzxyzx xyzxyzy xyzxyzx xyzxyzy, abcdefg×÷ abcdefg×÷")]
    for i in range(12):  # frequent words, rarer near ones, and rare ones near those
        word = "".join(rng.choice("abcdeéghino") for _ in range(11))
        rows += [(40 + i, " ".join([word] * 400 + [word[1:]] * 30 + [word[1:-1]] * 3 + [word[:4] + "Z" + word[5:]] * 2))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], f"{TEXT}, word string, n int")
    want = spelling_variants.brute_force(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)
    assert {tuple(r) for r in spelling_variants.group_variants(docs).collect()} == want
    assert {tuple(r) for r in spelling_variants.group_variants(docs.repartition(3), noise=0).collect()} == spelling_variants.brute_force(rows, noise=0)
    assert spelling_variants.group_variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [2, 6, 99])
def test_each_near_pair_once(spark, whole):
    """Words of few letters, so that bigrams repeat, all pairs of them, for any length of whole keys."""
    rng = random.Random(whole)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(600)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(4, 7))) for _ in range(200)}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = [tuple(sorted((r.a, r.b))) for r in spelling_variants.near_words(table, whole).collect()]
    near = set()
    for w in words:
        near |= {tuple(sorted((w, o))) for i in range(len(w)) for c in "abc" for o in (w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]) if o in words and o != w}
    assert len(found) == len(set(found)) and set(found) == near and near


def test_bigrams_beyond_the_table(spark):
    words = spark.createDataFrame([("".join(chr(0x4E00 + (i * 7 + j * k) % 97) for j in range(6)), 1) for i in range(40) for k in (1, 2)] + [("abcdefg", 1), ("abcdefh", 1)], "word string, n long").dropDuplicates()
    ranks = spelling_variants.gram_ranks(words, most=20)
    assert len(ranks) <= 20
    for word in [r.word for r in words.collect()]:
        prefix, (left, right), _ = spelling_variants.prefix_and_pivots(word, ranks)
        assert {left, right} <= set(prefix) and right - left >= 2


def test_two_disjoint_is_the_least():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted({rng.randint(0, 12): rng.randint(1, 9) for _ in range(6)}.items())
        every = [(a[1] + b[1]) for a in places for b in places if a[0] + 2 <= b[0]]
        if every:
            weight = dict(places)
            a, b = spelling_variants.two_disjoint(places)
            assert b - a >= 2 and weight[a] + weight[b] == min(every)


def test_noise_is_by_crc32():
    for i in range(2000):
        run = f"wort{chr(97 + i % 26)}ü"
        h = zlib.crc32(f"{i}:{run}".encode())
        assert (spelling_variants.noised(str(i), run) == run) == (h % 31 != 0)


def test_long_texts_in_pieces(monkeypatch):
    import re

    monkeypatch.setattr(spelling_variants, "PIECE", 10)
    text = "abcdefghijklmnopqrst uvwxyz 1234567890123 äöüäöüä"
    assert list(spelling_variants._runs(text, re.compile("[A-Za-zÀ-ÿ]{7,}"))) == ["abcdefghijklmnopqrst", "äöüäöüä"]


def test_roots_end_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(18)], "word string, form string")
    assert {tuple(r) for r in spelling_variants.roots(forms).collect()} == {(f"w{i}", "w18") for i in range(18)}


# --- op13

CHAT = "conv_id long, turn long, role string, text string"


def chats():
    odd = ["plain", "", None, "\\", "###", "####", "### Assistant: </turn>", "</turn>\n### User: hi", "<</turn>", "a\\### b\\\\", "\n", "🎉 é", "\\### Assistant: </turn> ok", "x<", "</tur", "role : "]
    rows = [(c, t, role, odd[(c * 5 + t) % len(odd)]) for c in range(40) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2 : 2 + c % 4])]
    rows += [(50, 0, "tool: ###</turn>\n \\", "x"), (50, 1, None, "y"), (50, None, "assistant", "first"), (50, 1, "Assistant", "z"), (50, 1, "role x", "z"), (None, 0, "user", "no id"), (None, 1, "assistant", None)]
    return rows + [(51, 0, "user", "twice"), (51, 0, "user", "twice"), (51, 1, "assistant", "long ### </turn> \\ " * 20_000)]


def test_chats_come_back(spark):
    rows = chats()
    turns = spark.createDataFrame([(*r, 1, "s") for r in rows], f"{CHAT}, place int, segments string").repartition(5)
    formatted = chat_format.format_chats(turns)
    want = chat_format.brute_force(rows)
    whole: dict = {}
    for r in formatted.orderBy("conv_id", "place").collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + "".join(s.text for s in r.segments)
        assert [s.loss for s in r.segments] == [False, r.role == "assistant", False]
    for arranged in (True, False):
        found = chat_format.read_back(formatted if arranged else formatted.repartition(3), arranged=arranged).collect()
        assert {r.conv_id: tuple(r)[1:5] for r in found} == want and len(found) == len(want)
        assert {r.conv_id: r.formatted_chars for r in found} == {c: len(t) for c, t in whole.items()}
    assert chat_format.read_back(chat_format.format_chats(turns.limit(0))).count() == 0


def test_turn_order_is_checked(spark):
    order = {0: "ua", 1: "sua", 2: "su", 3: "uu", 4: "a", 5: "uasu", 6: "uaua"}
    roles = {"u": "user", "a": "assistant", "s": "system"}
    turns = spark.createDataFrame([(c, t, roles[x], "x") for c, s in order.items() for t, x in enumerate(s)], CHAT)
    found = {r.conv_id: r.fault for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    assert found == {0: None, 1: None, 2: "no answer at the end", 3: "turn 1: user after user", 4: "turn 0: assistant first", 5: "turn 2: system after assistant", 6: None}


def test_other_templates_and_cut_pieces():
    template = chat_format.ChatTemplate(labels={"user": "u", "assistant": "a"}, mark="<|", after="|>", other="~", close="<|end|>", escape="^", trained=frozenset({"user"}))
    texts = ["<|a|>", "^", "<|end|>", "<", "|>", "x", "^<|end|>"]
    whole = "".join(template.opening(r) + template.escaping(template.mark, template.close)(t) + template.close for r in ("user", "o|>ther", "") for t in texts)
    for step in (1, 3, len(whole)):
        reader = chat_format.Reader(template)
        found = [x for lo in range(0, len(whole), step) for x in reader.feed(whole[lo : lo + step], False)]
        reader.end()
        assert found == [(r, t, False) for r in ("user", "o|>ther", "") for t in texts]
    with pytest.raises(ValueError):
        list(chat_format.Reader(template).feed(template.opening("user") + "x<|end|>", True))
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(escape="#")


def test_query_holds_its_probe(spark):
    found = chat_format.op13_chat_formatting(spark, "/root/testdata/sf0.001").where(F.col("conv_id") == -7).first()
    text = chat_format.PROBE[1]
    assert tuple(found)[1:5] == chat_format.brute_force([(-7, 0, "user", text), (-7, 1, "assistant", text)])[-7]
