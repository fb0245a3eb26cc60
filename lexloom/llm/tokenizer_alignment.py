"""Cross-tokenizer alignment of exact distinct texts.

Texts are grouped by their full text, so that each different one is tokenised and aligned once, by two tokenizers, whatever the number of
its copies. Places where a token of either ends are common boundaries; between two of them lies a group, and every token
of A there is linked with every token of B. A pair of ids counts in as many documents as hold it linked: texts count with their
multiplicity. The frequent pairs, a bounded table, are looked up where the texts' pairs lie; the rest are joined by pair.
Measures go back to the documents by the SHA-256 of their text.

Within a text, no token of either tokenizer reaches over a single space between two visible characters to its left, so a text is cut
there into units, and a unit that was seen before is not tokenised again. Units are joined piece by piece, so a long text needs
no more memory than its different pairs and one piece.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections import Counter
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import most_frequent, stage

#: Pairs of ids, the most frequent ones, that every task looks up in memory: at most so many, 17 bytes each.
FREQUENT = 1 << 18
#: Characters of a text, or of several, that are handled at once; units that a worker remembers; pairs whose counts a task sums up.
PIECE, REMEMBERED, SUMMED = 1 << 20, 1 << 18, 1 << 22

#: Bits of each of four numbers that are summed as one.
_FIELD = 64

# Visible ASCII, and letters of Latin-1 and the blocks after it: none is white space to any tokenizer.
_VISIBLE = "[!-~À-ɏ]"
_CUT = re.compile(f"(?<={_VISIBLE}) (?={_VISIBLE})")


def byte_level(token: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 and on."""
    return bytes(_byte_of()[c] for c in token)


@functools.cache
def _byte_of() -> dict[str, int]:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Aligner:
    """Two tokenizers, and the alignment of units of text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = np.empty(1 + max(self.a.get_vocab().values()), object)
        for t, i in self.a.get_vocab().items():
            self.a_bytes[i] = t.encode() if t in special else byte_level(t)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = np.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], object)
        self.a_lengths, self.b_lengths = (np.array([len(x or b"") for x in t]) for t in (self.a_bytes, self.b_bytes))
        # Ids as they stand in the digest: before another one, before the other tokenizer's, at a group's end.
        self.open_ids, self.closed_a, self.closed_b = (np.array([b"%d%s" % (i, c) for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object) for c in (b",", b"|", b";"))
        # Units are safe where no piece goes on with a space after something else.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.seen: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def units(self, text: str):
        """Lists of units, of a bounded number of characters where the text can be cut."""
        if not self.cuts:
            yield [text]
            return
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + PIECE) if len(text) - at > PIECE else None
            yield _CUT.split(text[at : cut.start()] if cut else text[at:])
            at = cut.end() if cut else len(text)

    def learn(self, units) -> None:
        """Aligns the units that are not known yet: joined, as they join again in any text, or one by one where bytes are lost."""
        new = []
        for u in units:
            if u not in self.seen:
                if u in self.before:
                    self.seen[u] = self.before[u]
                else:
                    new.append(u)
        if not new:
            return
        found = self.aligned(new)
        if found is None:
            found = [(self.aligned([u]) or [None])[0] for u in new]
        self.seen.update(zip(new, found, strict=True))

    def forget(self) -> None:
        """Keeps what was met since the last time, once that is many."""
        if len(self.seen) > REMEMBERED:
            self.before, self.seen = self.seen, {}

    def aligned(self, units: list[str]) -> list[tuple] | None:
        """For each of the units, which follow each other in a text, (tokens of A, of B, groups, links, the groups as bytes, linked pairs, how
        often each, and the four numbers packed into one, for sums); pairs may come again. None if either tokenizer's bytes are not the text's."""
        text = " ".join(units)
        a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text), np.int64)
        data = (" " + text).encode()
        if b"".join(self.a_bytes[a].tolist()) != data or b"".join(self.b_bytes[b].tolist()) != data:
            return None
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        ends = np.cumsum([1 + len(u.encode()) for u in units])
        a_marks, b_marks = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        a_marks[a_ends], b_marks[b_ends] = True, True
        a_last, b_last = b_marks[a_ends], a_marks[b_ends]  # tokens that end a group
        common = a_ends[a_last]
        # Groups, tokens and links before each unit's end.
        groups_to = np.searchsorted(common, ends, side="right")
        if not (common[groups_to - 1] == ends).all():
            return None
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        in_a, in_b = np.bincount(a_group, minlength=len(common)), np.bincount(b_group, minlength=len(common))
        a_from, b_from = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        n_links = in_a * in_b
        # The groups' own text, one token after the other.
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + b_from[a_group]] = np.where(a_last, self.closed_a[a], self.open_ids[a])
        shown[np.arange(len(b)) + (a_from + in_a)[b_group]] = np.where(b_last, self.closed_b[b], self.open_ids[b])
        # All links of groups of usual size; of others the distinct ids with their numbers.
        large = n_links > 4096
        times_b = np.where(large, 0, in_b)[a_group]
        x = np.repeat(np.arange(len(a)), times_b)
        y = np.arange(len(x)) - np.repeat(np.cumsum(times_b) - times_b, times_b) + b_from[a_group[x]]
        keys = a[x] << 32 | b[y]
        ones = np.ones(len(keys), np.int64)
        links_to = np.cumsum(np.where(large, 0, n_links))
        a_to, b_to, all_links = np.cumsum(in_a), np.cumsum(in_b), np.cumsum(n_links)
        a_cut, b_cut, link_cut, key_cut = (np.concatenate([[0], c[groups_to - 1]]) for c in (a_to, b_to, all_links, links_to))
        numbers = zip(*(np.diff(c).tolist() for c in (a_cut, b_cut, np.concatenate([[0], groups_to]), link_cut)), strict=True)
        token_cut, key_cut, shown = (a_cut + b_cut).tolist(), key_cut.tolist(), shown.tolist()
        out = [
            (*n, b"".join(shown[lo:hi])[:-1], keys[p:q], ones[p:q], n[0] | n[1] << _FIELD | n[2] << 2 * _FIELD | n[3] << 3 * _FIELD)
            for n, lo, hi, p, q in zip(numbers, token_cut, token_cut[1:], key_cut, key_cut[1:], strict=False)
        ]
        for g in np.flatnonzero(large):
            k = int(np.searchsorted(groups_to, g, side="right"))
            ids, n = np.unique(a[a_from[g] : a_from[g] + in_a[g]], return_counts=True)
            others, m = np.unique(b[b_from[g] : b_from[g] + in_b[g]], return_counts=True)
            out[k] = (*out[k][:5], np.concatenate([out[k][5], (ids[:, None] << 32 | others).ravel()]), np.concatenate([out[k][6], (n[:, None] * m).ravel()]), out[k][7])
        return out

    def text(self, text: str) -> tuple | None:
        """The same for a whole text, with the digest of its groups instead; None if it has no tokens."""
        if not text:
            return None
        total, digest, first = 0, hashlib.sha256(), True
        held_keys, held_times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for units in self.units(text):
            counts = Counter(units)
            self.forget()
            self.learn(counts)
            known = [self.seen[u] for u in counts]
            if any(k is None for k in known):
                return None
            times = np.fromiter(counts.values(), np.int64, len(counts))
            total += sum(map(mul, counts.values(), [k[7] for k in known]))
            digest.update((b"" if first else b";") + b";".join([self.seen[u][4] for u in units]))
            first = False
            held_keys.append(np.concatenate([k[5] for k in known]))
            held_times.append(np.concatenate([k[6] for k in known]) * np.repeat(times, [len(k[5]) for k in known]))
            if len(held_keys) > 8:
                held_keys, held_times = ([x] for x in summed(np.concatenate(held_keys), np.concatenate(held_times)))
        keys, times = summed(np.concatenate(held_keys), np.concatenate(held_times))
        return *(total >> at & (1 << _FIELD) - 1 for at in range(0, 4 * _FIELD, _FIELD)), digest.hexdigest(), keys, times


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


@functools.cache
def _aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, however many tasks it runs."""
    return Aligner(a_path, b_path)


_MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def _align(a_path: str, b_path: str):
    """(text_key, text, copies) to (text_key, copies, measures, groups_sha256, pairs, times): no row for a text without tokens."""
    names = ["text_key", "copies", *_MEASURES, "groups_sha256", "pairs", "times"]
    kinds = (pa.string(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())

    def run(batches):
        aligner = _aligner(a_path, b_path)
        for batch in batches:
            rows, held = [], 0
            texts = batch.column(1)
            for i, (key, copies) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = aligner.text(texts[i].as_py())
                if found is not None:
                    *measures, keys, times = found
                    rows.append((key, copies, *measures, keys.tobytes(), times.astype(np.uint32).tobytes()))
                    held += 12 * len(keys)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def _pair_counts(batches):
    """(copies, pairs) to (pair, docs): sums over stretches of a task."""
    keys, copies, held = [], [], 0

    def passed():
        k, n = summed(np.concatenate(keys), np.concatenate(copies)) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["pair", "docs"])

    for batch in batches:
        for n, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(np.frombuffer(pairs.as_buffer(), np.int64))
            copies.append(np.full(len(keys[-1]), n, np.int64))
            held += len(keys[-1])
            if held >= SUMMED:
                yield passed()
                keys, copies, held = [], [], 0
    yield passed()


def _looked_up(table, rest: bool):
    """(text_no, pairs, times) to (text_no, n_best, count_sum) over the pairs in the table or, with ``rest``, to (text_no, pair, times) of the others."""

    def run(batches):
        known, docs, best = table.value
        for batch in batches:
            out = []
            for no, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                keys, n = np.frombuffer(pairs.as_buffer(), np.int64), np.frombuffer(times.as_buffer(), np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
                if rest:
                    out.append((np.full(int((~hit).sum()), no, np.int64), keys[~hit], n[~hit]))
                else:
                    out.append((no, int((n[hit] * best[at[hit]]).sum()), int((n[hit] * docs[at[hit]]).sum())))
            if rest:
                columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["text_no", "pair", "times"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["text_no", "n_best", "count_sum"])

    return run


def _key(text: Column) -> Column:
    """What documents find their text's measures by; null for null and empty texts."""
    return F.when(text != "", F.sha2(text, 256))


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """(text_no, text_key, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row for each different text that has tokens.

    ``pairs`` holds the distinct linked pairs of ids, sorted, as 64-bit numbers (A's id in the upper half), ``times`` how often each is linked, as
    unsigned 32-bit ones. It is a written table, so that text_no, any number that tells texts apart, stays.
    """
    texts = docs.where(F.col(text_col) != "").groupBy(F.col(text_col).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    shape = "text_key string, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return stage(texts.select(_key(F.col("text")).alias("text_key"), "text", "copies").mapInArrow(_align(a_path, b_path), shape).withColumn("text_no", F.monotonically_increasing_id()), "aligned", compression="zstd")


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, docs, best): how many documents hold a pair linked, and whether no pair with the same id of A is in more. A written table."""
    counts = stage(texts.select("copies", "pairs").mapInArrow(_pair_counts, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "counts")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("top"))  # a row for each id of A
    return stage(counts.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("top")).alias("best")), "pairs")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row for each row of ``docs``.

    A is a byte-level BPE (a file of the tokenizers library) over a space and the text, B a SentencePiece model, which adds that space itself;
    strings of special tokens are plain text. Null and empty texts, and those whose bytes either tokenizer does not give back, have zeros and an
    empty digest, and count in no pair. n_best: links whose pair's count is the highest of its id of A in the corpus, ties included; count_sum: the
    counts over all links. Rows repeated, or under one id, count one by one; null ids come back as null; other columns are not read; an
    empty table gives no rows. Both files have to be at their paths on every machine.
    """
    texts = aligned_texts(docs, a_path, b_path, text_col)
    pairs = pair_counts(texts)
    hot = most_frequent(pairs, "docs", frequent).toPandas().sort_values("pair")  # at most ``frequent`` rows
    table = docs.sparkSession.sparkContext.broadcast((hot.pair.to_numpy(np.int64), hot.docs.to_numpy(np.int64), hot.best.to_numpy(np.int64)))
    lists = texts.select("text_no", "pairs", "times")
    common = lists.mapInArrow(_looked_up(table, False), "text_no long, n_best long, count_sum long")
    rest = lists.mapInArrow(_looked_up(table, True), "text_no long, pair long, times long").withColumnRenamed("pair", "p")
    rare = rest.join(pairs, F.col("p") == F.col("pair")).select("text_no", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
    sums = common.unionByName(rare).groupBy("text_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    measured = texts.drop("pairs", "times", "copies").join(sums, "text_no").drop("text_no")
    out = docs.select(F.col(id_col).cast("long").alias("id"), _key(F.col(text_col)).alias("k")).join(measured, F.col("k") == F.col("text_key"), "left")
    return out.select(F.col("id").alias(id_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*_MEASURES, "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_tokenizer_alignment(spark, sf_dir: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokenizers(docs, a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model"))


def brute_force(rows: list[tuple], a_path: str, b_path: str) -> list[tuple]:
    """The same rows with whole texts tokenised and all links listed; for tests."""
    aligner, found, counts = Aligner(a_path, b_path), [], Counter()
    for _, text in rows:
        links, groups, n_a, n_b = [], [], 0, 0
        if text:
            a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
            data, x, y = (" " + text).encode(), [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
            if b"".join(x) == data == b"".join(y):
                ends_a, ends_b = np.cumsum([len(t) for t in x]).tolist(), np.cumsum([len(t) for t in y]).tolist()
                common, n_a, n_b = sorted({*ends_a} & {*ends_b}), len(a), len(b)
                for lo, hi in zip([0, *common], common, strict=False):
                    own_a, own_b = [i for i, e in zip(a, ends_a, strict=True) if lo < e <= hi], [i for i, e in zip(b, ends_b, strict=True) if lo < e <= hi]
                    groups.append((own_a, own_b))
                    links += [(i, j) for i in own_a for j in own_b]
        counts.update(set(links))
        found.append((n_a, n_b, groups, links))
    top: dict[int, int] = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    return [
        (i, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups).encode()).hexdigest() if groups else "")
        for (i, _), (n_a, n_b, groups, links) in zip(rows, found, strict=True)
    ]
