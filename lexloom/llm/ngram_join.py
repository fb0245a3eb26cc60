"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters.

A document's set holds the 64-bit hashes of its word n-grams. Equal sets are one node. Under one
order of all n-grams, two sets with similarity of at least t share an n-gram among the first
n - ceil(t * n) + 1 of each, so only those prefixes are shuffled. Rare n-grams come first: n-grams that are
frequent within the tasks of a scan are counted, and the most frequent of them, a bounded table, go to the end of
the order. Any order gives the same links; a good one gives few candidates.

The members of a prefix n-gram are counted, and meet in one task, sorted by size; an n-gram of many members is cut into
blocks first, and each two blocks meet in a cell. A pair is written only if it passes three filters there:
the sizes (length), what can be shared before and after the n-gram (positional), and the sizes of PARTS hash ranges
of what follows the n-gram in either set (suffix). An n-gram that no other prefix of a fitting size holds is dead: it
can't be shared before a shared one, which sharpens the positional filter for copies with many edits.

Components need only connectivity, so sets that are connected already need no check. A first round compares each
member of an n-gram with the group's head, the member with the fewest dead n-grams, and with its neighbour, which joins
copies by as many pairs as there are members; a second round takes the pairs across components that pass the filters, from
n-grams that more than one component holds, so no link is lost. Each pair is verified once, on whole sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import discard, mix64, most_frequent, partitions, signed, stage, text_bytes, window_hashes, word_hashes

#: The table of frequent n-grams has at most so many rows (12 bytes each), whatever the corpus.
FREQUENT = 1 << 18
#: An n-gram is counted as frequent where so many texts of one stretch of a task hold it.
LOCALLY = 2
#: n-grams in such a stretch.
STRETCH = 1 << 22
#: Hash ranges whose sizes the suffix filter compares; a byte each.
PARTS = 64
#: Members of an n-gram in a block; n-grams that have more are cut.
BLOCK = 2048
#: A join key other than the grouping key: both sides are dealt anew, and AQE can split hot keys.
_OTHER = 0x5DEECE66D
#: What tells sets apart.
KEYS = ["k1", "k2", "n_grams"]
#: Bits of the filter that saves shuffling sets of no candidate pair: 8 for each set, at most 16 MB whatever the corpus.
LEAST_BITS, MOST_BITS = 16, 27
#: Members that a task reads before it compares the n-grams that are complete.
CHUNK = 1 << 16


def ngram_set(data: np.ndarray, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of lower-cased words; the whole sequence if shorter; none without words."""
    words = word_hashes(data, lower=True)
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(n, len(words))) + np.uint64(len(words) < n) * np.uint64(len(words)))


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    found = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64)
    return int(found[0]), int(found[1])


def prefix_size(n: int, percent: int) -> int:
    """n minus the least intersection that a set of size n can have with a similar one, plus 1."""
    return n - -(-percent * n // 100) + 1


def _frequent(n: int):
    """(text) to (gram, texts) for the n-grams that LOCALLY texts of a stretch hold."""

    def run(batches):
        held, size = [], 0

        def counted():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCALLY
            return pa.RecordBatch.from_arrays([pa.array(signed(grams[often])), pa.array(counts[often].astype(np.int64))], names=["gram", "texts"])

        for batch in batches:
            for data in text_bytes(batch.column(0)):
                if data is not None:
                    held.append(ngram_set(data, n))
                    size += len(held[-1])
                    if size >= STRETCH:
                        yield counted()
                        held, size = [], 0
        if held:
            yield counted()

    return run


def frequent_ngrams(texts: DataFrame, n: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The locally frequent n-grams with the most texts, sorted, and their counts: at most ``most``."""
    found = texts.mapInArrow(_frequent(n), "gram long, texts long").groupBy("gram").agg(F.sum("texts").alias("texts"))
    found = stage(found, "frequent")
    pdf = most_frequent(found, "texts", most).toPandas()
    discard(found)
    grams = pdf.gram.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], pdf.texts.to_numpy(np.int64)[order]


def rare_first(grams: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of ``grams`` in the order of (count in the table or 0, hash)."""
    if not len(often):
        return np.arange(len(grams))
    at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
    return np.lexsort((grams, np.where(often[at] == grams, counts[at], 0)))


def _part(grams: np.ndarray) -> np.ndarray:
    """The hash range of each n-gram."""
    return (grams >> np.uint64(58)).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary Arrow column with one row of a matrix in each cell, without copying."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """The rows of such a column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width) if len(column) else np.zeros((0, width), kind)


def _sets(n: int, percent: int, table):
    """(id, text) to (id, k1, k2, n_grams, prefix, parts): the set's key, size, prefix in order, and sizes of its hash ranges."""

    def run(batches):
        often, counts = table.value
        for batch in batches:
            keys, sizes, prefixes, parts = [], [], [], []
            for data in text_bytes(batch.column(1)):
                grams = ngram_set(data, n) if data is not None else np.zeros(0, np.uint64)
                keys.append(set_key(grams))
                sizes.append(len(grams))
                prefixes.append(signed(grams[rare_first(grams, often, counts)[: prefix_size(len(grams), percent)]]) if len(grams) else np.zeros(0, np.int64))
                parts.append(np.bincount(_part(grams), minlength=PARTS).astype(np.int32))
            ends = np.cumsum([0] + [len(x) for x in prefixes]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))), _binary(np.array(parts, np.int32).reshape(-1, PARTS))],
                names=["id", "k1", "k2", "n_grams", "prefix", "parts"],
            )

    return run


def _members(cells: bool):
    """(node, n_grams, prefix, parts, alive, chosen, label) to a row for each chosen n-gram (place and number of blocks) of a node's prefix.

    (gram, i, j, side, n, node, at, before, label, suffix): ``at`` n-grams of the set and ``before`` alive ones come before it, and
    ``suffix`` has the sizes of the hash ranges of what follows, at most 255. Members of an n-gram with several blocks are in block i or
    j of a cell as ``side`` tells (2: both); without ``cells`` only in their own block's.
    """
    kinds = (np.int64, np.int32, np.int32, np.int8, np.int32, np.int64, np.int32, np.int32, np.int64)
    names = ["gram", "i", "j", "side", "n", "node", "at", "before", "label", "suffix"]

    def made(out):
        return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x).astype(kind)) for x, kind in zip(out, kinds)], _binary(np.concatenate(out[-1]))], names=names)

    def run(batches):
        for batch in batches:
            out, held = [[] for _ in names], 0
            whole = _matrix(batch.column("parts"), np.int32, PARTS)
            columns = [batch.column(c) for c in ("node", "n_grams", "prefix", "alive", "chosen", "blocks", "label")]
            for k, (node, n, prefix, alive, chosen, blocks, label) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), *columns[2:6], columns[6].to_pylist(), strict=True)):
                grams = np.asarray(prefix.values).view(np.uint64)
                at, blocks = np.asarray(chosen.values).astype(np.int64), np.asarray(blocks.values).astype(np.int64)
                seen = np.zeros((len(grams), PARTS), np.int32)
                seen[np.arange(len(grams)), _part(grams)] = 1
                suffix = np.minimum(whole[k] - seen.cumsum(0)[at], 255).astype(np.uint8)
                own, before = grams[at], np.searchsorted(np.sort(np.asarray(alive.values)), at)
                mine = (mix64(own ^ np.uint64(node & (1 << 64) - 1)) % blocks.astype(np.uint64)).astype(np.int64)
                i, j, side = mine, mine, np.full(len(at), 2)
                if cells and len(at) and blocks.max() > 1:
                    again = np.repeat(np.arange(len(at)), blocks)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    own, at, before, suffix, mine = own[again], at[again], before[again], suffix[again], mine[again]
                    i, j, side = np.minimum(mine, other), np.maximum(mine, other), np.where(mine == other, 2, (mine > other).astype(np.int64))
                size = len(own)
                for column, x in zip(out, (signed(own), i, j, side, np.full(size, n), np.full(size, node), at, before, np.full(size, label), suffix), strict=True):
                    column.append(x)
                held += size
                if held > CHUNK:
                    yield made(out)
                    out, held = [[] for _ in names], 0
            if held:
                yield made(out)

    return run


def _met(percent: int, heads: bool):
    """Members sorted by (gram, i, j, n, node) to the distinct pairs (a, b) of a stretch of them that pass the filters.

    With ``heads`` only pairs with the group's head and with the neighbour in the order of dead n-grams, else all pairs
    across labels.
    """

    def passed(m, x, y):
        """Which of the pairs of rows (x, y), which share an n-gram, pass the length, positional and suffix filters."""
        nx, ny = m["n"][x], m["n"][y]
        need = -(-percent * (nx + ny) // (100 + percent))
        shared = np.minimum(m["before"][x], m["before"][y])
        ok = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (shared + np.minimum(nx - m["at"][x], ny - m["at"][y]) >= need) & ((m["side"][x] == 2) | (m["side"][x] != m["side"][y])) & (m["label"][x] != m["label"][y])
        x, y = x[ok], y[ok]
        found = []
        for lo in range(0, len(x), CHUNK):
            p, q = x[lo : lo + CHUNK], y[lo : lo + CHUNK]
            apart = np.abs(m["suffix"][p].astype(np.int16) - m["suffix"][q]).sum(axis=1)
            rest = (m["n"][p] - m["at"][p] - 1) + (m["n"][q] - m["at"][q] - 1)
            most = np.minimum(m["before"][p], m["before"][q]) + 1 + (rest - apart) // 2
            found.append(most >= -(-percent * (m["n"][p] + m["n"][q]) // (100 + percent)))
        good = np.concatenate(found) if found else np.zeros(0, bool)
        return x[good], y[good]

    def compared(m):
        size = len(m["node"])
        new = np.ones(size, bool)
        new[1:] = (m["gram"][1:] != m["gram"][:-1]) | (m["i"][1:] != m["i"][:-1]) | (m["j"][1:] != m["j"][:-1])
        group = np.cumsum(new) - 1
        if heads:
            order = np.lexsort((m["node"], m["n"], m["at"] - m["before"], group))
            first = order[np.flatnonzero(new)]  # groups are contiguous in either order
            sides = [(order, first[group[order]]), (order[1:], order[:-1])]
            for x, y in sides:
                stay = (x != y) & (group[x] == group[y])
                yield passed(m, x[stay], y[stay])
            return
        last = np.r_[np.flatnonzero(new)[1:], size][group] - 1
        x, step = np.arange(size), 1
        while True:
            x = x[x + step <= last[x]]
            x = x[100 * m["n"][x] >= percent * m["n"][x + step]]  # sizes rise: who fails now fails further on
            if not len(x):
                return
            yield passed(m, x, x + step)
            step += 1

    def pairs(m):
        found = [(np.minimum(m["node"][x], m["node"][y]), np.maximum(m["node"][x], m["node"][y])) for x, y in compared(m) if len(x)]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        stay = np.ones(len(a), bool)
        stay[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[stay]), pa.array(b[stay])], names=["a", "b"])

    def run(batches):
        names, rest = ("gram", "i", "j", "side", "n", "node", "at", "before", "label"), None
        held, size = [], 0

        def joined():
            return {k: np.concatenate([h[k] for h in held]) for k in (*names, "suffix")}

        for batch in batches:
            part = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names} | {"suffix": _matrix(batch.column("suffix"), np.uint8, PARTS)}
            part |= {k: part[k].astype(np.int64) for k in ("n", "at", "before")}
            held.append(part)
            size += batch.num_rows
            if size >= CHUNK:
                m = joined()
                same = (m["gram"] == m["gram"][-1]) & (m["i"] == m["i"][-1]) & (m["j"] == m["j"][-1])
                cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut:
                    yield pairs({k: v[:cut] for k, v in m.items()})
                held, size = [{k: v[cut:] for k, v in m.items()}], 0
        if held:
            yield pairs(joined())

    return run


def _chosen(n: int, bits):
    """(id, text) to (id, k1, k2, grams) for the texts whose id is in the filter, packed bits; others are not even split."""

    def run(batches):
        wanted = bits.value
        for batch in batches:
            rows = []
            slots = _slots(batch.column(0).to_numpy(zero_copy_only=False), 8 * len(wanted))
            chosen = wanted[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1
            for i, (doc, data) in enumerate(zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True)):
                if chosen[i] and data is not None:
                    grams = ngram_set(data, n)
                    rows.append((doc, *set_key(grams), grams.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "k1", "k2", "grams"])

    return run


def _slots(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """Packed bits, one for each slot that one of ``ids`` (node) falls in. Blocks of bits are joined by key, the driver gets at most 16 MB."""
    width = 1 << LEAST_BITS
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (8 * ids.count()).bit_length()))

    def local(batches):
        for pdf in batches:
            slots = np.unique(_slots(pdf.node.to_numpy(), size))
            yield pd.DataFrame({"block": slots // width, "slot": slots % width})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(width, bool)
        bits[pdf.slot.to_numpy()] = True
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    slots = ids.mapInPandas(local, "block long, slot long").distinct()  # at most ``width`` for a block
    bits = np.zeros(size // 8, np.uint8)
    for row in slots.groupBy("block").applyInPandas(joined, "block long, bits binary").collect():
        bits[row.block * width // 8 : (row.block + 1) * width // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return run


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each of ``nodes`` (id) reaches over ``edges`` (a, b).

    Every round points each label at the least one next to it, follows the pointers to their ends and
    contracts the edges; rounds end when no edge joins two labels. Each round starts from written tables.
    """
    labels = None
    rest = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("up"))
        up = stage(up, "pointers")
        while True:
            far = up.alias("x").join(up.select(F.col("id").alias("m"), F.col("up").alias("far")), F.col("up") == F.col("m")).select("id", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved"))
            far, passed = stage(far, "pointers"), up
            ended = far.where("moved").isEmpty()
            discard(passed)
            up = far.select("id", "up")
            up.staged_at = far.staged_at
            if ended:
                break
        if labels is None:
            labels = stage(up, "labels")
        else:
            known = labels
            labels = stage(known.join(up.select(F.col("id").alias("m"), F.col("up").alias("far")), F.col("up") == F.col("m"), "left").select("id", F.coalesce("far", "up").alias("up")).unionByName(up.join(known.select("id"), "id", "left_anti")), "labels")
            discard(known)
        to = up.select(F.col("id").alias("m"), F.col("up").alias("far"))
        left = rest.join(to, F.col("a") == F.col("m")).select(F.col("far").alias("a"), "b").join(to, F.col("b") == F.col("m")).select("a", F.col("far").alias("b"))
        left = stage(left.where("a <> b").distinct(), "edges")
        discard(rest, up)
        rest = left
    discard(rest)
    if labels is None:
        return nodes.select("id", F.col("id").alias("label"))
    return nodes.select("id").join(labels.select(F.col("id").alias("m"), "up"), F.col("id") == F.col("m"), "left").select("id", F.coalesce("up", "id").alias("label"))


class _Join:
    """The sets of a table, its nodes (different sets, by a number) and the alive n-grams of their prefixes."""

    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str):
        self.n, self.percent, self.spark = n, percent, docs.sparkSession
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.table = self.spark.sparkContext.broadcast(frequent_ngrams(self.rows.select("text"), n))
        made = self.rows.mapInArrow(_sets(n, percent, self.table), "id long, k1 long, k2 long, n_grams int, prefix array<long>, parts binary")
        self.sets = stage(made, "sets")
        solid = self.sets.where("id IS NOT NULL AND n_grams > 0")
        # The number comes with the written rows; ``first`` is the smallest id that has the set.
        nodes = solid.groupBy(*KEYS).agg(F.min("id").alias("first"), F.any_value("prefix").alias("prefix"), F.any_value("parts").alias("parts"))
        self.nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        # Different sets under one id are one document: their nodes are joined by an edge.
        several = solid.groupBy("id").agg(F.min(F.struct(*KEYS)).alias("lo"), F.max(F.struct(*KEYS)).alias("hi")).where("lo <> hi").select("id")
        own = solid.select("id", *KEYS).join(several, "id").distinct().join(self.nodes.select(*KEYS, "node"), KEYS)
        edges = own.withColumn("a", F.min("node").over(Window.partitionBy("id"))).where("a <> node").select("a", F.col("node").alias("b"))
        self.shared = stage(edges, "shared")
        self.alive = self._alive()

    def _alive(self) -> DataFrame:
        """(node, alive, blocks): the places of a node's prefix whose n-gram another prefix of a fitting size holds too.

        The members of each n-gram are counted first. Where they are more than BLOCK they are cut into blocks, and count as alive.
        """
        flat = self.nodes.select("node", "n_grams", F.posexplode("prefix").alias("at", "gram"))
        counts = flat.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        counts = counts.select(F.col("gram").bitwiseXOR(F.lit(_OTHER)).alias("key"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
        met = flat.withColumn("key", F.col("gram").bitwiseXOR(F.lit(_OTHER)))
        # In the order of size a set's neighbours are the nearest in size: if both fail the length filter, all others do.
        by_size = Window.partitionBy("key").orderBy("n_grams", "node")
        below, above = F.lag("n_grams").over(by_size), F.lead("n_grams").over(by_size)
        fits = F.coalesce(below * 100 >= F.col("n_grams") * self.percent, F.lit(False)) | F.coalesce(F.col("n_grams") * 100 >= above * self.percent, F.lit(False))
        few = met.join(counts.where("blocks = 1"), "key").withColumn("fits", fits).where("fits")
        many = met.join(counts.where("blocks > 1"), "key")
        found = few.select("node", "at", "blocks").unionByName(many.select("node", "at", "blocks"))
        return stage(found.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "blocks"))).alias("x")).select("node", F.col("x.at").alias("alive"), F.col("x.blocks").alias("blocks")), "alive")

    def candidates(self, labels: DataFrame | None, heads: bool) -> DataFrame:
        """Distinct pairs (a, b), a < b, that pass the filters; with ``labels`` (id, label) only those across labels.

        n-grams whose members all have one label lead to no pair, so they go before any member is copied to a cell.
        """
        chosen = self.alive.select("node", F.col("alive").alias("chosen"), "blocks")
        if labels is not None:
            owned = self.alive.join(labels.select(F.col("id").alias("m"), "label"), F.col("node") == F.col("m")).select("node", "label", F.posexplode(F.arrays_zip("alive", "blocks")).alias("k", "x")).select("node", "label", "x.*")
            flat = owned.join(self.nodes.select("node", "prefix"), "node").select("node", "label", F.col("alive").alias("at"), "blocks", F.get("prefix", F.col("alive")).alias("gram"))
            mixed = flat.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("gram").bitwiseXOR(F.lit(_OTHER)).alias("key"))
            left = flat.withColumn("key", F.col("gram").bitwiseXOR(F.lit(_OTHER))).join(mixed, "key", "left_semi")
            chosen = left.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "blocks"))).alias("x")).select("node", F.col("x.at").alias("chosen"), F.col("x.blocks").alias("blocks"))
        nodes = chosen.join(self.alive.select("node", "alive"), "node").join(self.nodes.select("node", "n_grams", "prefix", "parts"), "node")
        if labels is None:
            nodes = nodes.withColumn("label", F.col("node"))
        else:
            nodes = nodes.join(labels.select(F.col("id").alias("m"), "label"), F.col("node") == F.col("m"))
        shape = "gram long, i int, j int, side byte, n int, node long, at int, before int, label long, suffix binary"
        members = nodes.select("node", "n_grams", "prefix", "parts", "alive", "chosen", "blocks", "label").mapInArrow(_members(not heads), shape)
        sorted_ = members.repartition(partitions(self.spark), "gram", "i", "j").sortWithinPartitions("gram", "i", "j", "n", "node")
        return sorted_.mapInArrow(_met(self.percent, heads), "a long, b long").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, linked), on whole sets. Only the sets of these pairs are made again from the texts and shuffled."""
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stage(self.nodes.join(nodes, "node").select(F.col("first").alias("id"), *KEYS[:2], "node"), "wanted")
        chosen = self.spark.sparkContext.broadcast(_filter_of(wanted.select(F.col("id").alias("node"))))
        made = self.rows.where("id IS NOT NULL").mapInArrow(_chosen(self.n, chosen), "id long, k1 long, k2 long, grams binary")
        grams = stage(made.join(wanted, ["id", "k1", "k2"]).dropDuplicates(["node"]).select("node", "grams"), "grams")
        a = grams.select(F.col("node").alias("a"), F.col("grams").alias("a_grams"))
        b = grams.select(F.col("node").alias("b"), F.col("grams").alias("b_grams"))
        done = stage(pairs.join(a, "a").join(b, "b").select("a", "b", "a_grams", "b_grams").mapInArrow(_verify(self.percent), "a long, b long, linked boolean"), "verified")
        discard(wanted, grams)
        return done

    def labels(self) -> DataFrame:
        """(id, label) of the nodes with alive n-grams or an id in common: the smallest node reachable."""
        every = self.alive.select(F.col("node").alias("id")).unionByName(self.shared.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
        pairs = stage(self.candidates(None, heads=True), "pairs")
        tested = self.verified(pairs)
        discard(pairs)
        edges = tested.where("linked").select("a", "b").unionByName(self.shared)
        found = stage(components(every, edges), "components")
        pairs = stage(self.candidates(found, heads=False).join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            discard(pairs, tested)
            return found
        rest = self.verified(pairs)
        discard(pairs)
        last = stage(components(every, edges.unionByName(rest.where("linked").select("a", "b"))), "components")
        discard(tested, rest, found)
        return last

    def components(self) -> DataFrame:
        """(k1, k2, n_grams, component_id): the smallest id of the sets reachable from each set."""
        labels = self.labels()
        found = self.nodes.select(*KEYS, "node", "first").join(labels.select(F.col("id").alias("m"), "label"), F.col("node") == F.col("m"), "left").select(*KEYS, "first", F.coalesce("label", "node").alias("label"))
        least = found.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "l")
        return stage(found.join(least, F.col("label") == F.col("l")).select(*KEYS, "component_id"), "named")

    def links(self) -> DataFrame:
        """(a, b): all pairs of linked nodes."""
        return self.verified(stage(self.candidates(None, heads=False), "pairs")).where("linked").select("a", "b")

    def discard(self) -> None:
        """Deletes what only the join itself reads."""
        discard(self.nodes, self.alive, self.shared)


def link_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row for each row of ``docs``.

    A-Z are lower-cased and words are runs of characters other than U+0020 and U+0009 to U+000D. The set of a text
    holds its distinct ``n``-grams, or its whole sequence of words if that is shorter; null texts and texts
    without words have an empty set and are linked with nothing. Two rows link when 100 * intersection >=
    ``percent`` * union. component_id is the smallest id reachable by links, itself included. link_pairs has the links
    themselves. Rows with equal ids are one document, which has all of their sets, and so one component; rows with a null id come back with a null
    component. Only the two columns are read, so others can't clash. An empty table gives no rows.
    """
    join = _Join(docs, n, percent, id_col, text_col)
    named = join.components().select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("n_grams").alias("n3"), "component_id")
    join.discard()
    sets = join.sets.select("id", *KEYS)
    out = sets.join(named, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")) & (F.col("n_grams") == F.col("n3")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n_grams").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def link_pairs(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (a, b), a < b, of the smallest ids of two linked sets, and the membership (id, node) of ids in sets, which go by their smallest id.

    Its rows are as many as there are links between different sets, which for m mutual near copies is about m * m / 2. Sets that begin with
    one id, as rows repeated under it with other texts have, are not told apart.
    """
    join = _Join(docs, n, percent, id_col, text_col)
    links, first = join.links(), join.nodes.select("node", "first")
    links = links.join(first.select(F.col("node").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("node").alias("b"), F.col("first").alias("y")), "b")
    members = join.sets.where("id IS NOT NULL").select("id", *KEYS).join(join.nodes.select(*KEYS, "first"), KEYS).select("id", F.col("first").alias("node")).distinct()
    return links.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), members


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), n=4, percent=85)


def stage_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id."""
    found = link_documents(docs)
    stay = found.where("component_id = doc_id").select(F.col("doc_id").alias("s_id")).distinct()
    return docs.join(stay, F.col("doc_id") == F.col("s_id"), "left_semi").unionByName(docs.where("doc_id IS NULL"))


def brute_force(rows: list[tuple[int, str | None]], n: int, percent: int) -> list[tuple[int, int, int]]:
    """(id, set size, component) by comparing all pairs of sets of words; for tests."""
    sets = []
    for i, text in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append((i, {tuple(folded[p : p + n]) for p in range(max(1, len(folded) - n + 1))} if folded else set()))
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for at, (i, s) in enumerate(sets):
        shared: dict[int, int] = {}
        for g in s:
            for other in holders.setdefault(g, []):
                shared[other] = shared.get(other, 0) + 1
            holders[g].append(at)
        for other, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[other][1]) - both):
                a, b = sorted((root(i), root(sets[other][0])))
                label[b] = a
    return [(i, len(s), root(i)) for i, s in sets]
