"""Variable-capacity best-fit packing of token sequences.

Texts longer than the largest capacity are cut into pieces of that capacity and a remainder. Pieces
go to shards of about SHARD pieces, by the hash of the row's number or, where an order is given, as
consecutive pieces of that order. Each shard is packed on its own, with the sizes to open chosen jointly for all its pieces: the number of shards follows the
data, whatever the ids, so no task grows with it, and a shard loses at most its last few bins.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import stage
from lexloom.llm.mixing import PLACE

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Fixed cost of a bin in tokens (its step of the training loop).
OVERHEAD = 64
#: Attention costs a bin of so many tokens as much as all the rest: a bin of c tokens costs OVERHEAD + c + c * c / ATTENTION.
ATTENTION = 8192
#: Mean number of pieces in a shard.
SHARD = 5000
#: Slots of the mixed order that are numbered in one group.
RANGE = 1024


def token_count(text):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def bin_cost(capacity: int, overhead: int, attention: int) -> float:
    return overhead + capacity + capacity * capacity / attention


def open_size(length: int, left: int, sizes: tuple[int, ...], cost: dict[int, float]) -> int:
    """Of ``sizes`` the one whose cost for each token that it can still get is least; ties go to the smaller.

    ``left`` is what remains to be packed, ``length`` included.
    """
    return min((c for c in sizes if c >= length), key=lambda c: (cost[c] / min(c, left), c))


def best_fit(lengths: list[int], sizes: tuple[int, ...], cost: dict[int, float], smallest: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) for each of ``lengths``, which come in decreasing order, and what each bin holds.

    Each goes to the open bin that it leaves fullest (the oldest of equals); where none has room, a bin opens: of the
    least-cost size or, with ``smallest``, of the smallest that holds it.
    """
    free: list[tuple[int, int]] = []  # (room, bin), sorted
    opened: list[int] = []
    used: list[int] = []
    placed, left = [], sum(lengths)
    for n in lengths:
        at = bisect.bisect_left(free, (n, -1))
        if at == len(free):
            opened.append(sizes[bisect.bisect_left(sizes, n)] if smallest else open_size(n, left, sizes, cost))
            used.append(0)
            room, b = opened[-1], len(opened) - 1
        else:
            room, b = free.pop(at)
        placed.append((b, used[b]))
        used[b] += n
        if room > n:
            bisect.insort(free, (room - n, b))
        left -= n
    return placed, used


def least_cost(lengths: list[int], capacities: tuple[int, ...], overhead: int, attention: int) -> tuple[list[tuple[int, int]], list[int]]:
    """The cheapest of the best-fit packings over all sets of sizes to open, each bin downsized to its contents.

    All sizes are weighed together on the lengths at hand: which sizes are worth opening depends on what is left to fill
    them. With k capacities these are 2 ** (k - 1) sets, as the largest one that is needed is in each.
    """
    if not lengths:
        return [], []
    cost = {c: bin_cost(c, overhead, attention) for c in capacities}
    need = capacities[bisect.bisect_left(capacities, lengths[0])]
    smaller = [c for c in capacities if c < need]
    best = None
    for larger in (need, *(c for c in capacities if c > need)):
        for k in range(1 << len(smaller)):
            sizes = (*(c for i, c in enumerate(smaller) if k >> i & 1), larger)
            for smallest in (True, False) if len(sizes) > 1 else (True,):
                placed, used = best_fit(lengths, sizes, cost, smallest)
                total = sum(cost[capacities[bisect.bisect_left(capacities, u)]] for u in used)
                if best is None or total < best[0] - 1e-9:
                    best = total, placed, used
    return best[1], best[2]


def pack(docs: DataFrame, lengths, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, shard: int = SHARD, id_col: str = "doc_id", order: tuple[str, str] | None = None) -> DataFrame:
    """(id, piece, start, n_tokens, shard, bin, offset, capacity, used), one row for each piece.

    ``lengths`` is a Column: the tokens of a row. A bin is (shard, bin); its pieces fill [0, used) without
    gaps or overlap, and ``capacity`` is the smallest permitted one that holds ``used``. Every token of
    every row is in exactly one piece. Rows of no tokens (null or empty text) get one row of piece 0 with no
    bin (bin, offset, capacity null). Repeated rows are packed one by one, null ids too, and only the id and
    the length are read, so extra columns can't clash. An empty table gives no rows.

    ``order`` names two columns, a slot from 0 and the place in it. Each shard then holds consecutive
    pieces in that order, and shards are numbered along it; a slot must hold few rows.
    """
    capacities = tuple(sorted(set(capacities)))
    top = capacities[-1]
    n = F.greatest(F.lit(1), F.ceil(F.col("len") / top)).cast("bigint")
    place = [F.col(c).cast("bigint").alias(f"o{k}") for k, c in enumerate(order or ())]
    # Written once: the texts are read once, and a row keeps its number. Ids are text, as pandas rounds large ones beside nulls.
    rows = stage(docs.select(F.col(id_col).cast("string").alias("id"), lengths.cast("bigint").alias("len"), *place).withColumn("n", n), "lengths")
    total = int(rows.agg(F.sum("n")).first()[0] or 0)
    shards = max(1, -(-total // shard))
    if order:
        ranges = rows.withColumn("range", F.floor(F.col("o0") / RANGE))
        before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # One row for each RANGE slots.
        offsets = ranges.groupBy("range").agg(F.sum("n").alias("n")).select(F.col("range").alias("o_range"), before(Window.partitionBy(F.lit(0)).orderBy("range")).alias("offset"))
        numbered = ranges.withColumn("first", before(Window.partitionBy("range").orderBy("o0", "o1"))).join(offsets, F.col("range") == F.col("o_range"))
        numbered = numbered.withColumn("first", F.col("first") + F.col("offset"))
        to = F.floor((F.col("first") + F.col("piece")) * shards / max(1, total)).cast("bigint")
    else:
        numbered = rows.withColumn("first", F.monotonically_increasing_id())
        to = F.pmod(F.xxhash64("first", "piece"), F.lit(shards))
    pieces = numbered.select("id", "len", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("piece"))
    keyed = pieces.select("id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("len") - F.col("piece") * top).alias("n_tokens"), to.alias("shard"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        full = pdf[pdf.n_tokens > 0].copy()
        placed, used = least_cost(full.n_tokens.tolist(), capacities, overhead, attention)
        full["bin"] = [b for b, _ in placed]
        full["offset"] = [at for _, at in placed]
        full["used"] = [used[b] for b, _ in placed]
        full["capacity"] = [capacities[bisect.bisect_left(capacities, u)] for u in full.used]
        none = pdf[pdf.n_tokens <= 0].assign(bin=None, offset=None, used=0, capacity=None)
        out = pd.concat([x for x in (full, none) if len(x)] or [full])
        return out.astype({k: "Int64" for k in ("piece", "start", "n_tokens", "shard", "bin", "offset", "capacity", "used")})[["id", "piece", "start", "n_tokens", "shard", "bin", "offset", "capacity", "used"]]

    packed = keyed.groupBy("shard").applyInPandas(fill, "id string, piece long, start long, n_tokens long, shard long, bin long, offset long, capacity long, used long")
    return packed.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, token_count(F.col("text")))


def stage_pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed along the mixed order, so that every shard has the sources in their target shares."""
    return pack(docs, token_count(F.col("text")), order=PLACE)
