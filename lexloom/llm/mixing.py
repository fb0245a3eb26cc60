"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Blocks are dealt in halves, one for each slot. A source of weight w should have had w * t halves by slot t. Time is
cut into frames, which are scheduled apart from each other: at the ends of a frame each source's count is w * t rounded down
or up (by largest remainders, so that they add up to t), and what it gains in the frame are its halves there. The i-th
of c halves in a frame of M slots is released at slot floor(i * M / c) and due by slot ceil((i + 1) * M / c); in every slot
the released half with the earliest deadline goes next (earliest deadline first). A count is less than one half from its line
within the frame, and that line less than one half from w * t, so every source is less than one block from its
target at every slot, however long the schedule runs. Weights are whole parts of their sum, so nothing drifts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import partitions, stage

#: Slots of a frame at least; more where the rarest source would have less than one half in a frame.
FRAME = 500
#: A weight is a whole number of such parts of the unit.
PARTS = 10**9
BIG = "decimal(18,0)"


def source_parts(sizes: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5) -> DataFrame:
    """(source, n, p): the weight of a source is p over the sum of all p.

    ``sizes`` is (source, n). The targets are ``weights`` where given (other sources: their mean), else n ** power.
    """
    if weights:
        top = max(weights.values())
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v) / top))])
        target = F.coalesce(given[F.col("source")], F.lit(sum(weights.values()) / len(weights) / top))
    else:
        target = F.pow(F.col("n").cast("double"), F.lit(power))
    return sizes.select("source", "n", F.greatest(F.lit(1).cast("bigint"), F.round(target * PARTS).cast("bigint")).alias("p"))


def _name(value: Column, use) -> Column:
    """``use`` of a value that is computed once: a one-element array stands for a local name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _counts(t: Column, total: int) -> Column:
    """The count of each source in ``s`` after slot ``t``: p * t / total rounded down, and up for the largest remainders."""
    whole = F.lit(total).cast(BIG)

    def exact(x: Column, k: Column) -> Column:
        return _name(x["p"].cast(BIG) * t.cast(BIG), lambda y: F.struct((y % whole).cast("bigint").alias("rest"), (-k).alias("k"), ((y - y % whole) / whole).cast("bigint").alias("whole")))

    def rounded(parts: Column) -> Column:
        left = t - F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x["whole"])
        least = F.get(F.reverse(F.array_sort(F.transform(parts, lambda x: F.struct(x["rest"], x["k"])))), (left - 1).cast("int"))
        # Where nothing is left, ``least`` is null and no source is rounded up.
        return _name(least, lambda m: F.transform(parts, lambda x: x["whole"] + F.when(F.struct(x["rest"], x["k"]) >= m, 1).otherwise(0)))

    return _name(F.transform("s", exact), rounded)


def _earliest_deadlines(own: Column, slots: int) -> Column:
    """array<struct<j, nth>>: which of ``own`` (c) each of the slots goes to, and which of its halves it is."""
    width = max(1, int(slots**0.5))  # the order grows by stretches, so that it is not copied in every slot
    m = F.lit(slots).cast("bigint")

    def step(state: Column, slot: Column) -> Column:
        # Of the released halves the one with the earliest deadline; ties go to the first source.
        due = F.zip_with(own, state["done"], lambda x, i: F.when((i < x["c"]) & (F.floor(i * m / x["c"]) <= slot), F.struct(F.ceil((i + 1) * m / x["c"]).alias("d"), x["j"].alias("j"), i.alias("i"))))
        return _name(
            F.array_min(due),
            lambda p: F.struct(F.transform(state["done"], lambda n, j: F.when(j == p["j"], n + 1).otherwise(n)).alias("done"), F.concat(state["order"], F.array(F.struct(p["j"].alias("j"), p["i"].alias("nth")))).alias("order")),
        )

    none = F.array().cast("array<struct<j:int,nth:bigint>>")

    def stretch(state: Column, lo: Column) -> Column:
        start = F.struct(state["done"].alias("done"), none.alias("order"))
        part = F.aggregate(F.sequence(lo, F.least(lo + width, m) - 1), start, step)
        return _name(part, lambda p: F.struct(p["done"].alias("done"), F.concat(state["order"], p["order"]).alias("order")))

    start = F.struct(F.transform(own, lambda _: F.lit(0).cast("bigint")).alias("done"), none.alias("order"))
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), m - 1, F.lit(width).cast("bigint")), start, stretch)["order"]


def schedule(parts: DataFrame, half: int, frame: int = FRAME) -> DataFrame:
    """(source, i, slot, release, deadline): the slot of the i-th half of each source (source, n, p), for all its n rows.

    ``release`` and ``deadline`` bound the slot by the target weight alone: two halves around w * slot. A row for each
    frame, with an array of the sources, is folded over its slots; frames are spread over the tasks.
    """
    spark = parts.sparkSession
    known = parts.agg(F.sum("p").alias("total"), F.min("p").alias("least")).first()
    if known.total is None:
        return spark.createDataFrame([], parts.schema).select("source", *[F.lit(0).cast("bigint").alias(c) for c in ("i", "slot", "release", "deadline")])
    total = int(known.total)
    slots = max(frame, -(-total // known.least))
    halves = F.ceil(F.col("n") / half).cast("bigint")
    last = parts.agg(F.max(F.floor(halves.cast("double") * total / F.col("p") / slots))).first()[0]
    one = parts.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "p", halves.alias("halves")))).alias("s")).withColumn("one", F.lit(0))
    # One row, of all sources, goes to each task.
    frames = spark.range(int(last) + 2).select(F.col("id").alias("frame"), F.lit(0).alias("one")).join(F.broadcast(one), "one")
    start, end = F.col("frame") * slots, (F.col("frame") + 1) * slots
    gained = F.zip_with(_counts(start, total), _counts(end, total), lambda a, z: F.struct(a.alias("a"), (z - a).alias("c")))
    own = F.filter(F.zip_with("s", gained, lambda x, y: F.struct(x["source"].alias("source"), x["p"].alias("p"), x["halves"].alias("halves"), y["a"].alias("a"), y["c"].alias("c"))), lambda y: y["c"] > 0)
    numbered = _name(own, lambda rows: F.transform(rows, lambda y, j: y.withField("j", j)))
    order = frames.select("frame", _name(numbered, lambda rows: F.struct(rows.alias("own"), F.when(F.exists(rows, lambda y: y["a"] < y["halves"]), _earliest_deadlines(rows, slots)).alias("order"))).alias("f"))
    dealt = order.select("frame", F.col("f.own").alias("own"), F.posexplode("f.order").alias("at", "o")).select("frame", "at", F.get("own", F.col("o.j")).alias("y"), "o.nth")
    i = F.col("y.a") + F.col("nth")
    rows = dealt.select(F.col("y.source").alias("source"), i.alias("i"), (F.col("frame") * slots + F.col("at")).alias("slot"), F.col("y.p").alias("p")).where(i < F.col("y.halves"))
    per = F.lit(total).cast("double") / F.col("p")
    return rows.select("source", "i", "slot", F.greatest(F.lit(0), F.floor((F.col("i") - 1) * per) - 1).cast("bigint").alias("release"), (F.ceil((F.col("i") + 2) * per) + 1).cast("bigint").alias("deadline"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 4, power: float = 0.5, frame: int = FRAME, id_col: str = "doc_id", source_col: str = "source", carry: Column | None = None) -> DataFrame:
    """(id, source, block_no, in_block, slot, release, deadline), one row for each row of ``docs``.

    With ``carry``, a column of that name holds its value for the row, so that nothing is joined back by id.

    Each source's rows, in the order of the md5 of their ids, form blocks of ``block`` rows, an even number (the last
    may be shorter), which are dealt in halves; block numbers and slots count from 0. Reading by (slot, in_block) mixes the
    sources to their weights within less than one block, until the first of them has no rows left; its
    slots then stay empty and nothing is dropped or repeated. There may be any number of sources; a null source is one; null ids
    come first in theirs; repeated rows are placed one by one; an empty table gives no rows. Only the
    two columns and ``carry`` are used, so extra ones can't clash.

    A row's number in its source comes from ranges of (source, md5, id, row), which cut even the rows of one id: no task holds
    more than a range's rows, however large the source or however often an id is repeated.
    """
    if block < 2 or block % 2:
        raise ValueError("a block has an even number of rows")
    half = block // 2
    kept = [] if carry is None else [carry.alias("carry")]
    # A number for each row: the same in every run over the same files.
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.monotonically_increasing_id().alias("row"), *kept)
    hashed = rows.select("id", "source", "row", F.coalesce(F.md5(F.col("id").cast("string")), F.lit("")).alias("h"))
    # Written with the number of the range, so that counts and row numbers agree.
    ranged = stage(hashed.repartitionByRange(partitions(docs.sparkSession), "source", "h", "id", "row").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range and source in it
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    parts = source_parts(counts.groupBy("source").agg(F.sum("n").alias("n")), weights, power)
    within = Window.partitionBy("source", "range").orderBy("h", "id", "row")
    numbered = (
        ranged.withColumn("rn", F.row_number().over(within))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
        .select("id", "source", "row", (F.col("offset") + F.col("rn") - 1).alias("n"))
    )
    # As many rows as half blocks, so it is never broadcast, whatever its size is taken for.
    slots = schedule(parts, half, frame).withColumnRenamed("source", "s_source").hint("merge")
    placed = numbered.join(slots, F.col("source").eqNullSafe(F.col("s_source")) & (F.floor(F.col("n") / half) == F.col("i"))).select(
        "id", "source", "row", F.floor(F.col("n") / block).cast("bigint").alias("block_no"), (F.col("n") % block).cast("bigint").alias("in_block"), "slot", "release", "deadline"
    )
    names = [F.col("id").alias(id_col), F.col("source").alias(source_col), "block_no", "in_block", "slot", "release", "deadline"]
    if carry is None:
        return placed.select(*names)
    return placed.join(rows.select("row", "carry"), "row").select(*names, "carry")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


#: The place of a row in the mixed order, as stage_mix writes it: slot, and the row in the slot's block.
PLACE = ("mix_slot", "mix_place")


def stage_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each row once, and their place in the mixed order, which the next stage packs by."""
    order = mix_sources(docs, carry=F.struct(*[c for c in docs.columns if c not in PLACE]))
    return order.orderBy("slot", "in_block").select("carry.*", F.col("slot").alias(PLACE[0]), F.col("in_block").alias(PLACE[1]))


# Counts at the ends of the frames, then one recursion over the slots of all frames.
OP9_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS n FROM documents),
sizes AS (SELECT source, (count(*) + 1) // 2 AS halves, greatest(1, round(pow(count(*)::DOUBLE, 0.5) * {PARTS}))::HUGEINT AS p FROM rows GROUP BY source),
total AS (SELECT sum(p)::HUGEINT AS c, greatest({FRAME}, (sum(p) + min(p) - 1)::HUGEINT // min(p))::HUGEINT AS m FROM sizes),
last AS (SELECT max(floor(halves::DOUBLE * c / p / m))::BIGINT AS l FROM sizes, total),
ends AS (SELECT f * m AS t, f, source, p, halves, p * f * m // c AS whole, p * f * m % c AS rest FROM sizes, total, last, range(0, l + 3) AS r(f)),
counts AS (SELECT f, source, p, halves, whole + CASE WHEN row_number() OVER (PARTITION BY f ORDER BY rest DESC, source) <= t - sum(whole) OVER (PARTITION BY f) THEN 1 ELSE 0 END AS a FROM ends),
own AS (SELECT x.f, x.source, x.p, x.halves, x.a::BIGINT AS a, (z.a - x.a)::BIGINT AS c FROM counts x JOIN counts z ON z.f = x.f + 1 AND z.source = x.source WHERE z.a > x.a),
lists AS (SELECT f, list(c ORDER BY source) AS cs, list(source ORDER BY source) AS src, (SELECT m FROM total)::BIGINT AS m FROM own GROUP BY f),
run(f, slot, done, best) AS (
  SELECT f, -1::BIGINT, list_transform(cs, lambda x: 0::BIGINT), 0::BIGINT FROM lists
  UNION ALL
  SELECT f, slot + 1, list_transform(done, lambda d, k: CASE WHEN k = best THEN d + 1 ELSE d END), best
  FROM (SELECT f, slot, done, list_min(list_filter(list_transform(cs, lambda c, k:
          CASE WHEN done[k] < c AND floor(done[k] * m / c) <= slot + 1 THEN ceil((done[k] + 1) * m / c)::BIGINT * 100000 + k END),
          lambda x: x IS NOT NULL)) % 100000 AS best FROM run JOIN lists USING (f) WHERE slot < m - 1)),
slots AS (SELECT r.f * m + r.slot AS slot, r.f, src[best] AS source, done[best] - 1 AS nth FROM run r JOIN lists USING (f) WHERE r.slot >= 0),
dealt AS (SELECT s.source, o.a + nth AS i, s.slot, (SELECT c FROM total)::DOUBLE / p AS per FROM slots s JOIN own o ON o.f = s.f AND o.source = s.source)
SELECT doc_id, r.source, n // 4 AS block_no, n % 4 AS in_block, slot::BIGINT AS slot, greatest(0, floor((i - 1) * per) - 1)::BIGINT AS release, (ceil((i + 2) * per) + 1)::BIGINT AS deadline
FROM rows r JOIN dealt d ON d.source = r.source AND d.i = n // 2
"""
