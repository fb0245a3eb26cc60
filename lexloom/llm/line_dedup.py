"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

A line goes if the same line, or one within one edit (a character inserted, deleted or replaced), stands
earlier in the corpus. Lines within one edit share a variant: both with the same place deleted, or one with
a place deleted and the other whole. Emitting the variants of every line would take a row for each
character of the corpus, so lines that can't have such a partner are set aside first: of two lines within one
edit and over SHORT characters, a first or a last part of at least 3/8 of the shorter one is equal. The rest emit hashed
variants, equal variants are joined to the earliest line with it, and the edit distance of the pairs is
verified.

A variant's hash is made of the hashes of the text before and after a block of BLOCK characters, folded from block to block, and of the block
with one character left out, so that a long line costs two hashes for each block, and only blocks with a
context that two lines share emit variants, one short hash for each character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.arrays import let
from lexloom.llm.common import partitions

#: Lines up to this length all emit variants; longer ones only with a part that another line has too.
SHORT = 16
BLOCK = 32
#: Characters of a line that is compared as a whole.
LONG = 512
#: The hash of no text.
BASE = 42
NO_ID = (1 << 63) - 1
#: A join key other than the grouping key: both sides are dealt anew, and AQE can split hot keys.
_OTHER = 0x5DEECE66D


def _seeds(line: Column) -> Column:
    """Hashes of the first and last 8 * floor(n / 16) characters, for the line's length n and for n - 1."""
    n = F.length(line)

    def ends(size: Column) -> Column:
        return F.array(F.xxhash64(F.lit(1), size, F.substring(line, F.lit(1), size)), F.xxhash64(F.lit(2), size, F.substring(line, n - size + 1, size)))

    size = F.floor(n / 16).cast("int") * 8
    return F.when(n < SHORT, F.array().cast("array<bigint>")).when((n % 16 == 0) & (n > SHORT), F.concat(ends(size), ends(size - 8))).otherwise(ends(size))


def _chunks(text: Column) -> Column:
    """The text in pieces of BLOCK characters, the last one shorter, cut in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _running(chunks: Column) -> Column:
    """The hashes of the first 0, 1, 2 ... chunks, each from the one before; by stretches, so that the array is not copied at each step."""
    none = F.array().cast("array<bigint>")
    width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(chunks))).cast("int"))

    def step(state: Column, chunk: Column) -> Column:
        return let(F.xxhash64(state["last"], chunk), lambda h: F.struct(h.alias("last"), F.concat(state["all"], F.array(h)).alias("all")))

    def stretch(state: Column, lo: Column) -> Column:
        part = F.aggregate(F.slice(chunks, lo + 1, width), F.struct(state["last"].alias("last"), none.alias("all")), step)
        return let(part, lambda p: F.struct(p["last"].alias("last"), F.concat(state["all"], p["all"]).alias("all")))

    start = F.struct(F.lit(BASE).cast("bigint").alias("last"), F.array(F.lit(BASE).cast("bigint")).alias("all"))
    return F.when(F.size(chunks) == 0, start["all"]).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(chunks) - 1, width), start, stretch)["all"])


def _blocks(line: Column) -> Column:
    """array<struct<context, whole, part>>: each block of a line, once in full and once without its last character.

    The context is a hash of the block's place and of all the text before and after it. Lines within one edit share
    the context of the block with the edit: two of equal length those of the full blocks, else the longer one's full
    block and the shorter one's other form. What comes before and after is hashed in one fold over the blocks, from either end; for the
    other form the fold goes over the line cut one character earlier.
    """

    def made(chunks: Column, early: Column) -> Column:
        def of(before: Column, after: Column, after_early: Column) -> Column:
            def block(j: Column) -> Column:
                part, own = F.coalesce(F.get(chunks, j), F.lit("")), F.xxhash64(j, F.get(before, j))
                full = F.struct(F.xxhash64(own, F.coalesce(F.get(after, j + 1), F.lit(BASE).cast("bigint"))).alias("context"), F.lit(False).alias("whole"), part.alias("part"))
                other = F.struct(F.xxhash64(own, F.coalesce(F.get(after_early, j), F.lit(BASE).cast("bigint"))).alias("context"), F.lit(True).alias("whole"), F.substring(part, F.lit(1), F.lit(BLOCK - 1)).alias("part"))
                return F.array(full, other)

            return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.length(line) / BLOCK).cast("int")), block))

        return let(_running(chunks), lambda x: let(F.reverse(_running(F.reverse(chunks))), lambda y: let(F.reverse(_running(F.reverse(early))), lambda z: of(x, y, z))))

    return let(_chunks(line), lambda chunks: let(_chunks(F.substring(line, F.lit(BLOCK), F.length(line))), lambda early: made(chunks, early)))


def _variants(context: Column, whole: Column, part: Column) -> Column:
    """array<struct<key, role>>: role "S" for a place deleted with the place in the key, which equals that of a line
    with another character there; "D" for the same without the place, which equals "W", the whole block, of a line
    that is shorter by that character."""

    def without(i: Column) -> Column:
        rest = F.concat(F.substring(part, F.lit(1), i), F.substring(part, i + 2, F.lit(BLOCK)))
        return F.array(F.struct(F.xxhash64(F.lit(1), context, i, rest).alias("key"), F.lit("S").alias("role")), F.struct(F.xxhash64(F.lit(0), context, rest).alias("key"), F.lit("D").alias("role")))

    none = F.array().cast("array<struct<key:bigint,role:string>>")
    cut = F.when(F.length(part) == 0, none).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(part) - 1)), without)))
    return F.when(whole, F.array(F.struct(F.xxhash64(F.lit(0), context, part).alias("key"), F.lit("W").alias("role")))).otherwise(cut)


def _within_one_edit(a: Column, b: Column) -> Column:
    """Whether two lines are within one edit. Of long ones only the first chunks that differ are compared by edit distance, and the rest must be equal."""

    def differs(long: Column, short: Column) -> Column:
        shift = F.length(long) - F.length(short)

        def rest_of(j: Column) -> Column:
            at = (j - 1).cast("int") * BLOCK
            middle = F.levenshtein(F.substring(long, at + 1, F.lit(BLOCK)), F.substring(short, at + 1, BLOCK - shift), 1).between(0, 1)
            return (j == 0) | (middle & (F.substring(long, at + BLOCK + 1, F.length(long)) == F.substring(short, at + BLOCK + 1 - shift, F.length(long))))

        unequal = F.zip_with(_chunks(long), _chunks(short), lambda x, y: ~x.eqNullSafe(y))
        return shift.between(0, 1) & let(F.array_position(unequal, True), rest_of)

    near = F.when(F.length(a) >= F.length(b), differs(a, b)).otherwise(differs(b, a))
    return F.when(F.greatest(F.length(a), F.length(b)) <= LONG, F.levenshtein(a, b, 1).between(0, 1)).otherwise(near)


def _lines(rows: DataFrame) -> DataFrame:
    """(at{id, line_no, version}, line, h1, h2) for every line that is not blank."""
    lines = rows.select("id", "version", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(r"\S"))
    return lines.select(F.struct("id", "line_no", "version").alias("at"), "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(id, version, gone): for each text the numbers of its lines with an equal or similar earlier line.

    ``rows`` is (id, version, text) without nulls; lines are ordered by id, number and version.
    """
    n = partitions(rows.sparkSession)
    lines = _lines(rows)
    firsts = lines.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last"))

    # Lines that share a seed with another line.
    seeds = lines.select("at", "h1", F.explode(_seeds(F.col("line"))).alias("seed"))
    shared = seeds.groupBy("seed").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select(F.col("seed").bitwiseXOR(F.lit(_OTHER)).alias("key"))
    suspects = seeds.select("at", F.col("seed").bitwiseXOR(F.lit(_OTHER)).alias("key")).join(shared, "key", "left_semi")
    wanted = suspects.groupBy(F.col("at.id").alias("id"), F.col("at.version").alias("version")).agg(F.collect_set("at.line_no").alias("wanted"))
    # All uses of the texts by id share this exchange.
    dealt = rows.repartition(n, "id", "version")
    numbered = let(F.split("text", "\n", -1), lambda all_: F.transform("wanted", lambda i: F.struct(i.alias("line_no"), F.get(all_, i).alias("line"))))
    chosen = dealt.join(wanted, ["id", "version"]).select("id", "version", F.explode(numbered).alias("x"))
    texts = chosen.select(F.struct("id", F.col("x.line_no").alias("line_no"), "version").alias("at"), F.col("x.line").alias("line"), F.xxhash64("x.line").alias("h1"), F.hash("x.line").alias("h2"))
    texts = texts.unionByName(lines.where(F.length("line") <= SHORT))
    texts = texts.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.any_value("line").alias("line"))

    # Of those, the blocks whose context another line has too; only they emit variants.
    blocks = texts.select(F.struct("first", "h1", "h2").alias("own"), F.explode(_blocks(F.col("line"))).alias("b")).select("own", "b.*")
    met = blocks.groupBy("context").agg(F.min("own.h1").alias("lo"), F.max("own.h1").alias("hi")).where("lo <> hi").select(F.col("context").bitwiseXOR(F.lit(_OTHER)).alias("key"))
    alive = blocks.withColumn("key", F.col("context").bitwiseXOR(F.lit(_OTHER))).join(met, "key", "left_semi")
    emitted = alive.select("own", F.explode(_variants(F.col("context"), F.col("whole"), F.col("part"))).alias("v")).select("own", "v.key", "v.role")
    same = Window.partitionBy("key")
    partner = {"S": "S", "D": "W", "W": "D"}
    best = F.coalesce(*[F.when(F.col("role") == a, F.min(F.when(F.col("role") == b, F.col("own"))).over(same)) for a, b in partner.items()])
    pairs = emitted.select("own", best.alias("to")).where("to.first < own.first").distinct()
    own = texts.select("h1", "h2", "line")
    other = texts.select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.col("line").alias("t_line"))
    near = (
        pairs.select("own.h1", "own.h2", F.col("to.h1").alias("t1"), F.col("to.h2").alias("t2"))
        .join(own, ["h1", "h2"])
        .join(other, ["t1", "t2"])
        .where(_within_one_edit(F.col("line"), F.col("t_line")))
        .select("h1", "h2", F.lit(None).cast(firsts.schema["first"].dataType).alias("first"))
    )
    marks = firsts.where("first <> last").select("h1", "h2", "first").unionByName(near)
    marks = marks.select(F.col("h1").bitwiseXOR(F.lit(_OTHER)).alias("k1"), F.col("h2").alias("k2"), "first")
    hit = lines.select("at", F.col("h1").bitwiseXOR(F.lit(_OTHER)).alias("k1"), F.col("h2").alias("k2")).join(marks, ["k1", "k2"])
    gone = hit.where("first IS NULL OR at.id > first.id OR (at.id = first.id AND at.line_no > first.line_no)")
    return gone.groupBy(F.col("at.id").alias("id"), F.col("at.version").alias("version")).agg(F.collect_set("at.line_no").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_lines, n_removed, text): one row for each row of ``docs``, its text without repeated lines.

    The columns named by ``carry`` come along, in a struct of that name.

    Lines end at U+000A. A line goes if an equal line, or one within one edit, stands earlier (smaller id, then line number);
    whether that line itself stays does not matter. Blank lines always stay. Null texts stay null with no lines; empty texts have one
    blank line; null ids come after all others; repeated rows, and rows with equal ids at equal line numbers,
    take nothing from each other; only the id and the text are read, so other columns can't clash; an empty
    table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.hash(F.col(text_col)).alias("version"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.struct(*carry).alias("carry")] * bool(carry))
    found = repeated_lines(texts.select("id", "version", "text"))
    dealt = texts.repartition(partitions(docs.sparkSession), "id", "version")
    cut = dealt.join(found, ["id", "version"], "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    # The numbers left are found by a hash set, so that a text costs its lines and not their square.
    rest = let(F.split("text", "\n", -1), lambda all_: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), gone), lambda i: F.get(all_, i)), "\n"))
    # The hash of null is its seed, 42, and that of the empty text is another: together they tell null texts.
    kept = cut.select("id", F.when(F.size(gone) == 0, F.col("text")).otherwise(rest).alias("text"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_removed"), ((F.col("version") == 42) & (F.col("text") == "")).alias("none"), *["carry"] * bool(carry))
    return kept.select(
        F.nullif("id", F.lit(NO_ID)).alias(id_col), F.when(F.col("none"), F.lit(0)).otherwise(F.col("n_lines")).cast("bigint").alias("n_lines"), "n_removed", F.when(~F.col("none"), F.col("text")).alias(text_col), *["carry"] * bool(carry)
    )


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their remaining lines; those of which no words remain go, unless they had none before."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = dedup_lines(docs, carry=rest).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return kept.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), *[f"carry.{c}" for c in rest]).select(*docs.columns)


# Distinct lines with their first place; variants with one place deleted, with and without the place.
OP4_SQL = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), range(1, len(l) + 1) AS r(i)),
solid AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]')),
firsts AS (SELECT line, min((doc_id, line_no)) AS f FROM solid GROUP BY line),
fuzzy AS (SELECT row_number() OVER () AS k, line, f, length(line) AS n FROM firsts),
cut AS (SELECT k, f, i, hash(line[:i - 1] || chr(0) || line[i + 1:]) AS gap, hash(line[:i - 1] || line[i + 1:]) AS rest FROM fuzzy, range(1, n + 1) AS r(i)),
same AS (SELECT k, f, min(f) OVER (PARTITION BY gap) AS e FROM cut),
whole AS (SELECT hash(line) AS h, k, f FROM fuzzy),
pairs AS (
  SELECT k FROM same WHERE e < f
  UNION SELECT c.k FROM cut c JOIN whole w ON c.rest = w.h WHERE w.f < c.f
  UNION SELECT w.k FROM cut c JOIN whole w ON c.rest = w.h WHERE c.f < w.f),
gone AS (
  SELECT s.doc_id, s.line_no FROM solid s JOIN firsts USING (line) WHERE (s.doc_id, s.line_no) > f
  UNION SELECT s.doc_id, s.line_no FROM solid s JOIN fuzzy USING (line) WHERE k IN (SELECT k FROM pairs)),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.doc_id) AS n_removed, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE g.doc_id IS NULL) AS text
  FROM lines LEFT JOIN (SELECT doc_id AS doc_id, line_no FROM gone) g USING (doc_id, line_no) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
