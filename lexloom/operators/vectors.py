"""Vector artifacts: inputs, chunk plans, weighted aggregation, derivation, comparability and integrity."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import canonical_hash
from lexloom.functions.vectors import FORMATS, TOLERANCES, doubles, encode, finite, l2_normalize, norm
from lexloom.session import cut


@dataclass(frozen=True)
class Profile:
    """How texts become vectors. The space id leaves out what does not change the numbers."""

    name: str
    prefix: str = ""
    format: str = "float32"
    limit: int = 512
    margin: int = 0
    revision: str = "0" * 40
    cut_at: int | None = None
    batch: int = 16

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ValueError(f"format {self.format}")
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or self.limit <= 2 or not 0 <= self.margin < self.limit - 2:
            raise ValueError("limit and margin leave no room")
        if len(self.revision) not in (40, 64) or set(self.revision) - set("0123456789abcdef"):
            raise ValueError("revision is no pinned hash")

    def space_id(self, with_prefix: bool = True) -> str:
        parts = [self.revision, self.format, self.prefix if with_prefix else "-"]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()


# The four profiles.
PROFILES = {p.name: p for p in (Profile("query", "query: "), Profile("passage", "passage: "), Profile("symmetric", "query: "), Profile("legacy", "passage: ", "float16", cut_at=2000))}


def comparable(a: Profile, b: Profile) -> str | None:
    """ "symmetric" in one space, "retrieval" from query to passage in spaces equal but for the prefix, else None."""
    if a.space_id() == b.space_id():
        return "symmetric"
    if (a.prefix, b.prefix) == ("query: ", "passage: ") and a.space_id(False) == b.space_id(False):
        return "retrieval"
    return None


def inputs(units: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, kind, ord, text): focus and window of each unit (doc_id, ord, focus, window), and each document."""
    focus = units.select("doc_id", F.lit("focus").alias("kind"), "ord", F.col("focus").alias("text"))
    window = units.select("doc_id", F.lit("window").alias("kind"), "ord", F.col("window").alias("text"))
    return focus.unionByName(window).unionByName(docs.select("doc_id", F.lit("document").alias("kind"), F.lit(0).cast("long").alias("ord"), "text"))


def input_budget(rows: DataFrame) -> DataFrame:
    """One row: distinct inputs and their bytes."""
    return rows.select(F.sha2("text", 256).alias("h"), F.octet_length("text").cast("long").alias("n")).distinct().agg(F.count(F.lit(1)).alias("inputs"), F.sum("n").alias("bytes"))


def cache_key(config: Column, text: Column, tokens: Column) -> Column:
    return canonical_hash(config=config, input=text, tokens=tokens)


def code_points(text: str) -> list[tuple[int, int]]:
    """The test tokenizer: one token for each code point."""
    return list(zip(range(len(text)), range(1, len(text) + 1), strict=True))


def plan_chunks(text: str, tokenize: Callable[[str], list[tuple[int, int]]], limit: int, stops: list[int]) -> list[tuple[int, int]]:
    """Contiguous chunks covering ``text``, each of at most ``limit`` tokens, cut after a sentence end (``stops``) where one is inside.

    A chunk without anything but white space joins the one before, else the one after. A blank text has no chunks.
    """
    if not text.strip():
        return []
    spans = tokenize(text)
    stops, starts = sorted(stops), [a for a, _ in spans] if stops else []  # looked up only for a stop
    chunks, at, first = [], 0, 0
    while first < len(spans):
        last = min(first + limit, len(spans))
        if last == len(spans):
            end, last = len(text), len(spans)
        else:
            end = spans[last][0]
            k = bisect_right(stops, end)  # the last stop that is not behind the chunk
            if k and stops[k - 1] > at:
                after = bisect_left(starts, stops[k - 1], first + 1, last + 1)
                if after <= last:
                    end, last = stops[k - 1], after
        chunks.append([at, end])
        at, first = end, last
    merged: list[list[int]] = []
    for a, b in chunks:
        if merged and (not text[a:b].strip() or not text[merged[-1][0] : merged[-1][1]].strip()):
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def chunk_plan(texts: DataFrame, limit: int, tokenize: Callable[[str], list[tuple[int, int]]] = code_points, specials: int = 2) -> DataFrame:
    """(doc_id, chunk, start, end, tokens) for texts (doc_id, text, stops): one pass in Arrow batches, no shuffle."""
    room = limit - specials

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, stops in zip(pdf.doc_id, pdf.text, pdf.stops, strict=True):
                for k, (a, b) in enumerate(plan_chunks(text or "", tokenize, room, list(stops) if stops is not None else [])):
                    rows.append((doc, k, a, b, len(tokenize(text[a:b])) + specials))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "end", "tokens"])

    return texts.select("doc_id", "text", "stops").mapInPandas(run, "doc_id long, chunk long, start long, end long, tokens long")


def hashing_embedder(dim: int = 16) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed counts of hashed letters triples."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
            x = np.concatenate([x, np.zeros(max(0, 3 - len(x)), np.uint64)])
            h = ((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]) * np.uint64(0x9E3779B97F4A7C15)
            out[i] = np.bincount((h >> np.uint64(40)).astype(np.int64) % dim, np.where(h >> np.uint64(63), 1.0, -1.0), dim)
            if not out[i].any():
                out[i, 0] = 1
        return out

    return embed


def embed_distinct(rows: DataFrame, embed: Callable[[list[str]], np.ndarray], batch: int = 16) -> DataFrame:
    """(input_sha256, v): every different text once, in batches; a wrong count or a non-finite value is an error."""
    once = rows.select(F.sha2("text", 256).alias("input_sha256"), "text").groupBy("input_sha256").agg(F.first("text").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                got = np.asarray(embed(part.text.tolist()), np.float64)
                if len(got) != len(part) or not np.isfinite(got).all():
                    raise ValueError("the embedder's answer does not fit its input")
                yield pd.DataFrame({"input_sha256": part.input_sha256.to_numpy(), "v": list(got)})

    return once.mapInPandas(run, "input_sha256 string, v array<double>")


def artifacts(vectors: DataFrame, kind: str = "float32") -> DataFrame:
    """Adds unit vectors' bytes in ``kind``, their hash and the content id; what can't be normalised is left null."""
    packed = vectors.withColumn("unit", l2_normalize(doubles(F.col("v")))).withColumn("bytes", encode(kind)("unit"))
    return packed.withColumn("sha256_bytes", F.sha2("bytes", 256)).withColumn("artifact_id", F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.lit(kind), F.size("unit").cast("string"), "sha256_bytes"), 256))).withColumn("format", F.lit(kind)).withColumn("dim", F.size("unit"))


def weighted_mean(rows: DataFrame, key: str) -> DataFrame:
    """(key, v): the mean of vectors (key, v, w) by weight, dimension by dimension; weights have to be positive.

    Components are summed with partial aggregation, so a large group is never gathered.
    """
    good = rows.where("w > 0").select(key, "w", F.posexplode(doubles(F.col("v"))).alias("pos", "x"))
    sums = good.groupBy(key, "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("v"))


def content_tokens(starts: Column, ends: Column, special: Column, prefix: int) -> Column:
    """Tokens that are not special, not empty, and end behind the prefix."""
    return F.size(F.filter(F.arrays_zip(starts.alias("s"), ends.alias("e"), special.alias("p")), lambda t: (t["p"] == 0) & (t["e"] > prefix) & (t["e"] > t["s"]))).cast("long")


def check_matrix(rows: DataFrame, dim: int, tolerance: float = 2e-5) -> DataFrame:
    """(id, rule): vectors of the wrong length, with non-finite values, or off the unit norm."""
    v = doubles(F.col("v"))
    rule = F.when(F.col("v").isNull() | (F.size("v") != dim), "dimension").when(~finite(v), "finite").when(F.abs(norm(v) - 1) > tolerance, "norm")
    return rows.select("id", rule.alias("rule")).where("rule IS NOT NULL")


def check_vectors(stored: DataFrame) -> DataFrame:
    """(artifact_id, rule) for artifacts whose bytes, length or norm do not hold."""
    width = F.create_map(*[x for k, n in (("float16", 2), ("float32", 4), ("float64", 8)) for x in (F.lit(k), F.lit(n))])
    slack = F.create_map(*[x for k, n in TOLERANCES.items() for x in (F.lit(k), F.lit(n))])
    rule = F.when(F.sha2("bytes", 256) != F.col("sha256_bytes"), "hash").when(F.octet_length("bytes") != F.col("dim") * width[F.col("format")], "length").when(F.abs(norm(F.col("unit")) - 1) > slack[F.col("format")], "norm")
    return stored.select("artifact_id", rule.alias("rule")).where("rule IS NOT NULL")


def component_closure(parts: DataFrame, rounds: int = 16) -> DataFrame:
    """(artifact, component): all that an artifact is derived from, over ``parts`` (artifact, component), itself included.

    Pairs are extended level by level; derivations deeper than ``rounds`` are an error, as are circles.
    """
    edge = parts.select(F.col("artifact").alias("a"), F.col("component").alias("b")).distinct()
    everything = front = cut(parts.select("artifact", "component").distinct())
    for _ in range(rounds):
        front = cut(front.join(edge, F.col("component") == F.col("a")).select("artifact", F.col("b").alias("component")).distinct().join(everything, ["artifact", "component"], "left_anti"))
        if front.isEmpty():
            break
        everything = everything.unionByName(front)
    else:
        raise ValueError(f"derivations deeper than {rounds}")
    circle = everything.where("artifact = component").first()
    if circle is not None:
        raise ValueError(f"artifact {circle.artifact} is derived from itself")
    own = parts.select("artifact").unionByName(parts.select(F.col("component").alias("artifact"))).distinct().select("artifact", F.col("artifact").alias("component"))
    return everything.unionByName(own).distinct()


def lookup(wanted: DataFrame, representations: DataFrame, fragments: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(representation_id, fault, artifacts): each wanted representation (representation_id) with its own artifact and those of its fragments.

    ``representations`` and ``fragments`` are (representation_id, artifact_id), ``artifacts`` (artifact_id, ...), an id once. ``artifacts`` are the rows
    found, each once, by id. ``fault`` is "missing" for an unknown representation, "incomplete" if an artifact is not there; else null.
    """
    asked = wanted.select("representation_id").distinct()
    known = representations.join(asked, "representation_id", "left_semi").select("representation_id", "artifact_id")
    parts = fragments.join(known.select("representation_id").distinct(), "representation_id", "left_semi").select("representation_id", "artifact_id")
    uses = known.unionByName(parts).distinct()
    row = F.struct("artifact_id", *[c for c in artifacts.columns if c != "artifact_id"])
    met = uses.join(artifacts.select("artifact_id", row.alias("row")), "artifact_id", "left")
    lacks = F.bool_or(F.col("artifact_id").isNotNull() & F.col("row").isNull())
    found = met.groupBy("representation_id").agg(lacks.alias("lacks"), F.array_sort(F.collect_list("row")).alias("artifacts"))
    fault = F.when(F.col("artifacts").isNull(), "missing").when(F.col("lacks"), "incomplete")
    return asked.join(found, "representation_id", "left").select("representation_id", fault.alias("fault"), "artifacts")


def orphan_artifacts(used: DataFrame, present: DataFrame) -> DataFrame:
    """(artifact_id, side) of artifacts that are present but unused, or used but absent."""
    a, b = used.select("artifact_id").distinct(), present.select("artifact_id").distinct()
    return b.join(a, "artifact_id", "left_anti").withColumn("side", F.lit("unused")).unionByName(a.join(b, "artifact_id", "left_anti").withColumn("side", F.lit("absent")))
