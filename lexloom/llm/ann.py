"""Approximate nearest neighbours by cosine over balanced posting lists.

A bounded sample is split again and again at the median into leaves of equal size, whose centres are the centroids.
The centroids form a graph of near neighbours that is searched best-first in memory. Every vector goes to the list
of its nearest centroid and, near a boundary, to further lists, unless a list already chosen lies
closer to that centroid. A query reads the lists whose centroids are within a ratio of the nearest one's
distance. Lists and their queries are cut into blocks, which meet by a join on the block; each block is one
matrix product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import stage

#: About so many vectors, spread by hash, place the centroids.
SAMPLE = 65_536
#: Vectors of a list; a sample of LEAF of them, or more, places its centroid. At most SAMPLE / LEAF lists.
LIST, LEAF = 128, 16
#: Neighbours of a centroid in the graph.
DEGREE = 16
#: Copies of a vector at most, and how much farther than the nearest centroid others may be.
COPIES, COPY_RATIO = 4, 1.15
#: Lists that a query reads at most and at least, and how much farther than the nearest their centroids may be.
PROBES, LEAST_PROBES, PROBE_RATIO = 128, 12, 1.6
#: Vectors and queries of a block.
BLOCK, QUERY_BLOCK = 4096, 2048
#: Cosines, or components of vectors, that are held at once.
CELLS = 1 << 20
#: Cosines of a matrix product that differ by less may be ties.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Unit centres of leaves of nearly equal size."""
    rng, leaves = np.random.default_rng(seed), []

    def split(part: np.ndarray, parts: int) -> None:
        if parts <= 1 or len(part) < 2:
            leaves.append(part)
            return
        ends = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            near = (part @ ends.T).argmax(axis=1)
            ends = np.stack([part[near == k].mean(axis=0) if (near == k).any() else part[rng.integers(len(part))] for k in (0, 1)])
        order = np.argsort(part @ (ends[1] - ends[0]), kind="stable")
        left = parts // 2
        cut = len(part) * left // parts
        split(part[order[:cut]], left)
        split(part[order[cut:]], parts - left)

    split(x, lists)
    means = np.stack([leaf.mean(axis=0) for leaf in leaves if len(leaf)])
    norms = np.sqrt((means * means).sum(axis=1, keepdims=True))
    return np.where(norms > 1e-12, means / np.maximum(norms, 1e-12), np.eye(1, x.shape[1]))


class CentroidGraph:
    """Centroids, each linked to its nearest ones and to the next, so that all are reachable."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.centroids, n = centroids, len(centroids)
        near = np.argsort(-(centroids @ centroids.T), axis=1, kind="stable")[:, 1 : degree + 1]
        self.links = np.hstack([near, ((np.arange(n) + 1) % n)[:, None]])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def search(self, x: np.ndarray, width: int, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best centroids found for each row of ``x``, best first, and their cosines."""
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        width = min(width, n)
        seen = np.full((len(x), n), -np.inf)
        seen[:, self.entries] = x @ self.centroids[self.entries].T
        done = np.zeros((len(x), n), bool)
        for _ in range(steps):
            top = np.argpartition(-seen, width - 1, axis=1)[:, :width]
            open_ = np.where(done[rows, top] | np.isneginf(seen[rows, top]), -np.inf, seen[rows, top])
            if np.isneginf(open_).all():
                break
            pick = top[rows, np.argsort(-open_, axis=1)[:, :4]]
            done[rows, pick] = True
            reached = self.links[pick].reshape(len(x), -1)
            seen[rows, reached] = np.einsum("bd,bmd->bm", x, self.centroids[reached])
        top = np.argpartition(-seen, width - 1, axis=1)[:, :width]
        top = top[rows, np.argsort(-seen[rows, top], axis=1, kind="stable")]
        return top, seen[rows, top]


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def lists_of_vectors(graph: CentroidGraph, x: np.ndarray) -> list[np.ndarray]:
    """For each unit vector its own list and, near a boundary, further ones."""
    top, cosine = graph.search(x, COPIES * 3)
    far = _distance(cosine)
    out = []
    for row, d in zip(top, far, strict=True):
        chosen = [row[0]]
        for c, dc in zip(row[1:], d[1:], strict=True):
            if len(chosen) == COPIES or dc > COPY_RATIO * d[0] + 1e-9:
                break
            if _distance(graph.centroids[chosen] @ graph.centroids[c]).min() >= dc:  # else a chosen list covers that side
                chosen.append(c)
        out.append(np.array(chosen))
    return out


def lists_of_queries(graph: CentroidGraph, x: np.ndarray) -> list[np.ndarray]:
    top, cosine = graph.search(x, PROBES)
    far = _distance(cosine)
    return [row[: max(LEAST_PROBES, int((d <= PROBE_RATIO * d[0] + 1e-9).sum()))] for row, d in zip(top, far, strict=True)]


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), np.float64)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id whose vector is not null, zero, or holding null or non-finite components."""
    v = F.col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & good).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))


def best_of_block(q: np.ndarray, own: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of queries, ids of vectors, scores): for each row of ``q`` the ``k`` nearest rows of ``v`` with other ids, ties to the smaller id.

    A slice of queries at a time, of at most CELLS cosines; all that may be among the nearest get exact scores, CELLS components at a time,
    however many of them tie.
    """
    u, norms, out = unit(v).T, np.sqrt((v * v).sum(axis=1)), []
    step, few = max(1, CELLS // len(v)), max(1, CELLS // v.shape[1])
    for lo in range(0, len(q), step):
        part, part_ids = q[lo : lo + step], own[lo : lo + step]
        cosine = unit(part) @ u
        cosine[part_ids[:, None] == ids[None, :]] = -np.inf
        last = np.partition(cosine, -k, axis=1)[:, -k] if cosine.shape[1] > k else np.full(len(part), -2.0)
        rows, at = np.nonzero((cosine >= last[:, None] - SLACK) & (cosine > -np.inf))
        # The score itself: the same sums whatever block a vector is in.
        score, part_norms = np.empty(len(rows)), np.sqrt((part * part).sum(axis=1))
        for p in range(0, len(rows), few):
            r, a = rows[p : p + few], at[p : p + few]
            score[p : p + few] = (part[r] * v[a]).sum(axis=1) / (part_norms[r] * norms[a])
        order = np.lexsort((ids[at], -score, rows))
        rows, at, score = rows[order], at[order], score[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(part)))[rows] < k
        out.append((part_ids[rows[best]], ids[at[best]], score[best]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``base`` with the largest cosine found for each query.

    Ranks count from 1, ties go to the smaller id, a query's own id is no candidate. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do those of another length than most of the
    sample, nor rows without an id. Rows repeated under one id are one candidate; of different query vectors under one id the
    smallest asks. Of equal vectors the k + 1 with the smallest ids
    are indexed, which are all that can be returned, so a hot vector can't fill a list. Only the two columns are read.
    Empty tables give no rows. Every other row is indexed; scores are computed on the original vectors in double precision.
    """
    spark = base.sparkSession
    same = Window.partitionBy("v").orderBy("id")
    distinct = stage(valid_vectors(base, id_col, vector_col).dropDuplicates(["id", "v"]).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r"), "vectors")
    wanted = valid_vectors(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    shape = "query_id long, rank int, vec_id long, score double"
    total = distinct.count()
    if not total:
        return spark.createDataFrame([], shape)
    sample = distinct.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= min(1.0, SAMPLE / total) * 1_000_003).select("v").toPandas().v.tolist()
    sample = sample or [distinct.first().v]
    lengths = pd.Series([len(v) for v in sample]).value_counts()
    size = int(lengths[lengths == lengths.max()].index.min())
    x = unit(np.array([v for v in sample if len(v) == size], np.float64))
    # The lists follow the table until the sample, a bounded one, can place no more.
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(x, max(1, min(len(x) // LEAF, total // LIST)))))

    def listed(choose):
        def run(batches):
            for pdf in batches:
                pdf = pdf[[len(v) == size for v in pdf.v]]
                for lo in range(0, len(pdf), 1024):
                    part = pdf.iloc[lo : lo + 1024]
                    lists = choose(graph.value, unit(_matrix(part.v)))
                    at = np.repeat(np.arange(len(part)), [len(n) for n in lists])
                    yield pd.DataFrame({"list": np.concatenate(lists).astype(np.int32), "id": part.id.to_numpy()[at], "v": part.v.to_numpy()[at]})

        return run

    shape_in = "list int, id long, v array<double>"
    index = stage(distinct.mapInPandas(listed(lists_of_vectors), shape_in), "lists")
    asked = stage(wanted.mapInPandas(listed(lists_of_queries), shape_in), "asked")
    # One row for each list: at most SAMPLE / LEAF, 4096.
    counts = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("query_blocks")), "list")
    counts = F.broadcast(counts)
    vectors = index.join(counts, "list").select("list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), "id", "v")
    asking = asked.join(counts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.col("query_blocks")).cast("int").alias("query_block"), "id", "v")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = best_of_block(_matrix(left.v), left.id.to_numpy(), _matrix(right.v), right.id.to_numpy(), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["list", "block", "query_block"]
    met = asking.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def brute_force(rows: list[tuple[int, list[float]]], queries: set[int], k: int = 5) -> dict[int, list[tuple[int, float]]]:
    """The exact nearest rows; for tests and for measuring recall."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    u, out = unit(v), {}
    for at in np.flatnonzero(np.isin(ids, list(queries))):
        cosine = u @ u[at]
        order = [j for j in np.lexsort((ids, -np.round(cosine, 14))) if ids[j] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[j]), float(cosine[j])) for j in order]
    return out
