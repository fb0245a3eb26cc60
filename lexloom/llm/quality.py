"""Hierarchical empirical Bayes quality classifier.

A logistic model of surface features and of hashed n-grams of characters and words gives each document's evidence. Documents of one source (the
host) and of one source and language (the path) pool theirs: the mean evidence of a path is shrunk
to its host's, the host's to the corpus's, with strengths matched to the spread between the groups. A
document's log odds are its own plus what its path's posterior adds over the corpus's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import mix64, stage, window_hashes, word_hashes

#: About so many labelled rows, spread by hash, are used to fit the evidence model.
FIT_ROWS = 20_000
#: Documents whose probability is below this are rejected.
THRESHOLD = 0.5
#: Evidence of a single document counts at most so much, in log odds.
MOST = 12.0
#: Long texts are also judged by their worst stretch of so many words.
STRETCH = 100

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper case, 2 digit, 3 plain punctuation, 4 symbol, 5 white space, 6 lower case
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 3
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 5
_CLASS[97:123] = 6
#: Slots for hashed character trigrams, words and word pairs.
SLOTS = 64
#: A letter of any script counts as itself, all else by its class, so that trigrams show the texture of a text.
_TEXTURE = np.where((_CLASS == 0) | (_CLASS == 6) | (_CLASS == 1), np.arange(256), 256 + _CLASS).astype(np.uint64)
FEATURES = ("log_words", "upper", "digits", "punctuation", "symbols", "other", "mean_word", "repeats", "distinct", "worst_symbols", "worst_upper", "worst_repeats", *(f"{k}{i}" for k in ("chars", "words", "pairs") for i in range(SLOTS)))


def _shares(hashes: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the slots that hashes fall into; zeros where there are none."""
    counts = np.bincount((mix64(hashes) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
    return np.sqrt(counts / max(1, len(hashes)))


def features(text: str) -> np.ndarray:
    """Shares of character classes, word length, repetition, hashed n-grams; zeros for an empty text."""
    data = np.frombuffer(text.encode(), np.uint8)
    words = word_hashes(data)
    if not len(words):
        return np.zeros(len(FEATURES))
    kinds = _CLASS[data]
    space = kinds == 5
    counts = np.bincount(kinds, minlength=7)
    solid = max(1, len(data) - counts[5])
    same = np.concatenate([[False], words[1:] == words[:-1]])
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    at = starts[::STRETCH]  # stretches of words
    share = lambda mask: np.add.reduceat(mask.astype(np.int64), at) / np.maximum(1, np.add.reduceat((~space).astype(np.int64), at))
    repeats = np.add.reduceat(same.astype(np.int64), np.arange(0, len(words), STRETCH)) / STRETCH
    letters = _TEXTURE[data]
    chars = letters[:-2] + np.uint64(512) * letters[1:-1] + np.uint64(1 << 18) * letters[2:]
    plain = [
        float(np.log1p(len(words))), counts[1] / solid, counts[2] / solid, counts[3] / solid, counts[4] / solid, counts[0] / solid,
        solid / len(words) / 10, float(same.mean()), len(np.unique(words)) / len(words), float(share(kinds == 4).max()), float(share(kinds == 1).max()), float(repeats.max()),
    ]
    return np.concatenate([plain, _shares(chars), _shares(words), _shares(window_hashes(words, 2))])


@dataclass(frozen=True)
class EvidenceModel:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the intercept

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -20, 20)
        return np.clip(z @ np.array(self.weights[:-1]) + self.weights[-1], -MOST, MOST)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 30.0) -> EvidenceModel:
    """Ridge logistic regression by Newton steps. Without rows of both kinds the evidence is always 0."""
    k = len(FEATURES)
    if len(set(y.tolist())) < 2:
        return EvidenceModel((0.0,) * k, (1.0,) * k, (0.0,) * (k + 1))
    mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64) + 1e-6
    penalty = np.diag([ridge] * k + [1e-6])
    w = np.zeros(k + 1)
    for _ in range(12):
        slope, bend = -penalty @ w, penalty.copy()
        for lo in range(0, len(x), 2048):  # a part at a time, so that the sample is never held twice
            z = np.hstack([np.clip((x[lo : lo + 2048] - mean) / scale, -20, 20), np.ones((len(x[lo : lo + 2048]), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (y[lo : lo + 2048] - p)
            bend += (z * (p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return EvidenceModel(tuple(mean), tuple(scale), tuple(w))


def features_of(text):
    """The features of a text column; null texts as empty ones."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t or "").astype(np.float32).tobytes())

    return of(text)


def fit_rows_of(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, x, quality): features of about ``rows`` of ``labels``, chosen by the hash of their ids, one row for each id.

    The ids chosen are bounded by ``rows``, so they are broadcast: no text is shuffled. Of several documents under one id the
    least features count, which Spark finds before anything reaches the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    found = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", features_of("text").alias("x"), "quality")
    return found.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality"))


def fit_evidence(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> EvidenceModel:
    """Fits on about ``rows`` of ``labels`` (doc_id, quality 0 or 1), 1 KB each in the driver."""
    found = fit_rows_of(docs, labels, rows).select("x", "quality").toPandas()
    x, y = np.frombuffer(b"".join(found.x), np.float32).reshape(len(found), len(FEATURES)), found.quality.to_numpy(float)
    del found
    return fit(x, y)


def evidence(model: EvidenceModel):
    """A pandas UDF text -> log odds of good quality; 0, no evidence, for null texts and texts without words."""

    @F.pandas_udf("double")
    def log_odds(texts: pd.Series) -> pd.Series:
        x = np.array([features(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
        return pd.Series(np.where(x[:, 0] > 0, model.log_odds(x), 0.0))

    return log_odds


def _probability(z):
    return 1 / (1 + F.exp(-z))


def _log_odds(p):
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, parent: str) -> float:
    """How many documents a parent's mean counts for, from the spread of ``groups`` (n, s, parent) around it."""
    m, mu = F.col("s") / F.col("n"), F.col(parent)
    row = groups.agg(
        F.sum(F.col("n") * (m - mu) * (m - mu)).alias("between"), F.sum(mu * (1 - mu)).alias("noise"), F.sum("n").alias("n"), F.sum(F.col("n") * mu * (1 - mu)).alias("total")
    ).first()
    if not row.n:
        return 1.0
    spread = max((row.between - row.noise) / row.n, 1e-6)
    return float(min(max((row.total / row.n) / spread - 1, 1.0), 1e6))


def posteriors(scored: DataFrame) -> DataFrame:
    """(source, lang, host_posterior, path_posterior, base) from (source, lang, z), by grouped aggregation.

    Null sources and languages are groups of their own.
    """
    paths = stage(scored.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum(_probability(F.col("z"))).alias("s")), "paths")
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    base = (whole.s + 1) / (whole.n + 2) if whole.n else 0.5
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("base", F.lit(base))
    k = _strength(hosts, "base")
    hosts = hosts.select("source", ((F.col("s") + k * base) / (F.col("n") + k)).alias("host_posterior"))
    h = hosts.withColumnRenamed("source", "h_source")
    paths = paths.join(h, F.col("source").eqNullSafe(F.col("h_source"))).drop("h_source")
    k = _strength(paths, "host_posterior")
    return paths.select("source", "lang", "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"), F.lit(base).alias("base"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, keep_text: bool = True) -> DataFrame:
    """``docs`` with q_evidence, q_host, q_path, q_score (probability of good quality) and q_keep.

    ``docs`` has doc_id, text, source and lang; its other columns are kept (without ``keep_text`` the text is not) and can't clash
    with the q_ ones unless they carry those very names, which are replaced. Null and empty texts bring no evidence and get
    their path's posterior. Repeated rows are scored alike; of several labels of one id the least counts. Without usable
    labels everything has the score of its path, about a half, and is kept. An empty table gives no rows.

    The evidence is written, without the texts, and sites are summed from there. Without ``keep_text`` that is the only pass
    over the texts; else it is computed again beside them, as writing all texts once more costs more disk than it saves.
    """
    model = fit_evidence(docs.select("doc_id", "text"), labels, fit_rows)
    own = docs.drop("q_evidence", "q_host", "q_path", "q_score", "q_keep", "q_source", "q_lang", "q_base").withColumn("q_evidence", evidence(model)("text"))
    scored = stage(own.select("source", "lang", "q_evidence") if keep_text else own.drop("text"), "evidence")
    site = stage(posteriors(scored.select("source", "lang", F.col("q_evidence").alias("z"))), "posteriors").select(F.col("source").alias("q_source"), F.col("lang").alias("q_lang"), F.col("host_posterior").alias("q_host"), F.col("path_posterior").alias("q_path"), F.col("base").alias("q_base"))
    z = (own if keep_text else scored).join(site, F.col("source").eqNullSafe(F.col("q_source")) & F.col("lang").eqNullSafe(F.col("q_lang")), "left")
    score = _probability(F.col("q_evidence") + F.when(F.col("q_evidence") == 0, _log_odds(F.col("q_path"))).otherwise(_log_odds(F.col("q_path")) - _log_odds(F.col("q_base"))))
    return z.withColumn("q_score", score).withColumn("q_keep", F.round("q_score", 9) >= threshold).drop("q_source", "q_lang", "q_base")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_text=False)


def stage_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("q_keep").select(*docs.columns)
