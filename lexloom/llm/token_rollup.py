"""Token counts: rollups by source, language and tokenizer version, maintained by signed deltas.

A batch is a table of signed changes: an insert adds a document's counts, a delete takes them away, and
a revision does both. Each batch is summed to one row for each key and written under its own batch id;
a batch counts once it is renamed to that id, and a batch id that is already there is left as it is, so
that repeating a batch changes nothing. Totals are the sums over the complete batches, which any number
of writers can extend, and compaction replaces batches by their sum.
"""

from __future__ import annotations

import base64
import functools
import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import shared_dir

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("docs", "tokens", "empty_docs")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, empty_docs long"
#: A compaction: sums, whose batch is null, and a row for each batch in them.
COVERED = f"{SCHEMA}, batch string"


@functools.cache
def _encoding(path: str, pattern: str):
    """One for each Python worker, however many tasks it runs."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_counts(path: str, pattern: str) -> object:
    """A pandas UDF text -> tokens under a byte-level BPE vocabulary file (base64 token and rank on a line).

    Null texts count 0 tokens. The file is read once by each Python worker from ``path``.
    """

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path, pattern).encode_ordinary
        return texts.map(lambda x: len(encode(x)) if x else 0)

    return count


def word_counts(text: Column) -> Column:
    """The tokenizer "words": maximal runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def count_tokens(docs: DataFrame, tokenizers: dict[str, Column]) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): one row for each document and tokenizer version.

    Null sources and languages are keys of their own; repeated rows count as often as they come.
    """
    counts = F.array(*[F.struct(F.lit(k).alias("tokenizer"), v.cast("long").alias("tokens")) for k, v in tokenizers.items()])
    return docs.select("doc_id", "source", "lang", F.explode(counts).alias("x")).select("doc_id", "source", "lang", "x.*")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Takes the counts of ``before`` away and adds those of ``after``."""
    return deletes(before).unionByName(inserts(after))


def summed(deltas: DataFrame) -> DataFrame:
    """Signed changes (source, lang, tokenizer, tokens, sign) to one row for each key; partial sums come first."""
    return deltas.groupBy(*KEYS).agg(
        F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"), F.sum(F.when(F.col("tokens") == 0, F.col("sign")).otherwise(0)).cast("long").alias("empty_docs")
    )


class Rollup:
    """Additive totals in a shared folder. Writers of one batch id may race: one of them wins, whole."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Writes ``rows`` aside and renames them to ``name``; False, with nothing left behind, if that exists already."""
        aside = f"{self.root}/.writing-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.java.net.URI(jvm.org.apache.hadoop.fs.Path(self.root).toUri().toString()), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
        fs, to = self._fs(f"{self.root}/{name}")
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(aside), to, options)
        except Py4JJavaError:
            fs.delete(jvm.org.apache.hadoop.fs.Path(aside), True)
            if fs.exists(to):
                return False
            raise
        return True

    def _names(self, prefix: str) -> list[str]:
        fs, at = self._fs(self.root)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(x.removeprefix(prefix) for x in names if x.startswith(prefix))

    def _compacted(self) -> tuple[str | None, list[str]]:
        """The last compaction and the batches in it: each covers all that were covered before."""
        last = max(self._names("compact="), default=None)
        return last, [] if last is None else [r.batch for r in self.spark.read.schema(COVERED).parquet(f"{self.root}/compact={last}").where("batch IS NOT NULL").select("batch").collect()]

    def batches(self) -> list[str]:
        """Ids of the complete batches, compacted ones included."""
        return sorted({*self._names("batch="), *self._compacted()[1]})

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch; False, and nothing changes, if that id is complete already.

        A batch counts from the rename that ends its writing on, so a lost driver leaves no half-written one.
        """
        if batch_id in self.batches():
            return False
        return self._publish(summed(deltas), f"batch={batch_id}")

    def compact(self) -> bool:
        """Replaces the complete batches by their sum. Readers take a compaction with what it does not cover.

        It is published under the number after the last one, so that of two writers one wins; batches it covers are deleted after.
        """
        last, covered = self._compacted()
        found = self._names("batch=")
        if not found:
            return False
        names = [(b,) for b in sorted({*covered, *found})]
        sums = self._rows(last, [b for b in found if b not in covered]).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).withColumn("batch", F.lit(None).cast("string"))
        marks = self.spark.createDataFrame(names, "batch string")
        for column, kind in (x.split() for x in SCHEMA.split(", ")):
            marks = marks.withColumn(column, F.lit(None).cast(kind))
        if not self._publish(sums.unionByName(marks), f"compact={int(last or 0) + 1:08d}"):
            return False
        for b in found:
            fs, at = self._fs(f"{self.root}/batch={b}")
            fs.delete(at, True)
        return True

    def _rows(self, last: str | None, batches: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([], SCHEMA)
        if batches:
            rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/batch={b}" for b in batches])
        if last is not None:
            rows = rows.unionByName(self.spark.read.schema(COVERED).parquet(f"{self.root}/compact={last}").where("batch IS NULL").drop("batch"))
        return rows

    def totals(self) -> DataFrame:
        """One row for each key with documents left, null keys included; no rows before the first batch."""
        last, covered = self._compacted()
        rows = self._rows(last, [b for b in self._names("batch=") if b not in covered])
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]).where("docs <> 0 OR tokens <> 0")


#: Vocabulary file and pattern of the production tokenizer; both are parameters of ``bpe_counts``.
BPE_NAME = "byte_bpe_50k"


def op6_token_rollup(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Three batches over ``documents``: all inserted; ids divisible by 7 revised to their trimmed lower-case
    text; ids divisible by 11 deleted. The last batch is sent twice. The result is the totals.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    bpe = bpe_counts(tokenizer_path or public_tokenizers.path(f"{BPE_NAME}.tiktoken"), public_tokenizers.PATTERN)

    def counts(rows: DataFrame) -> DataFrame:
        # Each text is tokenized once, before the rows for the tokenizer versions are made.
        known = rows.withColumn("bpe", bpe("text")).withColumn("words", word_counts(F.col("text")))
        return count_tokens(known, {f"{BPE_NAME}-v1": F.col("bpe"), "words-v1": F.col("words")})

    revised = docs.where("doc_id % 7 = 0")
    state = Rollup(spark)
    state.commit("0-inserts", inserts(counts(docs)))
    state.commit("1-revisions", revisions(counts(revised), counts(revised.withColumn("text", F.lower(F.trim("text"))))))
    gone = docs.where("doc_id % 11 = 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lower(F.trim("text"))).otherwise(F.col("text")))
    for _ in range(2):
        state.commit("2-deletes", deletes(counts(gone)))
    return state.totals()
