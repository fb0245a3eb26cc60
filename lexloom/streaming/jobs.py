"""The job log as a stream, and the stateless stages over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import crlf_to_lf, sha256_text


def live_states(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """A streaming aggregate over events (job_id, event_id, ts, state): counts for each job and hour, and its last state."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "job_id").agg(F.count(F.lit(1)).alias("events"), F.max_by("state", "event_id").alias("state"))


def prepared(documents: DataFrame) -> DataFrame:
    """Stateless preparation of arriving documents: the same columns as in batch."""
    work = crlf_to_lf(F.col("text"))
    return documents.where("text IS NOT NULL").select("doc_id", F.length(work).cast("long").alias("length"), sha256_text(work).alias("sha256"), work.alias("text"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there now to Parquet and stops; a repeated call goes on where the checkpoint ends."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
