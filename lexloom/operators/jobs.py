"""Jobs as an append-only event log: state is the latest event, legality a comparison with the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The states that may follow a state.
NEXT = {
    "start": ("queued",),
    "queued": ("running", "interrupted"),
    "running": ("done", "failed", "interrupted"),
    "failed": ("queued",),
    "interrupted": ("queued",),
    "done": (),
}


def job_states(log: DataFrame) -> DataFrame:
    """(job_id, state, event_id, events): the latest event of each job, by partial aggregation."""
    return log.groupBy("job_id").agg(F.max_by("state", "event_id").alias("state"), F.max("event_id").alias("event_id"), F.count(F.lit(1)).alias("events"))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """(job_id, event_id, before, state) of events that may not follow the one before."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy("job_id").orderBy("event_id")), F.lit("start"))
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    return log.select("job_id", "event_id", before.alias("before"), "state").where(~F.coalesce(F.array_contains(allowed[F.col("before")], F.col("state")), F.lit(False)))


def claims(log: DataFrame) -> DataFrame:
    """(job_id, attempt, winner, claimants): of the claims of an attempt, the least event id wins.

    An attempt is counted by the job's queued events before it.
    """
    upto = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    tried = log.withColumn("attempt", F.count_if(F.col("state") == "queued").over(upto).cast("long"))
    return tried.where("state = 'running'").groupBy("job_id", "attempt").agg(F.min("event_id").alias("winner"), F.count(F.lit(1)).alias("claimants"))


def progress(log: DataFrame) -> DataFrame:
    """(job_id, done, monotone): the highest progress and whether it never fell."""
    before = F.lag("progress").over(Window.partitionBy("job_id").orderBy("event_id"))
    rows = log.withColumn("fell", F.coalesce(before > F.col("progress"), F.lit(False)))
    return rows.groupBy("job_id").agg(F.max("progress").alias("done"), (~F.bool_or("fell")).alias("monotone"))


def inconsistent(states: DataFrame, runs: DataFrame) -> DataFrame:
    """(job_id, rule): done jobs without a published run, and runs of jobs that are not done."""
    both = states.select("job_id", "state").join(runs.select("job_id", F.lit(True).alias("published")), "job_id", "full")
    rule = F.when((F.col("state") == "done") & F.col("published").isNull(), "done_without_run").when((F.coalesce("state", F.lit("")) != "done") & F.col("published"), "run_of_unfinished_job")
    return both.select("job_id", rule.alias("rule")).where("rule IS NOT NULL")


def recovered(log: DataFrame, open_states: tuple[str, ...] = ("queued", "running")) -> DataFrame:
    """(job_id, event_id, state): what a restart appends, "interrupted" for every job that is still open, behind its last event."""
    return job_states(log).where(F.col("state").isin(*open_states)).select("job_id", (F.col("event_id") + 1).alias("event_id"), F.lit("interrupted").alias("state"))


ENDINGS = {"finish": "done", "fail": "failed", "interrupt": "interrupted"}


def report_states(log: DataFrame) -> DataFrame:
    """(report_id, state, shown, start_event, end_event) from a log (report_id, event_id, kind, sha256).

    A report is what its first "register" says. It is searched once: by the first later "start" with the same text; the first ending
    after that stays. ``shown`` is what a reader sees: an interrupted search is an error. Only least events are kept for each report.
    """
    known = log.where("kind = 'register'").groupBy("report_id").agg(F.min("event_id").alias("registered"), F.min_by("sha256", "event_id").alias("own"))
    starts = log.where("kind = 'start'").join(known, "report_id").where("event_id > registered AND sha256 = own").groupBy("report_id").agg(F.min("event_id").alias("start_event"))
    ends = log.where(F.col("kind").isin(*ENDINGS)).join(starts, "report_id").where("event_id > start_event").groupBy("report_id").agg(F.min("event_id").alias("end_event"), F.min_by("kind", "event_id").alias("ending"))
    rows = known.join(starts, "report_id", "left").join(ends, "report_id", "left")
    ended = F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair])[F.col("ending")]
    state = F.coalesce(ended, F.when(F.col("start_event").isNotNull(), "running"), F.lit("registered"))
    return rows.select("report_id", state.alias("state"), F.when(state.isin("failed", "interrupted"), "error").otherwise(state).alias("shown"), "start_event", "end_event")


def rejected_report_events(log: DataFrame) -> DataFrame:
    """(report_id, event_id, reason): starts of unknown, changed or already searched reports, and endings of searches that do not run."""
    known = log.where("kind = 'register'").groupBy("report_id").agg(F.min("event_id").alias("registered"), F.min_by("sha256", "event_id").alias("own"))
    rows = log.where("kind <> 'register'").join(known, "report_id", "left").join(report_states(log).select("report_id", "start_event", "end_event"), "report_id", "left")
    unknown = F.col("registered").isNull() | (F.col("event_id") < F.col("registered"))
    start = F.when(unknown, "unknown").when(~F.coalesce(F.col("sha256") == F.col("own"), F.lit(False)), "text").when(F.col("event_id") != F.col("start_event"), "searched")
    end = F.when(~F.coalesce(F.col("event_id") == F.col("end_event"), F.lit(False)), "not_running")
    return rows.select("report_id", "event_id", F.when(F.col("kind") == "start", start).otherwise(end).alias("reason")).where("reason IS NOT NULL")
