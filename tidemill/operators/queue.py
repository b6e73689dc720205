"""The job queue as a fold of its log: enqueue, claim, finish, fail, retry and stale claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MOST_ATTEMPTS, RETRY_MINUTES, STALE_MINUTES = 5, 30, 30


def step(state: Column, event: Column) -> Column:
    """One transition of (status, attempts, at) by an event (kind, at): what fits the state counts, the rest changes nothing."""
    late = event["at"] >= state["at"] + F.expr(f"INTERVAL {STALE_MINUTES} MINUTES")
    status = F.when((state["status"] == "running") & late, "pending").otherwise(state["status"])
    waits = (status == "pending") & (state["failed"]) & (event["at"] < state["at"] + F.expr(f"INTERVAL {RETRY_MINUTES} MINUTES"))
    tries = state["attempts"]
    make = lambda s, a, t, f: F.struct(s.alias("status"), a.cast("int").alias("attempts"), t.alias("at"), f.alias("failed"))
    text = F.lit
    return (
        F.when((event["kind"] == "enqueue") & status.isin("none", "done", "error"), make(text("pending"), text(0), event["at"], text(False)))
        .when((event["kind"] == "claim") & (status == "pending") & ~waits, make(text("running"), tries + 1, event["at"], text(False)))
        .when((event["kind"] == "finish") & (status == "running"), make(text("done"), tries, event["at"], text(False)))
        .when((event["kind"] == "fail") & (status == "running"), make(F.when(tries >= MOST_ATTEMPTS, "error").otherwise("pending"), tries, event["at"], text(True)))
        .otherwise(make(status, tries, state["at"], state["failed"]))
    )


def fold(events: DataFrame) -> DataFrame:
    """job, status, attempts, at and next_attempt after all events (job, at, seq, kind); a job's own log is folded in order of at and seq.

    A log is as long as its job has events, which MOST_ATTEMPTS bounds while the job is worked on.
    """
    ordered = events.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "kind"))).alias("log"))
    first = F.struct(F.lit("none").alias("status"), F.lit(0).alias("attempts"), F.lit("1970-01-01 00:00:00").cast("timestamp").alias("at"), F.lit(False).alias("failed"))
    done = ordered.select("job", F.aggregate("log", first, step).alias("s"))
    waits = (F.col("s.status") == "pending") & F.col("s.failed")
    return done.select("job", "s.status", "s.attempts", "s.at", F.when(waits, F.col("s.at") + F.expr(f"INTERVAL {RETRY_MINUTES} MINUTES")).alias("next_attempt"))


def ready(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """The first `limit` pending jobs by id whose next attempt is due."""
    due = F.col("next_attempt").isNull() | (F.col("next_attempt") <= now)
    return jobs.filter((F.col("status") == "pending") & due).orderBy("job").limit(limit)
