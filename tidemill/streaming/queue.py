"""Streaming forms: the job queue, sessions and windows over an event stream."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemill.operators.queue import MOST_ATTEMPTS, RETRY_MINUTES, STALE_MINUTES

STATE = "status string, attempts int, at timestamp, failed boolean"


def advance(state: tuple, kind: str, at) -> tuple:
    """The transition of operators.queue.step on plain values."""
    status, attempts, since, failed = state
    if status == "running" and at >= since + timedelta(minutes=STALE_MINUTES):
        status = "pending"
    waits = status == "pending" and failed and at < since + timedelta(minutes=RETRY_MINUTES)
    if kind == "enqueue" and status in ("none", "done", "error"):
        return "pending", 0, at, False
    if kind == "claim" and status == "pending" and not waits:
        return "running", attempts + 1, at, False
    if kind == "finish" and status == "running":
        return "done", attempts, at, False
    if kind == "fail" and status == "running":
        return ("error" if attempts >= MOST_ATTEMPTS else "pending"), attempts, at, True
    return status, attempts, since, failed


def job_states(events: DataFrame, output_mode: str = "update", late: str = "10 minutes") -> DataFrame:
    """job and its state after each micro-batch of events (job bigint, at timestamp, seq bigint, kind string).

    A claim that neither ends nor fails is given back by a timer in event time, STALE_MINUTES after it, without any event of
    its job; until then nothing is said about the job.
    """

    def run(key, frames, state):
        now = tuple(state.get) if state.exists else ("none", 0, pd.Timestamp(0), False)
        if state.hasTimedOut:
            now = ("pending", now[1], pd.Timestamp(now[2]) + timedelta(minutes=STALE_MINUTES), False)
        else:
            for event in pd.concat(list(frames)).sort_values(["at", "seq"]).itertuples():
                now = advance(now, event.kind, event.at)
        state.update(now)
        if now[0] == "running":
            end = int((pd.Timestamp(now[2]) + timedelta(minutes=STALE_MINUTES)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job": [key[0]], "status": [now[0]], "attempts": [now[1]], "at": [now[2]]})

    timed = events.withWatermark("at", late)
    return timed.groupBy("job").applyInPandasWithState(run, "job bigint, status string, attempts int, at timestamp", STATE, output_mode, "EventTimeTimeout")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each user without a pause of `gap`, by event time; batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "value")


def usage(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events of each type in windows of event time; batch or stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
