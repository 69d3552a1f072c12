"""Operators over streams of notifications and job updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwork.runtime import micros


# Kinds of events.
EVENTS = ["job_cancelled", "job_completed", "job_failed", "job_interrupted", "job_snoozed", "queue_metadata_changed", "queue_paused", "queue_resumed"]
#: States that running jobs share in :func:`stuck`. A stream's checkpoint holds for one number only.
BUCKETS = 1024
# The bucket of jobs without id, and the places of a row's state: before and behind running are others.
_NO_ID, _RUNNING, _UNKNOWN = -1, 0, 9


def cooldown(stream: DataFrame, key: str, ts: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """At most one row per key within ``seconds`` of the last one let through:
    (``key``, ``ts``). A batch's rows of a key go in order of time; a row older
    than the last one let through is dropped. State: one time per key, dropped
    once the watermark is past its cooldown. ``late``: how late rows may come."""
    us = int(seconds * 1_000_000)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # A key's rows of one batch; times are sorted, a window at a time is kept.
        times = sorted(t for f in frames for t in f["us"])
        last, out = (state.get[0] if state.exists else None), []
        for t in times:
            if last is None or t >= last + us:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
            ends = (last + us) // 1000 + 1
            if ends > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({key: [k[0]] * len(out), "us": out}).astype({"us": "int64"})

    src = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).select(F.col(key).cast("string").alias(key), "__ts", F.unix_micros("__ts").alias("us"))
    out = src.groupBy(key).applyInPandasWithState(step, f"`{key}` string, us bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("us").cast("timestamp_ntz").alias(ts))


def stuck(updates: DataFrame, after_seconds: float, ts: str = "at", late: str = "0 seconds") -> DataFrame:
    """Jobs that have been running for ``after_seconds``, by event time: (id,
    attempted_at). ``updates`` is a stream of (id, state, attempted_at, ``ts``).
    A job that ends before its time is up drops its state. A batch's rows of a
    job go in order of time, then of state; the last one holds.

    Jobs share :data:`BUCKETS` states by the hash of their id, each with the ids
    and begins of its running jobs and a timer for the first that is due, so a
    call of Python serves a bucket of jobs."""
    us = int(after_seconds * 1_000_000)
    none = np.empty(0, "<i8")

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, begun = (np.frombuffer(x, "<i8") for x in state.get) if state.exists else (none, none)
        if not state.hasTimedOut:
            key, at, order, start = (np.concatenate(x) for x in zip(*([f[c].to_numpy() for c in ("job", "us", "order", "begun")] for f in frames), strict=True))
            by = np.lexsort((start, order, at, key))
            by = by[order[by] != _UNKNOWN]
            last = by[np.append(key[by][1:] != key[by][:-1], True)] if len(by) else by
            kept, runs = ~np.isin(ids, key[last]), last[order[last] == _RUNNING]
            ids, begun = np.concatenate([ids[kept], key[runs]]), np.concatenate([begun[kept], start[runs]])
        due, now = (begun + us) // 1000, state.getCurrentWatermarkMs()
        over = due < now
        if over.all():
            if state.exists:
                state.remove()
        else:
            state.update((ids[~over].astype("<i8").tobytes(), begun[~over].astype("<i8").tobytes()))
            state.setTimeoutTimestamp(max(1, int(due[~over].min())))
        if over.any():
            # Nullable, for the worker pads what it sends with nulls, which makes plain integers floats.
            jobs = ids[over] if k[0] != _NO_ID else [None] * int(over.sum())
            yield pd.DataFrame({"id": pd.array(jobs, "Int64"), "us": pd.array(begun[over], "Int64")})

    # All of a job's columns are numbers that are never null, which pandas keeps exact.
    begin, job = F.unix_micros(F.col("attempted_at").cast("timestamp")), F.col("id").cast("long")
    running = F.col("state") == "running"
    order = F.when(running & begin.isNull(), _UNKNOWN).when(running, _RUNNING).when(F.col("state") > "running", _RUNNING + 1).otherwise(_RUNNING - 1)
    bucket = F.when(job.isNull(), _NO_ID).otherwise(F.pmod(F.xxhash64(job), F.lit(BUCKETS)).cast("int"))
    known = [F.coalesce(job, F.lit(0)).alias("job"), F.coalesce(F.unix_micros("__ts"), F.lit(-(2**63))).alias("us"), order.alias("order"), F.coalesce(begin, F.lit(0)).alias("begun")]
    src = updates.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).select(bucket.alias("bucket"), "__ts", *known)
    out = src.groupBy("bucket").applyInPandasWithState(step, "id bigint, us bigint", "ids binary, begun binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("id", F.timestamp_micros("us").cast("timestamp_ntz").alias("attempted_at"))


def job_events(updates: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Events of job updates: ``event``, the job's columns, and its run's
    statistics in seconds (``complete_s``, ``queue_wait_s``, ``run_s``). An update
    that is no event is dropped; none is for want of room. Works on streams
    and tables alike.

    Updates with a ``reason`` (see :func:`tarnwork.operators.commands.reported`)
    have the event it names. Of rows without, only the states that a run's end
    alone brings about tell: completed, cancelled, and retryable or discarded."""
    s = F.col("state")
    if "reason" in updates.columns:
        event = F.when(F.col("reason").isNotNull(), F.concat(F.lit("job_"), F.col("reason")))
    else:
        event = F.when(s == "completed", "job_completed").when(s == "cancelled", "job_cancelled").when(s.isin("retryable", "discarded"), "job_failed")
    gap = lambda a, b: (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 1e6
    out = updates.withColumns({"event": event, "complete_s": gap("finalized_at", "created_at"), "queue_wait_s": gap("attempted_at", "scheduled_at"), "run_s": gap("finalized_at", "attempted_at")})
    return out.where(F.col("event").isin(*kinds) if kinds else F.col("event").isNotNull())


def queue_events(notices: DataFrame) -> DataFrame:
    """Events of control notifications about queues: ``event``, ``queue``, ``created_at``."""
    action = F.get_json_object("payload", "$.action")
    event = F.when(action == "pause", "queue_paused").when(action == "resume", "queue_resumed").when(action == "metadata_changed", "queue_metadata_changed")
    return notices.select(event.alias("event"), F.get_json_object("payload", "$.queue").alias("queue"), "created_at").where("event IS NOT NULL")


def statistics(updates: DataFrame, every: str = "1 minute", late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Means of completed jobs per window of their end; with ``keys`` rows that
    agree in them and in their end count once (state: one until the watermark
    has passed the end). In append mode a window
    comes out once the watermark has passed it, in complete mode every window
    does, in each batch."""
    done = job_events(updates, ["job_completed"]).withColumn("__ts", F.col("finalized_at").cast("timestamp")).withWatermark("__ts", late)
    if keys:
        done = done.dropDuplicates([*keys, "__ts"])

    def mean(a: str, b: str):
        us = micros(F.col(a)) - micros(F.col(b))  # whole numbers add up alike in any order
        return F.sum(us) / F.count(us) / F.lit(1e6)

    means = [mean("finalized_at", "created_at").alias("complete_s"), mean("attempted_at", "scheduled_at").alias("queue_wait_s"), mean("finalized_at", "attempted_at").alias("run_s")]
    w = done.groupBy(F.window("__ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n"), *means)
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "complete_s", "queue_wait_s", "run_s")
