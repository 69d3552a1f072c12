"""From outcomes of runs to changes of state, and what else time brings about."""

from __future__ import annotations

import json
import re
import signal
import threading
import traceback
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import json_has_key, json_merge, micros_of, plus_seconds, retry_seconds
from tarnwork.model import CANCEL_KEY, CURSOR_KEY, LOG_KEY, OUTPUT_KEY, RESERVED_PREFIX, REQUIRED_UNIQUE, SNOOZE_KEY, STEP_KEY
from tarnwork.operators.commands import SET_STATE, at

#: Outcomes of a run.
OUTCOMES = ("completed", "error", "cancel", "snooze", "soft_stop")
#: Columns of outcomes: what a worker, or a stream of workers, reports.
OUTCOME = "id bigint, outcome string, error string, trace string, snooze_s double, retry_at timestamp_ntz, metadata string, started_at timestamp_ntz"


def commands_of(jobs: DataFrame, outcomes: DataFrame, now: datetime, scheduler_s: float = 5.0, jitter: Column | float = 0.0) -> DataFrame:
    """The state changes (:data:`SET_STATE`) that outcomes of running jobs ask for.

    A snooze gives its attempt back and counts in the metadata; an error is
    retried after the worker's own time or the growing default, unless all
    attempts are used; a short wait (up to the scheduler's interval) makes the
    job available at once. A retry time in the past falls back to the default.
    """
    o = outcomes.select("id", "outcome", *(F.col(c).alias(f"o_{c}") for c in ("error", "trace", "snooze_s", "retry_at", "metadata", "started_at")))
    j = jobs.select("id", "attempt", "max_attempts", "errors", F.col("metadata").alias("j_metadata")).join(o, "id")
    is_ = lambda x: F.col("outcome") == x
    used = F.col("attempt") >= F.col("max_attempts")
    default = plus_seconds(at(now), retry_seconds(F.col("errors"), jitter))
    retry_at = F.when(F.col("o_retry_at") >= at(now), F.col("o_retry_at")).otherwise(default)
    wait = (micros_of(retry_at) - micros_of(at(now))) / 1e6
    snooze_at = plus_seconds(at(now), F.coalesce("o_snooze_s", F.lit(0.0)))
    short = F.coalesce("o_snooze_s", F.lit(0.0)) <= scheduler_s
    state = (
        F.when(is_("completed"), "completed")
        .when(is_("cancel"), "cancelled")
        .when(is_("soft_stop"), "available")
        .when(is_("snooze"), F.when(short, "available").otherwise("scheduled"))
        .when(used, "discarded")
        .otherwise(F.when(wait <= scheduler_s, "available").otherwise("retryable"))
    )
    failed = is_("error") | is_("cancel")
    error = F.when(failed, F.struct(F.coalesce("o_started_at", at(now)).alias("at"), F.col("attempt").alias("attempt"), F.col("o_error").alias("error"), F.coalesce("o_trace", F.lit("")).alias("trace")))
    attempt = F.when(is_("snooze"), F.col("attempt") - 1).when(is_("soft_stop"), F.greatest(F.col("attempt") - 1, F.lit(0)))
    finalized = F.when(is_("completed") | is_("cancel") | (is_("error") & used), at(now))
    scheduled = F.when(is_("snooze"), snooze_at).when(is_("soft_stop"), at(now)).when(is_("error") & ~used, retry_at)
    snoozes = F.coalesce(F.get_json_object("j_metadata", f"$.{SNOOZE_KEY}").try_cast("long"), F.lit(0)) + 1
    counted = F.to_json(F.struct(snoozes.alias(SNOOZE_KEY)))
    merged = F.when(F.coalesce("o_metadata", F.lit("{}")) == "{}", counted).otherwise(F.concat(F.expr("substr(rtrim(o_metadata), 1, length(rtrim(o_metadata)) - 1)"), F.lit(","), F.substr(counted, F.lit(2))))
    metadata = F.when(is_("snooze"), merged).otherwise(F.col("o_metadata"))
    reason = F.when(is_("completed"), "completed").when(is_("cancel"), "cancelled").when(is_("soft_stop"), "interrupted").when(is_("snooze"), "snoozed").otherwise("failed")
    return j.select("id", state.alias("state"), reason.alias("reason"), attempt.alias("attempt"), error.alias("error"), finalized.alias("finalized_at"), metadata.alias("metadata"), scheduled.alias("scheduled_at"))


def rescue_decisions(stuck: DataFrame, kinds: DataFrame, now: datetime, default_timeout_s: float = 60.0, jitter: Column | float = 0.0) -> DataFrame:
    """What to do with stuck jobs: (id, decision, state, error, finalized_at,
    scheduled_at). ``kinds`` is (kind, timeout_s) of the kinds that have a
    worker; no timeout or nought means the default, a negative one never ends.
    Cancel if that was asked for, discard a kind without a worker or a job out
    of attempts, ignore one whose time isn't up, else retry."""
    k = kinds.select("kind", F.col("timeout_s").alias("__t"), F.lit(True).alias("__known"))
    j = stuck.join(k, "kind", "left")
    timeout = F.when(F.coalesce("__t", F.lit(0.0)) == 0, F.lit(default_timeout_s)).otherwise(F.col("__t"))
    ran = (micros_of(at(now)) - micros_of(F.col("attempted_at"))) / 1e6
    cancels = json_has_key(F.col("metadata"), CANCEL_KEY)
    decision = (
        F.when(cancels, "cancel")
        .when(F.col("__known").isNull(), "discard")
        .when((timeout < 0) | ((timeout > 0) & (ran < timeout)), "ignore")
        .when(F.col("attempt") < F.greatest(F.col("max_attempts"), F.lit(0)), "retry")
        .otherwise("discard")
    )
    error = F.struct(at(now).alias("at"), F.greatest(F.col("attempt"), F.lit(0)).alias("attempt"), F.lit("run out of time and taken back by the rescuer").alias("error"), F.lit("").alias("trace"))
    retry_at = plus_seconds(at(now), retry_seconds(F.col("errors"), jitter))
    d = F.col("decision")
    out = j.withColumn("decision", decision)
    state = F.when(d == "cancel", "cancelled").when(d == "discard", "discarded").when(d == "retry", "retryable")
    return out.select("id", "decision", state.alias("state"), error.alias("error"), F.when(d.isin("cancel", "discard"), at(now)).alias("finalized_at"), F.when(d == "retry", retry_at).otherwise(F.col("scheduled_at")).alias("scheduled_at"))


def periodic_runs(spec: DataFrame, now: datetime, slack_s: float = 0.1) -> DataFrame:
    """(id, run_at) of every periodic job due by ``now``: ``spec`` is (id,
    next_run_at, every_s, run_on_start). A run counts from the time planned,
    not from when it happened; those within the slack are due."""
    first, step = micros_of(F.col("next_run_at")), (F.col("every_s") * 1_000_000).cast("long")
    last = F.lit(None).cast("long") if now is None else micros_of(at(now)) + int(slack_s * 1e6) - 1
    times = F.when(first <= last, F.sequence(first, last, step)).otherwise(F.array().cast("array<bigint>"))
    started = F.when(F.col("run_on_start"), F.array(micros_of(at(now)))).otherwise(F.array().cast("array<bigint>"))
    return spec.select("id", F.explode(F.array_distinct(F.concat(started, times))).alias("us")).select("id", F.timestamp_micros("us").cast("timestamp_ntz").alias("run_at"))


def periodic_upsert(have: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
    """Durable periodic jobs (id, next_run_at, updated_at) after an upsert by id."""
    rows = new.select("id", "next_run_at").withColumn("updated_at", at(now))
    return have.join(rows.select("id"), "id", "left_anti").select(*have.columns).unionByName(rows.select(*have.columns))


def periodic_touch(have: DataFrame, ids: list[str], now: datetime) -> DataFrame:
    """Durable periodic jobs with ``updated_at`` set for those named: they are still wanted."""
    return have.withColumn("updated_at", F.when(F.col("id").isin(*ids), at(now)).otherwise(F.col("updated_at")))


def periodic_kept(have: DataFrame, horizon: datetime) -> DataFrame:
    """Durable periodic jobs without those no one has touched since ``horizon``."""
    return have.where(F.col("updated_at") >= at(horizon))


# --- logs, output, steps -----------------------------------------------------


def log_entries(jobs: DataFrame, new: DataFrame, most_total: int = 8 << 20, most_entry: int = 2 << 20) -> DataFrame:
    """The log entries that stay in a job's metadata once a new one (id,
    attempt, log) is appended: (id, pos, attempt, log). The new one is cut to
    ``most_entry`` bytes; of the older ones the oldest go until all together,
    as a JSON array, fit in ``most_total`` bytes. Logs that are no array count
    as none. Work per job is over its own entries, in the JVM."""
    text = F.get_json_object("metadata", f"$['{LOG_KEY}']")
    old = F.from_json(F.when(text.startswith("["), text).otherwise("[]"), "array<struct<attempt:bigint,log:string>>")
    cut = F.when(F.octet_length("log") > most_entry, F.expr(f"cast(substring(encode(log, 'UTF-8'), 1, {most_entry}) as string)")).otherwise(F.col("log"))
    entry = F.struct(F.col("attempt").cast("long").alias("attempt"), cut.alias("log"))
    n = new.select("id", F.array(entry).alias("__new"))
    j = jobs.select("id", F.coalesce(F.filter(old, lambda x: x.isNotNull()), F.array().cast("array<struct<attempt:bigint,log:string>>")).alias("__old")).join(n, "id")
    rows = j.select("id", F.size("__old").alias("__last"), F.posexplode(F.concat("__old", "__new")).alias("pos", "e"))
    # Bytes from an entry to the end, commas and brackets included: one running sum from the newest.
    upto = F.sum(F.octet_length(F.to_json("e")) + 1).over(Window.partitionBy("id").orderBy(F.desc("pos"))) + 1
    kept = rows.withColumn("__upto", upto).where((F.col("__upto") <= most_total) | (F.col("pos") == F.col("__last")))
    first = F.min("pos").over(Window.partitionBy("id"))
    return kept.select("id", (F.col("pos") - first).alias("pos"), "e.attempt", "e.log")


def log_append(jobs: DataFrame, new: DataFrame, most_total: int = 8 << 20, most_entry: int = 2 << 20) -> DataFrame:
    """The jobs (``id``, ``metadata`` and whatever else they have) of ``new``
    with its entries appended to their logs, as :func:`log_entries` keeps them."""
    kept = log_entries(jobs, new, most_total, most_entry)
    # Bounded by most_total bytes a job.
    logs = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "attempt", "log"))), lambda e: F.struct(e.attempt.alias("attempt"), e.log.alias("log"))).alias("__log"))
    return jobs.join(logs, "id").withColumn("metadata", json_merge(F.col("metadata"), F.to_json(F.struct(F.col("__log").alias(LOG_KEY))))).select(*jobs.columns)


def output_update(output: str, most: int = 32 << 20) -> str:
    """The metadata update that records a job's output; refused if too large."""
    if len(output.encode()) > most:
        raise ValueError(f"output is larger than {most} bytes")
    return json.dumps({OUTPUT_KEY: json.loads(output)}, separators=(",", ":"))


def metadata_update(**values) -> str:
    """A metadata update by a worker; keys of the engine's own are refused."""
    if own := [k for k in values if k.startswith(RESERVED_PREFIX)]:
        raise ValueError(f"reserved keys: {own}")
    return json.dumps(values, separators=(",", ":"))


def next_step(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """(id, next_step, cursor): where a job of steps goes on. ``steps`` is
    (kind, steps): the names in order. A step with a cursor was done in part
    and is run again; a done one gives the next; an unknown one none at all,
    for no step matches it; no step recorded gives the first."""
    done = F.get_json_object("metadata", f"$['{STEP_KEY}']")
    cursors = F.get_json_object("metadata", f"$['{CURSOR_KEY}']")
    j = jobs.join(steps, "kind").withColumn("__done", done).withColumn("__cursor", F.element_at(F.from_json(cursors, "map<string,string>"), F.col("__done")))
    at_ = F.array_position("steps", F.col("__done")).cast("int")
    step = F.when(F.col("__done").isNull(), F.try_element_at("steps", F.lit(1))).when(at_ == 0, F.lit(None)).when(F.col("__cursor").isNotNull(), F.col("__done")).otherwise(F.try_element_at("steps", at_ + 1))
    return j.select("id", step.alias("next_step"), F.when(step == F.col("__done"), F.col("__cursor")).alias("cursor"))


# --- insert options ----------------------------------------------------------

# The forms of a queue's name and of a tag.
_QUEUE = re.compile(r"\A[a-z0-9]+(?:[_|\-][a-z0-9]+)*\Z")
_TAG = re.compile(r"\A\w[\w\-]+\w\Z")


def insert_options(kind: str, *, own: dict | None = None, of_args: dict | None = None, config: dict | None = None, now: datetime | None = None) -> dict:
    """The options of an insert: given ones, then the kind's, then the client's,
    then defaults; checked. ``scheduled_at`` set, even in the past, makes the
    job scheduled, ``pending`` pending."""
    own, of_args, config = own or {}, of_args or {}, config or {}
    pick = lambda k, d=None: next((x[k] for x in (own, of_args, config) if x.get(k)), d)
    out = {"kind": kind, "max_attempts": pick("max_attempts", 25), "priority": pick("priority", 1), "queue": pick("queue", "default"), "tags": pick("tags", []), "metadata": own.get("metadata", "{}"), "unique": pick("unique"), "scheduled_at": own.get("scheduled_at") or of_args.get("scheduled_at")}
    out["state"] = "pending" if own.get("pending") else "scheduled" if out["scheduled_at"] else "available"
    out["scheduled_at"] = out["scheduled_at"] or now
    if not 1 <= out["priority"] <= 4:
        raise ValueError("priority must be 1 to 4")
    check_queue_name(out["queue"])
    for t in out["tags"]:
        if len(t) > 255 or not _TAG.match(t):
            raise ValueError(f"tag {t!r} isn't valid")
    if out["unique"]:
        check_unique(out["unique"])
    return out


def check_queue_name(name: str) -> None:
    if not name or len(name) > 64 or not _QUEUE.match(name):
        raise ValueError(f"queue name {name!r} isn't valid")


def check_unique(unique: dict) -> None:
    if 0 < (unique.get("by_period") or 0) < 1:
        raise ValueError("a period has a second at least")
    states = unique.get("by_state")
    if states and (missing := set(REQUIRED_UNIQUE) - set(states)):
        raise ValueError(f"unique states must include {sorted(missing)}")


# --- workers -----------------------------------------------------------------


class Cancel(Exception):
    """Raised by a worker to cancel its job."""


class Snooze(Exception):
    """Raised by a worker to be run again later."""

    def __init__(self, seconds: float):
        super().__init__(f"snoozed for {seconds} s")
        self.seconds = seconds


@contextmanager
def _limited(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in a run that takes longer; only the thread that runs
    the batch can be interrupted, so elsewhere there is no limit."""
    if not seconds or seconds <= 0 or threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(*_):
        raise TimeoutError(f"no end after {seconds} s")

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@dataclass(frozen=True)
class Worker:
    """``work`` is a function of a job's args (a dict) and row that may return a
    metadata update. ``timeout``: seconds a run may take (None: the default,
    below nought: no limit). ``next_retry``: a function of the row and the
    exception that may give the time of the next attempt. ``around``: functions
    of the row and the rest of the run, outermost first."""

    work: Callable
    timeout: float | None = None
    next_retry: Callable | None = None
    around: tuple[Callable, ...] = ()


class Workers:
    """Workers by kind of job. Hooks ``begin`` and ``end`` are called around
    each run, middleware in ``around`` runs it (for all kinds, outside a
    worker's own); ``on_error`` and ``on_panic`` (for errors that are no
    Exception of the worker's own making, such as MemoryError) may return True
    to cancel the job. A plugin is an object with any of ``begin``, ``end``,
    ``around`` and ``insert`` (called with each row to insert, may change it)."""

    def __init__(self, timeout: float = 60.0):
        self.timeout = timeout
        self._work: dict[str, Worker] = {}
        self.begin: list[Callable] = []
        self.end: list[Callable] = []
        self.around: list[Callable] = []
        self.insert: list[Callable] = []
        self.on_error: Callable | None = None
        self.on_panic: Callable | None = None

    def add(self, kind: str, work: Callable | Worker, *aliases: str, **options) -> None:
        worker = work if isinstance(work, Worker) else Worker(work, **options)
        for k in (kind, *aliases):
            if k in self._work:
                raise ValueError(f"{k} has a worker already")
            self._work[k] = worker

    def plug(self, plugin: object) -> None:
        for name in ("begin", "end", "around", "insert"):
            if hasattr(plugin, name):
                getattr(self, name).append(getattr(plugin, name))

    @property
    def kinds(self) -> list[str]:
        return sorted(self._work)

    def timeouts(self, spark) -> DataFrame:
        """(kind, timeout_s) of all workers, as :func:`rescue_decisions` takes it; nought: the default."""
        return spark.createDataFrame([(k, float(self._work[k].timeout or 0)) for k in self.kinds] or [("", 0.0)], "kind string, timeout_s double")

    def inserting(self, rows: list[dict]) -> list[dict]:
        """Rows to insert after the insert hooks."""
        for hook in self.insert:
            rows = [hook(dict(r)) or r for r in rows]
        return rows

    def one(self, row: dict) -> dict:
        out = {"id": row["id"], "outcome": "completed", "error": None, "trace": None, "snooze_s": None, "metadata": None, "retry_at": None}
        for hook in self.begin:
            hook(row)
        worker = self._work.get(row["kind"])
        try:
            if worker is None:
                raise LookupError(f"no worker takes jobs of kind {row['kind']}")
            run = lambda: worker.work(json.loads(row["args"] or "{}"), row)
            for layer in reversed([*self.around, *worker.around]):
                run = lambda inner=run, layer=layer: layer(row, inner)
            with _limited(self.timeout if worker.timeout is None else worker.timeout):
                got = run()
            if got:
                out["metadata"] = json.dumps(got)
        except Snooze as e:
            out |= {"outcome": "snooze", "snooze_s": float(e.seconds)}
        except Cancel as e:
            out |= {"outcome": "cancel", "error": str(e)}
        except BaseException as e:  # noqa: BLE001
            if isinstance(e, KeyboardInterrupt | SystemExit | GeneratorExit):
                raise
            handler = self.on_error if isinstance(e, Exception) and not isinstance(e, MemoryError | RecursionError | AssertionError) else self.on_panic or self.on_error
            cancel = bool(handler and handler(row, e))
            out |= {"outcome": "cancel" if cancel else "error", "error": str(e), "trace": traceback.format_exc()}
            if worker is not None and worker.next_retry and not cancel:
                out["retry_at"] = worker.next_retry(row, e)
        for hook in self.end:
            hook(row, out)
        return out

    def run(self, jobs: DataFrame) -> DataFrame:
        """The outcomes (:data:`OUTCOME`) of running jobs, batch by batch on the executors."""

        def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = pd.DataFrame([self.one(r) for r in pdf.to_dict("records")], columns=["id", "outcome", "error", "trace", "snooze_s", "metadata", "retry_at"])
                out["retry_at"] = pd.to_datetime(out["retry_at"])
                out["started_at"] = pdf["attempted_at"].to_numpy()
                yield out[[c.split()[0] for c in OUTCOME.split(", ")]]

        return jobs.select("id", "kind", "args", "attempt", "attempted_at", "metadata", "queue").mapInPandas(batch, OUTCOME)


__all__ = ["SET_STATE", "OUTCOME", "OUTCOMES", "Cancel", "Snooze", "Worker", "Workers", "check_queue_name", "check_unique", "commands_of", "insert_options", "log_append", "log_entries", "metadata_update", "next_step", "output_update", "periodic_kept", "periodic_runs", "periodic_touch", "periodic_upsert", "rescue_decisions"]

