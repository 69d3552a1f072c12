"""The loops around the job table, as micro-batches of a single writer."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwork.model import TOPICS
from tarnwork.operators import commands, machine, reads
from tarnwork.runtime import staged
from tarnwork.sources.store import Store
from tarnwork.streaming.pilot import Pilot


@dataclass(frozen=True)
class Settings:
    """How often and how much the loops do; retention None keeps for ever.
    ``room`` is how many jobs of a queue a worker has running at most."""

    worker: str = "worker-1"
    room: int = 100
    batch: int = 10_000
    reduced_batch: int = 1_000
    scheduler: timedelta = timedelta(seconds=5)
    rescue_after: timedelta = timedelta(hours=1)
    job_timeout: timedelta = timedelta(minutes=1)
    step_timeout: timedelta = timedelta(seconds=30)
    retention: dict = field(default_factory=lambda: {"cancelled": timedelta(hours=24), "completed": timedelta(hours=24), "discarded": timedelta(days=7)})
    queue_retention: timedelta = timedelta(hours=24)
    notification_retention: timedelta = timedelta(hours=1)


class Breaker:
    """Opens for good after ``limit`` trips within ``window``: batches are smaller then."""

    def __init__(self, limit: int = 3, window: timedelta = timedelta(minutes=10)):
        self.limit, self.window, self.trips, self.open = limit, window, [], False

    def trip(self, now: datetime) -> bool:
        self.trips = [t for t in self.trips if now - t < self.window] + [now]
        self.open |= len(self.trips) >= self.limit
        return self.open

    def reset_if_closed(self) -> None:
        if not self.open:
            self.trips = []


def room_of(jobs: DataFrame, queues: DataFrame, worker: str, most: int) -> DataFrame:
    """(queue, most): how many jobs of each queue a worker may still take; none of a paused one."""
    busy = jobs.where((F.col("state") == "running") & (F.element_at("attempted_by", -1) == worker)).groupBy("queue").agg(F.count(F.lit(1)).alias("__busy"))
    free = F.greatest(F.lit(most) - F.coalesce("__busy", F.lit(0)), F.lit(0))
    names = queues.select(F.col("name").alias("queue"), "paused_at")
    return names.join(busy, "queue", "left").select("queue", F.when(F.col("paused_at").isNull(), free).otherwise(0).cast("int").alias("most"))


def cycle(jobs: Store, queues: DataFrame | Store, workers: machine.Workers, now: datetime, settings: Settings = Settings(), breaker: Breaker | None = None, outbox: Store | None = None, pilot: Pilot | None = None) -> dict[str, int]:
    """One round: schedule (batch after batch while they are full), fetch for
    every queue not paused, work on the executors, end the runs, rescue stuck
    jobs (while batches are full), delete old jobs, and, where ``queues`` and
    ``outbox`` are stores, old queues and notifications. Queues that got jobs
    are notified in the outbox. Each step writes the rows it changes. A step
    that takes too long trips the breaker. Returns the rows of each step."""
    done: dict[str, int] = {}
    pilot = pilot or Pilot()
    pilot.worker_alive(settings.worker, now)

    def size() -> int:
        return settings.reduced_batch if breaker and breaker.open else settings.batch

    def step(name: str, changed: DataFrame, gone: bool = False, store: Store = jobs) -> DataFrame:
        began = time.monotonic()
        rows = staged(changed, name)
        n = rows.count()
        if n:
            store.merge(rows, gone)
        done[name] = done.get(name, 0) + n
        if breaker:
            if time.monotonic() - began > settings.step_timeout.total_seconds():
                breaker.trip(now)
            else:
                breaker.reset_if_closed()
        return rows

    def notify(rows: DataFrame) -> None:
        if outbox is None:
            return
        # A queue is notified once, by a job due now or in a moment.
        soon = rows.where((F.col("state") == "available") & (F.col("scheduled_at") <= commands.at(now + timedelta(milliseconds=5)))).select("queue").distinct()
        notes = soon.select(F.to_json(F.struct("queue")).alias("payload"), F.lit(TOPICS["insert"]).alias("topic"), (F.row_number().over(Window.orderBy("queue")) - 1).alias("ordinal"))  # a row a queue
        step("notified", commands.notifications_insert(outbox.read(), notes, now), store=outbox)

    def while_full(name: str, batch: Callable[[int], DataFrame], gone: bool = False, after: Callable[[DataFrame], None] | None = None) -> None:
        while True:
            most, before = size(), done.get(name, 0)
            rows = step(name, batch(most), gone)
            if after and done[name] > before:
                after(rows)
            if done[name] - before < most:
                return

    while_full("scheduled", lambda most: commands.schedule(jobs.read(), now + settings.scheduler, most), after=notify)
    names = queues.read() if isinstance(queues, Store) else queues
    taken = step("fetched", pilot.fetch(jobs.read(), room_of(jobs.read(), names, settings.worker, settings.room), now, settings.worker))
    outcomes = staged(workers.run(taken), "outcomes")
    changes = machine.commands_of(taken, outcomes, now, settings.scheduler.total_seconds())
    step("ended", pilot.set_state(jobs.read(), changes, now))
    kinds = workers.timeouts(jobs.spark)
    last, full = 0, True
    while full:  # some of a full batch may be left alone
        most = size()
        stuck = staged(reads.stuck_jobs(jobs.read(), now - settings.rescue_after, most, after=last), "stuck")
        n, top = stuck.agg(F.count(F.lit(1)), F.max("id")).first()
        last, full = top or last, n == most
        decided = machine.rescue_decisions(stuck, kinds, now, settings.job_timeout.total_seconds())
        step("rescued", commands.rescue(jobs.read(), decided.where("decision != 'ignore'")))
    horizons = {s: now - keep for s, keep in settings.retention.items() if keep is not None}
    if horizons:
        while_full("deleted", lambda most: commands.expired(jobs.read(), horizons, most, excluded=pilot.queues_not_cleaned()), gone=True)
    if isinstance(queues, Store):
        step("queues_deleted", commands.queues_expired(queues.read(), now - settings.queue_retention, size()), True, queues)
    if outbox is not None:
        old = outbox.read().where(F.col("created_at") < commands.at(now - settings.notification_retention))
        step("notifications_deleted", old, True, outbox)
    return done


def run_every(spark, seconds: float, checkpoint: str, f: Callable[[datetime], object]) -> StreamingQuery:
    """Calls ``f`` with the time on a trigger of the streaming engine, one call at a time."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def once(batch: DataFrame, _: int) -> None:
        f(datetime.now(UTC).replace(tzinfo=None))

    return ticks.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def complete_from(stream: DataFrame, jobs: Store, checkpoint: str, now: Callable[[], datetime], *, order: str = "at", available_now: bool = False, retries: int = 3, sub_batch: int = 1_000_000) -> StreamingQuery:
    """Ends runs from a stream of state changes (:data:`machine.SET_STATE` and a
    time ``order``): a micro-batch keeps the last change per job and applies
    them together, writing only the jobs they change. A batch that fails is
    tried again ``retries`` times, ever later, and then by the engine, when the
    query is started anew; applying a change twice is harmless, for the job no
    longer runs. ``sub_batch`` changes go into one version at most."""

    def part(last: DataFrame, parts: int, i: int) -> None:
        mine = last.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) if parts > 1 else last
        jobs.merge(staged(commands.set_state(jobs.read(), mine, now()), "ended"))

    def batch(rows: DataFrame, _: int) -> None:
        last = staged(commands.last_per_job(rows, order), "changes")
        parts = -(-last.count() // sub_batch)
        for i in range(parts):
            for again in range(retries + 1):
                try:
                    part(last, parts, i)
                    break
                except Exception:
                    if again == retries:
                        raise
                    time.sleep(0.1 * 4**again)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def complete_now(jobs: Store, changes: DataFrame, now: datetime) -> DataFrame:
    """Ends runs at once, outside any stream; the jobs as they are then."""
    rows = staged(commands.set_state(jobs.read(), changes, now), "ended")
    jobs.merge(rows)
    return rows


class Completer:
    """Ends runs in the background, batch by batch in the order they were given,
    by one thread: the store has a single writer. :meth:`close` waits for all
    and raises what failed."""

    def __init__(self, jobs: Store, now: Callable[[], datetime]):
        self.jobs, self.now = jobs, now
        self._pool = ThreadPoolExecutor(max_workers=1)
        self._runs: list[Future] = []

    def give(self, changes: DataFrame) -> Future:
        run = self._pool.submit(lambda: complete_now(self.jobs, changes, self.now()))
        self._runs.append(run)
        return run

    def close(self) -> None:
        self._pool.shutdown(wait=True)
        for run in self._runs:
            run.result()
