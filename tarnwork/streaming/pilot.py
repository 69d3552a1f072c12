"""Points at which another package may take over parts of the engine's work."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from tarnwork.operators import commands, machine


class Pilot:
    """What the loops call; the defaults are the engine's own operators. A
    subclass may limit what a worker takes, keep track of workers, or write
    more than the job's row when a run ends."""

    def cancel(self, jobs: DataFrame, now: datetime) -> DataFrame:
        return commands.cancel(jobs, now)

    def retry(self, jobs: DataFrame, now: datetime) -> DataFrame:
        return commands.retry(jobs, now)

    def insert(self, jobs: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
        return commands.insert(jobs, rows, now)

    def fetch(self, jobs: DataFrame, room: DataFrame, now: datetime, worker: str) -> DataFrame:
        return commands.fetch_all(jobs, room, now, worker)

    def set_state(self, jobs: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
        return commands.set_state(jobs, changes, now)

    def queues_not_cleaned(self) -> list[str] | None:
        """Queues whose old jobs the cleaner leaves alone; None: no such queues."""
        return None

    def worker_started(self, worker: str, now: datetime) -> None:
        """Called before a worker's first round."""

    def worker_alive(self, worker: str, now: datetime) -> None:
        """Called in every round."""

    def worker_stopped(self, worker: str, now: datetime) -> None:
        """Called after a worker's last round."""

    def queue_metadata_changed(self, queue: str, metadata: str, now: datetime) -> None:
        """Called when the metadata of a queue has been set."""

    # Periodic jobs that outlive the process: (id, next_run_at, updated_at).

    def periodic_all(self, periodic: DataFrame) -> DataFrame:
        return periodic.orderBy("id")

    def periodic_touched(self, periodic: DataFrame, ids: list[str], now: datetime) -> DataFrame:
        return machine.periodic_touch(periodic, ids, now)

    def periodic_upserted(self, periodic: DataFrame, new: DataFrame, now: datetime) -> DataFrame:
        return machine.periodic_upsert(periodic, new, now)

    def periodic_kept(self, periodic: DataFrame, horizon: datetime) -> DataFrame:
        return machine.periodic_kept(periodic, horizon)
