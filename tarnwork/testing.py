"""Helpers for tests of code that inserts and works jobs."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, Row

from tarnwork.operators import reads
from tarnwork.operators.machine import Workers

#: What may be asked of an inserted job.
CHECKED = ("max_attempts", "priority", "queue", "scheduled_at", "state", "tags", "args", "metadata")


def _differences(row: Row, wanted: dict) -> list[str]:
    out = []
    for name, want in wanted.items():
        if name not in CHECKED:
            raise ValueError(f"can't be asked for: {name}")
        got = json.loads(row[name]) if name in ("args", "metadata") else row[name]
        if name == "tags":
            got, want = list(got or []), list(want)
        if got != want:
            out.append(f"{name} is {got!r}, not {want!r}")
    return out


def require_inserted(jobs: DataFrame, kind: str, **wanted) -> Row:
    """The only job of the kind, if it is as ``wanted`` (columns of
    :data:`CHECKED`; args and metadata as values, not text)."""
    rows = reads.jobs_by_kind(jobs, [kind]).limit(2).collect()
    if len(rows) != 1:
        raise AssertionError(f"{'no job' if not rows else 'more than one job'} of kind {kind}")
    if wrong := _differences(rows[0], wanted):
        raise AssertionError(f"the job of kind {kind}: {'; '.join(wrong)}")
    return rows[0]


def require_many_inserted(jobs: DataFrame, wanted: list[tuple[str, dict]]) -> list[Row]:
    """The jobs of the kinds in ``wanted``, by id, if they are these (kind, columns) in this order."""
    rows = reads.jobs_by_kind(jobs, sorted({k for k, _ in wanted})).limit(len(wanted) + 1).collect()
    kinds = [r["kind"] for r in rows]
    if kinds != [k for k, _ in wanted]:
        raise AssertionError(f"kinds are {kinds}, not {[k for k, _ in wanted]}")
    for i, (row, (kind, columns)) in enumerate(zip(rows, wanted, strict=True)):
        if wrong := _differences(row, columns):
            raise AssertionError(f"job {i} of kind {kind}: {'; '.join(wrong)}")
    return rows


def require_not_inserted(jobs: DataFrame, kind: str, **unwanted) -> None:
    """No job of the kind that is all of ``unwanted``."""
    for row in reads.jobs_by_kind(jobs, [kind]).toLocalIterator():
        if not _differences(row, unwanted):
            raise AssertionError(f"there is a job of kind {kind}" + (" like that" if unwanted else ""))


def work_one(workers: Workers, kind: str, args: dict | None = None, *, id_: int = 1, attempt: int = 1, metadata: str = "{}", queue: str = "default", attempted_at: datetime | None = None) -> dict:
    """The outcome of one run of a worker, here and now, hooks and all."""
    return workers.one({"id": id_, "kind": kind, "args": json.dumps(args or {}), "attempt": attempt, "metadata": metadata, "queue": queue, "attempted_at": attempted_at or datetime(2000, 1, 1)})
