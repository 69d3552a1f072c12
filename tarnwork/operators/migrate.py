"""Migrations of a line: which are due, and applying them one by one."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from tarnwork.operators import commands
from tarnwork.sources.store import Store


def plan(known: list[int], have: list[int], direction: str, *, target: int | None = None, most: int | None = None) -> list[int]:
    """The versions to apply, in order. ``up``: the known ones that aren't there,
    lowest first, up to and with ``target``; ``down``: those that are there,
    highest first, one step unless told otherwise, down to but without
    ``target`` (-1: all). ``most`` bounds the steps."""
    if direction not in ("up", "down"):
        raise ValueError("a direction is up or down")
    if target is not None and target != -1 and target not in known:
        raise ValueError(f"version {target} isn't known")
    up = direction == "up"
    due = sorted(set(known) - set(have)) if up else sorted(set(known) & set(have), reverse=True)
    if target is not None and target != -1:
        if not up and target not in have:
            raise ValueError(f"version {target} isn't there to go down to")
        due = [v for v in due if (v <= target if up else v > target)]
    elif not up and target is None and most is None:
        most = 1
    return due if most is None else due[:most]


class Runner:
    """Applies migrations of lines to a store of the migration table. ``steps``
    has for each line its versions, each with a function for up and one for
    down (or None)."""

    def __init__(self, store: Store, steps: dict[str, dict[int, tuple[Callable | None, Callable | None]]]):
        self.store, self.steps = store, steps

    def versions(self, line: str = "main") -> list[int]:
        """The versions there are, lowest first."""
        return sorted(r["version"] for r in self.store.read().where(f"line = '{line}'").select("version").collect())

    def migrate(self, direction: str, line: str = "main", *, now: datetime, target: int | None = None, most: int | None = None, dry: bool = False) -> list[int]:
        """Applies what :func:`plan` gives and returns it; a step is recorded once
        it is done, so that a failed run can be taken up again."""
        if line not in self.steps:
            raise ValueError(f"no such line: {line}")
        due = plan(sorted(self.steps[line]), self.versions(line), direction, target=target, most=most)
        for v in [] if dry else due:
            f = self.steps[line][v][direction == "down"]
            if f is not None:
                f()
            table = self.store.read()
            if direction == "up":
                self.store.write(table.unionByName(commands.migrations_insert(table, line, [v], now)))
            else:
                self.store.write(commands.migrations_delete(table, line, [v]))
        return due

    def validate(self, line: str = "main") -> list[int]:
        """The versions that are missing."""
        return plan(sorted(self.steps[line]), self.versions(line), "up")
