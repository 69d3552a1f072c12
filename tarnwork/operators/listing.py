"""Lists and deletes of jobs by typed filters, sorting and keyset pages."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tarnwork.functions import json_contains, tags_all, tags_any
from tarnwork.model import FINAL, STATES

MOST = 10_000
#: What stands for itself in a predicate (quoted text and names, comments), and a value's name.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|@(\w+)""", re.S)
_TIME_OF = {"running": "attempted_at"} | dict.fromkeys(FINAL, "finalized_at")


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the last row's id and, unless sorted by id, its time."""

    id: int
    kind: str
    queue: str
    sort_field: str
    time: datetime | None = None

    def encode(self) -> str:
        doc = {"id": self.id, "kind": self.kind, "queue": self.queue, "sort_field": self.sort_field, "time": self.time.isoformat() if self.time else None}
        return base64.urlsafe_b64encode(json.dumps(doc).encode()).decode()

    @staticmethod
    def decode(text: str) -> Cursor:
        doc = json.loads(base64.urlsafe_b64decode(text))
        return Cursor(doc["id"], doc["kind"], doc["queue"], doc["sort_field"], datetime.fromisoformat(doc["time"]) if doc["time"] else None)


@dataclass(frozen=True)
class JobFilter:
    """A query for jobs; every method gives a new one. Filters are ANDed, an
    empty list is no filter."""

    id_list: tuple[int, ...] = ()
    kind_list: tuple[str, ...] = ()
    priority_list: tuple[int, ...] = ()
    queue_list: tuple[str, ...] = ()
    state_list: tuple[str, ...] = tuple(STATES)
    states_set: bool = False
    all_tags: tuple[str, ...] = ()
    any_tags: tuple[str, ...] = ()
    fragments: tuple[str, ...] = ()
    predicates: tuple[tuple[str, tuple[tuple[str, object], ...]], ...] = ()
    sort_field: str = "id"
    descending: bool = False
    limit: int = 100
    cursor: Cursor | None = None
    unsafe: bool = field(default=False)

    def ids(self, *x: int) -> JobFilter:
        return replace(self, id_list=x)

    def kinds(self, *x: str) -> JobFilter:
        return replace(self, kind_list=x)

    def priorities(self, *x: int) -> JobFilter:
        return replace(self, priority_list=x)

    def queues(self, *x: str) -> JobFilter:
        return replace(self, queue_list=x)

    def states(self, *x: str) -> JobFilter:
        if unknown := set(x) - set(STATES):
            raise ValueError(f"unknown states: {sorted(unknown)}")
        return replace(self, state_list=x, states_set=True)

    def tags_all(self, *x: str) -> JobFilter:
        return replace(self, all_tags=x)

    def tags_any(self, *x: str) -> JobFilter:
        return replace(self, any_tags=x)

    def metadata(self, fragment: str) -> JobFilter:
        json.loads(fragment)
        return replace(self, fragments=(*self.fragments, fragment))

    def where(self, sql: str, *sets: dict, **args) -> JobFilter:
        """A predicate in SQL with values named ``@name``: each must be given, and
        used. Of several sets of values a later one overrules those before it.
        A name within quotes or a comment is text. Values become literals and
        are never read again, so they can't change the predicate."""
        given: dict = {}
        for more in (*sets, args):
            given |= more
        used = {m[1] for m in _TOKEN.finditer(sql) if m[1]}
        if missing := used - set(given):
            raise ValueError(f"values missing for {sorted(missing)}")
        if idle := set(given) - used:
            raise ValueError(f"values not used: {sorted(idle)}")
        return replace(self, predicates=(*self.predicates, (sql, tuple(given.items()))))

    def order_by(self, sort_field: str, descending: bool = False) -> JobFilter:
        if sort_field not in ("id", "finalized_at", "scheduled_at", "time"):
            raise ValueError(f"can't sort by {sort_field}")
        out = replace(self, sort_field=sort_field, descending=descending)
        if sort_field == "finalized_at" and not self.states_set:
            out = replace(out, state_list=tuple(FINAL))
        return out

    def first(self, n: int) -> JobFilter:
        if not 1 <= n <= MOST:
            raise ValueError(f"a page has 1 to {MOST} rows")
        return replace(self, limit=n)

    def after(self, cursor: Cursor) -> JobFilter:
        return replace(self, cursor=cursor)

    def unsafe_all(self) -> JobFilter:
        """Lets a delete run with no filter at all."""
        return replace(self, unsafe=True)

    # --- as columns ---

    @property
    def time_field(self) -> str | None:
        """The column sorted by before the id."""
        if self.sort_field == "id":
            return None
        if self.sort_field == "time":
            return _TIME_OF.get(self.state_list[0], "scheduled_at") if self.state_list else "time"
        return self.sort_field

    def _check(self) -> None:
        if self.sort_field == "finalized_at":
            if not self.state_list:
                raise ValueError("finalized_at needs filters of final states")
            if open_ := [s for s in self.state_list if s not in FINAL]:
                raise ValueError(f"finalized_at can't be sorted by with states {open_}")
        if self.sort_field == "time" and not self.state_list:
            raise ValueError("time needs a state")

    @property
    def filtered(self) -> bool:
        return bool(self.id_list or self.kind_list or self.priority_list or self.queue_list or self.states_set or self.all_tags or self.any_tags or self.fragments or self.predicates)

    def condition(self) -> Column:
        """All filters and the cursor as one column."""
        self._check()
        parts = [F.col(c).isin(*v) for c, v in (("id", self.id_list), ("kind", self.kind_list), ("priority", self.priority_list), ("queue", self.queue_list)) if v]
        if self.state_list and set(self.state_list) != set(STATES):
            parts.append(F.col("state").isin(*self.state_list))
        if self.all_tags:
            parts.append(tags_all(F.col("tags"), list(self.all_tags)))
        if self.any_tags:
            parts.append(tags_any(F.col("tags"), list(self.any_tags)))
        parts += [json_contains(F.col("metadata"), x) for x in self.fragments]
        for sql, args in self.predicates:
            values = dict(args)
            parts.append(F.expr(f"({_TOKEN.sub(lambda m, v=values: _literal(v[m[1]]) if m[1] else m[0], sql)})"))
        if self.cursor:
            c, id_ = self.cursor, F.col("id")
            beyond = id_ < c.id if self.descending else id_ > c.id
            if self.time_field and c.time is not None:
                t, at = F.col(self.time_field), F.lit(c.time).cast("timestamp_ntz")
                beyond = ((t < at) if self.descending else (t > at)) | ((t == at) & beyond)
            parts.append(beyond)
        out = F.lit(True)
        for i, p in enumerate(parts):
            out = p if not i else out & p
        return out

    def ordering(self) -> list[Column]:
        fields = [*([self.time_field] if self.time_field else []), "id"]
        return [F.col(c).desc_nulls_first() if self.descending else F.col(c).asc_nulls_last() for c in fields]

    def run(self, jobs: DataFrame) -> DataFrame:
        """The page of jobs, in order."""
        return jobs.where(self.condition()).orderBy(*self.ordering()).limit(self.limit)

    def cursor_of(self, row: Row) -> Cursor:
        """The cursor behind a row of the page."""
        return Cursor(row["id"], row["kind"], row["queue"], self.sort_field, row[self.time_field] if self.time_field else None)

    def last_cursor(self, page: DataFrame) -> Cursor | None:
        """The cursor behind the page's last row; None for an empty page."""
        rows = page.select("id", "kind", "queue", *([self.time_field] if self.time_field else [])).tail(1)
        return self.cursor_of(rows[0]) if rows else None

    def victims(self, jobs: DataFrame) -> DataFrame:
        """The jobs a delete by this filter takes: never running ones, at most a page."""
        if not self.filtered and not self.unsafe:
            raise ValueError("a delete with no filter needs unsafe_all()")
        return jobs.where(self.condition() & (F.col("state") != "running")).orderBy(*self.ordering()).limit(self.limit)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, datetime):
        return f"TIMESTAMP_NTZ '{v.isoformat(sep=' ')}'"
    if isinstance(v, list | tuple):
        return f"array({', '.join(map(_literal, v))})"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"
