"""SQLite files as a source of tables and as a polled stream of notifications.

Rows come in the tables' schemas: SQLite keeps times as text, arrays and JSON
as text, and bit masks as whole numbers. A table is read in ranges of its row
ids, a task per range; the file must lie where every executor can open it.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tarnwork.model import TABLES

FORMAT = "tarnwork_sqlite"


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _value(v, kind: T.DataType):
    """A stored value in the type of the table's schema."""
    if v is None:
        return None
    if isinstance(kind, T.TimestampNTZType):
        at = datetime.fromisoformat(v) if isinstance(v, str) else datetime.fromtimestamp(v, UTC)
        return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
    if isinstance(kind, T.ArrayType):
        items = json.loads(v) if isinstance(v, str | bytes) else v
        return None if items is None else [_value(x, kind.elementType) for x in items]
    if isinstance(kind, T.StructType):
        return tuple(_value(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.BinaryType):
        return v.encode() if isinstance(v, str) else bytes(v)
    if isinstance(kind, T.StringType):
        return v.decode() if isinstance(v, bytes) else str(v)
    return v


def _stored(v, kind: T.DataType):
    """The other way: how a value is kept."""
    if isinstance(v, datetime):
        return v.isoformat(sep=" ")
    if isinstance(kind, T.ArrayType):
        return None if v is None else json.dumps([x.asDict() if isinstance(x, T.Row) else x for x in v], default=str)
    return bytes(v) if isinstance(v, bytearray) else v


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("parts", "8"))

    def partitions(self) -> list[InputPartition]:
        with _connect(self.path) as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Rows(at, min(high, at + step - 1)) for at in range(low, high + 1, step)]

    def read(self, part: Rows) -> Iterator[tuple]:
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        with _connect(self.path) as con:
            for row in con.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (part.low, part.high)):
                yield tuple(_value(v, f.dataType) for v, f in zip(row, self.schema.fields, strict=True))


class Poller(SimpleDataSourceStreamReader):
    """New rows behind the last id that was read, at each trigger."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.start = int(options.get("after", "0"))

    def initialOffset(self) -> dict:
        return {"id": self.start}

    def _between(self, start: int, end: int | None) -> list[tuple]:
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        upto, given = ("", (start,)) if end is None else (" AND id <= ?", (start, end))
        with _connect(self.path) as con:
            rows = con.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE id > ?{upto} ORDER BY id", given).fetchall()
        return [tuple(_value(v, f.dataType) for v, f in zip(row, self.schema.fields, strict=True)) for row in rows]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._between(start["id"], None)
        at = self.schema.fieldNames().index("id")
        return iter(rows), {"id": max([start["id"], *(r[at] for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(start["id"], end["id"]))


class Sqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return TABLES[self.options["table"]]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(schema, dict(self.options))

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return Poller(schema, dict(self.options))


def read_sqlite(spark: SparkSession, path: str, name: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file, in the table's schema."""
    spark.dataSource.register(Sqlite)
    return spark.read.format(FORMAT).options(path=path, table=name, parts=parts).load()


def poll_sqlite(spark: SparkSession, path: str, name: str = "job_notification", after: int = 0) -> DataFrame:
    """The rows of a table (by default the outbox) behind ``after`` as a stream
    that asks for new ones at every trigger; each comes once."""
    spark.dataSource.register(Sqlite)
    return spark.readStream.format(FORMAT).options(path=path, table=name, after=after).load()


def write_sqlite(df: DataFrame, path: str, name: str) -> int:
    """Adds rows to a table of a SQLite file, creating it if need be; a row whose
    id (or other primary key) is there takes the old one's place. SQLite has one
    writer, so the rows pass through the driver one by one: for small tables."""
    kind = TABLES[name]
    key = kind.fields[0].name
    types = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.BinaryType: "BLOB"}
    columns = ", ".join(f"{_quoted(f.name)} {types.get(type(f.dataType), 'TEXT')}{' PRIMARY KEY' if f.name == key and name != 'job_migration' else ''}" for f in kind.fields)
    n = 0
    with sqlite3.connect(path) as con:
        con.execute(f"CREATE TABLE IF NOT EXISTS {_quoted(name)} ({columns})")
        for row in df.select(*kind.fieldNames()).toLocalIterator():
            con.execute(f"INSERT OR REPLACE INTO {_quoted(name)} VALUES ({', '.join('?' * len(row))})", [_stored(v, f.dataType) for v, f in zip(row, kind.fields, strict=True)])
            n += 1
    return n
