"""A table as parquet snapshots and changes between them, with a single writer.

Parquet tables can't be updated in place. A change of some rows is written as
a delta: the rows as they are now, or as gone. Readers take the newest
snapshot and the deltas behind it; after some deltas the next snapshot is
written in whole. The writer is one driver: its changes are applied one after
the other, which stands in for row locks and transactions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.runtime import SMALL


class Store:
    """One table in ``folder``, on any file system Spark can write. ``key`` is
    its unique column; ``keep`` snapshots are kept, and after ``deltas`` deltas
    a snapshot is written."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keep: int = 3, key: str = "id", deltas: int = 16):
        self.spark, self.folder, self.schema, self.keep, self.key, self.deltas = spark, folder.rstrip("/"), schema, keep, key, deltas
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _have(self) -> list[tuple[int, str]]:
        """(number, v for a snapshot or d for a delta) of all that is complete, oldest first."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        found = [(int(n[1:]), n[0]) for n in names if n[:1] in ("v", "d") and n[1:].isdigit()]
        return sorted((v, k) for v, k in found if self._fs.exists(self._path(f"{self._at(v, k)}/_SUCCESS")))

    def versions(self) -> list[int]:
        """Numbers of the versions that can be read, oldest first: a snapshot and all behind it."""
        have = self._have()
        first = next((v for v, k in have if k == "v"), None)
        return [v for v, _ in have if first is not None and v >= first]

    def _at(self, version: int, kind: str = "v") -> str:
        return f"{self.folder}/{kind}{version:09d}"

    def _size(self, version: int) -> int:
        return self._fs.getContentSummary(self._path(self._at(version, "d"))).getLength()

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the newest by default; empty before the first write."""
        have = [(v, k) for v, k in self._have() if version is None or v <= version]
        base = max((v for v, k in have if k == "v"), default=None)
        if base is None:
            return self.spark.createDataFrame([], self.schema)
        table = self.spark.read.schema(self.schema).parquet(self._at(base))
        later = [v for v, k in have if k == "d" and v > base]
        if not later:
            return table
        columns = self.schema.fieldNames()
        kind = T.StructType([*self.schema.fields, T.StructField("__gone", T.BooleanType())])
        rows = reduce(DataFrame.unionByName, (self.spark.read.schema(kind).parquet(self._at(v, "d")).withColumn("__version", F.lit(v)) for v in later))
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns, "__gone"), "__version").alias("r")).select("r.*")
        gone = last.select(self.key)
        few = sum(map(self._size, later)) <= SMALL // 4  # compressed
        return table.join(F.broadcast(gone) if few else gone, self.key, "left_anti").select(*columns).unionByName(last.where("NOT __gone").select(*columns))

    def write(self, table: DataFrame) -> int:
        """The next snapshot in whole; those beyond ``keep`` are deleted, with their deltas."""
        have = self._have()
        new = (have[-1][0] if have else 0) + 1
        table.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._at(new))
        kept = [v for v, k in have if k == "v"][-(self.keep - 1) :] if self.keep > 1 else []
        oldest = kept[0] if kept else new
        for v, k in have:
            if v < oldest:
                self._fs.delete(self._path(self._at(v, k)), True)
        return new

    def merge(self, rows: DataFrame, gone: bool = False) -> int:
        """The next version, with ``rows`` as they are now, or without them: only
        they are written. They must not hang on files of an older version than
        are kept."""
        have = self._have()
        if not have:
            return self.write(rows if not gone else rows.limit(0))
        new = have[-1][0] + 1
        rows.select(*self.schema.fieldNames()).withColumn("__gone", F.lit(gone)).write.mode("overwrite").parquet(self._at(new, "d"))
        base = max(v for v, k in have if k == "v")
        return self.write(self.read()) if sum(v > base for v, k in have if k == "d") + 1 >= self.deltas else new

    def truncate(self) -> int:
        """The next version: an empty snapshot."""
        return self.write(self.spark.createDataFrame([], self.schema))

    def change(self, f: Callable[[DataFrame], DataFrame]) -> int:
        """The next snapshot, as a function of the newest version: for changes of most rows."""
        return self.write(f(self.read()))
