"""Session settings, lineage cuts and small helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Bytes up to which a table whose size has been taken is broadcast.
SMALL = 8_000_000


def build_session(app: str = "tarnwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides them."""
    settings = NEEDED | {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Settings without which results differ: the zone of zoneless times, and the last of repeated keys in JSON.
NEEDED = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that results depend on."""
    for k, v in NEEDED.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, but only in local
    mode, where driver and executors are one process.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tarnwork-")
    spark.conf.set(CHECKPOINT_KEY, found)
    return found


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    a lost executor costs no recomputation. Deleted at the end of the
    :func:`scratch` it is in, or when the JVM exits."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_OPEN: list[list[str]] = []


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that is deleted like a staged table."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target, fs = _fs(spark, path)
    fs.deleteOnExit(target)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within are deleted at its end: results must be written or
    collected by then. For sessions that run many queries."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            target, fs = _fs(spark, path)
            fs.delete(target, True)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """A (written) table in as many partitions that each holds about ``rows``,
    for steps that take much time a row: sized by rows, not by bytes."""
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > 1 else df


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone (session zone UTC)."""
    return F.unix_micros(c.cast("timestamp"))
