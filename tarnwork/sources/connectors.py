"""Other ways in and out: JDBC, line-wise JSON, the notification outbox as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.model import NOTIFICATION, TABLES


def read_jdbc(spark: SparkSession, url: str, name: str, *, key: str | None = "id", parts: int = 16, **options: str) -> DataFrame:
    """A table of a live database, read in ranges of ``key``, a whole number or
    a time (None: by one task). The database's driver must be on the class
    path; none comes with this package."""
    source = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return source.option("dbtable", name).load()
    own = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = spark.read.format("jdbc").options(url=url, **options).option("query", f"SELECT min({own}) AS lo, max({own}) AS hi FROM {name}").load().first()
    if low is None:
        return source.option("dbtable", name).load()
    return source.options(dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high + 1, numPartitions=parts).load()


def write_jdbc(df: DataFrame, url: str, name: str, *, batch: int = 10_000, **options: str) -> None:
    """Bulk load into a table of a live database, by as many connections as
    there are partitions; a row that breaks a constraint fails the load.
    Columns a database has no type for go as text: arrays as JSON."""
    plain = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.col(f.name) for f in df.schema.fields]
    df.select(*plain).write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode("append").save()


def read_json(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table from files of one JSON object per line, in the table's schema."""
    return spark.read.schema(TABLES[name]).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append(df: DataFrame, path: str, name: str) -> None:
    """Bulk load: rows in the table's column order, appended as parquet."""
    df.select(*TABLES[name].fieldNames()).write.mode("append").parquet(path)


def clustered(jobs: DataFrame, path: str) -> None:
    """Jobs laid out for the engine's access paths: a folder per state, so that
    scans of one state read no other, and rows in fetch order within files, so
    that a queue's rows lie in few row groups."""
    spread = F.pmod(F.xxhash64("id"), F.lit(64))  # a state may hold most rows
    jobs.repartition("state", "queue", spread).sortWithinPartitions("queue", "priority", "scheduled_at", "id").write.partitionBy("state").mode("errorifexists").parquet(path)


def notifications(spark: SparkSession, path: str, topics: list[str] | None = None, files_per_trigger: int = 100) -> DataFrame:
    """The outbox as a stream: new files of the folder, of the given topics."""
    out = spark.readStream.schema(NOTIFICATION).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return out.where(F.col("topic").isin(*topics)) if topics else out
