"""Lookups, lists and counts over the job tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import micros_of
from tarnwork.model import MIGRATIONS, STATES

#: Values of a list up to which it becomes an IN filter that reaches the scan.
INLINE = 1_000


def _among(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is one of ``values``: an IN filter, or a semi join for long lists."""
    if len(values) <= INLINE:
        return df.where(F.col(column).isin(*values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"`{column}` {dict(df.dtypes)[column]}")
    return df.join(wanted, column, "left_semi")


def job_by_id(jobs: DataFrame, id_: int) -> DataFrame:
    return jobs.where(F.col("id") == id_).limit(1)


def jobs_by_id(jobs: DataFrame, ids: list[int]) -> DataFrame:
    return _among(jobs, "id", ids).orderBy("id")


def jobs_by_kind(jobs: DataFrame, kinds: list[str]) -> DataFrame:
    return _among(jobs, "kind", kinds).orderBy("id")


def stuck_jobs(jobs: DataFrame, horizon: datetime, most: int, after: int = 0) -> DataFrame:
    """Running jobs begun before ``horizon``, by id, a batch at a time."""
    return jobs.where((F.col("state") == "running") & (F.col("id") > after) & (F.col("attempted_at") < F.lit(horizon).cast("timestamp_ntz"))).orderBy("id").limit(most)


def names(df: DataFrame, column: str, match: str = "", after: str = "", exclude: list[str] = (), most: int = 100) -> DataFrame:
    """Distinct values of a column in order: those that hold ``match`` (in any
    case; % and _ stand for anything), come after ``after`` and aren't excluded."""
    out = df.select(column)
    if match:
        out = out.where(F.col(column).ilike(f"%{match}%"))
    if after:
        out = out.where(F.col(column) > after)
    if exclude:
        out = out.where(~F.col(column).isin(*exclude))
    return out.distinct().orderBy(column).limit(most)


def queue_by_name(queues: DataFrame, name: str) -> DataFrame:
    return queues.where(F.col("name") == name)


def queue_list(queues: DataFrame, most: int = 100) -> DataFrame:
    if not 1 <= most <= 10_000:
        raise ValueError("a page has 1 to 10000 rows")
    return queues.orderBy("name").limit(most)


def count_by_state(jobs: DataFrame) -> DataFrame:
    """(state, n) for all eight states, zeros included."""
    counts = jobs.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    states = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    # Eight rows against eight at most.
    return F.broadcast(states).join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def count_in_state(jobs: DataFrame, state: str) -> DataFrame:
    return jobs.where(F.col("state") == state).agg(F.count(F.lit(1)).alias("n"))


def count_by_queue_and_state(jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """(queue, available, running) for each distinct name in ``queues``, in one pass."""
    wanted = queues.select("queue").distinct()
    counts = jobs.where(F.col("state").isin("available", "running")).groupBy("queue").agg(F.count_if(F.col("state") == "available").alias("available"), F.count_if(F.col("state") == "running").alias("running"))
    return wanted.join(counts, "queue", "left").fillna(0, ["available", "running"]).orderBy("queue")


def run_statistics(jobs: DataFrame, every: str | None = None) -> DataFrame:
    """Means of completed jobs, in seconds: time from creation to the end,
    wait in the queue and run; per window of ``every`` by end, or over all (0 if none)."""
    done = jobs.where(F.col("state") == "completed")
    def gap(a: str, b: str):
        us = micros_of(F.col(a)) - micros_of(F.col(b))  # whole numbers add up alike in any order
        return F.sum(us) / F.count(us) / F.lit(1e6)

    stats = [F.count(F.lit(1)).alias("n"), gap("finalized_at", "created_at").alias("complete_s"), gap("attempted_at", "scheduled_at").alias("queue_wait_s"), gap("finalized_at", "attempted_at").alias("run_s")]
    if every is None:
        return done.agg(*stats).fillna(0.0)
    return done.groupBy(F.window("finalized_at", every).alias("w")).agg(*stats).select(F.col("w.start").alias("start"), "n", "complete_s", "queue_wait_s", "run_s")


def last_notification_id(notes: DataFrame) -> DataFrame:
    return notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))


def notifications_after(notes: DataFrame, id_: int, topics: list[str] | None = None) -> DataFrame:
    """The tail of the outbox behind ``id_``, in order."""
    out = notes.where(F.col("id") > id_)
    if topics:
        out = out.where(F.col("topic").isin(*topics))
    return out.orderBy("id")


def migrations_of(migrations: DataFrame, line: str = "main") -> DataFrame:
    return migrations.where(F.col("line") == line).orderBy("version")


def missing_migrations(migrations: DataFrame, expected: dict[str, list[int]] = MIGRATIONS) -> DataFrame:
    """Versions that should be there and aren't."""
    want = migrations.sparkSession.createDataFrame([(k, v) for k, vs in expected.items() for v in vs], "line string, version bigint")
    return want.join(migrations.select("line", "version").distinct(), ["line", "version"], "left_anti")


# --- the catalogue -----------------------------------------------------------


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def column_exists(spark: SparkSession, name: str, column: str) -> bool:
    return spark.catalog.tableExists(name) and any(c.name == column for c in spark.catalog.listColumns(name))


def expired_schemas(spark: SparkSession, prefix: str, before: str) -> list[str]:
    """Databases of the prefix whose name comes before ``before``."""
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name.startswith(prefix) and d.name < before)


def which_exist(wanted: DataFrame, have: DataFrame, column: str) -> DataFrame:
    """The wanted names, in order, with ``exists``: whether ``have`` has them."""
    there = have.select(column).distinct().withColumn("__there", F.lit(True))
    return wanted.select(column).join(there, column, "left").select(column, F.col("__there").isNotNull().alias("exists")).orderBy(column)


def rebuilt_leftovers(names: DataFrame, column: str, name: str) -> DataFrame:
    """The names that a rebuild of ``name`` leaves behind when it breaks off: it
    with a suffix for the new or the old copy, and maybe a number."""
    suffix = F.substr(F.col(column), F.lit(len(name) + 1))
    return names.select(column).where(F.col(column).startswith(name) & suffix.rlike("^_cc(new|old)[0-9]*$")).orderBy(column)


def schema_create(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}")


def schema_drop(spark: SparkSession, name: str) -> None:
    """Drops a database with all its tables."""
    spark.sql(f"DROP DATABASE IF EXISTS {quoted(name)} CASCADE")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
