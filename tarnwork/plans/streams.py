"""Queries stream_: streams over the tables' files, run until they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.model import JOB, NOTIFICATION
from tarnwork.plans.jobs import SQL as JOB_SQL
from tarnwork.runtime import prepared, scratch_path
from tarnwork.streaming import cooldown, job_events, queue_events, statistics, stuck


#: How late a row may come, and how far apart two copies of one.
LATE = "365 days"


def _source(spark: SparkSession, d: str, name: str, schema) -> DataFrame:
    # As a pattern, for a table may be one file or a folder of files.
    return prepared(spark).readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


def once(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Repeated rows of a stream counted once, if they come within :data:`LATE` of
    each other by ``ts``: the state of a key is dropped after that."""
    timed = stream.withColumn("__once", F.col(ts).cast("timestamp")).withWatermark("__once", LATE)
    return timed.dropDuplicatesWithinWatermark(keys).drop("__once")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """All that a stream gives for the files there are, as a table."""
    spark, base = stream.sparkSession, scratch_path(stream.sparkSession, label)
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def flushed(stream: DataFrame, label: str) -> DataFrame:
    """As :func:`drained`, of a stream of windows: also the ones that the
    watermark hasn't passed when the files are read. Each batch writes all
    windows anew; the last one's are the result."""
    spark, base = stream.sparkSession, scratch_path(stream.sparkSession, label)
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out")

    def write(windows: DataFrame, _: int) -> None:
        windows.write.mode("overwrite").parquet(f"{base}/out")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Insert notifications, at most one a minute per queue."""
    notes = _source(spark, d, "job_notification", NOTIFICATION).where("topic = 'job_insert'")
    return drained(cooldown(notes.withColumn("queue", F.get_json_object("payload", "$.queue")), "queue", "created_at", 60.0, "365 days"), "cooldown")


def stream_stuck(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that had been running for an hour by the time of the last update."""
    jobs = _source(spark, d, "job_row", JOB)
    updates = jobs.select("id", "state", "attempted_at", F.coalesce("finalized_at", "attempted_at", "created_at").alias("at"))
    return drained(stuck(updates, 3600.0, "at"), "stuck")


def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of all job updates."""
    events = job_events(once(_source(spark, d, "job_row", JOB), ["id", "state"], "created_at"))
    return drained(events.select("event", "id", "kind", "queue", "complete_s", "queue_wait_s", "run_s"), "events")


def stream_queue_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of queues paused, resumed and changed."""
    notes = _source(spark, d, "job_notification", NOTIFICATION).where("topic = 'job_control'")
    return drained(queue_events(once(notes, ["id"], "created_at")), "queue-events")


def stream_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Means of completed jobs per day of their end."""
    return flushed(statistics(_source(spark, d, "job_row", JOB), "1 day", LATE, keys=["id"]), "statistics")


QUERIES = {f.__name__: f for f in (stream_cooldown, stream_stuck, stream_events, stream_queue_events, stream_statistics)}

_GAP = "(epoch_us({}) - epoch_us({})) / 1e6"
SQL = {
    "stream_statistics": JOB_SQL["q_job_stats_daily"],
    "stream_cooldown": """WITH RECURSIVE n AS (SELECT DISTINCT json_extract_string(payload, '$.queue') AS queue, created_at FROM job_notification WHERE topic = 'job_insert'),
r AS (SELECT queue, min(created_at) AS created_at FROM n GROUP BY queue UNION ALL SELECT r.queue, min(n.created_at) FROM r JOIN n ON n.queue IS NOT DISTINCT FROM r.queue AND n.created_at >= r.created_at + INTERVAL 60 SECOND GROUP BY r.queue) SELECT * FROM r""",
    "stream_stuck": "SELECT DISTINCT id, attempted_at FROM job_row WHERE state = 'running' AND epoch_ms(attempted_at) + 3600000 < (SELECT max(epoch_ms(coalesce(finalized_at, attempted_at, created_at))) FROM job_row)",
    "stream_events": "SELECT CASE state WHEN 'completed' THEN 'job_completed' WHEN 'cancelled' THEN 'job_cancelled' ELSE 'job_failed' END AS event, id, kind, queue, "
    f"{_GAP.format('finalized_at', 'created_at')} AS complete_s, {_GAP.format('attempted_at', 'scheduled_at')} AS queue_wait_s, {_GAP.format('finalized_at', 'attempted_at')} AS run_s "
    "FROM (SELECT DISTINCT id, kind, queue, state, created_at, scheduled_at, attempted_at, finalized_at FROM job_row) WHERE state IN ('completed', 'cancelled', 'retryable', 'discarded')",
    "stream_queue_events": "SELECT CASE json_extract_string(payload, '$.action') WHEN 'pause' THEN 'queue_paused' WHEN 'resume' THEN 'queue_resumed' ELSE 'queue_metadata_changed' END AS event, json_extract_string(payload, '$.queue') AS queue, created_at FROM (SELECT DISTINCT id, created_at, payload, topic FROM job_notification) WHERE topic = 'job_control' AND json_extract_string(payload, '$.action') IN ('pause', 'resume', 'metadata_changed')",
}
