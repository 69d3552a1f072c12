"""Queries q_ over the job tables: reads, lists, changes of state, and upkeep."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork import functions as fn
from tarnwork.model import LEADER, STATES, broken_rules
from tarnwork.operators import commands, machine, reads
from tarnwork.operators.listing import JobFilter
from tarnwork.runtime import staged
from tarnwork.sources import distinct_rows, table
from tarnwork.streaming.operators import job_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The time at which all queries run.
NOW, NOW_SQL = datetime(2025, 4, 15), "TIMESTAMP '2025-04-15 00:00:00'"
HORIZON, HORIZON_SQL = datetime(2025, 4, 14, 23), "TIMESTAMP '2025-04-14 23:00:00'"
IDS = [1354, 5049, 6040, 6236, 8027, 15246, 17811, 24083]
BASIC = ["id", "kind", "queue", "state", "priority", "attempt", "scheduled_at"]
_BASIC = ", ".join(BASIC)
_IDS = ", ".join(map(str, IDS))


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _jobs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return distinct_rows(table(spark, d, "job_row"), *(columns or BASIC))


def _from(*columns: str) -> str:
    return f"(SELECT DISTINCT {', '.join(columns or BASIC)} FROM job_row)"


# --- reads -------------------------------------------------------------------


@query(f"SELECT {_BASIC} FROM {_from()} WHERE id = {IDS[0]}")
def q_job_get_by_id(spark, d):
    return reads.job_by_id(_jobs(spark, d), IDS[0])


@query(f"SELECT {_BASIC} FROM {_from()} WHERE id IN ({_IDS})")
def q_job_get_by_id_many(spark, d):
    return reads.jobs_by_id(_jobs(spark, d), IDS)


@query(f"SELECT {_BASIC} FROM {_from()} WHERE kind IN ('ledger_post', 'seat_assign')")
def q_job_get_by_kind_many(spark, d):
    return reads.jobs_by_kind(_jobs(spark, d), ["ledger_post", "seat_assign"])


@query(f"SELECT id, kind, attempted_at FROM {_from('id', 'kind', 'state', 'attempted_at')} WHERE state = 'running' AND attempted_at < {HORIZON_SQL} AND id > 20 ORDER BY id LIMIT 100")
def q_job_get_stuck(spark, d):
    return reads.stuck_jobs(_jobs(spark, d, "id", "kind", "state", "attempted_at"), HORIZON, 100, after=20).select("id", "kind", "attempted_at")


@query(f"SELECT {_BASIC} FROM {_from()} ORDER BY id LIMIT 100")
def q_job_list_default(spark, d):
    return JobFilter().run(_jobs(spark, d))


_FILTER = JobFilter().kinds("webhook_deliver", "ledger_post").priorities(1, 2).queues("default", "mailers", "ledger_sync").states("completed", "retryable").first(10_000)


@query(f"SELECT {_BASIC} FROM {_from()} WHERE kind IN ('webhook_deliver', 'ledger_post') AND priority IN (1, 2) AND queue IN ('default', 'mailers', 'ledger_sync') AND state IN ('completed', 'retryable') ORDER BY id LIMIT 10000")
def q_job_list_filters(spark, d):
    return _FILTER.run(_jobs(spark, d))


@query(f"SELECT id FROM {_from('id', 'tags')} WHERE list_has_all(tags, ['fjord', 'reed']) ORDER BY id LIMIT 10000")
def q_job_list_tags_all(spark, d):
    return JobFilter().tags_all("fjord", "reed").first(10_000).run(_jobs(spark, d, "id", "tags")).select("id")


@query(f"SELECT id FROM {_from('id', 'tags')} WHERE list_has_any(tags, ['fjord', 'umber']) ORDER BY id LIMIT 10000")
def q_job_list_tags_any(spark, d):
    return JobFilter().tags_any("fjord", "umber").first(10_000).run(_jobs(spark, d, "id", "tags")).select("id")


@query(f"""SELECT id FROM {_from('id', 'metadata')} WHERE json_extract_string(metadata, '$."runner:resumable_step"') = 'basil' AND json_type(metadata, '$."runner:resumable_cursor"') = 'OBJECT' ORDER BY id LIMIT 10000""")
def q_job_list_metadata(spark, d):
    wanted = '{"runner:resumable_step": "basil", "runner:resumable_cursor": {}}'
    return JobFilter().metadata(wanted).first(10_000).run(_jobs(spark, d, "id", "metadata")).select("id")


@query(f"SELECT {_BASIC} FROM {_from()} WHERE attempt >= 3 AND queue LIKE 'tenant%' ORDER BY id LIMIT 10000")
def q_job_list_where(spark, d):
    return JobFilter().where("attempt >= @n", n=3).where("queue LIKE @q", q="tenant%").first(10_000).run(_jobs(spark, d))


@query(f"SELECT id, attempted_at FROM {_from('id', 'state', 'attempted_at')} WHERE state = 'running' ORDER BY attempted_at DESC NULLS FIRST, id DESC LIMIT 50")
def q_job_list_time_desc(spark, d):
    return JobFilter().states("running").order_by("time", descending=True).first(50).run(_jobs(spark, d, "id", "state", "attempted_at")).select("id", "attempted_at")


@query(f"SELECT id, state, finalized_at FROM {_from('id', 'state', 'finalized_at')} WHERE state IN ('cancelled', 'completed', 'discarded') ORDER BY finalized_at ASC NULLS LAST, id LIMIT 200")
def q_job_list_finalized(spark, d):
    return JobFilter().order_by("finalized_at").first(200).run(_jobs(spark, d, "id", "state", "finalized_at"))


@query(f"SELECT {_BASIC} FROM {_from()} WHERE state = 'available' ORDER BY scheduled_at, id LIMIT 50 OFFSET 50")
def q_job_list_page2(spark, d):
    jobs = _jobs(spark, d)
    page = JobFilter().states("available").order_by("scheduled_at").first(50)
    cursor = page.last_cursor(page.run(jobs))
    return page.after(cursor).run(jobs) if cursor else page.run(jobs)


@query("SELECT DISTINCT kind FROM job_row WHERE kind ILIKE '%RE%' AND kind > 'geo' AND kind NOT IN ('report_build') ORDER BY kind LIMIT 20")
def q_job_kind_list(spark, d):
    return reads.names(table(spark, d, "job_row"), "kind", "RE", "geo", ["report_build"], 20)


@query("SELECT name, created_at, metadata, paused_at, updated_at FROM job_queue WHERE name = 'default'")
def q_queue_get(spark, d):
    return reads.queue_by_name(table(spark, d, "job_queue"), "default")


@query("SELECT name, created_at, metadata, paused_at, updated_at FROM job_queue ORDER BY name LIMIT 100")
def q_queue_list(spark, d):
    return reads.queue_list(table(spark, d, "job_queue"))


@query("SELECT DISTINCT name FROM job_queue WHERE name ILIKE '%shop%' AND name > 'm' AND name NOT IN ('shop0000166') ORDER BY name LIMIT 50")
def q_queue_name_list(spark, d):
    return reads.names(table(spark, d, "job_queue"), "name", "shop", "m", ["shop0000166"], 50)


@query("SELECT w.name, EXISTS (SELECT 1 FROM job_queue q WHERE q.name = w.name) AS exists FROM (SELECT unnest(['default', 'mailers', 'nowhere']) AS name) w")
def q_names_exist(spark, d):
    wanted = spark.createDataFrame([("default",), ("mailers",), ("nowhere",)], "name string")
    return reads.which_exist(wanted, table(spark, d, "job_queue"), "name")


@query("SELECT DISTINCT name || s AS name FROM job_queue, (SELECT unnest(['_ccnew', '_ccold12']) AS s) WHERE name = 'default'")
def q_rebuild_leftovers(spark, d):
    queues = table(spark, d, "job_queue").select("name")
    made = queues.select(F.explode(F.array(*(F.concat("name", F.lit(s)) for s in ("", "_ccnew", "_ccold12", "_ccnewer", "_1")))).alias("name"))
    return reads.rebuilt_leftovers(made, "name", "default")


@query(f"""SELECT to_base64(encode('{{"id": ' || id || ', "kind": "' || kind || '", "queue": "' || queue || '", "sort_field": "id", "time": null}}')) AS cursor FROM (SELECT id, kind, queue FROM {_from()} ORDER BY id LIMIT 100) ORDER BY id DESC LIMIT 1""")
def q_job_list_cursor(spark, d):
    """The cursor behind the first page, as text."""
    cursor = JobFilter().last_cursor(JobFilter().run(_jobs(spark, d)))
    return spark.createDataFrame([(cursor.encode(),)] if cursor else [], "cursor string")


_ALL_STATES = " UNION ALL ".join(f"SELECT '{s}' AS state" for s in STATES)


@query(f"SELECT s.state, count(j.id) AS n FROM ({_ALL_STATES}) s LEFT JOIN {_from('id', 'state')} j ON j.state = s.state GROUP BY s.state")
def q_count_by_all_states(spark, d):
    return reads.count_by_state(_jobs(spark, d, "id", "state"))


@query(f"SELECT q.name AS queue, count(*) FILTER (WHERE j.state = 'available') AS available, count(*) FILTER (WHERE j.state = 'running') AS running FROM job_queue q LEFT JOIN {_from('id', 'queue', 'state')} j ON j.queue = q.name GROUP BY q.name")
def q_count_by_queue_and_state(spark, d):
    queues = table(spark, d, "job_queue").select(F.col("name").alias("queue"))
    return reads.count_by_queue_and_state(_jobs(spark, d, "id", "queue", "state"), queues)


@query(f"SELECT count(*) AS n FROM {_from('id', 'state')} WHERE state = 'retryable'")
def q_count_by_state(spark, d):
    return reads.count_in_state(_jobs(spark, d, "id", "state"), "retryable")


_TIMES = ["id", "state", "created_at", "scheduled_at", "attempted_at", "finalized_at"]


def _mean(a: str, b: str, name: str) -> str:
    us = f"epoch_us({a}) - epoch_us({b})"
    return f"CAST(sum({us}) AS DOUBLE) / count({us}) / 1e6 AS {name}"


_MEANS = ", ".join([_mean("finalized_at", "created_at", "complete_s"), _mean("attempted_at", "scheduled_at", "queue_wait_s"), _mean("finalized_at", "attempted_at", "run_s")])


@query(f"SELECT count(*) AS n, {_MEANS} FROM {_from(*_TIMES)} WHERE state = 'completed'")
def q_job_stats(spark, d):
    return reads.run_statistics(_jobs(spark, d, *_TIMES))


@query(f"SELECT date_trunc('day', finalized_at)::TIMESTAMP AS start, count(*) AS n, {_MEANS} FROM {_from(*_TIMES)} WHERE state = 'completed' GROUP BY 1")
def q_job_stats_daily(spark, d):
    out = reads.run_statistics(_jobs(spark, d, *_TIMES), "1 day")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT coalesce(max(id), 0) AS id FROM job_notification")
def q_notification_last_id(spark, d):
    return reads.last_notification_id(table(spark, d, "job_notification"))


@query("SELECT DISTINCT id, created_at, payload, topic FROM job_notification WHERE id > 100 AND topic IN ('job_control', 'job_leadership')")
def q_notification_tail(spark, d):
    notes = distinct_rows(table(spark, d, "job_notification"), "id", "created_at", "payload", "topic")
    return reads.notifications_after(notes, 100, ["job_control", "job_leadership"])


@query("SELECT line, version, created_at FROM job_migration WHERE line = 'main'")
def q_migration_list(spark, d):
    return reads.migrations_of(table(spark, d, "job_migration"))


@query("SELECT e.line, e.version FROM (SELECT 'main' AS line, unnest(range(1, 10)) AS version UNION ALL SELECT 'extra', unnest(range(1, 5))) e WHERE NOT EXISTS (SELECT 1 FROM job_migration m WHERE m.line = e.line AND m.version = e.version)")
def q_migration_validate(spark, d):
    return reads.missing_migrations(table(spark, d, "job_migration"), {"main": [*range(1, 10)], "extra": [*range(1, 5)]})


@query(f"""SELECT id, rule FROM (SELECT id, unnest([CASE WHEN (state IN ('cancelled', 'completed', 'discarded')) != (finalized_at IS NOT NULL) THEN 'finalized_or_finalized_at_null' END, CASE WHEN priority NOT BETWEEN 1 AND 4 THEN 'priority_in_range' END, CASE WHEN length(queue) NOT BETWEEN 1 AND 127 THEN 'queue_length' END, CASE WHEN length(kind) NOT BETWEEN 1 AND 127 THEN 'kind_length' END, CASE WHEN max_attempts <= 0 THEN 'max_attempts_is_positive' END]) AS rule FROM {_from('id', 'state', 'finalized_at', 'priority', 'queue', 'kind', 'max_attempts')}) WHERE rule IS NOT NULL""")
def q_table_rules(spark, d):
    return broken_rules(_jobs(spark, d, "id", "state", "finalized_at", "priority", "queue", "kind", "max_attempts"))


# --- scalar functions --------------------------------------------------------

_BIT = "CASE state " + " ".join(f"WHEN '{s}' THEN {1 << i}" for i, s in enumerate(STATES)) + " END"


def _held(mask: str = "unique_states", state: str = "state") -> str:
    return f"(({mask} & {_BIT.replace('CASE state', f'CASE {state}')}) != 0)"


@query(f"SELECT unique_states, state, {_held()} AS held, count(*) AS n FROM {_from('id', 'unique_states', 'state')} WHERE unique_states IS NOT NULL GROUP BY ALL")
def q_state_in_bitmask(spark, d):
    jobs = _jobs(spark, d, "id", "unique_states", "state").where("unique_states IS NOT NULL")
    return jobs.groupBy("unique_states", "state", fn.in_mask(F.col("unique_states"), F.col("state")).alias("held")).agg(F.count(F.lit(1)).alias("n"))


def _period_sql(seconds: int) -> str:
    at = f"(floor(epoch_us(scheduled_at) / 1000000.0)::BIGINT + {fn.columns.YEAR_ONE})"
    return f"make_timestamp(({at} - {at} % {seconds} - {fn.columns.YEAR_ONE}) * 1000000)"


@query(f"SELECT id, {_period_sql(604_800)} AS week, {_period_sql(900)} AS quarter FROM {_from('id', 'scheduled_at')}")
def q_unique_period_bucket(spark, d):
    ts = F.col("scheduled_at")
    return _jobs(spark, d, "id", "scheduled_at").select("id", fn.period_start(ts, 604_800).alias("week"), fn.period_start(ts, 900).alias("quarter"))


_KEY = f"'&kind=' || kind || '&args={{' || coalesce('\"account_id\":' || CAST(json_extract(args, '$.account_id') AS VARCHAR), '') || '}}&period=' || strftime({_period_sql(86_400)}, '%Y-%m-%dT%H:%M:%SZ') || '&queue=' || queue"


@query(f"SELECT id, {_KEY} AS text, sha256({_KEY}) AS key FROM {_from('id', 'kind', 'queue', 'scheduled_at', 'args')}")
def q_unique_key(spark, d):
    text = fn.unique_key_text(F.col("kind"), F.col("args"), ["account_id"], F.col("scheduled_at"), 86_400, F.col("queue"))
    jobs = _jobs(spark, d, "id", "kind", "queue", "scheduled_at", "args").select("id", text.alias("text"))
    return jobs.select("id", "text", fn.unique_key_hex(F.col("text")).alias("key"))


@query(f"SELECT id, CAST(pow(coalesce(len(errors), 0) + 1, 4) AS DOUBLE) AS seconds FROM {_from('id', 'errors')}")
def q_retry_delay(spark, d):
    return _jobs(spark, d, "id", "errors").select("id", fn.retry_seconds(F.col("errors")).alias("seconds"))


# --- inserts -----------------------------------------------------------------

_WHOLE = ["id", "args", "attempt", "attempted_at", "attempted_by", "created_at", "errors", "finalized_at", "kind", "max_attempts", "metadata", "priority", "queue", "scheduled_at", "state", "tags", "unique_key", "unique_states"]


def _inserted(spark: SparkSession, d: str) -> DataFrame:
    """Every job with a unique key is inserted again, as a new available one."""
    jobs = staged(_jobs(spark, d, *_WHOLE), "jobs")  # read by different columns
    again = jobs.where("unique_key IS NOT NULL").select(F.col("id").alias("ordinal"), "args", "kind", "queue", "priority", "tags", "unique_key", "unique_states")
    return commands.insert(jobs, again, NOW)


_INSERT = f"""WITH j AS (SELECT DISTINCT id, state, unique_key, unique_states FROM job_row), holder AS (SELECT unique_key, id, state FROM j WHERE unique_key IS NOT NULL AND {_held()}),
batch AS (SELECT id AS ordinal, unique_key, (SELECT max(id) FROM j) + id + 1 AS new_id, row_number() OVER (PARTITION BY unique_key ORDER BY id) AS rk, first_value(id) OVER (PARTITION BY unique_key ORDER BY id) + (SELECT max(id) FROM j) + 1 AS first_id FROM j WHERE unique_key IS NOT NULL)
SELECT b.ordinal, coalesce(h.id, b.first_id) AS id, coalesce(h.state, 'available') AS state, h.id IS NOT NULL OR b.rk > 1 AS duplicate FROM batch b LEFT JOIN holder h ON h.unique_key = b.unique_key"""


@query(_INSERT)
def q_insert_unique(spark, d):
    return _inserted(spark, d).select("ordinal", "id", "state", "duplicate")


@query(f"SELECT count(*) FILTER (WHERE NOT duplicate) AS inserted, count(*) FILTER (WHERE duplicate) AS skipped FROM ({_INSERT})")
def q_insert_skip_count(spark, d):
    return _inserted(spark, d).agg(F.count_if(~F.col("duplicate")).alias("inserted"), F.count_if("duplicate").alias("skipped"))


@query(f"""SELECT '{{"queue":"' || queue || '"}}' AS payload, 'job_insert' AS topic FROM (SELECT DISTINCT j.queue FROM ({_INSERT}) i JOIN (SELECT DISTINCT id, queue FROM job_row) j ON j.id = i.ordinal WHERE NOT i.duplicate)""")
def q_insert_notices(spark, d):
    return commands.insert_notices(_inserted(spark, d))


@query(f"SELECT id, state, attempted_at, max_attempts, len(tags) AS n_tags, unique_states FROM (SELECT DISTINCT id, state, CASE WHEN state IN ('completed', 'discarded', 'retryable', 'running') THEN coalesce(attempted_at, {NOW_SQL}) ELSE attempted_at END AS attempted_at, max_attempts, tags, unique_states FROM job_row)")
def q_insert_full(spark, d):
    out = commands.insert_full(_jobs(spark, d, *_WHOLE), NOW)
    return out.select("id", "state", "attempted_at", "max_attempts", F.size("tags").cast("bigint").alias("n_tags"), "unique_states")


# --- fetch and schedule ------------------------------------------------------

_FETCH = ["id", "state", "queue", "priority", "scheduled_at", "attempt", "attempted_at", "attempted_by"]
_CAPPED = "(CASE WHEN len(attempted_by) >= 2 THEN [attempted_by[-1]] ELSE coalesce(attempted_by, []) END || ['worker-1'])"


@query(f"SELECT id, 'running' AS state, attempt + 1 AS attempt, {NOW_SQL} AS attempted_at, array_to_string({_CAPPED}, ',') AS attempted_by FROM {_from(*_FETCH)} WHERE state = 'available' AND queue = 'default' AND scheduled_at <= {NOW_SQL} ORDER BY priority, scheduled_at, id LIMIT 50")
def q_job_get_available(spark, d):
    taken = commands.fetch(_jobs(spark, d, *_FETCH), "default", 50, NOW, "worker-1", most_workers=2)
    return taken.select("id", "state", "attempt", "attempted_at", F.array_join("attempted_by", ",").alias("attempted_by"))


@query(f"SELECT id, queue, attempt + 1 AS attempt FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority, scheduled_at, id) AS rk FROM {_from(*_FETCH)} WHERE state = 'available' AND scheduled_at <= {NOW_SQL}) j JOIN job_queue q ON q.name = j.queue WHERE rk <= CASE WHEN q.paused_at IS NULL THEN 3 ELSE 0 END")
def q_fetch_all_queues(spark, d):
    room = table(spark, d, "job_queue").select(F.col("name").alias("queue"), F.when(F.col("paused_at").isNull(), 3).otherwise(0).alias("most"))
    return commands.fetch_all(_jobs(spark, d, *_FETCH), room, NOW, "worker-1").select("id", "queue", "attempt")


_SCHEDULE = ["id", "state", "queue", "priority", "scheduled_at", "finalized_at", "metadata", "unique_key", "unique_states"]


def _schedule_sql(limit: str) -> str:
    return f"""WITH j AS (SELECT DISTINCT {', '.join(_SCHEDULE)} FROM job_row),
b AS (SELECT *, CASE WHEN unique_key IS NOT NULL AND unique_states IS NOT NULL THEN row_number() OVER (PARTITION BY unique_key ORDER BY priority, scheduled_at, id) END AS rk FROM (SELECT * FROM j WHERE state IN ('retryable', 'scheduled') AND scheduled_at <= {NOW_SQL} ORDER BY priority, scheduled_at, id {limit})),
c AS (SELECT DISTINCT o.unique_key FROM j o JOIN b ON o.unique_key = b.unique_key AND o.id != b.id WHERE o.unique_states IS NOT NULL AND {_held('o.unique_states', 'o.state')}),
u AS (SELECT b.*, b.rk IS NOT NULL AND (c.unique_key IS NOT NULL OR b.rk > 1) AS conflict FROM b LEFT JOIN c ON c.unique_key = b.unique_key)
SELECT id, CASE WHEN conflict THEN 'discarded' ELSE 'available' END AS state, conflict, CASE WHEN conflict THEN {NOW_SQL} ELSE finalized_at END AS finalized_at, CASE WHEN conflict THEN 'scheduler_discarded' ELSE json_extract_string(metadata, '$.unique_key_conflict') END AS note FROM u"""


def _scheduled(spark: SparkSession, d: str, most: int | None) -> DataFrame:
    out = commands.schedule(_jobs(spark, d, *_SCHEDULE), NOW, most)
    return out.select("id", "state", "conflict", "finalized_at", F.get_json_object("metadata", "$.unique_key_conflict").alias("note"))


@query(_schedule_sql(""))
def q_job_schedule(spark, d):
    return _scheduled(spark, d, None)


@query(_schedule_sql("LIMIT 500"))
def q_job_schedule_batch(spark, d):
    return _scheduled(spark, d, 500)


# --- the end of a run --------------------------------------------------------

_RUN = ["id", "kind", "state", "priority", "attempt", "max_attempts", "attempted_at", "scheduled_at", "finalized_at", "errors", "metadata"]
_STATE = "CASE priority WHEN 1 THEN 'completed' WHEN 2 THEN 'retryable' WHEN 3 THEN 'discarded' ELSE 'scheduled' END"
_HAS_CANCEL = "list_contains(json_keys(metadata), 'cancel_attempted_at')"


@query(
    f"""WITH j AS {_from(*_RUN)}, b AS (SELECT *, {_STATE} AS new, state = 'running' AND priority IN (2, 4) AND {_HAS_CANCEL} AS cancels FROM j WHERE state IN ('running', 'retryable'))
SELECT id, CASE WHEN cancels THEN 'cancelled' WHEN state = 'running' THEN new ELSE state END AS state, CASE WHEN state = 'running' AND NOT cancels AND priority = 4 THEN attempt - 1 ELSE attempt END AS attempt,
CASE WHEN cancels THEN {NOW_SQL} WHEN state = 'running' AND priority IN (1, 3) THEN {NOW_SQL} ELSE finalized_at END AS finalized_at,
CASE WHEN state = 'running' AND NOT cancels AND priority IN (2, 4) THEN {NOW_SQL} + INTERVAL 1 HOUR ELSE scheduled_at END AS scheduled_at,
CAST(coalesce(len(errors), 0) + CASE WHEN state = 'running' AND priority IN (2, 3) THEN 1 ELSE 0 END AS BIGINT) AS n_errors, CASE WHEN priority = 2 THEN 'done' ELSE json_extract_string(metadata, '$.note') END AS note, CAST(len(json_keys(metadata)) + CASE WHEN priority = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_keys FROM b"""
)
def q_set_state_many(spark, d):
    jobs = _jobs(spark, d, *_RUN)
    p, later = F.col("priority"), F.lit(datetime(2025, 4, 15, 1)).cast("timestamp_ntz")
    error = F.struct(commands.at(NOW).alias("at"), F.col("attempt").alias("attempt"), F.lit("failed").alias("error"), F.lit("").alias("trace"))
    batch = jobs.where(F.col("state").isin("running", "retryable")).select(
        "id",
        F.when(p == 1, "completed").when(p == 2, "retryable").when(p == 3, "discarded").otherwise("scheduled").alias("state"),
        F.when(p == 4, F.col("attempt") - 1).alias("attempt"),
        F.when(p.isin(2, 3), error).alias("error"),
        F.when(p.isin(1, 3), commands.at(NOW)).alias("finalized_at"),
        F.when(p == 2, F.lit('{"note":"done"}')).alias("metadata"),
        F.when(p.isin(2, 4), later).alias("scheduled_at"),
    )
    out = commands.set_state(jobs, batch, NOW)
    size = F.coalesce(F.when(F.col("errors").isNotNull(), F.size("errors")), F.lit(0)).cast("bigint")
    return out.select("id", "state", "attempt", "finalized_at", "scheduled_at", size.alias("n_errors"), F.get_json_object("metadata", "$.note").alias("note"), F.size(F.json_object_keys("metadata")).cast("bigint").alias("n_keys"))


_DELAY = "CAST(pow(coalesce(len(errors), 0) + 1, 4) AS BIGINT)"


@query(
    f"""WITH j AS (SELECT *, {NOW_SQL} + to_seconds({_DELAY}) AS retry_at FROM {_from(*_RUN)} WHERE state = 'running'),
n AS (SELECT *, CASE WHEN priority = 1 THEN 'completed' WHEN priority = 4 THEN 'scheduled' WHEN priority = 3 THEN 'available' WHEN attempt >= max_attempts THEN 'discarded' WHEN {_DELAY} <= 5 THEN 'available' ELSE 'retryable' END AS new FROM j),
c AS (SELECT *, new IN ('retryable', 'scheduled') AND {_HAS_CANCEL} AS cancels FROM n)
SELECT id, CASE WHEN cancels THEN 'cancelled' ELSE new END AS state, CASE WHEN cancels THEN attempt WHEN priority = 4 THEN attempt - 1 WHEN priority = 3 THEN greatest(attempt - 1, 0) ELSE attempt END AS attempt,
CASE WHEN cancels OR new IN ('completed', 'discarded') THEN {NOW_SQL} ELSE finalized_at END AS finalized_at,
CASE WHEN cancels THEN scheduled_at WHEN priority = 4 THEN {NOW_SQL} + INTERVAL 90 SECOND WHEN priority = 3 THEN {NOW_SQL} WHEN priority = 2 AND attempt < max_attempts THEN retry_at ELSE scheduled_at END AS scheduled_at,
CAST(coalesce(len(errors), 0) + CASE WHEN priority = 2 THEN 1 ELSE 0 END AS BIGINT) AS n_errors, CASE WHEN priority = 4 THEN CAST(coalesce(CAST(json_extract_string(metadata, '$.snoozes') AS BIGINT), 0) + 1 AS VARCHAR) ELSE json_extract_string(metadata, '$.snoozes') END AS snoozes FROM c"""
)
def q_apply_outcomes(spark, d):
    """Every running job ends: by priority it is done, fails, is stopped or snoozed."""
    jobs = _jobs(spark, d, *_RUN)
    out = commands.set_state(jobs, machine.commands_of(jobs, _outcomes(jobs), NOW), NOW)
    size = F.coalesce(F.when(F.col("errors").isNotNull(), F.size("errors")), F.lit(0)).cast("bigint")
    return out.select("id", "state", "attempt", "finalized_at", "scheduled_at", size.alias("n_errors"), F.get_json_object("metadata", "$.snoozes").alias("snoozes"))


def _outcomes(jobs: DataFrame) -> DataFrame:
    p = F.col("priority")
    none = lambda t: F.lit(None).cast(t)
    outcome = F.when(p == 1, "completed").when(p == 2, "error").when(p == 3, "soft_stop").otherwise("snooze")
    return jobs.where("state = 'running'").select("id", outcome.alias("outcome"), F.lit("boom").alias("error"), none("string").alias("trace"), F.lit(90.0).alias("snooze_s"), none("timestamp_ntz").alias("retry_at"), none("string").alias("metadata"), F.col("attempted_at").alias("started_at"))


@query(f"SELECT CASE priority WHEN 1 THEN 'job_completed' WHEN 2 THEN 'job_failed' WHEN 3 THEN 'job_interrupted' ELSE 'job_snoozed' END AS event, count(*) AS n FROM {_from('id', 'state', 'priority')} WHERE state = 'running' GROUP BY 1")
def q_job_events(spark, d):
    """The events of the runs that :func:`q_apply_outcomes` ends, by the reasons they ended for."""
    jobs = _jobs(spark, d, *_RUN, "created_at")
    changes = machine.commands_of(jobs, _outcomes(jobs), NOW)
    events = job_events(commands.reported(commands.set_state(jobs, changes, NOW), changes))
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, state, queue FROM (SELECT DISTINCT id, state, queue, unique_key FROM job_row) WHERE unique_key IS NULL")
def q_insert_strict(spark, d):
    """A bulk load of the jobs without a unique key, as themselves: no conflict."""
    jobs = _jobs(spark, d, *_WHOLE)
    rows = jobs.where("unique_key IS NULL").withColumn("ordinal", F.col("id"))
    return commands.insert_strict(jobs.where("unique_key IS NOT NULL"), rows, NOW).select("id", "state", "queue")


def _kinds(jobs: DataFrame) -> DataFrame:
    k = F.col("kind")
    timeout = F.when(k == "index_refresh", -1.0).when(k == "ledger_post", 864_000.0).otherwise(0.0)
    return jobs.where(k != "webhook_deliver").select("kind", timeout.alias("timeout_s")).distinct()


_RAN = f"(epoch_us({NOW_SQL}) - epoch_us(attempted_at)) / 1e6"
_DECIDED = f"""SELECT *, CASE WHEN {_HAS_CANCEL} THEN 'cancel' WHEN kind = 'webhook_deliver' THEN 'discard' WHEN kind = 'index_refresh' THEN 'ignore' WHEN {_RAN} < CASE kind WHEN 'ledger_post' THEN 864000 ELSE 60 END THEN 'ignore' WHEN attempt < max_attempts THEN 'retry' ELSE 'discard' END AS decision
FROM {_from(*_RUN)} WHERE state = 'running' AND attempted_at < {HORIZON_SQL}"""
_DECISION = f"SELECT id, decision, CASE decision WHEN 'cancel' THEN 'cancelled' WHEN 'discard' THEN 'discarded' WHEN 'retry' THEN 'retryable' END AS state, CASE WHEN decision IN ('cancel', 'discard') THEN {NOW_SQL} END AS finalized_at, CASE WHEN decision = 'retry' THEN {NOW_SQL} + to_seconds({_DELAY}) ELSE scheduled_at END AS scheduled_at FROM ({_DECIDED})"


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    jobs = _jobs(spark, d, *_RUN)
    stuck = jobs.where((F.col("state") == "running") & (F.col("attempted_at") < F.lit(HORIZON).cast("timestamp_ntz")))
    return jobs, machine.rescue_decisions(stuck, _kinds(jobs), NOW)


@query(_DECISION)
def q_rescue_decision(spark, d):
    return _decided(spark, d)[1].drop("error")


@query(
    f"""SELECT j.id, r.state, r.finalized_at, r.scheduled_at, CAST(coalesce(len(j.errors), 0) + 1 AS BIGINT) AS n_errors, CAST(1 + CASE WHEN json_type(j.metadata, '$."runner:rescue_count"') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc(CAST(json_extract_string(j.metadata, '$."runner:rescue_count"') AS DOUBLE)) ELSE 0 END AS BIGINT) AS rescues
FROM {_from('id', 'errors', 'metadata')} j JOIN ({_DECISION}) r ON r.id = j.id WHERE r.decision != 'ignore'"""
)
def q_job_rescue(spark, d):
    jobs, decided = _decided(spark, d)
    out = commands.rescue(jobs, decided.where("decision != 'ignore'"))
    return out.select("id", "state", "finalized_at", "scheduled_at", F.size("errors").cast("bigint").alias("n_errors"), F.get_json_object("metadata", "$['runner:rescue_count']").cast("bigint").alias("rescues"))


# --- single jobs, here for every job of the table ----------------------------

_OPEN = "state NOT IN ('cancelled', 'completed', 'discarded') AND finalized_at IS NULL"


@query(
    f"""SELECT id, CASE WHEN {_OPEN} AND state != 'running' THEN 'cancelled' ELSE state END AS state, CASE WHEN {_OPEN} AND state != 'running' THEN {NOW_SQL} ELSE finalized_at END AS finalized_at, CASE WHEN {_OPEN} THEN '2025-04-15T00:00:00Z' ELSE json_extract_string(metadata, '$.cancel_attempted_at') END AS told
FROM {_from('id', 'state', 'finalized_at', 'metadata')}"""
)
def q_job_cancel(spark, d):
    out = commands.cancel(_jobs(spark, d, "id", "state", "finalized_at", "metadata"), NOW)
    return out.select("id", "state", "finalized_at", F.get_json_object("metadata", "$.cancel_attempted_at").alias("told"))


_SKIP = f"(state = 'running' OR (state = 'available' AND scheduled_at < {NOW_SQL}))"


@query(f"SELECT id, CASE WHEN {_SKIP} THEN state ELSE 'available' END AS state, CASE WHEN NOT {_SKIP} AND attempt = max_attempts THEN max_attempts + 1 ELSE max_attempts END AS max_attempts, CASE WHEN {_SKIP} THEN finalized_at END AS finalized_at, CASE WHEN {_SKIP} THEN scheduled_at ELSE {NOW_SQL} END AS scheduled_at FROM {_from('id', 'state', 'attempt', 'max_attempts', 'finalized_at', 'scheduled_at')}")
def q_job_retry(spark, d):
    out = commands.retry(_jobs(spark, d, "id", "state", "attempt", "max_attempts", "finalized_at", "scheduled_at"), NOW)
    return out.select("id", "state", "max_attempts", "finalized_at", "scheduled_at")


@query(f"SELECT id, state, state != 'running' AS deleted FROM {_from('id', 'state')}")
def q_job_delete(spark, d):
    return commands.deletable(_jobs(spark, d, "id", "state"))


_GONE = f"((state = 'cancelled' AND finalized_at < {NOW_SQL} - INTERVAL 24 HOUR) OR (state = 'completed' AND finalized_at < {NOW_SQL} - INTERVAL 24 HOUR) OR (state = 'discarded' AND finalized_at < {NOW_SQL} - INTERVAL 7 DAY)) AND queue NOT IN ('audit_trail')"


@query(f"SELECT id, state, queue FROM {_from('id', 'state', 'queue', 'finalized_at')} WHERE {_GONE}")
def q_job_delete_before(spark, d):
    day = datetime(2025, 4, 14)
    horizons = {"cancelled": day, "completed": day, "discarded": datetime(2025, 4, 8)}
    return commands.expired(_jobs(spark, d, "id", "state", "queue", "finalized_at"), horizons, None, excluded=["audit_trail"]).select("id", "state", "queue")


@query(f"SELECT id, kind, state FROM {_from()} WHERE kind IN ('seat_assign', 'limit_recalc', 'email_compose') AND state != 'running' ORDER BY id LIMIT 10000")
def q_job_delete_many(spark, d):
    return JobFilter().kinds("seat_assign", "limit_recalc", "email_compose").first(10_000).victims(_jobs(spark, d)).select("id", "kind", "state")


@query(f"""SELECT id, 'true' AS ok, CAST(len(json_keys(metadata)) + CASE WHEN list_contains(json_keys(metadata), 'output') THEN 0 ELSE 1 END AS BIGINT) AS n_keys FROM {_from('id', 'metadata')}""")
def q_job_update(spark, d):
    out = commands.update(_jobs(spark, d, "id", "metadata"), machine.output_update('{"ok": true}'))
    return out.select("id", F.get_json_object("metadata", "$.output.ok").alias("ok"), F.size(F.json_object_keys("metadata")).cast("bigint").alias("n_keys"))


@query(f"SELECT id, 9 AS attempt, CAST(NULL AS TIMESTAMP) AS finalized_at, 'pending' AS state FROM {_from('id', 'attempt', 'finalized_at', 'state')} WHERE state = 'cancelled'")
def q_job_update_full(spark, d):
    jobs = _jobs(spark, d, "id", "attempt", "finalized_at", "state").where("state = 'cancelled'")
    return commands.update_full(jobs, attempt=9, finalized_at=None, state="pending")


# --- queues, leader, notifications -------------------------------------------


@query(f"SELECT q.name, q.created_at, q.metadata, q.paused_at, {NOW_SQL} AS updated_at FROM job_queue q UNION ALL SELECT 'new_' || name, {NOW_SQL}, '{{\"a\":1}}', NULL, {NOW_SQL} FROM job_queue")
def q_queue_upsert(spark, d):
    queues = table(spark, d, "job_queue")
    rows = queues.select("name", F.lit('{"a":1}').alias("metadata")).unionByName(queues.select(F.concat(F.lit("new_"), "name").alias("name"), F.lit('{"a":1}').alias("metadata")))
    return commands.queue_upsert(queues, rows, NOW)


@query(f"SELECT name, updated_at FROM job_queue WHERE updated_at < {NOW_SQL} ORDER BY name LIMIT 1000")
def q_queue_delete_expired(spark, d):
    return commands.queues_expired(table(spark, d, "job_queue"), NOW).select("name", "updated_at")


@query(f"SELECT name, coalesce(paused_at, {NOW_SQL}) AS paused_at, CASE WHEN paused_at IS NULL THEN {NOW_SQL} ELSE updated_at END AS updated_at FROM job_queue")
def q_queue_pause(spark, d):
    return commands.queue_pause(table(spark, d, "job_queue"), "*", NOW).select("name", "paused_at", "updated_at")


@query(f"SELECT name, CAST(NULL AS TIMESTAMP) AS paused_at, CASE WHEN paused_at IS NOT NULL THEN {NOW_SQL} ELSE updated_at END AS updated_at FROM job_queue")
def q_queue_resume(spark, d):
    return commands.queue_resume(table(spark, d, "job_queue"), "*", NOW).select("name", "paused_at", "updated_at")


@query(f"SELECT name, '{{\"owner\":\"ops\"}}' AS metadata, {NOW_SQL} AS updated_at FROM job_queue WHERE name = 'default'")
def q_queue_update(spark, d):
    return commands.queue_update(table(spark, d, "job_queue"), "default", NOW, '{"owner":"ops"}').select("name", "metadata", "updated_at")


@query(f"SELECT 'node-01' AS leader_id, 'default' AS name, {NOW_SQL} AS elected_at, {NOW_SQL} + INTERVAL 15 SECOND AS expires_at")
def q_leader_elect(spark, d):
    first = commands.leader_elect(spark.createDataFrame([], LEADER), "node-01", 15.0, NOW)
    return commands.leader_elect(first, "node-02", 15.0, NOW)


@query(f"SELECT 'node-01' AS leader_id, 'default' AS name, {NOW_SQL} AS elected_at, {NOW_SQL} + INTERVAL 30 SECOND AS expires_at")
def q_leader_reelect(spark, d):
    first = commands.leader_elect(spark.createDataFrame([], LEADER), "node-01", 15.0, NOW)
    return commands.leader_reelect(first, "node-01", NOW, 20.0, datetime(2025, 4, 15, 0, 0, 10))


@query(f"SELECT 'node-01' AS leader_id, 'default' AS name, {NOW_SQL} - INTERVAL 1 HOUR AS elected_at, {NOW_SQL} + INTERVAL 20 SECOND AS expires_at")
def q_leader_get(spark, d):
    """An inserted term, read back."""
    return commands.leader_elected(commands.leader_insert(spark.createDataFrame([], LEADER), "node-01", NOW, ttl=20.0, elected_at=datetime(2025, 4, 14, 23)))


@query("SELECT 'job_leadership' AS topic, '{\"leader_id\":\"node-01\",\"action\":\"resigned\"}' AS payload, 0 AS left")
def q_leader_resign(spark, d):
    term = commands.leader_insert(spark.createDataFrame([], LEADER), "node-01", NOW)
    rest, notice = commands.leader_resign(term, "node-01", NOW)
    return notice.join(rest.agg(F.count(F.lit(1)).alias("left"))).select("topic", "payload", "left")  # one row each


@query("SELECT 0 AS left")
def q_leader_delete_expired(spark, d):
    term = commands.leader_insert(spark.createDataFrame([], LEADER), "node-01", NOW, expires_at=HORIZON)
    return commands.leader_without_expired(term, NOW).agg(F.count(F.lit(1)).alias("left"))


@query(f"SELECT e.line, e.version, {NOW_SQL} AS created_at FROM (SELECT 'main' AS line, unnest(range(1, 13)) AS version) e WHERE NOT EXISTS (SELECT 1 FROM job_migration m WHERE m.line = e.line AND m.version = e.version)")
def q_migration_insert(spark, d):
    return commands.migrations_insert(table(spark, d, "job_migration"), "main", [*range(1, 13)], NOW)


@query("SELECT line, version, created_at FROM job_migration WHERE NOT (line = 'main' AND version IN (2, 3))")
def q_migration_delete(spark, d):
    return commands.migrations_delete(table(spark, d, "job_migration"), "main", [2, 3])


@query("SELECT max(id) + 1 AS id, 'job_control' AS topic, '{\"action\":\"pause\",\"queue\":\"default\"}' AS payload FROM job_notification")
def q_notification_insert(spark, d):
    note = commands.queue_notice("default", "pause", spark).withColumn("ordinal", F.lit(0))
    return commands.notifications_insert(table(spark, d, "job_notification"), note, NOW).select("id", "topic", "payload")


@query(f"SELECT topic, count(*) AS n FROM (SELECT DISTINCT id, created_at, topic FROM job_notification) WHERE created_at >= {NOW_SQL} GROUP BY topic")
def q_notification_delete_before(spark, d):
    notes = distinct_rows(table(spark, d, "job_notification"), "id", "created_at", "topic")
    return commands.notifications_kept(notes, NOW).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


# --- time, logs, steps -------------------------------------------------------


@query(f"SELECT name AS id, make_timestamp(unnest(range(epoch_us(updated_at), epoch_us({NOW_SQL}) + 100000, 21600000000))) AS run_at FROM job_queue")
def q_periodic_runs(spark, d):
    spec = table(spark, d, "job_queue").select(F.col("name").alias("id"), F.col("updated_at").alias("next_run_at"), F.lit(21_600.0).alias("every_s"), F.lit(False).alias("run_on_start"))
    return machine.periodic_runs(spec, NOW)


_LOG = "json_extract(metadata, '$.\"runner:log\"')"
_LOGS = f"""WITH j AS (SELECT DISTINCT id, attempt, metadata FROM job_row WHERE metadata LIKE '%runner:log%'),
o AS (SELECT id, attempt, CASE WHEN json_type({_LOG}) = 'ARRAY' THEN list_transform(list_filter(CAST({_LOG} AS JSON[]), lambda x: json_type(x) = 'OBJECT'), lambda x: {{'attempt': CAST(json_extract(x, '$.attempt') AS BIGINT), 'log': json_extract_string(x, '$.log')}}) ELSE [] END AS old FROM j),
e AS (SELECT id, pos, (all_)[pos] AS x, len(all_) AS most FROM (SELECT id, old || [{{'attempt': CAST(attempt AS BIGINT), 'log': 'finished job ' || id}}] AS all_ FROM o), unnest(range(1, len(all_) + 1)) u(pos)),
s AS (SELECT id, pos, x, most, 1 + sum(strlen(CAST(to_json(x) AS VARCHAR)) + 1) OVER (PARTITION BY id ORDER BY pos DESC) AS upto FROM e),
k AS (SELECT id, pos, x FROM s WHERE upto <= 160 OR pos = most)
"""


def _logged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    jobs = _jobs(spark, d, "id", "attempt", "metadata").where("metadata LIKE '%runner:log%'")
    return jobs, jobs.select("id", F.col("attempt"), F.concat(F.lit("finished job "), F.col("id")).alias("log"))


@query(f"{_LOGS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INT) AS pos, x.attempt AS attempt, x.log AS log FROM k")
def q_log_cap(spark, d):
    return machine.log_entries(*_logged(spark, d), most_total=160)


@query(f"{_LOGS} SELECT k.id, count(*) AS entries, last(x.log ORDER BY pos) AS newest, any_value(len(json_keys(metadata))) AS n_keys FROM k JOIN j ON j.id = k.id GROUP BY k.id")
def q_log_append(spark, d):
    out = machine.log_append(*_logged(spark, d), most_total=160)
    log = F.from_json(F.get_json_object("metadata", "$['runner:log']"), "array<struct<attempt:bigint,log:string>>")
    return out.select("id", F.size(log).cast("bigint").alias("entries"), F.element_at(log, -1).getField("log").alias("newest"), F.size(F.json_object_keys("metadata")).cast("bigint").alias("n_keys"))


@query(f"SELECT name AS id, {NOW_SQL} AS next_run_at, {NOW_SQL} AS updated_at FROM job_queue WHERE name LIKE 't%' UNION ALL SELECT name, created_at, CASE WHEN name = 'default' THEN {NOW_SQL} ELSE updated_at END FROM job_queue WHERE name NOT LIKE 't%' AND (name = 'default' OR updated_at >= {HORIZON_SQL})")
def q_periodic_durable(spark, d):
    """Durable periodic jobs, one a queue: some planned anew, one touched, and those no one has touched dropped."""
    have = table(spark, d, "job_queue").select(F.col("name").alias("id"), F.col("created_at").alias("next_run_at"), "updated_at")
    new = have.where("id LIKE 't%'").select("id", commands.at(NOW).alias("next_run_at"))
    return machine.periodic_kept(machine.periodic_touch(machine.periodic_upsert(have, new, NOW), ["default"], NOW), HORIZON)


_STEPS = ["basil", "opal", "quartz", "juniper", "umber", "fjord"]
_DONE = "json_extract_string(metadata, '$.\"runner:resumable_step\"')"


@query(
    f"""SELECT id, CASE WHEN done IS NULL THEN 'basil' WHEN cur IS NOT NULL AND list_position(s, done) > 0 THEN done ELSE CASE WHEN list_position(s, done) > 0 THEN s[list_position(s, done) + 1] END END AS next_step
FROM (SELECT id, {_DONE} AS done, ['basil', 'opal', 'quartz', 'juniper', 'umber', 'fjord'] AS s, CASE WHEN {_DONE} IS NOT NULL THEN json_extract_string(metadata, '$."runner:resumable_cursor"."' || {_DONE} || '"') END AS cur FROM {_from('id', 'kind', 'metadata')})"""
)
def q_resumable_next_step(spark, d):
    jobs = _jobs(spark, d, "id", "kind", "metadata")
    steps = jobs.select("kind").distinct().withColumn("steps", F.array(*(F.lit(s) for s in _STEPS)))
    return machine.next_step(jobs, steps).select("id", "next_step")
