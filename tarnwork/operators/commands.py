"""Changes of the job tables as functions: table and command in, rows out.

Every function returns the rows as they are after the change (or, for deletes,
the rows taken out); :func:`applied` and :func:`without` make the new table.
``now`` is always given. A store with a single writer applies them in turn.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import append, append_capped, in_mask, json_has_key, json_merge, plus_seconds
from tarnwork.model import CANCEL_KEY, CONFLICT_KEY, FINAL, JOB, RESCUE_KEY, TOPICS


def at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def applied(table: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """The table with the changed rows in place of the old ones, new ones added."""
    rows = changed.select(*table.columns)
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows)


def without(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti").select(*table.columns)


# --- the given jobs, each on its own -----------------------------------------------------


def cancel(jobs: DataFrame, now: datetime) -> DataFrame:
    """Cancels the given jobs: at once if it isn't running, by a mark its worker and the
    rescuer heed if it is; final ones stay as they are."""
    todo = ~F.col("state").isin(FINAL) & F.col("finalized_at").isNull()
    ends = todo & (F.col("state") != "running")
    mark = F.to_json(F.struct(F.date_format(at(now), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(CANCEL_KEY)))
    return jobs.withColumns({"metadata": F.when(todo, json_merge(F.col("metadata"), mark)).otherwise(F.col("metadata")), "finalized_at": F.when(ends, at(now)).otherwise(F.col("finalized_at")), "state": F.when(ends, "cancelled").otherwise(F.col("state"))})


def cancel_notice(jobs: DataFrame) -> DataFrame:
    """The control notification that goes with :func:`cancel`; none for a final job."""
    job = jobs.where(~F.col("state").isin(FINAL) & F.col("finalized_at").isNull())
    return job.select(F.to_json(F.struct(F.lit("cancel").alias("action"), F.col("id").alias("job_id"), "queue")).alias("payload"), F.lit(TOPICS["control"]).alias("topic"))


def retry(jobs: DataFrame, now: datetime) -> DataFrame:
    """Makes the given jobs available now, with one more attempt if it has used all; a
    running one, or one already available from before, stays as it is."""
    skip = (F.col("state") == "running") | ((F.col("state") == "available") & (F.col("scheduled_at") < at(now)))
    more = F.when(F.col("attempt") == F.col("max_attempts"), F.col("max_attempts") + 1).otherwise(F.col("max_attempts"))
    keep = lambda c, v: F.when(skip, F.col(c)).otherwise(v)
    return jobs.withColumns({"max_attempts": keep("max_attempts", more), "finalized_at": keep("finalized_at", F.lit(None)), "scheduled_at": keep("scheduled_at", at(now)), "state": keep("state", F.lit("available"))})


def deletable(jobs: DataFrame) -> DataFrame:
    """The given jobs with ``deleted``: false for a running one, which stays."""
    return jobs.withColumn("deleted", F.col("state") != "running")


def update(jobs: DataFrame, metadata: str | None = None) -> DataFrame:
    """Merges an object into the metadata of the given jobs."""
    return jobs if metadata is None else jobs.withColumn("metadata", json_merge(F.col("metadata"), F.lit(metadata)))


def update_full(jobs: DataFrame, **values) -> DataFrame:
    """Sets columns of the given jobs (Columns or plain values), None included."""
    allowed = {"attempt", "attempted_at", "attempted_by", "errors", "finalized_at", "max_attempts", "metadata", "state"}
    if unknown := set(values) - allowed:
        raise ValueError(f"can't be set: {sorted(unknown)}")
    kinds = dict(jobs.dtypes)
    return jobs.withColumns({c: (v if isinstance(v, Column) else F.lit(v)).cast(kinds[c]) for c, v in values.items()})


# --- jobs, many at a time ----------------------------------------------------


def fetch(jobs: DataFrame, queue: str, most: int, now: datetime, worker: str, most_workers: int = 100) -> DataFrame:
    """Takes up to ``most`` due jobs of a queue, first by priority, time and id,
    and sets them running for ``worker``; the last ``most_workers`` are kept."""
    due = (F.col("state") == "available") & (F.col("queue") == queue) & (F.col("scheduled_at") <= at(now))
    taken = jobs.where(due).orderBy("priority", "scheduled_at", "id").limit(most)
    return taken.withColumns({"state": F.lit("running"), "attempt": F.col("attempt") + 1, "attempted_at": at(now), "attempted_by": append_capped(F.col("attempted_by"), F.lit(worker), most_workers)})


def fetch_all(jobs: DataFrame, room: DataFrame, now: datetime, worker: str, most_workers: int = 100) -> DataFrame:
    """:func:`fetch` for all queues at once: ``room`` is (queue, most). A queue's
    window keeps no more rows than the largest ``most`` on its way to one task."""
    largest = room.agg(F.max("most")).first()[0] or 0
    due = jobs.where((F.col("state") == "available") & (F.col("scheduled_at") <= at(now)))
    first = Window.partitionBy("queue").orderBy("priority", "scheduled_at", "id")
    ranked = due.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= int(largest))
    taken = ranked.join(room, "queue").where(F.col("__rank") <= F.col("most")).select(*jobs.columns)
    return taken.withColumns({"state": F.lit("running"), "attempt": F.col("attempt") + 1, "attempted_at": at(now), "attempted_by": append_capped(F.col("attempted_by"), F.lit(worker), most_workers)})


def schedule(jobs: DataFrame, now: datetime, most: int | None = 10_000) -> DataFrame:
    """Makes due jobs available, in order of priority, time and id. Of those
    with a unique key that an active job holds, or that come later in the batch
    than another with that key, the state becomes discarded; ``conflict`` tells.
    ``most`` bounds the batch; None takes all due jobs, with no global sort."""
    cols = jobs.columns
    due = jobs.where(F.col("state").isin("retryable", "scheduled") & F.col("queue").isNotNull() & (F.col("priority") >= 0) & (F.col("scheduled_at") <= at(now)))
    batch = due if most is None else due.orderBy("priority", "scheduled_at", "id").limit(most)
    # Most jobs have no key: they take no part in the windows, where they would meet in one task.
    free = batch.where("unique_key IS NULL").withColumn("conflict", F.lit(False))
    batch = batch.where("unique_key IS NOT NULL")
    keyed = F.col("unique_key").isNotNull() & F.col("unique_states").isNotNull()
    rank = F.when(keyed, F.row_number().over(Window.partitionBy("unique_key").orderBy("priority", "scheduled_at", "id")))
    ranked = batch.withColumn("__rank", rank)
    holders = jobs.where(keyed & in_mask(F.col("unique_states"), F.col("state"))).select(F.col("unique_key").alias("__key"), F.col("id").alias("__holder"))
    # One row per key: how many hold it, and one of them, so that a job's own hold is told apart.
    held = holders.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min("__holder").alias("__holder"))
    met = ranked.join(held, ranked["unique_key"] == held["__key"], "left")
    other = F.coalesce((F.col("__n") > 1) | (F.col("__holder") != F.col("id")), F.lit(False))
    # A key is in conflict for all of the batch's jobs if any of them sees another holder.
    blocked = F.max(other).over(Window.partitionBy("unique_key"))
    bound = met.withColumn("conflict", F.col("__rank").isNotNull() & (blocked | (F.col("__rank") > 1)))
    judged = free.unionByName(bound.select(*cols, "conflict"))
    note = F.lit(f'{{"{CONFLICT_KEY}":"scheduler_discarded"}}')
    out = judged.withColumns({"state": F.when(F.col("conflict"), "discarded").otherwise("available"), "finalized_at": F.when(F.col("conflict"), at(now)).otherwise(F.col("finalized_at")), "metadata": F.when(F.col("conflict"), json_merge(F.col("metadata"), note)).otherwise(F.col("metadata"))})
    return out.select(*cols, "conflict")


#: Why a run ended the way it did.
REASONS = ("cancelled", "completed", "failed", "interrupted", "snoozed")
#: Columns of a batch of state changes; a null in an optional one leaves the job's value.
#: A column ``reason`` (one of :data:`REASONS`) may say what brought it about, as the state alone doesn't.
SET_STATE = "id bigint, state string, attempt int, error struct<at:timestamp_ntz,attempt:int,error:string,trace:string>, finalized_at timestamp_ntz, metadata string, scheduled_at timestamp_ntz"


def _by_id(df: DataFrame, ordered: bool) -> DataFrame:
    return df.orderBy("id") if ordered else df


def set_state(jobs: DataFrame, batch: DataFrame, now: datetime, *, ordered: bool = False) -> DataFrame:
    """Ends the run of many jobs (columns of :data:`SET_STATE`).

    Only running jobs change state. One that is to be retried or scheduled but
    was told to cancel is cancelled now, keeping its attempt and time. Errors
    are appended in either case; metadata is merged even if the job isn't
    running. Unknown ids are passed over; unchanged jobs come back as well.
    They come by id if ``ordered`` is asked for, which costs a sort.
    """
    b = batch.select(*(F.col(c).alias(f"__{c}") for c in ("id", "state", "attempt", "error", "finalized_at", "metadata", "scheduled_at")))
    met = jobs.join(b, jobs["id"] == b["__id"])
    running = F.col("state") == "running"
    cancels = running & F.col("__state").isin("retryable", "scheduled") & json_has_key(F.col("metadata"), CANCEL_KEY)
    moves = running & ~cancels
    take = lambda c, when: F.when(when & F.col(f"__{c}").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c))
    new = {
        "attempt": take("attempt", moves),
        "errors": F.when(running & F.col("__error").isNotNull(), append(F.col("errors"), F.col("__error"))).otherwise(F.col("errors")),
        "finalized_at": F.when(cancels, at(now)).otherwise(take("finalized_at", running)),
        "metadata": F.when(F.col("__metadata").isNotNull(), json_merge(F.col("metadata"), F.col("__metadata"))).otherwise(F.col("metadata")),
        "scheduled_at": take("scheduled_at", moves),
        "state": F.when(cancels, "cancelled").when(running, F.col("__state")).otherwise(F.col("state")),
    }
    return _by_id(met.select(*(new[c].alias(c) if c in new else F.col(c) for c in jobs.columns)), ordered)


def reported(changed: DataFrame, batch: DataFrame) -> DataFrame:
    """The jobs of :func:`set_state` with the ``reason`` of their change."""
    return changed.join(batch.select("id", "reason"), "id")


def last_per_job(commands: DataFrame, order: str) -> DataFrame:
    """The latest of several commands for a job, by the column ``order``."""
    rows = F.struct(*(F.col(c) for c in commands.columns))
    return commands.groupBy("id").agg(F.max_by(rows, order).alias("r")).select("r.*")


def rescue(jobs: DataFrame, batch: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Rescued jobs: ``batch`` is (id, error, finalized_at, scheduled_at, state).
    The error is appended, and the count of rescues in the metadata grows by
    one (from nought if it is no number). By id if ``ordered``."""
    b = batch.select("id", *(F.col(c).alias(f"__{c}") for c in ("error", "finalized_at", "scheduled_at", "state")))
    count = F.try_variant_get(F.try_parse_json("metadata"), f"$['{RESCUE_KEY}']", "variant")
    number = F.schema_of_variant(count).rlike("^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL)")
    n = F.when(number, count.try_cast("double").cast("long")).otherwise(F.lit(0))
    merged = json_merge(F.col("metadata"), F.to_json(F.struct((F.coalesce(n, F.lit(0)) + 1).alias(RESCUE_KEY))))
    new = {"errors": append(F.col("errors"), F.col("__error")), "metadata": merged} | {c: F.col(f"__{c}") for c in ("finalized_at", "scheduled_at", "state")}
    return _by_id(jobs.join(b, "id").select(*(new[c].alias(c) if c in new else F.col(c) for c in jobs.columns)), ordered)


def expired(jobs: DataFrame, horizons: dict[str, datetime], most: int | None = 10_000, *, excluded: list[str] | None = None, included: list[str] | None = None) -> DataFrame:
    """Final jobs that ended before the horizon of their state (a state without
    one is kept), by id, at most ``most``; None takes them all, in no order."""
    old = F.lit(False)
    for state, h in horizons.items():
        if state not in FINAL:
            raise ValueError(f"{state} is no final state")
        old = old | ((F.col("state") == state) & (F.col("finalized_at") < at(h)))
    out = jobs.where(old)
    if excluded is not None:
        out = out.where(~F.col("queue").isin(*excluded) if excluded else F.lit(True))
    if included is not None:
        out = out.where(F.col("queue").isin(*included) if included else F.lit(False))
    return out if most is None else out.orderBy("id").limit(most)


# --- inserts -----------------------------------------------------------------


def normalised(rows: DataFrame, now: datetime) -> DataFrame:
    """Rows to insert with defaults in place of nulls; an empty key or mask is none."""
    given = set(rows.columns)
    default = {"args": "{}", "metadata": "{}", "attempt": 0, "max_attempts": 25, "priority": 1, "queue": "default", "state": "available"}
    out = {}
    for f in JOB.fields:
        c = F.col(f.name) if f.name in given else F.lit(None)
        c = c.cast(f.dataType)
        if f.name in default:
            c = F.coalesce(c, F.lit(default[f.name]).cast(f.dataType))
        elif f.name in ("created_at", "scheduled_at"):
            c = F.coalesce(c, at(now))
        elif f.name == "tags":
            c = F.coalesce(c, F.array().cast("array<string>"))
        elif f.name == "unique_key":
            c = F.when(F.length(c) > 0, c)
        elif f.name == "unique_states":
            c = F.when(c != 0, c)
        out[f.name] = c
    return rows.select(*(c.alias(n) for n, c in out.items()), *([F.col("ordinal")] if "ordinal" in given else []))


def insert(jobs: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """Inserts rows (with ``ordinal``, their order in the batch) unless an
    active job has their unique key. Every row comes back: the new job, or the
    one that holds the key with ``duplicate`` set; within the batch the first
    holds it. Ids not given are the highest id plus the ordinal plus one.
    """
    new = normalised(rows, now)
    top = jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))  # one row
    new = new.join(F.broadcast(top)).withColumn("id", F.coalesce("id", F.col("__top") + F.col("ordinal") + 1)).drop("__top")
    bound = F.col("unique_key").isNotNull() & F.coalesce(in_mask(F.col("unique_states"), F.col("state")), F.lit(False))
    holders = jobs.where(bound).select(F.col("unique_key").alias("__key"), F.col("id").alias("__holder"))
    whole = F.struct(*JOB.fieldNames())
    free = new.where(~bound).select(whole.alias("__row"), "ordinal", F.lit(False).alias("duplicate"))
    first = Window.partitionBy("unique_key").orderBy("ordinal")
    # The batch's own rows of a key: all but the first report the first.
    ranked = new.where(bound).select("unique_key", "ordinal", whole.alias("__row"), F.row_number().over(first).alias("__rank"), F.first(whole).over(first).alias("__first"))
    # Holders are found by key and id; only those that are met come back whole.
    met = ranked.join(holders, ranked["unique_key"] == holders["__key"], "left")
    fresh = met.where("__holder IS NULL").select(F.when(F.col("__rank") > 1, F.col("__first")).otherwise(F.col("__row")).alias("__row"), "ordinal", (F.col("__rank") > 1).alias("duplicate"))
    there = met.where("__holder IS NOT NULL").select("ordinal", "__holder").join(jobs.select(whole.alias("__row"), F.col("id").alias("__holder")), "__holder")
    return free.unionByName(fresh).unionByName(there.select("__row", "ordinal", F.lit(True).alias("duplicate"))).select("ordinal", "__row.*", "duplicate")


def insert_strict(jobs: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """The new jobs of a bulk load in which a conflict of keys is an error: if
    any row's key is held, by a job or an earlier row, using the result fails."""
    result = insert(jobs, rows, now)
    # Both sides of the join are named, so that it isn't raised for jobs no row meets.
    refused = F.raise_error(F.concat(F.lit("the unique key of row "), F.col("ordinal").cast("string"), F.lit(" is held by job "), F.col("id").cast("string")))
    return inserted_rows(result.withColumn("duplicate", F.when(F.col("duplicate"), refused.cast("boolean")).otherwise(F.lit(False))))


def inserted_rows(result: DataFrame) -> DataFrame:
    """The new jobs of :func:`insert`."""
    return result.where(~F.col("duplicate")).drop("ordinal", "duplicate")


def insert_full(rows: DataFrame, now: datetime) -> DataFrame:
    """Rows with every column explicit, no uniqueness: a state that has been
    worked gets its attempted_at from ``now`` if it has none."""
    out = normalised(rows, now)
    worked = F.col("state").isin("completed", "discarded", "retryable", "running")
    return out.withColumn("attempted_at", F.when(worked, F.coalesce("attempted_at", at(now))).otherwise(F.col("attempted_at")))


def insert_notices(result: DataFrame) -> DataFrame:
    """One notification per queue that got an available job."""
    queues = inserted_rows(result).where(F.col("state") == "available").select("queue").distinct()
    return queues.select(F.to_json(F.struct("queue")).alias("payload"), F.lit(TOPICS["insert"]).alias("topic"))


# --- queues, leader, migrations, notifications -------------------------------


def queue_upsert(queues: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """Creates queues (name, metadata), or only sets updated_at of those there are."""
    new = rows.select("name", F.col("metadata").alias("__metadata")).dropDuplicates(["name"])
    met = new.join(queues, "name", "left")
    return met.select("name", F.coalesce("created_at", at(now)).alias("created_at"), F.when(F.col("created_at").isNotNull(), F.col("metadata")).otherwise(F.coalesce("__metadata", F.lit("{}"))).alias("metadata"), "paused_at", at(now).alias("updated_at"))


def queues_expired(queues: DataFrame, horizon: datetime, most: int = 1000) -> DataFrame:
    return queues.where(F.col("updated_at") < at(horizon)).orderBy("name").limit(most)


def _named(queues: DataFrame, name: str) -> DataFrame:
    return queues if name == "*" else queues.where(F.col("name") == name)


def queue_pause(queues: DataFrame, name: str, now: datetime) -> DataFrame:
    """Pauses a queue, or all by ``*``; one that is paused keeps its times."""
    fresh = F.col("paused_at").isNull()
    return _named(queues, name).withColumns({"updated_at": F.when(fresh, at(now)).otherwise(F.col("updated_at")), "paused_at": F.coalesce("paused_at", at(now))})


def queue_resume(queues: DataFrame, name: str, now: datetime) -> DataFrame:
    """Resumes a queue, or all by ``*``; one that isn't paused keeps its times."""
    return _named(queues, name).withColumns({"updated_at": F.when(F.col("paused_at").isNotNull(), at(now)).otherwise(F.col("updated_at")), "paused_at": F.lit(None).cast("timestamp_ntz")})


def queue_update(queues: DataFrame, name: str, now: datetime, metadata: str | None = None) -> DataFrame:
    row = queues.where(F.col("name") == name).withColumn("updated_at", at(now))
    return row if metadata is None else row.withColumn("metadata", F.lit(metadata))


def queue_notice(name: str, action: str, spark) -> DataFrame:
    """The control notification of a pause, resume or metadata change."""
    row = spark.range(1).select(F.to_json(F.struct(F.lit(action).alias("action"), F.lit(name).alias("queue"))).alias("payload"), F.lit(TOPICS["control"]).alias("topic"))
    return row


def leader_elect(leader: DataFrame, who: str, ttl: float, now: datetime) -> DataFrame:
    """The leader table after ``who`` stood for election: unchanged if there is one."""
    own = leader.sparkSession.range(1).select(at(now).alias("elected_at"), plus_seconds(at(now), F.lit(float(ttl))).alias("expires_at"), F.lit(who).alias("leader_id"), F.lit("default").alias("name"))
    # At most one row on either side.
    return leader.unionByName(own.join(leader.select("name"), "name", "left_anti").select(*leader.columns))


def leader_reelect(leader: DataFrame, who: str, elected_at: datetime, ttl: float, now: datetime) -> DataFrame:
    """The row with its term prolonged; empty if the term was lost or has run out."""
    mine = (F.col("elected_at") == at(elected_at)) & (F.col("expires_at") >= at(now)) & (F.col("leader_id") == who)
    return leader.where(mine).withColumn("expires_at", plus_seconds(at(now), F.lit(float(ttl))))


def leader_insert(leader: DataFrame, who: str, now: datetime, *, ttl: float = 15.0, elected_at: datetime | None = None, expires_at: datetime | None = None) -> DataFrame:
    """The row of a new term with explicit times where given; there must be no other term."""
    end = at(expires_at) if expires_at else plus_seconds(at(now), F.lit(float(ttl)))
    own = leader.sparkSession.range(1).select(at(elected_at or now).alias("elected_at"), end.alias("expires_at"), F.lit(who).alias("leader_id"), F.lit("default").alias("name"))
    there = leader.select("name", F.col("leader_id").alias("__there"))
    refused = F.raise_error(F.concat(F.lit("there is a term already, of "), F.col("__there"))).cast("string")
    return own.join(there, "name", "left").withColumn("leader_id", F.when(F.col("__there").isNotNull(), refused).otherwise(F.col("leader_id"))).select(*leader.columns)


def leader_without_expired(leader: DataFrame, now: datetime) -> DataFrame:
    return leader.where(F.col("expires_at") >= at(now))


def leader_resign(leader: DataFrame, who: str, elected_at: datetime) -> tuple[DataFrame, DataFrame]:
    """The table without one's own term, and the notification of it."""
    mine = (F.col("elected_at") == at(elected_at)) & (F.col("leader_id") == who)
    notice = leader.where(mine).select(F.to_json(F.struct("leader_id", F.lit("resigned").alias("action"))).alias("payload"), F.lit(TOPICS["leadership"]).alias("topic"))
    return leader.where(~mine), notice


def leader_elected(leader: DataFrame) -> DataFrame:
    """The current term, expired or not; no row if there is none."""
    return leader.where("name = 'default'")


def migrations_insert(migrations: DataFrame, line: str, versions: list[int], now: datetime) -> DataFrame:
    new = migrations.sparkSession.createDataFrame([(line, v) for v in versions], "line string, version bigint").withColumn("created_at", at(now))
    return new.join(migrations.select("line", "version"), ["line", "version"], "left_anti").select(*migrations.columns)


def migrations_delete(migrations: DataFrame, line: str, versions: list[int]) -> DataFrame:
    return migrations.where(~((F.col("line") == line) & F.col("version").isin(*versions)))


def notifications_insert(notes: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """Rows (ordinal, payload, topic) for the outbox, with ids behind its last."""
    top = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))  # one row
    return rows.join(F.broadcast(top)).select((F.col("__top") + F.col("ordinal") + 1).alias("id"), at(now).alias("created_at"), "payload", "topic")


def notifications_kept(notes: DataFrame, horizon: datetime) -> DataFrame:
    return notes.where(F.col("created_at") >= at(horizon))
