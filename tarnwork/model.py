"""The data model: tables, states, the uniqueness mask and table invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Job states, in the order of their bits in unique_states (least bit first).
STATES = ["available", "cancelled", "completed", "discarded", "pending", "retryable", "running", "scheduled"]
FINAL = ["cancelled", "completed", "discarded"]
#: States in which a key is held unless the job says otherwise (mask 245).
DEFAULT_UNIQUE = ["available", "completed", "pending", "retryable", "running", "scheduled"]
#: States that a set of unique states must have.
REQUIRED_UNIQUE = ["available", "pending", "running", "scheduled"]

# Well-known keys of a job's metadata.
CANCEL_KEY, RESCUE_KEY, CONFLICT_KEY = "cancel_attempted_at", "runner:rescue_count", "unique_key_conflict"
SNOOZE_KEY, OUTPUT_KEY, LOG_KEY = "snoozes", "output", "runner:log"
STEP_KEY, CURSOR_KEY, PERIODIC_KEY = "runner:resumable_step", "runner:resumable_cursor", "runner:periodic_job_id"
RESERVED_PREFIX = "runner:"

# Notification topics.
TOPICS = {"control": "job_control", "insert": "job_insert", "leadership": "job_leadership"}

_TS = T.TimestampNTZType()
ERROR = T.StructType([T.StructField("at", _TS), T.StructField("attempt", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("trace", T.StringType())])
JOB = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("args", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("attempted_at", _TS),
        T.StructField("attempted_by", T.ArrayType(T.StringType())),
        T.StructField("created_at", _TS),
        T.StructField("errors", T.ArrayType(ERROR)),
        T.StructField("finalized_at", _TS),
        T.StructField("kind", T.StringType()),
        T.StructField("max_attempts", T.IntegerType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("queue", T.StringType()),
        T.StructField("scheduled_at", _TS),
        T.StructField("state", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("unique_key", T.BinaryType()),
        T.StructField("unique_states", T.IntegerType()),
    ]
)
QUEUE = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("created_at", _TS), T.StructField("metadata", T.StringType()), T.StructField("paused_at", _TS), T.StructField("updated_at", _TS)])
LEADER = T.StructType([T.StructField("elected_at", _TS), T.StructField("expires_at", _TS), T.StructField("leader_id", T.StringType()), T.StructField("name", T.StringType())])
MIGRATION = T.StructType([T.StructField("line", T.StringType()), T.StructField("version", T.LongType()), T.StructField("created_at", _TS)])
NOTIFICATION = T.StructType([T.StructField("id", T.LongType()), T.StructField("created_at", _TS), T.StructField("payload", T.StringType()), T.StructField("topic", T.StringType())])
TABLES = {"job_row": JOB, "job_queue": QUEUE, "job_leader": LEADER, "job_migration": MIGRATION, "job_notification": NOTIFICATION}

#: Versions each line of migrations should have.
MIGRATIONS = {"main": [1, 2, 3, 4, 5, 6, 7]}


def mask_of(states: list[str]) -> int:
    """The bit mask of a set of states."""
    return sum(1 << STATES.index(s) for s in set(states))


def states_of(mask: int) -> list[str]:
    return [s for i, s in enumerate(STATES) if mask >> i & 1]


def broken_rules(df: DataFrame) -> DataFrame:
    """(id, rule) of every row of a job table that breaks a rule of the table."""
    final = F.col("state").isin(FINAL)
    rules: dict[str, Column] = {
        "finalized_or_finalized_at_null": final != F.col("finalized_at").isNotNull(),
        "priority_in_range": ~F.col("priority").between(1, 4),
        "queue_length": ~F.length("queue").between(1, 127),
        "kind_length": ~F.length("kind").between(1, 127),
        "max_attempts_is_positive": F.col("max_attempts") <= 0,
        "state_known": ~F.col("state").isin(STATES),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select("id", F.explode(broken).alias("rule"))
