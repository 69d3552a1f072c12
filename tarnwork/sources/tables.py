"""Reading the job-queue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwork.runtime import prepared


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of ``folder``; the session zone is pinned to UTC, in
    which the zoneless timestamps of the tables are written."""
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows counted once, over ``columns``, which must include the row's key.

    A repeated row is a copy in all columns, so the distinct of a pruned set
    of columns that holds the key drops copies only. Both sides of the shuffle
    hash-aggregate; the key is unique but for copies, so no partition is hot.
    """
    return df.select(*columns).distinct()
