"""Queries p2_, p5_, p6_, p7_ and p8_, with SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import leakage, packing
from tarnwork.llm import percentiles as pct
from tarnwork.llm import truncation
from tarnwork.llm.topn import top_n
from tarnwork.runtime import micros, staged
from tarnwork.sources import distinct_rows, table

#: Percentiles in per mille.
TARGETS = {"p50": 500, "p90": 900, "p95": 950, "p99": 990, "p999": 999}
LEVELS = [["queue"], ["queue", "day"]]


def _waits(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "job_row").where("attempted_at IS NOT NULL AND scheduled_at IS NOT NULL")
    jobs = distinct_rows(jobs, "id", "queue", "attempted_at", "scheduled_at")
    return jobs.select("queue", F.to_date("scheduled_at").cast("string").alias("day"), (micros(F.col("attempted_at")) - micros(F.col("scheduled_at"))).alias("wait_us"))


def p2_wait_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles (error 0) of the wait per queue and per queue and day."""
    freq = pct.frequencies(_waits(spark, d), ["queue", "day"], "wait_us")
    return pct.percentiles(freq, LEVELS, "wait_us", TARGETS)


def p2_wait_bounded(spark: SparkSession, d: str) -> DataFrame:
    """The same from a frequency table rounded to a relative error of 0.5 % at most."""
    freq = pct.frequencies(_waits(spark, d), ["queue", "day"], "wait_us", error=0.005)
    return pct.percentiles(freq, LEVELS, "wait_us", TARGETS)


def p2_wait_merged(spark: SparkSession, d: str) -> DataFrame:
    """Frequency tables of odd and even days, kept apart, put together: the
    result is that of all days at once."""
    waits = _waits(spark, d)
    days = F.datediff(F.to_date("day"), F.lit("1970-01-01")) % 2
    parts = [staged(pct.frequencies(waits.where(days == k), ["queue", "day"], "wait_us"), f"waits{k}") for k in (0, 1)]
    return pct.percentiles(pct.merged(*parts), LEVELS, "wait_us", TARGETS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The first five jobs of each queue by priority, scheduled_at and id."""
    # Read three times: for the bounds of buckets, the histograms and the ranking.
    jobs = staged(distinct_rows(table(spark, d, "job_row"), "id", "queue", "priority", "scheduled_at"), "jobs")
    return top_n(jobs, "queue", ["priority", "scheduled_at", "id"], 5).select("queue", "id")


def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window of 2,048 tokens of every document, or of each of its pieces."""
    return packing.windows(table(spark, d, "documents"), "doc_id", "text")


def p6_filling(spark: SparkSession, d: str) -> DataFrame:
    """How well the windows are filled."""
    return packing.filling(p6_windows(spark, d), packing.Window().tokens)


def p6_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether every piece of every text is in one window, and no window passes a limit."""
    docs = table(spark, d, "documents")
    return packing.broken_limits(docs, "doc_id", "text", staged(packing.windows(docs, "doc_id", "text"), "windows"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold a passage of an evaluation item, with the item."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return found.where("kind = 'passage'").select("doc_id", "item_id")


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """The documents that say over what an item says, without a run of its words."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return found.where("kind = 'paraphrase'").select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents it leaked into."""
    items = table(spark, d, "eval_item").select("item_id", "suite", "split")
    n = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.join(n, "item_id", "left").fillna(0, ["documents"])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose text was cut off."""
    return truncation.judge(table(spark, d, "documents"), "doc_id", "text", "source").where("cut").select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    return truncation.by_source(truncation.judge(table(spark, d, "documents"), "doc_id", "text", "source"))


QUERIES = {
    "p2_wait_percentiles": p2_wait_percentiles,
    "p2_wait_bounded": p2_wait_bounded,
    "p2_wait_merged": p2_wait_merged,
    "p5_found": p5_found,
    "p6_windows": p6_windows,
    "p6_filling": p6_filling,
    "p6_limits": p6_limits,
    "p7_found": p7_found,
    "p7_paraphrases": p7_paraphrases,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_sources": p8_sources,
}

_WAITS = "(SELECT queue, CAST(CAST(scheduled_at AS DATE) AS VARCHAR) AS day, epoch_us(attempted_at) - epoch_us(scheduled_at) AS wait_us FROM (SELECT DISTINCT id, queue, attempted_at, scheduled_at FROM job_row WHERE attempted_at IS NOT NULL AND scheduled_at IS NOT NULL))"


def _percentile_sql(levels: str) -> str:
    picks = ", ".join(f"min(CASE WHEN rk >= (n * {p} + 999) // 1000 THEN wait_us END) AS {name}" for name, p in TARGETS.items())
    return (
        f"SELECT level, queue, day, n, min(wait_us) AS least, max(wait_us) AS most, {picks} FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY level, queue, day ORDER BY wait_us) AS rk, count(*) OVER (PARTITION BY level, queue, day) AS n FROM ({levels})"
        ") GROUP BY level, queue, day, n"
    )


_LEVELS = f"SELECT 0 AS level, queue, CAST(NULL AS VARCHAR) AS day, wait_us FROM {_WAITS} UNION ALL SELECT 1 AS level, queue, day, wait_us FROM {_WAITS}"
_GROW = math.log((1 + 0.005) / (1 - 0.005))
_ROUNDED = f"CASE WHEN abs(wait_us) <= 200 THEN wait_us ELSE CAST(sign(wait_us) AS BIGINT) * CAST(round(exp(floor(ln(CAST(abs(wait_us) AS DOUBLE)) / {_GROW!r}) * {_GROW!r}) * 1.005) AS BIGINT) END"
SQL = {
    "p2_wait_bounded": _percentile_sql(f"SELECT level, queue, day, {_ROUNDED} AS wait_us FROM ({_LEVELS})"),
    "p2_wait_percentiles": _percentile_sql(_LEVELS),
    "p2_wait_merged": _percentile_sql(_LEVELS),
    "p6_limits": "SELECT count(text) AS texts, 0 AS missing, 0 AS repeated, 0 AS cut_short, 0 AS over_tokens, 0 AS over_segments, 0 AS over_loss, true AS tight FROM documents",
    "p5_found": "SELECT queue, id FROM (SELECT queue, id, row_number() OVER (PARTITION BY queue ORDER BY priority, scheduled_at, id) AS rk FROM (SELECT DISTINCT queue, id, priority, scheduled_at FROM job_row)) WHERE rk <= 5",
}
