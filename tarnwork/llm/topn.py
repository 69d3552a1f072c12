"""The first N rows of every group, by histogram thresholds.

A histogram of the leading order columns per group tells a bucket by which at
least N rows of the group have come; rows beyond that bucket cannot be among
the first N and are dropped. Every group has its threshold: those of the
largest groups go to the rows where they lie, before any shuffle; all others
meet their rows in the shuffle that the exact ranking needs anyway. The
survivors are ranked exactly, with the tie keys.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.runtime import staged

#: Groups, the largest ones, whose thresholds are broadcast: where most rows of hot groups are dropped early.
LARGEST = 10_000


def _number(df: DataFrame, name: str) -> Column:
    """A column as a double that orders alike (coarsely is enough for a bucket)."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.TimestampNTZType | T.TimestampType | T.DateType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def _edges(values: list[float]) -> list[float]:
    """Inner bounds of buckets as Bucketizer takes them: each once, open at both ends."""
    inner = sorted({x for x in values if abs(x) < 1e300})
    return [float("-inf"), *(inner or [0.0]), float("inf")]


def top_n(
    df: DataFrame,
    group: str,
    order: list[str],
    n: int,
    *,
    coarse: int = 2,
    bins: int = 256,
    largest: int = LARGEST,
    rank: str | None = None,
) -> DataFrame:
    """The ``n`` rows of each ``group`` that come first by ``order``.

    ``order``: column names, ascending unless written ``-name``; nulls come
    last either way. The last columns are the tie keys: give a unique one, or
    rows equal in all of them are taken in no certain order. ``coarse``: how
    many leading order columns, all numbers or times, the histogram uses, each
    in at most ``bins`` buckets (+1 for nulls and one for NaN), whose bounds
    are quantiles of all rows, so that a far-off value spoils none. A group's
    histogram has at most ``(bins + 2) ** coarse`` rows. A column behind the
    first is used if all before it are whole numbers of a range of less than
    ``bins``, each with a bucket of its own.

    A null group is a group. Groups of fewer than ``n`` rows come out whole;
    repeated rows count as often as they stand; an empty table gives an empty
    one. All columns of ``df`` come back, with the rank as ``rank`` if named.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    names = [x.lstrip("-") for x in order]
    down = [x.startswith("-") for x in order]
    lead = list(zip(names, down, strict=True))[:coarse]

    def key(k: Column) -> list[Column]:
        return [c.desc_nulls_last() if d else c.asc_nulls_last() for c, d in zip((k.getField(x) for x in names), down, strict=True)]

    whole_kind = [isinstance(df.schema[x].dataType, T.IntegralType) for x, _ in lead]
    finite = [F.when(F.abs(v := _number(df, x)) < F.lit(1.0e300), v) for x, _ in lead]
    cuts = [i / bins for i in range(1, bins)]
    facts = df.agg(*(f(v).alias(f"{p}{i}") for i, v in enumerate(finite) for p, f in (("lo", F.min), ("hi", F.max), ("q", lambda v: F.percentile_approx(v, cuts, 10 * bins))))).first()
    buckets, numbered = [], df
    for i, (x, d) in enumerate(lead):
        lo, hi = facts[f"lo{i}"], facts[f"hi{i}"]
        v = _number(df, x)
        whole = whole_kind[i] and lo is not None and hi - lo < bins
        if whole:
            at = v - F.lit(lo)
        else:
            numbered = numbered.withColumn(f"__v{i}", F.when(F.isnan(v) | v.isNull(), 0.0).otherwise(v))
            numbered = Bucketizer(splits=_edges(facts[f"q{i}"] or []), inputCol=f"__v{i}", outputCol=f"__at{i}").transform(numbered)
            at = F.col(f"__at{i}")
        # NaN is larger than any number, and null comes last.
        nan = F.lit(-1 - 2 * bins if d else 2 * bins)
        buckets.append(F.when(v.isNull(), 2 * bins + 1).when(F.isnan(v), nan).otherwise(-at if d else at).cast("int").alias(f"b{i}"))
        if not whole:  # values that share a bucket have no order, so the next column can't refine it
            break
    rows = numbered.select(F.struct(*(F.col(c) for c in df.columns)).alias("__row"), F.struct(F.col(group)).alias("__g"), F.struct(*buckets).alias("__b"))

    histogram = rows.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy("__g").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limits = (
        histogram.withColumn("__cum", F.sum("__n").over(run))
        .groupBy("__g")
        .agg(F.sum("__n").alias("__all"), F.min(F.when(F.col("__cum") >= n, F.col("__b"))).alias("__t"))
        .where(F.col("__t").isNotNull())
        .select(F.col("__g").alias("__hg"), "__t", "__all")
    )
    limits = staged(limits, "thresholds")  # a row a group
    hot = F.broadcast(limits.orderBy(F.desc("__all"), "__hg").limit(largest).select("__hg", "__t"))  # at most `largest` rows
    below = F.col("__t").isNull() | (F.col("__b") <= F.col("__t"))
    own = F.col("__g") == F.col("__hg")

    def ranked(kept: DataFrame) -> DataFrame:
        # Spark keeps only n rows a group on their way into the window (window group limit).
        return kept.withColumn("__rank", F.row_number().over(Window.partitionBy("__g").orderBy(*key(F.col("__row"))))).where(F.col("__rank") <= n)

    if limits.count() <= largest:
        best = ranked(rows.join(hot, own, "left").where(below))
    else:
        # The groups behind the largest: one shuffle by group serves the join with their thresholds and the ranking.
        rest = rows.join(hot, own, "left_anti").join(limits.select("__hg", "__t").hint("shuffle_hash"), own, "left").where(below)
        best = ranked(rows.join(hot, own).where(below)).select("__row", "__rank").unionByName(ranked(rest).select("__row", "__rank"))
    return best.select("__row.*", *([F.col("__rank").alias(rank)] if rank else []))
