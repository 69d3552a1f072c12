"""Percentiles per group from cumulative frequencies.

The values are first reduced to a frequency table (group, value, count), which
is the form that days, files and partitions are put together in: counts add
up. Percentiles come from that table: it is range-sorted by group and segment,
where a segment is all of a small group or a range of values of a large one;
each segment sums up its own counts by a window, the totals of the segments
before are added as an offset, and the first value that reaches the target
rank is picked. No task holds more than some segments.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.runtime import SMALL, staged

#: Values of a segment, about; groups of more are cut.
SEGMENT = 65_536
#: Bytes that a row of a table of groups or segments takes at most when it is broadcast, beside its group's columns.
ROW = 64


def rounded(value: Column, error: float) -> Column:
    """An integer ``value`` rounded with a relative error of at most ``error``.

    Values of up to 1/error in size stay as they are; larger ones go to the
    middle of a bucket whose ends differ by a factor (1+error)/(1-error), so a
    range of r has about ln(r)/(2 error) buckets, whatever the row count.
    """
    if not 0 < error < 0.5:
        raise ValueError("error must lie between 0 and 0.5")
    grow = math.log((1 + error) / (1 - error))
    size = F.abs(value)
    at = F.floor(F.ln(size.cast("double")) / F.lit(grow))
    middle = F.round(F.exp(at * F.lit(grow)) * F.lit(1 + error)).cast("long")
    return F.when(size <= F.lit(int(1 / error)), value).otherwise(F.signum(value).cast("long") * middle)


def frequencies(df: DataFrame, groups: list[str], value: str, *, error: float | None = None) -> DataFrame:
    """The frequency table: ``groups``, ``value``, ``n``. Rows whose value is
    null are left out. With ``error`` values are rounded first (see
    :func:`rounded`), which bounds the table's size and the error alike."""
    v = F.col(value) if error is None else rounded(F.col(value), error)
    return df.where(F.col(value).isNotNull()).select(*groups, v.alias(value)).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))


def merged(*tables: DataFrame) -> DataFrame:
    """Frequency tables of days, files or partitions put together."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first.groupBy(*(c for c in first.columns if c != "n")).agg(F.sum("n").alias("n"))


def _maybe_broadcast(df: DataFrame, columns: list[str]) -> DataFrame:
    """A (written) table with a broadcast hint if its rows, counted and measured, are few and short."""
    size = df.agg(F.sum(F.lit(ROW) + sum((F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns), F.lit(0)))).first()[0]
    return F.broadcast(df) if (size or 0) <= SMALL else df


def _segmented(rows: DataFrame, at: list[str], count: int, segment: int) -> tuple[DataFrame, bool]:
    """Rows with ``seg``: 0 in groups of up to ``segment`` values, else the
    number of a range of values, of which a group has about one per ``segment``
    values; and whether there are such groups. The ranges are made of fine ones
    between quantiles of all large groups' values, each group taking so many
    together as it needs."""
    sizes = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > segment)
    large = staged(sizes.select(*(F.col(c).alias(f"__{c}") for c in at), "__size"), "large")  # at most rows / segment
    if large.isEmpty():
        return rows.withColumn("seg", F.lit(0)), False
    same = F.lit(True)
    for c in at:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = rows.join(_maybe_broadcast(large, [f"__{c}" for c in at]), same, "left")
    fine = min(10_000, 4 * -(-count // segment))
    number = F.col("v").cast("double")
    cuts = met.where("__size IS NOT NULL").agg(F.percentile_approx(number, [i / fine for i in range(1, fine)], 10 * fine)).first()[0]
    bounds = [float("-inf"), *sorted(set(cuts)), float("inf")]
    met = Bucketizer(splits=bounds, inputCol="__v", outputCol="__bucket").transform(met.withColumn("__v", number))
    own = F.greatest(F.ceil(F.col("__size") / segment), F.lit(1))  # segments of the group
    seg = F.when(F.col("__size").isNull(), 0).otherwise(F.floor(F.col("__bucket") * own / len(bounds)))
    return met.select(*at, "v", "n", seg.cast("int").alias("seg")), True


def percentiles(freq: DataFrame, levels: list[list[str]], value: str, targets: dict[str, int], *, segment: int = SEGMENT) -> DataFrame:
    """Percentiles of a frequency table at several groupings in one pass.

    ``levels``: lists of group columns, each a subset of the columns of
    ``freq``; columns that a level lacks are null in its rows. ``targets``:
    output name -> per mille p (0 < p <= 1000). A percentile is the first
    value whose running count reaches ceil(p * N / 1000): exact on an exact
    table; on a rounded one within the rounding's relative error of the value
    of that rank. Output: all group columns, ``level`` (index), ``n``,
    ``least``, ``most`` and the targets. Null groups are groups. An empty
    table gives an empty result.
    """
    groups = list(dict.fromkeys(c for level in levels for c in level))
    kinds = dict(freq.dtypes)
    choices = [F.struct(F.lit(i).alias("level"), *((F.col(c) if c in level else F.lit(None).cast(kinds[c])).alias(f"g{j}") for j, c in enumerate(groups))) for i, level in enumerate(levels)]
    at = ["level", *(f"g{j}" for j in range(len(groups)))]
    rows = (
        freq.select(F.explode(F.array(*choices)).alias("__c"), F.col(value).alias("v"), F.col("n"))
        .groupBy(*(F.col(f"__c.{c}").alias(c) for c in at), "v")
        .agg(F.sum("n").alias("n"))
    )
    rows = staged(rows, "frequencies")
    count = rows.count()
    cut, many = _segmented(rows, at, count, segment)
    # The range-sort is by what the windows are partitioned by, so that they need no further shuffle.
    ranged = cut.repartitionByRange(max(1, -(-count // segment)), *at, "seg")
    own = Window.partitionBy(*at, "seg")
    before = own.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumns({"cum": F.sum("n").over(before), "all": F.sum("n").over(own), "least": F.min("v").over(own), "most": F.max("v").over(own)})
    if many:
        # One row per segment of a large group: at most twice the rows by the segment's size.
        totals = cut.groupBy(*at, "seg").agg(F.sum("n").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        of = Window.partitionBy(*at)
        earlier = F.coalesce(F.sum("s").over(of.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        totals = totals.select(*(F.col(c).alias(f"t{c}") for c in at), F.col("seg").alias("tseg"), earlier.alias("t_offset"), F.sum("s").over(of).alias("t_all"), F.min("lo").over(of).alias("t_least"), F.max("hi").over(of).alias("t_most"), F.count(F.lit(1)).over(of).alias("segs")).where("segs > 1").drop("segs")
        totals = _maybe_broadcast(staged(totals, "offsets"), [f"t{c}" for c in at])
        same = F.col("seg") == F.col("tseg")
        for c in at:
            same = same & F.col(c).eqNullSafe(F.col(f"t{c}"))
        placed = placed.join(totals, same, "left").withColumns({"cum": F.col("cum") + F.coalesce("t_offset", F.lit(0)), **{c: F.coalesce(f"t_{c}", c) for c in ("all", "least", "most")}})
    rank = {name: F.expr(f"(`all` * {int(p)} + 999) div 1000") for name, p in targets.items()}
    hit = {name: (F.col("cum") >= r) & (F.col("cum") - F.col("n") < r) for name, r in rank.items()}
    anyhit = None
    for h in hit.values():
        anyhit = h if anyhit is None else anyhit | h
    picked = placed.where(anyhit).groupBy(*at).agg(F.max("all").alias("n"), F.max("least").alias("least"), F.max("most").alias("most"), *(F.max(F.when(h, F.col("v"))).alias(name) for name, h in hit.items()))
    return picked.select("level", *(F.col(f"g{j}").alias(c) for j, c in enumerate(groups)), "n", "least", "most", *targets)
