"""Aggregation by keys of which a few hold most rows: a tree of merges.

Rows are cut into chunks of a fixed number of rows where they lie; each chunk
is combined on its own, and the states of up to ``fan_in`` chunks are merged
per round, until one state per key is left. The shuffle key of every round
holds the chunk's number, so that the partial states of a hot key spread over
many reducers and none ever gets them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a state is made from rows, and how two states become one.
_KINDS = {
    "count": (lambda c: F.count(c), F.sum),
    "sum": (lambda c: F.sum(c), F.sum),
    "min": (lambda c: F.min(c), F.min),
    "max": (lambda c: F.max(c), F.max),
}


@dataclass(frozen=True)
class Measure:
    """``kind`` is count, sum, min or max; ``value`` what goes in (count: rows where it isn't null)."""

    kind: str
    value: Column


def rounds_for(rows: int, chunk_rows: int, fan_in: int) -> int:
    """Merge rounds that bring the chunks of ``rows`` rows down to one."""
    chunks, rounds = max(1, -(-rows // chunk_rows)), 1
    while fan_in**rounds < chunks:
        rounds += 1
    return rounds


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, Measure],
    *,
    chunk_rows: int = 65_536,
    fan_in: int = 16,
    rounds: int = 2,
) -> DataFrame:
    """One row per distinct ``keys`` with the ``measures``, by a tree of merges.

    ``rounds``: merge rounds; leaves of the tree number ``fan_in ** rounds``,
    and chunks beyond that many share leaves evenly (:func:`rounds_for` gives
    the number for a row count). Any grouping of rows into chunks gives the
    same result, as all measures are associative and commutative, so a task
    that is run again may number its chunks otherwise.

    Null keys form a key of their own; nulls in a measure are ignored, and a
    measure of nulls only is null (count: 0). Repeated rows count as often as
    they stand. An empty table gives an empty result. Columns of ``df`` that
    are neither keys nor measured are not read, whatever their names.
    """
    if not keys or not measures:
        raise ValueError("tree_aggregate needs keys and measures")
    if fan_in < 2 or rounds < 1 or chunk_rows < 1:
        raise ValueError("fan_in must be 2 or more, rounds and chunk_rows 1 or more")
    k = [f"__k{i}" for i in range(len(keys))]
    m = [f"__m{i}" for i in range(len(measures))]
    place = F.monotonically_increasing_id()
    chunk = F.xxhash64(F.shiftright(place, 33), F.floor(place.bitwiseAND((1 << 33) - 1) / chunk_rows))
    rows = df.select(
        *(F.col(x).alias(y) for x, y in zip(keys, k, strict=True)),
        *(x.value.alias(y) for x, y in zip(measures.values(), m, strict=True)),
        F.pmod(chunk, F.lit(fan_in**rounds)).alias("__leaf"),
    )
    kinds = [x.kind for x in measures.values()]
    state = rows.groupBy(*k, "__leaf").agg(*(_KINDS[t][0](F.col(c)).alias(c) for t, c in zip(kinds, m, strict=True)))
    for _ in range(rounds):
        state = (
            state.withColumn("__leaf", F.floor(F.col("__leaf") / fan_in))
            .groupBy(*k, "__leaf")
            .agg(*(_KINDS[t][1](F.col(c)).alias(c) for t, c in zip(kinds, m, strict=True)))
        )
    return state.select(*(F.col(y).alias(x) for x, y in zip(keys, k, strict=True)), *(F.col(y).alias(x) for x, y in zip(measures, m, strict=True)))


def by_fields(df: DataFrame, fields: list[str], measures: dict[str, Measure], **tree) -> DataFrame:
    """:func:`tree_aggregate` per value of each of ``fields`` in one pass over
    the rows: columns ``field``, ``value`` (as string) and the measures."""
    m = {f"__v{i}": x for i, x in enumerate(measures.values())}
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    rows = df.select(pairs.alias("__p"), *(x.value.alias(c) for c, x in m.items())).select("__p.field", "__p.value", *m)
    done = tree_aggregate(rows, ["field", "value"], {n: Measure(x.kind, F.col(c)) for (n, x), c in zip(measures.items(), m, strict=True)}, **tree)
    return done


def frequent_values(df: DataFrame, fields: list[str], share: float, **tree) -> DataFrame:
    """(field, value) of the values that hold at least ``share`` of all rows.

    A null is no value but its row counts into the total. ``share`` is
    compared exactly, as a whole number of hundred-thousandths of rows.
    """
    counts = by_fields(df, fields, {"n": Measure("count", F.lit(1))}, **tree)
    total = counts.groupBy("field").agg(F.sum("n").alias("__total"))  # one row per field: at most len(fields)
    parts = round(share * 100_000)
    return (
        counts.join(F.broadcast(total), "field")
        .where(F.col("value").isNotNull() & (F.col("n") * 100_000 >= F.col("__total") * parts))
        .select("field", "value")
    )
