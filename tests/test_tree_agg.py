from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import tree_agg as t
from tarnwork.plans import problems


def count():
    return {"n": t.Measure("count", F.lit(1))}


@pytest.mark.parametrize(("chunk", "fan", "rounds"), [(1, 2, 3), (7, 4, 2), (1000, 16, 1)])
def test_any_tree_gives_the_same(spark, chunk, fan, rounds):
    rows = [(i, "hot" if i % 3 else f"k{i}", None if i % 5 == 0 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(3)
    m = count() | {"s": t.Measure("sum", F.col("v")), "lo": t.Measure("min", F.col("v")), "hi": t.Measure("max", F.col("v")), "nv": t.Measure("count", F.col("v"))}
    got = {r.k: (r.n, r.s, r.lo, r.hi, r.nv) for r in t.tree_aggregate(df, ["k"], m, chunk_rows=chunk, fan_in=fan, rounds=rounds).collect()}
    for k in {r[1] for r in rows}:
        vs = [r[2] for r in rows if r[1] == k and r[2] is not None]
        assert got[k] == (sum(r[1] == k for r in rows), sum(vs) if vs else None, min(vs, default=None), max(vs, default=None), len(vs))


def test_no_reducer_gets_all_partials(spark):
    df = spark.range(0, 10_000, 1, 40).withColumn("k", F.lit("hot").substr(F.lit(1), F.col("id") * 0 + 3))
    plan = t.tree_aggregate(df, ["k"], count(), chunk_rows=100, fan_in=4, rounds=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 4  # leaves and three rounds


def test_nulls_ties_repeats_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 1), ("x", None, 2), ("x", None, 2)], "queue string, __k0 string, __leaf int")
    got = {tuple(r) for r in t.by_fields(df, ["queue", "__k0"], count()).collect()}
    assert got == {("queue", None, 2), ("queue", "x", 2), ("__k0", "a", 2), ("__k0", None, 2)}
    assert t.by_fields(df.limit(0), ["queue"], count()).count() == 0
    assert t.frequent_values(df.limit(0), ["queue"], 0.03).count() == 0


def test_frequent_values_counts_nulls_into_the_total_only(spark):
    rows = [(None,)] * 94 + [("a",)] * 3 + [("b",)] * 2 + [("x" * 50_000,)]
    got = t.frequent_values(spark.createDataFrame(rows, "q string"), ["q"], 0.03)
    assert Counter(tuple(r) for r in got.collect()) == Counter([("q", "a")])


def test_parameters():
    assert t.rounds_for(1, 10, 4) == 1 and t.rounds_for(10**9, 1000, 16) == 5
    with pytest.raises(ValueError):
        t.tree_aggregate(None, [], {})


@pytest.mark.parametrize(("rows", "rounds"), [(0, 2), (256 * 65_536, 2), (256 * 65_536 + 1, 3), (5000 * 65_536, 4)])
def test_rounds_of_the_queries_grow_with_the_rows(rows, rounds):
    assert problems.tree_for(rows) == problems.TREE | {"rounds": rounds}
