import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.llm.topn import top_n

START = datetime(2025, 1, 1)


def brute(rows, n, key):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    return sorted((r[0] for rs in by.values() for r in sorted(rs, key=key)[:n]))


def last_if_null(v, low):
    return (v is None, low if v is None else v)


@pytest.mark.parametrize(("bins", "largest"), [(4, 1), (256, 10_000), (1, 10_000)])
def test_matches_sorting(spark, bins, largest):
    r = random.Random(3)
    rows = [(i, r.choice(["hot", "hot", "warm", f"t{i % 40}", None]), r.choice([1, 2, 3, 4, None]), r.choice([None, START, START + timedelta(seconds=r.randint(0, 10**6))])) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, q string, p int, at timestamp_ntz").withColumns({"__g": F.lit(1), "__b": F.lit(2), "__row": F.lit(3), "__t": F.lit(4)})
    got = top_n(df, "q", ["p", "at", "id"], 5, bins=bins, largest=largest)
    assert got.columns == df.columns
    assert sorted(x.id for x in got.collect()) == brute(rows, 5, lambda x: (last_if_null(x[2], 0), last_if_null(x[3], START), x[0]))


def test_descending_floats_with_nan(spark):
    rows = [(1, "a", 1.0), (2, "a", float("nan")), (3, "a", float("inf")), (4, "a", -5.0), (5, "a", None), (6, "a", 2.0)]
    df = spark.createDataFrame(rows, "id long, q string, s double")
    got = top_n(df, "q", ["-s", "id"], 3, coarse=1, bins=8, rank="r").orderBy("r").collect()
    assert [x.id for x in got] == [2, 3, 6]
    assert [x.id for x in top_n(df, "q", ["s", "id"], 5, coarse=1, rank="r").orderBy("r").collect()] == [4, 1, 6, 3, 2]


def test_all_tied_and_repeats(spark):
    df = spark.range(5000).select("id", F.lit("q").alias("q"), F.lit(1).alias("p"))
    assert sorted(x.id for x in top_n(df, "q", ["p", "id"], 5).collect()) == [0, 1, 2, 3, 4]
    assert top_n(df.unionByName(df), "q", ["p", "id"], 5).count() == 5


def test_hot_groups_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("q"), F.col("id").alias("p"))
    plan = top_n(df, "q", ["p", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("WindowGroupLimit") == 2


def test_empty(spark):
    df = spark.createDataFrame([], "id long, q string, p int, at timestamp_ntz")
    assert top_n(df, "q", ["p", "at", "id"], 5).count() == 0
    with pytest.raises(ValueError):
        top_n(df, "q", ["p"], 0)


def test_every_group_has_a_threshold(spark):
    """More groups than are broadcast, null groups, a far-off value, and hot groups: all as by brute force."""
    r = random.Random(9)
    rows = [(i, r.choice([None, "hot", "hot", *(f"g{k}" for k in range(60))]), r.randint(1, 4), START + timedelta(seconds=r.randint(0, 5_000))) for i in range(6_000)]
    rows.append((9_999, "hot", 1, datetime(9999, 1, 1)))
    df = spark.createDataFrame(rows, "id long, g string, p int, at timestamp_ntz")
    want = brute(rows, 5, lambda x: (x[2], x[3], x[0]))
    for largest in (1, 7, 10_000):
        assert sorted(x.id for x in top_n(df, "g", ["p", "at", "id"], 5, largest=largest).collect()) == want
    late = sorted(rows, key=lambda x: (x[3], x[0]), reverse=True)
    assert sorted(x.id for x in top_n(df, "g", ["-at", "-id"], 5, largest=3).collect()) == brute(late, 5, lambda x: 0)


def test_thresholds_drop_rows_of_large_and_small_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 20}", i % 2, float(i)) for i in range(4_000)]
    df = spark.createDataFrame(rows, "id long, g string, p int, v double")
    out = top_n(df, "g", ["v", "id"], 2, largest=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__b") >= 2 and "LeftAnti" in plan
    assert sorted(x.id for x in out.collect()) == brute(rows, 2, lambda x: (x[3], x[0]))
