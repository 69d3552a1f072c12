import random

import pytest
from pyspark.sql import functions as F

from tarnwork.llm import percentiles as p

TARGETS = {"p1": 10, "p50": 500, "p99": 990, "p100": 1000}


def exact(values, per_mille):
    return sorted(values)[(per_mille * len(values) + 999) // 1000 - 1]


def test_matches_sorting_for_skewed_groups_and_ties(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 11}", r.choice([None, 0, 5, r.randint(-10**6, 10**12)])) for i in range(3000)] + [(None, 7), (None, 7)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: r for r in p.percentiles(p.frequencies(df, ["g"], "v"), [["g"]], "v", TARGETS).collect()}
    for g in {x[0] for x in rows}:
        vs = [v for k, v in rows if k == g and v is not None]
        assert got[g].n == len(vs) and got[g].least == min(vs) and got[g].most == max(vs)
        for name, pm in TARGETS.items():
            assert got[g][name] == exact(vs, pm)


def test_levels_and_merge(spark):
    rows = [("a", "d1", i) for i in range(50)] + [("a", "d2", i * 2) for i in range(50)] + [("a", None, 3)]
    df = spark.createDataFrame(rows, "g string, d string, v long")
    levels = [["g"], ["g", "d"]]
    whole = p.frequencies(df, ["g", "d"], "v")
    parts = p.merged(p.frequencies(df.where("d = 'd1'"), ["g", "d"], "v"), p.frequencies(df.where("d = 'd2' OR d IS NULL"), ["g", "d"], "v"))
    a, b = (sorted(map(str, p.percentiles(t, levels, "v", TARGETS).collect())) for t in (whole, parts))
    assert a == b and len(a) == 4


@pytest.mark.parametrize("error", [0.005, 0.05])
def test_rounding_keeps_its_bound_and_size(spark, error):
    r = random.Random(2)
    rows = [(int(r.choice([-1, 1]) * 10 ** r.uniform(0, 15)),) for _ in range(5000)] + [(0,), (1,), (-1,), (2**62,), (-(2**62),)]
    df = spark.createDataFrame(rows, "v long")
    out = df.select("v", p.rounded(F.col("v"), error).alias("r")).collect()
    assert all(abs(x.r - x.v) <= (error + 1e-9) * abs(x.v) + 0.5 for x in out)
    assert len({x.r for x in out}) < 2 * (43 / error + 1 / error)
    got = p.percentiles(p.frequencies(df.withColumn("g", F.lit("x")), ["g"], "v", error=error), [["g"]], "v", TARGETS).first()
    for name, pm in TARGETS.items():
        want = exact([x.v for x in out], pm)
        assert abs(got[name] - want) <= (error + 1e-9) * abs(want) + 0.5


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "seg string, gk string, v long")
    assert p.percentiles(p.frequencies(df, ["seg", "gk"], "v"), [["seg"]], "v", TARGETS).count() == 0
    df = spark.createDataFrame([("a", "b", 4, "x" * 50_000)], "seg string, gk string, v long, cum string")
    got = p.percentiles(p.frequencies(df, ["seg", "gk"], "v"), [["seg"], ["seg", "gk"]], "v", TARGETS).collect()
    assert {(r.seg, r.gk, r.p50) for r in got} == {("a", None, 4), ("a", "b", 4)}
    with pytest.raises(ValueError):
        p.rounded(F.col("v"), 0.7)


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_large_groups_are_cut_into_segments(spark, segment):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", None, *(f"g{k}" for k in range(30))]), r.choice([r.randint(0, 40), r.randint(-(10**12), 10**12)])) for _ in range(2_000)]
    df = spark.createDataFrame(rows, "g string, v long").withColumn("d", F.col("v") % 3)
    out = p.percentiles(p.frequencies(df, ["g", "d"], "v"), [["g"], []], "v", TARGETS, segment=segment)
    got = {(x.level, x.g): x for x in out.collect()}
    assert len(got) == len({g for g, _ in rows}) + 1
    for (level, g), x in got.items():
        vs = [v for k, v in rows if level or k == g]
        assert (x.n, x.least, x.most) == (len(vs), min(vs), max(vs))
        assert all(x[name] == exact(vs, pm) for name, pm in TARGETS.items())


def test_running_sums_need_no_shuffle_of_their_own(spark):
    df = spark.createDataFrame([(f"g{i % 3}", i) for i in range(300)], "g string, v long")
    plan = p.percentiles(p.frequencies(df, ["g"], "v"), [["g"]], "v", TARGETS, segment=200)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange hashpartitioning") == 1
