from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import json_contains
from tarnwork.operators import reads
from tarnwork.operators.listing import Cursor, JobFilter

T0 = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def jobs(spark):
    states = ["available", "completed", "running", "cancelled"]
    rows = [(i, f"k{i % 3}", f"q{i % 2}", states[i % 4], 1 + i % 4, ["a", "b"] if i % 2 else ["a"], '{"x": {"y": [1, {"z": 2}]}, "n": null}' if i % 5 else "{}", T0 + timedelta(minutes=i // 3), T0 if i % 4 == 2 else None, T0 + timedelta(hours=i) if i % 4 in (1, 3) else None) for i in range(1, 41)]
    return spark.createDataFrame(rows, "id long, kind string, queue string, state string, priority int, tags array<string>, metadata string, scheduled_at timestamp_ntz, attempted_at timestamp_ntz, finalized_at timestamp_ntz").cache()


def ids(df):
    return [r.id for r in df.collect()]


def test_filters_are_anded_and_empty_ones_are_none(jobs):
    assert ids(JobFilter().ids(3, 1, 99).run(jobs)) == [1, 3]
    assert ids(JobFilter().kinds("k1").queues("q0").priorities().states("completed", "running").run(jobs)) == [10, 22, 34]
    assert len(ids(JobFilter().kinds().run(jobs))) == 40
    assert ids(JobFilter().tags_all("a", "b").tags_any("b", "c").first(2).run(jobs)) == [1, 3]


def test_predicates(jobs):
    f = JobFilter().where("priority = @p", p=2).where("kind = @k", k="k'1")
    assert ids(f.run(jobs)) == []
    assert ids(JobFilter().where("priority = @p AND kind = @k", p=2, k="k1").first(1).run(jobs)) == [1]
    for bad in (lambda: JobFilter().where("a = @x"), lambda: JobFilter().where("a = 1", x=1)):
        with pytest.raises(ValueError):
            bad()


def test_values_of_predicates_stay_values(jobs):
    """Names are filled in once, outside quotes; a value that looks like a name or like SQL is text."""
    f = JobFilter().where("queue = @q AND attempt >= @n", q="x@n", n=3).condition()
    assert "x@n" in str(f) and "x3" not in str(f)
    assert ids(JobFilter().where("concat(queue, '@p') = @q AND priority = @p", q="q1@p", p=2).run(jobs)) == ids(JobFilter().queues("q1").priorities(2).run(jobs))
    assert ids(JobFilter().where("kind = @k", k="' OR 1 = 1 --").run(jobs)) == []
    assert ids(JobFilter().where("kind = @k", k="\\' OR 1 = 1 --").run(jobs)) == []
    assert ids(JobFilter().where("kind = @k /* @none */", {"k": "k0"}, {"k": "k1"}).first(1).run(jobs)) == [1]
    both = JobFilter().where("priority = @x", x=2).where("kind = @x", x="k1")
    assert ids(both.run(jobs)) == ids(JobFilter().priorities(2).kinds("k1").run(jobs))


@pytest.mark.parametrize(("fragment", "want"), [('{"x": {"y": [{"z": 2}]}}', True), ('{"x": {"y": [1.0]}}', True), ('{"x": {"y": ["1"]}}', False), ('{"n": null}', True), ('{"n": 0}', False), ("{}", True), ("[]", False), ('{"x": {"w": 1}}', False)])
def test_containment(spark, fragment, want):
    df = spark.createDataFrame([('{"x": {"y": [1, {"z": 2}]}, "n": null}',)], "m string")
    assert df.select(json_contains(F.col("m"), fragment)).first()[0] is want
    assert spark.createDataFrame([(None,), ("bad",)], "m string").where(json_contains(F.col("m"), fragment)).count() == 0


def test_sorting_and_its_errors(jobs):
    assert ids(JobFilter().order_by("id", descending=True).first(2).run(jobs)) == [40, 39]
    assert ids(JobFilter().order_by("finalized_at", descending=True).first(2).run(jobs)) == [39, 37]
    assert JobFilter().states("running").order_by("time").time_field == "attempted_at"
    assert JobFilter().states("scheduled", "running").order_by("time").time_field == "scheduled_at"
    with pytest.raises(ValueError):
        JobFilter().states("available").order_by("finalized_at").run(jobs)
    with pytest.raises(ValueError):
        JobFilter().states().order_by("finalized_at").run(jobs)
    for n in (0, 10_001):
        with pytest.raises(ValueError):
            JobFilter().first(n)


@pytest.mark.parametrize("down", [False, True])
def test_pages_by_cursor_give_every_job_once(jobs, down):
    page, got = JobFilter().order_by("scheduled_at", down).first(7), []
    while True:
        rows = page.run(jobs)
        got += ids(rows)
        cursor = page.last_cursor(rows)
        if cursor is None:
            break
        assert Cursor.decode(cursor.encode()) == cursor
        page = page.after(cursor)
    want = [r.id for r in jobs.orderBy("scheduled_at", "id").collect()]
    assert got == (want[::-1] if down else want)


def test_deletes_need_a_filter_and_spare_running_jobs(jobs):
    with pytest.raises(ValueError):
        JobFilter().victims(jobs)
    assert len(ids(JobFilter().unsafe_all().victims(jobs))) == 30
    assert ids(JobFilter().kinds("k0").first(2).victims(jobs)) == [3, 9]


def test_reads(jobs, spark):
    many = list(range(2000))
    assert ids(reads.jobs_by_id(jobs, many)) == list(range(1, 41))
    assert ids(reads.stuck_jobs(jobs, T0 + timedelta(1), 2, after=2)) == [6, 10]
    assert [r.kind for r in reads.names(jobs, "kind", "K", "k0", ["k2"]).collect()] == ["k1"]
    counts = {r.state: r.n for r in reads.count_by_state(jobs).collect()}
    assert counts["available"] == 10 and counts["pending"] == 0 and len(counts) == 8
    asked = spark.createDataFrame([("q1",), ("q1",), ("none",)], "queue string")
    assert [tuple(r) for r in reads.count_by_queue_and_state(jobs, asked).collect()] == [("none", 0, 0), ("q1", 0, 0)]
    none = reads.run_statistics(jobs.limit(0).withColumn("created_at", F.col("scheduled_at"))).first()
    assert (none.n, none.run_s) == (0, 0.0)
    wanted, have = (spark.createDataFrame([(x,) for x in xs], "name string") for xs in (["b", "a", "c"], ["a", "a", "b", "z"]))
    assert [tuple(r) for r in reads.which_exist(wanted, have, "name").collect()] == [("a", True), ("b", True), ("c", False)]
    assert not reads.table_exists(spark, "no_such_table") and not reads.column_exists(spark, "no_such_table", "c")
