"""SQLite, migrations, pilots and the helpers for tests."""

from datetime import timedelta

import pytest

from tarnwork import testing
from tarnwork.model import JOB, MIGRATION, NOTIFICATION, QUEUE
from tarnwork.operators import machine as m
from tarnwork.operators import migrate, reads
from tarnwork.sources.sqlite import poll_sqlite, read_sqlite, write_sqlite
from tarnwork.sources.store import Store
from tarnwork.streaming import Pilot, cycle
from tests.test_commands import NOW, OLD, by_id, job, table


def test_sqlite_tables_come_back_as_they_were(spark, tmp_path):
    path = str(tmp_path / "q.db")
    jobs = table(spark, *(job(i, "running", tags=["a", "é"], attempted_by=["w"], attempted_at=NOW, errors=[(OLD, 1, "x", "")], unique_key=b"\x00k", unique_states=245, args='{"a": 1}') for i in range(1, 40)), job(100))
    assert write_sqlite(jobs, path, "job_row") == 40
    got = read_sqlite(spark, path, "job_row", parts=4)
    assert got.rdd.getNumPartitions() == 4 and by_id(got) == by_id(jobs)
    write_sqlite(table(spark, job(100, "pending")), path, "job_row")  # in the old one's place
    assert by_id(read_sqlite(spark, path, "job_row"))[100].state == "pending"
    write_sqlite(jobs.limit(0), str(tmp_path / "none.db"), "job_row")
    assert read_sqlite(spark, str(tmp_path / "none.db"), "job_row").count() == 0


def test_sqlite_outbox_is_polled(spark, tmp_path):
    path = str(tmp_path / "q.db")
    notes = lambda *ids: spark.createDataFrame([(i, NOW, "{}", "job_insert") for i in ids], NOTIFICATION)
    write_sqlite(notes(1, 2, 3), path, "job_notification")
    seen = []
    run = poll_sqlite(spark, path, after=1).writeStream.foreachBatch(lambda df, _: seen.append(sorted(r.id for r in df.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 seconds").start()
    try:
        run.processAllAvailable()
        write_sqlite(notes(4, 9), path, "job_notification")
        run.processAllAvailable()
    finally:
        run.stop()
    assert [i for batch in seen for i in batch] == [2, 3, 4, 9]


@pytest.mark.parametrize(("direction", "have", "options", "want"), [
    ("up", [1, 2], {}, [3, 4]), ("up", [2], {}, [1, 3, 4]), ("up", [], {"target": 2}, [1, 2]), ("up", [1], {"most": 1}, [2]), ("up", [1, 2, 3, 4], {}, []),
    ("down", [1, 2, 3], {}, [3]), ("down", [1, 2, 3], {"target": 1}, [3, 2]), ("down", [1, 2, 3], {"target": -1}, [3, 2, 1]), ("down", [1, 2, 3], {"most": 2}, [3, 2]), ("down", [], {}, []),
])
def test_plans_of_migrations(direction, have, options, want):
    assert migrate.plan([1, 2, 3, 4], have, direction, **options) == want


def test_migrations_run_and_are_recorded(spark, tmp_path):
    store, done = Store(spark, str(tmp_path / "m"), MIGRATION), []
    store.write(spark.createDataFrame([("other", 7, OLD)], MIGRATION))
    steps = {v: (lambda v=v: done.append(v), lambda v=v: done.append(-v)) for v in (1, 2, 3)}
    r = migrate.Runner(store, {"main": steps})
    assert r.validate() == [1, 2, 3] and r.migrate("up", now=NOW, dry=True) == [1, 2, 3] and done == []
    assert r.migrate("up", now=NOW, target=2) == [1, 2] and r.versions() == [1, 2] and r.validate() == [3]
    assert r.migrate("down", now=NOW) == [2] and done == [1, 2, -2] and r.versions("other") == [7]
    for bad in (lambda: r.migrate("up", "none", now=NOW), lambda: r.migrate("up", now=NOW, target=9), lambda: r.migrate("down", now=NOW, target=3), lambda: r.migrate("side", now=NOW)):
        with pytest.raises(ValueError):
            bad()

    def broken():
        raise RuntimeError("no")

    bad = migrate.Runner(store, {"main": steps | {2: (broken, None)}})
    with pytest.raises(RuntimeError):
        bad.migrate("up", now=NOW)
    assert r.versions() == [1] and r.migrate("up", now=NOW) == [2, 3]


def test_a_pilot_takes_over(spark, tmp_path):
    class OneAtATime(Pilot):
        alive = 0

        def fetch(self, jobs, room, now, worker):
            return super().fetch(jobs, room.selectExpr("queue", "least(most, 1) AS most"), now, worker)

        def queues_not_cleaned(self):
            return ["kept"]

        def worker_alive(self, worker, now):
            self.alive += 1

    store = Store(spark, str(tmp_path / "jobs"), JOB)
    store.write(table(spark, job(1), job(2), job(3, "completed"), job(4, "completed", queue="kept")))
    queues = spark.createDataFrame([("default", OLD, "{}", None, OLD)], QUEUE)
    w, pilot = m.Workers(), OneAtATime()
    w.add("k", lambda args, row: None)
    done = cycle(store, queues, w, NOW, pilot=pilot)
    assert (done["fetched"], done["deleted"], pilot.alive) == (1, 1, 1) and sorted(by_id(store.read())) == [1, 2, 4]


def test_durable_periodic_jobs(spark):
    pilot = Pilot()
    have = spark.createDataFrame([("a", OLD, OLD), ("b", OLD, OLD), ("c", OLD, OLD)], "id string, next_run_at timestamp_ntz, updated_at timestamp_ntz")
    up = pilot.periodic_upserted(have, spark.createDataFrame([("b", NOW), ("d", NOW)], "id string, next_run_at timestamp_ntz"), NOW)
    kept = pilot.periodic_all(pilot.periodic_kept(pilot.periodic_touched(up, ["a"], NOW), NOW - timedelta(hours=1)))
    assert [(r.id, r.next_run_at, r.updated_at) for r in kept.collect()] == [("a", OLD, NOW), ("b", NOW, NOW), ("d", NOW, NOW)]


def test_helpers_for_tests(spark):
    jobs = table(spark, job(1, kind="one", args='{"n": 1}', tags=["x"]), job(2, kind="two", priority=2), job(3, kind="two"))
    assert testing.require_inserted(jobs, "one", args={"n": 1}, tags=["x"], state="available").id == 1
    for bad in (lambda: testing.require_inserted(jobs, "none"), lambda: testing.require_inserted(jobs, "two"), lambda: testing.require_inserted(jobs, "one", priority=3), lambda: testing.require_not_inserted(jobs, "two"), lambda: testing.require_not_inserted(jobs, "two", priority=2), lambda: testing.require_many_inserted(jobs, [("two", {}), ("one", {})]), lambda: testing.require_many_inserted(jobs, [("two", {"priority": 4}), ("two", {})])):
        with pytest.raises(AssertionError):
            bad()
    with pytest.raises(ValueError):
        testing.require_inserted(jobs, "one", id=1)
    assert [r.id for r in testing.require_many_inserted(jobs, [("one", {}), ("two", {"priority": 2}), ("two", {})])] == [1, 2, 3]
    testing.require_not_inserted(jobs, "none")
    testing.require_not_inserted(jobs, "two", priority=4)
    w = m.Workers()
    w.add("k", lambda args, row: {"n": args["n"], "try": row["attempt"]})
    assert testing.work_one(w, "k", {"n": 5}, attempt=2)["metadata"] == '{"n": 5, "try": 2}'


def test_catalogue(spark, tmp_path):
    for name in ("t_old", "t_new", "other"):
        reads.schema_create(spark, name)
    assert reads.expired_schemas(spark, "t_", "t_o") == ["t_new"]
    spark.range(1).write.saveAsTable("t_new.some")
    assert reads.table_exists(spark, "t_new.some") and reads.column_exists(spark, "t_new.some", "id") and not reads.column_exists(spark, "t_new.some", "x")
    for name in ("t_old", "t_new", "other"):
        reads.schema_drop(spark, name)
    assert not reads.table_exists(spark, "t_new.some") and reads.expired_schemas(spark, "t_", "z") == []
    store = Store(spark, str(tmp_path / "jobs"), JOB)
    store.write(table(spark, job(1)))
    store.truncate()
    assert store.read().count() == 0


def test_scratch_deletes_what_was_staged(spark):
    from pathlib import Path

    from tarnwork import runtime

    folder = Path(runtime.shared_dir(spark))
    before = set(folder.iterdir())
    with runtime.scratch(spark):
        assert runtime.staged(spark.range(3), "tmp").count() == 3
        assert set(folder.iterdir()) - before
    assert set(folder.iterdir()) == before
