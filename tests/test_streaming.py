from datetime import datetime, timedelta

import pytest

from tarnwork.model import JOB, QUEUE
from tarnwork.operators import commands as c
from tarnwork.operators import machine as m
from tarnwork.plans import jobs as job_queries
from tarnwork.plans.streams import QUERIES, drained
from tarnwork.sources.store import Store
from tarnwork.streaming import complete_from, cooldown, cycle, stuck
from tarnwork.streaming.loops import Breaker, Settings
from tarnwork.streaming.operators import BUCKETS
from tests.conftest import DATA
from tests.oracle import assert_same
from tests.test_commands import NOW, OLD, by_id, job, table


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cooldown_counts_from_the_last_one_let_through(spark, tmp_path):
    at = [0, 30, 61, 90, 125]
    rows = [("q", NOW + timedelta(seconds=s)) for s in at] + [("p", NOW), (None, NOW)]
    got = drained(cooldown(stream(spark, tmp_path, [rows], "queue string, ts timestamp_ntz"), "queue", "ts", 60.0), "t").collect()
    assert sorted((r.ts - NOW).total_seconds() for r in got if r.queue == "q") == [0, 61, 125]
    assert sum(r.queue == "p" for r in got) == 1


def test_stuck_jobs_come_out_by_event_time(spark, tmp_path):
    rows = [(1, "running", OLD, OLD), (2, "running", OLD, OLD), (2, "completed", OLD, OLD + timedelta(minutes=5)), (3, "running", NOW, NOW), (9, "running", None, NOW)]
    got = drained(stuck(stream(spark, tmp_path, [rows], "id long, state string, attempted_at timestamp_ntz, at timestamp_ntz"), 3600.0), "t").collect()
    assert [(r.id, r.attempted_at) for r in got] == [(1, OLD)]


UPDATES = "id long, state string, attempted_at timestamp_ntz, at timestamp_ntz"


def test_stuck_jobs_share_states(spark, tmp_path):
    many, ended = 3000, {7, 2999}
    rows = [(i, "running", OLD, OLD) for i in range(many)] + [(i, "completed", OLD, OLD + timedelta(minutes=5)) for i in ended] + [(many, "running", NOW, NOW)]
    src = stuck(stream(spark, tmp_path, [rows], UPDATES), 3600.0)
    run = src.writeStream.format("memory").queryName("stuck_shared").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [r.id for r in spark.table("stuck_shared").collect()]
    assert sorted(got) == [i for i in range(many) if i not in ended]
    assert 0 < max(o.numRowsTotal for p in run.recentProgress for o in p.stateOperators) <= BUCKETS


def test_stuck_jobs_over_batches(spark, tmp_path):
    big, at = 2**62 + 1, lambda m: OLD + timedelta(minutes=m)
    batches = [
        [(1, "running", OLD, OLD), (2, "running", OLD, OLD), (3, "running", OLD, OLD), (3, "running", OLD, OLD), (big, "running", OLD, OLD), (None, "running", at(1), at(1)), (4, "running", None, at(1)), (8, None, OLD, at(1))],
        [(2, "completed", OLD, at(30)), (5, "retryable", at(20), at(31)), (5, "running", at(32), at(32)), (3, "running", None, at(33)), (6, "running", at(33), at(33)), (6, "cancelled", at(33), at(34))],
        [(1, "running", at(40), at(40)), (7, "running", at(40), at(40))],
        [(9, "running", at(100), at(100))],  # the timer of 7 is due just then, which is not past
        [(10, "running", at(101), at(101))],
    ]
    got = drained(stuck(stream(spark, tmp_path, batches, UPDATES), 3600.0), "t").collect()
    want = [(1, at(40)), (3, OLD), (5, at(32)), (7, at(40)), (big, OLD), (None, at(1))]
    assert sorted(((r.id, r.attempted_at) for r in got), key=str) == sorted(want, key=str)


def test_statistics_give_every_day(spark):
    small = DATA / "sf0.001"
    assert_same(QUERIES["stream_statistics"](spark, str(small)), job_queries.SQL["q_job_stats_daily"], small)


def test_completions_from_a_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "jobs"), JOB)
    store.write(table(spark, job(1, "running"), job(2, "running"), job(3)))
    n = None
    rows = [(1, "retryable", n, n, n, n, NOW, OLD), (1, "completed", n, n, NOW, n, n, NOW), (3, "completed", n, n, NOW, n, n, NOW)]
    s = stream(spark, tmp_path, [rows], c.SET_STATE + ", at timestamp_ntz")
    complete_from(s, store, str(tmp_path / "state"), lambda: NOW, available_now=True).awaitTermination()
    assert {i: r.state for i, r in by_id(store.read()).items()} == {1: "completed", 2: "running", 3: "available"}


def test_cycle_runs_every_loop_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "jobs"), JOB)
    store.write(table(spark, job(1, args='{"n": 2}'), job(2, "scheduled", kind="bad"), job(3, "completed"), job(4, "running", attempted_at=OLD, kind="none", attempt=1), job(5, queue="paused"), job(6, kind="later"), job(7, kind="stop")))
    queues = spark.createDataFrame([("default", OLD, "{}", None, OLD), ("paused", OLD, "{}", OLD, OLD)], QUEUE)

    def bad(args, row):
        raise RuntimeError("broken")

    def later(args, row):
        raise m.Snooze(3600)

    def stop(args, row):
        raise m.Cancel("no")

    w = m.Workers()
    for kind, f in (("k", lambda args, row: {"twice": args["n"] * 2} if "n" in args else None), ("bad", bad), ("later", later), ("stop", stop)):
        w.add(kind, f)
    done = cycle(store, queues, w, NOW, Settings())
    assert done == {"scheduled": 1, "fetched": 4, "ended": 4, "rescued": 1, "deleted": 1}
    got = by_id(store.read())
    assert {i: r.state for i, r in got.items()} == {1: "completed", 2: "available", 4: "discarded", 5: "available", 6: "scheduled", 7: "cancelled"}
    assert '"twice":4' in got[1].metadata and got[2].errors[0].error == "broken"


def test_breaker():
    b, t = Breaker(), datetime(2025, 1, 1)
    assert not b.trip(t) and not b.trip(t + timedelta(minutes=1)) and not b.trip(t + timedelta(minutes=12))
    assert not b.trip(t + timedelta(minutes=13)) and b.trip(t + timedelta(minutes=14))


def test_cycle_takes_batch_after_batch_notifies_and_cleans(spark, tmp_path):
    from tarnwork.model import NOTIFICATION

    store, queues, outbox = Store(spark, str(tmp_path / "jobs"), JOB), Store(spark, str(tmp_path / "queues"), QUEUE, key="name"), Store(spark, str(tmp_path / "notes"), NOTIFICATION)
    busy = job(20, "running", attempted_at=NOW, attempted_by=["worker-1"], queue="a")
    store.write(table(spark, *(job(i, "scheduled", queue="a" if i % 2 else "b") for i in range(1, 8)), busy, job(30, "completed", attempted_at=OLD), job(31, "completed", attempted_at=OLD), job(32, "completed", attempted_at=OLD)))
    queues.write(spark.createDataFrame([("a", NOW, "{}", None, NOW), ("b", NOW, "{}", None, NOW), ("old", OLD, "{}", None, OLD)], QUEUE))
    outbox.write(spark.createDataFrame([(1, OLD, "{}", "job_insert")], NOTIFICATION))
    w = m.Workers()
    w.add("k", lambda args, row: None)
    done = cycle(store, queues, w, NOW, Settings(batch=3, room=2), Breaker(), outbox)
    assert done["scheduled"] == 7 and done["deleted"] >= 3 and done["queues_deleted"] == 1 and done["notifications_deleted"] == 1
    assert done["fetched"] == 3  # two of b, and one beside the busy one of a
    assert {r.name for r in queues.read().collect()} == {"a", "b"}
    assert {r.payload for r in outbox.read().collect()} == {'{"queue":"a"}', '{"queue":"b"}'}


def test_completers(spark, tmp_path):
    from tarnwork.streaming.loops import Completer, complete_now

    store = Store(spark, str(tmp_path / "jobs"), JOB)
    store.write(table(spark, job(1, "running"), job(2, "running"), job(3, "running")))
    change = lambda i: spark.createDataFrame([(i, "completed", None, None, NOW, None, None)], c.SET_STATE)
    assert [r.state for r in complete_now(store, change(1), NOW).collect()] == ["completed"]
    later = Completer(store, lambda: NOW)
    later.give(change(2))
    later.give(change(3))
    later.close()
    assert {r.state for r in store.read().collect()} == {"completed"}
    bad = Completer(store, lambda: NOW)
    bad.give(spark.range(1))
    with pytest.raises(Exception):
        bad.close()


def test_run_every_calls_with_the_time(spark, tmp_path):
    import time

    from tarnwork.streaming import run_every

    seen = []
    run = run_every(spark, 0.2, str(tmp_path / "ticks"), seen.append)
    try:
        until = time.monotonic() + 30
        while len(seen) < 2 and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        run.stop()
    assert len(seen) >= 2 and seen == sorted(seen)
