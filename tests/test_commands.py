import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwork.model import JOB, LEADER, QUEUE, broken_rules, mask_of, states_of
from tarnwork.operators import commands as c
from tarnwork.operators import machine as m
from tarnwork.sources.store import Store

NOW = datetime(2025, 4, 1, 12)
OLD = NOW - timedelta(days=2)


def job(id_, state="available", **kw):
    row = {"id": id_, "args": "{}", "attempt": 0, "attempted_at": None, "attempted_by": None, "created_at": OLD, "errors": None, "finalized_at": OLD if state in ("cancelled", "completed", "discarded") else None, "kind": "k", "max_attempts": 3, "metadata": "{}", "priority": 1, "queue": "default", "scheduled_at": OLD, "state": state, "tags": [], "unique_key": None, "unique_states": None}
    return tuple((row | kw)[f] for f in JOB.fieldNames())


def table(spark, *rows):
    return spark.createDataFrame(rows, JOB)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_fetch_order_limit_and_workers(spark):
    jobs = table(spark, job(1, priority=3), job(2, priority=2), job(3, priority=1, attempted_by=["a", "b", "c"]), job(4, queue="other"), job(5, scheduled_at=NOW + timedelta(1)), job(6, "running"))
    got = by_id(c.fetch(jobs, "default", 2, NOW, "me", most_workers=3))
    assert sorted(got) == [2, 3] and got[3].attempted_by == ["b", "c", "me"] and got[2].attempted_by == ["me"]
    assert got[2].state == "running" and got[2].attempt == 1 and got[2].attempted_at == NOW
    room = spark.createDataFrame([("default", 1), ("other", 5), ("none", 2)], "queue string, most int")
    assert sorted(by_id(c.fetch_all(jobs, room, NOW, "me"))) == [3, 4]


def test_schedule_conflicts(spark):
    key, mask, no_retry = b"key", mask_of(["available", "pending", "running", "scheduled"]), mask_of(["available", "running"])
    jobs = table(
        spark,
        job(1, "retryable", unique_key=key, unique_states=no_retry),
        job(2, "retryable", unique_key=key, unique_states=no_retry, priority=2),
        job(3, "scheduled"), job(4, "scheduled", scheduled_at=NOW + timedelta(1)), job(5, "pending"),
        job(6, "running", unique_key=b"held", unique_states=mask), job(7, "retryable", unique_key=b"held", unique_states=no_retry, metadata='{"a": 1}'),
        job(8, "scheduled", unique_key=b"own", unique_states=mask),
    )
    got = by_id(c.schedule(jobs, NOW))
    assert {i: (r.state, r.conflict) for i, r in got.items()} == {1: ("available", False), 2: ("discarded", True), 3: ("available", False), 7: ("discarded", True), 8: ("available", False)}
    assert json.loads(got[7].metadata) == {"a": 1, "unique_key_conflict": "scheduler_discarded"} and got[7].finalized_at == NOW
    assert sorted(by_id(c.schedule(jobs, NOW, 1))) == [1]
    assert c.schedule(jobs.limit(0), NOW).count() == 0


def test_set_state_truth_table(spark):
    told = '{"cancel_attempted_at": "x"}'
    e = (OLD, 1, "boom", "")
    jobs = table(spark, job(1, "running"), job(2, "running", metadata=told, attempt=2), job(3, "retryable"), job(4, "running", metadata=told), job(5, "completed"), job(6, "running", errors=[e]))
    later = NOW + timedelta(hours=1)
    batch = spark.createDataFrame(
        [(1, "completed", None, None, NOW, '{"o": 1}', None), (2, "retryable", 9, e, None, None, later), (3, "completed", 7, e, NOW, '{"m": 2}', later), (4, "completed", None, None, NOW, None, None), (5, "retryable", None, e, None, None, later), (6, "scheduled", 0, e, None, None, later), (99, "completed", None, None, NOW, None, None)],
        c.SET_STATE,
    )
    got = by_id(c.set_state(jobs, batch, NOW))
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    assert got[1].state == "completed" and got[1].finalized_at == NOW and json.loads(got[1].metadata) == {"o": 1}
    assert got[2].state == "cancelled" and got[2].finalized_at == NOW and got[2].attempt == 2 and got[2].scheduled_at == OLD and len(got[2].errors) == 1
    assert got[3].state == "retryable" and got[3].attempt == 0 and got[3].errors is None and json.loads(got[3].metadata) == {"m": 2}
    assert got[4].state == "completed"
    assert got[5].state == "completed" and got[5].errors is None
    assert got[6].state == "scheduled" and got[6].attempt == 0 and len(got[6].errors) == 2 and got[6].scheduled_at == later


def test_unique_insert(spark):
    mask = mask_of(states_of(245))
    jobs = table(spark, job(10, "running", unique_key=b"k1", unique_states=mask), job(11, "discarded", unique_key=b"k2", unique_states=mask))
    rows = spark.createDataFrame([(0, "a", b"k1", mask, None), (1, "b", b"k2", mask, None), (2, "c", b"k2", mask, None), (3, "d", b"", 0, None), (4, "e", None, None, None)], "ordinal long, kind string, unique_key binary, unique_states int, tags array<string>")
    got = {r.ordinal: (r.id, r.kind, r.duplicate) for r in c.insert(jobs, rows, NOW).collect()}
    assert got == {0: (10, "k", True), 1: (13, "b", False), 2: (13, "b", True), 3: (15, "d", False), 4: (16, "e", False)}
    assert [r.payload for r in c.insert_notices(c.insert(jobs, rows, NOW)).collect()] == ['{"queue":"default"}']
    new = by_id(c.applied(jobs, c.inserted_rows(c.insert(jobs, rows, NOW))))
    assert sorted(new) == [10, 11, 13, 15, 16] and new[15].unique_key is None and new[15].metadata == "{}" and new[15].tags == []


def test_single_job_commands(spark):
    jobs = table(spark, job(1), job(2, "running"), job(3, "completed"), job(4, "discarded", attempt=3), job(5, scheduled_at=NOW))
    cancelled = by_id(c.cancel(jobs, NOW))
    assert {i: r.state for i, r in cancelled.items()} == {1: "cancelled", 2: "running", 3: "completed", 4: "discarded", 5: "cancelled"}
    assert "cancel_attempted_at" in cancelled[2].metadata and cancelled[2].finalized_at is None and cancelled[3].metadata == "{}"
    assert c.cancel_notice(jobs).count() == 3
    retried = by_id(c.retry(jobs, NOW))
    assert retried[1].scheduled_at == OLD and retried[2].state == "running" and retried[4].max_attempts == 4 and retried[4].finalized_at is None and retried[5].scheduled_at == NOW
    assert {r.id: r.deleted for r in c.deletable(jobs).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}
    assert json.loads(by_id(c.update(jobs.where("id = 1"), '{"output": [1]}'))[1].metadata) == {"output": [1]}
    assert by_id(c.update_full(jobs.where("id = 1"), state="pending", metadata=None))[1].metadata is None
    with pytest.raises(ValueError):
        c.update_full(jobs, queue="x")


def test_rescue_retention_and_rules(spark):
    e = (NOW, 1, "stuck", "")
    jobs = table(spark, job(1, "running", metadata='{"runner:rescue_count": 2}'), job(2, "running", metadata='{"runner:rescue_count": "x"}'))
    batch = spark.createDataFrame([(1, e, None, NOW, "retryable"), (2, e, NOW, OLD, "discarded")], "id long, error struct<at:timestamp_ntz,attempt:int,error:string,trace:string>, finalized_at timestamp_ntz, scheduled_at timestamp_ntz, state string")
    got = by_id(c.rescue(jobs, batch))
    assert json.loads(got[1].metadata)["runner:rescue_count"] == 3 and json.loads(got[2].metadata)["runner:rescue_count"] == 1 and len(got[1].errors) == 1
    old = table(spark, job(1, "cancelled"), job(2, "completed"), job(3, "discarded", queue="kept"), job(4, "completed", finalized_at=NOW), job(5))
    h = {s: NOW - timedelta(hours=1) for s in ("cancelled", "completed", "discarded")}
    assert sorted(by_id(c.expired(old, h, 2))) == [1, 2]
    assert sorted(by_id(c.expired(old, h, excluded=["kept"]))) == [1, 2] and sorted(by_id(c.expired(old, h, included=["kept"]))) == [3]
    assert sorted(by_id(c.expired(old, {"completed": NOW - timedelta(hours=1)}))) == [2]
    bad = table(spark, job(1, "completed", finalized_at=None, priority=9), job(2, queue="q" * 200))
    assert {tuple(r) for r in broken_rules(bad).collect()} == {(1, "finalized_or_finalized_at_null"), (1, "priority_in_range"), (2, "queue_length")}


def test_queues_and_leader(spark):
    queues = spark.createDataFrame([("a", OLD, "{}", None, OLD), ("b", OLD, "{}", OLD, OLD)], QUEUE)
    p = {r.name: (r.paused_at, r.updated_at) for r in c.queue_pause(queues, "*", NOW).collect()}
    assert p == {"a": (NOW, NOW), "b": (OLD, OLD)}
    r = {r.name: (r.paused_at, r.updated_at) for r in c.queue_resume(queues, "*", NOW).collect()}
    assert r == {"a": (None, OLD), "b": (None, NOW)}
    up = {x.name: x for x in c.queue_upsert(queues, spark.createDataFrame([("a", "{1}"), ("c", None)], "name string, metadata string"), NOW).collect()}
    assert up["a"].created_at == OLD and up["a"].metadata == "{}" and up["c"].created_at == NOW and up["c"].metadata == "{}"
    first = c.leader_elect(spark.createDataFrame([], LEADER), "x", 10, NOW)
    assert [r.leader_id for r in c.leader_elect(first, "y", 10, NOW).collect()] == ["x"]
    assert c.leader_reelect(first, "x", NOW, 10, NOW + timedelta(seconds=11)).count() == 0
    assert c.leader_without_expired(first, NOW + timedelta(seconds=11)).count() == 0
    rest, notice = c.leader_resign(first, "x", NOW)
    assert rest.count() == 0 and json.loads(notice.first().payload) == {"leader_id": "x", "action": "resigned"}


def test_outcomes(spark):
    e = (OLD, 1, "boom", "")
    jobs = table(spark, *(job(i, "running", attempt=a, errors=er) for i, a, er in ((1, 1, None), (2, 3, None), (3, 1, [e] * 3), (4, 1, None), (5, 1, None), (6, 0, None), (7, 1, None))))
    n = None
    outs = [(1, "error", "x", n, n, n, n, OLD), (2, "error", "x", n, n, n, n, OLD), (3, "error", "x", n, n, n, n, OLD), (4, "snooze", n, n, 2.0, n, '{"a":1}', OLD), (5, "cancel", "why", n, n, n, n, OLD), (6, "soft_stop", "x", n, n, n, n, OLD), (7, "error", "x", n, n, NOW - timedelta(1), n, OLD)]
    got = by_id(c.set_state(jobs, m.commands_of(jobs, spark.createDataFrame(outs, m.OUTCOME), NOW), NOW))
    assert {i: r.state for i, r in got.items()} == {1: "available", 2: "discarded", 3: "retryable", 4: "available", 5: "cancelled", 6: "available", 7: "available"}
    assert got[3].scheduled_at == NOW + timedelta(seconds=256) and len(got[3].errors) == 4
    assert json.loads(got[4].metadata) == {"a": 1, "snoozes": 1} and got[4].attempt == 0 and got[4].errors is None
    assert got[6].attempt == 0 and got[6].errors is None and got[7].scheduled_at == NOW + timedelta(seconds=1)


def test_logs_steps_periodic_and_options(spark):
    logs = json.dumps({"runner:log": [{"attempt": 1, "log": "a" * 50}, {"attempt": 2, "log": "b" * 50}]})
    jobs = table(spark, job(1, metadata=logs), job(2), job(3, metadata='{"runner:log": {"no": "array"}}'))
    new = spark.createDataFrame([(1, 3, "c" * 60), (2, 1, "d"), (3, 1, "e")], "id long, attempt int, log string")
    got = [(r.id, r.attempt, r.log[:1], len(r.log)) for r in m.log_entries(jobs, new, most_total=170, most_entry=50).orderBy("id", "pos").collect()]
    assert got[:2] == [(1, 2, "b", 50), (1, 3, "c", 50)] and (2, 1, "d", 1) in got
    steps = spark.createDataFrame([("k", ["s1", "s2", "s3"])], "kind string, steps array<string>")
    meta = ["{}", '{"runner:resumable_step": "s1"}', '{"runner:resumable_step": "s2", "runner:resumable_cursor": {"s2": 5}}', '{"runner:resumable_step": "s3"}', '{"runner:resumable_step": "gone"}']
    got = {r.id: (r.next_step, r.cursor) for r in m.next_step(table(spark, *(job(i, metadata=x) for i, x in enumerate(meta))), steps).collect()}
    assert got == {0: ("s1", None), 1: ("s2", None), 2: ("s2", "5"), 3: (None, None), 4: (None, None)}
    spec = spark.createDataFrame([("a", NOW - timedelta(seconds=25), 10.0, False), ("b", NOW + timedelta(1), 10.0, True), ("c", NOW + timedelta(1), 10.0, False)], "id string, next_run_at timestamp_ntz, every_s double, run_on_start boolean")
    runs = sorted((r.id, (r.run_at - NOW).total_seconds()) for r in m.periodic_runs(spec, NOW).collect())
    assert runs == [("a", -25.0), ("a", -15.0), ("a", -5.0), ("b", 0.0)]
    opts = m.insert_options("k", own={"priority": 2, "scheduled_at": OLD}, of_args={"queue": "q", "priority": 4}, config={"max_attempts": 7})
    assert (opts["priority"], opts["queue"], opts["max_attempts"], opts["state"]) == (2, "q", 7, "scheduled")
    for bad in ({"priority": 5}, {"queue": "no spaces"}, {"tags": ["x y"]}, {"unique": {"by_period": 0.5}}, {"unique": {"by_state": ["available"]}}):
        with pytest.raises(ValueError):
            m.insert_options("k", own=bad)
    with pytest.raises(ValueError):
        m.metadata_update(**{"runner:x": 1})
    with pytest.raises(ValueError):
        m.output_update('"x"', most=2)


def test_store_keeps_snapshots(spark, tmp_path):
    s = Store(spark, str(tmp_path / "jobs"), JOB, keep=2)
    assert s.read().count() == 0
    for i in range(1, 4):
        s.change(lambda t, i=i: c.applied(t, table(spark, job(i))))
    assert s.versions() == [2, 3] and sorted(by_id(s.read())) == [1, 2, 3]
    s.change(lambda t: c.without(t, t.where(F.col("id") == 2)))
    assert sorted(by_id(s.read())) == [1, 3] and sorted(by_id(s.read(3))) == [1, 2, 3]


def test_store_writes_changes_and_compacts(spark, tmp_path):
    s = Store(spark, str(tmp_path / "jobs"), JOB, keep=2, deltas=3)
    s.merge(table(spark, job(1), job(2), job(3)))  # the first is a snapshot
    s.merge(table(spark, job(2, "running"), job(4)))
    assert {i: r.state for i, r in by_id(s.read()).items()} == {1: "available", 2: "running", 3: "available", 4: "available"}
    s.merge(table(spark, job(1), job(2)), gone=True)
    assert sorted(by_id(s.read())) == [3, 4] and sorted(by_id(s.read(2))) == [1, 2, 3, 4] and sorted(by_id(s.read(1))) == [1, 2, 3]
    assert len(list((tmp_path / "jobs").glob("v*"))) == 1  # no snapshot for either
    s.merge(table(spark, job(2, "completed")))
    assert len(list((tmp_path / "jobs").glob("v*"))) == 2 and {i: r.state for i, r in by_id(s.read()).items()} == {2: "completed", 3: "available", 4: "available"}
    s.write(s.read())
    s.write(s.read())
    assert s.versions() == [6, 7]


@pytest.mark.parametrize(("left", "right", "want"), [
    ('{"a":1,"a":2,"b":3}', '{"c":1}', {"a": 2, "b": 3, "c": 1}), ("not json", '{"c":1}', "not json"), ("[1]", '{"c":1}', "[1]"), (None, '{"c":1}', {"c": 1}),
    (" ", '{"c":1}', {"c": 1}), ('{"a":{"x":1}}', '{"a":{"y":2}}', {"a": {"y": 2}}), ('{"a":1}', None, {"a": 1}), ('{"a":1}', "{}", {"a": 1}), ('{"a":1}', "bad", {"a": 1}),
])
def test_merge_loses_nothing_of_the_left(spark, left, right, want):
    from tarnwork.functions import json_merge

    got = spark.createDataFrame([(left, right)], "a string, b string").select(json_merge(F.col("a"), F.col("b"))).first()[0]
    assert got == want or json.loads(got) == want


def test_whole_numbers_are_compared_digit_by_digit(spark):
    from tarnwork.functions import json_contains

    big = 2**53 + 1
    df = spark.createDataFrame([(f'{{"n": {big}}}',), (f'{{"n": {big - 1}}}',), ('{"n": 5.0}',), ('{"n": 5.5}',), ('{"n": 123456789012345678901234567890}',)], "m string")
    n = lambda v: df.where(json_contains(F.col("m"), json.dumps({"n": v}))).count()
    assert (n(big), n(5), n(5.5), n(123456789012345678901234567890), n(123456789012345678901234567891)) == (1, 1, 1, 1, 0)


@pytest.mark.parametrize(("name", "good"), [("a", True), ("a_b-c|d", True), ("a1", True), ("a__b", False), ("A", False), ("a/b", False), ("_a", False), ("a_", False), ("", False), ("a" * 64, True), ("a" * 65, False), ("a" * 63 + "!", False)])
def test_queue_names(name, good):
    if good:
        m.check_queue_name(name)
    else:
        with pytest.raises(ValueError):
            m.check_queue_name(name)


def test_strict_inserts_and_terms_refuse_conflicts(spark):
    key, mask = b"key", mask_of(["available", "pending", "running", "scheduled"])
    jobs = table(spark, job(1, unique_key=key, unique_states=mask), job(5))
    rows = lambda *ks: spark.createDataFrame([(i, k, mask if k else None) for i, k in enumerate(ks)], "ordinal long, unique_key binary, unique_states int")
    assert sorted(by_id(c.insert_strict(jobs, rows(None, b"new"), NOW))) == [6, 7]
    for bad in (rows(key), rows(b"x", b"x")):
        with pytest.raises(Exception, match="unique key of row"):
            c.insert_strict(jobs, bad, NOW).collect()
    term = c.leader_insert(spark.createDataFrame([], LEADER), "x", NOW, ttl=5)
    assert [(r.leader_id, r.expires_at) for r in c.leader_elected(term).collect()] == [("x", NOW + timedelta(seconds=5))]
    with pytest.raises(Exception, match="a term already"):
        c.leader_insert(term, "y", NOW).collect()


def test_workers_limits_retries_traces_and_layers():
    import time

    calls = []

    class Plugin:
        def begin(self, row):
            calls.append("begin")

        def around(self, row, run):
            calls.append("in")
            out = run()
            calls.append("out")
            return {**(out or {}), "seen": True}

        def insert(self, row):
            return row | {"queue": "other"}

    def slow(args, row):
        time.sleep(5)

    def broken(args, row):
        raise RuntimeError("broken")

    def panics(args, row):
        raise MemoryError("full")

    w = m.Workers()
    w.plug(Plugin())
    w.on_panic = lambda row, e: True
    w.add("slow", slow, timeout=0.2)
    w.add("broken", broken, next_retry=lambda row, e: NOW)
    w.add("panics", panics)
    w.add("fine", lambda args, row: {"n": args["n"]}, around=(lambda row, run: run() | {"own": 1},))
    run = lambda kind: w.one({"id": 1, "kind": kind, "args": '{"n": 2}'})
    assert run("slow")["outcome"] == "error" and "no end after" in run("slow")["error"]
    got = run("broken")
    assert (got["outcome"], got["retry_at"]) == ("error", NOW) and "RuntimeError: broken" in got["trace"] and "in broken" in got["trace"]
    assert run("panics")["outcome"] == "cancel" and "no worker" in run("none")["error"]
    calls.clear()
    assert json.loads(run("fine")["metadata"]) == {"n": 2, "own": 1, "seen": True} and calls == ["begin", "in", "out"]
    assert w.inserting([{"queue": "q", "id": 1}]) == [{"queue": "other", "id": 1}]


def test_log_append_writes_the_log_back(spark):
    logs = json.dumps({"runner:log": [{"attempt": 1, "log": "a" * 50}, {"attempt": 2, "log": "b" * 50}], "x": 1})
    jobs = table(spark, job(1, metadata=logs), job(2), job(4))
    new = spark.createDataFrame([(1, 3, "é" * 40), (2, 1, "d")], "id long, attempt int, log string")
    got = {i: json.loads(r.metadata) for i, r in by_id(m.log_append(jobs, new, most_total=170)).items()}
    assert sorted(got) == [1, 2] and got[2] == {"runner:log": [{"attempt": 1, "log": "d"}]}
    assert got[1] == {"x": 1, "runner:log": [{"attempt": 3, "log": "é" * 40}]} or len(got[1]["runner:log"]) == 2
    many = table(spark, job(1, metadata=json.dumps({"runner:log": [{"attempt": i, "log": "x" * 10} for i in range(20_000)]})))
    assert m.log_entries(many, new.limit(1)).count() == 20_001


def test_events_follow_the_reasons(spark):
    from tarnwork.streaming import job_events

    jobs = table(spark, *(job(i, "running", attempt=1) for i in range(1, 7)))
    n = None
    outs = [(1, "completed", n, n, n, n, n, OLD), (2, "error", "x", n, n, n, n, OLD), (3, "snooze", n, n, 1.0, n, n, OLD), (4, "soft_stop", n, n, n, n, n, OLD), (5, "cancel", "x", n, n, n, n, OLD), (6, "snooze", n, n, 99.0, n, n, OLD)]
    changes = m.commands_of(jobs, spark.createDataFrame(outs, m.OUTCOME), NOW)
    got = {r.id: (r.event, r.state) for r in job_events(c.reported(c.set_state(jobs, changes, NOW), changes)).collect()}
    assert got == {1: ("job_completed", "completed"), 2: ("job_failed", "available"), 3: ("job_snoozed", "available"), 4: ("job_interrupted", "available"), 5: ("job_cancelled", "cancelled"), 6: ("job_snoozed", "scheduled")}
    assert job_events(table(spark, job(1, "scheduled"))).count() == 0


def test_changes_come_by_id_where_asked(spark):
    ids = [9, 2, 7, 1, 8, 3]
    jobs = table(spark, *(job(i, "running") for i in ids)).repartition(3)
    changes = spark.createDataFrame([(i, "completed", None, None, NOW, None, None) for i in ids], c.SET_STATE)
    assert [r.id for r in c.set_state(jobs, changes, NOW, ordered=True).collect()] == sorted(ids)
    batch = spark.createDataFrame([(i, (NOW, 1, "stuck", ""), None, NOW, "retryable") for i in ids], "id long, error struct<at:timestamp_ntz,attempt:int,error:string,trace:string>, finalized_at timestamp_ntz, scheduled_at timestamp_ntz, state string")
    assert [r.id for r in c.rescue(jobs, batch, ordered=True).collect()] == sorted(ids)


def test_split_lists(spark):
    from tarnwork.functions import split_list

    df = spark.createDataFrame([("a,b",), ("",), (None,), ("x.y",)], "t string")
    assert [r[0] for r in df.select(split_list(F.col("t"))).collect()] == [["a", "b"], [], None, ["x.y"]]
    assert df.select(split_list(F.col("t"), ".")).collect()[3][0] == ["x", "y"]
