import json

import pytest

from tarnwork.operators import drift

SCHEMA = "archiver string, kind string, file_no int, line_no int, job_id bigint, args string"


def table(spark, lines):
    """Lines of (file, job, document or text)."""
    rows = [("a", "k", f, i, j, d if d is None or isinstance(d, str) else json.dumps(d)) for i, (f, j, d) in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return {(r.file_no, r.change, r.field, r.new_field) for r in drift.changes(df).collect()}


def test_kinds_of_changes(spark):
    lines = [
        (1, 1, {"a": 1, "b": "x", "o": {"p": 1, "q": [1]}, "gone": True}),
        (1, 2, {"a": 2, "b": "y", "o": {"p": 2, "q": []}, "gone": False}),
        (3, 2, {"A": 2, "b": ["y"], "o": {"p": 2, "q": []}, "new": {"x": 1}}),
        (3, 3, {"A": 3, "b": ["z"], "o": {"p": "5", "q": [1]}, "new": {"x": 1}}),
    ]
    assert found(table(spark, lines)) == {(3, "renamed", "a", "A"), (3, "retyped", "b", ""), (3, "removed", "gone", ""), (3, "added", "new", ""), (3, "retyped", "o.p", "")}


def test_rename_needs_equal_values_in_jobs_of_both_files(spark):
    same = [(1, 1, {"user_id": 7}), (2, 1, {"user_ident": 7}), (2, 2, {"user_ident": 8})]
    other = [(1, 1, {"user_id": 7}), (2, 1, {"user_ident": 9})]
    apart = [(1, 1, {"user_id": 7}), (2, 2, {"user_ident": 7})]
    assert found(table(spark, same)) == {(2, "renamed", "user_id", "user_ident")}
    for lines in (other, apart):
        assert found(table(spark, lines)) == {(2, "removed", "user_id", ""), (2, "added", "user_ident", "")}


def test_renamed_objects_and_swaps(spark):
    lines = [(1, 1, {"opts": {"x": 1, "y": [{"z": 2}]}, "p": 1, "q": 2}), (2, 1, {"options": {"y": [{"z": 2}], "x": 1}, "r": 2, "s": 1})]
    assert found(table(spark, lines)) == {(2, "renamed", "opts", "options"), (2, "renamed", "p", "s"), (2, "renamed", "q", "r")}


def test_ties_are_settled_by_structure(spark):
    lines = [(1, 1, {"dry_run": True, "verbose": True}), (2, 1, {"dry_runs": True, "verbosity": True})]
    assert found(table(spark, lines)) == {(2, "renamed", "dry_run", "dry_runs"), (2, "renamed", "verbose", "verbosity")}


def test_only_topmost_and_files_that_lack_the_kind(spark):
    lines = [(1, 1, {"o": {"p": 1}}), (2, 2, "spoilt {"), (2, 2, None), (2, 2, "null"), (2, 3, "[1]"), (5, 3, {"o": {"p": 1, "r": {"s": 1}}}), (7, 4, {"o": 3})]
    assert found(table(spark, lines)) == {(5, "added", "o.r", ""), (7, "retyped", "o", "")}


def test_nulls_repeats_long_texts_and_odd_names(spark):
    lines = [(1, None, {"a": None, "b": 1, "x.y": 1}), (1, None, {"a": None, "b": 1, "x.y": 1}), (2, None, {"a": "v" * 100_000, "b": 1, "x.y": 1, "é\ud800": 1})]
    got = found(table(spark, lines))
    assert {g[:3] for g in got} >= {(2, "added", "a")} and len(got) == 2
    df = table(spark, lines).withColumnsRenamed({"line_no": "path"}).selectExpr("*", "1 AS digest", "1 AS s0", "1 AS file")
    assert found(df) == got


def test_null_series_and_empty(spark):
    df = spark.createDataFrame([(None, "k", 1, 1, 1, '{"a":1}'), (None, "k", 2, 1, 1, '{"b":1}'), (None, "k", None, 1, 1, '{"c":1}')], SCHEMA)
    assert found(df) == {(2, "renamed", "a", "b")}
    assert drift.changes(df.limit(0)).count() == 0


def test_one_table(spark):
    lines = [(1, 1, {"a": 1, "t": 1}), (2, 1, {"b": 1, "t": 2.5}), (3, 1, {"c": 1, "t": 3}), (3, 2, {"c": 4, "t": 1, "n": None}), (3, 9, "spoilt")]
    df = table(spark, lines)
    rows = drift.unified(df, drift.changes(df))
    got = {(r.file_no, r.job_id, r.name, r.value) for r in rows.collect()}
    assert got == {(1, 1, "c", "1"), (2, 1, "c", "1"), (3, 1, "c", "1"), (3, 2, "c", "4"), (1, 1, "t", "1"), (2, 1, "t", "2.5"), (3, 1, "t", "3"), (3, 2, "t", "1")}
    types = {r.name: r.type for r in drift.columns_of(rows).collect()}
    assert types == {"c": "bigint", "t": "double"}
    flat = drift.kind_table(rows, types, "k").orderBy("file_no", "job_id").collect()
    assert [(r.c, r.t) for r in flat] == [(1, 1.0), (1, 2.5), (1, 3.0), (4, 1.0)]


def test_one_table_of_nested_and_moved_fields(spark):
    lines = [
        (1, 1, {"o": {"hash": "h", "n": 1}, "call": "u", "opts": {"k": True}, "chunks": [{"price": 5, "q": 1}, {"q": 2}, 7], "p": 1, "q": 2, "e": {}}),
        (2, 1, {"o": {"content_hash": "h", "n": 1}, "opts": {"k": True, "call": "u"}, "chunks": [{"unitPrice": 5, "q": 1}, {"q": 2}, 7], "p": 2, "q": 1, "e": {}}),
        (4, 1, {"target": {"content_hash": "h", "n": 1}, "opts": {"k": True, "call": "u"}, "chunks": [{"unitPrice": 5, "q": 1}, {"q": 2}, 7], "p": 2, "q": 1, "e": {}}),
    ]
    df = table(spark, lines)
    rows = drift.unified(df, drift.changes(df)).collect()
    want = {"target.content_hash": "h", "target.n": "1", "opts.k": "true", "opts.call": "u", "chunks": "[null,null,7]", "chunks.unitPrice": "[5,null,null]", "chunks.q": "[1,2,null]", "e": "{}"}
    for file in (1, 2, 4):
        got = {r.name: r.value for r in rows if r.file_no == file}
        assert {n: v for n, v in got.items() if n not in ("p", "q")} == want
    assert {r.name: r.type for r in rows}["opts.k"] == "boolean" and len(rows) == 30


def test_swapped_names_and_texts_as_written(spark):
    swap = [(3, "a", "b"), (3, "b", "a"), (5, "a", "c")]
    assert [drift.current_path(p, 1, swap) for p in ("a", "b", "b.x", "ab")] == ["b", "c", "c.x", "ab"]
    assert drift.current_path("a", 3, swap) == "c" and drift.current_path("a", 5, swap) == "a"
    df = table(spark, [(1, 1, '{"x": 2.50, "y": [1e400, 0.12345678901234567890], "z": "null", "w": [[{"v": 1}], [{"v": null}]]}')])
    got = {r.name: r.value for r in drift.unified(df, drift.changes(df)).collect()}
    assert got == {"x": "2.50", "y": "[1e400,0.12345678901234567890]", "z": "null", "w.v": "[[1],null]"}


def test_flooding_prefers_the_same_structure():
    old = {"a": {"object"}, "a\x1fx": {"number"}, "a\x1fy": {"string"}, "b": {"object"}, "b\x1fu": {"boolean"}}
    new = {"p": {"object"}, "p\x1fx": {"number"}, "p\x1fy": {"string"}, "q": {"object"}, "q\x1fu": {"boolean"}}
    score = drift.flood(old, new, {("a\x1fx", "p\x1fx"): 1.0, ("b\x1fu", "q\x1fu"): 1.0})
    assert score["a", "p"] > score["a", "q"] and score["b", "q"] > score["b", "p"]
    assert drift.matches(old, new, ["a", "b"], ["p", "q"], {}) == [("a", "p"), ("b", "q")] or set(drift.matches(old, new, ["a", "b"], ["p", "q"], {})) == {("a", "p"), ("b", "q")}


@pytest.mark.parametrize(("v", "t"), [(True, "boolean"), (1, "number"), (1.5, "number"), ("", "string"), ([], "array"), ({}, "object")])
def test_types(v, t):
    assert drift.type_of(v) == t


SEVERAL = [
    (1, 1, {"o": {"unit_price": 5, "n": 1}, "old_a": "x", "old_b": "y", "flag": True, "mark": True, "p": 1, "q": 2}),
    (1, 2, {"o": {"unit_price": 6, "n": 1}, "old_a": "u", "old_b": "v", "flag": False, "mark": False, "p": 3, "q": 4}),
    (2, 1, {"o": {"unitPrice": 5, "n": 1}, "new_b": "y", "new_a": "x", "a_mark": True, "the_flag": True, "r": 2, "s": 1}),
    (2, 2, {"o": {"unitPrice": 6, "n": 1}, "new_b": "v", "new_a": "u", "a_mark": False, "the_flag": False, "r": 4, "s": 3}),
]
WANT = {("o.unit_price", "o.unitPrice"), ("old_a", "new_a"), ("old_b", "new_b"), ("flag", "the_flag"), ("mark", "a_mark"), ("p", "s"), ("q", "r")}


def test_flooding_decides_among_several(spark, monkeypatch):
    got = found(table(spark, SEVERAL))
    assert {(a, b) for _, c, a, b in got if c == "renamed"} == WANT and len(got) == len(WANT)
    lines = [json.loads(json.dumps(x[2])) for x in SEVERAL]
    was, now = ([f"{p}{drift.TYPE}{drift.type_of(v[0])}" for p, v in drift.fields_of(x).items()] for x in (lines[0], lines[2]))
    shared = {(a, b): 1.0 for a, b in WANT} | {("flag", "a_mark"): 1.0, ("mark", "the_flag"): 1.0}
    shared = {(a.replace(".", drift.SEP), b.replace(".", drift.SEP)): v for (a, b), v in shared.items()}
    renamed = lambda: {(a.replace(drift.SEP, "."), b.replace(drift.SEP, ".")) for c, a, b in drift._compare(was, now, shared) if c == "renamed"}
    assert renamed() == WANT
    monkeypatch.setattr(drift, "flood", lambda old, new, first: {})
    assert renamed() == set()  # nothing is proposed
    monkeypatch.setattr(drift, "flood", lambda old, new, first: dict.fromkeys(first, 1.0))
    assert renamed() != WANT


def test_values_refute_what_names_suggest(spark):
    lines = [(1, 1, {"price": 5, "cost": 7}), (1, 2, {"price": 6, "cost": 8}), (2, 1, {"prices": 7, "z": 5}), (2, 2, {"prices": 8, "z": 6})]
    assert found(table(spark, lines)) == {(2, "renamed", "price", "z"), (2, "renamed", "cost", "prices")}
    lines = [(1, 1, {"price": 5}), (2, 1, {"prices": 7})]
    assert found(table(spark, lines)) == {(2, "removed", "price", ""), (2, "added", "prices", "")}


def test_deep_documents(spark):
    deep = lambda n, x: "[" * n + '{"b": ' + x + "}" + "]" * n
    lines = [(1, 1, '{"v": ' + deep(12_000, "1") + ', "old": 1}'), (2, 1, '{"v": ' + deep(12_000, "1") + ', "new": 1}'), (3, 1, '{"v": ' + deep(12_000, '"x"') + ', "new": 1}')]
    got = found(table(spark, lines))
    assert got == {(2, "renamed", "old", "new"), (3, "retyped", "v.b", "")}
    rows = drift.unified(table(spark, lines), drift.changes(table(spark, lines))).collect()
    assert sorted(r.value[12_000:-12_000] for r in rows if r.name == "v.b") == ['"x"', "1", "1"] and len(rows) == 6


def test_values_at_agree_with_fields():
    docs = [{"a": [{"b": 1}, {"b": [{"c": 2}, None, {"c": [3, {"d": 4}]}]}, [{"b": None}], 5], "e": {"f": {"g": [1, [2]]}}}, {"a": {"b": {"c": 1}}, "": {"": 0}}, {}]
    for doc in docs:
        for path, values in drift.fields_of(doc).items():
            assert drift.values_at(doc, path) == values
    assert drift.values_at({"a": 1}, "b") == []
