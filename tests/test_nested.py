import json
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import nested
from tarnwork.plans.problems import QUERIES
from tests.conftest import DATA


sys.setrecursionlimit(50_000)


def load(v):
    if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
        try:
            w = json.loads(v)
        except ValueError:
            return v
        return w if isinstance(w, dict | list) else v
    return v


def brute(rows):
    """Child records of (id, {column: text}) by plain recursion."""
    arrays, out = set(), set()

    def scan(v, p):
        v = load(v)
        if isinstance(v, list):
            arrays.add(p)
            for x in v:
                scan(x, p)
        elif isinstance(v, dict):
            for k, x in v.items():
                scan(x, f"{p}.{k}")

    def go(i, v, p, pos, element):
        v = load(v)
        if isinstance(v, list):
            for n, x in enumerate(v):
                go(i, x, p, [*pos, n], True)
        elif isinstance(v, dict):
            if not element and p in arrays:
                pos, element = [*pos, 0], True
            if element:
                out.add((i, p, ".".join(map(str, pos))))
            for k, x in v.items():
                go(i, x, f"{p}.{k}", pos, False)

    for f in (lambda i, c, v: scan(v, c), lambda i, c, v: go(i, v, c, [], False)):
        for i, docs in rows:
            for c, text in docs.items():
                if (v := nested.parse(text)) is not None:
                    f(i, c, v)
    return out


CASES = [
    '{"a": [{"b": [{"c": 1}, null, {"c": 2}]}, {"b": []}]}',
    '{"a": {"b": {"c": 3}}}',
    '{"a": "[{\\"b\\": [{\\"c\\": 4}]}]", "note": "{see below}"}',
    '{"a": [[{"x": 1}, {"x": 2}], [{"x": 3}]], "d": {"e": [{"f": {"g": [{}]}}]}}',
    '{"a": null, "b.c": [{"z": 1}], "": [{"y": 1}]}',
    '{"a": ["{\\"b\\": 1}", "text", 5, true]}',
    "[{\"top\": 1}]",
    '{"d": {"e": {"f": 1}}}',
    "not json", "", None, "null", "7", '"text"',
    '{"s": "\\ud800", "k": [{"u": 1}]}',
    '{"a": ' + "[" * 5000 + "]" * 5000 + "}",
    '{"a": ' + "[" * 12_000 + '{"b": [{"c": 1}]}' + "]" * 12_000 + "}",
    '{"o": ' * 200 + '[{"u": 1}]' + "}" * 200,
    '{"long": [{"t": "' + "x" * 200_000 + '"}]}',
]


def test_child_records_match_brute_force(spark):
    rows = [(i, c) for i, c in enumerate(CASES)] + [(0, CASES[0])]
    df = spark.createDataFrame(rows, "id long, args string").withColumn("shape", F.lit("clash")).withColumn("key", F.lit(1))
    got = [tuple(r) for r in nested.child_records(df, "id", ["args"], []).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([(i, {"args": c}) for i, c in rows])


def test_job_rows_match_brute_force(spark):
    df = spark.read.parquet(str(DATA / "sf0.001/job_row.parquet"))
    rows = [(r.id, {"args": r.args, "metadata": r.metadata}) for r in df.select("id", "args", "metadata").distinct().collect()]
    got = {tuple(r) for r in nested.child_records(df, "id", ["args", "metadata"], []).collect()}
    assert got == brute(rows)


def test_array_columns_keep_positions(spark):
    df = spark.createDataFrame([(1, [("a",), None, ("b",)]), (2, None), (3, []), (1, [("a",), None, ("b",)])], "id long, errors array<struct<error:string>>")
    got = sorted(tuple(r) for r in nested.child_records(df, "id", [], ["errors"]).collect())
    assert got == [(1, "errors", "0"), (1, "errors", "2")]


def test_intervals_link_parents(spark):
    df = spark.createDataFrame([(1, CASES[0]), (1, CASES[0]), (2, CASES[1]), (3, CASES[3])], "id long, args string")
    rows = nested.tables(df, "id", ["args"]).collect()
    by = {(r.key, r.path, r.pos): r for r in rows}
    assert len(rows) == len(by)
    assert by[1, "args.a.b", "0.2"].parent_path == "args.a" and by[1, "args.a.b", "0.2"].parent_pos == "0"
    assert json.loads(by[1, "args.a.b", "0.2"].fields) == {"c": "2"}
    assert by[2, "args.a.b", "0.0"].parent_pos == "0" and by[2, "args.a", "0"].parent_path is None
    for r in rows:
        if r.parent_path:
            up = by[r.key, r.parent_path, r.parent_pos]
            assert up.pre < r.pre and up.post > r.post
    links = nested.tables(df, "id", ["args"])
    table = nested.flat_table(links, "args.a.b", ["c", "none"]).collect()
    assert {(r.key, r.pos, r.c, r.none) for r in table} == {(1, "0.0", "1", None), (1, "0.2", "2", None), (2, "0.0", "3", None)}


def leaves(v):
    """The scalars other than null anywhere in a value, as texts."""
    v = load(v)
    if isinstance(v, dict | list):
        return [x for y in (v.values() if isinstance(v, dict) else v) for x in leaves(y)]
    return [] if v is None else [v if isinstance(v, str) else json.dumps(v)]


LONE = [
    '{"a": [{"b": {"c": 1, "d": {"e": "x", "n": null}, "g": [2, 3]}, "h": 4}, {"b": {}}]}',
    '{"a": [{"m": [5, {"k": 6}, [7, {"k": 8}], null], "s": "[9, {\\"k\\": 10}]", "t": "{\\"u\\": 11}"}]}',
    '{"a": [{"p": {"q": {"z": 12}}, "b.c": 13, "b": {"c": 14}}]}',
    '{"a": [{"p": {"q": [{"z": 15, "y": {"w": true}}]}}]}',
]


def test_every_scalar_below_a_record_comes_out(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(LONE)] + [(0, LONE[0])], "id long, args string")
    rows = nested.tables(df, "id", ["args"]).collect()
    for i, doc in enumerate(LONE):
        got = [x for r in rows if r.key == i for v in json.loads(r.fields).values() for x in leaves(v)]
        assert sorted(got) == sorted(leaves(doc))
    by = {(r.key, r.path, r.pos): json.loads(r.fields) for r in rows}
    assert by[0, "args.a", "0"] == {"b.c": "1", "b.d.e": "x", "b.g": "[2, 3]", "h": "4"} and by[0, "args.a", "1"] == {}
    assert by[1, "args.a", "0"] == {"m": "[5, null, [7, null], null]", "s": "[9, null]", "t.u": "11"}
    assert by[2, "args.a", "0"] == {"b.c": '["13","14"]'} and by[2, "args.a.p.q", "0.0"] == {"z": "12"}
    assert by[3, "args.a.p.q", "0.0"] == {"z": "15", "y.w": "true"}


def test_tables_hold_every_scalar_of_job_rows(spark):
    def below(v, p, arrays, inside):
        v = load(v)
        if isinstance(v, list):
            return [x for y in v for x in below(y, p, arrays, inside or isinstance(load(y), dict))]
        if isinstance(v, dict):
            return [x for k, y in v.items() for x in below(y, f"{p}.{k}", arrays, inside or p in arrays)]
        return leaves(v) if inside else []

    def scan(v, p, arrays):
        v = load(v)
        if isinstance(v, list):
            arrays.add(p)
        for k, x in v.items() if isinstance(v, dict) else ((None, x) for x in v) if isinstance(v, list) else ():
            scan(x, p if k is None else f"{p}.{k}", arrays)

    small = str(DATA / "sf0.001")
    docs = [(c, nested.parse(r[c])) for r in spark.read.parquet(f"{small}/job_row.parquet").select("id", "args", "metadata").distinct().collect() for c in ("args", "metadata")]
    arrays: set = set()
    for c, v in docs:
        scan(v, c, arrays)
    want = Counter(x for c, v in docs for x in below(v, c, arrays, False))
    got = Counter(x for r in QUERIES["p4_tables"](spark, small).collect() for v in json.loads(r.fields or "{}").values() for x in leaves(v))
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "id long, args string, errors array<struct<error:string>>")
    assert nested.child_records(df, "id", ["args"], ["errors"]).count() == 0
    assert nested.tables(df, "id", ["args"]).count() == 0


@pytest.mark.parametrize(("shape", "arrays", "want"), [("args\x02\x1fa\x01\x1fb\x02", set(), ("args.a.b", None, "args.a", [0], 1)), ("args\x02\x1fa\x02", {"args.a"}, ("args.a", [-1], None, None, None)), ("args\x02\x1fa\x01\x01", set(), ("args.a", [0, 1], None, None, None)), ("args\x02\x1fa\x02\x1fb\x02\x1fc\x01", {"args.a"}, ("args.a.b.c", [-1, 0], "args.a", [-1], 2))])
def test_plan_of_a_shape(shape, arrays, want):
    assert nested._plan(shape, arrays) == want


def labelled(doc):
    see = nested.Labeller(True)
    see.document(1, "args", json.loads(doc))
    return see


def test_intervals_nest_and_hold():
    nodes, posts = nested.numbered(json.loads(CASES[3]))
    up = nested.holders(posts)
    for i, (_, _, _, pre) in enumerate(nodes):
        held_by = [j for j, (_, _, _, p) in enumerate(nodes) if p < pre and posts[j] > posts[i]]
        assert up[i] == (held_by[-1] if held_by else -1)
    numbers = sorted(n[3] for n in nodes)
    assert len(set(numbers)) == len(numbers) == len(set(posts))


def test_records_come_from_the_intervals(monkeypatch):
    """Paths, positions and parents are found through the labels alone."""
    whole = labelled(CASES[0]).rows
    assert sum(r[1].endswith(nested.ELEMENT) for r in whole) == 4
    real = nested.numbered
    monkeypatch.setattr(nested, "numbered", lambda v: (real(v)[0], [0] * len(real(v)[1])))
    assert [r[1:3] for r in labelled(CASES[0]).rows] != [r[1:3] for r in whole]
    monkeypatch.setattr(nested, "holders", lambda posts: [-1] * len(posts))
    off = labelled(CASES[0]).rows
    assert not any(r[1].endswith(nested.ELEMENT) or r[2] or r[6] for r in off)


def test_every_kind_is_written_as_a_table(spark, tmp_path):
    df = spark.createDataFrame([(1, CASES[0]), (2, CASES[1]), (3, '{"a": [{"Key": 1, "key": 2, "pos": 3, "pos_": 4}]}')], "id long, args string")
    links = nested.tables(df, "id", ["args"])
    assert nested.write_tables(links, str(tmp_path / "out")) == ["args.a", "args.a.b"]
    b = spark.read.parquet(str(tmp_path / "out" / "args.a.b"))
    assert sorted((r.key, r.pos, r.parent_pos, r.c) for r in b.collect()) == [(1, "0.0", "0", "1"), (1, "0.2", "0", "2"), (2, "0.0", "0", "3")]
    a = spark.read.parquet(str(tmp_path / "out" / "args.a")).where("key = 3").first().asDict()
    assert len(a) == 9 and sorted(v for k, v in a.items() if k.rstrip("_").lower() in ("key", "pos") and k not in ("key", "pos")) == ["1", "2", "3", "4"]
