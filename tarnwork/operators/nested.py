"""Nested records as flat tables: interval labels by depth-first traversal.

Every node of a document gets its pre-order and its post-order number; node a
holds node b if ``a.pre < b.pre and a.post > b.post``. All that is said of a
node beyond its own name and place - the path and the positions that lead to
it, whether it is an array's element, the record it lies in - comes from the
nodes whose intervals hold its own. Objects come out as rows, one table per
path, each linked to the record it lies in.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.functions.jsontext import depth_of, dump, parse
from tarnwork.runtime import SMALL, staged

#: Marks within a shape: the name before ends in an array's element, in an
#: object that is no element, and the end of a name.
ELEMENT, LONE, END = "\x01", "\x02", "\x1f"
OPENERS = ("{", "[")


def _clean(texts: list) -> pa.Array:
    try:
        return pa.array(texts, pa.string())
    except (UnicodeEncodeError, pa.ArrowInvalid):  # half of a surrogate pair, from an escape
        return pa.array([x if x is None else x.encode("utf-8", "replace").decode() for x in texts], pa.string())


def _name(k: str) -> str:
    """A field's name without the marks, so that shapes stay readable."""
    return k.translate({1: "�", 2: "�", 31: "�"})


def opened(v):
    """A value, or what a string holds if it is the text of an object or array."""
    if isinstance(v, str) and (v[:1] in OPENERS or (v[:1].isspace() and v.lstrip()[:1] in OPENERS)):
        inner = parse(v)
        return inner if isinstance(inner, dict | list) else v
    return v


def numbered(value) -> tuple[list[tuple], list[int]]:
    """The objects and arrays of a document in pre-order: the name under which
    each stands (None in an array), its place in an array (-1 in an object),
    its value and its pre number; and the post numbers. Scalars are numbered
    too, before their siblings that hold something."""
    nodes: list[tuple] = []
    posts: list[int] = []
    pre = post = 0
    todo: list = [(None, -1, value)]
    while todo:
        step = todo.pop()
        if type(step) is int:  # all below that node is done
            posts[step] = post
            post += 1
            continue
        name, place, v = step
        below = []
        if type(v) is dict:
            for k, x in v.items():
                kind = type(x)
                if kind is str and (x[:1] in OPENERS or x[:1].isspace()):
                    x = opened(x)
                    kind = type(x)
                if kind is dict or kind is list:
                    below.append((k, -1, x))
        else:
            for i, x in enumerate(v):
                kind = type(x)
                if kind is str and (x[:1] in OPENERS or x[:1].isspace()):
                    x = opened(x)
                    kind = type(x)
                if kind is dict or kind is list:
                    below.append((None, i, x))
        nodes.append((name, place, v, pre))
        scalars = len(v) - len(below)
        pre += 1 + scalars
        post += scalars
        if below:
            posts.append(-1)
            todo.append(len(nodes) - 1)
            todo += reversed(below)
        else:
            posts.append(post)
            post += 1
    return nodes, posts


def holders(posts: list[int]) -> list[int]:
    """For each node, given in pre-order by its post number, the inmost one
    whose interval holds it (-1: none)."""
    out, open_ = [], []
    for i, post in enumerate(posts):
        while open_ and posts[open_[-1]] < post:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(i)
    return out


def _rest(values: list) -> tuple[list | None, bool]:
    """An array without its objects (null in their place; None where nothing
    but nulls is left), and whether it had any."""
    if all(type(x) in (int, float, bool) for x in values):
        return values, False
    out, had = [], False
    for x in values:
        x = opened(x)
        if isinstance(x, list):
            x, below = _rest(x)
            had |= below
        elif isinstance(x, dict):
            x, had = None, True
        out.append(x)
    return (None if had and all(x is None for x in out) else out), had


def _scalars(v: dict) -> dict[str, str]:
    """Name -> text of the fields of an object that hold no object; arrays as
    JSON with null for each object in them; nulls and arrays of objects only
    left out."""
    flat = {}
    for k, x in v.items():
        kind = type(x)
        if kind is int:
            flat[k] = str(x)
        elif kind is str and not (x[:1] in OPENERS or x[:1].isspace()):
            flat[k] = x
        elif x is None or kind is dict:
            continue
        else:
            inner = opened(x)
            if isinstance(inner, list):
                rest, had = _rest(inner)
                if rest is not None:
                    flat[k] = x if kind is str and not had else dump(rest)
            elif not isinstance(inner, dict):
                flat[k] = x if kind is str else dump(x)
    return flat


def _unwound(pos: tuple | None) -> list[int]:
    out = []
    while pos is not None:
        pos, last = pos
        out.append(last)
    return out[::-1]


class Labeller:
    """Labels the documents of one record after the other and gathers rows."""

    def __init__(self, fields: bool):
        self.fields = fields
        self.arrays: set[str] = set()
        self.rows: list[tuple] = []

    def document(self, key, column: str, value) -> None:
        if not isinstance(value := opened(value), dict | list):
            return
        nodes, posts = numbered(value)
        # Of each node: its shape less the marks of arrays in arrays, and how many these are; its positions as pairs
        # of all but the last and the last; pre of the objects it lies in up to an element, inmost first.
        around: list[tuple[str, int]] = []
        poss: list[tuple | None] = []
        above: list[tuple] = []
        row_of: dict[int, int] = {}
        for i, up in enumerate(holders(posts)):
            name, place, v, pre = nodes[i]
            marks, pos, over = 0, None, ()
            if up < 0:
                shape = column
            elif name is None:
                (shape, marks), pos, over = around[up], (poss[up], place), above[up]
                marks += 1
            else:
                outer = around[up][0]
                shape, pos = f"{outer}{END}{name if name.isprintable() else _name(name)}", poss[up]
                # What an element lies in is its own record's matter.
                over = (nodes[up][3],) if outer[-1] == ELEMENT else (nodes[up][3], *above[up])
            if type(v) is list:
                if not marks:
                    self.arrays.add(shape)
            else:
                shape, marks = shape + (ELEMENT * marks if marks else LONE), 0
                if shape[-1] == LONE and up >= 0:
                    self.rows[row_of[up]][-1] = True
                row_of[i] = len(self.rows)
                self.rows.append([key, shape, _unwound(pos), pre, posts[i], dump(_scalars(v), spaced=False) if self.fields else None, over, False])
            around.append((shape, marks))
            poss.append(pos)
            above.append(over)


def label(df: DataFrame, key: str, columns: list[str], *, fields: bool = True) -> DataFrame:
    """The node table of the JSON texts in ``columns``.

    A row per object: ``key``, ``shape`` (the names on the way with marks for
    arrays and lone objects), ``pos`` (positions in the arrays on the way),
    ``pre``, ``post`` and, if asked for, ``fields`` (see :func:`_scalars`; as JSON),
    ``ups`` (pre of the objects whose intervals hold its own up to an array's
    element, inmost first) and ``holds`` (whether a lone object lies right in it).
    Arrays come out as rows with a null ``pos``, once per batch and shape.
    Only ``key`` and ``columns`` are read, so extra columns may have any name.
    Null, empty and unreadable texts give no rows; a string holding the text
    of a JSON object or array counts as that value. Documents may nest to any
    depth; n objects one in the other have paths of n names, so the rows of
    such a document grow with the square of n.
    """
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), T.StructField("shape", T.StringType()), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("pre", T.IntegerType()), T.StructField("post", T.IntegerType())])
    if fields:
        out.add("fields", T.StringType()).add("ups", T.ArrayType(T.IntegerType())).add("holds", T.BooleanType())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *texts = (c.to_pylist() for c in batch.columns)
            see = Labeller(fields)
            for name, column in zip(columns, texts, strict=True):
                for k, text in zip(keys, column, strict=True):
                    if text is None:
                        continue
                    try:
                        see.document(k, name, parse(text))
                    except RecursionError:  # only arrays in arrays, for their scalars
                        with depth_of(text):
                            see.document(k, name, parse(text))
            rows = see.rows + [(None, a, None, None, None, None, None, None) for a in sorted(see.arrays)]
            if rows:
                k, shape, pos, pre, post, flat, ups, holds = map(list, zip(*rows, strict=True))
                data = [pa.array(k, batch.schema.field(0).type), _clean(shape), pa.array(pos, pa.list_(pa.int32())), pa.array(pre, pa.int32()), pa.array(post, pa.int32())]
                if fields:
                    data += [_clean(flat), pa.array(ups, pa.list_(pa.int32())), pa.array(holds, pa.bool_())]
                yield pa.RecordBatch.from_arrays(data, names=[f.name for f in out.fields])

    return df.select(F.col(key), *(F.col(c) for c in columns)).mapInArrow(walk, out)


def _plan(shape: str, arrays: set[str]) -> tuple[str, list[int] | None, str | None, list[int] | None, int | None]:
    """Path of a shape; for each position in it the index among the given ones
    or -1 for the 0 of an array of one (None if the shape is no record); path
    and positions of the record it lies in (None: the document itself), and
    which of the objects it lies in that is (1: the inmost)."""
    steps, taken, path, plan, prefix = shape.split(END), 0, [], [], []
    parent, parent_plan, up, record = None, None, None, False
    for i, step in enumerate(steps):
        name = step.rstrip(ELEMENT + LONE)
        path.append(name)
        prefix.append(step)
        marks = step[len(name) :]
        record = marks.endswith(ELEMENT)
        for m in marks:
            if m == ELEMENT:
                plan.append(taken)
                taken += 1
            elif ".".join(path) in arrays:
                plan.append(-1)
                record = True
        if record and i < len(steps) - 1:
            parent, parent_plan, up = ".".join(path), list(plan), len(steps) - 1 - i
    return ".".join(path), plan if record else None, parent, parent_plan, up


def _small(df: DataFrame, column: str) -> bool:
    return (df.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0) <= SMALL


def resolve(nodes: DataFrame, parts: bool = False) -> DataFrame:
    """A row per shape that is a child record's: ``shape``, ``path``, ``plan``,
    ``parent_path``, ``parent_plan`` and ``up`` (see :func:`_plan`). A lone object is a record if its path
    holds an array in any row of ``nodes``; with ``parts``, one that is none
    but lies in a record has a row too, with a null ``plan``. The work is on
    distinct shapes."""
    named = F.translate(F.regexp_replace("shape", "[\x01\x02]", ""), END, ".")
    # Array of an array: the inner one's shape ends in marks, its path is the same.
    arrays = nodes.where("pos IS NULL").select(named.alias("path")).distinct()
    shapes = nodes.where("pos IS NOT NULL").select("shape").distinct()
    steps = F.split("shape", END)
    prefix = lambda i: F.regexp_replace(F.array_join(F.slice(steps, 1, i), "."), "[\x01\x02]", "")
    tried = F.filter(F.sequence(F.lit(1), F.size(steps)), lambda i: F.element_at(steps, i).endswith(LONE))
    lone = shapes.select("shape", F.explode_outer(F.transform(tried, prefix)).alias("path"))
    known = lone.join(arrays.withColumn("is_array", F.lit(True)), "path", "left").groupBy("shape").agg(F.collect_set(F.when(F.col("is_array"), F.col("path"))).alias("arrays"))

    @F.pandas_udf("path string, plan array<int>, parent_path string, parent_plan array<int>, up int")
    def planned(shape: pd.Series, arrays: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_plan(s, set(a)) for s, a in zip(shape, arrays, strict=True)], columns=["path", "plan", "parent_path", "parent_plan", "up"], dtype=object)

    return known.select("shape", planned("shape", "arrays").alias("p")).select("shape", "p.*").where("plan IS NOT NULL OR up IS NOT NULL" if parts else "plan IS NOT NULL")


def records(nodes: DataFrame, *keep: str, parts: bool = False) -> DataFrame:
    """The child records of a (written) node table: ``key``, ``path``, ``pos``
    (joined by dots) and the columns ``keep``, to which those of :func:`resolve`
    count. With ``parts`` also the lone objects within them (``pos`` is null)."""
    plans = staged(resolve(nodes, parts), "shapes")
    if _small(plans, "shape"):
        plans = F.broadcast(plans)
    return nodes.where("pos IS NOT NULL").withColumnRenamed("pos", "places").join(plans, "shape").select("key", "path", _positions("plan").alias("pos"), *keep)


def _positions(plan: str) -> Column:
    return F.array_join(F.transform(plan, lambda i: F.when(i < 0, "0").otherwise(F.element_at("places", i + 1).cast("string"))), ".")


def elements(df: DataFrame, key: str, column: str) -> DataFrame:
    """The elements of an array column as records: ``key``, ``path`` (the
    column's name), ``pos`` and ``item``; null elements keep their position."""
    items = df.select(F.col(key).alias("key"), F.posexplode(column).alias("at", "item"))
    return items.where("item IS NOT NULL").select("key", F.lit(column).alias("path"), F.col("at").cast("string").alias("pos"), "item")


def child_records(df: DataFrame, key: str, json_columns: list[str], array_columns: list[str]) -> DataFrame:
    """(key, path, pos) of every child record, each once, however often its row
    is repeated: objects that are elements of an array in a JSON column, lone
    ones where other rows have an array, and elements of the array columns.

    Null and unreadable documents, empty arrays and an empty table give none.
    """
    nodes = staged(label(df, key, json_columns, fields=False), "nodes") if json_columns else None
    parts = [records(nodes)] if nodes is not None else []
    parts += [elements(df, key, c).drop("item") for c in array_columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _map(fields: str) -> Column:
    return F.from_json(fields, "map<string,string>")


def linked(nodes: DataFrame) -> DataFrame:
    """The record table of a (written) node table: ``key``, ``path``, ``pos``,
    ``pre``, ``post``, ``column``, ``fields`` (name -> text, as JSON) and the parent's ``parent_path``,
    ``parent_pos`` and ``parent_pre`` (null: the record lies in the row itself).

    The parent is the inmost record among the objects whose intervals hold the
    child's; which of them are records is settled per distinct shape.

    Lone objects that are no records are part of the record they lie in:
    their fields stand among its ``fields`` under the names on the way joined
    by dots. Where two fields come to one name, it has a JSON array of both.
    Only records with such parts are brought together with them by a shuffle.
    """
    root = F.substring_index(F.regexp_replace("shape", "[\x01\x02]", ""), END, 1)
    parent_pre = F.when(F.col("up").isNotNull(), F.element_at("ups", F.col("up")))
    parent = ["parent_path", _positions("parent_plan").alias("parent_pos"), parent_pre.alias("parent_pre")]
    found = records(nodes, "shape", "plan", "up", "pre", "post", "fields", "holds", *parent, parts=True).withColumn("column", root)
    out = ["key", "column", "path", "pos", "pre", "post", "fields", "parent_path", "parent_pos", "parent_pre"]
    alone = found.where("plan IS NOT NULL AND NOT holds").select(*out)
    is_part = F.col("plan").isNull()
    steps = F.split(F.regexp_replace("shape", "[\x01\x02]", ""), END)
    way = F.array_join(F.slice(steps, F.size(steps) - F.col("up") + 1, F.col("up")), ".")
    named = F.transform(F.map_entries(_map("fields")), lambda e: F.struct(F.when(is_part, F.concat(way, F.lit("."), e.key)).otherwise(e.key).alias("key"), e.value.alias("value")))
    whole = F.when(~is_part, F.struct("path", "pos", "post", *(c for c in out if c.startswith("parent_"))))
    rows = found.where("plan IS NULL OR holds").select("key", "column", F.when(is_part, F.col("parent_pre")).otherwise(F.col("pre")).alias("pre"), whole.alias("r"), F.struct("pre", named.alias("named")).alias("part"))
    # The objects of one record, which were one text.
    rows = rows.groupBy("key", "column", "pre").agg(F.max("r").alias("r"), F.sort_array(F.collect_set("part")).alias("parts"))
    rows = rows.select("key", "column", "pre", "r.*", F.flatten(F.transform("parts", lambda p: p.named)).alias("named"))
    names = F.array_distinct(F.transform("named", lambda e: e.key))
    of = lambda n: F.transform(F.filter("named", lambda e: e.key == n), lambda e: e.value)
    clash = F.map_from_arrays(names, F.transform(names, lambda n: F.when(F.size(of(n)) > 1, F.to_json(of(n))).otherwise(F.element_at(of(n), 1))))
    folded = rows.withColumn("fields", F.to_json(F.when(F.size(names) < F.size("named"), clash).otherwise(F.map_from_entries("named"))))
    return alone.unionByName(folded.select(*out))


def tables(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """:func:`linked` of the JSON ``columns``, each row counted once however
    often it is repeated. The texts are shuffled for that, once; their records,
    which are larger, are not."""
    rows = df.select(key, *columns).repartition(key).dropDuplicates([key, *columns])
    return linked(staged(label(rows, key, columns), "nodes"))


def flat_table(links: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """One kind of child record as a flat table: its links and the named fields
    as text; a field whose name a link or another field has (in any case of
    letters) gets underscores behind it."""
    mine = links.where(F.col("path") == path)
    fixed = ["key", "pos", "parent_path", "parent_pos"]
    used, out = {c.lower() for c in [*fixed, "id"]}, []
    for c in columns:
        name = c
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(F.col("__map").getItem(c).alias(name))
    return mine.withColumn("__map", _map("fields")).select(*fixed, *out)


def kinds_of(links: DataFrame) -> DataFrame:
    """The columns of each table of records: ``path``, ``name``, ``records`` that have it."""
    return links.select("path", F.explode(F.json_object_keys("fields")).alias("name")).groupBy("path", "name").agg(F.count(F.lit(1)).alias("records"))


def write_tables(links: DataFrame, folder: str) -> list[str]:
    """Every kind of record as a parquet table of its own below ``folder``, in
    one pass per kind over the (written) links; the paths written."""
    paths: dict[str, list[str]] = {}
    for r in kinds_of(links).orderBy("path", "name").collect():  # names of fields
        paths.setdefault(r["path"], []).append(r["name"])
    for r in links.select("path").distinct().collect():
        paths.setdefault(r["path"], [])
    for path, names in paths.items():
        flat_table(links, path, names).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{quote(path, safe='')}")
    return sorted(paths)
