"""Schemas that drift between files: one table, and a list of every change.

Schema graphs of each file and the one before it (nodes: fields and types;
edges: field to field it holds, field to type) are matched by similarity
flooding: the score of a pair of nodes spreads to the pairs that are reached
by edges of the same label, until the scores settle. From the scores of fields
that have gone and fields that have come a consistent set of correspondences
is picked; the records written in both files confirm or refute each, and what
is refuted is struck out and the rest flooded again.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.jsontext import depth_of, dump, parse
from tarnwork.runtime import SMALL, spread, staged

#: End of a name within a path while paths are compared (names may hold dots),
#: and what stands between a path and a type.
SEP, TYPE = "\x1f", "\x1e"
#: Changed files that a task compares.
FILES = 50


def type_of(v) -> str:
    """string, number, boolean, array or object."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, int | float):
        return "number"
    return "array" if isinstance(v, list) else "object"


def _digest(values: list) -> int:
    """64 bits that are equal for equal values, whatever the order of keys."""
    if len(values) == 1 and isinstance(values[0], str):
        return xxhash.xxh64_intdigest(values[0].encode("utf-8", "surrogatepass")) - (1 << 63)
    text = dump(values, sort_keys=True, ensure_ascii=True, spaced=False)
    return xxhash.xxh64_intdigest(text, seed=1) - (1 << 63)


def fields_of(doc: dict) -> dict[str, list]:
    """Path -> its values other than null, in order, arrays' positions left out."""
    out: dict[str, list] = defaultdict(list)
    stack = [("", doc, False)]
    while stack:
        path, v, element = stack.pop()
        if path and not element and v is not None:
            out[path].append(v)
        if isinstance(v, dict):
            stack += [(f"{path}{SEP}{k}" if path else k, x, False) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(path, x, True) for x in reversed(v) if isinstance(x, dict | list)]
    return out


def values_at(doc: dict, path: str) -> list:
    """The values of one field of :func:`fields_of`, found along its names."""
    found, names = [doc], path.split(SEP)
    for n, name in enumerate(names):
        held = []
        for v in found:
            if isinstance(v, dict) and v.get(name) is not None:
                held.append(v[name])
        found = held
        if n < len(names) - 1:  # on the way, arrays stand for their elements
            todo, found = found[::-1], []
            while todo:
                v = todo.pop()
                if isinstance(v, list):
                    todo += [x for x in reversed(v) if isinstance(x, dict | list)]
                else:
                    found.append(v)
    return found


@dataclass(frozen=True)
class Series:
    """Where things stand: columns that name a series of files, the file's
    number within it, the record's key and its JSON text."""

    series: list[str] = field(default_factory=lambda: ["archiver", "kind"])
    file: str = "file_no"
    key: str = "job_id"
    text: str = "args"


def _lines(df: DataFrame, at: Series) -> DataFrame:
    """The columns ``s0``.. (series), ``file``, ``key`` and ``text``; others aren't read."""
    return df.select(*(F.col(c).alias(f"s{i}") for i, c in enumerate(at.series)), F.col(at.file).cast("int").alias("file"), F.col(at.key).alias("key"), F.col(at.text).cast("string").alias("text")).where("file IS NOT NULL")


def _ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def schemas(df: DataFrame, at: Series = Series()) -> DataFrame:
    """A row per file: ``s0``.., ``file`` and ``fields``, the sorted list of its
    paths, each once per type it has there. A file without a line that is a
    JSON object has no row. A batch of lines gives each field of a file once."""
    src = _lines(df, at).drop("key")
    s = [f"s{i}" for i in range(len(at.series))]
    cols = [*s, "file"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, dict[str, None]] = {}
            first: dict[tuple, int] = {}
            *names, texts = (c.to_pylist() for c in batch.columns)
            for i, (of, text) in enumerate(zip(zip(*names, strict=True), texts, strict=True)):
                doc = parse(text)
                if not isinstance(doc, dict):
                    continue
                mine = seen.setdefault(of, {"": None})
                first.setdefault(of, i)
                stack: list[tuple] = [("", doc, False)]
                while stack:
                    path, v, element = stack.pop()
                    if path and not element:
                        mine[f"{path}{TYPE}{type_of(v)}"] = None
                    if isinstance(v, dict):
                        stack += [(f"{path}{SEP}{k}" if path else k, x, False) for k, x in v.items() if x is not None]
                    elif isinstance(v, list):
                        stack += [(path, x, True) for x in v if isinstance(x, dict | list)]
            where = pa.array([first[of] for of, mine in seen.items() for _ in mine], pa.int64())
            found = pa.array([_clean(x) for mine in seen.values() for x in mine], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in range(len(cols))), found], names=[*cols, "found"])

    rows = src.mapInArrow(run, f"{_ddl(src, cols)}, found string")
    return rows.groupBy(*cols).agg(F.array_sort(F.collect_set("found")).alias("fields"))  # as many as a schema has fields


# --- similarity flooding -----------------------------------------------------


def _name_score(a: str, b: str) -> float:
    """Likeness of two names: shared pairs of letters, case aside."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (f"^{a}$", f"^{b}$"))
    return 2 * len(x & y) / max(1, len(x) + len(y))


def _edges(types: dict[str, set[str]]) -> list[tuple[str, str, str]]:
    """Edges (from, label, to) of a schema graph; the root is the empty path."""
    out = []
    for path, kinds in types.items():
        out.append((path.rpartition(SEP)[0], "holds", path))
        out += [(path, "type", f"\x00{t}") for t in sorted(kinds)]
    return out


def flood(old: dict[str, set[str]], new: dict[str, set[str]], first: dict[tuple[str, str], float], *, rounds: int = 100, least: float = 1e-4) -> dict[tuple[str, str], float]:
    """Scores of pairs of nodes of two schemas (path -> types) after similarity
    flooding from the ``first`` scores; each round adds what flows in over
    edges of the same label to the first and the last score and divides by the
    largest, until no score moves by more than ``least``."""
    pairs: dict[tuple[str, str], int] = {}
    flows: list[tuple[int, int]] = []
    by_label: dict[str, list] = defaultdict(list)
    for a, label, b in _edges(new):
        by_label[label].append((a, b))
    # Only pairs at the same depth can meet, so edges are indexed by label and depth.
    depth = lambda p: p.count(SEP) + bool(p)
    at: dict[tuple[str, int], list] = defaultdict(list)
    for label, edges in by_label.items():
        for a, b in edges:
            at[label, depth(a)].append((a, b))
    for a, label, b in _edges(old):
        for c, e in at[label, depth(a)]:
            if label == "type" and b != e:
                continue
            x, y = (pairs.setdefault(p, len(pairs)) for p in ((a, c), (b, e)))
            flows.append((x, y))
    for p in first:
        pairs.setdefault(p, len(pairs))
    start = np.zeros(len(pairs))
    for p, i in pairs.items():
        start[i] = first.get(p, 1.0 if p[0] == p[1] else 0.0)
    if not flows:
        return {p: float(start[i]) for p, i in pairs.items()}
    x, y = np.array(flows).T
    down = 1.0 / np.bincount(x, minlength=len(pairs))[x]  # a node's score is shared among its edges, both ways
    up = 1.0 / np.bincount(y, minlength=len(pairs))[y]
    score = start.copy()
    for _ in range(rounds):
        flow = start + score
        grown = flow + np.bincount(y, flow[x] * down, len(pairs)) + np.bincount(x, flow[y] * up, len(pairs))
        grown /= max(grown.max(), 1e-12)
        moved, score = float(np.abs(grown - score).max()), grown
        if moved <= least:
            break
    return {p: float(score[i]) for p, i in pairs.items()}


def matches(old: dict[str, set[str]], new: dict[str, set[str]], gone: list[str], come: list[str], shared: dict[tuple[str, str], float], refuted: set[tuple[str, str]] = frozenset()) -> list[tuple[str, str]]:
    """Correspondences between fields that are gone and ones that have come:
    one to one, best flooded score first; ``refuted`` pairs are struck out.

    What is known before the flooding: likeness of names and types of fields at
    one depth, and of all gone and come ones, which may move to another; and
    ``shared``, the share of the old field's values that stand under the new
    one in records of both files (values are nodes of the graph, too, taken
    together), which weighs twice as much as name and type.
    """
    first = {}
    moved = {(a, b) for a in gone for b in come}
    for a in old:
        for b in new:
            if a.count(SEP) == b.count(SEP) or (a, b) in moved:
                first[a, b] = 0.5 * _name_score(a.rpartition(SEP)[2], b.rpartition(SEP)[2]) + 0.2 * bool(old[a] & new[b])
    for p, s in shared.items():
        first[p] = first.get(p, 0.0) + 2.0 * s
    for p in refuted:
        first[p] = 0.0
    score = flood(old, new, {p: s / 2.7 for p, s in first.items()})
    order = sorted(((score.get((a, b), 0.0), a, b) for a, b in moved - set(refuted)), key=lambda t: (-t[0], t[1], t[2]))
    out, used = [], set()
    for s, a, b in order:
        if s > 0 and ("old", a) not in used and ("new", b) not in used:
            used |= {("old", a), ("new", b)}
            out.append((a, b))
    return out


# --- changes -----------------------------------------------------------------


def _topmost(paths: set[str], cases: set[str]) -> list[str]:
    def under(p: str) -> bool:
        while SEP in p:
            p = p.rpartition(SEP)[0]
            if p in cases:
                return True
        return False

    return sorted(p for p in paths if not under(p))


def _schema(fields: list[str]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for f in fields:
        path, _, kind = f.rpartition(TYPE)
        if path or kind:
            out.setdefault(path, set()).add(kind)
    return out


def _outline(was: list[str], now: list[str]) -> tuple[dict, dict, list[str], list[str], list[str]]:
    """Both schemas and the topmost fields gone, come and retyped."""
    old, new = _schema(was), _schema(now)
    retyped = {p for p in old.keys() & new.keys() if new[p] - old[p]}
    cases = (old.keys() ^ new.keys()) | retyped
    return old, new, _topmost(old.keys() - new.keys(), cases), _topmost(new.keys() - old.keys(), cases), _topmost(retyped, cases)


def _compare(was: list[str], now: list[str], shared: dict[tuple[str, str], float]) -> list[tuple[str, str, str]]:
    """The changes between two files. Flooding proposes which gone field is
    which that has come; a proposal that not all values bear out is refuted,
    and the flooding is run again without it, until none is left."""
    old, new, gone, come, retyped = _outline(was, now)
    out, refuted = [], set()
    while gone and come:
        held = matches(old, new, gone, come, shared, refuted)
        agreed = [p for p in held if shared.get(p, 0.0) >= 1.0]
        out += [("renamed", a, b) for a, b in agreed]
        from_, to = {a for a, _ in agreed}, {b for _, b in agreed}
        gone, come = [p for p in gone if p not in from_], [p for p in come if p not in to]
        refuted |= set(held) - set(agreed)
        if not held:
            break
    out += [("removed", p, "") for p in gone] + [("added", p, "") for p in come]
    return out + [("retyped", p, "") for p in retyped]


def _same(columns: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _broadcastable(df: DataFrame) -> bool:
    """Whether a (written) table with an ``bytes`` column is small enough to broadcast."""
    return (df.agg(F.sum("bytes")).first()[0] or 0) <= SMALL


def _shares(df: DataFrame, steps: DataFrame, at: Series) -> DataFrame:
    """(step, shared): of each changed file with fields both gone and come, the
    shares of the values of the gone ones that stand under each that has come,
    in records of both files. Only lines of such files, and only such fields,
    are looked at."""
    s = [f"s{i}" for i in range(len(at.series))]

    def wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                _, _, gone, come, _ = _outline(r["was"], r["fields"])
                if gone and come:
                    rows += [(*(r[c] for c in s), f, r["step"], role, names) for f, role, names in ((r["before"], 0, gone), (r["file"], 1, come))]
            yield pd.DataFrame(rows, columns=[*s, "file", "step", "role", "paths"]).astype({"file": "int32", "step": "int64", "role": "int32"})

    wants = steps.select(*s, "file", "before", "step", "was", "fields").mapInPandas(wanted, f"{_ddl(steps, s)}, file int, step bigint, role int, paths array<string>")
    # A row per file and role, with all it is asked for; a file is looked at once for each side it is on.
    wants = staged(wants.withColumn("bytes", F.octet_length(F.concat_ws("", "paths")) + 64), "wants")
    lines = _lines(df, at).where("key IS NOT NULL AND text IS NOT NULL").alias("l")
    asked = (F.broadcast(wants) if _broadcastable(wants) else wants).alias("w")
    asked = lines.join(asked, _same([*s, "file"], "l", "w")).select("w.step", "w.role", "w.paths", "l.key", "l.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, found, digests = [], [], []
            _, roles, paths, _, texts = (c.to_pylist() for c in batch.columns)
            for i, (role, names, text) in enumerate(zip(roles, paths, texts, strict=True)):
                doc = parse(text)
                if not isinstance(doc, dict):
                    continue
                if role:  # the record is there, whatever it holds
                    line.append(i)
                    found.append("")
                    digests.append(0)
                for p in names:
                    values = values_at(doc, p)
                    if values:
                        line.append(i)
                        found.append(p)
                        digests.append(_digest(values))
            where = pa.array(line, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in (0, 1, 3)), pa.array(found, pa.string()), pa.array(digests, pa.int64())], names=["step", "role", "key", "path", "digest"])

    seen = asked.mapInArrow(run, f"step bigint, role int, key {dict(asked.dtypes)['key']}, path string, digest bigint")
    # One shuffle brings a record's values of both files together; the sets hold names of fields.
    of = lambda role: F.collect_set(F.when(F.col("role") == role, F.col("path")))
    met = seen.repartition("step", "key").groupBy("step", "key", "digest").agg(of(0).alias("was"), of(1).alias("now"))
    met = met.withColumn("there", F.max(F.array_contains("now", "")).over(Window.partitionBy("step", "key"))).where("there")
    pairs = met.select("step", F.explode("was").alias("gone"), F.col("now")).select("step", "gone", F.explode(F.concat(F.array(F.lit("")), F.array_remove("now", ""))).alias("come"))
    n = pairs.groupBy("step", "gone", "come").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("step").agg(F.collect_list(F.struct("gone", "come", "n")).alias("shared"))  # pairs of fields of two schemas


def changes(df: DataFrame, at: Series = Series()) -> DataFrame:
    """Every change of a field between a file and the nearest earlier one of
    its series: the series' columns, the file's number, ``change`` (added,
    removed, renamed, retyped), ``field`` and ``new_field`` ('' unless renamed).

    A file counts if it has a line that is a JSON object. Null series form a
    series; lines with a null file number are passed over, ones with a null
    key count for the schema but are no record of two files. Repeated lines
    change nothing, of two differing lines with one key both count. Documents
    may nest to any depth. An empty table gives an empty result. A file
    compared is bounded by the fields of two schemas, never by lines.
    """
    s = [f"s{i}" for i in range(len(at.series))]
    files = schemas(df, at)
    last = Window.partitionBy(*s).orderBy("file")
    steps = files.withColumns({"before": F.lag("file").over(last), "was": F.lag("fields").over(last)})
    # Most files have the schema of the one before; only the others are looked into.
    steps = staged(steps.where("before IS NOT NULL AND was != fields").withColumn("step", F.monotonically_increasing_id()), "steps")
    whole = spread(steps, FILES).join(_shares(df, steps, at), "step", "left")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                n = {(x["gone"], x["come"]): x["n"] for x in r["shared"]} if r["shared"] is not None else {}
                shared = {p: m / n[p[0], ""] for p, m in n.items() if p[1]}
                rows += [(*(r[c] for c in s), r["file"], c, a.replace(SEP, "."), b.replace(SEP, ".")) for c, a, b in _compare(r["was"], r["fields"], shared)]
            yield pd.DataFrame(rows, columns=[*s, "file", "change", "field", "new_field"]).astype({"file": "int32"})

    found = whole.select(*s, "file", "was", "fields", "shared").mapInPandas(compare, f"{_ddl(steps, s)}, file int, change string, field string, new_field string")
    return found.select(*(F.col(c).alias(a) for c, a in zip(s, at.series, strict=True)), F.col("file").alias(at.file), "change", "field", "new_field")


# --- one table ---------------------------------------------------------------


class Raw(float):
    """A number with its text, so that no digit is lost."""

    def __new__(cls, text: str):
        out = super().__new__(cls, text)
        out.text = text
        return out


def _text(v) -> str:
    """JSON of a value, its numbers as they were written."""
    return dump(v, spaced=False, scalar=lambda x: x.text if isinstance(x, Raw) else None)


def _hollow(v) -> bool:
    """An array of nulls, or of such arrays, only."""
    todo = [v]
    while todo:
        x = todo.pop()
        if not isinstance(x, list) or not x:
            return False
        todo += [y for y in x if y is not None]
    return True


def leaves_of(v, path: str = "") -> dict[str, object]:
    """Path -> value of all that is no object. What lies in an array's objects
    stands under its own path as an array, with null at the places of elements
    that lack it; the array itself is there for its other elements (null for
    objects), or if it holds nothing else. Nulls are left out; an object of
    nothing stands for itself."""
    if isinstance(v, dict):
        out: dict[str, object] = {}
        for k, x in v.items():
            out.update(leaves_of(x, f"{path}{SEP}{k}" if path else k))
        return out or ({path: {}} if path and not v else {})
    if isinstance(v, list) and any(isinstance(x, dict | list) for x in v):
        parts = [leaves_of(x, path) if isinstance(x, dict | list) else {path: x} for x in v]
        names = dict.fromkeys(p for part in parts for p in part)
        out = {p: [part.get(p) for part in parts] for p in names}
        if _hollow(out.get(path)) and len(out) > 1:
            del out[path]
        return out or {path: [None] * len(v)}
    return {} if v is None else {path: v}


def current_path(path: str, file: int, renames: list[tuple[int, str, str]]) -> str:
    """The newest name of a field that a file has as ``path``: each later file's
    renames (in order) are applied once, to the field or an object it lies in.
    Names are compared as :func:`changes` writes them, joined by dots."""
    done = file
    for at, old, new in renames:
        if at > done and (path == old or path.startswith(old + ".")):
            path, done = new + path[len(old) :], at
    return path


def unified(df: DataFrame, found: DataFrame, at: Series = Series(), *, keep: list[str] = ()) -> DataFrame:
    """All lines as one table: the series' columns, file, key, ``keep``, and a
    row per field, nested ones included, under its current name (joined by
    dots): ``name``, ``type`` and ``value`` (text; JSON for arrays, see
    :func:`leaves_of`). All renames of ``found`` are applied, moves into and
    out of objects too. The work per series is bounded by its renames."""
    cols = [*at.series, at.file, at.key, *keep]
    lines = df.where(F.col(at.file).isNotNull()).select(*cols, F.col(at.text).cast("string").alias("__text")).distinct()
    entry = F.struct(F.col(at.file).cast("int").alias("file"), "field", "new_field")
    names = found.where("change = 'renamed'").groupBy(*(F.col(c).alias(f"__s{i}") for i, c in enumerate(at.series))).agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("__renames"))
    names = staged(names, "names")
    small = (names.agg(F.sum(F.octet_length("__renames") + 64)).first()[0] or 0) <= SMALL
    on = [F.col(c).eqNullSafe(F.col(f"__s{i}")) for i, c in enumerate(at.series)]
    src = lines.join(F.broadcast(names) if small else names, on, "left").select(*cols, F.col(at.file).cast("int").alias("__file"), "__renames", "__text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields[: len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, paths, types, values = [], [], [], []
            steps: dict = {None: []}
            current: dict = {}
            for i, (file, renames, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True)):
                doc = parse(text, Raw)
                if not isinstance(doc, dict):
                    continue
                try:
                    leaves = leaves_of(doc)
                except RecursionError:
                    with depth_of(text):
                        leaves = leaves_of(doc)
                fields = {p: (type_of(v), v if isinstance(v, str) else _text(v)) for p, v in leaves.items()}
                if renames not in steps:
                    steps[renames] = [(r["file"], r["field"], r["new_field"]) for r in json.loads(renames)]
                for p, (kind, value) in fields.items():
                    if (file, renames, p) not in current:
                        current[file, renames, p] = current_path(_clean(p.replace(SEP, ".")), file, steps[renames])
                    line.append(i)
                    paths.append(current[file, renames, p])
                    types.append(kind)
                    values.append(_clean(value))
            where = pa.array(line, pa.int64())
            given = [batch.column(c).take(where) for c in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*given, *(pa.array(x, pa.string()) for x in (paths, types, values))], names=[*cols, "name", "type", "value"])

    return src.mapInArrow(run, f"{kinds}, name string, type string, value string")


def columns_of(rows: DataFrame, at: Series = Series()) -> DataFrame:
    """The consistent columns per kind (the last series column): ``name`` and
    the ``type`` all its values can be cast to: bigint, double, boolean, else string."""
    kind = at.series[-1]
    long, double, boolean = (F.expr(f"try_cast(value AS {t}) IS NOT NULL") for t in ("bigint", "double", "boolean"))
    flag = rows.groupBy(kind, "name").agg(F.every(F.col("value").rlike("^-?[0-9]+$") & long).alias("l"), F.every(F.col("value").rlike("^-?[0-9.eE+-]+$") & double).alias("d"), F.every(F.col("value").isin("true", "false") & boolean).alias("b"), F.count(F.lit(1)).alias("n"))
    return flag.select(kind, "name", F.when(F.col("l"), "bigint").when(F.col("d"), "double").when(F.col("b"), "boolean").otherwise("string").alias("type"), "n")


def kind_table(rows: DataFrame, columns: dict[str, str], kind: str, at: Series = Series(), *, keep: list[str] = ()) -> DataFrame:
    """The table of one kind with the given columns (name -> type), cast."""
    cols = [*at.series, at.file, at.key, *keep]
    mine = rows.where(F.col(at.series[-1]) == kind).groupBy(*cols).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    return mine.select(*cols, *(F.col("m").getItem(c).try_cast(t).alias(c) for c, t in columns.items()))


def cast_lines(rows: DataFrame, columns: DataFrame, at: Series = Series(), *, keep: list[str] = ()) -> DataFrame:
    """:func:`unified` rows as one row per line: ``line`` is a JSON object of all
    its fields in the order of their names, each cast to the type its column
    has in the whole of its kind (``columns``, see :func:`columns_of`)."""
    kind, cols = at.series[-1], [*at.series, at.file, at.key, *keep]
    types = columns.select(F.col(kind).alias("__kind"), F.col("name").alias("__name"), F.col("type").alias("__cast"))
    types = staged(types.withColumn("bytes", F.octet_length("__name") + F.coalesce(F.octet_length(F.col("__kind").cast("string")), F.lit(0)) + 64), "types")
    types = (F.broadcast(types) if _broadcastable(types) else types).drop("bytes")
    met = rows.join(types, F.col(kind).eqNullSafe(F.col("__kind")) & (F.col("name") == F.col("__name")))
    plain = F.col("__cast").isin("bigint", "boolean") | (F.col("type").isin("array", "object"))
    text = F.when(F.col("__cast") == "double", F.to_json(F.array(F.col("value").try_cast("double")))).when(plain, F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(F.to_json(F.array("value")))
    pair = F.concat(F.expr("substr(to_json(array(name)), 2, length(to_json(array(name))) - 2)"), F.lit(":"), F.expr("substr(__text, 2, length(__text) - 2)"))
    lines = met.withColumn("__text", text).withColumn("__pair", F.struct("name", pair.alias("pair")))
    return lines.groupBy(*cols).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list("__pair")), lambda p: p.pair), ","), F.lit("}")).alias("line"))
