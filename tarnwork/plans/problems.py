"""Queries p1_, p3_ and p4_ over the job tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.model import STATES
from tarnwork.operators import drift, nested
from tarnwork.operators import tree_agg as tree
from tarnwork.runtime import staged
from tarnwork.sources import distinct_rows, table

#: A chunk's rows, the merges per round, and the least rounds, of the queries below.
TREE = {"chunk_rows": 65_536, "fan_in": 16, "rounds": 2}


def tree_for(rows: int) -> dict[str, int]:
    """:data:`TREE` with the rounds that ``rows`` rows need, so that no chunks share a leaf for want of leaves."""
    return TREE | {"rounds": max(TREE["rounds"], tree.rounds_for(rows, TREE["chunk_rows"], TREE["fan_in"]))}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of queue and kind that hold 3 in 100 of the jobs or more."""
    rows = table(spark, d, "job_row")
    jobs = distinct_rows(rows, "id", "queue", "kind")
    # Two rows of the tree, its queue and its kind, a job.
    return tree.frequent_values(jobs, ["queue", "kind"], 0.03, **tree_for(2 * rows.count()))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by state and times per queue and per kind, for every value."""
    rows = table(spark, d, "job_row")
    jobs = distinct_rows(rows, "id", "queue", "kind", "state", "attempt", "attempted_at", "scheduled_at")
    measures = {"n": tree.Measure("count", F.lit(1))}
    measures |= {f"n_{s}": tree.Measure("count", F.when(F.col("state") == s, 1)) for s in STATES}
    measures |= {
        "attempts": tree.Measure("sum", F.col("attempt").cast("long")),
        "last_attempted_at": tree.Measure("max", F.col("attempted_at")),
        "first_scheduled_at": tree.Measure("min", F.col("scheduled_at")),
    }
    # As in p1_found.
    return tree.by_fields(jobs, ["queue", "kind"], measures, **tree_for(2 * rows.count()))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field of a kind's args between an archiver's files."""
    return drift.changes(table(spark, d, "job_archive"))


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    """All archived jobs as one table: a row per line and field, nested ones
    included, under the field's current name."""
    archive = table(spark, d, "job_archive")
    return drift.unified(archive, drift.changes(archive), keep=["line_no"])


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """The consistent columns per kind of :func:`p3_unified`."""
    return drift.columns_of(p3_unified(spark, d))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """How many values other than null each file has in :func:`p3_unified`; none may be lost on the way."""
    rows = p3_unified(spark, d)
    scalars = F.when(F.col("type") == "array", F.regexp_count("value", F.lit(r'"(?:[^"\\]|\\.)*"|[0-9.eE+-]+|true|false'))).when(F.col("type") == "object", 0).otherwise(1)
    return rows.groupBy("archiver", "kind", "file_no").agg(F.sum(scalars).alias("scalars")).where("scalars > 0")


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    """All archived jobs, a row each, under one set of columns per kind, cast."""
    rows = staged(p3_unified(spark, d), "unified")
    return drift.cast_lines(rows, drift.columns_of(rows), keep=["line_no"])


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """The table of the kind with most archived lines."""
    rows = staged(p3_unified(spark, d), "unified")
    top = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").first()
    if top is None:
        return drift.kind_table(rows, {}, "", keep=["line_no"])
    columns = {r["name"]: r["type"] for r in drift.columns_of(rows.where(F.col("kind") == top["kind"])).orderBy("name").collect()}  # fields of one kind
    return drift.kind_table(rows, columns, top["kind"], keep=["line_no"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every child record of args, metadata and errors."""
    jobs = table(spark, d, "job_row").select("id", "args", "metadata", "errors")
    return nested.child_records(jobs, "id", ["args", "metadata"], ["errors"]).select(F.col("key").alias("id"), "path", "pos")


def p4_tables(spark: SparkSession, d: str) -> DataFrame:
    """The child records of args and metadata with their fields (as JSON) and
    the record each lies in."""
    jobs = table(spark, d, "job_row").select("id", "args", "metadata")
    links = nested.tables(jobs, "id", ["args", "metadata"])
    return links.select(F.col("key").alias("id"), "path", "pos", "pre", "post", "fields", "parent_path", "parent_pos")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """The record that each child record of args and metadata lies in."""
    return p4_tables(spark, d).select("id", "path", "pos", "parent_path", "parent_pos")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The tables of child records: a row per path and field, with how many records have it."""
    return nested.kinds_of(nested.tables(table(spark, d, "job_row").select("id", "args", "metadata"), "id", ["args", "metadata"]))


def p4_flat(spark: SparkSession, d: str) -> DataFrame:
    """The records of the path that most jobs have, as a table of its own."""
    links = staged(nested.tables(table(spark, d, "job_row").select("id", "args", "metadata"), "id", ["args", "metadata"]), "links")
    top = links.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").first()
    names = [r["name"] for r in nested.kinds_of(links.where(F.col("path") == top["path"])).orderBy("name").collect()] if top else []  # fields of one kind
    return nested.flat_table(links, top["path"] if top else "", names).withColumnRenamed("key", "id")


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    """The table of the elements of errors."""
    jobs = table(spark, d, "job_row").select("id", "errors").distinct()
    item = nested.elements(jobs, "id", "errors")
    return item.select(F.col("key").alias("id"), F.col("pos").cast("int").alias("pos"), *(F.col(f"item.{c}").alias(c) for c in ("at", "attempt", "error", "trace")))


QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary, "p3_found": p3_found, "p3_unified": p3_unified, "p3_columns": p3_columns, "p3_kept": p3_kept, "p3_lines": p3_lines, "p3_table": p3_table, "p4_found": p4_found, "p4_tables": p4_tables, "p4_links": p4_links, "p4_kinds": p4_kinds, "p4_flat": p4_flat, "p4_errors": p4_errors}

_JOBS = "(SELECT DISTINCT id, queue, kind, state, attempt, attempted_at, scheduled_at FROM job_row)"
_FIELDS = f"(SELECT 'queue' AS field, queue AS value, * FROM {_JOBS} UNION ALL SELECT 'kind' AS field, kind AS value, * FROM {_JOBS})"
# Every node of args and metadata, strings that hold JSON opened; first which paths hold an array anywhere, then the records.
_DOCS = "(SELECT DISTINCT id, args, metadata FROM job_row)"
_ROOTS = " UNION ALL ".join(f"SELECT id, '{c}' AS path, CASE WHEN json_valid({c}) THEN CAST({c} AS JSON) END AS v FROM {_DOCS}" for c in ("args", "metadata"))
_OPENED = "CASE WHEN json_type(c.value) = 'VARCHAR' AND ltrim(c.value ->> '$')[1] IN ('{', '[') AND json_valid(c.value ->> '$') AND json_type(c.value ->> '$') IN ('OBJECT', 'ARRAY') THEN CAST(c.value ->> '$' AS JSON) ELSE c.value END"
_RECORDS = f"""WITH RECURSIVE nodes AS (SELECT DISTINCT path, v FROM ({_ROOTS})
UNION ALL SELECT CASE WHEN json_type(n.v) = 'OBJECT' THEN n.path || '.' || c.key ELSE n.path END, {_OPENED} FROM nodes n, json_each(n.v) c WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')),
arrays AS (SELECT DISTINCT path FROM nodes WHERE json_type(v) = 'ARRAY'),
walk AS (SELECT id, path, '' AS pos, v, false AS element, CAST(NULL AS VARCHAR) AS up, CAST(NULL AS VARCHAR) AS up_pos FROM ({_ROOTS})
UNION ALL SELECT s.id, CASE WHEN s.t = 'OBJECT' THEN s.path || '.' || c.key ELSE s.path END, CASE WHEN s.t = 'OBJECT' THEN s.at WHEN s.at = '' THEN c.key ELSE s.at || '.' || c.key END, {_OPENED}, s.t = 'ARRAY', CASE WHEN s.record THEN s.path ELSE s.up END, CASE WHEN s.record THEN s.at ELSE s.up_pos END
 FROM (SELECT w.*, json_type(w.v) AS t, json_type(w.v) = 'OBJECT' AND (w.element OR w.path IN (FROM arrays)) AS record, CASE WHEN json_type(w.v) = 'OBJECT' AND NOT w.element AND w.path IN (FROM arrays) THEN CASE WHEN w.pos = '' THEN '0' ELSE w.pos || '.0' END ELSE w.pos END AS at FROM walk w WHERE json_type(w.v) IN ('OBJECT', 'ARRAY')) s, json_each(s.v) c),
records AS (SELECT DISTINCT id, path, CASE WHEN element THEN pos WHEN pos = '' THEN '0' ELSE pos || '.0' END AS pos, up AS parent_path, up_pos AS parent_pos FROM walk WHERE json_type(v) = 'OBJECT' AND (element OR path IN (FROM arrays)))
"""
_ERRORS = "(SELECT id, unnest(errors) AS e, generate_subscripts(errors, 1) AS pos FROM (SELECT DISTINCT id, errors FROM job_row WHERE len(errors) > 0))"
# The fields of archived lines by a walk over their nodes; a rename is a pair of fields gone and come whose values agree in
# all jobs of both files (of several such pairs the first by name: which of them the structure favours, SQL can't say).
_LINES = "WITH RECURSIVE l AS (SELECT row_number() OVER () AS line, * FROM (SELECT DISTINCT archiver, kind, file_no AS f, {more} job_id AS j, CAST(args AS JSON) AS v FROM job_archive WHERE json_valid(args)) WHERE json_type(v) = 'OBJECT'),"
_CHANGES = r"""n AS (SELECT line, CAST([] AS VARCHAR[]) AS names, '' AS places, v, false AS named FROM l
 UNION ALL SELECT n.line, CASE WHEN json_type(n.v) = 'OBJECT' THEN list_append(names, c.key) ELSE names END, CASE WHEN json_type(n.v) = 'ARRAY' THEN places || '.' || lpad(c.key, 8, '0') ELSE places END, c.value, json_type(n.v) = 'OBJECT' FROM n, json_each(n.v) c WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')),
m AS (SELECT line, names, places, named, v, array_to_string(names, chr(31)) AS p, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END AS t FROM n WHERE len(names) > 0),
fields AS (SELECT DISTINCT archiver, kind, f, p, t FROM m JOIN l USING (line) WHERE named AND t != 'null'),
steps AS (SELECT *, lag(f) OVER (PARTITION BY archiver, kind ORDER BY f) AS b FROM (SELECT DISTINCT archiver, kind, f FROM l)),
was AS (SELECT s.archiver, s.kind, s.f, s.b, x.p, x.t FROM steps s JOIN fields x ON x.archiver = s.archiver AND x.kind = s.kind AND x.f = s.b),
now AS (SELECT s.archiver, s.kind, s.f, s.b, x.p, x.t FROM steps s JOIN fields x ON x.archiver = s.archiver AND x.kind = s.kind AND x.f = s.f WHERE s.b IS NOT NULL),
cases AS (SELECT DISTINCT archiver, kind, f, b, p, 'removed' AS change FROM was ANTI JOIN now USING (archiver, kind, f, p)
 UNION ALL SELECT DISTINCT archiver, kind, f, b, p, 'added' FROM now ANTI JOIN was USING (archiver, kind, f, p)
 UNION ALL SELECT DISTINCT archiver, kind, f, b, p, 'retyped' FROM (FROM now ANTI JOIN was USING (archiver, kind, f, p, t)) SEMI JOIN was USING (archiver, kind, f, p)),
tops AS (SELECT * FROM cases c WHERE NOT EXISTS (SELECT 1 FROM cases o WHERE o.archiver = c.archiver AND o.kind = c.kind AND o.f = c.f AND starts_with(c.p, o.p || chr(31)))),
vals AS (SELECT t.archiver, t.kind, t.f, t.p, t.change, l.j, l.line, string_agg(array_to_string(m.names[len(string_split(t.p, chr(31))) + 1:], chr(31)) || '|' || m.places || '=' || CASE WHEN m.t = 'number' THEN CAST(CAST(m.v AS DOUBLE) AS VARCHAR) ELSE CAST(m.v AS VARCHAR) END, chr(30) ORDER BY m.names, m.places) AS d
 FROM tops t JOIN l ON l.archiver = t.archiver AND l.kind = t.kind AND l.f = CASE t.change WHEN 'removed' THEN t.b ELSE t.f END JOIN m ON m.line = l.line AND (m.p = t.p OR starts_with(m.p, t.p || chr(31)))
 WHERE t.change != 'retyped' AND (m.t NOT IN ('array', 'object') OR CAST(m.v AS VARCHAR) IN ('[]', '{}')) AND NOT (m.t = 'null' AND m.named AND m.p = t.p) GROUP BY ALL),
met AS (SELECT DISTINCT o.archiver, o.kind, o.f, o.p, o.j, o.d FROM vals o JOIN l ON l.archiver = o.archiver AND l.kind = o.kind AND l.f = o.f AND l.j = o.j WHERE o.change = 'removed'),
pairs AS (SELECT o.archiver, o.kind, o.f, o.p, c.p AS q FROM met o JOIN tops c ON c.archiver = o.archiver AND c.kind = o.kind AND c.f = o.f AND c.change = 'added'
 LEFT JOIN (SELECT DISTINCT archiver, kind, f, p, j, d FROM vals WHERE change = 'added') x ON x.archiver = o.archiver AND x.kind = o.kind AND x.f = o.f AND x.p = c.p AND x.j = o.j AND x.d = o.d GROUP BY ALL HAVING count(*) = count(x.d)),
renames AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY archiver, kind, f, p ORDER BY q) = 1 AND row_number() OVER (PARTITION BY archiver, kind, f, q ORDER BY p) = 1)
SELECT archiver, kind, f AS file_no, 'renamed' AS change, replace(p, chr(31), '.') AS field, replace(q, chr(31), '.') AS new_field FROM renames
UNION ALL SELECT archiver, kind, f, change, replace(p, chr(31), '.'), '' FROM tops t WHERE NOT EXISTS (SELECT 1 FROM renames r WHERE r.archiver = t.archiver AND r.kind = t.kind AND r.f = t.f AND (t.change = 'removed' AND r.p = t.p OR t.change = 'added' AND r.q = t.p))"""
SQL = {
    "p3_found": f"{_LINES.format(more='')} {_CHANGES}",
    "p3_kept": f"{_LINES.format(more='line_no,')} n AS (SELECT line, v FROM l UNION ALL SELECT n.line, c.value FROM n, json_each(n.v) c WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')) SELECT archiver, kind, f AS file_no, count(*) AS scalars FROM n JOIN l USING (line) WHERE json_type(n.v) NOT IN ('OBJECT', 'ARRAY', 'NULL') GROUP BY ALL",
    "p4_found": f"{_RECORDS} SELECT id, path, pos FROM records UNION ALL SELECT id, 'errors', CAST(pos - 1 AS VARCHAR) FROM {_ERRORS} WHERE e IS NOT NULL",
    "p4_links": f"{_RECORDS} SELECT * FROM records",
    "p1_found": f"SELECT field, value FROM {_FIELDS} WHERE value IS NOT NULL GROUP BY field, value HAVING count(*) * 100 >= 3 * (SELECT count(*) FROM {_JOBS})",
    "p4_errors": f"SELECT id, pos - 1 AS pos, e.at AS at, e.attempt AS attempt, e.error AS error, e.trace AS trace FROM {_ERRORS} WHERE e IS NOT NULL",
    "p1_summary": "SELECT field, value, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS n_{s}" for s in STATES)
    + f", CAST(sum(attempt) AS BIGINT) AS attempts, max(attempted_at) AS last_attempted_at, min(scheduled_at) AS first_scheduled_at FROM {_FIELDS} GROUP BY field, value",
}
