import pytest
from pyspark.sql import functions as F

from tarnwork import runtime
from tarnwork.model import JOB, NOTIFICATION
from tarnwork.plans.streams import drained
from tarnwork.sources import connectors, distinct_rows, table
from tests.conftest import DATA
from tests.test_commands import by_id, job
from tests.test_commands import table as jobs_of

SMALL = str(DATA / "sf0.001")


def test_tables_have_the_schemas_of_the_model(spark):
    got = {f.name: f.dataType for f in table(spark, SMALL, "job_row").schema.fields}
    assert got == {f.name: f.dataType for f in JOB.fields}


def test_repeats_count_once_and_columns_are_pruned(spark):
    jobs = table(spark, SMALL, "job_row")
    one = distinct_rows(jobs, "id", "queue")
    assert one.count() == jobs.select("id").distinct().count() < jobs.count()
    plan = one.where("queue = 'default'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(queue,default)" in plan and "ReadSchema: struct<id:bigint,queue:string>" in plan


def test_staged_cuts_lineage(spark):
    df = runtime.staged(spark.range(10).selectExpr("id", "id % 2 AS k"), "t")
    assert df.count() == 10 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert runtime.spread(df, 3).rdd.getNumPartitions() == 4 and runtime.spread(df, 100) is df


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_json_append_and_layout(spark, tmp_path):
    jobs = jobs_of(spark, job(1), job(2, "running", tags=["a"], errors=[(None, 1, "x", "")]), job(3, "completed"))
    connectors.write_json(jobs, str(tmp_path / "json"))
    back = by_id(connectors.read_json(spark, str(tmp_path / "json"), "job_row"))
    assert back == by_id(jobs)
    for _ in range(2):
        connectors.append(jobs, str(tmp_path / "bulk"), "job_row")
    assert spark.read.parquet(str(tmp_path / "bulk")).count() == 6
    connectors.clustered(jobs, str(tmp_path / "layout"))
    one = spark.read.parquet(str(tmp_path / "layout")).where("state = 'running'")
    assert [r.id for r in one.collect()] == [2]
    assert "PartitionFilters: [isnotnull(state" in one._jdf.queryExecution().executedPlan().toString()


def test_jdbc_reads_in_ranges_and_appends(spark):
    """Against the small database that comes with the engine."""
    url, driver = "jdbc:derby:memory:jobs;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    jobs = jobs_of(spark, *(job(i, "running", tags=["a"], unique_states=3) for i in range(1, 50))).select("id", "kind", "priority", "scheduled_at", "state", "tags")
    connectors.write_jdbc(jobs, url, "job_row", driver=driver)
    got = connectors.read_jdbc(spark, url, "job_row", parts=4, driver=driver)
    rows = {r[0]: r for r in got.collect()}
    assert got.rdd.getNumPartitions() == 4 and sorted(rows) == list(range(1, 50)) and rows[7][1:3] == ("k", 1) and rows[7][5] == '["a"]'
    connectors.write_jdbc(jobs.where("id = 1").withColumn("id", F.lit(100).cast("long")), url, "job_row", driver=driver)
    assert connectors.read_jdbc(spark, url, "job_row", key=None, driver=driver).count() == 50
    connectors.write_jdbc(jobs.limit(0), url, "empty_jobs", driver=driver)
    assert connectors.read_jdbc(spark, url, "empty_jobs", driver=driver).count() == 0


def test_outbox_files_are_a_stream(spark, tmp_path):
    path = str(tmp_path / "notes")
    at = __import__("datetime").datetime(2025, 1, 1)
    for i, topic in enumerate(["job_insert", "job_control", "job_insert"]):
        connectors.append(spark.createDataFrame([(i, at, "{}", topic)], NOTIFICATION), path, "job_notification")
    stream = connectors.notifications(spark, path, ["job_insert"], files_per_trigger=1)
    assert sorted(r.id for r in drained(stream, "notes").collect()) == [0, 2]
