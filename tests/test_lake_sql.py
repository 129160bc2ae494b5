"""SQL over a lake: names, permissions, and folders pruned by what the query demands of time."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidelake.catalog import Lake
from tidelake.plans import lake_sql as L
from tidelake.plans import safety


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    hours = spark.range(48).select(F.timestamp_add("HOUR", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("time"), F.concat(F.lit("h"), F.col("id") % 3).alias("host"), F.col("id").alias("v"))
    lake.write(hours, "main", "cpu", ["host"])
    lake.write(hours.filter("v < 24").withColumn("w", F.col("v") * 2), "ops", "mem", ["host"])
    return lake


def bounds(lake, text):
    refs = [(a, b, *L.named(p, "main")) for a, b, p in L.references(lake.spark, text)]
    return L.folder_bounds(L.bound(lake, text, refs, {}), {(d, n): [lake.path(d, n)] for _, _, d, n in refs})


def test_names(lake):
    run = lambda text: [tuple(r) for r in L.lake_sql(lake, text).collect()]
    assert run("SELECT count(*) FROM cpu") == [(48,)]
    assert run("SELECT cpu.v FROM main.cpu WHERE cpu.v = 7 ORDER BY 1") == [(7,)]
    assert run("SELECT count(*), sum(m.w) FROM cpu JOIN ops.mem m ON m.time = cpu.time AND m.host = cpu.host") == [(24, 552)]
    assert run("WITH mem AS (SELECT 5 AS x) SELECT x, 'FROM ops.mem' FROM mem") == [(5, "FROM ops.mem")]
    assert run("SELECT count(*) FROM cpu WHERE v IN (SELECT v FROM ops.mem WHERE w > 40)") == [(3,)]
    assert run("SELECT count(*) FROM (SELECT * FROM cpu) x, ops.mem") == [(48 * 24,)]
    assert run("WITH cpu AS (SELECT * FROM cpu WHERE v < 5) SELECT count(*), CAST(avg(v) + 0.6 AS INTEGER) FROM cpu") == [(5, 3)]
    assert run("SELECT host, v FROM cpu QUALIFY row_number() OVER (PARTITION BY host ORDER BY time DESC) = 1 ORDER BY host") == [("h0", 45), ("h1", 46), ("h2", 47)]
    assert run("SELECT count(*), sum(m.v) FROM cpu c ASOF JOIN ops.mem m ON c.host = m.host AND c.time > m.time") == [(45, 276 + 7 * 66)]
    with pytest.raises(LookupError):
        run("SELECT * FROM main.none")


def test_permissions(lake):
    assert L.lake_sql(lake, "SELECT * FROM cpu", grants=[("main", "c*")]).count() == 48
    for text in ("SELECT * FROM cpu JOIN ops.mem USING (time)", "SELECT * FROM cpu WHERE v IN (SELECT v FROM ops.mem)", "DROP TABLE cpu"):
        with pytest.raises(safety.Refused):
            L.lake_sql(lake, text, grants=[("main", "*")])


def test_bounds(lake):
    d = datetime(2024, 1, 1, 5)
    late = "time >= TIMESTAMP_NTZ '2024-01-01 05:00:00'"
    assert bounds(lake, f"SELECT * FROM cpu WHERE {late} AND v > 3") == {("main", "cpu"): (d, None)}
    assert bounds(lake, f"SELECT * FROM cpu WHERE {late} OR v > 3") == {("main", "cpu"): (None, None)}
    assert bounds(lake, f"SELECT * FROM cpu WHERE {late} UNION ALL SELECT * FROM cpu WHERE v = 1") == {("main", "cpu"): (None, None)}
    assert bounds(lake, f"SELECT * FROM cpu WHERE {late} AND v < (SELECT max(v) FROM cpu)") == {}
    assert bounds(lake, "SELECT * FROM cpu WHERE time > now() - INTERVAL '2 hours'")["main", "cpu"][0] > d
    both = bounds(lake, "SELECT a.v FROM cpu a JOIN ops.mem b ON a.time = b.time WHERE b.time BETWEEN TIMESTAMP_NTZ '2024-01-01 05:00:00' AND TIMESTAMP_NTZ '2024-01-01 07:00:00'")
    assert both["ops", "mem"] == (d, datetime(2024, 1, 1, 7, 0, 0, 1)) == both["main", "cpu"]


def test_pruned_plan(lake):
    df = L.lake_sql(lake, "SELECT count(*) AS n FROM cpu WHERE time >= TIMESTAMP '2024-01-01 05:00:00' AND time < TIMESTAMP '2024-01-01 07:30:00'")
    assert df.first()["n"] == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
