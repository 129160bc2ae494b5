"""The catalog, upkeep and continuous queries on small measurements."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelake import paths
from tidelake.catalog import Lake
from tidelake.operators import browse, maintenance
from tidelake.streaming.continuous import ContinuousQuery, drained, duration, schedule, stream_sessions

ROWS = [(datetime(2024, 1, 1, h, m), f"h{m % 3}", float(h * 60 + m), h) for h in range(4) for m in range(0, 60, 7)]
SCHEMA = "time timestamp_ntz, host string, v double, n int"


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "hot"), str(tmp_path / "cold"))


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_write_and_read(lake, rows):
    lake.write(rows, "db", "cpu", ["host"], sort_keys=["host"])
    got = lake.read("db", "cpu")
    assert sorted(map(tuple, got.collect())) == sorted((t, h, v, n) for t, h, v, n in ROWS)
    assert [(c["name"], c["kind"]) for c in lake.schema("db", "cpu")] == [("time", "time"), ("host", "tag"), ("v", "field"), ("n", "field")]
    assert lake.databases() == ["db"] and lake.measurements("db") == ["cpu"] and lake.stats("db").first()["file_count"] == 4
    with pytest.raises(ValueError):
        lake.write(rows, "db", "../x")
    with pytest.raises(LookupError):
        lake.read("db", "nothing")
    with pytest.raises(ValueError):
        lake.drop_database("db")
    assert lake.drop_database("db", confirm=True) == 1 and lake.databases() == []


def test_pruning_reaches_the_folders(lake, rows):
    lake.write(rows, "db", "cpu")
    got = lake.read("db", "cpu", "2024-01-01 01:30:00", "2024-01-01 03:00:00")
    assert got.count() == sum(datetime(2024, 1, 1, 1, 30) <= r[0] < datetime(2024, 1, 1, 3) for r in ROWS)
    assert got.select(F.input_file_name()).distinct().count() == 2
    assert "PartitionFilters: [isnotnull(dt" in got._jdf.queryExecution().executedPlan().toString().replace("true, ", "")


def test_schema_evolves_and_conflicts(lake, spark, rows):
    lake.write(rows.drop("n"), "db", "m", ["host"])
    lake.write(rows.withColumn("extra", F.lit(True)), "db", "m")
    got = lake.read("db", "m")
    assert set(got.columns) == {"time", "host", "v", "n", "extra"} and got.filter("extra is null").count() == len(ROWS)
    lake.write(spark.createDataFrame([(datetime(2024, 1, 1), "x")], "time timestamp_ntz, v string"), "db", "m")
    got = lake.read("db", "m")
    assert dict(got.dtypes)["v"] == "string" and got.count() == 2 * len(ROWS) + 1
    with pytest.raises(TypeError):
        lake.write(rows.withColumn("a", F.array("n")), "db", "m")
    with pytest.raises(TypeError):
        lake.write(rows.withColumn("time", F.lit("2024")), "db", "m")


def test_stored_types(lake, spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' time, cast(1 as tinyint) a, cast(1.5 as float) b, null c, 1 _d, 2.25 e")
    lake.write(df, "db", "t", decimals={"e": "18,8"})
    assert dict(lake.read("db", "t").dtypes) == {"time": "timestamp_ntz", "a": "bigint", "b": "double", "c": "string", "e": "decimal(18,8)"}


def test_dedup_keeps_the_last_write(lake, rows):
    lake.write(rows, "db", "cpu", ["host"])
    lake.write(rows.withColumn("v", -F.col("v")), "db", "cpu", ["host"])
    report = maintenance.compact(lake, "db", "cpu", least=2)
    assert report == {"folders": 4, "files_before": 8, "files_after": 4}
    assert sorted(r["v"] for r in lake.read("db", "cpu").collect()) == sorted(-r[2] for r in ROWS)
    assert maintenance.compact(lake, "db", "cpu", least=2)["folders"] == 0
    lake.write(rows, "db", "cpu", ["host"])
    assert maintenance.compact(lake, "db", "cpu", least=2, older_than=datetime(2024, 1, 1, 2))["folders"] == 2
    assert maintenance.compact(lake, "db", "cpu", least=5, daily=True)["folders"] == 4


def test_dedup_by_mark(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "a", 1, 1), (datetime(2024, 1, 1), "b", 2, 2)], "time timestamp_ntz, host string, v int, _seq int")
    assert [r["v"] for r in maintenance.dedup(df, ["host"], dedup_time=True).collect()] == [2]
    assert maintenance.dedup(df, []).count() == 2 and maintenance.dedup(df, ["host"]).count() == 2


def test_retention_takes_whole_files(lake, rows):
    lake.write(rows, "db", "cpu")
    now = datetime(2024, 1, 11, 1, 30)
    assert len(maintenance.retain(lake, "db", "cpu", 10, now, dry_run=True)) == 1
    maintenance.retain(lake, "db", "cpu", 10, now)
    assert lake.read("db", "cpu").agg(F.min("time")).first()[0] == datetime(2024, 1, 1, 1)
    assert maintenance.retain(lake, "db", "cpu", 10, now, buffer_days=1) == []


def test_delete_keeps_unknown(lake, rows):
    lake.write(rows.withColumn("v", F.when(F.col("n") != 2, F.col("v"))), "db", "cpu")
    for always in ("1 = 1", "2=2", "true", "not false", "host = host", "v < 3 or 1 < 2", "v in (v)", "5 between 1 and 9"):
        with pytest.raises(ValueError, match="all rows"):
            maintenance.delete_where(lake, "db", "cpu", always)
    with pytest.raises(ValueError):
        maintenance.delete_where(lake, "db", "cpu", "v >= 0", most=3)
    assert maintenance.delete_where(lake, "db", "cpu", "v < 60", dry_run=True)["rows"] == sum(r[2] < 60 for r in ROWS)
    maintenance.delete_where(lake, "db", "cpu", "v < 60")
    assert lake.read("db", "cpu").count() == len(ROWS) - 9 and lake.read("db", "cpu").filter("v is null").count() == 9


def test_tiers(lake, rows):
    lake.write(rows, "db", "cpu", ["host"])
    assert len(maintenance.migrate(lake, "db", "cpu", 1, datetime(2024, 1, 2, 2))) == 2
    assert maintenance.migrate(lake, "db", "cpu", 0, datetime(2024, 1, 3), hot_only=True) == []
    assert lake.read("db", "cpu").count() == len(ROWS)
    assert {(r["tier"], r["file_count"]) for r in lake.stats("db").collect()} == {("hot", 2), ("cold", 2)}


def test_continuous_query(lake, rows):
    lake.write(rows, "db", "cpu", ["host"])
    cq = ContinuousQuery(lake, "db", "cpu", "hourly", "SELECT host, count(*) AS c FROM db.cpu WHERE time >= {start_time} AND time < {end_time} GROUP BY host", "1h", ("host",))
    assert len(cq.advance(datetime(2024, 1, 1, 1))) == 1  # an hour back at first
    assert len(cq.advance(datetime(2024, 1, 1, 4, 59))) == 3 and cq.last() == datetime(2024, 1, 1, 4)
    got = lake.read("db", "hourly")
    assert got.count() == 12 and got.agg(F.sum("c")).first()[0] == len(ROWS)
    cq.run(datetime(2024, 1, 1), datetime(2024, 1, 1, 1))
    maintenance.compact(lake, "db", "hourly", least=1)
    assert lake.read("db", "hourly").count() == 12
    assert "2024-01-01" in cq.run(datetime(2024, 1, 1), datetime(2024, 1, 2), dry_run=True)
    for bad in ({"sql": "SELECT 1"}, {"interval": "5s"}, {"interval": "soon"}):
        with pytest.raises(ValueError):
            ContinuousQuery(lake, "db", "cpu", "x", **({"sql": cq.sql, "interval": "1h"} | bad))
    assert duration("1h30m") == timedelta(minutes=90)


def test_sessions(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, m), 1) for m in (0, 10, 50, 55)] + [(datetime(2024, 1, 2), 1)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, user_id int")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    out = drained(stream_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))), spark, "complete")
    assert sorted(r["n"] for r in out.collect()) == [1, 2, 2]


def test_browse(spark, rows):
    assert [r["v"] for r in browse.measurement_query(rows, "n = 3", limit=2, offset=1).collect()] == [229.0, 222.0]
    for bad in ({"limit": 0}, {"limit": 10**7}, {"offset": -1}, {"order_by": [("x", True)]}):
        with pytest.raises(ValueError):
            browse.measurement_query(rows, **bad)
    assert browse.estimate(spark.range(200_000).toDF("x"), exact=True) == {"rows": 200_000, "level": "medium"}
    assert browse.describe(rows, ["host"])[1] == {"name": "host", "kind": "tag", "type": "string"}
    out = browse.egress(spark.sql("select cast(5 as decimal(38,0)) a, cast(1.5 as decimal(5,2)) b, double('nan') c, double('inf') d"))
    assert tuple(out.first()) == (5, 1.5, None, None) and dict(out.dtypes)["a"] == "bigint"


def test_corrupt_files_are_skipped(lake, rows, tmp_path):
    lake.write(rows, "db", "cpu")
    (tmp_path / "hot/db/cpu/dt=2024-01-01/hr=00/bad.parquet").write_bytes(b"no parquet")
    assert lake.read("db", "cpu").count() == len(ROWS)
    lake.write(rows, "db", "cpu")
    report = maintenance.compact(lake, "db", "cpu", least=2)
    assert report == {"folders": 4, "files_before": 8, "files_after": 4} and (tmp_path / "hot/db/cpu/dt=2024-01-01/hr=00/bad.parquet").exists()
    maintenance.delete_where(lake, "db", "cpu", "v < 60")
    assert lake.read("db", "cpu").count() == 2 * (len(ROWS) - 9)


def test_upkeep_reads_only_the_files_it_rewrites(lake, rows, monkeypatch):
    lake.write(rows, "db", "cpu", ["host"])
    lake.write(rows.filter("n < 2"), "db", "cpu", ["host"])
    seen = []
    monkeypatch.setattr(Lake, "_scan", lambda self, path, files=None, f=Lake._scan, **bounds: seen.append(files and len(files)) or f(self, path, files, **bounds))
    assert maintenance.compact(lake, "db", "cpu", least=2, at_once=1)["files_before"] == 4 and seen == [2, 2]
    seen.clear()
    assert maintenance.delete_where(lake, "db", "cpu", "v < 60") == {"rows": 9, "files": 1} and seen[-1] == 1


def test_deletion_reaches_both_tiers(lake, rows):
    lake.write(rows, "db", "cpu", ["host"])
    maintenance.migrate(lake, "db", "cpu", 1, datetime(2024, 1, 2, 2))
    assert maintenance.delete_where(lake, "db", "cpu", "host = 'h0'")["files"] == 4
    assert lake.read("db", "cpu").count() == sum(r[1] != "h0" for r in ROWS)


def test_schedule(lake, rows):
    lake.write(rows, "db", "cpu", ["host"])
    text = "SELECT host, count(*) AS c FROM db.cpu WHERE time >= {start_time} AND time < {end_time} GROUP BY host"
    good, bad = (ContinuousQuery(lake, "db", "cpu", target, text, "10m", tags) for target, tags in (("a", ("host",)), ("b", ())))
    failures = []
    for cq in (good, bad):
        stop = threading.Event()
        schedule([cq], stop, lambda stop=stop: stop.set() or datetime(2024, 1, 1, 1), lambda cq, e: failures.append((cq.target, type(e))))[0].join()
    # rows of one window without tags can't be told apart, so the second query writes nothing and does not advance
    assert good.last() == datetime(2024, 1, 1, 1) and bad.last() is None and failures == [("b", ValueError)]
    assert lake.measurements("db") == ["a", "cpu"]


def test_text_files(spark, tmp_path):
    p = str(tmp_path / "a/b.json")
    assert paths.read_text(spark, p) is None
    paths.write_text(spark, p, "é")
    assert paths.read_text(spark, p) == "é" and paths.children(spark, str(tmp_path / "a"))[0][0] in ("b.json", ".b.json.crc")


def test_a_batch_that_is_written_again_takes_its_own_place(lake, rows):
    lake.write(rows, "db", "cpu", ["host"])
    for part in (rows.filter("n < 2"), rows.filter("n < 2"), rows.filter("n = 3")):
        lake.write(part, "db", "cpu", ["host"], batch="stream/1-7" if part.first()["n"] < 2 else "stream/1-8")
    assert lake.read("db", "cpu").count() == len(ROWS) + sum(r[3] < 2 or r[3] == 3 for r in ROWS)
    assert not [n for n, _, _ in paths.children(lake.spark, lake.path("db", "cpu")) if n.startswith("_batch")]


def test_properties_of_writers_at_once_are_united(lake, rows):
    threads = [threading.Thread(target=lake.set_properties, args=("db", "cpu"), kwargs={"tags": [f"t{i}"]}) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert lake.properties("db", "cpu")["tags"] == [f"t{i}" for i in range(8)]


def test_mixed_types_open_the_pruned_hours_only(lake, spark, rows, monkeypatch):
    from tidelake import catalog
    from tidelake.plans.lake_sql import lake_sql

    lake.write(rows, "db", "m", ["host"])
    lake.write(rows.withColumn("v", F.concat(F.lit("s"), "v")), "db", "m")
    seen = []
    monkeypatch.setattr(catalog, "file_schema", lambda s, f, g=catalog.file_schema: seen.append(f) or g(s, f))
    assert lake.read("db", "m", "2024-01-01 01:00:00", "2024-01-01 02:00:00").count() == 18 and len(seen) == 2 and "hr=01" in seen[0]
    seen.clear()
    got = lake_sql(lake, "SELECT count(*) AS n, count(CASE WHEN v LIKE 's%' THEN 1 END) AS s FROM db.m WHERE time >= TIMESTAMP '2024-01-01 03:00:00'")
    assert tuple(got.first()) == (18, 9) and len(seen) == 2
    assert lake.read("db", "m", "2025-01-01").count() == 0
    hot = Lake(spark, lake.root)
    maintenance.compact(hot, "db", "m", least=1)
    seen.clear()
    assert not hot.properties("db", "m")["mixed"] and hot.read("db", "m").count() == len(ROWS) and not seen  # the later write's rows stay


def test_day_files(lake, rows):
    lake.write(rows, "db", "cpu", ["host"], sort_keys=["host"])
    assert maintenance.compact(lake, "db", "cpu", least=3, daily=True, older_than=datetime(2024, 1, 1, 23)) == {"folders": 0, "files_before": 0, "files_after": 0}
    assert maintenance.compact(lake, "db", "cpu", least=3, daily=True) == {"folders": 4, "files_before": 4, "files_after": 1}
    assert list(maintenance.by_folder(lake, lake.path("db", "cpu"))) == ["dt=2024-01-01/hr=day"]
    for start, end in (("2024-01-01 01:30:00", "2024-01-01 03:00:00"), ("2023-12-31", "2024-01-01 00:10:00"), ("2024-01-01 03:50:00", "2024-01-02")):
        assert lake.read("db", "cpu", start, end).count() == sum(datetime.fromisoformat(start) <= r[0] < datetime.fromisoformat(end) for r in ROWS)
    assert lake.read("db", "cpu", "2024-01-02").count() == 0
    one = lake.read("db", "cpu").collect()
    assert [(r["host"], r["time"]) for r in one] == sorted((r["host"], r["time"]) for r in one)  # as sorted in the file
    lake.write(rows.limit(5).withColumn("v", F.lit(0.5)), "db", "cpu")  # late rows, united by the next run
    maintenance.compact(lake, "db", "cpu", least=2, daily=True)
    assert lake.read("db", "cpu").count() == len(ROWS) and lake.read("db", "cpu").filter("v = 0.5").count() == 5
    assert len(maintenance.migrate(lake, "db", "cpu", 1, datetime(2024, 1, 3, 2))) == 1


def test_continuous_sql_is_checked(lake, rows):
    lake.write(rows, "db", "cpu", ["host"])
    span = "time >= {start_time} AND time < {end_time}"
    for bad in (f"DROP TABLE cpu -- {span}", f"SELECT reflect('a', 'b') FROM db.cpu WHERE {span}", f"SELECT 1; SELECT 2 FROM db.cpu WHERE {span}", f"SELECT * FROM parquet.`/x` WHERE {span}"):
        with pytest.raises(ValueError):
            ContinuousQuery(lake, "db", "cpu", "x", bad)
    cq = ContinuousQuery(lake, "db", "cpu", "named", f"SELECT host, max('db.cpu') AS said, count(*) AS c FROM cpu WHERE {span} GROUP BY host QUALIFY row_number() OVER (ORDER BY host) < 9", tags=("host",))
    cq.run(datetime(2024, 1, 1), datetime(2024, 1, 1, 1))
    assert {r["said"] for r in lake.read("db", "named").collect()} == {"db.cpu"} and lake.read("db", "named").agg(F.sum("c")).first()[0] == 9


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Cluster:
        sparkContext = type("C", (), {"master": "spark://h:7077"})()  # noqa: N815
        conf = type("F", (), {"get": staticmethod(lambda k, d=None: d)})()

    with pytest.raises(ValueError, match="checkpoint"):
        paths.scratch(Cluster(), "x")


def test_asof_join_by_units(spark):
    import random

    from tidelake.operators.joins import asof_join, range_join

    rnd = random.Random(4)
    moment = lambda: datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(8000))
    left = [(rnd.choice(["a", "b", None]), moment() if rnd.random() < 0.95 else None, i) for i in range(300)]
    right = [(rnd.choice(["a", "a", "c", None]), moment(), float(i)) for i in range(60)]
    a, b = spark.createDataFrame(left, "k string, t timestamp_ntz, i int"), spark.createDataFrame(right, "k string, u timestamp_ntz, v double")
    want = {i: max(((u, v) for q, u, v in right if q == k and k is not None and t is not None and u <= t), default=(None, None))[1] for k, t, i in left}
    for every in (None, "day", "hour"):
        got = asof_join(a, b, ["k"], "t", "u", ["v"], every=every)
        assert got.count() == 300 and {r["i"]: r["v"] for r in got.collect()} == want
        assert asof_join(a, b, ["k"], "t", "u", ["v"], "inner", every).count() == sum(v is not None for v in want.values())
    points, ranges = [rnd.uniform(-50, 1e6) for _ in range(200)], [(x, x + w) for w in (0.5, 3, 90, 4000, 2e6) for x in (rnd.uniform(-60, 1e6) for _ in range(8))] + [(5.0, 5.0)]
    hits = range_join(spark.createDataFrame([(p,) for p in points], "p double"), spark.createDataFrame(ranges, "lo double, hi double"), "p", "lo", "hi", 2.0)
    assert sorted(map(tuple, hits.collect())) == sorted((p, lo, hi) for p in points for lo, hi in ranges if lo <= p < hi)
