"""What must not grow with the input: results on the driver, bodies in one row, frames and cells in one task."""

import io
import json
from collections import Counter

import pytest

from tidelake.plans import dialect
from tidelake.plans.registry import QUERIES


def test_json_read(spark):
    df = spark.sql("select id, if(id = 1, null, concat('],[\"é\\\\', id)) s, id / 4 x from range(2500)")
    text = "".join(dialect.json_rows(df, every=700))
    assert list(dialect.json_read(io.BytesIO(text.encode()))) == json.loads(text)["data"] == [list(r) for r in df.collect()]
    assert list(dialect.json_read(io.BytesIO("".join(dialect.json_rows(df.limit(0))).encode()))) == []
    for bad in (text[:-1], text[:-30], text + " ", text.replace("2500}", "2499}"), "[]", ""):
        with pytest.raises(ValueError):
            list(dialect.json_read(io.BytesIO(bad.encode())))


def test_landed_and_same_rows(spark):
    df = spark.sql("select id, if(id % 3 = 0, null, cast(id % 7 as string)) s from range(1000)")
    back = dialect.landed(spark, iter([df.toArrow().slice(0, 400), df.toArrow().slice(400)]), df.schema)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, df.collect())) and back.dtypes == df.dtypes
    assert dialect.same_rows(back, df) and not dialect.same_rows(back, df.union(df.limit(1))) and not dialect.same_rows(back.filter("id <> 3"), df)
    assert dialect.landed(spark, iter([]), df.schema).count() == 0


def test_responses_are_not_held_by_the_driver(spark, sf_dir, monkeypatch):
    """k10 makes no table of the driver's rows, and an empty result has both forms too."""
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", None)
        assert QUERIES["k10_compressed_responses"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_responses_of_nothing(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["k10_compressed_responses"](spark, str(tmp_path)).count() == 0


def test_each_csv_file_has_its_preamble(spark, sf_dir, tmp_path, monkeypatch):
    """Tasks write files of their own, no text of all rows is made, and all rows come back."""
    from tidelake.plans import storage

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(storage, "import_csv", lambda spark, path, *a, f=storage.import_csv, **b: (seen.append(path), f(spark, path, *a, **b))[1])
    monkeypatch.setattr(storage.F, "collect_list", None)
    got = QUERIES["s8_csv_preambles"](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, events.select("ts", "event_id", "user_id", "event_type", "value").collect()))
    files = [r["value"] for r in spark.read.text(seen[0], wholetext=True).collect() if r["value"]]
    assert len(files) > 3 and all(f.startswith("# written by a device\n# for a test\nwhen;event_id;") for f in files)


@pytest.mark.parametrize("seconds", [1, 7, 3600])
def test_trailing(spark, seconds):
    """Frames by time against Spark's own window: ends, equal times, times before 1970, no time, no key, no value, infinity."""
    import random

    from tidelake.operators.windows import trailing

    r = random.Random(seconds)
    rows = [(i, r.choice(["a", "b", None]), None if i % 20 == 0 else r.choice([-1, 1]) * r.randrange(40) * seconds * 1_000_000 // 8 + r.choice([0, 0, 1]), None if i % 7 == 0 else r.choice([0.25, -3.5, 8.0]) if i % 50 else float("inf")) for i in range(600)]
    df = spark.createDataFrame(rows, "i int, k string, us long, v double").selectExpr("i", "k", "timestampadd(MICROSECOND, us, timestamp_ntz'1970-01-01') t", "v")
    df.createOrReplaceTempView("frames")
    over = f"OVER (PARTITION BY k ORDER BY t RANGE BETWEEN INTERVAL '{seconds}' SECOND PRECEDING AND CURRENT ROW)"
    want = spark.sql(f"SELECT *, count(*) {over} AS n, sum(v) {over} AS s FROM frames")
    assert sorted(map(repr, trailing(df, ["k"], "t", "v", seconds).collect())) == sorted(map(repr, want.collect()))


def test_range_frames_are_not_added_up_row_by_row(spark, sf_dir):
    """w3's rows are dealt by key and a cell of time, not by key alone, and no frame slides over rows."""
    plan = QUERIES["w3_range_interval"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -59" in plan and "INTERVAL" not in plan and "_cell" in plan


def test_range_join_deals_out_a_full_cell(spark, monkeypatch):
    """Points and ranges of one cell: more tasks with more pairs, none with most of them, and each pair once."""
    from pyspark.sql import functions as F

    from tidelake.operators import joins

    monkeypatch.setattr(joins, "BLOCK", 64, raising=False)
    monkeypatch.setattr(joins, "PAIRS", 16 * 64 * 64, raising=False)
    points = spark.range(2000).selectExpr("id", "double(id % 10) p").unionAll(spark.range(3).selectExpr("id", "double(5) p"))
    ranges = spark.range(1000).selectExpr("id k", "double(id % 5) lo", "double(9) hi").unionAll(spark.sql("select -1L, 0D, 1000D union all select -2L, 3D, 3D union all select -3L, null, 1D"))
    got = joins.range_join(points, ranges, "p", "lo", "hi", 40.0)
    want = points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi")))
    hashed = lambda df: df.select(F.count("*"), F.sum(F.xxhash64("id", "p", "k", "lo", "hi").cast("decimal(38,0)"))).first()
    assert hashed(got) == hashed(want)
    n = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) > 10 and max(n) < sum(n) / 5
    assert joins.range_join(points, ranges.limit(0), "p", "lo", "hi", 40.0).count() == 0


def test_agents_are_asked_and_decoded_a_few_at_a_time(spark, monkeypatch, tmp_path):
    """A task asks AT_ONCE agents, holds one answer's points, and hands on pieces; broken and missing answers give none."""
    from tidelake.sources import live

    answer = json.dumps([{"m": "ev", "t": 1_700_000_000 + i, "h": "h", "fields": {"v": i}} for i in range(250)])
    for i in range(40):
        (tmp_path / f"{i}").write_text(answer if i % 8 else answer[:-1])
    urls = [f"file://{tmp_path}/{i}" for i in range(41)]
    monkeypatch.setattr(live, "PIECE", 100, raising=False)
    points = live.live_points(spark, urls)
    assert points.count() == 35 * 250
    sizes = points.select("time").mapInArrow(lambda bs: bs, "time long").count()
    assert sizes == 35 * 250
    asked, out = [], []

    class Frame:  # what the tasks run, run here
        def repartition(self, n):
            return self

        def mapInArrow(self, f, schema):
            return f

    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **b: Frame())
    monkeypatch.setattr(live, "answered", lambda u, t: (asked.append(u), answer.encode())[1], raising=False)
    import pyarrow as pa

    for b in live.live_points(spark, urls)(iter([pa.RecordBatch.from_pydict({"url": urls})])):
        out.append(b.num_rows)
        assert len(asked) <= (sum(out) - 1) // 250 // live.AT_ONCE * live.AT_ONCE + live.AT_ONCE
    assert max(out) == 100 and sum(out) == 41 * 250


def test_live_answers_are_many(spark, tmp_path, monkeypatch):
    """s4 makes no row of all records: answers are as long as one of Arrow's batches, however many records there are."""
    from tidelake.plans.storage import answers

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        spark.range(0, 1050, 1, 1).selectExpr("to_json(struct('ev' as m, id as t)) value").mapInArrow(answers, "value string").write.option("maxRecordsPerFile", 1).text(f"{tmp_path}/a")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/a", wholetext=True).collect()]
    assert len(found) == 11 and max(map(len, found)) == 101 and sum(map(len, found)) == 1050 + 11


def test_decoders_hand_on_pieces(spark, monkeypatch):
    """Values are taken one by one, and a value with many points becomes several batches."""
    from tidelake.sources import points

    monkeypatch.setattr(points, "PIECE", 100, raising=False)
    one = points.point("m", 1, {}, {"v": 1})
    df = spark.createDataFrame([("x",), (None,), ("y",)], "value string").coalesce(1)
    sizes = []
    caught = {}

    class Rows:
        isStreaming = True

        def select(self, c):
            return self

        def mapInArrow(self, f, schema):
            caught["f"] = f

    points.decoded(Rows(), "value", lambda v: [one] * 10_050)
    import pyarrow as pa

    for b in caught["f"](iter([pa.RecordBatch.from_pydict({"value": ["x", None, "y"]})])):
        sizes.append(b.num_rows)
    assert max(sizes) == 100 and sum(sizes) == 20_100
    assert points.decoded(df, "value", lambda v: [one] * 10_050).count() == 20_100
