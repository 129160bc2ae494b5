"""Ingest, layout, upkeep and streaming as queries: each moves a whole table through an operator and reads it back."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake import paths
from tidelake.catalog import Lake
from tidelake.functions.time import at, epoch_to_micros, mqtt_epoch_to_micros
from tidelake.operators import maintenance
from tidelake.plans.registry import query
from tidelake.sources.imports import import_csv, import_parquet, parse_time
from tidelake.sources.line_protocol import line_protocol
from tidelake.sources.points import to_table
from tidelake.sources.records import messages, records
from tidelake.streaming.continuous import ContinuousQuery, drained, stream_buckets


def events(load):
    """The table events as a measurement: tags event_type and host, fields value and event_id."""
    e = load("events")
    return e.select(F.col("ts").alias("time"), "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("host"), "value", "event_id")


def lake_of(spark, what: str, cold: bool = False) -> Lake:
    root = paths.scratch(spark, what)
    return Lake(spark, root, f"{root}-cold" if cold else None)


PLAIN = "SELECT ts AS time, event_type, 'u' || user_id AS host, value, event_id FROM events"


def micros(column: str):
    return F.timestamp_diff("MICROSECOND", at("1970-01-01"), F.col(column))



@query(PLAIN)
def s1_union_by_name_scan(load, spark):
    lake = lake_of(spark, "s1")
    e = events(load)
    lake.write(e.filter("event_id % 2 = 0"), "main", "events", ["event_type", "host"])
    lake.write(e.filter("event_id % 2 = 1").select("event_id", "host", "time", "value", "event_type"), "main", "events")
    return lake.read("main", "events")


@query(f"SELECT * FROM ({PLAIN}) WHERE time >= TIMESTAMP '2024-01-09 07:30:00' AND time < TIMESTAMP '2024-01-12 05:00:00'")
def s2_pruned_scan(load, spark):
    lake = lake_of(spark, "s2")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    return lake.read("main", "events", "2024-01-09 07:30:00", "2024-01-12 05:00:00")


@query(PLAIN)
def s3_multi_tier_scan(load, spark):
    lake = lake_of(spark, "s3", cold=True)
    lake.write(events(load), "main", "events", ["event_type", "host"])
    maintenance.migrate(lake, "main", "events", 10, datetime(2024, 1, 25))
    return lake.read("main", "events")


def answers(batches):
    """An agent's answer for each of Arrow's batches of records: there are more agents with more records, not longer answers."""
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_pydict({"value": pa.array(["[" + "".join(f"{r}," for r in b.column(0).to_pylist()) + '{"m":"x"}]'])})


@query(f"SELECT host, count(*) AS n, max(live) AS live, CAST(sum(coalesce(event_id, 0)) AS BIGINT) AS ids FROM (SELECT *, 0 AS live FROM ({PLAIN}) UNION ALL SELECT ts, event_type, 'u' || user_id, value, event_id, 1 FROM events WHERE event_id % 10 = 0) GROUP BY host")
def s4_live_rows(load, spark):
    """Rows that agents hold, asked for by URL (files of answers, and one that is not there), united below the query."""
    from tidelake.sources.live import live_rows

    lake, folder = lake_of(spark, "s4"), paths.scratch(spark, "agents")
    e = events(load)
    lake.write(e, "main", "events", ["event_type", "host"])
    record = F.to_json(F.struct(F.lit("ev").alias("m"), micros("time").alias("t"), F.col("host").alias("h"), F.struct("value", "event_id", F.lit(1).alias("live")).alias("fields"), F.struct("event_type").alias("tags")))
    e.filter("event_id % 10 = 0").select(record.alias("value")).mapInArrow(answers, "value string").write.option("maxRecordsPerFile", 1).text(folder)
    base = folder if folder.startswith("file:") else f"file://{folder}"
    urls = [f"{base}/{n}" for n, _, _ in paths.children(spark, folder) if n.startswith("part")] + [f"{base}/none"]
    both = lake.with_live(lake.read("main", "events").withColumn("live", F.lit(0).cast("long")), live_rows(spark, urls, "ev"))
    return both.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("live").cast("int").alias("live"), F.sum(F.coalesce("event_id", F.lit(0))).alias("ids"))


@query("SELECT ts AS time, event_type, 'a b,' || user_id AS host, value, event_id, 'say \"' || event_type || '\"' AS note, event_id % 2 = 0 AS even FROM events")
def s5_line_protocol(load, spark):
    e = load("events")
    nanos = micros("ts") * 1000
    line = F.concat(F.lit("ev,event_type="), "event_type", F.lit(r",host=a\ b\,"), F.col("user_id").cast("string"), F.lit(" value="), F.col("value").cast("string"), F.lit(",event_id="), F.col("event_id").cast("string"), F.lit('i,note="say \\"'), "event_type", F.lit('\\"",even='), F.when(F.col("event_id") % 2 == 0, "t").otherwise("false"), F.lit(" "), nanos.cast("string"))
    return to_table(line_protocol(e.select(line.alias("value"))), "ev")[0]


@query(PLAIN)
def s6_records(load, spark):
    e = events(load)
    json = F.to_json(F.struct(F.lit("ev").alias("m"), micros("time").alias("t"), F.col("host").alias("h"), F.struct("value", "event_id").alias("fields"), F.struct("event_type").alias("tags")))
    return to_table(records(e.select(json.alias("value"))), "ev")[0]


def packed(rows: DataFrame, shape: str, encoding: str = "") -> DataFrame:
    """(value) MessagePack bodies of about a thousand rows (time, event_type, host, value, event_id) each, as agents send them."""

    def bodies(batches):
        import gzip

        import pyarrow as pa
        import zstandard

        from tidelake.sources.records import pack

        squeeze = {"gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress, "": bytes}[encoding]
        for b in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            t, kind, host, value, number = (c.to_pylist() for c in b.columns)
            if shape == "columns":
                body = {"m": "ev", "columns": {"time": t, "event_type": kind, "host": host, "value": value, "event_id": number}, "tags": ["event_type", "host"]}
            else:
                each = [{"m": "ev", "t": a, "h": h, "tags": {"event_type": k}, "fields": {"value": v, "event_id": n}} for a, k, h, v, n in zip(t, kind, host, value, number)]
                body = {"batch": each} if shape == "batch" else each
            yield pa.RecordBatch.from_pydict({"value": pa.array([squeeze(pack(body))], pa.binary())})

    return rows.select(micros("time"), "event_type", "host", "value", "event_id").mapInArrow(bodies, "value binary")


def _messagepack(name: str, shape: str, encoding: str) -> None:
    def f(load, spark):
        return to_table(records(packed(events(load), shape, encoding)), "ev")[0].select("time", "event_type", "host", "value", "event_id")

    f.__name__ = name
    query(PLAIN)(f)


for _name, _shape, _encoding in (("s6_messagepack_rows", "rows", ""), ("s6_messagepack_batch", "batch", ""), ("s6_messagepack_columns", "columns", ""), ("s13_zstd_bodies", "columns", "zstd"), ("s13_gzip_bodies", "rows", "gzip")):
    _messagepack(_name, _shape, _encoding)


@query(PLAIN)
def s12_agent_parquet(load, spark):
    """Parquet bodies of an agent, times as whole numbers, written twice under one name: the second takes the first's place."""
    from tidelake.sources.imports import ingest_parquet

    lake, folder = lake_of(spark, "s12"), paths.scratch(spark, "body")
    events(load).withColumn("time", micros("time")).write.parquet(folder)
    for _ in range(2):
        ingest_parquet(lake, folder, "main", "events", ["event_type", "host"], batch="agent-1")
    return lake.read("main", "events")


@query("SELECT * FROM (VALUES ('databases', 'main', ''), ('databases', 'ops', ''), ('tables', 'main.events', 'lake'), ('columns', 'ops.even.event_id', 'field'), ('columns', 'ops.even.host', 'tag'), ('columns', 'ops.even.time', 'time'), ('described', 'host', 'tag'), ('hidden', 'main', '')) t(what, name, more)")
def s16_catalogs(load, spark):
    """SHOW, DESCRIBE and the catalog's tables; what the grants don't cover is not there."""
    from tidelake.plans.lake_sql import lake_sql

    lake, e = lake_of(spark, "s16"), events(load)
    lake.write(e, "main", "events", ["event_type", "host"])
    lake.write(e.select("time", "host", "event_id"), "ops", "even", ["host"])
    asked = {
        "databases": "SHOW DATABASES", "tables": "SHOW TABLES FROM main", "described": "DESCRIBE ops.even",
        "columns": "SELECT table_schema || '.' || table_name || '.' || column_name AS name, column_kind AS more FROM information_schema.columns WHERE table_schema = 'ops' ORDER BY 1",
    }
    rows = [("databases", r["database"], "") for r in lake_sql(lake, asked["databases"]).collect()]
    rows += [("tables", f"{r['database']}.{r['table_name']}", "lake" if r["storage_path"].startswith(lake.root) else "") for r in lake_sql(lake, asked["tables"]).collect()]
    rows += [("columns", *r) for r in lake_sql(lake, asked["columns"]).collect()]
    rows += [("described", r["column_name"], r["column_kind"]) for r in lake_sql(lake, asked["described"]).collect() if r["column_name"] == "host"]
    rows += [("hidden", r["schema_name"], "") for r in lake_sql(lake, "SELECT schema_name FROM information_schema.schemata", grants=[("main", "*")]).collect()]
    return spark.createDataFrame(rows, "what string, name string, more string")


@query("SELECT ts AS time, 'd' || user_id AS dn, value AS temperature, event_id AS seq FROM events")
def s7_message_stream(load, spark):
    """Messages landed as files, taken in as a stream, each micro-batch written under its number."""
    from tidelake.streaming.continuous import ingest_points

    lake, folder = lake_of(spark, "s7"), paths.scratch(spark, "landed")
    text = F.to_json(F.struct(micros("ts").alias("timestamp"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("dn"), F.struct(F.col("value").alias("temperature")).alias("properties"), F.col("event_id").alias("seq")))
    load("events").select(text.alias("value")).write.text(folder)
    ingest_points(messages(spark.readStream.text(folder)), lake, "main", paths.scratch(spark, "state")).awaitTermination()
    return lake.read("main", "mqtt").select("time", "dn", "temperature", "seq")


@query(PLAIN)
def k11_replayed_batch(load, spark):
    """A micro-batch that fails after it was written, and is run again: its rows are there once."""
    from tidelake.streaming import continuous

    lake, folder, state = lake_of(spark, "k11"), paths.scratch(spark, "source"), paths.scratch(spark, "state")
    e = events(load)
    e.write.parquet(folder)
    stream = spark.readStream.schema(e.schema).parquet(folder)
    continuous.ingest(stream, lake, "main", "events", state, ["event_type", "host"]).awaitTermination()
    for n, _, _ in paths.children(spark, f"{state}/commits"):  # as if the driver had been lost before the commit
        paths.delete(spark, f"{state}/commits/{n}")
    continuous.ingest(stream, lake, "main", "events", state, ["event_type", "host"]).awaitTermination()
    return lake.read("main", "events")


def headed(lines: DataFrame, head: str) -> DataFrame:
    """Lines (value string), before those of each partition the lines of head: each file that a task writes begins with them."""

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": pa.array([head])})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], ["value"])

    return lines.mapInArrow(run, "value string")


@query("SELECT ts AS time, event_id, user_id, event_type, value FROM events")
def s8_csv_preambles(load, spark):
    """Files that each begin with two lines of a preamble and a header, with a delimiter of their own."""
    path = paths.scratch(spark, "csv")
    line = F.concat_ws(";", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "event_id", "user_id", F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("value").cast("string"))
    for part in range(3):
        body = load("events").filter(F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(3)) == part).select(line.alias("value"))
        headed(body, "# written by a device\n# for a test\nwhen;event_id;user_id;event_type;value").write.mode("append").text(path)
    return import_csv(spark, path, "when", delimiter=";", skip_rows=2)


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1700000000 + event_id WHEN event_id % 4 = 1 THEN 1700000000123 WHEN event_id % 4 = 2 THEN 1700000000123456 ELSE 1700000000123456789 END AS t, CASE WHEN event_id % 4 = 0 THEN (1700000000 + event_id) * 1000000 WHEN event_id % 4 = 1 THEN 1700000000123000 ELSE 1700000000123456 END AS us, CASE WHEN event_id % 4 = 0 THEN (1700000000 + event_id) * 1000000 WHEN event_id % 4 = 1 THEN 1700000000123000 ELSE 1700000000123456 END AS mqtt FROM events")
def s6b_epoch_units(load, spark):
    i = F.col("event_id")
    t = F.when(i % 4 == 0, 1700000000 + i).when(i % 4 == 1, 1700000000123).when(i % 4 == 2, 1700000000123456).otherwise(1700000000123456789)
    return load("events").select("event_id", t.alias("t"), epoch_to_micros(t).alias("us"), mqtt_epoch_to_micros(t).alias("mqtt"))


@query("SELECT ts AS time, 'd' || user_id AS dn, value AS temperature, event_id AS seq FROM events")
def s7_messages(load, spark):
    e = load("events")
    us = micros("ts")
    text = F.to_json(F.struct(us.alias("timestamp"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("dn"), F.struct(F.col("value").alias("temperature")).alias("properties"), F.col("event_id").alias("seq")))
    return to_table(messages(e.select(text.alias("value"))), "mqtt")[0]


@query("SELECT ts AS time, event_id, user_id, event_type, value FROM events")
def s8_csv_import(load, spark):
    path = paths.scratch(spark, "csv")
    load("events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("when"), "event_id", "user_id", "event_type", "value").write.option("header", True).csv(path)
    return import_csv(spark, path, "when")


@query("SELECT event_id, ts AS iso, date_trunc('second', ts) AS sec, date_trunc('day', ts) AS day FROM events")
def s8a_import_times(load, spark):
    e = load("events")
    us = micros("ts")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    return e.select("event_id", parse_time(iso).alias("iso"), parse_time(F.floor(us / 1000000).cast("string"), "epoch_s").alias("sec"), parse_time(F.date_format("ts", "yyyy-MM-dd")).alias("day"))


@query("SELECT o_orderdate AS time, o_orderkey, o_totalprice, o_orderstatus, CAST(o_totalprice AS DECIMAL(18, 2))::DOUBLE AS price, epoch_us(o_orderdate) AS stamp FROM orders")
def s9_parquet_import(load, spark):
    path = paths.scratch(spark, "import")
    o = load("orders")
    o.select("o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderdate").alias("stamp")).write.parquet(path)
    return import_parquet(spark, path, "o_orderdate")


@query("SELECT strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hr, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2")
def k2_hour_partitions(load, spark):
    lake = lake_of(spark, "k2")
    lake.write(events(load), "main", "events", ["event_type", "host"], sort_keys=["host"])
    return lake.read("main", "events", internal=True).groupBy("dt", "hr").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@query(PLAIN)
def m1_compaction(load, spark):
    lake = lake_of(spark, "m1")
    e = events(load)
    for part in range(3):
        lake.write(e.filter(F.col("event_id") % 3 == part), "main", "events", ["event_type", "host", "event_id"])
    maintenance.compact(lake, "main", "events", least=2)
    return lake.read("main", "events")


@query("SELECT * FROM (SELECT ts AS time, event_type, value, event_id FROM events) QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('day', time) ORDER BY event_id DESC) = 1")
def m4_dedup_last_wins(load, spark):
    e = load("events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time"), "event_type", "value", "event_id", F.col("ts").alias("at"))
    kept = maintenance.dedup(e.withColumn("_seq", F.col("event_id")), ["event_type"]).drop("_seq")
    return kept.select(F.col("at").alias("time"), "event_type", "value", "event_id")


@query("SELECT event_id, ts AS time FROM events")
def m5_time_normalisation(load, spark):
    e = load("events")
    us = micros("ts")
    text = F.when(F.col("event_id") % 2 == 0, us.cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return e.select("event_id", maintenance.normalised_time(text).alias("time"))


@query(f"SELECT * FROM ({PLAIN}) QUALIFY max(time) OVER (PARTITION BY date_trunc('hour', time)) >= TIMESTAMP '2024-01-15 12:30:00'")
def m7_retention(load, spark):
    lake = lake_of(spark, "m7")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    maintenance.retain(lake, "main", "events", days=10, now=datetime(2024, 1, 25, 12, 30))
    return lake.read("main", "events")


@query(f"SELECT * FROM (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN value END AS value) FROM ({PLAIN})) WHERE NOT coalesce(value > 20 AND event_type = 'view', false)")
def m8_delete(load, spark):
    lake = lake_of(spark, "m8")
    e = events(load).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    lake.write(e, "main", "events", ["event_type", "host"])
    maintenance.delete_where(lake, "main", "events", "value > 20 and event_type = 'view'")
    return lake.read("main", "events")


HOURS = "SELECT DISTINCT strftime(ts, 'dt=%Y-%m-%d/hr=%H') AS path, CAST(date_part('hour', ts) AS INT) AS h FROM events"


@query(f"SELECT path, 'orphan' AS problem FROM ({HOURS}) WHERE h % 5 = 0 UNION ALL SELECT path || '/lost', 'missing' FROM ({HOURS}) WHERE h % 7 = 0")
def m12_reconcile(load, spark):
    """The files that a store lists against a list that lacks some of them and has others that are gone."""
    lake = lake_of(spark, "m12")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    listing = [(maintenance.folder_of(f), size, modified) for f, size, modified in paths.files(spark, lake.path("main", "events"))]
    stored = spark.createDataFrame(listing, "path string, bytes long, modified long")
    hour = F.substring("path", -2, 2).cast("int")
    listed = stored.filter(hour % 5 != 0).select("path").unionByName(stored.filter(hour % 7 == 0).select(F.concat("path", F.lit("/lost")).alias("path")))
    return maintenance.reconcile(stored, listed, now_ms=1 << 60)


@query("SELECT 'main' AS database, 'events' AS table_name, 'hot' AS tier, count(DISTINCT date_trunc('hour', ts)) AS file_count, true AS bytes_agree FROM events")
def i2_measurements(load, spark):
    """One file an hour; the bytes agree with what a listing of the files' contents gives."""
    lake = lake_of(spark, "i2")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(lake.path("main", "events")).agg(F.sum("length")).first()[0]
    return lake.stats("main").select("database", "table_name", "tier", "file_count", (F.col("total_bytes") == listed).alias("bytes_agree"))


@query("SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-05 12:00:00' GROUP BY 1, 2")
def c1_continuous_query(load, spark):
    lake = lake_of(spark, "c1")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    text = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM main.events WHERE time >= {start_time} AND time < {end_time} GROUP BY event_type"
    cq = ContinuousQuery(lake, "main", "events", "hourly", text, "1h", tags=("event_type",))
    paths.write_text(spark, cq.progress, "2024-01-05T00:00:00")
    cq.advance(datetime(2024, 1, 5, 12, 20))
    cq.run(datetime(2024, 1, 5, 3), datetime(2024, 1, 5, 4))  # again: the copies go when the target is compacted
    maintenance.compact(lake, "main", "hourly", least=1)
    return lake.read("main", "hourly")


@query("SELECT time_bucket(INTERVAL '5 hours', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def c8_streaming_buckets(load, spark):
    df = load("events")
    folder = paths.scratch(spark, "source")
    df.write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    out = drained(stream_buckets(stream, "5 hours", keys=("event_type",)), spark)
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("total", 4).alias("total"))


@query(PLAIN)
def c7_streaming_ingest(load, spark):
    from tidelake.streaming.continuous import ingest

    lake, folder = lake_of(spark, "c7"), paths.scratch(spark, "source")
    e = events(load)
    e.write.parquet(folder)
    ingest(spark.readStream.schema(e.schema).parquet(folder), lake, "main", "events", paths.scratch(spark, "state"), ["event_type", "host"]).awaitTermination()
    return lake.read("main", "events")


DIALECT = """
SELECT time_bucket(INTERVAL '6 hours', ts) AS b, event_type, count(*) AS n, round(quantile_cont(value, 0.9), 6) AS p90, max(event_id) // 7 AS q, max(event_id)::VARCHAR AS s
FROM events SEMI JOIN (SELECT user_id FROM events WHERE event_type = 'purchase') p USING (user_id)
WHERE strlen(event_type) > 4 GROUP BY 1, 2 ORDER BY n DESC, b, event_type LIMIT 40
"""


@query(DIALECT)
def d1_dialect(load, spark):
    from tidelake.plans.dialect import run

    load("events").createOrReplaceTempView("events")
    return run(spark, DIALECT)


@query("SELECT e.event_type, count(*) AS n, round(sum(e.value), 4) AS total FROM events e JOIN events o ON o.event_id = e.event_id AND o.event_id % 2 = 0 WHERE e.ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def j11_cross_database(load, spark):
    from tidelake.plans.lake_sql import lake_sql

    lake = lake_of(spark, "j11")
    e = events(load)
    lake.write(e, "main", "events", ["event_type", "host"])
    lake.write(e.filter("event_id % 2 = 0").select("time", "event_id"), "ops", "even")
    return lake_sql(lake, "SELECT e.event_type, count(*) AS n, round(sum(e.value), 4) AS total FROM main.events e JOIN ops.even o ON o.event_id = e.event_id WHERE e.time >= TIMESTAMP_NTZ '2024-01-05 00:00:00' GROUP BY 1")


@query("SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-09 07:30:00' AND TIMESTAMP '2024-01-12 05:00:00' AND value > 1 GROUP BY 1")
def s2_sql_pruned(load, spark):
    """The bounds are taken from the optimised plan and prune the folders by hour."""
    from tidelake.plans.lake_sql import lake_sql

    lake = lake_of(spark, "s2sql")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    return lake_sql(lake, "SELECT event_type, count(*) AS n, min(time) AS first, max(time) AS last FROM events WHERE time BETWEEN TIMESTAMP '2024-01-09 07:30:00' AND TIMESTAMP '2024-01-12 05:00:00' AND value > 1 GROUP BY 1")


@query(PLAIN)
def m2_daily_compaction(load, spark):
    lake = lake_of(spark, "m2")
    lake.write(events(load), "main", "events", ["event_type", "host", "event_id"])
    maintenance.compact(lake, "main", "events", least=12, daily=True)
    return lake.read("main", "events")


@query("SELECT strftime(ts, '%Y-%m-%d') AS dt, CASE WHEN date_trunc('day', ts) < TIMESTAMP '2024-01-20' THEN 'day' ELSE strftime(ts, '%H') END AS hr, 1 AS files, count(*) AS n, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-03 05:30:00' AND TIMESTAMP '2024-01-25 09:00:00') AS within FROM events GROUP BY 1, 2 HAVING within > 0")
def m2_day_files(load, spark):
    """Days that are over have one file of their own; ranges of time still find their rows in days and in hours."""
    lake = lake_of(spark, "m2d")
    lake.write(events(load), "main", "events", ["event_type", "host", "event_id"])
    maintenance.compact(lake, "main", "events", least=12, daily=True, older_than=datetime(2024, 1, 20))
    whole = lake.read("main", "events", internal=True).groupBy("dt", "hr").agg(F.countDistinct("_metadata.file_path").cast("int").alias("files"), F.count(F.lit(1)).alias("n"))
    within = lake.read("main", "events", "2024-01-03 05:30:00", "2024-01-25 09:00:00.000001", internal=True).groupBy("dt", "hr").agg(F.count(F.lit(1)).alias("within"))
    return whole.join(within, ["dt", "hr"])


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def c9_sessions(load, spark):
    """Sessions with pauses shorter than half an hour, over a stream of all events."""
    from tidelake.streaming.continuous import stream_sessions

    df, folder = load("events"), paths.scratch(spark, "source")
    df.write.parquet(folder)
    out = drained(stream_sessions(spark.readStream.schema(df.schema).parquet(folder)), spark)
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


TOOLS = [("list_databases", ""), ("list_measurements", "database"), ("describe_measurement", "database, measurement"), ("sample_data", "database, measurement, rows"), ("query", "sql, database"), ("write_data", "database, lines"), ("help", "")]


@query("SELECT 'rows' AS what, count(*) AS n, 'event_type:tag host:tag time:time value:field event_id:field' AS said FROM events UNION ALL SELECT 'sample', 7, '' UNION ALL SELECT 'written', 2, 'cpu' UNION ALL SELECT 'help', " + str(len(TOOLS)) + ", '" + "; ".join(f"{n}({a})" for n, a in TOOLS) + "'")
def i9_assistant_tools(load, spark):
    from tidelake.operators.tools import Tools

    lake = lake_of(spark, "i9")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    tools = Tools(lake, [("main", "*")], writes=True)
    kinds = {r["column_name"]: r["column_kind"] for r in tools.call("describe_measurement", database="main", measurement="events")}
    told = " ".join(f"{c}:{kinds[c]}" for c in ("event_type", "host", "time", "value", "event_id"))
    rows = [("rows", tools.call("query", sql="SELECT count(*) AS n FROM events")[0]["n"], told)]
    rows.append(("sample", len(tools.call("sample_data", database="main", measurement="events", rows=7)), ""))
    rows.append(("written", tools.call("write_data", database="main", lines="cpu,host=a u=1 1\ncpu,host=b u=2 2")[0]["rows"], tools.call("list_measurements", database="main")[0]["table_name"]))
    found = tools.call("help")
    rows.append(("help", len(found), "; ".join(f"{t['tool']}({t['arguments']})" for t in found)))
    return spark.createDataFrame(rows, "what string, n long, said string")


@query("SELECT 'kept' AS database, count(*) AS n FROM events")
def m13_drop_database(load, spark):
    lake = lake_of(spark, "m13")
    for db in ("kept", "gone"):
        lake.write(events(load), db, "events", ["event_type", "host"])
    lake.drop_database("gone", confirm=True)
    left = lake.databases()
    return lake.read("kept", "events").groupBy(F.lit(",".join(left)).alias("database")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT ts AS time, event_type, value, event_id FROM events")
def s10_line_file_import(load, spark):
    """Files of lines: comments and broken lines are left out."""
    e = load("events")
    line = F.concat(F.lit("ev,event_type="), "event_type", F.lit(" value="), F.col("value").cast("string"), F.lit(",event_id="), F.col("event_id").cast("string"), F.lit("i "), micros("ts").cast("string"))
    path = paths.scratch(spark, "lines")
    e.select(F.explode(F.array(F.lit("# a comment"), line, F.lit("broken"))).alias("value")).write.text(path)
    return to_table(line_protocol(spark.read.text(path), precision="us"), "ev")[0]


@query("SELECT CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 3 = 1 THEN 'host_' || user_id ELSE 'u' || user_id END AS host, count(*) AS n, sum(event_id) AS field_0, round(sum(value), 4) AS field_1 FROM events GROUP BY 1")
def s6a_host_default(load, spark):
    e = load("events")
    host = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(',"h":'), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 2, F.concat(F.lit(',"h":"u'), F.col("user_id").cast("string"), F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"m":7,"t":'), micros("ts").cast("string"), host, F.lit(',"f":['), F.col("event_id").cast("string"), F.lit(","), F.col("value").cast("string"), F.lit("]}"))
    table, _ = to_table(records(e.select(text.alias("value"))), "measurement_7")
    return table.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("field_0").alias("field_0"), F.round(F.sum("field_1"), 4).alias("field_1"))


ORBITS = """
WITH t AS (SELECT s_suppkey % 100000 AS k, 1 + (s_suppkey % 150) / 10.0 AS n, (s_suppkey % 70) / 1000.0 * 10 AS e FROM supplier),
a AS (SELECT *, pow(3.986004418e14 / pow(n * 2 * pi() / 86400.0, 2), 1.0 / 3) / 1000.0 AS a FROM t),
h AS (SELECT *, a * (1 - e) - 6371.0 AS p, a * (1 + e) - 6371.0 AS q FROM a)
SELECT lpad(k::VARCHAR, 5, '0') AS norad_id, 'SAT ' || k AS object_name, TIMESTAMP '2024-01-01' + to_hours(CAST(k % 360 * 24 + 12 AS INT)) AS time, round(a, 3) AS semi_major_axis_km, round(1440.0 / n, 6) AS period_min,
'U' AS classification, '98067A' AS international_designator, 51.6416::DOUBLE AS inclination_deg, 247.4627::DOUBLE AS raan_deg, round(e, 7)::DOUBLE AS eccentricity, 130.536::DOUBLE AS arg_perigee_deg, 325.0288::DOUBLE AS mean_anomaly_deg,
round(n, 8)::DOUBLE AS mean_motion_rev_day, round(-0.11606 * pow(10, -4), 12) AS bstar, 0.00002182::DOUBLE AS mean_motion_dot, 0.0::DOUBLE AS mean_motion_ddot, 56353.0::DOUBLE AS revolution_number, round(q, 3) AS apogee_km, round(p, 3) AS perigee_km,
CASE WHEN p < 0 THEN 'SUB' WHEN e > 0.25 AND q > 35786.0 THEN 'HEO' WHEN (p + q) / 2 > 35586.0 AND (p + q) / 2 < 35986.0 THEN 'GEO' WHEN q < 2000.0 THEN 'LEO' WHEN p >= 2000.0 AND q <= 35786.0 THEN 'MEO' ELSE 'HEO' END AS orbit_type
FROM h
"""


@query(ORBITS)
def s11_two_line_elements(load, spark):
    from tidelake.sources.tle import two_line_elements

    k = F.col("s_suppkey") % 100000
    number = F.lpad(k.cast("string"), 5, "0")
    one = F.concat(F.lit("1 "), number, F.lit("U 98067A   24"), F.format_string("%012.8f", (k % 360 + 1.5).cast("double")), F.lit("  .00002182  00000-0 -11606-4 0  292"))
    ecc = F.lpad(((F.col("s_suppkey") % 70) * 100_000).cast("string"), 7, "0")
    two = F.concat(F.lit("2 "), number, F.lit("  51.6416 247.4627 "), ecc, F.lit(" 130.5360 325.0288 "), F.format_string("%11.8f", (1 + (F.col("s_suppkey") % 150) / 10).cast("double")), F.lit("56353"))
    digit = lambda c: F.coalesce(c.try_cast("int"), (c == "-").cast("int"))
    checked = lambda c: F.concat(c, (F.aggregate(F.split(c, ""), F.lit(0), lambda s, x: s + digit(x)) % 10).cast("string"))
    text = F.concat(F.lit("SAT "), k.cast("string"), F.lit("\n"), checked(one), F.lit("\n"), checked(two), F.lit("\n"))
    out = two_line_elements(load("supplier").select(text.alias("value")))
    places = {"semi_major_axis_km": 3, "period_min": 6, "apogee_km": 3, "perigee_km": 3, "eccentricity": 7, "mean_motion_rev_day": 8, "bstar": 12}
    return out.select(*(F.round(c, places[c]).alias(c) if c in places else c for c in out.columns))


@query("SELECT CASE WHEN date_trunc('hour', ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-15' THEN 'cold' ELSE 'hot' END AS tier, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1")
def m9_tier_migration(load, spark):
    lake = lake_of(spark, "m9", cold=True)
    lake.write(events(load), "main", "events", ["event_type", "host"])
    maintenance.migrate(lake, "main", "events", 10, datetime(2024, 1, 25))
    tiers = [d.select("time", F.lit(t).alias("tier")) for t in lake.tiers() if (d := lake._scan(lake.path("main", "events", t))) is not None]
    rows = functools.reduce(DataFrame.unionByName, tiers)
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


@query(f"SELECT * FROM ({PLAIN}) WHERE time >= TIMESTAMP '2024-01-13 07:30:00' AND time < TIMESTAMP '2024-01-17 05:00:00'")
def m10_tier_lookup(load, spark):
    """A range over both tiers: each tier's folders are pruned by it."""
    lake = lake_of(spark, "m10", cold=True)
    lake.write(events(load), "main", "events", ["event_type", "host"])
    maintenance.migrate(lake, "main", "events", 10, datetime(2024, 1, 25))
    return lake.read("main", "events", "2024-01-13 07:30:00", "2024-01-17 05:00:00")


@query(PLAIN)
def m6_broken_files(load, spark):
    """Files that are no Parquet lie among the others; reads skip them, compaction leaves them."""
    lake = lake_of(spark, "m6")
    e = events(load)
    for part in range(2):
        lake.write(e.filter(F.col("event_id") % 2 == part), "main", "events", ["event_type", "host", "event_id"])
    for folder in sorted(maintenance.by_folder(lake, lake.path("main", "events")))[:3]:
        paths.write_text(spark, f"{lake.path('main', 'events')}/{folder}/broken.parquet", "no Parquet file at all")
    maintenance.compact(lake, "main", "events", least=2)
    return lake.read("main", "events")


@query("SELECT date_trunc('hour', ts) AS time, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-09' GROUP BY 1")
def c3_backfill(load, spark):
    """An explicit range, run twice; its rows have a time of their own and no tags."""
    lake = lake_of(spark, "c3")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    text = "SELECT cast(date_trunc('hour', time) AS timestamp_ntz) AS time, count(*) AS n, count(DISTINCT host) AS users FROM main.events WHERE time >= {start_time} AND time < {end_time} GROUP BY 1"
    cq = ContinuousQuery(lake, "main", "events", "hours", text)
    for _ in range(2):
        cq.run(datetime(2024, 1, 7), datetime(2024, 1, 9))
    maintenance.compact(lake, "main", "hours", least=1)
    return lake.read("main", "hours")


@query("SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-13 12:00:00') AS too_old, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 13:00:00') AS ahead FROM events")
def c10_misplaced_times(load, spark):
    from tidelake.streaming.continuous import misplaced

    return misplaced(events(load), datetime(2024, 1, 20, 12))
