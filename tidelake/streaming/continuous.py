"""Continuous queries over windows of time, and the same work on Structured Streaming."""

from __future__ import annotations

import dataclasses
import hashlib
import re
import threading
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake import paths
from tidelake.catalog import Lake
from tidelake.plans import lake_sql
from tidelake.plans.translate import translate
from tidelake.sources.points import to_table

#: The first run looks back so far; the shortest interval of a schedule.
FIRST, SHORTEST = timedelta(hours=1), timedelta(seconds=10)
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}


def duration(text: str) -> timedelta:
    """A duration like 1h30m or 90s."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"no duration: {text!r}")
    return timedelta(seconds=sum(float(a) * UNITS[b] for a, b in parts))


@dataclasses.dataclass
class ContinuousQuery:
    """SQL with {start_time} and {end_time} over source, run window by window into target.

    The SQL is the dialect's, checked like any user's: one query, of what is allowed, of tables that the lake has.

    The rows are written before the progress is, so a run that fails is run again; rows without a time get the
    window's start, and the target is deduplicated by its tags and time, so running again changes nothing. Without
    tags a time must be unique; a window where it is not is refused before anything is written.
    """

    lake: Lake
    db: str
    source: str
    target: str
    sql: str
    interval: str = "1h"
    tags: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if "{start_time}" not in self.sql or "{end_time}" not in self.sql:
            raise ValueError("the query needs {start_time} and {end_time}")
        if duration(self.interval) < SHORTEST:
            raise ValueError(f"the interval is shorter than {SHORTEST}")
        now = datetime(2000, 1, 1)
        lake_sql.references(self.lake.spark, translate(self.text(now, now)))  # refuses what is no query

    @property
    def progress(self) -> str:
        return f"{self.lake.root}/_continuous/{self.db}.{self.target}"

    def last(self) -> datetime | None:
        text = paths.read_text(self.lake.spark, self.progress)
        return datetime.fromisoformat(text) if text else None

    def text(self, start: datetime, end: datetime) -> str:
        stamp = lambda t: f"TIMESTAMP '{t.isoformat(sep=' ')}'"
        return self.sql.replace("{start_time}", stamp(start)).replace("{end_time}", stamp(end))

    def result(self, start: datetime, end: datetime) -> DataFrame:
        """The window's rows; the source's name is found in the parsed query, and only the window's folders are read."""
        text = translate(self.text(start, end))
        refs = [(a, b, *lake_sql.named(parts, self.db)) for a, b, parts in lake_sql.references(self.lake.spark, text)]
        out = lake_sql.bound(self.lake, text, refs, {(self.db, self.source): (start, end)})
        return out if "time" in out.columns else out.withColumn("time", F.lit(str(start)).cast("timestamp_ntz"))

    def run(self, start: datetime, end: datetime, dry_run: bool = False) -> str:
        """One window, by hand or again; a dry run gives the SQL alone."""
        if end <= start:
            raise ValueError("the window is empty")
        if dry_run:
            return self.text(start, end)
        out = self.result(start, end).persist()
        try:
            tags = [t for t in self.tags if t in out.columns]
            if not tags and not out.groupBy("time").count().filter("count > 1").isEmpty():
                raise ValueError("rows of one time and no tags to tell them apart by: state the tags")
            self.lake.write(out, self.db, self.target, tags=tags, dedup_time=not tags)
        finally:
            out.unpersist()
        return self.text(start, end)

    def advance(self, now: datetime) -> list[tuple[datetime, datetime]]:
        """Runs from where the last run ended (at first: an hour back) up to now, in steps of the interval."""
        start, step, done = self.last() or now - FIRST, duration(self.interval), []
        while start + step <= now:
            self.run(start, start + step)
            paths.write_text(self.lake.spark, self.progress, (start + step).isoformat())
            done.append((start, start + step))
            start += step
        return done


def schedule(queries: list[ContinuousQuery], stop: threading.Event, now: Callable[[], datetime], failed: Callable[[ContinuousQuery, Exception], None]) -> list[threading.Thread]:
    """Advances each query in a thread of its own, once in its interval, until stop is set.

    A run that fails is reported and its windows are run at the next turn, as progress is kept after the rows.
    """

    def turns(cq: ContinuousQuery) -> None:
        while not stop.is_set():
            try:
                cq.advance(now())
            except Exception as e:  # noqa: BLE001  (one query's failure must not end its schedule)
                failed(cq, e)
            stop.wait(duration(cq.interval).total_seconds())

    threads = [threading.Thread(target=turns, args=(cq,), daemon=True) for cq in queries]
    for t in threads:
        t.start()
    return threads


def misplaced(df: DataFrame, now: datetime, old: timedelta = timedelta(days=7), ahead: timedelta = timedelta(hours=1)) -> DataFrame:
    """(too_old, ahead): how many rows of a write lie far from now; they are reported, never refused."""
    bound = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    return df.agg(F.count_if(F.col("time") < bound(now - old)).alias("too_old"), F.count_if(F.col("time") > bound(now + ahead)).alias("ahead"))


def stream_buckets(stream: DataFrame, width: str = "1 hour", late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums of a stream (ts, value, ...) by tumbling windows, with a watermark for late rows.

    Watermarks need timestamps with a zone; buckets start where time_bucket()'s do.
    """
    from tidelake.functions.time import bucket_width

    seconds = bucket_width(width)[0] // 1_000_000
    shift = f"{946857600 % seconds} seconds"
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", f"{seconds} seconds", f"{seconds} seconds", shift), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("bucket"), *keys, "n", "total")


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Sessions of a stream's rows with pauses shorter than gap."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def ingest(stream: DataFrame, lake: Lake, db: str, name: str, checkpoint: str, tags: list[str] = (), available_now: bool = True, every: str = "5 seconds"):
    """Appends a stream (time, ...) to a measurement, micro-batch by micro-batch.

    A batch is written under its number and the checkpoint's name, so one that is run again after a failure takes the
    place of what it left: rows are there once.
    """
    stream_name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(df: DataFrame, number: int) -> None:
        lake.write(df, db, name, tags, batch=f"{stream_name}-{number}")

    return _started(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now, every)


def _started(writer, available_now: bool, every: str):
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def ingest_points(stream: DataFrame, lake: Lake, db: str, checkpoint: str, available_now: bool = True, every: str = "5 seconds"):
    """Appends a stream of points (messages(), records(), line_protocol() over landed payloads or a queue's values).

    Each measurement in a micro-batch is written as a table of its own; a batch is decoded once. Written as in ingest().
    """
    stream_name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write(df: DataFrame, number: int) -> None:
        points = paths.stored(df, "points")
        for r in points.select("measurement").distinct().collect():  # measurements, not rows
            table, tags = to_table(points, r["measurement"])
            lake.write(table, db, r["measurement"], tags, batch=f"{stream_name}-{number}")

    return _started(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), available_now, every)


def drained(stream: DataFrame, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder."""
    out, state = paths.scratch(spark, "stream"), paths.scratch(spark, "state")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    paths.delete(spark, state)
    return spark.read.schema(stream.schema).parquet(out)
