"""Imports of CSV and Parquet files with the engine's own types."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake import paths
from tidelake.functions.time import at, epoch_to_micros

UNITS = {"epoch_s": 1_000_000, "epoch_ms": 1_000, "epoch_us": 1}


def check_header(columns: list[str], time_column: str) -> None:
    """Empty and repeated names, a missing time column and a second column called time are refused."""
    if any(not c.strip() for c in columns):
        raise ValueError("a column has no name")
    if len({c.lower() for c in columns}) != len(columns):
        raise ValueError("a column's name is repeated")
    if time_column not in columns:
        raise ValueError(f"no column {time_column!r}")
    if time_column != "time" and "time" in columns:
        raise ValueError("another column is called time already")


def parse_time(c: Column, time_format: str = "auto") -> Column:
    """A time of text: epochs by a stated unit or by size, or ISO dates and times; null if it is none."""
    s = F.trim(c.cast("string"))
    number = s.try_cast("double")
    good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9e18) & ~F.lower(s).rlike("nan|inf")
    whole = s.try_cast("long")
    if time_format in UNITS:
        micros = F.coalesce(whole * UNITS[time_format], F.round(number * UNITS[time_format]).try_cast("long"))
    elif time_format == "epoch_ns":
        micros = ((whole - F.pmod(whole, F.lit(1000))).cast("decimal(20,0)") / 1000).cast("long")
    else:
        micros = F.coalesce(epoch_to_micros(whole), epoch_to_micros(F.floor(number)) + F.round((number - F.floor(number)) * 1e6).cast("long"))
    epoch = F.when(good, F.timestamp_add("MICROSECOND", micros, at("1970-01-01")))
    if time_format.startswith("epoch"):
        return epoch
    return F.coalesce(epoch, F.when(s.rlike(r"^\d{4}-\d\d-\d\d"), _iso(s)))


def _iso(s: Column) -> Column:
    zoned = s.rlike(r"([zZ]|[+-]\d\d:?\d\d)$") & s.rlike("[T ]")
    # a stated zone is taken into account, whatever the session's is
    micros = F.unix_micros(s.try_cast("timestamp"))
    return F.when(zoned, F.timestamp_add("MICROSECOND", micros, at("1970-01-01"))).otherwise(s.try_cast("timestamp_ntz"))


def inferred(df: DataFrame, skip: list[str] = ()) -> DataFrame:
    """String columns as the first of long, double and boolean that all their values are, empty ones being null.

    One pass counts for all columns; columns without any value and mixed ones stay strings, with empty strings.
    """
    cols = [c for c in df.columns if c not in skip]
    if not cols:
        return df
    some = lambda c: F.col(f"`{c}`").isNotNull() & (F.trim(f"`{c}`") != "")
    is_bool = lambda c: F.lower(F.trim(f"`{c}`")).isin("true", "false")
    tests = {"long": lambda c: F.trim(f"`{c}`").rlike(r"^[+-]?\d+$") & F.trim(f"`{c}`").try_cast("long").isNotNull(), "double": lambda c: F.trim(f"`{c}`").try_cast("double").isNotNull() & ~F.lower(f"`{c}`").rlike("[df]$"), "boolean": is_bool}
    row = df.agg(*(F.count_if(some(c) & (t(c) if t else F.lit(True))).alias(f"{i}_{k}") for i, c in enumerate(cols) for k, t in [("n", None), *tests.items()])).first()
    out = {}
    for i, c in enumerate(cols):
        n = row[f"{i}_n"]
        kind = next((k for k in tests if n and row[f"{i}_{k}"] == n), None)
        out[c] = F.when(some(c), F.trim(f"`{c}`").try_cast(kind)) if kind else F.coalesce(F.col(f"`{c}`"), F.lit(""))
    return df.withColumns(out)


def import_csv(spark: SparkSession, path: str, time_column: str = "time", time_format: str = "auto", delimiter: str = ",", skip_rows: int = 0) -> DataFrame:
    """time and typed columns of CSV files with a header; short rows are padded, a byte order mark is dropped."""
    if skip_rows:
        # each file has its own preamble and header; a file's first range is where its lines are counted
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        lines = spark.read.text(path).select("value", *place).withColumn("n", F.monotonically_increasing_id())
        first = lines.filter("block = 0").groupBy("file").agg(F.min("n").alias("first"))
        lines = lines.join(F.broadcast(first), "file").withColumn("i", F.when(F.col("block") == 0, F.col("n") - F.col("first")))  # one row a file
        header = lines.filter(F.col("i") == skip_rows).orderBy("file").first()
        if header is None:
            raise ValueError("no header after the rows to skip")
        names = next(csv.reader([header["value"].lstrip("\ufeff")], delimiter=delimiter))
        schema = ", ".join("`" + c.strip().replace("`", "``") + "` string" for c in names)
        body = lines.filter((F.col("i") > skip_rows) | F.col("i").isNull()).filter(F.trim("value") != "")
        df = body.select(F.from_csv("value", schema, {"sep": delimiter, "escape": '"'}).alias("r")).select("r.*")
    else:
        df = spark.read.option("header", True).option("sep", delimiter).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
        df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    check_header(df.columns, time_column)
    df = inferred(df, [time_column])
    rest = [F.col(f"`{c}`") for c in df.columns if c != time_column]
    return df.select(parse_time(F.col(f"`{time_column}`"), time_format).alias("time"), *rest)


def import_parquet(spark: SparkSession, path: str, time_column: str = "time") -> DataFrame:
    """time and columns of Parquet files as long, double, string or boolean; times other than `time` are microseconds."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    check_header(df.columns, time_column)
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if f.name == time_column:
            out.append((c.cast("timestamp_ntz") if kind.startswith("timestamp") else parse_time(c)).alias("time"))
        elif kind in ("byte", "short", "integer", "long"):
            out.append(c.cast("long").alias(f.name))
        elif kind in ("float", "double") or kind.startswith("decimal"):
            out.append(c.cast("double").alias(f.name))
        elif kind in ("string", "binary"):
            out.append(c.cast("string").alias(f.name))
        elif kind == "boolean":
            out.append(c)
        elif kind.startswith("timestamp"):
            out.append(F.timestamp_diff("MICROSECOND", at("1970-01-01"), c.cast("timestamp_ntz")).alias(f.name))
        else:
            raise ValueError(f"column {f.name!r}: type {kind} cannot be imported")
    return df.select(*out)


def ingest_parquet(lake, source: str | bytes, db: str, name: str, tags: list[str] = (), time_column: str = "time", batch: str | None = None) -> int:
    """Writes an agent's Parquet body (bytes), or the files at a path, into a measurement; the rows that were written.

    Types and times are those of import_parquet(): whole numbers of time by the unit that their size tells. Rows without
    a time are left out.
    """
    spark = lake.spark
    if isinstance(source, bytes | bytearray):
        path = paths.scratch(spark, "body") + ".parquet"
        paths.write_bytes(spark, path, bytes(source))
    else:
        path = source
    rows = paths.stored(import_parquet(spark, path, time_column), "import")
    lake.write(rows, db, name, tags, batch=batch)
    return rows.filter("time is not null").count()
