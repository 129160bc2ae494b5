"""Databases of measurements: folders of Parquet files by hour, with what Parquet schemas cannot say beside them."""

from __future__ import annotations

import json
import re
import time as clock
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake import paths

NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_-]{0,127}")
#: Partition columns, strings of a day and an hour, and the column that tells writes apart.
DAY, HOUR, SEQUENCE = "dt", "hr", "_seq"
PARTITIONS = f"{DAY} string, {HOUR} string"
PROPERTIES = "_properties.json"
HOT, COLD = "hot", "cold"
#: The hour folder of files that hold a whole day: it sorts after all hours.
WHOLE_DAY = "day"


#: Properties of a measurement: which columns are tags, how its files are sorted and split, what its rows are told
#: apart by, types that writers declare; the columns of all writes, and whether writes differ in a column's type.
NEW = {"tags": [], "sort_keys": [], "dedup_time": False, "decimals": {}, "files_per_hour": 1, "columns": {}, "mixed": False}


#: How files are written; rows of a group are as many as scans take at a time.
PARQUET = {"compression": "zstd", "parquet.block.row.count.limit": "122880", "parquet.enable.dictionary": "true"}


class Lake:
    """A folder of databases; each database holds measurements, made by their first write.

    root may have a cold twin: whole hours move there by age, and reads take both.
    """

    def __init__(self, spark: SparkSession, root: str, cold: str | None = None) -> None:
        self.spark, self.root, self.cold = spark, root.rstrip("/"), cold.rstrip("/") if cold else None

    # ------------------------------------------------------------ names and properties

    def path(self, db: str, name: str, tier: str = HOT) -> str:
        for n in (db, name):
            if not NAME.fullmatch(n):
                raise ValueError(f"no valid name: {n!r}")
        return f"{self.cold if tier == COLD else self.root}/{db}/{name}"

    def tiers(self) -> list[str]:
        return [HOT, COLD] if self.cold else [HOT]

    def properties(self, db: str, name: str) -> dict:
        text = paths.read_text(self.spark, f"{self.path(db, name)}/{PROPERTIES}")
        return NEW | (json.loads(text) if text else {})

    def set_properties(self, db: str, name: str, **changes) -> dict:
        """tags are united with what is there, columns' types are widened; others are replaced. One writer at a time."""
        path = f"{self.path(db, name)}/{PROPERTIES}"

        def changed() -> tuple[dict, dict]:
            now = self.properties(db, name)
            new = now | changes | {"tags": sorted({*now["tags"], *changes.get("tags", [])})}
            if "columns" in changes:
                new["columns"], new["mixed"] = dict(now["columns"]), now["mixed"]
                for c, kind in changes["columns"].items():
                    known = new["columns"].setdefault(c, kind)
                    new["mixed"] |= known != kind
                    new["columns"][c] = known if known == kind else widest({known, kind})
            return now, new

        now, new = changed()
        if new != now or not paths.exists(self.spark, path):
            with paths.lock(self.spark, f"{self.path(db, name)}/_lock"):
                _, new = changed()
                paths.write_text(self.spark, path, json.dumps(new))
        return new

    def settle(self, db: str, name: str) -> None:
        """Notes that all files have the columns' widest types, as after a rewrite of all."""
        with paths.lock(self.spark, f"{self.path(db, name)}/_lock"):
            paths.write_text(self.spark, f"{self.path(db, name)}/{PROPERTIES}", json.dumps(self.properties(db, name) | {"mixed": False}))

    def databases(self) -> list[str]:
        return sorted({n for base in (self.root, self.cold) if base for n, folder, _ in paths.children(self.spark, base) if folder})

    def measurements(self, db: str) -> list[str]:
        return sorted({n for base in (self.root, self.cold) if base for n, folder, _ in paths.children(self.spark, f"{base}/{db}") if folder})

    def stats(self, db: str) -> DataFrame:
        """(database, table_name, tier, file_count, total_bytes) of a database's measurements."""
        rows = [(db, m, t, len(f), sum(x[1] for x in f)) for m in self.measurements(db) for t in self.tiers() if (f := paths.files(self.spark, self.path(db, m, t)))]
        return self.spark.createDataFrame(rows, "database string, table_name string, tier string, file_count long, total_bytes long")

    def drop_database(self, db: str, confirm: bool = False) -> int:
        if not confirm:
            raise ValueError("dropping a database needs confirm=True")
        found = self.measurements(db)
        for base in (self.root, self.cold):
            if base:
                paths.delete(self.spark, f"{base}/{db}")
        return len(found)

    # ------------------------------------------------------------ writing

    def write(self, df: DataFrame, db: str, name: str, tags: list[str] = (), sort_keys: list[str] | None = None, dedup_time: bool | None = None, decimals: dict[str, str] | None = None, files_per_hour: int | None = None, batch: str | None = None) -> None:
        """Appends rows with a column time (timestamps without zone), into the hours that they belong to.

        Rows of an hour meet in files_per_hour tasks (a property of the measurement, 1 at first; raise it where a
        write brings more than about a GB an hour) and lie there by the sort keys and time. Types are widened to the
        stored ones; columns of nothing are strings, names that begin with _ are dropped. The union of all writes'
        columns is kept beside the files, so that a read need not open each file for its schema.

        batch names a write that may be made again, as a stream does after a failure: its files are written aside and
        moved in under that name, in the place of those that an earlier attempt has left, so rows are there once.
        """
        changes = {"tags": list(tags)}
        if sort_keys is not None:
            changes["sort_keys"] = sort_keys
        if dedup_time is not None:
            changes["dedup_time"] = dedup_time
        if decimals is not None:
            changes["decimals"] = decimals
        if files_per_hour is not None:
            changes["files_per_hour"] = files_per_hour
        known = self.properties(db, name) | changes
        rows = stored_types(df, known["decimals"])
        known = self.set_properties(db, name, **changes, columns=dict(rows.dtypes))
        rows = partitioned(rows).withColumn(SEQUENCE, F.lit(clock.time_ns()))
        keys = [k for k in known["sort_keys"] if k in rows.columns and k != "time"]
        # a stated number of tasks, so that many small hours are not written one after another by a single one
        tasks = max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(tasks, DAY, HOUR, F.pmod(F.hash("time"), F.lit(known["files_per_hour"])))
        path = self.path(db, name)
        out = rows.sortWithinPartitions(DAY, HOUR, *keys, "time").write.partitionBy(DAY, HOUR).options(**PARQUET)
        if batch is None:
            out.mode("append").parquet(path)
        else:
            self._publish(out, path, re.sub(r"\W", "-", batch))

    def _publish(self, out, path: str, batch: str) -> None:
        spark, aside = self.spark, f"{path}/_batch-{batch}"
        out.mode("overwrite").parquet(aside)
        new = sorted(f for f, _, _ in paths.files(spark, aside))
        folders = sorted({"/".join(f.split("/")[-3:-1]) for f in new})
        prefix = f"batch-{batch}-"
        old = [f"{path}/{d}/{n}" for d in folders for n, _, _ in paths.children(spark, f"{path}/{d}") if n.startswith(prefix)]
        paths.each(lambda f: paths.delete(spark, f), old)
        numbered = {f: f"{path}/{'/'.join(f.split('/')[-3:-1])}/{prefix}{i:05}.parquet" for i, f in enumerate(new)}
        paths.each(lambda f: paths.move(spark, f, numbered[f]), new)
        paths.delete(spark, aside)

    # ------------------------------------------------------------ reading

    def read(self, db: str, name: str, start: datetime | str | None = None, end: datetime | str | None = None, internal: bool = False, planned: bool = False) -> DataFrame:
        """A measurement's rows, of all tiers, columns united by name; [start, end) prunes whole hours before rows.

        planned: for a plan's sake only, not to be run: no file is opened even where writes differ in a column's type.
        """
        found = [d for t in self.tiers() if (d := self._scan(self.path(db, name, t), start=start, end=end, planned=planned)) is not None]
        if not found:
            raise LookupError(f"no measurement {db}.{name}")
        df = found[0]
        for other in found[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        condition = time_range(start, end)
        df = df.filter(condition) if condition is not None else df
        return df if internal else df.drop(DAY, HOUR, SEQUENCE)

    def _scan(self, path: str, files: list[str] | None = None, start: datetime | str | None = None, end: datetime | str | None = None, planned: bool = False) -> DataFrame | None:
        """All files below path, broken ones skipped; or just the stated ones, of which none may be broken.

        Where writes differ in a column's type, the bounds say which folders' files are looked at.
        """
        if files is None and not any(n.startswith(f"{DAY}=") for n, _, _ in paths.children(self.spark, path)):
            return None
        text = paths.read_text(self.spark, f"{path.replace(self.cold or self.root, self.root, 1)}/{PROPERTIES}")
        known = NEW | (json.loads(text) if text else {})
        if known["columns"] and (planned or not known["mixed"]):
            schema = ", ".join(f"`{c}` {kind}" for c, kind in {**known["columns"], SEQUENCE: "bigint"}.items())
            reader = self.spark.read.schema(f"{schema}, {PARTITIONS}").option("basePath", path).option("ignoreCorruptFiles", files is None)
            return reader.parquet(*(files or [path]))
        files = files or paths.parquet_only(self.spark, [f for f, _, _ in paths.files(self.spark, path) if in_range(f, start, end)])
        if not files:  # the bounds leave nothing: a frame of the known columns
            return self._scan(path, None, planned=True).filter(F.lit(False))
        return union_by_name(self.spark, path, files)

    def schema(self, db: str, name: str) -> list[dict]:
        tags = self.properties(db, name)["tags"]
        kind = lambda c: "time" if c == "time" else "tag" if c in tags else "field"
        return [{"name": f.name, "kind": kind(f.name), "type": f.dataType.simpleString()} for f in self.read(db, name).schema]

    def with_live(self, df: DataFrame, live: DataFrame) -> DataFrame:
        """df with rows that agents still hold, united below whatever is asked of it."""
        return df.unionByName(live, allowMissingColumns=True)


def stored_types(df: DataFrame, decimals: dict[str, str]) -> DataFrame:
    out = []
    for f in df.schema:
        if f.name.startswith("_"):
            continue
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if f.name == "time":
            if not kind.startswith("timestamp"):
                raise TypeError("time must be a timestamp")
            c = c.cast("timestamp_ntz")
        elif f.name in decimals:
            c = c.cast(f"decimal({decimals[f.name]})")
        elif kind in ("byte", "short", "integer"):
            c = c.cast("long")
        elif kind == "float":
            c = c.cast("double")
        elif kind == "void":
            c = c.cast("string")
        elif kind not in ("long", "double", "string", "boolean", "timestamp", "timestamp_ntz", "date") and not kind.startswith("decimal"):
            raise TypeError(f"column {f.name!r}: type {kind} cannot be stored")
        out.append(c.alias(f.name))
    if "time" not in df.columns:
        raise TypeError("a column time is needed")
    return df.select(*out).filter("time is not null")


def partitioned(df: DataFrame) -> DataFrame:
    return df.withColumn(DAY, F.date_format("time", "yyyy-MM-dd")).withColumn(HOUR, F.date_format("time", "HH"))


def moment(t: datetime | str) -> datetime:
    return t if isinstance(t, datetime) else datetime.fromisoformat(t.replace("Z", ""))


def time_range(start: datetime | str | None, end: datetime | str | None) -> Column | None:
    """start <= time < end, with the bounds on days and hours that follow from it, which prune folders."""
    out = None
    for bound, of_time, of_day in ((start, "__ge__", "__ge__"), (end, "__lt__", "__le__")):
        if bound is None:
            continue
        t = moment(bound)
        last = t - timedelta(microseconds=1) if of_time == "__lt__" else t
        day, hour = F.lit(last.strftime("%Y-%m-%d")), F.lit(last.strftime("%H"))
        c = getattr(F.col("time"), of_time)(F.lit(str(t)).cast("timestamp_ntz"))
        inside = (F.col(DAY) > day) if of_day == "__ge__" else (F.col(DAY) < day) | (F.col(HOUR) == WHOLE_DAY)
        c &= getattr(F.col(DAY), of_day)(day) & (inside | getattr(F.col(HOUR), of_day)(hour))
        out = c if out is None else out & c
    return out


def in_range(file: str, start: datetime | str | None, end: datetime | str | None) -> bool:
    """Whether a file's folder may hold rows of [start, end)."""
    day, hour = (part.split("=", 1)[1] for part in file.split("/")[-3:-1])
    first = moment(f"{day} {'00' if hour == WHOLE_DAY else hour}:00:00")
    after = first + timedelta(days=1) if hour == WHOLE_DAY else first + timedelta(hours=1)
    return (start is None or after > moment(start)) and (end is None or first < moment(end))


#: The order in which differing types of a column are widened.
WIDER = ["boolean", "long", "double", "string"]


def widest(kinds: set[str]) -> str:
    """The type that values of all these types are cast to."""
    kinds = {{"bigint": "long"}.get(k, k) for k in kinds}
    if len(kinds) == 1:
        (kind,) = kinds
        return {"long": "bigint"}.get(kind, kind)
    kind = max(kinds, key=lambda k: WIDER.index(k) if k in WIDER else len(WIDER) - 1)
    return {"long": "bigint"}.get(kind, kind) if kind in WIDER else "string"


def file_schema(spark: SparkSession, file: str) -> T.StructType:
    """A file's schema from its footer, as Spark wrote it there; no job is run, unless another writer made the file."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        text = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("org.apache.spark.sql.parquet.row.metadata")
    finally:
        reader.close()
    return T.StructType.fromJson(json.loads(text)) if text else spark.read.parquet(file).schema


def union_by_name(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Files whose types differ: files of one schema are read together, cast to the widest types and united by name.

    time of text is read as a timestamp or as microseconds. Only files' schemas come to the driver, many at once.
    """
    groups: dict[str, list[str]] = {}
    schemas: dict[str, T.StructType] = {}
    with ThreadPoolExecutor(16) as pool:
        for file, schema in zip(files, pool.map(lambda f: file_schema(spark, f), files), strict=True):
            schemas[schema.json()] = schema
            groups.setdefault(schema.json(), []).append(file)
    partition = T.StructType.fromDDL(PARTITIONS)
    frames = [spark.read.schema(T.StructType([*schemas[k].fields, *partition.fields])).option("basePath", path).parquet(*of) for k, of in groups.items()]
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for f in df.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    types = {c: "timestamp_ntz" if c == "time" else widest(found) for c, found in kinds.items()}
    out = None
    for df in frames:
        of = dict(df.dtypes)
        cast = df.select(*((normal_time(F.col("time"), of["time"]) if c == "time" else F.col(f"`{c}`") if c in (DAY, HOUR) else F.col(f"`{c}`").try_cast(types[c])).alias(c) for c in df.columns))
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    return out


def normal_time(c: Column, kind: str) -> Column:
    """time of any stored form as a timestamp: text of a time, or of microseconds, or microseconds."""
    micros = F.timestamp_add("MICROSECOND", c.try_cast("long"), F.lit("1970-01-01").cast("timestamp_ntz")) if not kind.startswith("timestamp") else None
    if kind.startswith("timestamp"):
        return c.cast("timestamp_ntz")
    return micros if kind in ("bigint", "int") else F.coalesce(c.try_cast("timestamp_ntz"), micros)
