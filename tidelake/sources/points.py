"""The form that all decoders share: one row a point, its values by kind."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake import paths

#: time is in microseconds; null where the point has none that is valid (the caller says what then holds).
POINTS = "measurement string, time long, tags map<string,string>, ints map<string,long>, floats map<string,double>, strings map<string,string>, bools map<string,boolean>"
NAMES = [c.split()[0] for c in POINTS.split(", ")]
_KINDS = [pa.string(), pa.int64(), *(pa.map_(pa.string(), t) for t in (pa.string(), pa.int64(), pa.float64(), pa.string(), pa.bool_()))]


#: Points of a batch that a decoder hands on.
PIECE = 10_000


def point(measurement: str, time: int | None, tags: dict, fields: dict) -> tuple:
    """A point; fields go by the kind of their value, and what has no kind of its own is left out."""
    ints, floats, strings, bools = {}, {}, {}, {}
    for k, v in fields.items():
        if isinstance(v, bool):
            bools[k] = v
        elif isinstance(v, int):
            if -(1 << 63) <= v < 1 << 63:
                ints[k] = v
            else:
                floats[k] = float(v)
        elif isinstance(v, float):
            floats[k] = v
        elif isinstance(v, bytes):
            strings[k] = v.decode("utf-8", "replace")
        elif isinstance(v, str):
            strings[k] = v
    return measurement, time, {str(k): str(v) for k, v in tags.items() if v is not None}, ints, floats, strings, bools


def map_array(dicts: list[dict], kind: pa.DataType) -> pa.MapArray:
    """Dicts as Arrow's maps, from one array of all keys and one of all values."""
    ends = np.zeros(len(dicts) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, dicts), np.int32, len(dicts)), out=ends[1:])
    keys = pa.array(list(itertools.chain.from_iterable(dicts)), pa.string())
    values = pa.array(list(itertools.chain.from_iterable(d.values() for d in dicts)), kind)
    return pa.MapArray.from_arrays(pa.array(ends), keys, values)


def batch(points: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*points)) if points else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([map_array(c, k.item_type) if pa.types.is_map(k) else pa.array(c, k) for c, k in zip(cols, _KINDS)], NAMES)


def decoded(df: DataFrame, column: str, decode) -> DataFrame:
    """Points of each value of a column; decode(value) gives a list of them. Bad input gives none.

    Input in fewer parts than there are cores, as one small file, is dealt out first: decoding is the work. Values are
    taken from a batch one by one, and no more than one batch of them is held.
    """

    def run(batches):
        for b in batches:
            found: list[tuple] = []
            values = b.column(0)
            del b
            for i in range(len(values)):
                value = values[i].as_py()
                if value is not None:
                    found += decode(value)
                if len(found) >= PIECE:
                    full = len(found) // PIECE * PIECE
                    for j in range(0, full, PIECE):
                        yield batch(found[j : j + PIECE])
                    found = found[full:]
            del values
            if found:
                yield batch(found)

    rows = df.select(column)
    if not df.isStreaming:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores:
            rows = rows.repartition(cores)
    return rows.mapInArrow(run, POINTS)


def names(points: DataFrame, measurement: str) -> dict[str, list[str]]:
    """Tag and field names of a measurement by kind: as many rows as columns come to the driver. Reads points once."""
    of = points.filter(F.col("measurement") == measurement)
    kinds = ["tags", "ints", "floats", "strings", "bools"]
    keys = of.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.map_keys(k).alias("names")) for k in kinds))).alias("x"))
    rows = keys.select("x.kind", F.explode("x.names").alias("name")).distinct().collect()
    return {k: sorted(r["name"] for r in rows if r["kind"] == k) for k in kinds}


def to_table(points: DataFrame, measurement: str, now: str | None = None) -> tuple[DataFrame, list[str]]:
    """(table, its tags) of a measurement's points: time, a string column a tag, a typed column a field.

    A field whose name a tag has is called <name>_value; names that begin with _ are dropped. A field seen with
    whole numbers and others is a double, with other mixtures a string. Points without a time get `now` (a
    timestamp), the time of decoding unless stated. Points are looked at twice, for their names and for their values,
    so those that are still to be decoded are stored first: they are decoded once.
    """
    if points._jdf.queryExecution().optimizedPlan().toString().find("MapInArrow") >= 0:
        points = paths.stored(points, "points")
    by = names(points, measurement)
    tags = [t for t in by["tags"] if not t.startswith("_") and t != "time"]
    of = points.filter(F.col("measurement") == measurement)
    moment = F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz")
    time = F.coalesce(F.timestamp_add("MICROSECOND", F.col("time"), F.lit("1970-01-01").cast("timestamp_ntz")), moment)
    cols = [time.alias("time"), *(F.col("tags")[t].alias(t) for t in tags)]
    for name in sorted({n for k in ("ints", "floats", "strings", "bools") for n in by[k]}):
        if name.startswith("_"):
            continue
        kinds = [k for k in ("ints", "floats", "strings", "bools") if name in by[k]]
        if len(kinds) == 1:
            value = F.col(kinds[0])[name]
        elif set(kinds) == {"ints", "floats"}:
            value = F.coalesce(F.col("floats")[name], F.col("ints")[name].cast("double"))
        else:
            value = F.coalesce(*(F.col(k)[name].cast("string") for k in kinds))
        cols.append(value.alias(f"{name}_value" if name in tags or name == "time" else name))
    return of.select(*cols), tags
