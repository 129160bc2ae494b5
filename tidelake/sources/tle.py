"""Satellites' two-line elements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard gravitational parameter (m3/s2) and mean radius (km) of the earth; heights (km) that tell orbits apart.
MU, RADIUS, LOW, GEO, NEAR_GEO = 3.986004418e14, 6371.0, 2000.0, 35786.0, 200.0
ECCENTRIC = 0.25

ELEMENTS = "object_name string, line1 string, line2 string"


def checksum(line: str) -> bool:
    """Digits and, as one each, minus signs of the first 68 columns add up to the 69th, mod 10."""
    return len(line) >= 69 and line[68].isdigit() and sum(int(c) if c.isdigit() else c == "-" for c in line[:68]) % 10 == int(line[68])


def entries(text: str) -> list[tuple[str, str, str]]:
    """(name, line 1, line 2) of a file's sets of two lines, with or without a name before; broken ones are left out."""
    lines = [x for raw in text.split("\n") if (x := raw.rstrip("\r \t"))]
    out, i = [], 0
    while i < len(lines):
        named = not lines[i].startswith("1 ")
        group = lines[i : i + 2 + named]
        if len(group) < 2 + named:
            break
        one, two = group[-2:]
        name = group[0].strip() if named else f"NORAD {one[2:7].strip()}"
        if named and name.startswith("0 "):
            name = name[2:]
        if one.startswith("1 ") and two.startswith("2 ") and checksum(one) and checksum(two) and one[2:7] == two[2:7]:
            out.append((name, one, two))
            i += 2 + named
        else:
            i += 2 + named
    return out


def exponential(s: Column) -> Column:
    """A number like ' 12345-3': digits after a point, and an exponent."""
    s = F.trim(s)
    digits, power = F.regexp_extract(s, r"^([+-]?)\.?(\d+)([+-]\d)?$", 2), F.regexp_extract(s, r"([+-]\d)$", 1)
    sign = F.when(s.startswith("-"), -1.0).otherwise(1.0)
    return F.when(s == "", 0.0).otherwise(sign * F.concat(F.lit("0."), digits).try_cast("double") * F.pow(F.lit(10.0), F.coalesce(power.try_cast("double"), F.lit(0.0))))


def orbit_type(perigee: Column, apogee: Column, eccentricity: Column) -> Column:
    middle = (perigee + apogee) / 2
    return (
        F.when(perigee < 0, "SUB").when((eccentricity > ECCENTRIC) & (apogee > GEO), "HEO")
        .when((middle > GEO - NEAR_GEO) & (middle < GEO + NEAR_GEO), "GEO").when(apogee < LOW, "LEO")
        .when((perigee >= LOW) & (apogee <= GEO), "MEO").otherwise("HEO")
    )


def orbits(elements: DataFrame) -> DataFrame:
    """time and 19 columns of sets (object_name, line1, line2), by columns' places and plain arithmetic."""
    one = lambda a, b: F.trim(F.substring("line1", a, b - a + 1))
    two = lambda a, b: F.trim(F.substring("line2", a, b - a + 1))
    year, day = one(19, 20).try_cast("int"), one(21, 32).try_cast("double")
    start = F.make_timestamp_ntz(F.when(year < 57, year + 2000).otherwise(year + 1900), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    df = elements.select(
        F.timestamp_add("MICROSECOND", F.round((day - 1) * 86_400_000_000.0).cast("long"), start).alias("time"),
        one(3, 7).alias("norad_id"), "object_name", one(8, 8).alias("classification"), one(10, 17).alias("international_designator"),
        two(9, 16).try_cast("double").alias("inclination_deg"), two(18, 25).try_cast("double").alias("raan_deg"),
        F.concat(F.lit("0."), two(27, 33)).try_cast("double").alias("eccentricity"), two(35, 42).try_cast("double").alias("arg_perigee_deg"),
        two(44, 51).try_cast("double").alias("mean_anomaly_deg"), two(53, 63).try_cast("double").alias("mean_motion_rev_day"),
        exponential(F.substring("line1", 54, 8)).alias("bstar"), F.regexp_replace(one(34, 43), r"^([+-]?)\s*\.", "$10.").try_cast("double").alias("mean_motion_dot"),
        exponential(F.substring("line1", 45, 8)).alias("mean_motion_ddot"), two(64, 68).try_cast("double").alias("revolution_number"),
    )
    n = F.col("mean_motion_rev_day") * (2 * math.pi / 86400.0)
    some = F.col("mean_motion_rev_day") > 0
    df = df.withColumn("semi_major_axis_km", F.when(some, F.pow(MU / (n * n), 1 / 3) / 1000.0)).withColumn("period_min", F.when(some, 1440.0 / F.col("mean_motion_rev_day")))
    df = df.withColumn("apogee_km", F.col("semi_major_axis_km") * (1 + F.col("eccentricity")) - RADIUS).withColumn("perigee_km", F.col("semi_major_axis_km") * (1 - F.col("eccentricity")) - RADIUS)
    return df.withColumn("orbit_type", orbit_type(F.col("perigee_km"), F.col("apogee_km"), F.col("eccentricity")))


def two_line_elements(df: DataFrame, column: str = "value") -> DataFrame:
    """orbits() of a column of files' texts (spark.read.text with wholetext)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [e for v in b.column(0) for e in entries(v.as_py() or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["object_name", "line1", "line2"])

    return orbits(df.select(column).mapInArrow(run, ELEMENTS))
