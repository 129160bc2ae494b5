"""Joins that Spark has no operator for: as-of, positional, and ranges without a key."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelake import paths

#: Points or ranges of a cell that are compared as one, and pairs that a task compares.
BLOCK, PAIRS = 1024, 32 << 20

__all__ = ["asof_join", "positional_join", "range_join"]


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], how: str = "left", every: str | None = None) -> DataFrame:
    """left with the `values` of right's latest row of the same key at or before left_time.

    Both sides are united and one window carries the latest right row forward: one shuffle, one sort, no blow-up.
    Rows of right come before rows of left with the same time. Of right rows with equal key and time the one with
    the largest values counts. Null keys or times match nothing; rows without a key are spread over tasks. how:
    'left' or 'inner'.

    every: a unit of time (day, hour, ...) by which a key's rows are split too, so that a key that holds most rows
    binds no single task. Each unit's latest right row is carried into the later ones, one row a key and unit.
    """
    row = F.struct(*(F.col(c).alias(c) for c in left.columns))
    found = F.struct(F.col(right_time).alias("time"), *(F.col(c).alias(c) for c in values))
    known = lambda cs: functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cs))
    unit = lambda c: F.date_trunc(every, F.col(c).cast("timestamp")) if every else F.lit(None).cast("timestamp")
    spread = F.when(~known([*on, left_time]), F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    right = right.filter(known([*on, right_time]))
    key = [f"_k{i}" for i in range(len(on))]
    both = left.select(*(F.col(c).alias(k) for c, k in zip(on, key)), unit(left_time).alias("_u"), spread.alias("_spread"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(right.select(found.alias("x")).schema[0].dataType).alias("_found"))
    other = right.select(*(F.col(c).alias(k) for c, k in zip(on, key)), unit(right_time).alias("_u"), F.lit(None).cast("long").alias("_spread"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(row.alias("x")).schema[0].dataType).alias("_row"), found.alias("_found"))
    w = W.partitionBy(*key, "_u", "_spread").orderBy(F.col("_t").asc_nulls_last(), "_side", F.col("_found").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    united = both.unionByName(other)
    joined = united.withColumn("_last", F.last("_found", ignorenulls=True).over(w)).filter("_side = 1")
    if every:
        # the latest of all units before, for each unit that a key has rows in
        units = united.filter("_spread is null").groupBy(*key, "_u").agg(F.max(F.when(F.col("_side") == 0, F.struct(F.col("_t"), F.col("_found")))).alias("_top"))
        earlier = W.partitionBy(*key).orderBy("_u").rowsBetween(W.unboundedPreceding, -1)
        carried = units.select(*(F.col(k).alias(f"{k}r") for k in key), F.col("_u").alias("_ur"), F.last("_top", ignorenulls=True).over(earlier)["_found"].alias("_before"))
        same = functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{k}r") for k in key] + [F.col("_u") == F.col("_ur")])
        joined = joined.join(carried, same, "left").withColumn("_last", F.coalesce("_last", "_before"))
    joined = joined.withColumn("_last", F.when(F.col("_spread").isNull(), F.col("_last")))
    if how == "inner":
        joined = joined.filter(F.col("_last").isNotNull())
    return joined.select("_row.*", *(F.col("_last")[c].alias(c) for c in values))


def positional_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Row i of left beside row i of right, nulls where one side is shorter.

    Rows have no order of their own in a distributed table, so the orders are stated. Rows are numbered without a
    single task for all: each range-sorted partition counts from where the ones before it end.
    """
    return _numbered(left, left_order, "_i").join(_numbered(right, right_order, "_j"), F.col("_i") == F.col("_j"), "full").drop("_i", "_j")


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_p", F.shiftright("_id", 33)).withColumn("_n", F.col("_id").bitwiseAND((1 << 33) - 1))
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    starts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_p", "_s")
    return placed.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_n")).drop("_p", "_n", "_id", "_s")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of points with the ranges that hold them: low <= at < high.

    Ranges are listed under each cell that they touch and points under their own, so the join is by equality of cells
    instead of all pairs. Cells are `width` wide, and eight times as wide from level to level; a range is listed in
    the first level where it touches ten cells at most, so a very wide one is no more rows than others. A width near
    the usual range's length is best; any is right.

    Pairs may be many more than rows, where many ranges hold many points. A cell's points and ranges are cut into blocks
    and tasks are as many as the pairs to compare ask for, so a task's work does not grow with the input, nor with one
    cell; memory holds a task's ranges.
    """
    # how many cells of the first level a range spans; a level has eight times fewer
    cells = F.greatest(F.lit(1.0), (F.col(high) - F.col(low)).cast("double") / F.lit(width))
    level = F.greatest(F.lit(0), F.ceil(F.log(8.0, cells / 8.0))).cast("int")
    cell = lambda c, of: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(8.0), of))).cast("long")
    listed = ranges.filter(F.col(low) < F.col(high)).withColumn("_level", level)
    levels = sorted(r[0] for r in listed.select("_level").distinct().collect())  # a few: the logarithm of the widest range
    listed = listed.withColumn("_cell", F.explode(F.sequence(cell(low, F.col("_level")), cell(high, F.col("_level")))))
    own = F.explode(F.array(*(F.struct(F.lit(n).alias("_level"), cell(at, F.lit(n)).alias("_cell")) for n in levels or [0])))
    placed = points.withColumn("_at", own).withColumns({"_level": F.col("_at._level"), "_cell": F.col("_at._cell")}).drop("_at")
    # a cell's points and ranges are cut into blocks, and each pair of blocks is a piece of work of its own
    key = ["_level", "_cell"]
    blocks = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"{name}n")).withColumn(name, F.ceil(F.col(f"{name}n") / BLOCK).cast("int"))
    sizes = paths.stored(blocks(placed, "_p").join(blocks(listed, "_r"), key), "cells")
    pairs = sizes.agg(F.sum(F.col("_pn").cast("double") * F.col("_rn"))).first()[0] or 0.0
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS) + 1)
    of = sizes.select(*key, "_p", "_r")
    dealt = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pair = [*key, "_pb", "_rb"]
    left = placed.withColumn("_id", F.monotonically_increasing_id()).join(of, key).withColumn("_pb", dealt("_p")).withColumn("_rb", every("_r")).drop("_p", "_r", "_id").repartition(parts, *pair)
    right = listed.withColumn("_id", F.monotonically_increasing_id()).join(of, key).withColumn("_rb", dealt("_r")).withColumn("_pb", every("_p")).drop("_p", "_r", "_id").repartition(parts, *pair)
    hit = left.join(right.hint("shuffle_hash"), pair)
    return hit.filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop(*pair)
