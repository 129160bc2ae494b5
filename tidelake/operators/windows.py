"""Windows whose frames Spark adds up anew for each row."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelake.functions.time import at

__all__ = ["trailing"]


def trailing(df: DataFrame, key: list[str], time: str, value: str, seconds: int, count: str = "n", total: str = "s") -> DataFrame:
    """df with the count of rows and the sum of value over RANGE BETWEEN INTERVAL seconds PRECEDING AND CURRENT ROW.

    Time is cut into cells, a whole number of which is as long as the frame. A frame is what its first cell holds from
    its beginning on, the cells between, and what its last cell holds up to the row: running sums of one cell's distinct
    times, so the work grows with the rows and not with what frames hold, and no key binds a task. Nothing is
    subtracted, so sums are as exact as Spark's own. Rows without a time are each other's frame.
    """
    width = seconds * 1_000_000
    cells = next(n for n in range(60, 0, -1) if width % n == 0)
    us = F.timestamp_diff("MICROSECOND", at("1970-01-01"), F.col(time))
    k = [f"_k{i}" for i in range(len(key))]
    times = df.groupBy(*(F.col(c).alias(a) for c, a in zip(key, k)), us.alias("_us")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    times = times.withColumn("_cell", F.floor(F.col("_us") / F.lit(width // cells)).cast("long"))
    sums = lambda w, i: [F.sum(c).over(w).alias(f"{c}{i}") for c in ("_n", "_s")]
    up = W.partitionBy(*k, "_cell").orderBy("_us").rowsBetween(W.unboundedPreceding, 0)
    last = times.select(*k, "_us", "_cell", *sums(up, 1))
    # each time asks, from the place where its frame begins, for what that cell holds from there on
    asking = last.filter("_us is not null").select(*k, (F.col("_cell") - cells).alias("_cell"), (F.col("_us") - width).alias("_us"), F.lit(1).alias("_side"))
    both = times.filter("_us is not null").withColumn("_side", F.lit(0)).unionByName(asking, allowMissingColumns=True)
    down = W.partitionBy(*k, "_cell").orderBy(F.desc("_us"), "_side").rowsBetween(W.unboundedPreceding, 0)
    first = both.select(*k, "_us", "_side", *sums(down, 2)).filter("_side = 1").select(*k, (F.col("_us") + width).alias("_us"), "_n2", "_s2")
    parts = [last, first]
    if cells > 1:
        # a row a cell: as many a key as its time has cells
        whole = times.filter("_us is not null").groupBy(*k, "_cell").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
        between = W.partitionBy(*k).orderBy("_cell").rangeBetween(-(cells - 1), -1)
        parts.append(whole.select(*k, "_cell", *sums(between, 3)))
    plus = lambda a, b: F.coalesce(a + b, a, b)
    found = functools.reduce(lambda a, b: _joined(a, b, [*k, "_cell" if "_cell" in b.columns else "_us"]), parts)
    n, s = (functools.reduce(plus, (F.col(f"{c}{i + 1}") for i in range(len(parts)))).alias(c) for c in ("_n", "_s"))
    rows = df.withColumns({**{a: F.col(c) for c, a in zip(key, k)}, "_us": us})
    return _joined(rows, found.select(*k, "_us", n, s), [*k, "_us"]).select(*df.columns, F.col("_n").alias(count), F.col("_s").alias(total))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """left with right's one row of the same values, nulls being equal."""
    right = right.withColumnsRenamed({c: f"{c}r" for c in on})
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}r")) for c in on))
    return left.join(right, same, "left").drop(*(f"{c}r" for c in on))
