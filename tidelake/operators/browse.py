"""Queries without SQL: browsing a measurement, forced caps, estimates, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.functions import nulls_last

#: Rows that browsing returns where nothing is asked, and at most; rows of an assistant's tool.
DEFAULT_LIMIT, MOST, TOOL_ROWS = 100, 1_000_000, 500


def measurement_query(df: DataFrame, where: str | None = None, order_by: list[tuple[str, bool]] | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Rows of a measurement: a condition, an order (column, descending; newest first unless stated), a page."""
    if not 0 < limit <= MOST or offset < 0:
        raise ValueError(f"limit must be from 1 to {MOST} and offset 0 or more")
    order = order_by if order_by is not None else [("time", True)] if "time" in df.columns else []
    unknown = [c for c, _ in order if c not in df.columns]
    if unknown:
        raise ValueError(f"no such columns: {unknown}")
    if where:
        df = df.filter(where)
    if order:
        df = df.orderBy(*(nulls_last(c, descending) for c, descending in order))
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def capped(df: DataFrame, rows: int = TOOL_ROWS) -> DataFrame:
    """A forced cap on the whole plan's rows."""
    return df.limit(rows)


def estimate(df: DataFrame, exact: bool = False) -> dict:
    """Rows and a level (none, low, medium, high): by the plan's statistics, or counted."""
    if exact:
        rows = df.count()
    else:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        known = stats.rowCount()
        rows = int(str(known.get())) if known.isDefined() else int(str(stats.sizeInBytes())) // max(8, 8 * len(df.columns))
    level = next((name for least, name in ((1_000_000, "high"), (100_000, "medium"), (10_000, "low")) if rows > least), "none")
    return {"rows": rows, "level": level}


def describe(df: DataFrame, tags: list[str] = ()) -> list[dict]:
    """Columns of a measurement by kind: time, tags, fields; names that begin with _ are internal."""
    kind = lambda c: "time" if c == "time" else "tag" if c in tags else "field"
    return [{"name": f.name, "kind": kind(f.name), "type": f.dataType.simpleString()} for f in df.schema if not f.name.startswith("_")]


def sample(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.limit(min(rows, TOOL_ROWS))


def egress(df: DataFrame) -> DataFrame:
    """Columns as clients get them: whole decimals as longs, other decimals as doubles, NaN and infinities as null."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind.startswith("decimal"):
            c = c.cast("long" if f.dataType.scale == 0 else "double")
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(*out)
