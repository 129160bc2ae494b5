"""Strings, casts and sort orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["concat_skip_null", "double_to_int", "decimal_to_int", "nulls_last", "regexp_replace_first", "strlen", "url_domain"]


def concat_skip_null(*parts: Column) -> Column:
    """Concatenation in which nulls count as empty."""
    return F.concat_ws("", *parts)


def strlen(s: Column) -> Column:
    """Bytes of UTF-8."""
    return F.octet_length(s)


def regexp_replace_first(s: Column, pattern: str, replacement: str) -> Column:
    """Replaces the first match alone; the pattern may have groups, which the replacement counts from $2 on."""
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def double_to_int(x: Column) -> Column:
    """Half to even, as doubles are cast in the dialect."""
    return F.rint(x).cast("int")


def decimal_to_int(x: Column) -> Column:
    """Half away from zero, as decimals are cast in the dialect."""
    return F.round(x).cast("int")


def nulls_last(column: Column | str, descending: bool = False) -> Column:
    """Both orders put nulls last in the dialect."""
    c = F.col(column) if isinstance(column, str) else column
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def url_domain(url: Column) -> Column:
    """Host of an http or https URL without www.; null for what is no such URL."""
    host = F.regexp_extract(url, r"^https?://(?:www\.)?([^/]+)", 1)
    return F.when(host != "", host)
