"""Line protocol: measurement[,tag=value...] field=value[,...] [timestamp]."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame

from tidelake.sources.points import decoded, point
from tidelake.sources.records import plain_body

#: Microseconds of a unit of each precision, as (multiplier, divisor).
PRECISIONS = {"ns": (1, 1000), "us": (1, 1), "ms": (1000, 1), "s": (1_000_000, 1)}
TRUE, FALSE = {"t", "T", "true", "True", "TRUE"}, {"f", "F", "false", "False", "FALSE"}


def cut(text: str, stop: str, quotes: bool = False) -> tuple[str, str, str]:
    """(up to the first stop that no backslash or quote covers, the stop, the rest)."""
    end = text.find(stop)
    if end < 0:
        end = len(text)
    # what covers a stop lies before it
    if text.find("\\", 0, end) >= 0 or quotes and text.find('"', 0, end) >= 0:
        end = upto(stop, quotes).match(text).end()
    return text[:end], text[end : end + 1], text[end + 1 :]


@functools.cache
def upto(stop: str, quotes: bool) -> re.Pattern:
    """What goes on to a stop: other characters, any after a backslash, and quoted text (to the end, if left open)."""
    quoted = r'|"(?:[^"\\]|\\.)*(?:"|\\?$)' if quotes else ""
    return re.compile(rf'(?:[^\\{re.escape(stop)}{chr(34) if quotes else ""}]+|\\.{quoted}|\\$)*', re.S)


def plain(text: str, special: str) -> str:
    """The text without the backslashes before special characters."""
    if "\\" not in text:
        return text
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in special:
            i += 1
        out.append(text[i])
        i += 1
    return "".join(out)


def value(text: str):
    """A field's value by its spelling; None: no valid value, and the field is dropped."""
    if text[:1] == '"':
        return plain(text[1:-1], '"\\') if len(text) > 1 and text[-1] == '"' else text[1:]
    if text in TRUE | FALSE:
        return text in TRUE
    if text[-1:] in ("i", "u") and text[:-1]:
        digits = text[:-1]
        if digits.lstrip("+-").isascii() and digits.lstrip("+-").isdigit():
            n = int(digits)
            return n if (0 <= n < 1 << 64 if text[-1] == "u" else -(1 << 63) <= n < 1 << 63) else None
        return None if digits.lstrip("+-").replace(".", "", 1).isdigit() else text
    try:
        return float(text) if "_" not in text else text
    except ValueError:
        return text


def micros(text: str, precision: str) -> int | None:
    try:
        n = int(text)
    except ValueError:
        return None
    by, over = PRECISIONS[precision]
    out = abs(n) * by // over * (1 if n >= 0 else -1)
    return out if -(1 << 63) <= out < 1 << 63 else None


def parse_line(line: str, precision: str = "ns") -> tuple | None:
    line = line.strip()
    if not line or line[0] == "#":
        return None
    head, _, rest = cut(line, " ")
    body, _, stamp = cut(rest.lstrip(" "), " ", quotes=True)
    name, _, tail = cut(head, ",")
    if not name or not body:
        return None
    tags, fields = {}, {}
    while tail:
        part, _, tail = cut(tail, ",")
        k, eq, v = cut(part, "=")
        if eq and k and v:
            tags[plain(k, ", =\\")] = plain(v, ", =\\")
    while body:
        part, _, body = cut(body, ",", quotes=True)
        k, eq, v = cut(part, "=")
        if eq and k and v and (got := value(v)) is not None:
            key = plain(k, ", =\\")
            fields[f"{key}_value" if key in tags else key] = got
    if not fields:
        return None
    return point(plain(name, ", \\"), micros(stamp.strip(), precision) if stamp.strip() else None, tags, fields)


def decode_lines(text: str, precision: str = "ns") -> list[tuple]:
    return [p for line in text.split("\n") if (p := parse_line(line, precision))]


def line_protocol(df: DataFrame, column: str = "value", precision: str = "ns") -> DataFrame:
    """Points of a column of line protocol, one or many lines a value; bad lines and comments are skipped.

    A binary column holds bodies, which may be compressed; one that is broken gives no points.
    """
    if precision not in PRECISIONS:
        raise ValueError(f"precision must be one of {sorted(PRECISIONS)}")

    def decode(value: str | bytes) -> list[tuple]:
        if isinstance(value, str):
            return decode_lines(value, precision)
        try:
            return decode_lines(plain_body(bytes(value)).decode("utf-8", "replace"), precision)
        except ValueError:
            return []

    return decoded(df, column, decode)
