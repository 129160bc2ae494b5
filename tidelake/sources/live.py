"""Rows that agents still hold: fetched when a query runs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelake.sources.points import PIECE, POINTS, batch, to_table
from tidelake.sources.records import plain_body, record_points, unpack

#: Seconds that an agent has, and agents that a task asks at once.
TIMEOUT, AT_ONCE = 2.0, 16


def answered(url: str, timeout: float = TIMEOUT) -> bytes | None:
    """What an agent answers with; None where it fails or is late."""
    try:
        with urlopen(url, timeout=timeout) as answer:
            return answer.read()
    except (OSError, ValueError):
        return None


def answer_points(body: bytes) -> list[tuple]:
    """The points of an answer in MessagePack or JSON; none where it is nonsense."""
    try:
        body = plain_body(body)
        try:
            data = unpack(body)
        except ValueError:
            data = json.loads(body)
        return record_points(data)
    except (ValueError, TypeError, KeyError):
        return []


def fetched(url: str, timeout: float = TIMEOUT) -> list[tuple]:
    """The points that an agent answers with; none where it fails, is late or answers nonsense."""
    body = answered(url, timeout)
    return [] if body is None else answer_points(body)


def live_points(spark: SparkSession, urls: list[str], timeout: float = TIMEOUT) -> DataFrame:
    """Points of all agents: tasks ask them, AT_ONCE at a time; agents that fail are left out.

    A task holds the answers of those that it asks at once, as they came, and the points of one answer.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for some in batches:
                asked = some.column(0).to_pylist()
                for i in range(0, len(asked), AT_ONCE):
                    answers = [pool.submit(answered, u, timeout) for u in asked[i : i + AT_ONCE]][::-1]
                    while answers:
                        body = answers.pop().result()
                        points = answer_points(body) if body is not None else []
                        for j in range(0, len(points), PIECE):
                            yield batch(points[j : j + PIECE])

    parts = max(1, min(len(urls), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(parts).mapInArrow(ask, POINTS)


def live_rows(spark: SparkSession, urls: list[str], measurement: str, timeout: float = TIMEOUT) -> DataFrame:
    """A measurement's rows that agents still hold, for Lake.with_live(). Each agent is asked once."""
    return to_table(live_points(spark, urls, timeout), measurement)[0]
