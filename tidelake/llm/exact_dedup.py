"""Exact deduplication that treats frequent digests apart: found by Misra-Gries, decided once, sent to all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import SPACES, copied, fresh, settled, written

#: Counters of the Misra-Gries summary: a digest held by more than 1 in COUNTERS + 1 rows is always found.
COUNTERS = 1024


def normal_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), 256)


def misra_gries(digests: Iterator[pa.RecordBatch], counters: int = COUNTERS) -> dict[str, int]:
    """Counts, each too low by at most rows / (counters + 1), of at most `counters` digests."""
    held: dict[str, int] = {}
    for batch in digests:
        # A batch is counted at once and merged: sums, less the largest count that no longer has a place
        for value, n in ((x["values"], x["counts"]) for x in batch.column(0).value_counts().to_pylist()):
            held[value] = held.get(value, 0) + n
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: n - cut for k, n in held.items() if n > cut}
    return held


def heavy_digests(rows: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` values of `column`; each that more than 1 in counters + 1 rows hold is among them."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries(batches, counters)
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.string()), "low": pa.array(list(held.values()), pa.int64())})

    merged = rows.select(column).mapInArrow(summary, "digest string, low long").groupBy("digest").agg(F.sum("low").alias("low"))
    top = merged.orderBy(F.desc("low"), "digest").limit(counters + 1).collect()  # bounded by the counters
    cut = top[counters]["low"] if len(top) > counters else 0
    return rows.sparkSession.createDataFrame([(r["digest"],) for r in top if r["low"] > cut], f"{column} string")


def best_of(rows: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, keep_row, group_size) of each digest in rows: decided before the shuffle as far as may be."""
    # bitwise not turns the order round and, unlike a minus, holds for every long
    rank = F.struct("chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("low"), F.bitwise_not("row").alias("first"), "doc_id")
    best = rows.groupBy("text_sha256").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return best.select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.bitwise_not("best.first").alias("keep_row"), "group_size")


def exact_groups(docs: DataFrame, counters: int = COUNTERS, row: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row) for each row of docs (doc_id, text, ...).

    Texts are equal when identical without white space; null counts as empty, and all empty texts are equal. The row
    with the most code points in the original text stays, of those the smallest doc_id (null last); of repeated rows
    with that doc_id one is kept and the others have the same keep_id. Other columns are not read. An empty table
    gives an empty table. row names a column of docs that tells rows apart; without it rows are numbered as read.

    Texts are read once, whole; only digests move. Digests that Misra-Gries finds frequent are decided by a
    pre-aggregation, and at most `counters` winners are sent to all tasks, so their rows are never shuffled. The
    others are decided by a pre-aggregation too and meet their winner in a join by digest, a table of its own, whose
    partitions AQE can split: a digest that just misses the frequent ones binds no single task, however many rows.
    """
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), normal_digest(F.col("text")).alias("text_sha256"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("chars"),
            (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        )
    )
    heavy = heavy_digests(rows, "text_sha256", counters)
    frequent = rows.join(F.broadcast(best_of(rows.join(F.broadcast(heavy), "text_sha256", "left_semi"))), "text_sha256")
    rest = rows.join(F.broadcast(heavy), "text_sha256", "left_anti")
    winners = written(best_of(rest))
    out = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row"]
    return frequent.select(*out).unionByName(rest.join(winners, "text_sha256").select(*out))


def distinct_texts(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs (doc_id, text, ...), all columns, that exact_groups() keeps: one of each group of equal texts.

    Nulls, empty texts, ties, repeated rows and an empty table are as in exact_groups(); columns whose names clash
    with ours are left as they are.
    """
    (row,) = fresh(docs, "row")
    read = written(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = settled(lambda: exact_groups(read, counters, row).filter("kept").select("row", F.lit(1).alias("copies")))
    return copied(read, row, kept, bits=1).drop(row)
