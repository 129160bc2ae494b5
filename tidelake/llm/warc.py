"""WARC archives: written with revisits, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelake import paths
from tidelake.llm.common import discard, partitions, written

MAGIC = b"WARC/1.0\r\n"
#: Equal payloads shorter than this are no revisits.
LEAST = 100
#: Bytes of a record's header at most; what goes on for longer is no header.
LONGEST = 1 << 16
DATE = "2024-01-01T00:00:00Z"
#: Duplicated payloads (40 bytes each) up to which the responses' table is sent to all tasks; beyond it, a join.
SENT = 50_000


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(record): a WARC record as text for each row of pages (page_id, url, html, ...).

    Of records with equal payloads of at least `least` bytes, those with the smallest page_id are responses, the others
    revisits of it without payload; a null page_id is never the smallest, unless all are null, which are all
    responses. Null html: an empty payload. Null url: no target. Other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    first = written(first.select(F.col("digest").alias("same"), "first"))
    side = F.broadcast(first) if first.count() <= SENT else first
    rows = rows.join(side, F.col("digest") == F.col("same"), "left")
    revisit = F.coalesce(F.col("first") != F.coalesce("page_id", F.lit(-(1 << 63))), F.lit(False))
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    one_line = F.regexp_replace("url", r"[\r\n]", "")
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        F.lit(f"WARC-Date: {DATE}\r\n"),
        line("WARC-Target-URI", one_line),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length(payload).cast("string")),
        F.lit("\r\n"),
    )
    # the writer ends each value with the last of a record's closing "\r\n\r\n"
    return rows.select(F.concat(head, payload, F.lit("\r\n\r\n").substr(1, 3)).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, per_file: int = 0, compression: str = "none") -> None:
    """Writes pages as WARC files into the folder path, through Spark's own committer; see records() for odd rows.

    Records are text, so Spark's text writer makes the files; any file system that Spark writes to will do, and a
    task that runs again leaves no second copy. Plain files are read by ranges, so they may be of any size; with
    compression "gzip" a file is read by one task, as a stream, and per_file (records) bounds it.
    """
    records(pages, least).write.option("compression", compression).option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


def reachable(starts: np.ndarray, follows: np.ndarray, first: int = 0) -> np.ndarray:
    """Positions of the candidates on the chain from offset `first`, by pointer jumping.

    jump[i] is where 2^r records after candidate i begin; in each round what 2^r records lie beyond is marked too, so
    a chain of n records takes log2(n) rounds over arrays. Candidates inside payloads lie on no such chain.
    """
    n = len(starts)
    if not n:
        return np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(starts, follows), n - 1)
    jump = np.append(np.where((follows >= 0) & (starts[place] == follows), place, n), n)  # n: beyond the last
    mark = np.zeros(n + 1, bool)
    at = np.searchsorted(starts, first)
    if at == n or starts[at] != first:
        return np.empty(0, np.int64)
    mark[at] = True
    while True:
        new = jump[np.flatnonzero(mark)]
        before = mark.sum()
        mark[new] = True
        if mark.sum() == before:
            break
        jump = jump[jump]
    return np.flatnonzero(mark[:n])


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, size, data): what stands between two magic strings, wherever these are, payloads included.

    Spark's text reader cuts plain files by ranges (block: where a range begins) and gives each segment to the one
    range that its magic string's end lies in, in order; gzip files are one range each. The first segment of a file is
    what stands before its first magic string.
    """
    read = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value"))


def field(name: str) -> Column:
    return F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), rf"(?i)\r\n{name}: *([^\r\n]*?) *(?=\r\n|\z)", 1)


#: A candidate: where it is (its file, range, number and byte within the range), where its successor is by its length
#: (-1: nowhere), where the chain from it leaves the range, the range's bytes, and its header's fields.
CANDIDATES = (
    "file string, block long, size long, idx long, place long, follow long, exit long, total long, "
    "whole boolean, head_bytes long, body_bytes long, digest string, kind string, id string, refers string, stated string, stated_bytes string, url string"
)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Each segment as a candidate for a record. Headers are read and payloads hashed where the bytes are; payloads
    themselves go nowhere, and a magic string inside a payload costs one short row."""
    data = F.col("value").cast("binary")
    rows = segments(spark, path).withColumns({"bytes": F.octet_length("value").cast("long"), "head": F.substring_index("value", "\r\n\r\n", 1)})
    rows = rows.withColumn("head_bytes", F.octet_length("head").cast("long"))
    rows = rows.withColumn("head", F.when((F.col("head_bytes") < F.col("bytes")) & (F.col("head_bytes") <= LONGEST), F.col("head")))
    rows = rows.withColumn("body_bytes", field("Content-Length").try_cast("long"))
    span = F.lit(len(MAGIC)) + F.col("head_bytes") + 4 + F.col("body_bytes") + 4
    # a record that ends where the segment does is checked and hashed here; longer ones go over several segments
    rows = rows.withColumn("span", F.when(F.col("body_bytes").between(0, 1 << 60), span)).withColumn("whole", F.coalesce(F.col("span") == F.col("bytes") + len(MAGIC), F.lit(False)))
    closed = F.substring(data, -4, 4) == F.lit(b"\r\n\r\n")
    body = data.substr((F.col("head_bytes") + 5).cast("int"), F.col("body_bytes").try_cast("int"))
    short = F.col("span") < F.col("bytes") + len(MAGIC)  # no record begins where it would end
    rows = rows.withColumns({
        "span": F.when(short | F.col("whole") & ~closed, F.lit(-1)).otherwise(F.coalesce("span", F.lit(-1))).cast("long"),
        "digest": F.when(F.col("whole"), F.sha2(body, 256)),
        "kind": field("WARC-Type"), "id": field("WARC-Record-ID"), "refers": field("WARC-Refers-To"),
        "stated": field("WARC-Payload-Digest"), "stated_bytes": field("X-Payload-Length"), "url": F.when(F.col("head").rlike("(?i)(^|\n)WARC-Target-URI:"), field("WARC-Target-URI")),
    })
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    carried = names[names.index("whole"):]

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ranges(batches):
            sizes, span = (table.column(i).to_numpy() for i in (3, 4))
            n = len(sizes)
            ends = np.cumsum(sizes + len(MAGIC))
            place = ends - sizes - len(MAGIC)  # where the segment begins, behind its magic string
            follow = np.where(span >= 0, place + span, -1)
            exits = leaving(place, follow, int(ends[-1]))
            of_range = [table.column(i) for i in range(3)]
            numbers = [pa.array(x, pa.int64()) for x in (np.arange(n), place, follow, exits, np.full(n, ends[-1]))]
            yield from pa.Table.from_arrays([*of_range, *numbers, *(table.column(i) for i in range(5, table.num_columns))], names).to_batches(10_000)

    return rows.select("file", "block", "size", "bytes", "span", *carried).mapInArrow(contract, CANDIDATES)


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one range of a file after another's; a task reads its ranges one by one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(s, e - s)
            if held and any(held[-1].column(i)[-1].as_py() != part.column(i)[0].as_py() for i in (0, 1)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def leaving(place: np.ndarray, follow: np.ndarray, total: int) -> np.ndarray:
    """Where the chain from each candidate leaves a range of `total` bytes, by pointer jumping; -1: it breaks off before."""
    n = len(place)
    at = np.minimum(np.searchsorted(place, follow), n - 1)
    inside = (follow >= 0) & (follow < total)
    # what follows within the range is a candidate's number; n: the chain has left, or has broken off
    jump = np.append(np.where(inside & (place[at] == follow), at, n), n)
    exits = np.append(np.where(inside & (place[at] != follow), -1, follow), -1)
    while (jump[:n] < n).any():
        exits = np.where(jump < n, exits[jump], exits)
        jump = jump[jump]
    return exits[:n]


def reached(cand: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, block, entry): the byte, within the range, at which the chain from the file's start enters each range.

    Ranges hand on where their chains leave; only candidates to which some chain leads take part, one or two a range.
    In round r jumps lead over 2^r ranges, so a file of n ranges takes log2(n) rounds of joins.
    """
    based = cand.join(blocks, ["file", "block"]).select("file", "block", (F.col("base") + F.col("place")).alias("at"), F.when(F.col("exit") >= 0, F.col("base") + F.col("exit")).alias("to"), "base")
    first = cand.filter("block = 0 and idx = 1").select("file", F.col("place").alias("at"))
    aims = based.filter("to is not null").select("file", F.col("to").alias("at")).union(first).distinct()
    heads = written(based.join(aims, ["file", "at"]))
    jump = written(heads.select("file", "at", "to"))
    found = written(first)
    while not jump.isEmpty():
        ahead = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        more = written(found.union(found.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        further = written(jump.join(ahead, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")).filter("to is not null"))
        discard(jump)
        discard(found)
        jump, found = further, more
    out = written(heads.join(found, ["file", "at"]).select("file", "block", (F.col("at") - F.col("base")).alias("entry"), "to"))
    for table in (heads, jump, found):
        discard(table)
    return out


def on_chain(cand: DataFrame, entries: DataFrame) -> DataFrame:
    """(file, block, idx, place, kept, owner) of each candidate: whether it lies on the chain, and the byte, within its
    range, of the record that holds it (null: of a record that began in an earlier range)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ranges(batches):
            place, follow = (table.column(i).to_numpy() for i in (3, 4))
            entry = table.column(5)[0].as_py()
            kept = np.zeros(len(place), bool)
            if entry is not None:
                kept[reachable(place, follow, entry)] = True
            last = np.maximum.accumulate(np.where(kept, np.arange(len(place)), -1))
            owner = pa.array(np.where(last >= 0, place[last], 0), pa.int64(), mask=last < 0)
            columns = [table.column(i) for i in range(4)]
            yield from pa.Table.from_arrays([*columns, pa.array(kept), owner], ["file", "block", "idx", "place", "kept", "owner"]).to_batches(10_000)

    rows = cand.select("file", "block", "idx", "place", "follow").join(entries.select("file", "block", "entry"), ["file", "block"], "left")
    rows = rows.repartition(partitions(cand.sparkSession), "file", "block").sortWithinPartitions("file", "block", "idx")
    return rows.select("file", "block", "idx", "place", "follow", "entry").mapInArrow(mark, "file string, block long, idx long, place long, kept boolean, owner long")


PARTS = "file string, block long, idx long, data binary"


def assembled(spark: SparkSession, path: str, needed: DataFrame) -> DataFrame:
    """(file, start, payload, body_digest) of the records that needed (file, block, idx, start, at, body_bytes,
    head_bytes) has the segments of. The archives are read again; a task holds a record at a time."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, idx = None, 0
        for batch in batches:
            numbers = []
            for place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                idx = idx + 1 if place == last else 0
                last = place
                numbers.append(idx)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), batch.column(2)], ["file", "block", "idx", "data"])

    parts = segments(spark, path).select("file", "block", F.col("value").cast("binary").alias("data")).mapInArrow(number, PARTS)
    parts = parts.join(needed, ["file", "block", "idx"]).select("file", "start", "at", "head_bytes", "body_bytes", "data")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        of, head, size = None, 0, 0

        def record() -> pa.RecordBatch:
            raw = MAGIC.join(held)
            body = raw[head + 4 : head + 4 + size]
            if len(raw) != head + 4 + size + 4 or raw[-4:] != b"\r\n\r\n":
                raise ValueError("the chain of records does not reach the file's end: a record does not end as one")
            return pa.RecordBatch.from_arrays([pa.array([of[0]]), pa.array([of[1]], pa.int64()), pa.array([body], pa.binary()), pa.array([hashlib.sha256(body).hexdigest()])], ["file", "start", "payload", "body_digest"])

        for batch in batches:
            for i in range(batch.num_rows):
                file, start, head_bytes, body_bytes, data = (batch.column(c)[i].as_py() for c in (0, 1, 3, 4, 5))
                if (file, start) != of:
                    if held:
                        yield record()
                    of, held = (file, start), []
                    head, size = head_bytes, body_bytes
                held.append(data)
        if held:
            yield record()

    ordered = parts.repartition(partitions(spark), "file", "start").sortWithinPartitions("file", "start", "at")
    return ordered.mapInArrow(join, "file string, start long, payload binary, body_digest string")


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of the archives in path, one row a
    record, whichever wrote them.

    Archives are read by ranges. Each task emits what looks like a record's start, all places with the magic string,
    with the offset of its successor, as its length states it. Pointer jumping, within ranges and then over them, from
    each file's start keeps the records proper; magic strings inside payloads, whole records among them, are on no
    such chain. A chain that does not end where its file does fails the read, and so does a response whose payload
    does not have its header's SHA-256. payload_bytes and payload_digest are of the full payload, for revisits from the
    header. Ids that are no number, and fields that a header lacks, are null. An empty folder gives an empty table. A
    payload may have any bytes and any length that one row can hold; only payloads that hold magic strings, or all
    where payloads are asked for, are read a second time.
    """
    cand = written(candidates(spark, path))
    by_block = cand.groupBy("file", "block").agg(F.max("total").alias("total"), F.max("size").alias("size"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    blocks = written(by_block.select("file", "block", "total", "size", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    entries = reached(cand, blocks)
    # segments are counted with a magic string each, of which a file has one less
    files = blocks.groupBy("file").agg((F.sum("total")).alias("end"), F.max("size").alias("size"))
    ends = entries.groupBy("file").agg(F.max("to").alias("last"))
    plain = ~F.col("file").endswith(".gz")
    broken = files.join(ends, "file", "left").filter(F.coalesce(F.col("last"), F.lit(-1)) != F.col("end")).select("file")
    cut = files.filter(plain & (F.col("end") - len(MAGIC) != F.col("size"))).select("file")
    early = cand.filter("block = 0 and idx = 1").filter(F.col("place") != len(MAGIC)).select("file")  # bytes before the first record
    bad = broken.union(cut).union(early).limit(3).collect()
    if bad:
        raise ValueError(f"the chain of records does not reach the file's end: {', '.join(sorted({r['file'] for r in bad}))}")
    marked = written(on_chain(cand, entries))
    based = marked.join(blocks.select("file", "block", "base"), ["file", "block"])
    of = written(cand.join(based.filter("kept").select("file", "block", "idx", (F.col("base") + F.col("place")).alias("start")), ["file", "block", "idx"]))
    wanted = of if with_payload else of.filter("not whole")
    if wanted.isEmpty():
        out = of.withColumns({"payload": F.lit(None).cast("binary"), "body_digest": F.col("digest")})
    else:
        # a segment's record began in its range, or was the last that began before
        own = based.withColumn("at", F.col("base") + F.col("place")).withColumn("began", F.col("base") + F.col("owner"))
        last = written(own.groupBy("file", "block").agg(F.max("began").alias("last")))
        earlier = last.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("earlier"))
        own = own.join(earlier, ["file", "block"]).select("file", "block", "idx", "at", F.coalesce("began", "earlier").alias("start"))
        needed = own.join(wanted.select("file", "start", "head_bytes", "body_bytes"), ["file", "start"])
        bodies = assembled(spark, path, needed)
        bodies = bodies if with_payload else bodies.withColumn("payload", F.lit(None).cast("binary"))
        out = of.join(written(bodies), ["file", "start"], "left").withColumn("body_digest", F.coalesce("body_digest", "digest"))
    for table in (cand, blocks, entries, marked):
        discard(table)
    revisit = F.col("kind") == "revisit"
    stated = F.when(F.col("stated").startswith("sha256:"), F.substring_index("stated", ":", -1))
    wrong = ~revisit & stated.isNotNull() & (stated != F.col("body_digest"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return out.select(
        page("id").alias("page_id"),
        F.when(revisit, F.coalesce(F.col("stated_bytes").try_cast("long"), F.lit(0))).otherwise(F.col("body_bytes")).cast("long").alias("payload_bytes"),
        F.when(wrong, F.raise_error(F.lit("a payload does not have its digest")).cast("string")).when(revisit, stated).otherwise(F.col("body_digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), page("refers").alias("refers_to"), "url", "payload",
    )


def archive_folder(spark: SparkSession) -> str:
    return paths.scratch(spark, "warc")
