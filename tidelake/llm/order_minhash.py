"""Document fingerprints by Order MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelake.llm.common import partitions, written

#: Code points of a k-mer, tuples of a signature, k-mers of a tuple.
K, TUPLES, PER_TUPLE = 8, 32, 2  # K: a power of two
#: Code points that are hashed at a time.
PIECE = 1 << 17
#: A first selection keeps about so many k-mers a place in the signature; where it falls short, all are looked at.
AMPLE = 10
ROOM = np.uint64(59)  # 64 bits less those that choose the tuple


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kmer_hashes(points: np.ndarray, starts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the k-mers of documents that lie one after another; shorter ones: of the whole text."""
    n = len(points)
    lengths = np.diff(np.append(starts, n))
    if n < k:
        points = np.append(points, np.zeros(k - n, points.dtype))
    # hashes of k = 8 points from those of 4, 2 and 1
    h, factor, span = points.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while span < k:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor, span = factor * factor + 2 & 0xFFFFFFFFFFFFFFFF, 2 * span
    h ^= h >> np.uint64(29)
    last = np.repeat(starts + lengths, lengths)
    at = np.arange(n)
    whole = np.flatnonzero(at[: len(h)] + k <= last[: len(h)])
    doc = np.repeat(np.arange(len(starts)), lengths)
    out, of = h[whole], doc[whole]
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        more = np.array([int.from_bytes(hashlib.blake2b(points[starts[i] : starts[i] + lengths[i]].astype("<u4").tobytes(), digest_size=8).digest(), "little") for i in short], np.uint64)
        out, of = np.append(out, more), np.append(of, short)
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def numbered_occurrences(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each k-mer how many equal ones of its document stand before it."""
    own = h ^ mix(doc.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(len(h), np.uint64)
    # most k-mers are alone in a cell of a table of counts, and so have no equal; the others are sorted
    bits = np.uint64(64 - max(10, int(len(h)).bit_length() + 1))
    cell = (own * np.uint64(0xFF51AFD7ED558CCD) >> bits).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(cell)[cell] > 1)
    own_m = own[maybe]
    order = np.argsort(own_m)
    own_m = own_m[order]
    same = own_m[1:] == own_m[:-1]
    if same.any():
        inside = np.append(False, same) | np.append(same, False)
        at = maybe[order[inside]]  # all k-mers that have an equal one, run after run
        run = np.cumsum(np.append(True, own[at[1:]] != own[at[:-1]])) - 1
        both = np.sort(run.astype(np.uint64) << np.uint64(32) | at.astype(np.uint64))  # runs, in text order
        run, at = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        first = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1]), np.arange(len(run)), 0))
        out[at] = np.arange(len(run)) - first
    return out


def signatures(texts: list[str]) -> np.ndarray:
    """n x TUPLES values of 32 bits; 0 where a text has no k-mer for a tuple."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    out = np.zeros((len(texts), TUPLES), np.uint32)
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= PIECE):
            size += len(raw[end])
            end += 1
        out[at:end] = piece_signatures(raw[at:end])
        at = end
    return out


def piece_signatures(raw: list[np.ndarray]) -> np.ndarray:
    lengths = np.array([len(r) for r in raw])
    out = np.zeros((len(raw), TUPLES), np.uint32)
    points = np.concatenate(raw)
    if not len(points):
        return out
    h, doc = kmer_hashes(points, np.cumsum(lengths) - lengths)
    value = mix(h + numbered_occurrences(h, doc) * np.uint64(0x9E3779B97F4A7C15))
    tuple_of, rank = (value >> ROOM).astype(np.int64), value & np.uint64((1 << int(ROOM)) - 1)
    kmers = np.bincount(doc, minlength=len(raw))
    share = np.minimum(1.0, AMPLE * PER_TUPLE * TUPLES / np.maximum(1, kmers))
    limit = np.where(share < 1, share * 2.0 ** int(ROOM), 2.0**63).astype(np.uint64)
    chosen = np.flatnonzero(rank <= limit[doc])
    slots = np.bincount(doc[chosen] * TUPLES + tuple_of[chosen], minlength=len(raw) * TUPLES).reshape(-1, TUPLES)
    short = (slots.min(1) < PER_TUPLE) & (share < 1)
    if short.any():  # too few k-mers for a tuple: look at all k-mers of these documents
        chosen = np.flatnonzero((rank <= limit[doc]) | short[doc])
    slot = doc[chosen] * TUPLES + tuple_of[chosen]
    # by slot, then rank; ties between different k-mers go by place
    order = np.lexsort((rank[chosen], slot))
    slot, pick = slot[order], chosen[order]
    start = np.maximum.accumulate(np.where(np.append(True, slot[1:] != slot[:-1]), np.arange(len(slot)), 0))
    least = np.arange(len(slot)) - start < PER_TUPLE
    slot, pick = slot[least], pick[least]
    order = np.lexsort((pick, slot))  # the least k-mers of a slot, in text order
    slot, pick = slot[order], pick[order]
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
    # a tuple's hash heeds the order of its k-mers
    mixed = np.add.reduceat(mix(h[pick] + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), first)
    out.reshape(-1)[slot[first]] = np.maximum(1, mix(mixed) >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the tuples that agree, of those that either has; 1 if neither has any."""
    used = ((a | b) != 0).sum(1)
    return np.where(used == 0, 1.0, ((a == b) & (a != 0)).sum(1) / np.maximum(1, used))


def shown(signature: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in signature]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row of docs (doc_id, text, ...): 32 tuples of 8 hex digits.

    A text's k-mers of code points are numbered by occurrence and hashed; the hash's first bits deal each to one of
    the tuples, where the two with the least hashes stay. Their hashes, in text order, make the tuple. So signatures
    agree in a tuple only if the same k-mers come in the same order. Null text counts as empty, which has a signature
    of zeros; texts shorter than a k-mer have one k-mer. Nothing is shuffled. Other columns are not read.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown(signatures(texts)))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(prints, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter (floor) of code points replaced by as many of the next text's first, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows of edit_likeness() between its two steps: a result, or (kind 1, 2) the first and the last text of a range.
FOUND = EDITS + ", kind int, range int, text string"
#: Rows that are compared at a time.
ROWS = 250


def compared(ids: list[int | None], texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns EDITS of texts and the texts that follow them."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    # a row's next is mostly the next row: each text is hashed once
    distinct = list(dict.fromkeys([*texts, *following]))
    every = signatures(distinct)
    place = {t: i for i, t in enumerate(distinct)}
    a, b, e = every[[place[t] for t in texts]], every[[place[t] for t in following]], signatures(changed)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
        pa.array(shown(a)), pa.array(shown(e)), pa.array(likeness(a, e)), pa.array(likeness(a, b)),
    ]


def edit_likeness(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """For each row of docs (doc_id, text, ...) its fingerprint's likeness to its edited text's and the next row's.

    The next row is the next by doc_id (null first), then by the text's hash; after the last comes the first. Null
    text counts as empty. Repeated rows follow each other. One row alone follows itself. An empty table gives an empty
    table. Other columns are not read.

    Rows are range-sorted into `ranges` tasks (unless stated, as many as a shuffle has), which stream through them:
    each holds a few rows. Rows with equal doc_ids are split by the text's hash and then by where they were read, so a
    doc_id, or a text, that a third of all rows have is spread over many tasks. A range hands on two texts, its first
    and its last, whose neighbours lie in other ranges; these are compared in a second step, two rows a range.
    """
    spark = docs.sparkSession
    names = [c.split()[0] for c in FOUND.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), "h", "row"]
    placed = rows.repartitionByRange(ranges or partitions(spark), *order).sortWithinPartitions(*order)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        empty = pa.array([], pa.int64())

        def out(ids: list, texts: list[str], following: list[str], ends: list[tuple]) -> pa.RecordBatch:
            found = compared(ids, texts, following) if ids else [empty] * 7
            n = len(ids) + len(ends)
            kinds = [TYPES[x.split()[1]] for x in EDITS.split(", ")]
            some = [pa.concat_arrays([c.cast(k), pa.nulls(len(ends), k)]) for c, k in zip(found, kinds)]
            some[0] = pa.concat_arrays([some[0].slice(0, len(ids)), pa.array([e[1] for e in ends], pa.int64())])
            rest = [pa.array([0] * len(ids) + [e[0] for e in ends], pa.int32()), pa.array([at] * n, pa.int32()), pa.array([None] * len(ids) + [e[2] for e in ends], pa.string())]
            return pa.RecordBatch.from_arrays([*some, *rest], names)

        last: tuple | None = None  # the row whose following row is still to come
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                ids, texts = (batch.column(c).slice(i, ROWS).to_pylist() for c in range(2))
                first = [(1, ids[0], texts[0])] if last is None else []
                if last is not None:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = ids[-1], texts[-1]
                if first or len(ids) > 1:
                    yield out(ids[:-1], texts[:-1], texts[1:], first)
        if last is not None:
            yield out([], [], [], [(2, *last)])

    found = written(placed.select("doc_id", "text").mapInArrow(within, FOUND))
    # one number a range: the next range that has rows; after the last comes the first
    used = found.filter("kind = 1").select("range")
    after = used.select("range", F.coalesce(F.lead("range").over(W.orderBy("range")), F.min("range").over(W.partitionBy())).alias("after"))
    firsts = found.filter("kind = 1").select(F.col("range").alias("after"), F.col("text").alias("following"))
    ends = found.filter("kind = 2").select("range", "doc_id", "text").join(after, "range").join(firsts, "after").select("doc_id", "text", "following")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays(compared(*(batch.column(c).slice(i, ROWS).to_pylist() for c in range(3))), names[:7])

    return found.filter("kind = 0").select(*names[:7]).unionByName(ends.mapInArrow(across, EDITS))


#: Arrow's types of the names that FOUND uses.
TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
