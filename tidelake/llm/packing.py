"""Packing of documents into sequences along a space-filling curve."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import partitions, written

LENGTH, END = 1024, 0
#: Ids of a row that is sorted, at most: long documents are several rows, so that ranges of equal rows are near equal in bytes.
CHUNK = 4096
#: Dimensions of the curve and bits of each.
DIMENSIONS, BITS = 3, 10
#: Buckets into which token ids are hashed for a document's vector.
BUCKETS = 1 << 12


@functools.cache
def byte_encoder(path: str):
    """text -> ids as the `tokenizers` library gives them for a byte-level BPE file, without added tokens.

    The file's vocabulary is handed to tiktoken's merge loop, which is several times as fast; this is the same
    function where ids follow the order of the merges, which is checked here. Where they don't, or for a text that
    tiktoken can't take, the library itself encodes.
    """
    held: list = []  # the library is loaded only where it is needed

    def plain(text: str) -> list[int]:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return held[0].encode(text, add_special_tokens=False).ids

    spec = json.load(open(path, encoding="utf-8"))
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pre = spec["pre_tokenizer"]
    usual = pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not spec["normalizer"] and not spec["post_processor"]
    in_order = all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges))
    if not (usual and in_order):
        return plain
    import tiktoken

    # Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in word): i for word, i in vocab.items() if word not in special}
    # The split that ByteLevel makes with use_regex
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except BaseException as e:  # the regex engine's limit on very long runs of white space
            if isinstance(e, KeyboardInterrupt | SystemExit):
                raise
            return plain(text)

    return encode


def projection(dimensions: int = DIMENSIONS, buckets: int = BUCKETS) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((buckets, dimensions)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points (n x d integers below 2^bits), by Skilling's transposition."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of projected vectors with entries of about standard deviation 1."""
    with np.errstate(over="ignore"):
        even = 1 / (1 + np.exp(-1.7 * vectors.astype(np.float64)))
    return hilbert(np.clip((even * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def tokenized(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """(doc_id, key, n, start, ids): each text's ids and the closing id, at most CHUNK a row from start on, and its key.

    ids are little-endian words of 16 bits, or of 32 where a document has an id that needs them.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, axes = byte_encoder(vocabulary), projection()
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            rows, at = [], []
            points = np.zeros((batch.num_rows, axes.shape[1]), np.float32)
            for i, t in enumerate(batch.column(1)):
                ids = np.array(to_ids(t.as_py() or "") + [end], np.uint32)
                counts = np.bincount(ids * np.uint32(2654435761) >> np.uint32(20), minlength=BUCKETS)
                points[i] = counts @ axes / max(1.0, float(np.sqrt((counts * counts).sum())))
                words = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4")
                for start in range(0, len(ids), CHUNK):
                    at.append(i)
                    rows.append((len(ids), start, words[start : start + CHUNK].tobytes()))
            if rows:
                n, starts, raw = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(curve_keys(points)[at]), pa.array(n, pa.int64()), pa.array(starts, pa.int64()), pa.array(raw, pa.binary())],
                    ["doc_id", "key", "n", "start", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, key long, n long, start long, ids binary")


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, vocabulary: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of docs (doc_id, text, ...) in sequences of at most `length` tokens, one row a piece.

    A document's ids are followed by the id `end`; null text counts as empty, so each document has at least one id.
    Documents are range-sorted by the Hilbert key of their projected token vectors, then doc_id and size, and
    neighbours along the curve follow each other through sequences of `length`, cut where a sequence is full. What a
    task has left at its end goes to sequences whose sizes are powers of two, which need no padding, so no token of
    padding is needed at all. Long documents are sorted in chunks, so ranges are even in tokens and no row is large.
    Each task sees its rows as a stream and holds one chunk and one sequence at a time.
    Repeated rows and equal doc_ids are packed like other rows; a null doc_id stays null. An empty table gives an
    empty one. sequence_ids are distinct; they number a task's sequences from its place in the range sort on.
    with_ids adds column ids (binary, little-endian 32-bit), the piece itself.
    """
    spark = docs.sparkSession
    tokens = written(tokenized(docs, vocabulary, end))
    ordered = tokens.repartitionByRange(partitions(spark), "key", "doc_id", "n", "start").sortWithinPartitions("key", "doc_id", "n", "start", "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        at = 0
        rows: list[tuple] = []
        open_from = 0  # rows before this one belong to sequences that are full

        def out(some: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*some))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + ([pa.array(cols[7], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, names)

        names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            for doc, n, start, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                here = min(CHUNK, n - start)  # ids of the chunk
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * here else "<u4").astype("<u4").tobytes()
                done = 0
                while done < here:
                    take = min(here - done, length - at)
                    piece = ids[4 * done : 4 * (done + take)]
                    rows.append((doc, start + done, take, zlib.crc32(piece), n, sequence, at, piece))
                    done, at = done + take, at + take
                    if at == length:
                        sequence, at, open_from = sequence + 1, 0, len(rows)
            if open_from > 4096:
                yield out(rows[:open_from])
                rows, open_from = rows[open_from:], 0
        last, rows = rows[open_from:], rows[:open_from]
        sizes, at = powers(at), 0
        for doc, start, left, _, n, _, _, ids in last:
            while left:
                take = min(left, sizes[0] - at)
                rows.append((doc, start, take, zlib.crc32(ids[: 4 * take]), n, sequence, at, ids[: 4 * take]))
                ids, start, left, at = ids[4 * take :], start + take, left - take, at + take
                if at == sizes[0]:
                    sequence, at, sizes = sequence + 1, 0, sizes[1:]
        if rows:
            yield out(rows)

    return ordered.select("doc_id", "n", "start", "ids").mapInArrow(pack, PIECES + ", ids binary" * with_ids)
