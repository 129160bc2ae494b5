"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import partitions

#: The template: a turn is HEAD, the role, SEP, the text and TAIL. ESCAPE stands before control strings inside texts.
HEAD, SEP, TAIL, ESCAPE = "### ", ": ", "</turn>\n", "\\"
#: Strings that get an escape inside texts and roles; a role's separator is one more, so that a header can be read.
CONTROL, IN_ROLE = ("###", "</turn>"), (":",)
#: Bytes that are assembled, or read back, at a time; texts with more bytes than LONG are copied as one slice.
PIECE, LONG = 4 << 20, 1 << 16


def escaped(column: pa.Array, control: tuple[str, ...] = CONTROL) -> pa.Array:
    for string in (ESCAPE, *control):
        column = pc.replace_substring(column, string, ESCAPE + string)
    return column


def unescaped(raw: bytes) -> bytes:
    """The bytes without their escapes, a piece at a time; a text without any is given back as it is."""
    if ESCAPE.encode() not in raw:
        return raw
    out, odd = [], 0  # odd: the piece before ended within a run, on an escape whose character is still to come
    for i in range(0, len(raw), PIECE):
        piece = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - i), i)
        at = np.flatnonzero(piece == ord(ESCAPE))
        starts = np.flatnonzero(np.append(True, np.diff(at) != 1)[: len(at)])
        runs = np.diff(np.append(starts, len(at)))
        place = np.arange(len(at)) - np.repeat(starts, runs)
        if odd and len(at) and not at[0]:
            place[: runs[0]] += 1
        # in a run every second one is a character, not an escape
        keep = np.ones(len(piece), bool)
        keep[at[place % 2 == 0]] = False
        out.append(piece[keep].tobytes())
        odd = len(at) > 0 and at[-1] == len(piece) - 1 and place[-1] % 2 == 0
    return b"".join(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the values, one more than values; bytes) of a string column without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all turns; each turn's start, one more than turns; where its text starts; where it ends)."""
    parts = [pa.array([HEAD]), escaped(role, (*CONTROL, *IN_ROLE)), pa.array([SEP]), escaped(text), pa.array([TAIL])]
    n = len(text)
    lengths, sources = np.empty((n, len(parts)), np.int64), []
    for i, part in enumerate(parts):
        at, data = buffers(part)
        lengths[:, i] = np.diff(at)
        sources.append((at, data))
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for i, (at, data) in enumerate(sources):
        if len(at) == 2 and n != 1:  # a header: the same bytes for each turn
            out[(starts[:, i, None] + np.arange(at[1] - at[0])).ravel()] = np.tile(data[at[0] : at[1]], n)
        else:
            long = np.flatnonzero(lengths[:, i] > LONG)
            for j in long:  # by slices; the others by indices, one a byte
                out[starts[j, i] : ends[j, i]] = data[at[j] : at[j + 1]]
            for lo, hi in zip([0, *(long + 1)], [*long, n]):
                held = data[at[lo] : at[hi]]
                out[np.arange(len(held)) + np.repeat(starts[lo:hi, i] - (at[lo:hi] - at[lo]), lengths[lo:hi, i])] = held
    return out, np.append(starts[:, 0], ends[-1:, -1]), starts[:, 3], ends[:, 3]


FORMATTED = "conv_id long, piece long, formatted string, mask array<struct<start:long,end:long>>"


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, piece, formatted, mask) of turns (conv_id, turn, role, text, ...).

    Turns of a conversation are in order of turn (null first), then role and text, so ties and repeated rows have a
    place; null role or text counts as empty; turns without conv_id are one conversation. A conversation is one row,
    or several, numbered by piece, where it is longer than a batch: pieces end with a turn and follow each other, so
    a conversation that holds most rows is still a stream. mask has the spans of formatted, in bytes of UTF-8, that a
    loss is taken of: the texts of the role `trained`. An empty table gives an empty table. Other columns are not
    read. Inside texts and roles control strings get an escape; read_back() takes it out again.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = object(), 0
        for whole in batches:
            bytes_to = np.cumsum(np.diff(buffers(whole.column(3))[0]) + 64)
            at = 0
            while at < whole.num_rows:
                upto = bytes_to[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(bytes_to, upto + PIECE)))
                batch = whole.slice(at, end - at)
                at = end
                out, start, text_from, text_to = assemble(batch.column(2), batch.column(3))
                conv = batch.column(0).to_pylist()
                cuts = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]] + [len(conv)]
                to_train = np.flatnonzero(pc.equal(batch.column(2), trained).to_numpy(zero_copy_only=False))
                first = np.searchsorted(to_train, cuts)
                ids, pieces, masks = [], [], []
                for k, (s, _) in enumerate(zip(cuts, cuts[1:])):
                    piece = piece + 1 if conv[s] == last else 0
                    last = conv[s]
                    ids.append(last)
                    pieces.append(piece)
                    masks.append([{"start": int(text_from[i] - start[s]), "end": int(text_to[i] - start[s])} for i in to_train[first[k] : first[k + 1]]])
                ends = start[cuts].astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(out)])
                spans = pa.array(masks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int64()), text, spans], ["conv_id", "piece", "formatted", "mask"])

    ordered = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", "role", "text").mapInArrow(build, FORMATTED)


def unescaped_place(raw: bytes, string: bytes, at: int) -> int:
    """Where `string` next stands in raw, from `at` on, that no escape covers; -1: nowhere."""
    start, escape = at, ESCAPE.encode()
    while (at := raw.find(string, at)) >= 0:
        window = 16
        while (run := len(part := raw[max(start, at - window) : at]) - len(part.rstrip(escape))) == len(part) == window:
            window *= 2
        if run % 2 == 0:
            return at
        at += 1
    return -1


def read_back(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of the turns in formatted text, by searching for the control strings: no work is done by character."""
    head, sep, tail = HEAD.encode(), SEP.encode(), TAIL.encode()
    at = 0
    while at < len(raw):
        role_end = unescaped_place(raw, sep, at + len(head))
        text_end = unescaped_place(raw, tail, role_end + len(sep)) if role_end >= 0 else -1
        if not raw.startswith(head, at) or text_end < 0:
            raise ValueError(f"no turn at {at}")
        yield unescaped(raw[at + len(head) : role_end]), unescaped(raw[role_end + len(sep) : text_end])
        at = text_end + len(tail)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def code_points(raw: bytes) -> int:
    """Code points of UTF-8: the bytes that don't go on with one."""
    return sum(int(np.count_nonzero(np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - i), i) & 0xC0 != 0x80)) for i in range(0, len(raw), PIECE))


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation, read back from formatted()'s output: counts and digests of its turns and its mask.

    Pieces must come as formatted() leaves them, a conversation's one after another in one task; where they don't,
    the read fails. A conversation without conv_id is one like others; one of empty turns has empty digests' values. A
    turn is held whole, once as it stands and once unescaped. No pieces give an empty table; other columns are not read.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, state = None, -1, None

        def row() -> tuple:
            n, turns, loss_n, loss, chars = state
            return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in DIGESTS.split(", ")])

        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                c, piece, mask = (batch.column(j)[i].as_py() for j in (0, 1, 3))
                raw = batch.column(2)[i].as_py()
                if not piece:
                    if state:
                        rows.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                elif c != conv or piece != last + 1:
                    raise ValueError(f"piece {piece} of conversation {c} does not follow the one before it")
                last = piece
                state[4] += code_points(raw)
                for span in mask:
                    plain = unescaped(raw[span["start"] : span["end"]])
                    state[2] += code_points(plain)
                    state[3].update(plain)
                for role, said in read_back(raw):
                    state[0] += 1
                    for part in (role, b"\n", said, b"\n"):
                        state[1].update(part)
            if rows:
                yield out(rows)
        if state:
            yield out([row()])

    # formatted() leaves each conversation's pieces in order within a task
    return pieces.select("conv_id", "piece", F.col("formatted").cast("binary"), "mask").mapInArrow(digest, DIGESTS)
