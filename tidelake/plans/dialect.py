"""SQL of the documented dialect, run, and results as clients take them."""

from __future__ import annotations

import codecs
import itertools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake import paths
from tidelake.operators.browse import egress
from tidelake.plans.safety import listed
from tidelake.plans.translate import WHOLE, translate

__all__ = ["arrow_stream", "json_rows", "msgpack_columns", "query", "run", "translate"]


def query(spark: SparkSession, text: str) -> DataFrame:
    """Translated SQL as a DataFrame, in which casts to whole numbers round as the dialect does.

    A cast's rounding depends on its argument's type, which only the analysed plan knows: such casts are found there,
    with their places in the text, and the text is planned again with the rounding in it.
    """
    df = spark.sql(text)
    places = to_round(spark, df, text)
    for start, stop, function in sorted(places, reverse=True):
        part = text[start : stop + 1]
        begin, end = part.index("((") + 1, part.rindex(") AS ")
        text = f"{text[:start]}{part[:begin]}{function}{part[begin : end + 1]}{part[end + 1 :]}{text[stop + 1 :]}"
    return spark.sql(text) if places else df


def to_round(spark: SparkSession, df: DataFrame, text: str) -> set[tuple[int, int, str]]:
    """(first, last, function) of the casts of text in which fractions become whole numbers.

    Doubles are rounded half to even, decimals half away from zero.
    """
    if not any(f") AS {kind})" in text for kind in WHOLE):
        return set()
    found = set()

    def expression(e) -> None:
        if e.getClass().getSimpleName() == "Cast" and e.dataType().sql() in WHOLE:
            kind, origin = e.child().dataType().typeName(), e.origin()
            function = "rint" if kind in ("double", "float") else "round" if kind.startswith("decimal") else ""
            if function and origin.startIndex().isDefined():
                start, stop = origin.startIndex().get(), origin.stopIndex().get()
                if text[start : start + 6].lower() == "cast((" and text[: stop + 1].endswith(tuple(f") AS {w})" for w in WHOLE)):
                    found.add((start, stop, function))
        for c in listed(e.children()):
            expression(c)
        if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            plan(e.plan())

    def plan(p) -> None:
        for e in listed(p.expressions()):
            expression(e)
        for c in [*listed(p.children()), *(listed(p.innerChildren()) if p.getClass().getSimpleName() == "WithCTE" else [])]:
            plan(c)

    plan(df._jdf.queryExecution().analyzed())
    return found


def run(spark: SparkSession, sql: str) -> DataFrame:
    """Checked, translated, and as clients get it."""
    from tidelake.plans.safety import validate

    text = translate(sql)
    validate(spark, text)
    return egress(query(spark, text))


# ---------------------------------------------------------------- results


def json_rows(df: DataFrame, every: int = 1000) -> Iterator[str]:
    """A JSON document {columns, data, row_count} in pieces, as rows come; tasks write the pieces and squeeze them for
    the way, and the driver holds one partition at a time."""
    import zlib

    def pieces(rows):
        while some := [json.dumps(list(row), default=plain) for row in itertools.islice(rows, every)]:
            yield len(some), zlib.compress(",".join(some).encode(), 1)

    yield json.dumps({"columns": df.columns})[:-1] + ', "data": ['
    n = 0
    for rows, piece in df.rdd.mapPartitions(pieces).toLocalIterator(prefetchPartitions=True):
        yield ("," if n else "") + zlib.decompress(piece).decode()
        n += rows
    yield f'], "row_count": {n}}}'


def json_read(body) -> Iterator[list]:
    """The rows of a document of json_rows(), from an open file of its bytes, as they come; a ValueError where it is none.

    Memory holds a piece of the document and its row at a time.
    """
    decoder, text = json.JSONDecoder(), codecs.getreader("utf-8")(body)
    held, at = "", 0

    def more() -> None:
        nonlocal held, at
        new = text.read(max(1 << 20, len(held) - at))  # twice as much for a row that is longer than a piece
        if not new:
            raise ValueError("the document is cut off")
        held, at = held[at:] + new, 0

    def expect(word: str) -> None:
        nonlocal at
        while len(held) - at < len(word):
            more()
        if not held.startswith(word, at):
            raise ValueError(f"no {word!r} in the document")
        at += len(word)

    def value():
        nonlocal at
        while True:
            try:
                out, at = decoder.raw_decode(held, at)
                return out
            except json.JSONDecodeError:
                more()

    expect('{"columns": ')
    columns, n = value(), 0
    expect(', "data": [')
    while True:
        if len(held) - at < 2:
            more()
        if held[at] == "]":
            break
        if n:
            expect(",")
        row = value()
        if not isinstance(row, list) or len(row) != len(columns):
            raise ValueError("a row has not the document's columns")
        n += 1
        yield row
    expect('], "row_count": ' + f"{n}}}")
    if held[at:] or text.read(1):
        raise ValueError("bytes are left over")


def landed(spark: SparkSession, tables: Iterator, schema) -> DataFrame:
    """Arrow tables or batches, as a client gets them, as a table in the scratch folder; the driver holds one file's rows."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    path, kinds, held = paths.scratch(spark, "landed"), to_arrow_schema(schema), []

    def put(n: int) -> None:
        sink = pa.BufferOutputStream()
        pq.write_table(pa.concat_tables([t.cast(kinds) for t in held]) if held else kinds.empty_table(), sink, compression="zstd")
        paths.write_bytes(spark, f"{path}/part-{n:09d}.parquet", sink.getvalue().to_pybytes())
        held.clear()

    files = 0
    for t in tables:
        held.append(t if isinstance(t, pa.Table) else pa.Table.from_batches([t]))
        if sum(h.num_rows for h in held) >= 100_000 or sum(h.nbytes for h in held) >= 16 << 20:
            put(files)
            files += 1
    if held or not files:
        put(files)
    return spark.read.schema(schema).parquet(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, each as often; counted where the rows are."""
    both = a.withColumn("_n", F.lit(1)).unionAll(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").isEmpty()


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat() + ("Z" if hasattr(v, "hour") and v.tzinfo is None else "")
    return v.asDict(True) if hasattr(v, "asDict") else str(v)


def arrow_batches(df: DataFrame) -> Iterator:
    """The result's Arrow batches, partition by partition, as they come; the driver holds one partition at a time."""
    import pyarrow as pa

    schema = df.limit(0).toArrow().schema

    def packed(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"part": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    yield schema
    for row in df.mapInArrow(packed, "part binary").toLocalIterator(prefetchPartitions=True):
        for batch in pa.ipc.open_stream(bytes(row["part"])):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)


#: Distinct values of a column of text up to which it is sent as codes of a dictionary.
DICTIONARY = 4096


def arrow_pieces(df: DataFrame, compression: str | None = None, dictionary: bool = False) -> Iterator[bytes]:
    """The result as an Arrow IPC stream in pieces, one or more a partition.

    dictionary: columns of text are sent as codes; a piece brings the values that are new. A column whose values are
    more than DICTIONARY after the first batch is sent plainly, so memory stays bounded.
    """
    import pyarrow as pa

    batches = arrow_batches(df)
    schema, sink = next(batches), _Pieces()
    first = next(batches, None)
    codes = []
    if dictionary:
        codes = [i for i, f in enumerate(schema) if pa.types.is_string(f.type) and (first is None or len(first.column(i).unique()) <= DICTIONARY)]
    kind = pa.dictionary(pa.int32(), pa.string())
    sent = pa.schema([pa.field(f.name, kind) if i in codes else f for i, f in enumerate(schema)])
    options = pa.ipc.IpcWriteOptions(compression=compression, emit_dictionary_deltas=False)
    writer = pa.ipc.new_stream(pa.PythonFile(sink, "w"), sent, options=options)
    while first is not None:
        columns = [c.dictionary_encode().cast(kind) if i in codes else c for i, c in enumerate(first.columns)]
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=sent))
        yield sink.taken()
        first = next(batches, None)
    writer.close()
    yield sink.taken()


class _Pieces:
    """A file to write to, from which what was written is taken."""

    closed = False

    def __init__(self) -> None:
        self.held: list[bytes] = []

    def write(self, data) -> int:
        self.held.append(bytes(data))
        return len(data)

    def flush(self) -> None:
        pass

    def close(self) -> None:
        self.closed = True

    def taken(self) -> bytes:
        out, self.held = b"".join(self.held), []
        return out


def arrow_stream(df: DataFrame, compression: str | None = None, dictionary: bool = False) -> bytes:
    """arrow_pieces() as one value, for results that are small."""
    return b"".join(arrow_pieces(df, compression, dictionary))


def msgpack_pieces(df: DataFrame) -> Iterator[bytes]:
    """The result in MessagePack: for each of Arrow's batches a map of columns, types, data by columns and row_count."""
    from tidelake.sources.records import pack

    batches = arrow_batches(df)
    schema = next(batches)
    for batch in batches:
        data = [[v if isinstance(v, str | int | float | bool | bytes | type(None)) else str(plain(v)) for v in c.to_pylist()] for c in batch.columns]
        yield pack({"columns": schema.names, "types": [str(t) for t in schema.types], "data": data, "row_count": batch.num_rows})


def msgpack_columns(df: DataFrame) -> bytes:
    """The result as one MessagePack document, for results that are small: columns, types beside them, data, row_count."""
    from tidelake.sources.records import pack, unpack

    schema = next(arrow_batches(df))
    out = {"columns": schema.names, "types": [str(t) for t in schema.types], "data": [[] for _ in schema], "row_count": 0}
    for piece in map(unpack, msgpack_pieces(df)):
        out["row_count"] += piece["row_count"]
        for column, values in zip(out["data"], piece["data"]):
            column += values
    return pack(out)


def compressed(pieces: Iterator[bytes | str], encoding: str) -> Iterator[bytes]:
    """A response's pieces, compressed as one body of `encoding` (gzip or zstd) as they come."""
    import zlib

    import zstandard

    if encoding not in ("gzip", "zstd"):
        raise ValueError(f"no encoding {encoding!r}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31) if encoding == "gzip" else zstandard.ZstdCompressor(level=3).compressobj()
    for piece in pieces:
        if out := z.compress(piece.encode() if isinstance(piece, str) else piece):
            yield out
    yield z.flush()
