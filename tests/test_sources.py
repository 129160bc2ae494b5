"""Decoders and imports on hand-made payloads."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelake.sources import imports, line_protocol, records, tle
from tidelake.sources.points import to_table

ISS = """ISS (ZARYA)
1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927
2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537
"""


def test_lines():
    m, t, tags, ints, floats, strings, bools = line_protocol.parse_line(r'cpu\ x,host=a\,b,ho\=st=c\ d u=0.5,n=42i,big=18446744073709551615u,s="say \"hi\", ok",b=T 1609459200000000000')
    assert (m, t, tags) == ("cpu x", 1609459200000000, {"host": "a,b", "ho=st": "c d"})
    assert ints == {"n": 42} and floats == {"u": 0.5, "big": 1.8446744073709552e19} and strings == {"s": 'say "hi", ok'} and bools == {"b": True}
    assert line_protocol.parse_line("m,a=1 a=2")[4] == {"a_value": 2.0}
    assert line_protocol.parse_line("m v=1i 5", "s")[1] == 5_000_000 and line_protocol.parse_line("m v=1 soon")[1] is None
    assert line_protocol.parse_line("m v=1 -1500")[1] == -1
    for bad in ("", "# note", "m", "m ", ",a=b v=1", "m v", "m v=1.5i"):
        assert line_protocol.parse_line(bad) is None
    assert line_protocol.parse_line("m v=abc")[5] == {"v": "abc"}


@given(st.text('a,= "\\\\é', max_size=12), st.sampled_from(",= "), st.booleans())
@settings(max_examples=500, deadline=None)
def test_cut_is_the_pattern(text, stop, quotes):
    end = line_protocol.upto(stop, quotes).match(text).end()
    assert line_protocol.cut(text, stop, quotes) == (text[:end], text[end : end + 1], text[end + 1 :])


def test_line_table(spark):
    df = spark.createDataFrame([("cpu,host=a u=1,n=1i 1\ncpu,host=b u=2i,host=\"x\" 1000\nbad\nmem f=1",)], "value string")
    table, tags = to_table(line_protocol.line_protocol(df), "cpu", now="2024-01-01")
    assert tags == ["host"] and sorted(map(tuple, table.collect())) == [(datetime(1970, 1, 1), "a", None, 1, 1.0), (datetime(1970, 1, 1, 0, 0, 0, 1), "b", "x", None, 2.0)]
    with pytest.raises(ValueError):
        line_protocol.line_protocol(df, precision="h")


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False) | st.text(max_size=20) | st.binary(max_size=20), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=5), c, max_size=4), max_leaves=15)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_msgpack_round_trip(v):
    assert records.unpack(records.pack(v)) == v


def test_msgpack_small_forms():
    assert records.unpack(b"\x83\xa1m\xa3cpu\xa1t\xcb?\xf0\x00\x00\x00\x00\x00\x00\xa1l\x92\xc3\xe0") == {"m": "cpu", "t": 1.0, "l": [True, -32]}
    for bad in (b"", b"\xc1", b"\xa5ab", b"\x01\x02", b"\x92\x01"):
        with pytest.raises(ValueError):
            records.unpack(bad)


def test_records(spark):
    row = {"m": "cpu", "t": 1609459200000, "h": "server01", "fields": {"usage": 90.5, "count": 42, "host": 1}, "tags": {"region": "us"}}
    columnar = {"m": "cpu", "columns": {"time": [1609459200, 1609459201], "usage": [1.0, None], "host": ["a", "b"]}, "tags": ["host"]}
    compact = {"m": 7, "t": 5, "h": 3, "f": [1, True]}
    payloads = [records.pack(row), records.pack({"batch": [columnar, compact]}), b"\xc1", b'{"m": "cpu", "t": 1, "f": [2]}']
    pts = records.records(spark.createDataFrame([(bytearray(p),) for p in payloads], "value binary"))
    got = sorted((r["measurement"], r["time"], tuple(sorted(r["tags"].items())), tuple(sorted(r["ints"].items())), tuple(sorted(r["floats"].items()))) for r in pts.collect())
    assert got[0] == ("cpu", 1_000_000, (("host", "unknown"),), (("field_0", 2),), ())
    assert ("cpu", 1609459200000000, (("host", "server01"), ("region", "us")), (("count", 42), ("host_value", 1)), (("usage", 90.5),)) in got
    assert ("cpu", 1609459201000000, (("host", "b"),), (), ()) in got and got[-1][0] == "measurement_7" and got[-1][2] == (("host", "host_3"),)


def test_messages():
    flat = records.message_points({"dn": "dev", "timestamp": 1700000000123, "properties": {"t1": 1.5}, "on": True})
    assert flat[0][:3] == ("mqtt", 1700000000123000, {"dn": "dev"}) and flat[0][4] == {"t1": 1.5} and flat[0][6] == {"on": True}
    assert [p[0] for p in records.message_points([{"measurement": "a", "fields": {"x": 1}}, 5, {"m": "b", "y": 2}])] == ["a", "b"]
    assert records.message_time({"t": 0, "time": 9e14}) == 900000000000000000


def test_tle(spark):
    bad = ISS.replace("2927", "2928")
    df = tle.two_line_elements(spark.createDataFrame([(ISS + "\r\n" + "\n".join(ISS.split("\n")[1:]),), (bad,)], "value string"))
    got = df.orderBy("object_name").collect()
    assert [r["object_name"] for r in got] == ["ISS (ZARYA)", "NORAD 25544"] and len(df.columns) == 20
    r = got[0]
    assert r["time"] == datetime(2008, 9, 20, 12, 25, 40, 104192) and 90 < r["period_min"] < 95 and 330 < r["perigee_km"] < 450 and r["orbit_type"] == "LEO"
    assert r["eccentricity"] == 0.0006703 and r["bstar"] == pytest.approx(-0.11606e-4) and r["mean_motion_dot"] == pytest.approx(-0.00002182) and r["revolution_number"] == 56353


def test_orbits(spark):
    from pyspark.sql import functions as F

    rows = [(408.0, 412.0, 0.0007, "LEO"), (20180.0, 20220.0, 0.001, "MEO"), (35780.0, 35790.0, 0.0001, "GEO"), (500.0, 39800.0, 0.74, "HEO"), (-50.0, 200.0, 0.01, "SUB")]
    df = spark.createDataFrame(rows, "p double, a double, e double, want string")
    assert df.filter(tle.orbit_type(F.col("p"), F.col("a"), F.col("e")) != F.col("want")).count() == 0


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿when,i,f,b,m,e,none\n1609459200,1,1.5,true,1,,\n1609459201,2,2,FALSE,x,3,\n")
    df = imports.import_csv(spark, str(tmp_path / "a.csv"), "when")
    assert dict(df.dtypes) == {"time": "timestamp_ntz", "i": "bigint", "f": "double", "b": "boolean", "m": "string", "e": "bigint", "none": "string"}
    assert tuple(df.orderBy("time").first()) == (datetime(2021, 1, 1), 1, 1.5, True, "1", None, "")
    (tmp_path / "b.csv").write_text("note\nnote 2\nt;v\n5;1\n6;2\n")
    assert [r["v"] for r in imports.import_csv(spark, str(tmp_path / "b.csv"), "t", "epoch_s", ";", 2).orderBy("time").collect()] == [1, 2]
    for header in (["a", "a", "t"], ["", "t"], ["x"], ["t", "time"]):
        with pytest.raises(ValueError):
            imports.check_header(header, "t")


def test_times(spark):
    from pyspark.sql import functions as F

    cases = {"1609459200": datetime(2021, 1, 1), "1609459200000": datetime(2021, 1, 1), "1609459200000000": datetime(2021, 1, 1), "1609459200000000000": datetime(2021, 1, 1), "1609459200.5": datetime(2021, 1, 1, 0, 0, 0, 500000), "-5": datetime(1969, 12, 31, 23, 59, 55), "2021-01-01T02:00:00+02:00": datetime(2021, 1, 1), "2021-01-01T00:00:00Z": datetime(2021, 1, 1), "2021-01-01 00:00:00.25": datetime(2021, 1, 1, 0, 0, 0, 250000), "2021-01-01": datetime(2021, 1, 1), "NaN": None, "inf": None, "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", imports.parse_time(F.col("s")).alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == cases


def test_parquet_import(spark, tmp_path):
    p = str(tmp_path / "p")
    spark.sql("select 1609459200000 t, cast(1 as smallint) a, cast(1.5 as decimal(9,2)) d, timestamp_ntz'1970-01-01 00:00:01' ts, binary('x') b").write.parquet(p)
    assert tuple(imports.import_parquet(spark, p, "t").first()) == (datetime(2021, 1, 1), 1, 1.5, 1_000_000, "x")
    spark.sql("select 1 t, array(1) a").write.mode("overwrite").parquet(p)
    with pytest.raises(ValueError):
        imports.import_parquet(spark, p, "t")


def test_compressed_bodies():
    import gzip

    import zstandard

    data = b'[{"m":"a","t":1,"fields":{"v":1}}]' * 3
    z = zstandard.ZstdCompressor().compress
    for body in (data, gzip.compress(data), z(data), gzip.compress(data[:10]) + gzip.compress(data[10:]), z(data[:9]) + z(data[9:])):
        assert records.plain_body(body) == data
    for bad in (gzip.compress(data)[:-9], b"\x1f\x8bnonsense", z(b"x" * 5000), gzip.compress(b"x" * 5000)):
        with pytest.raises(ValueError):
            records.plain_body(bad, 4000)


def test_live_agents(spark):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from tidelake.sources.live import live_rows

    class Agent(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/late":
                time.sleep(2)
            body = records.pack({"batch": [{"m": "cpu", "t": 1700000000, "h": self.path, "fields": {"v": 1.5}}]}) if self.path == "/a" else b'[{"m":"cpu","t":1700000000,"h":"b","fields":{"v":2}},{"m":"mem","fields":{"x":1}}]' if self.path == "/b" else b"no records"
            self.send_response(500 if self.path == "/broken" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Agent)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        got = live_rows(spark, [f"{base}/a", f"{base}/b", f"{base}/late", f"{base}/broken", f"{base}/nonsense", "http://127.0.0.1:9/gone"], "cpu", timeout=1).collect()
    finally:
        server.shutdown()
    assert sorted((r["host"], r["v"]) for r in got) == [("/a", 1.5), ("b", 2.0)]


def test_agent_parquet_body(spark, tmp_path):
    import io

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidelake.catalog import Lake

    sink = io.BytesIO()
    pq.write_table(pa.table({"time": [1700000000, 1700000001, None], "v": pa.array([1, 2, 3], pa.int16()), "host": ["a", "b", "c"]}), sink)
    lake = Lake(spark, str(tmp_path))
    assert imports.ingest_parquet(lake, sink.getvalue(), "db", "cpu", ["host"]) == 2
    assert sorted((r["time"].year, r["v"], r["host"]) for r in lake.read("db", "cpu").collect()) == [(2023, 1, "a"), (2023, 2, "b")]


def test_csv_preambles_of_each_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"note\nother, note\n\ufefftime;a b;s\n2024-01-0{i + 1};{i};\"x;y\"\n\n2024-01-0{i + 1} 05:00:00;7;z\n" if not i else f"note\nother, note\ntime;a b;s\n2024-01-0{i + 1};{i};\"x;y\"\n")
    got = imports.import_csv(spark, str(tmp_path), delimiter=";", skip_rows=2)
    assert got.columns == ["time", "a b", "s"] and sorted((r["time"].day, r["a b"], r["s"]) for r in got.collect()) == [(1, 0, "x;y"), (1, 7, "z"), (2, 1, "x;y"), (3, 2, "x;y")]
