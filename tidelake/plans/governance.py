"""Metadata, permissions and checks of SQL as queries."""

from __future__ import annotations

import io

from pyspark.sql import functions as F

from tidelake.operators import browse
from tidelake.plans import safety
from tidelake.plans.registry import query, sql
from tidelake.plans.storage import events, lake_of

sql("f7_arithmetic", "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS half, l_quantity * l_extendedprice AS amount, l_quantity - l_linenumber AS less, l_quantity + l_tax AS more FROM lineitem")


@query("SELECT * FROM (VALUES ('time', 'time', 'timestamp_ntz'), ('event_type', 'tag', 'string'), ('host', 'tag', 'string'), ('value', 'field', 'double'), ('event_id', 'field', 'bigint')) t(name, kind, type)")
def i3_schema(load, spark):
    lake = lake_of(spark, "i3")
    lake.write(events(load), "main", "events", ["event_type", "host"])
    return spark.createDataFrame([(c["name"], c["kind"], c["type"]) for c in lake.schema("main", "events")], "name string, kind string, type string")


@query("SELECT 'ops' AS database UNION ALL SELECT 'main'")
def i1_databases(load, spark):
    lake = lake_of(spark, "i1")
    for db in ("main", "ops"):
        lake.write(events(load), db, "events", ["event_type", "host"])
    return spark.createDataFrame([(d,) for d in lake.databases()], "database string")


@query("SELECT name, n, CASE WHEN n > 1000000 THEN 'high' WHEN n > 100000 THEN 'medium' WHEN n > 10000 THEN 'low' ELSE 'none' END AS level FROM (SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem)")
def i5_estimate(load, spark):
    found = [(name, browse.estimate(load(name), exact=True)) for name in ("events", "lineitem")]
    return spark.createDataFrame([(name, e["rows"], e["level"]) for name, e in found], "name string, n long, level string")


STATEMENTS = {
    "SELECT load, copy FROM cpu": True,
    "WITH t AS (SELECT 1 AS x) SELECT x FROM t;": True,
    "SELECT 1; SELECT 2": False,
    "DROP TABLE cpu": False,
    "INSERT INTO cpu VALUES (1)": False,
    "SET a = b": False,
    "SELECT * FROM parquet.`/etc/x`": False,
    "SELECT reflect(a, b) FROM cpu": False,
    "SELECT `reflect`(a, b) FROM cpu": False,
    "SELECT 1 AS `''`, reflect(a, b) FROM cpu": False,
    "SELECT system.builtin.java_method(a, b) FROM cpu": False,
    "SELECT my_own_function(a) FROM cpu": False,
    "SELECT TRANSFORM(a) USING ''cat'' AS (b) FROM cpu": False,
    "SELECT * FROM IDENTIFIER(''prod.secret'')": False,
    "SELECT a FROM cpu WHERE b IN (SELECT input_file_name() FROM cpu)": False,
    "SELECT * FROM python_worker_logs()": False,
    "SELECT a, count(*) OVER (PARTITION BY b) FROM cpu, LATERAL explode(array(1)) AS e(x)": True,
    "SELECT x.y FROM (SELECT max(a) AS y FROM cpu GROUP BY ROLLUP (b) HAVING count(*) > 1) x ORDER BY 1 LIMIT 3": True,
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', {ok})" for s, ok in STATEMENTS.items()) + ") t(statement, allowed)")
def y1_statements(load, spark):
    def allowed(text: str) -> bool:
        try:
            safety.validate(spark, text)
        except safety.Refused:
            return False
        return True

    return spark.createDataFrame([(s, allowed(s)) for s in (t.replace("''", "'") for t in STATEMENTS)], "statement string, allowed boolean")


#: Queries and the tables that they read and that the grants do not cover; a CTE's name holds only where SQL lets it.
HIDDEN = {
    "WITH t AS (SELECT * FROM prod.p_cpu) SELECT * FROM t JOIN mem_s m ON m.x IN (SELECT y FROM ops.disk) WHERE EXISTS (SELECT 1 FROM log)": "default.log ops.disk",
    "WITH log AS (SELECT * FROM log) SELECT * FROM log": "default.log",
    "SELECT * FROM secret WHERE EXISTS (WITH secret AS (SELECT 1 AS x) SELECT x FROM secret)": "default.secret",
    "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM a) SELECT * FROM b": "default.b",
    "WITH RECURSIVE r AS (SELECT 1 AS x UNION ALL SELECT x + 1 FROM r WHERE x < 3) SELECT * FROM r": "",
    "SELECT (SELECT max(v) FROM ops.disk d WHERE d.h = m.h), sum(CASE WHEN m.x IN (SELECT x FROM ops.net) THEN 1 END) FROM mem_s m GROUP BY 1": "ops.disk ops.net",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in HIDDEN.items()) + ") t(statement, hidden)")
def y2_permissions(load, spark):
    grants = [("prod", "p_*"), ("def*", "*_s")]
    found = [(text, " ".join(".".join(t) for t in safety.allowed(grants, safety.tables(spark, text)))) for text in HIDDEN]
    return spark.createDataFrame(found, "statement string, hidden string")


#: Texts and what a log keeps of them.
LOGGED = {
    "SELECT a1 FROM t WHERE x = 'it''s' AND y > 12.5": "SELECT a1 FROM t WHERE x = '?' AND y > ?",
    'SELECT "secret" FROM t WHERE k = X\'0FF1\' AND z < 1e5 AND w = 0xCAFE': "SELECT \"?\" FROM t WHERE k = X'?' AND z < ? AND w = ?",
    "SELECT `it's` FROM t -- 'a comment'": "SELECT `it's` FROM t  ",
    "SELECT 1 /* 'x' */ + .5 FROM t2 WHERE a = 'open": "SELECT ?   + ? FROM t2 WHERE a = '?'",
    "SELECT 'a\\' AND b = 'secret' FROM t": "SELECT '?'",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{logged.replace(chr(39), chr(39) * 2)}')" for i, logged in enumerate(LOGGED.values())) + ") t(i, logged)")
def y5_masked_literals(load, spark):
    return spark.createDataFrame([(i, safety.masked(text)) for i, text in enumerate(LOGGED)], "i int, logged string")


@query("SELECT user_id, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY user_id")
def k7_arrow_round_trip(load, spark):
    """A result sent as an Arrow stream and as MessagePack columns, and read back: both must agree."""
    import pyarrow as pa

    from tidelake.plans.dialect import arrow_stream, msgpack_columns
    from tidelake.sources.records import unpack

    out = load("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    table = pa.ipc.open_stream(arrow_stream(out, "zstd")).read_all()
    packed = unpack(msgpack_columns(out.orderBy("user_id")))
    if packed["data"] != [c.to_pylist() for c in table.sort_by("user_id").columns]:
        raise AssertionError("the two forms of one result differ")
    return spark.createDataFrame(table)


@query("SELECT user_id, count(*) AS n, max(value) AS most FROM events GROUP BY user_id")
def k6_json_round_trip(load, spark):
    """A result sent as a JSON document, piece by piece, and read back."""
    import json

    from tidelake.plans.dialect import json_rows

    out = load("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))
    document = json.loads("".join(json_rows(out, every=100)))
    if document["row_count"] != len(document["data"]) or document["columns"] != out.columns:
        raise AssertionError("the document contradicts itself")
    return spark.createDataFrame([tuple(r) for r in document["data"]], out.schema)


@query("SELECT event_type, event_id, value FROM events")
def k10_compressed_responses(load, spark):
    """Results as JSON and as Arrow with dictionaries, in pieces and compressed as one body each, and read back.

    Bodies are sent to files and read from them piece by piece, so the driver never holds a result.
    """
    import gzip
    import itertools

    import pyarrow as pa
    import zstandard

    from tidelake import paths
    from tidelake.plans.dialect import arrow_pieces, compressed, json_read, json_rows, landed, same_rows

    df = load("events").select("event_type", "event_id", "value")
    document, body = paths.scratch(spark, "document"), paths.scratch(spark, "body")
    paths.write_pieces(spark, document, compressed(json_rows(df), "gzip"))
    paths.write_pieces(spark, body, compressed(arrow_pieces(df, dictionary=True), "zstd"))
    with paths.Reading(spark, document) as raw, gzip.open(io.BufferedReader(raw, 1 << 20)) as plain:
        rows = json_read(plain)
        batches = iter(lambda: list(itertools.islice(rows, 10_000)), [])
        read = landed(spark, (pa.table([pa.array(c) for c in zip(*b)], df.columns) for b in batches), df.schema)
    with paths.Reading(spark, body) as raw, zstandard.ZstdDecompressor().stream_reader(io.BufferedReader(raw, 1 << 20)) as plain:
        stream = pa.ipc.open_stream(plain)
        other = landed(spark, stream, df.schema)
        coded = pa.types.is_dictionary(stream.schema.field("event_type").type)
    if not coded or not same_rows(read, other):
        raise AssertionError("the two forms of one result differ")
    return read


@query("SELECT 'slow' AS kind, count(*) AS n FROM events UNION ALL SELECT 'all', 2")
def i8_slow_queries(load, spark):
    """Of two queries one is slower than the limit, which lies between them."""
    import time

    from tidelake.operators.registry import QueryRegistry

    registry, df = QueryRegistry(spark, slow_seconds=3.0), load("events")
    registry.run("SELECT 1", lambda: 1)
    n = registry.run("SELECT count(*) FROM events", lambda: (time.sleep(3), df.count())[1])
    slow = registry.slow()
    return spark.createDataFrame([("slow", n if [r.text for r in slow] == ["SELECT count(*) FROM events"] else -1), ("all", len(registry.done))], "kind string, n long")


SECONDS = [0, 10, 20, 30, 61, 65, 75, 100, 3599, 3605]


@query(f"SELECT second, second NOT IN (30, 65, 3599) AS admitted FROM (SELECT unnest({SECONDS}) AS second)")
def y3_limits(load, spark):
    """Three requests a minute refuse those at 30 and 65; six an hour refuse that at 3599, until the first is an hour old."""
    governor = safety.Governor(per_minute=3, per_hour=6)
    seconds = SECONDS
    return spark.createDataFrame([(s, governor.admit(float(s))) for s in seconds], "second int, admitted boolean")


@query("SELECT 'SELECT count(*) FROM events WHERE event_type = ''?'' AND event_id > ?' AS text, 'done' AS state, count(*) AS n FROM events WHERE event_type = 'view' AND event_id > 10 UNION ALL SELECT 'SELECT missing FROM events', 'failed', NULL")
def i7_query_history(load, spark):
    """Two queries run through the registry: one ends, one fails; their texts are kept without literals."""
    from tidelake.operators.registry import QueryRegistry

    registry, found = QueryRegistry(spark), {}
    load("events").createOrReplaceTempView("events")
    for text in ("SELECT count(*) FROM events WHERE event_type = 'view' AND event_id > 10", "SELECT missing FROM events"):
        try:
            n = registry.run(text, lambda text=text: spark.sql(text).first()[0])
        except Exception:  # noqa: BLE001  (the registry keeps what failed)
            n = None
        found[registry.done[-1].id] = n
    return spark.createDataFrame([(r.text, r.state, found[r.id]) for r in registry.done], "text string, state string, n long")
