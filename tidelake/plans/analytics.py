"""Scalar functions, time buckets, and the shapes of the benchmark suites over our tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelake.functions import concat_skip_null, date_diff, decimal_to_int, double_to_int, dow, epoch, nulls_last, regexp_replace_first, strlen, time_bucket, url_domain
from tidelake.plans.registry import query, sql

# ---------------------------------------------------------------- strings and casts


@query("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '-') AS first, regexp_replace(p_name, '[aeiou]', '-', 'g') AS every, regexp_extract(p_type, '([A-Z]+) ', 1) AS word FROM part")
def f1_regexp(load, spark):
    return load("part").select("p_partkey", regexp_replace_first(F.col("p_name"), "[aeiou]", "-").alias("first"), F.regexp_replace("p_name", "[aeiou]", "-").alias("every"), F.regexp_extract("p_type", "([A-Z]+) ", 1).alias("word"))


@query("SELECT page_id, nullif(regexp_extract(url, '^https?://(?:www\\.)?([^/]+)', 1), '') AS domain FROM pages")
def f2_url_domain(load, spark):
    return load("pages").select("page_id", url_domain(F.col("url")).alias("domain"))


sql("f3_split_part", "SELECT page_id, split_part(url, '/', 3) AS host, substr(url, 1, 5) AS scheme FROM pages")


@query("SELECT doc_id, strlen(text) AS bytes, length(text) AS chars FROM documents")
def f4_strlen(load, spark):
    return load("documents").select("doc_id", strlen(F.col("text")).cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"))


@query("SELECT c_custkey, concat(c_name, nullif(c_mktsegment, 'BUILDING'), '!') AS s, c_name || '/' || nullif(c_mktsegment, 'BUILDING') AS t, lower(c_mktsegment) AS l FROM customer")
def f5_concat(load, spark):
    part = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return load("customer").select("c_custkey", concat_skip_null(F.col("c_name"), part, F.lit("!")).alias("s"), F.concat("c_name", F.lit("/"), part).alias("t"), F.lower("c_mktsegment").alias("l"))


sql("f6_integer_division", "SELECT l_orderkey, l_linenumber, (l_orderkey - 100) div 7 AS q, (l_orderkey - 100) % 7 AS r, l_linenumber / 2 AS h FROM lineitem", "SELECT l_orderkey, l_linenumber, (l_orderkey - 100) // 7 AS q, (l_orderkey - 100) % 7 AS r, l_linenumber / 2 AS h FROM lineitem")


@query("SELECT c_custkey, CAST(c_acctbal AS INTEGER) AS d, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS INTEGER) AS m, TRY_CAST(c_name AS INTEGER) AS bad, c_custkey::VARCHAR AS s FROM customer")
def f8_casts(load, spark):
    b = F.col("c_acctbal")
    return load("customer").select("c_custkey", double_to_int(b).alias("d"), decimal_to_int(b.cast("decimal(18,2)")).alias("m"), F.col("c_name").try_cast("int").alias("bad"), F.col("c_custkey").cast("string").alias("s"))


sql("f9_coalesce", "SELECT c.c_custkey, coalesce(o.n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
sql("f10_keyword_from", "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, substring(o_orderpriority FROM 1 FOR 3) AS p, trim(BOTH '1' FROM o_orderpriority) AS t FROM orders", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, substring(o_orderpriority FROM 1 FOR 3) AS p, trim(o_orderpriority, '1') AS t FROM orders")
sql("f11_json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
sql("f12_arrays", "SELECT vec_id, size(embedding) AS n, round(aggregate(embedding, 0D, (a, x) -> a + x), 4) AS s, round(array_max(embedding), 6) AS m, size(filter(embedding, x -> x > 0)) AS pos FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s, round(list_max(embedding), 6) AS m, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS pos FROM embeddings")
sql("f12_maps", "SELECT n_nationkey, m['name'] AS name, size(map_keys(m)) AS n FROM (SELECT n_nationkey, map('name', n_name, 'key', cast(n_regionkey AS string)) AS m FROM nation)", "SELECT n_nationkey, m['name'] AS name, CAST(len(map_keys(m)) AS INT) AS n FROM (SELECT n_nationkey, MAP {'name': n_name, 'key': n_regionkey::VARCHAR} AS m FROM nation)")

# ---------------------------------------------------------------- time


def _buckets(name: str, width: str) -> None:
    def f(load, spark):
        return load("events").groupBy(time_bucket(width, "ts").alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

    f.__name__ = name
    query(f"SELECT time_bucket(INTERVAL '{width}', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(f)


for _name, _width in (("t1_bucket_1h", "1 hour"), ("t1_bucket_5h", "5 hours"), ("t1_bucket_7min", "7 minutes"), ("t1_bucket_13s", "13 seconds"), ("t1_bucket_2d", "2 days"), ("t1_bucket_1w", "1 week"), ("t2_bucket_month", "1 month"), ("t2_bucket_quarter", "1 quarter")):
    _buckets(_name, _width)


@query("SELECT o_orderkey, time_bucket(INTERVAL '5 months', o_orderdate) AS b, time_bucket(INTERVAL '9 days', o_orderdate - INTERVAL 12000 DAY) AS early FROM orders")
def t2_buckets_before_origin(load, spark):
    d = F.col("o_orderdate")
    return load("orders").select("o_orderkey", time_bucket("5 months", d).alias("b"), time_bucket("9 days", d - F.expr("INTERVAL '12000' DAY")).alias("early"))


@query("SELECT event_id, time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '2024-01-01 01:30:00') AS b FROM events")
def t3_bucket_origin(load, spark):
    return load("events").select("event_id", time_bucket("3 hours", "ts", "2024-01-01 01:30:00").alias("b"))


@query("SELECT date_trunc('week', ts) AS w, date_trunc('minute', ts) AS m, event_id FROM events")
def t4_date_trunc(load, spark):
    return load("events").select(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("w"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("m"), "event_id")


@query("SELECT event_id, CAST(extract(dow FROM ts) AS INT) AS d, CAST(extract(isodow FROM ts) AS INT) AS i, CAST(extract(hour FROM ts) AS INT) AS h, CAST(extract(month FROM ts) AS INT) AS mo, epoch(ts) AS e FROM events")
def t7_extract(load, spark):
    ts = F.col("ts")
    return load("events").select("event_id", dow(ts).alias("d"), (F.weekday(ts) + 1).alias("i"), F.hour(ts).alias("h"), F.month(ts).alias("mo"), epoch(ts).alias("e"))


@query("SELECT event_id, epoch_us(ts) AS us, make_timestamp(epoch_us(ts) + 1500000) AS later FROM events")
def t8_epochs(load, spark):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    return load("events").select("event_id", us.alias("us"), F.timestamp_add("MICROSECOND", us + 1_500_000, F.lit("1970-01-01").cast("timestamp_ntz")).alias("later"))


@query("SELECT a.event_id, date_diff('hour', a.ts, b.ts) AS h, date_diff('day', a.ts, b.ts) AS d, date_diff('month', a.ts, b.ts) AS m FROM events a JOIN events b ON b.event_id = a.event_id + 7")
def t9_date_diff(load, spark):
    e = load("events").select("event_id", "ts")
    later = e.select((F.col("event_id") - 7).alias("event_id"), F.col("ts").alias("ts2"))
    j = e.join(later, "event_id")
    return j.select("event_id", *(date_diff(u, F.col("ts"), F.col("ts2")).alias(u[0]) for u in ("hour", "day", "month")))


# ---------------------------------------------------------------- shapes of the wide-table benchmark
sql("cb01_02_counts", "SELECT count(*) AS n, count(CASE WHEN l_discount <> 0 THEN 1 END) AS m FROM lineitem")
sql("cb03_04_sums", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n, round(avg(l_partkey), 4) AS a FROM lineitem")
sql("cb05_06_distinct", "SELECT count(DISTINCT l_suppkey) AS i, count(DISTINCT l_returnflag) AS s FROM lineitem")
sql("cb07_min_max", "SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders")
sql("cb08_filter_group_order", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority")
sql("cb09_10_distinct_groups", "SELECT l_suppkey, count(DISTINCT l_partkey) AS u, CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS c, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY l_suppkey ORDER BY u DESC, c DESC, l_suppkey LIMIT 10")
sql("cb11_14_nonempty", "SELECT p_brand, p_type, count(DISTINCT p_size) AS u FROM part WHERE p_type <> '' GROUP BY p_brand, p_type ORDER BY u DESC, p_brand, p_type LIMIT 10")
sql("cb15_16_keys", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
sql("cb17_18_two_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
sql("cb19_expression_key", "SELECT user_id, minute(ts) AS m, event_type, count(*) AS n FROM events GROUP BY user_id, minute(ts), event_type ORDER BY n DESC, user_id, m, event_type LIMIT 10", "SELECT user_id, CAST(minute(ts) AS INT) AS m, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3 ORDER BY n DESC, user_id, m, event_type LIMIT 10")
sql("cb20_point", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
sql("cb21_23_like", "SELECT lang, min(source) AS s, count(*) AS n, count(DISTINCT doc_id) AS u FROM documents WHERE text LIKE '%the%' AND text NOT LIKE '%.example.%' GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
sql("cb24_star_like", "SELECT * FROM pages WHERE url LIKE '%example%' ORDER BY url, page_id LIMIT 10")
sql("cb25_27_top", "SELECT event_type, ts, event_id FROM events WHERE event_type <> '' ORDER BY ts, event_type, event_id LIMIT 10")
sql("cb28_avg_length", "SELECT source, round(avg(octet_length(text)), 4) AS l, count(*) AS c FROM documents WHERE text <> '' GROUP BY source HAVING count(*) > 5 ORDER BY l DESC, source LIMIT 25", "SELECT source, round(avg(strlen(text)), 4) AS l, count(*) AS c FROM documents WHERE text <> '' GROUP BY source HAVING count(*) > 5 ORDER BY l DESC, source LIMIT 25")


@query(r"SELECT regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS k, round(avg(strlen(url)), 4) AS l, count(*) AS c, min(url) AS m FROM pages WHERE url <> '' GROUP BY k HAVING count(*) > 1")
def cb29_regexp_key(load, spark):
    k = F.regexp_replace("url", r"^https?://(?:www\.)?([^/]+)/.*$", "$1")
    g = load("pages").filter("url <> ''").groupBy(k.alias("k")).agg(F.round(F.avg(strlen(F.col("url"))), 4).alias("l"), F.count(F.lit(1)).alias("c"), F.min("url").alias("m"))
    return g.filter("c > 1")


sql("cb31_33_two_keys", "SELECT l_suppkey, l_partkey, count(*) AS c, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 4) AS a FROM lineitem GROUP BY l_suppkey, l_partkey ORDER BY c DESC, l_suppkey, l_partkey LIMIT 10")
sql("cb34_35_constant_key", "SELECT 1 AS one, url, count(*) AS c FROM pages GROUP BY 1, url ORDER BY c DESC, url LIMIT 10")
sql("cb36_arithmetic_keys", "SELECT l_suppkey, l_suppkey - 1 AS a, l_suppkey - 2 AS b, l_suppkey - 3 AS d, count(*) AS c FROM lineitem GROUP BY l_suppkey, l_suppkey - 1, l_suppkey - 2, l_suppkey - 3 ORDER BY c DESC, l_suppkey LIMIT 10")
sql("cb37_39_many_filters", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1993-01-01' AND o_orderdate <= DATE '1999-12-31' AND o_orderstatus <> 'X' AND o_totalprice > 1000 AND o_orderpriority <> '' AND o_orderkey > 0 GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 20")
sql("cb40_case_keys", "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN o_orderpriority ELSE '' END AS src, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN o_orderpriority ELSE '' END, year(o_orderdate) ORDER BY n DESC, o_orderstatus, src, y LIMIT 10 OFFSET 3", "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN o_orderpriority ELSE '' END AS src, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY 1, 2, 3 ORDER BY n DESC, o_orderstatus, src, y LIMIT 10 OFFSET 3")
sql("cb41_42_in_equality", "SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem WHERE l_linenumber IN (-1, 6) AND l_returnflag = 'N' GROUP BY l_suppkey, l_shipdate ORDER BY n DESC, l_suppkey, l_shipdate LIMIT 10 OFFSET 10")


@query("SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND ts < TIMESTAMP '2024-01-16' GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 20")
def cb43_minutes(load, spark):
    e = load("events").filter("ts >= timestamp_ntz'2024-01-14' and ts < timestamp_ntz'2024-01-16'")
    return e.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("m")).agg(F.count(F.lit(1)).alias("n")).orderBy(nulls_last("m")).offset(20).limit(10)


# ---------------------------------------------------------------- shapes of the time-series suite
DAY = "ts >= timestamp_ntz'2024-01-10' AND ts < timestamp_ntz'2024-01-11'"
sql("qs_time_range_count", f"SELECT count(*) AS n FROM events WHERE {DAY}", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
sql("qs_aggregates", "SELECT round(sum(value), 3) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi FROM events")


@query("SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY 1, 2")
def qs_host_hour(load, spark):
    return load("events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("a"))


sql("qs_distinct_hosts", "SELECT DISTINCT user_id FROM events")
sql("qs_top10_average", "SELECT user_id, round(avg(value), 6) AS a FROM events GROUP BY user_id ORDER BY a DESC, user_id LIMIT 10")
sql("qs_having", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 5 AND avg(value) > 20")
sql("qs_logs", "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'error' AND value > 10 AND props LIKE '%1%' GROUP BY event_type")


@query(
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1, 2"
)
def flagship_hourly(load, spark):
    g = load("events").groupBy(time_bucket("1 hour", "ts").alias("bucket"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))
