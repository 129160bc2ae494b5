"""Projection, filters, joins, aggregation, windows, sorting, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidelake.functions import nulls_last
from tidelake.operators.joins import asof_join, positional_join, range_join
from tidelake.operators.windows import trailing
from tidelake.plans.registry import query, sql

# ---------------------------------------------------------------- projection and filters
sql("p1_project", "SELECT c_custkey, upper(c_name) AS name, c_acctbal * 2 AS doubled, 7 AS seven FROM customer")
sql("p2_star_replace", "SELECT * EXCEPT (p_name), lower(p_name) AS p_name FROM part", "SELECT * REPLACE (lower(p_name) AS p_name) FROM part")
sql("p3_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 200000 AND o_orderstatus <> 'F') OR NOT (o_totalprice > 2000)")
sql("p4_in", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 9, -1) AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) AND c_mktsegment NOT IN ('AUTOMOBILE')")
sql("p5_like", "SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'a%' OR p_name LIKE '%e' OR p_name LIKE '%ar%') AND p_type NOT LIKE '%STEEL%'")
sql("p6_between_time", "SELECT event_id, ts FROM events WHERE ts BETWEEN timestamp_ntz'2024-01-05 00:00:00' AND timestamp_ntz'2024-01-09 12:00:00'", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
sql("p7_relative_time", "SELECT count(*) AS n FROM events WHERE ts >= timestamp_ntz'2024-01-20 00:00:00' - INTERVAL '7' DAY AND ts < timestamp_ntz'2024-01-20 00:00:00' + INTERVAL '90' MINUTE", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL '7 days' AND ts < TIMESTAMP '2024-01-20' + INTERVAL 90 MINUTE")
#: Days that end today, so that ranges relative to now have rows: 45 of them, rows at six in the morning.
RECENT = "SELECT CAST(CAST(now() AS DATE) AS TIMESTAMP) - INTERVAL 1 DAY * CAST(event_id % 45 AS INT) + INTERVAL 6 HOUR AS time, value FROM events"
sql(
    "p7_now",
    f"SELECT count(*) AS n, count(CASE WHEN time > current_timestamp() - INTERVAL '24' HOUR THEN 1 END) AS m, min(time) AS first FROM ({RECENT.replace('TIMESTAMP', 'TIMESTAMP_NTZ')}) WHERE time >= now() - INTERVAL '7' DAY AND time < now() + INTERVAL '90' MINUTE",
    f"SELECT count(*) AS n, count(CASE WHEN time > current_timestamp - INTERVAL 24 HOUR THEN 1 END) AS m, min(time) AS first FROM ({RECENT}) WHERE time >= now() - INTERVAL 7 DAY AND time < now() + INTERVAL 90 MINUTE",
)
sql("p8_case", "SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM lineitem GROUP BY CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'mid' ELSE 'high' END")
sql("p9_is_null", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")


@query("SELECT * FROM events WHERE value > 20 ORDER BY ts DESC NULLS LAST, event_id LIMIT 100 OFFSET 5")
def p10_measurement_query(load, spark):
    from tidelake.operators.browse import measurement_query

    return measurement_query(load("events"), where="value > 20", order_by=[("ts", True), ("event_id", False)], limit=100, offset=5)


# ---------------------------------------------------------------- joins
sql("j1_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
sql("j2_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000 GROUP BY c.c_custkey")
sql("j2_right", "SELECT s.s_suppkey, n.n_name FROM nation n RIGHT JOIN supplier s ON n.n_nationkey = s.s_nationkey AND n.n_regionkey = 1")
sql("j2_full", "SELECT a.c_nationkey AS a, b.s_nationkey AS b, a.n AS n, b.m AS m FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey, count(*) AS m FROM supplier WHERE s_acctbal < 5000 GROUP BY s_nationkey) b ON a.c_nationkey = b.s_nationkey")
sql("j3_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
sql("j3_comma", "SELECT r.r_name AS a, q.r_name AS b FROM region r, region q WHERE r.r_regionkey < q.r_regionkey")
sql("j4_natural", "SELECT o_orderkey, l_linenumber FROM (SELECT o_orderkey, o_orderstatus FROM orders) o NATURAL JOIN (SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45) l")
sql("j5_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
sql("j5_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
LATEST = "(SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts)"


@query(f"SELECT p.event_id, p.user_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN {LATEST} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def j6_asof_left(load, spark):
    e = load("events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return asof_join(left, right, ["user_id"], "ts", "ts", ["view_value"]).select("event_id", "user_id", "view_value")


@query(f"SELECT p.event_id, p.user_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN {LATEST} v ON p.user_id = v.user_id AND p.ts >= v.ts")
def j6_asof_inner(load, spark):
    e = load("events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", "ts", F.col("value").alias("view_value"))
    return asof_join(left, right, ["user_id"], "ts", "ts", ["view_value"], "inner").select("event_id", "user_id", "view_value")


@query("SELECT a.s_suppkey, b.c_custkey FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey) a POSITIONAL JOIN (SELECT c_custkey FROM customer ORDER BY c_custkey DESC) b")
def j7_positional(load, spark):
    return positional_join(load("supplier").select("s_suppkey"), load("customer").select("c_custkey"), [F.col("s_suppkey")], [F.col("c_custkey").desc()])


sql("j8_lateral", "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
sql("j9_theta", "SELECT a.event_id, b.event_id AS later FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '6' HOUR WHERE a.event_type = 'error'", "SELECT a.event_id, b.event_id AS later FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'error'")


@query("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 40 AS hi FROM supplier) s ON p_retailprice >= lo AND p_retailprice < hi")
def j9_range(load, spark):
    ranges = load("supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 40).alias("hi"))
    return range_join(load("part").select("p_partkey", "p_retailprice"), ranges, "p_retailprice", "lo", "hi", 40.0).select("p_partkey", "s_suppkey")


sql("j10_recursive_self_join", "WITH RECURSIVE walk(n, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT x.n_nationkey, w.depth + 1 FROM walk w JOIN nation x ON x.n_nationkey = w.n + 3) SELECT n, depth FROM walk")

# ---------------------------------------------------------------- aggregation
sql("g1_count", "SELECT count(*) AS n, count(o_orderpriority) AS m FROM orders")
sql("g2_aggregates", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 4) AS avg_qty, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_extendedprice) AS lo, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("g3_distinct_mixed", "SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_brand")
sql("g4_alias_ordinal", "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
sql("g5_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND max(length(o_orderpriority)) > 5")
sql("g6_quantiles", "SELECT event_type, round(percentile(value, 0.95), 6) AS p95, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS d90, round(median(value), 6) AS med FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS p50, quantile_disc(value, 0.9) AS d90, round(median(value), 6) AS med FROM events GROUP BY event_type")
sql("g7_filter", "SELECT count(*) FILTER (WHERE o_totalprice > 150000) AS big, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders")
WIDE = ", ".join(f"CAST(sum(l_linenumber + {k}) AS BIGINT) AS s{k}" for k in range(90))
sql("g8_wide", f"SELECT {WIDE} FROM lineitem")
sql("g9_distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
sql("g12_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS TINYINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("g12_cube", "SELECT p_brand, p_size % 5 AS s, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size % 5)")
sql("g12_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("g12_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("g12_arg_max", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(p := o_totalprice, k := o_orderkey)) AS best FROM orders GROUP BY o_custkey")
sql("g12_statistics", "SELECT l_returnflag, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cv FROM lineitem GROUP BY l_returnflag")


@query("SELECT count(DISTINCT user_id) AS exact, true AS close FROM events")
def g12_approx_distinct(load, spark):
    e = load("events").agg(F.countDistinct("user_id").alias("exact"), F.approx_count_distinct("user_id", 0.02).alias("approx"))
    return e.select("exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


@query("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def g14_metadata_count(load, spark):
    return load("orders").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


# ---------------------------------------------------------------- windows
@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS moving FROM events")
def w1_moving_average(load, spark):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-10, 0)
    return load("events").select("event_id", F.round(F.avg("value").over(w), 6).alias("moving"))


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def w2_qualify_latest(load, spark):
    w = W.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return load("events").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


sql("w3_ranking", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS q, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)",
    "SELECT o_orderkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS n, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS q, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC)")
sql("w3_analytic", "SELECT event_id, lag(value) OVER w AS prev, lead(value, 2, -1.0) OVER w AS next2, first_value(value) OVER w AS f, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(value, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW), 4) AS s FROM events")
def w3_range_interval(load, spark):
    rows = trailing(load("events").select("event_id", "event_type", "ts", "value"), ["event_type"], "ts", "value", 3600)
    return rows.select("event_id", "n", F.round("s", 4).alias("s"))



# ---------------------------------------------------------------- order, limits, sets, subqueries


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def o3_top_k(load, spark):
    return load("orders").select("o_orderkey", "o_totalprice").orderBy(nulls_last("o_totalprice", True), nulls_last("o_orderkey")).limit(10)


@query("SELECT c.c_custkey, max(o.o_totalprice) AS best FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey ORDER BY best ASC, c.c_custkey LIMIT 20 OFFSET 15")
def o1_nulls_last(load, spark):
    j = load("customer").join(load("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.max("o_totalprice").alias("best"))
    return j.orderBy(nulls_last("best"), nulls_last("c_custkey")).offset(15).limit(20)


sql("o2_limit_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_size, p_partkey LIMIT 25 OFFSET 40")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 500")
def o4_row_cap(load, spark):
    from tidelake.operators.browse import capped

    return capped(load("events").select("event_id").orderBy("event_id"), 500)


sql("o5_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier")
sql("o5_union_all", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier")
sql("o6_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 4000")
sql("o6_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
sql("o6_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("o6_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("o7_ctes", "WITH big(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), top AS (SELECT k FROM big WHERE total > 1000000) SELECT c.c_mktsegment, count(*) AS n FROM customer c JOIN top ON c.c_custkey = top.k GROUP BY c.c_mktsegment")
sql("o7_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS sq FROM t")
sql("o8_subqueries", "SELECT o_orderkey, (SELECT round(avg(l_quantity), 4) FROM lineitem WHERE l_orderkey = o_orderkey) AS q FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05)")
sql("s15_series", "SELECT explode(sequence(1, 20, 3)) AS x", "SELECT CAST(x AS INT) AS x FROM generate_series(1, 20, 3) t(x)")
sql("s15_unnest", "SELECT vec_id, pos, x FROM (SELECT vec_id, posexplode(slice(embedding, 1, 3)) AS (pos, x) FROM embeddings)", "SELECT vec_id, CAST(i - 1 AS INT) AS pos, embedding[i] AS x FROM embeddings, generate_series(1, 3) t(i)")
