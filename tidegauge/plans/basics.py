"""Queries that are plain SQL: scans, filters, orders, sets, subqueries, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import scalars as S
from tidegauge.operators import merge
from tidegauge.plans.registry import query, sql, table
from tidegauge.sources import generate as G

sql("SRC1_scan", "SELECT n_nationkey, n_name, n_regionkey FROM {nation} ORDER BY n_nationkey LIMIT 10")
sql("SRC2_values", "SELECT id, uid, CAST(t AS TIMESTAMP_NTZ) AS t FROM VALUES (1, 'a', '2024-01-01 00:00:00'), (2, 'b', '2024-01-01 01:09:36') AS v(id, uid, t)",
    "SELECT id, uid, CAST(t AS TIMESTAMP) AS t FROM (VALUES (1, 'a', '2024-01-01 00:00:00'), (2, 'b', '2024-01-01 01:09:36')) AS v(id, uid, t)")


@query("SRC3_time_series", "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 00:00:50', INTERVAL 1 SECOND)) AS time")
def src3(spark, sf_dir):
    return G.time_series(spark, "2024-01-01 00:00:00", "2024-01-01 00:00:50", "1 SECOND")


@query("SRC4_int_series", "SELECT unnest(generate_series(1::BIGINT, 100, 7)) AS n")
def src4(spark, sf_dir):
    return G.int_series(spark, 1, 100, 7)


@query("SRC5_series_product", "SELECT time, a, b FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 00:01:01', INTERVAL 1 SECOND) x(time), generate_series(1::BIGINT, 2) y(a), generate_series(1::BIGINT, 3) z(b)")
def src5(spark, sf_dir):
    return G.product(G.time_series(spark, "2024-01-01 00:00:00", "2024-01-01 00:01:01", "1 SECOND"), G.int_series(spark, 1, 2, name="a"), G.int_series(spark, 1, 3, name="b"))


@query("SRC6_generator")
def src6(spark, sf_dir):
    return G.temperatures(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "1 HOUR", 5)


@query("SRC7_continue_series", "SELECT unnest(generate_series(max(ts) + INTERVAL 1 MINUTE, TIMESTAMP '2024-01-31 01:00:00', INTERVAL 1 MINUTE)) AS ts, r_regionkey AS device FROM events, region GROUP BY r_regionkey")
def src7(spark, sf_dir):
    keys = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("device"))
    return G.continue_series(table(spark, sf_dir, "events"), "ts", keys, "1 MINUTE", "2024-01-31 01:00:00", "2024-01-01 00:00:00")


sql("SNK2_cast_copy", "SELECT event_id, CAST(CAST(ts AS STRING) AS TIMESTAMP_NTZ) AS ts FROM {events}", "SELECT event_id, CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS ts FROM events")


def _halves(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))


@query("SNK3_upsert_add", "WITH o AS (SELECT c_nationkey AS k, count(*) AS n, min(c_acctbal) AS low FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS n, min(c_acctbal) AS low FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT coalesce(o.k, b.k) AS k, coalesce(o.n, 0) + coalesce(b.n, 0) AS n, least(o.low, b.low) AS low FROM o FULL JOIN b ON o.k = b.k")
def snk3(spark, sf_dir):
    old, batch = (d.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low")) for d in (table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")))
    return merge.upsert(old, batch, ["k"], {"n": merge.add, "low": merge.least})


@query("SNK4_insert_new", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_nationkey, round(c_acctbal + 1, 2) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0")
def snk4(spark, sf_dir):
    return merge.insert_new(*_halves(spark, sf_dir), ["c_custkey"])


@query("SNK5_merge", "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def snk5(spark, sf_dir):
    return merge.upsert(*_halves(spark, sf_dir), ["c_custkey"])


@query("SNK6_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def snk6(spark, sf_dir):
    return merge.update(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})


@query("SNK7_delete", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal < 0)")
def snk7(spark, sf_dir):
    return merge.delete(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0)


sql("STO14_foreign_key_violations", "SELECT o_orderkey, o_custkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {customer} WHERE c_custkey = o_custkey AND c_acctbal > 0)")
sql("STO7_range_skipping", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM {lineitem} WHERE l_shipdate >= TIMESTAMP_NTZ '1995-03-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1995-04-01 00:00:00'",
    "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-04-01'")
sql("PRJ1_expressions", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_tax AS tax FROM {lineitem}")


@query("PRJ2_struct_expansion", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id")
def prj2(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.struct(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).alias("s")).select("user_id", "s.*")


sql("PRJ3_case", "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS large FROM {orders} GROUP BY o_orderpriority",
    "SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS large FROM orders GROUP BY o_orderpriority")
sql("PRJ4_null_functions", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS k, greatest(c_acctbal, 0) AS g, least(c_acctbal, NULL, 100) AS l FROM {customer}")
sql("FLT1_predicates", "SELECT p_partkey FROM {part} WHERE p_size IN (1, 5, 9) AND p_partkey NOT IN (5, 7) AND p_size <> 5")
sql("FLT2_between", "SELECT event_id FROM {events} WHERE ts BETWEEN TIMESTAMP_NTZ '2024-01-05 00:00:00' AND TIMESTAMP_NTZ '2024-01-06 00:00:00'", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
sql("FLT3_any", "SELECT event_id FROM {events} WHERE array_contains(array('click', 'view'), event_type)", "SELECT event_id FROM events WHERE event_type = ANY(['click', 'view'])")
sql("FLT4_relative_time", "SELECT event_id FROM {events} WHERE ts > TIMESTAMP_NTZ '2024-01-30 00:00:00' - INTERVAL '7' DAY", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
sql("FLT5_null_safe", "SELECT a.c_custkey FROM {customer} a WHERE nullif(a.c_nationkey, 3) IS NOT DISTINCT FROM NULL OR a.c_acctbal IS NULL")
sql("FLT6_scalar_subquery", "SELECT c_custkey, c_acctbal - (SELECT min(c_acctbal) FROM {customer}) AS over_least FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer})",
    "SELECT c_custkey, c_acctbal - (SELECT min(c_acctbal) FROM customer) AS over_least FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
sql("FLT7_in_having", "SELECT o.o_orderkey, o.o_custkey, g.n FROM {orders} o JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12) g ON o.o_custkey = g.o_custkey",
    "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey) AS n FROM orders o WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)")


@query("FLT8_not_in_ranges", "SELECT event_id FROM events WHERE NOT ((ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05') OR (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'))")
def flt8(spark, sf_dir):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    ranges = F.array(*[F.struct(at(a).alias("s"), at(b).alias("e")) for a, b in (("2024-01-03", "2024-01-05"), ("2024-01-10", "2024-01-20"))])
    return table(spark, sf_dir, "events").where(~F.exists(ranges, lambda r: S.contains(r, "ts"))).select("event_id")


sql("CTE1_chain", "WITH a AS (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id), b AS (SELECT n, count(*) AS users FROM a GROUP BY n) SELECT n, users FROM b WHERE users > 1")
sql("CTE2_recursive", "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 20) SELECT n, total FROM t")
sql("CTE3_not_recursive", "WITH d AS (SELECT DISTINCT event_type FROM {events}) SELECT a.event_type AS a, b.event_type AS b FROM d a CROSS JOIN d b WHERE a.event_type < b.event_type")


@query("CTE4_materialized", "WITH latest AS MATERIALIZED (SELECT max(ts) AS t FROM events) SELECT user_id, count(*) AS n FROM events, latest WHERE ts > t - INTERVAL 1 DAY GROUP BY user_id")
def cte4(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("t"))  # one row
    return e.join(F.broadcast(last), e["ts"] > F.col("t") - F.expr("INTERVAL 1 DAY")).groupBy("user_id").agg(F.count("*").alias("n"))


sql("ORD1_null_order", "SELECT k, row_number() OVER (ORDER BY k DESC NULLS FIRST) AS place FROM (SELECT DISTINCT nullif(c_nationkey, 7) AS k FROM {customer}) x")
sql("ORD2_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")


@query("ORD3_last_n", "SELECT event_id, ts FROM events WHERE ts > (SELECT ts FROM events ORDER BY ts DESC LIMIT 1 OFFSET 500)")
def ord3(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    edge = e.orderBy(F.col("ts").desc()).offset(500).limit(1).select(F.col("ts").alias("edge"))
    return e.join(F.broadcast(edge), F.col("ts") > F.col("edge")).select("event_id", "ts")


sql("ORD5_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")
sql("SET1_union_all", "SELECT 'customers' AS metric, count(*) AS value FROM {customer} UNION ALL SELECT 'orders', count(*) FROM {orders} UNION ALL SELECT 'lines', count(*) FROM {lineitem}")
sql("SET2_default_or_latest", "SELECT ts FROM (SELECT TIMESTAMP_NTZ '2000-01-01 00:00:00' AS ts UNION ALL SELECT max(ts) FROM {events}) u ORDER BY ts DESC NULLS LAST LIMIT 1", "SELECT ts FROM (SELECT TIMESTAMP '2000-01-01' AS ts UNION ALL SELECT max(ts) FROM events) u ORDER BY ts DESC NULLS LAST LIMIT 1")
sql("SC1_concat", "SELECT c_custkey, c_name || '/' || nullif(c_mktsegment, 'BUILDING') AS label FROM {customer}")
sql("SC2_strings", "SELECT p_partkey, replace(p_name, ' ', '_') AS a, trim(BOTH '\"' FROM concat('\"', p_name, '\"')) AS b, lower(p_brand) AS c, regexp_replace(p_brand, '[0-9]+', '') AS d, array_join(split(p_name, ' '), '|') AS e FROM {part}",
    "SELECT p_partkey, replace(p_name, ' ', '_') AS a, trim('\"' || p_name || '\"', '\"') AS b, lower(p_brand) AS c, regexp_replace(p_brand, '[0-9]+', '', 'g') AS d, array_to_string(string_split(p_name, ' '), '|') AS e FROM part")
sql("SC4_format_time", "SELECT event_id, date_format(ts, 'yyyy-MM-dd HH:mm') AS t FROM {events}", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS t FROM events")


@query("SC5_extract", "SELECT event_id, extract(day FROM ts)::INTEGER AS d, extract(year FROM ts)::INTEGER AS y, extract(month FROM ts)::INTEGER AS m, extract(dow FROM ts)::INTEGER AS w, round(epoch(ts), 3) AS e FROM events")
def sc5(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.dayofmonth("ts").alias("d"), F.year("ts").alias("y"), F.month("ts").alias("m"), S.day_of_week("ts").alias("w"), F.round(S.epoch("ts"), 3).alias("e"))


sql("SC6_time_zones", "SELECT event_id, convert_timezone('UTC', 'America/New_York', ts) AS ny, convert_timezone('America/New_York', 'Europe/Berlin', ts) AS b FROM {events}",
    "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'Europe/Berlin' AS b FROM events")
sql("SC7_intervals", "SELECT event_id, ts + INTERVAL '90' MINUTE AS later, add_months(ts, 1) AS next_month, timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS us, ts - TIMESTAMP_NTZ '2024-01-01 00:00:00' > INTERVAL '10' DAY AS late FROM {events}",
    "SELECT event_id, ts + INTERVAL 90 MINUTE AS later, CAST(ts + INTERVAL 1 MONTH AS DATE) AS next_month, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, ts - TIMESTAMP '2024-01-01' > INTERVAL 10 DAY AS late FROM events")
sql("SC8_dates", "SELECT event_id, to_date(ts) AS d, make_date(year(ts), month(ts), 1) AS m FROM {events}", "SELECT event_id, ts::DATE AS d, make_date(year(ts), month(ts), 1) AS m FROM events")
sql("SC9_math", "SELECT event_id, round(sin(value), 6) AS a, round(cos(radians(value)), 6) AS b, round(degrees(atan2(value, 2)), 6) AS c, round(sqrt(abs(value)), 6) AS d, floor(value) AS e, CAST(value AS BIGINT) AS f, round(pi(), 5) AS g FROM {events}",
    "SELECT event_id, round(sin(value), 6) AS a, round(cos(radians(value)), 6) AS b, round(degrees(atan2(value, 2)), 6) AS c, round(sqrt(abs(value)), 6) AS d, floor(value)::BIGINT AS e, trunc(value)::BIGINT AS f, round(pi(), 5) AS g FROM events")


@query("SC10_random")
def sc10(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.rand(7).alias("r"))


@query("SC11_casts", "SELECT event_id, CASE WHEN value - floor(value) >= 0.5 THEN ceil(value) ELSE floor(value) END::INTEGER AS i, value::DECIMAL(12,2)::DOUBLE AS d, user_id::VARCHAR AS t FROM events")
def sc11(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.to_int("value").alias("i"), F.col("value").cast("decimal(12,2)").cast("double").alias("d"), F.col("user_id").cast("string").alias("t"))


sql("SC12_integer_division", "SELECT event_id, (event_id - 500) div 7 AS q, (event_id - 500) % 7 AS r FROM {events}", "SELECT event_id, trunc((event_id - 500) / 7)::BIGINT AS q, (event_id - 500) % 7 AS r FROM events")
sql("SC13_modulo", "SELECT p_partkey, p_size % 4 AS r, -p_size % 4 AS n FROM {part}")
sql("SC14_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, to_json(named_struct('a', event_type, 'b', user_id)) AS j FROM {events}",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_object('a', event_type, 'b', user_id)::VARCHAR AS j FROM events")
sql("SC15_arrays", "SELECT p_partkey, element_at(split(p_name, ' '), 1) AS f, size(split(p_name, ' ')) AS n, array_contains(split(p_name, ' '), 'red') AS r, nullif(size(filter(split(p_name, ' '), x -> x = 'nothing')), 0) AS z FROM {part}",
    "SELECT p_partkey, string_split(p_name, ' ')[1] AS f, len(string_split(p_name, ' '))::INTEGER AS n, list_contains(string_split(p_name, ' '), 'red') AS r, NULL::INTEGER AS z FROM part")


@query("SC16_ranges", "SELECT o_orderkey, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi, (TIMESTAMP '1995-06-15' >= o_orderdate AND TIMESTAMP '1995-06-15' < o_orderdate + INTERVAL 30 DAY) AS inside FROM orders")
def sc16(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("r", F.struct(F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("e")))
    return o.select("o_orderkey", F.col("r.s").alias("lo"), F.col("r.e").alias("hi"), S.contains(F.col("r"), F.lit("1995-06-15").cast("timestamp_ntz")).alias("inside"))


@query("SC17_uuid")
def sc17(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.uuid().alias("id"))


@query("SC18_vector_distance", "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), a.vec_id LIMIT 10")
def sc18(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    d = e.crossJoin(F.broadcast(q)).select("vec_id", S.l2_distance("embedding", "q").alias("d"))
    return d.orderBy("d", "vec_id").limit(10).select("vec_id", F.round("d", 4).alias("distance"))


_PERSIAN = """WITH dates AS (SELECT DISTINCT ts::DATE AS date FROM events UNION SELECT DISTINCT o_orderdate::DATE FROM orders),
a AS (SELECT date, floor(julian(date) + 0.5)::BIGINT - 2121445 AS n FROM dates),
b AS (SELECT date, 474 + 33 * (n // 12053) AS y, n % 12053 AS n FROM a),
c AS (SELECT date, y + 4 * (n // 1461) AS y, n % 1461 AS n FROM b),
e AS (SELECT date, CASE WHEN n >= 366 THEN y + (n - 1) // 365 ELSE y END AS y, CASE WHEN n >= 366 THEN (n - 1) % 365 ELSE n END AS n FROM c)
SELECT date, y::INTEGER AS persian_year, (CASE WHEN n < 186 THEN 1 + n // 31 ELSE 7 + (n - 186) // 30 END)::INTEGER AS persian_month,
(CASE WHEN n < 186 THEN 1 + n % 31 ELSE 1 + (n - 186) % 30 END)::INTEGER AS persian_day, (date - dayofweek(date)::INTEGER)::DATE AS week FROM e"""


@query("SC19_persian_date", _PERSIAN)
def sc19(spark, sf_dir):
    days = [table(spark, sf_dir, t).select(F.to_date(c).alias("date")) for t, c in (("events", "ts"), ("orders", "o_orderdate"))]
    d = days[0].unionByName(days[1]).distinct()
    p = d.withColumn("p", S.persian_date("date"))
    return p.select("date", F.col("p.y").alias("persian_year"), F.col("p.m").alias("persian_month"), F.col("p.d").alias("persian_day"), S.week_start_sunday("date").alias("week"))


@query("SC20_qualify", "SELECT event_id, CASE WHEN event_type = 'error' OR value - 5 < 0 THEN 'Discard' ELSE 'OK' END AS a, CASE WHEN user_id % 2 <> 0 OR nullif(value, 1) IS NULL THEN 'Discard' ELSE 'OK' END AS b FROM events")
def sc20(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "bad").otherwise("good")
    return e.select("event_id", S.qualify_reading(F.col("value") - 5, status).alias("a"), S.qualify_flagged(F.nullif(F.col("value"), F.lit(1.0)), F.col("user_id") % 2 == 0).alias("b"))


sql("SC21_boolean_column", "SELECT c_custkey, (nullif(c_nationkey, 3) IS NOT NULL) AS known FROM {customer}")
sql("ST12_alerts", "SELECT event_id, value FROM {events} WHERE value > 100")
