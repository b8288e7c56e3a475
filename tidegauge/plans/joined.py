"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidegauge.functions.bucket import time_bucket
from tidegauge.operators import joins as J, windows as W
from tidegauge.plans.registry import query, sql, table

sql("JN1_inner", "SELECT o.o_orderkey, c.c_name, n.n_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey, {nation} n WHERE c.c_nationkey = n.n_nationkey AND o.o_totalprice > 200000")
sql("JN2_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey")
sql("JN3_left_condition", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F' AND c.c_acctbal > 0 GROUP BY c.c_custkey")


def _events(spark, sf_dir, kind: str, *columns):
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(*columns)


@query("JN4_bucket_join", "WITH a AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, user_id, value AS va FROM events WHERE event_type = 'click'), b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, user_id, value AS vb FROM events WHERE event_type = 'view') SELECT user_id, bucket, round(va * vb, 6) AS product FROM a JOIN b USING (user_id, bucket)")
def jn4(spark, sf_dir):
    a = _events(spark, sf_dir, "click", "user_id", F.col("ts").alias("ta"), F.col("value").alias("va"))
    b = _events(spark, sf_dir, "view", "user_id", F.col("ts").alias("tb"), F.col("value").alias("vb"))
    return J.bucket_join(a, b, "1 hour", "ta", "tb", ["user_id"]).select("user_id", "bucket", F.round(F.col("va") * F.col("vb"), 6).alias("product"))


_THREE = "WITH {0} SELECT {1} AS bucket, a, b, c FROM x FULL JOIN y ON x.k = y.k FULL JOIN z ON coalesce(x.k, y.k) = z.k"


@query("JN5_full_outer_align", _THREE.format(", ".join(f"{n} AS (SELECT time_bucket(INTERVAL '3 hours', ts) AS k, count(*) AS {c} FROM events WHERE event_type = '{e}' GROUP BY 1)" for n, c, e in (("x", "a", "click"), ("y", "b", "view"), ("z", "c", "purchase"))), "coalesce(x.k, y.k, z.k)"))
def jn5(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    frames = [e.where(F.col("event_type") == k).groupBy(time_bucket("3 hours", "ts").alias("bucket")).agg(F.count("*").alias(c)) for c, k in (("a", "click"), ("b", "view"), ("c", "purchase"))]
    return J.full_outer_align(frames, "bucket")


@query("JN6_full_outer_zones", "WITH e AS (SELECT ts AT TIME ZONE 'UTC' AS t, value FROM events), a AS (SELECT date_trunc('day', t AT TIME ZONE 'America/New_York') AS day, count(*) AS ny FROM e GROUP BY 1), b AS (SELECT date_trunc('day', t AT TIME ZONE 'Europe/Berlin') AS day, count(*) AS berlin FROM e GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, ny, berlin FROM a FULL JOIN b ON a.day = b.day")
def jn6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = lambda zone, name: e.groupBy(F.date_trunc("day", F.convert_timezone(F.lit("UTC"), F.lit(zone), "ts")).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias(name))
    return J.full_outer_align([one("America/New_York", "ny"), one("Europe/Berlin", "berlin")], "day")


_ASOF = "SELECT p.event_id, p.user_id, p.ts, s.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts"


@query("JN7_asof", _ASOF)
def jn7(spark, sf_dir):
    p = _events(spark, sf_dir, "purchase", "event_id", "user_id", "ts")
    s = _events(spark, sf_dir, "signup", "user_id", "ts", F.col("value").alias("last_value"))
    return J.asof_join(p, s, ["user_id"], "ts", ["last_value"])


@query("JN7_asof_split", _ASOF)
def jn7_split(spark, sf_dir):
    p = _events(spark, sf_dir, "purchase", "event_id", "user_id", "ts")
    s = _events(spark, sf_dir, "signup", "user_id", "ts", F.col("value").alias("last_value"))
    return J.asof_join_split(p, s, ["user_id"], "ts", ["last_value"], "1 day")


@query("JN8_forward_fill", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM events")
def jn8(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    return W.forward_fill(e, ["user_id"], "ts", ["v"]).select("event_id", "user_id", "v")


_OVERLAP = "FROM (SELECT o_custkey AS k, o_orderkey AS a, o_orderdate AS a1, o_orderdate + INTERVAL 20 DAY AS a2 FROM orders WHERE o_orderkey % 2 = 0) x JOIN (SELECT o_custkey AS k, o_orderkey AS b, o_orderdate AS b1, o_orderdate + INTERVAL 35 DAY AS b2 FROM orders WHERE o_orderkey % 2 = 1) y ON x.k = y.k AND a1 < b2 AND b1 < a2"


@query("JN9_overlap", f"SELECT x.k AS k, a, b {_OVERLAP}")
def jn9(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    x = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("a"), F.col("o_orderdate").alias("a1"), (F.col("o_orderdate") + F.expr("INTERVAL 20 DAY")).alias("a2"))
    y = o.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("b"), F.col("o_orderdate").alias("b1"), (F.col("o_orderdate") + F.expr("INTERVAL 35 DAY")).alias("b2"))
    return J.overlap_join(x, y, ["k"], "a1", "a2", "b1", "b2", "30 days").select("k", "a", "b")


@query("JN10_least_gap", "SELECT b.user_id, min(epoch_us(b.ts) - epoch_us(a.ts)) / 1e6 AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND a.ts < b.ts GROUP BY b.user_id")
def jn10(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')")
    d = J.last_before(e, ["user_id"], "ts", F.col("event_type") == "view").where("event_type = 'purchase' AND mark_time IS NOT NULL")
    return d.groupBy("user_id").agg((F.min(F.expr("timestampdiff(MICROSECOND, mark_time, ts)")) / 1e6).alias("seconds"))


sql("JN11_cross", "SELECT a.r_name AS a, b.r_name AS b FROM {region} a CROSS JOIN {region} b WHERE a.r_name <> b.r_name")
sql("JN12_lateral", "SELECT e.event_id, l.k2 FROM {events} e, LATERAL (SELECT e.user_id * 2 + 1 AS k2) l")


@query("JN13_levels", "WITH h AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, count(*) AS n FROM events GROUP BY 1), d AS (SELECT time_bucket(INTERVAL '1 day', b) AS b, sum(n) AS n FROM h GROUP BY 1) SELECT th.b AS hour, th.n AS hour_n, td.b AS day, td.n::BIGINT AS day_n FROM (SELECT * FROM h ORDER BY n DESC, b LIMIT 1) th JOIN (SELECT * FROM d) td ON time_bucket(INTERVAL '1 day', th.b) = td.b")
def jn13(spark, sf_dir):
    h = table(spark, sf_dir, "events").groupBy(time_bucket("1 hour", "ts").alias("hour")).agg(F.count("*").alias("hour_n"))
    d = h.groupBy(time_bucket("1 day", "hour").alias("day")).agg(F.sum("hour_n").alias("day_n"))
    top = h.orderBy(F.col("hour_n").desc(), "hour").limit(1).withColumn("day", time_bucket("1 day", "hour"))
    return d.join(F.broadcast(top), "day").select("hour", "hour_n", "day", "day_n")


@query("JN14_self_interval", "SELECT a.o_custkey, (epoch_us(max(b.o_orderdate)) - epoch_us(min(a.o_orderdate))) // 86400000000 AS days FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey GROUP BY a.o_custkey HAVING max(b.o_orderdate) - min(a.o_orderdate) > INTERVAL 2000 DAY")
def jn14(spark, sf_dir):
    """Both ends of the self-join are over the rows of one key, so one aggregate has them; a null key meets nothing."""
    o = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return o.where("b - a > INTERVAL '2000' DAY").select("o_custkey", F.expr("timestampdiff(DAY, a, b)").alias("days"))


@query("ORD4_latest_per_key", "SELECT DISTINCT ON (user_id) user_id, event_id, ts, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def ord4(spark, sf_dir):
    return W.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", "event_id")


@query("SC18_nearest_vectors", "SELECT query_id, item_id, round(d, 4) AS distance, rank FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_distance(i.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(i.embedding::DOUBLE[], q.embedding::DOUBLE[]), i.vec_id) AS rank FROM embeddings i, embeddings q WHERE q.vec_id % 20 = 0) x WHERE rank <= 3")
def knn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    got = J.nearest_vectors(e.where("vec_id % 20 = 0"), e, "embedding", "vec_id", "vec_id", 3)
    return got.select("query_id", "item_id", F.round("distance", 4).alias("distance"), "rank")


@query("PIPE_consumption_by_type", """SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, kind, round(sum(value), 4) AS total FROM
       (SELECT p.ts, p.value, s.user_id % 5 AS kind FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id % 10 = s.user_id % 10 AND p.ts >= s.ts) GROUP BY ALL""")  # fmt: skip
def consumption(spark, sf_dir):
    grid = (F.col("user_id") % 10).alias("grid")
    p = _events(spark, sf_dir, "purchase", grid, "ts", "value")
    s = _events(spark, sf_dir, "signup", grid, "ts", (F.col("user_id") % 5).alias("kind"))
    return J.asof_join(p, s, ["grid"], "ts", ["kind"]).groupBy(time_bucket("1 day", "ts").alias("bucket"), "kind").agg(F.round(F.sum("value"), 4).alias("total"))


@query("WN8_last_value", "SELECT event_id, last_value(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM events")
def wn8(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last("value").over(w).alias("v"))
