"""Queries through chunked tables, jobs and logs; each has a scratch folder in the shared one."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidegauge.functions import timevector as V
from tidegauge.functions.bucket import time_bucket
from tidegauge.operators import merge
from tidegauge.plans.cagg import Catalog, scratch
from tidegauge.plans.jobs import Jobs, compression_policy, refresh_policy, retention_policy
from tidegauge.plans.registry import query, table
from tidegauge.sources.storage import ChunkedTable, route


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")


def _table(spark, sf_dir, interval="7 days", **more):
    e = _rows(spark, sf_dir)
    return ChunkedTable.create(spark, scratch(spark), e.schema, "ts", interval, rows=e, **more)


@query("SNK1_append", "SELECT event_id, ts, user_id, value FROM events")
def snk1(spark, sf_dir):
    e = _rows(spark, sf_dir)
    t = ChunkedTable.create(spark, scratch(spark), e.schema, "ts", "7 days")
    t.append(e.where("event_id % 2 = 0"))
    t.append(e.where("event_id % 2 = 1"))
    return t.read()


@query("SNK8_truncate", "SELECT event_id, ts, user_id, value FROM events")
def snk8(spark, sf_dir):
    t = _table(spark, sf_dir)
    t.truncate()
    t.append(_rows(spark, sf_dir))
    return t.read()


@query("STO1_chunks", "SELECT DISTINCT strftime(time_bucket(INTERVAL '7 days', ts), '%Y%m%dT%H%M%S') AS chunk FROM events")
def sto1(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in _table(spark, sf_dir).show_chunks()], "chunk string")


@query("STO2_second_dimension", "SELECT event_id, ts, user_id, value FROM events")
def sto2(spark, sf_dir):
    return _table(spark, sf_dir, space=("user_id", 4)).read()


@query("STO4_read_chunk", "SELECT event_id FROM events WHERE time_bucket(INTERVAL '7 days', ts) = (SELECT min(time_bucket(INTERVAL '7 days', ts)) FROM events)")
def sto4(spark, sf_dir):
    t = _table(spark, sf_dir)
    return t.read_chunk(t.show_chunks()[0]).select("event_id")


@query("STO5_compressed", "SELECT event_id, ts, user_id, value FROM events")
def sto5(spark, sf_dir):
    t = _table(spark, sf_dir)
    t.set_compression(["user_id"], ["ts"])
    t.compress_chunks("2024-01-16 00:00:00")
    return t.read()


@query("STO6_retention", "SELECT event_id FROM events WHERE time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-11 12:00:00'")
def sto6(spark, sf_dir):
    t = _table(spark, sf_dir, "1 day")
    t.drop_chunks("2024-01-11 12:00:00")
    return t.read().select("event_id")


@query("STO8_chunk_sizes", "SELECT strftime(time_bucket(INTERVAL '7 days', ts), '%Y%m%dT%H%M%S') AS chunk, count(*) AS rows FROM events GROUP BY 1")
def sto8(spark, sf_dir):
    return _table(spark, sf_dir).chunk_sizes().select("chunk", "rows")


@query("STO10_alter_type", "SELECT event_id, ts, user_id::VARCHAR AS user_id, value, NULL::INTEGER AS extra FROM events")
def sto10(spark, sf_dir):
    t = _table(spark, sf_dir)
    t.alter_type("user_id", "string")
    t.add_column("extra", "int")
    return t.read()


@query("STO11_routing", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def sto11(spark, sf_dir):
    root = scratch(spark)
    route(table(spark, sf_dir, "events").select("event_id", "event_type"), root, "event_type")
    return spark.read.parquet(root).groupBy("event_type").agg(F.count("*").alias("n"))


@query("STO14_checks", "SELECT event_id FROM events WHERE value >= 0")
def sto14(spark, sf_dir):
    t = _table(spark, sf_dir)
    t.add_check("not_negative", "value >= 0")
    try:
        t.append(_rows(spark, sf_dir).limit(1).withColumn("value", F.lit(-1.0)))
    except merge.ConstraintError:
        return t.read().select("event_id")
    raise AssertionError("the check should refuse the row")


_DAILY = "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, user_id, count(*) AS n FROM events"


def _catalog(spark, sf_dir):
    c = Catalog(spark)
    e = _rows(spark, sf_dir)
    c.create_table("ticks", e.schema, "ts", "1 day")
    c.append("ticks", e)
    return c


@query("CA4_policies", f"{_DAILY} WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-14' GROUP BY ALL")
def ca4(spark, sf_dir):
    c, jobs = _catalog(spark, sf_dir), Jobs()
    a = c.create("daily", "ticks", "ts", "1 day", ["user_id"], {"n": F.count("*")}, with_data=False)
    refresh_policy(jobs, a, "5 days", "1 day", "1 hour")
    compression_policy(jobs, c.tables["ticks"], "10 days")
    retention_policy(jobs, c.tables["ticks"], "13 days")
    jobs.run_once(datetime(2024, 1, 15))
    return a.read()


@query("CA11_log_states", """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE user_id IN (1, 2, 3)),
       g AS (SELECT user_id, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS run FROM d),
       n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, run FROM g))
       SELECT 'completed' AS status, 2::BIGINT AS n UNION ALL SELECT 'pending', n - 2 FROM n WHERE n > 2""")  # fmt: skip
def ca11(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    c.create("daily", "ticks", "ts", "1 day", ["user_id"], {"n": F.count("*")})
    log = c.enable_partial_refresh("daily")
    c.append("ticks", _rows(spark, sf_dir).where("user_id IN (1, 2, 3)"))
    log.process(limit=2)
    return log.entries().groupBy("status").agg(F.count("*").alias("n"))


@query("CA13_drop_cascade", "SELECT unnest(['weekly', 'daily', 'ticks']) AS dropped")
def ca13(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    c.create("daily", "ticks", "ts", "1 day", ["user_id"], {"n": F.count("*")}, with_data=False)
    c.create("weekly", "daily", "bucket", "7 days", ["user_id"], {"n": F.sum("n")}, with_data=False)
    return spark.createDataFrame([(n,) for n in c.drop("ticks", cascade=True)], "dropped string")


def _vectors(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("user_id").agg(V.timevector("ts", "value").alias("v"))


@query("AG25_timevector", "SELECT user_id, count(*)::INTEGER AS points FROM events GROUP BY user_id")
def ag25(spark, sf_dir):
    return _vectors(spark, sf_dir).select("user_id", F.size("v").alias("points"))


@query("TV1_sort", "SELECT user_id, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM events GROUP BY user_id")
def tv1(spark, sf_dir):
    d = _vectors(spark, sf_dir).withColumn("v", V.sort(F.col("v")))
    return d.select("user_id", F.element_at("v", 1)["value"].alias("first_value"), F.element_at("v", -1)["value"].alias("last_value"))


@query("TV3_absolute", "SELECT user_id, round(sum(abs(value - 20)), 4) AS total FROM events GROUP BY user_id")
def tv3(spark, sf_dir):
    d = _rows(spark, sf_dir).withColumn("value", F.col("value") - 20).groupBy("user_id").agg(V.timevector("ts", "value").alias("v"))
    return d.select("user_id", F.round(V.total(V.absolute(F.col("v"))), 4).alias("total"))


@query("TV4_sum", "SELECT user_id, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def tv4(spark, sf_dir):
    return _vectors(spark, sf_dir).select("user_id", F.round(V.total(F.col("v")), 4).alias("total"))


@query("TV5_unnest", "SELECT user_id, ts AS time, value FROM events")
def tv5(spark, sf_dir):
    return _vectors(spark, sf_dir).select("user_id", V.unnest(F.col("v")))


@query("ST2_late_rows", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, user_id, count(*) AS n FROM events WHERE NOT (ts < TIMESTAMP '2024-01-05' AND event_id % 2 = 1) GROUP BY ALL")
def st2(spark, sf_dir):
    c, e = Catalog(spark), _rows(spark, sf_dir)
    c.create_table("ticks", e.schema, "ts", "1 day")
    early = "ts < TIMESTAMP_NTZ '2024-01-20 00:00:00' AND event_id % 2 = 0"
    c.append("ticks", e.where(early))
    a = c.create("daily", "ticks", "ts", "1 day", ["user_id"], {"n": F.count("*")})
    c.append("ticks", e.where(f"NOT ({early})"))  # rows of days before 5 January come too late for the window that is refreshed
    a.refresh("2024-01-05 00:00:00", None)
    return a.read()


@query("ST6_latest_closed", "SELECT user_id, max(bucket) AS bucket FROM (SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS bucket FROM events) x WHERE bucket + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) GROUP BY user_id")
def st6(spark, sf_dir):
    e = _rows(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))  # one row
    h = e.groupBy("user_id", time_bucket("1 hour", "ts").alias("bucket")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(now))
    return h.where(F.col("bucket") + F.expr("INTERVAL 1 HOUR") <= F.col("now")).groupBy("user_id").agg(F.max("bucket").alias("bucket"))
