"""Queries through stored, incrementally maintained aggregates; each has a scratch catalog in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import aggs as A
from tidegauge.functions.scalars import qualify_reading
from tidegauge.plans.cagg import Catalog, merge_sources
from tidegauge.plans.registry import query, table

_COLUMNS = ("ts", "event_type", "user_id", "value")
_DAILY = "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS high FROM events GROUP BY ALL"


def _catalog(spark, sf_dir):
    c = Catalog(spark)
    e = table(spark, sf_dir, "events").select(*_COLUMNS)
    c.create_table("ticks", e.schema, "ts", "7 days")
    return c, e


def _aggs():
    return {"n": F.count("*"), "total": F.sum("value"), "high": F.max("value")}


def _rounded(d):
    return d.withColumn("total", F.round("total", 4))


@query("CA1_stored_aggregate", _DAILY)
def ca1(spark, sf_dir):
    c, e = _catalog(spark, sf_dir)
    c.append("ticks", e)
    return _rounded(c.create("daily", "ticks", "ts", "1 day", ["event_type"], _aggs()).read())


@query("CA2_real_time", _DAILY)
def ca2(spark, sf_dir):
    c, e = _catalog(spark, sf_dir)
    c.append("ticks", e.where("ts < TIMESTAMP_NTZ '2024-01-10 12:00:00'"))
    daily = c.create("daily", "ticks", "ts", "1 day", ["event_type"], _aggs(), with_data=False, materialized_only=False)
    daily.refresh(None, "2024-01-10 00:00:00")
    c.append("ticks", e.where("ts >= TIMESTAMP_NTZ '2024-01-10 12:00:00'"))
    return _rounded(daily.read())


@query("CA3_range_refresh", _DAILY.replace("FROM events", "FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'"))
def ca3(spark, sf_dir):
    c, e = _catalog(spark, sf_dir)
    c.append("ticks", e)
    daily = c.create("daily", "ticks", "ts", "1 day", ["event_type"], _aggs(), with_data=False)
    daily.refresh("2024-01-04 10:00:00", "2024-01-12 20:00:00")  # only whole days
    return _rounded(daily.read())


@query("CA5_refresh_cascade", _DAILY.replace("INTERVAL '1 day'", "INTERVAL '7 days'"))
def ca5(spark, sf_dir):
    c, e = _catalog(spark, sf_dir)
    c.create("hourly", "ticks", "ts", "1 hour", ["event_type"], _aggs(), with_data=False)
    up = {"n": F.sum("n"), "total": F.sum("total"), "high": F.max("high")}
    c.create("daily", "hourly", "bucket", "1 day", ["event_type"], up, with_data=False)
    c.create("weekly", "daily", "bucket", "7 days", ["event_type"], up, with_data=False)
    c.append("ticks", e)
    c.refresh_cascade()
    return _rounded(c.aggregates["weekly"].read())


@query("CA9_filtered_union", "SELECT 'low' AS source, time_bucket(INTERVAL '1 day', ts) AS bucket, count(*) AS n FROM events WHERE user_id < 50 AND value >= 5 GROUP BY 2 UNION ALL SELECT 'high', time_bucket(INTERVAL '1 day', ts), count(*) FROM events WHERE user_id >= 50 AND value >= 5 GROUP BY 2")
def ca9(spark, sf_dir):
    c, e = _catalog(spark, sf_dir)
    ok = e.withColumn("event_type", qualify_reading(F.col("value") - 5, F.lit("good")))
    c.append("ticks", ok)
    low = c.create("low", "ticks", "ts", "1 day", [], {"n": F.count("*")}, where="event_type = 'OK' AND user_id < 50").read()
    high = c.create("high", "ticks", "ts", "1 day", [], {"n": F.count("*")}, where="event_type = 'OK' AND user_id >= 50").read()
    return low.withColumn("source", F.lit("low")).unionByName(high.withColumn("source", F.lit("high")))


@query("CA10_partial_refresh", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, count(*) AS n, round(sum(CASE WHEN user_id = 7 THEN 0 ELSE value END), 4) AS total, max(CASE WHEN user_id = 7 THEN 0 ELSE value END) AS high FROM events WHERE NOT (event_type = 'error' AND user_id = 3) GROUP BY ALL")
def ca10(spark, sf_dir):
    c, e = _catalog(spark, sf_dir)
    c.append("ticks", e.where("user_id % 2 = 0"))
    daily = c.create("daily", "ticks", "ts", "1 day", ["event_type"], _aggs())
    log = c.enable_partial_refresh("daily")
    c.append("ticks", e.where("user_id % 2 = 1"))
    log.process(limit=2)
    c.update("ticks", F.col("user_id") == 7, {"value": F.lit(0.0)})
    c.delete("ticks", (F.col("event_type") == "error") & (F.col("user_id") == 3))
    log.process()
    return _rounded(daily.read())


@query("CA12_merge_sources", "WITH a AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS t, avg(value) AS v, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS t, max(value) AS w, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) SELECT coalesce(a.t, b.t) AS timestamp, round(v, 6) AS v, w, coalesce(a.n, 0) + coalesce(b.n, 0) AS samples_count FROM a FULL JOIN b ON a.t = b.t")
def ca12(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [(e.where("event_type = 'click'"), "ts", {"v": F.round(F.avg("value"), 6)}), (e.where("event_type = 'view'"), "ts", {"w": F.max("value")})]
    return merge_sources(parts, "1 hour")


@query("CA6_stored_candles", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY ALL")
def ca6_stored(spark, sf_dir):
    c, e = _catalog(spark, sf_dir)
    c.append("ticks", e)
    c.create("hourly", "ticks", "ts", "1 hour", ["event_type"], {"c": A.candlestick_agg("ts", "value")})
    d = c.create("daily", "hourly", "bucket", "1 day", ["event_type"], {"c": A.rollup_candlestick("c")}).read()
    return d.select("bucket", "event_type", "c.open", "c.high", "c.low", "c.close")


@query("STO_chunked_table", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-11'")
def sto(spark, sf_dir):
    from tidegauge.plans.cagg import scratch
    from tidegauge.sources.storage import ChunkedTable

    e = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    t = ChunkedTable.create(spark, scratch(spark), e.schema, "ts", "1 day", rows=e)
    t.set_compression([], ["event_id"])
    t.compress_chunks("2024-01-20 00:00:00")
    t.drop_chunks("2024-01-05 00:00:00")
    return t.read("2024-01-09 00:00:00", "2024-01-11 00:00:00")
