"""Candle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import aggs as A
from tidegauge.functions.bucket import time_bucket
from tidegauge.plans.registry import query
from tidegauge.streaming import stateful


@query(
    "AG6_ohlcv",
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type AS symbol, arg_min(value, ts) AS open,
       max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume
       FROM events GROUP BY ALL""",
)
def ohlcv(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(time_bucket("1 hour", "ts").alias("bucket"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"),
    )


def _hourly(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(time_bucket("1 hour", "ts").alias("bucket"), F.col("event_type").alias("symbol")).agg(A.candlestick_agg("ts", "value", "user_id").alias("c"))


_CANDLE = """round(arg_min(value, ts), 6) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(user_id)::DOUBLE AS volume,
       round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS vwap"""


def _unpacked(d, bucket="bucket"):
    return d.select(F.col(bucket).alias("bucket"), "symbol", F.round("c.open", 6).alias("open"), "c.high", "c.low", "c.close", "c.volume", F.round(A.vwap("c"), 6).alias("vwap"))


@query("AG19_candlestick", f"SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type AS symbol, {_CANDLE} FROM events GROUP BY ALL")
def candlestick(spark, sf_dir):
    return _unpacked(_hourly(spark, sf_dir))


@query("AG20_ohlc_state", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type AS symbol, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY ALL")
def ohlc_state(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = e.groupBy(time_bucket("1 day", "ts").alias("bucket"), F.col("event_type").alias("symbol")).agg(A.ohlc("ts", "value").alias("c"))
    return d.select("bucket", "symbol", "c.open", "c.high", "c.low", "c.close")


@query("AG21_candle_rollup", f"SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type AS symbol, {_CANDLE} FROM events GROUP BY ALL")
def rollup(spark, sf_dir):
    h = _hourly(spark, sf_dir).withColumn("day", time_bucket("1 day", "bucket"))
    return _unpacked(h.groupBy("day", "symbol").agg(A.rollup_candlestick("c").alias("c")), "day")


@query("AG22_candle_times", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type AS symbol, min(ts) AS open_time, max(ts) AS close_time, first(ts ORDER BY value DESC NULLS LAST, ts) AS high_time FROM events GROUP BY ALL")
def times(spark, sf_dir):
    """The times of candles of all events; the time of a high that occurs more than once is the least."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = e.groupBy(time_bucket("1 day", "ts").alias("bucket"), F.col("event_type").alias("symbol")).agg(A.candlestick_agg("ts", "value").alias("c"))
    return d.select("bucket", "symbol", "c.open_time", "c.close_time", "c.high_time")


@query("CA6_cascade", f"SELECT time_bucket(INTERVAL '1 week', ts) AS bucket, event_type AS symbol, {_CANDLE} FROM events GROUP BY ALL".replace("'1 week'", "'7 days'"))
def cascade(spark, sf_dir):
    day = _hourly(spark, sf_dir).withColumn("day", time_bucket("1 day", "bucket")).groupBy("day", "symbol").agg(A.rollup_candlestick("c").alias("c"))
    return _unpacked(day.withColumn("week", time_bucket("1 week", "day")).groupBy("week", "symbol").agg(A.rollup_candlestick("c").alias("c")), "week")


@query("CA7_zone_rollup", f"SELECT date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::TIMESTAMP AS bucket, event_type AS symbol, {_CANDLE} FROM events GROUP BY ALL")
def zones(spark, sf_dir):
    h = _hourly(spark, sf_dir).withColumn("day", time_bucket("1 day", F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), "bucket")))
    return _unpacked(h.groupBy("day", "symbol").agg(A.rollup_candlestick("c").alias("c")), "day")


@query("CA8_pair_candles", "WITH a AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, ts, value FROM events WHERE event_type = 'click'), b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) SELECT a.bucket, count(*) AS n, round(max(value / v), 6) AS high, round(min(value / v), 6) AS low, round(arg_max(value / v, ts), 6) AS close FROM a JOIN b ON a.bucket = b.bucket GROUP BY a.bucket")
def pairs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("bucket", time_bucket("1 hour", "ts"))
    b = e.where("event_type = 'view'").groupBy("bucket").agg(F.avg("value").alias("v"))
    d = e.where("event_type = 'click'").join(b, "bucket").withColumn("r", F.col("value") / F.col("v"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.max("r"), 6).alias("high"), F.round(F.min("r"), 6).alias("low"), F.round(F.max_by("r", "ts"), 6).alias("close"))


@query("ST3_stream_candles", "SELECT time_bucket(INTERVAL '1 minute', ts) AS bucket, event_type AS symbol, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY ALL")
def minute_candles(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("event_type").alias("symbol"), "value", F.lit(1).alias("volume"))
    return stateful.candles(e, "1 minute", ["symbol"], "ts", "value", "volume")
