"""Generated rows: series of times and numbers, and seeded sample data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def time_series(spark: SparkSession, start: str, stop: str, step: str, name: str = "time") -> DataFrame:
    """Times from start to stop, which is included if a step meets it."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}"))).alias(name))


def int_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "n") -> DataFrame:
    """Numbers from start to stop, both included."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def product(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All combinations of rows."""
    for r in rest:
        first = first.crossJoin(r)
    return first


def temperatures(spark: SparkSession, start: str, stop: str, step: str, sensors: int, seed: int = 1) -> DataFrame:
    """Readings of sensors: a daily wave and noise that the seed decides."""
    t = product(time_series(spark, start, stop, step), int_series(spark, 1, sensors, name="sensor_id"))
    hour = F.hour("time") + F.minute("time") / 60
    noise = (F.pmod(F.xxhash64("time", "sensor_id", F.lit(seed)), F.lit(1000)) / 1000 - 0.5) * 2
    return t.withColumn("value", F.round(20 + F.col("sensor_id") % 7 + 5 * F.sin((hour - 9) * F.pi() / 12) + noise, 3))


def ticks(spark: SparkSession, start: str, stop: str, step: str, symbols: list[str], seed: int = 1) -> DataFrame:
    """Prices of symbols about a slow wave."""
    t = time_series(spark, start, stop, step).crossJoin(spark.range(1).select(F.explode(F.array(*map(F.lit, symbols))).alias("symbol")))
    h = F.pmod(F.xxhash64("time", "symbol", F.lit(seed)), F.lit(10_000))
    return t.withColumn("price", F.round(100 + 10 * F.sin(F.unix_micros(F.col("time").cast("timestamp")) / 3.6e9) + h / 5000, 4)).withColumn("volume", (h % 100 + 1).cast("int"))


def continue_series(table: DataFrame, time: str, keys: DataFrame, step: str, until: str, default_start: str) -> DataFrame:
    """Times after the latest of the table up to until, for each of the keys; from default_start if it is empty."""
    spark = table.sparkSession
    last = table.agg(F.max(time)).first()[0]
    start = F.lit(last).cast("timestamp_ntz") + F.expr(f"INTERVAL {step}") if last is not None else F.lit(default_start).cast("timestamp_ntz")
    times = spark.range(1).select(start.alias("a"), F.lit(until).cast("timestamp_ntz").alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias(time))
    return times.crossJoin(keys)
