"""Streams over files give what the batch form gives."""

from datetime import datetime as D

from pyspark.sql import functions as F

from tidegauge.operators import windows as W
from tidegauge.streaming import stateful


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def stream(spark, path, df, parts=3):
    """df in so many files, read as a stream of one file a batch."""
    for i in range(parts):
        df.where(F.pmod(F.col("n"), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(query_df, name, tmp_path, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return query_df.sparkSession.table(name)


def _events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").select(F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.lit(1).alias("volume"))


def test_candles(spark, small, tmp_path):
    e = _events(spark, small)
    got = collect(stateful.candles(stream(spark, f"{tmp_path}/in", e), "1 hour", ["symbol"], delay="10 days"), "candles_s", tmp_path, "complete")
    assert rows(got) == rows(stateful.candles(e, "1 hour", ["symbol"]))


def test_closed_candles(spark, tmp_path):
    at = lambda s: D(2024, 1, 1, 10, 9, s)
    data = [(0, at(0), "X", 10.1, 100), (1, at(0), "X", 10.0, 100), (2, at(0), "X", 10.3, 200), (3, at(1), "X", 10.0, 300), (4, at(1), "X", 14.0, 200), (5, at(1), "X", 8.3, 200), (6, at(2), "X", 9.0, 1)]
    d = spark.createDataFrame(data, "n int, time timestamp, symbol string, price double, volume int").withColumn("time", F.timestamp_add("MILLISECOND", F.col("n"), "time"))
    got = collect(stateful.candles(stream(spark, f"{tmp_path}/in", d, 1), "1s", ["symbol"], delay="0 seconds"), "closed_s", tmp_path)
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got.orderBy("bucket").collect()] == [(10.1, 10.3, 10.0, 10.3, 400), (10.0, 14.0, 8.3, 8.3, 700)]


def test_deltas(spark, tmp_path):
    d = spark.createDataFrame([(i, D(2024, 1, 1, 0, i), f"b{i % 2}", float(i * i)) for i in range(12)], "n int, time timestamp, uid string, charge double")
    d.where("n < 6").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    out = stateful.deltas(s, "uid", "time", "charge")
    assert rows(collect(out, "deltas_s", tmp_path)) == rows(W.delta(d.where("n < 6"), ["uid"], ["time"], "charge"))
    d.where("n >= 6").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    q = out.writeStream.foreachBatch(lambda b, i: got.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/again").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(got, key=str) == rows(W.delta(d, ["uid"], ["time"], "charge"))


def test_since_mark(spark, tmp_path):
    at = lambda m: D(2024, 1, 1, 8, m)
    d = spark.createDataFrame([(0, at(0), "d", "A"), (1, at(15), "d", "B"), (2, at(20), "e", "B")], "n int, time timestamp, dev string, key string")
    got = collect(stateful.since_mark(stream(spark, f"{tmp_path}/in", d, 1), "dev", "time", "key", "A", "B"), "since_s", tmp_path)
    assert [(r["key"], r["mark_time"], r["time"], r["seconds"]) for r in got.collect()] == [("d", at(0), at(15), 900.0)]


def test_batches_and_alerts(spark, tmp_path):
    d = spark.createDataFrame([(i, 90 + i) for i in range(14)], "n int, charge int")
    seen, alarms = [], []

    def call(batch, i):
        seen.extend(r[0] for r in batch.select("n").collect())
        alarms.extend(r[0] for r in stateful.alerts(batch, "charge > 102").select("n").collect())

    stateful.run_batches(stream(spark, f"{tmp_path}/in", d), call, f"{tmp_path}/c").awaitTermination()
    assert sorted(seen) == list(range(14)) and alarms == [13]
