"""Queries through triggers as streams, notices, jobs, DDL, statistics and plans; each has a scratch folder in the shared one."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from tidegauge.functions.scalars import format_sql, qualify_reading
from tidegauge.plans.cagg import scratch
from tidegauge.plans.jobs import Channels, Jobs, explain, timed, watch
from tidegauge.plans.registry import query, table
from tidegauge.sources.storage import ChunkedTable
from tidegauge.streaming import stateful


def _rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _arrivals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All events as a stream of several micro-batches in order of time, and as a table."""
    e, folder = _rows(spark, sf_dir), scratch(spark)
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (e.where(F.col("ts") < half), e.where((F.col("ts") >= half) | F.col("ts").isNull())):
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder), e


def _ended(started) -> None:
    started.awaitTermination()
    if started.exception() is not None:
        raise started.exception()


@query("SNK9_notify", "SELECT json_object('event_type', event_type, 'n', count(*))::VARCHAR AS payload FROM events GROUP BY event_type")
def snk9(spark, sf_dir):
    got, channels = [], Channels()
    channels.listen("counts", got.append)
    channels.notify_rows("counts", _rows(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")))
    return spark.createDataFrame([(p,) for p in got], "payload string")


@query("ST1_tumbling_stream", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY ALL")
def st1(spark, sf_dir):
    stream, _ = _arrivals(spark, sf_dir)
    out = scratch(spark)
    candles = stateful.candles(stream.withColumn("volume", F.lit(1)), "1 hour", ["event_type"], "ts", "value", "volume")
    # each batch gives the state of all windows so far, under its own number; the last is what holds
    seen = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        seen.append(number)

    _ended(candles.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/{max(seen)}")


@query("ST4_stored_delta", "SELECT event_id, user_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 0), 6) AS delta FROM events")
def st4(spark, sf_dir):
    stream, e = _arrivals(spark, sf_dir)
    out = scratch(spark)
    rows = stateful.deltas(stream.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "value")
    _ended(stateful.run_batches(rows, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/state"))
    return spark.read.parquet(f"{out}/rows").select("event_id", "user_id", F.round("delta", 6).alias("delta"))


@query("ST7_statement_triggers", "SELECT event_type, count(*) AS inserted FROM events GROUP BY event_type")
def st7(spark, sf_dir):
    """What each statement's new rows hold, noted by a function that gets them all at once."""
    stream, _ = _arrivals(spark, sf_dir)
    out = scratch(spark)

    def note(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/log/batch={number}")

    _ended(stateful.run_batches(stream, note, f"{out}/state"))
    return spark.read.parquet(f"{out}/log").groupBy("event_type").agg(F.sum("n").alias("inserted"))


@query("ST8_normalised_insert", "SELECT event_id, ts, CASE WHEN event_type = 'error' OR value - 5 < 0 THEN 'Discard' ELSE 'OK' END AS qualification FROM events")
def st8(spark, sf_dir):
    stream, e = _arrivals(spark, sf_dir)
    out = scratch(spark)
    t = ChunkedTable.create(spark, f"{out}/t", "event_id long, ts timestamp_ntz, qualification string", "ts", "7 days")
    status = F.when(F.col("event_type") == "error", "bad").otherwise("good")
    ok = stream.select("event_id", "ts", qualify_reading(F.col("value") - 5, status).alias("qualification"))
    # by key, so that a batch that is tried again adds nothing
    _ended(stateful.run_batches(ok, lambda b, n: t.insert_new(b, ["ts", "event_id"]), f"{out}/state"))
    return t.read()


@query("ST9_scheduled_job", "SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-05'")
def st9(spark, sf_dir):
    """A daily job that copies the day before's events of the type in its config, run for three days."""
    e, jobs = _rows(spark, sf_dir), Jobs()
    t = ChunkedTable.create(spark, scratch(spark), e.schema, "ts", "1 day")

    def copy(config, now):
        a, b = (F.lit(str(x)).cast("timestamp_ntz") for x in (now - timedelta(days=1), now))
        t.append(e.where((F.col("ts") >= a) & (F.col("ts") < b) & (F.col("event_type") == config["type"])))

    n = jobs.add(copy, "1 day", {"type": "click"}, datetime(2024, 1, 3))
    for day in (2, 3, 4, 5):
        jobs.run_once(datetime(2024, 1, day))
    if jobs.jobs[n].failures:
        raise RuntimeError(jobs.jobs[n].last_error)
    return t.read().select("event_id")


@query("ST11_polling", "SELECT i::INTEGER AS poll, (SELECT count(*) FROM events) * i AS n FROM range(1, 4) x(i)")
def st11(spark, sf_dir):
    e = _rows(spark, sf_dir)
    t = ChunkedTable.create(spark, scratch(spark), e.schema, "ts", "7 days")

    def poll():
        t.append(e)
        return t.read().count()

    return spark.createDataFrame([(i, n) for i, n in enumerate(watch(poll, 3, 0.0), 1)], "poll int, n long")


@query("STO3_distributed", "SELECT event_id, ts, user_id, event_type, value FROM events")
def sto3(spark, sf_dir):
    """A table dealt by time and by a hash of a second column, and read back whole."""
    e = _rows(spark, sf_dir)
    return ChunkedTable.create(spark, scratch(spark), e.schema, "ts", "7 days", space=("user_id", 8), rows=e).read()


@query("STO13_versions", "SELECT unnest(['engine', 'shuffle partitions']) AS name, true AS known")
def sto13(spark, sf_dir):
    facts = [("engine", spark.sql("SELECT version()").first()[0]), ("shuffle partitions", spark.conf.get("spark.sql.shuffle.partitions"))]
    return spark.createDataFrame([(n, bool(v)) for n, v in facts], "name string, known boolean")


@query("STO15_explain", "SELECT true AS filter_pushed, true AS columns_pruned, true AS timed")
def sto15(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_orderkey < 10").select("l_orderkey", "l_tax")
    plan = explain(d)
    return spark.createDataFrame([("LessThan(l_orderkey,10)" in plan, "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan, timed(d) >= 0)], "filter_pushed boolean, columns_pruned boolean, timed boolean")


@query("STO16_statistics", "SELECT 'events' AS name, count(*) AS rows, '77' AS setting FROM events")
def sto16(spark, sf_dir):
    """Statistics of a table that are gathered anew, and a session setting that is put back."""
    name, key = f"statistics_{uuid.uuid4().hex}", "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.sql(f"SET {key}=77")
    setting = spark.sql(f"SET {key}").first()["value"]
    spark.conf.set(key, old)
    _rows(spark, sf_dir).write.option("path", scratch(spark)).saveAsTable(name)
    try:
        spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS")
        said = next(r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect() if r["col_name"] == "Statistics")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.createDataFrame([("events", int(said.split("bytes, ")[1].split(" rows")[0]), setting)], "name string, rows long, setting string")


@query("STO17_ddl", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY event_type")
def sto17(spark, sf_dir):
    """Schema, table and view that are made, used and dropped, twice over where that must not matter."""
    s = f"ddl_{uuid.uuid4().hex}"
    _rows(spark, sf_dir).createOrReplaceTempView(f"{s}_events")
    try:
        for _ in range(2):
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {s}")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {s}.t (event_type STRING, value DOUBLE) USING parquet LOCATION '{scratch(spark)}'")
        spark.sql(f"INSERT INTO {s}.t SELECT event_type, value FROM {s}_events")
        spark.sql(f"CREATE OR REPLACE VIEW {s}.v AS SELECT event_type, count(*) AS n FROM {s}.t WHERE value > 50 GROUP BY event_type")
        got = [tuple(r) for r in spark.sql(f"SELECT * FROM {s}.v").collect()]  # a row for each type
    finally:
        for what in (f"VIEW IF EXISTS {s}.v", f"TABLE IF EXISTS {s}.t", f"SCHEMA IF EXISTS {s} CASCADE", f"VIEW IF EXISTS {s}_events"):
            spark.sql(f"DROP {what}")
    if spark.catalog.databaseExists(s):
        raise RuntimeError(f"{s} is still there")
    return spark.createDataFrame(got, "event_type string, n long")


@query("SC3_format", """SELECT event_id, 'UPDATE "Log Of" SET ' || event_type || ' = ''it''''s ' || user_id || ''' WHERE x = NULL -- 100%' AS statement FROM events""")
def sc3(spark, sf_dir):
    text = F.concat(F.lit("it's "), F.col("user_id").cast("string"))
    return _rows(spark, sf_dir).select("event_id", format_sql("UPDATE %I SET %I = %L WHERE x = %L -- %s%%", F.lit("Log Of"), F.col("event_type"), text, F.lit(None).cast("string"), F.lit(100)).alias("statement"))
