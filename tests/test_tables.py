"""Chunked tables, continuous aggregates, partial refresh, jobs, notices, constraints."""

from datetime import datetime as D, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import merge
from tidegauge.plans import registry
from tidegauge.plans.cagg import Catalog
from tidegauge.plans.jobs import Channels, Jobs, compression_policy, explain, refresh_policy, retention_policy, timed
from tidegauge.sources import generate as G
from tidegauge.sources.storage import ChunkedTable, pretty_size, route


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def ticks(spark):
    return G.ticks(spark, "2024-01-01 00:00:00", "2024-01-20 00:00:00", "6 HOURS", ["A", "B"])


def test_chunked_table(spark, ticks, tmp_path):
    t = ChunkedTable.create(spark, f"{tmp_path}/t", ticks.schema, "time", "7 days", space=("symbol", 2), rows=ticks)
    assert rows(t.read()) == rows(ticks)
    assert len(t.show_chunks()) == 3
    a, b = "2024-01-03 00:00:00", "2024-01-05 12:00:00"
    assert rows(t.read(a, b)) == rows(ticks.where(f"time >= TIMESTAMP_NTZ '{a}' AND time < TIMESTAMP_NTZ '{b}'"))
    assert t.read(a, b).inputFiles() and len(t.read(a, b).inputFiles()) < len(t.read().inputFiles())
    t.set_compression(["symbol"], ["time"])
    assert t.compress_chunks("2024-01-09 00:00:00") == t.show_chunks()[:1]
    t.add_column("extra", "int")
    assert t.read().where("extra IS NOT NULL").count() == 0 and t.read().count() == ticks.count()
    t.alter_type("volume", "bigint")
    assert dict(t.read().dtypes)["volume"] == "bigint"
    assert t.drop_chunks("2024-01-10 00:00:00") and t.read().agg(F.min("time")).first()[0] == D(2024, 1, 8)
    assert t.chunk_sizes().where("bytes > 0 AND rows > 0").count() == 2
    t.update(F.col("symbol") == "A", {"price": F.lit(1.0)})
    assert t.read().where("symbol = 'A' AND price <> 1").isEmpty()
    t.delete(F.col("symbol") == "A")
    assert t.read().select("symbol").distinct().collect()[0][0] == "B"
    t.vacuum()
    n = t.read().count()
    assert n and t.describe()["segment_by"] == ["symbol"]
    t.truncate()
    assert t.read().count() == 0 and t.show_chunks() == []
    with pytest.raises(ValueError):
        ChunkedTable.create(spark, f"{tmp_path}/t", ticks.schema, "time")


def test_upsert_by_chunk(spark, ticks, tmp_path):
    t = ChunkedTable.create(spark, f"{tmp_path}/u", ticks.schema, "time", "1 day", rows=ticks)
    batch = ticks.where("time = TIMESTAMP_NTZ '2024-01-05 00:00:00'").withColumn("volume", F.lit(7))
    t.upsert(batch, ["time", "symbol"], {"volume": merge.add})
    want = ticks.withColumn("volume", F.when(F.col("time") == F.lit("2024-01-05").cast("timestamp_ntz"), F.col("volume") + 7).otherwise(F.col("volume")))
    assert rows(t.read()) == rows(want)
    t.insert_new(batch, ["time", "symbol"])
    assert t.read().count() == ticks.count()


def test_merge_null_keys(spark):
    old = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    new = spark.createDataFrame([(None, 5), (2, 6)], "k int, v int")
    assert rows(merge.upsert(old, new, ["k"])) == rows(spark.createDataFrame([(None, 5), (1, 2), (2, 6)], "k int, v int"))
    assert rows(merge.insert_new(old, new, ["k"])) == rows(spark.createDataFrame([(None, 1), (1, 2), (2, 6)], "k int, v int"))


def test_constraints(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    child = spark.createDataFrame([(4,)], "sensor_id int")
    with pytest.raises(merge.ConstraintError):
        merge.foreign_key(child, ["sensor_id"], parent, ["id"])
    merge.foreign_key(spark.createDataFrame([(1,), (None,)], "sensor_id int"), ["sensor_id"], parent, ["id"])
    with pytest.raises(merge.ConstraintError):
        merge.check(child, "positive", F.col("sensor_id") < 0)
    with pytest.raises(merge.ConstraintError):
        merge.unique(child, ["sensor_id"], child)


def _aggs():
    return {"n": F.count("*"), "total": F.sum("volume")}


def test_refresh_is_stale_then_fresh_and_idempotent(spark, ticks, tmp_path):
    c = Catalog(spark, f"{tmp_path}/c")
    c.create_table("ticks", ticks.schema, "time", "7 days")
    a = c.create("daily", "ticks", "time", "1 day", ["symbol"], _aggs(), with_data=False)
    c.append("ticks", ticks)
    assert a.read().count() == 0
    a.refresh()
    first = rows(a.read())
    assert first == rows(a.d.over(ticks))
    a.refresh()
    assert rows(a.read()) == first
    live = c.create("live", "ticks", "time", "1 day", ["symbol"], _aggs(), materialized_only=False)
    more = ticks.withColumn("time", F.col("time") + F.expr("INTERVAL 30 DAY"))
    c.append("ticks", more)
    assert rows(live.read()) == rows(a.d.over(ticks.unionByName(more)))
    assert rows(a.read()) == first


def test_partial_refresh_equals_full(spark, ticks, tmp_path):
    c = Catalog(spark, f"{tmp_path}/p")
    c.create_table("ticks", ticks.schema, "time", "7 days")
    c.append("ticks", ticks)
    a = c.create("daily", "ticks", "time", "1 day", ["symbol"], _aggs())
    log = c.enable_partial_refresh("daily")
    late = ticks.where("symbol = 'A' AND time < TIMESTAMP_NTZ '2024-01-03 00:00:00'")
    c.append("ticks", late)
    e = log.entries().collect()
    assert [(r["symbol"], r["status"], r["range_start"], r["range_end"]) for r in e] == [("A", "pending", D(2024, 1, 1), D(2024, 1, 3))]
    c.delete("ticks", (F.col("symbol") == "B") & (F.col("time") < F.lit("2024-01-02").cast("timestamp_ntz")))
    assert log.process(limit=1) == 1 and log.process() == 1 and log.process() == 0
    assert rows(a.read()) == rows(a.d.over(c.tables["ticks"].read()))
    assert {r["status"] for r in log.entries().collect()} == {"completed"}


def _hours(spark, first, last, *more):
    """A row each hour with a zone, and of one key."""
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 HOUR)) AS time").select("time", F.lit("A").alias("symbol"), F.lit(1).alias("volume"), *more)


@pytest.mark.parametrize("width", ["1 day", "1 month"])
def test_refresh_follows_the_zone(spark, tmp_path, width):
    """Ranges of a New York aggregate end where New York's days and months do, over a change of its clocks too."""
    h = _hours(spark, "2024-01-01 00:00:00", "2024-03-20 00:00:00")
    c = Catalog(spark, f"{tmp_path}/z")
    c.create_table("ticks", h.schema, "time", "7 days")
    c.append("ticks", h)
    a = c.create("ny", "ticks", "time", width, ["symbol"], _aggs(), tz="America/New_York")
    want = rows(a.d.over(h))
    assert rows(a.read()) == want
    a.refresh("2024-01-02 00:00:00", "2024-03-12 12:00:00")
    assert rows(a.read()) == want
    log = c.enable_partial_refresh("ny")
    late = h.where("hour(time) = 3 AND time > TIMESTAMP '2024-03-08 00:00:00' AND time < TIMESTAMP '2024-03-12 00:00:00'")
    c.append("ticks", late)
    assert log.process() > 0 and rows(a.read()) == rows(a.d.over(h.unionByName(late)))


def test_reopened_catalog(spark, ticks, tmp_path):
    """Definitions, how far they are filled and what is stale are there after the objects are gone."""
    root = f"{tmp_path}/o"
    c = Catalog(spark, root)
    c.create_table("ticks", ticks.schema, "time", "7 days")
    c.append("ticks", ticks.where("time < TIMESTAMP_NTZ '2024-01-10 12:00:00'"))
    texts = {"n": "count(*)", "total": "sum(volume)"}
    c.create("live", "ticks", "time", "1 day", ["symbol"], texts, with_data=False, materialized_only=False).refresh(None, "2024-01-10 00:00:00")
    c.create("weekly", "live", "bucket", "7 days", [], {"n": "sum(n)"}, with_data=False)
    c.create("columns", "ticks", "time", "1 day", ["symbol"], _aggs())
    c.enable_partial_refresh("columns")
    c.append("ticks", ticks.where("time >= TIMESTAMP_NTZ '2024-01-10 12:00:00'"))
    with pytest.raises(ValueError):
        Catalog.open(spark, root)
    o = Catalog.open(spark, root, {"columns": _aggs()})
    assert o.order() == ["live", "weekly", "columns"]
    want = rows(o.aggregates["live"].d.over(ticks))
    assert rows(o.aggregates["live"].read()) == want
    o.refresh_cascade(name="weekly")
    assert o.aggregates["weekly"].read().agg(F.sum("n")).first()[0] == ticks.count()
    assert o.logs["columns"].process() > 0 and rows(o.aggregates["columns"].read()) == rows(o.aggregates["columns"].d.over(ticks))


def test_partial_refresh_of_moved_rows(spark, ticks, tmp_path):
    """Rows whose key or time changes leave one group and come to another; both are refreshed, and days between aren't."""
    c = Catalog(spark, f"{tmp_path}/m")
    c.create_table("ticks", ticks.schema, "time", "1 day")
    c.append("ticks", ticks)
    a = c.create("daily", "ticks", "time", "1 day", ["symbol"], _aggs())
    log = c.enable_partial_refresh("daily")
    c.update("ticks", (F.col("symbol") == "A") & (F.col("time") < F.lit("2024-01-02").cast("timestamp_ntz")), {"symbol": F.lit("C"), "time": F.col("time") + F.expr("INTERVAL 10 DAY")})
    assert sorted((r["symbol"], r["range_start"], r["range_end"]) for r in log.entries().collect()) == [("A", D(2024, 1, 1), D(2024, 1, 2)), ("C", D(2024, 1, 11), D(2024, 1, 12))]
    log.process()
    assert rows(a.read()) == rows(a.d.over(c.tables["ticks"].read())) and not a.read().where("symbol = 'C'").isEmpty()


def test_only_touched_chunks_are_rewritten(spark, ticks, tmp_path):
    t = ChunkedTable.create(spark, f"{tmp_path}/w", ticks.schema, "time", "1 day", rows=ticks)
    files = lambda: {f for f in t.read().inputFiles()}
    before = files()
    t.update(F.col("time") == F.lit("2024-01-05 06:00:00").cast("timestamp_ntz"), {"price": F.lit(2.0)})
    t.delete(F.col("time") == F.lit("2024-01-07 06:00:00").cast("timestamp_ntz"))
    t.upsert(ticks.where("time = TIMESTAMP_NTZ '2024-01-09 06:00:00'").withColumn("volume", F.lit(777)), ["time", "symbol"])
    gone = {f.split("__chunk=")[1].split("/")[0] for f in before - files()}
    assert gone == {"20240105T000000", "20240107T000000", "20240109T000000"}
    assert t.read().count() == ticks.count() - 2 and t.read().where("volume = 777").count() == 2
    with pytest.raises(RuntimeError):  # the version is there already
        t._commit(t._manifest()[0], t._manifest()[1])


def test_large_chunk_is_split_among_tasks(spark, tmp_path):
    """One chunk of more than the advised size makes several files."""
    d = spark.range(400_000).select(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 80000)").alias("time"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(2 << 20))
    try:
        t = ChunkedTable.create(spark, f"{tmp_path}/l", d.schema, "time", "7 days", rows=d)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(t.show_chunks()) == 1 and len(t.read().inputFiles()) > 3 and t.read().count() == 400_000


def test_cascade_order_and_drop(spark, ticks, tmp_path):
    c = Catalog(spark, f"{tmp_path}/d")
    c.create_table("ticks", ticks.schema, "time", "7 days")
    c.append("ticks", ticks)
    c.create("h", "ticks", "time", "1 hour", ["symbol"], _aggs())
    up = {"n": F.sum("n"), "total": F.sum("total")}
    c.create("d", "h", "bucket", "1 day", ["symbol"], up)
    c.create("m", "d", "bucket", "1 month", ["symbol"], up)
    assert c.order() == ["h", "d", "m"] and c.order("d") == ["d", "m"]
    assert rows(c.aggregates["m"].read().select("n")) == rows(ticks.groupBy("symbol").count().select("count"))
    with pytest.raises(ValueError):
        c.drop("h")
    assert c.describe().count() == 4
    assert c.drop("h", cascade=True) == ["m", "d", "h"]


def test_jobs(spark, ticks, tmp_path):
    c = Catalog(spark, f"{tmp_path}/j")
    t = c.create_table("ticks", ticks.schema, "time", "7 days")
    c.append("ticks", ticks)
    a = c.create("daily", "ticks", "time", "1 day", ["symbol"], _aggs(), with_data=False)
    jobs, now = Jobs(), D(2024, 1, 15)
    refresh_policy(jobs, a, "5 days", "1 day", "1 hour")
    retention_policy(jobs, t, "14 days")
    compression_policy(jobs, t, "7 days")
    bad = jobs.add(lambda config, when: 1 / 0, "1m", {"n": 1})
    assert len(jobs.run_once(now)) == 4 and jobs.run_once(now) == []
    assert a.read().agg(F.min("bucket"), F.max("bucket")).first() == (D(2024, 1, 10), D(2024, 1, 13))
    assert jobs.jobs[bad].failures == 1 and jobs.stats(spark).where("total_failures = 1").count() == 1
    assert jobs.run_once(now + timedelta(minutes=1)) == [bad]
    jobs.alter(bad, every="1 day")
    jobs.delete(bad)
    with pytest.raises(ValueError):
        jobs.alter(1000, nothing=1)


def test_notices_route_and_plans(spark, ticks, tmp_path):
    got, ch = [], Channels()
    ch.listen("candles", got.append)
    assert ch.notify_rows("candles", ticks.limit(2)) == 2 and len(got) == 2 and '"symbol"' in got[0]
    with pytest.raises(ValueError):
        ch.notify_rows("candles", ticks, most=1)
    route(ticks, f"{tmp_path}/r", "symbol")
    assert rows(spark.read.parquet(f"{tmp_path}/r").groupBy("symbol").count()) == rows(ticks.groupBy("symbol").count())
    assert "Scan" in explain(spark.read.parquet(f"{tmp_path}/r")) and timed(ticks) >= 0
    assert (pretty_size(10), pretty_size(20480)) == ("10 bytes", "20 kB")


def test_pushdown(spark, small):
    plan = explain(spark.read.parquet(f"{small}/lineitem.parquet").where("l_orderkey < 10").select("l_orderkey", "l_tax"))
    assert "LessThan(l_orderkey,10)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in plan


@pytest.mark.parametrize("name", ["SNK8_truncate", "STO2_second_dimension", "STO5_compressed"])
def test_all_users_are_read_back(spark, small, name):
    """Rows of every user come back, and a filter by user is pushed to the files."""
    got = registry.QUERIES[name](spark, small)
    assert rows(got) == rows(spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "user_id", "value"))
    assert "EqualTo(user_id,17)" in explain(got.where("user_id = 17"))


def test_bounds_of_chunks_are_those_that_spark_gives(spark):
    from tidegauge.functions.bucket import parse_width, time_bucket
    from tidegauge.sources.storage import _bounds

    times = spark.sql("SELECT timestamp_ntz'1969-12-01 00:00:00' + make_dt_interval(id * 11, id % 24, id % 60, 0) AS t FROM range(500)")
    for text in ("1 day", "7 days", "35 minutes", "1 month", "3 months", "1 year"):
        w = parse_width(text)
        step = F.expr(f"INTERVAL '{w.months}' MONTH") if w.months else F.expr(f"INTERVAL '{w.micros / 1e6:f}' SECOND")
        b = times.select(time_bucket(text, "t").alias("b")).distinct()
        got = b.select(F.date_format("b", "yyyyMMdd'T'HHmmss").alias("n"), F.col("b").cast("string").alias("x"), (F.col("b") + step).cast("string").alias("y")).collect()
        assert all(_bounds(r["n"], w) == (r["x"], r["y"]) for r in got)
