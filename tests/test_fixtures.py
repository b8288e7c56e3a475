"""Answers worked out by hand for small literal inputs."""

from datetime import UTC, datetime as D
from time import monotonic

import numpy as np
from pyspark.sql import Window, functions as F

from tidegauge.functions import aggs as A, counters as C, scalars, states as S, timevector as V
from tidegauge.functions.bucket import bucket_start, parse_width, time_bucket
from tidegauge.operators import joins as J, windows as W


def frame(spark, kind, *rows):
    return spark.createDataFrame(list(rows), kind)


def t(text):
    return D.fromisoformat(text)


def test_bucket_join_product(spark):
    at = lambda x: t(f"2024-01-01 {x}")
    a = frame(spark, "t timestamp_ntz, v int", (at("10:10:10"), 2), (at("10:20:20"), 3), (at("10:30:00"), 4))
    b = frame(spark, "u timestamp_ntz, w int", (at("10:10:30"), 5), (at("10:20:21"), 6), (at("10:30:01"), 7))
    got = J.bucket_join(a, b, "1m", "t", "u").selectExpr("u", "v * w AS p").collect()
    assert sorted(map(tuple, got)) == [(at("10:10:30"), 10), (at("10:20:21"), 18), (at("10:30:01"), 28)]


def test_histogram(spark):
    d = frame(spark, "v double", *[(float(x),) for x in (1, 2, 3, 4, 5)])
    assert d.agg(A.histogram("v", 0, 20, 2).alias("h")).first()["h"] == [0, 5, 0, 0]


def test_interval_groups(spark):
    d = frame(spark, "uid string, t timestamp_ntz", ("a", t("2024-01-01 00:00:00")), ("a", t("2024-01-01 02:00:00")), ("b", t("2024-01-01 00:00:00")), ("b", t("2024-01-01 01:00:00")))
    got = W.gaps(d, ["uid"], "t", "1 HOUR").collect()
    assert [(r["uid"], r["gap_seconds"]) for r in got] == [("a", 7200.0)]


def test_least_gap(spark):
    at = lambda x: t(f"2024-01-01 {x}")
    d = frame(spark, "g int, time timestamp_ntz, key string", (1, at("08:00:00"), "A"), (1, at("08:15:00"), "B"), (1, at("07:00:00"), "B"))
    got = J.last_before(d, ["g"], "time", F.col("key") == "A").where("key = 'B' AND mark_time IS NOT NULL").collect()
    assert [(r["mark_time"], r["time"]) for r in got] == [(at("08:00:00"), at("08:15:00"))]


def test_average_cost(spark):
    rows = [(1, 1.0, 100.0, 0.0, 0.0), (2, 2.0, 200.0, 0.0, 0.0), (3, 0.0, 0.0, 0.5, 58.333333), (4, 0.0, 0.0, 1.5, 175.0), (5, 3.0, 310.0, 0.0, 0.0), (6, 0.0, 0.0, 2.0, 220.0)]
    d = frame(spark, "k int, b double, c double, s double, p double", *rows).withColumn("token", F.lit("x"))
    got = W.avg_cost_pnl(d, ["token"], ["k"], F.col("b"), F.col("c"), F.col("s"), F.col("p")).orderBy("k").collect()
    assert [r["balance"] for r in got] == [1.0, 3.0, 2.5, 1.0, 4.0, 2.0]
    assert [round(r["realized"], 4) for r in got] == [0, 0, 8.3333, 25.0, 0, 16.6667]
    assert round(got[-1]["cumulative"], 4) == 50.0


def test_zone_candles(spark):
    ticks = [("2024-01-30 22:10:00", 1000, 1), ("2024-01-30 23:10:00", 1100, 2), ("2024-01-30 23:40:00", 1200, 3), ("2024-01-31 00:10:00", 1300, 4), ("2024-01-31 04:10:00", 1400, 5), ("2024-01-31 05:10:00", 1500, 6), ("2024-01-31 15:10:00", 1600, 7), ("2024-01-31 20:10:00", 1700, 8)]
    d = frame(spark, "time timestamp_ntz, price int, volume int", *[(t(a), b, c) for a, b, c in ticks]).withColumn("time", F.col("time").cast("timestamp"))

    def days(zone):
        g = d.groupBy(time_bucket("1 day", "time", zone).cast("timestamp_ntz").alias("b")).agg(A.candlestick_agg("time", "price", "volume").alias("c"))
        return sorted(map(tuple, g.select("b", "c.open", "c.high", "c.low", "c.close", "c.volume").collect()))

    assert days("America/New_York") == [(t("2024-01-30 05:00:00"), 1000, 1400, 1000, 1400, 15.0), (t("2024-01-31 05:00:00"), 1500, 1700, 1500, 1700, 21.0)]
    assert days("Europe/Berlin") == [(t("2024-01-29 23:00:00"), 1000, 1000, 1000, 1000, 1.0), (t("2024-01-30 23:00:00"), 1100, 1700, 1100, 1700, 35.0)]


def test_counter_rate_and_reset(spark):
    at = [t("2024-01-01 12:00:00"), t("2024-01-01 12:01:00"), t("2024-01-01 12:02:00"), t("2024-01-01 12:04:00")]
    d = frame(spark, "k int, time timestamp_ntz, v bigint", *[(1, a, v) for a, v in zip(at, (0, 60_000, 120_000, 240_000), strict=True)])
    assert [r["rate"] for r in W.counter_rate(d, ["k"], "time", "v").orderBy("time").collect()] == [None, 1000.0, 1000.0, 1000.0]
    d = frame(spark, "k int, time timestamp_ntz, v bigint", *[(1, a, v) for a, v in zip(at, (100, 200, 50, 80), strict=True)])
    s = d.groupBy("k").agg(C.counter_agg("time", "v").alias("s")).select("s.*").first()
    assert (s["delta"], s["resets"], s["first"], s["last"]) == (180.0, 1, 100.0, 80.0)
    wrapped = d.groupBy("k").agg(C.counter_agg("time", "v", 256).alias("s")).select("s.delta").first()
    assert wrapped["delta"] == 100 + (256 - 200 + 50) + 30


def test_interpolated_delta(spark):
    rows = [("00:45:00", 19), ("01:15:00", 36), ("01:45:00", 46), ("02:30:00", 61)]
    d = frame(spark, "time timestamp_ntz, v double", *[(t(f"2024-01-01 {a}"), float(v)) for a, v in rows]).withColumn("k", F.lit(1))
    g = d.groupBy("k", bucket_start("1 hour", "time").alias("b")).agg(C.counter_agg("time", "v").alias("s"))
    w = Window.partitionBy("k").orderBy("b")
    g = g.withColumns({"p": F.lag("s").over(w), "n": F.lead("s").over(w)})
    got = [round(r["x"], 6) for r in g.select("b", C.interpolated_delta("s", "b", 3600, "p", "n").alias("x")).orderBy("b").collect()]
    assert got == [8.5, 8.5 + 10 + 5, 10.0]


def test_state_timeline_and_durations(spark):
    T = t("2024-01-02 00:00:00")
    d = frame(spark, "who string, time timestamp_ntz, status string", ("alice", t("2024-01-01 00:00:00"), "joined"), ("alice", t("2024-01-01 23:00:00"), "log in"), ("alice", T, "log out"))
    g = d.groupBy("who").agg(S.state_agg("time", "status").alias("s"))
    got = g.select(F.inline(S.state_timeline("s"))).collect()
    assert [(r["state"], (r["end_time"] - r["start_time"]).total_seconds()) for r in got] == [("joined", 82800.0), ("log in", 3600.0), ("log out", 0.0)]
    e = frame(spark, "time timestamp_ntz, s int", (t("2024-08-01 00:00:00"), 1), (t("2024-08-22 12:55:00"), 0), (t("2024-08-23 09:50:00"), 0)).withColumn("k", F.lit(1))
    g = e.groupBy("k", bucket_start("1 hour", "time").alias("b")).agg(S.state_agg("time", "s").alias("s"))
    w = Window.partitionBy("k").orderBy("b")
    g = g.withColumns({"p": F.lag("s").over(w), "n": F.lead("s").over(w)})
    on = [r["x"] / 60 for r in g.select("b", S.interpolated_duration_in("s", 1, "b", 3600, "p", "n").alias("x")).orderBy("b").collect()]
    assert on == [60.0, 55.0, 0.0]


def test_states_of_a_large_group(spark):
    """The rows of a group are sorted once, not again for each of them: that took 82 s for these."""
    n = 12_000
    d = spark.range(n, numPartitions=4).select(F.timestamp_seconds(1704067200 + F.pmod(F.col("id") * 4999, F.lit(n))).cast("timestamp_ntz").alias("time"), F.when(F.pmod(F.col("id") * 4999, F.lit(n)) % 5 < 3, "on").alias("s"))
    began = monotonic()
    g = d.groupBy().agg(S.state_agg("time", "s").alias("s"))
    got = g.select(F.size("s.changes"), F.slice("s.changes", 1, 3), "s.last_time", S.duration_in("s", "on")).first()
    assert monotonic() - began < 20
    at = lambda x: D.fromtimestamp(1704067200 + x, UTC).replace(tzinfo=None)
    assert got[0] == 2 * n // 5 and [tuple(x) for x in got[1]] == [(at(0), "on"), (at(3), None), (at(5), "on")]
    assert got[2:] == (at(n - 1), 3 * n / 5)


def test_alignment(spark):
    a, b = frame(spark, "t int, x int", (1, 3), (2, 2)), frame(spark, "t int, y int", (2, 5), (3, 4))
    assert sorted(map(tuple, J.full_outer_align([a, b], "t").collect()), key=str) == [(1, 3, None), (2, 2, 5), (3, None, 4)]


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    """Many queries over many blocks, with ties, a null vector and one of another length; nothing is sent to all."""
    monkeypatch.setattr(J, "QUERY_BLOCK", 7)
    monkeypatch.setattr(J, "ITEM_BLOCK", 11)
    g = np.random.default_rng(1).integers(0, 3, (60, 3)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(g)] + [(60, None), (61, [1.0])]
    d = frame(spark, "id bigint, v array<double>", *rows)
    got = J.nearest_vectors(d.where("id % 2 = 0 AND id < 60"), d, "v", "id", "id", 4)
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString() and "Join Cross" not in got._jdf.queryExecution().toString()
    want = [(q, i, r + 1) for q in range(0, 60, 2) for r, i in enumerate(sorted(range(60), key=lambda i: (np.sqrt(((g[i] - g[q]) ** 2).sum()), i))[:4])]
    assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in got.collect()) == sorted(want)
    few = J.nearest_vectors(d.where("id = 0"), d.where("id >= 59"), "v", "id", "id", 4).orderBy("rank").collect()
    assert [(r["item_id"], r["distance"] is None) for r in few] == [(59, False), (60, True), (61, True)]
    assert J.nearest_vectors(d.limit(0), d, "v", "id", "id", 4).count() == 0


def test_delta(spark):
    d = frame(spark, "uid string, n int, charge int", ("b1", 1, 100), ("b1", 2, 102), ("b1", 3, 106))
    assert [r["delta"] for r in W.delta(d, ["uid"], ["n"], "charge").orderBy("n").collect()] == [0, 2, 4]


def test_qualify(spark):
    d = frame(spark, "value double, status string, flag boolean", (10.0, "ok", True), (-1.0, "ok", False), (5.0, "bad", None), (None, None, True))
    got = d.select(scalars.qualify_reading("value", "status"), scalars.qualify_flagged("value", "flag")).collect()
    assert [tuple(r) for r in got] == [("OK", "OK"), ("Discard", "Discard"), ("Discard", "OK"), ("OK", "Discard")]


def test_mode_or_average(spark):
    d = frame(spark, "k int, v string", (1, "10"), (1, "20"), (1, "30"), (2, "x"), (2, "x"), (2, "1"))
    assert sorted(map(tuple, d.groupBy("k").agg(A.mode_or_avg("v")).collect())) == [(1, "20.0"), (2, "x")]


def test_first_time(spark):
    d = frame(spark, "time timestamp_ntz, tag string", (t("2024-01-01 12:45:00"), "1"), (t("2024-01-01 12:50:00"), "1"), (t("2024-01-01 13:05:00"), "1"))
    got = d.groupBy(time_bucket("1 h", "time").alias("b"), "tag").agg(A.first("time", "time").alias("f"))
    assert sorted(r["f"] for r in got.collect()) == [t("2024-01-01 12:45:00"), t("2024-01-01 13:05:00")]


def test_lttb():
    x = np.arange(0, 75, 15, dtype=float)
    y = np.array([20.0, 25.0, 22.0, 23.0, 21.0])
    assert V.lttb_indexes(x, y, 3).tolist() == [0, 1, 4]
    assert V.lttb_indexes(x, y, 5).tolist() == [0, 1, 2, 3, 4]
    big = V.lttb_indexes(np.arange(1000.0), np.sin(np.arange(1000.0)), 40)
    assert len(big) == 40 and len(set(big.tolist())) == 40 and big[0] == 0 and big[-1] == 999


def test_lttb_all(spark):
    d = frame(spark, "time timestamp_ntz, id string, power double, humidity double", *[(t(f"2024-01-01 00:{m:02d}:00"), s, float((m * 7) % 11), float(m)) for m in range(0, 60, 5) for s in "ab"])
    got = V.lttb_all(d, 4, group="id")
    assert got.columns == ["id", "time", "power", "humidity"] and got.groupBy("id").count().where("count = 4").count() == 2
    assert V.lttb_all(d, 4, ["power"], "humidity > 20", "id").where("minute(time) <= 20").isEmpty()


def test_persian(spark):
    d = frame(spark, "d string", ("2024-03-20",), ("2024-03-25",), ("2024-04-20",)).select(scalars.persian_date(F.col("d").cast("date")).alias("p")).select("p.*")
    assert [tuple(r) for r in d.collect()] == [(1402, 1, 1), (1402, 1, 6), (1402, 2, 1)]


def test_persian_day_by_day(spark):
    """Fifty years of the day-number arithmetic, and the new years of the calendar itself."""

    def want(day):
        n = day.toordinal() + 1721425 - 2121445
        y = 474 + 33 * (n // 12053) + 4 * (n % 12053 // 1461)
        n = n % 12053 % 1461
        y, n = (y + (n - 1) // 365, (n - 1) % 365) if n >= 366 else (y, n)
        return (y, 1 + n // 31, 1 + n % 31) if n < 186 else (y, 7 + (n - 186) // 30, 1 + (n - 186) % 30)

    d = spark.sql("SELECT explode(sequence(DATE '1990-01-01', DATE '2040-01-01', INTERVAL 1 DAY)) AS d").select("d", scalars.persian_date("d").alias("p")).collect()
    assert len(d) > 18000 and all(tuple(r["p"]) == want(r["d"]) for r in d)
    years = {"2020-03-20": 1399, "2021-03-21": 1400, "2022-03-21": 1401, "2023-03-21": 1402, "2024-03-20": 1403, "2025-03-21": 1404, "2026-03-21": 1405}
    d = frame(spark, "d string", *[(k,) for k in years]).select("d", scalars.persian_date(F.col("d").cast("date"), legacy=False).alias("p"), scalars.persian_date(F.col("d").cast("date") - F.expr("INTERVAL 1 DAY"), legacy=False).alias("q"))
    for r in d.collect():
        y = years[r["d"]]
        assert tuple(r["p"]) == (y, 1, 1) and tuple(r["q"])[:2] == (y - 1, 12) and r["q"]["d"] in (29, 30)


def test_stats_far_from_zero(spark):
    """Values near a thousand million lose no digits, in one state or merged from many."""
    d = spark.range(1000).selectExpr("id % 7 AS g", "1e9 + id % 10 AS y", "2e9 + (id % 10) * 3 + (id % 3) * 0.1 AS x").selectExpr("g", "double(y) AS y", "double(x) AS x")
    want = d.agg(F.corr("y", "x").alias("r"), F.covar_samp("y", "x").alias("c")).first()
    parts = d.groupBy("g").agg(A.stats_agg("y", "x").alias("s")).agg(A.rollup_stats("s").alias("s"))
    for got in (d.agg(A.stats_agg("y", "x").alias("s")), parts):
        r = got.select(A.stats_corr("s").alias("r"), A.stats_covariance("s").alias("c")).first()
        assert abs(r["r"] - want["r"]) < 1e-6 and abs(r["c"] - want["c"]) < 1e-4


def test_latest_per_key(spark):
    d = frame(spark, "k string, n int, v string", ("a", 1, "x"), ("a", 3, None), ("b", 2, "z"))
    assert sorted(map(tuple, W.latest(d, ["k"], "n").collect())) == [("a", 3, None), ("b", 2, "z")]


def test_widths_and_buckets(spark):
    assert parse_width("1m").micros == 60_000_000 and parse_width("3 months").months == 3 and parse_width("1 day 12 hours").micros == 129_600_000_000
    for bad in ("", "x", "1 month 1 day", "0 s"):
        try:
            parse_width(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    d = frame(spark, "t timestamp_ntz", (t("1999-12-31 23:59:59.5"),), (t("2024-02-29 12:00:00"),), (t("1969-07-01 00:00:00"),))
    for w in ("35m", "1 week", "10s", "1 day"):
        a, b = (sorted(r[0] for r in d.select(f(w, "t").cast("timestamp_ntz")).collect()) for f in (time_bucket, bucket_start))
        assert a == b


def test_subtract(spark):
    at = lambda x: t(f"2024-01-01 {x:02d}:00:00")
    base = frame(spark, "k int, s timestamp_ntz, e timestamp_ntz", (1, at(0), at(10)), (2, at(0), None))
    cut = frame(spark, "k int, s timestamp_ntz, e timestamp_ntz", (1, at(2), at(4)), (1, at(3), at(5)), (2, at(1), at(2)))
    got = sorted(map(tuple, S.subtract_intervals(base, cut, ["k"], "s", "e").collect()), key=str)
    assert got == sorted([(1, at(0), at(2)), (1, at(5), at(10)), (2, at(0), at(1)), (2, at(2), None)], key=str)


def test_rollup_of_rollup(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    m = e.groupBy(time_bucket("1m", "ts").alias("b")).agg(A.candlestick_agg("ts", "value", "user_id").alias("c"))
    h = m.groupBy(time_bucket("1h", "b").alias("b2")).agg(A.rollup_candlestick("c").alias("c"))
    a = h.groupBy(time_bucket("1 day", "b2").alias("b3")).agg(A.rollup_candlestick("c").alias("c")).select("b3", "c.open", "c.high", "c.high_time", "c.low", "c.low_time", "c.close", "c.volume")
    b = e.groupBy(time_bucket("1 day", "ts").alias("b3")).agg(A.candlestick_agg("ts", "value", "user_id").alias("c")).select("b3", "c.open", "c.high", "c.high_time", "c.low", "c.low_time", "c.close", "c.volume")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_percentile_rank(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    s = e.groupBy("event_type").agg(A.percentile_agg("value").alias("s")).agg(A.rollup_percentile("s").alias("s"))
    approx = s.select(A.approx_percentile_rank(F.lit(50.0), "s")).first()[0]
    exact = e.agg(F.avg((F.col("value") <= 50).cast("double"))).first()[0]
    assert abs(approx - exact) < 0.05
