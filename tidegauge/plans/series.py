"""Aggregates, buckets, windows, counters, states and time vectors."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidegauge.functions import aggs as A, counters as C, states as S, timevector as V
from tidegauge.functions.bucket import time_bucket
from tidegauge.functions.scalars import array_length
from tidegauge.operators import joins as J, windows as W
from tidegauge.plans.registry import query, sql, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


sql("AG1_basic", "SELECT event_type, count(*) AS n, count(value) AS nv, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM {events} GROUP BY event_type")
sql("AG2_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM {events} GROUP BY event_type")
sql("AG3_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, max(value) FILTER (WHERE event_type <> 'error') AS best FROM {events} GROUP BY user_id")
sql("AG4_conditional_count", "SELECT l_shipmode_ AS mode, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS n FROM (SELECT l_returnflag AS l_shipmode_, l_discount FROM {lineitem}) x GROUP BY l_shipmode_")


@query("AG5_first_last", "SELECT user_id, arg_min(value, ts) AS f, arg_max(value, ts) AS l, arg_min(ts, ts) AS t FROM events GROUP BY user_id")
def ag5(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(A.first("value", "ts").alias("f"), A.last("value", "ts").alias("l"), A.first("ts", "ts").alias("t"))


@query("AG7_cube", "SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, event_type AS symbol, arg_min(value, ts) AS open, max(value) AS high, count(*) AS n, grouping(time_bucket(INTERVAL '1 day', ts), event_type)::BIGINT AS level FROM events GROUP BY CUBE (time_bucket(INTERVAL '1 day', ts), event_type)")
def ag7(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("bucket", time_bucket("1 day", "ts")).withColumnRenamed("event_type", "symbol")
    return e.cube("bucket", "symbol").agg(A.first("value", "ts").alias("open"), F.max("value").alias("high"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


sql("AG8_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 1000000")


@query("AG9_ordered_arrays", "SELECT user_id, array_to_string(list(event_type ORDER BY ts), ',') AS kinds, len(list(event_id))::INTEGER AS n FROM events GROUP BY user_id")
def ag9(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy("user_id").agg(A.ordered_values("event_type", "ts").alias("k"))
    return g.select("user_id", F.array_join("k", ",").alias("kinds"), array_length("k").alias("n"))


@query("AG10_pivot_case", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view_ FROM events GROUP BY 1")
def ag10(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(time_bucket("1 day", "ts").alias("day")).pivot("event_type", ["click", "view"]).agg(F.max("value")).withColumnRenamed("view", "view_")


@query("AG11_crosstab", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id")
def ag11(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.count(F.lit(1))).na.fill(0, ["click", "error"])


@query("AG12_mode", "SELECT user_id, v AS common FROM (SELECT user_id, event_type AS v, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) x WHERE r = 1")
def ag12(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.mode("event_type", deterministic=True).alias("common"))


@query("AG13_mode_or_avg", "SELECT user_id % 7 AS k, round(avg(json_extract_string(props, '$.k')::DOUBLE), 6) AS v FROM events GROUP BY 1")
def ag13(spark, sf_dir):
    return _events(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("k")).agg(F.round(A.mode_or_avg(F.get_json_object("props", "$.k")).cast("double"), 6).alias("v"))


@query("AG14_circular_avg", "SELECT user_id, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS direction FROM (SELECT user_id, degrees(atan2(sum(sin(radians(event_id * 37 % 360))), sum(cos(radians(event_id * 37 % 360))))) AS a FROM events GROUP BY user_id) x")
def ag14(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id").agg(F.round(A.circular_avg(F.col("event_id") * 37 % 360), 6).alias("direction"))


_H = " ".join(f"count(*) FILTER (value >= {lo} AND value < {hi}) AS b{i}," for i, (lo, hi) in enumerate([(-1e9, 10), (10, 40), (40, 70), (70, 100)]))


@query("AG15_histogram", f"SELECT event_type, {_H} count(*) FILTER (value >= 100) AS b4 FROM events GROUP BY event_type")
def ag15(spark, sf_dir):
    h = _events(spark, sf_dir).groupBy("event_type").agg(A.histogram("value", 10, 100, 3).alias("h"))
    return h.select("event_type", *[F.get("h", F.lit(i)).alias(f"b{i}") for i in range(5)])


@query("AG16_stats", "SELECT event_type, round(corr(value, user_id), 6) AS r, round(covar_samp(value, user_id), 6) AS c FROM events GROUP BY event_type")
def ag16(spark, sf_dir):
    daily = _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("d")).agg(A.stats_agg("value", "user_id").alias("s"))
    s = daily.groupBy("event_type").agg(A.rollup_stats("s").alias("s"))
    return s.select("event_type", F.round(A.stats_corr("s"), 6).alias("r"), F.round(A.stats_covariance("s"), 6).alias("c"))


_CORR = "WITH b AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS t, event_type AS k, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT x.k AS a, y.k AS b, corr(x.v, y.v) AS r FROM b x JOIN b y ON x.t = y.t AND x.k <> y.k GROUP BY ALL)"


@query("AG17_correlation_matrix", f"{_CORR} SELECT a, b, round(r, 6) AS r FROM p")
def ag17(spark, sf_dir):
    b = _events(spark, sf_dir).groupBy(time_bucket("6 hours", "ts").alias("t"), F.col("event_type").alias("k")).agg(F.avg("value").alias("v"))
    x, y = b.select("t", F.col("k").alias("a"), F.col("v").alias("va")), b.select("t", F.col("k").alias("b"), F.col("v").alias("vb"))
    return x.join(y, "t").where("a <> b").groupBy("a", "b").agg(F.round(F.corr("va", "vb"), 6).alias("r"))


@query("AG18_percentile_rank", "SELECT event_type, round(count(*) FILTER (WHERE value <= 50) / count(value), 4) AS exact_rank, true AS rank_near, true AS median_near FROM events GROUP BY event_type")
def ag18(spark, sf_dir):
    """Rank and median by merged sketches, and whether they are within 0.03 of the exact ones in rank."""
    e = _events(spark, sf_dir)
    daily = e.groupBy("event_type", F.to_date("ts").alias("d")).agg(A.percentile_agg("value").alias("s"))
    whole = daily.groupBy("event_type").agg(A.rollup_percentile("s").alias("s"))
    got = whole.select("event_type", A.approx_percentile_rank(F.lit(50.0), "s").alias("rank"), A.approx_percentile(F.lit(0.5), "s").alias("median"))
    share = lambda limit: F.count_if(F.col("value") <= limit) / F.count("value")
    exact = e.join(F.broadcast(got), "event_type").groupBy("event_type", "rank", "median").agg(share(F.lit(50.0)).alias("at_50"), share(F.col("median")).alias("at_median"))
    return exact.select("event_type", F.round("at_50", 4).alias("exact_rank"), (F.abs(F.col("rank") - F.col("at_50")) < 0.03).alias("rank_near"), (F.abs(F.col("at_median") - 0.5) < 0.03).alias("median_near"))


@query("AG26_merge_intervals", """WITH i AS (SELECT o_custkey AS k, o_orderdate AS s, o_orderdate + INTERVAL 60 DAY AS e FROM orders),
       r AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
       g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
       SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, island""")  # fmt: skip
def ag26(spark, sf_dir):
    i = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("e"))
    return S.merge_intervals(i, ["k"], "s", "e")


@query("AG27_hierarchical_rollup", "WITH h AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS b, event_type AS k, count(*) AS n, avg(value) AS m, max(value) AS high FROM events GROUP BY ALL) SELECT time_bucket(INTERVAL '1 day', b) AS b, k, sum(n)::BIGINT AS n, round(avg(m), 9) AS avg_of_avg, round(sum(m * n) / sum(n), 9) AS weighted, max(high) AS high FROM h GROUP BY 1, 2")
def ag27(spark, sf_dir):
    h = _events(spark, sf_dir).groupBy(time_bucket("1 hour", "ts").alias("h"), F.col("event_type").alias("k")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.max("value").alias("high"))
    return h.groupBy(time_bucket("1 day", "h").alias("b"), "k").agg(F.sum("n").alias("n"), F.round(F.avg("m"), 9).alias("avg_of_avg"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 9).alias("weighted"), F.max("high").alias("high"))


sql("AG28_share_of_total", "SELECT event_type, count(*) AS n, round(100D * count(*) / sum(count(*)) OVER (), 4) AS share FROM {events} GROUP BY event_type",
    "SELECT event_type, count(*) AS n, round((100.0 * count(*))::DOUBLE / (sum(count(*)) OVER ())::DOUBLE, 4) AS share FROM events GROUP BY event_type")
sql("AG29_interval_groups", "SELECT d, count(*) AS n FROM (SELECT datediff(l_shipdate, o_orderdate) AS d FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) x GROUP BY d",
    "SELECT d, count(*) AS n FROM (SELECT (l_shipdate::DATE - o_orderdate::DATE)::INTEGER AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x GROUP BY d")
sql("AG30_weekly_totals", "SELECT date_trunc('WEEK', l_shipdate) AS week, round(sum(l_extendedprice), 2) AS total FROM {lineitem} GROUP BY date_trunc('WEEK', l_shipdate)",
    "SELECT CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")


def _bucket(name: str, width: str, duck: str) -> None:
    @query(name, f"SELECT time_bucket(INTERVAL '{duck}', ts) AS bucket, count(*) AS n FROM events GROUP BY 1")
    def f(spark, sf_dir):
        return _events(spark, sf_dir).groupBy(time_bucket(width, "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


_bucket("TB1_bucket_week", "1 week", "7 days")
_bucket("TB1_bucket_35m", "35m", "35 minutes")
_bucket("TB2_bucket_month", "1 month", "1 month")
_bucket("TB2_bucket_quarter", "3 months", "3 months")
_bucket("TB5_bucket_15m", "15m", "15 minutes")


@query("TB3_bucket_zone", "SELECT (date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS bucket, count(*) AS n FROM events GROUP BY 1")
def tb3(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    return _events(spark, sf_dir).groupBy(time_bucket("1 day", t, "America/New_York").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


@query("TB4_bucket_of_bucket", "SELECT time_bucket(INTERVAL '4 hours', time_bucket(INTERVAL '1 hour', ts)) AS bucket, count(*) AS n FROM events GROUP BY 1")
def tb4(spark, sf_dir):
    h = _events(spark, sf_dir).groupBy(time_bucket("1 hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    return h.groupBy(time_bucket("4 hours", "h").alias("bucket")).agg(F.sum("n").alias("n"))


sql("TB6_date_trunc", "SELECT event_id, date_trunc('DAY', ts) AS d, date_trunc('HOUR', ts) AS h, date_trunc('WEEK', ts) AS w, date_trunc('MONTH', ts) AS m, date_trunc('YEAR', ts) AS y FROM {events}",
    "SELECT event_id, " + ", ".join(f"CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS {u[0]}" for u in ("day", "hour", "week", "month", "year")) + " FROM events")
sql("WN1_lag_lead", "SELECT event_id, lag(value) OVER w AS before, lead(value) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
sql("WN2_lag_default", "SELECT event_id, lag(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM {events}")
sql("WN4_row_number", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM {events}) x WHERE r = 3")
sql("WN5_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS sma FROM {events}")
sql("WN6_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS s, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts), 4) AS r FROM {events}")
sql("WN7_named_window", "SELECT event_id, row_number() OVER w AS n, round(sum(value) OVER w, 4) AS s FROM {events} WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts)")
sql("WN9_aggregate_in_window", "SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total FROM {events} GROUP BY event_type", "SELECT event_type, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total FROM events GROUP BY event_type")


@query("WN10_bollinger", """WITH s AS (SELECT *, avg(value) OVER w AS sma FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
       d AS (SELECT *, sqrt(avg((value - sma) * (value - sma)) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS sd FROM s)
       SELECT event_id, round(sma, 6) AS sma, round(sma + 2 * sd, 6) AS upper_band, round(sma - 2 * sd, 6) AS lower_band FROM d""")  # fmt: skip
def wn10(spark, sf_dir):
    b = W.bollinger(_events(spark, sf_dir), ["event_type"], "ts", "value")
    # averages of up to 20 amounts of cents have six decimals at most, so none lies between two results
    return b.select("event_id", *[F.round(c, 6).alias(c) for c in ("sma", "upper_band", "lower_band")])


@query("WN11_counter_rate", """SELECT event_id, round((CASE WHEN v >= p THEN v - p ELSE v END) / ((epoch_us(ts) - epoch_us(q)) / 1e6), 6) AS rate FROM
       (SELECT event_id, ts, floor(value * 100)::BIGINT AS v, lag(floor(value * 100)::BIGINT) OVER w AS p, lag(ts) OVER w AS q FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) x""")  # fmt: skip
def wn11(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.floor(F.col("value") * 100))
    return W.counter_rate(e, ["user_id"], "ts", "v").select("event_id", F.round("rate", 6).alias("rate"))


@query("WN12_gaps", "SELECT user_id, ts AS gap_start, nx AS gap_end, (epoch_us(nx) - epoch_us(ts)) / 1e6 AS gap_seconds FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events) x WHERE nx - ts > INTERVAL 1 DAY")
def wn12(spark, sf_dir):
    return W.gaps(_events(spark, sf_dir), ["user_id"], "ts", "1 DAY")


@query("WN13_avg_cost_pnl", """WITH t AS (SELECT l_partkey AS k, l_shipdate AS d, l_orderkey AS o, l_linenumber AS l, CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS b, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END AS c, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS s, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS p FROM lineitem),
       r AS (SELECT *, sum(b) OVER w AS tb, sum(c) OVER w AS tc, sum(b - s) OVER w AS balance FROM t WINDOW w AS (PARTITION BY k ORDER BY d, o, l ROWS UNBOUNDED PRECEDING)),
       g AS (SELECT *, CASE WHEN s > 0 THEN p - s * coalesce(tc / nullif(tb, 0), 0) ELSE 0 END AS realized FROM r)
       SELECT o AS orderkey, l AS linenumber, balance, round(realized + 3e-7, 4) AS realized, round(sum(realized) OVER (PARTITION BY k ORDER BY d, o, l ROWS UNBOUNDED PRECEDING) + 3e-7, 4) AS cumulative FROM g""")  # fmt: skip
def wn13(spark, sf_dir):
    back = F.col("l_returnflag") == "R"
    d = W.avg_cost_pnl(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], F.when(~back, F.col("l_quantity")).otherwise(0.0), F.when(~back, F.col("l_extendedprice")).otherwise(0.0), F.when(back, F.col("l_quantity")).otherwise(0.0), F.when(back, F.col("l_extendedprice")).otherwise(0.0))
    return d.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), "balance", F.round(F.col("realized") + 3e-7, 4).alias("realized"), F.round(F.col("cumulative") + 3e-7, 4).alias("cumulative"))


@query("WN14_pivot_forward_fill", """WITH p AS (SELECT user_id, ts, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'view' THEN value END) AS view_ FROM events GROUP BY ALL)
       SELECT user_id, ts, last_value(click IGNORE NULLS) OVER w AS click, last_value(view_ IGNORE NULLS) OVER w AS view_ FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def wn14(spark, sf_dir):
    p = _events(spark, sf_dir).groupBy("user_id", "ts").pivot("event_type", ["click", "view"]).agg(F.max("value")).withColumnRenamed("view", "view_")
    return W.forward_fill(p, ["user_id"], "ts", ["click", "view_"])


_POINTS = """p AS (SELECT event_type AS k, time_bucket(INTERVAL '6 hours', ts) AS b, ts, value AS v, lag(value) OVER (PARTITION BY event_type, time_bucket(INTERVAL '6 hours', ts) ORDER BY ts) AS pv FROM events),
       g AS (SELECT k, b, min(ts) AS t1, max(ts) AS t2, arg_min(v, ts) AS v1, arg_max(v, ts) AS v2, sum(CASE WHEN pv IS NULL THEN 0 WHEN v < pv THEN v ELSE v - pv END) AS delta, count(*) FILTER (v < pv)::INTEGER AS resets FROM p GROUP BY ALL),
       n AS (SELECT *, lag(t2) OVER w AS pt, lag(v2) OVER w AS pv, lead(t1) OVER w AS nt, lead(v1) OVER w AS nv FROM g WINDOW w AS (PARTITION BY k ORDER BY b)),
       x AS (SELECT *, delta + coalesce((CASE WHEN v1 < pv THEN v1 ELSE v1 - pv END) * (epoch_us(t1) - epoch_us(b)) / (epoch_us(t1) - epoch_us(pt)), 0)
         + coalesce((CASE WHEN nv < v2 THEN nv ELSE nv - v2 END) * (epoch_us(b) + 21600000000 - epoch_us(t2)) / (epoch_us(nt) - epoch_us(t2)), 0) AS whole FROM n)"""


def _counters(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy(F.col("event_type").alias("k"), time_bucket("6 hours", "ts").alias("b")).agg(C.counter_agg("ts", "value").alias("s"))
    w = Window.partitionBy("k").orderBy("b")
    return g.withColumns({"prev": F.lag("s").over(w), "next": F.lead("s").over(w)})


@query("AG23_counter_agg", f"WITH {_POINTS} SELECT k, b, round(delta, 6) AS delta, resets, round(delta / nullif((epoch_us(t2) - epoch_us(t1)) / 1e6, 0), 6) AS rate FROM x")
def ag23(spark, sf_dir):
    return _counters(spark, sf_dir).select("k", "b", F.round(C.delta("s"), 6).alias("delta"), F.col("s.resets").alias("resets"), F.round(C.rate("s"), 6).alias("rate"))


@query("WN15_interpolated_delta", f"WITH {_POINTS} SELECT k, b, round(whole, 6) AS delta FROM x")
def wn15(spark, sf_dir):
    return _counters(spark, sf_dir).select("k", "b", F.round(C.interpolated_delta("s", "b", 21600, "prev", "next"), 6).alias("delta"))


@query("WN16_interpolated_rate", f"WITH {_POINTS} SELECT k, b, round(whole / 21600, 8) AS rate FROM x")
def wn16(spark, sf_dir):
    return _counters(spark, sf_dir).select("k", "b", F.round(C.interpolated_rate("s", "b", 21600, "prev", "next"), 8).alias("rate"))


@query("WN3_lag_state", f"WITH {_POINTS} SELECT k, b, pv AS last_before FROM n")
def wn3(spark, sf_dir):
    return _counters(spark, sf_dir).select("k", "b", F.col("prev.last").alias("last_before"))


_TIMELINE = """c AS (SELECT user_id, ts, event_type AS s, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p, max(ts) OVER (PARTITION BY user_id) AS last_time FROM events),
       t AS (SELECT user_id, s AS state, ts AS start_time, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), last_time) AS end_time FROM c WHERE p IS NULL OR p <> s)"""


@query("WN18_state_timeline", f"WITH {_TIMELINE} SELECT user_id, state, start_time, end_time FROM t")
def wn18(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy("user_id").agg(S.state_agg("ts", "event_type").alias("s"))
    return g.select("user_id", F.inline(S.state_timeline("s")))


@query("AG24_duration_in", f"WITH {_TIMELINE} SELECT user_id, round(sum(CASE WHEN state = 'view' THEN epoch_us(end_time) - epoch_us(start_time) ELSE 0 END) / 1e6, 6) AS seconds FROM t GROUP BY user_id")
def ag24(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy("user_id").agg(S.state_agg("ts", "event_type").alias("s"))
    return g.select("user_id", F.round(S.duration_in("s", "view"), 6).alias("seconds"))


@query("WN17_interpolated_duration", """WITH p AS (SELECT user_id % 10 AS k, time_bucket(INTERVAL '1 day', ts) AS b, ts, event_type AS s, lead(ts) OVER (PARTITION BY user_id % 10, time_bucket(INTERVAL '1 day', ts) ORDER BY ts) AS nx FROM events),
       g AS (SELECT k, b, min(ts) AS t1, max(ts) AS t2, arg_max(s, ts) AS last_s, sum(CASE WHEN s = 'view' AND nx IS NOT NULL THEN epoch_us(nx) - epoch_us(ts) ELSE 0 END) AS own FROM p GROUP BY ALL),
       n AS (SELECT *, lag(last_s) OVER w AS prev_s, lead(b) OVER w AS next_b FROM g WINDOW w AS (PARTITION BY k ORDER BY b))
       SELECT k, b, round((own + CASE WHEN prev_s = 'view' THEN epoch_us(t1) - epoch_us(b) ELSE 0 END + CASE WHEN next_b IS NOT NULL AND last_s = 'view' THEN epoch_us(b) + 86400000000 - epoch_us(t2) ELSE 0 END) / 1e6, 6) AS seconds FROM n""")  # fmt: skip
def wn17(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("k"), time_bucket("1 day", "ts").alias("b")).agg(S.state_agg("ts", "event_type").alias("s"))
    w = Window.partitionBy("k").orderBy("b")
    g = g.withColumns({"prev": F.lag("s").over(w), "next": F.lead("s").over(w)})
    return g.select("k", "b", F.round(S.interpolated_duration_in("s", "view", "b", 86400, "prev", "next"), 6).alias("seconds"))


@query("WN19_delta", "SELECT event_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 0), 6) AS delta FROM events")
def wn19(spark, sf_dir):
    return W.delta(_events(spark, sf_dir), ["user_id"], ["ts"], "value").select("event_id", F.round("delta", 6).alias("delta"))


_SUBTRACT = """WITH b AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS s, o_orderdate + INTERVAL 90 DAY AS e FROM orders WHERE o_orderkey % 2 = 0), x AS (SELECT o_custkey AS k, o_orderdate AS s, o_orderdate + INTERVAL 10 DAY AS e FROM orders WHERE o_orderkey % 2 = 1),
       r AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
       g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
       u AS (SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, island),
       o AS (SELECT b.k, b.id, b.s, b.e, u.s AS cs, u.e AS ce FROM b JOIN u ON b.k = u.k AND u.s < b.e AND u.e > b.s),
       p AS (SELECT id, ce AS ps, coalesce(lead(cs) OVER (PARTITION BY id ORDER BY cs), e) AS pe FROM o UNION ALL SELECT id, any_value(s), min(cs) FROM o GROUP BY id UNION ALL SELECT id, s, e FROM b WHERE id NOT IN (SELECT id FROM o))
       SELECT id, ps AS s, pe AS e FROM p WHERE ps < pe"""


@query("WN20_subtract_intervals", _SUBTRACT)
def wn20(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    one = lambda d, days: d.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp_ntz").alias("s"), (F.col("o_orderdate") + F.expr(f"INTERVAL {days} DAY")).cast("timestamp_ntz").alias("e"))
    return S.subtract_intervals(one(o.where("o_orderkey % 2 = 0"), 90), one(o.where("o_orderkey % 2 = 1"), 10).drop("id"), ["k"], "s", "e").select("id", "s", "e")


_VOL = "SELECT time_bucket(INTERVAL '1 day', ts) AS b, event_type AS k, abs(value - lag(value) OVER (PARTITION BY event_type, time_bucket(INTERVAL '1 day', ts) ORDER BY ts)) AS d FROM events"


@query("TV7_volatility", f"SELECT k, b, round(coalesce(sum(d), 0), 4) AS volatility FROM ({_VOL}) x GROUP BY k, b")
def tv7(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy(F.col("event_type").alias("k"), time_bucket("1 day", "ts").alias("b")).agg(V.timevector("ts", "value").alias("v"))
    return g.select("k", "b", F.round(V.volatility(F.col("v")), 4).alias("volatility"))


@query("TV6_volatility_of_all", f"SELECT k, round(sum(d), 3) AS volatility FROM ({_VOL}) x GROUP BY k")
def tv6(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy(F.col("event_type").alias("k"), time_bucket("1 day", "ts").alias("b")).agg(V.timevector("ts", "value").alias("v"))
    return g.select("k", V.volatility(F.col("v")).alias("x")).groupBy("k").agg(F.round(F.sum("x"), 3).alias("volatility"))


@query("TV2_delta_unnest", "SELECT k, ts AS time, round(d, 6) AS value FROM (SELECT user_id AS k, ts, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS d FROM events) x WHERE d IS NOT NULL")
def tv2(spark, sf_dir):
    g = _events(spark, sf_dir).groupBy(F.col("user_id").alias("k")).agg(V.timevector("ts", "value").alias("v"))
    return g.select("k", V.unnest(V.delta(V.sort(F.col("v"))))).select("k", "time", F.round("value", 6).alias("value"))


@query("TV8_lttb")
def tv8(spark, sf_dir):
    return V.lttb(_events(spark, sf_dir).withColumnRenamed("ts", "time"), ["event_type"], "time", "value", 50)


@query("TV9_lttb_all")
def tv9(spark, sf_dir):
    return V.lttb_all(_events(spark, sf_dir).withColumnRenamed("ts", "time"), 30, ["value", "user_id"], "value > 1", "event_type")


@query("PIPE_seasonal_extremes")
def seasonal(spark, sf_dir):
    e = _events(spark, sf_dir)
    base = e.groupBy("event_type", F.dayofweek("ts").alias("dow")).agg(A.percentile_agg("value").alias("s"))
    high = base.select("event_type", "dow", A.approx_percentile(F.lit(0.99), "s").alias("high"))
    d = e.withColumn("dow", F.dayofweek("ts")).join(high, ["event_type", "dow"])
    return d.groupBy("event_type").agg(F.count_if(F.col("value") > F.col("high")).alias("extreme"), F.count("*").alias("n"))


@query("PIPE_overrides", """SELECT o.o_orderkey, coalesce(c.c_mktsegment, o.o_orderpriority) AS label, CASE WHEN c.c_custkey IS NULL THEN 'plain' ELSE 'override' END AS kind FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 5000""")
def overrides(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").select("o_orderkey", F.coalesce("c_mktsegment", "o_orderpriority").alias("label"), F.when(F.col("c_custkey").isNull(), "plain").otherwise("override").alias("kind"))


@query("ST5_time_since_mark", "SELECT user_id, ts, (epoch_us(ts) - epoch_us(m)) / 1e6 AS seconds FROM (SELECT user_id, ts, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) x WHERE event_type = 'purchase' AND m IS NOT NULL")
def st5(spark, sf_dir):
    d = J.last_before(_events(spark, sf_dir), ["user_id"], "ts", F.col("event_type") == "view").where("event_type = 'purchase' AND mark_time IS NOT NULL")
    return d.select("user_id", "ts", C.seconds(F.col("mark_time"), F.col("ts")).alias("seconds"))
