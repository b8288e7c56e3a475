"""Aggregates over time series, as Columns for DataFrame.agg, with states that merge."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first(value, time) -> Column:
    """The value at the least time of the group."""
    return F.min_by(_c(value), _c(time))


def last(value, time) -> Column:
    """The value at the greatest time of the group."""
    return F.max_by(_c(value), _c(time))


def candlestick_agg(time, price, volume=None) -> Column:
    """State of a candle: prices at the ends and extremes with their times, volume, and the volume-weighted sum of prices."""
    t, p = _c(time), _c(price)
    v = F.lit(None).cast("double") if volume is None else _c(volume).cast("double")
    low, high = F.min(F.struct(p.alias("p"), t.alias("t"))), F.max(F.struct(p.alias("p"), (-_micros(t)).alias("n"), t.alias("t")))
    return F.struct(
        F.min_by(p, t).alias("open"), F.min(t).alias("open_time"),
        high.getField("p").alias("high"), high.getField("t").alias("high_time"),
        low.getField("p").alias("low"), low.getField("t").alias("low_time"),
        F.max_by(p, t).alias("close"), F.max(t).alias("close_time"),
        F.sum(v).alias("volume"), F.sum(p * v).alias("weighted"),
    )


def ohlc(time, price) -> Column:
    """State of a candle without volume."""
    return candlestick_agg(time, price)


def rollup_candlestick(state) -> Column:
    """One state of many; a rollup of rollups is that of the rows themselves."""
    s = _c(state)
    low = F.min(F.struct(s["low"].alias("p"), s["low_time"].alias("t")))
    high = F.max(F.struct(s["high"].alias("p"), (-_micros(s["high_time"])).alias("n"), s["high_time"].alias("t")))
    return F.struct(
        F.min_by(s["open"], s["open_time"]).alias("open"), F.min(s["open_time"]).alias("open_time"),
        high.getField("p").alias("high"), high.getField("t").alias("high_time"),
        low.getField("p").alias("low"), low.getField("t").alias("low_time"),
        F.max_by(s["close"], s["close_time"]).alias("close"), F.max(s["close_time"]).alias("close_time"),
        F.sum(s["volume"]).alias("volume"), F.sum(s["weighted"]).alias("weighted"),
    )


def vwap(state) -> Column:
    """Average price of a candle, weighted by volume."""
    s = _c(state)
    return s["weighted"] / F.nullif(s["volume"], F.lit(0.0))


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def stats_agg(y, x) -> Column:
    """State of rows with both values: their count, both averages, and sums of squared and mixed deviations from these."""
    both = _c(y).isNotNull() & _c(x).isNotNull()
    a, b = F.when(both, _c(y).cast("double")), F.when(both, _c(x).cast("double"))
    n = F.count(a)
    return F.struct(n.alias("n"), F.avg(a).alias("my"), F.avg(b).alias("mx"), (F.var_pop(a) * n).alias("cyy"), (F.var_pop(b) * n).alias("cxx"), (F.covar_pop(a, b) * n).alias("cxy"))


def rollup_stats(state) -> Column:
    """One state of many, merged one by one, so that averages far from 0 cost no digits.

    States of a group, not its rows, stand in one array; states without rows count for nothing.
    """
    states = F.array_sort(F.collect_list(F.when(_c(state)["n"] > 0, _c(state))))
    none = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(f) for f in ("my", "mx", "cyy", "cxx", "cxy")])

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        dy, dx, share = b["my"] - a["my"], b["mx"] - a["mx"], b["n"] / n
        w = a["n"] * share
        return F.struct(
            n.alias("n"), (a["my"] + dy * share).alias("my"), (a["mx"] + dx * share).alias("mx"),
            (a["cyy"] + b["cyy"] + dy * dy * w).alias("cyy"), (a["cxx"] + b["cxx"] + dx * dx * w).alias("cxx"), (a["cxy"] + b["cxy"] + dy * dx * w).alias("cxy"),
        )

    return F.aggregate(states, none, merge)


def stats_corr(state) -> Column:
    """Correlation; null if a value doesn't vary."""
    s = _c(state)
    return s["cxy"] / F.nullif(F.sqrt(s["cyy"]) * F.sqrt(s["cxx"]), F.lit(0.0))


def stats_covariance(state) -> Column:
    """Sample covariance."""
    s = _c(state)
    return s["cxy"] / F.nullif(s["n"] - 1, F.lit(0))


def histogram(value, low: float, high: float, buckets: int) -> Column:
    """Counts below low, in equal bins of [low, high), and from high on: buckets + 2 numbers."""
    b = F.width_bucket(_c(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return F.array(*[F.count_if(b == i) for i in range(buckets + 2)])


def circular_avg(degrees) -> Column:
    """Mean direction of angles, 0 to 360."""
    r = F.radians(_c(degrees))
    a = F.degrees(F.atan2(F.sum(F.sin(r)), F.sum(F.cos(r))))
    return F.when(a < 0, a + 360).otherwise(a)


def mode_or_avg(text) -> Column:
    """Average of values that are all numbers, as text; else the most frequent value, the least of those as frequent."""
    t = _c(text)
    n, common = t.try_cast("double"), F.mode(t, deterministic=True)
    return F.when(F.count_if(t.isNotNull() & n.isNull()) == 0, F.avg(n).cast("string")).otherwise(common)


def ordered_values(value, time) -> Column:
    """All values of the group by time, nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(_c(time).alias("t"), _c(value).alias("v")))), lambda s: s["v"])


def percentile_agg(value, k: int = 200) -> Column:
    """A mergeable quantile sketch."""
    return F.kll_sketch_agg_double(_c(value).cast("double"), F.lit(k))


def rollup_percentile(sketch) -> Column:
    return F.kll_merge_agg_double(_c(sketch))


def approx_percentile_rank(value, sketch) -> Column:
    """Share of the sketched values at or below value, which must be a constant."""
    return F.kll_sketch_get_rank_double(_c(sketch), _c(value).cast("double"))


def approx_percentile(share, sketch) -> Column:
    return F.kll_sketch_get_quantile_double(_c(sketch), _c(share).cast("double"))
