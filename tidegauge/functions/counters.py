"""Counters that may be reset: states, deltas and rates, with values interpolated at bucket edges."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(a: Column, b: Column) -> Column:
    """Seconds from a to b."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def counter_agg(time, value, modulus: float | None = None) -> Column:
    """State of a counter: first and last reading, number of resets, and the growth with resets made good.

    After a fall the counter is taken to have gone on from zero, or with a modulus to have wrapped there.
    """
    points = F.array_sort(F.collect_list(F.struct(_c(time).alias("t"), _c(value).cast("double").alias("v"))))

    def step(acc, x):
        fell = x["v"] < acc["prev"]
        gain = F.when(fell, x["v"] if modulus is None else x["v"] + F.lit(float(modulus)) - acc["prev"]).otherwise(x["v"] - acc["prev"])
        return F.struct(x["v"].alias("prev"), (acc["delta"] + gain).alias("delta"), (acc["resets"] + F.when(fell, 1).otherwise(0)).alias("resets"))

    zero = F.struct(F.get(points, F.lit(0))["v"].alias("prev"), F.lit(0.0).alias("delta"), F.lit(0).alias("resets"))
    grown = F.aggregate(points, zero, step)
    head, tail = F.get(points, F.lit(0)), F.element_at(points, -1)
    return F.struct(
        head["t"].alias("first_time"), head["v"].alias("first"), tail["t"].alias("last_time"), tail["v"].alias("last"),
        grown["delta"].alias("delta"), grown["resets"].alias("resets"), F.size(points).alias("n"),
    )


def delta(state) -> Column:
    return _c(state)["delta"]


def rate(state) -> Column:
    """Growth a second between the first and the last reading."""
    s = _c(state)
    return s["delta"] / F.nullif(seconds(s["first_time"], s["last_time"]), F.lit(0.0))


def interpolated_delta(state, start, width_seconds: float, prev, following) -> Column:
    """Growth over the whole bucket: readings at its edges lie on lines to the neighbours' readings, where there are neighbours."""
    s, p, n = _c(state), _c(prev), _c(following)
    begin = _c(start)
    end = begin + F.make_dt_interval(secs=F.lit(width_seconds).cast("decimal(18,6)"))
    up = F.when(s["first"] < p["last"], s["first"]).otherwise(s["first"] - p["last"])
    before = up * seconds(begin, s["first_time"]) / F.nullif(seconds(p["last_time"], s["first_time"]), F.lit(0.0))
    up = F.when(n["first"] < s["last"], n["first"]).otherwise(n["first"] - s["last"])
    after = up * seconds(s["last_time"], end) / F.nullif(seconds(s["last_time"], n["first_time"]), F.lit(0.0))
    return s["delta"] + F.coalesce(before, F.lit(0.0)) + F.coalesce(after, F.lit(0.0))


def interpolated_rate(state, start, width_seconds: float, prev, following) -> Column:
    return interpolated_delta(state, start, width_seconds, prev, following) / width_seconds
