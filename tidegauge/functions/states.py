"""Aggregates of states over time, and sets of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.counters import seconds


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(x: Column, f) -> Column:
    """f(x) with x worked out once; a lambda that refers to an expression from outside works it out anew for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def state_agg(time, state) -> Column:
    """Changes of state by time, runs of one state as one, and the time of the last observation."""

    def runs(points):
        changes = F.filter(points, lambda x, i: (i == 0) | ~x["s"].eqNullSafe(F.get(points, i - 1)["s"]))
        return F.struct(changes.alias("changes"), F.element_at(points, -1)["t"].alias("last_time"))

    return _once(F.sort_array(F.collect_list(F.struct(_c(time).alias("t"), _c(state).alias("s")))), runs)


def state_timeline(state) -> Column:
    """Array of (state, start_time, end_time); the last ends at the last observation."""
    s = _c(state)
    c = s["changes"]
    return F.transform(c, lambda x, i: F.struct(x["s"].alias("state"), x["t"].alias("start_time"), F.coalesce(F.get(c, i + 1)["t"], s["last_time"]).alias("end_time")))


def duration_in(state, value) -> Column:
    """Seconds in a state between the first and the last observation."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.aggregate(state_timeline(state), F.lit(0.0), lambda acc, x: acc + F.when(x["state"] == v, seconds(x["start_time"], x["end_time"])).otherwise(0.0))


def interpolated_duration_in(state, value, start, width_seconds: float, prev, following) -> Column:
    """Seconds in a state within a bucket: the state before fills its start, the last one its end if there is a next bucket."""
    s, p, n = _c(state), _c(prev), _c(following)
    v = value if isinstance(value, Column) else F.lit(value)
    begin = _c(start)
    end = begin + F.make_dt_interval(secs=F.lit(width_seconds).cast("decimal(18,6)"))
    head, tail = F.get(s["changes"], F.lit(0)), F.element_at(s["changes"], -1)
    before = F.when(F.element_at(p["changes"], -1)["s"] == v, seconds(begin, head["t"])).otherwise(0.0)
    after = F.when(n.isNotNull() & (tail["s"] == v), seconds(s["last_time"], end)).otherwise(0.0)
    return before + duration_in(s, v) + after


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Union of the half-open intervals of each key as disjoint intervals; touching ones are joined."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(start) < F.col(end)).withColumn("__reach", reach).withColumn("__island", F.sum(F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def subtract_intervals(base: DataFrame, cut: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """What is left of each base interval after all cut intervals of its key are taken out; an open end is null."""
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    gone = merge_intervals(cut, keys, start, end).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("__cut"))
    b = base.join(gone, keys, "left").withColumn("__end", F.coalesce(F.col(end), far))
    own = F.filter(F.coalesce(F.col("__cut"), F.expr("cast(array() as array<struct<s:timestamp_ntz,e:timestamp_ntz>>)")), lambda x: (x["s"] < F.col("__end")) & (x["e"] > F.col(start)))
    b = b.withColumn("__own", own)
    edges_s = F.concat(F.array(F.col(start)), F.transform("__own", lambda x: x["e"]))
    edges_e = F.concat(F.transform("__own", lambda x: x["s"]), F.array(F.col("__end")))
    pieces = F.filter(F.arrays_zip(edges_s.alias("a"), edges_e.alias("b")), lambda x: x["a"] < x["b"])
    out = b.withColumn("__piece", F.explode(pieces))
    return out.withColumn(start, F.col("__piece.a")).withColumn(end, F.when(F.col("__piece.b") < far, F.col("__piece.b"))).drop("__piece", "__own", "__cut", "__end")
