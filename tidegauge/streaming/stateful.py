"""Streaming forms of trigger-style processing: closed candles, deltas, gaps between events, alerts and notices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.functions.bucket import ORIGIN_MICROS, parse_width


def candles(rows: DataFrame, width: str, keys: list[str], time: str = "time", price: str = "price", volume: str = "volume", delay: str | None = None) -> DataFrame:
    """Candles of windows of a stream or a table; with a delay a stream closes each when its time is past by that."""
    w = parse_width(width)
    d = rows.withWatermark(time, delay) if delay is not None else rows
    win = F.window(time, w.interval(), w.interval(), f"{ORIGIN_MICROS % w.micros} microseconds")
    got = d.groupBy(win.alias("w"), *keys).agg(
        F.min_by(price, time).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, time).alias("close"), F.sum(volume).alias("volume")
    )
    return got.select(F.col("w.start").alias("bucket"), *keys, "open", "high", "low", "close", "volume")


def deltas(rows: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Rows of a stream with delta to the reading before of the same key, 0 for the first; in order of time within a batch."""
    kind = rows.schema

    def f(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(time, kind="stable")
        before = state.get[0] if state.exists else None
        v = pdf[value].astype("float64")
        d = v.diff()
        d.iloc[0] = 0.0 if before is None else v.iloc[0] - before
        state.update((float(v.iloc[-1]),))
        yield pdf.assign(delta=d)

    out = kind.simpleString()[len("struct<") : -1] + ",delta:double"
    return rows.groupBy(key).applyInPandasWithState(f, _ddl(out), "last double", "append", GroupStateTimeout.NoTimeout)


def since_mark(rows: DataFrame, key: str, time: str, label: str, mark: str, event: str) -> DataFrame:
    """For each event of a stream the seconds since the last mark of its key; events before any mark give nothing."""

    def f(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(time, kind="stable")
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for t, s in zip(pdf[time], pdf[label], strict=True):
            t = pd.Timestamp(t)
            if s == mark:
                last = t
            elif s == event and last is not None:
                out.append((k[0], last, t, (t - last).total_seconds()))
        if last is not None:
            state.update((int(last.value // 1000 if last.unit == "ns" else last.as_unit("us").value),))
        yield pd.DataFrame(out, columns=["key", "mark_time", "time", "seconds"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(f, f"key {kind}, mark_time timestamp, time timestamp, seconds double", "mark long", "append", GroupStateTimeout.NoTimeout)


def _ddl(fields: str) -> str:
    return ", ".join(f.replace(":", " ", 1) for f in fields.split(","))


def alerts(rows: DataFrame, condition: str) -> DataFrame:
    """Rows over a threshold; the rows themselves go on unchanged."""
    return rows.where(condition)


def run_batches(rows: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give every micro-batch that is available to a function, as statement triggers get their new rows, and end."""
    return rows.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tick_stream(spark, per_second: int = 10) -> DataFrame:
    """A stream of made-up ticks."""
    r = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return r.select(F.col("timestamp").alias("time"), F.concat(F.lit("S"), (F.col("value") % 3).cast("string")).alias("symbol"), (100 + F.col("value") % 10).cast("double").alias("price"), F.lit(1).alias("volume"))
