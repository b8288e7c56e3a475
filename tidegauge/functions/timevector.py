"""Time vectors (arrays of time and value) with steps that compose, and downsampling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def timevector(time, value) -> Column:
    """All points of the group, in no order."""
    return F.collect_list(F.struct(_c(time).alias("time"), _c(value).cast("double").alias("value")))


def sort(v: Column) -> Column:
    return F.array_sort(v)


def delta(v: Column) -> Column:
    """Each value less the one before, one point fewer."""
    n = F.greatest(F.size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, F.lit(2), n), F.slice(v, F.lit(1), n), lambda b, a: F.struct(b["time"].alias("time"), (b["value"] - a["value"]).alias("value")))


def absolute(v: Column) -> Column:
    return F.transform(v, lambda x: F.struct(x["time"].alias("time"), F.abs(x["value"]).alias("value")))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["value"], F.lit(0.0)))


def unnest(v: Column) -> Column:
    """For select: a row for each point, with columns time and value."""
    return F.inline(v)


def pipeline(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """One step of many, to be kept and used again."""
    return lambda v: reduce(lambda acc, f: f(acc), steps, v)


volatility = pipeline(sort, delta, absolute, total)


def lttb_indexes(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Points kept by largest triangles: the first, the last, and one of each of n - 2 equal runs of those between."""
    m = len(x)
    if n >= m or n < 3:
        return np.arange(m) if n >= m else np.unique([0, m - 1])[: max(n, 0)]
    edge = 1 + np.arange(n - 1) * (m - 2) / (n - 2)
    edge = np.floor(edge).astype(int)
    out, at = [0], 0
    for i in range(n - 2):
        a, b = edge[i], edge[i + 1]
        c, d = (edge[i + 1], edge[i + 2]) if i < n - 3 else (m - 1, m)
        cx, cy = x[c:d].mean(), y[c:d].mean()
        area = np.abs((x[at] - cx) * (y[a:b] - y[at]) - (x[at] - x[a:b]) * (cy - y[at]))
        at = a + int(area.argmax())
        out.append(at)
    return np.array([*out, m - 1])


def lttb(df: DataFrame, keys: list[str], time: str, value: str, n: int) -> DataFrame:
    """Rows of each key that draw its curve with n points; a null value counts as the lowest.

    A series is one group: it must fit in a task's memory.
    """
    keep = [*keys, time, value]

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable").reset_index(drop=True)
        y = pdf[value].astype("float64").fillna(-np.inf).to_numpy()
        x = pd.to_datetime(pdf[time]).astype("int64").to_numpy().astype(np.float64)
        with np.errstate(invalid="ignore"):
            return pdf.iloc[lttb_indexes(x - x[0], y, n)]

    return df.select(keep).groupBy(*keys).applyInPandas(pick, df.select(keep).schema)


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold numbers, in order."""
    return [c for c, kind in df.dtypes if c not in but and kind.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]


def lttb_all(df: DataFrame, n: int, columns: list[str] | None = None, where: str | None = None, group: str | None = None, time: str = "time") -> DataFrame:
    """Downsample on the first column and return all columns at the times it keeps; by default all that hold numbers."""
    d = df.where(where) if where else df
    keys = [group] if group else []
    columns = columns or numeric_columns(df, (time, *keys))
    if not keys:
        d = d.withColumn("__all", F.lit(1))
    kept = lttb(d, keys or ["__all"], time, columns[0], n).select(*keys, time).distinct()
    return d.join(kept, [*keys, time], "left_semi").select(*keys, time, *columns)
