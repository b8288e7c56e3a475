"""Scalar functions whose meaning in Spark would differ, and small domain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a, b) -> Column:
    """Quotient of integers, toward zero; null if b is zero."""
    q = _c(a) / F.nullif(_c(b), F.lit(0))
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def to_int(x) -> Column:
    """A number as an integer, rounded and not cut."""
    return F.round(_c(x)).cast("int")


def day_of_week(ts) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(_c(ts)) - 1


def epoch(ts) -> Column:
    """Seconds since 1970 with fractions."""
    return F.unix_micros(_c(ts).cast("timestamp")) / 1e6


def array_length(a) -> Column:
    """Number of elements; null for an empty array."""
    return F.nullif(F.size(_c(a)), F.lit(0))


def l2_distance(a, b) -> Column:
    """Euclidean distance of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x))


def contains(range_: Column, ts) -> Column:
    """Whether a half-open range, a struct of s and e, holds ts; an open end is null."""
    return (_c(ts) >= range_["s"]) & (range_["e"].isNull() | (_c(ts) < range_["e"]))


def persian_date(d, legacy: bool = True) -> Column:
    """Year, month and day of the Persian calendar by whole-number arithmetic on the day number of a Gregorian date.

    legacy counts days from 2121445 in the Julian day count and years from 474, which earlier results have: its years begin
    a day or so off and are one too small at first. Without it leap years are the eight of each 33 that the calendar has
    from 1799 to 2255.
    """
    if legacy:
        # fixed values: the base day, the base year, and the days of 33, 4 and 1 years
        n = F.unix_date(_c(d)) + 2440588 - 2121445
        cycle, n = F.floor(n / 12053), F.pmod(n, F.lit(12053))
        four, n = F.floor(n / 1461), n % 1461
        late = n >= 366
        year = 474 + 33 * cycle + 4 * four + F.when(late, F.floor((n - 1) / 365)).otherwise(0)
        n = F.when(late, (n - 1) % 365).otherwise(n)
    else:
        # fixed values: 12,053 days in 33 years, and the day number of the year 1
        e = F.unix_date(_c(d)) + 492268
        year = F.floor((33 * e + 3) / 12053) + 1
        n = e - F.floor((12053 * (year - 1) + 29) / 33)
    month = F.when(n < 186, 1 + F.floor(n / 31)).otherwise(7 + F.floor((n - 186) / 30))
    day = F.when(n < 186, 1 + n % 31).otherwise(1 + (n - 186) % 30)
    return F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"))


def format_sql(template: str, *args: Column) -> Column:
    """A text with %s as plain values, %I as identifiers and %L as literals in quotes where they need them, and %% as %."""
    parts, left = [], list(args)
    for text, kind in re.findall(r"([^%]*)(%[sIL%]|$)", template):
        if text:
            parts.append(F.lit(text))
        if kind == "%%":
            parts.append(F.lit("%"))
        elif kind:
            v = left.pop(0).cast("string")
            if kind == "%s":
                parts.append(F.coalesce(v, F.lit("")))
            elif kind == "%I":
                parts.append(F.when(v.rlike("^[a-z_][a-z0-9_]*$"), v).otherwise(F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))))
            else:
                parts.append(F.coalesce(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")))
    if left:
        raise ValueError("more values than places for them")
    return F.concat(*parts)


def week_start_sunday(d) -> Column:
    return F.date_sub(_c(d).cast("date"), day_of_week(d))


def qualify_reading(value, status) -> Column:
    """Discard what is bad or negative; anything unknown is OK."""
    return F.when((_c(status) == "bad") | (_c(value) < 0), "Discard").otherwise("OK")


def qualify_flagged(reading, flag) -> Column:
    """Discard what isn't flagged or has no reading."""
    return F.when(~_c(flag) | _c(reading).isNull(), "Discard").otherwise("OK")
