"""Interval widths and time buckets as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Buckets of fixed width are aligned to this Monday, calendar buckets to January 2000.
ORIGIN = "2000-01-03 00:00:00"
ORIGIN_MICROS = 946_857_600_000_000

_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_NAMES = {
    "microsecond": "us", "us": "us", "millisecond": "ms", "ms": "ms", "second": "s", "sec": "s", "s": "s", "minute": "m", "min": "m", "m": "m",
    "hour": "h", "h": "h", "day": "d", "d": "d", "week": "w", "w": "w",
}
_MONTHS = {"month": 1, "mon": 1, "quarter": 3, "year": 12, "y": 12}


@dataclass(frozen=True)
class Width:
    """A bucket width: a number of microseconds, or a number of calendar months."""

    micros: int = 0
    months: int = 0

    def interval(self) -> str:
        """The width as a Spark interval string."""
        return f"{self.months} months" if self.months else f"{self.micros} microseconds"


def parse_width(text: str | Width) -> Width:
    """Read '1m', '10s', '1 h', '2 weeks', '1 day 12 hours', '3 months'; a bare m is a minute."""
    if isinstance(text, Width):
        return text
    micros = months = 0
    rest = re.sub(r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)[\s,]*", "", text).strip()
    parts = re.findall(r"(\d+(?:\.\d+)?)\s*([A-Za-z]+)", text)
    if rest or not parts:
        raise ValueError(f"not an interval: {text!r}")
    for number, unit in parts:
        u = unit.lower()
        u = u if u in _NAMES or u in _MONTHS else u.rstrip("s")
        if u in _NAMES:
            micros += round(float(number) * _MICROS[_NAMES[u]])
        elif u in _MONTHS and float(number).is_integer():
            months += int(number) * _MONTHS[u]
        else:
            raise ValueError(f"not an interval: {text!r}")
    if bool(micros) == bool(months):
        raise ValueError(f"an interval must be of fixed width or of whole months, and over zero: {text!r}")
    return Width(micros, months)


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _local(t: Column, tz: str) -> Column:
    """Wall clock of a zone at an instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.to_utc_timestamp(t, F.current_timezone()).cast("timestamp_ntz"))


def _instant(local: Column, tz: str) -> Column:
    """The instant of a zone's wall clock."""
    return F.from_utc_timestamp(F.convert_timezone(F.lit(tz), F.lit("UTC"), local).cast("timestamp"), F.current_timezone())


def step_of(width: str | Width) -> Column:
    """The width as an interval."""
    w = parse_width(width)
    return F.expr(f"INTERVAL '{w.months}' MONTH") if w.months else F.expr(f"INTERVAL '{w.micros / 1e6:f}' SECOND")


def time_bucket(width: str | Width, ts: str | Column, tz: str | None = None) -> Column:
    """Start of the bucket that holds ts.

    A timestamp without zone stays one. With tz, buckets follow that zone's calendar and ts must be a
    timestamp with zone; the result is the instant at which the local bucket starts.
    """
    w, t = parse_width(width), _column(ts)
    if tz is not None:
        return _instant(time_bucket(w, _local(t, tz)), tz)
    if w.months:
        if w.months == 1:
            return F.date_trunc("month", t).cast("timestamp_ntz")
        n = (F.year(t) - 2000) * 12 + F.month(t) - 1
        first = n - F.pmod(n, F.lit(w.months))
        return F.make_date(2000 + F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    start = f"{ORIGIN_MICROS % w.micros} microseconds"
    return F.window(t, w.interval(), w.interval(), start).getField("start")


def bucket_start(width: str | Width, ts: str | Column) -> Column:
    """As time_bucket without a zone, by arithmetic; a projection may hold many of these, but only one of those."""
    w, t = parse_width(width), _column(ts)
    if w.months:
        return time_bucket(w, t)
    since = F.timestamp_diff("MICROSECOND", F.lit(ORIGIN).cast("timestamp_ntz"), t)
    return F.timestamp_add("MICROSECOND", -F.pmod(since, F.lit(w.micros)), t)


def bucket_of(width: str | Width, ts: str | Column, tz: str | None = None) -> Column:
    """As time_bucket, by arithmetic alone, so that a projection may hold many."""
    if tz is None:
        return bucket_start(width, ts)
    return _instant(bucket_start(width, _local(_column(ts), tz)), tz)


def next_bucket(width: str | Width, start: str | Column, tz: str | None = None) -> Column:
    """Start of the bucket after the one that starts there."""
    t = _column(start)
    return t + step_of(width) if tz is None else _instant(_local(t, tz) + step_of(width), tz)


def buckets_within(width: str | Width, start: str | Column, end: str | Column, tz: str | None = None) -> Column:
    """Array of the starts of all buckets from one that starts at start to before the one that starts at end."""
    a, b = _column(start), _column(end)
    if tz is None:
        return F.sequence(a, b - step_of(width), step_of(width))
    return F.transform(F.sequence(_local(a, tz), _local(b, tz) - step_of(width), step_of(width)), lambda x: _instant(x, tz))
