"""Calendar and clock expressions on TIMESTAMP_NTZ columns (the session time zone is UTC)."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AFTERNOON = (12, 13, 14, 15, 16)
SEASONS = {1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA", 7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON", 12: "DJF"}
STEPS = {"hourly": "INTERVAL 1 HOUR", "daily": "INTERVAL 1 DAY", "monthly": "INTERVAL 1 MONTH", "annual": "INTERVAL 1 YEAR"}
MICROS_A_DAY = 86_400_000_000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts: Column | str) -> Column:
    return F.unix_micros(_c(ts).cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def rounded_micros(ts: Column | str, step_us: int, method: str = "floor") -> Column:
    us = micros(ts)
    if method == "floor":
        return us - F.pmod(us, F.lit(step_us))
    if method == "ceil":
        return us + F.pmod(-us, F.lit(step_us))
    if method == "round":  # half to even
        low = us - F.pmod(us, F.lit(step_us))
        twice = (us - low) * 2
        odd = F.pmod((low / step_us).cast("bigint"), F.lit(2)) == 1
        return low + F.when((twice > step_us) | ((twice == step_us) & odd), F.lit(step_us)).otherwise(F.lit(0))
    raise ValueError(f"unknown method {method}")


def time_of_day(us: Column) -> Column:
    return F.date_format(from_micros(us), "HH:mm:ss")


def season(ts: Column | str) -> Column:
    m = F.month(_c(ts))
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isin(9, 10, 11), "SON")


def quarter_start(ts: Column | str) -> Column:
    """First day of the December-anchored quarter."""
    return F.add_months(F.trunc(F.add_months(F.to_date(_c(ts)), 1), "quarter"), -1)


def days_in_year(ts: Column | str) -> Column:
    return F.dayofyear(F.make_date(F.year(_c(ts)), F.lit(12), F.lit(31)))


def year_start(ts: Column | str) -> Column:
    return F.make_date(F.year(_c(ts)), F.lit(1), F.lit(1)).cast("timestamp_ntz")


def decimal_year(ts: Column | str) -> Column:
    return F.year(_c(ts)) + (micros(ts) - micros(year_start(ts))) / 1e6 / (86400.0 * days_in_year(ts))


def from_decimal_year(x: Column | str) -> Column:
    year = F.floor(_c(x)).cast("int")
    first = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    length = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) * F.lit(MICROS_A_DAY)
    return from_micros(micros(first) + F.round((_c(x) - year) * length).cast("bigint"))


def seconds_in_step(ts: Column | str, step: str) -> Column:
    forms = {"annual": lambda: days_in_year(ts) * 86400, "monthly": lambda: F.day(F.last_day(_c(ts))) * 86400, "daily": lambda: F.lit(86400), "hourly": lambda: F.lit(3600)}
    if step not in forms:
        raise ValueError(f"unknown time step {step}")
    return forms[step]()


def convert_zone(ts: Column | str, to: str, source: str = "UTC") -> Column:
    """Local time in `to` of a naive time in `source`; in a gap or overlap Java's rule holds (the earlier offset)."""
    return F.convert_timezone(F.lit(source), F.lit(to), _c(ts))


def interval_stop(start: Column | str, step: str) -> Column:
    return _c(start) + F.expr(STEPS[step])


def in_interval(ts: Column | str, start: Column | str, stop: Column | str, closed: str = "left") -> Column:
    """Whether a time lies between two others; closed: the ends that belong to it (left, right, both, neither)."""
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError(f"closed can't be {closed!r}")
    t, a, b = _c(ts), _c(start), _c(stop)
    return (t >= a if closed in ("left", "both") else t > a) & (t <= b if closed in ("right", "both") else t < b)


def spine(df: DataFrame, col: str, step: str, keys: list[str] | None = None) -> DataFrame:
    """All steps between the first and last value of col (of each key), so that empty bins stay."""
    keys = keys or []
    ends = df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return ends.filter("_lo IS NOT NULL").select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias(col))


@dataclass(frozen=True)
class TimeRange:
    """A range of times, closed at both ends; None is unbounded."""

    start: dt.datetime | None = None
    stop: dt.datetime | None = None

    @classmethod
    def of(cls, value=None, start=None, stop=None) -> TimeRange:
        if value is not None and (start is not None or stop is not None):
            raise AssertionError("give a range or its ends")
        if isinstance(value, TimeRange):
            return value
        if isinstance(value, str):
            return cls(parse_iso(value), parse_iso(value, inclusive=True))
        if isinstance(value, slice):
            start, stop = value.start, value.stop
        elif value is not None:
            start, stop = value
        return cls(parse_iso(start) if isinstance(start, str) else start, parse_iso(stop, inclusive=True) if isinstance(stop, str) else stop)

    def __contains__(self, t: dt.datetime) -> bool:
        return (self.start is None or self.start <= t) and (self.stop is None or t <= self.stop)

    def __iter__(self):
        return iter((self.start, self.stop))

    def condition(self, col: Column | str) -> Column:
        out = F.lit(True)
        if self.start is not None:
            out = out & (_c(col) >= F.lit(self.start).cast("timestamp_ntz"))
        if self.stop is not None:
            out = out & (_c(col) <= F.lit(self.stop).cast("timestamp_ntz"))
        return out

    def total_seconds(self) -> float:
        if self.start is None or self.stop is None:
            raise ValueError("the range is unbounded")
        return (self.stop - self.start).total_seconds()


def parse_iso(text: str, inclusive: bool = False) -> dt.datetime:
    """YYYY[-MM[-DD[THH[:mm]]]], dashes optional, minutes ignored; inclusive: the start of the next period."""
    m = re.match(r"(\d{4})(?:-?(\d{2}))?(?:-?(\d{2}))?(?:[T -]?(\d{1,2}))?", text)
    if not m:
        raise ValueError(f"not a time: {text}")
    y, mo, d, h = (int(x) if x else None for x in m.groups())
    start = dt.datetime(y, mo or 1, d or 1, h or 0)
    if not inclusive:
        return start
    if h is not None:
        return start + dt.timedelta(hours=1)
    if d is not None:
        return start + dt.timedelta(days=1)
    if mo is not None:
        return dt.datetime(y + mo // 12, mo % 12 + 1, 1)
    return dt.datetime(y + 1, 1, 1)


def bin_edges(periods: DataFrame, start: str, step: str) -> DataFrame:
    """All starts of periods and the last microsecond of the last one."""
    last = periods.agg((F.max(start) + F.expr(STEPS[step]) - F.expr("INTERVAL 1 MICROSECOND")).alias(start))
    return periods.select(start).unionByName(last.filter(F.col(start).isNotNull()))
