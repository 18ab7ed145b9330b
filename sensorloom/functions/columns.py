"""Column expressions shared by the operators; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def reading_time(date: Column, time: Column, lenient: bool = False) -> Column:
    """Timestamp from a date and an `HH:mm:ss` text; bad text gives NULL when lenient."""
    text = F.concat(F.date_format(date, "yyyy-MM-dd"), time)
    parse = F.try_to_timestamp if lenient else F.to_timestamp
    return parse(text, F.lit("yyyy-MM-ddHH:mm:ss") if lenient else "yyyy-MM-ddHH:mm:ss")


def parse_time(text: Column) -> Column:
    return F.to_timestamp(text, TEXT_FORMAT)


def time_text(ts: Column) -> Column:
    return F.date_format(ts, TEXT_FORMAT)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def next_day(day: Column) -> Column:
    return F.date_add(day, 1)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def hours(seconds: Column) -> Column:
    return seconds / F.lit(3600)


def series_id(identifier: Column, asset: Column) -> Column:
    """`<identifier>_<asset>`; NULL when the identifier is unknown."""
    return F.concat(identifier, F.lit("_"), asset)


def asset_of(series: Column, width: int = 4) -> Column:
    return F.right(series, F.lit(width))


def variable_of(series: Column, width: int = 4) -> Column:
    return F.substring(series, F.lit(1), F.length(series) - (width + 1))


def missing_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def clock_aligned(ts: Column, minute_mod: int = 10, second: int | None = 0) -> Column:
    """True on whole multiples of `minute_mod` minutes; any second counts when `second` is None."""
    on_minute = F.minute(ts) % minute_mod == 0
    return on_minute if second is None else on_minute & (F.second(ts) == second)


def day_hour_slice(ts: Column, day_of_year: int, last_hour: int) -> Column:
    """True on one day of the year up to and including the given hour."""
    return (F.dayofyear(ts) == day_of_year) & (F.hour(ts) <= last_hour)


def right_closed_bucket(ts: Column, seconds: int) -> Column:
    """End of the bucket (end - seconds, end] that holds the time."""
    ticks = F.unix_micros(ts.cast("timestamp"))
    width = seconds * 1_000_000
    end = ticks + F.pmod(-ticks, F.lit(width).cast("bigint"))
    return F.timestamp_micros(end).cast("timestamp_ntz")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson coefficient over complete pairs; NULL for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0))


def linspace(index: Column, start: float, stop: float, n: int) -> Column:
    """Evenly spaced points, both ends included, from an index 0 .. n-1."""
    return F.lit(start) + index * F.lit((stop - start) / (n - 1))
