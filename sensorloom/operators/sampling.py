"""Filters on clock and calendar, resampling, and day-wise train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import clock_aligned, day_hour_slice, right_closed_bucket


def clock_sample(df: DataFrame, ts: str, minute_mod: int = 10, second: int | None = 0) -> DataFrame:
    return df.filter(clock_aligned(F.col(ts), minute_mod, second))


def day_slice(df: DataFrame, ts: str, day_of_year: int, last_hour: int = 12) -> DataFrame:
    return df.filter(day_hour_slice(F.col(ts), day_of_year, last_hour))


def resample_right_closed(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, step: int = 600, name: str = "ma"
) -> DataFrame:
    """Mean per (end - step, end] bucket: the sampled trailing mean without any sort."""
    bucketed = df.select(*keys, right_closed_bucket(F.col(ts), step).alias(ts), value)
    return bucketed.groupBy(*keys, ts).agg(F.avg(value).alias(name))


def pick_days(df: DataFrame, day: str, n: int, seed: str = "") -> DataFrame:
    """`n` distinct days in an order fixed by a hash of the day; at most `n` rows."""
    salted = F.concat(F.lit(seed), F.col(day).cast("string"))
    return df.select(day).distinct().orderBy(F.md5(salted), day).limit(n)


def split_by_day(df: DataFrame, day: str, n: int, seed: str = "", days: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): whole days are held out, so no day is on both sides.

    Days come from `days` when given (the forecast table), else from `df`.
    """
    picked = F.broadcast(pick_days(days if days is not None else df, day, n, seed))
    return df.join(picked, day, "left_anti"), df.join(picked, day, "left_semi")


def days_except(df: DataFrame, other: DataFrame, day: str) -> DataFrame:
    """Days of `df` that do not occur in `other`."""
    return df.select(day).distinct().subtract(other.select(day))


def contiguous_folds(numbered: DataFrame, size: str, pos: str = "pos", folds: int = 3, name: str = "fold") -> DataFrame:
    """Unshuffled folds 0 .. folds-1 from the row position 1 .. size; the first folds take the remainder."""
    index, small = F.col(pos) - 1, F.floor(F.col(size) / folds)
    extra = F.col(size) % folds
    edge = extra * (small + 1)
    fold = F.when(index < edge, F.floor(index / (small + 1))).otherwise(
        extra + F.floor((index - edge) / F.greatest(small, F.lit(1)))
    )
    return numbered.withColumn(name, fold.cast("int"))
