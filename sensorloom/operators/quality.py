"""Profiles, missing data, gaps, outliers and distributions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.ordered import cumulative_sum
from sensorloom.operators.reshape import column_values
from sensorloom.operators.sizing import SLICE_ROWS, Slices, checked_broadcast, plan_slices
from sensorloom.sources.staging import stage

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def table_profile(df: DataFrame, asset: str, variable: str, ts: str, approx: bool = False) -> DataFrame:
    """Distinct assets, variables and timestamps with first and last time, in one pass."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(
        distinct(F.col(asset)).alias("n_assets"),
        distinct(F.col(variable)).alias("n_variables"),
        distinct(F.col(ts)).alias("n_timestamps"),
        F.min(ts).alias("t_start"),
        F.max(ts).alias("t_stop"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def series_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean and sample deviation per series."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def missing_matrix(df: DataFrame, variable: str, asset: str, ts: str, value: str, assets: Sequence[str] | None = None) -> DataFrame:
    """Missing cells per variable and asset, over the distinct timestamps of the table.

    A cell is missing when its row is absent or its value is NULL, so it is the
    number of timestamps minus the cells present; the dense table is never built.
    """
    total = df.select(ts).distinct().agg(F.count(F.lit(1)).alias("_total"))
    present = df.groupBy(variable, asset).agg(F.count_distinct(F.when(F.col(value).isNotNull(), F.col(ts))).alias("_n"))
    assets = list(assets) if assets is not None else column_values(df, asset)
    wide = present.withColumn("_total", total.scalar()).groupBy(variable, "_total").pivot(asset, assets).agg(F.first("_n"))
    return wide.select(
        variable,
        *[(F.col("_total") - F.coalesce(F.col(f"`{a}`"), F.lit(0))).cast("bigint").alias(a) for a in assets],
    )


def gap_report(
    df: DataFrame, key: str | Sequence[str], ts: str, value: str, step_seconds: int = 600, slices: Slices | None = None
) -> DataFrame:
    """Runs of missing readings per series as (start, stop, duration_s, *key), ordered by start.

    A run breaks when two missing times are more than one step apart; `stop` is
    one step after its last missing time. Keys without gaps give no row.
    """
    keys = [key] if isinstance(key, str) else list(key)
    missing = df.filter(F.col(value).isNull()).select(*keys, ts)
    slices = slices or plan_slices(missing, keys, ts)
    session = F.session_window(F.col(ts), f"{step_seconds} seconds")
    runs = (
        slices.add(missing)
        .groupBy(*keys, "_slice", session)
        .agg(F.min(ts).alias("start"), F.max(ts).alias("last"))
        .drop("session_window")
    )
    if not slices.single:
        runs = _join_cut_runs(runs, keys, step_seconds)
    stop = F.col("last") + F.expr(f"INTERVAL {step_seconds} SECOND")
    seconds = F.unix_seconds(stop.cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp"))
    return runs.select("start", stop.alias("stop"), seconds.alias("duration_s"), *keys).orderBy("start", *keys)


def _join_cut_runs(runs: DataFrame, keys: list[str], step_seconds: int) -> DataFrame:
    """Put runs that a slice edge cut in two together again.

    Only the first and last run of a slice can continue elsewhere, so the
    window per key sees at most two rows per slice.
    """
    part = Window.partitionBy(*keys, "_slice")
    marked = runs.withColumn(
        "_edge",
        (F.col("start") == F.min("start").over(part)) | (F.col("last") == F.max("last").over(part)),
    )
    line = Window.partitionBy(*keys).orderBy("start")
    edges = marked.filter("_edge")
    continues = F.col("start") <= F.lag("last").over(line) + F.expr(f"INTERVAL {step_seconds} SECOND")
    joined = (
        edges.withColumn("_new", F.when(F.coalesce(continues, F.lit(False)), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(line))
        .groupBy(*keys, "_run")
        .agg(F.min("start").alias("start"), F.max("last").alias("last"))
    )
    return marked.filter(~F.col("_edge")).select(*keys, "start", "last").unionByName(joined.select(*keys, "start", "last"))


def sigma_outliers(df: DataFrame, keys: Sequence[str], value: str, n: float = 3.0) -> DataFrame:
    """Add `is_outlier`: strictly outside mean ± n deviations of its series; missing is False.

    Deviations are per series, one row each; they are broadcast when that
    table is small and joined by shuffle otherwise.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    x, mean, band = F.col(value), F.col("_mean"), F.lit(float(n)) * F.col("_std")
    outside = (x > mean + band) | (x < mean - band)
    return (
        df.join(checked_broadcast(stats), list(keys), "left")
        .withColumn("is_outlier", F.coalesce(outside, F.lit(False)))
        .drop("_mean", "_std")
    )


def outlier_matrix(df: DataFrame, variable: str, asset: str, value: str, assets: Sequence[str] | None = None) -> DataFrame:
    """Outlier count per variable and asset."""
    assets = list(assets) if assets is not None else column_values(df, asset)
    flagged = sigma_outliers(df.select(variable, asset, value), [variable, asset], value)
    return flagged.groupBy(variable).pivot(asset, assets).agg(F.sum(F.col("is_outlier").cast("bigint")))


def masked_outliers(df: DataFrame, keys: Sequence[str], value: str, name: str = "masked") -> DataFrame:
    """Keep the value of outliers only; every other row becomes missing."""
    flagged = sigma_outliers(df, keys, value)
    return flagged.withColumn(name, F.when(F.col("is_outlier"), F.col(value))).drop("is_outlier")


def shared_histogram(df: DataFrame, shared: str, series: str, value: str, bins: int = 100) -> DataFrame:
    """Counts per bin; bin edges span the values of all series that share a variable.

    The largest value belongs to the last bin; a constant variable fills the middle one.
    """
    limits = df.groupBy(shared).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    share = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    index = F.least(F.floor(F.coalesce(share, F.lit(0.5)) * bins) + 1, F.lit(bins)).cast("int")
    known = df.filter(F.col(value).isNotNull()).select(shared, series, value)
    binned = known.join(checked_broadcast(limits), shared).withColumn("bin", index)
    return binned.groupBy(shared, series, "bin").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: dict[str, float],
    slices: Slices | None = None,
) -> DataFrame:
    """Exact quantiles per key with linear interpolation between neighbours.

    Keys of ordinary size use the built-in aggregate. When a key is longer than a slice,
    equal values are counted first, so a value that fills most of a key is one row a task;
    running totals over the distinct values, slice by slice, then tell which of them hold the
    few ranks next to a quantile. No task ever holds the values of a key.
    """
    known = df.filter(F.col(value).isNotNull()).select(*keys, value)
    slices = slices or plan_slices(known, keys, value)
    if slices.single:
        return known.groupBy(*keys).agg(
            *[F.percentile(value, F.lit(q)).alias(name) for name, q in fractions.items()]
        )
    counts = stage(known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")))
    distinct = plan_slices(counts, keys, value, slices.rows_per_slice)
    ranked = cumulative_sum(counts, keys, value, F.col("_c"), "_upto", distinct)
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = ranked.join(slices.per_key(sizes), list(keys))
    spots = {name: (F.col("_n") - 1) * F.lit(q) + 1 for name, q in fractions.items()}
    holds = lambda rank: (F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto"))
    wanted = reduce(or_, [holds(F.floor(s)) | holds(F.ceil(s)) for s in spots.values()])
    out = []
    for name, spot in spots.items():
        low = F.max(F.when(holds(F.floor(spot)), F.col(value)))
        high = F.max(F.when(holds(F.ceil(spot)), F.col(value)))
        share = F.max(spot - F.floor(spot))
        out.append((low + (high - low) * share).alias(name))
    return ranked.filter(wanted).groupBy(*keys).agg(*out)


def describe(df: DataFrame, keys: Sequence[str], value: str, rows_per_slice: int = SLICE_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles, max and mean + std per key."""
    moments = [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    slices = plan_slices(df.filter(F.col(value).isNotNull()), keys, value, rows_per_slice)
    if slices.single:
        quartiles = [F.percentile(value, F.lit(q)).alias(name) for name, q in QUARTILES.items()]
        joined = df.groupBy(*keys).agg(*moments, *quartiles)
    else:
        ranked = exact_quantiles(df, keys, value, QUARTILES, slices=slices)
        joined = df.groupBy(*keys).agg(*moments).join(slices.per_key(ranked), list(keys), "left")
    return joined.withColumn("mean_plus_std", F.col("mean") + F.col("std"))
