"""Day-ahead forecasts: pairing with telemetry, truth, errors and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import day_of, from_epoch, next_day, plus_seconds
from sensorloom.operators.quality import describe
from sensorloom.operators.sampling import split_by_day

FORECAST_VARIABLES = ("WNACWindSpeed", "WNACAmbTemp")


def prepare_raw(df: DataFrame) -> DataFrame:
    """Telemetry with `timestamp`, `day` and the day it is used to predict."""
    ts = from_epoch(F.col("unixtime"))
    return df.withColumns(
        {"timestamp": ts, "day": day_of(ts), "fcast_day": next_day(day_of(ts)).cast("timestamp")}
    ).drop("unixtime")


def prepare_forecasts(df: DataFrame, variables: Sequence[str] = FORECAST_VARIABLES) -> DataFrame:
    """Forecasts with issue time `fcast_day`, target time `fcast_time` and suffixed variables."""
    issued = from_epoch(F.col("unixtime"))
    renamed = df.withColumnsRenamed({v: f"{v}_fcast" for v in variables})
    return renamed.withColumns(
        {"fcast_day": issued, "fcast_time": plus_seconds(issued, F.col("range"))}
    ).drop("unixtime")


def forecast_join(raw: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Every reading of a day with every forecast issued for the day after it.

    The fan-out is the result itself. Both sides shuffle on (fcast_day, asset);
    the adaptive skew join splits an asset-day that is larger than the rest.
    """
    return raw.join(forecasts, ["fcast_day", "asset"], "inner")


def unique_by(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """One value per key; the job fails if a key occurs twice.

    The grouping uses the keys of the join that follows, so it adds no shuffle.
    """
    repeated = F.count(F.lit(1)) > 1
    message = F.lit(f"duplicate key in ({', '.join(keys)})")
    return df.groupBy(*keys).agg(
        F.when(repeated, F.raise_error(message).cast("double")).otherwise(F.max(value)).alias(name)
    )


def attach_truth(
    forecasts: DataFrame,
    raw: DataFrame,
    variable: str,
    name: str | None = None,
    at: str = "fcast_time",
) -> DataFrame:
    """Add the measured value at the forecast's target time; NULL when it was not measured."""
    name = name or f"true_{variable}"
    truth = unique_by(raw.select("asset", F.col("timestamp").alias(at), variable), ["asset", at], variable, name)
    return forecasts.join(truth, ["asset", at], "left")


def training_table(raw: DataFrame, forecasts: DataFrame, target: str = "WTURPower") -> DataFrame:
    """Features of day D, forecasts for D+1 and the measured target.

    The truth depends on the forecast alone, so it is attached before the fan-out.
    """
    return forecast_join(raw, attach_truth(forecasts, raw, target))


def train_test_by_day(
    raw: DataFrame, forecasts: DataFrame, assets: Sequence[str] | None = None, num_days: int = 1, seed: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(train, test) tables for the given assets with `num_days` whole days held out."""
    if assets is not None:
        raw = raw.filter(F.col("asset").isin(list(assets)))
        forecasts_used = forecasts.filter(F.col("asset").isin(list(assets)))
    else:
        forecasts_used = forecasts
    return split_by_day(training_table(raw, forecasts_used), "fcast_day", num_days, seed, days=forecasts)


def error_field(df: DataFrame, true: str, pred: str, keys: Sequence[str] = ("fcast_day", "range")) -> DataFrame:
    """|mean(true) - mean(pred)| per cell of the day × range field."""
    cells = df.groupBy(*keys).agg(F.avg(true).alias("true_mean"), F.avg(pred).alias("pred_mean"))
    return cells.withColumn("delta", F.abs(F.col("true_mean") - F.col("pred_mean")))


def error_stats(
    df: DataFrame, true: str, pred: str, by: Sequence[str] = ("range",), day: str = "fcast_day"
) -> DataFrame:
    """Distribution of the daily error for each forecast range."""
    return describe(error_field(df, true, pred, [*by, day]), list(by), "delta")


def score_columns(true: str, pred: str) -> list[Column]:
    """Aggregates for n, MSE and R², over rows where both values are known."""
    known = F.col(true).isNotNull() & F.col(pred).isNotNull()
    y = F.when(known, F.col(true))
    residual = F.when(known, F.col(true) - F.col(pred))
    sse = F.sum(residual * residual)
    spread = F.var_pop(y) * F.count(y)
    return [
        F.count(y).alias("n"),
        F.avg(residual * residual).alias("mse"),
        (F.lit(1.0) - sse / F.nullif(spread, F.lit(0.0))).alias("r2"),
    ]


def regression_metrics(df: DataFrame, true: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*score_columns(true, pred))


def forecast_report(df: DataFrame, true: str, pred: str, complete: Sequence[str] | None = None) -> DataFrame:
    """Per asset: score over complete rows, and mean and worst error over the day × range field."""
    scores = regression_metrics(df.na.drop("any", subset=list(complete) if complete else None), true, pred, ["asset"])
    field = error_field(df, true, pred, ["asset", "fcast_day", "range"])
    cells = field.groupBy("asset").agg(
        F.count("delta").alias("n_cells"), F.avg("delta").alias("mean_delta"), F.max("delta").alias("max_delta")
    )
    return cells.join(scores, "asset", "left")


def latest_prediction(
    df: DataFrame, pred: str = "pred_WTURPower", at: str = "timestamp", keys: Sequence[str] = ("asset", "fcast_day", "range")
) -> DataFrame:
    """One prediction per cell: the one made from the latest reading."""
    return df.groupBy(*keys).agg(F.max_by(pred, at).alias(pred))
