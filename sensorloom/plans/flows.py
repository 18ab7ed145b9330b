"""The three studies as compositions of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.columns import time_text
from sensorloom.operators import forecast, grouped_pipeline, ordered, reshape, sampling, splines
from sensorloom.sources import files
from sensorloom.sources.staging import stage


def smooth_and_widen(
    telemetry: DataFrame,
    dictionary: DataFrame,
    columns: Sequence[str] | None = None,
    rows: int = 10,
    minute_mod: int = 10,
    second: int | None = 0,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Smooth, sample on the clock, rename and pivot long telemetry to one column per series.

    Readings whose variable has no translation are dropped before the pivot.
    """
    smoothed = ordered.trailing_avg(telemetry, ["asset", "variable"], "timestamp", "value", rows, tiebreak)
    return _widen(sampling.clock_sample(smoothed, "timestamp", minute_mod, second), dictionary, columns)


def resample_and_widen(
    telemetry: DataFrame, dictionary: DataFrame, columns: Sequence[str] | None = None, step: int = 600
) -> DataFrame:
    """The same wide table from the time form of the average: grouped sums instead of a sort."""
    sampled = sampling.resample_right_closed(telemetry, ["asset", "variable"], "timestamp", "value", step)
    return _widen(sampled, dictionary, columns)


def _widen(sampled: DataFrame, dictionary: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Translate, round and pivot `ma`; times are whole seconds and become text last."""
    named = reshape.with_series_id(reshape.translate(sampled, dictionary)).filter(F.col("id").isNotNull())
    second = F.date_trunc("second", F.col("timestamp"))
    cells = named.select("id", second.alias("timestamp"), F.round("ma", 6).alias("value"))
    wide = reshape.pivot_wide(cells, "timestamp", "id", "value", columns).orderBy("timestamp")
    return wide.withColumn("timestamp", time_text(F.col("timestamp")))


def wide_history(filled: DataFrame, columns: Sequence[str], name: str = "sensor") -> DataFrame:
    """Wide telemetry from gap-filled long readings; leading gaps stay missing."""
    wide = reshape.pivot_wide(filled, ["asset", "timestamp"], name, "value", columns, how="mean")
    day = F.to_date("timestamp")
    return wide.withColumns({"day": day, "fcast_day": F.date_add(day, 1)})


def day_ahead_predictions(
    train: DataFrame,
    evaluation: DataFrame,
    inputs: Sequence[str],
    alpha: float,
    target: str = "WTURPower",
) -> DataFrame:
    """Model per asset on all complete training rows, then one prediction per evaluation cell.

    It is made from the latest reading that gives one; a cell without any, for a missing
    feature or an asset without a model, stays with NULL.
    """
    name = f"pred_{target}"
    models = grouped_pipeline.fit_grouped_pipeline(train, ["asset"], inputs, f"true_{target}", [alpha])
    return _latest(evaluation, models, inputs, name)


def fleet_predictions(
    train: DataFrame,
    evaluation: DataFrame,
    inputs: Sequence[str],
    alphas: Sequence[float],
    target: str = "WTURPower",
) -> DataFrame:
    """The same with one penalty chosen per asset by cross-validation, all models fitted together.

    `train` carries a `fold` column; every cell of `evaluation` stays.
    """
    name = f"pred_{target}"
    _, models = grouped_pipeline.grouped_grid_search(train, ["asset"], inputs, f"true_{target}", alphas)
    return _latest(evaluation, models, inputs, name)


def _latest(evaluation: DataFrame, models: DataFrame, inputs: Sequence[str], name: str) -> DataFrame:
    rows = grouped_pipeline.predict_grouped_pipeline(evaluation, models, ["asset"], inputs, name)
    return forecast.latest_prediction(rows.withColumn("_at", F.when(F.col(name).isNotNull(), F.col("timestamp"))), name, "_at")


def evaluate_to_daily_files(
    train: DataFrame, evaluation: DataFrame, inputs: Sequence[str], alpha: float, path: str, step: int = 600, target: str = "WTURPower", curve: str = "spline"
) -> None:
    """Models from one table, predictions for another, interpolated and written as a folder of CSV per day.

    `evaluation` needs no truth. A missing feature column fails before anything runs; a cell
    without a feature or a model keeps NULL up to the files, where the curve does not fill it.
    """
    lacking = [c for c in ("asset", "timestamp", "fcast_day", "range", *inputs) if c not in evaluation.columns]
    if lacking:
        raise ValueError(f"the evaluation table has no {', '.join(lacking)}")
    keys, name = ["asset", "fcast_day"], f"pred_{target}"
    predicted = stage(day_ahead_predictions(train, evaluation, inputs, alpha, target))
    fill = splines.spline if curve == "spline" else splines.linear_curve
    files.write_daily_csv(fill(reshape.densify(predicted, keys, "range", name, step), keys, "range", name), path)


def fine_predictions(pred: DataFrame, step: int = 600, value: str = "pred_WTURPower") -> DataFrame:
    """Predictions on the finer grid, interpolated by a cubic spline per asset and day."""
    keys = ["asset", "fcast_day"]
    return splines.spline(reshape.densify(pred, keys, "range", value, step), keys, "range", value)
