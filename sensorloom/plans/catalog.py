"""Registered queries: every operator applied to whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import columns as fn
from sensorloom.operators import (
    clustering,
    correlation,
    forecast,
    grouped_pipeline,
    ordered,
    quality,
    regression,
    reshape,
    sampling,
    spectral,
    splines,
)
from sensorloom.operators.sizing import Slices, plan_slices
from sensorloom.plans import flows
from sensorloom.session import apply_settings
from sensorloom.sources import files, roles
from sensorloom.sources.staging import fresh_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIES = ["asset", "variable"]
CELL = ["asset", "fcast_day", "range"]
BINS = 40
HOUR_MICROS = roles.HOUR * 1_000_000
TEST_DAYS = 5
TRANSLATED_COLUMNS = sorted(f"{v}_{a}" for v in roles.TRANSLATIONS.values() for a in roles.ASSETS)
SERIES_COLUMNS = sorted(f"{v}_{a}" for v in roles.VARIABLES for a in roles.ASSETS)
ALPHAS = (0.01, 1.0, 100.0)
KMEANS_STEPS = 10
BLEND = (0.731058578630005, 0.268941421369995)
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def query(run: Query) -> Query:
    """Register under the function's name and pin the session options the operators need."""

    @wraps(run)
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(apply_settings(spark), sf_dir)

    QUERIES[run.__name__] = prepared
    return prepared


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- load, smooth, sample, rename, pivot --------------------------------------------------


@query
def etl_wide(spark, sf):
    return flows.smooth_and_widen(
        roles.telemetry(spark, sf), roles.dictionary(spark), TRANSLATED_COLUMNS, second=None, tiebreak=["event_id"]
    )


@query
def resample_wide(spark, sf):
    return flows.resample_and_widen(roles.telemetry(spark, sf), roles.dictionary(spark), TRANSLATED_COLUMNS)


@query
def trailing_avg_rows(spark, sf):
    tel = roles.telemetry(spark, sf)
    smoothed = ordered.trailing_avg(tel, SERIES, "timestamp", "value", 10, ["event_id"])
    return rounded(smoothed.select("event_id", *SERIES, "timestamp", "ma"), "ma")


@query
def trailing_avg_time(spark, sf):
    tel = roles.telemetry(spark, sf)
    smoothed = ordered.trailing_avg_time(tel, SERIES, "timestamp", "value", seconds=21_600)
    return rounded(smoothed.select("event_id", *SERIES, "timestamp", "ma"), "ma")


@query
def resample_right_closed(spark, sf):
    tel = roles.telemetry(spark, sf)
    return rounded(sampling.resample_right_closed(tel, SERIES, "timestamp", "value", 600), "ma")


@query
def clock_aligned_sample(spark, sf):
    return sampling.clock_sample(roles.telemetry(spark, sf), "timestamp", 10, 0)


@query
def day_hour_slice(spark, sf):
    return sampling.day_slice(roles.telemetry(spark, sf), "timestamp", 3, 12)


@query
def translate_variables(spark, sf):
    named = reshape.translate(roles.telemetry(spark, sf), roles.dictionary(spark))
    return reshape.with_series_id(named).select("event_id", "asset", "variable", "identifier", "id")


@query
def untranslated_variables(spark, sf):
    return reshape.untranslated(reshape.translate(roles.telemetry(spark, sf), roles.dictionary(spark)))


@query
def pivot_wide(spark, sf):
    tel = roles.telemetry(spark, sf)
    cells = tel.select(
        fn.series_id(F.col("variable"), F.col("asset")).alias("id"),
        fn.time_text(F.date_trunc("hour", F.col("timestamp"))).alias("timestamp"),
        "value",
    )
    return reshape.pivot_wide(cells, "timestamp", "id", "value", SERIES_COLUMNS, how="min")


@query
def pivot_mean(spark, sf):
    tel = roles.telemetry(spark, sf).withColumn("day", F.to_date("timestamp"))
    wide = reshape.pivot_wide(tel, ["day", "variable"], "asset", "value", roles.ASSETS, how="mean")
    return rounded(wide, *roles.ASSETS)


@query
def wide_to_long(spark, sf):
    hourly = roles.hourly(spark, sf).withColumn("id", fn.series_id(F.col("variable"), F.col("asset")))
    wide = reshape.pivot_wide(hourly, "timestamp", "id", "value", SERIES_COLUMNS, how="min")
    return rounded(reshape.wide_to_long(wide, "timestamp"), "value")


@query
def scalar_time_text(spark, sf):
    tel = roles.telemetry(spark, sf)
    ts, day = F.col("timestamp"), F.to_date("timestamp")
    text = fn.time_text(ts)
    series = fn.series_id(F.col("variable"), F.col("asset"))
    phase = F.lit(2.0) * F.pi() * F.hour(ts) / 24
    return tel.select(
        "event_id",
        fn.reading_time(day, F.date_format(ts, "HH:mm:ss")).cast("timestamp_ntz").alias("parsed"),
        text.alias("text"),
        F.date_format(day, "yyyy-MM-dd").alias("day_text"),
        series.alias("id"),
        fn.asset_of(series).alias("id_asset"),
        fn.variable_of(series).alias("id_variable"),
        series.contains("ig").alias("has_tag"),
        F.second(ts).cast("int").alias("sec"),
        F.minute(ts).cast("int").alias("minute"),
        F.hour(ts).cast("int").alias("hour"),
        F.dayofyear(ts).cast("int").alias("doy"),
        (F.minute(ts) % 10).cast("int").alias("minute_mod"),
        F.round(F.col("value") / 3, 6).alias("third"),
        fn.from_epoch(F.unix_seconds(ts.cast("timestamp"))).cast("timestamp_ntz").alias("whole_second"),
        fn.next_day(day).alias("next_day"),
        fn.plus_seconds(ts, F.col("event_id") % 1000).alias("shifted"),
        (F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(day.cast("timestamp"))).alias("second_of_day"),
        F.round(F.abs(F.col("value") - 100), 6).alias("distance"),
        F.round(F.col("value") * F.col("value"), 4).alias("square"),
        F.round(F.sin(phase), 6).alias("sin_h"),
        F.round(F.cos(phase), 6).alias("cos_h"),
        F.round(fn.hours(F.hour(ts) * 3600 + F.minute(ts) * 60), 6).alias("hours"),
        F.round(fn.linspace(F.hour(ts), 1.0, 10.0, 24), 6).alias("spaced"),
        F.try_element_at(
            F.create_map(*[F.lit(x) for p in roles.TRANSLATIONS.items() for x in p]), F.col("variable")
        ).alias("looked_up"),
    )


@query
def long_csv_round_trip(spark, sf):
    """Telemetry written as long CSV files and scanned again as one table."""
    tel, path = roles.telemetry(spark, sf), fresh_path(spark, "long")
    ts = F.col("timestamp")
    lines = tel.select("asset", "variable", F.to_date(ts).alias("date"), F.date_format(ts, "HH:mm:ss").alias("time"), "value")
    files.write_csv(lines, path)
    back = files.read_long_csv(spark, path)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# --- profile and data quality -------------------------------------------------------------


@query
def wide_csv_round_trip(spark, sf):
    """The wide table of the ETL written as CSV and read back with its times."""
    path = fresh_path(spark, "wide")
    files.write_csv(etl_wide(spark, sf), path)
    back = files.read_wide_csv(spark, path)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query
def xml_dictionary(spark, sf):
    """Readings per variable with its name from an XML dictionary."""
    path = fresh_path(spark, "translations")
    files.write_translations(roles.dictionary(spark).unionByName(roles.dictionary(spark)), path)
    named = reshape.translate(roles.telemetry(spark, sf), files.read_translations(spark, path))
    return named.groupBy("variable", "identifier").agg(F.count(F.lit(1)).alias("n"))


def _epoch_files(spark, sf) -> str:
    """Raw history in files of two layouts: columns in another order on odd days, which also lack one sensor."""
    raw, path = roles.raw_history(roles.hourly(spark, sf)), fresh_path(spark, "raw")
    seconds = F.unix_timestamp(F.col("timestamp").cast("timestamp")).alias("unixtime")
    sensors, odd = list(roles.SENSOR_COLUMNS), F.dayofmonth("timestamp") % 2 == 1
    files.write_csv(raw.where(~odd).select("asset", seconds, *sensors), path)
    files.write_csv(raw.where(odd).select(*reversed(sensors[1:]), seconds, "asset"), path, mode="append")
    return path


@query
def csv_by_name(spark, sf):
    types = {"asset": "string", "unixtime": "bigint"}
    back = files.read_csv_by_name(spark, _epoch_files(spark, sf), types)
    return rounded(back.select("asset", "unixtime", *roles.SENSOR_COLUMNS), *roles.SENSOR_COLUMNS)


@query
def epoch_preparation(spark, sf):
    """Files in epoch seconds, prepared and paired: of the issues at 00:00 and 06:00 only the first meets a day."""
    types = {"asset": "string", "unixtime": "bigint", "range": "bigint"}
    raw = forecast.prepare_raw(files.read_csv_by_name(spark, _epoch_files(spark, sf), types))
    issued = roles.forecasts(roles.hourly(spark, sf)).withColumn("_hour", F.explode(F.array(F.lit(0), F.lit(6))))
    seconds = (F.unix_timestamp(F.col("fcast_day").cast("timestamp")) + F.col("_hour") * roles.HOUR).alias("unixtime")
    path = fresh_path(spark, "forecasts")
    values = [F.col(f"{v}_fcast").alias(v) for v in forecast.FORECAST_VARIABLES]
    files.write_csv(issued.select("asset", seconds, "range", *values), path)
    fcast = forecast.prepare_forecasts(files.read_csv_by_name(spark, path, types))
    paired = forecast.forecast_join(raw.select("asset", "timestamp", "day", "fcast_day", "WNACWindSpeed"), fcast)
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("timestamp", "fcast_day", "fcast_time")}
    wanted = ["asset", "timestamp", "day", "fcast_day", "range", "fcast_time", "WNACWindSpeed", "WNACWindSpeed_fcast"]
    return rounded(paired.withColumns(times).select(*wanted), *wanted[6:])


@query
def evaluation_flow(spark, sf):
    """Trained on all but the last days, whose readings and forecasts are the evaluation: one CSV folder per day."""
    raw, fcast = _raw_and_forecasts(spark, sf)
    raw = raw.select("asset", "timestamp", "fcast_day", "WTURPower")
    cut = fcast.agg(F.date_sub(F.max("fcast_day"), TEST_DAYS).alias("cut"))
    known, later = (fcast.join(F.broadcast(cut), when).drop("cut") for when in (F.col("fcast_day") <= F.col("cut"), F.col("fcast_day") > F.col("cut")))
    path = fresh_path(spark, "evaluation")
    train = forecast.training_table(raw, known)
    flows.evaluate_to_daily_files(train, forecast.forecast_join(raw, later), ["WNACWindSpeed_fcast"], 10.0, path, curve="linear")
    return rounded(files.read_daily_csv(spark, path), "pred_WTURPower")


@query
def table_profile(spark, sf):
    return quality.table_profile(roles.telemetry(spark, sf), "asset", "variable", "timestamp")


@query
def distinct_keys(spark, sf):
    return roles.telemetry(spark, sf).select(*SERIES).distinct()


@query
def first_keys(spark, sf):
    tel = roles.telemetry(spark, sf)
    return tel.agg(
        F.min("asset").alias("asset"),
        F.min("variable").alias("variable"),
        F.min(F.dayofyear("timestamp")).alias("day_of_year"),
    )


@query
def series_stats(spark, sf):
    return rounded(quality.series_stats(roles.telemetry(spark, sf), SERIES, "value"), "mean", "std")


@query
def step_to_previous(spark, sf):
    steps = ordered.step_to_previous(roles.telemetry(spark, sf), SERIES, "timestamp")
    return rounded(steps.select("event_id", *SERIES, "step_s"), "step_s")


@query
def missing_matrix(spark, sf):
    return quality.missing_matrix(roles.hourly(spark, sf), "variable", "asset", "timestamp", "value", roles.ASSETS)


@query
def gap_report(spark, sf):
    grid, table = _on_grid(spark, sf)
    return quality.gap_report(table, SERIES, "timestamp", "value", roles.HOUR, grid.slices())


@query
def outlier_rows(spark, sf):
    flagged = quality.sigma_outliers(roles.telemetry(spark, sf), SERIES, "value")
    return flagged.filter("is_outlier").select("event_id", *SERIES, "value")


@query
def outlier_matrix(spark, sf):
    return quality.outlier_matrix(roles.telemetry(spark, sf), "variable", "asset", "value", roles.ASSETS)


@query
def masked_outliers(spark, sf):
    masked = quality.masked_outliers(roles.telemetry(spark, sf), SERIES, "value")
    return masked.select("event_id", *SERIES, "masked")


@query
def shared_histogram(spark, sf):
    return quality.shared_histogram(roles.telemetry(spark, sf), "variable", "asset", "value", 100)


@query
def variables_by_type(spark, sf):
    return reshape.variables_tagged(roles.telemetry(spark, sf), "i").select("event_id", "variable", "value")


@query
def dropna_any(spark, sf):
    complete = reshape.drop_missing_rows(roles.raw_history(roles.hourly(spark, sf)))
    return rounded(complete.select("asset", "timestamp", *roles.SENSOR_COLUMNS), *roles.SENSOR_COLUMNS)


@query
def drop_null_columns(spark, sf):
    return reshape.drop_null_columns(roles.raw_history(roles.hourly(spark, sf, reused=True)))


def _on_grid(spark, sf) -> tuple[reshape.Grid, DataFrame]:
    """The hourly grid and the table on it, NULL where a reading is missing."""
    means = roles.hourly(spark, sf, reused=True)
    grid = reshape.Grid.measure(means, SERIES, "timestamp", roles.HOUR)
    return grid, grid.fill(means, "value")


def _filled(spark, sf) -> tuple[reshape.Grid, DataFrame]:
    grid, table = _on_grid(spark, sf)
    return grid, ordered.interpolate_linear(table, SERIES, "timestamp", "value", slices=grid.slices())


@query
def linear_interpolate(spark, sf):
    return rounded(_filled(spark, sf)[1], "value", digits=8)


@query
def union_by_name(spark, sf):
    orders = roles.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("timestamp"), F.col("o_totalprice").alias("value")
    )
    lines = roles.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("timestamp"),
        F.col("l_orderkey").alias("key"), F.col("l_quantity").alias("quantity"),
    )
    return orders.unionByName(lines, allowMissingColumns=True)


# --- correlation and spectrum -------------------------------------------------------------


@query
def correlation_matrix(spark, sf):
    hourly = roles.hourly(spark, sf).withColumn("id", fn.series_id(F.col("variable"), F.col("asset")))
    return rounded(correlation.correlation_long(hourly, "timestamp", "id", "value"), "corr")


@query
def correlation_by_asset(spark, sf):
    hourly = roles.hourly(spark, sf)
    return rounded(correlation.correlation_long(hourly, "timestamp", "variable", "value", within="asset"), "corr")


def _spectrum(spark, sf) -> tuple[Slices, DataFrame]:
    """Centred spectra of whole series, each from its own first reading on, and slices of their bins if a series is long."""
    grid, filled = _filled(spark, sf)
    spectrum = spectral.fft_magnitude(filled, SERIES, "timestamp", "value", slices=grid.slices(), step=HOUR_MICROS)
    centred = spectral.centre_spectrum(spectrum, roles.HOUR)
    if not grid.slices().single:
        return plan_slices(centred, SERIES, "k_shift"), centred
    return Slices(tuple(SERIES), "k_shift", n_keys=grid.n_series), centred


@query
def dft_magnitude(spark, sf):
    grid, filled = _filled(spark, sf)
    spectrum = spectral.dft_magnitude(filled, SERIES, "timestamp", "value", BINS, grid.slices(), HOUR_MICROS)
    return rounded(spectrum, "amp")


@query
def fft_magnitude(spark, sf):
    grid, filled = _filled(spark, sf)
    spectrum = spectral.fft_magnitude(
        filled, SERIES, "timestamp", "value", slices=grid.slices(), step=HOUR_MICROS
    )
    centred = spectral.centre_spectrum(spectrum, roles.HOUR)
    return rounded(centred, "amp").withColumn("freq", F.round("freq", 12))


@query
def cumulative_energy(spark, sf):
    slices, spectrum = _spectrum(spark, sf)
    energy = spectral.cumulative_energy(spectrum, SERIES, "k_shift", slices=slices)
    return rounded(energy.select(*SERIES, "k_shift", "cum_energy"), "cum_energy")


@query
def energy_band(spark, sf):
    slices, spectrum = _spectrum(spark, sf)
    energy = spectral.cumulative_energy(spectrum, SERIES, "k_shift", slices=slices)
    inside = spectral.energy_band(energy.select(*SERIES, "k_shift", "freq", "amp", "cum_energy"), k="freq")
    return rounded(inside.drop("freq"), "amp", "cum_energy")


@query
def spectral_correlation(spark, sf):
    """Whole series; those of an asset are compared at the frequencies of its longest one."""
    grid, filled = _filled(spark, sf)
    spectrum = spectral.fft_magnitude(
        filled, SERIES, "timestamp", "value", slices=grid.slices(), step=HOUR_MICROS, within="asset"
    )
    return rounded(spectral.spectral_correlation(spectrum), "corr")


@query
def quadrature_demo(spark, sf):
    """Every series against its copy six hours behind: apart in time, equal in the spectrum."""
    grid, filled = _filled(spark, sf)
    both = spectral.with_late_copies(filled, "timestamp", 6 * roles.HOUR)
    in_time = correlation.correlation_long(both, "timestamp", "variable", "value", within="asset")
    # A delayed series has as many points as its origin; `n` counts hours from its own start.
    spectrum = spectral.fft_magnitude(both, SERIES, "timestamp", "value", slices=grid.slices(), step=HOUR_MICROS)
    in_bins = spectral.spectral_correlation(spectrum)
    pairs = in_time.withColumn("domain", F.lit("time")).unionByName(in_bins.withColumn("domain", F.lit("spectrum")))
    return rounded(pairs.filter(F.col("var_b") == F.concat("var_a", F.lit("_late"))), "corr")


# --- forecasts ----------------------------------------------------------------------------


def _raw_and_forecasts(spark, sf) -> tuple[DataFrame, DataFrame]:
    means = roles.hourly(spark, sf, reused=True)
    return roles.raw_history(means), roles.forecasts(means)


def _truth(spark, sf) -> DataFrame:
    raw, fcast = _raw_and_forecasts(spark, sf)
    return forecast.attach_truth(fcast, raw, "WNACWindSpeed")


@query
def forecast_join(spark, sf):
    raw, fcast = _raw_and_forecasts(spark, sf)
    joined = forecast.forecast_join(raw.select("asset", "timestamp", "fcast_day", "WTURPower"), fcast)
    wanted = [*CELL, "timestamp", "fcast_time", "WTURPower", "WNACWindSpeed_fcast", "WNACAmbTemp_fcast"]
    return rounded(joined.select(*wanted), *wanted[5:])


@query
def attach_truth(spark, sf):
    return rounded(
        _truth(spark, sf).select(*CELL, "WNACWindSpeed_fcast", "true_WNACWindSpeed"),
        "WNACWindSpeed_fcast",
        "true_WNACWindSpeed",
    )


def _split(spark, sf) -> tuple[DataFrame, DataFrame]:
    raw, fcast = _raw_and_forecasts(spark, sf)
    slim = raw.select("asset", "timestamp", "fcast_day", "WTURPower")
    return forecast.train_test_by_day(slim, fcast, num_days=TEST_DAYS)


_SPLIT_COLUMNS = [*CELL, "timestamp", "WTURPower", "WNACWindSpeed_fcast", "true_WTURPower"]


@query
def test_days(spark, sf):
    return rounded(_split(spark, sf)[1].select(*_SPLIT_COLUMNS), *_SPLIT_COLUMNS[4:])


@query
def train_days(spark, sf):
    return rounded(_split(spark, sf)[0].select(*_SPLIT_COLUMNS), *_SPLIT_COLUMNS[4:])


@query
def days_except(spark, sf):
    fcast = roles.forecasts(roles.hourly(spark, sf, reused=True))
    return sampling.days_except(fcast, sampling.pick_days(fcast, "fcast_day", TEST_DAYS), "fcast_day")


@query
def forecast_error_field(spark, sf):
    field = forecast.error_field(_truth(spark, sf), "true_WNACWindSpeed", "WNACWindSpeed_fcast")
    return rounded(field, "true_mean", "pred_mean", "delta", digits=8)


@query
def error_stats_by_range(spark, sf):
    stats = forecast.error_stats(_truth(spark, sf), "true_WNACWindSpeed", "WNACWindSpeed_fcast")
    return rounded(stats, "mean", "std", "min", "max", "p25", "p50", "p75", "mean_plus_std", digits=8)


@query
def regression_metrics(spark, sf):
    scores = forecast.regression_metrics(_truth(spark, sf), "true_WNACWindSpeed", "WNACWindSpeed_fcast", ["range"])
    return rounded(scores, "mse", "r2", digits=4)


@query
def forecast_report(spark, sf):
    report = forecast.forecast_report(
        _truth(spark, sf), "true_WNACWindSpeed", "WNACWindSpeed_fcast", ["true_WNACWindSpeed", "WNACWindSpeed_fcast"]
    )
    return rounded(report, "mean_delta", "max_delta", "mse", "r2")


def _blend(spark, sf) -> DataFrame:
    """Predictions that repeat per reading, as evaluation rows do."""
    raw, fcast = _raw_and_forecasts(spark, sf)
    slim = raw.select("asset", "timestamp", "fcast_day", "WNACWindSpeed")
    joined = forecast.forecast_join(slim, fcast.filter(F.col("WNACWindSpeed_fcast").isNotNull()))
    blended = F.col("WNACWindSpeed_fcast") * BLEND[0] + F.coalesce("WNACWindSpeed", F.lit(0.0)) * BLEND[1]
    return forecast.latest_prediction(joined.withColumn("pred_WTURPower", blended)).persist()


@query
def latest_prediction(spark, sf):
    return rounded(_blend(spark, sf), "pred_WTURPower")


@query
def densify_grid(spark, sf):
    grid = reshape.densify(_blend(spark, sf), ["asset", "fcast_day"], "range", "pred_WTURPower", 600)
    return rounded(grid, "pred_WTURPower")


@query
def linear_10min(spark, sf):
    keys = ["asset", "fcast_day"]
    grid = reshape.densify(_blend(spark, sf), keys, "range", "pred_WTURPower", 600)
    return rounded(splines.linear_curve(grid, keys, "range", "pred_WTURPower"), "pred_WTURPower")


@query
def spline_10min(spark, sf):
    return rounded(flows.fine_predictions(_blend(spark, sf)), "pred_WTURPower")


@query
def daily_csv_round_trip(spark, sf):
    """Fine predictions written as one folder per day and read back."""
    keys, path = ["asset", "fcast_day"], fresh_path(spark, "daily")
    grid = reshape.densify(_blend(spark, sf), keys, "range", "pred_WTURPower", 600)
    files.write_daily_csv(splines.linear_curve(grid, keys, "range", "pred_WTURPower"), path)
    return rounded(files.read_daily_csv(spark, path), "pred_WTURPower")


@query
def spline_six_hourly(spark, sf):
    """Spline through six-hour means of the predictions: one cubic per day with all four knots."""
    keys = ["asset", "fcast_day"]
    start = (F.floor(F.col("range") / 21_600) * 21_600).cast("bigint")
    means = _blend(spark, sf).groupBy(*keys, start.alias("range")).agg(F.avg("pred_WTURPower").alias("pred_WTURPower"))
    return rounded(flows.fine_predictions(means), "pred_WTURPower")


# --- learning -----------------------------------------------------------------------------


@query
def ridge_gram(spark, sf):
    lines = roles.table(spark, sf, "lineitem")
    thousands = lines.select(*LINE_FEATURES, (F.col("l_extendedprice") / 1000).alias("price_k"))
    gram = regression.ridge_gram(thousands, LINE_FEATURES, "price_k")
    return rounded(gram, *[c for c in gram.columns if c != "n"], digits=2)


@query
def ridge_fit(spark, sf):
    lines = roles.table(spark, sf, "lineitem").select(*LINE_FEATURES, "l_extendedprice")
    model = regression.fit_grouped_ridge(lines, [], LINE_FEATURES, "l_extendedprice", ALPHAS)
    weights = [F.col("coef")[i].alias(c) for i, c in enumerate(["quantity", "discount", "tax"])]
    return rounded(model.select("alpha", "intercept", *weights), "intercept", "quantity", "discount", "tax", digits=4)


def _power_table(spark, sf) -> DataFrame:
    raw, fcast = _raw_and_forecasts(spark, sf)
    return forecast.training_table(raw.select("asset", "timestamp", "fcast_day", "WTURPower"), fcast)


@query
def grouped_ridge(spark, sf):
    table = _power_table(spark, sf)
    features = ["WTURPower", "range", "WNACWindSpeed_fcast"]
    model = regression.fit_grouped_ridge(table, ["asset"], features, "true_WTURPower", [1.0])
    out = model.select(
        "asset", "n", "intercept", *[F.col("coef")[i].alias(f"w{i + 1}") for i in range(len(features))]
    )
    return rounded(out, "intercept", "w1", "w2", "w3")


@query
def grouped_ridge_predictions(spark, sf):
    table = _power_table(spark, sf)
    features = ["WTURPower", "range", "WNACWindSpeed_fcast"]
    model = regression.fit_grouped_ridge(table, ["asset"], features, "true_WTURPower", [1.0])
    predicted = regression.predict_grouped(table, model, ["asset"], features, "pred_WTURPower")
    return rounded(forecast.latest_prediction(predicted), "pred_WTURPower")


def _complete(spark, sf) -> DataFrame:
    """Wide telemetry without inner gaps."""
    filled = roles.sensor_names(_filled(spark, sf)[1])
    return flows.wide_history(filled, roles.SENSOR_COLUMNS)


def _learning(spark, sf, complete: bool = True) -> tuple[DataFrame, list[str]]:
    raw, fcast = _complete(spark, sf), roles.forecasts(roles.hourly(spark, sf, reused=True))
    table = forecast.training_table(raw, fcast)
    table = table.na.drop("any") if complete else table
    return stage(table, ["asset", "timestamp"]), regression.feature_columns(table)


@query
def pca_variance(spark, sf):
    shares = regression.pca_variance(_complete(spark, sf), ["asset"], roles.SENSOR_COLUMNS, 1, len(roles.SENSOR_COLUMNS))
    return rounded(shares, "explained")


@query
def pca_variance_pair(spark, sf):
    raw = roles.raw_history(roles.hourly(spark, sf))
    return rounded(regression.pca_variance(raw, ["asset"], ["WNACWindSpeed", "WNACAmbTemp"], 1, 2), "explained")


@query
def quadratic_ridge(spark, sf):
    raw, fcast = _raw_and_forecasts(spark, sf)
    table = forecast.attach_truth(fcast, raw, "WTURPower")
    inputs = ["WNACWindSpeed_fcast"]
    models = grouped_pipeline.fit_grouped_pipeline(table, ["asset"], inputs, "true_WTURPower", [10.0])
    out = grouped_pipeline.predict_grouped_pipeline(table, models, ["asset"], inputs, "pred_WTURPower")
    return rounded(out.select(*CELL, "pred_WTURPower"), "pred_WTURPower")


@query
def grid_search_scores(spark, sf):
    table, inputs = _learning(spark, sf)
    folded = regression.with_folds(table, "timestamp", ["asset", "range"])
    grid = {a: (lambda train, a=a: regression.ridge(train, "true_WTURPower", a)) for a in ALPHAS}
    result = regression.grid_search(folded, inputs, "true_WTURPower", grid)
    rows = [(a, s, a == result.best) for a, s in result.scores.items()]
    return rounded(spark.createDataFrame(rows, "alpha double, r2 double, best boolean"), "r2")


@query
def per_asset_predictions(spark, sf):
    table, inputs = _learning(spark, sf, complete=False)
    out = flows.day_ahead_predictions(table, table, inputs, 1e-3)
    return rounded(out, "pred_WTURPower")


def _folded(table: DataFrame) -> DataFrame:
    return regression.with_folds(table.na.drop("any"), "timestamp", ["range"], keys=["asset"])


@query
def grouped_grid_search(spark, sf):
    table, inputs = _learning(spark, sf, complete=False)
    scores, _ = grouped_pipeline.grouped_grid_search(_folded(table), ["asset"], inputs, "true_WTURPower", ALPHAS)
    return rounded(scores, "r2")


@query
def grouped_grid_search_single(spark, sf):
    """One input: wind speed forecast against power."""
    folded = regression.with_folds(_power_pairs(spark, sf), "fcast_time", ["range"], keys=["asset"])
    scores, models = grouped_pipeline.grouped_grid_search(folded, ["asset"], ["WNACWindSpeed_fcast"], "true_WTURPower", ALPHAS)
    chosen = models.select("asset", F.col("alpha").alias("best"), "n")
    return rounded(scores.join(chosen, "asset").select("asset", "alpha", "r2", (F.col("alpha") == F.col("best")).alias("best"), "n"), "r2")


def _power_pairs(spark, sf) -> DataFrame:
    raw, fcast = _raw_and_forecasts(spark, sf)
    truth = forecast.attach_truth(fcast, raw, "WTURPower").select("asset", "fcast_time", "range", "WNACWindSpeed_fcast", "true_WTURPower")
    return truth.na.drop("any")


@query
def fleet_predictions(spark, sf):
    table, inputs = _learning(spark, sf, complete=False)
    return rounded(flows.fleet_predictions(_folded(table), table, inputs, ALPHAS), "pred_WTURPower")


@query
def nonlinear_fit(spark, sf):
    table, inputs = _learning(spark, sf)
    model = regression.fit_pipeline(
        table, inputs, "true_WTURPower", lambda t: regression.boosted_trees("true_WTURPower", iterations=5, depth=3)
    )
    scored = model.transform(table)
    return rounded(forecast.regression_metrics(scored, "true_WTURPower", "prediction", ["asset"]), "mse", "r2")


def _states(spark, sf) -> DataFrame:
    return _complete(spark, sf).select("asset", "timestamp", *roles.SENSOR_COLUMNS)


@query
def kmeans_labels(spark, sf):
    return clustering.kmeans_labels(_states(spark, sf), roles.SENSOR_COLUMNS, ["asset", "timestamp"], k=8, steps=KMEANS_STEPS)


@query
def silhouette_sweep(spark, sf):
    scores = clustering.silhouette_sweep(_states(spark, sf), roles.SENSOR_COLUMNS, ["timestamp"], range(2, 15), steps=KMEANS_STEPS)
    return rounded(scores, "silhouette")


@query
def state_projection_2d(spark, sf):
    states = stage(_states(spark, sf), ["asset", "timestamp"])
    keep = ["asset", "timestamp"]
    labelled = clustering.kmeans_labels(states, roles.SENSOR_COLUMNS, keep, k=8, steps=KMEANS_STEPS)
    flat = clustering.state_projection(states, ["asset"], roles.SENSOR_COLUMNS, keep)
    return rounded(labelled.join(flat, keep).select(*keep, "label", "x", "y"), "x", "y")


def queries() -> dict[str, Query]:
    return dict(QUERIES)

