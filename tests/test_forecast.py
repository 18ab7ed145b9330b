import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import forecast, reshape, sampling, splines
from sensorloom.operators.ordered import positions

DAY = 86_400


def epoch(day, seconds=0):
    return int(dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc).timestamp()) + seconds


@pytest.fixture
def raw(spark):
    rows = [("A001", epoch(1, 0), 1.0, 5.0), ("A001", epoch(1, 600), 2.0, 6.0), ("A001", epoch(2, 3600), 3.0, 7.0)]
    return forecast.prepare_raw(spark.createDataFrame(rows, "asset string, unixtime bigint, WTURPower double, WNACWindSpeed double"))


@pytest.fixture
def issued(spark):
    rows = [("A001", epoch(2), r, 1.0, 2.0) for r in (0, 3600, 7200)] + [("A001", epoch(2, 21_600), 0, 1.0, 2.0)]
    schema = "asset string, unixtime bigint, range bigint, WNACWindSpeed double, WNACAmbTemp double"
    return forecast.prepare_forecasts(spark.createDataFrame(rows, schema))


def test_join_pairs_a_day_with_midnight_forecasts_of_the_next(raw, issued):
    joined = forecast.forecast_join(raw, issued)
    assert joined.count() == 6
    assert {"WNACWindSpeed_fcast", "WNACAmbTemp_fcast", "fcast_time"} <= set(joined.columns)
    assert {r.timestamp.day for r in joined.collect()} == {1}


def test_truth_is_missing_where_not_measured(raw, issued):
    truth = {(r.range, r.fcast_day.hour): r.true_WTURPower for r in forecast.attach_truth(issued, raw, "WTURPower").collect()}
    assert truth == {(0, 0): None, (3600, 0): 3.0, (7200, 0): None, (0, 6): None}


def test_truth_must_be_unique(raw, issued):
    with pytest.raises(Exception, match="duplicate key"):
        forecast.attach_truth(issued, raw.unionByName(raw), "WTURPower").collect()


def test_whole_days_are_held_out(spark):
    rows = [(dt.date(2024, 1, d), i) for d in range(1, 11) for i in range(4)]
    df = spark.createDataFrame(rows, "fcast_day date, i int")
    train, test = sampling.split_by_day(df, "fcast_day", 3, seed="s")
    days = lambda d: {r.fcast_day for r in d.select("fcast_day").collect()}
    assert len(days(test)) == 3 and not days(test) & days(train)
    assert train.count() + test.count() == 40
    assert days(test) == days(sampling.split_by_day(df, "fcast_day", 3, seed="s")[1])
    assert sampling.split_by_day(df, "fcast_day", 0)[1].count() == 0
    assert sampling.days_except(df, test, "fcast_day").count() == 7


def test_error_field(spark):
    df = spark.createDataFrame([("d", 0, 1.0, 2.0), ("d", 0, 3.0, 6.0)], "fcast_day string, range int, t double, p double")
    assert forecast.error_field(df, "t", "p").first().delta == 2


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (None, 1.0)], "y double, p double")
    row = forecast.regression_metrics(df, "y", "p").first()
    assert row.n == 3 and np.isclose(row.mse, 1 / 3) and np.isclose(row.r2, 0.5)


def test_latest_prediction(spark, at):
    rows = [("A001", "d", 0, at(1), 1.0), ("A001", "d", 0, at(3), 3.0), ("A001", "d", 0, at(2), 2.0)]
    df = spark.createDataFrame(rows, "asset string, fcast_day string, range int, timestamp timestamp_ntz, pred_WTURPower double")
    assert forecast.latest_prediction(df).first().pred_WTURPower == 3


@pytest.mark.parametrize("n", [3, 7, 8])
def test_contiguous_folds(spark, n):
    df = spark.createDataFrame([(i, 1) for i in range(n)], "x int, g int")
    folded = sampling.contiguous_folds(positions(df, ["g"], "x").withColumn("size", F.lit(n)), "size")
    found = [r.fold for r in folded.orderBy("x").collect()]
    assert found == [f for f, part in enumerate(np.array_split(np.arange(n), 3)) for _ in part]


def test_spline_of_a_cubic(spark):
    rows = [("A001", x, x**3 if x == int(x) and x <= 4 else None) for x in (0.0, 1.0, 1.5, 2.0, 3.0, 3.5, 4.0, 5.0)]
    out = {r.x: r.y for r in splines.spline(spark.createDataFrame(rows, "asset string, x double, y double"), ["asset"], "x", "y").collect()}
    assert np.isclose(out[1.5], 3.375) and np.isclose(out[3.5], 42.875) and out[5.0] is None and out[2.0] == 8


@pytest.mark.parametrize("n", [4, 5, 9, 30])
def test_spline_satisfies_its_equations(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.uniform(0.5, 2, n))
    y = rng.normal(size=n)
    assert np.allclose(splines.not_a_knot(x, y, x), y)
    h = 1e-4
    slope = lambda t, s: (splines.not_a_knot(x, y, np.array([t + s]))[0] - splines.not_a_knot(x, y, np.array([t]))[0]) / s
    for t in x[1:-1]:
        assert abs(slope(t, h) - slope(t, -h)) < 1e-2
    # Not-a-knot: the first three knots and the next one share a single cubic at both ends.
    for ends in (slice(0, 3), slice(n - 3, n)):
        t = np.linspace(x[ends][0], x[ends][-1], 9)
        values = splines.not_a_knot(x, y, t)
        assert np.allclose(np.polyval(np.polyfit(t, values, 3), t), values, atol=1e-7)


def test_few_knots_are_joined_by_lines(spark):
    assert np.allclose(splines.not_a_knot(np.array([0.0, 2.0]), np.array([0.0, 4.0]), np.array([1.0, 3.0])), [2, np.nan], equal_nan=True)
    assert np.isnan(splines.not_a_knot(np.array([]), np.array([]), np.array([1.0]))).all()


def test_densify_refuses_values_off_the_grid(spark):
    schema = "asset string, fcast_day string, range int, pred double"
    df = spark.createDataFrame([("A001", "d", 0, 0.0), (None, "d", 1200, 2.0), ("A001", "d", 900, 1.0)], schema)
    fits = reshape.densify(df.filter("range <> 900"), ["asset", "fcast_day"], "range", "pred", 600)
    assert sorted((str(r.asset), r.range, r.pred) for r in fits.collect() if r.pred is not None) == [("A001", 0, 0.0), ("None", 1200, 2.0)]
    with pytest.raises(Exception, match="no grid point"):
        reshape.densify(df, ["asset", "fcast_day"], "range", "pred", 600).collect()


def test_densify_and_linear_curve(spark):
    rows = [("A001", "d", 0, 0.0), ("A001", "d", 3600, 6.0), ("A002", "d", 3600, 1.0)]
    df = spark.createDataFrame(rows, "asset string, fcast_day string, range int, pred double")
    grid = reshape.densify(df, ["asset", "fcast_day"], "range", "pred", 600)
    assert grid.count() == 14
    out = splines.linear_curve(grid, ["asset", "fcast_day"], "range", "pred")
    one = [r.pred for r in out.filter("asset = 'A001'").orderBy("range").collect()]
    assert np.allclose(one, np.arange(7))
    two = [r.pred for r in out.filter("asset = 'A002'").orderBy("range").collect()]
    assert two == [None] * 6 + [1]
