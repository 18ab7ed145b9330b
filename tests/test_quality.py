import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import quality, reshape
from sensorloom.operators.sizing import checked_broadcast, plan_slices

SCHEMA = "asset string, variable string, timestamp timestamp_ntz, value double"


def grid_rows(at, missing, n=9, asset="A001"):
    return [(asset, "v", at(10 * i), None if 10 * i in missing else 1.0) for i in range(n)]


def test_gap_report(spark, at):
    rows = grid_rows(at, {10, 20, 30, 60}) + grid_rows(at, set(), asset="A002")
    report = quality.gap_report(spark.createDataFrame(rows, SCHEMA), "asset", "timestamp", "value", 600)
    found = sorted(map(tuple, report.collect()))
    assert found == [(at(10), at(40), 1800, "A001"), (at(60), at(70), 600, "A001")]


def test_gaps_per_asset_and_variable_in_order_of_start(spark, at):
    rows = [("A001", v, at(10 * i), None if i in gaps else 1.0) for v, gaps in (("v", {4, 5}), ("w", {1, 4})) for i in range(9)]
    report = quality.gap_report(spark.createDataFrame(rows, SCHEMA), ["asset", "variable"], "timestamp", "value", 600)
    assert report.columns == ["start", "stop", "duration_s", "asset", "variable"]
    assert list(map(tuple, report.collect())) == [
        (at(10), at(20), 600, "A001", "w"),
        (at(40), at(60), 1200, "A001", "v"),
        (at(40), at(50), 600, "A001", "w"),
    ]


def test_readings_off_the_grid_fail(spark, at):
    rows = [("A001", "v", at(0), 1.0), ("A001", "v", at(15), 2.0), ("A001", "v", at(30), 3.0), ("A001", "v", None, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    grid = reshape.Grid.measure(df, ["asset", "variable"], "timestamp", 600)
    with pytest.raises(Exception, match="no grid point"):
        grid.fill(df, "value").collect()
    fitting = df.filter("value <> 2")
    assert sorted(r.value for r in grid.fill(fitting, "value").collect() if r.value) == [1.0, 3.0]


def test_no_gaps(spark, at):
    df = spark.createDataFrame(grid_rows(at, set()), SCHEMA)
    assert quality.gap_report(df, "asset", "timestamp", "value", 600).count() == 0


@pytest.mark.parametrize("rows_per_slice", [2, 5, 30])
def test_sliced_gaps_equal_plain(spark, at, rows_per_slice):
    rng = np.random.default_rng(rows_per_slice)
    rows = []
    for asset, share in (("A001", 0.8), ("A002", 0.3)):
        missing = {10 * i for i in range(200) if rng.random() < share or 50 <= i < 90}
        rows += grid_rows(at, missing, 200, asset)
    df = spark.createDataFrame(rows, SCHEMA)
    slices = plan_slices(df.filter(F.col("value").isNull()), ["asset"], "timestamp", rows_per_slice)
    assert not slices.single
    plain = quality.gap_report(df, "asset", "timestamp", "value", 600)
    cut = quality.gap_report(df, "asset", "timestamp", "value", 600, slices=slices)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))
    total = plain.agg(F.sum("duration_s")).first()[0]
    assert total == df.filter(F.col("value").isNull()).count() * 600


def test_outliers(spark, at):
    rows = [("A001", "v", at(i), 0.0) for i in range(19)] + [("A001", "v", at(19), 100.0), ("A001", "v", at(20), None)]
    flagged = quality.sigma_outliers(spark.createDataFrame(rows, SCHEMA), ["asset", "variable"], "value")
    hits = flagged.filter("is_outlier").collect()
    assert len(hits) == 1 and hits[0].value == 100 and flagged.filter("is_outlier is null").count() == 0


def test_histogram(spark, at):
    rows = [("A001", "v", at(i), float(i)) for i in range(11)]
    bins = {r.bin: r.n for r in quality.shared_histogram(spark.createDataFrame(rows, SCHEMA), "variable", "asset", "value", 10).collect()}
    assert bins == {**{i: 1 for i in range(1, 10)}, 10: 2}
    flat = spark.createDataFrame([("A001", "v", at(0), 3.0)] * 4, SCHEMA)
    assert [(r.bin, r.n) for r in quality.shared_histogram(flat, "variable", "asset", "value", 10).collect()] == [(6, 4)]


def test_missing_matrix_counts_absent_and_null_cells(spark, at):
    rows = [("A001", "x", at(0), 1.0), ("A001", "x", at(1), None), ("A002", "x", at(2), 1.0), ("A001", "y", at(0), 2.0)]
    out = quality.missing_matrix(spark.createDataFrame(rows, SCHEMA), "variable", "asset", "timestamp", "value")
    assert sorted(map(tuple, out.collect())) == [("x", 2, 2), ("y", 2, 3)]


def test_describe(spark):
    df = spark.createDataFrame([("r", float(v)) for v in (1, 2, 4, 8)], "range string, delta double")
    row = quality.describe(df, ["range"], "delta").first()
    assert (row["count"], row["mean"], row["min"], row["max"]) == (4, 3.75, 1, 8)
    assert (row.p25, row.p50, row.p75) == (1.75, 3, 5) and abs(row["std"] - 3.095696) < 1e-6


@pytest.mark.parametrize("rows_per_slice", [3, 17])
def test_sliced_quantiles_equal_numpy(noisy, rows_per_slice):
    out = quality.describe(noisy, ["asset"], "value", rows_per_slice).toPandas().set_index("asset")
    pdf = noisy.toPandas()
    for asset, one in pdf.groupby("asset"):
        known = one.value.dropna()
        assert np.allclose(out.loc[asset, ["p25", "p50", "p75"]].astype(float), np.quantile(known, [0.25, 0.5, 0.75]))
        assert out.loc[asset, "count"] == len(known)


@pytest.mark.parametrize("rows_per_slice", [5, 100])
def test_quantiles_of_a_key_full_of_one_value(spark, rows_per_slice):
    """One value in 99 % of the rows of a sliced key is one row of counts."""
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(1980, 7.0), rng.normal(7, 50, 20)])
    rng.shuffle(values)
    rows = [("hot", float(v)) for v in values] + [("even", float(v)) for v in rng.integers(0, 40, 300) / 4] + [("short", 1.0), ("short", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "asset string, value double").repartition(5)
    out = quality.describe(df, ["asset"], "value", rows_per_slice).toPandas().set_index("asset")
    for asset in ("hot", "even", "short"):
        known = [v for a, v in rows if a == asset]
        assert np.allclose(out.loc[asset, ["p25", "p50", "p75"]].astype(float), np.quantile(known, [0.25, 0.5, 0.75]))
    assert out.loc["hot", "p50"] == 7 and out.loc[["none"], ["p25", "p50", "p75"]].isna().all().all()


def test_table_profile(noisy):
    row = quality.table_profile(noisy, "asset", "variable", "timestamp").first()
    assert (row.n_assets, row.n_variables, row.n_rows) == (3, 1, 463)
    close = quality.table_profile(noisy, "asset", "variable", "timestamp", approx=True).first()
    assert close.n_assets == 3


def test_checked_broadcast_limits(spark):
    small = spark.range(10)
    assert "BroadcastHashJoin" in _plan(spark.range(100).join(checked_broadcast(small, 10), "id"))
    big = checked_broadcast(small, 9)
    assert big is small


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_fill_and_blocks(spark, at):
    rows = [("A001", "v", at(0), 1.0), ("A001", "v", at(50), 2.0), ("A002", "v", at(20), 3.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    grid = reshape.Grid.measure(df, ["asset", "variable"], "timestamp", 600)
    assert grid.points_per_series == 6 and grid.n_series == 2
    assert sorted(map(tuple, grid.points().collect())) == sorted(map(tuple, grid.points(points_per_block=2).collect()))
    filled = grid.fill(df, "value")
    assert filled.count() == 12 and filled.filter("value is not null").count() == 3
    cut = grid.slices(rows_per_slice=2).add(filled).toPandas().sort_values(["asset", "timestamp"])
    assert cut.groupby("asset")["_slice"].apply(lambda s: s.is_monotonic_increasing and s.nunique() == 3).all()


def test_grid_of_empty_table(spark):
    grid = reshape.Grid.measure(spark.createDataFrame([], SCHEMA), ["asset"], "timestamp", 600)
    assert grid.points().count() == 0


def test_grid_keeps_datetimes(spark):
    start = dt.datetime(2024, 3, 31, 1, 30)
    df = spark.createDataFrame([("A001", "v", start + dt.timedelta(hours=h), 1.0) for h in (0, 3)], SCHEMA)
    points = [r.timestamp for r in reshape.Grid.measure(df, ["asset"], "timestamp", 3600).points().collect()]
    assert sorted(points) == [start + dt.timedelta(hours=h) for h in range(4)]
