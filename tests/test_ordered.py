import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import ordered
from sensorloom.operators.sizing import plan_slices

KEYS = ["asset", "variable"]


def collect(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def series(spark, values, at):
    rows = [("A001", "v", at(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "asset string, variable string, timestamp timestamp_ntz, value double")


def test_trailing_avg_rows(spark, at):
    out = ordered.trailing_avg(series(spark, [float(i) for i in range(1, 13)], at), KEYS, "timestamp", "value")
    ma = collect(out, "timestamp").ma.tolist()
    assert ma[0] == 1 and ma[9] == 5.5 and ma[10] == 6.5 and ma[11] == 7.5


def test_trailing_avg_skips_missing(spark, at):
    out = ordered.trailing_avg(series(spark, [2.0, None, 4.0], at), KEYS, "timestamp", "value")
    assert collect(out, "timestamp").ma.tolist() == [2, 2, 3]


def test_trailing_avg_keeps_assets_apart(spark, at):
    rows = [("A001", "v", at(0), 1.0), ("A002", "v", at(0), 100.0), ("A001", "v", at(1), 3.0), ("A002", "v", at(1), 200.0)]
    df = spark.createDataFrame(rows, "asset string, variable string, timestamp timestamp_ntz, value double")
    out = collect(ordered.trailing_avg(df, KEYS, "timestamp", "value"), "asset", "timestamp")
    assert out.ma.tolist() == [1, 2, 100, 150]


@pytest.mark.parametrize("rows_per_slice", [3, 7, 40])
def test_slices_are_ordered_and_bounded(noisy, rows_per_slice):
    slices = plan_slices(noisy, KEYS, "timestamp", rows_per_slice)
    assert not slices.single and slices.n_keys == 3 and slices.n_rows == 463 and slices.n_longest == 400
    out = slices.add(noisy).toPandas().sort_values(["asset", "timestamp"])
    for _, one in out.groupby("asset"):
        assert one["_slice"].is_monotonic_increasing
    sizes = out.groupby(["asset", "_slice"]).size()
    assert sizes.max() <= rows_per_slice or rows_per_slice == 3
    if rows_per_slice > 3:
        assert set(out[out.asset == "A003"]["_slice"]) == {0}


@pytest.mark.parametrize("rows_per_slice", [2, 5, 40])
def test_sliced_trailing_avg_equals_plain(noisy, rows_per_slice):
    slices = plan_slices(noisy, KEYS, "timestamp", rows_per_slice)
    plain = collect(ordered.trailing_avg(noisy, KEYS, "timestamp", "value"), "asset", "seq")
    cut = collect(ordered.trailing_avg(noisy, KEYS, "timestamp", "value", slices=slices), "asset", "seq")
    pd.testing.assert_frame_equal(plain, cut)


@pytest.mark.parametrize("width", [1, 60, 1800])
def test_trailing_avg_time_equals_brute_force(noisy, width):
    twice = noisy.unionByName(noisy.withColumn("value", F.col("value") + 1).withColumn("seq", F.col("seq") + 1000))
    out = collect(ordered.trailing_avg_time(twice, KEYS, "timestamp", "value", width), "asset", "seq")
    assert len(out) == 926
    for _, one in out.groupby("asset"):
        for _, row in one.iterrows():
            span = (one.timestamp > row.timestamp - pd.Timedelta(seconds=width)) & (one.timestamp <= row.timestamp)
            expected = one[span].value.mean()
            assert (np.isnan(expected) and np.isnan(row.ma)) or abs(expected - row.ma) < 1e-9


@pytest.mark.parametrize("rows_per_slice", [4, 50])
def test_sliced_positions_and_sums(noisy, rows_per_slice):
    slices = plan_slices(noisy, KEYS, "timestamp", rows_per_slice)
    numbered = collect(ordered.positions(noisy, KEYS, "timestamp", slices=slices), "asset", "seq")
    assert (numbered.pos == numbered.seq + 1).all()
    value = F.coalesce("value", F.lit(0.0))
    summed = collect(ordered.cumulative_sum(noisy, KEYS, "timestamp", value, slices=slices), "asset", "seq")
    expected = summed.assign(v=summed.value.fillna(0)).groupby("asset").v.cumsum()
    assert np.allclose(summed.cum, expected)
    steps = collect(ordered.step_to_previous(noisy, KEYS, "timestamp"), "asset", "seq")
    expected = steps.groupby("asset").timestamp.diff().dt.total_seconds()
    assert np.allclose(steps.step_s.fillna(-1), expected.fillna(-1))


def test_interpolate_linear(spark, at):
    df = series(spark, [None, 1.0, None, None, 4.0, None], at)
    filled = collect(ordered.interpolate_linear(df, KEYS, "timestamp", "value"), "timestamp").value.tolist()
    assert np.isnan(filled[0]) and filled[1:] == [1, 2, 3, 4, 4]
    inner = collect(ordered.interpolate_linear(df, KEYS, "timestamp", "value", inside_only=True), "timestamp")
    assert np.isnan(inner.value.iloc[-1])


@pytest.mark.parametrize("rows_per_slice", [2, 6, 60])
def test_sliced_interpolation_equals_pandas(noisy, rows_per_slice):
    slices = plan_slices(noisy, KEYS, "timestamp", rows_per_slice)
    out = collect(ordered.interpolate_linear(noisy, KEYS, "timestamp", "value", name="filled", slices=slices), "asset", "seq")
    expected = pd.concat([one.value.astype(float).interpolate() for _, one in out.groupby("asset")])
    assert np.allclose(out.filled.fillna(-1), expected.fillna(-1))


def test_empty_input(spark, noisy):
    empty = noisy.limit(0)
    assert ordered.trailing_avg(empty, KEYS, "timestamp", "value").count() == 0
    assert ordered.interpolate_linear(empty, KEYS, "timestamp", "value").count() == 0


def test_rows_without_time_go_to_the_first_slice(spark, at):
    from sensorloom.operators.sizing import plan_slices

    rows = [("a", at(i)) for i in range(40)] + [("a", None)]
    df = spark.createDataFrame(rows, "asset string, timestamp timestamp_ntz")
    slices = plan_slices(df, ["asset"], "timestamp", rows_per_slice=10)
    placed = slices.add(df).collect()
    assert not slices.single
    assert {r["_slice"] for r in placed if r["timestamp"] is None} == {min(r["_slice"] for r in placed)}


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Nothing is small enough to be broadcast."""
    from sensorloom.operators import sizing

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 0)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_carries_move_to_their_slice_without_broadcast(noisy, no_broadcast):
    """The same results where bounds, carries and offsets all go by shuffle; the readings are shuffled once more than plainly at most."""
    slices = plan_slices(noisy, KEYS, "timestamp", 7)
    work = {
        "average": lambda s: ordered.trailing_avg(noisy, KEYS, "timestamp", "value", slices=s),
        "positions": lambda s: ordered.positions(noisy, KEYS, "timestamp", slices=s),
        "sums": lambda s: ordered.cumulative_sum(noisy, KEYS, "timestamp", F.coalesce("value", F.lit(0.0)), slices=s),
        "fill": lambda s: ordered.interpolate_linear(noisy, KEYS, "timestamp", "value", slices=s),
    }
    for name, run in work.items():
        cut = run(slices)
        assert "Broadcast" not in cut._jdf.queryExecution().executedPlan().toString(), name
        plain = run(plan_slices(noisy, KEYS, "timestamp"))
        pd.testing.assert_frame_equal(collect(plain, "asset", "seq"), collect(cut, "asset", "seq")[plain.columns])


def test_slices_left_too_full_are_warned_of(noisy, monkeypatch):
    from sensorloom.operators import sizing

    monkeypatch.setattr(sizing, "_LEVELS", 1)
    monkeypatch.setattr(sizing, "_OVERCUT", 1)
    with pytest.warns(UserWarning, match="left after 1 cuts"):
        plan_slices(noisy, KEYS, "timestamp", 40)
