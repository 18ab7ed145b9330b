import numpy as np
import pytest

from sensorloom.operators import correlation, spectral

KEYS = ["asset", "variable"]
SCHEMA = "asset string, variable string, n bigint, value double"


def waves(spark, **series):
    rows = [("A001", name, i, None if v is None else float(v)) for name, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, SCHEMA)


def test_dft_of_a_sine(spark):
    df = waves(spark, s=np.sin(2 * np.pi * np.arange(8) / 8))
    amp = {r.k: r.amp for r in spectral.dft_magnitude(df, KEYS, "n", "value", 7).collect()}
    assert np.allclose([amp[k] for k in range(8)], [0, 4, 0, 0, 0, 0, 0, 4], atol=1e-9)
    on_grid = {r.k: r.amp for r in spectral.dft_magnitude(df, KEYS, "n", "value", 7, step=1).collect()}
    assert np.allclose([on_grid[k] for k in range(8)], [amp[k] for k in range(8)])


def test_late_copies_differ_in_time_only(spark, at):
    values = np.random.default_rng(1).normal(size=30)
    rows = [("A001", "v", at(10 * i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "asset string, variable string, timestamp timestamp_ntz, value double")
    both = spectral.with_late_copies(df, "timestamp", 1200)
    assert both.schema["timestamp"].dataType == df.schema["timestamp"].dataType
    in_time = {(r.var_a, r.var_b): r for r in correlation.correlation_long(both, "timestamp", "variable", "value", within="asset").collect()}
    pair = in_time["v", "v_late"]
    assert pair.n == 28 and np.isclose(pair["corr"], abs(np.corrcoef(values[2:], values[:-2])[0, 1]))
    bins = spectral.fft_magnitude(both, KEYS, "timestamp", "value", step=600_000_000)
    in_bins = {(r.var_a, r.var_b): r["corr"] for r in spectral.spectral_correlation(bins).collect()}
    assert np.isclose(in_bins["v", "v_late"], 1)


def test_late_series_shorten_no_others(spark, tmp_path, at):
    """Energy, band and correlation of whole series against numpy, with one late series and one late asset."""
    from sensorloom.plans.catalog import QUERIES

    rng = np.random.default_rng(3)
    begins = {(1, "click"): 0, (1, "view"): 37, (2, "click"): 11, (2, "view"): 10, (3, "click"): 47}
    series = {key: rng.normal(size=48 - begin) for key, begin in begins.items()}
    rows = [(a - 1, v, at(60 * (begins[a, v] + i)), float(x), 0) for (a, v), xs in series.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, value double, event_id long").write.parquet(str(tmp_path / "events.parquet"))

    def spectrum(x, size=None):
        return np.abs(np.fft.fft(x - x.mean(), size))

    shares, freqs = {}, {}
    for key, x in series.items():
        power = np.fft.fftshift(spectrum(x)) ** 2
        shares[key] = np.cumsum(power) / power.sum() if len(x) > 1 else np.array([np.nan])
        freqs[key] = np.arange(len(x)) - len(x) // 2
    energy = QUERIES["cumulative_energy"](spark, str(tmp_path)).toPandas()
    for (a, v), want in shares.items():
        one = energy[(energy.asset == f"A00{a}") & (energy.variable == v)].sort_values("k_shift")
        assert len(one) == 48 - begins[a, v] and np.allclose(one.cum_energy.astype(float), want, atol=1e-6, equal_nan=True)
    band = {(r.asset, r.variable, r.k_shift) for r in QUERIES["energy_band"](spark, str(tmp_path)).collect()}
    want = set()
    for (a, v), ks in freqs.items():
        others = [o for o in series if o[1] == v and len(series[o]) > 1]
        for k in ks:
            # Share of each asset at the last of its bins up to this frequency, in whole numbers.
            at_k = [shares[o][np.flatnonzero(freqs[o] * len(ks) <= k * len(series[o]))].max(initial=0) for o in others]
            if min(at_k) > 0.05 and max(at_k) < 0.95:
                want.add((f"A00{a}", v, k))
    assert band == want and {x[0] for x in want} == {"A001", "A002", "A003"}
    pairs = {(r.asset, r.var_a, r.var_b): r for r in QUERIES["spectral_correlation"](spark, str(tmp_path)).collect()}
    for a, size in ((1, 48), (2, 38)):
        pair = pairs[f"A00{a}", "click", "view"]
        x, y = spectrum(series[a, "click"], size), spectrum(series[a, "view"], size)
        assert pair.n == size and np.isclose(pair["corr"], abs(np.corrcoef(x, y)[0, 1]), atol=1e-6)


@pytest.mark.parametrize("limit", [0, 100])
def test_shared_bins_of_a_group(spark, monkeypatch, limit):
    monkeypatch.setattr(spectral, "PADDING_BLOCK", 4)
    x, y = np.arange(30.0) ** 2 % 7, np.arange(13.0) ** 2 % 5
    df = waves(spark, x=x, y=[None] * 17 + list(y))
    out = spectral.fft_magnitude(df, KEYS, "n", "value", points_per_task=limit, within="asset").toPandas()
    for name, values in (("x", x), ("y", y)):
        one = out[out.variable == name].sort_values("k")
        assert len(one) == 30 and np.allclose(one.amp, np.abs(np.fft.fft(values - values.mean(), 30)), atol=1e-8)


@pytest.mark.parametrize("size", [1, 2, 7, 16, 45, 101])
def test_distributed_transform_equals_numpy(spark, size):
    rng = np.random.default_rng(size)
    x, y = rng.normal(size=size), rng.normal(size=size + 3)
    df = waves(spark, x=x, y=y)
    for limit in (0, size + 1):
        out = spectral.fft_magnitude(df, KEYS, "n", "value", points_per_task=limit).toPandas()
        for name, values in (("x", x), ("y", y)):
            one = out[out.variable == name].sort_values("k")
            expected = np.abs(np.fft.fft(values - values.mean()))
            assert len(one) == len(values) and np.allclose(one.amp, expected, atol=1e-8)
            assert np.isclose((one.amp**2).sum(), len(values) * ((values - values.mean()) ** 2).sum())


def test_leading_missing_readings_are_trimmed(spark):
    values = [None, None, 1.0, 5.0, 2.0, 0.0]
    out = spectral.fft_magnitude(waves(spark, x=values), KEYS, "n", "value").toPandas().sort_values("k")
    known = np.array(values[2:], dtype=float)
    assert np.allclose(out.amp, np.abs(np.fft.fft(known - known.mean())))


@pytest.mark.parametrize("size", [8, 9])
def test_centred_bins_match_fftfreq(spark, size):
    df = spectral.fft_magnitude(waves(spark, x=np.arange(size) ** 2), KEYS, "n", "value")
    out = spectral.centre_spectrum(df, 600).toPandas().sort_values("k")
    assert np.allclose(out.freq, np.fft.fftfreq(size, 600))


def test_cumulative_energy_and_band(spark):
    spectrum = spark.createDataFrame(
        [(a, "v", k, amp) for a in ("A001", "A002") for k, amp in enumerate((1.0, 2.0, 2.0))],
        "asset string, variable string, k bigint, amp double",
    )
    energy = spectral.cumulative_energy(spectrum, KEYS)
    shares = [r.cum_energy for r in energy.filter("asset = 'A001'").orderBy("k").collect()]
    assert np.allclose(shares, [1 / 9, 5 / 9, 1])
    assert {r.k for r in spectral.energy_band(energy).collect()} == {0, 1}


def test_quadrature_pair_is_uncorrelated_in_time_only(spark):
    t = np.linspace(1, 10, 100)
    df = waves(spark, x=np.sin(0.8 * np.pi * t), y=np.cos(0.8 * np.pi * t))
    in_time = correlation.correlation_long(df, "n", "variable", "value", within="asset").filter("var_a <> var_b")
    assert np.isclose(in_time.first()["corr"], abs(-0.023517), atol=1e-6)
    spectrum = spectral.fft_magnitude(df, KEYS, "n", "value")
    raw = np.abs(np.fft.fft([np.sin(0.8 * np.pi * t), np.cos(0.8 * np.pi * t)]))
    assert np.isclose(np.corrcoef(raw)[0, 1], 0.973485, atol=1e-6)
    centred = np.abs(np.fft.fft([w - w.mean() for w in (np.sin(0.8 * np.pi * t), np.cos(0.8 * np.pi * t))]))
    both = spectral.spectral_correlation(spectrum).filter("var_a <> var_b").first()
    assert np.isclose(both["corr"], np.corrcoef(centred)[0, 1])


@pytest.mark.parametrize("cells,tile", [(500_000, 512), (40, 512), (40, 2), (500_000, 1)])
def test_correlation_equals_pandas(spark, noisy, cells, tile):
    rng = np.random.default_rng(1)
    import pandas as pd

    n = 60
    wide = pd.DataFrame(rng.normal(size=(n, 5)), columns=list("abcde"))
    wide["c"] = wide["a"] * 2 + 1
    wide["e"] = 7.0
    wide = wide.mask(rng.random((n, 5)) < 0.2)
    long = wide.reset_index(names="n").melt("n", var_name="variable", value_name="value").assign(asset="A001")
    long = long.astype(object).where(long.notna(), None)
    df = spark.createDataFrame(long.to_dict("records"), SCHEMA)
    for within in (None, "asset"):
        out = correlation.correlation_long(df, "n", "variable", "value", within, cells, tile).toPandas()
        assert len(out) == 15 and (out.var_a <= out.var_b).all()
        expected = wide.corr().abs()
        for row in out.itertuples():
            want = expected.loc[row.var_a, row.var_b]
            assert (np.isnan(want) and np.isnan(row.corr)) or np.isclose(want, row.corr)
            assert row.n == (wide[row.var_a].notna() & wide[row.var_b].notna()).sum()


def test_series_without_a_common_time(spark):
    df = spark.createDataFrame([("A001", v, n, float(n)) for v, start in (("a", 0), ("b", 5), ("c", 2)) for n in range(start, start + 5)], SCHEMA)
    for within in (None, "asset"):
        out = {(r.var_a, r.var_b): r for r in correlation.correlation_long(df, "n", "variable", "value", within).collect()}
        assert len(out) == 6 and out["a", "b"].n == 0 and out["a", "b"]["corr"] is None and out["a", "c"].n == 3


def test_many_times_by_many_series_in_blocks(monkeypatch):
    """A task's matrices stay within the bound though no two times have the same series."""
    monkeypatch.setattr(correlation, "MATRIX_CELLS", 1 << 12)
    held, rng = [], np.random.default_rng(6)
    zeros = np.zeros
    monkeypatch.setattr(correlation.np, "zeros", lambda shape, *a, **k: held.append(np.prod(shape)) or zeros(shape, *a, **k))
    row, col = np.arange(20_000) // 2, rng.integers(0, 50, 20_000)
    _, first = np.unique(row * 50 + col, return_index=True)
    row, col, value = row[first], col[first], rng.normal(size=len(first))
    n, sa, saa, sab = correlation.co_moments(row, col, value, 10_000, 50)
    assert max(held) <= 1 << 12
    full, seen = zeros((10_000, 50)), zeros((10_000, 50))
    full[row, col], seen[row, col] = value, 1
    for got, want in ((n, seen.T @ seen), (sa, full.T @ seen), (saa, (full**2).T @ seen), (sab, full.T @ full)):
        assert np.allclose(got, want)


def test_constant_series_have_no_coefficient(spark):
    df = waves(spark, a=[1, 1], b=[2, 3])
    out = {(r.var_a, r.var_b): r["corr"] for r in correlation.correlation_long(df, "n", "variable", "value").collect()}
    assert out[("a", "b")] is None and out[("a", "a")] is None and np.isclose(out[("b", "b")], 1)


def test_repeated_cells_count_once(spark):
    df = waves(spark, a=[1, 2, 4], b=[3, 1, 5])
    twice = df.unionByName(df)
    row = correlation.correlation_long(twice, "n", "variable", "value").filter("var_a <> var_b").first()
    assert row.n == 3 and np.isclose(row["corr"], abs(np.corrcoef([1, 2, 4], [3, 1, 5])[0, 1]))
