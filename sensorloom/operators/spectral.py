"""Magnitude spectra of long series tables, their energy and their correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.correlation import correlation_long
from sensorloom.operators.ordered import cumulative_sum, positions
from sensorloom.operators.sizing import Slices, order_number, plan_slices

POINTS_PER_TASK = 1 << 20
PADDING_BLOCK = 1 << 16


def _centred(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    slices: Slices | None,
    step: float | None,
    within: str | None = None,
) -> DataFrame:
    """Position `n` from 0, length `size` and deviation `dev` from the mean; missing rows are trimmed.

    On a regular grid (`step` in order units, microseconds for times) the
    position follows from the order value, so nothing is sorted. With `within` (one of
    the keys) every series gets the length of the longest of its group: deviations of
    zero follow it, so its spectrum is taken at the frequencies of that one.
    """
    known = df.filter(F.col(value).isNotNull()).select(
        *keys, order, order_number(df, order).alias("_x"), F.col(value).cast("double").alias("_v")
    )
    slices = slices or plan_slices(known, keys, order)
    stats = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.avg("_v").alias("_mean"), F.min("_x").alias("_lo")
    )
    placed = known if step else positions(known, keys, order, name="_pos", slices=slices)
    n = F.round((F.col("_x") - F.col("_lo")) / F.lit(step)) if step else F.col("_pos") - 1
    joined = placed.join(slices.per_key(stats), list(keys))
    centred = joined.select(*keys, n.cast("bigint").alias("n"), "size", (F.col("_v") - F.col("_mean")).alias("dev"))
    if within is None:
        return centred
    longest = stats.groupBy(within).agg(F.max("size").alias("_longest"))
    lengths = stats.select(*keys, "size").join(longest, within)
    block, last = F.lit(PADDING_BLOCK), F.col("_longest") - 1
    blocks = lengths.filter(F.col("size") <= last).select(
        *keys, "size", "_longest", F.explode(F.sequence(F.floor(F.col("size") / block), F.floor(last / block))).alias("_b")
    )
    begin, end = F.greatest(F.col("size"), F.col("_b") * block), F.least(last, (F.col("_b") + 1) * block - 1)
    padding = blocks.select(
        *keys, F.explode(F.sequence(begin, end)).alias("n"), F.col("_longest").alias("size"), F.lit(0.0).alias("dev")
    )
    whole = centred.join(slices.per_key(lengths.select(*keys, "_longest")), list(keys))
    return whole.select(*keys, "n", F.col("_longest").alias("size"), "dev").unionByName(padding)


def dft_magnitude(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    k_max: int,
    slices: Slices | None = None,
    step: float | None = None,
) -> DataFrame:
    """Amplitudes of bins 0 .. k_max by direct summation, all in built-in expressions.

    Each reading meets a fixed number of bins and is summed on its own side of
    the shuffle, which then carries one row per series, bin and task.
    """
    centred = _centred(df, keys, order, value, slices, step)
    bins = centred.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k_max).cast("bigint"))))
    # The product is reduced modulo the length before it becomes an angle.
    angle = F.lit(2.0) * F.pi() * (F.col("k") * F.col("n") % F.col("size")) / F.col("size")
    sums = bins.groupBy(*keys, "k").agg(
        F.sum(F.col("dev") * F.cos(angle)).alias("_c"), F.sum(F.col("dev") * F.sin(angle)).alias("_s")
    )
    amp = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    return sums.select(*keys, "k", amp.alias("amp"))


def fft_magnitude(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    points_per_task: int = POINTS_PER_TASK,
    slices: Slices | None = None,
    step: float | None = None,
    within: str | None = None,
) -> DataFrame:
    """Amplitudes of all bins k = 0 .. size-1, with the length as `size`.

    With `within` (one of the keys) the series of a group have the bins of its longest
    one, so that equal bins are equal frequencies; no reading is left out.

    Series up to `points_per_task` are transformed one per group. Longer ones
    go through the distributed transform, whose groups hold about the square
    root of the series.
    """
    keys = list(keys)
    centred = _centred(df, keys, order, value, slices, step, within)
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{fields}, k bigint, amp double, size bigint"

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = len(rows)
        place = rows["n"].to_numpy()
        if size and (len(np.unique(place)) < size or place.max() >= size):
            raise ValueError(f"series {key}: repeated or missing times")
        x = np.zeros(size)
        x[place] = rows["dev"].to_numpy()
        data = dict(zip(keys, key))
        return pd.DataFrame(data | {"k": np.arange(size), "amp": np.abs(np.fft.fft(x)), "size": size})

    is_long = F.col("size") > points_per_task
    short = centred.filter(~is_long).groupBy(*keys).applyInPandas(whole, schema)
    if slices is not None and slices.n_longest is not None and slices.n_longest <= points_per_task:
        return centred.groupBy(*keys).applyInPandas(whole, schema)
    if centred.filter(is_long).limit(1).isEmpty():
        return short
    return short.unionByName(_chirp_transform(centred.filter(is_long), keys))


def _chirp_transform(centred: DataFrame, keys: list[str]) -> DataFrame:
    """Spectrum of long series of any length (Bluestein 1970, on the four-step FFT of Bailey 1990).

    The transform of length N becomes a convolution of length M = 2^m >= 2N-1,
    and every transform of length M runs as two grouped stages of short ones.
    """
    m = F.ceil(F.log2(F.col("size") * 2 - 1)).cast("int")
    base = centred.withColumn("_m", m)
    half = F.pi() * ((F.col("n") * F.col("n")) % (F.col("size") * 2)) / F.col("size")
    chirped = base.withColumns({"_cos": F.cos(half), "_sin": F.sin(half), "_len": _power_of_two(F.col("_m"))})
    # Signal a = x · conj(chirp); filter b = chirp, mirrored at the end of the padded range.
    signal = F.struct(
        F.col("n").alias("i"),
        (F.col("dev") * F.col("_cos")).alias("ar"),
        (-F.col("dev") * F.col("_sin")).alias("ai"),
        F.col("_cos").alias("br"),
        F.col("_sin").alias("bi"),
    )
    mirror = F.struct(
        (F.col("_len") - F.col("n")).alias("i"),
        F.lit(0.0).alias("ar"),
        F.lit(0.0).alias("ai"),
        F.col("_cos").alias("br"),
        F.col("_sin").alias("bi"),
    )
    entries = F.when(F.col("n") > 0, F.array(signal, mirror)).otherwise(F.array(signal))
    rows = chirped.select(*keys, "size", "_m", F.explode(entries).alias("e")).select(*keys, "size", "_m", "e.*")
    product = _four_step(rows, keys, multiply=True)
    back = _four_step(product, keys, multiply=False).filter(F.col("i") < F.col("size"))
    amp = F.sqrt(F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai"))
    return back.select(*keys, F.col("i").alias("k"), amp.alias("amp"), "size")


def _power_of_two(exponent: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), exponent)


def _four_step(rows: DataFrame, keys: list[str], multiply: bool) -> DataFrame:
    """Length 2^m transform in two grouped stages with a twiddle factor between.

    With `multiply` the spectra of a and b are multiplied and conjugated, ready
    for the inverse; without it the result is scaled by 1/M.
    """
    pairs = ("ar", "ai", "br", "bi")
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{fields}, size bigint, _m int, i bigint, ar double, ai double, br double, bi double"

    def stage(key: tuple, part: pd.DataFrame, first: bool) -> pd.DataFrame:
        m, lane = int(part["_m"].iloc[0]), int(key[-1])
        n1, n2 = 1 << (m // 2), 1 << (m - m // 2)
        length = n1 if first else n2
        index = part["i"].to_numpy()
        at = index // n2 if first else index % n2
        out = {}
        for re, im in (("ar", "ai"), ("br", "bi")):
            z = np.zeros(length, dtype=np.complex128)
            z[at] = part[re].to_numpy() + 1j * part[im].to_numpy()
            z = np.fft.fft(z)
            if first:
                z = z * np.exp(-2j * np.pi * ((lane * np.arange(length)) % (n1 * n2)) / (n1 * n2))
            out[re] = z
        # After stage one the entry (k1, n2) sits at k1 * n2_total + n2; after stage two bin k1 + n1 * k2.
        place = np.arange(length) * n2 + lane if first else lane + n1 * np.arange(length)
        a, b = out["ar"], out["br"]
        if not first:
            a = np.conj(a * b) if multiply else a / (n1 * n2)
            b = np.zeros_like(a)
        data = dict(zip(keys, key)) | {"size": part["size"].iloc[0], "_m": m, "i": place}
        return pd.DataFrame(data | {"ar": a.real, "ai": a.imag, "br": b.real, "bi": b.imag})

    def first_stage(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return stage(key, part, True)

    def second_stage(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return stage(key, part, False)

    width = _power_of_two(F.ceil(F.col("_m") / 2).cast("int"))
    columns = [*keys, "size", "_m", "i", *pairs]
    lanes = rows.select(*columns, (F.col("i") % width).alias("_lane"))
    mixed = lanes.groupBy(*keys, "_lane").applyInPandas(first_stage, schema)
    lanes = mixed.select(*columns, F.floor(F.col("i") / width).alias("_lane"))
    return lanes.groupBy(*keys, "_lane").applyInPandas(second_stage, schema)


def centre_spectrum(spectrum: DataFrame, step_seconds: float, size: str = "size") -> DataFrame:
    """Signed bin `k_shift` with zero in the middle and its frequency in Hz."""
    half = F.floor(F.col(size) / 2)
    shifted = F.pmod(F.col("k") + half, F.col(size)) - half
    return spectrum.withColumns(
        {"k_shift": shifted.cast("bigint"), "freq": shifted / (F.col(size) * F.lit(float(step_seconds)))}
    )


def cumulative_energy(
    spectrum: DataFrame, keys: Sequence[str], order: str = "k", amp: str = "amp", slices: Slices | None = None
) -> DataFrame:
    """Running share of the energy along the bins, 1 at the last bin."""
    energy = F.col(amp) * F.col(amp)
    slices = slices or plan_slices(spectrum, keys, order)
    summed = cumulative_sum(spectrum, keys, order, energy, "_cum", slices)
    totals = spectrum.groupBy(*keys).agg(F.sum(energy).alias("_total"))
    joined = summed.join(slices.per_key(totals), list(keys))
    share = F.col("_cum") / F.nullif(F.col("_total"), F.lit(0.0))
    return joined.select(*spectrum.columns, share.alias("cum_energy"))


def energy_band(
    energy: DataFrame, variable: str = "variable", k: str = "k", low: float = 0.05, high: float = 0.95, asset: str = "asset"
) -> DataFrame:
    """Rows of bins where every asset of the variable lies strictly inside the band.

    `k` is the bin, or its frequency where the assets have spectra of different lengths:
    an asset's share at a frequency is that of its last bin up to there. Shares never
    fall, so each asset is inside from one bin on and up to before another; assets
    without energy do not count.
    """
    share = F.col("cum_energy")
    inside = energy.groupBy(asset, variable).agg(
        F.min(F.when(share > low, F.col(k))).alias("_lo"), F.min(F.when(share >= high, F.col(k))).alias("_hi")
    )
    bands = inside.groupBy(variable).agg(F.max("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    found = energy.join(bands, variable).filter((F.col(k) >= F.col("_lo")) & (F.col(k) < F.col("_hi")))
    return found.select(*energy.columns)


def spectral_correlation(spectrum: DataFrame, asset: str = "asset", variable: str = "variable") -> DataFrame:
    """|corr| between the spectra of the variables of one asset."""
    return correlation_long(spectrum, "k", variable, "amp", within=asset)


def with_late_copies(df: DataFrame, order: str, seconds: int, variable: str = "variable", mark: str = "_late") -> DataFrame:
    """The table and a copy of every series that runs `seconds` behind it, named with `mark`.

    A delay changes the correlation in time but not the amplitudes of the spectrum.
    """
    later = (F.col(order) + F.expr(f"INTERVAL {seconds} SECOND")).cast(df.schema[order].dataType)
    late = df.withColumns({order: later, variable: F.concat(variable, F.lit(mark))})
    return df.unionByName(late)
