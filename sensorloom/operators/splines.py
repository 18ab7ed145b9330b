"""Interpolation of predictions to a finer grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordered import interpolate_linear
from sensorloom.operators.sizing import Slices


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline with not-a-knot ends; NaN outside the knots, linear below four knots."""
    out = np.full(len(at), np.nan)
    n = len(x)
    if n == 0:
        return out
    inside = (at >= x[0]) & (at <= x[-1])
    if n < 4:
        out[inside] = np.interp(at[inside], x, y)
        return out
    h = np.diff(x)
    d = np.diff(y) / h
    # Second derivatives s solve a tridiagonal system; the end conditions are
    # eliminated into its first and last row.
    low, diag, up = h[:-1].copy(), 2.0 * (h[:-1] + h[1:]), h[1:].copy()
    rhs = 6.0 * np.diff(d)
    diag[0] += h[0] + h[0] ** 2 / h[1]
    up[0] -= h[0] ** 2 / h[1]
    diag[-1] += h[-1] + h[-1] ** 2 / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    for i in range(1, n - 2):
        w = low[i] / diag[i - 1]
        diag[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    s = np.empty(n)
    s[n - 2] = rhs[-1] / diag[-1]
    for i in range(n - 4, -1, -1):
        s[i + 1] = (rhs[i] - up[i] * s[i + 2]) / diag[i]
    s[0] = s[1] - (s[2] - s[1]) * h[0] / h[1]
    s[-1] = s[-2] + (s[-2] - s[-3]) * h[-1] / h[-2]
    t = at[inside]
    j = np.clip(np.searchsorted(x, t, side="right") - 1, 0, n - 2)
    u, v, hj = t - x[j], x[j + 1] - t, h[j]
    out[inside] = (
        s[j] * v**3 / (6 * hj)
        + s[j + 1] * u**3 / (6 * hj)
        + (y[j] / hj - s[j] * hj / 6) * v
        + (y[j + 1] / hj - s[j + 1] * hj / 6) * u
    )
    return out


def spline(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Fill missing `y` of each curve from its known points; NULL outside them.

    A curve is one forecast, so its points are bounded by the forecast horizon
    over the step: repeated cells are collapsed first and never reach a group.
    """
    keys = list(keys)
    cells = df.select(*keys, F.col(x), F.col(y).cast("double").alias(y)).groupBy(*keys, x).agg(F.max(y).alias(y))
    schema = ", ".join(
        [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, x]] + [f"`{y}` double"]
    )

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(x)
        at, known = rows[x].to_numpy(dtype=float), rows[y].notna().to_numpy()
        values = rows[y].to_numpy(dtype=float)
        curve = not_a_knot(at[known], values[known], at)
        rows[y] = pd.Series(np.where(known, values, curve), index=rows.index)
        rows[y] = rows[y].astype(object).where(rows[y].notna(), None)
        return rows[[*keys, x, y]]

    return cells.groupBy(*keys).applyInPandas(fill, schema)


def linear_curve(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Linear counterpart of `spline` on an evenly spaced grid; NULL outside the known points.

    Curves have the same bound as there, so none is sliced.
    """
    return interpolate_linear(df.select(*keys, x, y), keys, x, y, inside_only=True, slices=Slices(tuple(keys), x))
