"""Pairwise-complete Pearson correlation of many series in long form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.sizing import checked_broadcast

CELLS_PER_GROUP = 500_000
SERIES_PER_TILE = 512
#: Cells, missing ones too, of the times x series matrix a task holds at a time.
MATRIX_CELLS = 1 << 21

_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def correlation_long(
    df: DataFrame,
    time: str,
    id: str,
    value: str,
    within: Sequence[str] | str | None = None,
    cells_per_group: int = CELLS_PER_GROUP,
    series_per_tile: int = SERIES_PER_TILE,
) -> DataFrame:
    """|corr| and number of complete pairs for every pair of series, `var_a <= var_b`.

    Readings are first reduced to their mean per (within, time, id), which
    bounds a time by the number of series and needs no shuffle after a grouping
    by the same columns. Times are then spread by hash into groups of bounded size; a group is
    walked in blocks of times, each a times × series matrix of at most MATRIX_CELLS cells
    whose cross products are added up for all pairs at once, so pairs of readings never
    become rows and times at which few series have a reading cost no memory. The partial sums, one
    row per pair and group, are then added up. Many series are cut into tiles of
    `series_per_tile`, one group per pair of tiles. Series of one group of `within` without a
    common time come with n = 0 and NULL.
    """
    within = [within] if isinstance(within, str) else list(within or [])
    cells = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*within, F.col(time).alias("_t"), F.col(id).cast("string").alias("_id"))
        .agg(F.avg(value).alias("_v"))
    )
    sizes = cells.groupBy(*within, "_id").agg(F.avg("_v").alias("_mean"), F.count(F.lit(1)).alias("_cells"))
    sizes = checked_broadcast(sizes)
    plan = sizes.groupBy(*within).agg(
        F.ceil(F.sum("_cells") / cells_per_group).alias("_groups"),
        F.ceil(F.count(F.lit(1)) / series_per_tile).alias("_tiles"),
    )
    # Deviations from the mean keep the sums of products well conditioned.
    centred = cells.join(sizes.drop("_cells"), [*within, "_id"])
    if within:
        placed = centred.join(checked_broadcast(plan), within)
    else:
        groups, tiles = plan.first()
        placed = centred.withColumns({"_groups": F.lit(groups or 1), "_tiles": F.lit(tiles or 1)})
    placed = placed.withColumns(
        {
            "_group": F.pmod(F.xxhash64("_t"), F.col("_groups")),
            "_tile": F.pmod(F.xxhash64("_id"), F.col("_tiles")),
        }
    )
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_tiles") - 1))
    tiled = placed.withColumn("_other", other).select(
        *within,
        "_group",
        F.least("_tile", "_other").alias("_p"),
        F.greatest("_tile", "_other").alias("_q"),
        "_tile",
        "_t",
        "_id",
        F.when(F.col("_mean").isNotNull(), F.col("_v") - F.col("_mean")).alias("_v"),
    )
    by = [*within, "_group", "_p", "_q"]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in within)
    schema = ", ".join(
        filter(None, [fields, "var_a string, var_b string", ", ".join(f"{s} double" for s in _SUMS)])
    )

    def pair_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, q = key[-2], key[-1]
        times, row = np.unique(rows["_t"].to_numpy(), return_inverse=True)
        names, col = np.unique(rows["_id"].to_numpy().astype(str), return_inverse=True)
        n, sa, saa, sab = co_moments(row, col, rows["_v"].to_numpy(), len(times), len(names))
        tile = np.zeros(len(names), dtype=np.int64)
        tile[col] = rows["_tile"].to_numpy()
        a, b = np.triu_indices(len(names))
        keep = n[a, b] > 0
        if p != q:
            keep &= tile[a] != tile[b]
        a, b = a[keep], b[keep]
        data = {name: key[i] for i, name in enumerate(within)}
        data |= {"var_a": names[a], "var_b": names[b], "n": n[a, b], "sa": sa[a, b], "sb": sa[b, a]}
        data |= {"saa": saa[a, b], "sbb": saa[b, a], "sab": sab[a, b]}
        return pd.DataFrame(data)

    partial = tiled.groupBy(*by).applyInPandas(pair_sums, schema)
    total = partial.groupBy(*within, "var_a", "var_b").agg(*[F.sum(s).alias(s) for s in _SUMS])
    # The result has a row for every pair of names anyway; here are those that share no time.
    side = lambda c: sizes.select(*within, F.lit(0).alias("_all"), F.col("_id").alias(c))
    pairs = side("var_a").join(side("var_b"), [*within, "_all"]).where("var_a <= var_b").drop("_all")
    total = pairs.join(total, [*within, "var_a", "var_b"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.nullif(F.col("n"), F.lit(0.0))
    var_a = F.col("saa") - F.col("sa") * F.col("sa") / F.nullif(F.col("n"), F.lit(0.0))
    var_b = F.col("sbb") - F.col("sb") * F.col("sb") / F.nullif(F.col("n"), F.lit(0.0))
    # A constant side leaves only rounding noise around zero variance.
    flat = (var_a <= 1e-12 * F.col("saa")) | (var_b <= 1e-12 * F.col("sbb")) | (F.col("n") < 2)
    corr = F.when(~flat, F.abs(cov / F.sqrt(var_a * var_b)))
    return total.select(*within, "var_a", "var_b", corr.alias("corr"), F.col("n").cast("bigint").alias("n"))


def co_moments(row: np.ndarray, col: np.ndarray, value: np.ndarray, n_rows: int, n_cols: int) -> tuple[np.ndarray, ...]:
    """For all pairs of columns of a sparse matrix, over rows where both have a value: count, sum of the first, of its square, of the product."""
    step = max(1, MATRIX_CELLS // max(1, n_cols))
    order = np.argsort(row, kind="stable")
    row, col, value = row[order], col[order], value[order]
    out = [np.zeros((n_cols, n_cols)) for _ in range(4)]
    for start in range(0, n_rows, step):
        mine = slice(*np.searchsorted(row, (start, start + step)))
        height = min(step, n_rows - start)
        x, seen = np.zeros((height, n_cols)), np.zeros((height, n_cols))
        x[row[mine] - start, col[mine]] = value[mine]
        seen[row[mine] - start, col[mine]] = 1.0
        for total, part in zip(out, (seen.T @ seen, x.T @ seen, (x * x).T @ seen, x.T @ x), strict=True):
            total += part
    return tuple(out)
