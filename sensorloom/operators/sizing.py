"""Size checks made before a plan is built.

Two decisions depend on data volume: whether a side of a join may be broadcast,
and whether a series is so long that one task must not order it alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.sources.staging import stage

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
SLICE_ROWS = 4_000_000
# A long key gets this many slices per SLICE_ROWS, so an uneven spread still leaves even tasks.
_OVERCUT = 16
_LEVELS = 3
_MAX_CUTS = 1 << 16


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, row_bytes: int = 64) -> DataFrame:
    """Broadcast `small` if it is at most `max_rows` rows and `BROADCAST_BYTES` large, else leave the join to a shuffle.

    `row_bytes` is the caller's estimate for tables with arrays or long texts; it keeps the
    fetch itself bounded, what was fetched is measured. Beyond the bounds the frame comes
    back unhinted, and adaptive skew-join handling splits hot keys.
    """
    max_rows = min(max_rows, BROADCAST_BYTES // row_bytes)
    table = small.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > BROADCAST_BYTES:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(table, schema=small.schema))


def order_number(df: DataFrame, order: str) -> Column:
    """Numeric image of an order column: microseconds for times, the value itself otherwise."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(order).cast("timestamp"))
    return F.col(order)


@dataclass(frozen=True)
class Slices:
    """Cut of long series into ordered slices of bounded size.

    The first level holds one row per long key, each further level one row per
    slice that was still too full; every level has at most (rows / rows per
    slice) rows. Short keys are absent and live in slice 0.
    """

    keys: tuple[str, ...]
    order: str
    levels: tuple[DataFrame, ...] = ()
    n_keys: int | None = None
    n_rows: int | None = None
    n_longest: int | None = None
    rows_per_slice: int = SLICE_ROWS

    @property
    def single(self) -> bool:
        """True when no series is long, so plain windows per key are enough."""
        return not self.levels

    def per_key(self, table: DataFrame) -> DataFrame:
        """Hint a table with one row per key for broadcast if the measured key count allows it."""
        if self.n_keys is None:
            return checked_broadcast(table)
        return F.broadcast(table) if self.n_keys <= BROADCAST_ROWS else table

    def add(self, df: DataFrame, name: str = "_slice") -> DataFrame:
        """Attach the number of the slice, ordered like the series."""
        if self.single:
            return df.withColumn(name, F.lit(0).cast("bigint"))
        out = df.withColumns({"_x": order_number(df, self.order), "_slice": F.lit(0).cast("bigint")})
        for level in self.levels:
            out = out.join(level, [*self.keys, "_slice"], "left")
            inner = F.floor((F.col("_x") - F.col("_lo")) / F.col("_width"))
            clamped = F.greatest(F.least(inner, F.col("_cuts") - 1), F.lit(0).cast("bigint"))
            # Rows without an order value come first, as in a plain window.
            placed = F.when(F.col("_x").isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(clamped, F.lit(0).cast("bigint")))
            number = F.col("_slice") * _MAX_CUTS + placed
            out = out.withColumn("_slice", number).drop("_lo", "_width", "_cuts")
        return out.select(*df.columns, F.col("_slice").alias(name))


def plan_slices(df: DataFrame, keys: Sequence[str], order: str, rows_per_slice: int = SLICE_ROWS) -> Slices:
    """Measure the series and cut those longer than `rows_per_slice`.

    One aggregate over the keys tells how many there are and whether any is
    long; only then the bounds of long keys are staged, at most
    (rows / rows_per_slice) rows. Slices left too full by an uneven spread are
    cut again between their own bounds; what is too full after the last level is warned of.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n_keys, n_rows, n_longest = counts.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))
    ).first()
    found = Slices(tuple(keys), order, (), n_keys, n_rows, n_longest, rows_per_slice)
    if n_longest <= rows_per_slice:
        return found
    base = df.select(*keys, order)
    for _ in range(_LEVELS):
        placed = found.add(base).withColumn("_x", order_number(base, order))
        stats = placed.groupBy(*keys, "_slice").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
        )
        cuts = F.least(F.ceil(F.col("_n") / rows_per_slice) * _OVERCUT, F.lit(_MAX_CUTS)).cast("bigint")
        width = (F.col("_hi") - F.col("_lo")).cast("double") / F.col("_cuts")
        # Equal order values cannot be cut, so a full slice of one value stays.
        full = stats.filter((F.col("_n") > rows_per_slice) & (F.col("_hi") > F.col("_lo")))
        level = full.withColumn("_cuts", cuts).withColumn("_width", width)
        level = stage(level.select(*keys, "_slice", F.col("_lo").cast("double").alias("_lo"), "_width", "_cuts"))
        if level.isEmpty():
            return found
        # Up to BROADCAST_ROWS bounds go to every task; more meet their rows by a shuffle that splits hot keys.
        found = replace(found, levels=(*found.levels, checked_broadcast(level)))
    left = found.add(base).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    if not left.where((F.col("_n") > rows_per_slice) & (F.col("_hi") > F.col("_lo"))).isEmpty():
        warnings.warn(f"slices of more than {rows_per_slice} rows are left after {_LEVELS} cuts", stacklevel=2)
    return found
