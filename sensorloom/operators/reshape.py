"""Translation, pivots, unpivots and grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.columns import asset_of, series_id, variable_of
from sensorloom.operators.sizing import SLICE_ROWS, Slices, checked_broadcast, order_number

PIVOT_COLUMNS = 10_000


def translate(df: DataFrame, dictionary: DataFrame, variable: str = "variable", name: str = "identifier") -> DataFrame:
    """Look up `variable` in a (src, dest) dictionary; unknown names give NULL."""
    lookup = dictionary.select(F.col("src").alias(variable), F.col("dest").alias(name))
    return df.join(checked_broadcast(lookup), variable, "left")


def translate_with_map(df: DataFrame, pairs: dict[str, str], variable: str = "variable", name: str = "identifier") -> DataFrame:
    """The same lookup through a literal map, for dictionaries written in code."""
    entries = [F.lit(x) for pair in pairs.items() for x in pair]
    return df.withColumn(name, F.try_element_at(F.create_map(*entries), F.col(variable)))


def untranslated(df: DataFrame, name: str = "identifier", variable: str = "variable") -> DataFrame:
    """Rows per variable that found no dictionary entry."""
    return df.filter(F.col(name).isNull()).groupBy(variable).agg(F.count(F.lit(1)).alias("n"))


def with_series_id(df: DataFrame, identifier: str = "identifier", asset: str = "asset", name: str = "id") -> DataFrame:
    return df.withColumn(name, series_id(F.col(identifier), F.col(asset)))


def column_values(df: DataFrame, column: str, limit: int = PIVOT_COLUMNS) -> list:
    """Sorted distinct values that become columns; fails beyond `limit`, as a wide table would."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} distinct values in {column}: keep this table long")
    return sorted(found)


def pivot_wide(
    df: DataFrame,
    row: Sequence[str] | str,
    column: str,
    value: str,
    values: Sequence[str] | None = None,
    how: str = "min",
) -> DataFrame:
    """One row per `row` key and one column per value of `column`.

    With `values` given nothing is scanned to find the columns. Rows whose
    column name is NULL are dropped. Readings are first reduced to one per
    cell, which bounds a row key by the number of columns; the cells then move
    to their row as narrow records, so no half-empty wide row is ever shuffled.
    """
    row = [row] if isinstance(row, str) else list(row)
    values = column_values(df, column) if values is None else list(values)
    known = df.filter(F.col(column).isNotNull()).select(*row, column, value)
    aggregate = {"min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum}[how]
    cells = known.groupBy(*row, column).agg(aggregate(value).alias(value)).repartition(*row)
    return cells.groupBy(*row).pivot(column, values).agg(F.first(value))


def wide_to_long(wide: DataFrame, index: Sequence[str] | str, suffix: int = 4) -> DataFrame:
    """Series columns `<variable>_<asset>` back to (index, id, asset, variable, value)."""
    index = [index] if isinstance(index, str) else list(index)
    series = [c for c in wide.columns if c not in index]
    long = wide.unpivot([F.col(c) for c in index], [F.col(f"`{c}`") for c in series], "id", "value")
    return long.select(
        *index,
        "id",
        asset_of(F.col("id"), suffix).alias("asset"),
        variable_of(F.col("id"), suffix).alias("variable"),
        "value",
    )


def variables_tagged(df: DataFrame, tag: str, variable: str = "variable") -> DataFrame:
    """Readings whose variable name contains the tag."""
    return df.filter(F.col(variable).contains(tag))


def drop_missing_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Keep only columns without a missing value, found with one aggregate."""
    counts = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not counts[c]])


@dataclass(frozen=True)
class Grid:
    """Regular times between the first and last reading of a table, the same for every series."""

    series: DataFrame
    ts: str
    kind: T.DataType
    step_seconds: int
    first: int | None
    last: int | None
    n_series: int

    @classmethod
    def measure(cls, df: DataFrame, keys: Sequence[str], ts: str, step_seconds: int) -> Grid:
        """Find the bounds and the number of series with one aggregate."""
        x = order_number(df, ts)
        per_series = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        first, last, n = per_series.agg(F.min("_lo"), F.max("_hi"), F.count(F.lit(1))).first()
        return cls(df.select(*keys).distinct(), ts, df.schema[ts].dataType, step_seconds, first, last, n)

    @property
    def points_per_series(self) -> int:
        return 0 if self.first is None else (self.last - self.first) // (self.step_seconds * 1_000_000) + 1

    def points(self, points_per_block: int = 10_000) -> DataFrame:
        """Every grid time of every series.

        Times come in blocks: block starts are generated and spread over tasks
        first, then each block grows its own points, so no task holds a whole series.
        """
        if self.first is None:
            return self.series.withColumn(self.ts, F.lit(None).cast(self.kind)).limit(0)
        first, last = (F.timestamp_micros(F.lit(t).cast("bigint")).cast(self.kind) for t in (self.first, self.last))
        seconds = lambda n: F.expr(f"INTERVAL {n * self.step_seconds} SECOND")
        starts = self.series.withColumn("_start", F.explode(F.sequence(first, last, seconds(points_per_block))))
        if self.points_per_series > points_per_block:
            starts = starts.repartition(*starts.columns)
        end = F.least(F.col("_start") + seconds(points_per_block - 1), last)
        return starts.select(*self.series.columns, F.explode(F.sequence("_start", end, seconds(1))).alias(self.ts))

    def fill(self, df: DataFrame, value: str) -> DataFrame:
        """The table on the grid, with NULL where a series has no reading.

        A reading at a time off the grid fails the job; one without a time has no place and is left out.
        """
        return _placed(self.points(), df.select(*self.series.columns, self.ts, value), self.ts, value)

    def slices(self, rows_per_slice: int = SLICE_ROWS, keys: Sequence[str] | None = None) -> Slices:
        """Slices of the grid; every series has the same length, so nothing is scanned.

        `keys` may name fewer columns when they still identify one series each.
        """
        n = self.points_per_series
        keys = tuple(keys or self.series.columns)
        levels = ()
        if n > rows_per_slice:
            cuts = -(-n // rows_per_slice)
            level = self.series.select(*keys).distinct().withColumns(
                {
                    "_slice": F.lit(0).cast("bigint"),
                    "_lo": F.lit(float(self.first)),
                    "_width": F.lit((self.last - self.first) / cuts),
                    "_cuts": F.lit(cuts).cast("bigint"),
                }
            )
            levels = (level,)
        return Slices(keys, self.ts, levels, n_keys=self.n_series, n_rows=n * self.n_series, n_longest=n)


def step_grid(df: DataFrame, keys: Sequence[str], x: str, step: int) -> DataFrame:
    """Every `step` between the smallest and largest `x` of the whole table, for every key."""
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.select(*keys, F.col(x).cast("bigint").alias(x)).limit(0)
    last = lo + -(-(hi - lo) // step) * step
    points = F.sequence(F.lit(lo).cast("bigint"), F.lit(last).cast("bigint"), F.lit(step).cast("bigint"))
    return df.select(*keys).distinct().withColumn(x, F.explode(points))


def densify(df: DataFrame, keys: Sequence[str], x: str, value: str, step: int) -> DataFrame:
    """Known values on the finer step grid; NULL in between.

    A value at an `x` off the grid fails the job; one without `x` has no place and is left out.
    """
    grid = step_grid(df, keys, x, step)
    return _placed(grid, df.select(*keys, F.col(x).cast("bigint").alias(x), value), x, value)


def _placed(grid: DataFrame, known: DataFrame, x: str, value: str) -> DataFrame:
    """Known values at their grid points, keys compared with NULL equal to NULL."""
    keys = grid.columns
    spots = grid.withColumn("_on_grid", F.lit(True)).alias("g")
    found = known.filter(F.col(x).isNotNull()).alias("k")
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys]
    off = F.concat(F.lit(f"no grid point for {x} = "), F.col(f"k.{x}").cast("string"))
    checked = F.when(F.col("g._on_grid").isNull(), F.raise_error(off)).otherwise(F.col(f"k.{value}"))
    return spots.join(found, same, "full").select(*[F.col(f"g.{c}") for c in keys], checked.alias(value))
