"""Operators that follow the order of readings inside a series.

Each one runs as a plain window per series while series are short. Series over
the slice size are cut into ordered slices; the work then runs per
(series, slice), and one row per slice carries what crosses the cut. Readings lie by
(series, slice) already when that row joins them, so only the carries move, to the
partition of their slice; nothing is broadcast unasked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.sizing import Slices, order_number, plan_slices

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def trailing_avg(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    rows: int = 10,
    tiebreak: Sequence[str] = (),
    name: str = "ma",
    slices: Slices | None = None,
) -> DataFrame:
    """Average of the current reading and the `rows - 1` before it; missing values are skipped."""
    slices = slices or plan_slices(df, keys, ts)
    before = rows - 1
    if slices.single or before == 0:
        frame = Window.partitionBy(*keys).orderBy(ts, *tiebreak).rowsBetween(-before, 0)
        return df.withColumn(name, F.avg(value).over(frame))

    part = Window.partitionBy(*keys, "_slice")
    ordered = part.orderBy(ts, *tiebreak)
    frame = ordered.rowsBetween(-before, 0)
    inside = slices.add(df).select(
        "*",
        F.row_number().over(ordered).alias("_rn"),
        F.count(F.lit(1)).over(part).alias("_size"),
        F.sum(value).over(frame).alias("_sum"),
        F.count(value).over(frame).alias("_cnt"),
    )
    tails = (
        inside.filter(F.col("_rn") > F.col("_size") - before)
        .groupBy(*keys, "_slice")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", F.col(value).alias("v")))).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-before, -1)
    carried = F.flatten(F.collect_list("_tail").over(earlier))
    # Only series with several slices have a carry, so this table is bounded by the slice count.
    carry = tails.select(*keys, "_slice", _last(carried, F.lit(before)).alias("_carry")).filter(
        F.size("_carry") > 0
    )
    missing = F.lit(rows) - F.col("_rn")
    extra = F.when(missing > 0, _last(F.col("_carry"), missing))
    total = F.coalesce(F.col("_sum"), F.lit(0.0)) + F.coalesce(
        F.aggregate(extra, F.lit(0.0), lambda acc, e: acc + F.coalesce(e["v"], F.lit(0.0))), F.lit(0.0)
    )
    count = F.col("_cnt") + F.coalesce(F.size(F.filter(extra, lambda e: e["v"].isNotNull())), F.lit(0))
    joined = inside.join(carry, [*keys, "_slice"], "left")
    return joined.select(*df.columns, (total / F.nullif(count, F.lit(0))).alias(name))


def _last(array: Column, n: Column) -> Column:
    """The last `n` elements of an array; fewer when it is shorter."""
    return F.slice(array, F.greatest(F.size(array) - n + 1, F.lit(1)), n)


def trailing_avg_time(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    seconds: int = 600,
    name: str = "ma",
) -> DataFrame:
    """Average over the half-open span (ts - seconds, ts].

    Time is cut into blocks as long as the span, so a span is the end of one
    block plus the start of the next. Every reading joins its own block, and
    the following one at the moment it leaves the span. Two running sums then
    give each average, without a sliding frame whose cost grows with the
    density of the readings. Work is spread over (series, block).
    """
    micros = seconds * 1_000_000
    x, v = order_number(df, ts), F.col(value).cast("double")
    block = F.floor(x / micros)
    own = F.struct(block.alias("block"), x.alias("t"), F.lit(0).alias("old"), v.alias("new_v"), F.lit(None).cast("double").alias("old_v"))
    leaving = F.struct((block + 1).alias("block"), (x + micros).alias("t"), F.lit(1).alias("old"), F.lit(None).cast("double").alias("new_v"), v.alias("old_v"))
    copies = df.withColumn("_e", F.explode(F.array(own, leaving))).select(*df.columns, "_e.*")
    part = Window.partitionBy(*keys, "block")
    started = part.orderBy("t").rangeBetween(*_UP_TO_HERE)
    # Seen from the end, readings that leave later come first; one leaving right now is out.
    remaining = part.orderBy(F.col("t").desc(), "old").rowsBetween(*_UP_TO_HERE)
    sums = copies.select(
        "*",
        F.sum("new_v").over(started).alias("_new"),
        F.count("new_v").over(started).alias("_n_new"),
        F.sum("old_v").over(remaining).alias("_old"),
        F.count("old_v").over(remaining).alias("_n_old"),
    )
    total = F.coalesce(F.col("_new"), F.lit(0.0)) + F.coalesce(F.col("_old"), F.lit(0.0))
    average = total / F.nullif(F.col("_n_new") + F.col("_n_old"), F.lit(0))
    return sums.filter(F.col("old") == 0).select(*df.columns, average.alias(name))


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tiebreak: Sequence[str] = (),
    name: str = "pos",
    slices: Slices | None = None,
) -> DataFrame:
    """Row number 1 .. n of each reading in its series."""
    slices = slices or plan_slices(df, keys, order)
    if slices.single:
        ordered = Window.partitionBy(*keys).orderBy(order, *tiebreak)
        return df.withColumn(name, F.row_number().over(ordered).cast("bigint"))
    sliced = slices.add(df)
    inside = sliced.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(order, *tiebreak))
    )
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_step"))
    joined = inside.join(_offsets(sizes, keys), [*keys, "_slice"], "left")
    pos = F.col("_rn") + F.coalesce(F.col("_offset"), F.lit(0))
    return joined.select(*df.columns, pos.cast("bigint").alias(name))


def cumulative_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str = "cum",
    slices: Slices | None = None,
) -> DataFrame:
    """Running sum of `value` along the series."""
    slices = slices or plan_slices(df, keys, order)
    if slices.single:
        frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(*_UP_TO_HERE)
        return df.withColumn(name, F.sum(value).over(frame))
    sliced = slices.add(df.withColumn("_v", value))
    frame = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(*_UP_TO_HERE)
    inside = sliced.withColumn("_part", F.sum("_v").over(frame))
    totals = sliced.groupBy(*keys, "_slice").agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("_step"))
    joined = inside.join(_offsets(totals, keys), [*keys, "_slice"], "left")
    return joined.select(*df.columns, (F.col("_part") + F.coalesce(F.col("_offset"), F.lit(0.0))).alias(name))


def _offsets(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of `_step` over earlier slices; slices without predecessors are left out.

    The window runs over one row per slice. Its result has rows for sliced
    series only, at most a small multiple of (rows / rows per slice).
    """
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return steps.select(*keys, "_slice", F.sum("_step").over(earlier).alias("_offset")).filter(
        F.col("_offset").isNotNull()
    )


def interpolate_linear(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str | None = None,
    inside_only: bool = False,
    slices: Slices | None = None,
) -> DataFrame:
    """Fill missing values linearly in row position.

    Leading gaps stay missing; trailing gaps repeat the last value, or stay
    missing with `inside_only`.
    """
    slices = slices or plan_slices(df, keys, order)
    name = name or value
    sliced = slices.add(df)
    part = Window.partitionBy(*keys, "_slice")
    forward = part.orderBy(order)
    # The mirrored order keeps the look-ahead a running frame instead of a quadratic one.
    backward = part.orderBy(F.col(order).desc()).rowsBetween(*_UP_TO_HERE)
    numbered = sliced.withColumn("_rn", F.row_number().over(forward).cast("bigint"))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_rn").alias("p"), F.col(value).alias("v")))
    filled = (
        numbered.withColumn("_known", known)
        .withColumn("_prev", F.last("_known", ignorenulls=True).over(forward.rowsBetween(*_UP_TO_HERE)))
        .withColumn("_next", F.last("_known", ignorenulls=True).over(backward))
    )
    prev, nxt, pos = F.col("_prev"), F.col("_next"), F.col("_rn")
    if not slices.single:
        filled = filled.join(_neighbours(numbered, keys, known), [*keys, "_slice"], "left")
        offset = F.coalesce(F.col("_offset"), F.lit(0).cast("bigint"))
        shifted = lambda s: F.when(s.isNotNull(), F.struct((s["p"] + offset).alias("p"), s["v"].alias("v")))
        prev = F.coalesce(shifted(prev), F.col("_before"))
        nxt = F.coalesce(shifted(nxt), F.col("_after"))
        pos = pos + offset
    slope = (nxt["v"] - prev["v"]) / F.nullif(nxt["p"] - prev["p"], F.lit(0))
    tail = F.lit(None) if inside_only else prev["v"]
    result = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(prev.isNotNull() & nxt.isNotNull(), prev["v"] + slope * (pos - prev["p"]))
        .when(prev.isNotNull(), tail)
    )
    kept = [c for c in df.columns if c != name]
    return filled.select(*kept, result.cast("double").alias(name))


def _neighbours(numbered: DataFrame, keys: Sequence[str], known: Column) -> DataFrame:
    """Per slice: row offset, last known reading before it and first known reading after it."""
    summary = numbered.withColumn("_known", known).groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_known").alias("_first"),
        F.max("_known").alias("_last"),
    )
    line = Window.partitionBy(*keys).orderBy("_slice")
    mirrored = Window.partitionBy(*keys).orderBy(F.col("_slice").desc())
    earlier, later = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (line, mirrored))
    placed = summary.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))
    for edge in ("_first", "_last"):
        shifted = F.struct((F.col(edge)["p"] + F.col("_offset")).alias("p"), F.col(edge)["v"].alias("v"))
        placed = placed.withColumn(edge, F.when(F.col(edge).isNotNull(), shifted))
    return placed.select(
        *keys,
        "_slice",
        "_offset",
        F.last("_last", ignorenulls=True).over(earlier).alias("_before"),
        F.last("_first", ignorenulls=True).over(later).alias("_after"),
    ).filter((F.col("_offset") > 0) | F.col("_after").isNotNull())


def step_to_previous(df: DataFrame, keys: Sequence[str], ts: str, name: str = "step_s") -> DataFrame:
    """Seconds since the previous reading of the series."""
    slices = plan_slices(df, keys, ts)
    sliced = slices.add(df.withColumn("_us", order_number(df, ts)))
    ordered = Window.partitionBy(*keys, "_slice").orderBy("_us")
    inside = sliced.withColumn("_before", F.lag("_us").over(ordered))
    before = F.col("_before")
    if not slices.single:
        ends = sliced.groupBy(*keys, "_slice").agg(F.max("_us").alias("_end"))
        line = Window.partitionBy(*keys).orderBy("_slice")
        carry = ends.select(*keys, "_slice", F.lag("_end").over(line).alias("_carry")).filter(
            F.col("_carry").isNotNull()
        )
        inside = inside.join(carry, [*keys, "_slice"], "left")
        before = F.coalesce(before, F.col("_carry"))
    return inside.select(*df.columns, ((F.col("_us") - before) / 1e6).alias(name))
