"""Operating states: k-means of every asset's sensor vectors, their silhouettes and a 2-D view.

All assets and all numbers of clusters go through the same passes: a pass reads the staged
points once and sends one small record per group, cluster and task. The number of jobs
depends on the number of steps, not on that of assets or of cluster numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.regression import _square, grouped_covariance
from sensorloom.operators.sizing import BROADCAST_BYTES, checked_broadcast
from sensorloom.sources.staging import stage

#: Rows whose distances to all centres a task holds at a time.
BLOCK_ROWS = 4096
#: Bytes of sums a task holds before it sends them on.
HELD_BYTES = 32 << 20


class Points(NamedTuple):
    """Staged rows of all groups: keys, the columns that tell rows apart, inputs, and a fixed draw `_e` per row."""

    table: DataFrame
    keys: list[str]
    inputs: list[str]

    @property
    def key_fields(self) -> str:
        return "".join(f"`{c}` {self.table.schema[c].dataType.simpleString()}, " for c in self.keys)


def _usable(inputs: Sequence[str]) -> str:
    """No input missing, NaN or infinite; NaN is no smaller than infinity, so one comparison leaves both out."""
    return " and ".join(f"abs(cast(`{c}` as double)) < double('Infinity')" for c in inputs)


def sensor_points(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], row: Sequence[str], seed: str = "") -> Points:
    """Complete rows, staged by key, with a random draw that the hash of keys and `row` fixes.

    `row` names the columns that tell the rows of a group apart. Rows with a NULL key or a
    missing or non-finite input take no part.
    """
    known = " and ".join(f"`{c}` is not null" for c in keys)
    complete = df.where(known).where(_usable(inputs))
    name = F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in (*keys, *row)])
    uniform = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    kept = [c for c in dict.fromkeys((*keys, *row)) if c not in inputs]
    values = [F.col(c).cast("double").alias(c) for c in inputs]
    return Points(stage(complete.select(*kept, *values, (-F.log(uniform)).alias("_e")), list(keys)), list(keys), list(inputs))


def _in_blocks(points: Points, group_bytes: int, work: Callable[[Points], DataFrame]) -> DataFrame:
    """`work` over all groups, in blocks of groups whose models the driver and a task can hold.

    Models take `group_bytes` a group. Up to BROADCAST_BYTES in all there is one block; beyond
    it the points are staged by block, so each block reads its own part of them.
    """
    groups = points.table.select(*points.keys).distinct().count()
    blocks = max(1, math.ceil(groups * group_bytes / BROADCAST_BYTES))
    if blocks == 1:
        return work(points)
    number = F.pmod(F.xxhash64(*points.keys), F.lit(blocks))
    table = stage(points.table.withColumn("_block", number), ["_block", *points.keys])
    return reduce(DataFrame.unionByName, [stage(work(points._replace(table=table.where(F.col("_block") == b)))) for b in range(blocks)])


Models = dict[tuple, dict[int, tuple[np.ndarray, ...]]]


def _fetched(models: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> Models:
    """The models of one block of groups: by key and number of clusters, one array per column, ordered by label."""
    found: dict[tuple, dict[int, list]] = {}
    for r in models.select(*keys, "k", *columns).collect():
        found.setdefault(tuple(r[c] for c in keys), {}).setdefault(r["k"], []).append(tuple(r[c] for c in columns))
    return {key: {k: tuple(np.array(c) for c in zip(*sorted(rows), strict=True)) for k, rows in sorted(by_k.items())} for key, by_k in found.items()}


def _by_group(keys: list[str], inputs: list[str], models: Models, batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, rows, inputs, models) of one group each, at most BLOCK_ROWS rows."""
    for batch in batches:
        for key, at in batch.groupby(keys, sort=False).indices.items():
            key = key if isinstance(key, tuple) else (key,)
            for start in range(0, len(at) if key in models else 0, BLOCK_ROWS):
                rows = batch.iloc[at[start : start + BLOCK_ROWS]]
                yield key, rows, rows[inputs].to_numpy(dtype=float), models[key]


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points by centres."""
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def _starts(points: Points, most: int) -> dict[tuple, list[list[float]]]:
    """The first `most` centres of every group of a block.

    Each is drawn among the rows with a probability in proportion to the squared distance
    to the nearest one drawn before (Arthur and Vassilvitskii, 2007), by the smallest of
    the rows' fixed exponential draws over that distance. Groups with fewer distinct
    points have fewer centres. The starts for fewer clusters are the first of those for more.
    """
    table, keys, inputs = points
    schema = f"{points.key_fields}_race double, center array<double>"

    def add(rows: DataFrame) -> None:
        for r in rows.groupBy(*keys).agg(F.min(F.struct("_race", "center")).alias("_r")).collect():
            chosen.setdefault(tuple(r[c] for c in keys), []).append(r["_r"]["center"])

    def next_of(models: Models) -> Callable:
        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for key, rows, x, by_k in _by_group(keys, inputs, models, batches):
                apart = _squares(x, by_k[0][0]).min(1)
                if apart.max() > 0:
                    race = np.full(len(x), np.inf)
                    np.divide(rows["_e"].to_numpy(), apart, out=race, where=apart > 0)
                    at = min(np.flatnonzero(race == race.min()), key=lambda i: tuple(x[i]))
                    yield pd.DataFrame(dict(zip(keys, key, strict=True)) | {"_race": [race[at]], "center": [x[at]]})

        return nearest

    chosen: dict[tuple, list] = {}
    add(table.select(*keys, F.col("_e").alias("_race"), F.array(*inputs).alias("center")))
    for drawn in range(1, most):
        # Groups that ran out of distinct points are settled.
        open_ = {key: {0: (np.array(c),)} for key, c in chosen.items() if len(c) == drawn}
        if not open_:
            break
        add(table.mapInPandas(next_of(open_), schema))
    return chosen


def fit_grouped_kmeans(points: Points, ks: Sequence[int], steps: int = 20) -> DataFrame:
    """Centres of every group and number of clusters: keys, k, label, center, n, step.

    Lloyd steps run for all groups and all `ks` of a block together, one job a step: every
    task sends its sums by (group, k, label), the new centres are the means; a cluster without points keeps its
    centre. `step` is the last one that moved a centre of its (group, k): the centres of a
    `step` below `steps` have converged. Steps end when nothing moves, or after `steps`.
    Distances tie to the smaller label. The same rows give the same centres.
    """
    ks = sorted(set(ks))
    return _in_blocks(points, sum(ks) * (len(points.inputs) * 8 + 100), lambda block: _lloyd(block, ks, steps))


def _lloyd(points: Points, ks: Sequence[int], steps: int) -> DataFrame:
    table, keys, inputs = points
    size, names = len(inputs), [f"_s{i}" for i in range(len(inputs))]
    schema = f"{points.key_fields}k int, label int, n bigint, " + ", ".join(f"{c} double" for c in names)

    def sums_of(models: Models) -> Callable:
        def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, np.ndarray] = {}

            def release() -> pd.DataFrame:
                index = pd.DataFrame(list(held), columns=[*keys, "k", "label"])
                sums = np.array(list(held.values()))
                held.clear()
                return index.assign(n=sums[:, 0].astype(np.int64), **{c: sums[:, i + 1] for i, c in enumerate(names)})

            for key, _, x, by_k in _by_group(keys, inputs, models, batches):
                one = np.hstack([np.ones((len(x), 1)), x])
                for k, (centres,) in by_k.items():
                    at = _squares(x, centres).argmin(1)
                    for i in np.unique(at):
                        slot = (*key, k, int(i))
                        held[slot] = held.get(slot, 0.0) + one[at == i].sum(0)
                if len(held) * (size * 8 + 200) > HELD_BYTES:
                    yield release()
            if held:
                yield release()

        return assigned

    starts = _starts(points, max(ks))
    models = {key: {k: (np.array(c[:k]),) for k in ks} for key, c in starts.items()}
    counts = {(key, k): np.zeros(len(c), np.int64) for key, by_k in models.items() for k, (c,) in by_k.items()}
    last = dict.fromkeys(counts, 0)
    for step in range(1, steps + 1):
        sums = table.mapInPandas(sums_of(models), schema).groupBy(*keys, "k", "label").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
        after = {slot: models[slot[0]][slot[1]][0].copy() for slot in counts}
        for n in counts.values():
            n[:] = 0
        for r in sums.collect():
            slot = (tuple(r[c] for c in keys), r["k"])
            counts[slot][r["label"]] = r["n"]
            after[slot][r["label"]] = [r[c] / r["n"] for c in names]
        moved = [slot for slot, c in after.items() if not np.array_equal(c, models[slot[0]][slot[1]][0])]
        for slot in moved:
            last[slot] = step
            models[slot[0]][slot[1]] = (after[slot],)
        if not moved:
            break
    rows = [(*key, k, label, c.tolist(), int(counts[key, k][label]), last[key, k]) for key, by_k in models.items() for k, (own,) in by_k.items() for label, c in enumerate(own)]
    return table.sparkSession.createDataFrame(rows, f"{points.key_fields}k int, label int, center array<double>, n bigint, step int")


def assign_clusters(points: Points, centres: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`keep`, k, label, distance2 (squared, to the centre) of every point, for every number of clusters."""
    keep = list(keep)
    fields = "".join(f"`{c}` {points.table.schema[c].dataType.simpleString()}, " for c in keep)

    keys, inputs = points.keys, points.inputs

    def work(block: Points) -> DataFrame:
        models = _fetched(centres.join(block.table.select(*keys).distinct(), keys, "left_semi"), keys, ["label", "center"])

        def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, rows, x, by_k in _by_group(keys, inputs, models, batches):
                for k, (labels, own) in by_k.items():
                    apart = _squares(x, own)
                    at = apart.argmin(1)
                    yield rows[keep].assign(k=k, label=labels[at], distance2=apart[np.arange(len(x)), at])

        return block.table.mapInPandas(label, f"{fields}k int, label int, distance2 double")

    return _in_blocks(points, 16 * (len(points.inputs) * 8 + 100), work)


def kmeans_labels(df: DataFrame, inputs: Sequence[str], keep: Sequence[str], asset: str = "asset", k: int = 8, steps: int = 20, seed: str = "") -> DataFrame:
    """`keep` and the cluster label of every complete row, with one k-means per asset on unscaled sensors.

    Labels number the clusters from 0 in the order of their starts. `keep` names the asset
    and what tells its rows apart.
    """
    points = sensor_points(df, [asset], inputs, [c for c in keep if c != asset], seed)
    return assign_clusters(points, fit_grouped_kmeans(points, [k], steps), keep).drop("k", "distance2")


def silhouettes(points: Points, centres: DataFrame) -> DataFrame:
    """Mean silhouette of every group and number of clusters: keys, k, silhouette, n.

    Squared Euclidean distances. The mean squared distance of a point x to a cluster of n
    points with sum s and sum of squares q is |x|² - 2 x·s / n + q / n, so two passes serve all
    pairs of points: one for the moments about the group's mean, one for the points. Own
    clusters count without the point itself; a point alone in its cluster counts 0; with
    fewer than two clusters in use the silhouette is NULL.
    """
    bytes_each = 120 * (2 * len(points.inputs) * 8 + 150)
    return _in_blocks(points, bytes_each, lambda block: _silhouettes(block, centres))


def _silhouettes(points: Points, centres: DataFrame) -> DataFrame:
    table, keys, inputs = points
    middle = table.groupBy(*keys).agg(F.array(*[F.avg(c) for c in inputs]).alias("middle"))
    models = stage(centres.join(middle, keys).select(*keys, "k", "label", "center", "middle"))
    names = [f"_s{i}" for i in range(len(inputs))]
    first = _fetched(models, keys, ["label", "center", "middle"])
    schema = f"{points.key_fields}k int, label int, n bigint, q double, " + ", ".join(f"{c} double" for c in names)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, _, x, by_k in _by_group(keys, inputs, first, batches):
            for k, (labels, own, about) in by_k.items():
                at = _squares(x, own).argmin(1)
                used = np.unique(at)
                parts = [x[at == i] - about[0] for i in used]
                data = dict(zip(keys, key, strict=True)) | {"k": k, "label": labels[used], "n": [len(p) for p in parts], "q": [float((p * p).sum()) for p in parts]}
                yield pd.DataFrame(data | dict(zip(names, np.array([p.sum(0) for p in parts]).T, strict=True)))

    sums = F.array(*[F.sum(c) for c in names]).alias("s")
    clusters = table.mapInPandas(moments, schema).groupBy(*keys, "k", "label").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), sums)
    second = _fetched(models.join(clusters, [*keys, "k", "label"]), keys, ["label", "center", "middle", "n", "q", "s"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, _, x, by_k in _by_group(keys, inputs, second, batches):
            row = np.arange(len(x))
            for k, (_, own, about, n, q, s) in by_k.items():
                total = None
                if len(own) > 1:
                    rest = x - about[0]
                    at = _squares(x, own).argmin(1)
                    mean = (rest * rest).sum(1)[:, None] - 2 * rest @ (s / n[:, None]).T + q / n
                    inner = np.maximum(mean[row, at], 0) * n[at] / np.maximum(n[at] - 1, 1)
                    mean[row, at] = np.inf
                    outer = np.maximum(mean.min(1), 0)
                    larger = np.maximum(inner, outer)
                    shares = np.zeros(len(x))
                    np.divide(outer - inner, larger, out=shares, where=(n[at] > 1) & (larger > 0))
                    total = float(shares.sum())
                yield pd.DataFrame(dict(zip(keys, key, strict=True)) | {"k": [k], "total": [total], "n": [len(x)]}).astype({"total": float})

    scored = table.mapInPandas(score, f"{points.key_fields}k int, total double, n bigint")
    mean = F.sum("total") / F.sum("n")
    return scored.groupBy(*keys, "k").agg(F.when(~F.isnan(mean), mean).alias("silhouette"), F.sum("n").alias("n"))


def silhouette_sweep(df: DataFrame, inputs: Sequence[str], row: Sequence[str], ks: Sequence[int] = range(2, 15), asset: str = "asset", steps: int = 20, seed: str = "") -> DataFrame:
    """Mean silhouette (squared Euclidean) per asset and number of clusters, all from the same passes."""
    points = sensor_points(df, [asset], inputs, row, seed)
    return silhouettes(points, fit_grouped_kmeans(points, ks, steps)).drop("n")


def grouped_axes(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], k: int = 2) -> DataFrame:
    """Leading principal axes of every group: keys, middle, axes (k rows; the largest entry of each is positive)."""
    keys, size = list(keys), len(inputs)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)

    def axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.to_dict("records"):
                vectors = np.linalg.eigh(_square(row["cov"], size))[1][:, ::-1][:, :k]
                vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
                yield pd.DataFrame({c: [row[c]] for c in keys} | {"middle": [np.asarray(row["mean"])], "axes": [list(vectors.T)]})

    return grouped_covariance(df, keys, inputs).mapInPandas(axes, f"{fields}middle array<double>, axes array<array<double>>")


def state_projection(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` with x and y, each row's scores on the two principal axes of its own group; NULL where an input is missing or not finite."""
    axes = checked_broadcast(grouped_axes(df.where(_usable(inputs)), keys, inputs), row_bytes=64 + 24 * len(inputs))

    def score(axis: int) -> Column:
        return F.when(F.expr(_usable(inputs)), reduce(Column.__add__, [F.col("axes")[axis][i] * (F.col(c).cast("double") - F.col("middle")[i]) for i, c in enumerate(inputs)]))

    return df.join(axes, list(keys), "left").select(*keep, score(0).alias("x"), score(1).alias("y"))
