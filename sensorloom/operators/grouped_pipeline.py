"""Component reduction, quadratic terms, scaling and ridge for every group at once.

A fleet of any size is fitted in two passes over the table: means and deviations of the
inputs, then sums of products of their quadratic terms by group and fold. Everything else
follows from these sums: the training set of a fold is the total less the fold, components
are turned into by a change of basis, and a held-out fold's score needs no second look at its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.sizing import checked_broadcast
from sensorloom.sources.staging import stage

#: Bytes of finished sums that a task holds before it sends them on; doubles in a record of sums; rows expanded at a time.
HELD_BYTES = 32 << 20
RECORD = 1024
BLOCK_ROWS = 4096
#: More inputs would make the sums of one group too large for a task (64 inputs: 18 MB).
MAX_INPUTS = 64


def _dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in constant code size however long they are."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def _scores(inputs: Sequence[str]) -> Column:
    """Array of component scores of a row from its group's `center` and `basis`."""
    deviations = F.zip_with(F.array(*[F.col(c).cast("double") for c in inputs]), F.col("center"), lambda x, m: x - m)
    return F.transform("basis", lambda axis: _dot(axis, deviations))


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)


def _runs(rows: pd.DataFrame, by: Sequence[str]) -> list[tuple[tuple, int, int]]:
    """(key, start, end) of the runs of equal keys in sorted rows."""
    keys = rows[list(by)]
    new = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
    return [(tuple(keys.iloc[a]), int(a), int(b)) for a, b in zip(new, [*new[1:], len(rows)], strict=True)]


def quadratic_terms(z: np.ndarray) -> np.ndarray:
    """1, the columns and all their products, a <= b."""
    a, b = np.triu_indices(z.shape[1])
    return np.hstack([np.ones((len(z), 1)), z, z[:, a] * z[:, b]])


def group_sums(rows: DataFrame, by: Sequence[str], inputs: Sequence[str], label: str) -> DataFrame:
    """Sums of products of the quadratic terms and the label: by, record, sums (a piece of the upper triangle).

    Rows are sorted by group inside their partitions, so a task holds the sums of one group
    and at most HELD_BYTES of finished ones, however many groups there are and however they
    interleave. The tasks' sums go in records of RECORD numbers to the task of their group
    and piece, which adds them one after the other: their number does not matter.
    """
    by, inputs = list(by), list(inputs)
    width = 2 + len(inputs) + len(inputs) * (len(inputs) + 1) // 2
    upper = np.triu_indices(width)
    cuts = list(range(0, len(upper[0]), RECORD))
    schema = f"{_fields(rows, by)}record int, sums array<double>"

    def sent(done: list[tuple[tuple, int, np.ndarray]]) -> pd.DataFrame:
        data = {c: [key[i] for key, _, _ in done] for i, c in enumerate(by)}
        return pd.DataFrame(data | {"record": [r for _, r, _ in done], "sums": [v for _, _, v in done]})

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[tuple[tuple, int, np.ndarray]] = []
        key, gram = None, np.zeros((width, width))

        def finish() -> None:
            flat = gram[upper]
            done.extend((key, i, flat[at : at + RECORD]) for i, at in enumerate(cuts))

        for batch in batches:
            for run, start, end in _runs(batch, by):
                if key is not None and run != key:
                    finish()
                    gram = np.zeros((width, width))
                    if len(done) * RECORD * 8 > HELD_BYTES:
                        yield sent(done)
                        done = []
                key = run
                for at in range(start, end, BLOCK_ROWS):
                    part = batch.iloc[at : min(end, at + BLOCK_ROWS)]
                    terms = np.hstack([quadratic_terms(part[inputs].to_numpy(dtype=float)), part[[label]].to_numpy(dtype=float)])
                    gram += terms.T @ terms
        if key is not None:
            finish()
            yield sent(done)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[tuple, np.ndarray] | None = None
        for batch in batches:
            done = []
            for run, start, end in _runs(batch, [*by, "record"]):
                total = np.sum(np.stack(batch["sums"].iloc[start:end].to_list()), axis=0)
                if held is not None and held[0] == run:
                    held = run, held[1] + total
                    continue
                if held is not None:
                    done.append((held[0][:-1], held[0][-1], held[1]))
                held = run, total
            if done:
                yield sent(done)
        if held is not None:
            yield sent([(held[0][:-1], held[0][-1], held[1])])

    partial = rows.select(*by, *inputs, label).sortWithinPartitions(*by).mapInPandas(products, schema)
    return partial.repartition(*by, "record").sortWithinPartitions(*by, "record").mapInPandas(add, schema)


def _square(records: pd.DataFrame, width: int) -> np.ndarray:
    full = np.zeros((width, width))
    i, j = np.triu_indices(width)
    full[i, j] = full[j, i] = np.concatenate(records.sort_values("record")["sums"].to_list())
    return full


def _reduced(gram: np.ndarray, size: int, k: int, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Principal axes of a training set and the change of basis to its quadratic terms in their scores.

    `gram` is over 1, z, products of z and y; inputs are shift + scale * z. Returns the mean of
    z, the axes in input units, scaled to unit variance of the scores, and the matrix that
    takes (1, z, products, y) to (1, scores, products of scores, y).
    """
    n, mean = gram[0, 0], gram[0, 1 : size + 1] / gram[0, 0]
    cov = (gram[1 : size + 1, 1 : size + 1] / n - np.outer(mean, mean)) * n / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    floor = max(values[0], 0.0) * 1e-12
    basis = (vectors / np.sqrt(np.where(values > floor, values, 1.0))).T
    # Score i is constant[i] + linear[i] @ z.
    linear = basis * scale
    constant = -linear @ mean
    a, b = np.triu_indices(size)
    i, j = np.triu_indices(k)
    change = np.zeros((2 + k + len(i), len(gram)))
    change[0, 0] = change[-1, -1] = 1
    change[1 : k + 1, 0], change[1 : k + 1, 1 : size + 1] = constant, linear
    products = change[k + 1 : -1]
    products[:, 0] = constant[i] * constant[j]
    products[:, 1 : size + 1] = constant[i][:, None] * linear[j] + constant[j][:, None] * linear[i]
    products[:, size + 1 : -1] = linear[i][:, a] * linear[j][:, b] + np.where(a != b, linear[i][:, b] * linear[j][:, a], 0)
    return mean, basis, change


def _ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and weights from sums over 1, terms, y; terms are standardised before the penalty applies."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(cov)[:-1], 0.0, None))
    spread[spread < 1e-9] = 1.0
    normal = n * cov[:-1, :-1] / np.outer(spread, spread) + alpha * np.eye(len(spread))
    coef = np.linalg.lstsq(normal, n * cov[:-1, -1] / spread, rcond=None)[0] / spread
    return np.append(mean[-1] - coef @ mean[:-1], coef)


def _r2(weights: np.ndarray, gram: np.ndarray) -> float | None:
    """R² of a model on the rows behind `gram`, None where it is undefined."""
    n, total = gram[0, 0], gram[0, -1]
    spread = gram[-1, -1] - total * total / n if n else 0.0
    if spread <= 1e-12 * max(gram[-1, -1], 1e-300):
        return None
    x, y = gram[:-1, :-1], gram[:-1, -1]
    return float(1 - (weights @ x @ weights - 2 * weights @ y + gram[-1, -1]) / spread)


def _solved(
    df: DataFrame, keys: list[str], inputs: list[str], label: str, alphas: Sequence[float], components: int, fold: str | None
) -> DataFrame:
    """keys, alpha, r2 (mean over folds), n, intercept, coef, center, basis: models on all rows of every group and penalty."""
    if len(inputs) > MAX_INPUTS:
        raise ValueError(f"{len(inputs)} inputs, at most {MAX_INPUTS}: reduce them first")
    size, k = len(inputs), min(components, len(inputs))
    width = 2 + size + size * (size + 1) // 2
    fields, names = _fields(df, keys), [f"_z{i}" for i in range(size)]
    values = [F.col(c).cast("double").alias(n) for c, n in zip(inputs, names, strict=True)]
    part = F.col(fold).cast("int") if fold else F.lit(0)
    complete = df.select(*keys, part.alias("_part"), *values, F.col(label).cast("double").alias("_y")).na.drop("any", subset=[*names, "_y"])
    moments = complete.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in [*names, "_y"] for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    spread = lambda c: F.when(F.col(f"{c}_s") > 0, F.col(f"{c}_s")).otherwise(1.0)
    described = stage(
        moments.select(
            *keys,
            F.array(*[F.col(f"{c}_m") for c in names]).alias("shift"),
            F.array(*[spread(c) for c in names]).alias("scale"),
            F.col("_y_m").alias("middle"),
        )
    )
    joined = complete.join(checked_broadcast(described, row_bytes=64 + 16 * size), keys)
    z = [((F.col(c) - F.col("shift")[i]) / F.col("scale")[i]).alias(c) for i, c in enumerate(names)]
    sums = group_sums(joined.select(*keys, "_part", *z, (F.col("_y") - F.col("middle")).alias("_y")), [*keys, "_part"], names, "_y")

    def solve(key: tuple, records: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        grams = {f: _square(one, width) for f, one in records.groupby("_part")}
        if not grams:
            return pd.DataFrame()
        shift, scale, middle = (np.asarray(about[c].iloc[0]) for c in ("shift", "scale", "middle"))
        total = np.sum(list(grams.values()), axis=0)
        scored: dict[float, list[float]] = {a: [] for a in alphas}
        for held in grams.values() if fold else ():
            train = total - held
            if train[0, 0] < 0.5:
                continue
            change = _reduced(train, size, k, scale)[2]
            train, held = change @ train @ change.T, change @ held @ change.T
            for alpha in alphas:
                if (r2 := _r2(_ridge(train, alpha), held)) is not None:
                    scored[alpha].append(r2)
        mean, basis, change = _reduced(total, size, k, scale)
        all_rows = change @ total @ change.T
        found = []
        for alpha in alphas:
            weights = _ridge(all_rows, alpha)
            r2 = float(np.mean(scored[alpha])) if scored[alpha] else None
            model = {"n": int(round(total[0, 0])), "intercept": float(weights[0] + middle), "coef": weights[1:]}
            found.append(dict(zip(keys, key, strict=True)) | {"alpha": alpha, "r2": r2} | model | {"center": shift + scale * mean, "basis": list(basis)})
        return pd.DataFrame(found).astype({"r2": float})

    schema = f"{fields}alpha double, r2 double, n bigint, intercept double, coef array<double>, center array<double>, basis array<array<double>>"
    out = sums.groupBy(*keys).cogroup(described.groupBy(*keys)).applyInPandas(solve, schema)
    return stage(out.withColumn("r2", F.nanvl("r2", F.lit(None).cast("double"))))


def fit_grouped_pipeline(
    df: DataFrame, keys: Sequence[str], inputs: Sequence[str], label: str, alphas: Sequence[float], components: int = 14
) -> DataFrame:
    """Models (keys, alpha, n, intercept, coef, center, basis) for every group and penalty.

    Terms are standardised by their population deviation before the penalty applies. A
    group of any size costs some records of sums per task: its rows are never brought together.
    """
    return _solved(df, list(keys), list(inputs), label, alphas, components, None).drop("r2")


def predict_grouped_pipeline(
    df: DataFrame, models: DataFrame, keys: Sequence[str], inputs: Sequence[str], name: str, components: int = 14
) -> DataFrame:
    """Add the prediction of each row's group; NULL where an input or the model is missing.

    Several penalties per group give one row each, told apart by `alpha`.
    """
    k = min(components, len(inputs))
    scores = [F.col("_s")[i] for i in range(k)]
    terms = F.array(*scores, *[scores[i] * scores[j] for i in range(k) for j in range(i, k)])
    wanted = models.select(*keys, "alpha", "intercept", "coef", "center", "basis")
    row_bytes = 100 + 8 * (len(inputs) * (k + 1) + k * (k + 3) // 2)
    joined = df.join(checked_broadcast(wanted, row_bytes=row_bytes), list(keys), "left")
    scored = joined.select(*df.columns, "alpha", "intercept", "coef", _scores(inputs).alias("_s"))
    return scored.select(*df.columns, "alpha", (F.col("intercept") + _dot(F.col("coef"), terms)).alias(name))


def grouped_grid_search(
    df: DataFrame,
    keys: Sequence[str],
    inputs: Sequence[str],
    label: str,
    alphas: Sequence[float],
    fold: str = "fold",
    components: int = 14,
) -> tuple[DataFrame, DataFrame]:
    """(scores, models): mean R² per group and penalty, and the model of the best one on all rows.

    Sums are made once per group and fold. A fold's model is fitted to the total less the
    fold and scored on the fold's own sums, so no row is copied or read again. Folds whose R² is
    undefined (constant or no truth, nothing left to learn from) do not count; a group
    without a defined one keeps the model of the first penalty. Equal scores go to the
    penalty named first.
    """
    keys = list(keys)
    solved = _solved(df, keys, list(inputs), label, alphas, components, fold)
    place = F.array_position(F.array(*[F.lit(float(a)) for a in alphas]), F.col("alpha"))
    best = solved.groupBy(*keys).agg(F.max(F.struct(F.coalesce("r2", F.lit(float("-inf"))), -place, "alpha")).getField("alpha").alias("alpha"))
    return solved.select(*keys, "alpha", "r2"), solved.drop("r2").join(best, [*keys, "alpha"])
