"""Regression on telemetry and forecasts: closed forms per group, and ML pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordered import positions
from sensorloom.operators.sampling import contiguous_folds
from sensorloom.operators.sizing import checked_broadcast, plan_slices

# Columns that are keys, times or targets and never features.
NOT_FEATURES = ("asset", "timestamp", "fcast_time", "fcast_day", "day", "true_WTURPower", "pred_WTURPower")


def feature_columns(df: DataFrame, exclude: Iterable[str] = NOT_FEATURES) -> list[str]:
    """All columns but the excluded ones, in table order."""
    excluded = set(exclude)
    return [c for c in df.columns if c not in excluded]


# --- closed forms: one aggregate for all groups -------------------------------------------


def ridge_gram(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Row count and sums of products XᵀX, Xᵀy, yᵀy over complete rows, one row per group."""
    columns = [*features, label]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = [F.sum(a).alias(f"s_{a}") for a in columns]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"g_{a}_{b}") for a, b in pairs]
    return df.na.drop("any", subset=columns).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def grouped_covariance(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group: n, column means and upper triangle of the sample covariance, over complete rows.

    The built-in aggregates merge partial moments before the shuffle, so a
    group of any size costs one row per task.
    """
    upper = [F.covar_samp(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return df.na.drop("any", subset=list(columns)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*upper).alias("cov")
    )


def _square(upper: np.ndarray, size: int) -> np.ndarray:
    full = np.zeros((size, size))
    i, j = np.triu_indices(size)
    full[i, j] = full[j, i] = np.nan_to_num(np.asarray(upper, dtype=float))
    return full


def fit_grouped_ridge(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, alphas: Sequence[float]
) -> DataFrame:
    """Ridge with free intercept for every group and penalty: (keys, alpha, n, intercept, coef).

    One aggregate serves all groups and penalties; only the moments, one small
    row per group, reach the solver.
    """
    keys = list(keys)
    size = len(features) + 1
    moments = grouped_covariance(df, keys, [*features, label])
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.to_dict("records"):
                mean = np.asarray(row["mean"], dtype=float)
                scatter = _square(row["cov"], size) * max(row["n"] - 1, 0)
                for alpha in alphas if row["n"] else ():
                    left = scatter[:-1, :-1] + alpha * np.eye(size - 1)
                    coef = np.linalg.lstsq(left, scatter[:-1, -1], rcond=None)[0]
                    found = {"alpha": alpha, "n": row["n"], "intercept": mean[-1] - coef @ mean[:-1], "coef": [coef]}
                    yield pd.DataFrame({k: row[k] for k in keys} | found, index=[0])

    return moments.mapInPandas(solve, f"{fields}alpha double, n bigint, intercept double, coef array<double>")


def predict_grouped(
    df: DataFrame, model: DataFrame, keys: Sequence[str], features: Sequence[str], name: str = "prediction"
) -> DataFrame:
    """Apply the models of `fit_grouped_ridge`; NULL where a feature or a model is missing."""
    terms = F.col("intercept")
    for i, feature in enumerate(features):
        terms = terms + F.col("coef")[i] * F.col(feature)
    joined = df.join(checked_broadcast(model.select(*keys, "intercept", "coef")), list(keys), "left")
    return joined.select(*df.columns, terms.alias(name))


def pca_variance(df: DataFrame, keys: Sequence[str], columns: Sequence[str], first: int = 2, last: int | None = None) -> DataFrame:
    """Share of variance explained by the first n components, n = `first` .. `last`, per group.

    One covariance aggregate serves every group and every n. `last` defaults to
    two less than the number of columns.
    """
    keys = list(keys)
    size = len(columns)
    last = size - 2 if last is None else last
    moments = grouped_covariance(df, keys, columns)
    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keys)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.arange(first, last + 1)
        for rows in batches:
            for row in rows.to_dict("records"):
                values = np.clip(np.linalg.eigvalsh(_square(row["cov"], size))[::-1], 0, None)
                total = values.sum()
                share = np.cumsum(values)[counts - 1] / total if total > 0 else np.full(len(counts), np.nan)
                yield pd.DataFrame({k: row[k] for k in keys} | {"n": counts, "explained": share})

    return moments.mapInPandas(shares, f"{fields}n bigint, explained double")


# --- ML pipelines: component reduction, polynomial terms, scaling, regression ------------


def preparation(inputs: Sequence[str], components: int = 14, degree: int = 2) -> Pipeline:
    """Centre, reduce to principal components, expand polynomially and standardise."""
    k = min(components, len(inputs))
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(inputs), outputCol="_raw", handleInvalid="skip"),
            StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
            PCA(k=k, inputCol="_centred", outputCol="_scores"),
            PolynomialExpansion(degree=degree, inputCol="_scores", outputCol="_poly"),
            StandardScaler(inputCol="_poly", outputCol="features", withMean=True, withStd=True),
        ]
    )


def ridge(df: DataFrame, label: str, alpha: float, features: str = "features", prediction: str = "prediction") -> LinearRegression:
    """Estimator equal to ridge with penalty `alpha` on this data.

    The solver scales its penalty by rows and label deviation, so both are measured.
    """
    n, sigma = df.agg(F.count(label), F.stddev_pop(label)).first()
    return LinearRegression(
        featuresCol=features,
        labelCol=label,
        predictionCol=prediction,
        elasticNetParam=0.0,
        regParam=alpha * (sigma or 0.0) / max(n, 1),
        standardization=False,
        solver="normal",
    )


def affine(df: DataFrame, label: str, alpha: float, prediction: str = "prediction") -> LinearRegression:
    """Affine model of the standardised features, the function class of an identity-activation network."""
    return ridge(df, label, alpha, prediction=prediction)


def boosted_trees(label: str, prediction: str = "prediction", iterations: int = 20, depth: int = 5, seed: int = 7) -> GBTRegressor:
    """Regressor that is not linear in the prepared features."""
    return GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol=prediction, maxIter=iterations, maxDepth=depth, seed=seed
    )


@dataclass
class SearchResult:
    """Outcome of a grid search: winning setting, mean fold score of each, refitted model."""

    best: Any
    scores: dict[Any, float]
    model: PipelineModel
    inputs: list[str] = field(default_factory=list)


def fit_pipeline(
    df: DataFrame,
    inputs: Sequence[str],
    label: str,
    estimator: Callable[[DataFrame], Any],
    components: int = 14,
    degree: int = 2,
) -> PipelineModel:
    """Fit preparation and regressor on the complete rows of `df`."""
    complete = df.select(*inputs, label).na.drop("any")
    prepared = preparation(inputs, components, degree).fit(complete)
    train = prepared.transform(complete).select("features", label)
    return PipelineModel(stages=[*prepared.stages, estimator(train).fit(train)])


def with_folds(
    df: DataFrame, order: str, tiebreak: Sequence[str] = (), folds: int = 3, keys: Sequence[str] = ()
) -> DataFrame:
    """Contiguous folds along `order`, over the whole table or within each key."""
    by = list(keys) or ["_all"]
    one = df if keys else df.withColumn("_all", F.lit(1))
    slices = plan_slices(one, by, order)
    numbered = positions(one, by, order, tiebreak, name="_pos", slices=slices)
    sizes = one.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    sized = numbered.join(slices.per_key(sizes), by)
    return contiguous_folds(sized, "_size", "_pos", folds).select(*df.columns, "fold")


def grid_search(
    df: DataFrame,
    inputs: Sequence[str],
    label: str,
    grid: dict[Any, Callable[[DataFrame], Any]],
    fold: str = "fold",
    folds: int = 3,
    components: int = 14,
    degree: int = 2,
) -> SearchResult:
    """Cross-validated choice by mean R² over the folds, then a refit on all rows.

    Preparation is fitted once per fold and shared by the candidates of the
    grid, which differ in the last stage only.
    """
    inputs = list(inputs)
    data = df.select(*inputs, label, fold).na.drop("any").persist()
    scorer = RegressionEvaluator(labelCol=label, metricName="r2")

    def one_fold(f: int) -> dict[Any, float]:
        train, held = data.filter(F.col(fold) != f), data.filter(F.col(fold) == f)
        prepared = preparation(inputs, components, degree).fit(train)
        ready = prepared.transform(train).select("features", label).persist()
        test = prepared.transform(held).select("features", label).persist()
        scores = {s: scorer.evaluate(make(ready).fit(ready).transform(test)) for s, make in grid.items()}
        ready.unpersist()
        test.unpersist()
        return scores

    with ThreadPool(folds) as pool:
        by_fold = pool.map(one_fold, range(folds))
    scores = {s: float(np.mean([one[s] for one in by_fold])) for s in grid}
    best = max(scores, key=scores.get)
    model = fit_pipeline(data, inputs, label, grid[best], components, degree)
    data.unpersist()
    return SearchResult(best, scores, model, inputs)


def predict(model: PipelineModel, df: DataFrame, inputs: Sequence[str], keys: Sequence[str], name: str) -> DataFrame:
    """Rows of `df` with a prediction; rows with a missing feature keep a NULL prediction.

    `keys` identify a row, so skipped rows come back with a join on them.
    """
    last = model.stages[-1].getPredictionCol()
    done = model.transform(df).select(*keys, F.col(last).alias(name))
    if not any(df.schema[c].nullable for c in inputs):
        return model.transform(df).select(*df.columns, F.col(last).alias(name))
    return df.join(done, list(keys), "left")
