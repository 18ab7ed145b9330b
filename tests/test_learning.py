import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sensorloom.operators import regression
from sensorloom.sources.staging import stage, staging_folder, union_in_batches


def closed_form(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - w @ x.mean(0)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    n = 240
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + 3
    y = x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, asset=np.where(np.arange(n) % 3 == 0, "A002", "A001"), t=np.arange(n))
    return pdf, spark.createDataFrame(pdf).persist()


@pytest.mark.parametrize("alpha,slope", [(0.01, 2.487562), (1, 1.666667), (100, 0.049020)])
def test_ridge_on_three_points(spark, alpha, slope):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "x double, y double")
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    assert np.isclose(regression.ridge(data, "y", alpha).fit(data).coefficients[0], slope, atol=1e-6)
    row = regression.fit_grouped_ridge(df, [], ["x"], "y", [alpha]).first()
    assert np.isclose(row.coef[0], slope, atol=1e-6) and row.alpha == alpha


def test_grouped_ridge_equals_closed_form(sample):
    pdf, df = sample
    model = regression.fit_grouped_ridge(df, ["asset"], list("abcd"), "y", [0.01, 10.0])
    for row in model.collect():
        one = pdf[pdf.asset == row.asset]
        w, b = closed_form(one[list("abcd")].to_numpy(), one.y.to_numpy(), row.alpha)
        assert np.allclose(row.coef, w) and np.isclose(row.intercept, b) and row.n == len(one)
    out = regression.predict_grouped(df, model.filter("alpha = 10"), ["asset"], list("abcd"), "p").toPandas()
    one = out[out.asset == "A001"]
    w, b = closed_form(one[list("abcd")].to_numpy(), one.y.to_numpy(), 10.0)
    assert np.allclose(one.p, one[list("abcd")].to_numpy() @ w + b)


def test_gram_sums(sample):
    pdf, df = sample
    row = regression.ridge_gram(df, ["a", "b"], "y").first()
    assert row.n == len(pdf) and np.isclose(row.g_a_b, (pdf.a * pdf.b).sum()) and np.isclose(row.s_y, pdf.y.sum())


def test_pca_variance_is_monotone_and_complete(sample):
    pdf, df = sample
    out = regression.pca_variance(df, ["asset"], list("abcd"), 1, 4).toPandas()
    for asset, one in out.groupby("asset"):
        x = pdf[pdf.asset == asset][list("abcd")].to_numpy()
        values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
        assert np.allclose(one.sort_values("n").explained, np.cumsum(values) / values.sum())
    assert set(regression.pca_variance(df, ["asset"], list("abcd")).toPandas().n) == {2}


def test_grid_search_prefers_the_weak_penalty(sample):
    _, df = sample
    folded = regression.with_folds(df, "t")
    assert {r.fold: r["count"] for r in folded.groupBy("fold").count().collect()} == {0: 80, 1: 80, 2: 80}
    by_asset = regression.with_folds(df, "t", keys=["asset"]).groupBy("asset", "fold").count().collect()
    assert {(r.asset, r.fold): r["count"] for r in by_asset}[("A002", 2)] == 26 and len(by_asset) == 6
    grid = {a: (lambda train, a=a: regression.ridge(train, "y", a)) for a in (1.0, 1e6)}
    result = regression.grid_search(folded, list("abcd"), "y", grid)
    assert result.best == 1.0 and result.scores[1.0] > 0.5 > result.scores[1e6]
    out = regression.predict(result.model, df.withColumn("a", F.when(F.col("t") > 0, F.col("a"))), list("abcd"), ["t"], "p")
    assert out.count() == 240 and out.filter("p is null").count() == 1


def test_feature_columns():
    class Table:
        columns = ["asset", "timestamp", "WTURPower", "range", "day", "true_WTURPower"]

    assert regression.feature_columns(Table) == ["WTURPower", "range"]


def test_staged_tables_go_to_the_shared_folder(spark):
    folder = staging_folder(spark)
    assert folder == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    df = stage(spark.range(10), ["id"])
    assert df.count() == 10
    assert all(f.split(":", 1)[1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")) for f in df.inputFiles())


@pytest.mark.parametrize("batch", [2, 10])
def test_union_in_batches(spark, batch):
    build = lambda names: [spark.createDataFrame([(n,)], "name string") for n in names]
    out = union_in_batches(list("abcde"), build, batch)
    assert sorted(r.name for r in out.collect()) == list("abcde")


def test_per_asset_predictions_keep_every_cell(spark, tmp_path, at):
    """A late sensor, a day without truth and an asset without one sensor leave no cell out."""
    from sensorloom.plans.catalog import QUERIES
    from sensorloom.sources import roles

    rng = np.random.default_rng(4)
    begins = {v: 0 for v in roles.VARIABLES} | {"error": 30}
    rows = [
        (a - 1, v, at(60 * h), float(rng.normal()), 0)
        for a in (1, 2) for v, begin in begins.items() for h in range(begin, 120) if (a, v) != (2, "signup")
    ]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    events = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, value double, event_id long")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["per_asset_predictions"](spark, str(tmp_path)).toPandas()
    days = found.fcast_day.map(str)
    assert len(found) == 2 * 5 * 24 and not found.duplicated(["asset", "fcast_day", "range"]).any()
    assert found[found.asset == "A002"].pred_WTURPower.isna().all()
    known = found[found.asset == "A001"].pred_WTURPower.notna()
    # The first day has no complete reading; the last has no truth, yet a prediction.
    assert (known == (days[found.asset == "A001"] > "2024-01-02")).all() and known.sum() == 4 * 24
