import numpy as np
import pandas as pd
import pytest

from sensorloom.operators import grouped_pipeline as gp
from sensorloom.operators import regression

INPUTS = list("abcd")


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    parts = []
    for asset, n in (("A001", 240), ("A002", 90)):
        x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + 5
        y = x[:, 0] * x[:, 1] - 2 * x[:, 2] + rng.normal(size=n)
        parts.append(pd.DataFrame(x, columns=INPUTS).assign(y=y, asset=asset, t=np.arange(n), fold=np.arange(n) * 3 // n))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(6).persist()


def expected(train, test, alpha, k):
    """Components, quadratic terms, standardisation and ridge, written out for one table."""
    x, y = train[INPUTS].to_numpy(), train.y.to_numpy()
    mean = x.mean(0)
    axes = np.linalg.svd(x - mean, full_matrices=False)[2][:k]
    i, j = np.triu_indices(k)

    def terms(rows):
        s = (rows[INPUTS].to_numpy() - mean) @ axes.T
        return np.hstack([s, s[:, i] * s[:, j]])

    p = terms(train)
    mu, sd = p.mean(0), p.std(0)
    z = (p - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + (terms(test) - mu) / sd @ w


@pytest.mark.parametrize("components", [4, 2])
def test_models_equal_the_written_out_pipeline(sample, components):
    pdf, df = sample
    models = gp.fit_grouped_pipeline(df, ["asset"], INPUTS, "y", [0.01, 5.0], components)
    out = gp.predict_grouped_pipeline(df, models, ["asset"], INPUTS, "p", components).toPandas()
    assert len(out) == 2 * len(pdf)
    for (asset, alpha), one in out.groupby(["asset", "alpha"]):
        train = pdf[pdf.asset == asset].sort_values("t")
        assert np.allclose(one.sort_values("t").p, expected(train, train, alpha, components))


def test_missing_inputs_give_no_prediction(sample):
    _, df = sample
    models = gp.fit_grouped_pipeline(df.filter("asset = 'A001'"), ["asset"], INPUTS, "y", [1.0])
    out = gp.predict_grouped_pipeline(df.selectExpr("asset", "t", "nullif(a, a) as a", "b", "c", "d"), models, ["asset"], INPUTS, "p")
    assert out.count() == 330 and out.filter("p is not null").count() == 0


def test_search_scores_equal_fold_by_fold_fits(sample):
    pdf, df = sample
    alphas = [0.01, 1e5]
    scores, models = gp.grouped_grid_search(df, ["asset"], INPUTS, "y", alphas)
    for row in scores.collect():
        one, r2 = pdf[pdf.asset == row.asset], []
        for f in range(3):
            test = one[one.fold == f]
            p = expected(one[one.fold != f], test, row.alpha, 4)
            r2.append(1 - ((test.y - p) ** 2).sum() / ((test.y - test.y.mean()) ** 2).sum())
        assert np.isclose(row.r2, np.mean(r2))
    assert {(r.asset, r.alpha, r.n) for r in models.collect()} == {("A001", 0.01, 240), ("A002", 0.01, 90)}


def test_agrees_with_the_ml_pipeline_without_penalty(sample):
    pdf, df = sample
    one = df.filter("asset = 'A002'")
    model = regression.fit_pipeline(one, INPUTS, "y", lambda t: regression.ridge(t, "y", 0.0))
    ml = model.transform(one).select("t", "prediction").toPandas().sort_values("t").prediction
    grouped = gp.fit_grouped_pipeline(one, ["asset"], INPUTS, "y", [0.0])
    ours = gp.predict_grouped_pipeline(one, grouped, ["asset"], INPUTS, "p").toPandas().sort_values("t").p
    assert np.allclose(ml, ours, atol=1e-6)


def test_many_interleaved_groups_in_bounded_memory(spark, monkeypatch):
    """5,000 groups whose rows alternate: a task holds one group's sums and little more."""
    monkeypatch.setattr(gp, "HELD_BYTES", 1 << 16)
    monkeypatch.setattr(gp, "RECORD", 4)
    monkeypatch.setattr(gp, "BLOCK_ROWS", 2)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.tile(np.arange(5000), 4), "a": rng.normal(size=20000), "b": rng.normal(size=20000), "y": rng.normal(size=20000)})
    df = spark.createDataFrame(pdf).repartition(3)
    sizes: list[int] = []
    rows = gp.group_sums(df, ["g"], ["a", "b"], "y")
    found = rows.toPandas()
    assert len(found) == 5000 * 7 and found.sums.map(len).max() == 4
    for g in (0, 17, 4999):
        one = pdf[pdf.g == g]
        terms = np.hstack([gp.quadratic_terms(one[["a", "b"]].to_numpy()), one[["y"]].to_numpy()])
        assert np.allclose(gp._square(found[found.g == g], 7), terms.T @ terms)

    # The batches a task sends never hold more than the bound and one group.
    class Rows:
        def __init__(self, df):
            self.df, self.schema = df, df.schema

        select = sortWithinPartitions = lambda self, *_: self

        def mapInPandas(self, run, _):
            sizes.extend(len(part) for part in run(iter([pdf.sort_values("g")])))
            raise StopIteration

    with pytest.raises(StopIteration):
        gp.group_sums(Rows(df), ["g"], ["a", "b"], "y")
    assert len(sizes) > 10 and max(sizes) * gp.RECORD * 8 <= gp.HELD_BYTES + 7 * gp.RECORD * 8


def test_groups_without_a_defined_score_keep_a_model(spark):
    rng = np.random.default_rng(2)
    rows = [("flat", float(rng.normal()), 3.0, i % 3) for i in range(30)] + [("one fold", float(rng.normal()), float(i), 0) for i in range(30)]
    rows += [("fine", float(i), 2.0 * i + float(rng.normal()), i % 3) for i in range(30)] + [("lone", 1.0, 5.0, 1)]
    df = spark.createDataFrame(rows, "asset string, a double, y double, fold int")
    scores, models = gp.grouped_grid_search(df, ["asset"], ["a"], "y", [5.0, 0.1])
    r2 = {(r.asset, r.alpha): r.r2 for r in scores.collect()}
    assert {k for k, v in r2.items() if v is None} == {(a, p) for a in ("flat", "one fold", "lone") for p in (5.0, 0.1)}
    assert {(r.asset, r.alpha, r.n) for r in models.collect()} == {("flat", 5.0, 30), ("one fold", 5.0, 30), ("fine", 0.1, 30), ("lone", 5.0, 1)}
    out = gp.predict_grouped_pipeline(df, models, ["asset"], ["a"], "p").toPandas()
    assert np.allclose(out[out.asset == "flat"].p, 3.0) and np.isclose(out[out.asset == "lone"].p.iloc[0], 5.0)


def test_models_outside_the_broadcast_bound_and_too_many_inputs(sample, monkeypatch):
    from sensorloom.operators import sizing

    pdf, df = sample
    want = gp.predict_grouped_pipeline(df, gp.fit_grouped_pipeline(df, ["asset"], INPUTS, "y", [1.0]), ["asset"], INPUTS, "p").toPandas()
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 100)
    models = gp.fit_grouped_pipeline(df, ["asset"], INPUTS, "y", [1.0])
    got = gp.predict_grouped_pipeline(df, models, ["asset"], INPUTS, "p").toPandas()
    sort = lambda f: f.sort_values(["asset", "t"]).p.to_numpy()
    assert np.allclose(sort(want), sort(got))
    with pytest.raises(ValueError, match="reduce them first"):
        gp.fit_grouped_pipeline(df, ["asset"], ["a"] * 65, "y", [1.0])
