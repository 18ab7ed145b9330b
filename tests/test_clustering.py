"""Grouped k-means, silhouettes and projections against plain numpy."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from sensorloom.operators import clustering

INPUTS = ["x", "y", "z"]


@pytest.fixture(scope="module")
def states(spark, tmp_path_factory):
    """Three well separated states, a group of few distinct points, a single row, and rows that take no part."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    rng = np.random.default_rng(0)
    rows = []
    for asset in ("A001", "A002"):
        for i in range(90):
            rows.append((asset, i, *map(float, 20 * (i % 3) + rng.normal(size=3))))
    rows += [("A003", i, float(i % 2), 0.0, 5.0) for i in range(9)] + [("A004", 0, 1.0, 1.0, 1.0)]
    rows += [("A001", 90, None, 1.0, 1.0), ("A001", 91, float("nan"), 1.0, 1.0), ("A001", 92, float("inf"), 1.0, 1.0), (None, 0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "asset string, t int, x double, y double, z double").repartition(5)
    return pd.DataFrame([r for r in rows if r[0] and all(v is not None and np.isfinite(v) for v in r[2:])], columns=["asset", "t", *INPUTS]), df


def plain(one: pd.DataFrame, asset: str, k: int, steps: int):
    """Labels, centres and the last step that moved one, written out for one group."""
    x = one[INPUTS].to_numpy()
    draw = np.array([-np.log((int(hashlib.md5(f"|{asset}|{t}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32) for t in one.t])
    centres = [x[draw.argmin()]]
    while len(centres) < k:
        apart = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        if not apart.max():
            break
        centres.append(x[np.where(apart > 0, draw / np.where(apart > 0, apart, 1), np.inf).argmin()])
    centres, last = np.array(centres), 0
    nearest = lambda: np.array([((x - c) ** 2).sum(1) for c in centres]).argmin(0)
    for step in range(1, steps + 1):
        at = nearest()
        after = np.array([x[at == i].mean(0) if (at == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(after, centres, rtol=0, atol=1e-12):
            break
        centres, last = after, step
    return nearest(), centres, last


@pytest.mark.parametrize("block_bytes", [64 << 20, 700])
def test_all_assets_and_numbers_of_clusters_in_one_fit(states, monkeypatch, block_bytes):
    """Also where the models of all groups are too large for one block."""
    pdf, df = states
    monkeypatch.setattr(clustering, "BROADCAST_BYTES", block_bytes)
    points = clustering.sensor_points(df, ["asset"], INPUTS, ["t"])
    centres = clustering.fit_grouped_kmeans(points, [2, 3, 5], steps=15)
    found = {(r.asset, r.k): [] for r in centres.collect()}
    for r in sorted(centres.collect(), key=lambda r: r.label):
        found[r.asset, r.k].append(r)
    labels = clustering.assign_clusters(points, centres, ["asset", "t"]).toPandas()
    assert len(labels) == 3 * len(pdf) and len(found) == 4 * 3
    for (asset, k), rows in found.items():
        one = pdf[pdf.asset == asset].sort_values("t")
        at, expected, last = plain(one, asset, k, 15)
        assert np.allclose([r.center for r in rows], expected) and {r.step for r in rows} == {last} and last < 15
        assert [r.n for r in rows] == np.bincount(at, minlength=len(expected)).tolist()
        mine = labels[(labels.asset == asset) & (labels.k == k)].sort_values("t")
        assert mine.label.tolist() == at.tolist()
        assert np.allclose(mine.distance2, ((one[INPUTS].to_numpy() - expected[at]) ** 2).sum(1))


def test_sums_are_sent_on_before_they_grow(states, monkeypatch):
    _, df = states
    points = clustering.sensor_points(df, ["asset"], INPUTS, ["t"])
    want = sorted(map(str, clustering.fit_grouped_kmeans(points, [4], steps=1).collect()))
    monkeypatch.setattr(clustering, "HELD_BYTES", 0)
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 7)
    again = clustering.fit_grouped_kmeans(points, [4], steps=1).collect()
    assert len(want) == len(again) and sorted(r.n for r in again) == sorted(int(w.split("n=")[1].split(",")[0]) for w in want)


def test_labels_are_the_same_every_time_and_find_the_states(states):
    pdf, df = states
    first, second = (clustering.kmeans_labels(d, INPUTS, ["asset", "t"], k=3).toPandas() for d in (df, df.repartition(2)))
    sort = lambda f: f.sort_values(["asset", "t"]).reset_index(drop=True)
    assert sort(first).equals(sort(second)) and len(first) == len(pdf)
    for _, one in first[first.asset < "A003"].groupby("asset"):
        assert one.groupby(one.t % 3).label.nunique().eq(1).all() and one.label.nunique() == 3
    assert clustering.kmeans_labels(df.where("t < 0"), INPUTS, ["asset", "t"]).count() == 0


def test_silhouettes_equal_all_pairs(states):
    pdf, df = states
    sweep = clustering.silhouette_sweep(df, INPUTS, ["t"], range(2, 7)).collect()
    assert len(sweep) == 4 * 5
    for r in sweep:
        one = pdf[pdf.asset == r.asset].sort_values("t")
        at, _, _ = plain(one, r.asset, r.k, 20)
        x = one[INPUTS].to_numpy()
        pairs = ((x[:, None] - x[None]) ** 2).sum(2)
        if len(set(at)) < 2:
            assert r.silhouette is None
            continue
        scores = []
        for i in range(len(x)):
            inner = pairs[i, (at == at[i]) & (np.arange(len(x)) != i)]
            outer = min(pairs[i, at == c].mean() for c in set(at) - {at[i]})
            larger = max(inner.mean(), outer) if len(inner) else 0
            scores.append((outer - inner.mean()) / larger if larger else 0)
        assert np.isclose(r.silhouette, np.mean(scores))
    best = max((r for r in sweep if r.asset == "A001"), key=lambda r: r.silhouette)
    assert best.k == 3


def test_projection_per_group(states):
    pdf, df = states
    flat = clustering.state_projection(df, ["asset"], INPUTS, ["asset", "t"]).toPandas()
    assert len(flat) == df.count()
    for asset in ("A001", "A002"):
        one = pdf[pdf.asset == asset].sort_values("t")
        x = one[INPUTS].to_numpy()
        axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
        axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
        mine = flat[(flat.asset == asset) & flat.t.isin(one.t)].sort_values("t")
        assert np.allclose(mine[["x", "y"]].to_numpy(), (x - x.mean(0)) @ axes[:, :].T[:, :2])
    # A missing input gives no score.
    assert flat[(flat.asset == "A001") & (flat.t == 90)].x.isna().all()
