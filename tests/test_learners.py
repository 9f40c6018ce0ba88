"""Learners against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from helixmill.operators import learners as L
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c"]


def table(spark, n=200, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 2, 0.5] + [0, 3, -1]
    y = 1.5 * x[:, 0] - 0.3 * x[:, 1] + np.sin(2 * x[:, 2]) + r.normal(size=n) * 0.1
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    odd = [(9001, None, 1.0, 1.0, 2.0), (9002, 1.0, float("nan"), 1.0, 2.0), (9003, 1.0, 1.0, float("inf"), 2.0), (9004, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows + odd, "id long, a double, b double, c double, y double").repartition(3), x, y


def plain_ridge(x, y, penalty):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + penalty * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(axis=0) @ w


def test_ridge_by_penalty(spark):
    df, x, y = table(spark, 60)
    model, errors = L.ridge_by_penalty(df, FEATURES, "y")
    assert len(errors) == 20 and min(errors) == pytest.approx(0.01) and max(errors) == pytest.approx(1000)
    for penalty, error in errors.items():
        left_out = []
        for i in range(len(x)):
            keep = np.arange(len(x)) != i
            w, b = plain_ridge(x[keep], y[keep], penalty)
            left_out.append((y[i] - x[i] @ w - b) ** 2)
        # of a penalised fit with a free intercept, centring anew moves the left-out error a little
        assert error == pytest.approx(np.mean(left_out), rel=0.02)
    w, b = plain_ridge(x, y, model.penalty)
    assert model.penalty == min(errors, key=errors.get) and model.weights == pytest.approx(w) and model.intercept == pytest.approx(b)
    told = {r.id: r.p for r in df.select("id", model.column().alias("p")).collect()}
    assert told[5] == pytest.approx(x[5] @ w + b) and told[9001] is None


def test_fifty_fits_from_one_pass(spark):
    df, x, y = table(spark, 120)
    rows = df.where("id < 9000").withColumn("seed", F.explode(F.array(*map(F.lit, range(10))))).withColumn("fold", (F.xxhash64("id", "seed") % 5 + 5) % 5)
    told, fits = L.repeated_folds(rows, FEATURES, "y", "seed", "fold", 2.0)
    assert len(fits) == 50
    got = told.select("id", "seed", "fold", "prediction").toPandas()
    assert len(got) == 1200
    for (s, k), own in got.groupby(["seed", "fold"]):
        inside = np.isin(np.arange(120), own["id"])
        w, b = plain_ridge(x[~inside], y[~inside], 2.0)
        assert fits[s, k].weights == pytest.approx(w)
        assert own["prediction"].to_numpy() == pytest.approx(x[own["id"]] @ w + b)


def plain_support_vectors(k: np.ndarray, y: np.ndarray, cost: float, epsilon: float) -> np.ndarray:
    """Predictions of the kernel solution, by reweighted least squares on the whole kernel matrix."""
    n = len(y)
    alpha, b = np.zeros(n), y.mean()
    for _ in range(60):
        off = y - k @ alpha - b
        out = np.abs(off) - epsilon
        a = np.where(out > 0, cost / np.maximum(out, 1e-6), 1e-9)
        t = y - np.sign(off) * epsilon
        s = np.block([[k + np.diag(1 / a), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
        z = np.linalg.solve(s, np.append(t, 0))
        alpha, b = z[:-1], z[-1]
    return k @ alpha + b


def test_support_vectors_are_near_the_kernel_solution(spark):
    df, x, y = table(spark, 150)
    model = L.support_vectors(df, FEATURES, "y", cost=2.0, epsilon=0.05, size=512)
    width = 1 / (3 * x.var())
    assert model.frequencies.std() == pytest.approx(np.sqrt(2 * width), rel=0.1)
    exact = plain_support_vectors(np.exp(-width * ((x[:, None] - x[None]) ** 2).sum(axis=2)), y, 2.0, 0.05)
    told = {r.id: r.p for r in df.select("id", model.column().alias("p")).collect()}
    mine = np.array([told[i] for i in range(150)])
    rmse = lambda p: float(np.sqrt(np.mean((p - y) ** 2)))
    assert rmse(mine) < rmse(exact) + 0.05 and np.corrcoef(mine, exact)[0, 1] > 0.99
    assert told[9002] is None


def plain_tree(x, y, tree, depth, least, seed):
    """{node: (feature, threshold) or None}, {node: mean} of one tree, by recursion."""
    splits, means = {}, {}

    def grow(node, rows, level):
        means[node] = y[rows].mean()
        if level == depth:
            return
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        u = L.uniform(seed, np.full(x.shape[1], tree), np.full(x.shape[1], node), np.arange(x.shape[1]))
        cut, best = low + u * (high - low), (1e-12 * (1 + (y[rows] ** 2).sum()), None)
        for f in range(x.shape[1]):
            left = x[rows, f] <= cut[f]
            if min(left.sum(), (~left).sum()) >= least:
                sse = lambda v: ((v - v.mean()) ** 2).sum()
                gain = sse(y[rows]) - sse(y[rows][left]) - sse(y[rows][~left])
                if gain > best[0]:
                    best = (gain, f)
        if best[1] is None:
            return
        splits[node] = (best[1], cut[best[1]])
        left = x[rows, best[1]] <= cut[best[1]]
        grow(2 * node, rows[left], level + 1)
        grow(2 * node + 1, rows[~left], level + 1)

    grow(1, np.arange(len(x)), 0)
    return splits, means


def test_extra_trees_by_brute_force(spark):
    df, x, y = table(spark, 90)
    forest = L.extra_trees(df, FEATURES, "y", trees=4, depth=4, least=3)
    told = np.zeros(len(x))
    for t in range(4):
        splits, means = plain_tree(x, y, t, 4, 3, 42)
        assert {int(n) for n in np.flatnonzero(forest.split[t] >= 0)} == set(splits)
        for node, (f, cut) in splits.items():
            assert forest.split[t, node] == f and forest.threshold[t, node] == pytest.approx(cut)
        for node, mean in means.items():
            assert forest.value[t, node] == pytest.approx(mean)
        at = np.ones(len(x), int)
        for i in range(len(x)):
            while at[i] in splits:
                f, cut = splits[at[i]]
                at[i] = 2 * at[i] + (x[i, f] > cut)
            told[i] += means[at[i]] / 4
    got = {r.id: r.p for r in df.select("id", forest.column().alias("p")).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(told.tolist()) and got[9001] is None


def test_constant_features_and_labels(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0, 3.0, 5.0) for i in range(20)], "id long, a double, b double, c double, y double")
    assert {round(r.p, 9) for r in df.select(L.extra_trees(df, FEATURES, "y", trees=2, depth=2).column().alias("p")).collect()} == {5.0}
    assert {round(r.p, 6) for r in df.select(L.support_vectors(df, FEATURES, "y", size=16).column().alias("p")).collect()} == {5.0}
    assert L.ridge_by_penalty(df, FEATURES, "y")[0].intercept == pytest.approx(5.0)
