"""Steps whose memory or rounds grew faster than their tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from helixmill.functions import statistics
from helixmill.operators import importance, joins, pareto
from helixmill.sources.tables import kept
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_deltas_in_parts(spark, monkeypatch):
    """Counts of parts aren't taken for a small table, and parts change no number."""
    df = kept(spark.range(400).select("id", (F.col("id") % 3).alias("fold"), *(F.round(F.rand(k), 6).alias(c) for k, c in enumerate("aby"))), "rows")
    run = lambda: importance.permutation_deltas(df, "id", "fold", {"a": ["a"], "ab": ["a", "b"]}, lambda c: c["a"] + 2 * c["b"], ["a", "b"], "y", 3, 7)
    told = lambda d: {(r.fold, r.group, r.permutation): (round(r.baseline, 9), round(r.delta, 9)) for r in d.collect()}
    one = run()
    whole = told(one)
    # before, counts of 4096 parts of each condition were broadcast
    assert len(whole) == 18 and not [x for x in plan(one).split("\n") if "BroadcastHashJoin" in x and "permutation" in x]
    monkeypatch.setattr(importance, "SHUFFLE_ROWS", 9)
    assert told(run()) == whole


def test_conditions_in_batches(spark, monkeypatch):
    """Shuffled rows of a few groups at a time are on disk; a batch is one packed shuffle, and all are equal to plain permutations."""
    r = np.random.default_rng(9)
    rows = [(k, k % 2, *(None if k == 7 and c == 1 else float(v) for c, v in enumerate(r.normal(size=3)))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, a double, b double")
    done = []
    monkeypatch.setattr(importance, "kept", lambda df, name, **k: done.append((name, k)) or kept(df, name, **k))
    monkeypatch.setattr(importance, "BATCH_ROWS", 600)
    monkeypatch.setattr(importance, "SHUFFLE_ROWS", 40)
    groups = {"a": ["a"], "b": ["b"], "ba": ["b", "a"]}
    got = {(q.fold, q.group, q.permutation): q.delta for q in importance.permutation_deltas(df, "id", "fold", groups, lambda c: 3 * c["a"] - c["b"], ["a", "b"], "y", 2, 5).collect()}
    assert done.count(("errors", {"clean": True})) == 3 and len(got) == 12
    for (fold, group, p), delta in got.items():
        own = [q for q in rows if q[1] == fold]
        mixed = sorted(own, key=lambda q: hashlib.md5(f"5|{group}|{p}|{q[0]}".encode()).digest())
        pick = lambda q, m: (q[2], m[3] if "a" in group else q[3], m[4] if "b" in group else q[4])
        rmse = lambda told: np.sqrt(np.mean([(y - (3 * a - b)) ** 2 for y, a, b in told if None not in (y, a, b)]))
        assert delta == pytest.approx(rmse(map(pick, own, mixed)) - rmse(map(pick, own, own)), abs=1e-12)


def test_cells_not_rows_are_met(spark, monkeypatch):
    """What is known of cells isn't copied to queries, and a point that is no number hides no other."""
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 3))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5000, [float("nan"), 0.0, 0.0])], "id long, e array<double>")
    tables = {}
    monkeypatch.setattr(joins, "kept", lambda df, name: tables.setdefault(name, kept(df, name)))
    got = {q.id: q.nn_distance for q in joins.nearest(df, df, "id", "e", exclude_self=True, pivots=20).collect()}
    d = joins.apart(x, x) + np.diag(np.full(len(x), np.inf))
    assert all(got[k] == pytest.approx(d[k].min(), abs=1e-6) for k in range(len(x))) and 5000 not in got
    assert tables["met"].count() <= 20 * 21


@pytest.mark.parametrize("held", [5, 60])
def test_groups_of_queries(spark, monkeypatch, held):
    """Cells larger than a group are parted, smaller ones share one; keys may repeat."""
    monkeypatch.setattr(joins, "TILE", held)
    monkeypatch.setattr(joins, "HELD", held)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(200, 4)), np.ones((40, 4))])
    df = spark.createDataFrame([(f"k{k // 2}", v.tolist(), k % 2) for k, v in enumerate(x)], "id string, e array<double>, side int")
    a, b = df.where("side = 0"), df.where("side = 1")
    got = {q.id: q.nn_distance for q in joins.nearest(a, df, "id", "e", exclude_self=True).collect()}
    for k in range(120):
        assert got[f"k{k}"] == pytest.approx(min(np.linalg.norm(x[2 * k] - x[j]) for j in range(240) if j // 2 != k), abs=1e-9)
    assert joins.nearest(b, a, "id", "e").count() == 120


def test_rounds_of_a_cover(spark, monkeypatch):
    """Thousands of anchors take a few rounds."""
    r = np.random.default_rng(6)
    x = r.normal(size=(1200, 4))
    df = spark.createDataFrame([(0, k, v.tolist(), float(k % 5), 0.3) for k, v in enumerate(x)], "g int, id int, v array<double>, w double, radius double")
    rounds = []
    plain = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: rounds.append(1) or plain(self, *a, **k))
    got = [a.id for a in pareto.cover(df, "g", "id", "v", "w", "radius").orderBy("anchor_rank").collect()]
    want, near = [4], np.linalg.norm(x - x[4], axis=1)
    while near.max() > 0.3:
        i = max(range(len(x)), key=lambda j: (near[j], j % 5, -j))
        want.append(i)
        near = np.minimum(near, np.linalg.norm(x - x[i], axis=1))
    assert got == want and len(got) > 500 and len(rounds) <= 6


def test_least_distance():
    r = np.random.default_rng(7)
    x, c = r.normal(size=(700, 5)) + 1e3, r.normal(size=(90, 5)) + 1e3
    x[:3] = c[:3]
    assert (pareto.least_distance(x, list(c)) == np.sqrt(((x[:, None] - c[None]) ** 2).sum(axis=2)).min(axis=1)).all()


def test_correlations_of_components(spark):
    """One sum of matrices tells all pairs, where a component is missing, too."""
    r = np.random.default_rng(8)
    x = r.normal(size=(300, 4)) + 1e4
    x[:, 1] += x[:, 0]
    x[:, 3] = 2.0
    df = spark.createDataFrame([([None if (k + c) % 7 == 0 and c < 3 else float(v) for c, v in enumerate(row)],) for k, row in enumerate(x)], "e array<double>")
    got = {(q.i, q.j): q.r for q in statistics.correlation_matrix(df, "e", 4).collect()}
    assert set(got) == {(i, j) for i in range(1, 5) for j in range(i + 1, 5)} and got[1, 4] is None
    for i, j in ((1, 2), (1, 3), (2, 3)):
        rows = [k for k in range(300) if (k + i - 1) % 7 and (k + j - 1) % 7]
        assert got[i, j] == pytest.approx(np.corrcoef(x[rows, i - 1], x[rows, j - 1])[0, 1], abs=1e-9)
