"""The nearest-neighbour join by pivots: exact, in tiles, with few cells met."""

from __future__ import annotations

import numpy as np
import pytest
from helixmill.operators import joins


@pytest.mark.parametrize("block", [None, "label"])
@pytest.mark.parametrize("pivots", [None, 1, 9])
@pytest.mark.parametrize("alone", [True, False])
def test_equals_all_pairs(spark, monkeypatch, block, pivots, alone):
    monkeypatch.setattr(joins, "TILE", 10)
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(70, 4)), r.normal(size=(30, 4)) * 0.1 + 5, np.zeros((20, 4))])
    label = [None, 0, 1, 1][: 4] * 30
    df = spark.createDataFrame([(k, v.tolist(), label[k]) for k, v in enumerate(x)] + [(500, None, 1), (501, [9.0] * 4, 77)], "id long, e array<double>, label int")
    got = {r.id: r.nn_distance for r in joins.nearest(df, df, "id", "e", exclude_self=alone, block=block, pivots=pivots).collect()}
    for k in range(120):
        near = [np.linalg.norm(x[k] - x[j]) for j in range(120) if (j != k or not alone) and (not block or label[j] == label[k])] + ([] if block else [np.linalg.norm(x[k] - 9.0)])
        assert got[k] == pytest.approx(min(near), abs=1e-12)
    assert 500 not in got and (501 in got) == (not (block and alone))


def test_few_cells_are_met(spark, monkeypatch):
    """Of clustered points, a query meets few of the other cells."""
    r = np.random.default_rng(8)
    middle = r.normal(size=(40, 8)) * 10
    x = middle[r.integers(0, 40, 3000)] + r.normal(size=(3000, 8)) * 0.3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, e array<double>")
    met = []
    monkeypatch.setattr(joins, "kept", lambda df, name, keep=joins.kept: met.append((name, keep(df, name))) or met[-1][1])
    got = {r.id: r.nn_distance for r in joins.nearest(df, df, "id", "e", exclude_self=True, pivots=64).collect()}
    d = joins.apart(x, x) + np.diag(np.full(len(x), np.inf))
    assert all(got[k] == pytest.approx(d[k].min(), abs=1e-6) for k in range(len(x)))
    assert dict(met)["met"].count() <= 0.2 * 63 * len(x)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id long, e array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, e array<double>")
    assert joins.nearest(none, some, "id", "e").count() == joins.nearest(some, none, "id", "e").count() == joins.nearest(some, some, "id", "e", exclude_self=True).count() == 0
    assert joins.nearest(none, some, "id", "e", pivots=5).count() == 0
