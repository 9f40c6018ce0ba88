"""Centroid clustering against plain integer k-means and SQL."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from helixmill.llm import ball_tree
from helixmill.llm.queries import ORACLES, QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st

from ..conftest import SF_DIR, assert_same

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, _id string"


def plain(rows: list[tuple[int | None, list[int]]], k: int, rounds: int) -> tuple[list[tuple], int]:
    order = sorted(range(len(rows)), key=lambda j: (hashlib.sha256(f"2:{'' if rows[j][0] is None else rows[j][0]}".encode()).hexdigest(), rows[j][1]))
    c = [list(rows[j][1]) for j in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, z, strict=True)), j) for j, z in enumerate(c))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in rows]
        for j in set(of):
            own = [v for (_, v), o in zip(rows, of, strict=True) if o == j]
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    told = [(i, near(v)[1], near(v)[0]) for i, v in rows]
    total = sum(d for *_, d in told)
    return [(i, j, d, sum(e for _, q, e in told if q == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in told], total


def test_op11_equals_sql(spark, duck):
    assert_same(QUERIES["op11_ball_tree"](spark, SF_DIR), duck, ORACLES["op11_ball_tree"])


def vectors() -> list[tuple]:
    r = np.random.default_rng(4)
    own = [(i, (r.normal(size=3) * 0.2 + (i % 5)).astype("f4").tolist(), 1, "mine", "mine") for i in range(300)]
    own += [(1000 + i, [0.5, 0.25, -3.0], None, None, None) for i in range(150)]  # copies
    own += [(1000, [0.5, 0.25, -3.0], 1, "x", "x"), (None, [1.0, 2.0, 3.0], 1, None, None), (None, [1.0, 2.0, 2.0], 1, None, None)]
    return own + [(2000, None, 1, None, None), (2001, [1.0, 2.0], 1, None, None), (2002, [1.0, None, 2.0], 1, None, None), (2003, [1.0, float("nan"), 2.0], 1, None, None), (2004, [1.0, float("-inf"), 2.0], 1, None, None), (2005, [], 1, None, None)]


@pytest.mark.parametrize("k", [1, 7, 600])
def test_odd_rows_equal_plain_means(spark, k):
    rows = vectors()
    got = ball_tree.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding", dims=3, k=k, rounds=3, tree=64, leaf=8).collect()
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, *_ in rows if v and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(map(tuple, got), key=repr) == sorted(plain(good, k, 3)[0], key=repr)


def test_empty_table_and_large_components(spark):
    got = ball_tree.cluster(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", dims=3, k=4, rounds=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not got.count()
    big = [(1, [500000.0, 0.0, 0.0]), (2, [-500000.0, 0.0, 1.0]), (3, [-499999.0, 0.0, 1.0])]
    rows = ball_tree.cluster(spark.createDataFrame(big, "vec_id long, embedding array<float>"), "vec_id", "embedding", dims=3, k=2, rounds=2).collect()
    assert sorted(map(tuple, rows)) == sorted(plain([(i, [int(256 * x) for x in v]) for i, v in big], 2, 2)[0])
    with pytest.raises(Exception, match="or more"):
        ball_tree.cluster(spark.createDataFrame([(1, [1e9, 0.0, 0.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding", dims=3, k=2, rounds=2).collect()


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 60), st.integers(1, 9), st.integers(1, 3), st.integers(0, 10**6))
def test_balls_assign_as_all_pairs_do(n, k, spread, seed):
    r = np.random.default_rng(seed)
    x = r.integers(-(4**spread), 4**spread, (n, 4)) + r.integers(0, 3, (n, 1)) * 40
    c = r.integers(-(4**spread), 4**spread, (k, 4)) + r.integers(0, 3, (k, 1)) * 40
    order, tree = ball_tree.build(x, 4)
    rows = x[order]
    assert sorted(order.tolist()) == list(range(n))
    d = ((rows[:, None] - c[None]) ** 2).sum(axis=2)
    near, away = ball_tree.nearest(rows, tree, c)
    assert near.tolist() == d.argmin(axis=1).tolist() and away.tolist() == d.min(axis=1).tolist()
    count, total = ball_tree.moved(rows, tree, c)
    assert count.tolist() == np.bincount(near, minlength=k).tolist()
    assert all((total[j] == rows[near == j].sum(axis=0)).all() for j in range(k))


def test_far_balls_are_assigned_whole():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 9, (500, 8)), r.integers(1000, 1009, (500, 8))])
    order, tree = ball_tree.build(x)
    whole, leaves = ball_tree.filtered(x[order], tree, np.array([[4] * 8, [1004] * 8]))
    assert len(whole) == 2 and not leaves
