"""Fronts and selections of blocks of any size, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from helixmill.operators import pareto
from pyspark.sql import functions as F


def plain_fronts(x: np.ndarray) -> list[int]:
    left, out, k = set(range(len(x))), [0] * len(x), 0
    while left:
        best = {i for i in left if not any((x[j] <= x[i]).all() and (x[j] < x[i]).any() for j in left)}
        for i in best:
            out[i] = k
        left, k = left - best, k + 1
    return out


@pytest.mark.parametrize(("objectives", "step"), [(2, 10), (2, 1000), (3, 12), (4, 25)])
def test_fronts_in_ranges(spark, objectives, step):
    r = np.random.default_rng(objectives * step)
    rows = [(i, [None, "a", "b"][i % 3] if i < 130 else "c", *(float(v) for v in r.integers(0, 9, objectives))) for i in range(150)]
    names = [f"o{k}" for k in range(objectives)]
    df = spark.createDataFrame([*rows, (900, "a", None, *([1.0] * (objectives - 1))), (901, "a", float("nan"), *([1.0] * (objectives - 1)))], f"id long, g string, {', '.join(f'{n} double' for n in names)}")
    got = {x.id: x.front for x in pareto.fronts(df, "g", names, "front", step).collect()}
    assert got.pop(900) is None and got.pop(901) is None
    for g in (None, "a", "b", "c"):
        own = [x for x in rows if x[1] == g]
        assert [got[x[0]] for x in own] == plain_fronts(np.array([x[2:] for x in own]))


def test_fronts_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, g string, a double, b double")
    assert pareto.fronts(df, "g", ["a", "b"]).columns == ["id", "g", "a", "b", "pareto_rank"] and pareto.fronts(df, "g", ["a", "b"]).count() == 0


def test_fronts_of_one_large_block(spark):
    """200,000 rows of one block: each row of a later front is beaten by one of the front before, and fronts beat no own row."""
    df = spark.range(200_000).select("id", F.lit("one").alias("g"), (F.xxhash64("id") % 100_000).cast("double").alias("a"), (F.xxhash64("id", F.lit(1)) % 100_000).cast("double").alias("b"))
    rows = pareto.fronts(df, "g", ["a", "b"]).select("a", "b", "pareto_rank").toPandas().sort_values(["a", "b"])
    assert len(rows) == 200_000
    fronts = {k: x[["a", "b"]].to_numpy() for k, x in rows.groupby("pareto_rank")}
    assert sorted(fronts) == list(range(len(fronts)))
    for k, x in fronts.items():
        u = np.unique(x, axis=0)
        assert (np.diff(u[:, 1]) < 0).all()  # a front falls
        if k:
            before = fronts[k - 1]
            least = np.minimum.accumulate(before[:, 1])
            at = np.searchsorted(before[:, 0], u[:, 0], side="right") - 1
            assert (at >= 0).all() and (least[at] <= u[:, 1]).all()


def plain_choice(rows, least, most):
    kept = []
    for i, v, o in sorted(rows, key=lambda r: (r[2], r[0])):
        if len(kept) < most and all(np.linalg.norm(np.array(v) - np.array(u)) >= least for _, u in kept):
            kept.append((i, v))
    return [i for i, _ in kept]


@pytest.mark.parametrize(("least", "most"), [(0.5, 40), (0.05, 200), (3.0, 5)])
def test_diverse_choice(spark, monkeypatch, least, most):
    monkeypatch.setattr(pareto, "AHEAD", 7)
    r = np.random.default_rng(5)
    rows = [(i, [None, "a", "b"][i % 3], r.normal(size=2).tolist(), float(r.integers(0, 30))) for i in range(150)]
    df = spark.createDataFrame([*rows, (999, "a", None, 0.0)], "id long, g string, v array<double>, o double").repartition(3)
    got = pareto.diverse(df, "g", "id", "v", ["o"], least, most).collect()
    for g in (None, "a", "b"):
        assert [x.id for x in sorted((x for x in got if x.g == g), key=lambda x: x.pick)] == plain_choice([(i, v, o) for i, b, v, o in rows if b == g], least, most)


def test_cover(spark, monkeypatch):
    monkeypatch.setattr(pareto, "REFRESH", 3)
    r = np.random.default_rng(6)
    rows = [(i, [None, "a", "b"][i % 3], r.normal(size=2).tolist(), float(r.integers(0, 9)), 0.6 + (i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>, w double, radius double").repartition(3)
    got = pareto.cover(df, "g", "id", "v", "w", "radius").collect()
    for g in (None, "a", "b"):
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[3], x[0]))
        x, chosen = np.array([y[2] for y in own]), [0]
        near = np.linalg.norm(x - x[0], axis=1)
        while near.max() > own[0][4]:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
        assert [y.id for y in sorted((y for y in got if y.g == g), key=lambda y: y.anchor_rank)] == [own[i][0] for i in chosen]


def test_selections_of_empty_tables_and_large_blocks(spark):
    none = spark.createDataFrame([], "id long, g string, v array<double>, w double, radius double")
    assert pareto.cover(none, "g", "id", "v", "w", "radius").count() == pareto.diverse(none, "g", "id", "v", ["w"], 1.0, 3).count() == 0
    many = spark.range(200_000).select("id", F.lit("one").alias("g"), F.array((F.col("id") % 1000) / 1000.0, (F.xxhash64("id") % 1000) / 1000.0).alias("v"), F.lit(1.0).alias("w"), F.lit(1.0).alias("radius"))
    assert pareto.cover(many, "g", "id", "v", "w", "radius").first().id == 0
    assert [x.pick for x in pareto.diverse(many, "g", "id", "v", ["w"], 0.4, 4).collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_concordance_by_all_pairs(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, None if i % 17 == 5 else float(r.integers(0, 40)), None if i % 13 == 4 else float(r.integers(0, 25))) for i in range(n)]
    from helixmill.operators import joins

    got = joins.concordance(spark.createDataFrame(rows, "k long, a double, b double"), "k", "a", "b").first()
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[1] is not None and y[1] is not None and x[1] != y[1]]
    told = [np.sign(x[1] - y[1]) == np.sign(x[2] - y[2]) for x, y in pairs if x[2] is not None and y[2] is not None]
    assert got.n_pairs == len(pairs) and got.concordance == (pytest.approx(np.mean(told)) if told else None)


def test_concordance_of_a_large_table(spark):
    from helixmill.operators import joins

    df = spark.range(60_000).select("id", (F.col("id") * 7919 % 60_000).cast("double").alias("a"), (-F.col("id") * 7919 % 60_000).cast("double").alias("b"))
    assert joins.concordance(df, "id", "a", "a").first() == (1.0, 60_000 * 59_999 // 2)


def test_final_selection(spark):
    r = np.random.default_rng(11)
    rows = [(f"t{i % 3}", f"s{int(r.integers(0, 90))}", float(r.integers(0, 20)), float(r.integers(0, 20)), bool(r.random() < 0.7)) for i in range(240)] + [("none", "s1", 1.0, 1.0, True), ("bad", "q", 1.0, 1.0, False)]
    known = {f"s{k}" for k in range(0, 90, 5)} | {"s1"}
    schema = "t string, s string, a double, b double, ok boolean"
    table = lambda x: spark.createDataFrame(x, schema).withColumn("v", F.array("a", "b"))
    final, summary = pareto.final_selection([table(rows[:100]), table(rows[100:])], spark.createDataFrame([(k,) for k in known], "s string"), "t", "s", ["a", "b"], "v", "ok", 2.0, 4)
    told = {x.t: x for x in summary.collect()}
    assert set(told) == {"t0", "t1", "t2", "none", "bad"} and told["none"].status == told["bad"].status == "no_supported_novel_candidate" and told["none"].exact_training_removed == 1
    for t in ("t0", "t1", "t2"):
        pool: dict = {}
        for part in (rows[:100], rows[100:]):
            for x in sorted(x for x in part if x[0] == t):
                pool.setdefault(x[1], min((y for y in part if y[:2] == x[:2]), key=lambda y: y[2:4]) if x[1] not in pool else None)
        novel = [x for x in pool.values() if x[4] and x[1] not in known]
        ranks = plain_fronts(np.array([x[2:4] for x in novel]))
        front = [x for x, k in zip(novel, ranks, strict=True) if k == 0]
        crowd = {x[1]: 0.0 for x in front}
        for o in (2, 3):
            own = sorted(front, key=lambda x: (x[o], x[1]))
            span = own[-1][o] - own[0][o]
            for i, x in enumerate(own):
                crowd[x[1]] += float("inf") if len(own) <= 2 or i in (0, len(own) - 1) else (own[i + 1][o] - own[i - 1][o]) / span if span else 0.0
        picks = plain_choice([(x[1], x[2:4], (-crowd[x[1]], x[2])) for x in front], 2.0, 4)
        mine = sorted((x for x in final.collect() if x.t == t), key=lambda x: x.final_report_rank)
        assert {x.s for x in mine} == set(picks) and [(x.a, x.b, x.s) for x in mine] == sorted((x.a, x.b, x.s) for x in mine)
        assert (told[t].supported_novel_pool_n, told[t].pareto_front_n, told[t].n_final, told[t].best_sequence) == (len(novel), len(front), len(picks), mine[0].s)
        assert told[t].exact_training_removed == sum(x[4] and x[1] in known for x in pool.values())
