"""The library against plain Python: hairpins, statistics, fronts, selections, folds, contracts, sources, restarts."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from helixmill.functions import sequence as Q
from helixmill.functions import statistics as T
from helixmill.functions import transforms as X
from helixmill.operators import contracts, folds, importance, joins, models, pareto, search
from helixmill.operators.hairpin import best_hairpins, hairpin
from helixmill.sources import tables
from helixmill.streaming.incremental import run_available
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as S

SCORES = {"GC": 3, "CG": 3, "AT": 2, "TA": 2, "GT": 1, "TG": 1}


def plain_hairpin(s: str) -> tuple | None:
    best = None
    for stem in range(4, 14):
        for loop in range(3, 9):
            for start in range(len(s) - 2 * stem - loop + 1):
                pairs = [SCORES.get(s[start + k] + s[start + 2 * stem + loop - 1 - k], 0) for k in range(stem)]
                share = sum(p > 0 for p in pairs) / stem
                if share < 0.75:
                    continue
                key = (sum(pairs) - 0.5 * abs(loop - 4), share, stem, -abs(loop - 4))
                if best is None or key > best[0]:
                    best = (key, start, stem, loop)
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ACGT", max_size=60), min_size=1, max_size=4))
def test_hairpin_by_brute_force(rows):
    got = best_hairpins(rows)
    for k, s in enumerate(rows):
        want = plain_hairpin(s)
        if want is None:
            assert got["stem"][k] == 0
        else:
            assert (got["twice"][k] / 2, got["start"][k], got["stem"][k], got["loop"][k]) == (want[0][0], *want[1:])


def test_hairpin_cases(spark):
    rows = spark.createDataFrame([("GGGGAAAACCCC",), ("ACGTACGTAC",), (None,), ("",)], "s string").select("s", hairpin(F.col("s")).alias("g")).collect()
    by = {r.s: r.g for r in rows}
    assert (by["GGGGAAAACCCC"].stem_length, by["GGGGAAAACCCC"].loop_length, by["GGGGAAAACCCC"].score) == (4, 4, 12.0)
    assert by["ACGTACGTAC"] is None and by[None] is None and by[""] is None


def test_sequence_functions(spark):
    s = F.col("s")
    row = spark.createDataFrame([(" acgu ", "TTTTT", "AACCGU")], "n string, t string, s string").select(Q.normalise_dna(F.col("n")).alias("n"), Q.overlapping_count(F.col("t"), "TTTT").alias("t"), Q.state_changes(s).alias("c"), Q.gc_prefix(F.lit("GCGAT")).alias("p"), Q.longest_run(s, "T").alias("r")).first()
    assert tuple(row) == ("ACGT", 2, 3, 3, 0)
    bad = spark.createDataFrame([("ACGN",), ("",), (None,)], "n string").select(Q.normalise_dna(F.col("n")).alias("n")).collect()
    assert [r.n for r in bad] == [None] * 3


def test_ranks_bins_and_adjustment(spark):
    values = [1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    percent = [r.rank for r in T.average_ranks(df, "v", percent=True).orderBy("k").collect()]
    assert percent == pytest.approx(pd.Series(values).rank(pct=True).tolist())
    assert [r.bin for r in T.quantile_bins(df, "v", 5).orderBy("k").collect()] == pd.qcut(values, 5, duplicates="drop", labels=False).tolist()
    q = T.benjamini_hochberg(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double"), "p").collect()
    assert {r.p: r.q for r in q} == pytest.approx({0.01: 0.03, 0.04: 0.04, 0.03: 0.04, None: None})


def test_correlation_p_values():
    # two-sided p of Student's t, from tables of its quantiles
    for n, t, p in ((12, 2.228139, 0.05), (22, 2.845340, 0.01), (5, 3.182446, 0.05), (1002, 1.962339, 0.05)):
        r = t / math.sqrt(n - 2 + t * t)
        assert T.correlation_p_values(np.array([r]), np.array([n]))[0] == pytest.approx(p, rel=1e-4)
    assert T.correlation_p_values(np.array([1.0, np.nan]), np.array([9, 9])).tolist()[0] == 0


def test_weighted_median(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 9.0, 5.0), ("b", 1.0, 0.0), ("b", 3.0, 0.0)], "k string, v double, w double")
    assert {r.k: r.weighted_median for r in T.weighted_median(df, "v", "w", ("k",)).collect()} == {"a": 9.0, "b": 2.0}


def test_transforms(spark):
    te = F.col("te")
    row = spark.createDataFrame([(0.9,)], "te double").select(X.te_to_strength(te).alias("s"), X.te_to_y(te).alias("y"), X.y_to_te(X.te_to_y(te)).alias("t"), X.target_label(te).alias("l"), X.label_target(X.target_label(te)).alias("b")).first()
    assert (row.s, row.y, row.t, row.l, row.b) == (pytest.approx(10), pytest.approx(1), pytest.approx(0.9), "te_0p90", 0.9)
    with pytest.raises(Exception, match="between 0 and 100"):
        spark.createDataFrame([(101.0,)], "p double").select(X.remaining_log(F.col("p"))).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=25))
def test_front_numbers(points):
    x = np.array(points, float)
    left, k, want = set(range(len(x))), 0, {}
    while left:
        free = [i for i in left if not any((x[j] <= x[i]).all() and (x[j] < x[i]).any() for j in left)]
        want |= dict.fromkeys(free, k)
        left -= set(free)
        k += 1
    assert pareto.front_numbers(x).tolist() == [want[i] for i in range(len(x))]


def test_greedy_selections(spark):
    r = random.Random(4)
    rows = [(k, k % 3, [r.random() for _ in range(3)], r.random()) for k in range(120)]
    df = spark.createDataFrame(rows, "k long, b int, v array<double>, o double").withColumn("radius", F.lit(0.5))
    by = {k: np.array(v) for k, _, v, _ in rows}
    picked = pareto.diverse(df, "b", "k", "v", ["o", "k"], 0.4, 10).orderBy("b", "pick").collect()
    for b in range(3):
        want: list[int] = []
        for k, _, _, _ in sorted((x for x in rows if x[1] == b), key=lambda x: (x[3], x[0])):
            if len(want) < 10 and all(np.linalg.norm(by[k] - by[j]) >= 0.4 for j in want):
                want.append(k)
        assert [x.k for x in picked if x.b == b] == want
    anchors = pareto.cover(df, "b", "k", "v", "o", "radius").collect()
    for k, b, v, _ in rows:
        assert min(np.linalg.norm(np.array(v) - by[a.k]) for a in anchors if a.b == b) <= 0.5


def test_folds_permutations_allocation(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 4).withColumn("x", F.col("id") * 2)
    dealt = folds.stratified_folds(df, "s", "id", [1, 2]).collect()
    for seed in (1, 2):
        for s in range(4):
            assert sorted(sum(r.fold == f for r in dealt if (r.seed, r.s) == (seed, s)) for f in range(5)) == [5] * 5
    mixed = folds.permuted(df, "id", ["x"], ["s"], [7]).collect()
    assert all(sorted(r.x for r in mixed if r.s == s) == sorted(r.x_permuted for r in mixed if r.s == s) for s in range(4))
    assert any(r.x != r.x_permuted for r in mixed)
    given_out = folds.largest_remainder(spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "k int, w double").withColumn("g", F.lit(1)), "w", 10, ["g"], "k").collect()
    assert sorted(r.allocated for r in given_out) == [3, 3, 4]


def test_joins(spark):
    r = random.Random(1)
    a = [(k, round(r.uniform(-5, 5), 3)) for k in range(60)]
    b = [(k, round(r.uniform(-5, 5), 3)) for k in range(60)]
    got = joins.within_band(spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double"), "x", "y", 0.3).collect()
    assert {(x.i, x.j) for x in got} == {(i, j) for i, x in a for j, y in b if abs(x - y) <= 0.3}
    first = joins.union_first([spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")], ["k"], ["v"]).collect()
    assert {(x.k, x.v, x.source_rank) for x in first} == {(1, "a", 0), (2, "c", 1)}


def test_contracts(spark):
    df = spark.createDataFrame([("ACGTAC", "ACG", 6, 3), ("TCGTAN", "ACG", 7, 4)], "sequence string, prompt string, target_length int, n_tokens int")
    rows = contracts.check_samples(df).collect()
    assert rows[0].qc_reason == "PASS" and rows[1].qc_reason == "invalid_sequence_dna;prompt_prefix_mismatch;invalid_continuation_dna;target_length_mismatch;continuation_length_mismatch"
    with pytest.raises(contracts.ContractError):
        contracts.require_columns(df, ["nope"])
    assert contracts.resolve_column(df, ["Target Length"]) == "target_length"
    assert contracts.resolve_column(df, ["x"], [{"tokens"}]) == "n_tokens"


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text("id,sequence,efficiency\nx,ACGU,90\ny,ACGN,1\nz,acgt,n/a\nw, acgt ,5\n")
    raw = tables.read_csv(spark, str(tmp_path / "a" / "one.csv"), tables.RAW)
    assert {(r.id, r.sequence, r.efficiency) for r in tables.clean_sequences(raw, "id").collect()} == {("x", "ACGT", 90.0), ("w", "ACGT", 5.0)}
    assert tables.read_folders(spark, str(tmp_path), tables.RAW).select("source_folder").distinct().first()[0] == "a"
    assert tables.optional(spark, str(tmp_path / "none"), tables.RAW).count() == 0
    assert tables.best_source(spark, [str(tmp_path / "a" / "one.csv")], ["sequence"], ["one"])
    with pytest.raises(contracts.ContractError):
        tables.require_files(spark, [str(tmp_path / "none")])
    tables.write_manifest(spark, str(tmp_path / "m"), {"a": float("nan"), "b": [1, float("inf")]})
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"a": null, "b": [1, null]}'
    rows = spark.range(10)
    assert tables.append_new(rows.where("id < 4"), str(tmp_path / "t"), ["id"]) == 4
    assert tables.append_new(rows, str(tmp_path / "t"), ["id"]) == 6
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_restart_takes_only_what_is_new(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(5).write.parquet(source)
    run_available(spark, source, target, state, ["id"], lambda b: b)
    spark.range(3, 9).write.mode("append").parquet(source)
    run_available(spark, source, target, state, ["id"], lambda b: b)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(9))


def test_power_transform_makes_data_even(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(math.exp(r.gauss(0, 0.7)),) for _ in range(400)], "x double")
    power = models.fit_powers(df, ["x"])["x"]
    assert power < 0.5
    assert abs(models.powered(df, {"x": power}).agg(F.skewness("x")).first()[0]) < 0.4


def test_stack_sees_no_held_out_row(spark):
    r = random.Random(8)
    rows = [(k, x := r.uniform(0, 4), r.random(), math.sin(x) * 3 + r.gauss(0, 0.1), k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double, fold int")
    stack = lambda: models.Stack(["a", "b"], "y", "k", inner=2, trees=10, depth=3, boosts=3, size=32, rounds=4)
    told = models.out_of_fold(df, "fold", 2, stack)
    error = told.agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2))))).first()[0]
    assert error < 0.8 and told.count() == 200
    half = stack().fit(df.where("fold = 1"))
    again = {x.k: x.prediction for x in half.predict(df.where("fold = 0").withColumn("y", F.lit(0.0))).collect()}
    assert again == {x.k: x.prediction for x in half.predict(df.where("fold = 0")).collect()}


def test_evolution_improves_and_repeats(spark):
    r = random.Random(6)
    score = lambda names: np.array([s.count("G") / len(s) for s in names])
    zero = lambda names: np.zeros(len(names))
    starts = spark.createDataFrame([(0.9, 1, "".join(r.choice("ACGT") for _ in range(20))) for _ in range(20)], "target double, seed int, sequence string")
    run = lambda: sorted(map(tuple, search.evolve(starts, score, zero, generations=15, population=20, children=30).collect()))
    got = run()
    assert got == run() and len(got) == 20
    assert min(x[4] for x in got) < min(abs(0.9 - s) for s in score([x.sequence for x in starts.collect()]))


def test_importance_finds_the_feature(spark):
    r = random.Random(5)
    df = spark.createDataFrame([(k, k % 2, a := r.random(), r.random(), a) for k in range(200)], "k long, fold int, a double, b double, y double")
    deltas = importance.permutation_deltas(df, "k", "fold", {"a": ["a"], "b": ["b"], "both": ["a", "b"]}, lambda c: c["a"], ["a", "b"], "y", 2, 1)
    got = {x.group: x.mean for x in importance.importance(deltas, "fold").collect()}
    assert got["a"] > 0.2 and got["both"] > 0.2 and abs(got["b"]) < 1e-9
    rules = spark.createDataFrame([("a", "higher", 1.0, float("inf"))], "feature string, direction string, low double, high double")
    assert importance.rules_json(rules).first()[0] == '{"a":{"direction":"higher","range":[1.0,null]}}'


def test_guarded_metrics(spark):
    row = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, p double").agg(*T.regression_metrics("a", "p")).first()
    assert row.r2 is None and row.pearson_r is None and row.mae == 1.5
    assert S.StructType().fields == []
