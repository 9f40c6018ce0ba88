"""Ranks, shares and nearest rows without a window that holds a group; files and checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helixmill.functions import statistics as T
from helixmill.operators import contracts, folds, joins
from helixmill.sources import tables
from pyspark.sql import functions as F


def test_ranges_of_a_key_with_close_values(spark):
    """A key whose values lie within a thousandth of the others' range is dealt out all the same, and totals stay right."""
    rows = [("wide", float(i * 1000), 1) for i in range(3000)] + [("close", 5.0 + i / 1e6, 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    dealt = T.key_ranges(df, "v", ("g",))
    sizes = {(r.g, r._range): r["count"] for r in dealt.groupBy("g", "_range").count().collect()}
    assert max(sizes.values()) < 200
    got = {(r.g, r.v): r.upto for r in T.running_total(df, "v", "n", "upto", ("g",)).collect()}
    assert all(got["wide", i * 1000.0] == i + 1 and got["close", 5.0 + i / 1e6] == 2 * (i + 1) for i in range(3000))


def test_scales(spark):
    r = np.random.default_rng(2)
    x = {"a": r.normal(size=101), "b": np.ones(7), "c": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in x.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r.g: r for r in T.scales(df, "v", ("g",)).collect()}
    low, high = np.percentile(x["a"], [25, 75])
    assert got["a"].scale == pytest.approx(high - low) and got["a"].bandwidth == pytest.approx(0.9 * min(x["a"].std(ddof=1), (high - low) / 1.349) * 101**-0.2)
    assert (got["b"].scale, got["b"].bandwidth, got["c"].scale, got["c"].bandwidth) == (1.0, None, 1.0, None)
    assert T.scales(df.where("g = 'a'"), "v").first().scale == pytest.approx(high - low)


def test_weighted_median_without_weight(spark):
    df = spark.createDataFrame([("a", float(i), 0.0) for i in range(4)] + [("b", 1.0, 1.0), ("b", 9.0, 3.0), ("b", 4.0, 0.0)], "g string, v double, w double")
    assert {r.g: r.weighted_median for r in T.weighted_median(df, "v", "w", ("g",)).collect()} == {"a": 1.5, "b": 9.0}


def test_largest_remainders(spark):
    rows = [(g, k, float(w)) for g in ("a", None) for k, w in enumerate(np.random.default_rng(3).integers(0, 50, 60))] + [("zero", k, 0.0) for k in range(3)]
    df = spark.createDataFrame(rows, "g string, k int, w double")
    got = folds.largest_remainder(df, "w", 100, ["g"], "k").toPandas()
    for g in ("a", None, "zero"):
        own = got[got.g.isna() if g is None else got.g == g].sort_values("k")
        e = 100 * own.w / own.w.sum() if own.w.sum() else pd.Series([100 / len(own)] * len(own), index=own.index)
        want = np.floor(e)
        for k in sorted(own.index, key=lambda i: (-round(e[i] - np.floor(e[i]), 9), own.k[i]))[: int(100 - want.sum())]:
            want[k] += 1
        assert own.allocated.tolist() == want.astype(int).tolist()
    assert folds.largest_remainder(df.where("g = 'a'"), "w", 7, [], "k").agg(F.sum("allocated")).first()[0] == 7


def test_nearest_rows_of_short_grid_values(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(v)) for i, v in enumerate(r.integers(0, 40, 200))] + [(900, None)]
    grid = spark.createDataFrame([(-5.0,), (3.0,), (20.0,), (100.0,)], "t double")
    got = joins.band_or_nearest(spark.createDataFrame(rows, "k long, v double").repartition(4), grid, "v", "t", 0.4, 6, "k").collect()
    for t in (-5.0, 3.0, 20.0, 100.0):
        own = [x for x in rows if x[1] is not None]
        band = {k for k, v in own if abs(v - t) <= 0.4}
        want = band if len(band) >= 6 else {k for k, _ in sorted(own, key=lambda x: (abs(x[1] - t), x[0]))[:6]}
        assert {x.k for x in got if x.t == t} == want and {x.fallback for x in got if x.t == t} == {len(band) < 6}


def test_files_of_one_name(spark):
    files = spark.createDataFrame([(f"/r/{i:03}/a.csv", 1) for i in range(150)] + [("/r/x/ba.csv", 1), ("/r/y/b.csv", 1)], "path string, length long")
    first, more = tables.resolve_file(files, "a.csv")
    assert first == "/r/000/a.csv" and more.count() == 149
    assert tables.resolve_file(files, "b.csv")[1].count() == 0 and tables.resolve_file(files, "c.csv")[0] is None


def test_require_none_and_usable_bins(spark):
    contracts.require_none(spark.createDataFrame([], "a int"), "rows")
    with pytest.raises(contracts.ContractError, match="rows"):
        contracts.require_none(spark.createDataFrame([(1,)], "a int"), "rows")
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "k int, v double")
    assert T.usable_bins(df, "v").select("bin").distinct().count() == 5
    assert T.usable_bins(df, "v", splits=11).where("bin is not null").count() == 0
    assert T.usable_bins(df.withColumn("v", F.lit(1.0)), "v").where("bin is not null").count() == 0
