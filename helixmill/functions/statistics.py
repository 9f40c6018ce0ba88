"""Ranks, quantile bins, adjusted p-values and weighted quantiles as DataFrame operations.

Whole-table orders never use one window over all rows: values are counted first, dealt into ranges of values by
approximate quantiles, and only the ranges' few totals are put in one order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of values at least; a session with more shuffle partitions has as many ranges.
RANGES = 64


def value_ranges(df: DataFrame, column: str, name: str = "_range", ranges: int | None = None) -> DataFrame:
    """Adds the range (0, 1, ...) of a numeric column; equal values share one, and higher values have higher ranges."""
    ranges = ranges or max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.approxQuantile(column, [k / ranges for k in range(1, ranges)], 0.25 / ranges)))
    splits = [-math.inf, *cuts, math.inf]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def key_ranges(df: DataFrame, column: str, keys: tuple[str, ...], name: str = "_range", ranges: int = RANGES) -> DataFrame:
    """Adds the range (0, 1, ...) of a numeric column among its own key's values; rows with a null key go.

    Cuts are approximate quantiles of each key, so a key whose values lie close together is dealt out as well as any other."""
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(column, F.array(*(F.lit(k / ranges) for k in range(1, ranges))), F.lit(16 * ranges))).alias("_cuts"))
    return df.join(cuts, list(keys)).withColumn(name, F.size(F.filter("_cuts", lambda c: c <= F.col(column)))).drop("_cuts")


def running_total(df: DataFrame, order: str, amount: str, name: str, keys: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``amount`` over all rows of the keys with a smaller or equal ``order`` (unique within keys)."""
    dealt = key_ranges(df, order, keys) if keys else value_ranges(df, order, ranges=ranges)
    by = [*keys, "_range"]
    totals = dealt.groupBy(*by).agg(F.sum(amount).alias("_sum"))
    before = totals.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    within = F.sum(amount).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    own = dealt.withColumn("_within", within).join(before, by)
    return own.withColumn(name, F.col("_within") + F.coalesce("_before", F.lit(0))).drop("_range", "_within", "_before")


def average_ranks(df: DataFrame, column: str, name: str = "rank", keys: tuple[str, ...] = (), percent: bool = False) -> DataFrame:
    """Adds the rank of a column with ties at their mean (or that over the count); nulls have none and don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, column, "_n", "_upto", keys)
    rank = F.col("_upto") - (F.col("_n") - 1) / 2.0
    if percent:
        size = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
        ranked = ranked.join(size, list(keys)) if keys else ranked.crossJoin(F.broadcast(size))
        rank = rank / F.col("_all")
    return df.join(ranked.select(*keys, column, rank.alias(name)), [*keys, column], "left")


def benjamini_hochberg(df: DataFrame, p: str, name: str = "q") -> DataFrame:
    """Adds adjusted p-values; nulls stay null and don't count. Equal p-values share the rank of the last of them."""
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.sum("_n").alias("_all"))
    raw = running_total(counts, p, "_n", "_upto").crossJoin(F.broadcast(size)).withColumn("_raw", F.col(p) * F.col("_all") / F.col("_upto"))
    dealt = value_ranges(raw, p)
    after = dealt.groupBy("_range").agg(F.min("_raw").alias("_least")).withColumn("_after", F.min("_least").over(Window.orderBy("_range").rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    within = F.min("_raw").over(Window.partitionBy("_range").orderBy(p).rowsBetween(0, Window.unboundedFollowing))
    done = dealt.withColumn("_within", within).join(after, "_range").select(p, F.least("_within", F.coalesce("_after", F.lit(math.inf)), F.lit(1.0)).alias(name))
    return df.join(done, p, "left")


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin of a value among distinct sorted edges; the first edge belongs to bin 0."""
    return F.when(value.isNotNull(), F.greatest(F.size(F.filter(edges, lambda e: e < value)) - 1, F.lit(0)))


def quantiles(df: DataFrame, column: str, probabilities: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: exact interpolated quantiles by name, without nulls. Values are counted, so no task holds all of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    run = running_total(counts, column, "_n", "_upto", keys)
    both = run.join(size, list(keys)) if keys else run.crossJoin(F.broadcast(size))
    at = {name: F.lit(p) * (F.col("_all") - 1) for name, p in probabilities.items()}
    first = lambda place: F.min(F.when(F.col("_upto") > place, F.col(column)))
    ends = both.groupBy(*keys).agg(F.max("_all").alias("_all"), *(first(f(x)).alias(f"{name}{end}") for name, x in at.items() for end, f in (("_low", F.floor), ("_high", F.ceil))))
    return ends.select(*keys, *((F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (x - F.floor(x))).alias(n) for n, x in at.items()))


def quantile_bins(df: DataFrame, column: str, q: int, name: str = "bin") -> DataFrame:
    """Adds quantile bins, with equal edges dropped."""
    names = [f"_q{k}" for k in range(q + 1)]
    edges = quantiles(df, column, {n: k / q for k, n in enumerate(names)}).select(F.array_distinct(F.array(*names)).alias("_edges"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, bin_of(F.col(column), F.col("_edges"))).drop("_edges")


def equal_bins(value: Column, bins: int) -> Column:
    """Right-closed bins of equal width over 0..1."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: i * F.lit(1.0 / bins))
    return bin_of(value, edges)


def usable_bins(df: DataFrame, column: str, q: int = 5, splits: int = 5) -> DataFrame:
    """Quantile bins for stratified folds, or null bins where there are fewer than two or one is smaller than the splits."""
    dealt = quantile_bins(df, column, q)
    sizes = dealt.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).agg((F.count(F.lit(1)) >= 2).alias("_many"), (F.min("n") >= splits).alias("_large"))
    return dealt.crossJoin(F.broadcast(sizes)).withColumn("bin", F.when(F.col("_many") & F.col("_large"), F.col("bin"))).drop("_many", "_large")


def weighted_median(df: DataFrame, value: str, weight: str, keys: tuple[str, ...], name: str = "weighted_median") -> DataFrame:
    """One row per key: the lowest value at which the running weight reaches half; the plain median where weights sum to 0."""
    good = df.where(F.col(value).isNotNull() & (F.col(weight) >= 0))
    summed = good.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    running = running_total(summed, value, "_w", "_upto", keys)
    total = good.groupBy(*keys).agg(F.sum(weight).alias("_all"))
    middle = quantiles(good.join(total.where("_all <= 0").select(*keys), list(keys), "left_semi"), value, {"_median": 0.5}, keys)
    total = total.join(middle, list(keys), "left")
    reached = running.join(total.select(*keys, "_all"), list(keys)).where((F.col("_upto") >= 0.5 * F.col("_all")) & (F.col("_all") > 0)).groupBy(*keys).agg(F.min(value).alias("_low"))
    return total.join(reached, list(keys), "left").select(*keys, F.when(F.col("_all") > 0, F.col("_low")).otherwise(F.col("_median")).alias(name))


def weighted_mad(df: DataFrame, value: str, weight: str, keys: tuple[str, ...], name: str = "weighted_mad") -> DataFrame:
    """One row per key: the weighted median of the distances from the weighted median."""
    centre = weighted_median(df, value, weight, keys, "_centre")
    away = df.join(centre, list(keys)).withColumn("_away", F.abs(F.col(value) - F.col("_centre")))
    return weighted_median(away, "_away", weight, keys, name)


def scales(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per key (or for all rows): ``scale`` and ``bandwidth`` of a column, from quantiles by counts.

    The scale is the IQR, else the population SD, else 1. The bandwidth is 0.9 times the smaller positive one of the sample's SD and
    the IQR / 1.349, times n to the power -1/5; null where neither is positive."""
    quarters = quantiles(df, column, {"_low": 0.25, "_high": 0.75}, keys)
    spread = df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.stddev_samp(column).alias("_sd"), F.stddev_pop(column).alias("_pop"), F.count(F.lit(1)).alias("_n"))
    both = spread.join(quarters, list(keys)) if keys else spread.crossJoin(F.broadcast(quarters))
    positive = lambda x: F.when(x > 0, x)
    iqr = F.col("_high") - F.col("_low")
    scale = F.when(iqr > 1e-12, iqr).when(F.col("_pop") > 1e-12, F.col("_pop")).otherwise(1.0)
    bandwidth = 0.9 * F.least(positive(F.col("_sd")), positive(iqr / 1.349)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    return both.select(*keys, scale.alias("scale"), bandwidth.alias("bandwidth"), F.col("_n").alias("n"))


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's correlation, null where a column is constant (``corr`` raises there in ANSI mode)."""
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.try_divide(F.covar_pop(a, b), F.when(spread > 0, spread))


def correlation_matrix(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(i, j, r) for i < j, from 1: Pearson's correlations of the components of vectors; null where one is constant.

    A task sums products of whole batches as one matrix, of values less their rough means, and sends ``size`` squared sums; a pair
    counts rows in which both components are there."""
    rough = df.agg(*(F.coalesce(F.avg(F.get(vector, F.lit(i))), F.lit(0.0)).alias(f"m{i}") for i in range(size))).first()
    middle = np.nan_to_num(np.array(rough, float), posinf=0.0, neginf=0.0)
    i, j = np.triu_indices(size, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(i)))
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                columns = batch.slice(a, 4096).column(0).flatten()
                x = np.array([c.to_numpy(zero_copy_only=False) for c in columns], float).T
                there = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], float).T
                x = np.where(there > 0, x - middle, 0.0)
                parts = (there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x)
                total += np.array([m[i, j] for m in parts])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32") + 1), pa.array(j.astype("int32") + 1), *map(pa.array, total)], ["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    whole = df.select(F.struct(*(F.get(vector, F.lit(k)).cast("double").alias(f"c{k}") for k in range(size))).alias("v"))
    s = whole.mapInArrow(sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    spread = lambda a, b: F.try_divide(F.col(a) * F.col(b), F.col("n"))
    xx, yy, xy = F.col("xx") - spread("x", "x"), F.col("yy") - spread("y", "y"), F.col("xy") - spread("x", "y")
    scale = F.sqrt(xx) * F.sqrt(yy)
    return s.select("i", "j", F.try_divide(xy, F.when(scale > 0, scale)).alias("r"))


def regression_metrics(actual: str, predicted: str) -> list[Column]:
    """Aggregates: R2, Pearson, RMSE, MAE (null where an input is constant)."""
    a, p = F.col(actual), F.col(predicted)
    spread = F.var_pop(a)
    return [
        (1.0 - F.try_divide(F.avg((a - p) * (a - p)), F.when(spread > 0, spread))).alias("r2"),
        correlation(a, p).alias("pearson_r"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg(F.abs(a - p)).alias("mae"),
    ]


def spearman(df: DataFrame, a: str, b: str, keys: tuple[str, ...] = (), name: str = "spearman_r") -> DataFrame:
    """Rank correlation of two columns by keys, over rows where both are there."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, a, b)
    ranked = average_ranks(average_ranks(both, a, "_ra", keys), b, "_rb", keys)
    some = correlation(F.col("_ra"), F.col("_rb")).alias(name)
    return ranked.groupBy(*keys).agg(some, F.count(F.lit(1)).alias("n"))


def _beta_fraction(a: np.ndarray | float, b: np.ndarray | float, x: np.ndarray, steps: int = 200) -> np.ndarray:
    """Continued fraction of the incomplete beta function, after Lentz."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


def correlation_p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p-values of correlations of n pairs, by Student's t."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    free = n - 2
    out = np.full(r.shape, np.nan)
    ok = np.isfinite(r) & (free > 0)
    exact = ok & (np.abs(r) >= 1)
    out[exact] = 0.0
    ok &= ~exact
    v, t2 = free[ok], r[ok] ** 2 * free[ok] / (1 - r[ok] ** 2)
    a, x = v / 2, v / (v + t2)
    logs = np.array([math.lgamma(p + 0.5) - math.lgamma(p) - math.lgamma(0.5) for p in a]) if len(a) else a
    front = np.exp(logs + a * np.log(x) + 0.5 * np.log1p(-np.minimum(x, 1 - 1e-16)))
    direct = x < (a + 1) / (a + 2.5)
    left = front * _beta_fraction(a, 0.5, np.where(direct, x, 0.5)) / a
    right = 1.0 - front * _beta_fraction(0.5, a, np.where(direct, 0.5, 1 - x)) / 0.5
    out[ok] = np.clip(np.where(direct, left, right), 0, 1)
    return out


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation; null where there is none."""

    @F.pandas_udf("double")
    def value(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(correlation_p_values(a.to_numpy(float), b.to_numpy(float)))

    return F.nanvl(value.asNondeterministic()(r.cast("double"), n.cast("double")), F.lit(None).cast("double"))
