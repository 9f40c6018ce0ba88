"""Deterministic folds, permutations, samples and allocations, ordered by digests instead of generators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.statistics import running_total, value_ranges


def shuffled_order(*parts: Column | str) -> Column:
    """A reproducible random order: the digest of the parts (seed first, id last)."""
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str, part: str) -> DataFrame:
    """Adds 1, 2, ... within keys by the column ``part``, which is dropped, and then ``order``.

    Counts by key and part are summed first, so that no window holds more than one part of a key. Null keys are a key."""
    by = [*keys, part]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sums = F.sum("_n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), F.coalesce(sums, F.lit(0)).alias("_before"))
    within = df.withColumn("_within", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)))
    out = within.join(before, same).withColumn(name, F.col("_before") + F.col("_within"))
    return out.drop(part, "_within", "_before", *(f"_k{i}" for i in range(len(by))))


def shuffled(df: DataFrame, keys: list[str], digest: Column, tie: str, name: str) -> DataFrame:
    """Adds 1, 2, ... within keys in the order of a digest, whose first signs deal rows out evenly."""
    dealt = df.withColumn("_digest", digest)
    return numbered(dealt.withColumn("_part", F.substring("_digest", 1, 3)), keys, ["_digest", tie], name, "_part").drop("_digest")


def stratified_folds(df: DataFrame, strata: str, key: str, seeds: list[int], folds: int = 5) -> DataFrame:
    """One row per seed and row: ``fold`` deals each stratum out in shuffled order."""
    many = df.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    out = shuffled(many, ["seed", strata], shuffled_order(F.col("seed"), F.col(key)), key, "_n")
    return out.withColumn("fold", ((F.col("_n") - 1) % folds).cast("int")).drop("_n")


def permuted(df: DataFrame, key: str, columns: list[str], group: list[str], salt: list[Column | str]) -> DataFrame:
    """Columns permuted together within groups: natural (numeric key) and shuffled row numbers are paired."""
    natural = numbered(value_ranges(df, key, "_part"), group, [key], "_n", "_part")
    mixed = shuffled(df, group, shuffled_order(*salt, F.col(key)), key, "_n")
    other = mixed.select(*group, "_n", *(F.col(c).alias(f"{c}_permuted") for c in columns))
    return natural.join(other, [*group, "_n"]).drop("_n")


def stratified_sample(df: DataFrame, strata: str, key: str, per_stratum: int, seed: int) -> DataFrame:
    order = Window.partitionBy(strata).orderBy(shuffled_order(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_stratum).drop("_r")


def largest_remainder(df: DataFrame, weight: str, total: int, group: list[str], key: str, name: str = "allocated") -> DataFrame:
    """Shares of ``total`` in whole numbers: floors, then one more for the largest remainders (ties by key).

    Weights below 0 count 0; where all are 0, all count alike."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    some = with_totals(df.withColumn("_w", w), group, F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_c"))
    some = some.withColumn("_e", total * F.when(F.col("_s") > 0, F.col("_w") / F.col("_s")).otherwise(1.0 / F.col("_c")))
    some = some.withColumn("_f", F.floor("_e").cast("long")).withColumn("_rest", F.round(F.col("_e") - F.col("_f"), 9))
    some = with_totals(some, group, F.sum("_f").alias("_given"))
    # remainders from the largest down, in parts, so that no window holds a group
    ranked = numbered(some.withColumn("_part", F.floor((1 - F.col("_rest")) * 256)), group, [F.desc("_rest"), key], "_rank", "_part")
    return ranked.withColumn(name, F.col("_f") + (F.col("_rank") <= total - F.col("_given")).cast("long")).drop("_w", "_s", "_c", "_e", "_f", "_rest", "_given", "_rank")


def with_totals(df: DataFrame, group: list[str], *totals: Column) -> DataFrame:
    """``df`` with aggregates over its groups (null is a group, too) beside its rows."""
    sums = df.groupBy(*group).agg(*totals)
    if not group:
        return df.crossJoin(F.broadcast(sums))  # of one row
    sums = sums.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), *sums.columns[len(group) :])
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)))
    return df.join(sums, same).drop(*(f"_g{i}" for i in range(len(group))))


def weighted_draws(df: DataFrame, weight: str, draws: int, group: list[str], key: str, seed: int) -> DataFrame:
    """``draws`` rows per group with replacement: digest uniforms meet the intervals of running shares, by a unique numeric key."""
    share = with_totals(df, group, F.sum(weight).alias("_total")).withColumn("_share", F.col(weight) / F.col("_total")).drop("_total")
    upto = running_total(share, key, "_share", "_hi", tuple(group)).withColumn("_lo", F.col("_hi") - F.col("_share"))
    number = df.select(*group).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    uniform = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(g).cast("string") for g in group), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    number = number.withColumn("_u", uniform)
    return number.join(upto, group).where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_share", "_hi", "_lo", "_u")


def evenly_spaced(df: DataFrame, order: str, count: int) -> DataFrame:
    """First, last and evenly spaced rows by a unique numeric order; an empty table gives an empty one."""
    from ..sources.tables import with_row_number

    n = df.count()
    places = sorted({round(k * (n - 1) / max(count - 1, 1)) for k in range(count)}) if n else []
    return with_row_number(df, order, "_p").where(F.col("_p").isin(places)).drop("_p")
