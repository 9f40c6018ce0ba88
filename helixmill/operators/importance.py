"""Importance by permutation, mutation effects and the rules drawn from them.

Scorers are sums and products of what they are given by feature: columns or arrays of numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.statistics import average_ranks, value_ranges
from ..sources.tables import kept
from .folds import numbered

Scorer = Callable[[dict[str, Column | np.ndarray]], Column | np.ndarray]

#: Rows of a condition that a task puts in order at once, about, and shuffled rows that are on disk at once, about.
SHUFFLE_ROWS = 20_000
BATCH_ROWS = 1 << 25


def digests(prefix: str, keys: list[bytes]) -> np.ndarray:
    """uint64[n, 2]: the digests of ``shuffled_order`` for keys that each begin with their separator."""
    first, out = hashlib.md5(prefix.encode()), []
    for k in keys:
        own = first.copy()
        own.update(k)
        out.append(own.digest())
    return np.frombuffer(b"".join(out), ">u8").astype(np.uint64).reshape(-1, 2)


def permutation_deltas(df: DataFrame, key: str, fold: str, groups: dict[str, list[str]], score: Scorer, features: list[str], actual: str, permutations: int, seed: int) -> DataFrame:
    """(fold, group, permutation, baseline, delta): RMSE gained when a group's features are permuted together in a fold.

    Each condition pairs natural and shuffled row numbers. A fold's numbers are dealt into parts of about ``SHUFFLE_ROWS`` by the
    first bits of digests. A first pass counts each part of each condition (the driver gets these counts, one for so many rows and a
    condition); then digests and values of a condition's own features go, packed, to the task of their part, with the natural
    rows whose numbers the part can have, so each value moves once. Conditions are taken in batches of about ``BATCH_ROWS`` shuffled
    rows, a group at least, whose shuffle files go before the next. Rows with a missing number count in no error of theirs."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    suffix = F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit("")).alias("_key")
    natural = numbered(value_ranges(df.where(F.col(fold).isNotNull()), key, "_part"), [fold], [key], "_n", "_part")
    natural = kept(natural.select(F.col(fold).alias("_fold"), F.col("_n").cast("long").alias("_n"), suffix, *(number(c).alias(f"_x{i}") for i, c in enumerate((actual, *features)))), "natural")
    x = {f: F.col(f"_x{i + 1}") for i, f in enumerate(features)}
    base = kept(natural.groupBy("_fold").agg(F.sqrt(F.avg(F.pow(F.col("_x0") - score(x), F.lit(2)))).alias("baseline"), F.count(F.lit(1)).alias("n")), "folds")
    sizes = {r["_fold"]: r["n"] for r in base.collect()}
    order = {f: i for i, f in enumerate(sorted(sizes))}
    parts = min(1 << 16, max(1, -(-max(sizes.values(), default=0) // SHUFFLE_ROWS)))
    slots = parts * max(1, len(order))
    names = list(groups)
    conditions = [(g, p) for g in range(len(names)) for p in range(1, permutations + 1)]
    part_of = lambda d: ((d[:, 0] >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)

    def dealt(batch: pa.RecordBatch, own: list[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
        """Each condition with the digests and slots of a batch's rows."""
        first = np.array([order[f] for f in batch.column("_fold").to_pylist()], np.int64) * parts
        keys = [k.encode() for k in batch.column("_key").to_pylist()]
        for g, p in own:
            d = digests(f"{seed}|{names[g]}|{p}", keys)
            yield (g, p), d, first + part_of(d)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(conditions), slots), np.int64)
        for batch in batches:
            for c, (_, _, slot) in enumerate(dealt(batch, conditions)):
                n[c] += np.bincount(slot, minlength=slots)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), pa.array(list(n.T), pa.list_(pa.int64()))], ["slot", "n"])

    before = np.zeros((len(conditions), slots), np.int64)
    after = np.repeat(np.array([[sizes[f] for f in order]], np.int64), len(conditions), axis=0) if parts == 1 else before
    if parts > 1:
        told = natural.select("_fold", "_key").mapInArrow(count, "slot int, n array<long>")
        sums = told.groupBy("slot").agg(F.array(*(F.sum(F.get("n", F.lit(i))) for i in range(len(conditions)))).alias("n")).collect()
        n = np.zeros((slots, len(conditions)), np.int64)
        for r in sums:
            n[r["slot"]] = r["n"]
        after = np.cumsum(n.T.reshape(len(conditions), len(order), parts), axis=2).reshape(len(conditions), slots)
        before = after - n.T
    low, high = before.min(axis=0), after.max(axis=0)  # numbers that a slot's rows can have

    def errors(own: list[tuple[int, int]]) -> DataFrame:
        """(_f, _c, _s, _m): sums of squared errors and their numbers for some conditions."""
        wide = 1 + len(features)
        rows = max(1024, 128 * slots)
        place = {f: i for i, f in enumerate(features)}
        begin = {(g, p): before[g * permutations + p - 1] for g, p in own}

        def packed(slot: np.ndarray, condition: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            by = np.argsort(slot, kind="stable")
            slot, a, b = slot[by], a[by], b[by]
            starts = np.flatnonzero(np.append([True], slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
            cut = lambda m: pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((np.append(starts, len(slot)) * m[:1].nbytes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(m))])
            return pa.RecordBatch.from_arrays([pa.array(slot[starts].astype(np.int32)), pa.array(np.full(len(starts), condition, np.int32)), cut(a), cut(b)], ["slot", "condition", "a", "b"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    batch = whole.slice(at, rows)
                    number = batch.column("_n").to_numpy()
                    values = np.array([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(wide)], float).T
                    first = np.array([order[f] for f in batch.column("_fold").to_pylist()], np.int64) * parts
                    # a row goes to all parts that its number can fall into: its own and few neighbours
                    for k in range(parts):
                        there = np.flatnonzero((number > low[first + k]) & (number <= high[first + k]))
                        if len(there):
                            yield packed((first + k)[there], -1, number[there], values[there])
                    for c, d, slot in dealt(batch, own):
                        yield packed(slot, c[0] * permutations + c[1] - 1, d, values[:, [1 + place[f] for f in groups[names[c[0]]]]])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, rows = (-1, -1), [], np.zeros((0, wide))
            total: dict[tuple[int, int], tuple[float, int]] = {}

            def told() -> None:
                nonlocal rows
                slot, c = at
                if not held:
                    return
                a, b = (b"".join(x) for x in zip(*held, strict=True))
                if c < 0:
                    rows = np.frombuffer(b, float).reshape(-1, wide)[np.argsort(np.frombuffer(a, np.int64))]
                    return
                g, p = divmod(c, permutations)
                d = np.frombuffer(a, np.uint64).reshape(-1, 2)
                by = np.lexsort((d[:, 1], d[:, 0]))
                v = np.frombuffer(b, float).reshape(len(d), -1)[by]
                start = int(begin[g, p + 1][slot] - low[slot])
                x = rows[start : start + len(d)]
                own = groups[names[g]]
                given = {f: v[:, own.index(f)] if f in own else x[:, 1 + i] for f, i in place.items()}
                off = (x[:, 0] - score(given)) ** 2
                good = ~np.isnan(off)
                s, m = total.get((slot // parts, c), (0.0, 0))
                total[slot // parts, c] = (s + float(off[good].sum()), m + int(good.sum()))

            for batch in batches:
                for slot, c, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if (slot, c) != at:
                        told()
                        at, held = (slot, c), []
                    held.append((a, b))
            told()
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)] + [pa.array([v[0] for v in total.values()], pa.float64()), pa.array([v[1] for v in total.values()], pa.int64())], ["_f", "_c", "_s", "_m"])

        sent = natural.mapInArrow(deal, "slot int, condition int, a binary, b binary").repartition("slot").sortWithinPartitions("slot", "condition")
        return kept(sent.mapInArrow(add, "_f int, _c int, _s double, _m long"), "errors", clean=True)

    each = max(1, BATCH_ROWS // max(1, sum(sizes.values()) * permutations)) * permutations  # whole groups
    sums = reduce(DataFrame.unionByName, [errors(conditions[i : i + each]) for i in range(0, len(conditions), each)])
    spark = df.sparkSession
    kind = df.schema[fold].dataType
    folds = spark.createDataFrame([(i, f) for f, i in order.items()], T.StructType([T.StructField("_f", T.IntegerType()), T.StructField("_fold", kind)]))
    rmse = sums.groupBy("_f", "_c").agg(F.sqrt(F.try_divide(F.sum("_s"), F.sum("_m"))).alias("permuted")).join(folds, "_f").join(base.select("_fold", "baseline"), "_fold")
    group = F.element_at(F.array(*map(F.lit, names)), F.floor(F.col("_c") / permutations).cast("int") + 1)
    return rmse.select(F.col("_fold").alias(fold), group.alias("group"), (F.col("_c") % permutations + 1).alias("permutation"), "baseline", (F.col("permuted") - F.col("baseline")).alias("delta"))


def evidence(deltas: DataFrame, associations: DataFrame, feature: str = "feature") -> DataFrame:
    """(feature, pi_percentile, pi_stability, association_convergence, fdr_support, evidence) of the features of ``associations``
    (feature, rho_actual, rho_oof, q): the geometric mean of four parts in 0..1, of which missing ones count 0.

    The parts are the percent rank of the mean importance, the share of permutations that gain error, the geometric mean of two
    correlations of one direction, and what the adjusted p-value leaves of 1."""
    names = associations.select(feature)
    own = deltas.join(names, F.col("group") == F.col(feature), "left_semi")
    mean = importance(own, "fold").select(F.col("group").alias(feature), F.round("mean", 9).alias("_mean"))
    steady = own.groupBy(F.col("group").alias(feature)).agg(F.avg((F.round("delta", 9) > 0).cast("int")).alias("pi_stability"))
    rows = associations.join(average_ranks(mean, "_mean", "pi_percentile", percent=True), feature, "left").join(steady, feature, "left")
    rows = rows.withColumn("association_convergence", F.when(F.signum("rho_actual") == F.signum("rho_oof"), F.sqrt(F.abs(F.col("rho_actual") * F.col("rho_oof")))))
    rows = rows.withColumn("fdr_support", 1.0 - F.least(F.greatest(F.coalesce("q", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))
    parts = ("pi_percentile", "pi_stability", "association_convergence", "fdr_support")
    safe = {c: F.round(F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 5) for c in parts}
    product = safe[parts[0]]
    for c in parts[1:]:
        product = product * safe[c]
    return rows.select(feature, *(x.alias(c) for c, x in safe.items()), F.pow(product, F.lit(0.25)).alias("evidence"))


def operator_weights(scores: DataFrame, operators: dict[str, list[str]], fixed: dict[str, float], feature: str = "feature", score: str = "evidence") -> DataFrame:
    """(operator, score, weight): the mean score of each operator's features (missing ones count 0), and its share; ``fixed`` scores join in."""
    spark = scores.sparkSession
    wanted = spark.createDataFrame([(o, f) for o, fs in operators.items() for f in fs], f"operator string, `{feature}` string")
    mean = wanted.join(scores.select(feature, score), feature, "left").groupBy("operator").agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("score"))
    every = mean.unionByName(spark.createDataFrame(list(fixed.items()), "operator string, score double")) if fixed else mean
    every = every.withColumn("score", F.greatest("score", F.lit(0.0)))
    total = every.agg(F.sum("score").alias("_total"))
    return every.crossJoin(F.broadcast(total)).select("operator", "score", F.try_divide("score", "_total").alias("weight"))  # a row an operator


def importance(deltas: DataFrame, fold: str) -> DataFrame:
    """(group, mean, sd, median): means over a fold's permutations first, then over folds."""
    each = deltas.groupBy(fold, "group").agg(F.avg("delta").alias("d"))
    return each.groupBy("group").agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.median("d").alias("median"))


def two_stage_profile(df: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """(place, mean, median, sd, n, sem): one mean per row and place, then statistics over rows."""
    each = df.groupBy(key, place).agg(F.avg(value).alias("v"))
    out = each.groupBy(place).agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("sem", F.col("sd") / F.sqrt("n"))


def unpivoted(df: DataFrame, key: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(key, columns, name, value)


def rules_json(rules: DataFrame) -> DataFrame:
    """One JSON text of rules (feature, direction, low, high): a map by feature; numbers that JSON lacks are null."""
    safe = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    entry = F.struct("feature", F.struct("direction", F.array(safe("low"), safe("high")).alias("range")).alias("rule"))
    return rules.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("rules"))
