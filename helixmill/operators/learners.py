"""Learners as sums over rows: ridge regression with its penalty by leave-one-out, repeated folds from one pass, support vector
regression on Fourier features, and extremely randomised trees.

Tasks add up small arrays (``summed``) that Spark sums; the driver gets arrays whose size the parameters fix, never rows. Rows
with a null or non-finite feature or label are left out of fits and get a null prediction."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a row of a summed array holds.
WIDE = 64
PENALTIES = tuple(float(10 ** (-2 + 5 * k / 19)) for k in range(20))


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) if columns else np.zeros((batch.num_rows, 0))


def usable(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """Doubles of the rows in which all ``columns`` are finite, with ``more`` columns beside them."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns), *more)
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf"))
    return rows.where(ok)


def summed(rows: DataFrame, size: int, add: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sums by group of the arrays (group, float64[size]) that ``add`` makes of batches; a task sends each of its groups once."""
    wide = -(-size // WIDE) * WIDE
    names = [f"c{i}" for i in range(WIDE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for g, x in add(batch):
                    own.setdefault(g, np.zeros(wide))[:size] += np.asarray(x, float).ravel()
        for g, x in own.items():
            parts = x.reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), *(pa.array(parts[:, i]) for i in range(WIDE))], ["g", "part", *names])

    told = rows.mapInArrow(run, "g long, part int, " + ", ".join(f"{c} double" for c in names)).groupBy("g", "part").agg(*(F.sum(c).alias(c) for c in names))
    got = told.toArrow().sort_by([("g", "ascending"), ("part", "ascending")])
    out: dict[int, list[np.ndarray]] = {}
    values = np.stack([got.column(c).to_numpy() for c in names], axis=1) if got.num_rows else np.zeros((0, WIDE))
    for g, x in zip(got.column("g").to_pylist(), values, strict=True):
        out.setdefault(g, []).append(x)
    return {g: np.concatenate(x)[:size] for g, x in out.items()}


@dataclass
class Linear:
    """A fitted line: weights of the features, and the intercept."""

    features: list[str]
    weights: np.ndarray
    intercept: float
    penalty: float = 0.0

    def column(self) -> Column:
        total = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.weights, strict=True):
            total = total + F.col(f).cast("double") * float(w)
        return total


def moments(rows: DataFrame, features: list[str], label: str, group: str | None = None) -> dict[int, np.ndarray]:
    """By group, the sums of products of (1, features, label): all that a least-squares fit needs of the rows."""
    names = [*features, label]

    def add(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        z = np.concatenate([np.ones((batch.num_rows, 1)), matrix(batch, names)], axis=1)
        g = batch.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(len(z), int)
        for k in np.unique(g):
            yield int(k), z[g == k].T @ z[g == k]

    size = len(names) + 1
    return {g: x.reshape(size, size) for g, x in summed(usable(rows, names, *([group] if group else [])), size * size, add).items()}


def centred(m: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray]:
    """(n, means of features, mean of label, centred Gram matrix, centred products with the label) of moments."""
    n = m[0, 0]
    x, y = m[0, 1:-1] / n, m[0, -1] / n
    return n, x, y, m[1:-1, 1:-1] - n * np.outer(x, x), m[1:-1, -1] - n * x * y


def ridge(m: np.ndarray, features: list[str], penalty: float) -> Linear:
    """The ridge fit with an unpenalised intercept."""
    _, x, y, gram, cross = centred(m)
    w = np.linalg.lstsq(gram + penalty * np.eye(len(features)), cross, rcond=None)[0]
    return Linear(features, w, float(y - x @ w), penalty)


def ridge_by_penalty(rows: DataFrame, features: list[str], label: str, penalties: tuple[float, ...] = PENALTIES) -> tuple[Linear, dict[float, float]]:
    """The ridge fit of the penalty with the least mean squared leave-one-out error (ties: the first), and all errors.

    One aggregate gives the moments; in the eigenvectors of their Gram matrix each penalty's fit and each row's leverage are
    sums of squares, so a second aggregate has the left-out errors of all penalties."""
    got = moments(rows, features, label)
    if not got:
        raise ValueError("no usable row")
    n, x, y, gram, cross = centred(got[0])
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0)
    names = [*features, label]
    shrunk = 1 / (values[None, :] + np.array(penalties)[:, None])
    fits = shrunk * (vectors.T @ cross)[None, :]

    def add(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        z = matrix(batch, names)
        u = (z[:, :-1] - x) @ vectors
        error = (z[:, -1:] - y) - u @ fits.T
        leverage = (u**2) @ shrunk.T + 1 / n
        yield 0, ((error / np.maximum(1 - leverage, 1e-12)) ** 2).sum(axis=0)

    errors = summed(usable(rows, names), len(penalties), add)[0] / n
    best = int(errors.argmin())
    w = vectors @ fits[best]
    return Linear(features, w, float(y - x @ w), penalties[best]), dict(zip(penalties, errors.tolist(), strict=True))


def repeated_folds(rows: DataFrame, features: list[str], label: str, seed: str, fold: str, penalty: float) -> tuple[DataFrame, dict[tuple[int, int], Linear]]:
    """Out-of-fold predictions of rows dealt into folds for several seeds, and the fits, by (seed, fold).

    One pass gives the moments of each fold of each seed; those of the rows outside a fold are the seed's total less the fold's,
    so no fit reads the rows again. ``prediction`` is that of the fit without the row's own fold."""
    folds = 1 + int(rows.agg(F.max(fold)).first()[0] or 0)
    own = rows.withColumn("_group", (F.col(seed).cast("long") * folds + F.col(fold)).cast("long"))
    got = moments(own, features, label, "_group")
    fits = {}
    for s in sorted({g // folds for g in got}):
        total = sum(got[g] for g in got if g // folds == s)
        for k in range(folds):
            left = total - got.get(s * folds + k, 0)
            if left[0, 0] > 0.5:
                fits[s, k] = ridge(left, features, penalty)
    table = {s * folds + k: np.append(f.weights, f.intercept) for (s, k), f in fits.items()}

    @F.pandas_udf("double")
    def predicted(group: pd.Series, x: pd.DataFrame) -> pd.Series:
        w = np.stack([table.get(g, np.full(len(features) + 1, np.nan)) for g in group]) if len(group) else np.zeros((0, len(features) + 1))
        out = (x.to_numpy(float) * w[:, :-1]).sum(axis=1) + w[:, -1]
        return pd.Series(out).where(np.isfinite(out), None)

    told = own.withColumn("prediction", predicted.asNondeterministic()("_group", F.struct(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)))))
    return told.drop("_group"), fits


@dataclass
class FourierRegression:
    """A line on random Fourier features, whose products stand for a radial kernel."""

    features: list[str]
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    intercept: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)

    def column(self) -> Column:
        @F.pandas_udf("double")
        def predicted(x: pd.DataFrame) -> pd.Series:
            v = x.to_numpy(float)
            out = self.lifted(np.nan_to_num(v)) @ self.weights + self.intercept
            return pd.Series(out).where(np.isfinite(v).all(axis=1), None)

        return predicted.asNondeterministic()(F.struct(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features))))


def support_vectors(rows: DataFrame, features: list[str], label: str, cost: float = 20.0, epsilon: float = 0.005, size: int = 256, rounds: int = 25, seed: int = 42, tolerance: float = 1e-5) -> FourierRegression:
    """Support vector regression with a radial kernel of width 1 / (features * variance), its kernel approximated by ``size``
    seeded Fourier features.

    The loss, which is 0 within ``epsilon``, is solved by reweighted least squares: each round is one aggregate of weighted
    moments of the lifted rows, until the weights move by less than the tolerance."""
    own = usable(rows, [*features, label])
    m = moments(rows, features, label)[0]
    n, p = m[0, 0], len(features)
    variance = float(np.trace(m[1:-1, 1:-1]) / (n * p) - (m[0, 1:-1].sum() / (n * p)) ** 2)
    width = 1 / (p * variance) if variance > 0 else 1.0
    r = np.random.default_rng(seed)
    fit = FourierRegression(features, r.normal(size=(p, size)) * math.sqrt(2 * width), r.uniform(0, 2 * math.pi, size), np.zeros(size), float(m[0, -1] / n))

    def step(now: FourierRegression) -> np.ndarray:
        def add(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
            x = matrix(batch, [*features, label])
            z = np.concatenate([now.lifted(x[:, :-1]), np.ones((len(x), 1))], axis=1)
            off = x[:, -1] - z[:, :-1] @ now.weights - now.intercept
            out = np.abs(off) - epsilon
            a = np.where(out > 0, cost / np.maximum(out, 1e-6), 0.0)
            target = x[:, -1] - np.sign(off) * epsilon
            yield 0, np.concatenate([(z * a[:, None]).T @ z, ((z * a[:, None]).T @ target)[:, None]], axis=1)

        return summed(own, (size + 1) * (size + 2), add)[0].reshape(size + 1, size + 2)

    for _ in range(rounds):
        s = step(fit)
        if not s[:, :-1].any():  # no row is off by more than epsilon
            break
        penalty = np.eye(size + 1)
        penalty[size, size] = 1e-9
        w = np.linalg.solve(s[:, :-1] + penalty, s[:, -1])
        moved = float(np.abs(w[:-1] - fit.weights).max() + abs(w[-1] - fit.intercept))
        fit = FourierRegression(features, fit.frequencies, fit.phases, w[:-1], float(w[-1]))
        if moved < tolerance * (1 + float(np.abs(w).max())):
            break
    return fit


def uniform(seed: int, tree: np.ndarray, node: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Numbers in 0..1 by hash."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + tree.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + node.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + feature.astype(np.uint64) * np.uint64(0xAEF17502108EF2D9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


@dataclass
class Forest:
    """Trees as arrays [tree, node]; the root is node 1, the children of node i are 2 i and 2 i + 1; a leaf's feature is -1."""

    features: list[str]
    split: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """int64[trees, n]: the node where each row stands in each tree."""
        at = np.ones((len(self.split), len(x)), np.int64)
        tree, row = np.arange(len(self.split))[:, None], np.arange(len(x))[None, :]
        for _ in range(self.depth):
            f = self.split[tree, at]
            down = f >= 0
            right = x[row, np.maximum(f, 0)] > self.threshold[tree, at]
            at = np.where(down, 2 * at + right, at)
        return at

    def column(self) -> Column:
        @F.pandas_udf("double")
        def predicted(x: pd.DataFrame) -> pd.Series:
            v = x.to_numpy(float)
            out = np.concatenate([np.zeros(0), *(self.value[np.arange(len(self.split))[:, None], self.nodes(np.nan_to_num(v[i : i + 4096]))].mean(axis=0) for i in range(0, len(v), 4096))])
            return pd.Series(out).where(np.isfinite(v).all(axis=1), None)

        return predicted.asNondeterministic()(F.struct(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features))))


def node_sums(at: np.ndarray, columns: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Different nodes of one tree, and the sums, least or greatest values of columns over each one's rows."""
    order = np.argsort(at, kind="stable")
    node, begin = np.unique(at[order], return_index=True)
    return node, {"sum": np.add, "min": np.minimum, "max": np.maximum}[how].reduceat(columns[order], begin, axis=0)


def extra_trees(rows: DataFrame, features: list[str], label: str, trees: int = 200, depth: int = 12, least: int = 2, seed: int = 42) -> Forest:
    """Extremely randomised trees, grown level by level, all trees at once.

    A level is two aggregates by (tree, node): the range of each feature, in which a hash draws its threshold, and the count and
    sums of the label below each threshold, of which the largest fall in squared error is the split (ties: the first feature).
    Splits that leave fewer than ``least`` rows on a side don't count. Tasks send one row for each node that they hold, the
    driver gets one for each node of the level; the model's size is fixed by ``trees`` and ``depth``."""
    names, p = [*features, label], len(features)
    own = usable(rows, names)
    shape = (trees, 1 << (depth + 1))
    forest = Forest(features, np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape), depth)
    lows, highs, sums = [f"l{i}" for i in range(p)], [f"h{i}" for i in range(p)], [f"s{i}" for i in range(2 * p + 3)]
    open_ = np.zeros(shape, bool)
    open_[:, 1] = True

    def level(columns: list[str], work: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]], now: Forest, alive: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch, names)
                at = now.nodes(x)
                for t in range(trees):
                    some = alive[t, at[t]]
                    if some.any():
                        node, told = work(x[some], at[t][some], t)
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(node), pa.int32()), pa.array(node), *(pa.array(told[:, i]) for i in range(told.shape[1]))], ["tree", "node", *columns])

        return own.mapInArrow(run, "tree int, node long, " + ", ".join(f"{c} double" for c in columns)).groupBy("tree", "node")

    def ranges(x: np.ndarray, at: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray]:
        node, low = node_sums(at, x[:, :-1], "min")
        return node, np.concatenate([low, node_sums(at, x[:, :-1], "max")[1]], axis=1)

    for k in range(depth + 1):
        if not open_.any():
            break
        if k < depth:
            got = level([*lows, *highs], ranges, forest, open_).agg(*(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs)).toArrow()
            tree, node = got.column("tree").to_numpy(), got.column("node").to_numpy()
            low, high = (np.stack([got.column(c).to_numpy() for c in cs], axis=1) if len(tree) else np.zeros((0, p)) for cs in (lows, highs))
            drawn = low + uniform(seed, tree[:, None], node[:, None], np.arange(p)[None, :]) * (high - low)
            places = {(t, n): i for i, (t, n) in enumerate(zip(tree.tolist(), node.tolist(), strict=True))}
        else:
            drawn, places = np.zeros((0, p)), {}

        def halves(x: np.ndarray, at: np.ndarray, t: int, drawn: np.ndarray = drawn, places: dict = places) -> tuple[np.ndarray, np.ndarray]:
            y = x[:, -1:]
            parts = [np.ones_like(y), y, y * y]
            if places:
                node, which = np.unique(at, return_inverse=True)
                cut = drawn[[places[t, n] for n in node.tolist()]][which]
                left = (x[:, :-1] <= cut).astype(float)
                parts += [left, left * y]
            else:
                parts.append(np.zeros((len(x), 2 * p)))
            return node_sums(at, np.concatenate(parts, axis=1), "sum")

        got = level(sums, halves, forest, open_).agg(*(F.sum(c).alias(c) for c in sums)).toArrow()
        tree, node = got.column("tree").to_numpy(), got.column("node").to_numpy()
        s = np.stack([got.column(c).to_numpy() for c in sums], axis=1) if len(tree) else np.zeros((0, len(sums)))
        forest.value[tree, node] = s[:, 1] / s[:, 0]
        open_ = np.zeros(shape, bool)
        if k == depth or not len(tree):
            break
        feature, gain = best_splits(s, p, least)
        good = gain > 1e-12 * (1 + s[:, 2])
        cut = drawn[[places[t, n] for t, n in zip(tree.tolist(), node.tolist(), strict=True)], feature]
        forest.split[tree[good], node[good]] = feature[good]
        forest.threshold[tree[good], node[good]] = cut[good]
        open_[tree[good], 2 * node[good]] = open_[tree[good], 2 * node[good] + 1] = True
    return forest


def best_splits(s: np.ndarray, p: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature and gain of each node's best split, from (n, sum, sum of squares, counts below, sums below); -inf where none is allowed."""
    n, total, below, sum_below = s[:, :1], s[:, 1:2], s[:, 3 : 3 + p], s[:, 3 + p :]
    above, sum_above = n - below, total - sum_below
    gain = sum_below**2 / np.maximum(below, 1) + sum_above**2 / np.maximum(above, 1) - total**2 / n
    gain = np.where((below >= least) & (above >= least), gain, -np.inf)
    feature = gain.argmax(axis=1) if len(s) else np.zeros(0, int)
    return feature, gain[np.arange(len(s)), feature] if len(s) else np.zeros(0)
