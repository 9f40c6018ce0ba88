"""Centroid clustering by exact integer k-means, filtered by ball trees.

Each partition builds metric trees over up to ``TREE`` of its vectors. A tree is a row of a written table: its balls hold
radius, count and the integer sum of their vectors, its vectors lie in the order of the leaves. A round sends the few centroids
to the trees: by the triangle inequality a centroid that is farther from a ball's middle than the nearest one by over
twice the radius is nearest to none of its vectors. A ball that one centroid is left for is assigned whole, by its count and
sum; the others are descended, with the centroids left, to leaves whose distances are exact integers. Counts and sums are
added up by centroid on Spark; the driver gets one row a centroid.

Vectors of another length than ``dims`` or with a null or non-finite component are left out. A component x counts as the integer
floor(scale * x); vectors with one of ``LIMIT`` or more in size are refused with an error, as squared distances would pass 64 bits.
Centroids start as the vectors with the smallest sha256 of ``<salt>:<id>``, in that order; a null id hashes as an empty string,
and vectors of equal ids start in the order of their components. Fewer vectors than centroids make fewer centroids, and an
empty table gives an empty result. At equal distance the smaller number is taken; repeated rows are vectors of their own.
Only the columns of id and vector are read, so no other name can clash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors of a tree, and of a leaf, at most (a leaf of equal vectors may hold more).
TREE = 4096
LEAF = 64
#: Components of this size and more are refused.
LIMIT = 1 << 27
#: Up to this size, products and sums of squares of 64 components are exact as doubles.
EXACT = 1 << 21
#: Relative room for rounding in the test of a ball.
ROOM = 1e-6
FIELDS = ("start", "end", "left", "radius", "total")


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the rows of int64[n, d], and the balls: start, end, left child (-1: leaf; the right one follows it), radius, total.

    A ball is cut at the median of the projections on the line between two far vectors."""
    order = np.arange(len(x))
    start, end, left, radius, total = [0], [len(x)], [-1], [], []
    k = 0
    while k < len(start):
        own = order[start[k] : end[k]]
        rows = x[own].astype(float)
        total.append(x[own].sum(axis=0))
        away = ((rows - total[k] / len(own)) ** 2).sum(axis=1)
        radius.append(float(np.sqrt(away.max())))
        if len(own) > leaf and radius[k] > 0:
            far = rows[away.argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            half = len(own) // 2
            order[start[k] : end[k]] = own[np.argsort(rows @ (other - far), kind="stable")]
            left[k] = len(start)
            start += [start[k], start[k] + half]
            end += [start[k] + half, end[k]]
            left += [-1, -1]
        k += 1
    return order, {"start": np.array(start), "end": np.array(end), "left": np.array(left), "radius": np.array(radius), "total": np.array(total)}


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """int64[n, k]: exact squared distances of integer vectors."""
    size = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if size < EXACT and x.shape[1] <= 64:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)


def filtered(x: np.ndarray, tree: dict[str, np.ndarray], c: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
    """(ball, centroid) of the balls that one centroid is left for, and (leaf, centroids left) of the other leaves that are met.

    Levels are gone through from the root, all balls of a level at once."""
    centre = c.astype(float)
    whole, leaves = [], []
    balls, left = np.array([0]), np.ones((1, len(c)), bool)
    while len(balls):
        count = tree["end"][balls] - tree["start"][balls]
        middle = tree["total"][balls] / count[:, None]
        away = np.sqrt(np.maximum((middle**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1)[None, :] - 2 * middle @ centre.T, 0))
        room = ROOM * (1 + np.abs(middle).max() + np.abs(centre).max()) * np.sqrt(x.shape[1])
        away[~left] = np.inf
        left = away <= away.min(axis=1, keepdims=True) + 2 * tree["radius"][balls][:, None] + room
        one = left.sum(axis=1) == 1
        whole += zip(balls[one].tolist(), left[one].argmax(axis=1).tolist(), strict=True)
        child = tree["left"][balls]
        leaves += [(int(b), np.flatnonzero(m)) for b, m in zip(balls[~one & (child < 0)], left[~one & (child < 0)], strict=True)]
        down = ~one & (child >= 0)
        balls, left = np.concatenate([child[down], child[down] + 1]), np.concatenate([left[down], left[down]])
    return whole, leaves


def moved(x: np.ndarray, tree: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and integer sum of the vectors nearest to each centroid."""
    count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
    whole, leaves = filtered(x, tree, c)
    for ball, k in whole:
        count[k] += tree["end"][ball] - tree["start"][ball]
        total[k] += tree["total"][ball]
    for ball, some in leaves:
        rows = x[tree["start"][ball] : tree["end"][ball]]
        near = some[squares(rows, c[some]).argmin(axis=1)]
        np.add.at(count, near, 1)
        np.add.at(total, near, rows)
    return count, total


def nearest(x: np.ndarray, tree: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of each vector, in the order of the tree."""
    near, away = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    whole, leaves = filtered(x, tree, c)
    for ball, some in [*((b, np.array([k])) for b, k in whole), *leaves]:
        own = slice(tree["start"][ball], tree["end"][ball])
        d = squares(x[own], c[some])
        best = d.argmin(axis=1)
        near[own], away[own] = some[best], d[np.arange(len(d)), best]
    return near, away


def whole_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(_id, _v array<int>): the integer vectors of the rows that count."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    some = df.select(F.col(key).alias("_id"), v.cast("array<double>").alias("_x")).where((F.size("_x") == dims) & F.forall("_x", finite))
    small = lambda x: F.when(F.abs(x) < LIMIT, x.cast("int")).otherwise(F.raise_error(F.lit(f"a component of {LIMIT} or more")).cast("int"))
    return some.select("_id", F.transform("_x", lambda x: small(F.floor(x * float(scale)))).alias("_v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def forest(vectors: DataFrame, dims: int, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """The trees of (_id, _v), one a row: ids and vectors in the order of the leaves, and the balls, as bytes."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            own, x = pa.concat_arrays(ids), np.concatenate(held)
            order, balls = build(x, leaf)
            told = [own.take(pa.array(order)).to_pylist(), x[order].astype("<i4").tobytes(), *(balls[f].astype("<f8" if f == "radius" else "<i8").tobytes() for f in FIELDS)]
            ids.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array([told[0]], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in told[1:])], ["ids", "vectors", *FIELDS])

        n = 0
        for batch in batches:
            for k in range(0, batch.num_rows, tree):
                part = batch.slice(k, tree)
                if n and n + part.num_rows > tree:
                    yield rows()
                    n = 0
                ids.append(part.column("_id").cast(pa.int64()))
                held.append(matrix(part.column("_v"), dims))
                n += part.num_rows
        if n:
            yield rows()

    return vectors.mapInArrow(grow, "ids array<long>, vectors binary, " + ", ".join(f"`{f}` binary" for f in FIELDS))


def unpacked(batch: pa.RecordBatch, row: int, dims: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    raw = lambda f, kind: np.frombuffer(batch.column(f)[row].as_buffer(), kind)
    tree = {f: raw(f, "<f8" if f == "radius" else "<i8") for f in FIELDS}
    return raw("vectors", "<i4").astype(np.int64).reshape(-1, dims), tree | {"total": tree["total"].reshape(-1, dims)}


def sums(trees: DataFrame, c: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sum by centroid; each task sends one row for each component (the count comes last) of each centroid."""
    k, dims = c.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                n, s = moved(*unpacked(batch, row, dims), c)
                count, total = count + n, total + s
        some = np.flatnonzero(count)
        every = np.concatenate([total, count[:, None]], axis=1)[some]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(some)), pa.int32()), pa.array(every.ravel())], ["cluster", "part", "total"])

    told = trees.mapInArrow(add, "cluster int, part int, total long").groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")))
    got = {(r[0], r[1]): int(r[2]) for r in told.collect()}
    return {j: (got[j, dims], [got[j, i] for i in range(dims)]) for j, part in got if part == dims}


def starts(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The first ``k`` vectors by digest of their id."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("_digest"), "_v").orderBy("_digest", "_v").limit(k).collect()
    return np.array([r._v for r in rows], np.int64)


def cluster(df: DataFrame, key: str, vector: str, dims: int, k: int, rounds: int, scale: int = 256, salt: str = "2", tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """One row a vector that counts: key, cluster, squared distance, inertia of its cluster and of all, digest of its centroid."""
    spark = df.sparkSession
    scratch = Scratch(spark, "balls")
    whole = whole_vectors(df, key, vector, dims, scale)
    c = starts(whole, k, salt)
    out = f"`{key}` long, cluster int, distance long"
    if not len(c):
        none = spark.createDataFrame([], out)
        return none.select("*", *(F.lit(None).cast("long").alias(x) for x in ("cluster_inertia", "inertia")), F.lit(None).cast("string").alias("centroid_sha256"))
    trees = scratch.keep(forest(whole, dims, tree, leaf), "trees")
    for _ in range(rounds):
        for j, (n, s) in sums(trees, c).items():
            c[j] = [x // n for x in s]  # whole numbers of any size, rounded down

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                near, away = nearest(*unpacked(batch, row, dims), c)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(row, 1).flatten(), pa.array(near), pa.array(away)], [key, "cluster", "distance"])

    told = scratch.keep(trees.mapInArrow(tell, out), "assigned")
    scratch.drop("trees")
    each = {r[0]: int(r[1]) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    every = sum(each.values())
    facts = [(j, each[j], every, hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j in each]
    # one row a centroid
    return told.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
