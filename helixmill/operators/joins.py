"""Joins: keep-first union, nearest neighbours, bands, pair comparisons, consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.statistics import value_ranges
from ..sources.tables import kept


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the first in a stated order (``dropDuplicates`` keeps any)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def union_first(frames: list[DataFrame], keys: list[str], order: list[Column | str]) -> DataFrame:
    """Union by name with missing columns; of equal keys the earlier frame's row stays. ``source_rank`` names the frame."""
    tagged = [f.withColumn("source_rank", F.lit(k)) for k, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return first_by(out, keys, ["source_rank", *order])


def membership(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds whether the keys occur in the other table."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """Keys that are missing on a side or differ by more than the tolerance."""
    right = b.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_there"))
    both = a.select(*keys, *columns, F.lit(True).alias("_here")).join(right, keys, "full_outer")
    far = F.lit(False)
    for c in columns:
        far = far | (F.abs(F.col(c) - F.col(f"_{c}")) > tolerance) | (F.col(c).isNull() != F.col(f"_{c}").isNull())
    return both.where(F.col("_here").isNull() | F.col("_there").isNull() | far).select(*keys)


#: Rows of a tile, and pivots at most; a table gets a pivot for each tile that it would fill.
TILE = 4096
PIVOTS = 256
#: Relative room for rounding in bounds of distances.
ROOM = 1e-6


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


#: Queries of a group, which one task holds, at most; and groups that a table of queries is dealt into, about.
HELD = 65_536
GROUPS = 64


def matrix(vectors: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix; a null component is not a number."""
    if not len(vectors):
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (size != size[0]).any():
        raise ValueError("vectors of one length are needed")
    return flat.reshape(len(vectors), -1)


def pivot_cells(points: DataFrame, pivots: np.ndarray | None) -> DataFrame:
    """``points`` (_k, _v, _b) with _cell, their nearest pivot, and _away, their distance from it."""
    if pivots is None:
        return points.withColumn("_cell", F.lit(0)).withColumn("_away", F.lit(0.0))

    @F.arrow_udf("struct<cell:int,away:double>")
    def home(v: pa.Array) -> pa.Array:
        x = matrix(v)
        d = [apart(x[i : i + TILE], pivots) for i in range(0, len(x), TILE)]
        cell, away = (np.concatenate([f(e, axis=1) for e in d] or [np.zeros(0)]) for f in (np.argmin, np.min))
        return pa.StructArray.from_arrays([pa.array(cell.astype("int32")), pa.array(away)], names=["cell", "away"])

    at = points.withColumn("_at", home.asNondeterministic()("_v"))
    return at.select("_k", "_v", "_b", F.col("_at.cell").alias("_cell"), F.col("_at.away").alias("_away"))


def lessened(x: np.ndarray, least: np.ndarray, y: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> None:
    """Lowers ``least``, the distances of rows of x, to those from rows of y where these are nearer; ``pairs`` (of x, of y) don't count.

    Rows of x that by the triangle inequality lie no nearer to the ball around y are passed over."""
    middle = y.mean(axis=0)
    y = y - middle
    size = (y**2).sum(axis=1)
    reach = np.sqrt(size.max())
    far = np.sqrt(((x - middle) ** 2).sum(axis=1))
    near = np.flatnonzero(far - reach - ROOM * (1 + far + reach) <= least)
    wide = np.concatenate([-2 * y, size[:, None]], axis=1).T
    for i in range(0, len(near), 256):
        rows = near[i : i + 256]
        some = x[rows] - middle
        square = np.concatenate([some, np.ones((len(rows), 1))], axis=1) @ wide
        if len(pairs[0]):
            own = np.searchsorted(rows, pairs[0])
            here = (own < len(rows)) & (rows[np.minimum(own, len(rows) - 1)] == pairs[0])
            square[own[here], pairs[1][here]] = np.inf
        j = square.argmin(axis=1)
        exact = np.sqrt(((some - y[j]) ** 2).sum(axis=1))
        least[rows] = np.minimum(least[rows], np.where(np.isfinite(square[np.arange(len(rows)), j]), exact, np.inf))


def same_keys(index: pd.Index, keys: pd.Index) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``index`` and in ``keys`` of all equal keys."""
    if index.is_unique:
        at = index.get_indexer(keys)
        return at[at >= 0], np.flatnonzero(at >= 0)
    at, _ = index.get_indexer_non_unique(keys)
    of = np.repeat(np.arange(len(keys)), np.maximum(1, pd.Series(index).groupby(index).size().reindex(keys).fillna(1).astype(int).to_numpy()))
    return at[at >= 0], of[at >= 0]


def compared(q: DataFrame, p: DataFrame, exclude_self: bool, kind: str, tasks: int) -> DataFrame:
    """(_k, _d): the least distance of each query (_s, _k, _v) from the points (_s, _rank, _k, _v) that are sent to its group.

    A task holds the queries of one group at a time and meets its points as they come, the nearest cells first."""
    own = q.select("_s", F.lit(-1.0).alias("_rank"), F.lit(-1).alias("_cell"), "_k", "_v").unionByName(p.select("_s", "_rank", "_cell", "_k", "_v"))
    laid = own.repartition(tasks, "_s").sortWithinPartitions("_s", "_rank", "_cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, keys, x, least, index = None, [], [], None, None, None

        def told() -> Iterator[pa.RecordBatch]:
            if x is not None:
                ok = np.isfinite(least)
                yield pa.RecordBatch.from_arrays([pa.chunked_array(keys).combine_chunks().filter(pa.array(ok)), pa.array(least[ok])], ["_k", "_d"])

        for batch in batches:
            s, cell = batch.column("_s"), batch.column("_cell").to_numpy()
            new = np.concatenate([[True], (cell[1:] != cell[:-1]) | pc.not_equal(s[1:], s[:-1]).to_numpy(zero_copy_only=False)]) if len(cell) else np.zeros(0, bool)
            starts = [*np.flatnonzero(new).tolist(), len(cell)]
            for a, b in zip(starts, starts[1:], strict=False):
                if (name := s[a].as_py()) != group:
                    yield from told()
                    group, held, keys, x, least, index = name, [], [], None, None, None
                y = matrix(batch.column("_v").slice(a, b - a))
                if cell[a] < 0:
                    held.append(y)
                    keys.append(batch.column("_k").slice(a, b - a))
                    continue
                if not held and x is None:
                    continue
                if x is None:
                    x, held = np.concatenate(held), []
                    least = np.full(len(x), np.inf)
                    index = pd.Index(np.concatenate([k.to_numpy(zero_copy_only=False) for k in keys])) if exclude_self else None
                good = np.flatnonzero(np.isfinite(y).all(axis=1))
                if len(good):
                    own = pd.Index(batch.column("_k").slice(a, b - a).to_numpy(zero_copy_only=False)[good]) if exclude_self else None
                    for i in range(0, len(good), 2048):  # runs that stay in a processor's cache
                        part = good[i : i + 2048]
                        pairs = same_keys(index, own[i : i + 2048]) if exclude_self else (np.zeros(0, int), np.zeros(0, int))
                        lessened(x, least, y[part], pairs)
        yield from told()

    return laid.mapInArrow(compare, f"_k {kind}, _d double")


def chained(centre: np.ndarray) -> np.ndarray:
    """Pivots in an order in which neighbours lie near each other: each next one is the nearest that is left."""
    d = apart(centre, centre)
    order, left = [0], set(range(1, len(centre)))
    while left:
        order.append(min(left, key=lambda j: (d[order[-1], j], j)))
        left.discard(order[-1])
    return centre[order]


def nearest(queries: DataFrame, points: DataFrame, key: str, vector: str, exclude_self: bool = False, block: str | None = None, pivots: int | None = None, name: str = "nn_distance") -> DataFrame:
    """(key, distance) of each query's nearest point, exactly, by cells around pivots.

    Points and queries are dealt to the nearest of some pivots among the points; a cell knows the least and the greatest distances
    from its pivot. By the triangle inequality a cell of queries needs the cells of points alone in which a point can lie as near as
    one of its own cell surely does. Neighbouring cells of queries make a group of at most ``HELD`` and one cell more, of which a
    task holds one at a time; larger cells are parted. A point is copied for each group that needs its cell: for about ``GROUPS`` groups
    at most while these are no larger than ``HELD``. The points stream past a group, the nearest cells first, and each query
    passes over the runs in which no point can lie nearer than the best so far. ``block`` compares within equal values alone (null is one
    of them). Rows without a vector are left out, points with a component that is no number, too; a query without another point has no row."""
    of = F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit("")) if block else F.lit("")
    shaped = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"), of.alias("_b"))
    kind = queries.schema[key].dataType.simpleString()
    few = pivots or max(1, min(PIVOTS, points.count() // TILE))
    good = shaped(points).where(~F.exists("_v", lambda e: F.isnull(e) | F.isnan(e) | (F.abs(e) == float("inf"))))
    chosen = good.orderBy(F.xxhash64("_k")).limit(few).collect() if few > 1 else []
    centre = chained(np.array([r["_v"] for r in chosen], float)) if len(chosen) > 1 else None
    p = kept(pivot_cells(good, centre), "cells")
    q = kept(pivot_cells(shaped(queries), centre), "queries")
    cells = lambda df, side: df.groupBy("_b", F.col("_cell").alias(f"_{side}")).agg(F.min("_away").alias(f"_{side}low"), F.max("_away").alias(f"_{side}high"), F.count(F.lit(1)).alias(f"_{side}n"))
    of_q, of_p = kept(cells(q, "q"), "of_queries"), kept(cells(p, "p"), "of_points")
    held = max(TILE, min(HELD, -(-int(of_q.agg(F.sum("_qn")).first()[0] or 0) // GROUPS)))
    before = F.coalesce(F.sum("_qn").over(Window.partitionBy("_b").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = kept(of_q.withColumn("_g", F.floor(before / held)).withColumn("_parts", F.ceil(F.col("_qn") / held).cast("int")), "groups")

    @F.pandas_udf("double")
    def between(a: pd.Series, b: pd.Series) -> pd.Series:
        if centre is None:
            return pd.Series(np.zeros(len(a)))
        return pd.Series(np.sqrt(((centre[a.to_numpy()] - centre[b.to_numpy()]) ** 2).sum(axis=1)))

    both = groups.join(of_p, "_b").withColumn("_apart", between.asNondeterministic()("_q", "_p"))
    # all queries of a cell lie within this of a point of the cell around the same pivot, and of any other cell's points
    sure = F.when(F.col("_pn") > int(exclude_self), F.col("_apart") + F.col("_qhigh") + F.col("_phigh"))
    both = both.withColumn("_sure", F.coalesce(F.min(sure).over(Window.partitionBy("_b", "_q")), F.lit(float("inf"))))
    room = ROOM * (1 + F.col("_apart") + F.col("_qhigh") + F.col("_phigh"))
    met = kept(both.where(F.col("_apart") - F.col("_qhigh") - F.col("_phigh") - room <= F.col("_sure")).select("_b", "_q", "_g", "_parts", "_p", "_apart"), "met")
    named = lambda part: F.concat_ws("|", "_g", part, "_b")
    sent = met.select("_b", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_g", "_p", "_apart").groupBy("_b", named("_part").alias("_s"), F.col("_p").alias("_cell")).agg(F.min("_apart").alias("_rank"))
    tasks = max(int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * GROUPS if held > TILE else 1)
    asked = q.join(groups.select("_b", F.col("_q").alias("_cell"), "_g", "_parts"), ["_b", "_cell"]).withColumn("_s", named(F.pmod(F.xxhash64("_k"), F.col("_parts"))))
    found = compared(asked, p.join(sent, ["_b", "_cell"]), exclude_self, kind, tasks)
    return found.groupBy(F.col("_k").alias(key)).agg(F.min("_d").alias(name))


def within_band(left: DataFrame, right: DataFrame, a: str, b: str, width: float) -> DataFrame:
    """Pairs with |a - b| <= width: the right side is dealt into cells of that width, three of which a left row meets."""
    cell = lambda c: F.floor(c / width).cast("long")
    l = left.withColumn("_cell", F.explode(F.array(*(cell(F.col(a)) + d for d in (-1, 0, 1)))))  # noqa: E741
    return l.join(right.withColumn("_cell", cell(F.col(b))), "_cell").where(F.abs(F.col(a) - F.col(b)) <= width).drop("_cell")


def band_or_nearest(left: DataFrame, grid: DataFrame, a: str, b: str, width: float, least: int, key: str) -> DataFrame:
    """Pairs within a band of each grid value; a grid value with fewer than ``least`` of them gets its nearest rows instead.

    The grid is small (a list of targets) and is checked to be; nearest rows are the ``least`` first of each grid value by
    distance and key. Tasks sort their rows and send only the nearest ones on either side of a value, so the table isn't crossed
    with the grid. ``fallback`` tells the two apart."""
    if grid.count() > GRID:
        raise ValueError(f"a grid of at most {GRID} values is needed")
    near = within_band(left, grid, a, b, width)
    full = near.groupBy(b).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(b)
    short = grid.join(full, b, "left_anti").where(F.col(b).isNotNull())
    lacking = [float(r[0]) for r in short.select(F.col(b).cast("double")).distinct().collect()]

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for up in (True, False):  # rows from the value on, and rows below it, of equal ones those with the first keys
                some = pdf.sort_values([a, key], ascending=[True, up], kind="stable").reset_index(drop=True)
                place = np.searchsorted(some[a].to_numpy(float), lacking, side="left")
                for x, p in zip(lacking, place.tolist(), strict=True):
                    yield some.iloc[p : p + least].assign(_at=x) if up else some.iloc[max(0, p - least) : p].assign(_at=x)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema)
    few = left.where(F.col(a).isNotNull()).mapInPandas(sides, f"{fields}, _at double")
    rest = few.join(F.broadcast(short), F.col("_at") == F.col(b).cast("double")).drop("_at").withColumn("_d", F.abs(F.col(a) - F.col(b)))
    rest = rest.withColumn("_r", F.row_number().over(Window.partitionBy(b).orderBy("_d", key))).where(F.col("_r") <= least).drop("_r", "_d")
    return near.join(full, b, "left_semi").withColumn("fallback", F.lit(False)).unionByName(rest.withColumn("fallback", F.lit(True)))


#: Values of a grid at most.
GRID = 1000


def rising_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum of the products of weights of pairs with x and y both smaller in the one row than in the other, by halves of x."""
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order]
    total, parts = 0, [(0, len(x))]
    while parts:
        a, b = parts.pop()
        if b - a < 2 or x[a] == x[b - 1]:
            continue
        if b - a <= 256:
            both = (x[a:b, None] < x[None, a:b]) & (y[a:b, None] < y[None, a:b])
            total += int((both * w[a:b, None] * w[None, a:b]).sum())
            continue
        cut = int(np.searchsorted(x[a:b], x[(a + b) // 2])) + a  # equal values stay together
        cut = cut if cut > a else int(np.searchsorted(x[a:b], x[a], side="right")) + a
        low = np.argsort(y[a:cut], kind="stable")
        upto = np.concatenate([[0], np.cumsum(w[a:cut][low])])
        total += int((w[cut:b] * upto[np.searchsorted(y[a:cut][low], y[cut:b])]).sum())
        parts += [(a, cut), (cut, b)]
    return total


def concordance(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Share of pairs of rows, without ties in a, that both columns put in one order, and the number of such pairs; of tables of any size.

    Equal rows are counted first. Rows are dealt into ranges of a and into ranges of b; pairs that lie apart in both are products of
    the counts of a small grid, those in one range of either are counted within it by merging, so no two rows meet.
    Rows with a null ``a`` make no pair, pairs with a null ``b`` count in the number alone; without a pair the share is null."""
    counts = kept(df.where(F.col(a).isNotNull()).groupBy(F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).agg(F.count(F.lit(1)).alias("_n")), "counts")
    square = lambda c: F.sum(c.cast("decimal(38,0)") * c.cast("decimal(38,0)"))

    def apart(rows: DataFrame) -> int:
        """Pairs of rows that differ in a."""
        one = rows.groupBy("_a").agg(F.sum("_n").alias("_n")).agg(F.sum("_n").alias("n"), square(F.col("_n")).alias("s")).first()
        return (int(one["n"] or 0) ** 2 - int(one["s"] or 0)) // 2

    both = counts.where("_b is not null")
    every, known = apart(counts), apart(both)
    dealt = kept(value_ranges(value_ranges(both, "_a", "_ra"), "_b", "_rb").select("_a", "_b", "_n", F.col("_ra").cast("int").alias("_ra"), F.col("_rb").cast("int").alias("_rb")), "dealt")
    cells = dealt.groupBy("_ra", "_rb").agg(F.sum("_n").alias("n")).collect()  # ranges squared at most
    rising = 0
    if cells:
        grid = np.zeros((max(r["_ra"] for r in cells) + 2, max(r["_rb"] for r in cells) + 2), object)
        for r in cells:
            grid[r["_ra"] + 1, r["_rb"] + 1] = int(r["n"])
        before = np.cumsum(np.cumsum(grid, axis=0), axis=1)
        rising = sum(int(r["n"]) * int(before[r["_ra"], r["_rb"]]) for r in cells)

    def count(x: str) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"n": [rising_pairs(pdf[x].to_numpy(float), pdf["_b"].to_numpy(float), pdf["_n"].to_numpy("int64"))]})

        return dealt.groupBy("_ra" if x == "_a" else "_rb").applyInPandas(run, "n long")

    rising += int(count("_a").unionByName(count("_ra")).agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0] or 0)
    return df.sparkSession.createDataFrame([(rising / known if known else None, every)], "concordance double, n_pairs long")
