"""Non-dominated fronts, crowding and greedy selections, per block (a target's candidates) of any size.

Fronts go through ranges of a block in lexical order. The first front alone is found by ``skyline``, which compares within
salted parts before it compares what they leave."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import kept
from .folds import numbered

#: Different rows of a range of fronts, about.
STEP = 50_000
#: Rows that a round of a cover sends of all blocks at most.
AHEAD_ROWS = 20_000


def front_numbers(x: np.ndarray) -> np.ndarray:
    """Front (0 is best) of each row of objectives, all of which are minimised; equal rows share one."""
    if not len(x):
        return np.zeros(0, np.int64)
    rows, which = np.unique(x, axis=0, return_inverse=True)
    return range_fronts(rows)[0][which.reshape(-1)]


def range_fronts(x: np.ndarray, before: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Front (0 is best) of each row of objectives, all minimised, of different rows in lexical order; and what later rows need.

    In lexical order a row is beaten only by rows before it, by those that are as small in all objectives but the first. Of each
    front only its rows that are smallest in those matter, so ``before`` and the second result hold these alone, by front.
    Fronts of two objectives have one such value, and it ascends; with more, a row of a front is beaten by rows of all fronts
    before, so the first front that doesn't beat it is found by bisection, too."""
    rest = x[:, 1:]
    number = np.zeros(len(x), np.int64)
    if x.shape[1] == 2:
        least = [float(m[0, 0]) for m in before or []]
        for i, y in enumerate(rest[:, 0].tolist()):
            k = bisect_right(least, y)
            if k == len(least):
                least.append(y)
            least[k] = y
            number[i] = k
        return number, [np.array([[y]]) for y in least]
    stacked = list(before or [])
    for i, row in enumerate(rest):
        low, high = 0, len(stacked)
        while low < high:
            k = (low + high) // 2
            low, high = (k + 1, high) if (stacked[k] <= row).all(axis=1).any() else (low, k)
        if low == len(stacked):
            stacked.append(np.zeros((0, rest.shape[1])))
        kept = stacked[low][~(row <= stacked[low]).all(axis=1)]
        stacked[low] = np.concatenate([kept, row[None]])
        number[i] = low
    return number, stacked


def fronts(df: DataFrame, block: str, objectives: list[str], name: str = "pareto_rank", step: int = STEP) -> DataFrame:
    """Adds the front of each row within its block; rows with a missing objective have none. Blocks may be of any size.

    Different rows are dealt into ranges of about ``step`` by block and lexical order of their objectives. A round works out one
    range of every block, given the fronts' smallest values of the ranges before, which is all that a later range needs; tasks
    hold a range and those values. Blocks of fewer rows take one round or two; a large block as many as it has ranges."""
    if not 1 < len(objectives):
        raise ValueError("fronts need two objectives or more")
    points = df.dropna(subset=objectives).select(F.col(block).alias("_block"), *(F.col(o).cast("double").alias(f"_o{i}") for i, o in enumerate(objectives))).distinct()
    own = [f"_o{i}" for i in range(len(objectives))]
    points = kept(points, "points")
    ranges = max(1, -(-points.count() // step))
    laid = kept(points.repartitionByRange(ranges, "_block", *own).withColumn("_part", F.spark_partition_id()), "ranges")
    order = laid.select("_block", "_part").distinct().select(F.col("_block").alias("_b"), F.col("_part").alias("_p"), F.row_number().over(Window.partitionBy("_block").orderBy("_part")).alias("_round"))
    laid = laid.join(order, F.col("_block").eqNullSafe(F.col("_b")) & (F.col("_part") == F.col("_p"))).select("_block", *own, "_round")
    laid = kept(laid, "rounds", by=["_round"])
    rounds = laid.agg(F.max("_round")).first()[0] or 0
    kind = laid.schema["_block"].dataType.simpleString()
    fields = f"_block {kind}, {', '.join(f'{o} double' for o in own)}, _rank int, _later boolean"

    def run(rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        x = rows[own].to_numpy(float)
        x = x[np.lexsort(x.T[::-1])]
        told = state.sort_values("_rank", kind="stable")
        before = [m.to_numpy(float) for _, m in told[own[1:]].groupby(told["_rank"].to_numpy())]
        number, after = range_fronts(x, before)
        if not len(x):
            x, number, after = np.zeros((0, len(own))), number, before
        late = np.concatenate([np.zeros((0, len(own) - 1)), *after])
        out = pd.DataFrame(np.concatenate([x, np.concatenate([np.zeros((len(late), 1)), late], axis=1)]), columns=own)
        ranks = np.concatenate([number, np.repeat(np.arange(len(after)), [len(m) for m in after])]).astype("int32")
        first = (rows if len(rows) else state)["_block"].iloc[0]
        return out.assign(_block=first, _rank=ranks, _later=np.arange(len(out)) >= len(x))[["_block", *own, "_rank", "_later"]]

    state = df.sparkSession.createDataFrame([], fields)
    done = None
    for r in range(1, rounds + 1):
        rows = laid.where(F.col("_round") == r).select("_block", *own)
        both = rows.groupBy("_block").cogroup(state.where("_later").groupBy("_block")).applyInPandas(run, fields)
        state = kept(both, "fronts")
        ranked = state.where("not _later").drop("_later")
        done = ranked if done is None else done.unionByName(ranked)
    same = F.col(block).eqNullSafe(F.col("_block"))
    for o, c in zip(objectives, own, strict=True):
        same = same & (F.col(o).cast("double") == F.col(c))
    if done is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.join(done, same, "left").drop("_block", *own).withColumnRenamed("_rank", name)


def skyline(df: DataFrame, block: str, key: str, objectives: list[str], parts: int = 16) -> DataFrame:
    """The rows of the first front of each block: what no row of its part beats, then what none of those beats."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[objectives].to_numpy(float)
        order = np.lexsort(x.T[::-1])
        kept: list[int] = []
        for i in order:  # a row can only be beaten by one before it
            k = x[kept]
            if not len(kept) or not ((k <= x[i]).all(axis=1) & (k < x[i]).any(axis=1)).any():
                kept.append(int(i))
        return pdf.iloc[sorted(kept)]

    good = df.dropna(subset=objectives)
    salted = good.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in salted.schema)
    local = salted.groupBy(block, "_part").applyInPandas(run, fields)
    return local.groupBy(block).applyInPandas(run, fields).drop("_part")


def crowding(df: DataFrame, keys: list[str], objectives: list[str], key: str, name: str = "crowding_distance") -> DataFrame:
    """Adds the sum over objectives of the neighbours' gap over the range; infinite at the ends and in fronts of two."""
    total, edge = F.lit(0.0), F.lit(False)
    own = Window.partitionBy(*keys)
    for o in objectives:
        w = own.orderBy(o, key)
        gap = F.lead(o).over(w) - F.lag(o).over(w)
        span = F.max(o).over(own) - F.min(o).over(own)
        edge = edge | F.lead(o).over(w).isNull() | F.lag(o).over(w).isNull()
        total = total + F.when(span > 0, F.coalesce(gap, F.lit(0.0)) / span).otherwise(0.0)
    small = F.count(F.lit(1)).over(own) <= 2
    return df.withColumn(name, F.when(small | edge, F.lit(float("inf"))).otherwise(total))


def pareto_order(df: DataFrame, block: str, error: str, key: str, name: str = "pareto_position") -> DataFrame:
    """Adds 1, 2, ... within the block by front, crowding (the widest first), error and key; no window holds more than a front."""
    parted = df.withColumn("_front", F.col("pareto_rank"))
    return numbered(parted, [block], [F.desc("crowding_distance"), error, key], name, "_front").withColumn(name, F.col(name).cast("int"))


#: Blocks of a selection at most: the driver holds what is chosen of each.
BLOCKS = 10_000
#: Rows of a block that a round of a diverse choice looks at, and anchors of a cover after which distances are written.
AHEAD = 64
REFRESH = 4096
#: Times ``AHEAD`` rows of a block that a round of a cover sends at most.
MORE = 64


def selectable(df: DataFrame, block: str) -> None:
    if df.select(block).distinct().limit(BLOCKS + 1).count() > BLOCKS:
        raise ValueError(f"a selection is made of at most {BLOCKS} blocks")


def least_distance(x: np.ndarray, chosen: list) -> np.ndarray:
    """Distance of each row from the nearest chosen vector; infinite where none is.

    Products tell which chosen vectors can be the nearest one; the distances from these are worked out by differences."""
    out = np.full(len(x), np.inf)
    if not len(chosen) or not len(x):
        return out
    if len(chosen) < 16:
        for c in chosen:
            out = np.minimum(out, np.sqrt(((x - np.asarray(c, float)) ** 2).sum(axis=1)))
        return out
    every = np.asarray(chosen, float)
    for k in range(0, len(every), 1024):
        c = every[k : k + 1024]
        size = (c**2).sum(axis=1)
        for a in range(0, len(x), 512):
            some = x[a : a + 512]
            square = (some**2).sum(axis=1)[:, None] + size[None, :] - 2 * some @ c.T
            room = 1e-9 * (1 + (some**2).sum(axis=1) + size.max())
            i, j = np.nonzero(square <= np.minimum(square.min(axis=1), out[a : a + 512] ** 2)[:, None] + room[:, None])
            np.minimum.at(out, a + i, np.sqrt(((some[i] - c[j]) ** 2).sum(axis=1)))
    return out


def near_chosen(pdf: pd.DataFrame, chosen: dict) -> np.ndarray:
    """Distance of each row (_b, _v) from the nearest chosen vector of its block."""
    out = np.full(len(pdf), np.inf)
    for b, places in pdf.groupby("_b", dropna=False).indices.items():
        some = chosen.get(None if pd.isna(b) else b, [])
        if some:
            out[places] = least_distance(np.stack(pdf["_v"].iloc[places].to_numpy()).astype(float), some)
    return out


def diverse(df: DataFrame, block: str, key: str, vector: str, order: list[str], least: float, most: int) -> DataFrame:
    """Greedy choice per block in a stated order (ties by key): a row stays if it is at least so far from all that stay; ``pick`` from 1.

    A round gathers, of each block, the first ``AHEAD`` rows that are far enough from all that is chosen; tasks send their own
    first ones. The choice goes through them in order: rows that it passes over are too near to a chosen one, so nothing is
    missed, and the next round begins after them. A block of any size is done in ``most`` rounds at the latest, mostly in one."""
    selectable(df, block)
    names = [f"_o{i}" for i in range(len(order))]
    rows = kept(df.where(F.col(vector).isNotNull()).select(F.col(block).alias("_b"), F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"), *(F.col(o).alias(n) for o, n in zip(order, names, strict=True))), "choice")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    by = [F.col(c).asc_nulls_last() for c in (*names, "_k")]
    chosen: dict = {}
    picks: list[tuple] = []
    open_ = None

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = pdf[near_chosen(pdf, chosen) >= least]
            if open_ is not None:
                good = good[np.array([(None if pd.isna(b) else b) in open_ for b in good["_b"]], bool)]
            yield good.sort_values([*names, "_k"], kind="stable").groupby("_b", dropna=False, sort=False).head(AHEAD)

    while open_ is None or open_:
        head = rows.mapInPandas(far, fields).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(*by))).where(F.col("_r") <= AHEAD)
        got: dict = {}
        for r in head.orderBy("_r").collect():
            got.setdefault(r["_b"], []).append(r)
        open_ = set()
        for b, some in got.items():
            own = chosen.setdefault(b, [])
            for r in some:
                if len(own) < most and (not own or least_distance(np.array([r["_v"]], float), own)[0] >= least):
                    own.append(r["_v"])
                    picks.append((b, r["_k"], len(own)))
            if len(own) < most and len(some) == AHEAD:
                open_.add(b)
    kinds = f"`{block}` {df.schema[block].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, pick int"
    return df.sparkSession.createDataFrame(picks, kinds)


def cover(df: DataFrame, block: str, key: str, vector: str, weight: str, radius: str) -> DataFrame:
    """Farthest-point anchors per block from the heaviest row on (ties by key), until each row lies within the heaviest row's radius.

    An anchor is the row farthest from the anchors so far (ties: the heaviest, then by key). A round is one job for all blocks at once,
    in which tasks send their farthest rows, ``MORE`` times ``AHEAD`` of a block at most; anchors are taken from them as long as no row that wasn't
    sent can lie farther. Only anchors are sent out; distances are written every ``REFRESH`` anchors, so a round looks at the anchors
    since. Blocks may be of any size."""
    selectable(df, block)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(block).alias("_b"), F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"), F.col(weight).cast("double").alias("_w"), F.col(radius).cast("double").alias("_radius"))
    rows = kept(rows.withColumn("_near", F.lit(float("inf"))), "cover")
    first = rows.groupBy("_b").agg(F.min_by(F.struct("_k", "_v", "_w", "_radius"), F.struct(-F.col("_w"), F.col("_k"))).alias("x")).collect()
    recent = {r["_b"]: [r["x"]["_v"]] for r in first}
    limit = {r["_b"]: max(float(r["x"]["_radius"]), 1e-12) for r in first}
    picks = [(r["_b"], r["x"]["_k"], r["x"]["_w"], 1) for r in first]
    count = {r["_b"]: 1 for r in first}
    taken = {(r["_b"], r["x"]["_k"]) for r in first}
    open_ = set(limit)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def nearer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_near=np.minimum(pdf["_near"].to_numpy(float), near_chosen(pdf, recent)))

    ahead = max(1, min(MORE * AHEAD, AHEAD_ROWS // max(1, len(limit))))

    def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in nearer(batches):
            best = pdf if best is None else pd.concat([best, pdf], ignore_index=True)
            best = best.sort_values(["_near", "_w", "_k"], ascending=[False, False, True], kind="stable").groupby("_b", dropna=False, sort=False).head(ahead)
        if best is not None:
            yield best

    def place(x: Row, near: float) -> tuple:
        return -near, x["_w"] is not None, -(x["_w"] or 0.0), x["_k"] is not None, x["_k"]

    order = Window.partitionBy("_b").orderBy(F.desc("_near"), F.col("_w").desc_nulls_first(), "_k")
    while open_:
        sent = rows.mapInPandas(farthest, fields).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= ahead).collect()  # AHEAD_ROWS at most
        if sum(map(len, recent.values())) >= REFRESH:
            rows = kept(rows.mapInPandas(nearer, fields), "cover")
            recent = {}
        lists: dict = {b: [] for b in open_}
        for x in sent:
            if x["_b"] in lists:
                lists[x["_b"]].append(x)
        for b, some in lists.items():
            # rows that weren't sent lie behind the last one, and distances only fall
            last = max(place(x, x["_near"]) for x in some) if len(some) == ahead else None
            some.sort(key=lambda x: place(x, 0.0))
            vectors = np.array([x["_v"] for x in some], float)
            near = np.array([x["_near"] for x in some])
            while True:
                i = int(near.argmax())  # of equally far rows the first
                x = some[i]
                if last is not None and place(x, near[i]) > last and -last[0] > limit[b]:
                    break
                if near[i] <= limit[b] or (b, x["_k"]) in taken:
                    open_.discard(b)
                    break
                taken.add((b, x["_k"]))
                recent.setdefault(b, []).append(x["_v"])
                count[b] += 1
                picks.append((b, x["_k"], x["_w"], count[b]))
                near = np.minimum(near, least_distance(vectors, [x["_v"]]))
    kinds = f"`{block}` {df.schema[block].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, `{weight}` double, anchor_rank int"
    return df.sparkSession.createDataFrame(picks, kinds)


def final_selection(pools: list[DataFrame], known: DataFrame, target: str, sequence: str, objectives: list[str], vector: str, supported: str, least: float, most: int) -> tuple[DataFrame, DataFrame]:
    """The final report of each target, and its summary.

    Of the pools' sequences, of which an earlier pool's row stays, those that are supported and not ``known`` are the novel ones.
    Their first front, in the order of crowding (the widest first), the first objective and the sequence, is thinned to ``most`` rows that
    lie ``least`` apart, and ranked by the objectives. The summary has a row for each target of the pools: its status, the numbers
    of novel rows, of the first front, of reported rows and of known ones that were left out, and the best reported sequence."""
    from .joins import union_first

    one = union_first(pools, [target, sequence], [*objectives, sequence]).where(F.col(target).isNotNull() & F.col(sequence).isNotNull())
    flagged = one.join(known.select(sequence).distinct().withColumn("_known", F.lit(True)), sequence, "left")
    flagged = kept(flagged.withColumn("is_exact_training_sequence", F.coalesce("_known", F.lit(False))).drop("_known"), "pool")
    good = flagged.where(F.col(supported))
    ranked = kept(fronts(good.where(~F.col("is_exact_training_sequence")), target, objectives), "novel")
    front = crowding(ranked.where("pareto_rank = 0"), [target], objectives, sequence).withColumn("_wide", -F.col("crowding_distance"))
    front = kept(front, "front")
    picks = diverse(front, target, sequence, vector, ["_wide", objectives[0]], least, most)
    chosen = front.drop("_wide").join(picks, [target, sequence])
    order = Window.partitionBy(target).orderBy(*objectives, sequence)  # ``most`` rows a target
    final = kept(chosen.withColumn("final_report_rank", F.row_number().over(order)), "final")
    count = lambda df, name: df.groupBy(target).agg(F.count(F.lit(1)).alias(name))
    best = final.where("final_report_rank = 1").select(target, F.col(sequence).alias("best_sequence"), *(F.col(o).alias(f"best_{o}") for o in objectives))
    summary = flagged.select(target).distinct()
    for part in (count(ranked, "supported_novel_pool_n"), count(front, "pareto_front_n"), count(final, "n_final"), count(good.where("is_exact_training_sequence"), "exact_training_removed"), best):
        summary = summary.join(part, target, "left")
    numbers = ["supported_novel_pool_n", "pareto_front_n", "n_final", "exact_training_removed"]
    summary = summary.fillna(0, numbers)
    status = F.when(F.col("supported_novel_pool_n") > 0, "candidate_available").otherwise("no_supported_novel_candidate")
    return final, summary.select(target, status.alias("status"), *numbers, "best_sequence", *(f"best_{o}" for o in objectives))
