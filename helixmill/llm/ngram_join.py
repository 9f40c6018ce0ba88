"""Exact Jaccard join of documents' word shingles by universe partition and the pigeonhole principle.

Equal sets form a class first; one row of each class goes on. Sizes fall into bands so that similar sets lie in one
band or two neighbours. For each such group the universe of shingles is hashed into segments: if two sets differ in
at most H shingles, and segments are worth more than H in sum, one segment differs by less than its worth. Most
segments are worth one (equal subsets meet); where the cost model of the band says so, some are worth two (a subset
also meets subsets with one shingle fewer: one-deletion neighbourhoods). Groups hold a few segments in reserve: a set
leaves out as many of its subsets, the empty ones first and then those that most sets share (a frequent line's, say).
As all sets leave them out in one order, of equal subsets one more than the reserve, the rarest is left out by neither.

What shares a subset is verified exactly on whole texts. A set has hundreds of subsets, so no subset makes up a large share of
the index, and those of a bucket stream by in order. Small buckets give all their pairs, larger ones each row's
pair with the first; what the links so found leave apart in larger buckets is compared family by family, in
square tiles of bounded size. Only links that join something new are kept.

Null or wordless texts have empty sets and link with nothing. Rows that share an id count as one document and are
joined by it (if one of their texts links); rows with a null id are linked by text alone, and a component of such
rows alone has a null id.
Repeated rows each get their row. Shingles are compared by 64-bit hashes of hashes of words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, mix64, slices
from .graph import components
from .multiset_hash import word_hashes

#: Ids of rows that have none lie above this.
NAMELESS = 1 << 60
#: Buckets up to this size give all their pairs.
SMALL = 4
#: For the cost of segments: the share of shingles that many sets hold, and rows of the index that a pair to verify is worth.
FREQUENT = 0.1
PAIR = 30
#: Rows on each side of a tile, and shingles of its texts, about.
TILE = 256
TILE_SHINGLES = 1 << 20
#: Rows that meet one other row in a task; beyond, it is copied to more tasks.
MEET = 2000
MULT = np.uint64(0x9E3779B97F4A7C15)
#: Marks of a signature: a shingle is left out; its segment is worth two; it is of the lower band. SPARE is the most that
#: is noted of a reserve.
LESS, TWICE, ROLE, SPARE = 1, 2, 4, 4000


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and where each text's begin."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    row, h = pc.list_parent_indices(lists).to_numpy()[real], word_hashes(flat)[real]
    m = len(h)
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    place = np.arange(m) - np.repeat(first, count)
    total = np.zeros(m, np.uint64)
    for k in range(words):
        shifted = np.zeros(m, np.uint64)
        left = max(0, m - k)
        shifted[:left] = np.where(row[k:] == row[:left], h[k:], np.uint64(0)) if k else h
        total = total * MULT + shifted
    size = np.maximum(count - words + 1, np.minimum(count, 1))
    use = place < np.repeat(size, count)
    row, total = row[use], mix64(total[use])
    order = np.lexsort((total, row))
    row, total = row[order], total[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
    row, total = row[new], total[new]
    return total, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


@dataclass(frozen=True)
class Group:
    """Segments of a band and its upper neighbour; the first ``double`` of them are worth two."""

    segments: int
    double: int
    reserve: int


class Plan:
    """Bands and groups for a similarity of ``percent`` in a hundred."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]
        self.groups: list[Group | None] = []

    def grow(self, size: int) -> None:
        while self.lows[-1] <= size:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        while len(self.groups) < len(self.lows) - 1:
            self.groups.append(self.allocate(len(self.groups)))

    def allocate(self, band: int) -> Group | None:
        """The cheapest worths: rows of the index, and pairs to verify as all shingles of a subset are frequent ones."""
        low, top = self.lows[band], self.lows[band + 1] - 1
        total = top + top * 100 // self.percent
        differ = total * (100 - self.percent) // (100 + self.percent)
        if not differ:
            return None
        best, least = None, math.inf
        for double in range(0, min((differ + 2) // 2, 64) + 1):
            need = max(0, differ + 1 - 2 * double)
            reserve = -(-need // 5) + 1 if need else max(0, 2 * double - differ - 1)
            single = need + (reserve if need else 0)
            m = single + double
            mean = (low + top) / 2 / m
            empty, plain = math.exp(-mean), math.exp(-mean * (1 - FREQUENT))
            by_chance = max(0.0, single * plain - reserve) + double * plain * (1 + mean)
            cost = single * (1 - empty) + double * (1 + mean) + PAIR * by_chance
            if cost < least:
                best, least = Group(m, double, reserve), cost
        return best

    def signatures(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, signature, marks) of all sets. Marks: LESS, TWICE, ROLE, and what is left of the reserve above them."""
        size = np.diff(starts)
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int16)
        if not len(flat):
            return none
        self.grow(int(size.max()))
        band = np.searchsorted(self.lows, size, side="right") - 1
        row_of, weight = np.repeat(np.arange(len(size)), size), mix64(flat + np.uint64(77))
        rows, sigs, marks = [], [], []
        for role in (0, 1):
            group = band - role
            has = np.array([g >= 0 and n > 0 and self.groups[g] is not None for g, n in zip(group, size, strict=True)])
            own = [self.groups[g] if ok else Group(0, 0, 0) for g, ok in zip(group, has, strict=True)]
            m, double, reserve = (np.array([getattr(g, f) for g in own], np.int64) for f in ("segments", "double", "reserve"))
            base = np.concatenate([[0], np.cumsum(m)])
            if not base[-1]:
                continue
            ok = has[row_of]
            r, f, w = row_of[ok], flat[ok], weight[ok]
            cell = base[r] + (mix64(f ^ mix64(group[r].astype(np.uint64) + np.uint64(1))) % m[r].astype(np.uint64)).astype(np.int64)
            sums, count = np.zeros(base[-1], np.uint64), np.bincount(cell, minlength=base[-1])
            np.add.at(sums, cell, w)
            cell_row = np.repeat(np.arange(len(size)), m)
            segment = np.arange(base[-1]) - base[cell_row]
            domain = mix64((group[cell_row].astype(np.uint64) << np.uint64(32)) + segment.astype(np.uint64) + np.uint64(1))
            twice = segment < double[cell_row]
            empty = (count == 0) & ~twice
            # empty subsets are left out in the order of their segments, as many as the reserve allows
            before = np.concatenate([[0], np.cumsum(empty)])
            nth = before[:-1] - before[base[cell_row]]
            keep = ~(empty & (nth < reserve[cell_row]))
            left = np.clip(reserve - np.bincount(cell_row[empty], minlength=len(size)), 0, SPARE)
            rows.append(cell_row[keep])
            sigs.append(mix64(sums[keep] * MULT ^ domain[keep]))
            marks.append((TWICE * twice[keep] + ROLE * role + (left[cell_row[keep]] << 3)).astype(np.int16))
            d = twice[cell]
            if d.any():
                rows.append(r[d])
                sigs.append(mix64((sums[cell[d]] - w[d]) * MULT ^ domain[cell[d]]))
                marks.append(np.full(int(d.sum()), LESS + TWICE + ROLE * role, np.int16))
        return (np.concatenate(rows), np.concatenate(sigs), np.concatenate(marks)) if rows else none


def set_table(rows: DataFrame, words: int) -> DataFrame:
    """(node, n_shingles, k1, k2): sizes and keys of sets."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            flat, starts = shingle_sets(batch.column("text"), words)
            n = batch.num_rows
            size = np.diff(starts)
            one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            row = np.repeat(np.arange(n), size)
            np.add.at(one, row, mix64(flat + np.uint64(1)))
            np.add.at(two, row, mix64(flat ^ MULT))
            one, two = mix64(one + size.astype(np.uint64)), mix64(two ^ one)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["node", "n_shingles", "k1", "k2"])

    return rows.mapInArrow(walk, "node long, n_shingles long, k1 long, k2 long")


def signature_table(texts: DataFrame, words: int, plan: Plan) -> DataFrame:
    """(sig, marks, node) of all texts. They outweigh texts, so none is stored."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            r, s, d = plan.signatures(*shingle_sets(batch.column("text"), words))
            node = batch.column("node").to_numpy()[r]
            for k in range(0, len(r), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 18)]) for x in (s.view(np.int64), d, node)], ["sig", "marks", "node"])

    return texts.select("node", "text").mapInArrow(walk, "sig long, marks short, node long")


def members(signatures: DataFrame) -> DataFrame:
    """(sig, marks, node) of the signatures that more than one row has.

    Rows stream by in the order of signatures, so a large bucket is never held."""
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["sig", "marks", "node"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, joined = None, False  # the last row waits for the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in names]
            if last:
                cols = [np.concatenate([a, b]) for a, b in zip(last, cols, strict=True)]
            same = np.zeros(len(cols[0]), bool)
            same[1:] = cols[0][1:] == cols[0][:-1]
            same[0] = joined
            keep = same.copy()
            keep[:-1] |= same[1:]
            last, joined = [x[-1:] for x in cols], bool(same[-1])
            keep[-1] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], names)
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names)

    rows = signatures.repartition(n, "sig").sortWithinPartitions("sig", "node")
    return rows.mapInArrow(runs, "sig long, marks short, node long")


def buckets(rows: DataFrame) -> DataFrame:
    """(sig, hub, node, less) of rows that share a signature; the hub is the bucket's first whole subset.

    Each set leaves out those of its signatures that most rows share, as far as its reserve goes."""
    marks = F.col("marks").cast("int")
    rows = rows.withColumn("less", marks.bitwiseAND(F.lit(LESS))).withColumn("role", marks.bitwiseAND(F.lit(ROLE))).withColumn("spare", F.when(marks.bitwiseAND(F.lit(TWICE)) == 0, F.shiftright(marks, 3)).otherwise(0))
    size = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    wide = rows.join(size, "sig")
    order = Window.partitionBy("node", "role", F.col("spare") > 0).orderBy(F.desc("n"), "sig")
    kept = wide.withColumn("_r", F.row_number().over(order)).where((F.col("n") < SMALL) | (F.col("_r") > F.col("spare"))).select("sig", "node", "less")
    hubs = kept.groupBy("sig").agg(F.min(F.struct("less", "node")).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1 and h.less = 0").select("sig", F.col("h.node").alias("hub"))
    return kept.join(hubs, "sig").where("node <> hub").select("sig", "hub", "node", "less")


def small_pairs(links: DataFrame) -> DataFrame:
    """(a, b) candidates: each row with its hub, and all pairs of small buckets."""
    star = links.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    few = links.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, SMALL - 1)).select("sig")
    one = links.join(few, "sig").select("sig", "node", "less")
    two = one.select("sig", F.col("node").alias("node2"), F.col("less").alias("less2"))
    rest = one.join(two, "sig").where("node < node2 and less + less2 < 2").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    return star.unionByName(rest).distinct()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum()) * (100 + percent) >= percent * (len(a) + len(b))


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A row that meets many others is copied to several tasks."""
    spark = pairs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("copies"))
    heads = size.select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt")).hint("shuffle_hash").join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"), "text")
    rest = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"), F.lit(1).alias("side"), "b").hint("shuffle_hash").join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "side", "b", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for batch in slices(batches, "text"):
            flat, starts = shingle_sets(batch.column("text"), words)
            side, salt, a, b = (batch.column(c).to_numpy() for c in ("side", "salt", "a", "b"))
            good = []
            for i in range(len(side)):
                own = flat[starts[i] : starts[i + 1]]
                if now != (a[i], salt[i]):
                    now, heads = (a[i], salt[i]), []
                if not side[i]:  # rows that share an id are heads together
                    heads.append(own)
                elif any(similar(head, own, percent) for head in heads):
                    good.append(i)
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    rows = heads.unionByName(rest).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "side")
    return rows.mapInArrow(walk, "a long, b long")


def forest(links: np.ndarray) -> np.ndarray:
    """The links (rows of two positions) that join something new."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for i, (x, y) in enumerate(links.tolist()):
        a, b = root(x), root(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(i)
    return links[kept]


def tile_links(flat: np.ndarray, starts: np.ndarray, percent: int, columns: int = 4096) -> np.ndarray:
    """All similar pairs of sets in a tile, by products of their incidence with shared shingles."""
    size = np.diff(starts)
    row = np.repeat(np.arange(len(size)), size)
    value, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    new = np.cumsum(shared) - 1
    use = shared[code]
    row, code = row[use], new[code[use]]
    both = np.zeros((len(size), len(size)), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for k in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(code, [k, k + columns])
        part = np.zeros((len(size), columns), np.float32)
        part[row[a:b], code[a:b] - k] = 1
        both += part @ part.T
    total = size[:, None] + size[None, :]
    return np.argwhere(np.triu(both * (100 + percent) >= percent * total - 0.5, 1) & (np.minimum(size[:, None], size[None, :]) > 0))


def families(links: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, node) of larger buckets that the links so far leave apart: a family where that costs less than its buckets."""
    wide = links.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("hub").alias("hub")).where(F.col("n") >= SMALL)
    member = links.join(wide.select("sig"), "sig").select("sig", "node").unionByName(wide.select("sig", F.col("hub").alias("node"))).distinct()
    member = scratch.keep(member, "wide")
    member = scratch.keep(member.join(labels, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("label")), "labelled")
    apart = member.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("x <> y").select("sig", "n", "first")
    member = scratch.keep(member.select("sig", "node").join(apart, "sig"), "apart")
    family = scratch.keep(components(member.select(F.col("node").alias("a"), F.col("first").alias("b")), scratch, "families"), "family")
    cost = family.groupBy("component").agg(F.pow(F.count(F.lit(1)).cast("double"), 2).alias("whole"))
    each = member.select("sig", "n", F.col("first").alias("node")).distinct().join(family, "node").groupBy("component").agg(F.sum(F.pow(F.col("n").cast("double"), 2)).alias("parts"))
    whole = cost.join(each, "component").select("component", (F.col("whole") <= F.col("parts")).alias("as_one"))
    chosen = family.join(whole, "component").select("node", "component", "as_one")
    one = chosen.where("as_one").select(F.col("component").alias("block"), "node")
    parts = member.join(chosen.where("not as_one"), "node").select(F.col("sig").alias("block"), "node")
    return one.unionByName(parts)


def tiled(blocks: DataFrame, sizes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) within blocks: each pair of tiles of a block is a group of about twice ``TILE`` rows or ``TILE_SHINGLES``."""
    count = blocks.join(sizes, "node").groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("tiles"))
    # dealt out by a hash: groups stay near TILE rows whatever the ids
    dealt = blocks.join(count, "block").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    keyed = dealt.select("block", "node", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("own")).alias("i"), F.greatest(t, F.col("own")).alias("j")))).alias("k"))
    rows = keyed.select("block", "k.i", "k.j", "node").hint("shuffle_hash").join(texts, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        flat, starts = shingle_sets(pa.array(pdf["text"], pa.string()), words)
        node = pdf["node"].to_numpy()
        got = forest(tile_links(flat, starts, percent))
        return pd.DataFrame({"a": node[got[:, 0]], "b": node[got[:, 1]]})

    return rows.groupBy("block", "i", "j").applyInPandas(compare, "a long, b long")


def nodes(docs: DataFrame) -> DataFrame:
    """(node, text): the id, or a hash of the text above all ids where there is none."""
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("text"), 5)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("node"), "text")


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "ngram")
    rows = nodes(docs)
    sets = scratch.keep(set_table(rows, words), "sets")
    classes = scratch.keep(sets.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("node").alias("rep")), "classes")
    member = scratch.keep(sets.select("node", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left").select("node", "n_shingles", "rep"), "member")
    reps = classes.select(F.col("rep").alias("node")).distinct()
    texts = scratch.keep(rows.join(reps.hint("shuffle_hash"), "node", "left_semi"), "texts")
    scratch.drop("sets", "classes")
    shared = scratch.keep(members(signature_table(texts, words, Plan(percent))), "members")
    links = scratch.keep(buckets(shared), "links")
    scratch.drop("members")
    first = scratch.keep(verified(small_pairs(links), texts, words, percent), "first")
    blocks = scratch.keep(families(links, components(first, scratch, "first_components"), scratch), "blocks")
    sizes = member.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"))
    second = scratch.keep(tiled(blocks, sizes, texts, words, percent), "second")
    scratch.drop("texts", "links", "blocks", "apart", "wide", "labelled", "family")
    # an id in several classes joins them
    several = member.where("rep is not null").groupBy("node").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    bridges = member.join(several, "node").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    labels = components(first.unionByName(second).unionByName(bridges), scratch, "components")
    scratch.drop("first", "second")
    out = member.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = lambda c: F.when(c < NAMELESS, c)
    return out.select(named(F.col("node")).alias("doc_id"), "n_shingles", named(F.coalesce("component", "rep", "node")).alias("component_id"))
