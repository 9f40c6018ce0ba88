"""Phrase collocations by language: candidates from sketches, exact counts from automata, thresholds and containment on Spark.

1. Sketches. Words and word pairs, and then runs of three to five words all of whose pairs may be frequent, are counted in
   ``CELLS`` hashed cells. A cell's total bounds what falls into it from above, so a run whose cell is below the threshold is no
   candidate. Cells that reach it become a bitmap of fixed size (CELLS / 8 bytes), which tasks get. More text than cells makes
   the bound looser and the candidates more, never the result other.
2. Candidates. A task takes up its texts in parts of ``PART`` bytes. The candidates of a part are its runs that pass and all of
   whose inner runs do; it tells runs apart by hashes of 64 bits. A run passes in all parts or in none.
3. Counts. A part's candidates compile into automata for each language, of ``PATTERNS`` at most, whose patterns begin and end with
   a delimiter, so only whole words match. They scan the part, pieces apart, and count all matches, overlaps included; counts
   of equal phrases are summed by shares of the hashes. So texts are scanned once, however many candidates a corpus has.
4. Thresholds, cuts, containment and ranks are joins and aggregates on the counted phrases.

Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and those into words at blanks and tabs. Null texts count
as empty, a null lang as ``und``; texts count whole and every row counts, repeated ones too. Equal scores are put in order by
count and then phrase. Empty tables give an empty result. Only the columns lang and text are read, so no other name can clash."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, mix64, powers, slices

#: Cells of a sketch: a power of two, at least 2**15.
CELLS = 1 << 27
#: Phrases of an automaton at most.
PATTERNS = 250_000
LONGEST = 5
#: Cells that a row holds counts of (their places there take 16 bits), and shares of the hashes that phrases are summed by.
WIDE = 1 << 15
SHARES = 1024
#: Cells that a task holds before it counts and sends them, bytes of text that are hashed at once, and those that are scanned for the same candidates.
HELD = 1 << 21
BLOCK = 1 << 20
PART = 1 << 24
#: Parts that a language's phrases are dealt into for their order.
PARTS = 32

KIND = np.ones(256, np.uint8)
KIND[[9, 32]] = 0
KIND[[*b".,;:!?", *range(10, 14)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Blanks, and one line end for all that ends a piece.
PLAIN = bytes(10 if k == 2 else 32 if k == 0 else int(c) for k, c in zip(KIND, LOWER, strict=True))


def joined(texts: pa.Array) -> np.ndarray:
    """Bytes of some texts, each ended by a line end."""
    return np.frombuffer(b"\n".join([*pc.fill_null(texts, "").cast(pa.binary()).to_pylist(), b""]), np.uint8)


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, piece number, first and last-but-one byte of each word, in blocks that end between words."""
    parts: list[tuple[np.ndarray, ...]] = []
    at, pieces = 0, 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        while end < len(raw) and KIND[raw[end]] == 1 and KIND[raw[end - 1]] == 1:  # not inside a word
            gap = np.flatnonzero(KIND[raw[end : end + BLOCK]] != 1)
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(raw))
        own = raw[at:end]
        kind = KIND[own]
        word = kind == 1
        first = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
        last = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
        if len(first):
            size = last - first
            inside = np.flatnonzero(word)
            place = inside - np.repeat(first, size)
            power = powers(int(size.max()) + 1)
            h = np.add.reduceat((LOWER[own[inside]].astype(np.uint64) + np.uint64(1)) * power[place], np.concatenate([[0], np.cumsum(size)[:-1]]))
            ends = np.cumsum(kind == 2)
            parts.append((mix64(h), ends[first] + pieces, first + at, last + at))
        pieces += int((kind == 2).sum())
        at = end
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate([p[i] for p in (none, *parts)]) for i in range(4))


def salts(langs: pa.Array) -> np.ndarray:
    codes = langs.dictionary_encode()
    own = np.array([zlib.crc32(x.encode()) + (len(x) << 32) for x in codes.dictionary.to_pylist()], np.uint64)
    return mix64(own)[codes.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.uint64)


class Runs:
    """Cells of the runs of one to five words of some texts, by their first word."""

    def __init__(self, texts: pa.Array, langs: pa.Array, cells: int):
        self.raw = joined(texts)
        self.hash, self.piece, self.first, self.last = words(self.raw)
        row_ends = np.cumsum(pc.binary_length(pc.fill_null(texts, "").cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        self.row = np.searchsorted(row_ends, self.first, side="right")
        self.salt = salts(langs)[self.row] if len(self.row) else np.zeros(0, np.uint64)
        self.shift = np.uint64(64 - cells.bit_length() + 1)
        self.grams = {1: self.hash}
        for n in range(2, LONGEST + 1):
            before = self.grams[n - 1]
            self.grams[n] = mix64(before[:-1] * np.uint64(31) + self.hash[n - 1 :]) if len(before) else before

    def same(self, n: int) -> np.ndarray:
        """Whether the n words from each place on lie in one piece."""
        return self.piece[: len(self.grams[n])] == self.piece[n - 1 :] if len(self.grams[n]) else np.zeros(0, bool)

    def keys(self, n: int, places: np.ndarray) -> np.ndarray:
        return mix64((self.grams[n][places] ^ self.salt[places]) + np.uint64(n))

    def cells(self, n: int, places: np.ndarray) -> np.ndarray:
        return (self.keys(n, places) >> self.shift).astype(np.int64)

    def passing(self, n: int, places: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """The places whose run of n words lies in a cell of the bitmap."""
        c = self.cells(n, places)
        return places[(bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1]

    def pairs(self, bits: np.ndarray) -> dict[int, np.ndarray]:
        """Places by number of words up to five, within pieces, all of whose words and pairs pass."""
        n = len(self.hash)
        ok = {1: np.zeros(n, bool)}
        ok[1][self.passing(1, np.arange(n), bits)] = True
        ok[2] = np.zeros(max(n - 1, 0), bool)
        ok[2][self.passing(2, np.flatnonzero(self.same(2) & ok[1][:-1] & ok[1][1:]) if n > 1 else np.zeros(0, np.int64), bits)] = True
        for k in range(3, LONGEST + 1):
            ok[k] = ok[k - 1][:-1] & ok[k - 1][1:] if len(ok[k - 1]) else ok[k - 1]
        return {k: np.flatnonzero(x) for k, x in ok.items()}


def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The values as one binary value for each run of them that begins at ``starts``."""
    ends = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def passing_cells(docs: DataFrame, least: int, cells: int, take: Callable[[Runs], list[np.ndarray]]) -> DataFrame:
    """(lang, cell, n) of the cells that ``take`` fills and that reach ``least``, and, with cell null, each language's words.

    Counts travel as rows of ``WIDE`` neighbouring cells, and a task sums the rows of one such block at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            block = (cell // WIDE).astype(np.int32)
            starts = np.flatnonzero(np.append([True], block[1:] != block[:-1])) if len(cell) else np.zeros(0, np.int64)
            at, many = lists((cell % WIDE).astype(np.uint16), starts), lists(n.astype(np.uint32), starts)
            return pa.RecordBatch.from_arrays([pa.nulls(len(starts), pa.string()), pa.array(block[starts]), at, many, pa.nulls(len(starts), pa.int64())], ["lang", "block", "at", "many", "words"])

        for batch in slices(batches, "text", BLOCK):
            runs = Runs(batch.column("text"), batch.column("lang"), cells)
            for lang, n in zip(batch.column("lang").to_pylist(), np.bincount(runs.row, minlength=batch.num_rows).tolist(), strict=True):
                total[lang] = total.get(lang, 0) + n
            held += take(runs)
            if sum(map(len, held)) > HELD:
                yield counted()
        yield counted()
        none = pa.nulls(len(total), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([-1] * len(total), pa.int32()), none, none, pa.array(list(total.values()), pa.int64())], ["lang", "block", "at", "many", "words"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, own = np.zeros(WIDE, np.int64), -1
        total: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            some = np.flatnonzero(n >= max(least, 1))
            out = pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(some + own * WIDE), pa.array(n[some])], ["lang", "cell", "n"])
            n[:] = 0
            return out

        for batch in batches:
            for lang, block, at, many, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block < 0:
                    total[lang] = total.get(lang, 0) + words
                    continue
                if block != own:
                    yield told()
                    own = block
                n[np.frombuffer(at, np.uint16)] += np.frombuffer(many, np.uint32)
        yield told()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["lang", "cell", "n"])

    told = docs.mapInArrow(count, "lang string, block int, at binary, many binary, words long")
    return told.repartition("block").sortWithinPartitions("block").mapInArrow(add, "lang string, cell long, n long")


def bitmap(cells: DataFrame, size: int) -> bytes:
    """Compressed bits of the cells, of which the driver gets size / 8 bytes at most."""
    one = F.col("cell") + 1
    blocks = cells.where("cell is not null").groupBy(F.bitmap_bucket_number(one).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for block, bits in blocks.collect():
        out[(block - 1) * 4096 : block * 4096] = np.frombuffer(bits, np.uint8)
    return zlib.compress(out.tobytes(), 1)


def bits_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def passing_runs(runs: Runs, few: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, keys, places) of the different runs of one to five words that the bitmaps let pass, with all runs inside."""
    places = runs.pairs(few)
    for n in range(1, LONGEST + 1):
        if n > 2:
            inner = np.zeros(len(runs.hash) + 1, bool)
            inner[places[n - 1]] = True
            places[n] = runs.passing(n, places[n][inner[places[n]] & inner[places[n] + 1]], many)
        key, at = np.unique(runs.keys(n, places[n]), return_index=True)
        yield n, key, places[n][at]


def compiled(phrases: list[str]) -> ahocorasick.Automaton:
    """An automaton of phrases between delimiters; a match gives the phrase's number."""
    out = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        out.add_word(f" {p} ", k)
    out.make_automaton()
    return out


def scanned(texts: list[str | None]) -> str:
    """Texts of words between single blanks, with line ends between pieces."""
    raw = b"\n".join([(t or "").encode() for t in texts]).translate(PLAIN)
    return re.sub(rb"  +", b" ", re.sub(rb" *\n[ \n]*", b" \n ", b" %b " % raw)).decode()


def matches(block: pa.RecordBatch, automata: dict[str, ahocorasick.Automaton]) -> Iterator[tuple[str, np.ndarray]]:
    """The numbers of all phrases that a block's texts match, by language."""
    texts, langs = block.column("text").to_pylist(), block.column("lang").to_pylist()
    for lang in {*langs} & automata.keys():
        text = scanned([t for t, own in zip(texts, langs, strict=True) if own == lang])
        yield lang, np.fromiter(map(itemgetter(1), automata[lang].iter(text)), np.int64)


def counted(docs: DataFrame, short: bytes, long: bytes, cells: int, least: int, patterns: int = PATTERNS) -> DataFrame:
    """(lang, phrase, f) of the runs that the sketches let pass and that occur ``least`` times."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, many = bits_of(short), bits_of(long)
        held: list[pa.RecordBatch] = []
        own: dict[str, dict[int, str]] = {}
        seen: set[int] = set()

        def told() -> Iterator[pa.RecordBatch]:
            for k in range(0, max(map(len, own.values()), default=0), patterns):
                some = {lang: [*islice(phrases.items(), k, k + patterns)] for lang, phrases in own.items() if len(phrases) > k}
                automata = {lang: compiled([p for _, p in x]) for lang, x in some.items()}
                n = {lang: np.zeros(len(x), np.int64) for lang, x in some.items()}
                for block in held:
                    for lang, met in matches(block, automata):
                        n[lang] += np.bincount(met, minlength=len(n[lang]))
                for lang, x in some.items():
                    share = (np.array([key for key, _ in x], np.uint64) % np.uint64(SHARES)).astype(np.int32)
                    order = np.argsort(share, kind="stable")
                    share = share[order]
                    starts = np.flatnonzero(np.append([True], share[1:] != share[:-1]))
                    ends = pa.array(np.append(starts, len(share)).astype(np.int32))
                    phrases = pa.ListArray.from_arrays(ends, pa.array([p for _, p in x], pa.string()).take(pa.array(order)))
                    yield pa.RecordBatch.from_arrays([pa.array(share[starts]), pa.array([lang] * len(starts), pa.string()), phrases, pa.ListArray.from_arrays(ends, pa.array(n[lang][order]))], ["share", "lang", "phrase", "f"])
            for x in (held, own, seen):
                x.clear()

        for block in slices(batches, "text", BLOCK):
            runs = Runs(block.column("text"), block.column("lang"), cells)
            langs, low = block.column("lang").to_pylist(), LOWER[runs.raw].tobytes()
            for n, keys, places in passing_runs(runs, few, many):
                for key, i in zip(keys.tolist(), places.tolist(), strict=True):
                    if key not in seen:  # of any language, as keys are salted by it
                        seen.add(key)
                        own.setdefault(langs[runs.row[i]], {})[key] = b" ".join([low[runs.first[j] : runs.last[j]] for j in range(i, i + n)]).decode()
            held.append(block)
            if sum(b.column("text").nbytes for b in held) > PART or len(seen) > patterns:
                yield from told()
        yield from told()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held)
                held.clear()
                size = pc.list_value_length(rows["f"]).to_numpy()
                lang = rows["lang"].take(pa.array(np.repeat(np.arange(rows.num_rows), size)))
                sums = pa.table({"lang": lang, "phrase": pc.list_flatten(rows["phrase"]), "f": pc.list_flatten(rows["f"])}).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
                yield from sums.filter(pc.greater_equal(sums["f_sum"], least)).rename_columns({"f_sum": "f"}).select(["lang", "phrase", "f"]).to_batches()

        share = None
        for batch in batches:
            own = batch.column("share").to_numpy()
            starts = [*(np.flatnonzero(np.append([True], own[1:] != own[:-1])).tolist() if len(own) else []), len(own)]
            for a, b in zip(starts, starts[1:], strict=False):
                if own[a] != share:
                    yield from told()
                    share = own[a]
                held.append(batch.slice(a, b - a))
        yield from told()

    told = docs.mapInArrow(scan, "share int, lang string, phrase array<string>, f array<long>")
    return told.repartition("share").sortWithinPartitions("share").mapInArrow(add, "lang string, phrase string, f long")


def scored(counts: DataFrame, totals: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the candidates, by their lowest-scoring cut (ties: the first)."""
    sized = counts.withColumn("words", F.size(F.split("phrase", " ")))
    several = sized.where((F.col("words") > 1) & (F.col("f") >= least)).withColumnRenamed("f", "a")
    word = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(word, start, length), " ")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("_left", part(F.lit(1), F.col("k"))).withColumn("_right", part(F.col("k") + 1, F.col("words") - F.col("k")))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l")), ["lang", "_left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r")), ["lang", "_right"])
    cuts = cuts.join(totals, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_up", F.lit(1000).cast("decimal(4,0)") * (whole("a") * whole("n"))).withColumn("_down", whole("l") * whole("r"))
    cuts = cuts.withColumn("score", F.expr("_up div _down").cast("long"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("_best")
    return cuts.groupBy("lang", "phrase", "words", "a", "n").agg(best).select("lang", "phrase", "words", "a", "_best.l", "_best.r", "n", "_best.score")


def outermost(phrases: DataFrame) -> DataFrame:
    """The phrases that lie in no longer one of the same count; a longer one can't be more frequent."""
    word = F.split("phrase", " ")
    inner = phrases.where("words > 2").withColumn("_size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice(word, F.col("_at"), F.col("_size")), " ").alias("phrase"), "a").distinct()
    return phrases.join(inner, ["lang", "phrase", "a"], "left_anti")


def ranked(phrases: DataFrame, most: int, parts: int = PARTS) -> DataFrame:
    """Adds ``rank``: the first of each language by score, count and phrase, in two steps, so no task orders all of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = phrases.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most).drop("_part")


def mine(docs: DataFrame, least: int = 100, most: int = 2000, cells: int = CELLS, patterns: int = PATTERNS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of two to five words that occur ``least`` times."""
    scratch = Scratch(docs.sparkSession, "phrases")
    own = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")

    def short_runs(runs: Runs) -> list[np.ndarray]:
        return [runs.cells(1, np.arange(len(runs.hash))), runs.cells(2, np.flatnonzero(runs.same(2)))]

    first = scratch.keep(passing_cells(own, least, cells, short_runs), "short")
    short = bitmap(first, cells)

    def long_runs(runs: Runs) -> list[np.ndarray]:
        places = runs.pairs(bits_of(short))
        return [runs.cells(n, places[n]) for n in range(3, LONGEST + 1)]

    second = scratch.keep(passing_cells(own, least, cells, long_runs).where("cell is not null"), "long")
    totals = first.where("cell is null").select("lang", "n")
    counts = scratch.keep(counted(own, short, bitmap(second, cells), cells, least, patterns), "counts")
    some = scratch.keep(scored(counts, totals, least), "scored")
    return ranked(outermost(some), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
