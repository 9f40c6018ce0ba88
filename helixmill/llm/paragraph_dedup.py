"""Passages that repeat across documents, by the MinHash of paragraphs.

A paragraph is a window of ``WINDOW`` word shingles (of ``KEY`` words, 25 words in all) at any place of a text, as shared
passages need not keep to lines. Its MinHash, the shingle with the least hash, is its key; neighbouring windows mostly
share it, so a text has few. The band is tuned by this bound: two passages of 50 words or more whose 5-word shingles have
a Jaccard similarity of 0.8 are equal over 25 words in a row somewhere, whatever is substituted, inserted or deleted,
and so share a key.

Places of equal keys are candidates. Of a key that over ``MEET`` places share, places with the same ``REACH`` words on each side
are copies: they meet the smallest of them, which stands for them. Up to ``MEET`` places of a key all meet each other. A place of a more frequent key is
known by more: the key, the ``LEAST`` words around it at eight offsets, and ``BANDS`` bands of ``ROWS`` MinHashes each of the
shingles of about 60 words around it, wider than a line. With a similarity s of these surroundings two places share a band
with the probability 1 - (1 - s ** ROWS) ** BANDS: over 0.999 for 0.75, 0.94 for 0.58 (the middle of a passage of 50 words with
an edited word), 0.3 for 0.35 (a line in other surroundings). Up to ``MEET`` places that one of these values shares all meet each
other, more meet the smallest document of the value. For the exact words of an offset that loses nothing, as the smallest
document holds them too. Places of a crowded band need not be like its smallest; they are also known by the 50, 59 or 68 words around them without
one, two or three words in a row (``GAPS``), wherever these are. All that share such a value are similar, so meeting the smallest is exact there:
passages of 55, 64 or 73 words with one such gap around two crowded places meet for sure. Wider or uneven gaps in crowded bands are found by other bands alone.
The bands' joins are equi-joins on hashes; edited windows are compared by whole keys of at most ``LARGE`` places, larger keys by shuffled values. Candidates of
two texts on one diagonal form a region, whose words are aligned: substitutions, insertions and deletions are bridged, gaps of
up to ``JUMP`` words or a quarter of what is aligned so far, and the widest runs of at least ``LEAST`` words with a similarity of
0.8 are removals, each linked with a smaller document. Texts that are equal as a whole are found by their digest.
Removals are clustered by the components of their documents' links.

Null texts, texts of fewer than ``LEAST`` words and empty tables have no passage. Rows that share an id are told apart by
their text but don't remove from each other; repeated rows count once. Rows with a null id are left alone. Of several
documents that hold a passage the smallest id keeps it. Columns of any other name stay as they are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, carried, mix64, restored, slices
from .graph import components
from .multiset_hash import word_hashes

WORDS = 5
SIMILAR = 0.8
#: Words of a key, and keys of a window: 25 equal words hold one whole window.
KEY = 8
WINDOW = 18
LEAST = 45
#: Words before a key at which the ``LEAST`` words begin that a place of a frequent key is also known by.
OFFSETS = (*range(0, LEAST - KEY, 6), LEAST - KEY)
#: Words of a region on each side of its keys, so that it holds any 50 words around a key.
REACH = 44
#: Places of one region are at most so many words apart; its bounds are multiples of this.
TILE = 64
#: Words in a row that an alignment skips on either side; longer gaps in a passage of 50 words leave no similarity of 0.8. In
#: longer passages it skips up to a quarter of the words aligned so far: more leave no such similarity either.
JUMP = 12
#: Bands of MinHashes of a frequent key's surroundings, MinHashes of a band, and words on each side that count.
BANDS = 24
ROWS = 4
SIDE = 26
#: Equal words after a gap.
AGAIN = 4
#: (words left out, words) of windows that a crowded place is also known by: two that differ in so many words in a row, substituted,
#: inserted or deleted, have a similarity of 0.8.
GAPS = ((1, 50), (2, 59), (3, 68))
#: Windows begin so many words apart, and equal words in a row that hold the key.
STEP = 6
HELD = KEY + WINDOW - STEP
#: Words on each side of a crowded place that these windows can hold.
FAR = GAPS[-1][1] - KEY
#: Crowded places that a task compares, about; and those of one key, beyond which their values are shuffled.
DEALT = 20_000
LARGE = 100_000
#: Places of a key, or of a value that a frequent key's place is known by, that all meet each other.
MEET = 8
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MULT = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))
SPANS = "doc_id long, h long, start long, end long, keep_id long"
TEXT = ["doc_id", "h"]
PAIR = ["doc_id", "h", "keep_id", "keep_h", "diagonal"]


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word of all texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return pc.list_parent_indices(lists).to_numpy()[real], word_hashes(flat)[real]


def rolling(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and powers from which ``window_hash`` has the hash of any words in a row."""
    n = len(h)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, MULT)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), INVERSE)]))[:n]
    return np.concatenate([[np.uint64(0)], np.cumsum(h * back)]), power


def window_hash(sums: np.ndarray, power: np.ndarray, a: np.ndarray, size: int) -> np.ndarray:
    return mix64((sums[a + size] - sums[a]) * power[a])


def anchors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, place, around) where the MinHash of a paragraph begins, and the number of words of each text. ``around`` is a hash
    of the ``REACH`` words on each side, as far as there are."""
    row, h = hashed(texts)
    size = np.bincount(row, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    none = np.zeros(0, np.int64)
    least = WINDOW + KEY - 1
    if len(h) < LEAST:
        return none, none, none, none, size
    sums, power = rolling(h)
    key = window_hash(sums, power, np.arange(len(h) - KEY + 1), KEY)
    starts = np.flatnonzero((row[: len(row) - least + 1] == row[least - 1 :]) & (size[row[: len(row) - least + 1]] >= LEAST))
    view = np.lib.stride_tricks.sliding_window_view(key, WINDOW)
    places = [none]
    for k in range(0, len(starts), 1 << 16):
        part = starts[k : k + (1 << 16)]
        places.append(part + view[part[0] : part[-1] + 1].argmin(axis=1)[part - part[0]])
    p = np.concatenate(places)
    p = p[np.concatenate([[True], p[1:] != p[:-1]])[: len(p)]]  # they ascend
    p = p[unlike_before(row[p], key[p], p)]
    a, b = np.maximum(begin[row[p]], p - REACH), np.minimum(begin[row[p]] + size[row[p]], p + KEY + REACH)
    around = mix64(window_hash(sums, power, a, b - a) + (p - a).astype(np.uint64))
    return row[p], key[p].view(np.int64), p - begin[row[p]], around.view(np.int64), size


def unlike_before(row: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places (row, key, place) but for those that repeat a key within a window: of a run of words that repeats itself,
    one place for each ``LEAST`` words is enough."""
    order = np.lexsort((place, key, row))
    r, k, p = row[order], key[order], place[order]
    follows = np.zeros(len(p), bool)
    follows[1:] = (r[1:] == r[:-1]) & (k[1:] == k[:-1]) & (p[1:] - p[:-1] <= WINDOW)
    begin = np.maximum.accumulate(np.where(follows, 0, np.arange(len(p))))
    part = (p - p[begin]) // LEAST
    kept = ~follows
    kept[1:] |= part[1:] != part[:-1]
    return np.sort(order[kept])


def text_key(text: Column | str = "text") -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(text)


def key_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, digest, n_words, n_chars, keys, places, around) of each document."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, key, place, near, size = anchors(batch.column("text"))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
            keys, places, around = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key, place.astype(np.int32), near))
            own = ["doc_id", "h", "digest", "n_chars"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(size.astype(np.int64)), keys, places, around], [*own, "n_words", "keys", "places", "around"])

    rows = docs.where("doc_id is not null and text is not null")
    rows = rows.select("doc_id", text_key().alias("h"), F.md5("text").alias("digest"), F.char_length("text").cast("long").alias("n_chars"), "text")
    return rows.mapInArrow(walk, "doc_id long, h long, digest string, n_chars long, n_words long, keys array<long>, places array<int>, around array<long>")


def repeated_keys(rows: DataFrame) -> DataFrame:
    """(key, n, doc_id, h, place, around): each place of the n places of keys that more than one document holds."""
    one = rows.select(*TEXT, F.explode(F.arrays_zip("keys", "places", "around")).alias("k")).select(F.col("k.keys").alias("key"), *TEXT, F.col("k.places").alias("place"), F.col("k.around").alias("around"))
    shared = one.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high").select("key", "n")
    return one.join(shared, "key").select("key", "n", *TEXT, "place", "around")


def with_texts(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """``lists`` (doc_id, h, at) with the text of each."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("_id"), text_key().alias("_h"), "text")
    return lists.hint("shuffle_hash").join(texts, (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h"))).select(*TEXT, "at", "text")


#: Odd factors, one a MinHash: of hashes that are spread already, their products put shingles in as many orders.
FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def band_values(shingle: np.ndarray, key: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """uint64[n, BANDS]: of each place (its key's hash and first word, and its text's first word and end), hashes of the bands of
    the shingles around it. ``shingle`` is the hash of the shingle that begins at each word."""
    out = np.empty((len(start), BANDS), np.uint64)
    a, b = np.maximum(low, start - SIDE), np.minimum(high, start + KEY + SIDE) - WORDS
    for k in range(0, len(start), 4096):
        at = slice(k, k + 4096)
        own = shingle[np.minimum(a[at, None] + np.arange(2 * SIDE + KEY - WORDS + 1)[None, :], b[at, None])]
        value = np.repeat(key[at, None], BANDS, axis=1) + np.arange(BANDS, dtype=np.uint64)[None, :]
        for j, factor in enumerate(FACTORS):
            value[:, j // ROWS] = mix64(value[:, j // ROWS] * MULT + (own * factor).min(axis=1))
        out[at] = value
    return out


def edited_values(sums: np.ndarray, power: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of a place, value), by gap and offset: hashes of the windows that hold the key at each place, with the words of a gap left
    out wherever ``HELD`` words in a row still hold the key.

    Windows in which these words are substituted agree without them; if they are inserted, without them and without the last (or
    first) words of the other. So all that share a value are similar."""
    for gap, size in GAPS:
        for x in (*range(0, size - KEY, STEP), size - KEY):
            a = start - x
            ok = np.flatnonzero((a >= low) & (a + size <= high))
            out = np.array([*range(min(x, size - HELD) - gap + 1), *range(max(x + KEY, HELD), size - gap + 1)])
            cut = a[ok, None] + out[None, :]
            rest = (sums[cut] - sums[a[ok], None]) + (sums[a[ok] + size, None] - sums[cut + gap]) * np.uint64(pow(int(MULT), gap, 1 << 64))
            yield np.repeat(ok, len(out)), mix64(mix64(rest * power[a[ok], None]) + np.uint64(x + 128 * gap)).ravel()


def surrounding_values(sums: np.ndarray, power: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a place, value): hashes of the key at each place, of the ``LEAST`` words around it at each offset, and of the bands
    of its surroundings. Only those of bands are odd."""
    picked, values = [], []
    for size, x in ((KEY, 0), *((LEAST, x) for x in OFFSETS)):
        a = start - x
        ok = np.flatnonzero((a >= low) & (a + size <= high))
        picked.append(ok)
        values.append(mix64(window_hash(sums, power, a[ok], size) + np.uint64(x + 64 * size)) & ~np.uint64(1))
    if len(start):
        shingle = window_hash(sums, power, np.arange(len(sums) - WORDS), WORDS)
        bands = band_values(shingle, window_hash(sums, power, start, KEY), start, low, high)
        picked.append(np.repeat(np.arange(len(start)), BANDS))
        values.append(bands.ravel() | np.uint64(1))
    return np.concatenate(picked), np.concatenate(values)


def told_of(places: DataFrame, docs: DataFrame, tell: Callable, schema: str) -> DataFrame:
    """What ``tell`` tells of places (doc_id, h, place): of arrays (doc_id, h, place) and (hashes of words, sums, powers, place among these,
    begin and end of its text) it makes columns of ``schema``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, h = hashed(batch.column("text"))
            sums, power = rolling(h)
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            begins = np.concatenate([[0], ends])[:-1]
            at = batch.column("at")
            own, place = pc.list_parent_indices(at).to_numpy(), at.flatten().to_numpy()
            for k in range(0, len(own), 4096):
                o, x = own[k : k + 4096], place[k : k + 4096]
                ids = [*(batch.column(c).to_numpy()[o] for c in TEXT), x]
                yield pa.RecordBatch.from_pydict(tell(ids, h, sums, power, begins[o] + x, begins[o], ends[o]))

    lists = places.groupBy(*TEXT).agg(F.collect_list("place").alias("at"))
    return with_texts(lists, docs).mapInArrow(walk, schema)


VALUES = "value long, doc_id long, h long, place int"
AROUND = "key long, doc_id long, h long, place int, before int, words array<int>"


def valued(ids: list[np.ndarray], i: np.ndarray, value: np.ndarray) -> dict:
    return {"value": value.view(np.int64)} | {c: v[i] for c, v in zip((*TEXT, "place"), ids, strict=True)}


def tell_values(ids: list[np.ndarray], h: np.ndarray, *at: np.ndarray) -> dict:
    return valued(ids, *surrounding_values(*at))


def tell_words(ids: list[np.ndarray], h: np.ndarray, sums: np.ndarray, power: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict:
    """Key of each place and 32 bits of each word around it, of which ``before`` come before the key."""
    a, b = np.maximum(low, start - FAR), np.minimum(high, start + KEY + FAR)
    ends = np.concatenate([[0], np.cumsum(b - a)])
    words = h[np.arange(ends[-1]) + np.repeat(a - ends[:-1], b - a)]
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((words >> np.uint64(32)).astype(np.uint32).view(np.int32)))
    return {"key": window_hash(sums, power, start, KEY).view(np.int64)} | dict(zip((*TEXT, "place"), ids, strict=True)) | {"before": (start - a).astype(np.int32), "words": lists}


def around_words(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``edited_values`` of rows (AROUND)."""
    words = rows.column("words")
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
    h = mix64(words.flatten().to_numpy().view(np.uint32).astype(np.uint64))
    return edited_values(*rolling(h), ends[:-1] + rows.column("before").to_numpy(), ends[:-1], ends[1:])


def near_places(rows: pa.Table) -> pa.Table:
    """Pairs of places (AROUND) of whole keys that share an edited value: all of ``MEET`` places at most, else each with the smallest."""
    rows = rows.sort_by([(c, "ascending") for c in (*TEXT, "place")])
    found = [np.zeros(0, np.int64)]
    for i, value in around_words(rows):
        order = np.argsort(value, kind="stable")  # rows stay in order
        i, value = i[order], value[order]
        at = np.arange(len(i))
        new = np.concatenate([[True], value[1:] != value[:-1]])[: len(i)]
        begin = np.maximum.accumulate(np.where(new, at, 0))
        few = np.bincount(begin, minlength=len(i))[begin] <= MEET
        found.append((i * rows.num_rows + i[begin])[begin < at])
        for d in range(1, MEET):
            k = np.flatnonzero(few & (at - d > begin))
            found.append(i[k] * rows.num_rows + i[k - d])
        found = [np.unique(np.concatenate(found))]
    later, first = (rows.select([*TEXT, "place"]).take(pa.array(k)) for k in (found[0] // max(rows.num_rows, 1), found[0] % max(rows.num_rows, 1)))
    both = pa.Table.from_arrays([*later.columns, *first.columns], names=["doc_id", "h", "place", "keep_id", "keep_h", "keep_place"])
    return both.filter(pc.less(both.column("keep_id"), both.column("doc_id")))


def edited_pairs(places: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of places (doc_id, h, place) that share an edited value. Whole keys are dealt to tasks, but for those of more than ``LARGE``
    places, whose values are shuffled."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                for i, value in around_words(part):
                    yield pa.RecordBatch.from_pydict(valued([part.column(c).to_numpy() for c in (*TEXT, "place")], i, value))

    around = scratch.keep(told_of(places, docs, tell_words, AROUND), "around")
    large = scratch.keep(around.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("key"), "large")
    dealt = F.pmod(F.xxhash64("key"), F.lit(max(64, around.count() // DEALT)))
    pairs = around.join(large, "key", "left_anti").groupBy(dealt).applyInArrow(near_places, "doc_id long, h long, place int, keep_id long, keep_h long, keep_place int")
    if large.isEmpty():
        return pairs
    some, low, _ = by_values(around.join(large, "key").mapInArrow(walk, VALUES), scratch, "edits")
    return pairs.unionByName(met(some, "value")).unionByName(low)


def candidates(shared: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, h, place, keep_id, keep_h, keep_place): places that may lie in one passage; keep_id is smaller."""
    few = shared.where(F.col("n") <= MEET).select("key", *TEXT, "place")
    often = shared.where(F.col("n") > MEET).drop("n")
    kinds = scratch.keep(often.groupBy("key", "around").agg(F.min(F.struct(*TEXT, "place")).alias("m")), "kinds")
    same = often.join(kinds, ["key", "around"]).select(*TEXT, "place", *lowest()).where("keep_id < doc_id")
    kinds = kinds.join(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key").select("key", "n", "m.*")
    few = few.unionByName(kinds.where(F.col("n") <= MEET).drop("n"))
    some, low, crowded = by_values(told_of(kinds.where(F.col("n") > MEET), docs, tell_values, VALUES), scratch, "each")
    places = crowded.where(F.col("value").bitwiseAND(F.lit(1)) == 1).select(*TEXT, "place").distinct()
    pairs = [met(few, "key"), met(some, "value"), low, same, edited_pairs(places, docs, scratch)]
    return reduce(DataFrame.unionByName, pairs)


def lowest() -> list[Column]:
    return [F.col("m.doc_id").alias("keep_id"), F.col("m.h").alias("keep_h"), F.col("m.place").alias("keep_place")]


def by_values(each: DataFrame, scratch: Scratch, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of places that share values: those of values of ``MEET`` places at most, pairs with the smallest document of the others, and
    places of the others."""
    each = scratch.keep(each, label)
    known = each.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*TEXT, "place")).alias("m"), F.max("doc_id").alias("_high")).where("m.doc_id < _high")
    known = scratch.keep(known.select("value", "n", "m"), f"{label}_values")
    many = each.join(known.where(F.col("n") > MEET), "value")
    return each.join(known.where(F.col("n") <= MEET).select("value"), "value"), many.select(*TEXT, "place", *lowest()).where("keep_id < doc_id"), many


def met(rows: DataFrame, by: str) -> DataFrame:
    """All pairs of rows (by, doc_id, h, place) that share ``by``, of which there are ``MEET`` at most; the smaller id is kept."""
    other = rows.select(by, F.col("doc_id").alias("keep_id"), F.col("h").alias("keep_h"), F.col("place").alias("keep_place"))
    return rows.join(other, by).where("keep_id < doc_id").drop(by)


def regions(links: DataFrame) -> DataFrame:
    """(doc_id, h, keep_id, keep_h, diagonal, places, s, e, keep_s, keep_e): runs of places, and the words that hold them."""
    rows = links.withColumn("diagonal", F.col("place") - F.col("keep_place")).select(*PAIR, "place")
    rows = rows.repartition(*PAIR).distinct()
    order = Window.partitionBy(*PAIR).orderBy("place")
    rows = rows.withColumn("_new", F.coalesce(F.col("place") - F.lag("place").over(order) > TILE, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    rows = rows.groupBy(*PAIR, "_run").agg(F.sort_array(F.collect_list("place")).alias("places"), F.min("place").alias("_a"), F.max("place").alias("_b")).drop("_run")
    a, b, d = F.col("_a"), F.col("_b"), F.col("diagonal")
    reach = REACH + F.floor((b - a) / 2)
    begin = lambda c: (F.floor(F.greatest(c - reach, F.lit(0)) / TILE) * TILE).cast("int")
    end = lambda c: ((F.floor((c + KEY + reach) / TILE) + 1) * TILE).cast("int")
    return rows.select(*PAIR, "places", begin(a).alias("s"), end(b).alias("e"), begin(a - d).alias("keep_s"), end(b - d).alias("keep_e"))


def cut_out(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, h, s, e, first, text): the words s to e - 1 of a text, and the place in code points where they begin."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*TEXT, "s", "e", "first", "text"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            for doc, h, at, text in zip(*(batch.column(c).to_pylist() for c in (*TEXT, "at", "text")), strict=True):
                edges = [m.span() for m in WORD.finditer(text)]
                for x in at:
                    a, b = edges[x["s"]][0], edges[min(x["e"], len(edges)) - 1][1]
                    out.append((doc, h, x["s"], x["e"], a, text[a:b]))
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out[k : k + 4096], strict=True), kinds, strict=True)], names)

    lists = wanted.groupBy(*TEXT).agg(F.collect_set(F.struct("s", "e")).alias("at"))
    cut = with_texts(lists, docs).mapInArrow(walk, "doc_id long, h long, s int, e int, first long, text string")
    return cut.dropDuplicates([*TEXT, "s", "e"])  # of repeated rows


def words_of(text: str) -> list[bytes]:
    """Words in lower case; as bytes, only ASCII letters and spaces count."""
    return text.encode().lower().split()


def shingles(words: list) -> set[tuple]:
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False)) if len(words) > WORDS else {tuple(words)}


def aligned(u: list, v: list, x: int, y: int, done: int = 0) -> list[tuple[int, int, int]]:
    """Runs (place in u, place in v, words) on which u and v agree from (x, y) on, past each gap that AGAIN equal words follow.

    Gaps may have a quarter of the words that agree so far, ``done`` ones before (x, y) included."""
    out, m, n = [], len(u), len(v)
    while True:
        a, b = x, y
        while x + 32 <= m and u[x : x + 32] == v[y : y + 32]:
            x, y = x + 32, y + 32
        while x < m and y < n and u[x] == v[y]:
            x, y = x + 1, y + 1
        if x > a:
            out.append((a, b, x - a))
            done += x - a
        jump = max(JUMP, done // 4)
        ahead: dict[tuple, int] = {}
        for d in range(min(jump, n - y - AGAIN) + 1):
            ahead.setdefault(tuple(v[y + d : y + d + AGAIN]), d)
        gaps = [(d + ahead[t], abs(d - ahead[t]), d) for d in range(min(jump, m - x - AGAIN) + 1) if (t := tuple(u[x + d : x + d + AGAIN])) in ahead]
        if not gaps:
            return out
        both, _, d = min(gaps)
        x, y = x + d, y + both - d


def around(u: list, v: list, i: int, j: int, low: int = 0) -> list[tuple[int, int, int]]:
    """Runs on which u and v agree on both sides of (i, j), in order; none begins before ``low`` in u."""
    right = aligned(u, v, i, j)
    left = [(i - x - n, j - y - n, n) for x, y, n in aligned(u[low:i][::-1], v[:j][::-1], 0, 0, sum(n for *_, n in right))][::-1]
    if left and right and left[-1][0] + left[-1][2] == i and left[-1][1] + left[-1][2] == j:
        right[0] = (*left[-1][:2], left.pop()[2] + right[0][2])
    return left + right


def similar_runs(u: list, v: list, runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words (first, last + 1) of v in which runs, together with the gaps between them, reach the similarity.

    What doesn't reach it is parted at its widest gap, the one nearest to the middle of those."""
    equal = np.concatenate([[0], np.cumsum([max(0, n - WORDS + 1) for _, _, n in runs])]).tolist()
    gaps = [b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(runs, runs[1:], strict=False)]
    out, parts = [], [(0, len(runs) - 1)]
    while parts:
        i, j = parts.pop()
        (x0, y0, _), (x1, y1, n) = runs[i], runs[j]
        x1, y1 = x1 + n, y1 + n
        if y1 - y0 < LEAST:
            continue
        both = equal[j + 1] - equal[i]
        if i == j:
            out.append((y0, y1))
            continue
        if both >= SIMILAR * (x1 - x0 + y1 - y0 - 2 * (WORDS - 1) - both):
            s, t = shingles(u[x0:x1]), shingles(v[y0:y1])
            if len(s & t) >= SIMILAR * len(s | t):
                out.append((y0, y1))
                continue
        k = max(range(i, j), key=lambda g: (gaps[g], -abs(2 * g + 1 - i - j)))
        parts += [(i, k), (k + 1, j)]
    return out


def agreements(u: list, v: list, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Words of v that agree with u around places (in u, in v) of equal keys, which ascend."""
    out, done_u, done_v = [], 0, 0
    for i, j in places:
        if j < done_v or i < done_u or u[i : i + KEY] != v[j : j + KEY]:
            continue
        runs = around(u, v, i, j, done_u)
        runs = [r for r in runs if r[1] >= done_v]
        out += similar_runs(u, v, runs)
        done_u, done_v = runs[-1][0] + runs[-1][2], runs[-1][1] + runs[-1][2]
    return out


def verified(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Removals (doc_id, h, start, end, keep_id) of regions, by their words on both sides."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for doc, h, keep, diagonal, places, s, keep_s, first, text, keep_text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "keep_id", "diagonal", "places", "s", "keep_s", "first", "text", "keep_text")), strict=True):
                got = agreements(words_of(keep_text), words_of(text), [(p - diagonal - keep_s, p - s) for p in places])
                if got:
                    edges = [m.span() for m in WORD.finditer(text)]
                    out += [(doc, h, first + edges[a][0], first + edges[b - 1][1], keep) for a, b in got]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["doc_id", "h", "start", "end", "keep_id"])

    other = texts.select(F.col("doc_id").alias("keep_id"), F.col("h").alias("keep_h"), F.col("s").alias("keep_s"), F.col("e").alias("keep_e"), F.col("text").alias("keep_text"))
    return found.join(texts, [*TEXT, "s", "e"]).join(other, ["keep_id", "keep_h", "keep_s", "keep_e"]).mapInArrow(walk, SPANS)


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a text become one; it names the smallest document that keeps a part."""
    order = Window.partitionBy(*TEXT).orderBy("start", "end", "keep_id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.coalesce(F.col("start") > before + 1, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*TEXT, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("keep_id").alias("keep_id")).drop("_run")


def passages(docs: DataFrame) -> DataFrame:
    """Removals (doc_id, text_key, start, end, keep_id, component_id) of ``docs`` (doc_id, text): code points, end exclusive."""
    scratch = Scratch(docs.sparkSession, "passages")
    table = scratch.keep(key_table(docs), "table")
    first = scratch.keep(table.where(F.col("n_words") >= LEAST).groupBy("digest").agg(F.min("doc_id").alias("rep")), "first")
    known = table.join(first, "digest")
    copies = known.where("doc_id <> rep").select(*TEXT, F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"), F.col("rep").alias("keep_id")).distinct()
    copies = scratch.keep(copies, "copies")
    shared = scratch.keep(repeated_keys(known.where("doc_id = rep").select(*TEXT, "keys", "places", "around")), "shared")
    scratch.drop("table", "first")
    found = scratch.keep(regions(candidates(shared, docs, scratch)), "regions")
    scratch.drop("shared", "kinds", "each", "each_values", "around", "large", "edits", "edits_values")
    wanted = found.select(*TEXT, "s", "e").unionByName(found.select(F.col("keep_id").alias("doc_id"), F.col("keep_h").alias("h"), F.col("keep_s").alias("s"), F.col("keep_e").alias("e")))
    texts = scratch.keep(cut_out(wanted, docs), "texts")
    spans = scratch.keep(merged(verified(found, texts).unionByName(copies)), "spans")
    scratch.drop("regions", "texts", "copies")
    labels = components(spans.select(F.col("doc_id").alias("a"), F.col("keep_id").alias("b")), scratch)
    return spans.join(labels.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", F.col("h").alias("text_key"), "start", "end", "keep_id", F.col("component").alias("component_id"))


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the removals; what is left of a text that loses all its words goes. Other rows stay as they are."""
    spans = passages(docs.select("doc_id", "text"))
    lists = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    lists = Scratch(docs.sparkSession, "cut").keep(lists, "lists")

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if t is not None and s:
                parts, at = [], 0
                for x in s:
                    parts.append(t[at : x["start"]])
                    at = x["end"]
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pa.array(out, pa.string())

    rows = carried(docs, F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).withColumn("_key", text_key("_text"))
    rows = rows.join(lists.hint("shuffle_hash"), (F.col("_doc") == F.col("_id")) & (F.col("_key") == F.col("_h")), "left")
    # so marked, the filter doesn't make the planner cut a second time
    rows = rows.withColumn("_cut", cut.asNondeterministic()("_text", "_spans")).where(F.col("_spans").isNull() | F.col("_cut").rlike(r"[^\x20\x09-\x0D]"))
    return restored(rows, docs.columns, text=F.col("_cut"))
