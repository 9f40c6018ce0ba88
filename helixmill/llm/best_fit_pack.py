"""Best-fit packing of token sequences by large-item matching.

Items over a third of the capacity meet at most twice in a bin: each, from the longest down, is paired with
the longest other one that fits. Smaller items then go, from the longest down, into the tightest gap.
Lengths are whole numbers up to the capacity, so both steps work on counts by length: the plan depends on
at most ``capacity`` counts, never on single rows, and rows take their places by rank within a length.

Null texts count as empty: one piece with the end id alone. Repeated rows are packed each for itself.
Texts over the capacity are cut into full pieces and a rest. An empty table gives an empty table."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gapless_rank, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of a worker's word cache before it starts anew; affects speed only.
CACHE = 250_000
#: Words that the library encodes at once: its results are many times larger than the ids.
STEP = 8192
SPECIAL = r"(?i)<\|(startoftext|endoftext)\|>"
#: A run of ASCII signs after a letter or digit and before white space is a token group of its own.
TAIL = r"([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]+)([\t-\r ]|$)"


class WordEncoder:
    """Ids of texts by a tokenizer file whose pre-tokens never span white space.

    Texts are split at ASCII white space; each different word is encoded once by the library and kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.off = np.zeros(1 << 14, np.int64)
        self.n = 0

    def add(self, words: list[str]) -> None:
        got = [e.ids for k in range(0, len(words), STEP) for e in self.tokenizer.encode_batch_fast(words[k : k + STEP], add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for g in got for i in g), np.uint32, int(lens.sum()))
        end = int(self.off[self.n])
        while end + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(got) + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        self.ids[end : end + len(flat)] = flat
        self.off[self.n + 1 : self.n + 1 + len(got)] = end + np.cumsum(lens)
        self.code.update(zip(words, range(self.n, self.n + len(got)), strict=True))
        self.n += len(got)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each text's ids begin (one more entry than texts)."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, SPECIAL).to_numpy(zero_copy_only=False)
        low = pc.replace_substring_regex(pc.ascii_lower(texts), TAIL, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(low)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        words = coded.dictionary.to_pylist()
        if self.n > CACHE:
            self.clear()
        if new := [w for w in words if w not in self.code]:
            self.add(new)
        code = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        lens = self.off[code + 1] - self.off[code]
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.off[code] - ends[:-1], lens) + np.arange(ends[-1])]
        starts = ends[at]
        if whole.any():  # special strings in a text: left to the library as a whole
            parts = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if w else ids[a:b] for t, w, a, b in zip(texts.to_pylist(), whole, starts, starts[1:], strict=False)]
            ids, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, starts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in slices(batches, "text"):
            ids, starts = own.encode(batch.column("text"))
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if keep_ids else {})
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), starts, starts[1:], strict=False):
                own_ids = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(range(0, len(own_ids), capacity)):
                    part = own_ids[s : s + capacity]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(s)
                    out["length"].append(len(part))
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(part.astype(np.int32))
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Places for ``counts`` items of each length, and the number of bins.

    A row: items of rank first to last - 1 of a length go, ``each`` to a bin, to bins from ``bin`` on, at ``used`` on.
    Every step uses up a length or halves a gap at least, so the rows are bounded by the capacity alone."""
    left, taken, bins, rows = dict(counts), defaultdict(int), 0, []
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    gaps: list[tuple[int, int, int]] = []  # (gap, first bin, number of bins), sorted

    def place(length: int, n: int, first: int, used: int, each: int = 1) -> None:
        rows.append((length, taken[length], taken[length] + n, each, first, used))
        taken[length] += n
        left[length] -= n

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            fit = [m for m in large if m <= capacity - length and (left[m] if m != length else left[m] >= 2)]
            other = fit[-1] if fit else None
            n = left[length] // 2 if other == length else min(left[length], left[other]) if other else left[length]
            place(length, n, bins, 0)
            if other:
                place(other, n, bins, length)
            insort(gaps, (capacity - length - (other or 0), bins, n))
            bins += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect_left(gaps, (length, -1, -1))
            if i == len(gaps):
                each = capacity // length
                n = -(-left[length] // each)
                gap, first, have = capacity, bins, n
                bins += n
            else:
                gap, first, have = gaps.pop(i)
                each = gap // length
            full, rest = divmod(left[length], each)
            if full >= have:
                full, rest = have, 0
            if full:
                place(length, full * each, first, capacity - gap, each)
                insort(gaps, (gap - each * length, first, full))
            if rest:
                place(length, rest, first + full, capacity - gap, each)
                insort(gaps, (gap - rest * length, first + full, 1))
            if have > full + bool(rest):
                insort(gaps, (gap, first + full + bool(rest), have - full - bool(rest)))
    return pd.DataFrame(rows, columns=["length", "first", "last", "each", "bin", "used"]).astype("int64"), bins


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that are stored (they are read more than once)."""
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan, _ = packing_plan(counts, capacity)
    plan = plan.sort_values(["length", "first"])
    base = np.int64(1) << np.int64(44)
    key, each, first, bin_, used = plan["length"].to_numpy() * base + plan["first"].to_numpy(), *(plan[c].to_numpy() for c in ("each", "first", "bin", "used"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(key, n * base + r, side="right") - 1
        d = r - first[i]
        return pd.DataFrame({"sequence_id": bin_[i] + d // each[i], "offset": used[i] + d % each[i] * n})

    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    ranked = gapless_rank(pieces, ["length"], order, order, "_rank")
    return ranked.withColumn("_at", place("length", "_rank")).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(scratch.keep(token_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity)
