"""The best hairpin of a sequence: an exhaustive search over stems, loops and places within each row.

Rows are searched in batches as arrays of codes: for each loop length and place, stems grow outwards one pair at a
time, so each window costs one addition. No rows move between tasks. Ties: higher score, share of paired positions,
longer stem, loop nearer to four; then the shorter loop and the earlier place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores of pairs: 3 for G and C, 2 for A and T, 1 for G and T (fixed values).
PAIRS = {"GC": 3, "CG": 3, "AT": 2, "TA": 2, "GT": 1, "TG": 1}
STEMS = range(4, 14)
LOOPS = range(3, 9)
PAIRED = 0.75
GEOMETRY = "struct<stem_start:int,stem_length:int,loop_length:int,loop_start:int,loop_end:int,hairpin_end:int,score:double,pair_fraction:double,gu_count:int,proximal_gc:double>"
_CODE = np.full(256, 4, np.int8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _i
_SCORE = np.zeros((5, 5), np.int16)
for _p, _s in PAIRS.items():
    _SCORE["ACGT".index(_p[0]), "ACGT".index(_p[1])] = _s
#: Divisible by every stem length: shares compare as whole numbers.
_WHOLE = 360360


def best_hairpins(sequences: list[str], upstream: int = 0, downstream: int = 0) -> dict[str, np.ndarray]:
    """Columns of the geometry of each sequence; ``stem_length`` 0 where none has enough pairs."""
    n = len(sequences)
    width = max([len(s) for s in sequences] + [1])
    code = np.full((n, width), 4, np.int8)
    for k, s in enumerate(sequences):
        code[k, : len(s)] = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    size = np.array([len(s) for s in sequences], np.int64)
    best = np.full(n, -1, np.int64)
    got = {c: np.zeros(n, np.int64) for c in ("start", "stem", "loop", "twice", "pairs", "gu", "gc2")}
    place = np.arange(width)
    for loop in LOOPS:
        inner = np.zeros((n, width), np.int64)
        pairs, gu, gc2 = inner.copy(), inner.copy(), inner.copy()
        for t in range(1, max(STEMS) + 1):
            # the t-th pair from the loop of a loop that begins at each place
            left, right = place - t, place + loop + t - 1
            ok = (left >= 0) & (right < width)
            s = np.zeros((n, width), np.int64)
            s[:, ok] = _SCORE[code[:, left[ok]], code[:, right[ok]]]
            inner += s
            pairs += s > 0
            gu += s == 1
            if t <= 2:
                gc2 += s == 3
            if t not in STEMS:
                continue
            fits = (left >= upstream)[None, :] & (right[None, :] + 1 + downstream <= size[:, None]) & (left >= 0)[None, :] & (4 * pairs >= 3 * t)
            twice = 2 * inner - abs(loop - 4)
            key = ((((((twice + 64) << 19) + pairs * (_WHOLE // t)) << 4) + t << 3) + 7 - abs(loop - 4) << 4) + 15 - loop
            key = np.where(fits, key, -1)
            at = key.argmax(axis=1)
            value = key[np.arange(n), at]
            new = value > best
            best = np.where(new, value, best)
            for c, x in (("start", at - t), ("stem", np.full(n, t)), ("loop", np.full(n, loop)), ("twice", twice[np.arange(n), at]), ("pairs", pairs[np.arange(n), at]), ("gu", gu[np.arange(n), at]), ("gc2", gc2[np.arange(n), at])):
                got[c] = np.where(new, x, got[c])
    return got


#: Bases of a slice, padding included; one longer sequence makes a slice of its own.
CELLS = 1 << 21


def length_slices(sizes: np.ndarray, cells: int = CELLS) -> list[np.ndarray]:
    """Rows by ascending length in slices whose padded arrays hold at most ``cells`` bases."""
    order = np.argsort(sizes, kind="stable")
    out, a = [], 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * max(int(sizes[order[b]]), 1) <= cells:
            b += 1
        out.append(order[a:b])
        a = b
    return out


def hairpin(sequence: Column, upstream: int = 0, downstream: int = 0) -> Column:
    """Geometry struct of the best hairpin with so many bases on either side, null where there is none.

    Null and empty sequences have none. A filter on the result is not pushed below the search, which would run it twice."""
    names = ("stem_start", "stem_length", "loop_length", "loop_start", "loop_end", "hairpin_end", "score", "pair_fraction", "gu_count", "proximal_gc")

    @F.arrow_udf(GEOMETRY)
    def search(s: pa.Array) -> pa.Array:
        texts = [x or "" for x in s.to_pylist()]
        g = {c: np.zeros(len(texts), np.int64) for c in ("start", "stem", "loop", "twice", "pairs", "gu", "gc2")}
        for rows in length_slices(np.array([len(x) for x in texts], np.int64)):
            for c, x in best_hairpins([texts[i] for i in rows], upstream, downstream).items():
                g[c][rows] = x
        start, stem, loop = g["start"], g["stem"], g["loop"]
        whole = (start, stem, loop, start + stem, start + stem + loop, start + 2 * stem + loop)
        cols = [*(pa.array(x, pa.int32()) for x in whole), pa.array(g["twice"] / 2.0), pa.array(g["pairs"] / np.maximum(stem, 1)), pa.array(g["gu"], pa.int32()), pa.array(g["gc2"] / 2.0)]
        return pa.StructArray.from_arrays(cols, names=list(names), mask=pa.array(stem == 0))

    return search.asNondeterministic()(sequence)
