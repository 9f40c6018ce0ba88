"""Homomorphic multiset fingerprints of documents.

A paragraph (line) is hashed to a wide vector: EXACT lanes of 64 bits for equality, and SKETCH lanes of 16 bits
where each 3-word run of the paragraph adds or takes one. A document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo its power of two: the order of paragraphs doesn't matter, and a paragraph is inserted
or deleted by adding or subtracting its vector. The likeness of two fingerprints is 2<a,b> / (<a,a> + <b,b>) of
the signed sketch lanes, from 0 to 1; equal fingerprints have 1.

Null texts count as empty (one empty paragraph). Repeated rows have equal fingerprints. Null ids come first in
the order of ids; equal ids are ordered by text."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices

EXACT = 8
SKETCH = 256
RUN = 3
LOWEST = -(1 << 63)
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word, computed once for each different word."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    if not len(coded):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy()]


def vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of paragraph vectors of each text: uint64[n, EXACT] and int64[n, SKETCH] (not yet reduced)."""
    n = len(texts)
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    raw = b"".join(hashlib.blake2b(x, digest_size=8 * EXACT).digest() for x in lines.cast(pa.binary()).to_pylist())
    digests = np.frombuffer(raw, "<u8").reshape(-1, EXACT)
    first = np.searchsorted(parent, np.arange(n))
    exact = np.add.reduceat(digests, first, axis=0) if n else np.zeros((0, EXACT), np.uint64)
    words = pc.ascii_split_whitespace(lines)
    line = pc.list_parent_indices(words).to_numpy()
    flat = words.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    line, h = line[real], word_hashes(flat)[real]
    m = len(h)
    total, same, start = np.zeros(m, np.uint64), np.ones(m, bool), np.concatenate([[True], line[1:] != line[:-1]])[:m]
    with np.errstate(over="ignore"):
        for k in range(RUN):
            have = np.zeros(m, bool)
            have[: m - k] = line[k:] == line[: m - k] if k else True
            shifted = np.zeros(m, np.uint64)
            shifted[: m - k] = h[k:]
            total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(have, shifted, np.uint64(0))
            same &= have
        total = mix64(total)
    use = same | (start & ~same)  # shorter paragraphs count as one run
    t = total[use]
    cell = parent[line[use]].astype(np.int64) * SKETCH + (t % np.uint64(SKETCH)).astype(np.int64)
    sign = 1.0 - 2.0 * ((t >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    return exact, np.bincount(cell, sign, n * SKETCH).astype(np.int64).reshape(n, SKETCH)


def reduced(sketch: np.ndarray) -> np.ndarray:
    """Lanes modulo 2**16, as signed values."""
    return sketch.astype(np.int16)


def text_form(exact: np.ndarray, sketch: np.ndarray) -> list[str]:
    return [base64.b64encode(a.astype("<u8").tobytes() + b.astype("<i2").tobytes()).decode() for a, b in zip(exact, reduced(sketch), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, of reduced sketch lanes."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    both = (x * x).sum(1) + (y * y).sum(1)
    return np.where(both > 0, np.clip(2 * (x * y).sum(1) / np.maximum(both, 1), 0, 1), 1.0)


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of a text column."""

    @F.arrow_udf("string")
    def own(v: pa.Array) -> pa.Array:
        out = []
        for part in slices(iter([pa.RecordBatch.from_arrays([v], ["t"])]), "t"):
            out += text_form(*vectors(part.column("t")))
        return pa.array(out, pa.string())

    return df.withColumn(name, own(F.col(text)))


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of a text with the paragraphs of b inserted (1) or deleted (-1)."""
    x, y = base64.b64decode(a), base64.b64decode(b)
    head = 8 * EXACT
    with np.errstate(over="ignore"):
        exact = np.frombuffer(x[:head], "<u8") + np.uint64(sign % (1 << 64)) * np.frombuffer(y[:head], "<u8")
        sketch = np.frombuffer(x[head:], "<i2").astype(np.int64) + sign * np.frombuffer(y[head:], "<i2").astype(np.int64)
    return text_form(exact[None], sketch[None])[0]


def with_next(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Deals rows (doc_id, text) out to ranges of ids: own rows in order, then copies of the next range's first rows.

    Only one id for each range, of which there are as many as shuffle partitions, reaches the driver."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(LOWEST)).alias("_key"))
    cuts = sorted({int(x) for x in df.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n)}) if n > 1 else []
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="right").astype(np.int32))

    heads = sorted((r[0], r[1]) for r in df.groupBy(part("_key").alias("p")).agg(F.min("_key")).collect())
    before = {key: heads[k - 1][0] for k, (_, key) in enumerate(heads)}  # the last range, for the first key
    head_keys = np.array(sorted(before), np.int64)
    head_to = np.array([before[k] for k in sorted(before)], np.int32)

    @F.pandas_udf("array<int>")
    def dealt(key: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        own = np.searchsorted(bounds, k, side="right")
        i = np.minimum(np.searchsorted(head_keys, k), max(len(head_keys) - 1, 0))
        return pd.Series([[int(p), -1 - int(head_to[j])] if head_keys[j] == x else [int(p)] for p, j, x in zip(own, i, k, strict=True)])

    rows = df.withColumn("_to", F.explode(dealt("_key"))).withColumn("_copy", F.col("_to") < 0)
    rows = rows.withColumn("_part", F.when(F.col("_copy"), -1 - F.col("_to")).otherwise(F.col("_to"))).drop("_to")
    return rows.repartition(n, "_part").sortWithinPartitions("_part", "_copy", "_key", "text")


def edited_fingerprints(df: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edit (the last quarter replaced by the next text's beginning), and likenesses."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in slices(batches, "text"):
            exact, sketch = vectors(batch.column("text"))
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, parts, copies = (batch.column(c).to_pylist() for c in ("doc_id", "_part", "_copy"))
            if carry:
                texts, ids, parts, copies = [carry[0], *texts], [carry[1], *ids], [carry[2], *parts], [False, *copies]
                exact, sketch = np.concatenate([carry[3], exact]), np.concatenate([carry[4], sketch])
            at = [i for i in range(len(ids) - 1) if not copies[i] and parts[i] == parts[i + 1]]
            carry = None if copies[-1] else (texts[-1], ids[-1], parts[-1], exact[-1:], sketch[-1:])
            if not at:
                continue
            old, new, digests = [], [], []
            for i in at:
                t, cut = texts[i], len(texts[i]) - len(texts[i]) // 4
                line = t.rfind("\n", 0, cut) + 1
                added = texts[i + 1][: len(t) - cut]
                old.append(t[line:])
                new.append(t[line:cut] + added)
                digests.append(hashlib.sha256((t[:cut] + added).encode()).hexdigest())
            gone, come = vectors(pa.array(old, pa.string())), vectors(pa.array(new, pa.string()))
            e, s = exact[at] - gone[0] + come[0], sketch[at] - gone[1] + come[1]
            here, there, after = reduced(sketch[at]), reduced(s), reduced(sketch[[i + 1 for i in at]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()), pa.array(digests), pa.array(text_form(exact[at], sketch[at])), pa.array(text_form(e, s)), pa.array(likeness(here, there)), pa.array(likeness(here, after))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return with_next(df, ranges).mapInArrow(walk, EDITED)
