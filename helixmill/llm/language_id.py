"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed letter n-grams; each language has a few centroids from
spherical k-means; the nearest centroid by cosine names the language. A text farther from its centroid than the
language's limit is rejected (``rejected``), with ``lang_pred`` kept as the nearest language.

Texts that are null or hold no letter get ``und``, score 0 and are rejected. The model is fitted on at most
``PER_LANGUAGE`` different labelled rows of each language (and ``FITTED`` in all), those with the smallest hash of id and
text; every text is predicted as a whole. With no labelled row there is no model: every text is ``und`` with score 0, and
those with letters are not rejected. Of centroids at equal cosine the first language by name is taken. Repeated rows get
equal results, empty tables give empty ones, and columns that had the names of new ones are replaced."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import carried, restored, slices

DIMS = 4096
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 500
#: Rows that a model is fitted on at most; more languages than this are refused.
FITTED = 20_000
CENTROIDS = 4
#: A text is rejected below this part of the cosine that all but one in a thousand fitted texts reach. Both are
#: taken relative to what so few n-grams can reach: the square root of their share of the usual number.
SLACK = 0.4
#: Rows and bytes that are counted at once.
ROWS = 256
BLOCK = 1 << 20


def counts(texts: pa.Array) -> np.ndarray:
    """float32[n, DIMS]: n-gram counts of the lower-cased letters of each text (bytes of UTF-8, words apart)."""
    n = len(texts)
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    size = pc.binary_length(clean).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(clean.cast(pa.binary()).to_pylist()), np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    out = np.zeros(n * DIMS)
    for order in ORDERS:
        for a in range(0, len(raw) - order + 1, BLOCK):
            m = min(BLOCK, len(raw) - order + 1 - a)
            code = np.zeros(m, np.uint32)
            for k in range(order):
                code = (code << np.uint32(8)) | raw[a + k : a + k + m]
            first = row[a : a + m]
            whole = first == row[a + order - 1 : a + order - 1 + m]
            code = code[whole] + np.uint32(order)
            code = ((code ^ (code >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(20)
            first = first[whole]
            if len(first):  # rows are in order
                low, high = int(first[0]), int(first[-1]) + 1
                out[low * DIMS : high * DIMS] += np.bincount((first - low).astype(np.int64) * DIMS + code, minlength=(high - low) * DIMS)
    return out.reshape(n, DIMS).astype(np.float32)


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows: begun at the mean and then the rows farthest from all so far."""
    first = unit(x.mean(axis=0, keepdims=True))
    seeds = [first[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[np.argmin((x @ np.stack(seeds).T).max(axis=1))])
    c = unit(np.stack(seeds))
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limit: np.ndarray
    names: list[str]
    usual: float

    def vectors(self, c: np.ndarray) -> np.ndarray:
        return unit(np.log1p(c) * self.idf)

    def nearest(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, and whether it is too far, of each row of counts."""
        cos = self.vectors(c) @ self.centroids.T
        best = cos.argmax(axis=1)
        which, top = self.owner[best], cos[np.arange(len(cos)), best].clip(0, 1)
        return which, top, top < self.limit[which] * reach(c, self.usual)


def reach(c: np.ndarray, usual: float) -> np.ndarray:
    return np.sqrt(np.minimum((c > 0).sum(axis=1) / usual, 1))


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, clusters: int = CENTROIDS) -> LanguageModel | None:
    """A model from the rows (doc_id, text, lang) of ``train``; rows without text or lang don't count."""
    rows = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("_key"))
    size = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(FITTED + 1).collect()}
    if len(size) > FITTED:
        raise ValueError(f"more than {FITTED} languages are labelled")
    if not size:
        return None
    few = first_keys(rows, size, min(per_language, FITTED // len(size)))
    sample = rows.join(F.broadcast(few), ["lang", "_key"], "left_semi").dropDuplicates(["lang", "_key"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                letters = has_letter(part.column("text"))
                c = np.minimum(counts(part.column("text")), 65535).astype("<u2")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([x.tobytes() if ok else None for x, ok in zip(c, letters, strict=True)], pa.binary())], ["doc_id", "lang", "counts"])

    got = sorted(((r[1], r[0], bytes(r[2])) for r in sample.mapInArrow(count, "doc_id long, lang string, counts binary").collect() if r[2] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    if not got:
        return None
    names = sorted({r[0] for r in got})
    lang = np.array([names.index(r[0]) for r in got])
    c = np.stack([np.frombuffer(r[2], "<u2") for r in got]).astype(np.float32)
    idf = (np.log((1 + len(c)) / (1 + (c > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(np.log1p(c) * idf)
    parts = [spherical_means(x[lang == j], clusters) for j in range(len(names))]
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts])
    usual = float(np.median((c > 0).sum(axis=1)))
    limit = np.array([SLACK * np.quantile((x[lang == j] @ p.T).max(axis=1) / reach(c[lang == j], usual), 0.001) for j, p in enumerate(parts)])
    return LanguageModel(idf, np.concatenate(parts).astype(np.float32), owner, limit, names, usual)


def first_keys(rows: DataFrame, size: dict[str, int], most: int) -> DataFrame:
    """(lang, _key) of the ``most`` smallest different keys of each language, of which there are FITTED at most in all.

    Keys are hashes, evenly spread, so one below a language's bound is among so few that a window can hold them. Copies of a
    row count once; a language whose bound leaves too few keys has its bound raised."""
    room = {lang: min(1.0, 4.0 * most / n) for lang, n in size.items()}
    while True:
        bounds = [(lang, (1 << 63) - 1 if share >= 1 else int(share * (1 << 64)) - (1 << 63)) for lang, share in room.items()]
        limits = F.broadcast(rows.sparkSession.createDataFrame(bounds, "lang string, _bound long"))  # one row for each language
        keys = rows.join(limits, "lang").where("_key <= _bound").select("lang", "_key").distinct()
        order = Window.partitionBy("lang").orderBy("_key")
        got = [(r[0], r[1]) for r in keys.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("lang", "_key").collect()]
        have = Counter(lang for lang, _ in got)
        short = [lang for lang in room if have[lang] < most and room[lang] < 1]
        if not short:
            return rows.sparkSession.createDataFrame(got, "lang string, _key long")
        room |= {lang: min(1.0, 16 * room[lang]) for lang in short}


def tell(text: Column, model: LanguageModel | None) -> Column:
    """struct<lang_pred, score, rejected> of a text."""

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def told(v: pa.Array) -> pa.Array:
        names, scores, rejects = [], [], []
        for part in slices(iter([pa.RecordBatch.from_arrays([v], ["t"])]), "t", BLOCK):
            for k in range(0, part.num_rows, ROWS):
                t = part.column("t").slice(k, ROWS)
                ok = has_letter(t)
                which, cos, far = model.nearest(counts(t)) if model else (np.zeros(len(t), int), np.zeros(len(t)), np.zeros(len(t), bool))
                names += [model.names[w] if y and model else "und" for w, y in zip(which, ok, strict=True)]
                scores.append(np.where(ok, cos, 0.0))
                rejects.append(~ok | far)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), flat(scores, pa.float64()), flat(rejects, pa.bool_())], names=["lang_pred", "score", "rejected"])

    # so marked, a filter on the result doesn't make the planner work it out a second time
    return told.asNondeterministic()(text)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``rejected`` to the columns of ``docs``; columns that had these names are replaced."""
    rows = carried(docs, tell(F.col("text"), model).alias("_told"))
    return restored(rows, docs.columns, **{c: F.col(f"_told.{c}") for c in ("lang_pred", "score", "rejected")})


def held_out(doc_id: str = "doc_id"):
    """A fifth of the rows, by a hash of their id, that no model is fitted on."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0
