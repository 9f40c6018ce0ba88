"""Quality classifier: random-indexing word vectors, pooled per document, and a small network with calibrated probabilities.

A word's index vector has a few entries of +1 or -1 by its hash. Its word vector is the sum of the index vectors of the words
up to ``WINDOW`` places away, over all texts: tasks add them up for ``SLOTS`` hashed slots of words, Spark sums the slots, and
the driver gets one table of that fixed size, which it centres and scales. A document is the mean and the deviation of its
words' vectors, the length of the mean, how alike neighbours are, and how many words there are. A two-layer network learns from
at most ``FITTED`` labelled rows; a quarter of them, by a hash of the id, only sets the temperature of its probabilities.

Words are runs of letters, digits and bytes beyond ASCII, or of other signs; case is told only of words all in capitals. Null
texts count as empty ones; documents without a word get the score of a document of zeros. Without labelled rows every
score is 0.5. Rows with a null or another label than 0 and 1, or with two different ones for an id, are left out. Repeated rows
get equal scores, empty tables give empty ones, and columns that had the names of new ones are replaced. Texts count as a whole,
of any length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, mix64, powers, restored, slices

#: Slots of hashed words, components of a vector, entries of an index vector, neighbours on each side.
SLOTS = 1 << 14
DIMS = 64
ENTRIES = 4
WINDOW = 2
#: Labelled rows that a network is fitted on at most, those with the smallest hash of their id.
FITTED = 20_000
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.3
#: Bytes of text that are cut into words at once, and words that are pooled at once.
BLOCK = 1 << 20
POOLED = 1 << 15

KIND = np.full(256, 2, np.uint8)
KIND[:33] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of some bytes, in blocks that end between words."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        if end < len(raw):
            gap = np.flatnonzero(KIND[raw[at:end]] == 0)
            while not len(gap) and end < len(raw):  # a word longer than a block
                end = min(end + BLOCK, len(raw))
                gap = np.flatnonzero(KIND[raw[at:end]] == 0)
            if len(gap) and end < len(raw):
                end = at + int(gap[-1]) + 1
        own = raw[at:end]
        kind = KIND[own]
        start = (kind != 0) & np.concatenate([[True], kind[1:] != kind[:-1]])
        first = np.flatnonzero(start)
        if len(first):
            inside = np.flatnonzero(kind != 0)
            word = np.cumsum(start)[inside] - 1
            place = inside - first[word]
            power = powers(int(place.max()) + 1)
            cuts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            h = np.add.reduceat((LOWER[own[inside]].astype(np.uint64) + np.uint64(1)) * power[place], cuts)
            upper = np.minimum.reduceat(((own[inside] >= 65) & (own[inside] <= 90)).astype(np.uint8), cuts)
            size = np.diff(np.append(cuts, len(inside)))
            hashes.append(mix64(h + ((upper > 0) & (size > 1)).astype(np.uint64) * np.uint64(0x51_7CC1B727220A95)))
            places.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of some texts."""
    filled = pc.fill_null(texts, "").cast(pa.binary())
    size = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    hashes, places = word_hashes(np.frombuffer(b" ".join([*filled.to_pylist(), b""]), np.uint8))
    return hashes, np.searchsorted(np.cumsum(size), places, side="right")


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(50)).astype(np.int64)


def index_entries(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component, sign) of the entries of each word's index vector."""
    shift = np.arange(ENTRIES, dtype=np.uint64)
    parts = ((hashes[:, None] >> (np.uint64(6) * shift)) & np.uint64(DIMS - 1)).astype(np.int64)
    signs = ((hashes[:, None] >> (np.uint64(32) + shift)) & np.uint64(1)).astype(np.int64) * 2 - 1
    return parts, signs


def add_contexts(total: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> None:
    """Adds the index vectors of all words' neighbours to int64[SLOTS, DIMS + 1]; the last component counts words."""
    slot = slot_of(hashes)
    total[:, DIMS] += np.bincount(slot, minlength=SLOTS)
    parts, signs = index_entries(hashes)
    for k in range(1, WINDOW + 1):
        same = np.flatnonzero(row[k:] == row[:-k])
        for own, other in ((same, same + k), (same + k, same)):
            flat = (slot[own][:, None] * DIMS + parts[other]).ravel()
            total[:, :DIMS] += np.bincount(flat, weights=signs[other].ravel(), minlength=SLOTS * DIMS).reshape(SLOTS, DIMS).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """float32[SLOTS, DIMS]: centred unit vectors of all texts' words; slots without a word are zeros."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, DIMS + 1), np.int64)
        for batch in slices(batches, "text", BLOCK):
            add_contexts(total, *words(batch.column("text")))
        some = np.flatnonzero(total[:, DIMS])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(total[some, i]) for i in range(DIMS + 1))], ["slot", *(f"c{i}" for i in range(DIMS + 1))])

    names = [f"c{i}" for i in range(DIMS + 1)]
    told = docs.select("text").mapInArrow(add, "slot int, " + ", ".join(f"{c} long" for c in names))
    got = told.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names)).toArrow()  # SLOTS rows at most
    out = np.zeros((SLOTS, DIMS))
    count = np.zeros(SLOTS)
    if got.num_rows:
        slot = got.column("slot").to_numpy()
        out[slot] = np.stack([got.column(f"c{i}").to_numpy() for i in range(DIMS)], axis=1)
        count[slot] = got.column(f"c{DIMS}").to_numpy()
        out /= np.maximum(count, 1)[:, None]
        out[count > 0] -= (out * count[:, None]).sum(axis=0) / count.sum()
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


#: Values of a document: mean and deviation by component, length of the mean, likeness of neighbours, size.
VALUES = 2 * DIMS + WINDOW + 2


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """float32[n, VALUES] of some texts; words are pooled in blocks, so a long text takes no more room than its words' hashes."""
    hashes, row = words(texts)
    n = len(texts)
    size = np.maximum(np.bincount(row, minlength=n), 1)
    mean, square, alike = np.zeros((n, DIMS)), np.zeros((n, DIMS)), np.zeros((n, WINDOW))
    slot = slot_of(hashes)
    for a in range(0, len(slot), POOLED):
        v = vectors[slot[a : a + POOLED + WINDOW]].astype(float)
        r = row[a : a + POOLED + WINDOW]
        own = min(POOLED, len(slot) - a)
        cuts = np.flatnonzero(np.concatenate([[True], r[1:own] != r[: own - 1]]))
        mean[r[cuts]] += np.add.reduceat(v[:own], cuts, axis=0)
        square[r[cuts]] += np.add.reduceat(v[:own] ** 2, cuts, axis=0)
        for k in range(1, WINDOW + 1):
            left = min(own, len(r) - k)
            if left > 0:
                same = r[:left] == r[k : k + left]
                alike[:, k - 1] += np.bincount(r[:left], weights=same * (v[:left] * v[k : k + left]).sum(axis=1), minlength=n)
    mean /= size[:, None]
    deviation = np.sqrt(np.maximum(square / size[:, None] - mean**2, 0))
    return np.concatenate([mean, deviation, np.linalg.norm(mean, axis=1, keepdims=True), alike / size[:, None], np.log1p(np.bincount(row, minlength=n))[:, None]], axis=1).astype(np.float32)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    offset: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.first + self.bias) @ self.second + self.offset

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = 128, decay: float = 1e-3, seed: int = 7) -> Network:
    """Two layers by stochastic gradients (Adam) on the log loss."""
    r = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = (x - centre) / scale
    p = [r.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), r.normal(size=hidden) / np.sqrt(hidden), np.array([0.0])]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs) + 1e-5
        order = r.permutation(len(z))
        for a in range(0, len(z), batch):
            own = order[a : a + batch]
            h = np.tanh(z[own] @ p[0] + p[1])
            g = (sigmoid(h @ p[2] + p[3]) - y[own]) / len(own)
            back = np.outer(g, p[2]) * (1 - h * h)
            t += 1
            for i, grad in enumerate((z[own].T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))


def calibrated(network: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature with the least log loss on rows that the network has not seen, by golden section on its logarithm."""
    z = network.logits(x)
    a, b = np.log(0.1), np.log(20.0)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if log_loss(z / np.exp(c), y) < log_loss(z / np.exp(d), y) else (c, b)
    network.temperature = float(np.exp((a + b) / 2))
    return network


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network | None


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> QualityModel:
    """Word vectors of all ``docs``, and a network from the rows of ``docs`` that ``labels`` (key, label) names."""
    vectors = word_vectors(docs)
    good = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.min(label).cast("int").alias("_low"), F.max(label).cast("int").alias("_high"))
    few = good.where("_low = _high").select(F.col(key).alias("_id"), F.col("_low").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(FITTED)
    rows = docs.select(F.col(key).alias("_id"), "text").join(F.broadcast(few), "_id")  # FITTED rows at most

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            x = pooled(batch.column("text"), vectors)
            yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_label"), pa.array(list(x), pa.list_(pa.float32()))], ["id", "label", "x"])

    own = rows.mapInArrow(values, "id string, label int, x array<float>").select("label", "x", F.crc32("id").alias("h"), "id")
    got = sorted(own.toArrow().to_pylist(), key=lambda r: (r["h"], r["id"], r["x"]))
    if not got:
        return QualityModel(vectors, None)
    x, y = np.array([r["x"] for r in got], float), np.array([r["label"] for r in got], float)
    aside = np.array([(r["h"] // 5) % 4 == 0 for r in got])
    if aside.all() or not aside.any():
        return QualityModel(vectors, train(x, y))
    return QualityModel(vectors, calibrated(train(x[~aside], y[~aside]), x[aside], y[aside]))


def score(text: Column, model: QualityModel) -> Column:
    """Probability that a text's label is 1."""

    @F.arrow_udf("double")
    def told(v: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in slices(iter([pa.RecordBatch.from_arrays([v], ["t"])]), "t", BLOCK):
            out.append(model.network.probability(pooled(part.column("t"), model.vectors).astype(float)) if model.network else np.full(part.num_rows, 0.5))
        return pa.array(np.concatenate(out))

    return told.asNondeterministic()(text)


def predict(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` and ``predicted`` to the columns of ``docs``; columns that had these names are replaced."""
    rows = carried(docs, score(F.col("text"), model).alias("_score"))
    return restored(rows, docs.columns, score=F.col("_score"), predicted=(F.col("_score") >= threshold).cast("int"))
