"""Quality scores: words, contexts and pooling by brute force, held-out accuracy, calibration, odd rows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helixmill.llm import quality_network as Q
from helixmill.llm.queries import QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st

from ..conftest import SF_DIR


def plain_words(text: str) -> list[str]:
    return [w for run in re.findall(r"[^\x00-\x20]+", text) for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\u0080-\U0010ffff]+", run)]


def name(word: str) -> tuple[str, bool]:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), word), len(word.encode()) > 1 and bool(re.fullmatch("[A-Z]+", word))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "A", "b", "B", "9", "é", ".", "!", " ", "\n", "long", "longer", "words"]), max_size=40).map("".join), max_size=6), st.sampled_from([7, 1 << 20]))
def test_words_are_told_apart(texts, block):
    old, Q.BLOCK = Q.BLOCK, block
    try:
        hashes, row = Q.words(pa.array(texts, pa.string()))
    finally:
        Q.BLOCK = old
    want = [(k, name(w)) for k, t in enumerate(texts) for w in plain_words(t)]
    assert row.tolist() == [k for k, _ in want]
    known: dict = {}
    for h, (_, w) in zip(hashes.tolist(), want, strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_contexts_and_pooling_by_brute_force(monkeypatch):
    texts = ["the cat sat. the cat ran!", "", None, "one", "a b a b a b " * 40, "THE END !!"]
    hashes, row = Q.words(pa.array(texts, pa.string()))
    total = np.zeros((Q.SLOTS, Q.DIMS + 1), np.int64)
    Q.add_contexts(total, hashes, row)
    want = np.zeros_like(total)

    def index(h: int) -> np.ndarray:
        v = np.zeros(Q.DIMS, np.int64)
        for e in range(Q.ENTRIES):
            v[(h >> (6 * e)) & (Q.DIMS - 1)] += 1 if (h >> (32 + e)) & 1 else -1
        return v

    own = hashes.tolist()
    for i, h in enumerate(own):
        want[h >> 50, Q.DIMS] += 1
        for j in range(max(0, i - Q.WINDOW), min(len(own), i + Q.WINDOW + 1)):
            if j != i and row[i] == row[j]:
                want[h >> 50, : Q.DIMS] += index(own[j])
    assert (total == want).all()
    vectors = np.random.default_rng(2).normal(size=(Q.SLOTS, Q.DIMS)).astype("f4")
    monkeypatch.setattr(Q, "POOLED", 16)
    got = Q.pooled(pa.array(texts, pa.string()), vectors)
    for k in range(len(texts)):
        v = vectors[[h >> 50 for h, r in zip(own, row, strict=True) if r == k]].astype(float)
        n = max(len(v), 1)
        mean = v.sum(axis=0) / n
        plain = [*mean, *np.sqrt(np.maximum((v**2).sum(axis=0) / n - mean**2, 0)), np.linalg.norm(mean), *((v[:-s] * v[s:]).sum() / n for s in range(1, Q.WINDOW + 1)), np.log1p(len(v))]
        assert got[k] == pytest.approx(plain, rel=1e-4, abs=1e-4)


def auc(y: np.ndarray, p: np.ndarray) -> float:
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]))


def test_op12_contract_and_held_out_rows(spark):
    rows = QUERIES["op12_quality_network"](spark, SF_DIR).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_accuracy_and_calibration(spark):
    """Of a hundredth-scale table: clean rows stay, junk is told apart, probabilities are near the shares."""
    folder = SF_DIR.replace("sf0.001", "sf0.01")
    told = {r.doc_id: r for r in QUERIES["op12_quality_network"](spark, folder).collect()}
    labels = [(told[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in told]
    held = [(r.score, r.predicted, y) for r, y in labels if r.held_out]
    p, predicted, y = (np.array(x) for x in zip(*held, strict=True))
    assert auc(y, p) >= 0.9
    assert predicted[y == 1].mean() >= 0.97 and predicted[y == 0].mean() <= 0.3
    assert abs(p.mean() - y.mean()) < 0.05


def test_labels_of_held_out_rows_and_other_columns_are_no_inputs(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.createDataFrame([(r.doc_id, r.doc_id % 2) for r in docs.collect()] + [(None, 1), (3, None), (4, 0), (4, 1), (5, 7)], "doc_id long, quality int")
    a, b = (Q.fit(docs, x) for x in (labels, labels.where("doc_id >= 0 and quality < 2")))
    assert (a.network.first == b.network.first).all() and a.network.temperature == b.network.temperature


def test_temperature_mends_overconfidence():
    r = np.random.default_rng(3)
    z = r.normal(size=4000)
    y = (r.random(4000) < Q.sigmoid(z)).astype(float)
    sure = Q.Network(np.zeros(1), np.ones(1), np.array([[1e-3]]), np.zeros(1), np.array([5e3]), 0.0)
    assert Q.calibrated(sure, z[:, None], y).temperature == pytest.approx(5, rel=0.15)


def test_odd_rows(odd, clashing, nothing, spark):
    labels = spark.createDataFrame([(6, 1), (7, 0), (9, 1), (4, 0)], "doc_id long, quality int")
    model = Q.fit(odd, labels)
    rows = Q.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    score = {(r.doc_id, r.text): r.score for r in rows}
    assert score[1, None] == score[2, ""] == score[3, "   \n\t "] and score[4, "one"] == score[5, "one"]
    got = Q.predict(clashing.withColumn("predicted", odd_text()), model)
    assert set(got.columns) == {*clashing.columns, "predicted"} and {r.predicted for r in got.select("predicted").collect()} <= {0, 1}
    assert Q.predict(nothing, model).count() == 0
    none = Q.fit(odd, labels.where("quality = 5"))
    assert {(r.score, r.predicted) for r in Q.predict(odd, none).collect()} == {(0.5, 1)}
    assert Q.fit(nothing, labels).network is None


def odd_text():
    from pyspark.sql import functions as F

    return F.lit("mine")
