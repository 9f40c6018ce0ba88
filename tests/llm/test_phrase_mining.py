"""Phrase mining against plain counting and SQL."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helixmill.llm import phrase_mining as P
from helixmill.llm.queries import QUERIES, phrases_sql
from hypothesis import given, settings
from hypothesis import strategies as st

from ..conftest import assert_same


def pieces(text: str | None) -> list[list[str]]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n-\r]", low)]


def plain(rows: list[tuple], least: int, most: int) -> list[tuple]:
    f: dict[str, Counter] = {}
    for lang, text in rows:
        own = f.setdefault(lang or "und", Counter())
        for words in pieces(text):
            for k in range(1, 6):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for w, v in c.items() if len(w) == 1)
        good = {w: v for w, v in c.items() if len(w) > 1 and v >= least}
        held = {w[i:j] for w, v in good.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * v >= 100 * good.get(w[i:j], v + 1)}
        told = []
        for w, a in good.items():
            score, k = min((1000 * a * n // (c[w[:k]] * c[w[k:]]), k) for k in range(1, len(w)))
            if w not in held:
                told.append((-score, -a, " ".join(w).encode(), c[w[:k]], c[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(told)[:most])]
    return sorted(out)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", " ", "é", ".", "!", "\t", "\n", "long", "longer", "words"]), max_size=30).map("".join), max_size=5), st.sampled_from([5, 1 << 20]))
def test_words_pieces_and_scan(texts, block):
    old, P.BLOCK = P.BLOCK, block
    try:
        raw = P.joined(pa.array(texts, pa.string()))
        hashes, piece, first, last = P.words(raw)
    finally:
        P.BLOCK = old
    want = [(k, j, w) for k, t in enumerate(texts) for j, p in enumerate(pieces(t)) for w in p]
    low = P.LOWER[raw].tobytes()
    assert [low[a:b].decode() for a, b in zip(first, last, strict=True)] == [w for *_, w in want]
    same = [(a == b) for a, b in zip(piece, piece[1:], strict=False)]
    assert same == [x[:2] == y[:2] for x, y in zip(want, want[1:], strict=False)]
    assert len({*zip(hashes.tolist(), (w for *_, w in want), strict=True)}) == len({w for *_, w in want}) == len({*hashes.tolist()})
    assert [p.split() for p in P.scanned(texts).split("\n") if p.split()] == [p for t in texts for p in pieces(t) if p]


def corpus() -> list[tuple]:
    r = np.random.default_rng(6)
    word = lambda: "w" + str(int(r.zipf(1.6)) % 40)
    rows = [(("en", "de", None, "und")[k % 4], "".join(word() + (" ", " ", " ", "\t ", ". ", ",\n", "!")[int(r.integers(7))] for _ in range(60))) for k in range(80)]
    rows += [("en", "The quick Brown fox, the quick brown fox jumps over the lazy dog!")] * 9
    return rows + [("en", None), ("en", ""), ("de", "a a a a a a a a a a a a"), ("fr", "   "), ("es", "x"), ("en", "É é É é É é É é É é"), ("en", "z" * 5000 + " q")]


@pytest.mark.parametrize(("cells", "patterns"), [(1 << 27, 250_000), (1 << 15, 40)])
def test_equals_plain_counting(spark, cells, patterns):
    rows = corpus()
    docs = spark.createDataFrame([(i, *r, "x", "x", "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n string, cell string").repartition(3)
    got = P.mine(docs, least=6, most=50, cells=cells, patterns=patterns)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, 50)


def test_texts_are_scanned_once(spark, monkeypatch):
    """Tables are written as often for many groups of candidates as for one, and parts of a task's texts change no count."""
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    told, keep = [], P.Scratch.keep
    monkeypatch.setattr(P.Scratch, "keep", lambda self, df, label: told.append(label) or keep(self, df, label))
    for name, size in (("BLOCK", 300), ("PART", 900), ("HELD", 500)):
        monkeypatch.setattr(P, name, size)
    assert sorted(map(tuple, P.mine(docs, least=6, most=50, patterns=7).collect())) == plain(rows, 6, 50)
    assert len(told) <= 4


def test_sketch_leaves_candidates_out(spark):
    docs = spark.createDataFrame(corpus(), "lang string, text string").selectExpr("coalesce(lang, 'und') AS lang", "text")
    cells = P.passing_cells(docs, 6, 1 << 27, lambda r: [r.cells(1, np.arange(len(r.hash))), r.cells(2, np.flatnonzero(r.same(2)))])
    own: Counter = Counter()
    for lang, text in corpus():
        for words in pieces(text):
            own.update((lang or "und", *words[i : i + k]) for k in (1, 2) for i in range(len(words) - k + 1))
    rows = cells.collect()
    assert sum(r.cell is not None for r in rows) == sum(v >= 6 for v in own.values())
    bits = P.bits_of(P.bitmap(cells, 1 << 27))
    assert {int(c) for c in np.flatnonzero(np.unpackbits(bits, bitorder="little"))} == {r.cell for r in rows if r.cell is not None}


def test_arithmetic_passes_64_bits(spark):
    counts = spark.createDataFrame([("en", "a b", 3 * 10**12), ("en", "a", 4 * 10**12), ("en", "b", 5 * 10**12)], "lang string, phrase string, f long")
    total = spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")
    row = P.scored(counts, total, 100).first()
    assert row.score == 1000 * 3 * 10**12 * 9 * 10**13 // (4 * 10**12 * 5 * 10**12)


def test_empty_table(spark):
    assert P.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_op13_equals_sql(spark, duck, monkeypatch, tmp_path):
    from ..conftest import SF_DIR

    assert_same(P.mine(spark.read.parquet(f"{SF_DIR}/documents.parquet"), least=20, most=300), duck, phrases_sql(20, 300))
    assert QUERIES["op13_phrase_mining"](spark, SF_DIR).columns[0] == "lang"
