"""Texts of 1 to 14 words, each alone in its slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from helixmill.llm import ngram_join, paragraph_dedup


@pytest.mark.parametrize("n", range(15))
def test_one_short_text_alone(n):
    text = pa.array([" ".join(f"w{k}" for k in range(n))])
    for words in (4, 5):
        values, ends = ngram_join.shingle_sets(text, words)
        assert len(values) == ends[-1] == (max(n - words + 1, 1) if n else 0)
    assert not len(paragraph_dedup.anchors(text)[0])
    h = np.arange(n, dtype=np.uint64)
    for k in (5, 8, 13):
        total = paragraph_dedup.window_hash(*paragraph_dedup.rolling(h), np.arange(max(0, n - k + 1)), k)
        again = paragraph_dedup.window_hash(*paragraph_dedup.rolling(np.append(np.uint64(7), h)), np.arange(1, max(0, n - k + 1) + 1), k)
        assert len(set(total.tolist())) == max(0, n - k + 1) and (total == again).all()
