"""The end of a payload is part of its feature."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from helixmill.llm import media_columns


@pytest.mark.parametrize("n", [64, 448, 512, 576, 640, 704, 768, 832, 2048])
def test_the_last_byte_reaches_the_last_frame(n):
    a = bytes(range(1, 65)) * (n // 64)
    b = a[:-1] + b"\xff"
    x, y = (media_columns.framed(s) * media_columns.WINDOW for s in (a, b))
    assert x.shape == y.shape and not np.array_equal(x[-1], y[-1])


def test_texts_that_differ_at_the_end_differ():
    t = np.arange(192)
    base = bytes([128]) * 512
    ends = [base + (128 + 100 * np.sin(2 * np.pi * f * t / 512)).astype(np.uint8).tobytes() for f in (20, 30)]
    assert not np.array_equal(*(media_columns.landmarks(s) for s in ends))


def plain_landmarks(samples: bytes) -> list[int]:
    """The peaks and pairs of the module's docstring, frame by frame and bin by bin."""
    m = media_columns
    wave = [b - 128 for b in samples]
    while len(wave) < m.FRAME or (len(wave) - m.FRAME) % m.HOP or len(wave) < len(samples) + 1:
        wave.append(0)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (m.FRAME - 1)) for i in range(m.FRAME)]
    best = []
    for t in range(0, len(wave) - m.FRAME + 1, m.HOP):
        power = np.abs(np.fft.rfft(np.array([w * x for w, x in zip(window, wave[t : t + m.FRAME], strict=True)])))
        best.append([max(((float(power[f]), -f) for f in range(a, b)), key=lambda x: x[0]) for a, b in m.BANDS])
    peaks = []
    for t, bands in enumerate(best):
        for k, (p, f) in enumerate(bands):
            if p > 0 and (t == 0 or p > best[t - 1][k][0]) and (t + 1 == len(best) or p >= best[t + 1][k][0]):
                peaks.append((t, -f))
    pairs = [(a, b) for i, a in enumerate(peaks) for b in peaks[i + 1 : i + 1 + m.FAN] if b[0] - a[0] <= m.SPAN]
    return sorted((t << 24) | (f << 15) | (g << 6) | (u - t) for (t, f), (u, g) in pairs)


def test_landmarks_by_brute_force():
    r = random.Random(4)
    for size in (64, 512, 576, 1984, 5000 // 64 * 64, 30016):
        text = "".join(r.choice("abcdefgh .\nABC") for _ in range(size)).encode()
        assert media_columns.landmarks(text).tolist() == plain_landmarks(text)
