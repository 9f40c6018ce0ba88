"""Audio columns: payloads stored as WAV, read back, and described by spectral-peak pairs.

``wav_media`` writes bytes as 8-bit mono samples through the wave module, ``wav_facts`` reads a stored file
back and gives its digests and landmarks: short-time Fourier transform, the strongest bin of each band of
each frame where it exceeds its neighbours in time, and pairs of each peak with the ones that follow it,
stored as an array of time-coded integers (frame << 24 | first bin << 15 | second bin << 6 | frames between).

Null texts count as empty; the payload is padded with zero bytes to a positive multiple of 64. Equal texts and repeated
rows give equal values; of bins with equal power the lower one is a frame's peak. Empty tables give empty tables. Columns
that had the names of new ones are replaced. A text's bytes, its file and what is read back are held at once; the transform
works in blocks of ``BLOCK`` frames."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, restored

UNIT = 64
RATE = 8000
FRAME = 512
HOP = 256
BANDS = ((1, 48), (48, 257))
FAN = 2
SPAN = 63
BLOCK = 2048
#: The sample of no sound.
SILENCE = 128
WINDOW = np.hanning(FRAME).astype(np.float32)
FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, landmarks array<long>"


def padded(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def framed(samples: bytes) -> np.ndarray:
    """Frames of 8-bit samples. Silence follows until the last sample lies in a frame, before the frame's end, where the window is zero."""
    x = np.frombuffer(samples, np.uint8)
    whole = FRAME + max(0, -(-(len(x) + 1 - FRAME) // HOP)) * HOP
    x = np.concatenate([x, np.full(whole - len(x), SILENCE, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]


def landmarks(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs of 8-bit samples."""
    frames = framed(samples)
    bins, power = [], []
    for k in range(0, len(frames), BLOCK):
        spectrum = np.abs(np.fft.rfft((frames[k : k + BLOCK].astype(np.float32) - SILENCE) * WINDOW, axis=1))
        best = [spectrum[:, a:b].argmax(axis=1) + a for a, b in BANDS]
        bins.append(np.stack(best, axis=1))
        power.append(np.stack([spectrum[np.arange(len(spectrum)), b] for b in best], axis=1))
    at, height = np.concatenate(bins), np.concatenate(power)
    edge = np.full((1, len(BANDS)), -1, height.dtype)
    above = (height > np.concatenate([edge, height[:-1]])) & (height >= np.concatenate([height[1:], edge])) & (height > 0)
    t, band = np.nonzero(above)
    f = at[t, band]
    codes = []
    for step in range(1, FAN + 1):
        gap = t[step:] - t[:-step]
        ok = gap <= SPAN
        codes.append((t[:-step][ok].astype(np.int64) << 24) | (f[:-step][ok] << 15) | (f[step:][ok] << 6) | gap[ok])
    return np.sort(np.concatenate(codes))


def wav_media(text: Column) -> Column:
    """The stored form of a text: a WAV file as binary."""

    @F.arrow_udf("binary")
    def stored(v: pa.Array) -> pa.Array:
        return pa.array((to_wav(padded(x or b"")) for x in v.cast(pa.binary()).to_pylist()), pa.binary())

    return stored(text)


def wav_facts(media: Column) -> Column:
    """Digests and landmarks of stored WAV files, from the bytes that are read back."""

    @F.arrow_udf(FACTS)
    def facts(v: pa.Array) -> pa.Array:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "landmarks")
        cols: dict[str, list] = {n: [] for n in names}
        for m in v:
            m = m.as_py()
            back = from_wav(m)
            for n, x in zip(names, (len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), landmarks(back)), strict=True):
                cols[n].append(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(cols[n], k) for n, k in zip(names, kinds, strict=True)], names=list(names))

    return facts(media)


def text_of_media(media: Column, n_bytes: Column) -> Column:
    """The text again, from its stored form and its unpadded length."""

    @F.arrow_udf("string")
    def text(m: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([from_wav(a)[:b].decode("utf-8") for a, b in zip(m.to_pylist(), n.to_pylist(), strict=True)], pa.string())

    return text(media, n_bytes)


def media_columns(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``media`` and ``facts``; columns that had these names are replaced."""
    own = F.col(f"`{text}`")
    rows = carried(df, F.octet_length(F.coalesce(own, F.lit(""))).cast("long").alias("_n"), wav_media(own).alias("_media"))
    return restored(rows.withColumn("_facts", wav_facts(F.col("_media"))), df.columns, n_bytes=F.col("_n"), media=F.col("_media"), facts=F.col("_facts"))
