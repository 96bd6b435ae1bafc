"""Media columns: texts as WAV audio, and spectral-peak fingerprints of what is read back.

The payload (the text's UTF-8 bytes, then bytes 0 up to a positive multiple of 64) is
written as 8-bit mono samples by the wave module, and read back by it. Short-time Fourier
transforms over Hann windows of FRAME samples, HOP apart, give each frame's highest local
maxima; each peak is paired with the next peaks, and a pair is one integer (both bins and
the frames between them) at its frame's time: two arrays of the same length, time-coded.

A null text is an empty one: a payload of 64 zero bytes and no pairs. Equal texts have
equal values, as each is transformed by itself. Long texts are transformed in runs of
frames. Repeated rows give a row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plantlens.llm import base
from plantlens.llm import textmath as tm

RATE, FRAME, HOP, PEAKS, FAN = 8000, 512, 256, 2, 3
RUN = 1024  # frames transformed at once
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, pairs array<int>"


def padded(data: bytes) -> bytes:
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_HANN = np.hanning(FRAME).astype(np.float32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each frame's PEAKS highest local maxima, in order of frame and bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.append(x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for lo in range(0, n, RUN):
        m = np.abs(np.fft.rfft(frames[lo : lo + RUN] * _HANN, axis=1))[:, 1:-1]
        top = np.zeros_like(m)
        inner = m[:, 1:-1]
        np.copyto(top[:, 1:-1], inner, where=(inner > m[:, :-2]) & (inner >= m[:, 2:]) & (inner > m.mean(axis=1, keepdims=True)))
        row = np.arange(len(m))
        for _ in range(PEAKS):
            best = top.argmax(axis=1)
            held = top[row, best] > 0
            times.append(row[held] + lo)
            bins.append(best[held] + 1)
            top[row, best] = 0
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, pairs): each peak with the FAN next ones; bin, bin and frames between."""
    if not any(samples):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, f = peaks(samples)
    times, pairs = [], []
    for k in range(1, FAN + 1):
        gap = np.minimum(t[k:] - t[:-k], 255)
        times.append(t[:-k] if len(t) > k else t[:0])
        pairs.append(f[:-k] << 17 | f[k:] << 8 | gap if len(t) > k else t[:0])
    times, pairs = np.concatenate(times), np.concatenate(pairs)
    order = np.lexsort((pairs, times))
    return times[order].astype(np.int32), pairs[order].astype(np.int32)


def describe(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA for each document."""
    base.small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def row(data: bytes) -> tuple:
        media = write_wav(padded(data))
        payload = read_wav(media)
        times, pairs = fingerprint(payload)
        code = zlib.crc32(pairs.astype("<i4").tobytes(), zlib.crc32(times.astype("<i4").tobytes()))
        return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(pairs)}:{code:08x}", times, pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(zip(*[row(x.tobytes()) for x in tm.texts(batch.column(1))], strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(list(v), k) for v, k in zip(values, kinds[1:], strict=True)]], names)

    return base.only(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
