"""Media columns: texts as 8-bit WAV, read back, with spectral fingerprints.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of a mono
WAV file written and read by the wave module. Of the samples read back, a short-time Fourier
transform is taken (FRAME samples, half overlapping). A peak is a band's strongest bin in a
frame where the band is stronger than in the frames before and after. Each peak is paired with
the FAN peaks that follow it; a pair's code holds both bins and their distance in time, and the
fingerprint is the array of frame << 32 | code, so that it can be searched by code and aligned
by time.

Nulls and edges: a null text is an empty one (64 zero samples); any length works, frames beyond
the end are silence.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.llm.store import arm, table
from archgraph.llm.text import chunks

RATE, FRAME, HOP, FAN, NEAR = 8000, 512, 256, 3, 63
BANDS = ((2, 16), (16, 48), (48, 112), (112, 257))
_HANN = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each spectral peak, by frame and then bin. Works in blocks of frames."""
    frames = max(0, -(-(len(samples) - FRAME) // HOP)) + 1
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = (samples.astype(np.float32) - 128) / 128
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    power, bins = np.empty((frames, len(BANDS)), np.float32), np.empty((frames, len(BANDS)), np.int64)
    for a in range(0, frames, 2048):
        block = np.abs(np.fft.rfft(view[a : a + 2048] * _HANN, axis=1))
        for b, (lo, hi) in enumerate(BANDS):
            k = block[:, lo:hi].argmax(axis=1)
            bins[a : a + 2048, b] = k + lo
            power[a : a + 2048, b] = block[np.arange(len(k)), k + lo]
    fenced = np.pad(power, ((1, 1), (0, 0)))
    top = (power > fenced[:-2]) & (power >= fenced[2:])
    t, b = np.nonzero(top)
    return t, bins[t, b]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    t, f = peaks(samples)
    out = []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= NEAR
        out.append((t[:-k].astype(np.int64) << 32 | f[:-k] << 18 | f[k:] << 6 | gap)[near])
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def media(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, the digests of the query, and (if keep) the WAV file and the fingerprint array themselves."""
    arm(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode()
                    stored = to_wav(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                    back = from_wav(stored)
                    print_ = fingerprint(np.frombuffer(back, np.uint8))
                    feature = f"{len(print_)}:{hashlib.sha256(print_.astype('<i8').tobytes()).hexdigest()}"
                    rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, stored, print_))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary(), pa.list_(pa.int64())] * keep
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, fingerprint array<long>" * keep
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"), keep=False)
