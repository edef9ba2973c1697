"""Queries that SQL can't express, row by row against plain Python; and what intermediate tables are left."""

from __future__ import annotations

import hashlib
import io
import math
import os
import re
import wave
import zlib

import duckdb
import numpy as np
import pytest

from archgraph import llm
from archgraph.llm import near_dedup, quality_classifier, store
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall())


def _fingerprint(samples):
    """Peaks and pairs of them, a frame at a time."""
    window = np.hanning(512).astype(np.float32)
    frames, at = [], 0
    while True:
        chunk = np.zeros(512, np.float32)
        part = (np.frombuffer(samples[at : at + 512], np.uint8).astype(np.float32) - 128) / 128
        chunk[: len(part)] = part
        frames.append(np.abs(np.fft.rfft(chunk * window)))
        at += 256
        if at - 256 + 512 >= len(samples):
            break
    strongest = [[(int(lo + f[lo:hi].argmax()), np.float32(f[lo:hi].max())) for lo, hi in ((2, 16), (16, 48), (48, 112), (112, 257))] for f in frames]
    peaks = []
    for t, bands in enumerate(strongest):
        for b, (k, power) in enumerate(bands):
            before = strongest[t - 1][b][1] if t else 0
            after = strongest[t + 1][b][1] if t + 1 < len(strongest) else 0
            if power > before and power >= after:
                peaks.append((t, k))
    codes = []
    for i, (t, f) in enumerate(peaks):
        codes += [t << 32 | f << 18 | g << 6 | (u - t) for u, g in peaks[i + 1 : i + 4] if u - t <= 63]
    return sorted(codes)


def test_media_query(spark, documents):
    rows = llm.queries()["op5_media_columns"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        raw = (documents[r["doc_id"]] or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        stored = file.getvalue()
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(payload) < 6000:
            codes = np.array(_fingerprint(payload), "<i8")
            assert r["feature"] == f"{len(codes)}:{hashlib.sha256(codes.tobytes()).hexdigest()}"


def _statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, lines = max(len(words), 1), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = max(sum(map(len, words)), 1)
    count = lambda pattern: len(re.findall(pattern, text))
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    alpha = count("[A-Za-z]")
    return [
        math.log1p(len(words)), sum(map(len, words)) / n, count(r"[#*$%&|<>]") / n, sum(len(w.encode()) == 1 for w in words) / n, count("[A-Z]") / max(alpha, 1),
        sum(len(w.encode()) > 2 and bool(re.match("[A-Z]{2}", w)) for w in words) / n, count("[0-9]") / chars, count("[.?!]") / n, sum(w[-1] in ".?!" for w in words) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), len(again) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(words) / max(len(lines), 1), 1 - alpha / max(len(text.encode()), 1),
    ]


def test_classifier_query(spark, documents):
    """Each score is the sum of the weights of the rules that hold for statistics taken in plain Python."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality_classifier.train(docs, labels)
    for r in llm.queries()["op6_quality_classifier"](spark, SMALL).collect():
        text = documents[r["doc_id"]] or ""
        if len(text) > 20_000:
            continue
        x = [round(v, 6) for v in _statistics(text)]
        total = model.bias + sum(w for w, rule in model.rules if all((x[f] > t) if over else (x[f] <= t) for f, over, t in rule))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_scratch_tables_go(spark):
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i % 3} j k l m n o p") for i in range(9)], "doc_id long, text string")
    folder = os.path.join(store.shared_dir(spark), "archgraph", spark.sparkContext.applicationId).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    found = near_dedup.near_duplicates(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"sketch", "classes", "linked"}
    assert found.count() == 9
