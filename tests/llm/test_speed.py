"""Tokenizers on long slices: equal to the library, and fast enough without spaces."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from archgraph.llm import bpe, packing
from tests.llm.test_brute_force import HF, RANKS, TIKTOKEN, WORDS

COMMON = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从"


def _texts():
    rng = random.Random(4)
    return [
        "".join(rng.choice(COMMON) for _ in range(3000)),
        "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1500)),
        "".join(chr(rng.randrange(0x0E01, 0x0E3A)) for _ in range(1500)),
        "".join(chr(rng.randrange(0x3041, 0x30FF)) for _ in range(1500)),
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000)),
        "ab" * 700 + "ha" * 500 + "=" * 900 + "-=" * 300,
        "".join(chr(rng.randrange(0x1F300, 0x1F6FF)) for _ in range(400)),
    ]


def test_long_slices_match_the_library():
    column = pa.array(_texts(), pa.string())
    model = bpe.byte_bpe(RANKS)
    for text, (shown, ids) in zip(_texts(), model.encode_both(column), strict=True):
        assert ids.tolist() == [int(x) for x in shown.split()] == TIKTOKEN.encode_ordinary(text)
        offsets = model.offsets(ids)
        assert model.decode(ids, offsets) == text.encode()
        a, b = len(ids) // 3, len(ids) // 2
        assert model.decode(ids[a:b]) == text.encode()[offsets[a] : offsets[b]]
    for text, ids in zip(_texts(), packing.word_bpe(WORDS).encode_all(column), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chars", [COMMON, "".join(map(chr, range(0x4E00, 0x5E00)))])
def test_texts_without_spaces_take_about_as_long_as_others(chars):
    rng = random.Random(6)
    model = bpe.ByteBPE(RANKS)
    column = pa.array(["".join(rng.choice(chars) for _ in range(2000)) for _ in range(60)], pa.string())
    begin = time.perf_counter()
    assert sum(len(ids) for _, ids in model.encode_both(column)) > 0
    assert 60 * 6000 / (time.perf_counter() - begin) > 250_000  # bytes a second, on a slow machine too


def _by_piece(sizes, capacity):
    """Best-fit decreasing, a piece at a time."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)


def test_best_fit_on_the_histogram_is_that_by_piece():
    rng = random.Random(12)
    for _ in range(300):
        sizes = [rng.choice((rng.randrange(1, 31), 7, 11)) for _ in range(rng.randrange(1, 60))]
        plan = packing.best_fit(dict(Counter(sizes)), 30)
        used = Counter()
        for f in plan:
            for s, k in f.items:
                used[s] += k * f.bins
        assert used == Counter(sizes)
        assert sorted(30 - sum(s * k for s, k in f.items) for f in plan for _ in range(f.bins)) == _by_piece(sizes, 30)


def test_ties_and_clashing_columns_in_packing(spark):
    docs = spark.createDataFrame([(1, "a b", 9, "x"), (1, "a b", 9, "x"), (None, "c d", 9, "x"), (2, None, 9, "x"), (3, "e", 9, "x")], "doc_id long, text string, length int, task string")
    rows = packing.pack(docs, WORDS).collect()
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows), key=str) == sorted([(1, 0, 0, 3), (1, 0, 0, 3), (None, 0, 0, 3), (2, 0, 0, 1), (3, 0, 0, 2)], key=str)
    assert len({r["sequence_id"] for r in rows}) == 1
    assert sorted((r["offset"], r["length"]) for r in rows) == [(0, 3), (3, 3), (6, 3), (9, 2), (11, 1)]
