"""The sorted suffixes against all windows, in one range and in many, and by either step."""

from __future__ import annotations

import random

import pytest

from archgraph.llm import suffix_dedup


def _docs(rng):
    """Passages that go on differently on both sides, so that one 16-gram has many contexts."""
    core = [[f"c{k}_{i}" for i in range(rng.randrange(16, 60))] for k in range(3)]
    sides = [[f"s{k}_{i}" for i in range(40)] for k in range(4)]
    docs = []
    for d in range(60):
        c = rng.choice(core)
        before, after = rng.choice(sides)[: rng.randrange(0, 40)], rng.choice(sides)[: rng.randrange(0, 40)]
        docs.append([f"a{d}"] * rng.randrange(0, 3) + before[::-1] + c + after + [f"e{d}_{i}" for i in range(rng.randrange(0, 30))])
    return docs


def _expected(docs):
    seen = {}
    for d, w in docs:
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add((d, i))
    again, later = {d: set() for d, _ in docs}, {d: set() for d, _ in docs}
    for places in seen.values():
        for k, (d, i) in enumerate(sorted(places)):
            if len(places) > 1:
                again[d] |= set(range(i, i + 50))
            if k:
                later[d] |= set(range(i, i + 50))
    return {d: (len(again[d]), len(later[d])) for d in again}


def _got(spark, docs):
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    return {r["doc_id"]: (r["repeated_words"], r["removed_words"]) for r in suffix_dedup.repeated_passages(frame).collect()}


@pytest.mark.parametrize(("ranges", "block"), [(1, 20_000), (7, 20_000), (1, 3)])
def test_sorted_suffixes_against_all_windows(spark, monkeypatch, ranges, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        docs = list(enumerate(_docs(random.Random(9))))
        expected = _expected(docs)
        assert sum(x > 0 for x, _ in expected.values()) > 10
        assert _got(spark, docs) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_that_repeat_a_doc_id_are_one_document(spark):
    """Equal places are one occurrence; a passage of either row is found in other documents."""
    passage = [f"p{i}" for i in range(60)]
    other = [f"q{i}" for i in range(55)]
    docs = [(1, passage), (1, passage), (2, other), (2, [f"x{i}" for i in range(60)]), (3, ["y", *other]), (4, [f"z{i}" for i in range(80)]), (4, [f"z{i}" for i in range(80)])]
    assert _got(spark, docs) == {1: (0, 0), 2: (55, 0), 3: (55, 55), 4: (0, 0)}
