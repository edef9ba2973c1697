"""The whole job where a review found less of it."""

from __future__ import annotations

import random
import warnings
from collections import Counter

import pytest

from archgraph.llm import packing, quality_rules, substring_dedup
from tests.llm.test_brute_force import _fewest


def _line(*key):
    return " ".join(f"{'_'.join(map(str, key))}_{i}" for i in range(12))


@pytest.mark.parametrize("host_docs", [11, 60])
def test_documents_of_shared_lines_are_depleted(spark, host_docs):
    """Eight shared lines and two own ones: the shared lines go, though they make the documents alike."""
    docs = [(d, "\n".join([*(_line("shared", k) for k in range(8)), _line("own", d, 0), _line("own", d, 1)]), "a") for d in range(host_docs)]
    docs += [(1000 + d, "\n".join([*(_line("shared", k) for k in range(8)), _line("own", d, 0)]), "b") for d in range(10)]
    got = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"]: (r["n_line_words"], r["kept"]) for r in got} == {d: (0, True) if d >= 1000 else (96, False) for d, *_ in docs}


def test_near_copies_keep_no_shared_line(spark):
    """A hot group of near copies that have a shared line doesn't keep it for the rest of the host."""
    docs = [(d, "\n".join([_line("shared"), *(_line("own", d, k) for k in range(6))]), "a") for d in range(20)]
    docs += [(100 + d, "\n".join([_line("shared"), *(_line("copied", k) for k in range(9)), _line("edit", d)]), "a") for d in range(50)]
    got = quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r["n_line_words"] for r in got if r["doc_id"] < 100} == {12}
    assert all(r["kept"] for r in got if r["doc_id"] < 100)


def test_later_whole_lines_go_whatever_their_length(spark):
    """Against brute force: of equal lines the earliest stays, also where it is short or of several clauses."""
    rng = random.Random(7)
    pool = ["ok", "Two words", "All rights reserved, by the owner of it.", "See the first part of this. Then see the second part, too.", "\u00dcber uns: wir sind viele, sagt man."]
    docs, seen, lost = [], set(), {}
    for d in range(40):
        lines = [rng.choice(pool) if rng.random() < 0.6 else f"own{d}_{k} line with, some words of its own; here{rng.random()}" for k in range(rng.randrange(1, 9))]
        docs.append((d, "\n".join(x.upper() if rng.random() < 0.3 and x.isascii() else x for x in lines)))
        lost[d] = 0
        for x in lines:
            lost[d] += len(x.split()) * (x in seen)
            seen.add(x)
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: r["__removed"] for d, r in got.items()} == lost
    kept = [x.lower() for d in sorted(got) for x in got[d]["text"].split("\n") if x.strip()]
    assert len(kept) == len(set(kept))


def test_clause_that_makes_a_line_elsewhere_stays(spark):
    """A short clause inside a line is no whole line: neither it nor the first line of these words goes."""
    docs = [(1, "We begin with this here. All rights are reserved now. And so on it goes."), (2, "All rights are reserved now.\nother words"), (3, "x y z\nAll rights are reserved now.")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: docs[1][1], 3: "x y z"}


def test_packing_needs_as_few_bins_as_any():
    """The optimum, not one more: small cases against all packings, without a warning of an ended search."""
    rng = random.Random(11)
    cases = [[13, 11, 11, 8, 6, 5, 3, 2, 1]] + [[rng.randrange(1, 21) for _ in range(rng.randrange(1, 12))] for _ in range(400)]
    cases += [[rng.choice([4, 5, 6, 7, 9, 11]) for _ in range(11)] for _ in range(200)]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        for sizes in cases:
            plan = packing.complete(dict(Counter(sizes)), 20)
            used = Counter()
            for f in plan:
                assert sum(s * k for s, k in f.items) <= 20
                used.update({s: k * f.bins for s, k in f.items})
            assert used == Counter(sizes)
            assert sum(f.bins for f in plan) == _fewest(sorted(sizes, reverse=True), 20) >= packing.least_bins(Counter(sizes), 20)
