"""Near duplicates: no lost link, whatever leads a list and however long it is."""

from __future__ import annotations

import random

import pytest

from archgraph.llm import near_dedup


def _sets(texts):
    out = []
    for t in texts:
        w = t.split()
        out.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    return out


def _components(docs):
    """By all pairs: doc_id -> smallest doc_id reachable."""
    found, sets = {i: i for i, _ in docs}, dict(zip([i for i, _ in docs], _sets([t for _, t in docs]), strict=True))

    def find(i):
        while found[i] != i:
            i = found[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                found[b] = a
    return {i: find(i) for i in found}


def _got(spark, docs):
    return {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def _triple(name=""):
    """A is like B and C, but not enough; B and C are."""
    core = [f"c{name}{i}" for i in range(104)]
    a = " ".join(core)
    b = " ".join([*core[4:], *(f"x{name}{i}" for i in range(14))])
    c = " ".join([*core[4:], *(f"x{name}{i}" for i in range(8)), *(f"y{name}{i}" for i in range(6))])
    return a, b, c


def test_leader_that_is_like_neither(spark):
    """Whichever of three leads their lists, and however often."""
    triples = [(16, 1, 2), (3, 17, 4), (5, 18, 6), (71, 70, 72), (81, 82, 80), (92, 90, 91)]
    docs = [x for k, ids in enumerate(triples) for x in zip(ids, _triple(f"{k}_"), strict=True)]
    expected = _components(docs)
    assert len(set(expected.values())) == 2 * len(triples)
    assert _got(spark, docs) == expected


@pytest.mark.parametrize(("short", "rounds"), [(0, 0), (2, 3), (32, 0)])
def test_documents_of_one_template(spark, monkeypatch, short, rounds):
    """Pairs just under and just over the threshold, all in the same posting lists, by either exact step."""
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    rng = random.Random(8)
    template = [f"t{i}" for i in range(120)]
    docs = []
    for d in range(45):
        at = rng.randrange(0, 100)
        own = rng.choice([3, 6, 9, 12, 20])
        docs.append((d, " ".join([*template[:at], *(f"o{rng.randrange(12)}_{i}" for i in range(own)), *template[at:]])))
    docs += [(100 + d, " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randrange(0, 30)))) for d in range(20)]
    assert _got(spark, docs) == _components(docs)


def test_rows_that_repeat_a_doc_id(spark):
    """The least set by size stands for the document; each row has its own size."""
    a, b, c = _triple()
    docs = [(1, b), (2, c), (2, c + " more words at the end of it"), (2, ""), (3, a), (3, a)]
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows) == sorted((i, len(s), 1 if i < 3 else 3, i != 2) for (i, _), s in zip(docs, _sets([t for _, t in docs]), strict=True))


def test_other_columns(spark):
    docs = [(1, "a b c d", "x", 5, True), (2, "A b c D", "y", 6, False)]
    found = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, component string, n long, kept boolean"))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, 1, True), (2, 2, 1, False)]
