"""Columns that clash with the operators' own, and values on nulls, ties and repeated rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from archgraph.llm import line_dedup, quality_classifier, quality_rules, substring_dedup

NAMES = ["__removed", "__lines", "__later", "__doc", "__words", "__spans", "__text", "c0", "c1", "doc", "later", "gone", "removed", "lines", "row", "rep", "component", "__log_words"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in NAMES)


def _rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), *(f"{n}{i}" for n in NAMES)) for i, t in texts]


SAME = "first line of it\nsecond line of it\nthird line of it"
TEXTS = [(1, SAME), (2, f"own\n{SAME}"), (3, None), (4, ""), (None, SAME), (5, SAME), (6, " \n"), (5, SAME)]


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame(_rows(TEXTS), SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_figures_get_free_names(clashing):
    lines = line_dedup.dedup_lines(clashing)
    assert lines.columns == [*clashing.columns, "__lines_", "__removed_"]
    assert sorted(((r["doc_id"], r["text"], r["__lines_"], r["__removed_"], r["__removed"]) for r in lines.collect()), key=str) == sorted(
        [(1, SAME, 3, 0, "__removed1"), (2, "own", 4, 3, "__removed2"), (3, None, 0, 0, "__removed3"), (4, "", 0, 0, "__removed4"), (None, SAME, 3, 0, "__removedNone"), (5, "", 3, 3, "__removed5"), (5, "", 3, 3, "__removed5"), (6, " \n", 0, 0, "__removed6")],
        key=str,
    )
    found = substring_dedup.dedup_substrings(clashing)
    assert found.columns == [*clashing.columns, "__words_", "__removed_", "__spans_", "__longest"]
    assert {(r["doc_id"], r["text"], r["__removed_"]) for r in found.collect()} == {(1, SAME, 0), (2, "own", 12), (3, None, 0), (4, "", 0), (None, SAME, 0), (5, "", 12), (6, " \n", 0)}


#: Near duplicates: 10 of 11 shingles make 2 a copy of 1.
STAYS = {
    "quality_classifier": TEXTS,  # without labels nothing is rejected
    "line_dedup": [(1, SAME), (2, "own"), (3, None), (4, ""), (None, SAME), (6, " \n")],
    "minhash_near_dedup": [(1, SAME), (3, None), (4, ""), (None, SAME), (6, " \n")],
    "substring_dedup": [(1, SAME), (2, "own"), (3, None), (4, ""), (None, SAME), (6, " \n")],
}


@pytest.mark.parametrize("name", STAYS)
def test_stage_values(spark, clashing, folder, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, clashing, folder)
    assert out.dtypes == clashing.dtypes
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, _rows(STAYS[name])))


def test_rules_on_nulls_and_repeated_rows(spark):
    shared, own = " ".join(f"s{i}" for i in range(30)), lambda d: " ".join(f"o{d}_{i}" for i in range(40))
    docs = [(d, f"{shared}\n{own(d)}", None) for d in range(11)] + [(None, f"{shared}\n{own(11)}", ""), (5, f"{shared}\n{own(5)}", None), (5, shared, "other"), (50, None, None), (51, "", "x")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_line_words"], r["base_failed"], r["kept"]) for r in quality_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()), key=str)
    expected = [(d, 70, 30, False, True) for d in [*range(11), 5, None]] + [(5, 30, 0, True, False), (50, 0, 0, True, False), (51, 0, 0, True, False)]
    assert got == sorted(expected, key=str)


def test_classifier_learns_one_row_of_a_repeated_doc_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, None), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    assert len(quality_classifier.classify(docs, labels).collect()) == 4
