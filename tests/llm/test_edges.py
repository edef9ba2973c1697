"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from archgraph.llm import bpe, html_text, line_dedup, media, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup
from tests.llm.conftest import ODD

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "near": lambda d, _: near_dedup.near_duplicates(d),
    "rules": lambda d, _: quality_rules.judge(d),
    "bpe": lambda d, _: bpe.round_trip(d, RANKS),
    "media": lambda d, _: media.media(d),
    "classifier": lambda d, labels: quality_classifier.classify(d, labels),
    "suffix": lambda d, _: suffix_dedup.repeated_passages(d),
    "lines": lambda d, _: line_dedup.dedup_lines(d),
    "substrings": lambda d, _: substring_dedup.dedup_substrings(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(name, odd, none, labels):
    rows = OPERATORS[name](odd, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert OPERATORS[name](none, labels).collect() == []


def test_packing(odd, none):
    rows = packing.pack(odd, WORDS).collect()
    assert len({(r["doc_id"]) for r in rows}) == len({r[0] for r in ODD})
    assert next(r for r in rows if r["doc_id"] == 2)["length"] == 1
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 9)
    assert len(long) > 2 and all(n == 4096 for _, _, n in long[:-1]) and [s for _, s, _ in long] == [4096 * i for i in range(len(long))]
    assert packing.pack(none, WORDS).collect() == []


def test_near_defined_results(odd):
    rows = {(r["doc_id"]): r for r in near_dedup.near_duplicates(odd).collect()}
    assert rows[1]["n_shingles"] == rows[2]["n_shingles"] == rows[3]["n_shingles"] == 0
    assert all(rows[i]["component_id"] == i for i in (1, 2, 3, 4, 5))
    assert rows[4]["n_shingles"] == rows[5]["n_shingles"] == 1
    assert rows[12]["component_id"] == 11 and not rows[12]["kept"]
    assert rows[None]["component_id"] is None and rows[None]["kept"]


def test_dedup_defined_results(odd):
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd).collect()}
    assert lines[1]["text"] is None and lines[1]["__lines"] == 0
    assert lines[8]["text"] == "end" and lines[8]["__removed"] == 3
    assert lines[8]["lang"] == "en" and lines[None]["text"].startswith("a text")
    units = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(odd).collect()}
    assert units[1]["text"] is None and units[9]["text"] == ODD[9][1] and units[5]["__removed"] == 0
    spans = {r["doc_id"]: r for r in suffix_dedup.repeated_passages(odd).collect()}
    assert spans[1]["n_words"] == 0 and spans[9]["repeated_words"] == 0


def test_bpe_and_media_defined_results(odd):
    ids = {r["doc_id"]: r for r in bpe.round_trip(odd, RANKS).collect()}
    assert ids[1]["n_tokens"] == ids[2]["n_tokens"] == 0 and ids[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    for i, text, *_ in ODD:
        assert ids[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    wav = {r["doc_id"]: r for r in media.media(odd).collect()}
    assert wav[1]["payload_bytes"] == wav[2]["payload_bytes"] == 64 and wav[1]["n_bytes"] == 0
    assert wav[11]["feature"] == wav[12]["feature"] and wav[11]["media_sha256"] == hashlib.sha256(wav[11]["media"]).hexdigest()


def test_classifier_without_labels(odd, labels):
    rows = quality_classifier.classify(odd, labels.limit(0)).collect()
    assert {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {1}


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, None, "<p>a<b"), (4, "u", "<article>" + "<div>" * 5000 + "deep &amp; &#228;</article>"), (4, "u", "<script>x")], "page_id long, url string, html string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 5 and {r["text"] for r in rows if r["page_id"] in (1, 2)} == {""}
    assert "deep & ä" in {r["text"] for r in rows}
    assert html_text.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, k, odd, none, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    _, stage = corpus_pipeline.STAGES[k]
    for docs in (odd, none):
        out = stage(spark, docs, folder)
        out.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
