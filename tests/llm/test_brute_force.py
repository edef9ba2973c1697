"""Operators against brute force, on fixtures and on the smallest tables."""

from __future__ import annotations

import base64
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from archgraph import llm
from archgraph.llm import bpe, html_text, line_dedup, media, near_dedup, packing, quality_classifier, substring_dedup, suffix_dedup
from tests.conftest import SMALL

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
_ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks, special_tokens={})
HF = Tokenizer.from_file(WORDS)
HF.encode_special_tokens = True


def rows(df):
    return sorted(map(str, (r.asDict() for r in df.collect())))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_queries_match_sql(spark, duck, name):
    found = llm.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    expected = duck.sql(llm.oracle_sql()[name]).fetchall()
    order = [duck.sql(llm.oracle_sql()[name]).columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(tuple(r[i] for i in order) for r in expected)


def _documents(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


def test_packing_query(spark, duck):
    got = llm.queries()["op3_best_fit_packing"](spark, SMALL).collect()
    docs, total = _documents(duck), 0
    by_doc = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, text in docs.items():
        ids = np.array([*HF.encode(text, add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        assert by_doc[i] == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 4096
    assert len(bins) <= -(-total // 4096) + 1


def _fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= capacity and bins[i] not in bins[:i]:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_is_valid_and_near_optimal(sizes):
    plan = packing.complete(dict(Counter(sizes)), 20)
    used = Counter()
    for f in plan:
        assert sum(s * k for s, k in f.items) <= 20
        for s, k in f.items:
            used[s] += k * f.bins
    assert used == Counter(sizes)
    assert sum(f.bins for f in plan) <= _fewest(sorted(sizes, reverse=True), 20) + (len(sizes) > 6)
    p = packing.Plan(plan, 20)
    taken = {}
    for s, n in Counter(sizes).items():
        for q, o in zip(*p.place(np.full(n, s), np.arange(n)), strict=True):
            taken.setdefault(int(q), []).append((int(o), s))
    for pieces in taken.values():
        at = 0
        for o, s in sorted(pieces):
            assert o == at
            at += s


ODD_CHARS = "aAbsStTdmlvre'’ \t\n\r\x0b\x1c\x85\xa0 　éßΣςİあ١½Ⅷ.,!?_#́\U0001f600"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ODD_CHARS, max_size=40) | st.text(max_size=30), max_size=6))
def test_tokenizers_match_libraries(texts):
    column = pa.array(texts, pa.string())
    model = bpe.byte_bpe(RANKS)
    for text, ids in zip(texts, model.encode_all(column), strict=True):
        numbers = [int(x) for x in ids.split()]
        assert numbers == TIKTOKEN.encode_ordinary(text)
        assert model.decode(ids) == text.encode()
        assert model.offsets(numbers)[-1] == len(text.encode())
    for text, ids in zip(texts, packing.word_bpe(WORDS).encode_all(column), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == HF.encode(text, add_special_tokens=False).ids


def test_bpe_query(spark, duck):
    docs = _documents(duck)
    for r in llm.queries()["op4_byte_bpe"](spark, SMALL).collect():
        ids = TIKTOKEN.encode_ordinary(docs[r["doc_id"]])
        import hashlib

        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_encode_keeps_offsets(spark):
    docs = spark.createDataFrame([(1, "it's a café\n\n now")], "doc_id long, text string")
    encoded = bpe.encode(docs, RANKS)
    r = encoded.collect()[0]
    raw = docs.collect()[0]["text"].encode()
    assert [raw[a:b] for a, b in zip(r["offsets"], r["offsets"][1:], strict=False)] == [TIKTOKEN.decode_single_token_bytes(i) for i in r["ids"]]
    assert bytes(bpe.decode(encoded, RANKS).collect()[0]["bytes"]) == raw


def test_media_round_trip_and_search():
    rng = random.Random(0)
    raw = bytes(rng.randrange(256) for _ in range(6400))
    assert media.from_wav(media.to_wav(raw)) == raw
    whole = media.fingerprint(np.frombuffer(raw, np.uint8))
    part = media.fingerprint(np.frombuffer(raw[media.HOP * 6 :], np.uint8))
    shifted = {int(x) + (6 << 32) for x in part}
    assert len(shifted & {int(x) for x in whole}) > 0.5 * len(part) > 0


def test_classifier_on_held_out_rows(spark, duck):
    got = {r["doc_id"]: r for r in llm.queries()["op6_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = duck.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    held = [(got[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and sum(r["held_out"] for r in got.values()) > 100
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.95


def test_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, len(quality_classifier.FEATURES)))
    y = ((x[:, 2] > 0.5) & (x[:, 4] < 0.7)).astype(float)
    model = quality_classifier.fit(x, y)
    assert 0 < len(model.rules) < 200
    by_hand = 1 / (1 + np.exp(-(model.bias + quality_classifier.holds([r for _, r in model.rules], x) @ np.array([w for w, _ in model.rules]))))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"__{f}" for f in quality_classifier.FEATURES])
    assert np.allclose([r[0] for r in df.select(model.score()).collect()], by_hand)
    assert ((by_hand > 0.5) == y).mean() > 0.95


PAGES = {
    "<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One <b>two</b><br>three&nbsp;&amp; four<p>five</article><footer>f</footer>": "T\n\nOne two three & four\n\nfive",
    "<header>Site</header><main><p>Body text.</p><aside>side</aside><div class='comment-list'><p>Great post, thanks to all of you!</p></div></main>": "Body text.",
    "<div class=cookie-banner>We use cookies</div><article><p>x < y</p><form>name <input></form><!-- no --><script>if (a<b) '</p>'</script><p>z</p></article>": "x < y\n\nz",
    "<article></article>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert html_text.main_text([page]) == [PAGES[page]]


def _near_texts(rng):
    words = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 120))) for _ in range(60)]
    for base in list(texts[:12]):
        for _ in range(rng.randrange(1, 9)):
            w = base.split()
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    template = [f"t{i}" for i in range(60)]
    texts += [" ".join([*template, f"u{i}", f"x{i}"]) for i in range(40)]  # a group in which all are similar
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = _near_texts(random.Random(3))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)})
    component = list(range(len(texts)))

    def find(i):
        while component[i] != i:
            i = component[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                component[b] = a
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(texts))}


def _passages(rng):
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(45, 130))] for k in range(6)]
    docs = []
    for d in range(30):
        text = [f"d{d}_{i}" for i in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            text += [*p[a : len(p) - rng.randrange(0, 20)], *[word() + str(rng.random()) for _ in range(rng.randrange(0, 15))]]
        docs.append(text)
    return [*docs, docs[3], docs[3]]


def test_repeated_passages_against_all_windows(spark):
    docs = _passages(random.Random(5))
    seen = {}
    for d, w in enumerate(docs):
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    again, later = [set() for _ in docs], [set() for _ in docs]
    for places in seen.values():
        for k, (d, i) in enumerate(places):
            if len(places) > 1:
                again[d] |= set(range(i, i + 50))
            if k:
                later[d] |= set(range(i, i + 50))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    for r in suffix_dedup.repeated_passages(df).collect():
        assert (r["repeated_words"], r["removed_words"]) == (len(again[r["doc_id"]]), len(later[r["doc_id"]]))


def test_line_dedup_by_hand(spark):
    docs = [(1, "a\nb\nc\nd"), (2, "x\nB\n\nc \nd\ny"), (3, "a\nb\nq")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x\n\ny", 3: "a\nb\nq"}


def test_substring_dedup_by_hand(spark):
    passage = " ".join(f"Sentence number {i} of the passage has ten words here." for i in range(6))
    docs = [(1, f"Own start. {passage} Own end."), (2, f"Other words go on and {passage} then it ends."), (3, "Short one. Short one.")]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["__removed"] == 0 and got[3]["__removed"] == 0
    assert got[2]["__removed"] == 50 and got[2]["text"].endswith("then it ends.") and "number 3" not in got[2]["text"]
    (span,) = got[2]["__spans"].split()
    a, b = map(int, span.split("-"))
    assert docs[1][1][a:b] == " ".join(passage.split(". ")[k] + ("." if k < 5 else "") for k in range(1, 6))


def test_pipeline_against_its_operators_one_by_one(spark, duck):
    """Decisions of each stage, recomputed from its input in plain Python or SQL."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r["doc_id"] for r in quality_classifier.classify(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r["predicted"]}
    frame = duck.sql("SELECT * FROM documents").df()
    frame = frame[frame.doc_id.isin(good)]
    duck.register("p_docs", frame)
    lines = duck.sql(f"WITH {line_dedup.lines_sql('p_docs')} SELECT doc_id, text FROM l8_out WHERE n_removed = 0 OR regexp_matches(text, '[^\\x20\\x09-\\x0D]')").df()
    duck.register("p_lines", lines)
    near = duck.sql(near_dedup.OP1_SQL.replace("FROM documents", "FROM p_lines")).df()
    kept = lines[lines.doc_id.isin(near[near.kept].doc_id)]
    duck.register("p_near", kept)
    clean = duck.sql(f"WITH {substring_dedup.units_sql('p_near')} SELECT doc_id, text FROM l9_out WHERE n_removed = 0 OR regexp_matches(text, '[^\\x20\\x09-\\x0D]')").fetchall()
    got = corpus_pipeline.run(spark, SMALL).collect()
    expected = []
    for i, t in clean:
        ids = np.array([*HF.encode(t, add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    bins = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 4096 and len(bins) == -(-sum(bins.values()) // 4096)
