"""HTML extraction: all pages against an independent extraction, the tree's features, and hostile markup."""

from __future__ import annotations

import time
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest

from archgraph import llm
from archgraph.llm import html_text
from tests.conftest import SMALL


class _Article(HTMLParser):
    """The blocks inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = 0, [], []

    def flush(self):
        if t := " ".join("".join(self.now).split()):
            self.blocks.append(t)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.inside -= 1

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def test_query_against_an_independent_extraction(spark):
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SMALL}/pages.parquet'").fetchall()
    expected = []
    for i, url, page in pages:
        parser = _Article()
        parser.feed(page)
        parser.close()
        parser.flush()
        text = "\n\n".join(parser.blocks)
        expected.append((i, url, text, len(text)))
    assert sorted(map(tuple, llm.queries()["op10_html_extraction"](spark, SMALL).collect())) == sorted(expected)


P = "The market in the valley opens every week, and people from all villages come to sell bread, cheese and wool."
CASES = {
    # Pages that mark no article: short paragraphs, list items and cells are told by their neighbours.
    f"<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul><h1>Wool</h1><p>{P}</p><p>So it went.</p><ul><li>rye</li></ul><p>{P}</p><div><a href=z>Terms</a></div><div>All rights reserved</div>": f"Wool\n\n{P}\n\nSo it went.\n\nrye\n\n{P}",
    f"<div>Valley News</div><div><a href=x>Home</a></div><p>{P}</p><table><tr><td>two pounds</td></tr></table><p>{P} {P}</p><div>Back to top</div><div>Since 1901</div>": f"{P}\n\ntwo pounds\n\n{P} {P}",
    f"<nav><p>{P}</p></nav><div id=cookie-banner><p>{P}</p></div><p>{P}</p><p>It rains.</p><p>{P}</p><aside><p>{P}</p></aside><footer><p>{P}</p></footer>": f"{P}\n\nIt rains.\n\n{P}",
    f"<article><header><h1>Title</h1></header><p>{P}</p><div class=comments><p>{P}</p><p>Nice.</p></div><p>End.</p></article><p>{P}</p>": f"Title\n\n{P}\n\nEnd.",
    "<article><p title=it's>Hello &amp; <b class='a>b'>you</b></p><p x=\">\">two</p><p y='<i>'>three</p></article>": "Hello & you\n\ntwo\n\nthree",
    "<main><p>a < b and c > d</p><p>x<y</p></main>": "a < b and c > d\n\nx",
    '<article><p>one<p title="never closed>two</article>': "one\n\ntwo",
    "<article><p>no end <b": "no end <b",
}


@pytest.mark.parametrize("page", CASES)
def test_main_text(page):
    assert html_text.main_text([page]) == [CASES[page]]


def _features(node):
    return set() if isinstance(node, bool) else {html_text.FEATURES[node[0]]} | _features(node[2]) | _features(node[3])


def test_neighbours_decide():
    x, y = html_text.labelled()
    assert len({"words_before", "links_before", "words_after", "links_after", "prose_before", "prose_after"} & _features(html_text.tree())) >= 3
    assert (html_text.verdicts(html_text.tree(), x) == y).mean() > 0.99
    right = {}
    for name, left_out in {"names": (8,), "markup": (8, 9, 10, 11), "markup and neighbours": tuple(range(2, 12))}.items():
        use = tuple(i for i in range(len(html_text.FEATURES)) if i not in left_out)
        right[name] = (html_text.verdicts(html_text.grow(x, y, 9, use), x) == y).mean()
    assert right["names"] > 0.9 and right["markup"] > right["markup and neighbours"] + 0.02


@pytest.mark.parametrize("bad", ["<a '", "<a x='", '<a x=">"', "<a x='>\"", "<a x=\"'", "<p title=it's>", "<script>", "<!--", "<!x", "<b", "</", "<svg ", "<a x=\"<a y='"])
def test_hostile_markup_takes_linear_time(bad):
    took = []
    for n in (50_000, 400_000):
        t = time.perf_counter()
        assert len(html_text.main_text([bad * (n // len(bad))])) == 1
        took.append(time.perf_counter() - t)
    assert took[1] < 20 * took[0] + 1


def test_scanner_against_the_standard_parser():
    """On random well-formed tags, with any quoting, both see the same text."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        page, said = "<article>", []
        for _ in range(rng.integers(1, 8)):
            attributes = " ".join(str(rng.choice(["a=1", "b='x>y'", 'c="<p>"', "d", "e = 'q\"'", "f=it's", 'g="it\'s"'])) for _ in range(rng.integers(0, 4)))
            word = f"w{rng.integers(1000)}"
            page += f"<p {attributes}>{word}</p>"
            said.append(word)
        assert html_text.main_text([page]) == ["\n\n".join(said)]
