"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block is described by its word
count and link density and those of its neighbours, and by how it is marked up (inside an
article, in a navigation or other page furniture by tag or class names, a heading),
and a decision tree says whether it is main text. The tree is grown once a process from a small
labelled table, the blocks of `samples`. Where pages mark their article, markup decides there;
where they don't, words and link densities of block and neighbours do.

Scripts, styles and comments never become text. Character references are decoded, white space
inside a block becomes one space, and main blocks are joined by two newlines in page order.

Nulls and edges: a null or empty page has no text; unclosed and misnested tags are tolerated, as
are quotes that never close; page_id and url may be null; rows that repeat a page_id are pages of
their own, equal pages give equal texts; whole pages are parsed, in time proportional to their
length. An empty table gives no row; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.llm.store import arm, table
from archgraph.llm.text import chunks

#: A tag without < or > in its attributes, which nearly all are; others are read by `Tags.end`.
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"'=]++|=[ \t\n\r\f]*+(?:\"[^\"<>]*+\"|'[^'<>]*+')|=(?![ \t\n\r\f]*+[\"']))*+)>")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_STOP = re.compile(r">|=[ \t\n\r\f]*+[\"']")
#: Elements whose content is no text, up to their closing tag.
_RAW = {n: re.compile(rf"</{n}(?![A-Za-z0-9:-])[^>]*+>", re.I) for n in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "object", "title")}
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|promo\w*|sponsor\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|widget|footer|foot|header|masthead|"
    r"cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|social|share|sharing|comments?|commentlist|replies|reply|disqus|discussion|related|recommended|tags|pagination|pager|copyright|toolbar|search)(?=$|[\s_-])",
    re.I,
)
_REGIONS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset", "label"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "prose_before", "prose_after", "furniture", "article", "heading", "page_has_article"]


#: prose_before and prose_after: words of the longest block without many links among so many neighbours.
REACH = 3


class Tags:
    """The tags of a page in order, in time proportional to its length whatever its quotes are.

    A quote counts only where an attribute's value begins, and if it is closed again. A tag that
    never ends so is ended by its first >, and is text if there is none.
    """

    def __init__(self, page: str):
        self.page = page
        self.open_ended: dict[str, bool] = {}  # what was looked for in vain; it isn't further on either
        self.dead = bytearray()  # outside quotes, on the way to no end

    def find(self, what: str, at: int) -> int:
        if self.open_ended.get(what):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.open_ended[what] = True
        return found

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at `at`; -1 if there is none."""
        page, begin, quiet = self.page, at, []
        while not (self.dead and self.dead[at]):
            m = _STOP.search(page, at)
            if m is None:
                quiet.append((at, len(page)))
                break
            if m[0] == ">":
                return m.start()
            close = self.find(m[0][-1], m.end())
            stop = m.end() if close < 0 else close + 1
            quiet.append((at, m.end() if close < 0 else m.start() + 1))
            at = stop
            if at >= len(page):
                break
        if not self.dead:
            self.dead = bytearray(len(page) + 1)
        for a, b in quiet:
            self.dead[a:b] = b"\1" * (b - a)
        return self.find(">", begin)

    def __iter__(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """(start, end, name, is it closing, attributes); without a name what is no text: comments, declarations, raw content."""
        page, page_at = self.page, 0
        while (at := self.find("<", page_at)) >= 0:
            m = _TAG.match(page, at)
            if m:
                end, name, closing, attributes = m.end(), m[2].lower(), bool(m[1]), m[3]
            elif page.startswith("<!--", at):
                end = self.find("-->", at + 4)
                yield at, len(page) if end < 0 else end + 3, None, False, ""
                page_at = len(page) if end < 0 else end + 3
                continue
            elif page.startswith(("<!", "<?"), at):
                mark = "]]>" if page.startswith("<![CDATA[", at) else ">"
                end = self.find(mark, at)
                if end < 0 and mark == ">":
                    page_at = at + 1
                    continue
                page_at = len(page) if end < 0 else end + len(mark)
                yield at, page_at, None, False, ""
                continue
            else:
                n = _NAME.match(page, at)
                end = self.end(n.end()) + 1 if n else 0
                if not end:
                    page_at = at + 1
                    continue
                name, closing, attributes = n[1].lower(), page[at + 1] == "/", page[n.end() : end - 1]
            if not closing and name in _RAW and not attributes.rstrip().endswith("/"):
                close = None if self.open_ended.get(name) else _RAW[name].search(page, end)
                if close is None:
                    self.open_ended[name] = True
                page_at = close.end() if close else len(page)
                yield at, page_at, None, False, ""
                continue
            page_at = end
            yield at, end, name, closing, attributes


#: Text, words, words inside links, in page furniture, in an article, heading.
Block = tuple[str, int, int, bool, bool, bool]


def blocks(page: str) -> list[Block]:
    """The flat blocks of a page."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # name, and what it adds to furniture and article
    furniture = article = anchors = 0
    parts: list[str] = []
    linked: list[str] = []
    heading = False
    at = 0

    def flush() -> None:
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                out.append((" ".join(words), len(words), len(html.unescape(" ".join(linked)).split()) if linked else 0, furniture > 0, article > 0, heading))
            parts.clear()
            linked.clear()

    for start, end, name, closing, attributes in Tags(page):
        if start > at:
            text = page[at:start]
            parts.append(text)
            if anchors:
                linked.append(text)
        at = end
        if name is None:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if closing:
            if name in _BLOCKS:
                flush()
            if name in _HEADINGS:
                heading = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, f, a in stack[k:]:
                        furniture -= f
                        article -= a
                    anchors -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
            continue
        if name in _BLOCKS:
            flush()
            while stack and (stack[-1][0] == "a" or (name in ("p", "li") and stack[-1][0] == "p") or (name == "li" and stack[-1][0] == "li")):
                n, f, a = stack.pop()
                furniture -= f
                article -= a
                anchors -= n == "a"
        if name in _HEADINGS:
            heading = True
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        named = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes)) if attributes else ""
        region = name in _REGIONS and not (name == "header" and article)  # an article's own header holds its title
        f = int(region or bool(named and name not in ("body", "html", "article", "main") and _FURNITURE.search(named)) or bool(attributes and _HIDDEN.search(attributes)))
        a = int(name in ("article", "main"))
        stack.append((name, f, a))
        furniture += f
        article += a
        anchors += name == "a"
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def describe(found: list[Block]) -> np.ndarray:
    """The features of a page's blocks, one row each."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    w = np.array([b[1] for b in found], float)
    d = np.array([b[2] for b in found], float) / w
    x[:, 0], x[:, 1] = w, d
    x[1:, 2], x[1:, 3] = w[:-1], d[:-1]
    x[:-1, 4], x[:-1, 5] = w[1:], d[1:]
    prose = np.concatenate([np.zeros(REACH), np.where(d < 0.5, w, 0), np.zeros(REACH)])
    for k in range(REACH):
        x[:, 6] = np.maximum(x[:, 6], prose[k : k + n])
        x[:, 7] = np.maximum(x[:, 7], prose[REACH + 1 + k : REACH + 1 + k + n])
    for k in range(8, 11):
        x[:, k] = [b[k - 5] for b in found]
    x[:, 11] = x[:, 9].any()
    return x


_SENTENCES = (
    "In the valley below the old bridge a small market opens every week, and people from the villages bring cheese, bread and wool to sell there before noon.",
    "Nobody remembers when it began, but the records of the parish mention it for the first time in the year of the great flood, together with a complaint.",
    "The baker comes first, long before the sun is over the ridge.",
    "Wool is sold by weight, and the scales are older than the town hall.",
    "When snow closes the pass the stalls move into the barn behind the inn, where it is warm and loud and the children play between the sacks until they are sent home.",
)
_SHORTS = ("Yes.", "It rains.", "So it went on.", "Cheese and bread.", "rye", "two pounds of wool", "The end of winter.")
_TITLES = ("The market", "Wool", "How the market in the valley began", "Bread and cheese")
_LINKS = ("Home", "News and stories", "Contact", "Archive of all stories", "Log in", "Terms", "Next story in this series", "Our prices")
_LINES = ("Valley News", "Monday", "All rights reserved", "Printed by Valley Press", "Back to top", "Since 1901", "Share this", "Most read this week")


def samples(pages: int = 720) -> Iterator[tuple[str, list[bool]]]:
    """The labelled pages: html, and for each of its blocks whether it is main text.

    A third marks the article as such, a third names the furniture's regions only, and a third
    does neither, so that there words and link densities of a block and its neighbours must tell.
    """
    rng = random.Random(10)
    for k in range(pages):
        said: list[bool] = []
        out: list[str] = []

        def put(tag: str, text: str, main: bool, said=said, out=out) -> None:
            out.append(f"<{tag}>{text}</{tag.split()[0]}>")
            said.append(main)

        def prose() -> str:
            return " ".join(rng.choice(_SENTENCES) for _ in range(rng.choice((1, 1, 2, 4, 9))))

        marked, named = k % 3 == 0, k % 3 == 1

        def menu(n: int) -> None:
            for _ in range(n):
                put("li" if rng.random() < 0.7 else "div", f'<a href="/x">{rng.choice(_LINKS)}</a>', False)

        def region(name: str, build) -> None:
            if marked or named:
                out.append(f"<{name}>")
            build()
            if marked or named:
                out.append(f"</{name.split()[0]}>")

        def lines(n: int) -> None:
            if (marked or named) and rng.random() < 0.3:
                put("h3", rng.choice(_TITLES), False)
            for _ in range(n):
                put(rng.choice(("div", "p")), rng.choice(_LINES), False)

        if rng.random() < 0.6:
            region(rng.choice(("nav", "header", 'div class="menu"', 'ul id="navigation"')), lambda: menu(rng.randrange(2, 7)))  # noqa: B023
        if rng.random() < 0.5:
            region(rng.choice(("header", 'div class="site-header"')), lambda: lines(rng.randrange(1, 3)))  # noqa: B023
        if (marked or named) and rng.random() < 0.6:
            region(rng.choice(('div class="ad"', 'div id="cookie-notice"', "aside", 'div class="promo banner"')), lambda: put("p", prose(), False))  # noqa: B023
        if marked and rng.random() < 0.4:
            put(rng.choice(("div", "p")), prose(), False)  # text outside the article
        if marked:
            out.append(rng.choice(("<article>", "<main>")))
        if rng.random() < 0.8:
            put(rng.choice(("h1", "h2")), rng.choice(_TITLES), True)
        n = rng.choice((1, 2, 3, 5, 8))
        for i in range(n):
            short = marked or 0 < i < n - 1  # told apart by its neighbours where nothing is marked
            if short and rng.random() < 0.4:
                put(rng.choice(("p", "p", "li", "td", "blockquote", "div")), rng.choice(_SHORTS), True)
            elif short and rng.random() < 0.1:
                put("p", f'<a href="/s">{rng.choice(_SENTENCES)}</a>', True)
            else:
                put(rng.choice(("p", "p", "div")), prose() + (' See <a href="/w">the list</a> too.' if rng.random() < 0.3 else ""), True)
            if marked and rng.random() < 0.15:  # furniture inside the article
                inner = rng.choice(("aside", "nav", 'div class="share"', 'div class="comments"', "form", 'div class="advert"'))
                region(inner, lambda: (put("p", prose(), False), put(rng.choice(("div", "p")), rng.choice(_LINES), False), menu(1), put("li", rng.choice(_SHORTS), False)))  # noqa: B023
        if marked:
            out.append("</article>" if "<article>" in out else "</main>")
            if rng.random() < 0.3:
                put(rng.choice(("div", "p")), prose(), False)
        if (marked or named) and rng.random() < 0.4:
            region(rng.choice(('div class="comments"', 'section id="disqus"')), lambda: (put("h4", "Comments", False), put("p", prose(), False), put("p", rng.choice(_SHORTS), False)))  # noqa: B023
        if (marked or named) and rng.random() < 0.5:
            region(rng.choice(("aside", 'div class="sidebar"')), lambda: (put("h3", rng.choice(_LINES), False), put("p", prose(), False), menu(2)))  # noqa: B023
        elif rng.random() < 0.6:
            menu(rng.randrange(1, 4))
        if rng.random() < 0.7:
            region(rng.choice(("footer", 'div class="footer"')), lambda: lines(rng.randrange(1, 4)))  # noqa: B023
        yield "".join(out), said


@lru_cache(1)
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The small labelled table: features of the samples' blocks, and whether they are main text."""
    x, y = [], []
    for page, said in samples():
        x.append(describe(blocks(page)))
        y.extend(said)
    return np.concatenate(x), np.array(y)


#: A tree: a leaf's verdict, or (feature, threshold, tree where at most, tree where over).
Tree = bool | tuple[int, float, "Tree", "Tree"]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, use: tuple[int, ...] = (8, 9, 11, 10, 7, 6, 5, 4, 3, 2, 1, 0)) -> Tree:
    """A decision tree by Gini impurity over the features in `use`; of equal splits, the one on the feature that comes first there."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() >= len(y))
    best: tuple[float, int, float] | None = None
    for f in use:
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            under = x[:, f] <= t
            a, b = y[under], y[~under]
            impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (a, b))
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, f, float(t))
    if best is None:
        return bool(2 * y.sum() >= len(y))
    _, f, t = best
    under = x[:, f] <= t
    return (f, t, grow(x[under], y[under], depth - 1, use), grow(x[~under], y[~under], depth - 1, use))


@lru_cache(1)
def tree() -> Tree:
    return grow(*labelled())


def verdicts(node: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(node, bool):
        return np.full(len(x), node)
    f, t, low, high = node
    under = x[:, f] <= t
    out = np.empty(len(x), bool)
    out[under] = verdicts(low, x[under])
    out[~under] = verdicts(high, x[~under])
    return out


def main_text(pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    found = [blocks(p) if p else [] for p in pages]
    keep = verdicts(tree(), np.concatenate([describe(b) for b in found])) if found else []
    out, at = [], 0
    for b in found:
        out.append("\n\n".join(x[0] for x, k in zip(b, keep[at : at + len(b)], strict=True) if k))
        at += len(b)
    return out


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "html"):
            text = main_text(part.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    arm(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
