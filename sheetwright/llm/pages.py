"""Main text of HTML pages by flat text blocks and a decision tree.

A page is cut into flat blocks of text. Each has its word count and link
density, those of its neighbours, and marks of the elements around it. A
decision tree, trained on a small labelled table that is made by rule below,
says which blocks are the article.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the labelled table: about 20 blocks each.
TRAINING_PAGES = 240
DEPTH, LEAF = 6, 12
#: Share of the labelled table's adverts and notices that no name tells.
UNNAMED = 0.25

_RAW = "script|style|noscript|template|textarea|title|iframe|svg|object|select"
#: Comments, elements without readable text, declarations, and tags. Nothing but quoted values and comments
#: runs past a "<", so a page of unclosed tags is read in time in proportion to its length.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^<>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z))|<[!?][^<>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|aria-label|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements that don't end a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msup msub mfrac msqrt semantics annotation".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset("article main".split())
_OTHER = frozenset("nav footer aside form menu dialog head fieldset".split())
#: Words that mark what isn't the article, as the first or last word of a name in class, id or role.
_OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promoted promotion breadcrumb breadcrumbs comment comments commentlist "
    "respond disqus reply replies discussion cookie cookies cookiebar consent gdpr notice notices alert alerts warning popup modal overlay nav navbar navigation menu submenu menubar sidebar sidenav "
    "sidemenu aside footer foot topbar toolbar share sharing sharebar social related recommended recommendations newsletter subscribe subscription signup login search searchbox widget widgets "
    "tags tagcloud pagination pager copyright legal disclaimer contentinfo complementary skip skiplink hidden".split()
)
#: Words of page headers; within the article a header is the article's.
_HEAD_WORDS = frozenset("header masthead banner".split())
_MAIN_FIRST, _MAIN_LAST = frozenset("article main content post entry story prose".split()), frozenset("article main content post entry story prose text body bodytext".split())
#: Names that begin or end so tell how a page is laid out or switched, not what an element holds.
_FLAG_FIRST, _FLAG_LAST = frozenset("no not has have with without is js hide show".split()), frozenset("enabled disabled on off open closed active visible".split())
_SHAPES = frozenset("wide narrow full left right top bottom large small big fixed fluid dark light inner outer wrapper wrap container box block area section".split())
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "main", "other", "heading", "item")


def blocks(page: str) -> list[dict]:
    """The flat text blocks of a page: text, words, links (share of words in links), main, other, heading, item.

    main and other: whether an element around the block marks the article, or
    something else; the innermost mark of the two kinds counts for main,
    while any mark of something else inside the article counts.
    """
    out: list[dict] = []
    stack: list[tuple[str, int, int]] = []  # open element, main, other
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    state = {"main": 0, "other": 0, "heading": 0, "item": 0}
    in_link, heading, item = 0, 0, 0

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            words = text.split(" ")
            out.append(dict(state, text=text, words=len(words), links=min(1.0, len("".join(linked).split()) / len(words)), heading=heading, item=item))
        parts.clear()
        linked.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            parts.append(text)
            if in_link:
                linked.append(text + " ")
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = m[2] == "/"
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _INLINE:
            if not closing and m[4] and _marks(name, m[4])[2]:
                stack.append((name, state["main"], 1))
                open_names[name] += 1
                end()
                state["other"] = 1
            elif closing and any(x[0] == name for x in stack[-1:]):
                end()
                open_names[stack.pop()[0]] -= 1
                _, state["main"], state["other"] = stack[-1] if stack else ("", 0, 0)
            continue
        end()
        in_link = 0
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = 0 if closing else 1
        elif name in ("p", "div", "section", "article", "td"):
            heading = 0
        if name in ("li", "dt", "dd", "option"):
            item = 0 if closing else 1
        elif name in ("ul", "ol", "dl", "p", "div", "section", "article"):
            item = 0
        if name in _VOID or name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "dt", "dd", "html", "body") and (closing or not m[4]):
            continue
        if closing:
            while open_names[name]:  # each element is closed once, however deep
                last = stack.pop()[0]
                open_names[last] -= 1
                if last == name:
                    break
        else:
            was = stack[-1] if stack else ("", 0, 0)
            main, other, _ = _marks(name, m[4], was[1])
            open_names[name] += 1
            if main and not other:
                stack.append((name, 1, was[2] if was[1] or name not in _MAIN else 0))
            elif other and not (name == "header" and was[1]):
                stack.append((name, was[1], 1))
            else:
                stack.append((name, was[1], was[2]))
        _, state["main"], state["other"] = stack[-1] if stack else ("", 0, 0)
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    end()
    return out


def name_kind(name: str, inside: int = 0) -> str:
    """What a name in class, id or role says of its element: "main", "other", "shape" (other, with a word of its shape) or "".

    A name is taken apart at hyphens, underscores and capitals, and judged by
    its first and last word; inside: whether the element is in the article.
    """
    parts = [p for p in (x.rstrip("0123456789").lower() for x in re.split(r"[-_\s]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name))) if p]
    if not parts or len(parts) > 1 and (parts[0] in _FLAG_FIRST or parts[-1] in _FLAG_LAST):
        return ""
    shaped = False
    while len(parts) > 1 and parts[-1] in _SHAPES:
        parts.pop()
        shaped = True
    words = _OTHER_WORDS if inside else _OTHER_WORDS | _HEAD_WORDS
    if parts[-1] in words or parts[0] in words or "".join(parts) in words:
        return "shape" if shaped else "other"
    return "main" if parts[0] in _MAIN_FIRST or parts[-1] in _MAIN_LAST else ""


def _marks(name: str, attributes: str, inside: int = 0) -> tuple[int, int, int]:
    """Whether an element marks the article, something else, or is out of sight."""
    main, other, gone = int(name in _MAIN), int(name in _OTHER or name == "header"), 0
    if attributes and name not in ("html", "body"):
        kinds: list[str] = []
        for key, *values in _ATTR.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key == "style":
                gone |= bool(_GONE.search(value))
            elif key == "hidden":
                gone = 1
            elif key == "aria-hidden":
                gone |= value.lower() == "true"
            elif name not in _MAIN:
                kinds += [name_kind(x, inside) for x in value.split()]
        main |= "main" in kinds
        other |= "other" in kinds or "shape" in kinds and "main" not in kinds
    return int(main), int(other or gone), int(gone)


def features(found: list[dict]) -> np.ndarray:
    """One row of FEATURES for each block; pages begin and end with an empty block."""
    own = np.array([[b["words"], b["links"]] for b in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    rest = np.array([[b["main"], b["other"], b["heading"], b["item"]] for b in found], float).reshape(-1, 4)
    return np.hstack([own, np.vstack([none, own[:-1]])[: len(own)], np.vstack([own[1:], none])[-len(own) :] if len(own) else own, rest])


class Tree:
    """A binary decision tree grown by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF):
        self.nodes: list[tuple] = []
        self._grow(x, y, depth, leaf)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int) -> int:
        k = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, float(y.mean()) if len(y) else 0.0))
        best = (1e-12, -1, 0.0)
        if depth and 0 < y.mean() < 1 and len(y) >= 2 * leaf:
            whole = y.mean() * (1 - y.mean())
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, t = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y))
                a, b = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
                gain = whole - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
                gain[(v[1:] == v[:-1]) | (n < leaf) | (len(y) - n < leaf)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, float(v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            a = self._grow(x[low], y[low], depth - 1, leaf)
            b = self._grow(x[~low], y[~low], depth - 1, leaf)
            self.nodes[k] = (best[1], best[2], a, b, self.nodes[k][4])
        return k

    def says(self, row: list[float]) -> bool:
        k = 0
        while True:
            f, cut, a, b, share = self.nodes[k]
            if f < 0:
                return share >= 0.5
            k = a if row[f] <= cut else b


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 5, unnamed: float = 0.0) -> list[tuple[str, set[str]]]:
    """Made pages and the texts of their article blocks: the small labelled table.

    Layouts vary in how the article and the rest are marked, or whether they
    are at all, and in how long and how linked the blocks are. ``unnamed``:
    share of adverts and notices whose class says nothing, so that only words
    and links tell them.
    """
    r = random.Random(seed)
    stems = "time river stone market garden winter signal engine paper window bridge forest letter music school harbour silver valley planet teacher".split()
    count = [0]

    def text(low: int, high: int) -> str:
        count[0] += 1
        words = [r.choice(stems) + r.choice(["", "s", "ing", "ed"]) for _ in range(r.randint(low, high) - 1)]
        return " ".join([f"n{count[0]}", *words]).capitalize() + r.choice([".", ".", ".", "!", ""])

    def linked(low: int, high: int) -> str:
        return f'<a href="/x">{text(low, high)}</a>'

    def named(*names: str) -> str:
        """One of the names, or one that says nothing."""
        return r.choice(names) if r.random() >= unnamed else "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(6))

    def menu() -> str:
        items = "".join(f"<li>{linked(1, 3)}</li>" for _ in range(r.randint(3, 7)))
        return r.choice(["<nav><ul>%s</ul></nav>", '<div class="menu"><ul>%s</ul></div>', "<ul>%s</ul>", '<div id="nav"><ul>%s</ul></div>']) % items

    def other() -> str:
        kind = r.randrange(9)
        if kind == 0:
            return menu()
        if kind == 1:
            return f'<div class="{named("ad", "ads", "advert", "sponsored", "banner-ad")}">{text(4, 30)}</div>'
        if kind == 2:
            return r.choice(["<aside>%s</aside>", '<div class="sidebar">%s</div>']) % f"<h3>{text(1, 4)}</h3><p>{text(5, 30)}</p><p>{linked(3, 8)}</p>"
        if kind == 3:
            return f'<div class="{named("cookie-notice", "notice", "alert", "consent")}"><p>{text(8, 35)}</p></div>'
        if kind == 4:
            return f"<form><label>{text(1, 4)}</label><input><p>{text(2, 12)}</p></form>"
        if kind == 5:
            each = "".join(f'<div class="comment"><p>{text(5, 60)}</p></div>' for _ in range(r.randint(1, 4)))
            return r.choice(['<section id="comments"><h2>%s</h2>%s</section>', '<div class="comments"><h3>%s</h3>%s</div>']) % (text(1, 3), each)
        if kind == 6:
            return r.choice(["<header><h1>%s</h1><p>%s</p></header>", '<div class="header"><h2>%s</h2><p>%s</p></div>']) % (text(1, 4), text(2, 10))
        if kind == 7:
            return f"<p>{linked(2, 6)} | {linked(1, 4)} | {linked(1, 4)}</p>"
        return r.choice(["<footer>&copy; %s</footer>", '<div class="footer"><p>%s</p></div>', "<p>&copy; %s</p>"]) % text(2, 10)

    out = []
    for _ in range(n):
        good: list[str] = []

        def mine(low: int, high: int, link: bool = False, good: list[str] = good) -> str:
            t = text(low, high)
            good.append(t)
            return t if not link else t.replace(" ", ' <a href="/y">', 1) + "</a>" if r.random() < 0.2 and " " in t else t

        bare = r.random() < 0.35
        body = [f"<h1>{mine(2, 9)}</h1>"] if not bare or r.random() < 0.5 else []
        for _ in range(r.randint(2, 9)):
            low, high = (15, 120) if bare or r.random() < 0.5 else r.choice([(1, 2), (1, 12), (5, 30)])
            body.append(f"<p>{mine(low, high, True)}</p>")
            if not bare and r.random() < 0.2:
                body.append(f"<h2>{mine(1, 5)}</h2>")
            if not bare and r.random() < 0.12:
                body.append(f"<ul><li>{mine(2, 12)}</li><li>{mine(2, 12)}</li></ul>")
            if r.random() < 0.12:
                body.append(other())
        wrap = "<div>%s</div>" if bare else r.choice(["<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<div id="main-content">%s</div>', '<div class="post-body">%s</div>', "<main><article>%s</article></main>"])
        before, after = [other() for _ in range(r.randint(1, 4))], [other() for _ in range(r.randint(1, 4))]
        out.append((f"<html><head><title>{text(2, 6)}</title></head><body>{''.join(before)}{wrap % ''.join(body)}{''.join(after)}</body></html>", set(good)))
    return out


def trained(pages: int = TRAINING_PAGES) -> Tree:
    """The tree, trained on the blocks of ``pages`` labelled pages."""
    x, y = [], []
    for page, good in labelled_pages(pages, unnamed=UNNAMED):
        found = blocks(page)
        x.append(features(found))
        y += [b["text"] in good for b in found]
    return Tree(np.vstack(x), np.array(y, float))


def main_text(page: str, tree: Tree) -> str:
    """The article's blocks joined by line ends."""
    found = blocks(page)
    return "\n".join(b["text"] for b, row in zip(found, features(found).tolist(), strict=True) if tree.says(row))


def extract_pages(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points), one row for each row of ``pages``.

    A null or empty html has an empty text, as has a page without an
    article. Repeated rows each get their row; equal pages have equal texts.
    Very long and broken pages are taken whole, in time in proportion to
    their length. Other columns are not looked at. An empty table gives an
    empty result. Nothing is shuffled; the tree is a few hundred bytes.
    """
    tree = tree or trained()
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", tree) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=out)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
