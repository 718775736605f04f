"""Main text of HTML pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes its leaf blocks in order: stretches of text between block-level tags, each with its
open ancestors. Features of a block are its ancestor tags, words of their class, id and role
attributes, and its text; the chain's two labels are main text and the rest, decoded by Viterbi. The
model is trained here, on pages labelled as they are made by rule (``training_pages``).

Scripts, styles and comments are never text, nor are the head, templates, iframes, form fields (select,
textarea) and svg drawings. Text of math, object and noscript is blocks like any other. Character
references are decoded, white space inside a block becomes one space, blocks are joined by a line feed.

Defined results: null or empty html, and pages without main text, give an empty text; html that
ends inside a tag or an element is read up to its end, but for a script, style or comment, which drop
what follows as they hold it; an element left out whose end tag is missing leaves out its start tag
alone; a head without end tag ends at the first tag of a body; text without tags is one block; repeated rows
are read again; an empty table gives an empty result; extra columns are ignored. Pages of any length
and depth are read whole: what a block keeps of its ancestors is their kinds.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(?P<broken>/?[a-zA-Z][^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A '/' that belongs to a value without quotes.
_UNQUOTED = re.compile(r"""=\s*[^\s"'=]+/\Z""")
_SPACE = re.compile(r"\s+")

# Element kinds of HTML.
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "iframe", "legend", "li", "main", "menu", "nav",
    "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "ul", "video", "audio",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "template", "svg", "iframe", "textarea", "select", "head", "title"}
#: Raw elements that hold the rest of the page where their end tag is missing, those of foreign content, which '/>' ends, and tags that an open head may hold.
TO_END, FOREIGN, IN_HEAD = {"script", "style"}, {"svg", "math"}, {"base", "link", "meta", "title", "script", "style", "template", "noscript", "object"}
#: Elements whose text is blocks of its own but that do not end a paragraph.
APART = {"noscript", "object"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Start tags that close an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class, id and role by what they stand for.
WORDS = {
    "nav": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "skip"}, "ad": {"ad", "ads", "adv", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "outbrain", "taboola"},
    "side": {"sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "rail", "complementary", "more"}, "comment": {"comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "commentlist", "reader", "feedback"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "warning", "toast"}, "foot": {"footer", "foot", "copyright", "legal", "colophon", "bottom", "contentinfo"},
    "head": {"header", "masthead", "topbar", "logo", "branding", "toolbar"}, "share": {"share", "sharing", "social", "follow"}, "form": {"form", "search", "login", "register", "poll"}, "meta": {"byline", "author", "tags", "meta", "date", "caption", "credit"},
    "main": {"article", "content", "main", "post", "entry", "story", "body", "text", "articlebody", "maintext"}, "hidden": {"hidden"},
}
_TAGS = ("article", "main", "section", "div", "p", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "td", "h1", "h2", "h3", "blockquote", "pre", "figure", "figcaption", "button", "a", "dl", "details", "dialog", "address", "menu", "label")
_NAMES = ["bias", *(f"in:{t}" for t in _TAGS), *(f"own:{t}" for t in _TAGS), *(f"word:{w}" for w in WORDS), "words0-3", "words4-9", "words10-29", "words30+", "links0", "links<half", "links>half", "links_all", "stop", "copyright", "article_out", "header_in_article", "first"]
_AT = {n: i for i, n in enumerate(_NAMES)}


class Block:
    """A leaf block: its text, the kinds of its ancestors, the nearest block among them, what their attributes say, its linked characters."""

    __slots__ = ("text", "path", "own", "words", "linked")

    def __init__(self, text, path, own, words, linked):
        self.text, self.path, self.own, self.words, self.linked = text, path, own, words, linked


class _Open:
    """The open elements: a stack, and how often each kind of tag and attribute word is on it."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.tags: Counter = Counter()
        self.words: Counter = Counter()
        self.blocks: list[int] = []
        self.paragraphs: list[int] = []

    def push(self, tag: str, words: frozenset[str]) -> None:
        for kind, where in ((tag in BLOCKS, self.blocks), (tag == "p", self.paragraphs)):
            if kind:
                where.append(len(self.stack))
        self.stack.append((tag, words))
        self.tags[tag] += 1
        self.words.update(words)

    def pop(self) -> str:
        tag, words = self.stack.pop()
        for where in (self.blocks, self.paragraphs):
            if where and where[-1] == len(self.stack):
                where.pop()
        for counts, names in ((self.tags, (tag,)), (self.words, words)):
            for x in names:
                counts[x] -= 1
                if not counts[x]:
                    del counts[x]
        return tag


def _attr_words(attrs: str) -> frozenset[str]:
    found = set()
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            found.add("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            parts = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            found |= {k for k, ws in WORDS.items() if k != "hidden" and parts & ws}
    return frozenset(found)


_CLOSE = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW | APART}


def _head_end(page: str, at: int, missing: set[str]) -> int:
    """Where a head that opens before at ends: past its end tag, or before the first text or tag that none holds."""
    while True:
        m = _TOKEN.search(page, at)
        if page[at : m.start() if m else len(page)].strip():
            return at
        if not m:
            return len(page)
        tag = (m["tag"] or "").lower()
        if m["end"] and tag == "head":
            return m.end()
        if m["cdata"] is not None or m["broken"] or tag and not m["end"] and tag not in IN_HEAD:
            return m.start()
        at = m.end()
        if tag in _CLOSE and not m["end"] and tag not in missing:
            close = _CLOSE[tag].search(page, at)
            if not close:
                missing.add(tag)
            at = close.end() if close else len(page) if tag in TO_END else at


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page, in order; text of raw elements is left out."""
    page = page or ""
    out: list[Block] = []
    open_ = _Open()
    stack = open_.stack
    buf: list[str] = []
    linked = at = 0
    in_link = False
    #: Raw elements without an end tag in the rest of the page; it is not searched again.
    missing: set[str] = set()

    def flush():
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
        if text:
            own = stack[open_.blocks[-1]][0] if open_.blocks else None
            out.append(Block(text, frozenset(open_.tags), own, frozenset(open_.words), min(linked, len(text))))
        buf.clear()
        linked = 0

    def add(s: str):
        nonlocal linked
        buf.append(s)
        if in_link:
            linked += len(s)

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        tag = m["tag"] or (re.match("/?([a-zA-Z0-9:-]+)", m["broken"])[1] if m["broken"] else None)
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m["end"]) or bool(m["broken"] and m["broken"][0] == "/")
        if closing:
            if tag in BLOCKS or tag in APART:
                flush()
            # An end tag closes what is open inside its element; without one it is ignored.
            if tag in open_.tags:
                while open_.pop() != tag:
                    pass
                in_link = "a" in open_.tags
            continue
        attrs = m["attrs"] or ""
        if tag in FOREIGN and attrs.endswith("/") and not _UNQUOTED.search(attrs):
            continue
        if tag in APART:
            flush()
        if tag in RAW:
            flush()
            if tag == "head":
                at = _head_end(page, at, missing)
                continue
            close = _CLOSE[tag].search(page, at) if tag not in missing else None
            if close:
                at = close.end()
            elif tag in TO_END:
                at = len(page)
            else:
                missing.add(tag)
            continue
        if tag == "br":
            add(" ")
        if tag in BLOCKS:
            flush()
            # A block ends an open paragraph, with the inline elements inside it.
            if open_.paragraphs and open_.blocks[-1] == open_.paragraphs[-1]:
                k = open_.paragraphs[-1]
                while len(stack) > k:
                    open_.pop()
            for t in CLOSES.get(tag, ()):
                while stack and stack[-1][0] in CLOSES[tag] | {"a", "b", "i", "span", "em", "strong"} and any(x in CLOSES[tag] for x, _ in stack[-3:]) and t == tag:
                    open_.pop()
            in_link = "a" in open_.tags
        if tag not in VOID and not attrs.endswith("/"):
            open_.push(tag, _attr_words(attrs) if attrs else frozenset())
            in_link = in_link or tag == "a"
    flush()
    return out


def block_features(blocks: list[Block]) -> list[list[int]]:
    has_article = any("article" in b.path or "main" in b.path for b in blocks)
    out = []
    for k, b in enumerate(blocks):
        f = [_AT["bias"]]
        path = b.path
        f += [_AT[f"in:{t}"] for t in _TAGS if t in path]
        if f"own:{b.own}" in _AT:
            f.append(_AT[f"own:{b.own}"])
        f += [_AT[f"word:{w}"] for w in b.words]
        n = b.text.count(" ") + 1
        f.append(_AT["words0-3" if n < 4 else "words4-9" if n < 10 else "words10-29" if n < 30 else "words30+"])
        share = b.linked / len(b.text)
        f.append(_AT["links0" if not b.linked else "links<half" if share < 0.5 else "links>half" if share < 0.95 else "links_all"])
        if b.text[-1] in ".!?:;…\"”»":
            f.append(_AT["stop"])
        if "©" in b.text or "all rights reserved" in b.text.lower():
            f.append(_AT["copyright"])
        if has_article and not path & {"article", "main"}:
            f.append(_AT["article_out"])
        if "header" in path and "article" in path:
            f.append(_AT["header_in_article"])
        if k == 0:
            f.append(_AT["first"])
        out.append(f)
    return out


class Chain:
    """Two labels, 1 the main text: a weight for each label 1 feature, and pairwise weights."""

    def __init__(self, w: np.ndarray, pair: np.ndarray):
        self.w, self.pair = w, pair

    def viterbi(self, feats: list[list[int]]) -> list[int]:
        if not feats:
            return []
        pair, back = self.pair.tolist(), []
        a, b = 0.0, float(self.w[feats[0]].sum())
        for f in feats[1:]:
            s = float(self.w[f].sum())
            from0, from1 = (a + pair[0][0], b + pair[1][0]), (a + pair[0][1], b + pair[1][1])
            back.append((from0[1] > from0[0], from1[1] > from1[0]))
            a, b = max(from0), max(from1) + s
        out = [int(b > a)]
        for bk in reversed(back):
            out.append(int(bk[out[-1]]))
        return out[::-1]

    def step(self, feats: list[list[int]], gold: list[int], rate: float, ridge: float) -> None:
        """One stochastic gradient step of the conditional likelihood."""
        s = np.array([[0.0, self.w[f].sum()] for f in feats])
        n = len(s)
        fwd, bwd = s.copy(), np.zeros_like(s)
        for k in range(1, n):
            fwd[k] += np.logaddexp.reduce(fwd[k - 1][:, None] + self.pair, 0)
        for k in range(n - 2, -1, -1):
            bwd[k] = np.logaddexp.reduce(self.pair + (s[k + 1] + bwd[k + 1])[None, :], 1)
        z = np.logaddexp.reduce(fwd[-1])
        p = np.exp(fwd + bwd - z)
        self.w *= 1 - rate * ridge
        for f, y, q in zip(feats, gold, p[:, 1]):
            self.w[f] += rate * (y - q)
        for k in range(1, n):
            e = np.exp(fwd[k - 1][:, None] + self.pair + (s[k] + bwd[k])[None, :] - z)
            self.pair -= rate * e
            self.pair[gold[k - 1], gold[k]] += rate


def training_pages(seed: int = 3, n: int = 160) -> list[str]:
    """Pages made by rule; main text carries the mark KEEP in its words, other text the mark DROP."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))

    def words(a: int, b: int, mark: str) -> str:
        return f"{mark}{word()} " + " ".join(word() for _ in range(r.randint(a, b)))

    def keep(a=2, b=60):
        return words(a, b, "KEEP") + r.choice((".", ".", "!", "?", ""))

    def drop(a=0, b=14):
        return words(a, b, "DROP") + r.choice(("", "", "."))

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{drop(0, 3)}</a></li>' for _ in range(k)) + "</ul>"

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.72:
            body = keep(0, 90)
            return f"<p>{body}</p>" if r.random() < 0.8 else f"<p><b>{body}<br>" if r.random() < 0.5 else f'<p>{body} <a href="/x">{word()} {word()}</a></p>'
        return r.choice((lambda: f"<h2>{keep(0, 6)}</h2>", lambda: f"<blockquote>{keep(4, 30)}</blockquote>", lambda: "<ul>" + "".join(f"<li>{keep(1, 12)}</li>" for _ in range(3)) + "</ul>", lambda: f"<pre>{keep(3, 20)}</pre>", lambda: f"<table><tr><td>{keep(0, 4)}</td><td>{keep(0, 4)}</td></tr></table>", lambda: f"<figure><figcaption>{keep(3, 12)}</figcaption></figure>"))()

    noise = [
        lambda: f"<nav>{links(r.randint(3, 8))}</nav>", lambda: f'<div class="{r.choice(("menu", "nav-bar", "breadcrumbs"))}">{links(4)}</div>', lambda: f'<div class="{r.choice(("ad", "ads-box", "advert", "sponsored", "promo"))}">{drop(2, 30)}</div>', lambda: f"<aside>{drop(3, 30)}</aside>",
        lambda: f'<div class="sidebar"><h3>{drop(0, 3)}</h3>{links(4)}<p>{drop(3, 25)}</p></div>', lambda: f'<div id="{r.choice(("cookie-notice", "consent", "newsletter", "alert"))}"><p>{drop(4, 30)}</p><button>{drop(0, 1)}</button></div>', lambda: f'<form action="/s"><label>{drop(0, 2)}</label><input name="q"><button>{drop(0, 1)}</button></form>',
        lambda: f'<section class="{r.choice(("comments", "comment-list", "replies"))}"><h3>{drop(0, 3)}</h3>' + "".join(f'<div class="comment"><p>{drop(3, 60)}</p></div>' for _ in range(r.randint(1, 4))) + "</section>", lambda: f'<div class="share social">{links(3)}</div>', lambda: f'<div class="related"><h3>{drop(0, 3)}</h3>{links(4)}</div>', lambda: f'<ol id="comments"><li>{drop(3, 50)}</li><li>{drop(3, 50)}</li></ol>',
    ]
    out = []
    for _ in range(n):
        head = f"<header><a href='/'>{drop(0, 3)}</a>{r.choice(('', f'<p>{drop(2, 8)}</p>'))}</header>" if r.random() < 0.4 else ""
        before = "".join(r.choice(noise)() for _ in range(r.randint(0, 3)))
        inner = [paragraph() for _ in range(r.randint(1, 14))]
        if r.random() < 0.45:
            inner.insert(r.randint(0, len(inner)), r.choice(noise)())
        title = f"<h1>{keep(0, 10)}</h1>" if r.random() < 0.85 else ""
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        body = title + "".join(inner)
        wrap = r.random()
        body = f"<article>{body}</article>" if wrap < 0.6 else f"<main>{body}</main>" if wrap < 0.75 else f'<div class="{r.choice(("content", "post", "entry-content", "article-body"))}">{body}</div>' if wrap < 0.9 else f"<div>{body}</div>"
        after = "".join(r.choice(noise)() for _ in range(r.randint(0, 3)))
        foot = r.choice((f"<footer>&copy; {drop(2, 12)}</footer>", f'<div class="footer"><p>&copy; {drop(2, 9)}</p></div>', ""))
        out.append(f"<html><head><title>{word()}</title></head><body>{head}{before}{body}{after}{foot}</body></html>")
    return out


@lru_cache(1)
def trained(epochs: int = 12, ridge: float = 0.002) -> Chain:
    chain, rng = Chain(np.zeros(len(_NAMES)), np.zeros((2, 2))), random.Random(1)
    data = []
    for page in training_pages():
        blocks = blocks_of(page)
        data.append((block_features(blocks), [int("KEEP" in b.text) for b in blocks]))
    for k in range(epochs):
        rng.shuffle(data)
        for feats, gold in data:
            chain.step(feats, gold, 0.1 / (1 + 0.2 * k), ridge)
    return chain


def main_blocks(page: str | None, chain: Chain) -> list[str]:
    blocks = blocks_of(page)
    return [b.text for b, y in zip(blocks, chain.viterbi(block_features(blocks))) if y]


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks."""
    chain = trained()
    schema = "page_id long, url string, text string, n_chars long, n_blocks long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [main_blocks(h, chain) for h in pdf["html"].array]
            texts = ["\n".join(b) for b in found]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(b) for b in found]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInPandas(run, schema)
