"""Main text of web pages: flat blocks, neighbours' figures, a decision tree.

A page is cut into flat text blocks at block-level tags.  A block's figures are
its word count and link density, those of the blocks before and after it, its share
of the page's words outside links, and cues of the elements around it: whether
a navigation, header, footer, aside or form element encloses it, whether a class
or id that names one does, or is on the paragraph itself, whether an article or
main element does, and whether it is a heading.  A decision tree (Gini, grown
on the small labelled table that ``LABELLED`` builds) says which blocks are the
article's; those are joined by newlines.  Half the labelled pages have no names
at all, and some have names that mislead, so that link density and word counts
decide there.

Edge cases: null html counts as empty and gives an empty text; markup that is
cut off or not closed is read to the page's end; repeated rows and null ids get
a result row each; an empty table gives an empty result; columns besides
page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumentrace.llm.common import table

#: Elements whose content is no text of the page.
UNSEEN = "script|style|noscript|template|svg|math|iframe|object|textarea|select|button|title|canvas|audio|video|map"
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold blocks and are followed by a stack; void and inline ones are not.
HOLDERS = frozenset("article aside body details dialog div dl fieldset figure footer form header main menu nav ol search section table td th tr ul".split())
#: Elements, and words of class or id names, around what is not the article.
APART = frozenset("nav footer aside form menu dialog search fieldset".split())
APART_NAMES = frozenset("ad ads adv advert advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Such a word after one of these names a part of the article itself.
OWN_NAMES = frozenset("article content entry page post story text".split())
#: Names of elements that hold an article, and what may follow them.
ARTICLE_NAMES, ARTICLE_PARTS = frozenset("article entry post story".split()), frozenset("body content main text".split())
#: Words behind a name that sets apart which leave its meaning; inside an article others change it (a share price is text).
CARRIERS = frozenset("area articles bar block blocks box button buttons card cards column container content count cta form group header heading icon icons inner item items label left link links list message news outer pages panel posts reading right row section slot stories strip text thread tile title top unit wrap wrapper".split())
#: A part of a name that has one of these says what a wrapper has or lacks, not what it is.
HAVING = frozenset("has have having with without no not hide hides show shows".split())
#: Elements that no name sets apart.
WHOLE = frozenset("html body main article".split())
#: Elements without their own closing tag end where another block begins.
SHORT = frozenset("p pre h1 h2 h3 h4 h5 h6 legend caption summary".split())
#: Elements that end where one of their kind begins.
ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())

#: What stands between a tag's name and its end: a quote opens a value only behind an equals sign.
INSIDE = r"""(?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({UNSEEN})\b{INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({INSIDE})>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S | re.I)
LINK = re.compile(r"<(/)?a(?=[\s>/])", re.I)
ATTRIBUTE = re.compile(r"""([^\s=>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
CUES = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden", "data-main"))
WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str, inside: bool = False) -> tuple[bool, bool, bool, bool]:
    """(apart, apart by a name, article, marked as main in the labelled table) of an opening tag, ``inside`` an article or not."""
    apart, named, article, marked = tag in APART, False, tag in ("article", "main"), False
    for name, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        name, value = name.lower(), next(filter(None, values), "")
        if name not in CUES:
            continue
        if name in ("class", "id"):
            if tag in WHOLE:
                continue
            for part in value.split():
                words = [w.lower() for w in WORD_OF_NAME.findall(part)]
                first = next((i for i, w in enumerate(words) if w in APART_NAMES), None)
                if words and words[0] in ARTICLE_NAMES and (len(words) == 1 or len(words) == 2 and words[1] in ARTICLE_PARTS):
                    article = article or tag in HOLDERS
                if inside and first is not None and words[-1] not in APART_NAMES and words[-1] not in CARRIERS:
                    first = None
                if first is not None and not HAVING.intersection(words[:first]) and not (words[0] in OWN_NAMES and words[-1] not in APART_NAMES):
                    named = True
                if words and words[0] in ("header", "masthead") or words[-2:] in (["site", "header"], ["page", "header"]):
                    named = named or tag not in ("h1", "h2")
        elif name == "role":
            apart, article = apart or value.lower() in ROLES, article or value.lower() in ("main", "article")
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value) or name == "aria-hidden" and value == "true":
            apart = True
        elif name == "data-main":
            marked = True
    return apart, named, article, marked


@dataclass
class Block:
    text: str
    words: int
    linked: float
    heading: bool
    apart: bool
    article: bool
    marked: bool
    #: Heading of the first level; numbers of the elements around it that a name sets apart; whether one is on itself.
    title: bool = False
    named: tuple[int, ...] = ()
    own: bool = False


def _settle(found: list[Block]) -> list[Block]:
    """Drops names of elements that wrap the page's text from the blocks inside.

    Such an element has the larger part of the words outside links, no article
    element stands outside it, and it has the page's title, an article element
    or nearly all the words.
    """
    weight = [0.0 if b.apart else b.words * (1 - b.linked) for b in found]
    whole, inside = sum(weight), {}
    for b, w in zip(found, weight):
        for k in b.named:
            inside[k] = inside.get(k, 0.0) + w
    for k, w in inside.items():
        if 2 * w > whole and not any(b.article and k not in b.named for b in found):
            if 5 * w > 4 * whole or any((b.title or b.article) and k in b.named for b in found):
                for b in found:
                    b.named = tuple(x for x in b.named if x != k)
    return found


def blocks(html: str) -> list[Block]:
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, tuple[int, ...]]] = [("", False, False, False, ())]
    parts: list[str] = []
    link_chars, in_link, over, heading, title, marked, own, n_named = 0, False, False, False, False, False, False, 0

    def close() -> None:
        nonlocal link_chars
        text = " ".join("".join(parts).split())
        if text:
            _, apart, article, main, names = stack[-1]
            found.append(Block(text, text.count(" ") + 1, min(1.0, link_chars / len(text)), heading, apart, article, main or marked, title, names, own))
        parts.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = references.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                link_chars += len(text.strip())

    at = 0
    for token in TOKEN.finditer(html):
        add(html[at : token.start()])
        at = token.end()
        tag = token[3]
        if not tag:
            parts.append(" " if token[1] else "")
            continue
        tag, closing = tag.lower(), bool(token[2])
        if tag == "a":
            in_link = not closing
            # A link goes over blocks if its end comes before another link begins; else the next block ends it.
            end = LINK.search(html, at) if in_link else None
            over = end is not None and end[1] is not None
        elif tag in ("br", "img", "input", "wbr"):
            parts.append("" if tag == "wbr" else " ")
        elif tag in BLOCKS:
            close()
            in_link = in_link and over
            heading = tag[0] == "h" and tag[1:].isdigit() and not closing
            title, marked, own = heading and tag == "h1", False, False
            if closing:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag or tag not in HOLDERS and stack[i][0] in HOLDERS), 0)
                if depth and stack[depth][0] == tag:
                    del stack[depth:]
                continue
            while stack[-1][0] in SHORT or stack[-1][0] in ITEMS.get(tag, ()):
                stack.pop()
            _, was_apart, was_article, was_main, names = stack[-1]
            apart, named, article, main = _kind(tag, token[4], was_article)
            if named and tag in SHORT:
                own = True
            elif named:
                n_named += 1
                names = (*names, n_named)
            if tag in HOLDERS:
                if tag == "header":
                    apart = apart or not was_article
                stack.append((tag, was_apart or apart, was_article or article, was_main or main, names))
            else:
                marked = main
                if apart or named and not own:  # an item that is itself a notice
                    stack.append((tag, was_apart or apart, was_article, was_main, names))
        # inline elements end no block
    add(html[at:])
    close()
    return _settle(found)


FIGURES = ("words", "linked", "words before", "linked before", "words after", "linked after", "heading", "apart", "named", "own name", "article", "page has an article", "share")


def figures(page: list[Block]) -> np.ndarray:
    if not page:
        return np.zeros((0, len(FIGURES)))
    own = np.array([[b.words, b.linked] for b in page], float)
    edge = np.zeros((1, 2))
    flags = np.array([[b.heading, b.apart, bool(b.named), b.own, b.article] for b in page], float)
    any_ = np.full((len(page), 1), float(any(b.article for b in page)))
    plain = own[:, :1] * (1 - own[:, 1:])
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), flags, any_, plain / max(1.0, plain.sum())])


def _page(rng: np.random.Generator, style: str) -> str:
    """A labelled page: the article's blocks carry data-main."""
    words = lambda a, b: " ".join(["word"] * int(rng.integers(a, b)))
    links = lambda n: "".join(f'<li><a href="#">{words(1, 4)}</a></li>' for _ in range(n))
    body = [f"<h1 data-main>{words(2, 12)}</h1>"]
    for _ in range(int(rng.integers(1, 9))):
        body.append(f"<p data-main>{words(*((12, 120) if style == 'bare' else (1, 120) if rng.random() < 0.7 else (1, 9)))}</p>")
    if rng.random() < 0.5:
        body.insert(2, f'<p data-main>{words(4, 40)} <a href="#">{words(1, 6)}</a> {words(4, 30)}</p>')
    if style in ("links", "bare", "misnamed"):  # pointers to other pages among the paragraphs
        body.insert(int(rng.integers(2, len(body) + 1)), f'<p>{words(1, 4)} <a href="#">{words(4, 14)}</a></p>')
    story = "".join(body)
    ad, notice, note = words(3, 40), words(5, 40), words(2, 80)
    if style == "semantic":
        return f'<header><p>{words(1, 6)}</p></header><nav><ul>{links(6)}</ul></nav><div class="ad">{ad}</div><article>{story}</article><aside>{note}</aside><form><p>{words(2, 8)}</p></form><footer>{words(3, 20)}</footer>'
    if style == "nested":
        return f'<nav>{links(5)}</nav><main><article><header><h1 data-main>{words(3, 9)}</h1></header>{story}<div class="ad">{ad}</div></article><section id="comments"><p>{note}</p></section></main><div class="cookie-notice"><p>{notice}</p></div><footer><p>{words(3, 20)}</p></footer>'
    if style == "named":
        return f'<div id="menu"><ul>{links(7)}</ul></div><div class="notice">{notice}</div><div class="content">{story}</div><div class="sidebar"><p>{note}</p><ul>{links(4)}</ul></div><div class="comments"><p>{note}</p></div><div id="footer">{words(3, 20)}</div>'
    if style == "single":
        return "".join(f"<p data-main>{words(4, 60)}</p>" for _ in range(int(rng.integers(1, 4))))
    if style == "links":
        entry = lambda: f'<p><a href="#">{words(3, 12)}</a> {words(0, 3)}</p>'
        crumbs = " / ".join(f'<a href="#">{words(1, 3)}</a>' for _ in range(4))
        return f"<div>{crumbs}</div>{entry()}{entry()}<div>{story}</div><div><h3>{words(1, 4)}</h3>{entry()}{entry()}{entry()}</div><div>{crumbs}</div>"
    if style == "misnamed":
        own = lambda a, b, main: f'<p class="{rng.choice(["related", "share", "notice", "comment", "ad"])}"{" data-main" * main}>{words(a, b)}</p>'
        notes = [own(*x) for x in ((14, 80, True), (14, 80, True), (1, 9, False), (1, 9, False))]
        notes = "".join(notes[k] for k in rng.permutation(4))
        return f"<nav>{links(4)}</nav><article>{story}{notes}</article><div class='comments'>{own(10, 60, False)}</div><footer>{words(3, 20)}</footer>"
    if style == "wrapped":
        return f'<body class="has-sidebar"><div class="content-with-sidebar social-page"><p class="share">{words(1, 5)}<div>{story}</div><ul><li class="ad">{words(2, 8)}<li><a href="#">{words(1, 4)}</a></ul><div class="sidebar">{note}</div></div><div id="footer">{words(3, 20)}</div>'
    return f"<div><ul>{links(8)}</ul></div><div>{story}</div><div><ul>{links(5)}</ul><p>{words(1, 5)}</p></div>"


STYLES = ("semantic", "nested", "named", "bare", "links", "single", "bare", "links")


def LABELLED(pages: int = 320, seed: int = 7, styles: tuple[str, ...] = STYLES) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: figures and labels of the blocks of small built pages, of seven layouts."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for style in [*(styles[k % len(styles)] for k in range(pages)), *["wrapped", "misnamed"] * (pages // 8)]:
        found = blocks(f"<html><body>{_page(rng, style)}</body></html>")
        x.append(figures(found))
        y += [b.marked for b in found]
    return np.vstack(x), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 3):
    """A binary tree as nested (figure, threshold, below, above); leaves are True or False."""
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return bool(2 * y.sum() > len(y))
    best = (1e-9, 0, 0.0)
    whole = 2 * y.mean() * (1 - y.mean()) * len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        cut = np.flatnonzero((values[1:] > values[:-1]) & (n >= least) & (len(y) - n >= least))
        if not len(cut):
            continue
        left, right = n[cut], len(y) - n[cut]
        a, b = ones[cut], ones[-1] - ones[cut]
        gain = whole - 2 * (a * (left - a) / left + b * (right - b) / right)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((values[cut[k]] + values[cut[k] + 1]) / 2))
    gain, f, threshold = best
    if gain <= 1e-9:
        return bool(2 * y.sum() > len(y))
    below = x[:, f] <= threshold
    return f, threshold, grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    f, threshold, below, above = tree
    side = x[:, f] <= threshold
    out = np.empty(len(x), bool)
    out[side], out[~side] = classify(below, x[side]), classify(above, x[~side])
    return out


def main_text(html: str | None, tree) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, main in zip(page, classify(tree, figures(page))) if main)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    tree = grow(*LABELLED())

    def texts(batches):
        for batch in batches:
            found = [main_text(h, tree) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
