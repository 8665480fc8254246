"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is read as a flat list of blocks, the text between block-level tags.
A block's features are its words and link density (share of words inside
links), the same of the blocks before and behind it, whether it is a heading,
whether it lies in an article or main element, and whether an element around it
is named as something beside the article (:data:`BESIDE`). The tree is grown
from :data:`LABELLED`, a small table of pages whose blocks start with ``+``
(article) or ``-`` (anything else).

Texts of scripts, styles, comments, form fields and hidden elements are no
blocks. A head without an end tag ends where the body starts: at ``<body>``, or
right inside the head at an element or text that cannot stand there. Character references are decoded, white space inside a block becomes
one space, a single line break too; two line breaks in a row end a block.

NULL and empty pages, and pages without an article, give an empty text. Pages
are independent: repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML elements that start and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
SILENT_TAGS = frozenset("head title template noscript svg iframe object canvas textarea select button option datalist".split())
#: Elements that may stand right inside a head.
HEAD_TAGS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Elements that stand beside an article.
BESIDE_TAGS = frozenset("nav footer header aside form dialog menu fieldset".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id names that mark what is beside an article.
BESIDE = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright discussion disqus footer gdpr header legal login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related "
    "replies reply respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored "
    "subscribe tags teaser toolbar toolbox widget widgets".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|xmp)\b.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[/!?][^>]*>""",
    re.S | re.I,
)
_HELD = re.compile(r"</(title|template)\b", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """``silent``, ``beside``, ``article`` or nothing."""
    if tag in SILENT_TAGS:
        return "silent"
    if attributes:
        found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        bare = _ATTRIBUTE.sub("", attributes).lower().split()
        if "hidden" in bare or "hidden" in found or found.get("aria-hidden") == "true":
            return "silent"
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
            return "silent"
        if found.get("role", "").lower() in BESIDE_ROLES:
            return "beside"
        if tag not in ("body", "html", "article", "main"):
            names = f"{found.get('class', '')} {found.get('id', '')}"
            if any(x.lower() in BESIDE for x in _NAME.findall(names)):
                return "beside"
        if found.get("role", "").lower() in ("main", "article"):
            return "article"
    if tag in BESIDE_TAGS:
        return "" if tag == "header" and in_article else "beside"
    return "article" if tag in ("article", "main") else ""


def page_blocks(html: str) -> list[dict]:
    """The blocks of a page in order: text, words, linked, heading, article, beside."""
    blocks: list[dict] = []
    open_: list[tuple[str, str]] = []  # element, its kind
    depth = {"silent": 0, "beside": 0, "article": 0, "": 0}
    state = {"link": 0, "breaks": 0, "heading": False}
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            words = text.count(" ") + 1
            inside = len(" ".join(linked).split())
            blocks.append(
                {"text": text, "words": words, "linked": min(1.0, inside / words), "heading": state["heading"],
                 "article": depth["article"] > 0, "beside": depth["beside"] > 0}
            )
        parts.clear()
        linked.clear()
        state["breaks"] = 0

    def leave_head(tag: str, at: int) -> None:
        """Closes an open head where ``tag`` cannot be part of it; an empty tag stands for text."""
        place = next((i for i, (x, _) in enumerate(open_) if x == "head"), None)
        if place is None or tag in HEAD_TAGS:
            return
        within = {x for x, _ in open_[place + 1 :]} - {"head"}
        if within:
            # <body> written inside a title or template that is closed later is part of that
            later = within & {"title", "template"} and any(m[1].lower() in within for m in _HELD.finditer(html, at))
            if tag != "body" or later:
                return
        for _, kind in open_[place:]:
            depth[kind] -= 1
        del open_[place:]

    def add(raw: str) -> None:
        if depth["silent"] and raw and not raw.isspace() and "<" not in raw:
            leave_head("", at)
        if depth["silent"] or not raw:
            return
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if not text.isspace():
            state["breaks"] = 0
        if state["link"]:
            linked.append(text)

    at = 0
    for token in _TOKEN.finditer(html):
        add(html[at : token.start()])
        at = token.end()
        tag = token[3]
        if not tag:
            continue
        tag = tag.lower()
        if depth["silent"] and not token[2]:
            leave_head(tag, at)
        if tag == "br":
            parts.append(" ")
            state["breaks"] += 1
            if state["breaks"] > 1:
                close()
            continue
        if tag in BLOCK_TAGS:
            close()
        if token[2]:
            place = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == tag), None)
            if tag == "a":
                state["link"] = 0
            if tag[0] == "h" and tag[1:].isdigit():
                state["heading"] = False
            if place is not None:
                for _, kind in open_[place:]:
                    depth[kind] -= 1
                del open_[place:]
        else:
            if tag == "a":
                state["link"] = 1
            elif tag in BLOCK_TAGS:
                state["link"] = state["link"] if any(x == "a" for x, _ in open_) else 0
            if tag[0] == "h" and tag[1:].isdigit():
                state["heading"] = True
            if tag in VOID_TAGS or token[4].endswith("/"):
                continue
            if tag in ("p", "li", "a") and open_ and open_[-1][0] == tag:  # its end tag may be left out
                depth[open_.pop()[1]] -= 1
            kind = _kind(tag, token[4], depth["article"] > 0)
            open_.append((tag, kind))
            depth[kind] += 1
    add(html[at:])
    close()
    return blocks


FEATURES = ("words", "linked", "words_before", "linked_before", "words_behind", "linked_behind", "heading", "article", "beside")
_NONE = {"words": 0, "linked": 0.0}


def features(blocks: list[dict]) -> list[tuple[float, ...]]:
    out = []
    for i, b in enumerate(blocks):
        before = blocks[i - 1] if i else _NONE
        behind = blocks[i + 1] if i + 1 < len(blocks) else _NONE
        out.append(
            (b["words"], b["linked"], before["words"], before["linked"], behind["words"], behind["linked"],
             float(b["heading"]), float(b["article"]), float(b["beside"]))
        )
    return out


_LONG = "The council voted on Tuesday to repair the old bridge before winter, after years of talk about its cost and its use. "
_MID = "Work will begin in May and take about ten weeks. "

#: Labelled pages: a block that starts with + belongs to the article, one with - does not.
LABELLED = (
    f"""<body><header>-City News</header><nav><ul><li><a>-Home</a><li><a>-Politics</a><li><a>-Sport</a></ul></nav>
    <div class="ad">-Buy two pairs of shoes and get the third for nothing, only this week in all our shops.</div>
    <article><h1>+Bridge to be repaired</h1><p>+{_LONG}{_LONG}</p><p>+Yes.</p><p>+{_MID}<a>read the plan</a></p>
    <ul><li>+New railings</li><li>+Wider path</li></ul><p>+{_LONG}</p></article>
    <aside><h3>-Most read</h3><p>-{_MID}</p></aside>
    <section id="comments"><p>-{_LONG}</p><p>-I do not agree at all.</p></section><footer>-All rights reserved. {_MID}</footer>""",
    f"""<body><div><a>-Start</a> <a>about us</a> <a>contact</a></div><div><h1>+A garden in March</h1><p>+{_LONG}{_MID}</p>
    <p>+{_LONG}{_LONG}{_MID}</p><p>+Then it rained.</p><p>+{_LONG}<a>seeds</a></p></div>
    <div><a>-Older posts</a> <a>newer posts</a></div><div>-Powered by a blog engine</div>""",
    f"""<body><div id="cookie-notice">-{_LONG}<a>Agree</a></div><main><h1>+How bread is made</h1><h2>+Flour</h2>
    <p>+{_MID}</p><p>+Salt too.</p><blockquote>+{_MID}</blockquote><table><tr><td>+Rye</td><td>+40 minutes</td></tr></table>
    <ul><li><a>-More about yeast</a></li><li><a>-Ten ovens compared</a></li><li><a>-Our shop</a></li></ul></main>
    <form>-Your name {_MID}</form><footer><p>-Imprint</p><p>-{_LONG}</p></footer>""",
    f"""<body><ul><li><a>-News</a></li><li><a>-Weather</a></li></ul><div>-12 March</div><h1>+Storm over the coast</h1>
    <div>+{_LONG}{_LONG}</div><div>+{_MID}{_MID}</div><div>+{_LONG}</div><ul><li><a>-Share this</a></li><li><a>-Print</a></li></ul>
    <div>-Call us any day</div><div><a>-Privacy</a></div>""",
    f"""<body><article><h1>+Short note</h1><p>+Closed today.</p></article><div class="sidebar"><p>-{_LONG}</p><p>-{_LONG}</p></div>
    <footer>-Example house</footer>""",
    f"""<body><nav><a>-One</a></nav><article><header><h1>+On rivers</h1></header><p>+{_LONG} <a>a map of all the rivers</a> {_MID}</p>
    <p>+<a>Springs</a> come first.</p><div class="related"><a>-On lakes</a></div><div class="share">-Tell your friends about it</div>
    <p>+{_MID}</p><ol class="comments"><li>-{_LONG}{_MID}</li><li>-Thanks!</li></ol></article>""",
    f"""<body><div class="menu"><a>-A</a></div><p>+{_LONG}{_LONG}</p><p>+{_MID}</p><p>+{_LONG}{_MID}</p><p>-Terms of use</p>""",
    "<article>+One line only</article>",
    f"<article><h1>+News</h1><p>+{_LONG}</p></article>",
    "<div>-12 May</div><article><h2>+Lost</h2><p>+A cat.</p><p>+Grey.</p></article><div>-Page 3</div>",
    f"<main><p>+Hello.</p><p>+{_MID}</p><p>+Bye.</p></main>",
    f"<div>-Welcome back</div><div>-You have no messages</div><article><p>+{_LONG}</p><p>+End.</p></article><div>-Build 17</div>",
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2):
    """A decision tree by Gini impurity: a label, or (feature, bound, tree up to it, tree above it)."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return bool(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= bound
            n, k = left.sum(), y[left].sum()
            m, j = len(y) - n, y.sum() - k
            if min(n, m) < least:
                continue
            impurity = k * (1 - k / n) + j * (1 - j / m)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(bound), left)
    if best is None or best[0] > len(y) * share * (1 - share) - 1e-9:
        return bool(share >= 0.5)
    _, f, bound, left = best
    return f, bound, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def labelled_rows(pages: tuple[str, ...] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of labelled pages."""
    rows, labels = [], []
    for page in pages:
        blocks = page_blocks(page)
        rows += features(blocks)
        labels += [b["text"][0] == "+" for b in blocks]
    return np.array(rows, float), np.array(labels)


@cache
def default_tree():
    return grow(*labelled_rows())


def decide(tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        f, bound, low, high = tree
        tree = low if row[f] <= bound else high
    return tree


def main_text(html: str | None, tree=None) -> str:
    tree = default_tree() if tree is None else tree
    blocks = page_blocks(html or "")
    return "\n".join(b["text"] for b, row in zip(blocks, features(blocks), strict=True) if decide(tree, row))


def _extract(batches: Iterator[pa.RecordBatch], tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py(), tree) for x in batch.column("_html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["_row", "text", "n_chars"],
        )


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None, tree=None) -> DataFrame:
    """One row per page: the columns to ``carry`` as ``_row``, the main text, and its code points."""
    tree = default_tree() if tree is None else tree
    row = F.struct(*[F.col(c) for c in ([c for c in pages.columns if c != html] if carry is None else carry)])
    slim = pages.select(row.alias("_row"), F.col(html).alias("_html"))
    schema = f"_row {slim.schema['_row'].dataType.simpleString()}, text string, n_chars long"
    return slim.mapInArrow(lambda b: _extract(b, tree), schema)
