"""Main text of web pages by two passes of rules over blocks.

The first pass decides blocks by their length, their share of stop words and of link text, and leaves out menus, forms and other
margin parts. In the second, blocks too short or with too few stop words to decide take the label of their nearest decided
neighbours, in page order. Article and main elements decide nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .rules import STOP_WORDS

SHORT, LONG = 60, 200  # characters
STOPS_LOW, STOPS_HIGH = 0.05, 0.15
LINKS_FEW, LINKS_MANY = 0.2, 0.5
STOPS = frozenset(STOP_WORDS)
GOOD, BAD, OPEN = 1, 0, -1

# Kinds of HTML elements.
UNSEEN = "script style noscript template head title svg math iframe object canvas video audio"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
MARGIN = frozenset("nav footer aside form button select option textarea label fieldset menu dialog".split())
BODY = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class, id and role that name what is not the article.
MARGIN_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside complementary contentinfo ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion "
    "cookie cookies consent gdpr notice notices alert banner popup modal overlay dialog newsletter subscribe subscription signup login signin paywall comment comments commentlist reply replies respond disqus "
    "discussion share sharing social related recommended recommendations widget pagination pager search toolbar topbar masthead tags tagcloud form".split())
HEADER_WORDS = frozenset("header masthead".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({UNSEEN.replace(' ', '|')})(?=[\s/>])(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(\bhidden\b)""", re.I)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    margin: bool
    inside: bool  # of an article or main element
    heading: bool


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether attributes name a margin part, and whether they name a header."""
    margin = header = False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = (m[1] or "hidden").lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            margin = True
        elif key in ("class", "id", "role"):
            words = set(re.split(r"[^a-z0-9]+", value))
            margin |= bool(words & MARGIN_WORDS)
            header |= bool(words & HEADER_WORDS)
    return margin, header


def blocks(html: str) -> list[Block]:
    """Text between block-level tags, in page order, with white space made single."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, margin, body
    pieces: list[str] = []
    margin = inside = links = linked = 0
    heading = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, linked, margin > 0, inside > 0, heading))
            pieces.clear()
        linked = 0

    def add(data: str) -> None:
        nonlocal linked
        if data:
            text = unescape(data) if "&" in data else data
            pieces.append(text)
            if links:
                linked += len("".join(text.split()))

    def pop() -> None:
        nonlocal margin, inside, links
        tag, m, b = stack.pop()
        margin, inside, links = margin - m, inside - b, links - (tag == "a")

    at = 0
    for token in TOKEN.finditer(html):
        add(html[at:token.start()])
        at = token.end()
        if token[0].startswith("<![CDATA["):
            add(token[0][9:].removesuffix("]]>"))
        if token[3] is None:
            continue
        tag, closing = token[3].lower(), bool(token[2])
        if tag not in INLINE:
            flush()
            heading = tag in HEADING and not closing
            if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                pop()
        if closing:
            places = [i for i, s in enumerate(stack) if s[0] == tag]
            if places and tag in INLINE:  # as far as no block stands in between
                if all(s[0] in INLINE for s in stack[places[-1]:]):
                    while len(stack) > places[-1]:
                        pop()
            elif places:
                while len(stack) > places[-1]:
                    pop()
        elif tag not in VOID and not token[4].rstrip().endswith("/"):
            named, header = _marked(token[4]) if token[4] else (False, False)
            if tag == "a" and links:
                while stack and links:
                    pop()
            part = tag in MARGIN or named or (tag == "header" or header) and not inside
            body = tag in BODY
            if part and tag in INLINE and tag != "a":
                pieces.append(" ")
            if part or body or tag not in INLINE or tag == "a":
                stack.append((tag, part, body))
                margin, inside, links = margin + part, inside + body, links + (tag == "a")
    add(html[at:])
    flush()
    return out


def measures(block: Block) -> tuple[int, float, float]:
    """Characters, share of them in links, and share of stop words."""
    n = len("".join(block.text.split()))
    words = LETTERS.findall(block.text.lower())
    return n, block.linked / n, sum(w in STOPS for w in words) / max(1, len(words))


def first_pass(block: Block) -> int:
    """GOOD, BAD or OPEN by margin part, length, links and stop words."""
    n, links, stops = measures(block)
    if block.margin or links > LINKS_MANY:
        return BAD
    if n < SHORT:
        return BAD if links > LINKS_FEW else OPEN
    if stops >= STOPS_HIGH or n >= LONG and stops >= STOPS_LOW:
        return GOOD
    return OPEN if links <= LINKS_FEW else BAD


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Each open block takes the label of its nearest decided neighbours among the blocks outside margin parts.

    Where they differ, headings look ahead, and others take the nearer one, or the good one of two as near. Without any decided
    neighbour an open block is all there is of an article, and good.
    """
    flow = [i for i, b in enumerate(found) if not b.margin]
    out = list(labels)
    before: list[tuple[int, int] | None] = []
    last = None
    for k, i in enumerate(flow):
        before.append(last)
        last = (labels[i], k) if labels[i] != OPEN else last
    last = None
    for k in range(len(flow) - 1, -1, -1):
        i = flow[k]
        if labels[i] != OPEN:
            last = (labels[i], k)
            continue
        near = [x for x in (before[k], last) if x is not None]
        if found[i].heading and last is not None:
            out[i] = last[0]
        else:
            out[i] = min(near, key=lambda x: (abs(x[1] - k), x[0] != GOOD))[0] if near else GOOD
    return out


def extract(html: str | None) -> str:
    """The main text; empty if there is none. Null is an empty page."""
    if not html:
        return ""
    found = blocks(html)
    labels = second_pass(found, [first_pass(b) for b in found])
    return " ".join(b.text for b, x in zip(found, labels) if x == GOOD)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each row of ``pages``.

    Null and empty html give an empty text. Pages are read whole. Repeated rows, null ids and urls stay as they are; other columns are ignored; an empty table gives an empty one.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h).encode("utf-8", "replace").decode() for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run, "page_id long, url string, text string, n_chars long")
