"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass labels each block from its length, its
share of stop words, its share of linked characters and the containers it lies in.  Blocks that stay
ambiguous (short ones, or ones with few stop words) take, in a second pass, the label of the nearest decided
neighbours.  Stop words alone condemn no block: on a page without an article or main element a long block with few
links outside boilerplate containers goes only between two blocks of links on a page that has prose with stop words.

Defined results: a null or empty page gives an empty text; unclosed tags, comments and scripts end with
the page; repeated rows give repeated rows; an empty table gives an empty result; other columns of the
table are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be been but by can for from had has have he her his how i if in into is it its more "
    "no not of on one or our out she so some than that the their them then there these they this to was we were what when which who "
    "will with would you your "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses "
    "son sont sur un une vous "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im ist ja mit nach "
    "nicht noch oder sich sie sind so um und von vor war wenn wie wir zu zum zur "
    "al como con de del el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se si sin "
    "sobre su sus también un una y ya".split()
)

# Elements that end the block before them, that hold no prose, and that never have content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
RAW_TAGS = frozenset("script style title textarea iframe noscript noembed noframes xmp template svg math object select button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())

# Words of class and id names that mark boilerplate; the second set does not count on an article or its frame.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification newsletter subscribe subscription signup comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended recommendations popup modal overlay outbrain taboola copyright disclaimer hidden".split()
)
FRAME_NAMES = frozenset(
    "sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar widget widgets "
    "pagination pager login search skip".split()
)

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_HIGH = 0.32
MAX_LINKS = 0.2
BAD, AMBIGUOUS_SHORT, AMBIGUOUS_TEXT, GOOD = 0, 1, 2, 3

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"\w+")


def _marks(tag: str, attributes: str, trusted: bool) -> bool:
    """Whether the names, role or style of an element mark it as boilerplate."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c in _NAMES.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key == "role" and value.lower() in BAD_ROLES:
            return True
        if key in ("class", "id") and tag not in ("html", "body"):
            parts = {p.lower() for p in _PARTS.findall(value)}
            if parts & BAD_NAMES or tag not in ("article", "main") and not trusted and parts & FRAME_NAMES:
                return True
    return False


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("bad", "frame", "links", "text")

    def __init__(self, text: str, links: int, bad: bool, frame: int):
        self.text, self.links, self.bad, self.frame = text, links, bad, frame


def split_blocks(page: str) -> list[Block]:
    """Non-empty blocks in page order; ``frame`` numbers the article or main element around a block (0: none)."""
    blocks: list[Block] = []
    stack: list[tuple[str, bool, int]] = []  # open containers: tag, boilerplate, frame
    bad, frame, frames, linked = False, 0, 0, False
    pieces: list[str] = []
    link_pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, len(" ".join("".join(link_pieces).split())), bad, frame))
            pieces.clear()
            link_pieces.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            run = page[at:stop]
            if "&" in run:
                run = html.unescape(run)
            pieces.append(run)
            if linked:
                link_pieces.append(run)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), (m[1] or m[4]) == "/"
        if tag in RAW_TAGS and not closing:
            if tag not in ("title", "svg", "math"):
                pieces.append(" ")
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "head":
            continue
        if tag == "a":
            linked = not closing
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                flush()
                del stack[depth:]
                _, bad, frame = stack[-1] if stack else ("", False, 0)
            continue
        if tag in VOID_TAGS:
            continue
        if block and stack and stack[-1][0] == "p":
            stack.pop()
            _, bad, frame = stack[-1] if stack else ("", False, 0)
        marked = tag in BAD_TAGS or tag == "header" and not frame or _marks(tag, m[3] or m[6] or "", frame > 0)
        opens_frame = tag in ("article", "main") and not marked
        if block and (tag in ("div", "section", "ul", "ol", "table", "header") or marked or opens_frame) or marked:
            flush()
            bad = bad or marked
            if opens_frame and not frame:
                frames += 1
                frame = frames
            stack.append((tag, bad, frame))
    flush()
    return blocks


def first_pass(block: Block) -> int:
    """Label of a block on its own."""
    n = len(block.text)
    if block.bad or block.links > MAX_LINKS * n and not (block.frame and block.links < 0.5 * n):
        return BAD
    words = _WORD.findall(block.text.lower())
    share = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if n < LENGTH_LOW:
        return AMBIGUOUS_SHORT
    if share >= STOP_HIGH:
        return GOOD if n > LENGTH_HIGH else AMBIGUOUS_TEXT
    return AMBIGUOUS_TEXT  # words alone don't condemn a block


def _decide_long(blocks: list[Block], labels: list[int]) -> list[int]:
    """Labels with the long ambiguous blocks decided: bad only between two blocks of links, and only where the page has good ones."""
    if GOOD not in labels:
        return [GOOD if label == AMBIGUOUS_TEXT else label for label in labels]
    decided = [i for i, label in enumerate(labels) if label == GOOD or label == BAD and not blocks[i].bad]
    out, k = list(labels), 0
    for i, label in enumerate(labels):
        while k < len(decided) and decided[k] < i:
            k += 1
        if label == AMBIGUOUS_TEXT:
            between = 0 < k < len(decided) and labels[decided[k - 1]] == labels[decided[k]] == BAD
            out[i] = BAD if between else GOOD
    return out


def second_pass(blocks: list[Block], labels: list[int]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided neighbours of the same frame.

    If the two sides disagree, the nearer side wins, and at equal distance a text with stop words stays.
    The ends of a frame count as decided for it, so a block of a frame goes only between two bad ones.
    On a page without frames the long ambiguous blocks are decided first, in the same way, and then count for the short ones.
    """
    n = len(blocks)
    if not any(b.frame for b in blocks):
        labels = _decide_long(blocks, labels)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    for order, found in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            frame = blocks[i].frame
            found[i] = last.get(frame)
            if labels[i] in (GOOD, BAD) and not (frame and blocks[i].bad):
                last[frame] = i
    keep = []
    for i, label in enumerate(labels):
        if label in (GOOD, BAD):
            keep.append(label == GOOD)
            continue
        p, q = before[i], after[i]
        if blocks[i].frame:
            keep.append(p is None or q is None or GOOD in (labels[p], labels[q]))
            continue
        if p is None and q is None:
            keep.append(label == AMBIGUOUS_TEXT)
        elif p is None or q is None:
            keep.append(labels[q if p is None else p] == GOOD)
        elif labels[p] == labels[q]:
            keep.append(labels[p] == GOOD)
        elif i - p != q - i:
            keep.append(labels[p if i - p < q - i else q] == GOOD)
        else:
            keep.append(label == AMBIGUOUS_TEXT)
    return keep


def main_text(page: str | None) -> str:
    """Blocks that both passes keep, joined by line ends."""
    blocks = split_blocks(page or "")
    keep = second_pass(blocks, [first_pass(b) for b in blocks])
    return "\n".join(b.text for b, kept in zip(blocks, keep, strict=True) if kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, main text and its number of code points.  A narrow pass; nothing is shuffled."""
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["page_id", "url"]].assign(text=[main_text(h if isinstance(h, str) else None) for h in batch["html"]])

    kinds = dict(base.dtypes)
    out = base.mapInPandas(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
