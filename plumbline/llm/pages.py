"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels a block by where it stands, its share of
stop words, its length and the share of it that is link text; what it can't tell stays open: short blocks,
headings, and texts with few stop words. In the second pass an open block takes the label of the nearest decided
one, a heading that of the next one below it; what lies as near to text as to furniture is furniture.

Where a block stands: navigation, footers, asides, forms and elements whose class, id or role says menu,
sidebar, notice, advert, comments and the like are furniture, as is what a page hides. If a page marks its article,
blocks outside it are furniture and blocks inside take labels from each other only, so menus around it
can't pull its ends down. An article within something that isn't closed is still an article, but not one in
comments, sidebars or related links. An article in which nothing could be decided is text.

Blocks are the text between block-level tags with character references decoded and runs of white space as one
space; a single line break is white space. Comments, declarations, scripts, styles, controls and embedded objects
have no text. Null, empty and broken pages never fail: an unclosed tag ends with the page, an unclosed comment
or script hides the rest. Pages without main text give an empty text. Rows are read one by one: repeated rows come out
as often as they occur, null addresses stay null, other columns are not read. No length is limited.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words of the languages that the pages are expected in.
STOP_WORDS = frozenset(
    # English
    "a an and are as at be been but by can do for from had has have he her his i if in into is it its more no not of on or our "
    "out she so than that the their them then there these they this to up was we were what when which who will with would you your "
    # German
    "aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist "
    "kann mit nach nicht noch nur oder sein sich sie sind über um und uns vom von vor war was wenn wie wird wir zu zum zur "
    # French
    "ai au aux avec ce ces cette dans de des du elle en est et été eux il ils je la le les leur lui mais me même ne nos notre nous on "
    "ont ou par pas plus pour que qui sa se ses son sont sur un une vous y à où "
    # Spanish
    "al como con cuando del desde el ella ellos era eran ese esta este esto fue ha hay la las lo los más muy ni nos o para pero por "
    "porque que se sin sobre su sus también tan un una unos y ya".split()
)

# Characters below which a block is short, and from which on one with many stop words is text.
SHORT, LONG = 70, 200
# Shares of stop words of texts, and of possible texts.
MANY, SOME = 0.25, 0.12
# Share of link text above which a block is furniture.
LINKED, LINKED_INSIDE = 0.2, 0.5

_BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
# Elements that may hold blocks: what closes them is looked up among those open.
_CONTAINERS = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form header html main menu nav ol search "
    "section table ul".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_NO_TEXT = frozenset(
    "applet audio button canvas datalist embed head iframe math noembed noframes noscript object option script select style svg "
    "template textarea title video xmp".split()
)
# Of those, the ones whose content is never markup.
_RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "search"))
# Words of a class, id or role. An article inside elements with the latter is no main text either.
_FURNITURE = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising adbox banner sponsor sponsors sponsored promo promos promotion "
    "promotions cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer warning popup modal overlay "
    "header masthead topbar toolbar footer copyright legal imprint login signin signup register search searchbox newsletter subscribe "
    "subscription pagination pager skip contentinfo complementary widget widgets".split()
)
_FURNITURE_STRICT = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars comment comments commentlist respond reply replies disqus "
    "discussion reactions related recommended recommendations share sharing social".split()
)

# Words that say article only together: "entry-content", "post-body".
_ARTICLE_KINDS = frozenset(("post", "entry", "story", "main"))
_ARTICLE_PARTS = frozenset(("content", "body", "text"))

_MARKUP = re.compile(
    r"<!--(?P<hidden>.*?)(?:--!?>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[a-zA-Z/!?][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_EDGES = ".,;:!?\"'()[]«»„“”‚‘’–-…|"

OUTSIDE, INSIDE, FURNITURE = 0, 1, 2


class Block(NamedTuple):
    text: str
    linked: int  # characters of it in links, without white space
    place: int  # OUTSIDE, INSIDE an article, or FURNITURE
    article: int  # which article it is in, 0 for none
    heading: bool
    listed: bool


class _Open(NamedTuple):
    name: str
    place: int
    strict: bool
    article: int


def _marked(name: str, rest: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes say furniture, strictly furniture, and article."""
    words: list[str] = []
    hidden = article = False
    for m in _ATTRIBUTE.finditer(rest):
        key = m[1].lower()
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        if key in ("class", "id", "role"):
            for part in value.split():
                split = [w.lower() for w in _NAME_PART.findall(part)]
                # "with-sidebar" says what stands beside the element
                words += [w for w, before in zip(split, ["", *split]) if before not in ("with", "has", "no", "without")]
                named = set(split)
                article |= "article" in named or bool(named & _ARTICLE_KINDS and named & _ARTICLE_PARTS) or key == "role" and part == "main"
        elif key == "itemprop":
            article |= value == "articleBody"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDING.search(value):
            hidden = True
    if name in ("html", "body"):
        return hidden, False, False
    strict = hidden or any(w in _FURNITURE_STRICT for w in words)
    return strict or any(w in _FURNITURE for w in words), strict, article


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in order."""
    found: list[Block] = []
    opened: list[_Open] = [_Open("", OUTSIDE, False, 0)]
    texts: list[str] = []
    linked, link_depth, articles, list_item = 0, False, 0, False
    heading, breaks, skip = False, 0, ""
    at, depth = 0, 0

    def flush():
        nonlocal texts, linked, breaks
        text = " ".join("".join(texts).split())
        if text:
            here = opened[-1]
            found.append(Block(text, linked, here.place, here.article, heading, list_item))
        texts, linked, breaks = [], 0, 0

    def add(piece: str):
        nonlocal linked
        if skip or not piece:
            return
        piece = html.unescape(piece)
        texts.append(piece)
        if link_depth:
            linked += sum(map(len, piece.split()))

    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing = bool(m["end"] or m["end2"])
        rest = m["rest"] or m["rest2"] or ""
        if skip:  # inside an element without text
            if name == skip:
                depth += -1 if closing else 0 if rest.endswith("/") else 1
                if depth == 0:
                    skip = ""
            continue
        if name in _NO_TEXT:
            if closing:
                continue
            if name in _BLOCK_TAGS:
                flush()
            if name == "head":  # its texts are in elements of their own
                continue
            if rest.endswith("/") and name not in _RAW or name in _VOID:
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if name in _RAW:
                at = len(page) if end is None else end.start()
            elif end is not None:  # one that is never closed hides nothing
                skip, depth = name, 1
            continue
        if name == "br":
            breaks += 1
            texts.append(" ")
            continue
        if name == "a":
            link_depth = not closing
            continue
        if name not in _BLOCK_TAGS:
            continue
        flush()
        link_depth = False
        if name in _HEADINGS:
            heading = not closing
        elif name in ("li", "dt", "dd", "option"):
            list_item = not closing
        else:
            heading = False
            if name != "p":
                list_item = False
        if name not in _CONTAINERS:
            continue
        if closing:
            for i in range(len(opened) - 1, 0, -1):
                if opened[i].name == name:
                    del opened[i:]
                    break
            continue
        above = opened[-1]
        furniture, strict, marked = _marked(name, rest)
        tag_furniture = name in _FURNITURE_TAGS or name == "header" and above.place != INSIDE
        if above.place == INSIDE and name in ("header", "article") and not strict:
            furniture = False  # the article's own head
        if (name in ("article", "main") or marked) and name not in _FURNITURE_TAGS and not furniture and not above.strict:
            if above.place != INSIDE:
                articles += 1
            here = _Open(name, INSIDE, False, above.article if above.place == INSIDE else articles)
        elif furniture or tag_furniture or above.place == FURNITURE:
            here = _Open(name, FURNITURE, above.strict or strict or name == "aside", above.article)
        else:
            here = _Open(name, above.place, above.strict, above.article)
        opened.append(here)
    flush()
    return found


TEXT, NO_TEXT, OPEN = 1, 0, 2


def first_pass(block: Block, has_article: bool) -> int:
    """TEXT, NO_TEXT or OPEN, from the block alone."""
    if block.place == FURNITURE or has_article and block.place == OUTSIDE:
        return NO_TEXT
    letters = len(block.text) - block.text.count(" ")
    linked = block.linked / letters
    words = block.text.lower().split()
    stops = sum(w.strip(_EDGES) in STOP_WORDS for w in words) / len(words)
    if block.place == INSIDE:
        if linked > LINKED_INSIDE:
            return NO_TEXT if block.listed else OPEN
        return TEXT if len(block.text) >= SHORT and stops >= SOME and not block.heading else OPEN
    if linked > LINKED or "©" in block.text:
        return NO_TEXT
    if block.heading or len(block.text) < SHORT:
        return NO_TEXT if block.linked and not block.heading else OPEN
    if stops >= MANY or stops >= SOME and len(block.text) >= LONG:
        return TEXT
    return OPEN if stops >= SOME else NO_TEXT


def second_pass(found: list[Block], labels: list[int]) -> list[int]:
    """Labels without open ones: each takes that of the nearest decided block of its article."""
    n = len(found)
    before: list[tuple[int, int]] = []  # (distance, label) of the last decided block
    last: dict[int, tuple[int, int]] = {}
    for i, (block, label) in enumerate(zip(found, labels)):
        if label != OPEN and (block.place != FURNITURE or not block.article):
            last[block.article] = (i, label)
        j, known = last.get(block.article, (-n, OPEN))
        before.append((i - j, known))
    settled = labels[:]
    following: dict[int, tuple[int, int]] = {}
    for i in range(n - 1, -1, -1):
        block, label = found[i], labels[i]
        if label != OPEN:
            if block.place != FURNITURE or not block.article:
                following[block.article] = (i, label)
            continue
        (back, earlier), (j, later) = before[i], following.get(block.article, (2 * n, OPEN))
        ahead = j - i
        if earlier == OPEN and later == OPEN:
            settled[i] = TEXT if block.place == INSIDE else NO_TEXT
        elif earlier == OPEN or later == OPEN or earlier == later:
            settled[i] = later if earlier == OPEN else earlier
        elif block.heading:
            settled[i] = later
        else:
            settled[i] = NO_TEXT if back == ahead else earlier if back < ahead else later
    return settled


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text of a page, how many blocks it has and how many of them are text."""
    found = blocks(page or "")
    has_article = any(b.place == INSIDE for b in found)
    labels = second_pass(found, [first_pass(b, has_article) for b in found])
    kept = [b.text for b, label in zip(found, labels) if label == TEXT]
    return "\n\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, n_blocks, n_text_blocks) of every page. No shuffle: a task reads its own pages."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    added = [("text", T.StringType()), ("n_chars", T.LongType()), ("n_blocks", T.LongType()), ("n_text_blocks", T.LongType())]
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(name, kind) for name, kind in added)])

    def task(batches):
        for batch in batches:
            found = [main_text(page) for page in batch.column("html").to_pylist()]
            texts, seen, kept = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array(seen, pa.int64()),
                    pa.array(kept, pa.int64()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(task, schema).withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
