"""Main text of web pages: flat blocks, classified by a small decision tree.

A page is read as a flat list of text blocks: block-level tags end one block and begin the next; scripts,
styles, comments and other unshown elements give none. Every block has its words, its link density, those
of its neighbours, and whether it stands in an article, in page furniture, or in something that names
itself so. A decision tree grown from the labelled table below decides which blocks are main text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.llm.rows import over_texts

# Elements by their role.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
UNSHOWN = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form menu button select dialog option label".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("body head html option optgroup".split())
# Parts of class, id and role names.
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|"
    r"side\w*|aside|widget\w*|related|recommend\w*|share|sharing|social|comments?|commentlist|replies|reply|respond|discuss\w*|"
    r"disqus\w*|reactions?|cookies?|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscri\w*|signup|login|form|search\w*|"
    r"pagination|pager|tags?|legal|copyright|disclaimer|toolbar|complementary|contentinfo|navigation|dialog)(?=$|[\s_-])",
    re.I,
)
GOOD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|hentry|articlebody)(?=$|[\s_-])", re.I
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*>|<[A-Za-z/!?][^>]*\Z|[^<]+|<", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Names that tell what a page has or lacks, and headers, which an article may have.
MODIFIERS = re.compile(r"(?<![\w-])(?:has|no|with|without)[_-]\S+", re.I)
HEADERS = re.compile(r"(?<![A-Za-z0-9])header(?![A-Za-z0-9])", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "heading")
# Labelled blocks. Words and link density of the block, of the one before and of the one after;
# in an article; in page furniture; a heading; and whether it is main text.
LABELLED = (
    # paragraphs, headings and list items of articles
    (80, 0.0, 60, 0.0, 75, 0.0, 1, 0, 0, 1), (120, 0.02, 9, 0.0, 90, 0.0, 1, 0, 0, 1), (2, 0.0, 70, 0.0, 55, 0.0, 1, 0, 0, 1),
    (1, 0.0, 1, 0.0, 30, 0.0, 1, 0, 0, 1), (8, 0.0, 12, 0.0, 60, 0.0, 1, 0, 1, 1), (5, 0.0, 0, 0.0, 3, 0.0, 1, 0, 1, 1),
    (14, 0.5, 40, 0.0, 35, 0.0, 1, 0, 0, 1), (6, 1.0, 50, 0.0, 60, 0.0, 1, 0, 0, 1), (3, 1.0, 2, 1.0, 40, 0.0, 1, 0, 0, 1),
    (40, 0.1, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (300, 0.0, 20, 0.0, 4, 1.0, 1, 0, 0, 1),
    (5, 0.0, 2, 0.0, 2, 0.5, 1, 0, 0, 1), (4, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 1), (2, 0.5, 5, 0.0, 2, 0.0, 1, 0, 0, 1),
    (9, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1), (2, 1.0, 9, 0.0, 7, 0.0, 1, 0, 0, 1), (3, 0.0, 2, 0.0, 12, 0.0, 1, 0, 0, 1),
    (20, 0.8, 25, 0.9, 15, 0.7, 1, 0, 0, 1), (60, 0.9, 30, 0.0, 45, 0.0, 1, 0, 0, 1), (2, 0.0, 1, 1.0, 6, 0.0, 1, 0, 1, 1),
    (3, 0.0, 4, 0.0, 0, 0.0, 1, 0, 1, 1), (7, 0.0, 0, 0.0, 1, 1.0, 1, 0, 0, 1), (16, 0.3, 2, 0.0, 4, 0.0, 1, 0, 0, 1),
    # furniture inside and outside of articles
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0), (12, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0),
    (45, 0.0, 30, 0.0, 20, 0.0, 0, 1, 0, 0), (60, 0.1, 5, 0.0, 2, 1.0, 0, 1, 0, 0), (10, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0, 0),
    (4, 0.0, 1, 1.0, 9, 0.0, 0, 1, 1, 0), (30, 0.0, 90, 0.0, 4, 0.0, 1, 1, 0, 0), (6, 0.5, 70, 0.0, 60, 0.0, 1, 1, 0, 0),
    (120, 0.0, 5, 0.0, 100, 0.0, 0, 1, 0, 0), (25, 0.0, 3, 0.0, 25, 0.0, 1, 1, 0, 0), (2, 0.0, 40, 0.0, 30, 0.0, 1, 1, 1, 0),
    (70, 0.0, 80, 0.0, 75, 0.0, 0, 1, 0, 0), (18, 0.0, 60, 0.0, 70, 0.0, 1, 1, 0, 0), (90, 0.0, 12, 0.0, 60, 0.0, 1, 1, 0, 0),
    (8, 0.0, 60, 0.0, 5, 0.0, 0, 1, 1, 0), (50, 0.0, 7, 0.0, 7, 0.0, 0, 1, 0, 0), (14, 0.1, 14, 0.0, 0, 0.0, 0, 1, 0, 0),
    # pages without an article element: running text with neighbours like it, and its headings
    (60, 0.0, 70, 0.0, 65, 0.0, 0, 0, 0, 1), (35, 0.0, 40, 0.0, 12, 0.0, 0, 0, 0, 1), (90, 0.05, 3, 1.0, 70, 0.0, 0, 0, 0, 1),
    (12, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0, 1), (4, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 1), (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1),
    (6, 0.0, 45, 0.0, 50, 0.0, 0, 0, 1, 1), (28, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 1), (150, 0.2, 3, 1.0, 3, 1.0, 0, 0, 0, 1),
    # and what stands between them: links, short lines, lone labels
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (5, 0.8, 2, 1.0, 60, 0.0, 0, 0, 0, 0), (20, 0.7, 10, 0.8, 15, 0.9, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0), (4, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0, 0), (6, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (3, 0.0, 2, 1.0, 3, 0.5, 0, 0, 1, 0), (60, 0.9, 70, 0.9, 50, 0.9, 0, 0, 0, 0),
    (1, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (2, 1.0, 50, 0.0, 3, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0),
    (4, 1.0, 70, 0.0, 80, 0.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 55, 0.0, 0, 0, 0, 0), (8, 0.6, 45, 0.0, 2, 1.0, 0, 0, 0, 0),
)


@dataclass
class Block:
    text: str
    linked: int
    article: bool
    furniture: bool
    heading: bool
    words: int = field(init=False)

    def __post_init__(self) -> None:
        self.words = len(self.text.split())

    @property
    def density(self) -> float:
        return min(1.0, self.linked / self.words)


@dataclass(eq=False)
class Mark:
    """An element that is furniture or an article, inside ``outer``, and what it turned out to hold."""

    outer: Mark | None
    bad: bool
    main: bool
    within: bool  # inside an article element
    words: int = 0  # unlinked ones, of the elements inside as well
    holds: bool = False  # the page's largest article
    furniture: bool = False  # it or one around it, as a whole

    any_bad: bool = False  # it or one around it
    in_within: bool = False  # one around it is inside an article element

    def __post_init__(self) -> None:
        self.any_bad = self.bad or (self.outer is not None and self.outer.any_bad)
        self.in_within = self.outer is not None and (self.outer.within or self.outer.in_within)


@dataclass(slots=True)
class Open:
    """An open element: what it makes of the text inside it."""

    tag: str = ""
    within: bool = False  # inside an article element
    article: bool = False
    hidden: bool = False
    heading: bool = False
    mark: Mark | None = None


def opened(tag: str, attributes: str, outer: Open) -> Open:
    """The element inside ``outer``. An article inside an article is a comment; the header of one is not furniture."""
    names = " ".join(value.strip("\"'") for value in NAMES.findall(attributes)) if attributes else ""
    inner = tag == "article" and outer.within
    bad = inner or (tag in FURNITURE and not (tag == "header" and outer.within))
    if names and tag not in ("html", "body", "main", "article"):
        said = MODIFIERS.sub(" ", names)
        bad = bad or BAD_NAMES.search(HEADERS.sub(" ", said) if outer.within else said) is not None
    main = tag in MAIN and not outer.within
    return Open(
        tag,
        outer.within or tag == "article",
        outer.article or tag in MAIN or bool(names and GOOD_NAMES.search(names)),
        outer.hidden or tag in UNSHOWN or bool(attributes and HIDDEN.search(attributes)),
        outer.heading or tag in HEADINGS,
        Mark(outer.mark, bad, main, outer.within) if bad or main else outer.mark,
    )


#: A piece of a block's text, whether it is linked, and the element it stands in.
Piece = tuple[str, bool, Open]


def shown(pieces: list[Piece]) -> str:
    return " ".join(html.unescape("".join(text for text, _, _ in pieces)).split())


def linked_words(pieces: list[Piece]) -> int:
    return len(html.unescape(" ".join(text for text, linked, _ in pieces if linked)).split())


def settle(found: list[list[Piece]], marks: list[Mark]) -> list[Block]:
    """The blocks, now that all of the page is known. An element that holds the page's largest article, or most
    of its unlinked words, is not furniture as a whole, unless it stands in an article. An article counts for this
    when it has more words than stand free of furniture, so comments below a text are none.

    Text of furniture inside a line, such as an advert or a label in a paragraph, is left out of the block; a block that is
    nothing else is furniture. Marks are in the order in which they were opened, so one pass each way adds up and passes down.
    """
    total = free = 0
    for pieces in found:
        by_mark: dict[int, tuple[Mark | None, list[Piece]]] = {}
        for piece in pieces:
            by_mark.setdefault(id(piece[2].mark), (piece[2].mark, []))[1].append(piece)
        for mark, own in by_mark.values():
            words = max(0, len(shown(own).split()) - linked_words(own))
            total += words
            if mark is not None:
                mark.words += words
            if mark is None or not mark.any_bad:
                free += words
    for mark in reversed(marks):
        if mark.outer is not None:
            mark.outer.words += mark.words
    largest = max((m for m in marks if m.main and not m.in_within), key=lambda m: m.words, default=None)
    above = largest.outer if largest is not None and largest.words > free else None
    while above is not None:
        above.holds, above = True, above.outer
    for m in marks:
        own = m.bad and (m.within or not (m.holds or 2 * m.words > total))
        m.furniture = own or (m.outer is not None and m.outer.furniture)

    blocks = []
    for pieces in found:
        kept = [p for p in pieces if p[2].mark is None or not p[2].mark.furniture]
        text = shown(kept)
        used, furniture = (kept, False) if text else (pieces, True)
        element = next(p[2] for p in used if html.unescape(p[0]).strip())
        blocks.append(Block(text or shown(pieces), linked_words(used), element.article, furniture, element.heading))
    return blocks


def blocks_of(page: str) -> list[Block]:
    """The flat text blocks of a page, in order. Time grows with the page's length alone, however deep its elements are."""
    found: list[list[Piece]] = []
    marks: list[Mark] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack
    borders: list[int] = []  # places of the open block elements
    pieces: list[Piece] = []
    outside = Open()
    links = 0

    def flush() -> None:
        nonlocal pieces
        if pieces:
            if shown(pieces):
                found.append(pieces)
            pieces = []

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            element = stack.pop()
            links -= element.tag == "a"
            places[element.tag].pop()
            if element.tag in BLOCKS:
                borders.pop()

    at, size = 0, len(page)
    while at < size:
        match = TOKEN.match(page, at)
        at = match.end()
        tag = match[2]
        here = stack[-1] if stack else outside
        if tag is None:
            token = match[0]
            if (token[0] != "<" or token == "<") and not here.hidden:
                pieces.append((token, links > 0, here))
            continue
        tag = tag.lower()
        if match[1]:
            opener = places.get(tag)
            if tag in BLOCKS:
                flush()
            if opener and (tag in BLOCKS or not (borders and borders[-1] > opener[-1])):
                close(opener[-1])
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append((" ", True, here))
            elif tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and borders and (stack[borders[-1]].tag == "p" or (tag == "li" and stack[borders[-1]].tag == "li")):
                close(borders[-1])
                here = stack[-1] if stack else outside
        element = opened(tag, match[3], here)
        if element.mark is not here.mark:
            marks.append(element.mark)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            borders.append(len(stack))
        stack.append(element)
        links += tag == "a"
        if match[3].endswith("/") and tag not in BLOCKS:
            close(len(stack) - 1)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            close(len(stack) - 1)
    flush()
    return settle(found, marks)


def feature_rows(blocks: list[Block]) -> list[tuple]:
    rows = []
    for i, b in enumerate(blocks):
        before = blocks[i - 1] if i else None
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        rows.append((
            b.words, b.density, before.words if before else 0, before.density if before else 0.0,
            after.words if after else 0, after.density if after else 0.0, int(b.article), int(b.furniture), int(b.heading),
        ))
    return rows


def impurity(labels: list[int]) -> float:
    share = sum(labels) / len(labels)
    return len(labels) * share * (1 - share)


def grow(rows: list[tuple], depth: int) -> tuple | int:
    """A decision tree over (features..., label): a label, or (feature, limit, tree up to the limit, tree above it)."""
    labels = [row[-1] for row in rows]
    if depth == 0 or len(set(labels)) == 1:
        return int(2 * sum(labels) >= len(labels))
    best = None
    for feature in range(len(rows[0]) - 1):
        values = sorted({row[feature] for row in rows})
        for low, high in zip(values, values[1:]):
            limit = (low + high) / 2
            left, right = [r[-1] for r in rows if r[feature] <= limit], [r[-1] for r in rows if r[feature] > limit]
            score = impurity(left) + impurity(right)
            if best is None or score < best[0] - 1e-12:
                best = score, feature, limit
    if best is None:
        return int(2 * sum(labels) >= len(labels))
    _, feature, limit = best
    return (
        feature, limit, grow([r for r in rows if r[feature] <= limit], depth - 1),
        grow([r for r in rows if r[feature] > limit], depth - 1),
    )


@lru_cache(maxsize=1)
def tree() -> tuple:
    return grow(list(LABELLED), 6)


def is_main(row: tuple, node: tuple | int) -> bool:
    while isinstance(node, tuple):
        feature, limit, low, high = node
        node = low if row[feature] <= limit else high
    return bool(node)


def main_blocks(page: str) -> list[str]:
    """Texts of the blocks classified as main text. A page with an article has it only there."""
    blocks = blocks_of(page)
    rows = feature_rows(blocks)
    wanted = [is_main(row, tree()) for row in rows]
    if any(keep and b.article for keep, b in zip(wanted, blocks)):
        wanted = [keep and b.article for keep, b in zip(wanted, blocks)]
    return [b.text for keep, b in zip(wanted, blocks) if keep]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Main text of every page: key, url, text (blocks joined by an empty line), n_chars and n_blocks.

    A null or empty page has an empty text. Every row gives one row, repeated and null keys too; an
    empty table gives no rows. Other columns are not read. Pages are read whole, however malformed.
    """

    def text_of(value: str) -> tuple:
        kept = main_blocks(value)
        text = "\n\n".join(kept)
        return text, len(text), len(kept)

    rows = pages.select(F.struct(key, url).alias("kept"), page)
    made = over_texts(rows, text_of, "text string, n_chars bigint, n_blocks bigint", "kept", page)
    return made.select(F.col("kept")[key].alias(key), F.col("kept")[url].alias(url), "text", "n_chars", "n_blocks")
