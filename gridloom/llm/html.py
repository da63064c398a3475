"""Main text of web pages by two passes of block rules (operator 8).

A page is cut into blocks at block-level tags. The first pass looks at each
block alone: where it stands, its length, its share of link text and of stop
words; it calls a block good, bad, nearly good or undecided. The second pass
gives the undecided ones the label of the nearest decided neighbours.

An article or main tag is a feature of the blocks in it and around it, on pages
where it holds as much prose as stands outside; elsewhere it is only a block.
Stop words tell nothing on a page in a language that is not listed; there the
length of a block takes their place. Short blocks that read as a copyright line or
an invitation to share are bad wherever they stand. On a page without any good
block, short sentences are the text, and so is a page without tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import small_batches

GOOD, BAD, NEAR, SHORT = "good", "bad", "near", "short"

SHORT_LENGTH, LONG_LENGTH = 70, 200
LINK_SHARE, ARTICLE_LINK_SHARE = 0.33, 0.8
STOP_LOW, STOP_HIGH = 0.2, 0.3
HEADING_REACH = 200

# Names of HTML elements.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE = frozenset("nav aside footer form button select fieldset dialog menu head".split())
CONTENT = frozenset("article main".split())
# Words that name parts of a page around its article in class, id and role.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies dialog disqus disclaimer footer form header login menu modal nav navbar navigation newsletter notice overlay paywall popup "
    "promo promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "widget".split())
# Words before the last one of a hyphenated class that say what a page has, not what the element is.
STATES = frozenset("has have with without no not is hide hides hidden show shows shown open opens above below before after under".split())
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on or our "
    "she so that the their they this to was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qui que se son sur un une vous "
    "aber als auch auf aus bei das dem den der die ein eine einen er es für ich ihr im ist mit nach nicht noch sich sie sind so über um und von "
    "war wie wird zu zum "
    "al como con del el ella esta este fue ha hay las lo los más no para pero por se si sin su sus también una y ya".split())
# How copyright lines and invitations to share begin, in the same languages.
NOTICE = re.compile(
    r"^(?:©|\(c\)|copyright\b(?=\W*(?:©|\(c\)|\d{4})))"
    r"|^(?:share (?:this|on|with|via)|tweet this|follow us|partage[rz] (?:cet|sur|cette)|suivez-nous|artikel teilen|folgen sie uns"
    r"|compart[ei]r? (?:en|este|esta)|síguenos)\b", re.IGNORECASE)
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)]*$")

TOKEN = re.compile(
    r"<(?:!--(?:.*?)(?:--!?>|\Z)|[!?][^>]*+(?:>|\Z)"
    r"|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|/?[a-zA-Z][^>]*+(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
NAME_PARTS = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
BLANKS = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    links: int
    heading: bool
    outside: bool
    #: The number of the outermost article or main around it, or 0.
    article: int
    #: The innermost element around it whose name says that it is a part around the article, or -1.
    part: int = -1
    label: str = SHORT
    words: int = 0
    stops: int = 0

    def count_words(self) -> None:
        if not self.outside and len(self.text) >= SHORT_LENGTH:
            words = self.text.lower().split()
            self.words, self.stops = len(words), sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words)

    @property
    def link_share(self) -> float:
        return self.links / len(self.text)

    @property
    def prose(self) -> int:
        """Characters outside links."""
        return max(0, len(self.text) - self.links)

    @property
    def notice(self) -> bool:
        """Whether it is a short copyright line or an invitation to share."""
        return len(self.text) < SHORT_LENGTH and not self.heading and bool(NOTICE.search(self.text))


@dataclass(frozen=True)
class Place:
    """Where the parser stands: inside boilerplate, an article, a link, a heading."""

    name: str
    outside: bool = False
    article: int = 0
    link: bool = False
    heading: bool = False
    part: int = -1

    def inside(self, name: str, attrs: str, number: int, parts: list[Part]) -> Place:
        article = self.article or (number if name in CONTENT else 0)
        outside = self.outside or name in BOILERPLATE or name == "header" and not self.article
        part = self.part
        if attrs and not outside and name not in ("html", "body"):
            outside = bool(HIDDEN.search(attrs))
            if not outside and names_a_part(attrs, self.article > 0):
                part = len(parts)
                parts.append(Part(self.part, self.article))
        return Place(name, outside, article, self.link or name == "a", self.heading or name in HEADINGS, part)


@dataclass
class Part:
    """An element whose name says that it is a part around the article; it may be wrong."""

    parent: int
    #: The article around it, or 0.
    article: int
    prose: int = 0
    #: Prose of the longest outermost article that it holds or is.
    longest: int = 0


def names_a_part(attrs: str, in_article: bool) -> bool:
    """Whether a class, id or role is one of ``PARTS`` or a compound of which such a word is the head (user-comments).

    Inside an article a header is the article's own, as the tag of that name is,
    unless its name holds another part (comment-header).
    """
    for _, *values in ATTRIBUTE.findall(attrs):
        for value in values:
            for token in value.split():
                words = [w for w in NAME_PARTS.split(CAMEL.sub(" ", token).lower()) if w]
                own = in_article and words[-1:] == ["header"] and PARTS.isdisjoint(words[:-1])
                if words and words[-1] in PARTS and STATES.isdisjoint(words[:-1]) and not own:
                    return True
    return False


def set_parts_apart(blocks: list[Block], parts: list[Part]) -> None:
    """Mark the blocks of named parts as outside, unless the rest of the page speaks against the name.

    An element that is or holds an article or main goes only if a longer article
    stands elsewhere; one with most of the page's text goes only if an article of
    a fourth of its length does, or any if it is itself below ``LONG_LENGTH``.
    """
    articles: dict[int, int] = {}
    whole = 0
    for block in blocks:
        if not block.outside:
            whole += block.prose
            if block.article:
                articles[block.article] = articles.get(block.article, 0) + block.prose
            if block.part >= 0:
                parts[block.part].prose += block.prose
    for block in blocks:
        if block.part >= 0 and not parts[block.part].article:
            parts[block.part].longest = max(parts[block.part].longest, articles.get(block.article, 0))
    for part in reversed(parts):
        if part.parent >= 0:
            above = parts[part.parent]
            above.prose += part.prose
            if not above.article:
                above.longest = max(above.longest, part.longest, articles.get(part.article, 0))
    longest = max(articles.values(), default=0)
    apart: list[bool] = []
    for part in parts:
        if part.longest:
            trusted = longest > part.longest
        else:
            elsewhere = articles.get(part.article, 0) - part.prose if part.article else longest
            trusted = 2 * part.prose <= whole or elsewhere > 0 and (part.prose < LONG_LENGTH or 4 * elsewhere >= part.prose)
        apart.append(trusted or part.parent >= 0 and apart[part.parent])
    for block in blocks:
        block.outside = block.outside or block.part >= 0 and apart[block.part]


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    found: list[Block] = []
    named: list[Part] = []
    stack = [Place("")]
    # How many elements of a name are open, and the places of block elements on the stack: closing never searches in vain.
    open_names: dict[str, int] = {}
    open_blocks: list[int] = []
    parts: list[str] = []
    links = 0

    def close_block(place: Place) -> None:
        nonlocal links
        text = BLANKS.sub(" ", "".join(parts)).strip()
        if text:
            found.append(Block(text, links, place.heading, place.outside, place.article, place.part))
        parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if stack[-1].link:
                links += len(text.strip())

    def cut(k: int) -> None:
        """End the elements from place ``k`` of the stack on."""
        for place in stack[k:]:
            open_names[place.name] -= 1
        del stack[k:]
        while open_blocks and open_blocks[-1] >= k:
            open_blocks.pop()

    at = 0
    while True:
        match = TOKEN.search(page, at)
        if match is None:
            add(page[at:])
            break
        add(page[at : match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            continue
        if match["close"]:
            if name in BLOCK:
                close_block(stack[-1])
            if not open_names.get(name):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if (stack[-1].outside, stack[-1].article, stack[-1].part) != (stack[k - 1].outside, stack[k - 1].article, stack[k - 1].part):
                        close_block(stack[-1])
                    cut(k)
                    break
            continue
        if name in RAW:
            if match["attrs"].rstrip().endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            close_block(stack[-1])
            if name not in VOID:
                # A block ends an open paragraph, and an item the item before it.
                if open_blocks and (stack[open_blocks[-1]].name == "p" or stack[open_blocks[-1]].name == name == "li"):
                    cut(open_blocks[-1])
        if name in VOID:
            if name != "br":
                parts.append("")
            continue
        place = stack[-1].inside(name, match["attrs"], at, named)
        if (place.outside, place.part) != (stack[-1].outside, stack[-1].part):
            close_block(stack[-1])
        if name in BLOCK:
            open_blocks.append(len(stack))
        open_names[name] = open_names.get(name, 0) + 1
        stack.append(place)
    close_block(stack[-1])
    set_parts_apart(found, named)
    for block in found:
        block.count_words()
    return found


def stop_words_tell(blocks: list[Block]) -> bool:
    """Whether the page's long blocks hold enough listed words to be in a listed language."""
    long = [b for b in blocks if b.words and b.link_share <= LINK_SHARE]
    return sum(b.stops for b in long) >= STOP_LOW * sum(b.words for b in long)


def label_alone(block: Block, telling: bool) -> str:
    """First pass: the block's label from what it holds; low density alone leaves it undecided."""
    if block.outside or block.link_share > LINK_SHARE or block.notice:
        return BAD
    if len(block.text) < SHORT_LENGTH:
        return BAD if block.links else SHORT
    density = block.stops / block.words
    if not telling or density >= STOP_HIGH:
        return GOOD if len(block.text) > LONG_LENGTH else NEAR
    return NEAR if density >= STOP_LOW else SHORT


def with_article(block: Block, label: str, telling: bool) -> str:
    """The first pass's label on a page with an article: better inside, worse outside."""
    if block.outside:
        return BAD
    if block.article:
        if block.link_share > ARTICLE_LINK_SHARE or block.notice:
            return BAD
        long = len(block.text) >= SHORT_LENGTH and not block.heading
        return GOOD if long and (not telling or block.stops >= STOP_LOW * block.words) else SHORT
    return NEAR if label == GOOD else SHORT if block.heading and label != BAD else BAD


def nearest(labels: list[str], decided: tuple[str, ...], edge: str) -> list[tuple[str, str]]:
    """For each block the nearest label among ``decided`` before it and after it; ``edge`` where there is none."""
    def seen(order: list[str]) -> list[str]:
        last, out = edge, []
        for label in order:
            out.append(last)
            if label in decided:
                last = label
        return out

    return list(zip(seen(labels), seen(labels[::-1])[::-1], strict=True))


def label_articles(blocks: list[Block]) -> None:
    """Second pass inside articles: an undecided block is bad between two bad ones.

    Only the article's own blocks are neighbours, without what its tags set
    apart, and its edges count as good.
    """
    held: dict[int, list[Block]] = {}
    for block in blocks:
        if block.article and not block.outside:
            held.setdefault(block.article, []).append(block)
    for own in held.values():
        for block, sides in zip(own, nearest([b.label for b in own], (GOOD, BAD), GOOD), strict=True):
            if block.label == SHORT:
                block.label = GOOD if GOOD in sides else BAD


def label_by_neighbours(blocks: list[Block]) -> None:
    """Second pass: undecided blocks take the label of the nearest decided ones.

    An undecided block between a good and a bad one is bad unless a nearly good
    one touches it; a nearly good block is bad only between bad ones; a heading
    close before good text is good.
    """
    first = [b.label for b in blocks]
    for i, block in enumerate(blocks):
        if first[i] == SHORT and block.heading:
            reach, k = 0, i + 1
            while k < len(blocks) and reach <= HEADING_REACH and block.label == SHORT:
                if first[k] in (GOOD, NEAR):
                    block.label = NEAR
                reach += len(blocks[k].text)
                k += 1
    first = [b.label for b in blocks]
    decided, touching = nearest(first, (GOOD, BAD), BAD), nearest(first, (GOOD, BAD, NEAR), BAD)
    for i, block in enumerate(blocks):
        if first[i] == SHORT:
            if decided[i][0] != decided[i][1]:
                block.label = GOOD if NEAR in touching[i] else BAD
            else:
                block.label = decided[i][0]
    first = [NEAR if a == NEAR else b.label for a, b in zip(first, blocks, strict=True)]
    decided = nearest(first, (GOOD, BAD), BAD)
    for i, block in enumerate(blocks):
        if first[i] == NEAR:
            block.label = GOOD if GOOD in decided[i] or block.heading else BAD


def label_short_page(blocks: list[Block], bare: bool) -> None:
    """On a page whose first pass finds nothing good: its short sentences are good, and so is a page without tags."""
    if not any(b.label in (GOOD, NEAR) for b in blocks):
        for block in blocks:
            if block.label == SHORT and (bare or not block.heading and SENTENCE_END.search(block.text)):
                block.label = GOOD


def main_text(page: str | None) -> str:
    """The article of a page: good blocks in page order, one space between them."""
    blocks = blocks_of(page or "")
    telling = stop_words_tell(blocks)
    for block in blocks:
        block.label = label_alone(block, telling)
    inside = sum(b.prose for b in blocks if b.article and not b.outside)
    around = sum(b.prose for b in blocks if not b.article and b.label in (GOOD, NEAR))
    if inside and inside >= around:
        for block in blocks:
            block.label = with_article(block, block.label, telling)
        label_articles(blocks)
    else:
        label_short_page(blocks, TOKEN.search(page or "") is None)
    label_by_neighbours(blocks)
    return " ".join(b.text for b in blocks if b.label == GOOD)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null page is empty and gives empty text; null ids and urls stay null. Repeated
    rows give repeated rows, an empty table gives none, and other columns of any
    name are ignored. A page is parsed whole, in time linear in its length for well-quoted tags.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return small_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
