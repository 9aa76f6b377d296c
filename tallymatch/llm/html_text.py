"""Main text of web pages by two-pass block rules.

*Blocks.* A page is cut at block-level tags. Comments, scripts, styles, controls and pictures are left out (formulas stay), as is
everything inside navigation, headers, footers and sidebars: elements of such a kind or with such a role, but for the header
of an article. A form, menu, dialog or set of fields, or a class or id that says an element is not of the article, is a hint: what is below is left out too, but for an ``article`` or ``main`` in it without a hint of
its own, and unless more than ``MOST_HINTED`` of the characters that may be content are below that element, which then is
the page's layout. Parts after has-, no-, with- and without-, and the header of an article, are no hints. Within a block white space, line breaks included, is one blank; character references are
decoded. Each block keeps its number of characters, how many of them are in links, how many of its words are stop words of
some language, and the region it is in: the innermost ``article`` or ``main``, or the rest of the page.

*First pass*, each block by itself. Many links: boilerplate (undecided for a heading, or a long paragraph that ends a sentence, in an article). Long with many stop words: content. Long with few: boilerplate.
Stop words say nothing about a block in another script than theirs, or on a page whose long blocks have few of them taken
together, as it is in a language that is not listed: there a long block is content if most of its letters and digits are
letters. Anything else is undecided; short blocks are.

*Second pass.* An undecided block takes the label of its nearest decided neighbours in its own region, one on either side;
of two that differ, the nearer one in blocks, content if both are as near. With a neighbour on one side only, that one
counts, the edge of the page or region being no neighbour. In a region without any decided block, undecided blocks are
content, unless it is the rest of the page and a long block there is boilerplate for its words. If a page marks an ``article`` or ``main`` with any text,
blocks outside of all of them are boilerplate, and so are articles outside of a ``main`` with content, and an article within one that has
at least as much content of its own, which is a comment; a page without such marks is judged by the rules alone.

Null html: empty. Text without tags is one block. A page of which nothing is content gives an empty text. Broken markup is
read as browsers roughly do: tags left open end with their parent, stray end tags are ignored; the start of a control that is never closed
is passed over. Very long pages are taken whole, one at a time. Rows are treated one by one,
repeated rows and null ids alike; an empty table gives an empty result; columns other than ``page_id``, ``url`` and ``html``
are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.llm import tables, words

LONG = 80
MOST_LINKS = 0.5
MOST_LINKS_SHORT = 0.33
LEAST_STOPS = 0.08
LEAST_LETTERS = 0.75
MOST_HINTED = 0.75

#: Elements, by what they mean for the text.
RAW = "script style noscript iframe textarea title xmp".split()
CONTROLS = "template svg object canvas audio video select button annotation annotation-xml".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
BLOCK = (
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul caption colgroup"
).split()
ASIDE = "nav header footer aside".split()
ROLES = "navigation banner contentinfo complementary search alert menubar toolbar".split()
HINTS = "form menu dialog fieldset".split()
ROLE_HINTS = "form dialog alertdialog menu".split()
ENDS_P = set(BLOCK) - {"body", "html", "head"}
#: An element of the first kind is ended by the start of one of the second, unless one of the third lies between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "tbody", "tfoot"}, {"table"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in a class or an id that say an element is not part of the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs byline captcha carousel "
    "comment comments commentlist consent cookie cookies copyright disqus disclaimer footer footnav gdpr header "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager "
    "pagination paywall popup print promo promoted promotion related reply replies respond search share sharing sidebar "
    "signup sitemap skip social sponsor sponsored sponsors subscribe subscription taboola teaser toc toolbar tooltip topbar "
    "warning widget widgets hidden".split()
)
#: What follows the first in a class or id says what a layout has; a header of the second belongs to the article.
MODIFIERS = frozenset("has no with without".split())
OF_ARTICLE = frozenset("article content entry main post story title".split())
#: Frequent function words.
STOPS = frozenset(
    (
        "a about after all also an and any are as at be because been but by can could did do for from had has have he her his "
        "i if in into is it its more most no not of on one only or other our out she so some than that the their them then there "
        "these they this to up was we were what when which who will with would you your "
        "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist "
        "mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wird zu zum zur "
        "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que "
        "qui sa se ses son sur un une vous "
        "al como con de del el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no o para pero por que "
        "se si sin sobre su sus también un una y ya"
    ).split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|</[^a-zA-Z>][^>]*>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_LATIN = re.compile(r"[A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ]")
_CONTROL = re.compile(rf"<(/?)({'|'.join(map(re.escape, sorted(CONTROLS, key=len, reverse=True)))})(?=[\s/>])(?:[^\"'>]|\"[^\"]*\"|'[^']*')*(/?)>", re.IGNORECASE)
_SENTENCE_END = re.compile(r"[.!?…。！？]\W*\Z")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}


@dataclass
class Block:
    region: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    heading: bool = False
    paragraph: bool = False
    #: The hinted elements it is in.
    hints: tuple[int, ...] = ()


@dataclass
class _Element:
    name: str
    aside: bool
    region: int
    hints: tuple[int, ...] = ()
    #: In a hinted element within a block, so not part of the block.
    inline: bool = False


def is_hint(value: str) -> bool:
    """Whether a class or id says that an element is not part of an article."""
    for one in value.split():
        before: set[str] = set()
        for part in map(str.lower, _NAME_PART.findall(one)):
            if part in NOT_ARTICLE and not before & MODIFIERS and not (part == "header" and before & OF_ARTICLE):
                return True
            before.add(part)
    return False


def is_aside(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is not part of an article by its kind, role or style; whether its class or id hints so."""
    if name in ASIDE:
        return True, False
    hint = name in HINTS
    if "=" not in rest and "hidden" not in rest:
        return False, hint
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            hint = hint or name not in ("body", "html") and is_hint(value)
        elif key == "role" and value.strip().lower() in ROLES:
            return True, hint
        elif key == "role" and value.strip().lower() in ROLE_HINTS:
            hint = True
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            return True, hint
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True, hint
    return False, hint


def ends_of_controls(page: str) -> dict[int, int]:
    """Where each control or picture ends, by where its start tag ends. One that is never closed is not among them."""
    opened: dict[str, list[int]] = {}
    ends = {}
    for match in _CONTROL.finditer(page):
        starts = opened.setdefault(match[2].lower(), [])
        if not match[1]:
            starts.append(match.end())
        elif starts:
            ends[starts.pop()] = match.end()
    return ends


def blocks(page: str) -> tuple[list[Block], list[tuple[str, int]]]:
    """The blocks with text that are not set aside, hinted ones included, and of each region its element and the region around it.

    Region 0 is the rest of the page.
    """
    stack: list[_Element] = [_Element("", False, 0)]
    found: list[Block] = []
    now = Block(0)
    regions, ends = [("", 0)], None
    links = hints = 0
    at = 0

    def finish(element: _Element) -> None:
        nonlocal now
        now.text = _SPACE.sub(" ", "".join(now.parts)).strip()
        if now.text:
            found.append(now)
        now = Block(element.region, hints=element.hints)

    def say(text: str) -> None:
        if text and not stack[-1].aside and not stack[-1].inline:
            text = entities.unescape(text)
            now.parts.append(text)
            if links:
                now.linked += len(_SPACE.sub(" ", text))

    def close(to: int) -> None:
        """Ends the elements from place ``to`` on."""
        nonlocal links
        gone = stack[to:]
        if any(e.name in ENDS_P or e.name == "body" or "-" in e.name and e.hints for e in gone):
            del stack[to:]
            finish(stack[-1])
        else:
            del stack[to:]
        links -= sum(e.name == "a" for e in gone)

    def place_of(names: set[str], stops: set[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                return k
            if stack[k].name in stops:
                break
        return 0

    while at < len(page):
        match = _TOKEN.search(page, at)
        if not match:
            say(page[at:])
            break
        say(page[at : match.start()])
        at = match.end()
        if match["cdata"] is not None:
            continue
        if not match["name"]:
            continue
        name = match["name"].lower()
        if match["end"]:
            if name == "p" and not place_of({"p"}, set()):
                finish(stack[-1])
            k = place_of({name}, {"table"} if name not in ("table", "body", "html", "article", "main", "div") else set())
            if k:
                close(k)
            elif name == "br" and not stack[-1].aside:
                now.parts.append(" ")
            continue
        if name in CONTROLS:
            # Up to its own end; the start of one that is never closed is passed over, what follows is text.
            if ends is None:
                ends = ends_of_controls(page)
            at = at if match["rest"].endswith("/") else ends.get(at, at)
            continue
        if name in RAW:
            ending = _RAW_END[name].search(page, at)
            at = ending.end() if ending else len(page)
            continue
        if name in VOID:
            if name == "hr":
                finish(stack[-1])
            elif name in ("br", "wbr") and not stack[-1].aside:
                now.parts.append(" " if name == "br" else "")
            continue
        if name in ENDS_P:
            k = place_of({"p"}, {"table", "td", "th", "button", "object"})
            if k:
                close(k)
        if name in IMPLIED:
            k = place_of(*IMPLIED[name])
            if k:
                close(k)
        elif name == "a":
            k = place_of({"a"}, {"td", "th"})
            if k:
                close(k)
        above = stack[-1]
        region = above.region
        own, hint = is_aside(name, match["rest"])
        if name == "header" and regions[region][0] == "article" and not is_aside("div", match["rest"])[0]:
            own = False  # the head of an article holds its title
        hinted = above.hints
        if name in ("article", "main"):
            if not above.aside:
                regions.append((name, region))
                region = len(regions) - 1
            # Reopens what a class or id has closed; below such a one its own hint counts.
            hinted, hint = (hinted, False) if hint else ((), False)
        elif hint and not own:
            hints += 1
            hinted = (*hinted, hints)
        block = name in ENDS_P or name in ("body", "html", "head")
        # An element of an unknown kind may hold blocks, one within a line does not.
        inline = (above.inline or hint) and not block and "-" not in name
        element = _Element(name, above.aside or name == "head" or own, region, hinted, inline)
        if block or hint and not inline:
            finish(element)
            now.heading, now.paragraph = name in ("h1", "h2", "h3"), name == "p"
        stack.append(element)
        links += name == "a"
        if name == "body":  # text before it may have left a head open
            for element in stack[:-1]:
                element.aside = element.aside and element.name != "head"
            stack[-1].aside = is_aside(name, match["rest"])[0]
    finish(stack[0])
    return found, regions


def many_links(block: Block) -> bool:
    return block.linked > (MOST_LINKS if len(block.text) >= LONG else MOST_LINKS_SHORT) * len(block.text)


def listed(found: list[Block]) -> bool:
    """Whether the long blocks, taken together, have the stop words of a language that is listed."""
    own = [word for block in found if len(block.text) >= LONG and not many_links(block) for word in _WORD.findall(block.text.lower())]
    return sum(word in STOPS for word in own) >= LEAST_STOPS * len(own)


def first_pass(block: Block, known: bool = True) -> bool | None:
    """Content, boilerplate, or undecided; ``known``: the page is in a language whose stop words are listed."""
    text = block.text
    if many_links(block):
        # The heading of an article often links to the article, and a sentence of it may be a link.
        sentence = block.paragraph and len(text) >= LONG and _SENTENCE_END.search(text)
        return None if block.region and (block.heading or sentence) else False
    if len(text) < LONG:
        return None
    own = _WORD.findall(text.lower())
    stops = sum(word in STOPS for word in own)
    letters = sum(map(len, own))
    if stops >= LEAST_STOPS * len(own):
        return True
    if not known or 2 * len(_LATIN.findall(text)) < letters:
        if letters and letters >= LEAST_LETTERS * (letters + len(_DIGIT.findall(text))):
            return True
    return None if block.region else False


def second_pass(labels: list[bool | None], otherwise: bool) -> list[bool]:
    """Undecided blocks of one region by their nearest decided neighbours."""
    n = len(labels)
    before, after = [None] * n, [None] * n
    for order, out in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for k in order:
            out[k] = last
            if labels[k] is not None:
                last = k
    result = []
    for k, label in enumerate(labels):
        if label is not None:
            result.append(label)
            continue
        near = [(abs(at - k), not labels[at]) for at in (before[k], after[k]) if at is not None]
        result.append(not min(near)[1] if near else otherwise)
    return result


def layout(found: list[Block], known: bool) -> set[int]:
    """The hinted elements that hold nearly all of what may be content."""
    marked = any(block.region for block in found)
    held: dict[int, int] = {}
    total = 0
    for block in found:
        if (block.region or not marked) and first_pass(block, known) is not False:
            total += len(block.text)
            for hint in block.hints:
                held[hint] = held.get(hint, 0) + len(block.text)
    return {hint for hint, n in held.items() if n > MOST_HINTED * total}


def of_article(found: list[Block], regions: list[tuple[str, int]], known: bool) -> set[int]:
    """The regions that hold the article.

    All of those marked, but: where a ``main`` has content, those outside of it are something else; and an ``article`` within another that
    has at least as much content of its own is a comment on it.
    """
    held = [0] * len(regions)
    for block in found:
        if first_pass(block, known) is not False:
            held[block.region] += len(block.text)
    inside, around = [False] * len(regions), [0] * len(regions)
    for k, (name, outer) in enumerate(regions[1:], 1):
        inside[k] = name == "main" or inside[outer]
        around[k] = outer
    whole = held.copy()
    for k in range(len(regions) - 1, 0, -1):
        whole[around[k]] += whole[k]
    only_main = any(held[k] for k in range(1, len(regions)) if inside[k])
    chosen: set[int] = set()
    for k, (name, outer) in enumerate(regions[1:], 1):
        comment = name == "article" and outer and (regions[outer][0] == "article" and held[outer] >= whole[k] or outer not in chosen)
        if not comment and (inside[k] or not only_main):
            chosen.add(k)
    return chosen


def main_text(page: str) -> str:
    found, regions = blocks(page)
    known = listed(found)
    if any(block.hints for block in found):
        shown = layout(found, known)
        found = [block for block in found if shown.issuperset(block.hints)]
    marked = any(block.region for block in found)
    chosen = of_article(found, regions, known) if marked else {0}
    keep = [False] * len(found)
    by_region: dict[int, list[int]] = {}
    for k, block in enumerate(found):
        by_region.setdefault(block.region, []).append(k)
    for region, own in by_region.items():
        if region not in chosen:
            continue
        labels = [first_pass(found[k], known) for k in own]
        if not region and not any(label is not None and (label or not many_links(found[k])) for k, label in zip(own, labels, strict=True)):
            # Nothing but links was decided, and they say nothing about their neighbours.
            labels = [label is None for label in labels]
        for k, label in zip(own, second_pass(labels, region > 0), strict=True):
            keep[k] = label
    return "\n".join(block.text for block, kept in zip(found, keep, strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text; a row for each row of ``pages``."""

    def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in words.pieces(batches, "html"):
            column = {name: part.column(k) for k, name in enumerate(part.schema.names)}
            texts = [main_text(page or "") for page in column["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column["page_id"], column["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return own.mapInArrow(extracted, "page_id long, url string, text string")


def op9_html_extraction(spark, folder: str) -> DataFrame:
    return extract(tables.table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
