"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block it can: blocks inside menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are bad, and so are blocks made of links (inside the page's article only those of lists made of links). Others are
good if they stand inside the page's article element, hold enough stop words, or are long and hold some; those of middle length with hardly any are
bad. The rest stays open, as do short blocks. In the second pass an open block takes the label of its nearest decided neighbour; headings
look at what follows them first. On a page without a good block the open ones are all the text there is, and stay.

Some elements are bad for sure (by tag, role, or because they are hidden), others only by their name or as a form, and then the text decides. A name tells
for sure if all its words are of the kind ("related-posts", "comment-list"), and tells little if others stand beside them ("layout-with-sidebar",
"related-work"): inside the page's article such a name means nothing, and elsewhere not on an element with most of the page's prose. Inside the
article a section with a name like "discussion" that begins with a heading and holds prose is part of it. Where all that leaves a page without any
text, no element with most of its prose is bad by name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from learnlens.llm.common import slices, texts

SHORT, LONG = 70, 200
STOP_SHARE, SOME_STOPS = 0.2, 0.05
LINK_SHARE = 0.5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was we were which with you
    au aux avec ce dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour que qui sa se ses son sur un une vous
    aber als auch auf aus bei das dem den der die durch ein eine einen einer er es für hat ich im ist mit nach nicht oder sein sich sie sind um und von war wie zu
    al como con del el esta han las lo los más muy no para pero por sin su sus también te una y
    """.split()
)

# Element names, roles, and words of class or id names.
BAD_TAGS = frozenset("nav footer aside form button dialog menu noscript fieldset head audio video canvas object select datalist".split())
SOFT_TAGS = frozenset(["form", "fieldset"])  # a form may wrap a whole page
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs
    sidebar footer masthead cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login share sharing social
    related recommended recommendations comment comments disqus respond popup modal overlay toolbar pagination pager search form skip copyright alert alerts widget
    topnav sidenav subnav menubar topbar navlist adbox adslot adblock cookiebar commentlist replies responses discussion announcement notification notifications disclaimer warning toast
    """.split()
)
TEXT_WORDS = frozenset("article content post entry story".split())  # in names of the article's element where it is no article or main
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head
    header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul
    """.split()
)
#: An opening tag ends an open element of these kinds, up to an element of the kinds after the colon.
IMPLIED = {
    **{t: ({"p"}, frozenset("button td th".split())) for t in BLOCK_TAGS - frozenset("html head body tbody thead tfoot tr td th caption legend summary option optgroup".split())},
    "li": ({"li", "p"}, frozenset("ul ol menu td th".split())),
    "dd": ({"dd", "dt", "p"}, frozenset(["dl"])),
    "dt": ({"dd", "dt", "p"}, frozenset(["dl"])),
    "tr": ({"tr"}, frozenset(["table"])),
    "td": ({"td", "th"}, frozenset("table tr".split())),
    "th": ({"td", "th"}, frozenset("table tr".split())),
    "option": ({"option"}, frozenset(["select"])),
    "body": ({"head"}, frozenset()),
}

_ATTRS = r"""(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<(?P<raw>script|style|textarea|title|iframe|noframes|noembed|xmp|template|svg|math)(?=[\s/>]){_ATTRS}.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)
    |<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})
    |<[!?][^>]*+(?:>|\Z)|</[^>]*+>|<[a-zA-Z/][^>]*+\Z""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMES = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class _Open:
    tag: str
    bad: bool  # for sure
    soft: int  # the innermost element around that is bad by its name, or -1
    held: bool  # bad also for an article inside
    article: bool
    link: bool
    heading: bool


@dataclass(slots=True)
class _Block:
    text: str
    links: int
    bad: bool
    soft: int
    article: bool
    heading: bool
    item: int  # the list of a list item, or 0


@dataclass(slots=True)
class _Soft:
    """An element that is bad by its name, or as a form."""

    parent: int
    sure: bool  # its name tells for sure
    section: bool  # a section of an article may be named so


HELD_WORDS = frozenset("comment comments commentlist replies responses related recommended recommendations sidebar".split())
#: Beside a bad word in a compound name, these change nothing.
HELPERS = frozenset(
    """
    area article articles bar block bottom box button buttons column container count entry group icon icons inline inner item items left link links list module
    outer panel placeholder post posts primary reader right row secondary section site slot social stories story thread top unit user users wrap wrapper
    """.split()
)
#: Sections of an article may have these names.
SECTION_WORDS = frozenset("discussion notice notices search form promotion social announcement disclaimer warning alert alerts recommendations".split())


def _words(name: str) -> list[str]:
    return _NAMES.findall(_CAMEL.sub(" ", name).lower())


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool | None, bool, bool, bool]:
    """Of an element: bad for sure; bad by its name, and whether that is sure (None: not); held; named like an article; named like a section."""
    named = held = section = False
    soft: bool | None = False if tag in SOFT_TAGS else None
    bad = (tag in BAD_TAGS and tag not in SOFT_TAGS) or (tag == "header" and not in_article)
    held = tag == "aside"
    if "=" in attrs or "hidden" in attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                for token in value.split():
                    words = _words(token)
                    if tag in ("div", "section", "td") and not TEXT_WORDS.isdisjoint(words):
                        named = True
                    own = [w for w in words if w in BAD_WORDS or (w == "header" and not in_article)]
                    if own:
                        sure = all(w in BAD_WORDS or w in HELPERS or w == "header" for w in words)
                        if sure or not in_article:
                            section = (soft is None or section) and SECTION_WORDS.issuperset(own)
                            soft = bool(soft) or sure
                        held |= sure and not HELD_WORDS.isdisjoint(own)
            elif name in ("class", "id") and tag == "article" and {"comment", "comments"} & set(_words(value)):
                bad, held = True, True
            elif name == "role":
                bad |= value.strip().lower() in BAD_ROLES and not (in_article and value.strip().lower() == "banner")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                bad = True
    return bad, soft, held or (bad and tag in ("article", "main")), named and not bad and soft is None, section


class _Stack:
    """The open elements, and where each kind of them is: no step walks the stack, however deep a page is."""

    def __init__(self) -> None:
        self.open: list[_Open] = [_Open("", False, -1, False, False, False, False)]
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks = [0]

    def last(self, tag: str) -> int:
        places = self.at[tag]
        return places[-1] if places else 0

    def push(self, element: _Open) -> None:
        self.at[element.tag].append(len(self.open))
        if element.tag in BLOCK_TAGS:
            self.blocks.append(len(self.open))
        self.open.append(element)

    def cut(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.open) > place:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()

    def close(self, tag: str) -> None:
        place = self.last(tag)
        if place and (tag in BLOCK_TAGS or place > self.blocks[-1]):  # an inline end tag closes nothing outside its block
            self.cut(place)

    def imply(self, tag: str) -> None:
        ends, until = IMPLIED[tag]
        place, bound = max(map(self.last, ends)), max(map(self.last, until), default=0)
        if tag not in ("body", "li", "dd", "dt", "tr", "td", "th"):
            bound = max(bound, self.blocks[-1])
        if place and place >= bound:
            self.cut(place)


def blocks(html: str) -> tuple[list[_Block], list[_Soft]]:
    """The blocks of a page that hold text, in page order, with white space as single blanks; and the elements that are bad by name."""
    out: list[_Block] = []
    softs: list[_Soft] = []
    stack = _Stack()
    parts: list[str] = []
    linked: list[str] = []
    breaks = lists = 0
    list_of: list[int] = []  # the numbers of the open lists

    def end() -> None:
        nonlocal breaks
        text = " ".join("".join(parts).split())
        if text:
            top = stack.open[-1]
            links = len(" ".join("".join(linked).split()))
            item = stack.last("li") > max(stack.last("article"), stack.last("main"))
            out.append(_Block(text, links, top.bad, top.soft, top.article, top.heading, (list_of[-1] if list_of else -1) if item else 0))
        parts.clear()
        linked.clear()
        breaks = 0

    def put(text: str) -> None:
        nonlocal breaks
        if text:
            text = unescape(text) if "&" in text else text
            if breaks and text.strip():
                breaks = 0
            parts.append(text)
            if stack.open[-1].link:
                linked.append(text)

    at = 0
    for m in _TOKEN.finditer(html):
        put(html[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            if m["raw"] is None and m[0].startswith("<![CDATA["):
                put(m[0][9:].removesuffix("]]>"))
            continue
        tag = m["tag"].lower()
        if tag == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:  # a blank line
                end()
            continue
        if tag in BLOCK_TAGS:
            end()
        if m["close"]:
            stack.close(tag)
            del list_of[len(stack.at["ul"]) + len(stack.at["ol"]) :]
            continue
        if tag in VOID:
            continue
        if tag in IMPLIED:
            stack.imply(tag)
            del list_of[len(stack.at["ul"]) + len(stack.at["ol"]) :]
        top = stack.open[-1]
        bad, soft, held, named, section = _marks(tag, m["attrs"], top.article)
        number = top.soft
        if soft is not None:
            softs.append(_Soft(top.soft, soft, section and top.article))
            number = len(softs) - 1
        main = tag in ("main", "article") or re.search(r"role\s*=\s*[\"']?main\b", m["attrs"]) is not None
        if main and not top.held:  # an element left open before the article does not swallow it
            stack.push(_Open(tag, bad, -1 if soft is None else number, held, not bad, False, False))
        else:
            heading = tag in HEADINGS or (top.heading and tag not in BLOCK_TAGS)
            # Inside an article, of its own header only the headings belong to the text.
            aside = tag == "header" and top.article
            own = top.bad and not (heading and top.tag in ("header", "hgroup") and top.article and not top.held)
            stack.push(_Open(tag, own or bad or aside, number, top.held or held, top.article or (named and not top.bad and top.soft < 0), top.link or tag == "a", heading))
        if tag in ("ul", "ol"):
            lists += 1
            list_of.append(lists)
    put(html[at:])
    end()
    return out, softs


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _prose(block: _Block) -> bool:
    n = len(block.text)
    if n < SHORT or block.links > LINK_SHARE * n:
        return False
    stops = _stop_share(block.text)
    return stops >= STOP_SHARE or (n >= LONG and stops >= SOME_STOPS)


def _first_label(block: _Block, bad: bool, marked: bool, menu: bool) -> int | None:
    """1 good, 0 bad, None open. `menu`: an item of a list made of links."""
    n = len(block.text)
    if bad or (marked and not block.article):
        return 0
    if block.links > LINK_SHARE * n:
        return None if marked and not menu else 0
    if n < SHORT:
        return 1 if marked and not block.heading and not menu else None
    if marked:
        return 1
    stops = _stop_share(block.text)
    if stops >= STOP_SHARE or (n >= LONG and stops >= SOME_STOPS):
        return 1
    return 0 if n < LONG and stops < SOME_STOPS else None


class _Page:
    """The blocks of a page and their labels."""

    def __init__(self, html: str):
        self.found, self.softs = blocks(html)
        in_lists: Counter[int] = Counter()
        for b in self.found:
            in_lists[b.item] += 1 if b.links > LINK_SHARE * len(b.text) else -1
        self.menus = {k for k, n in in_lists.items() if k and n > 0}  # more items are links than not
        self.excused = [False] * len(self.softs)
        self._prose: list[int] | None = None
        self.label: list[int | None] = []
        self.marked = False

    def prose(self) -> list[int]:
        """The characters of prose in each block, 0 in blocks that are bad for sure."""
        if self._prose is None:
            self._prose = [len(b.text) if not b.bad and _prose(b) else 0 for b in self.found]
        return self._prose

    def inside(self) -> list[int]:
        """The prose inside each element that is bad by name."""
        total = [0] * len(self.softs)
        for b, n in zip(self.found, self.prose()):
            if b.soft >= 0:
                total[b.soft] += n
        for k in range(len(total) - 1, -1, -1):
            if self.softs[k].parent >= 0:
                total[self.softs[k].parent] += total[k]
        return total

    def in_soft(self, sure: bool = False) -> list[bool]:
        """Whether each of those elements, or one around it, is bad (`sure`: by a name that tells for sure)."""
        out: list[bool] = []
        for k, soft in enumerate(self.softs):
            out.append((not self.excused[k] and (soft.sure or not sure)) or (soft.parent >= 0 and out[soft.parent]))
        return out

    def classify(self) -> None:
        held = self.in_soft()
        bad = [b.bad or (b.soft >= 0 and held[b.soft]) for b in self.found]
        self.marked = any(b.article and not x for b, x in zip(self.found, bad))
        self.label = [_first_label(b, x, self.marked, b.item in self.menus) for b, x in zip(self.found, bad)]
        self.own = [k for k, b in enumerate(self.found) if not self.marked or (b.article and not bad[k])]

    def excuse(self) -> None:
        """Sections of the article by their text; and elements with uncertain names that hold most of the prose outside the certain ones."""
        if any(s.section for s in self.softs):
            inside, first = self.inside(), {}
            for b in reversed(self.found):
                k = b.soft
                if k >= 0:
                    first[k] = b
            for k, soft in enumerate(self.softs):
                if soft.section and inside[k] and k in first and first[k].heading:
                    self.excused[k] = True
        if any(not s.sure for s in self.softs):
            sure = self.in_soft(True)
            total = sum(n for b, n in zip(self.found, self.prose()) if b.soft < 0 or not sure[b.soft])
            kept = [0 if b.soft >= 0 and sure[b.soft] else n for b, n in zip(self.found, self.prose())]
            inside = [0] * len(self.softs)
            for b, n in zip(self.found, kept):
                if b.soft >= 0:
                    inside[b.soft] += n
            for k in range(len(inside) - 1, -1, -1):
                if self.softs[k].parent >= 0:
                    inside[self.softs[k].parent] += inside[k]
                if not self.softs[k].sure and 2 * inside[k] > total:
                    self.excused[k] = True


def main_text(html: str | None) -> str:
    """The article of a page, one block a line. No html: an empty text."""
    if not html:
        return ""
    page = _Page(html)
    page.excuse()
    page.classify()
    if page.softs and all(x == 0 for x in page.label):
        total = sum(page.prose())
        page.excused = [x or 2 * n > total for x, n in zip(page.excused, page.inside())]
        page.classify()
    found, label = page.found, page.label
    if 1 not in label:  # nothing tells the text from the rest
        rest = [k for k, x in enumerate(label) if x is None] or [k for k, b in enumerate(found) if b.soft >= 0 and not b.bad and b.links <= LINK_SHARE * len(b.text)]
        return "\n".join(found[k].text for k in rest)
    # Second pass. Of a marked article only its own blocks are neighbours.
    own = page.own
    before: dict[int, int] = {}
    after: dict[int, int] = {}
    for order, near in ((own, before), (own[::-1], after)):
        last = None
        for place, k in enumerate(order):
            if label[k] is not None:
                last = (place, label[k])
            elif last:
                near[k] = (place - last[0], last[1])
    for k in own:
        if label[k] is None:
            left, right = before.get(k), after.get(k)
            if left and right and left[1] != right[1]:
                nearest = right if found[k].heading or right[0] < left[0] else left if left[0] < right[0] else (0, 1)
            else:
                nearest = right or left or (0, 1)  # nothing decided: the text is all there is
            label[k] = -nearest[1]  # marked as inherited, so that it decides no other
    return "\n".join(b.text for b, x in zip(found, label) if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of `pages` (page_id, url, html; all else is ignored).

    A null or empty html, and a page without an article, have an empty text. Repeated rows are read each; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(h) for h in texts(part, "html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, type=pa.string()), pa.array([len(t) for t in found], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
