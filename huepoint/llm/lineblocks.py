"""Main text of web pages by their line-block distribution.

The markup is stripped: a page becomes lines, cut at block elements, with the element that holds each
line. Lines inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are no text; they are told by element, role, and class and id. Each other line has a weight: the
length of its text outside links, nothing where links hold more than half of it; of paragraphs
and headlines up to ``width`` in a row may be links as a whole. The weights of ``width``
lines in a row are summed; where the sum surges to ``surge`` the text begins, where it dives to zero it
ends, and what lies between is text, all of it, on every page alike.

Markup is evidence that moves the weights, no more: where an ``article`` (or else ``main``) holds at least
half of the text outside links, its lines weigh ``MARKED`` times as much, so that short lines surge too, and lines
outside weigh nothing; three lines in a row that are all links end the text there as well. An article that holds
less is a teaser and says nothing. Two stretches of one parent element
belong together with that element's lines between them, and a stretch takes the rest of its parent's
lines, if that isn't the body.

Elements nest as HTML says, with end tags left out (p, li, td ... end where the next one or their parent's
end implies it). An excluded element whose own end tag is missing reaches to its parent's end, but never
over an article or main that begins in it. Elements more than ``DEPTH`` deep nest by their own tags alone; those
to be excluded are at any depth. A class or id excludes if one of its names has a word such as
"ad", "sidebar" or "comments" and beside it nothing but words of layout ("left-sidebar", "ad-slot"), so
that "short-form" or "search-results-explained" stay. A tag that no ">" ends is dropped up to the next "<".
All steps take time in proportion to the page.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by a newline. Null and empty pages, and pages without lines, give an empty text. Rows that repeat an
id give a row each. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, SURGE, MARKED = 3, 60, 20

#: Their content is no markup, up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What the start of an element ends if it is open (first), unless one of the others is nearer.
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
for _tags, _ended, _fence in (
    ("li", "li", "ul ol menu dir"),
    ("dt dd", "dt dd", "dl"),
    ("option", "option", "select datalist"),
    ("optgroup", "option optgroup", "select"),
    ("td th", "td th", "tr table"),
    ("tr", "tr td th", "tbody thead tfoot table"),
    ("tbody thead tfoot", "tbody thead tfoot tr td th caption", "table"),
    ("body", "head", "html"),
):
    for _t in _tags.split():
        ENDS[_t] = frozenset(_ended.split()), frozenset(_fence.split())
ENDS_P = BLOCKS - frozenset("body button caption dd dt head html legend li optgroup option select summary tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
P_FENCE = frozenset("button td th table caption object template svg".split())
END_IMPLIED = frozenset("p li dt dd option optgroup td th tr tbody thead tfoot caption head body html".split())
IN_HEAD = frozenset("base link meta title noscript noframes style script template".split())

OUT_TAGS = frozenset("nav aside footer form button select dialog menu head search fieldset noscript template svg canvas object math".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header masthead topbar toolbar footer foot colophon copyright"
    " sidebar sidebars aside rail widget widgets related recommended recommendations trending popular outbrain taboola"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist disqus respond replies reply discussion share sharing social follow form search hidden".split()
)
#: Words that may stand beside them in a name without saying what it holds.
LAYOUT = frozenset(
    "site page global main primary secondary left right top bottom upper lower middle center inner outer side sticky fixed floating mobile desktop"
    " box bar list lists item items wrap wrapper container content group block blocks section area slot slots unit units zone module panel pane row col column"
    " button buttons btn btns link links icon icons text message title label post posts article articles story stories entry user users reader readers"
    " up in out us on the and this by your x new more js has is no old wp fb twitter facebook email".split()
)
PARTS = frozenset(["article", "main"])
CELLS = frozenset("td th caption".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption body html".split())
#: Elements whose end tags may be left out; deeper ones nest by their own tags alone, which keeps each step short.
DEPTH = 256
#: Lines of these are prose whatever part of them is a link.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt caption summary".split())

REST_OF_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPECIAL = re.compile("[\"'>]")


class Tags:
    """Where tags end: at the next > outside of quotes. Each place is looked at once, whatever the page holds."""

    def __init__(self, page: str):
        self.page = page
        self.at = [m.start() for m in SPECIAL.finditer(page)]
        self.same = [-1] * len(self.at)  # the next of the same kind
        seen: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            c = page[self.at[i]]
            self.same[i] = seen.get(c, -1)
            seen[c] = i
        self.endless = bytearray(len(self.at))  # no > outside of quotes from here on
        self.first = 0

    def end(self, start: int) -> int:
        """Place of the > that ends the tag at ``start``, or -1; starts may only grow."""
        while self.first < len(self.at) and self.at[self.first] < start:
            self.first += 1
        i, seen = self.first, []
        while i < len(self.at) and not self.endless[i]:
            if self.page[self.at[i]] == ">":
                return self.at[i]
            seen.append(i)
            i = (self.same[i] if self.same[i] >= 0 else i) + 1  # a quotation mark without a second one is none
        for i in seen:
            self.endless[i] = 1
        return -1


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """("", text, False, "") or (tag, "", whether it ends, attributes), in order; comments and raw text are left out."""
    tags, at, n = Tags(page), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "", page[at:], False, ""
            return
        if lt > at:
            yield "", page[at:lt], False, ""
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", lt):
                stop = lt + 5 if page.startswith("<!-->", lt) else page.find("-->", lt + 4) + 3
            elif page.startswith("<![CDATA[", lt):
                stop = page.find("]]>", lt) + 3
            else:
                stop = page.find(">", lt) + 1
            at = stop if stop > lt else n
            continue
        name = REST_OF_TAG.match(page, lt + 1)
        if not name:  # a bare <
            yield "", "<", False, ""
            at = lt + 1
            continue
        gt = tags.end(lt)
        if gt < 0:
            at = page.find("<", lt + 1)
            at = n if at < 0 else at
            continue
        tag, ends = name[2].lower(), bool(name[1])
        at = gt + 1
        yield tag, "", ends, page[name.end() : gt]
        if tag in RAW and not ends:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else n


def names_out(value: str) -> bool:
    """Whether one of the names in a class or id says that this is no text."""
    for name in value.split():
        words = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower())
        if any(w in OUT_WORDS for w in words) and all(w in OUT_WORDS or w in LAYOUT or len(w) == 1 for w in words):
            return True
    return False


def excluded(tag: str, attrs: str, inside: bool) -> bool:
    """inside: of an article, whose own header is its headline."""
    own_header = inside and tag in ("header", "hgroup")
    if tag in OUT_TAGS or tag == "header" and not inside:
        return True
    if not attrs or tag in ("article", "main", "body", "html"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    named = not own_header and (names_out(found.get("class", "")) or names_out(found.get("id", "")))
    return named or found.get("role", "").lower() in OUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


class Element:
    __slots__ = ("tag", "out", "closed", "number")

    def __init__(self, tag: str, out: bool, number: int):
        self.tag, self.out, self.closed, self.number = tag, out, False, number


class Line:
    __slots__ = ("text", "outside", "prose", "before", "inside", "part", "parent", "body")

    def __init__(self, text: str, outside: int, stack: list[Element], deep_out: bool):
        self.text, self.outside = text, outside
        self.prose = next((e.tag for e in reversed(stack) if e.tag in BLOCKS), "") in PROSE
        part = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in PARTS), -1)
        # excluded elements around the innermost part, and those in it (all, where there is none)
        self.before = [e for e in stack[: part + 1] if e.out]
        self.inside = deep_out or any(e.out for e in stack[part + 1 :])
        kinds = {e.tag for e in stack if e.tag in PARTS}
        self.part = "article" if "article" in kinds else "main" if kinds else ""
        held = next((e for e in reversed(stack) if e.tag in BLOCKS and e.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "summary", "figcaption", "ul", "ol")), None)
        self.parent, self.body = (held.number, held.tag in ("body", "html")) if held else (0, True)

    @property
    def out(self) -> bool:
        return self.inside or any(e.closed for e in self.before)


def lines_of(page: str) -> list[Line]:
    lines: list[Line] = []
    stack: list[Element] = []
    buffer: list[str] = []
    deep: list[tuple[str, bool]] = []  # elements below the stack, and whether they are excluded
    too_deep: Counter[str] = Counter()
    deep_out = 0
    inline_out: Counter[str] = Counter()  # open inline elements that are excluded
    outside = links = count = 0
    quiet = False

    def close_line() -> None:
        nonlocal outside
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                lines.append(Line(text, outside, stack, deep_out > 0))
            buffer.clear()
        outside = 0

    def open_above(tags: frozenset[str], fence: frozenset[str]) -> int:
        """The place of the outermost of these tags that is open, or -1; not beyond a fence."""
        found = -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in fence:
                break
            if stack[i].tag in tags:
                found = i
        return found

    def hidden() -> bool:
        """Whether text here is in an excluded element that is no block: it is left out of its line."""
        for e in reversed(stack):
            if e.out or e.tag in BLOCKS:
                return e.out and e.tag not in BLOCKS
        return False

    def cut(i: int, ended: bool) -> None:
        """Closes the elements from ``i`` on; ended: the first of them by its own end tag."""
        nonlocal quiet
        for e in stack[i:]:
            e.closed = e.tag in END_IMPLIED
            if e.tag not in BLOCKS:
                inline_out[e.tag] -= 1
        stack[i].closed |= ended
        del stack[i:]
        quiet = hidden()

    for tag, text, ends, attrs in tokens(page):
        if not tag:
            if quiet:
                continue
            buffer.append(text)
            if not links:
                outside += len(text.strip())
            continue
        if tag == "a":
            links = 0 if ends else 1
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in VOID and tag not in BLOCKS:
            continue
        block = tag in BLOCKS
        if not block and not ends and tag not in OUT_TAGS and not attrs and not inline_out[tag]:
            continue  # b, i, span ...: nothing depends on them
        if ends:
            if too_deep[tag]:
                if block:
                    close_line()
                while True:  # what is open inside ends with it
                    name, out = deep.pop()
                    too_deep[name] -= 1
                    deep_out -= out
                    if name == tag:
                        break
                continue
            i = len(stack) - 1 if block or inline_out[tag] else -1
            while i >= 0 and stack[i].tag != tag:
                near = stack[i].tag
                if not block and near in BLOCKS or near in PARTS and tag not in PARTS and tag not in ("body", "html") or near in CELLS and tag not in TABLE:
                    i = -1  # it ends nothing outside
                else:
                    i -= 1
            if block:
                close_line()
                links = 0
            if i >= 0:
                deep.clear()
                too_deep.clear()
                deep_out = 0
                cut(i, True)
            continue
        if block:
            close_line()
            links = 0
            if stack and stack[-1].tag == "head" and tag not in IN_HEAD:
                cut(len(stack) - 1, True)
            for ended, fence in ([ENDS[tag]] if tag in ENDS else []) + ([(frozenset("p"), P_FENCE)] if tag in ENDS_P else []):
                i = open_above(ended, fence)
                if i >= 0:
                    cut(i, False)
        if tag in VOID or attrs.endswith("/") and not block:
            continue
        out = excluded(tag, attrs, any(e.tag == "article" for e in stack))
        if not block and (out or inline_out[tag]):
            inline_out[tag] += 1
        elif not block:
            continue
        if len(stack) >= DEPTH:
            too_deep[tag] += 1
            deep.append((tag, out))
            deep_out += out
            inline_out[tag] -= not block
            continue
        count += 1
        stack.append(Element(tag, out, count))
        quiet = hidden()
    close_line()
    if stack:
        cut(0, False)
    return lines


def weights(lines: list[Line], width: int) -> list[int]:
    plain = [x.outside if 2 * x.outside >= len(x.text) else 0 for x in lines]
    at = 0
    while at < len(lines):
        stop = at
        while stop < len(lines) and not plain[stop] and lines[stop].prose:
            stop += 1
        if stop - at <= width:  # more in a row are a list of links
            plain[at:stop] = [len(x.text) for x in lines[at:stop]]
        at = stop + 1
    for part in ("article", "main"):
        inside = sum(w for w, x in zip(plain, lines) if x.part == part)
        if any(x.part == part for x in lines) and 2 * inside >= sum(plain):
            return [MARKED * w if x.part == part else 0 for w, x in zip(plain, lines)]
    return plain


def stretches(weigh: list[int], width: int, surge: int) -> list[tuple[int, int]]:
    """From each surge to the dive after it."""
    n, out, i = len(weigh), [], 0
    sums = [sum(weigh[i : i + width]) for i in range(n)] + [0]
    while i < n:
        if weigh[i] and sums[i] >= surge:
            j = i
            while sums[j]:
                j += 1
            out.append((i, j))
            i = j
        i += 1
    return out


def main_text(page: str | None, width: int = WIDTH, surge: int = SURGE) -> str:
    if not page:
        return ""
    lines = [x for x in lines_of(page) if not x.out]
    weigh = weights(lines, width)
    found = stretches(weigh, width, surge)
    if not found and any(weigh):  # nothing surges: all there is
        weighty = [i for i, w in enumerate(weigh) if w]
        found = [(weighty[0], weighty[-1] + 1)]
    keep = [False] * len(lines)
    reach: dict[int, tuple[int, int]] = {}  # of each parent the first and the last line in a stretch
    for i, j in found:
        for x in range(i, j):
            keep[x] = True
            if weigh[x]:
                lo, hi = reach.get(lines[x].parent, (x, x))
                reach[lines[x].parent] = lo, max(hi, x)
    for x, line in enumerate(lines):
        if weigh[x] and line.parent in reach:
            lo, hi = reach[line.parent]
            keep[x] |= lo < x < hi or not line.body
    return "\n".join(line.text for x, line in enumerate(lines) if keep[x])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({"page_id": b["page_id"], "url": b["url"], "text": pa.array([main_text(x) for x in b["html"].to_pylist()], pa.string())})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string")
