"""HTML extraction by wrappers: union-free expressions inferred from the pages of a host.

Every page is read as a stream of tags and texts. The expression of an element is the sequence of its
children: runs of like children, and of like groups of up to four children, become repeated groups,
texts become slots. Two expressions are aligned child by child; a child that one of them lacks becomes
optional, one that either repeats is repeated, and slots keep whether all texts met so far were equal.
There is no alternative in an expression. Wrappers of single batches are merged by host and part, then by host, so a host with a
third of all pages costs one wrapper per batch.

The wrapper says which region holds the article - `article` or `main` elements, else the smallest
element with all headings and all text that is not the same on every page - and which parts of it are not text of the article: elements
named as menus, headers, footers, sidebars, notices, adverts, forms or comments, and elements and slots that hold
the same text on every page of the host, but headings, and titles within an article. A name counts for nothing on an element with the
page's only article or main elements, the title (h1) of an article, or most of the page's varying text.

Null and empty pages give empty text; repeated pages give repeated rows; a null or odd URL makes its
pages a host of their own, "". Unclosed and stray tags are accepted as browsers accept them;
an element below `MAX_DEPTH` levels is put beside the one above it, with all its text.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.sources.staging import pin

PARTS = 256
#: Different pages of a host after which a text that all of them have counts as part of the template.
LEAST_PAGES = 5
#: Different pages that a wrapper tells apart.
DIFFERENT = 64

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html dd dt li td th tr tbody thead tfoot option optgroup legend summary".split())
#: What an opening tag ends, and within which elements.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())
HEADING = re.compile("h[1-6]")
TITLES = frozenset("h1 h2 h3 h4 h5 h6 dt th caption figcaption legend".split())
DROPPED_TAGS = frozenset(
    "head nav aside footer form button select input label menu dialog canvas audio video object".split()
) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
DROPPED_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|side-?bar|menu|nav(?:bar|igation)?|"
    r"breadcrumbs?|footer|masthead|site-?header|page-?header|header|top-?bar|comments?|comment-?list|replies|reply|respond|disqus|"
    r"cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|sign-?up|login|share|sharing|social|"
    r"related|recommend(?:ed|ations)?|widget|toolbar|pagination|pager|skip-?link|search(?:-?form)?|form)(?:$|[-_\s\d])",
    re.I,
)
#: Names of what a layout has or lacks.
LAYOUT_NAMES = re.compile(r"(?:^|(?<=[-_\s]))(?:with|without|has|no)[-_]+\S+", re.I)
COMMENT_NAMES = re.compile(r"comment|reply|replies|disqus", re.I)
#: Where a comment, a declaration or a tag begins; the end of a tag is found by `_tag_end`.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The same beyond the last ">", where no tag can end.
_COMMENT = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?].*", re.S)
_QUOTE_OR_END = re.compile("[>\"']")
#: Levels of elements; a deeper one is put beside the last one, as browsers do, so that no page is too deep.
MAX_DEPTH = 200
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Element:
    """An element: tag, label (tag and first class or id, digits as #), whether its name marks it as
    no part of an article, and its children, elements or texts. `named` says that nothing but the name
    marks it, `comments` that it is the name of comments."""

    __slots__ = ("tag", "label", "dropped", "named", "comments", "children", "page", "whole")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.label, self.page, self.whole = tag, [], tag, None, None
        self.dropped = tag in DROPPED_TAGS
        self.named = self.comments = False
        if attributes and not attributes.isspace():
            found = {}
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            name = (found.get("class") or found.get("id") or "").split()
            if name:
                self.label = f"{tag}.{re.sub(r'[0-9]+', '#', name[0])[:40]}"
            names = LAYOUT_NAMES.sub(" ", f"{found.get('class', '')} {found.get('id', '')}")
            self.dropped |= found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found
            self.dropped |= found.get("aria-hidden", "").lower() == "true"
            # The page itself may be named after its layout; comments may be articles.
            self.comments = bool(COMMENT_NAMES.search(names))
            if not self.dropped and tag not in ("html", "body") and (tag not in ("article", "main") or self.comments):
                self.dropped = self.named = bool(DROPPED_NAMES.search(names))


def _tag_end(page: str, at: int, failed: set[int]) -> int:
    """The place behind the ">" that ends a tag, given one behind its name: the first outside of quotes, else
    the first at all. `failed` are quotes from which no end is reached, so that none is followed twice."""
    place, quotes = at, []
    while m := _QUOTE_OR_END.search(page, place):
        if m[0] == ">":
            return m.end()
        if m.start() in failed:
            break
        quotes.append(m.start())
        place = page.find(m[0], m.end()) + 1
        if not place:
            break
    failed.update(quotes)
    return page.find(">", at) + 1


def parse(page: str) -> Element:
    """The element tree of a page, with unclosed and stray tags put right, in time linear in its length."""
    root = Element("html")
    root.page = zlib.crc32(page.encode())
    stack, at, n = [root], 0, len(page)
    last, failed = page.rfind(">"), set()
    beside: dict[str, int] = {}  # elements below the deepest level that are open
    while at < n:
        m = (_TOKEN if at <= last else _COMMENT).search(page, at)
        if m is not None and m.re is _TOKEN and m[2] and m.start() > last:
            m = _COMMENT.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower() if m.re is _TOKEN else ""
        if not tag:
            continue  # comment or declaration
        at = _tag_end(page, m.end(), failed)
        attributes = page[m.end() : at - 1]
        if m[1]:
            if beside.get(tag):
                beside[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    beside.clear()
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            _end(stack, {"p"}, {"td", "th", "table", "button", "li", "dd", "div", "article", "section", "blockquote"})
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
                stack.pop()
        elif tag in ENDS:
            _end(stack, *ENDS[tag])
        if tag == "body":
            del stack[1:]
        element = Element(tag, attributes)
        opens = tag not in RAW and tag not in VOID and (not attributes.endswith("/") or tag not in ("svg", "math"))
        if opens and len(stack) > MAX_DEPTH:
            above = stack.pop()
            beside[above.tag] = beside.get(above.tag, 0) + 1
            element.dropped |= above.dropped  # what is beside was inside
        stack[-1].children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at, last + 1)
            at = close.end() if close else n
        elif opens:
            stack.append(element)  # a slash does not close an HTML element
    return root


def _end(stack: list[Element], tags: set, within: set) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in within:
            return


# --- expressions ------------------------------------------------------------------------
# An expression is a dict: l label, d dropped, o optional, r repeated, n pages, s slot (checksum of the text, or null once texts differed), t pages that had a text in
# the slot, w checksum of all text in the element (or null once it differed; false without any), c children. A group of children has the label "()". The root also has p, checksums of
# different pages.


def _text_sum(text: str) -> int:
    return zlib.crc32(" ".join(text.split()).encode())


def _whole_sum(slot: int | bool, children: list[int | bool]) -> int | bool:
    return zlib.crc32(repr((slot, children)).encode()) if slot is not False or any(c is not False for c in children) else False


def _whole(element: Element) -> int | bool:
    """The checksum of all text in an element of a page."""
    if element.whole is None:
        text = [c for c in element.children if isinstance(c, str) and not c.isspace()]
        below = [_whole(c) for c in element.children if not isinstance(c, str)]
        element.whole = _whole_sum(_text_sum(" ".join(text)) if text else False, below)
    return element.whole


def expression(element: Element) -> dict:
    """The expression of one page's element."""
    found = _expression(element)
    return found if element.page is None else found | {"p": [element.page]}


def _expression(element: Element) -> dict:
    children, text = [], []
    for child in element.children:
        if isinstance(child, str):
            if not child.isspace():
                text.append(child)
        else:
            children.append(_expression(child))
    slot = _text_sum(" ".join(text)) if text else False
    return {"l": element.label, "d": element.dropped, "o": False, "r": False, "n": 1, "s": slot,
            "t": int(slot is not False), "w": _whole_sum(slot, [c["w"] for c in children]), "c": fold(children)}


def _runs(labels: list[str]) -> list[tuple[str, list]]:
    """Like neighbours, then like groups of neighbours, as one: the label with its places, or "()" with
    the sequences that repeat."""
    runs: list[tuple[str, list]] = []
    for i, label in enumerate(labels):
        if runs and runs[-1][0] == label:
            runs[-1][1].append(i)
        else:
            runs.append((label, [i]))
    for width in range(2, 5):
        i = 0
        while i + 2 * width <= len(runs):
            group = [r[0] for r in runs[i : i + width]]
            if len(set(group)) == 1 or group != [r[0] for r in runs[i + width : i + 2 * width]]:
                i += 1
                continue
            end = i
            while [r[0] for r in runs[end : end + width]] == group:
                end += width
            runs[i:end] = [("()", [runs[k : k + width] for k in range(i, end, width)])]
            i += 1
    return runs


def fold(children: list[dict]) -> list[dict]:
    """Like neighbours, then like groups of neighbours, become repeated groups."""
    return [_folded(children, *run) for run in _runs([c["l"] for c in children])]


def _folded(children: list[dict], label: str, found: list) -> dict:
    if label != "()":
        out = children[found[0]]
        for i in found[1:]:
            out = merge(out, children[i], pages=False) | {"r": True}
        return out
    merged = [_folded(children, *run) for run in found[0]]
    for sequence in found[1:]:
        merged = [merge(a, _folded(children, *run), pages=False) for a, run in zip(merged, sequence)]
    return {"l": "()", "d": False, "o": False, "r": True, "n": 1, "s": False, "t": 0, "w": None, "c": merged}


def merge(a: dict, b: dict, pages: bool = True) -> dict:
    """One expression for both; `pages` says that they come from different pages. Else the pages of one
    may be those of the other, and counts are the least that holds."""
    slot = a["s"] if a["s"] == b["s"] and a["s"] is not False else (None if a["s"] is not False or b["s"] is not False else False)
    if slot is None and pages and (a["s"] is False or b["s"] is False):
        slot = a["s"] if a["s"] is not False else b["s"]  # an optional text
    both = (lambda x, y: x + y) if pages else max
    out = {
        "l": a["l"], "d": a["d"] or b["d"], "o": a["o"] or b["o"], "r": a["r"] or b["r"], "n": both(a["n"], b["n"]),
        "s": slot, "t": both(a["t"], b["t"]), "w": a["w"] if a["w"] == b["w"] and pages else None, "c": align(a["c"], b["c"], pages),
    }
    if "p" in a or "p" in b:
        out["p"] = sorted({*a.get("p", ()), *b.get("p", ())})[:DIFFERENT]
    return out


def align(a: list[dict], b: list[dict], pages: bool = True) -> list[dict]:
    """Two sequences of children as one: what only one has is optional."""
    left, right = [c["l"] for c in a], [c["l"] for c in b]
    if left == right:
        return [merge(x, y, pages) for x, y in zip(a, b)]
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out += [merge(x, y, pages) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [c | {"o": True} for c in (*a[i:j], *b[k:m])]
    return _join(out)


def _join(children: list[dict]) -> list[dict]:
    """Optional neighbours with one label are one optional child."""
    out: list[dict] = []
    for child in children:
        if out and child["o"] and out[-1]["o"] and out[-1]["l"] == child["l"]:
            out[-1] = merge(out[-1], child, pages=False)  # one page may have both
        else:
            out.append(child)
    return out


def pattern(wrapper: dict) -> str:
    """The wrapper written as a regular expression over tags and text slots (#)."""
    inner = ("#" if wrapper["s"] is not False else "") + "".join(map(pattern, wrapper["c"]))
    body = inner if wrapper["l"] == "()" else f"<{wrapper['l']}>{inner}</>"
    mark = {(True, True): "*", (True, False): "?", (False, True): "+"}.get((wrapper["o"], wrapper["r"]), "")
    return f"({body}){mark}" if mark else body


# --- extraction -------------------------------------------------------------------------


def _entries(element: Element, known: dict | None) -> list[tuple[Element, dict | None]]:
    """The child elements, each with its own entry of the wrapper."""
    children = [c for c in element.children if not isinstance(c, str)]
    found: list[dict | None] = [None] * len(children)
    if known:
        _match(_runs([c.label for c in children]), known["c"], found)
    return list(zip(children, found))


def _match(runs: list[tuple[str, list]], entries: list[dict], found: list[dict | None]) -> None:
    left, right = [e["l"] for e in entries], [r[0] for r in runs]
    blocks = [(0, 0, len(left))] if left == right else SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks()
    for i, k, size in blocks:
        for entry, (label, places) in zip(entries[i : i + size], runs[k : k + size]):
            for place in places:
                if label == "()":
                    _match(place, entry["c"], found)
                else:
                    found[place] = entry


def _region(wrapper: dict, pages: int) -> tuple[int, ...]:
    """Places of the entries from the root to the lowest one with all headings and text that may vary."""
    path: list[int] = []
    while not _own_varies(wrapper, pages):
        inner = [i for i, c in enumerate(wrapper["c"]) if _varies(c, pages)]
        best = wrapper["c"][inner[0]] if len(inner) == 1 else None
        tag = best["l"].split(".")[0] if best else ""
        if best is None or best["r"] or tag in PROSE or tag not in BLOCKS:
            break
        path.append(inner[0])
        wrapper = best
    return tuple(path)


def _own_varies(entry: dict, pages: int) -> bool:
    return entry["s"] is not False and (not pages or entry["s"] is None or entry["t"] < pages)


def _same(entry: dict | None, pages: int) -> bool:
    """Whether an element has the same text, whole, on all `pages` of the host."""
    return bool(pages) and entry is not None and entry["w"] not in (None, False) and not entry["o"] and entry["n"] >= pages


def _varies(entry: dict, pages: int) -> bool:
    if entry["d"]:
        return False
    if HEADING.fullmatch(entry["l"].split(".")[0]):
        return True
    if _same(entry, pages):
        return False
    return _own_varies(entry, pages) or any(_varies(c, pages) for c in entry["c"])


def _needed(element: Element, known: dict | None, pages: int) -> bool:
    """Whether a page's element has a heading or text that is not template."""
    if element.dropped:
        return False
    if HEADING.fullmatch(element.tag):
        return True
    if _same(known, pages) and _whole(element) == known["w"]:
        return False
    if _own_needed(element, known, pages):
        return True
    return any(_needed(c, entry, pages) for c, entry in _entries(element, known))


def _own_needed(element: Element, known: dict | None, pages: int) -> bool:
    has_text = any(isinstance(c, str) and not c.isspace() for c in element.children)
    return has_text and not _steady(element, known, pages)


def _down(element: Element, known: dict, region: tuple[int, ...], pages: int) -> tuple[Element, dict]:
    """The element of the region and its entry; higher up where a page has needed text outside of it."""
    for at in region:
        best, entries = known["c"][at], _entries(element, known)
        inner = [c for c, entry in entries if entry is best and not c.dropped]
        if len(inner) != 1 or _own_needed(element, known, pages):
            break
        if any(_needed(c, entry, pages) for c, entry in entries if c is not inner[0]):
            break
        element, known = inner[0], best
    return element, known


def _articles(element: Element, known: dict | None, tags: tuple[str, ...]) -> list[tuple[Element, dict | None]]:
    """The outermost elements of these tags that are no part of a dropped element, with their entries."""
    found, stack = [], [(element, known)]
    while stack:
        e, known = stack.pop()
        if e.dropped:
            continue
        if e.tag in tags:
            found.append((e, known))
            continue
        stack += reversed(_entries(e, known))
    return found


def _unmark_around_articles(element: Element) -> set[str]:
    """The kinds of article and main elements in an element; names around them count for nothing, but
    those of comments do around an article."""
    if element.dropped and not element.named:
        return set()
    found = set().union(*(_unmark_around_articles(c) for c in element.children if not isinstance(c, str)))
    if element.named and ("main" in found or found and not element.comments):
        element.dropped = element.named = False
    if element.dropped:
        return set()
    return found | {element.tag} if element.tag in ("article", "main") else found


def _unmark_most(parts: list[tuple[Element, dict | None]], pages: int) -> None:
    """Names of elements with most of the text of the parts that is neither template, link nor comment count for nothing."""
    named: list[tuple[Element, int]] = []

    def size(element: Element, known: dict | None) -> int:
        if element.dropped and (not element.named or element.comments) or element.tag == "a":
            return 0
        n = sum(len(c.strip()) for c in element.children if isinstance(c, str)) if _own_needed(element, known, pages) else 0
        n += sum(size(c, entry) for c, entry in _entries(element, known))
        if element.named:
            named.append((element, n))
        return n

    total = sum(size(*part) for part in parts)
    for element, n in named:
        if 2 * n > total:
            element.dropped = element.named = False


def _unmark_titles(article: Element) -> bool:
    """Whether an article holds an h1; names of elements around it count for nothing, but those of comments do."""
    found = article.tag == "h1"
    for child in article.children:
        if not isinstance(child, str) and (not child.dropped or child.named and not child.comments):
            found |= _unmark_titles(child)
    if found and article.named:
        article.dropped = article.named = False
    return found


def _has_named(element: Element) -> bool:
    return element.named or any(_has_named(c) for c in element.children if not isinstance(c, str))


def _template_pages(wrapper: dict | None, least_pages: int) -> int:
    """Number of pages that must have a text that counts as template: all of a host with enough different ones, else 0."""
    return wrapper["n"] if wrapper and len(wrapper.get("p", ())) >= least_pages else 0


def _steady(element: Element, known: dict | None, pages: int) -> bool:
    """Whether all `pages` of the host have the text that stands directly in the element."""
    if not pages or known is None or known["s"] in (None, False) or known["t"] < pages:
        return False
    text = [c for c in element.children if isinstance(c, str) and not c.isspace()]
    return bool(text) and _text_sum(" ".join(text)) == known["s"]


def extract(page: str | None, wrapper: dict | None, least_pages: int = LEAST_PAGES,
            region: tuple[int, ...] | None = None) -> str:
    """The text of the article of a page, one line per block; `region` is that of the wrapper, if known."""
    if not page:
        return ""
    root, pages = parse(page), _template_pages(wrapper, least_pages)
    marked = _has_named(root)
    if marked:
        _unmark_most([(root, wrapper)], pages)
    parts = _articles(root, wrapper, ("article",))
    if not parts:
        # Beside an article, one in an element named as a sidebar or the like is none of the page's own.
        parts = _articles(root, wrapper, ("main",))
        _unmark_around_articles(root)
        parts = parts or _articles(root, wrapper, ("article",)) or _articles(root, wrapper, ("main",))
    if parts and marked:
        _unmark_most(parts, pages)
        for part, _ in parts:
            _unmark_titles(part)
    whole = not parts
    if not parts:
        known = wrapper or expression(root)
        parts = [_down(root, known, _region(known, pages) if region is None else region, pages)]
    lines: list[str] = []
    buffer: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            lines.append(text)

    def walk(element: Element, known: dict | None, title: bool):
        # A title that all articles have, or a heading beside text that varies, is no template; other text of all pages is.
        title = title or bool(HEADING.fullmatch(element.tag)) or not whole and element.tag in TITLES
        steady = not title and _steady(element, known, pages)
        entries = iter(_entries(element, known))
        for child in element.children:
            if isinstance(child, str):
                if not steady:
                    buffer.append(child)
                continue
            child, entry = next(entries)
            if child.dropped or whole and not HEADING.fullmatch(child.tag) and _same(entry, pages) and _whole(child) == entry["w"]:
                if child.tag in BLOCKS or child.tag in RAW:
                    flush()
            elif child.tag == "br":
                buffer.append(" ")
            elif child.tag in BLOCKS:
                flush()
                walk(child, entry, title)
                flush()
            else:
                walk(child, entry, title)

    for element, known in parts:
        walk(element, known, False)
        flush()
    return "\n".join(lines)


# --- Spark ------------------------------------------------------------------------------


def host_of(url):
    """The host of a URL column, lower-cased; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def infer(pages: DataFrame, url: str = "url", payload: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of every host as JSON, from all of its pages."""
    rows = pages.select(host_of(pages[url]).alias("host"), pages[payload].alias("t"))

    def first(batches):
        found: dict[str, str | dict] = {}
        for batch in batches:
            hosts, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, host in enumerate(hosts):
                page = texts[i].as_py()
                if page:
                    one = expression(parse(page))
                    found[host] = merge(found[host], one) if host in found else one
            if len(found) > 1000:
                yield _wrapper_rows(found)
                found = {}
        yield _wrapper_rows(found)

    def again(table: pa.Table) -> pa.Table:
        whole = None
        for text in sorted(table.column("wrapper").to_pylist()):
            one = json.loads(text)
            whole = one if whole is None else merge(whole, one)
        return pa.Table.from_batches([_wrapper_rows({table.column("host")[0].as_py(): whole})])

    fields = "host string, wrapper string"
    part = F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))
    partial = rows.mapInArrow(first, fields).withColumn("part", part).groupBy("host", "part").applyInArrow(again, fields)
    return partial.groupBy("host").applyInArrow(again, fields)


def _wrapper_rows(found: dict[str, dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())],
        names=["host", "wrapper"],
    )


def main_text(pages: DataFrame, wrappers: DataFrame | None = None, key: str = "page_id", url: str = "url",
              payload: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the article of every page by the wrapper of its host."""
    # Written once, so that the join knows the true size of the wrappers.
    wrappers = pin(infer(pages, url, payload), "wrappers") if wrappers is None else wrappers
    rows = pages.select(
        pages[key].cast("long").alias("page_id"), pages[url].alias("url"), pages[payload].alias("t"),
        host_of(pages[url]).alias("host"),
    )
    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "t", "wrapper")

    def apply(batches):
        known: dict[str | None, tuple[dict | None, tuple[int, ...] | None]] = {None: (None, None)}
        for batch in batches:
            texts, wraps, out = batch.column(2), batch.column(3), []
            for i in range(batch.num_rows):
                text = wraps[i].as_py()
                if text is not None and text not in known:
                    if len(known) > 500:
                        known.clear()
                        known[None] = None, None
                    one = json.loads(text)
                    known[text] = one, _region(one, _template_pages(one, LEAST_PAGES))
                wrapper, region = known[text]
                out.append(extract(texts[i].as_py(), wrapper, region=region))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return joined.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
