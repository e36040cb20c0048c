"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page; block tags without text between them
leave empty lines, containers around bare text one more. A line weighs its characters outside links. Weights
are summed over sliding windows of ``WINDOW`` lines; a surge is where the sum passes ``SURGE``, or ``PEAK`` of the
page's highest sum where that is more, a dive where it returns to zero, and the text of every stretch that surges
before it dives is kept. A stretch of headings alone goes with the stretch that follows it, and a short stretch
between two kept ones stays.

Structure only shapes the lines and their weights. Elements that HTML or the page itself declares to be no content
(menus, forms, scripts, asides, footers, hidden parts) are left out. Text whose class or id names adverts,
comments, sidebars and the like weighs ``FAINT`` of its characters, and ``WEAK`` of them where the name is a weaker hint
(notice, share, tags, ...): such parts have stretches of their own, which surge if they are long enough. If an
article or main element holds at least ``TRUST`` of a page's weight, its lines that no name tells against weigh ``MARK`` times and those outside
1 / ``MARK`` of their characters, and empty lines inside count as one, however its parts are nested; otherwise, as with
teasers in article elements, it counts for nothing. If nothing surges, the stretch with most weight (without
any, most characters) that no name tells against is the text.

Null, empty and text-less pages give an empty string. Unclosed or crossed tags end at the next
structural tag, so a broken page gives what can be read of it. Time and memory are linear in a page's length,
however long it is. Stretches of equal weight: the first. Repeated rows give repeated rows, an empty table
none, and further columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from biblens.llm.common import pick

#: Lines in a window of the distribution, and the empty lines that a removed part leaves.
WINDOW = 2
#: Weight of a window above which a stretch is text of the page, and that weight as a share of the page's highest.
SURGE, PEAK = 100, 1 / 32
#: Share of a page's weight from which on its article or main elements are trusted, and what they count then.
TRUST, MARK = 1 / 3, 4
#: Weight of text under a weak hint, and under a name of what is no content.
WEAK, FAINT = 1 / 4, 1 / 16

# Fixed values of HTML: elements without content of their own, and elements that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
# Parts that are not content, by element and by role, and words of class and id that tell against a part.
DROP = frozenset("head nav aside footer form button select menu dialog fieldset svg object audio video canvas".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored promo "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs topbar toolbar masthead footer "
    "sidebar cookie cookies consent gdpr popup modal newsletter signup login comment comments respond replies disqus "
    "pagination pager".split()
)
#: Words of class and id that only hint at it.
WEAK_WORDS = frozenset(
    "banner promotion header aside rail notice notices notification alert overlay subscribe subscription share sharing social reply "
    "related recommended widget search skip hidden tags".split()
)
CONTAINERS = frozenset("article aside blockquote body center details div dl fieldset figure footer form header html main nav ol section table td ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: inside an article only a whole class or id that is such a word tells against them, not a part of one.
PROSE = frozenset("p li blockquote pre dd dt td th figcaption".split())
KEEP_TAGS = frozenset("html body main article".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
OPEN = re.compile(r"<[A-Za-z/!?]")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE = re.compile(r"\s+")


def noise(tag: str, attributes: str, inside: bool) -> float:
    """Weight of an element's text: 0 if HTML tells that it is no content, ``FAINT`` or ``WEAK`` if names do, else 1. A header inside the article is its heading."""
    if tag in KEEP_TAGS:
        return 1
    if tag in DROP or (tag == "header" and not inside):
        return 0
    out = 1.0
    if not attributes or tag in HEADINGS:
        return out
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0
        if name == "role" and value.lower() in DROP_ROLES:
            return 0
        if name in ("class", "id"):
            words = {w.lower() for w in (value.split() if inside and tag in PROSE else WORDS.findall(value))}
            named = words & {"article", "content", "main", "body", "post", "entry"}
            if words & DROP_WORDS and not (named and not words & {"comment", "comments", "sidebar", "nav", "footer", "ad", "ads"}):
                out = FAINT
            elif words & WEAK_WORDS and not named:
                out = min(out, WEAK)
    return out


class Line:
    """A line of a page: its text, characters outside links, where it stands, and whether something was removed there."""

    __slots__ = ("text", "plain", "inside", "share", "heading", "gap")

    def __init__(self, text: str, plain: int, inside: bool, share: float, heading: bool, gap: bool = False):
        self.text, self.plain, self.inside, self.share, self.heading, self.gap = text, plain, inside, share, heading, gap


def page_lines(page: str) -> list[Line]:
    """The lines of a page."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = depth = 0  # characters of link text in the line; open article or main elements
    link = heading = False
    skip: str | None = None  # the element being dropped, and how many of its name are open
    opened = 0
    named: list[tuple[str, float]] = []  # open elements that names tell against, those of the same tags inside them, and the least weight so far
    unclosed: set[str] = set()  # raw elements that no end tag follows any more
    at, size, last = 0, len(page), page.rfind(">")

    def flush(empty: bool = False) -> None:
        nonlocal linked, heading
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text or empty:
            lines.append(Line(text, max(0, len(text) - linked), depth > 0, named[-1][1] if named else 1.0, heading))
        parts.clear()
        linked, heading = 0, False

    def gap() -> None:
        flush()
        lines.extend(Line("", 0, depth > 0, 1.0, False, True) for _ in range(WINDOW))

    while at < size:
        m = TOKEN.search(page, at) if at <= last else None
        end = m.start() if m else size
        if skip is None and end > at:
            broken = None if m else OPEN.search(page, at)  # a tag that never ends takes the rest
            text = page[at : broken.start() if broken else end]
            parts.append(text)
            if link:
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW and not closing:
            stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if stop:
                at = stop.end()
            else:
                unclosed.add(tag)
                after = page.find("<", at)
                at = after if after >= 0 else size
            continue
        if skip is not None:
            if tag in ("article", "main") and not closing and skip not in ("article", "main"):
                skip = None  # what was dropped was never closed
            elif tag == "body" and skip == "head":
                skip = None
                continue
            elif skip in ("p", "li") and ((tag in BLOCK and not closing and tag != "br") or (closing and tag in ("ul", "ol", "div", "article", "main", "section"))):
                skip = None
            elif tag == skip:
                opened += -1 if closing else 1
                if opened <= 0:
                    skip = None
                continue
            elif closing and tag in ("article", "main", "body", "html"):
                skip = None
            else:
                continue
        share = 1.0 if closing or tag in VOID else noise(tag, attributes, depth > 0)
        if share == 0:
            gap()
            if not attributes.rstrip().endswith("/"):
                skip, opened = tag, 1
            continue
        if tag == "a":
            link = not closing
        if tag in BLOCK:
            bare = tag in CONTAINERS and any(x and not x.isspace() for x in parts)
            flush(empty=True)
            if bare:
                flush(empty=True)
            link = False
            heading = tag in HEADINGS and not closing
            if tag in ("article", "main"):
                named.clear()
                if depth == 0:
                    gap()
                depth = max(0, depth + (-1 if closing else 1))
                if closing and depth == 0:
                    gap()
            elif named and named[-1][0] in ("p", "li") and (tag != "br" if not closing else tag in CONTAINERS):
                closed = named.pop()[0] == tag and closing  # an open paragraph or item ends here
                if not named:
                    gap()
                if closed:
                    continue
        if closing and named and tag == named[-1][0]:
            named.pop()
            if not named:
                gap()
        elif not closing and tag not in VOID and (share < 1 or (named and tag == named[-1][0] and tag != "p" and tag != "li")):
            if not named:
                gap()
            named.append((tag, min(share, named[-1][1] if named else 1.0)))
    flush()
    return lines


def trusted(lines: list[Line]) -> bool:
    """Whether the page's article or main elements hold enough of its weight."""
    marked = sum(n.plain * n.share for n in lines if n.inside)
    return marked > 0 and marked >= TRUST * sum(n.plain * n.share for n in lines)


def weights(lines: list[Line], marked: bool) -> list[float]:
    """What each line counts in the distribution."""
    if not marked:
        return [n.plain * n.share for n in lines]
    return [n.plain * (n.share if n.share < 1 else MARK) if n.inside else n.plain * n.share / MARK for n in lines]


def stretches(weight: list[float], window: int = WINDOW) -> list[tuple[int, int, float]]:
    """Ranges of lines from where the windowed sum of weights rises to where it dives to zero, and its maximum there."""
    n, out = len(weight), []
    last = -window  # the last line with weight
    for i in range(n):
        if weight[i] > 0:
            if i - last > window or not out:
                out.append([i, i + 1, 0.0])
            out[-1][1] = i + 1
            last = i
    total = 0.0
    sums = []
    for i in range(n):  # of the lines i - window + 1 to i
        total = sum(weight[max(0, i - window + 1) : i + 1])
        sums.append(total)
    return [(a, b, max(sums[a:b])) for a, b, _ in out]


def kept_lines(lines: list[Line], window: int = WINDOW, surge: float = SURGE) -> list[bool]:
    """Which lines the distribution keeps: parts that names tell against are a distribution of their own."""
    marked = trusted(lines)
    weight = weights(lines, marked)
    plain, named = [], []
    for i, n in enumerate(lines):
        if n.share < 1 or n.gap:
            named.append(i)
        if n.share == 1 and not (marked and n.inside and not n.text and (n.gap or (plain and lines[plain[-1]].inside and not lines[plain[-1]].text))):
            plain.append(i)
    found = stretches([weight[i] for i in plain], window)
    apart = stretches([weight[i] for i in named], window)
    level = max(surge, PEAK * max((high for *_, high in [*found, *apart]), default=0))
    out = [False] * len(lines)
    for a, b, high in apart:
        if high > level:
            for i in named[a:b]:
                out[i] = True
    if not found:
        weight = [float(len(n.text)) for n in lines]
        found = stretches([weight[i] for i in plain], window)
    keep = [high > level for *_, high in found]
    if found and not any(keep) and not any(out):
        totals = [sum(weight[i] for i in plain[a:b]) for a, b, _ in found]
        keep[totals.index(max(totals))] = True
    touching = [all(not lines[i].text and not lines[i].gap for i in plain[x[1] : y[0]]) for x, y in zip(found, found[1:], strict=False)]
    titles = [all(lines[i].heading or not lines[i].text for i in plain[a:b]) for a, b, _ in found]
    for i in reversed(range(len(found) - 1)):  # headings go with what follows
        keep[i] = keep[i] or (titles[i] and touching[i] and keep[i + 1])
    for i in range(1, len(found) - 1):  # short ones between two kept ones
        if not keep[i] and keep[i - 1] and touching[i - 1] and touching[i]:
            j = i + 1
            while j < len(found) - 1 and not keep[j] and touching[j]:
                j += 1
            if keep[j]:
                keep[i] = True
    for (a, b, _), k in zip(found, keep, strict=True):
        if k:
            for i in plain[a:b]:
                out[i] = True
    return out


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The main text of one page; empty if it has none."""
    lines = page_lines(page) if page else []
    return " ".join(n.text for n, k in zip(lines, kept_lines(lines, window, surge), strict=True) if k and n.text)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row, in place: one narrow pass, no shuffle.

    A null page counts as empty and gives an empty text of length 0; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
