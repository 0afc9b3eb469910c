"""The main text of web pages, by line-block distribution.

A page is cut into lines at the tags that begin or end a block; markup, scripts and styles are stripped, and lines of
menus, headers, footers, sidebars, notices, adverts, forms and reader comments (known by their elements, roles and names
of classes) are emptied. A line weighs its letters outside links. Weights are summed over sliding windows of lines: where
the sum surges, text begins; where it dives to nothing, it ends. Between a surge and the next dive everything that isn't
emptied is kept. Where a page marks its article or main part, lines elsewhere weigh nothing and every rise is a surge.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window. Blocks next to each other have one empty line between them, a list or quotation two, parts of a page three or more.
WINDOW = 3
#: A window surges with this share of the page's fullest window.
SURGE = 0.2
#: Empty lines that an emptied element leaves, so that windows don't reach over it.
GAP = WINDOW

#: Elements and words of the HTML standard and of common page templates.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp template svg math object select noframes".split())
SPACES = frozenset("br td th caption".split())
DROPPED = frozenset("nav footer aside form menu dialog button head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"html", "body", "option", "legend"}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
ALWAYS_ARTICLE = frozenset("comment comments reply replies ad ads advert related promo sponsored".split())
NOT_AFTER = frozenset("has with no non without show article entry post content main page".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*>?|<![^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']|["'])*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of a text, as far as its own tag tells."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    known = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in known or known.get("aria-hidden", "").lower() == "true" or HIDDEN.search(known.get("style", "")):
        return True
    if known.get("role", "").lower() in ROLES:
        return True
    names = ALWAYS_ARTICLE if tag in ("article", "main") or tag in HEADINGS else NAMES
    for name in f"{known.get('class', '')} {known.get('id', '')}".split():
        before = ""
        for word in map(str.lower, WORDS.findall(name)):
            if word in names and before not in NOT_AFTER and not (in_article and word in ("header", "banner")):
                return True
            before = word
    return False


class Line:
    """Some text of a block; weight: its characters but white space, without those in links. An empty line has no parts."""

    __slots__ = ("parts", "weight", "article")

    def __init__(self, article: bool):
        self.parts, self.weight, self.article = [], 0, article

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def lines_of(html: str) -> list[Line]:
    """The lines of a page; what is no part of a text leaves GAP empty ones."""
    out = [Line(False)]
    stack: list[tuple[str, bool, bool]] = []  # (tag, within boilerplate, within an article)
    links, pos = 0, 0

    def close(at: int) -> None:
        nonlocal links
        for tag, dropped, article in reversed(stack[at:]):
            links -= tag == "a"
        gone = stack[at][1] and not (at and stack[at - 1][1])
        del stack[at:]
        out.extend(Line(bool(stack) and stack[-1][2]) for _ in range(GAP if gone else 0))

    def put(text: str) -> None:
        if not text or stack and stack[-1][1]:
            return
        text = unescape(text) if "&" in text else text
        if text.isspace() and not out[-1].parts:
            return
        out[-1].parts.append(text)
        if not links or any(tag in HEADINGS for tag, _, _ in stack):
            out[-1].weight += len(text) - sum(map(text.count, " \t\n\r\f"))

    while (m := TOKEN.search(html, pos)) is not None:
        put(html[pos : m.start()])
        pos, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in SPACES:
            put(" ")
        if m[1]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag or tag not in BLOCKS and stack[k][0] in BLOCKS), -1)
            if at >= 0 and stack[at][0] == tag:
                close(at)
            if tag in BLOCKS:
                out.append(Line(bool(stack) and stack[-1][2]))
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, pos)
            pos = end.end() if end else len(html)
            pos = html.find(">", pos) + 1 or len(html)
            put(" ")
            continue
        if tag in CLOSES_P or tag == "li":
            inner = "li" if tag == "li" else "p"
            outer = BLOCKS - {"p"} if inner == "p" else {"ul", "ol", "menu", "dir"}
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == inner or stack[k][0] in outer), -1)
            if at >= 0 and stack[at][0] == inner:
                close(at)
        article = bool(stack) and stack[-1][2]
        dropped = bool(stack) and stack[-1][1]
        if dropped and tag in ("article", "main"):  # a form may hold the whole page
            dropped = any(s[1] and s[0] != "form" and not (k and stack[k - 1][1]) for k, s in enumerate(stack))
        dropped = dropped or is_boilerplate(tag, m[3], article)
        article = article or not dropped and (tag in ("article", "main") or 'role="main"' in m[3])
        if tag in BLOCKS:
            out.append(Line(article))
        if tag not in VOID and not m[0].endswith("/>"):
            stack.append((tag, dropped, article))
            links += tag == "a"
    put(html[pos:])
    return out


def stretches(weights: list[int], window: int = WINDOW, surge: float = SURGE) -> list[tuple[int, int]]:
    """[from, to) of the lines between each surge and the next dive.

    The sum at a line is that of the window that begins there. Lines belong together until a window's sum is nothing;
    they are a text if a sum among them surges, that is, reaches the share of the greatest one."""
    total, running = [0], 0
    for w in weights:
        running += w
        total.append(running)
    n = len(weights)
    sums = [total[min(n, k + window)] - total[k] for k in range(n)]
    least = max(sums, default=0) * surge
    out, begin = [], None
    for k in range(n + 1):
        if k < n and sums[k]:
            begin = k if begin is None else begin
        elif begin is not None:
            if max(sums[begin:k]) >= least:
                held = [i for i in range(begin, k) if weights[i]]
                out.append((held[0], held[-1] + 1))
            begin = None
    return out


def main_text(html: str, window: int = WINDOW, surge: float = SURGE) -> str:
    """The text of a page's article: a line for each block, white space as single spaces."""
    lines = lines_of(html)
    weights = [line.weight for line in lines]
    if any(line.article and line.weight for line in lines):  # within what is marked, any rise from nothing is a surge
        weights, surge = [line.weight * line.article for line in lines], 0.0
    return "\n".join(filter(None, (line.text() for a, b in stretches(weights, window, surge) for line in lines[a:b])))


def extract_batches(batches: Iterator[pa.RecordBatch], window: int, surge: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page or "", window, surge) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame, window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    A null or empty html, and a page without any text outside its boilerplate, gives an empty text; null ids and urls stay
    null, repeated rows each get a row, other columns are not looked at. Pages are read whole; markup that isn't closed
    ends with its parent. No-break spaces count as white space. <br> and table cells part words, not blocks."""
    kinds = dict(pages.dtypes)
    found = pages.select("page_id", "url", "html").mapInArrow(lambda batches: extract_batches(batches, window, surge), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
