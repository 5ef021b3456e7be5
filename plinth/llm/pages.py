"""Main text of web pages by differencing each page with its nearest URL, and by what its markup says.

A page is cut into lines, one per block. It is compared with the page whose URL path is nearest on the
same host: the lines of both are aligned by their longest common subsequence, and shared lines go, as
they belong to the site; but not those inside an article or main element, since passages that articles
share are text. Pages of a host with equal lines are one page in this, so that no copy is compared with
itself. Where a neighbour shares nearly all lines that may go, it may be a near copy, and only those go
that the neighbour on the other side shares too.

Differencing can't know menus, adverts, notices and reader comments that no other page has, so what the
markup says is left out, too: script and style, the elements and roles of navigation, footers, adverts
and forms, and elements whose class or id is wholly made of known words (``ad``, ``cookie-notice``,
``site-footer``; not ``has-sidebar``). Names and forms don't count for an element that holds more than
half of the page's text while no article is outside it.

Distinct pages are ordered by (host, path) over range partitions, so one host may hold any part of all
pages; only hashes of lines meet their neighbour, and only numbers of lines that the markup leaves go
back to the pages. Defined cases: a null html is an empty text; a null url is a host of its own; repeated
rows are each extracted; of pages with equal lines the least path stands for all, and equal paths are
ordered by a hash of the lines; pages of any length are handled whole; an empty table gives no rows;
other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COPY = 0.8  # a neighbour that shares more of a page's open lines may be a copy of it

# Fixed values of HTML: how elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea math canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
LEFT_OUT = frozenset("nav aside footer dialog menu head select button".split())
ASKS = frozenset("form fieldset".split())
OWN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
# Words that name parts which are no main text, and words that may stand beside them in a name.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup paywall sidebar rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist "
    "disqus respond reply replies share sharing social related recommended recommendations pagination pager login search skip copyright".split()
)
BESIDE = frozenset("a area article bar block bottom box button buttons container form global inner item items left link links list main page policy post posts primary reader right secondary section site slot thread to top unit user wrapper".split())

_tag = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_attribute = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_words = re.compile(r"[a-z0-9]+")
_hidden = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _named(value: str) -> bool:
    """Whether a class or id has a token that is made of known words only."""
    for token in value.split():
        words = _words.findall(token)
        if any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def _mark(name: str, attributes: str, inside: bool) -> str:
    """What the markup says of an element: "out", "maybe" (unless it holds most of the text), or nothing."""
    if name in LEFT_OUT or (name == "header" and not inside):
        return "out"
    found = "maybe" if name in ASKS else ""
    if not attributes or attributes.isspace():
        return found
    low = attributes.lower()
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", low):
        return "out"
    for key, value in _attribute.findall(low):
        value = value.strip("\"'")
        if key in ("class", "id") and name not in ("html", "body") and not (inside and name in INLINE) and _named(value):
            found = "maybe"
        elif key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and _hidden.search(value):
            return "out"
    return found


def all_lines(html: str | None) -> list[tuple[str, bool, bool]]:
    """The page's lines in order: (text, inside an article, left out by the markup)."""
    found: list[tuple[str, bool, bool, tuple]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool, tuple]] = []  # open elements: name, left out, inside an article, numbers of doubtful ones
    html = html or ""
    skip = inside = False
    doubts: tuple = ()
    doubtful = 0
    at, end = 0, len(html)

    def flush() -> None:
        if text:
            if line := " ".join(unescape("".join(text)).split()):
                found.append((line, inside, skip, doubts))
            text.clear()

    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            begin = end
        if begin > at:
            text.append(html[at:begin])
        if begin == end:
            break
        tag = _tag.match(html, begin)
        if not tag:
            text.append("<")
            at = begin + 1
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if not tag[1]:
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
                if name == "noscript" and not close:
                    continue
                at = close.start() if close else end
                stop = html.find(">", at)
                at = stop + 1 if close and stop >= 0 else end
                continue
            if name == "br":
                text.append(" ")
                continue
            mark = _mark(name, tag[3], inside)
            if name in INLINE and not mark:
                continue
            if name in ("td", "th"):
                text.append(" ")
            else:
                flush()
            if name in VOID or tag[3].endswith("/") and name in INLINE:
                continue
            if name not in INLINE:  # a block ends an open paragraph, a like item the one before
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "tr", "td", "th", "dt", "dd", "option"):
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            _, skip, inside, doubts = stack[-1] if stack else ("", False, False, ())
            if mark == "maybe":
                doubts, doubtful = (*doubts, doubtful), doubtful + 1
            stack.append((name, skip or mark == "out", inside or name in OWN, doubts))
        else:
            known = any(x[0] == name for x in stack)
            if name in INLINE and not known:
                continue
            if name not in ("td", "th"):
                flush()
            if known:
                while stack.pop()[0] != name:
                    pass
        _, skip, inside, doubts = stack[-1] if stack else ("", False, False, ())
    flush()
    if not doubtful:
        return [x[:3] for x in found]
    size, own = [0] * doubtful, [0] * doubtful  # text and lines of articles in each doubtful element
    for line, article, out, within in found:
        for k in within if not out else ():
            size[k] += len(line)
            own[k] += article
    total, articles = sum(len(x[0]) for x in found if not x[2]), sum(x[1] for x in found if not x[2])
    drops = {k for k in range(doubtful) if 2 * size[k] <= total or own[k] < articles}
    return [(line, article, out or not drops.isdisjoint(within)) for line, article, out, within in found]


def lines_of(html: str | None) -> list[tuple[str, bool]]:
    """The lines that the markup leaves, in order: (text, inside an article)."""
    return [(line, own) for line, own, out in all_lines(html) if not out]


def key(line: str) -> int:
    return (xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) ^ (1 << 63)) - (1 << 63)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b."""
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []  # least end in b of a common subsequence of each length
    last: list[tuple] = []  # its last pair, with the one before
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            elif j < ends[k]:
                ends[k] = j
                last[k] = link
    out = []
    link = last[-1] if last else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def place_of(url: str | None) -> tuple[str, str]:
    """Host, without a leading www., and path."""
    try:
        parts = urlsplit(url or "")
        host = (parts.netloc or "").lower().rpartition("@")[2]
    except ValueError:
        return "", url or ""
    return host.removeprefix("www."), parts.path.rstrip("/") or "/"


def _nearness(a: str, b: str) -> int:
    """Path segments in common from the start, then characters."""
    x, y = a.split("/"), b.split("/")
    n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    c = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return n * 10_000 + min(c, 9_999)


def site_lines(pages: DataFrame, row: str, marked: bool = False) -> DataFrame:
    """Rows (row, lines): numbers of the lines that a page shares with its nearest neighbour, outside an article.

    pages: columns row (long), url, html. Only pages with such lines are listed. Lines that the markup
    leaves out anyway are compared, but listed only with ``marked``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, same, keys, open_ = [], [], [], [], []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, p = place_of(url)
                found = all_lines(html)
                host.append(h)
                path.append(p)
                keys.append([key(x) for x, _, _ in found])
                open_.append([i for i, (_, own, out) in enumerate(found) if not own and (marked or not out)])
                same.append((xxhash.xxh3_64_intdigest(repr((keys[-1], open_[-1]))) ^ (1 << 63)) - (1 << 63))
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(same, pa.int64()), pa.array(keys, longs), pa.array(open_, longs)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "host", "path", "same", "keys", "open"])

    narrow = common.arrow_map(pages.select(row, "url", "html"), read, "row long, host string, path string, same long, keys array<long>, open array<long>")
    narrow = common.stash(narrow, "page-lines")
    distinct = narrow.groupBy("host", "same").agg(F.min("path").alias("path"), F.first("keys").alias("keys"), F.first("open").alias("open"))
    order = common.in_order(distinct, ["host", "path", "same"], "pages")
    near = common.neighbours(order, ["host", "path", "same"], ["host", "path", "keys"]).where(F.size("open") > 0).select("host", "same", "path", "keys", "open", "prev", "next")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, same, gone = [], [], []
            for r in batch.to_pylist():
                beside = [x for x in (r["prev"], r["next"]) if x and x["host"] == r["host"]]
                beside.sort(key=lambda x: -_nearness(x["path"], r["path"]))
                open_ = set(r["open"])
                found = [[i for i in common_lines(r["keys"], x["keys"]) if i in open_] for x in beside]
                shared = found[0] if found else []
                if len(shared) > COPY * len(open_):
                    other = set(found[1]) if len(found) > 1 else set()  # a near copy, or mostly the site's text: the other one tells
                    shared = [i for i in shared if i in other]
                if shared:
                    hosts.append(r["host"])
                    same.append(r["same"])
                    gone.append(shared)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(same, pa.int64()), pa.array(gone, pa.list_(pa.int64()))], names=["h", "s", "lines"])

    found = common.arrow_map(near, compare, "h string, s long, lines array<long>")
    return narrow.join(found, (F.col("host") == F.col("h")) & (F.col("same") == F.col("s"))).select("row", "lines").dropDuplicates(["row"])


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars): each page's main text, blocks joined by two line feeds."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(F.xxhash64("page_id", "url", "html").alias("row"), "page_id", "url", "html")
    # stored, so that Spark knows its size: it travels to the pages where it is small, else both are shuffled
    gone = common.stash(site_lines(rows, "row").select(F.col("row").alias("of"), "lines"), "site-lines")
    joined = rows.join(gone, F.col("row") == F.col("of"), "left").select("page_id", "url", "html", "lines")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, drop in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                off = set(drop or ())
                texts.append("\n\n".join([x for i, (x, _, out) in enumerate(all_lines(html)) if not out and i not in off]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return common.arrow_map(joined, cut, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
