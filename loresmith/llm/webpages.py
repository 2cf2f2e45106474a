"""Main text of web pages, by structure and by nearest-URL page differencing.

Pages are dealt by ranges of (host, path, page_id), so that a page's neighbours in URL order within
its host stream past next to it, whatever share of all pages one host has; the first and last page
of a range also go to the range beside it, as neighbours only. A page becomes blocks of text,
each marked by the elements around it: page furniture (navigation, headers, footers, sidebars,
notices, adverts, forms, reader comments), article, or neither. Words of a class or id mark furniture only outside
articles, and never an element that holds the page's article; within an article they make a block doubtful. The
blocks of a page and of its nearest pages are aligned by longest common subsequence; shared lines outside an article,
and shared doubtful ones, are the host's template and are deleted. Furniture goes whether shared or not; other lines of
an article stay even when another page repeats them.

Defined cases: a null or empty html has an empty text; null and unparsable URLs form a host of
their own; equal (host, path) stand next to each other in page_id order and a repeated row is a page
of its own; a page whose host has no other page loses nothing by differencing; an empty table
gives no rows; other columns are ignored. Pages at the border of a range have one neighbour.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresmith.llm.store import partitions_for

#: What a block is. DOUBTFUL: its class speaks against it, but it stands in an article.
FURNITURE, PLAIN, ARTICLE, DOUBTFUL = range(4)
#: Elements of HTML by what they do (fixed values).
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template head title nav header footer aside form button select option textarea dialog menu iframe object svg canvas audio video map xmp noembed noframes label input fieldset legend datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption html body option legend".split())
#: Words of class, id and role that mark page furniture, and those that mark an article.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert alerts popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar rail aside widget widgets footer header masthead topbar toolbar comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations newsletter subscribe signup login search pagination pager skip toc tags meta complementary contentinfo disclaimer".split()
)
ARTICLE_WORDS = frozenset("article entry post story main".split())
#: Whole names of a class or id that mean adverts and reader comments within an article too.
NEVER_ARTICLE = frozenset("ad ads advert adverts advertisement advertising sponsored comments commentlist comment-list comments-area reader-comments user-comments disqus disqus_thread newsletter cookie-notice share-buttons".split())
#: Share of a block's characters in links from which a doubtful one is a menu.
LINKED = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_MARKED = re.compile(r"\b(?:class|id|role|hidden|aria-hidden|style)\b", re.I)


def _mark(name: str, attrs: str, level: int) -> tuple[int, bool]:
    """What an element makes of its content (FURNITURE, PLAIN or ARTICLE), and whether its class or id speaks against that."""
    if level == FURNITURE or name in DROPPED:
        return level if name == "header" and level == ARTICLE else FURNITURE, False
    own = ARTICLE if name in ("article", "main") else level
    if not attrs or not _MARKED.search(attrs):
        return own, False
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return FURNITURE, False
    if name in ("body", "html", "article", "main"):
        return own, False
    names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    if level == ARTICLE and not NEVER_ARTICLE.isdisjoint(names.split()):
        return FURNITURE, False
    words = set(_WORD.findall(names))
    if words & FURNITURE_WORDS:
        return own, True
    return ARTICLE if words & ARTICLE_WORDS else own, False


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(mark, text) of every block with text, in page order; white space within a block is one space.

    A class or id that speaks against an element outside articles makes it furniture, unless the page's articles are all
    within such elements: then those that hold one are wrappers. Within an article it makes the blocks doubtful.
    """
    out: list[tuple[int, str, bool, tuple[int, ...]]] = []  # mark, text, mostly links, the elements spoken against that it is in
    parts: list[str] = []
    stack: list[tuple[str, int]] = [("", PLAIN)]
    against: list[tuple[int, int]] = []  # (height on the stack, number) of open elements that are spoken against
    holds: list[bool] = []  # by number: whether an article is in it
    doubts: list[int] = []  # heights of those within an article
    linked = links = 0  # open links; characters in links of the block so far

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _SPACE.sub(" ", raw).strip()
            if text:
                mark = stack[-1][1]
                out.append((DOUBTFUL if doubts and mark == ARTICLE else mark, text, linked >= LINKED * len(raw), tuple(k for _, k in against)))
            parts.clear()
        linked = 0

    def close(to: int) -> None:
        """Close the open elements from ``to`` on."""
        nonlocal links
        while len(stack) > to:
            top = len(stack) - 1
            edge = bool(against and against[-1][0] == top), bool(doubts and doubts[-1] == top)
            if stack[-1][0] in BLOCKS or stack[-1][1] != stack[-2][1] or any(edge):
                flush()
            if edge[0]:
                against.pop()
            if edge[1]:
                doubts.pop()
            if stack.pop()[0] == "a":
                links -= 1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(entities.unescape(page[at:]))
            break
        if m.start() > at:
            text = page[at : m.start()]
            say(entities.unescape(text) if "&" in text else text)
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body", "td", "table") and name not in BLOCKS:
                    break  # a stray inline end tag does not close what holds it
            else:
                if name == "p":
                    flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in same:
                    close(k)
                    if name != "tr":
                        break
                if stack[min(k, len(stack) - 1)][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        level, spoken = _mark(name, m[3], stack[-1][1])
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCKS or level != stack[-1][1] or spoken:
            flush()
        if m[3].endswith("/") and name not in BLOCKS:
            continue
        stack.append((name, level))
        if name == "a":
            links += 1
        if level == ARTICLE and name in ("article", "main"):
            for _, k in against:
                holds[k] = True
        if spoken and level == ARTICLE:
            doubts.append(len(stack) - 1)
        elif spoken and level == PLAIN:
            against.append((len(stack) - 1, len(holds)))
            holds.append(False)
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = end.start() if end else n
    close(1)
    flush()
    wrapped = not any(mark in (ARTICLE, DOUBTFUL) and not inside for mark, _, _, inside in out)
    done = []
    for mark, text, menu, inside in out:
        if any(not (wrapped and holds[k]) for k in inside) or mark == DOUBTFUL and menu:
            mark = FURNITURE
        done.append((mark, text))
    return done


#: Bits of rows kept at once while two pages are aligned; beyond it the longer one is halved first.
ALIGNED_BITS = 200_000_000


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each prefix of a, a number whose bit j is 0 where the longest common subsequence with b[: j + 1] is longer than with b[:j]."""
    full = (1 << len(b)) - 1
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each prefix of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b, in memory bounded by both lengths and ALIGNED_BITS."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > ALIGNED_BITS:
        half = len(a) // 2
        cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    rows, out = list(_rows(a, b)), []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> j - 1 & 1:
                j -= 1
                out.append(i)
    return out[::-1]


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = {*range(lo), *range(len(a) - hi, len(a))}
    either = set(a[lo : len(a) - hi]) & set(b[lo : len(b) - hi])
    number = {line: k for k, line in enumerate(either)}
    x = [i for i in range(lo, len(a) - hi) if a[i] in either]
    y = [number[line] for line in b[lo : len(b) - hi] if line in either]
    out.update(x[i] for i in _aligned([number[a[i]] for i in x], y))
    return out


def main_text(blocks: list[tuple[int, str]], near: list[list[tuple[int, str]]]) -> tuple[str, int, int]:
    """The text of a page, given the blocks of the pages nearest to it by URL, how many of its lines they share, and how many go for that."""
    lines = [t for _, t in blocks]
    shared: set[int] = set()
    for other in near:
        shared |= common(lines, [t for _, t in other])
    cut = {i for i in shared if blocks[i][0] in (PLAIN, DOUBTFUL)}
    return "\n".join(t for i, (mark, t) in enumerate(blocks) if mark != FURNITURE and i not in cut), len(shared), len(cut)


KEY = ["host", "path", "page_id"]
#: Ranges to a partition; stored bytes of pages to a partition, and partitions at most (the driver meets 100 keys for each range).
RANGES, PARTITION_BYTES, MOST_PARTITIONS = 2, 8_000_000, 10_000
TEXTS = "page_id long, url string, text string, n_chars long, n_lines long, n_shared long, n_cut long, n_near long"
_LEAST = -(1 << 63)


def range_ends(keys: DataFrame, n: int) -> list[tuple[tuple, tuple]]:
    """First and last key of up to n ranges of about equal size, in order: two keys a range."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            if b.num_rows:
                first = first or b.slice(0, 1).to_pylist()[0]
                last = b.slice(b.num_rows - 1, 1).to_pylist()[0]
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([first[k], last[k]]) for k in KEY], names=KEY)

    kind = "host string, path string, page_id long"
    rows = keys.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).mapInArrow(ends, kind).collect()
    flat = sorted(tuple(r) for r in rows)
    return list(zip(flat[::2], flat[1::2], strict=True))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    n_lines, n_shared, n_cut, n_near: lines of the page, those that a neighbour shares, those deleted for that, and neighbours compared.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    number = F.col("page_id").cast("long")
    keyed = pages.select(F.coalesce(number, F.lit(_LEAST)).alias("page_id"), number.alias("own_id"), "url", "html", host.alias("host"), path.alias("path"))
    n = partitions_for(pages, PARTITION_BYTES, MOST_PARTITIONS)
    ends = range_ends(keyed.select(*KEY), RANGES * n)  # several to a partition, so that partitions are alike
    firsts, lasts = [a for a, _ in ends], [b for _, b in ends]

    @F.pandas_udf("array<int>")
    def place(host: pd.Series, path: pd.Series, page_id: pd.Series) -> pd.Series:
        """2 * range, and 2 * range + 1 for a range that the page is a neighbour to."""
        out = []
        for key in zip(host, path, page_id, strict=True):
            k = max(0, bisect.bisect_right(firsts, key) - 1)
            to = [2 * k]
            if key == lasts[k] and k + 1 < len(firsts):
                to.append(2 * (k + 1) + 1)
            if key == firsts[k] and k:
                to.append(2 * (k - 1) + 1)
            out.append(to)
        return pd.Series(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in (0, 1)), (h.as_py() for h in b.column(2)), *(b.column(i).to_pylist() for i in (3, 4)), strict=True)

        def result(page, before, after):
            near = [q[2] for q in (before, after) if q is not None and q[3] == page[3]]
            text, shared, cut = main_text(page[2], near)
            return page[0], page[1], text, len(text), len(page[2]), shared, cut, len(near)

        def send(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = (pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in TEXTS.split(", ")])

        before = page = None
        out, held = [], 0
        for page_id, url, html, host, to in rows():
            after = (page_id, url, blocks_of(html or ""), (to // 2, host), to % 2)
            if page is not None and not page[4]:
                out.append(result(page, before, after))
                held += out[-1][3]
                if len(out) >= 2000 or held > 4_000_000:
                    yield send(out)
                    out, held = [], 0
            before, page = page, after
        if page is not None and not page[4]:
            out.append(result(page, before, None))
        yield send(out)

    dealt = keyed.withColumn("to", F.explode(place("host", "path", "page_id"))).withColumn("range", F.expr("to div 2").cast("int"))
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", *KEY, "to")
    return dealt.select("own_id", "url", "html", "host", "to").mapInArrow(run, TEXTS)


def op10_html_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_html_page_differencing": op10_html_page_differencing}
ORACLES: dict[str, str] = {}
