"""Main text of web pages: lines shared with the neighbouring page of a host are template and go; so does marked-up chrome."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text.
RAW = frozenset("script style noscript template textarea iframe object svg canvas audio video select".split())
#: Elements that are never part of an article.
CHROME = frozenset("nav header footer aside form head menu dialog button search".split())
#: Words of class, id and role that name such parts.
CHROME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|consent|disqus|footer|form|gdpr|header|"
    r"login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|related|replies|reply|respond|search|share|"
    r"sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Elements that hold the article; a heading block inside stays even where it is called a header.
ROOTS = frozenset(("article", "main"))
#: Articles that share so much of their characters are copies of each other.
COPY = 0.75
#: Pages without an article that share so much of their characters outside of chrome are copies of each other.
BARE_COPY = 0.9
#: A tag without its ">": nothing in it is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that a new one of these closes, as far as the nearest of the second set.
_CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_FENCE = frozenset("ul ol dl table article section div main body aside nav footer header form blockquote".split())


def lines(page: str | None) -> list[tuple[str, int]]:
    """Blocks of text in page order, each with a mark: 0 outside an article, 1 inside, 2 in chrome.

    Runs of white space are one space, references are decoded, empty blocks are left out. A tag with a quote that is never
    closed ends at the first ">", and a "<" with no ">" behind it is text."""
    page = page or ""
    last = page.rfind(">")
    opened: Counter[str] = Counter()
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    text: list[str] = []

    def close() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, stack[-1][1]))
            text.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None or m[2] is not None and m.start() > last:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at, name, attributes = m.end(), m[2], m[3]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if not page.startswith(">", at):
            at = page.index(">", m.end(2))
            attributes = page[m.end(2) : at]
        at += 1
        name = name.lower()
        if m[1]:
            if opened[name]:
                if name in BLOCKS or name in CHROME:
                    close()
                while True:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == name:
                        break
            elif name in BLOCKS:
                close()
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            text.append(" ")
        if name in BLOCKS or name in CHROME:
            close()
            closed_by = [x for x in _CLOSED_BY.get(name, ()) if opened[x]]
            for k in range(len(stack) - 1, 0, -1) if closed_by else ():
                if stack[k][0] in closed_by:
                    opened.subtract(x[0] for x in stack[k:])
                    del stack[k:]
                    break
                if stack[k][0] in _FENCE:
                    break
        if name in VOID or attributes.endswith("/"):
            continue
        mark = stack[-1][1]
        if mark < 2:
            words = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes else ""
            if name in CHROME and not (name == "header" and mark == 1) or words and name not in ("html", "body", *ROOTS) and CHROME_WORDS.search(words):
                mark = 2
            elif name in ROOTS:
                mark = 1
        stack.append((name, mark))
        opened[name] += 1
    close()
    return out


def _rows(a: list[int], b: list[int], keep: bool) -> tuple[list[int], int]:
    """Bit-parallel LCS table rows (Hyyro, 2004): in row i, bit j is 0 where the length grows at b[j]."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows, v


def _prefix_lengths(v: int, m: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(v.to_bytes((m + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared(a: list[int], b: list[int], cells: int = 1 << 24) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``. Large tables are halved (Hirschberg), so memory stays linear."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    head, tail = list(range(lo)), list(range(len(a) - hi, len(a)))
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return head + tail
    if len(a) * len(b) <= cells or len(a) == 1:
        rows, _ = _rows(a, b, True)
        found, j = [], len(b)
        for i in range(len(a), 0, -1):
            grown = ~rows[i] & ((1 << j) - 1)  # places below j where row i grows
            before = ~rows[i - 1] & ((1 << j) - 1)
            if grown.bit_count() > before.bit_count():
                found.append(i - 1)
                j = _back(b, a[i - 1], before, grown.bit_count(), j)
        return head + [lo + i for i in reversed(found)] + tail
    half = len(a) // 2
    left = _prefix_lengths(_rows(a[:half], b, False)[1], len(b))
    right = _prefix_lengths(_rows(a[half:][::-1], b[::-1], False)[1], len(b))[::-1]
    cut = int(np.argmax(left + right))
    found = shared(a[:half], b[:cut], cells) + [half + i for i in shared(a[half:], b[cut:], cells)]
    return head + [lo + i for i in found] + tail


def _back(b: list[int], x: int, before: int, length: int, j: int) -> int:
    """The last place below ``j`` that matches ``x`` with ``length - 1`` matches of the row before in front of it."""
    for k in range(j - 1, -1, -1):
        if b[k] == x and (before & ((1 << k) - 1)).bit_count() == length - 1:
            return k
    raise AssertionError


def _size(page: list[tuple[str, int]], inside: int = 1) -> int:
    """Characters inside an article, or of the blocks with another mark."""
    return sum(len(x) for x, mark in page if mark == inside)


def main_text(page: list[tuple[str, int]], neighbours: list[list[tuple[str, int]]]) -> str:
    """Lines of the page without those it shares, in order, with two line ends between.

    What a longest common subsequence with a neighbour holds is deleted as template. Inside an article a shared line comes
    back as quoted only if a neighbour speaks for that: the article on the other side lacks the line, or each one that holds
    it is nearly the same (:data:`COPY` of the characters of the longer one), so that nothing can be told from it.
    Of the lines that differ, those in chrome go, and on a page with an article those outside of it. On a page without an
    article a neighbour that is nearly the same outside of chrome (:data:`BARE_COPY`) tells nothing either, so copies leave
    each other whole."""
    number: dict[tuple[str, int], int] = {}
    own = [number.setdefault(x, len(number)) for x in page]
    held = [set(shared(own, [number.setdefault(x, len(number)) for x in other])) for other in neighbours]
    if not any(mark == 1 for _, mark in page):
        bare = _size(page, 0)
        gone = set().union(*(h for h, other in zip(held, neighbours) if _size([page[i] for i in h], 0) < BARE_COPY * max(bare, _size(other, 0))))
        return "\n\n".join(x for i, (x, mark) in enumerate(page) if mark == 0 and i not in gone)
    size = _size(page)
    telling = [h for h, other in zip(held, neighbours) if 0 < (n := _size(other)) and _size([page[i] for i in h]) < COPY * max(size, n)]
    gone = set.intersection(*telling) if telling else set()
    return "\n\n".join(x for i, (x, mark) in enumerate(page) if mark == 1 and i not in gone)


def _order_key(url: pd.Series) -> pd.DataFrame:
    got = url.fillna("").str.extract(r"^(?:[a-zA-Z][\w+.-]*:)?(?://)?([^/?#]*)([^?#]*)")
    return pd.DataFrame({"host": got[0].fillna("").str.lower().str.replace(r"^.*@|:\d+$", "", regex=True), "path": got[1].fillna("")})


def extract(pages: DataFrame, sample: int = 200) -> DataFrame:
    """``page_id``, ``url``, ``text`` (empty if none) and ``n_chars`` of every page.

    Pages are put in order of host, path and page_id, and each is compared with the ones before and behind it on its host:
    these have the nearest URLs. The order is dealt out in ranges, so a host may span many tasks; the pages at the border
    of a range also go to the next. Range borders come from ``sample`` keys for each range. A null html or url is empty,
    pages without host are a host of their own; repeated rows are pages like others. An empty table gives no rows."""
    spark = pages.sparkSession
    split = F.pandas_udf(_order_key, "host string, path string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"), split(F.col("url").cast("string")).alias("k"), F.xxhash64("page_id", "url", "html").alias("h"))
    key = F.concat_ws("\x00", "k.host", "k.path", F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"), F.hex("h"))
    parts = common.n_parts(spark)
    n = pages.count()
    every = max(1, n // (sample * parts))
    keys = sorted(r[0] for r in rows.where(F.pmod(F.shiftright("h", 7), F.lit(every)) == 0).select(key).collect())
    cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []

    @F.pandas_udf("int")
    def part_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, object), k.to_numpy(), side="right").astype(np.int32) if cuts else np.zeros(len(k), np.int32))

    rows = rows.select("page_id", "url", "html", F.col("k.host").alias("host"), key.alias("key")).withColumn("part", part_of("key"))
    ends = rows.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # two keys for each range
    ends = sorted((r.part, r.lo, r.hi) for r in ends)
    near = {}
    for (p, _, hi), (q, lo, _) in zip(ends, ends[1:]):
        near.setdefault(hi, []).append(q)
        near.setdefault(lo, []).append(p)

    @F.pandas_udf("array<int>")
    def also(k: pd.Series) -> pd.Series:
        return k.map(lambda x: near.get(x, []))

    dealt = rows.select("page_id", "url", "html", "host", "key", F.col("part").alias("home"), F.explode(F.concat(F.array("part"), also("key"))).alias("part"))
    dealt = dealt.repartitionById(max(1, len(cuts) + 1), "part").sortWithinPartitions("part", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                names = ("part", "host", "home", "page_id", "url", "html")
                yield from ((*x[:5], lines(x[5])) for x in zip(*(batch.column(c).to_pylist() for c in names)))

        def told(held: list[tuple]) -> pa.RecordBatch:
            text = [x[2] for x in held]
            cells = [pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.string()), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
            return pa.RecordBatch.from_arrays(cells, ["page_id", "url", "text", "n_chars"])

        held, before, now = [], None, None
        for after in _with_end(each()):
            if now is not None and now[0] == now[2]:
                around = [x[5] for x in (before, after) if x is not None and x[:2] == now[:2]]
                held.append((now[3], now[4], main_text(now[5], around)))
                if len(held) >= 500:
                    yield told(held)
                    held = []
            before, now = now, after
        yield told(held)

    return dealt.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def _with_end(x: Iterator) -> Iterator:
    yield from x
    yield None
