"""Main text of web pages: nearest-URL page differencing, weighed by block zones.

``blocks`` reads a page in one pass: tags end blocks, scripts, styles and comments go, and each block of text gets a
zone by tag, role or class: DROPPED (menus, headers outside an article, footers, sidebars, notices, adverts, forms, reader
comments), MAIN (in an article, main element or content container; PROSE where its own element is a paragraph,
heading, list item, cell or quotation) or OTHER. An article or main element is never DROPPED for a part of a class name.

``extract`` sorts pages by host and path and aligns each page's lines, of all zones, with those of its nearest pages by
longest common subsequence. What the nearest page shares is deleted; zones weigh in three ways: a shared MAIN line goes
only when both neighbours have it and it looks like furniture (short, without a closing full stop) or isn't PROSE, as
articles may share real sentences; of the lines that aren't shared, DROPPED ones go as well (a menu or advert of one
page); and OTHER ones are the text only of pages that have no MAIN line of their own.

Adjacent pages are copies if their lines are equal, or if each has at most COPY_REST of its text besides the lines that
they share; copies in turn make a run, of any length. A page is compared with the nearest page of its host before its run
and the one after it, first with the nearer by common path prefix; a page that has all but COPY_REST of its text in one of
them (it is contained there) gets no deletions by that one. Pages whose own text is at most COPY_REST of the page can't
be told from copies, and keep their text whole.

Pages are cut into blocks of neighbours, at most about BLOCK_PAGES each and as many as the table needs, by sampled
boundaries; the driver holds a few keys per block. A task sorts its blocks and streams them, holding one run of copies
(compressed) and its two neighbours. Where a run crosses a boundary, the blocks beside it are read for their first and
last runs, and each block gets the page beyond the run at either edge, however many blocks away, so the result doesn't
depend on the cut. Pages of one host, path and page_id are in the order of a hash of their html.

Null html gives the empty text; null urls share the empty host; repeated rows are copies of each other; an empty table
gives an empty one; other columns are left out, whatever their names; very long pages are read whole, in linear time.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, groupby, islice
from operator import add, itemgetter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import table
from .urls import with_host_and_path

DROPPED, OTHER, MAIN, PROSE = 0, 1, 2, 3
BLOCK_PAGES, LEAST_PAGES, SAMPLE = 20_000, 400, 40
COPY_REST, SHORT_WORDS, LINK_SHARE = 0.1, 12, 0.5
ROW_BITS = 1 << 26

#: Fixed vocabularies of HTML elements and of class or id words.
RAW = "script style noscript template svg math iframe object textarea select title".split()
DROP_TAGS = set("nav footer aside form button dialog menu head".split())
BREAKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE_TAGS = set("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
LOOSE = set("p li dt dd td th tr option".split())
DROP_WORDS = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split())
MAIN_WORDS = set("article content entry post story articlebody maincontent".split())
#: Words that leave the meaning of a drop word beside them in one class name: "comment-list", "site-footer".
NEUTRAL_WORDS = set("area article bar block body bottom box container content entry fixed form global header inner item items left links list main mobile outer page panel post primary reader right secondary section site slot sticky text thread title top unit user wrap wrapper".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

RAW_END = {raw: re.compile(rf"</{raw}\s*>", re.I) for raw in RAW}
TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: A quote opens a value only after an equals sign; elsewhere it is part of a name.
TAG_STOP = re.compile(r">|=\s*[\"']")
NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECES = re.compile(r"[a-z0-9]+")


def _drops(name: str) -> bool:
    """Whether a class or id names furniture as a whole: drop words, with neutral ones at most."""
    pieces = {x for x in PIECES.findall(name) if not x.isdigit()}
    return bool(pieces & DROP_WORDS) and pieces <= DROP_WORDS | NEUTRAL_WORDS


def _kind(tag: str, attrs: str, in_main: bool) -> int:
    """The zone that an element opens: DROPPED, MAIN or OTHER (no change)."""
    if tag in DROP_TAGS or (tag == "header" and not in_main):
        return DROPPED
    main = tag in ("article", "main")
    if "=" in attrs:
        for name, *values in NAMES.findall(attrs):
            value = next((v for v in values if v), "").lower()
            if name.lower() == "role":
                if value in DROP_ROLES:
                    return DROPPED
                main |= value == "main"
            elif name.lower() == "itemprop":
                main |= value == "articlebody"
            elif tag not in ("body", "html"):
                for token in value.split():
                    if token in DROP_WORDS or (tag not in ("article", "main") and _drops(token)):
                        return DROPPED
                    main |= tag in ("div", "section", "td") and bool(MAIN_WORDS.intersection(PIECES.findall(token)))
    return MAIN if main else OTHER


def _markup(page: str):
    """(begin, end, tag, closes, attributes) of each piece of markup in order; tag is empty where no element is named."""
    last = {c: page.rfind(c) for c in ">\"'"}
    at, quoted = 0, True
    while 0 <= (begin := page.find("<", at)) < last[">"]:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        closes = page[begin + 1] == "/"
        name = TAG_NAME.match(page, begin + 1 + closes)
        if not name and page[begin + 1] not in "!?/":
            at = begin + 1
            continue
        end = page.find(">", begin)
        if name and quoted and not closes:
            look = name.end()
            while (m := TAG_STOP.search(page, look)) and m[0] != ">":
                close = page.find(m[0][-1], m.end()) if m.end() <= last[m[0][-1]] else -1
                look = m.end() if close < 0 else close + 1
            if m:
                end = m.start()
            else:  # a quote that is closed behind the last tag: from here on, quotes are plain
                quoted = False
        at = end + 1
        yield begin, at, name[0].lower() if name else "", closes, page[name.end() : end] if name else ""


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, zone) of each non-empty block in page order."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    linked, inside = 0, ""
    stack: list[tuple[str, int]] = []
    zone, link_from = OTHER, None
    page, at = page or "", 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                is_links = zone == OTHER and linked > LINK_SHARE * len(text)
                out.append((text, DROPPED if is_links else PROSE if zone == MAIN and inside in PROSE_TAGS else zone))
            parts.clear()
        linked = 0

    for begin, end, tag, closes, attrs in _markup(page):
        if begin < at:
            continue
        if begin > at:
            parts.append(page[at:begin])
            linked += (begin - at) if link_from else 0
        at = end
        if not tag:
            continue
        if tag in RAW_END:
            if not closes and not (attrs.endswith("/") and tag in ("svg", "math")):
                m = RAW_END[tag].search(page, end)
                at = m.end() if m else len(page)
            continue
        if tag in BREAKS:
            close()
            inside = "" if closes else tag
        elif tag in ("br", "img", "wbr"):
            parts.append(" ")
        if tag == "a":
            link_from = not closes
        if tag in VOID:
            continue
        if not closes:
            if tag in LOOSE:
                while stack and stack[-1][0] == tag:
                    zone = stack.pop()[1]
            if attrs.endswith("/"):
                continue
            if tag == "body":
                stack.clear()
                zone = OTHER
            kind = _kind(tag, attrs, zone == MAIN)
            turns = zone != DROPPED and kind != OTHER
            # Inline elements matter only when they change the zone; inner ones of the same name are then kept apart.
            if tag in BREAKS or tag in DROP_TAGS or turns or any(t == tag for t, _ in stack):
                stack.append((tag, zone))
            if turns:
                close()
                zone = kind
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if zone != stack[k][1]:
                        close()
                    zone = stack[k][1]
                    del stack[k:]
                    break
    parts.append(page[at:].partition("<!--")[0])
    close()
    return out


def _rows(a: list[str], b: list[str]):
    """Bit vectors by row, from none of a on: bit j of row i is 0 where b[j] lengthens the longest common subsequence with a[:i]."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    yield v
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of a with each beginning of b."""
    for v in _rows(a, b):
        pass
    return [0, *accumulate(c == "0" for c in reversed(f"{v:0{len(b)}b}"))]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Positions in a and in b of a longest common subsequence, in no order.

    Bit vectors by row, walked back from the end; where they would pass ROW_BITS, a is halved at the best place of b
    (Hirschberg), which bounds the memory at any size.
    """
    out: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        begin, ea, start, eb = parts.pop()
        while begin < ea and start < eb and a[begin] == b[start]:
            out.append((begin, start))
            begin, start = begin + 1, start + 1
        while ea > begin and eb > start and a[ea - 1] == b[eb - 1]:
            ea, eb = ea - 1, eb - 1
            out.append((ea, eb))
        both = {*a[begin:ea]} & {*b[start:eb]}
        if not both:
            continue
        at_a = [i for i in range(begin, ea) if a[i] in both]
        at_b = [j for j in range(start, eb) if b[j] in both]
        x, y = [a[i] for i in at_a], [b[j] for j in at_b]
        if len(x) > 1 and len(x) * len(y) > ROW_BITS:
            half = len(x) // 2
            ends = _lengths(x[half:][::-1], y[::-1])[::-1]
            both_ways = [*map(add, _lengths(x[:half], y), ends)]
            cut = both_ways.index(max(both_ways))
            at = at_b[cut] if cut < len(at_b) else eb
            parts += [(begin, at_a[half], start, at), (at_a[half], ea, at, eb)]
            continue
        rows, i, j = [*_rows(x, y)], len(x), len(y)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif not rows[i - 1] >> (j - 1) & 1:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((at_a[i], at_b[j]))
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence with b."""
    return {i for i, _ in aligned(a, b)}


def _looks_like_furniture(line: str) -> bool:
    return len(line.split(" ", SHORT_WORDS)) <= SHORT_WORDS and line[-1] not in ".!?…:;\"”»"


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


class Page:
    """A page of a block; body is its lines, one a row, and their zones, compressed."""

    def __init__(self, host: str, path: str, page_id: int | None, h: int, url: str | None, body: bytes):
        self.key, self.host, self.path, self.page_id, self.h, self.url, self.body = (host, path, page_id), host, path, page_id, h, url, body


@lru_cache(maxsize=8)
def opened(body: bytes) -> tuple[list[str], bytes]:
    """Lines and zones of a body."""
    text = zstandard.ZstdDecompressor().decompress(body)
    zones, _, rest = text.partition(b"\n")
    return (rest.decode().split("\n") if zones else []), bytes(z - 48 for z in zones)


@lru_cache(maxsize=8)
def pairs(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """Aligned lines of two bodies; kept while neighbours are compared in order."""
    return aligned(opened(a)[0], opened(b)[0])


def packed(found: list[tuple[str, int]]) -> bytes:
    """Blocks as the body of a Page."""
    return zstandard.ZstdCompressor(level=3).compress("\n".join(["".join(str(z) for _, z in found), *(x for x, _ in found)]).encode())


def _is_contained(lines: list[str], zones: bytes, hit: set[int]) -> bool:
    """Whether at most COPY_REST of the text is outside the lines hit: of the main text, if it is half of the page without DROPPED lines."""
    sizes = [(len(x), z >= MAIN, i in hit) for i, (x, z) in enumerate(zip(lines, zones, strict=True)) if z != DROPPED]
    if 2 * sum(n for n, main, _ in sizes if main) >= sum(n for n, *_ in sizes):
        sizes = [x for x in sizes if x[1]]
    return sum(n for n, _, shared in sizes if not shared) <= COPY_REST * sum(n for n, *_ in sizes)


def are_copies(a: Page, b: Page) -> bool:
    """For a before b."""
    if a.host != b.host or a.body == b.body:
        return a.host == b.host
    (x, in_x), (y, in_y) = opened(a.body), opened(b.body)
    both = pairs(a.body, b.body)
    return x == y or (_is_contained(x, in_x, {i for i, _ in both}) and _is_contained(y, in_y, {j for _, j in both}))


def runs(pages: Iterable[Page]) -> Iterator[list[Page]]:
    """Runs of copies of sorted pages."""
    run: list[Page] = []
    for p in pages:
        if run and not are_copies(run[-1], p):
            yield run
            run = []
        run.append(p)
    if run:
        yield run


def differenced(page: Page, before: Page | None, after: Page | None) -> str:
    """Text of a page, given its neighbours beyond its run."""
    lines, zones = opened(page.body)
    near = []
    if before and before.host == page.host:
        near.append((-_prefix(before.path, page.path), 0, {j for _, j in pairs(before.body, page.body)}))
    if after and after.host == page.host:
        near.append((-_prefix(after.path, page.path), 1, {i for i, _ in pairs(page.body, after.body)}))
    found = [hit for *_, hit in sorted(near, key=lambda x: x[:2]) if not _is_contained(lines, zones, hit)]
    shared = found[0] if found else set()
    both = found[0] & found[1] if len(found) == 2 else set()
    main = [i for i, z in enumerate(zones) if z >= MAIN and not (i in both and (z == MAIN or _looks_like_furniture(lines[i])))]
    other = [i for i, z in enumerate(zones) if z == OTHER and i not in shared]
    own = any(i not in shared for i in main)
    return "\n".join(lines[i] for i in (main if own or not other else other))


def texts(run: list[Page], before: Page | None, after: Page | None) -> Iterator[tuple]:
    """(page_id, url, text, n_chars) of a run, given the pages beside it; equal pages of one path are differenced once."""
    known, text = None, ""
    for p in run:
        if (p.body, p.path) != known:
            known, text = (p.body, p.path), differenced(p, before, after)
        yield p.page_id, p.url, text, len(text)


def _order(host: str, path: str, page_id: int | None) -> tuple:
    return host, path, page_id is not None, page_id or 0


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    d = with_host_and_path(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"))
    keys = d.select("host", "path", "page_id")
    n = keys.count()
    n_blocks = max(-(-n // BLOCK_PAGES), min(-(-n // LEAST_PAGES), 16 * spark.sparkContext.defaultParallelism))
    cuts: list[tuple] = []
    if n_blocks > 1:
        some = sorted(_order(*r) for r in keys.sample(min(1.0, n_blocks * SAMPLE / n), seed=1).collect())
        cuts = sorted({some[k * len(some) // n_blocks] for k in range(1, n_blocks)}) if some else []
    held = spark.sparkContext.broadcast(cuts)

    def ends(batches):
        """First and last key of each block in this task."""
        lo: dict[int, tuple] = {}
        hi: dict[int, tuple] = {}
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                k = _order(*r)
                x = bisect_right(held.value, k)
                lo[x], hi[x] = min(lo.get(x, k), k), max(hi.get(x, k), k)
        yield pa.RecordBatch.from_pylist([dict(zip(ENDS.names, (x, *lo[x], *hi[x]), strict=True)) for x in lo], ENDS)

    first, last = F.struct("h0", "p0", "f0", "i0"), F.struct("h1", "p1", "f1", "i1")
    spread = keys.mapInArrow(ends, ENDS_DDL)
    edge = {r.block: (tuple(r.lo), tuple(r.hi)) for r in spread.groupBy("block").agg(F.min(first).alias("lo"), F.max(last).alias("hi")).collect()}
    source = d.select("host", "path", "page_id", "url", "html", F.xxhash64("html").alias("h"))

    def read(where):
        """Pages in each block that where(key, block) names; away from their own, they are ghosts."""

        def run(batches):
            for b in batches:
                rows = []
                for host, path, page_id, url, text, h in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    k = _order(host, path, page_id)
                    own = bisect_right(held.value, k)
                    if to := where(k, own):
                        row = {"host": host, "path": path, "page_id": page_id, "h": h, "url": url, "body": packed(blocks(text))}
                        rows += [row | {"block": x, "ghost": x != own} for x in to]
                yield pa.RecordBatch.from_pylist(rows, PAGES)

        return run

    def in_order(read_pages: DataFrame) -> DataFrame:
        return read_pages.repartition("block").sortWithinPartitions("block", "host", "path", "page_id", "h")

    def streamed(of_block):
        """Batches of a task's sorted rows, block by block: of_block(block, (page, ghost) rows) gives rows of a schema."""

        def run(schema):
            def go(batches):
                rows = ((r.pop("block"), r.pop("ghost"), Page(**r)) for b in batches for r in b.to_pylist())
                for block, own in groupby(rows, key=itemgetter(0)):
                    found = of_block(block, ((p, ghost) for _, ghost, p in own))
                    while some := list(islice(found, 500)):
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in some], schema)

            return go

        return run

    def joins(block, rows):
        """Whether the last page of a block and the first of the next one are copies."""
        left, right = None, None
        for p, ghost in rows:
            if not ghost:
                left = p
            elif right is None:
                right = p
        if left and right:
            yield block, are_copies(left, right)

    def outline(block, rows):
        """The first page after the first run and the last one before the last run; a block of one run has none."""
        second, before, previous = None, None, None
        for run in runs(p for p, _ in rows):
            if previous:
                second, before = second or run[0], previous
            previous = run[-1]
        if second:
            yield block, *_order(*second.key), *_order(*before.key)

    full = sorted(edge)
    beside = [(p, q) for p, q in zip(full, full[1:], strict=False) if edge[p][1][0] == edge[q][0][0]]
    joined: set[int] = set()
    inner: dict[int, tuple] = {}
    if beside:
        tips: dict[tuple, list[int]] = {}
        for p, q in beside:
            for k in {edge[p][1], edge[q][0]}:
                tips.setdefault(k, []).append(p)
        at_edges = spark.sparkContext.broadcast(tips)
        some = spark.createDataFrame([(h, p, i if there else None) for h, p, there, i in tips], "host string, path string, page_id bigint")
        name = F.xxhash64("host", "path", "page_id").alias("_k")
        some = some.select(name).distinct()
        near = source.withColumn("_k", name).join(F.broadcast(some) if len(tips) < 100_000 else some, "_k", "left_semi").drop("_k")
        edges = in_order(near.mapInArrow(read(lambda k, own: at_edges.value.get(k)), PAGES_DDL))
        joined = {r.block for r in edges.mapInArrow(streamed(joins)(JOINS), "block int, joined boolean").filter("joined").collect()}
    if joined:
        asked = spark.sparkContext.broadcast(joined | {q for p, q in beside if p in joined})
        whole = in_order(source.mapInArrow(read(lambda k, own: [own] if own in asked.value else None), PAGES_DDL))
        for r in whole.mapInArrow(streamed(outline)(ENDS), ENDS_DDL).collect():
            inner[r.block] = (tuple(r[1:5]), tuple(r[5:9]))
    # Pages beyond the runs at a block's edges, from the block beside it or, where that is of one run, from what it got.
    before: dict[int, tuple | None] = {}
    after: dict[int, tuple | None] = {}
    for p, q in zip(full, full[1:], strict=False):
        before[q] = edge[p][1] if p not in joined else inner[p][1] if p in inner else before.get(p)
    for p, q in reversed(list(zip(full, full[1:], strict=False))):
        after[p] = edge[q][0] if p not in joined else inner[q][0] if q in inner else after.get(q)
    ghosts: dict[tuple, list[int]] = {}
    for side in (before, after):
        for x, k in side.items():
            if k:
                ghosts.setdefault(k, []).append(x)
    plan = spark.sparkContext.broadcast(ghosts)

    def compare(block, rows):
        """Rows of RESULT. Ghosts stand before and after a block's own pages; the nearest one counts."""
        before, run = None, []
        for p, ghost in rows:
            if ghost and not run:
                before = p
                continue
            if run and (ghost or not are_copies(run[-1], p)):
                yield from texts(run, before, p)
                before, run = run[-1], []
            if ghost:
                return
            run.append(p)
        yield from texts(run, before, None)

    lines = in_order(source.mapInArrow(read(lambda k, own: [own, *plan.value.get(k, ())]), PAGES_DDL))
    return lines.mapInArrow(streamed(compare)(RESULT), "page_id bigint, url string, text string, n_chars bigint")


PAGES_DDL = "block int, ghost boolean, host string, path string, page_id bigint, h bigint, url string, body binary"
ENDS_DDL = "block int, h0 string, p0 string, f0 boolean, i0 bigint, h1 string, p1 string, f1 boolean, i1 bigint"
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
PAGES, ENDS, JOINS, RESULT = (pa.schema([(c, KINDS[t]) for c, t in (f.split() for f in ddl.split(", "))]) for ddl in (PAGES_DDL, ENDS_DDL, "block int, joined boolean", "page_id bigint, url string, text string, n_chars bigint"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
