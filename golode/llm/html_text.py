"""Main text of web pages: block parsing, then differencing with the nearest pages of the host.

A page is read by a small tokenizer into blocks (text between block-level tags), each with the kind
of region it stands in: inside the article (article or main), inside furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments: by tag, role, class or id), or neither. The
pages of a host are put in order of URL (path, then query and fragment), and every page is paired
with its nearest ones: the sequences of lines are aligned by longest common subsequence, and what
both have is taken for what the site adds to its pages.

* Lines outside furniture of a page without an article go if one of the nearest two shares them.
* Lines inside an article go only if all of the nearest EVIDENCE share them: a sentence that a few
  articles have in common is text, a notice that every article around carries is none. Where fewer
  than EVIDENCE pages can be met there is no such evidence, and the line stays.
* A page that leaves next to nothing of another (half of an article, or all but COPY of a page
  without one, is shared) is a copy or a revision of it and no template: the nearest beyond that is
  none is taken. Up to REACH pages on either side are looked at; a page that meets copies only
  keeps its lines.

Pages are dealt to groups of GROUP in order of host and URL, by ranks that come from counts of a
range partitioning, so neither a host with a third of all pages nor a path with many queries is one
task; the REACH pages on either side of a group come along. What is shuffled are hashes and sizes
of lines. Only pages that lose a line are written down, with the numbers of the lines; the pages
are then read once more, joined with these by a hash of the whole row (by broadcast as long as
Spark finds them small), and give their texts.

Defined results: null html is empty and gives an empty text; null url is a host of its own with an
empty path; rows that repeat an id are extracted each, and rows equal in id, url and html get the
same text; an empty table gives no rows; other columns are ignored; a page that ends inside a tag,
comment or script is read up to there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from golode.llm.common import shuffle_width, staged, table

GROUP = 256
#: Pages on either side that are looked at.
REACH = 32
#: Pages that must share a line of an article before it goes.
EVIDENCE = 6
#: The share of a page's letters that is left beside a copy of it, at most: without an article, and with one.
COPY, ARTICLE_COPY = 0.05, 0.5

#: Elements that start and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SILENT = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button title".split())
#: Their content is raw: only their own end tag ends them.
RAW = frozenset("script style textarea title iframe noscript xmp".split())
FURNITURE_TAGS = frozenset("nav aside footer form menu dialog".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words of class and id attributes that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar side rail widget widgets footer header masthead topbar cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations more trending popular comment comments disqus reply replies "
    "respond form search pagination pager toolbar skip copyright legal disclaimer hidden".split()
)
#: Those that an article's own parts may be called as well.
AMBIGUOUS = frozenset("side rail header alert more trending popular form search skip copyright legal disclaimer hidden login reply respond".split())
#: What else may stand in a name of an article's part that is furniture ("comment-list", "share-buttons").
PARTS = frozenset("area bar block box button buttons container content footer form header icons inner item items links list main panel post posts section thread title unit wrap wrapper".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_WORDS = re.compile(r"[a-z]+")
#: Elements whose missing end tags the next start tag supplies.
CLOSES = {"p": frozenset(("p",)), "li": frozenset(("li", "p")), "td": frozenset(("td", "th", "p")), "th": frozenset(("td", "th", "p")),
          "tr": frozenset(("tr", "td", "th", "p")), "dt": frozenset(("dt", "dd", "p")), "dd": frozenset(("dt", "dd", "p")), "option": frozenset(("option",))}

PLAIN, ARTICLE, FURNITURE = 0, 1, 2


def _furniture(tag: str, raw: str, in_article: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if not raw.strip():
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
    if found.get("role", "").lower() in FURNITURE_ROLES or "hidden" in raw.lower().split() or found.get("aria-hidden") == "true":
        return True
    if tag in ARTICLE_TAGS or tag in ("body", "html"):
        return False
    named = re.sub("([a-z])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')}").lower()
    if not in_article:
        return not FURNITURE_WORDS.isdisjoint(_WORDS.findall(named))
    # A whole name must say so here, not a word of it.
    for name in named.split():
        words = set(_WORDS.findall(name))
        if words & FURNITURE_WORDS - AMBIGUOUS and words <= FURNITURE_WORDS | PARTS:
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """(region, text) of each block with text, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # tag, region before it, whether it is silent
    region, silent, text = PLAIN, 0, []

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((region, line))
            text.clear()

    def close(upto: int) -> None:
        nonlocal region, silent
        while len(stack) > upto:
            _, region, quiet = stack.pop()
            silent -= quiet

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not silent:
            text.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                flush()
            if tag == "p" and not any(t == "p" for t, _, _ in stack):
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush() if any(t in BLOCKS for t, _, _ in stack[i:]) else None
                    close(i)
                    break
            continue
        if tag == "br":
            text.append("\n") if not silent else None
            continue
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in (CLOSES["p"] if tag not in CLOSES else CLOSES[tag]):
                    close(i)
                elif stack[i][0] in BLOCKS:
                    break
        if tag in VOID or m[3].endswith("/") and tag in SILENT:
            continue
        quiet = tag in SILENT
        stack.append((tag, region, quiet))
        silent += quiet
        if region != FURNITURE:
            if _furniture(tag, m[3], region == ARTICLE):
                flush()
                region = FURNITURE
            elif tag in ARTICLE_TAGS:
                region = ARTICLE
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = stop.start() if stop else n
    flush()
    return out


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of a stand in a longest common subsequence with b (hashes of lines): common
    ends first, then bit vectors over what is between them."""
    keep = np.zeros(len(a), bool)
    k = min(len(a), len(b))
    same = a[:k] == b[:k]
    pre = k if same.all() else int(same.argmin())
    keep[:pre] = True
    k -= pre
    same = a[len(a) - k :][::-1] == b[len(b) - k :][::-1]
    post = k if same.all() else int(same.argmin())
    keep[len(a) - post :] = True
    # Lines that only one side has can be in no common subsequence.
    ai = np.arange(pre, len(a) - post)
    x, y = a[ai], b[pre : len(b) - post]
    ai, x, y = ai[np.isin(x, y)], x[np.isin(x, y)], y[np.isin(y, x)]
    keep[ai[_subsequence(x.tolist(), y.tolist())]] = True
    return keep


#: Bits of the table of a longest common subsequence that is walked back; larger ones are halved.
TABLE_BITS = 1 << 27


def _columns(x: list, y: list) -> Iterator[int]:
    """Of each beginning of x: a bit per item of y, 0 where the longest common subsequence with the
    beginning of y up to there is longer than up to the item before (Hyyrö's bit vectors)."""
    at: dict = {}
    for j, item in enumerate(y):
        at[item] = at.get(item, 0) | 1 << j
    v = full = (1 << len(y)) - 1
    for item in x:
        u = v & at.get(item, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(x: list, y: list) -> np.ndarray:
    """The lengths of the longest common subsequences of x with every beginning of y."""
    last = (1 << len(y)) - 1
    for last in _columns(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _subsequence(x: list, y: list) -> list[int]:
    """Places in x of a longest common subsequence with y. A large table is halved at the middle of
    x (Hirschberg), so memory stays within TABLE_BITS or a few times the lengths."""
    if not x or not y:
        return []
    if len(x) > 1 and len(x) * len(y) > TABLE_BITS:
        half = len(x) // 2
        cut = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _subsequence(x[:half], y[:cut]) + [half + i for i in _subsequence(x[half:], y[cut:])]
    rows, out = [(1 << len(y)) - 1, *_columns(x, y)], []
    i, j = len(x), len(y)

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    here = length(i, j)
    while here:
        if length(i - 1, j) == here:
            i -= 1
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i, j, here = i - 1, j - 1, here - 1
            out.append(i)
    return out[::-1]


def has_article(found: list[tuple[int, str]]) -> bool:
    return any(region == ARTICLE for region, _ in found)


def wanted_region(found: list[tuple[int, str]]) -> int:
    return ARTICLE if has_article(found) else PLAIN


def main_text(found: list[tuple[int, str]], gone=()) -> str:
    """The wanted blocks but for those numbered in ``gone``, joined by line feeds."""
    region, gone = wanted_region(found), set(gone)
    return "\n".join(line for i, (r, line) in enumerate(found) if r == region and i not in gone)


def place_of(url) -> tuple:
    """host, path and rest of a URL column, without scheme."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^([^/?#]*)", 1)
    path = F.regexp_extract(bare, "^[^/?#]*([^?#]*)", 1)
    return F.lower(host), path, F.regexp_extract(bare, "^[^?#]*([?#].*)?$", 1)


class Page:
    """A page as its neighbours see it: hashes of its lines, letters of those that are wanted."""

    __slots__ = ("key", "host", "hashes", "letters", "article", "raw")

    def __init__(self, key, host, hashes: bytes, letters: bytes, article: bool):
        self.key, self.host, self.article, self.raw = key, host, article, hashes
        self.hashes, self.letters = np.frombuffer(hashes, np.uint64), np.frombuffer(letters, np.int32)

    def shared_with(self, other: Page) -> np.ndarray | None:
        """Which lines the other page has as well, or None if it is a copy of this one."""
        shared = shared_lines(self.hashes, other.hashes)
        left = int(self.letters[~shared].sum(dtype=np.int64))
        return None if left <= (ARTICLE_COPY if self.article else COPY) * int(self.letters.sum(dtype=np.int64)) else shared


def lines_to_drop(pages: list[Page], at: int) -> np.ndarray:
    """Numbers of the wanted lines of a page that are the site's, from the pages around it."""
    page = pages[at]
    if not page.letters.any():
        return np.empty(0, np.int64)
    needed, met = EVIDENCE if page.article else 2, []
    tried: dict[bytes, np.ndarray | None] = {}
    for away in range(1, REACH + 1):
        for k in (at - away, at + away):
            if len(met) < needed and 0 <= k < len(pages) and pages[k].host == page.host:
                other = pages[k]
                if other.raw not in tried:
                    tried[other.raw] = page.shared_with(other)
                if tried[other.raw] is not None:
                    met.append(tried[other.raw])
        if len(met) == needed or page.article and met and not (np.logical_and.reduce(met) & (page.letters > 0)).any():
            break
    if not met or page.article and len(met) < needed:
        return np.empty(0, np.int64)
    shared = np.logical_and.reduce(met) if page.article else np.logical_or.reduce(met)
    return np.flatnonzero(shared & (page.letters > 0))


def _hashed(batches):
    """Hashes of the lines of pages, and the letters of the wanted ones."""
    for batch in batches:
        hashes, letters, articles = [], [], []
        for raw in batch.column("html"):
            found = blocks(raw.as_py())
            region = wanted_region(found)
            hashes.append(b"".join(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")).to_bytes(8, "little") for _, t in found))
            letters.append(np.array([len(t) if r == region else 0 for r, t in found], np.int32).tobytes())
            articles.append(region == ARTICLE)
        more = [pa.array(hashes, pa.binary()), pa.array(letters, pa.binary()), pa.array(articles, pa.bool_())]
        names = ["h1", "h2", "host", "path", "rest"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "hashes", "letters", "article"])


def _dropped(batches):
    """h1, h2, gone of the pages that lose lines, from rows in order of group and rank."""
    group, pages, own = None, [], []

    def decided():
        rows = [(p.key, lines_to_drop(pages, i)) for i, p in enumerate(pages) if own[i]]
        rows = [(*key, gone) for key, gone in rows if len(gone)]
        if rows:
            h1, h2, gone = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(gone, pa.list_(pa.int64()))], ["h1", "h2", "gone"])

    for batch in batches:
        for one in batch.to_pylist():
            if one["group"] != group:
                yield from decided()
                group, pages, own = one["group"], [], []
            pages.append(Page((one["h1"], one["h2"]), one["host"], one["hashes"], one["letters"], one["article"]))
            own.append(one["own"])
    yield from decided()


def _extracted(batches):
    for batch in batches:
        texts = [
            main_text(blocks(raw.as_py()), gone.as_py() or ()) for raw, gone in zip(batch.column("html"), batch.column("gone"), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def site_lines(base: DataFrame) -> DataFrame:
    """h1, h2, gone: of the pages (h1, h2, host, path, rest, html) that lose lines, which."""
    read = staged(base.mapInArrow(_hashed, "h1 long, h2 long, host string, path string, rest string, hashes binary, letters binary, article boolean"), "lines")
    order = ["host", "path", "rest", "h1", "h2"]
    placed = read.repartitionByRange(shuffle_width(base.sparkSession), *order).sortWithinPartitions(*order)
    # The number has the partition in its upper bits and the place in it in the lower 33.
    placed = staged(placed.withColumn("number", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("part", F.shiftright("number", 33)).withColumn("place", F.col("number").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = placed.join(F.broadcast(counts), "part").withColumn("rank", F.col("base") + F.col("place"))
    group_of = lambda rank: F.floor(rank / GROUP)
    around = F.sequence(group_of(F.col("rank") - REACH), group_of(F.col("rank") + REACH))
    dealt = ranked.withColumn("group", F.explode(around)).withColumn("own", F.col("group") == group_of(F.col("rank")))
    dealt = dealt.repartition(shuffle_width(base.sparkSession), "group").sortWithinPartitions("group", "rank")
    found = dealt.select("group", "own", "h1", "h2", "host", "hashes", "letters", "article").mapInArrow(_dropped, "h1 long, h2 long, gone array<long>")
    return staged(found.groupBy("h1", "h2").agg(F.min("gone").alias("gone")), "site_lines")


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """id, url, text: one row per page."""
    host, path, rest = place_of(F.col(url_col))
    # A hash passes over nulls, so whether there is one is hashed as well.
    row = [c for n in (id_col, url_col, html_col) for c in (F.col(n), F.col(n).isNull())]
    base = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        host.alias("host"),
        path.alias("path"),
        rest.alias("rest"),
        F.coalesce(html_col, F.lit("")).alias("html"),
        F.xxhash64(F.lit(1), *row).alias("h1"),
        F.xxhash64(F.lit(2), *row).alias("h2"),
    )
    whole = base.select("id", "url", "html", "h1", "h2").join(site_lines(base), ["h1", "h2"], "left")
    return whole.select("id", "url", "html", "gone").mapInArrow(_extracted, "id long, url string, text string")


def op6(spark, sf_dir):
    found = extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The same for pages that have an article of headings and paragraphs and the character references
#: of the test tables: blocks are what stands between their tags.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(?:</article>|\z)', 1) AS inner_html FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(inner_html, '</?(?:h1|p|li|ul|br)[^>]*>'), lambda x:
        trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*(?:>|\z)', '', 'g'),
             '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
             '\s+', ' ', 'g'))) AS parts FROM a)
SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text,
       CAST(length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10))) AS BIGINT) AS n_chars FROM b
"""
