"""Main text of web pages.

A page is parsed once into blocks of text, each with the container that holds it.  Elements that are no content by their
meaning (menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers) are marked.

A suffix array over the pages of a host says which words are boilerplate.  The word streams of whole pages, menus included, are
concatenated; their suffixes are sorted by rank doubling up to ``RUN`` words, so neighbours that agree that far are the places of one
repeated substring, and longer ones are chains of such windows.  A word counts the less, the more distinct pages repeat what it
stands in.  What a page itself calls its article (or main part) is the main text; of several such elements those that mostly repeat
go.  On other pages the deepest container with most of the page's weight is the main text: everything in it stays, repeated or not.  If that is
the whole body, containers in it that are mostly boilerplate go.

Pages of a host are sorted together in groups of about ``GROUP_PAGES`` pages or ``GROUP_BYTES``; larger hosts are dealt into several by a hash of the page,
whatever the partitioning, so no host, however large, is in one task.  A repeat is judged among all pages of the host all the same:
groups tell each other how many of their pages have a window.  They first exchange fingerprints of ``FINGER`` bits, and then 64-bit hashes and
numbers of pages of those windows that other groups may have too.  A window that no other group has is known from the group itself.
That is left out for hosts where no page's main text depends on it, as each names one article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import Numbers, checkpointed, mix64, tidy, utf8
from .urlfilter import host_of

RUN, GROUP_PAGES, GROUP_BYTES, MAX_BROADCAST_BYTES = 5, 1000, 16 << 20, 32 << 20
#: Bits of a window's hash that groups compare first, inside one of as many buckets as the host has groups.
FINGER = 28
#: The share of a page's weight that its main container holds, and the weight a word that a container needs not to be boilerplate.
HELD, OWN = 0.7, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
#: HTML elements by their role.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noframes", "noembed"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
NO_CONTENT = frozenset(("nav", "aside", "form", "footer", "head", "button", "select", "svg", "menu", "dialog", "object", "canvas", "audio", "video", "datalist"))
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br", "ruby", "rt", "rp", "meta", "link"))
CLOSES_P = frozenset(("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
CONTAINERS = frozenset(("article", "body", "center", "div", "main", "section", "td"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BAD_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"))
#: What a class or id calls a part that is no content, and words that may stand beside these in one name.
PARTS = frozenset(("ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"))
BESIDE = frozenset(("", "area", "banner", "bar", "block", "bottom", "box", "buttons", "container", "content", "form", "header", "inner", "item", "left", "links", "list", "main", "middle", "outer", "page", "panel", "primary", "reader", "region", "right", "row", "secondary", "section", "site", "slot", "text", "thread", "top", "unit", "user", "wrap", "wrapper"))
ARTICLE, MAIN = 2, 1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if "=" in raw else {}


def _names_part(names: str) -> bool:
    """Whether one of the names of a class or id attribute is made of words for such a part alone: ``cookie-notice`` is one, while
    ``comments-on-kant`` is about something else."""
    for name in names.lower().split():
        words = re.split(r"[^a-z]+", name)
        if not PARTS.isdisjoint(words) and all(w in PARTS or w in BESIDE for w in words):
            return True
    return False


def _meaning(tag: str, raw: str, inside: bool) -> tuple[bool, int]:
    """Whether an element is no content, and whether it is the article or the main part.  ``inside``: of one of these."""
    if tag in NO_CONTENT or tag == "header" and not inside:
        return True, 0
    rank = ARTICLE if tag == "article" else MAIN if tag == "main" else 0
    if raw and not raw.isspace():
        attrs = _attributes(raw)
        if "hidden" in raw and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", raw) or attrs.get("aria-hidden") == "true" or attrs.get("role") in BAD_ROLES:
            return True, 0
        style = attrs.get("style", "").replace(" ", "").lower()
        if "display:none" in style or "visibility:hidden" in style:
            return True, 0
        if tag not in HEADINGS and tag not in ("body", "html", "main") and (_names_part(attrs.get("class", "")) or _names_part(attrs.get("id", ""))):
            return True, 0
        if attrs.get("role") == "article" or attrs.get("itemprop") == "articleBody":
            rank = ARTICLE
        elif attrs.get("role") == "main":
            rank = max(rank, MAIN)
    return False, rank


class Page:
    """Blocks in page order with the container of each (-1: no content), and the parents and ranks of the containers.

    Container 0 is the whole page.  Character references are decoded and white space is one space.
    """

    __slots__ = ("texts", "holder", "parent", "rank", "whole")

    def __init__(self, source: str | None) -> None:
        self.texts: list[str] = []
        self.holder: list[int] = []
        self.parent, self.rank, self.whole = [-1], [0], [True]
        if source:
            self._parse(source)

    def _parse(self, page: str) -> None:
        stack: list[tuple[str, int, bool, int]] = []  # tag, container, no content, rank
        now: list[str] = []
        at, end = 0, len(page)

        def flush() -> None:
            if now:
                text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
                now.clear()
                if text:
                    self.texts.append(text)
                    self.holder.append(-1 if stack and stack[-1][2] else stack[-1][1] if stack else 0)

        while at < end:
            m = _TOKEN.search(page, at)
            if m is None:
                now.append(page[at:])
                break
            if m.start() > at:
                now.append(page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:  # an end tag ends the elements left open in its own
                if tag not in INLINE:
                    flush()
                    n = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
                    if n >= 0:
                        del stack[n:]
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            _, holder, gone, rank = stack[-1] if stack else ("", 0, False, 0)
            if tag in INLINE:
                if tag == "br":
                    now.append(" ")
                elif tag in ("span", "a", "small", "label") and m[3] and not gone and _meaning(tag, m[3], rank > 0)[0]:
                    at = _after(page, at, tag)
                continue
            flush()
            if tag in CLOSES_P and stack and stack[-1][0] == "p" or tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                stack.pop()
                _, holder, gone, rank = stack[-1] if stack else ("", 0, False, 0)
            if tag in VOID:
                continue
            if not gone:
                gone, own = _meaning(tag, m[3], rank > 0)
                if not gone and (own or tag in CONTAINERS):
                    self.parent.append(holder)
                    self.rank.append(own)
                    self.whole.append(tag == "body")
                    holder = len(self.parent) - 1
                rank = max(rank, own)
            stack.append((tag, holder, gone, rank))
        flush()

    def pack(self) -> tuple[bytes, list[int], list[int]]:
        """Texts, one to a line and compressed, containers of the blocks, and for each container its parent, rank and whether it is the whole page."""
        return zstandard.ZstdCompressor(level=1).compress(utf8("\n".join(self.texts))), self.holder, [(p + 1) << 3 | r << 1 | w for p, r, w in zip(self.parent, self.rank, self.whole, strict=True)]

    @classmethod
    def unpack(cls, texts: bytes, holder: list[int], nodes: list[int]) -> Page:
        page = cls(None)
        page.texts, page.holder = zstandard.ZstdDecompressor().decompress(texts).decode("utf-8", "surrogatepass").split("\n") if holder else [], holder
        page.parent, page.rank, page.whole = [(x >> 3) - 1 for x in nodes], [x >> 1 & 3 for x in nodes], [bool(x & 1) for x in nodes]
        return page


def _after(page: str, at: int, tag: str) -> int:
    """The end of the inline element of this tag that starts before ``at``."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a token sequence, sorted by the first ``depth`` tokens, and the rank of each suffix; equal ranks agree
    that far.  Ranks of the first 1, 2, 4, ... tokens are doubled; a suffix shorter than ``depth`` ranks before longer ones."""
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while have < depth:
        shift = min(have, depth - have)  # the tokens that are added may overlap those before
        later = np.concatenate([rank[shift:], np.zeros(min(shift, len(rank)), np.int64)])
        rank = np.unique(rank * (len(rank) + 1) + later, return_inverse=True)[1].astype(np.int64) + 1
        have += shift
    return np.argsort(rank, kind="stable"), rank


class Windows:
    """The substrings of ``run`` words of a group of pages.  ``rank`` numbers the one that starts at each word, ``found`` is for each
    number how many distinct pages (``owner``) have it.

    Streams are concatenated with a token of its own after each, so no substring spans two.
    """

    def __init__(self, streams: list[list[int]] | list[np.ndarray], owner: list[int], run: int) -> None:
        self.run, self.sizes = run, np.array([len(s) + 1 for s in streams], np.int64)
        ends = np.cumsum(self.sizes)
        self.tokens = np.concatenate([np.asarray(x, np.int64) for k, s in enumerate(streams) for x in (s, [-1 - k])]) if streams else np.empty(0, np.int64)
        pages = np.repeat(np.array(owner, np.int64), self.sizes)
        self.left = np.repeat(ends, self.sizes) - 1 - np.arange(len(self.tokens))  # words of the stream from each on
        order, self.rank = suffix_order(self.tokens, run)
        r, p = self.rank[order], pages[order]
        if (np.diff(owner) < 0).any():  # else the stable order has neighbours in the array that agree by page
            by_page = np.lexsort((p, r))
            r, p = r[by_page], p[by_page]
        fresh = np.ones(len(r), bool)
        fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
        self.found = np.bincount(r[fresh], minlength=1)

    def counts(self) -> list[np.ndarray]:
        """For each word of each stream the largest ``found`` of what it stands in."""
        starts = self.found[self.rank]
        count = starts.copy()
        for k in range(1, min(self.run, len(count))):
            np.maximum(count[k:], starts[:-k], out=count[k:])
        return [count[e - n : e - 1] for e, n in zip(np.cumsum(self.sizes).tolist(), self.sizes.tolist(), strict=True)]

    def listed(self, words: pa.Array, asks: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank and hash of each substring, and whether a stream that ``asks`` has it; by hash."""
        whole = np.flatnonzero(self.left >= self.run)
        place = np.full(len(self.found), -1)
        place[self.rank[whole]] = whole
        ranks = np.flatnonzero(place >= 0)
        at, h = place[ranks], np.array([xxhash.xxh64_intdigest(w) for w in words.cast(pa.large_binary()).to_numpy(zero_copy_only=False)], np.uint64)
        key = h[self.tokens[at]]
        for k in range(1, self.run):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[self.tokens[at + k]]
        key = mix64(key)
        asked = np.zeros(len(self.found), bool)
        asked[self.rank[whole[np.repeat(np.array(asks, bool), self.sizes)[whole]]]] = True
        order = np.argsort(key)
        return ranks[order], key[order], asked[ranks[order]]


def _places(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket, of ``parts`` ranges of hashes, that each hash is in, and its fingerprint: the first bits of where it is there."""
    many, low = np.uint64(parts), np.uint64(32)
    bucket = (key >> low) * many + ((key & np.uint64(0xFFFFFFFF)) * many >> low) >> low
    return bucket.astype(np.int64), (key * many >> np.uint64(64 - FINGER)).astype(np.int64)


def repeats(streams: list[list[int]], owner: list[int], run: int) -> list[np.ndarray]:
    """For each word of each stream the number of distinct pages (``owner``) that have a substring of ``run`` words it stands in."""
    return Windows(streams, owner, run).counts()


def named(page: Page, size: list[int] | np.ndarray) -> list[int]:
    """The outermost containers that the page itself calls its article or, if none is, its main part; ``size`` is 0 for those that hold nothing."""
    n = len(page.parent)
    top, ranked = max((page.rank[k] for k in range(n) if size[k]), default=0), [0] * n
    for k in range(1, n):
        ranked[k] = max(ranked[page.parent[k]], page.rank[k])
    return [k for k in range(1, n) if top and page.rank[k] == top and size[k] and ranked[page.parent[k]] < top]


def asks(page: Page) -> bool:
    """Whether the main text may depend on what other pages repeat: all but that of a page without content or with one named part."""
    size = [0] * len(page.parent)
    for h in page.holder:
        if h >= 0:
            size[h] = 1
    for k in range(len(size) - 1, 0, -1):
        size[page.parent[k]] |= size[k]
    return size[0] > 0 and len(named(page, size)) != 1


def choose(page: Page, counts: np.ndarray) -> list[str]:
    """The blocks of the main text; ``counts`` are the numbers of pages that repeat each word of the page."""
    n = len(page.parent)
    words = np.array([t.count(" ") + 1 for t in page.texts], np.int64)
    if not len(words):
        return []
    weigh = np.add.reduceat(1.0 / (1.0 + np.log2(counts)), np.cumsum(words) - words)
    size, weight = np.zeros(n), np.zeros(n)  # of containers with what is in them
    for b, h in enumerate(page.holder):
        if h >= 0:
            size[h] += words[b]
            weight[h] += weigh[b]
    alone, own = size.copy(), weight.copy()
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        weight[page.parent[k]] += weight[k]
    own_parts = named(page, size)
    if own_parts:
        roots = {k for k in own_parts if weight[k] >= OWN * size[k]} or set(own_parts)
        drop: set[int] = set()
    else:
        roots = {max((k for k in range(n) if weight[k] >= HELD * weight[0]), default=0)}  # containers come after those around them
        drop = {k for k in range(n) if alone[k] and own[k] < OWN * alone[k]} if all(page.whole[k] for k in roots) else set()
        if sum(alone[k] for k in drop) == size[0]:
            drop = set()
    inside = [False] * n
    for k in range(n):
        inside[k] = k in roots or k > 0 and inside[page.parent[k]]
    return [t for t, h in zip(page.texts, page.holder, strict=True) if h >= 0 and inside[h] and h not in drop]


def windows(pages: list[Page], owner: list[int], run: int) -> tuple[Windows, pa.Array]:
    """The windows of a group of pages, and the words that their tokens number."""
    words = pc.split_pattern(pa.array([" ".join(p.texts) or None for p in pages], pa.large_string()), " ")
    index = words.flatten().dictionary_encode()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy())
    return Windows(np.split(index.indices.to_numpy(), ends[:-1]) if pages else [], owner, run), index.dictionary


def main_texts(pages: list[Page], owner: list[int], run: int = RUN) -> list[str]:
    """The main text of each page of pages that are all of their host; ``owner`` numbers distinct pages."""
    return ["\n\n".join(choose(p, c)) for p, c in zip(pages, windows(pages, owner, run)[0].counts(), strict=True)]


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 to below 2**32, byte planes compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


#: Of ``n`` windows that a group has in a bucket; a, b and c depend on the step.
_MESSAGE = "host string, bucket int, part int, n int, a binary, b binary, c binary"
_ARROW = pa.schema([("host", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


class _Group:
    """A group of a host's pages, and its windows as ``Windows.listed`` has them, the same in every step."""

    def __init__(self, table: pa.Table, run: int) -> None:
        self.rows = _rows(table)
        seen: Numbers = Numbers()
        self.pages = [Page.unpack(*r[6:]) for r in self.rows]
        self.windows, words = windows(self.pages, [seen[r[5]] for r in self.rows], run)
        self.host, self.part, parts = self.rows[0][2:5]
        self.ranks, self.keys, self.asked = self.windows.listed(words, [asks(p) for p in self.pages])
        bucket, self.fingers = _places(self.keys, parts)
        found, starts, sizes = np.unique(bucket, return_index=True, return_counts=True)
        self.buckets = {b: slice(lo, lo + n) for b, lo, n in zip(found.tolist(), starts.tolist(), sizes.tolist(), strict=True)}


def _whole_hosts(pages: DataFrame, run: int) -> DataFrame:
    """The main texts of parsed pages of hosts in several groups, with windows counted over all of them."""

    def offer(table: pa.Table) -> pa.Table:  # a: fingerprints, b: which are asked for
        g = _Group(table, run)
        return _messages([(g.host, b, g.part, s.stop - s.start, _packed(np.diff(g.fingers[s], prepend=0)), np.packbits(g.asked[s]).tobytes(), None) for b, s in g.buckets.items()])

    def shared(table: pa.Table) -> pa.Table:  # a: which of them are asked for and in several groups, if hashes don't tell them apart
        rows = _rows(table)
        if len(rows) < 2:
            return _messages([])
        fingers = np.concatenate([np.cumsum(_unpacked(r[4])) for r in rows])
        asked = np.concatenate([np.unpackbits(np.frombuffer(r[5], np.uint8), count=r[3]) for r in rows])
        _, which, many = np.unique(fingers, return_inverse=True, return_counts=True)
        hit = ((many > 1) & (np.bincount(which, weights=asked) > 0))[which]
        ends = np.cumsum([r[3] for r in rows])
        return _messages([(*r[:4], np.packbits(hit[e - r[3] : e]).tobytes(), None, None) for r, e in zip(rows, ends.tolist(), strict=True) if hit[e - r[3] : e].any()])

    def count(table: pa.Table, told: pa.Table) -> pa.Table:  # of these, a: places in the bucket, b: hashes, c: pages of the group
        told_rows = _rows(told)
        if not told_rows:
            return _messages([])
        g = _Group(table, run)
        out = []
        for _, b, _, n, mask, _, _ in told_rows:
            s = g.buckets[b]
            at = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n))
            out.append((g.host, b, g.part, len(at), _packed(np.diff(at, prepend=0)), g.keys[s][at].astype("<u8").tobytes(), _packed(g.windows.found[g.ranks[s][at]])))
        return _messages(out)

    def total(table: pa.Table) -> pa.Table:  # a: the places, c: pages of all groups
        rows = _rows(table)
        _, which = np.unique(np.concatenate([np.frombuffer(r[5], "<u8") for r in rows]), return_inverse=True)
        totals = np.bincount(which, weights=np.concatenate([_unpacked(r[6]) for r in rows])).astype(np.int64)[which]
        ends = np.cumsum([r[3] for r in rows])
        return _messages([(*r[:5], None, _packed(totals[e - r[3] : e])) for r, e in zip(rows, ends.tolist(), strict=True)])

    def texts(table: pa.Table, totals: pa.Table) -> pa.Table:
        g = _Group(table, run)
        for _, b, _, _, places, _, found in _rows(totals):
            g.windows.found[g.ranks[g.buckets[b]][np.cumsum(_unpacked(places))]] = _unpacked(found)
        return _texts(g.rows, g.pages, g.windows)

    by_group = pages.groupBy("host", "part")
    hits = by_group.applyInArrow(offer, _MESSAGE).groupBy("host", "bucket").applyInArrow(shared, _MESSAGE)
    totals = by_group.cogroup(hits.groupBy("host", "part")).applyInArrow(count, _MESSAGE).groupBy("host", "bucket").applyInArrow(total, _MESSAGE)
    return by_group.cogroup(totals.groupBy("host", "part")).applyInArrow(texts, "page_id bigint, url string, text string, n_chars bigint")


def _texts(rows: list[tuple], pages: list[Page], found: Windows) -> pa.Table:
    out = ["\n\n".join(choose(p, c)) for p, c in zip(pages, found.counts(), strict=True)]
    return pa.table([pa.array(c, f.type) for c, f in zip(([r[0] for r in rows], [r[1] for r in rows], out, list(map(len, out))), _OUT, strict=True)], schema=_OUT)


def _dealt(pages: DataFrame, group_pages: int, group_bytes: int) -> tuple[DataFrame, bool]:
    """``pages`` with ``part``, the number of the group of its host, ``parts``, how many it has, and ``whole``: whether counts of all of
    them matter; and whether there are such hosts."""
    parts = F.greatest(F.ceil(F.count("*") / F.lit(group_pages)), F.ceil(F.sum(F.octet_length("html")) / F.lit(group_bytes)))
    sizes = pages.groupBy("host").agg(parts.cast("int").alias("parts"))
    large = checkpointed(sizes.where("parts > 1"))
    room = large.agg(F.sum(F.octet_length("host") + 64).alias("n")).first().n or 0

    def few(hosts: DataFrame) -> DataFrame:
        return F.broadcast(hosts) if room <= MAX_BROADCAST_BYTES else hosts  # else the join is by shuffle

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for b in batches:
            for host, page in zip(b.column(0), b.column(1), strict=True):
                if (h := host.as_py()) not in known and asks(Page(page.as_py())):
                    known.add(h)
                    yield pa.RecordBatch.from_arrays([pa.array([h], pa.string())], ["host"])

    if room:
        whole = pages.join(few(large), "host", "left_semi").select("host", "html").mapInArrow(tidy(asking), "host string").distinct()
        large = checkpointed(large.join(whole.withColumn("whole", F.lit(True)), "host", "left"))
    else:
        large = large.withColumn("whole", F.lit(False))
    part = F.pmod(F.col("ph"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pages.join(few(large), "host", "left").withColumns({"part": part, "whole": F.coalesce("whole", F.lit(False))})
    return dealt, bool(room) and not large.where("whole").isEmpty()


def extract(pages: DataFrame, run: int = RUN, group_pages: int = GROUP_PAGES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text and n_chars.

    Blocks are joined by a blank line.  Null, empty and text-free pages: empty text.  Repeated rows give a row each and do not make each
    other's words boilerplate, for they are no distinct pages.  A null url counts as an empty host.  Pages of any length are
    taken whole.  Extra columns are not read.  An empty table gives an empty result.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    keyed = own.select("page_id", "url", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("ph"), "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [Page(x.as_py()).pack() for x in b.column(6)]
            cols = [pa.array([p[k] for p in packed], t) for k, t in enumerate((pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *cols], ["page_id", "url", "host", "part", "parts", "ph", "blocks", "holder", "nodes"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            seen: Numbers = Numbers()
            group = [Page.unpack(*r[6:]) for r in rows]
            return iter(_texts(rows, group, windows(group, [seen[r[5]] for r in rows], run)[0]).to_batches())

        key, rows = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[2:4] != key:
                    if rows:
                        yield from finish(rows)
                    key, rows = r[2:4], []
                rows.append(r)
        if rows:
            yield from finish(rows)

    schema = "page_id bigint, url string, host string, part int, parts int, ph bigint, blocks binary, holder array<int>, nodes array<int>"
    dealt, several = _dealt(keyed, group_pages, group_bytes)

    def parsed(some: DataFrame) -> DataFrame:
        return some.select("page_id", "url", "host", "part", "parts", "ph", "html").mapInArrow(tidy(parse), schema).repartition("host", "part")

    alone = parsed(dealt.where("not whole")).sortWithinPartitions("host", "part", "ph").mapInArrow(tidy(texts), "page_id bigint, url string, text string, n_chars bigint")
    return alone.union(_whole_hosts(parsed(dealt.where("whole")), run)) if several else alone
