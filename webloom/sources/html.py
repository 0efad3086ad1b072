"""HTML pages to page rows: a small element tree on the standard parser, and what an audit needs from it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webloom.functions.text import fold as _fold  # noqa: F401  (column form)
from webloom.functions.url import TWO_LABEL_SUFFIXES, normalize
from webloom.schemas import PAGE, PERF

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_P_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# What is no page content, and the containers of content in order of preference.
CHROME_TAGS = frozenset("script style noscript template svg iframe object embed nav header footer aside".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary".split())
CHROME_CLASSES = frozenset("nav navbar menu sidebar footer header breadcrumb breadcrumbs cookie cookie-banner cookie-consent gdpr skip-link screen-reader-text sr-only visually-hidden".split())
CHROME_IDS = frozenset("nav navbar menu sidebar footer header comments".split())
CONTENT_CLASSES = ("content", "post-content", "entry-content", "article-body", "prose")
_EXOTIC = re.compile("[               　﻿]")
_SKIP_LINK = re.compile(r"^(?:mailto|tel|javascript|sms|ftp|data):", re.I)
_TOKEN = re.compile(r"[^a-z0-9+#]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self, skip: bool = False) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif not (skip and n.chrome()):
                stack.extend(reversed(n.children))
        return "".join(out)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def chrome(self) -> bool:
        a = self.attrs
        if self.tag in CHROME_TAGS or a.get("role") in CHROME_ROLES or a.get("aria-hidden") == "true" or a.get("id") in CHROME_IDS:
            return True
        return bool(a.get("class")) and not CHROME_CLASSES.isdisjoint(a["class"].split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _P_ENDS and self.at.tag == "p" or tag == self.at.tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.at = self.at.parent
        node = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def token_list(text: str) -> list[str]:
    """ASCII tokens after full Unicode folding."""
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "̀" <= c <= "ͯ" and c not in "'’")
    return [t for t in _TOKEN.split(folded) if t]


def _flat(s: str) -> str:
    return " ".join(s.split())


def _tidy(s: str) -> str:
    return re.sub(r"\n\s*\n\s*", "\n\n", re.sub(r"[ \t]+", " ", _EXOTIC.sub(" ", s))).strip()


def domain(url: str | None) -> str | None:
    """Registrable domain of an absolute URL."""
    m = re.match(r"https?://(?:[^/?#@]*@)?([^/?#:]+)", url or "", re.I)
    if not m:
        return None
    labels = m[1].lower().rstrip(".").removeprefix("www.").split(".")
    n = 3 if ".".join(labels[-2:]) in TWO_LABEL_SUFFIXES else 2
    return ".".join(labels[-n:])


def _number(x: str | None) -> float | None:
    try:
        return float(x.strip() or 0) if x is not None else None
    except ValueError:
        return None


def _main_text(nodes: list[Node], root: Node) -> str:
    def visible(n: Node) -> bool:
        while n is not None:
            if n.chrome():
                return False
            n = n.parent
        return True

    def inside(n: Node, tag: str) -> bool:
        while (n := n.parent) is not None:
            if n.tag == tag:
                return True
        return False

    tests = [lambda n: n.tag == "article" and inside(n, "main"), lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.get("role") == "main", lambda n: n.get("id") == "content"]
    tests += [lambda n, c=c: c in (n.get("class") or "").split() for c in CONTENT_CLASSES]
    for test in tests:
        first = next((n for n in nodes if test(n) and visible(n)), None)
        if first is not None and len(token_list(t := _tidy(first.text(skip=True)))) >= 50:
            return t
    body = next((n for n in nodes if n.tag == "body"), root)
    return _tidy(body.text(skip=True))


def _json_blocks(nodes: list[Node]) -> list[str]:
    out = []
    for n in nodes:
        if n.tag == "script" and (n.get("type") or "").strip().lower() == "application/ld+json" and (raw := n.text().strip()):
            try:
                x = json.loads(raw)
            except ValueError:
                out.append(json.dumps({"__parse_error": raw[:200]}))
                continue
            graph = x.get("@graph") if isinstance(x, dict) else x
            out += [json.dumps(b, ensure_ascii=False) for b in (graph if isinstance(graph, list) else [x])]
    return out


def _links(nodes: list[Node], base: str) -> list[dict]:
    seen, links, home = set(), [], domain(base)
    for n in nodes:
        href = (n.get("href") or "").strip() if n.tag == "a" else ""
        if not href or href.startswith("#") or _SKIP_LINK.match(href) or (url := normalize(href, base)) is None:
            continue
        rel = n.get("rel").lower() if n.get("rel") is not None else None
        anchor = _flat(n.text()) or next((c.get("alt") for c in n.walk() if c.tag == "img" and c.get("alt")), "")
        if (url, anchor) not in seen:
            seen.add((url, anchor))
            links.append({"url": url, "anchor": anchor[:300], "rel": rel, "internal": domain(url) == home, "nofollow": bool(rel and re.search(r"\bnofollow\b", rel))})
    return links


def _images(nodes: list[Node], base: str) -> list[dict]:
    out = []
    for n in nodes:
        if n.tag == "img":
            src = next((n.get(a) for a in ("src", "data-src", "data-lazy-src", "data-original") if n.get(a) is not None), None)
            src = src if src is not None else next(iter((n.get("srcset") or "").split(",")[0].split()), None)
            if src and not src.startswith("data:") and (url := normalize(src, base)):
                out.append({"src": url, "alt": n.get("alt"), "width": _number(n.get("width")), "height": _number(n.get("height")), "loading": n.get("loading")})
    return out


def extract_page(url: str, html: str, final_url: str | None = None) -> dict:
    """What one document says: titles, metas, headings, links, images, structured data and main text."""
    final = final_url or url
    root = parse(html)
    nodes = list(root.walk())
    first = lambda test: next((n for n in nodes if test(n)), None)
    meta = lambda name: next(((n.get("content") or "").strip() or None for n in nodes if n.tag == "meta" and (n.get("name") or "") == name), None)
    base_node = first(lambda n: n.tag == "base" and n.get("href"))
    base = (normalize(base_node.get("href"), final) if base_node else None) or final
    in_head = first(lambda n: n.tag == "title" and n.parent is not None and n.parent.tag == "head")
    title = (in_head and _flat(in_head.text())) or next((t for n in nodes if n.tag == "title" and (t := _flat(n.text()))), None)
    canonical = first(lambda n: n.tag == "link" and (n.get("rel") or "") == "canonical" and n.get("href"))
    html_node = first(lambda n: n.tag == "html")
    headings = [{"level": int(n.tag[1]), "text": t} for n in nodes if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and (t := _flat(n.text()))]
    social: dict[str, str] = {}
    for n in nodes:
        key = (n.get("property") or n.get("name") or "") if n.tag == "meta" else ""
        if n.get("content") and (key.startswith("twitter:") or (n.get("property") or "").startswith("og:")):
            social[key.lower()] = n.get("content").strip()
    hreflang = [
        {"lang": n.get("hreflang").lower(), "href": u}
        for n in nodes
        if n.tag == "link" and n.get("rel") == "alternate" and n.get("hreflang") and n.get("href") and (u := normalize(n.get("href"), base))
    ]
    text = _main_text(nodes, root)
    return {
        "title": title, "meta_description": meta("description"), "meta_robots": meta("robots") or meta("googlebot"),
        "canonical": normalize(canonical.get("href"), base) if canonical else None, "lang": (html_node.get("lang") or "").strip() or None if html_node else None,
        "headings": headings, "h1": [h["text"] for h in headings if h["level"] == 1], "text": text, "word_count": len(token_list(text)),
        "links": _links(nodes, base), "images": _images(nodes, base), "jsonld": _json_blocks(nodes), "social": social, "hreflang": hreflang,
    }


def perf_signals(html: str) -> dict:
    """Counts that performance rules use."""
    nodes = [n for n in parse(html).walk() if n.tag != "#root"]
    in_head = lambda n: any(p.tag == "head" for p in _parents(n))
    images = [n for n in nodes if n.tag == "img"]
    return {
        "render_blocking_css": sum(n.tag == "link" and n.get("rel") == "stylesheet" and n.get("media") in (None, "", "all", "screen") and in_head(n) for n in nodes),
        "render_blocking_js": sum(n.tag == "script" and bool(n.get("src")) and n.get("async") is None and n.get("defer") is None and n.get("type") != "module" and in_head(n) for n in nodes),
        "inline_style_bytes": sum(len(n.text().encode()) for n in nodes if n.tag == "style"),
        "inline_script_bytes": sum(len(n.text().encode()) for n in nodes if n.tag == "script" and n.get("src") is None),
        "images_without_dimensions": sum(not n.get("width") or not n.get("height") for n in images),
        "images_without_lazy": sum(k >= 2 and n.get("loading") != "lazy" for k, n in enumerate(images)),
        "total_dom_nodes": len(nodes),
    }


def _parents(n: Node) -> Iterator[Node]:
    while (n := n.parent) is not None:
        yield n


def read_pages(raw: DataFrame) -> DataFrame:
    """Page rows from ``raw(url, html)``; fetch columns (final_url, status, content_type, bytes, fetch_ms, depth) are taken where
    there, else as of a plain successful fetch.  A null document gives an empty page with an error."""
    have = set(raw.columns)
    col = lambda name, kind, default: (F.col(name) if name in have else F.lit(default)).cast(kind).alias(name)
    base = raw.select("url", "html", col("final_url", "string", None), col("status", "int", 200), col("content_type", "string", "text/html"), col("fetch_ms", "bigint", 0), col("depth", "int", 0))
    schema = to_arrow_schema(StructType.fromDDL(PAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = {k: None for k in schema.names} | {k: [] for k in ("redirect_chain", "headings", "h1", "links", "images", "jsonld", "hreflang")} | {"social": {}, "word_count": 0, "text": ""}
        for b in batches:
            rows = []
            for r in b.to_pylist():
                html = r.pop("html")
                got = empty | r | {"final_url": r["final_url"] or r["url"], "bytes": len((html or "").encode("utf-8", "surrogatepass"))}
                got |= extract_page(r["url"] or "", html, r["final_url"]) if html is not None else {"error": "no document"}
                got["social"] = list(got["social"].items())
                rows.append([got[k] for k in schema.names])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return base.mapInArrow(run, PAGE)


def read_perf(raw: DataFrame) -> DataFrame:
    """(url, perf) of ``raw(url, html)``."""
    kind = to_arrow_schema(StructType.fromDDL(f"perf {PERF}")).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([perf_signals(h or "") for h in b.column(1).to_pylist()], kind)], ["url", "perf"])

    return raw.select("url", "html").mapInArrow(run, f"url string, perf {PERF}")
