"""Robots rules, sitemaps and an offline breadth-first crawl over a page store."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from webloom.functions.url import slash_key
from webloom.operators.similarity import checkpointed


# Conventional paths of sitemaps.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/wp-sitemap.xml")


def parse_robots(text: str, agent: str = "*") -> dict:
    """Rules of the group that fits the agent best, sitemaps and crawl delay.  Consecutive agent lines share a group."""
    groups: list[dict] = []
    sitemaps, fresh = [], False
    for line in text.splitlines():
        name, sep, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not sep:
            continue
        if name == "sitemap":
            sitemaps.append(value)
        elif name == "user-agent":
            if not (groups and fresh):
                groups.append({"agents": [], "rules": [], "delay": None})
            groups[-1]["agents"].append(value.lower())
            fresh = True
        elif groups:
            fresh = False
            if name in ("allow", "disallow") and value:
                groups[-1]["rules"].append((name == "allow", value))
            elif name == "crawl-delay" and re.fullmatch(r"\d+(?:\.\d+)?", value):
                groups[-1]["delay"] = float(value)
    fit = lambda g: max((len(a) if a != "*" else 0 for a in g["agents"] if a == "*" or a in agent.lower()), default=-1)
    best = max(map(fit, groups), default=-1)
    own = [g for g in groups if fit(g) == best] if best >= 0 else []
    return {"rules": [r for g in own for r in g["rules"]], "delay": next((g["delay"] for g in own if g["delay"] is not None), None), "sitemaps": sitemaps}


def allowed(path: str, rules: list[tuple[bool, str]]) -> bool:
    """The longest rule that fits decides; allow wins at equal length.  ``*`` and a final ``$`` are wildcards."""
    best = (-1, True)
    for allow, rule in rules:
        pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + ("$" if rule.endswith("$") else "")
        if re.match(pattern, path):
            best = max(best, (len(rule), allow))
    return best[1]


def filter_allowed(urls: DataFrame, robots: str | None, agent: str = "*") -> DataFrame:
    """``urls(url)`` that the robots text lets the agent fetch; no text or an HTML one allows all."""
    if not robots or re.match(r"\s*<", robots):
        return urls
    rules = parse_robots(robots, agent)["rules"]

    @F.pandas_udf("boolean")
    def ok(url: pd.Series) -> pd.Series:
        return url.map(lambda u: u is not None and allowed(re.sub(r"^https?://[^/?#]*", "", u).split("#")[0] or "/", rules))

    return urls.where(ok("url"))


def parse_sitemap(text: str) -> tuple[list[str], list[str]]:
    """(urls, further sitemaps) of an XML or plain text sitemap."""
    clean = lambda s: html.unescape(re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", s, flags=re.S)).strip()
    if "<" not in text:
        return [x.strip() for x in text.splitlines() if x.strip().startswith(("http://", "https://"))], []
    locs = [clean(x) for x in re.findall(r"<loc[^>]*>(.*?)</loc>", text, re.S | re.I)]
    return ([], locs) if re.search(r"<sitemapindex", text, re.I) else (locs, [])


def read_sitemaps(files: DataFrame, roots: list[str], max_depth: int = 3) -> DataFrame:
    """Distinct urls reached from the root sitemaps in ``files(url, content)``; indexes are followed ``max_depth`` levels."""

    @F.pandas_udf("urls array<string>, nested array<string>")
    def parts(content: pd.Series) -> pd.DataFrame:
        got = [parse_sitemap(c or "") for c in content]
        return pd.DataFrame({"urls": [a for a, _ in got], "nested": [b for _, b in got]})

    parsed = files.select("url", parts("content").alias("p"))
    spark = files.sparkSession
    level, found = spark.createDataFrame([(r,) for r in roots], "url string"), None
    for _ in range(max_depth + 1):
        now = parsed.join(level, "url", "left_semi")
        own = now.select(F.explode("p.urls").alias("url"))
        found = own if found is None else found.unionByName(own)
        level = now.select(F.explode("p.nested").alias("url")).distinct()
    return found.distinct()


def url_filter(urls: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Patterns are substrings or ``/regex/flags``; exclusion comes first."""

    def hit(p: str):  # noqa: ANN202
        m = re.fullmatch(r"/(.+)/([a-z]*)", p)
        return F.col("url").rlike(("(?i)" if "i" in m[2] else "") + m[1]) if m else F.contains(F.col("url"), F.lit(p))

    for p in exclude or []:
        urls = urls.where(~hit(p))
    if include:
        any_of = hit(include[0])
        for p in include[1:]:
            any_of = any_of | hit(p)
        urls = urls.where(any_of)
    return urls


def crawl(pages: DataFrame, seeds: list[str], max_depth: int = 10, max_pages: int = 20_000) -> tuple[DataFrame, str]:
    """Breadth-first waves over a store of page rows: (url, depth) of the pages reached through internal links, at most
    ``max_pages``, the shallowest and then least urls first; and why it stopped: complete, max_depth or max_pages.

    Of several rows of a page, slashes aside, the least url counts.
    """
    store = pages.select(slash_key(F.col("url")).alias("key"), "url", F.filter("links", lambda x: x["internal"]).alias("links"))
    frontier = pages.sparkSession.createDataFrame([(s,) for s in seeds], "u string").select(slash_key(F.col("u")).alias("key")).distinct()
    seen, depth = None, 0
    while True:
        found = store.join(frontier, "key", "left_semi")
        if depth > max_depth:
            stopped = "complete" if found.isEmpty() else "max_depth"
            break
        wave = checkpointed(found.groupBy("key").agg(F.min_by(F.struct("url", "links"), "url").alias("p")).select("key", "p.url", "p.links", F.lit(depth).alias("depth")))
        if wave.isEmpty():
            stopped = "complete"
            break
        seen = wave if seen is None else checkpointed(seen.unionByName(wave))
        out = wave.select(F.explode("links").alias("l")).select(slash_key(F.col("l.url")).alias("key")).distinct()
        frontier, depth = out.join(seen, "key", "left_anti"), depth + 1
    if seen is None:
        return store.limit(0).select("url", F.lit(0).alias("depth")), stopped
    stopped = "max_pages" if seen.count() > max_pages else stopped
    return seen.select("url", "depth").orderBy("depth", "url").limit(max_pages), stopped


def sitemap_candidates(origin: str, robots: str | None = None) -> list[str]:
    """Where a site's sitemaps may be: those that its robots text names, else the conventional paths."""
    named = parse_robots(robots)["sitemaps"] if robots else []
    return named or [origin.rstrip("/") + path for path in SITEMAP_PATHS]


def orphans(sitemap: DataFrame, reached: DataFrame) -> DataFrame:
    """Sitemap urls that no link leads to, whatever their last slash."""
    key = slash_key(F.col("url"))
    return sitemap.withColumn("k", key).join(reached.select(key.alias("k")), "k", "left_anti").select("url")
