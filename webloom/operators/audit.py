"""The 53-rule site audit.

Rules that look at one page are columns, fused into one array of findings per page, so they take one scan.  Rules over groups
and other pages are joins and windows.  All give rows (rule, severity, url, message, evidence) with the evidence as JSON.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from webloom.functions.mathx import clamp, js_round
from webloom.functions.text import truncate
from webloom.functions.url import normalize_url
from webloom.operators.groups import first_k

# Limits of the rules, anchors without a topic, required properties of structured data.
TITLE, META, THIN, VERY_THIN, LINKS, DEPTH, URL, SLOW, VERY_SLOW, LARGE, RATIO = (20, 60), (70, 160), 300, 100, 150, 4, 115, 1500, 3000, 2 << 20, 0.08
DUPLICATE = 0.85
GENERIC_ANCHORS = ("click here", "here", "read more", "more", "learn more", "this", "link", "this page", "continue reading", "see more", "details", "download", "view", "go", "next", "previous")
REQUIRED = {
    "Article": "headline image datePublished", "BlogPosting": "headline image datePublished", "NewsArticle": "headline image datePublished", "Product": "name image",
    "Recipe": "name image recipeIngredient recipeInstructions", "FAQPage": "mainEntity", "HowTo": "name step", "Event": "name startDate location",
    "JobPosting": "title datePosted hiringOrganization", "LocalBusiness": "name address", "Organization": "name", "BreadcrumbList": "itemListElement",
    "VideoObject": "name thumbnailUrl uploadDate", "SoftwareApplication": "name applicationCategory",
}
HREFLANG = r"(?i)^([a-z]{2,3}(-[a-z]{4})?(-[a-z]{2}|-\d{3})?|x-default)$"
SITE_RULES = ("sitemap.missing", "robots.missing")
#: Rule, category; and for rules with an action: priority, effort, kind of fix.
CATALOGUE = """status.5xx technical critical medium fix_server_error
status.4xx technical critical small fix_broken_page
status.fetch_failed technical
links.broken_internal internal-links high trivial update_internal_link
redirect.chain technical
links.to_redirect internal-links low trivial update_internal_link
security.http_link technical medium small fix_mixed_content
index.noindex indexability
index.noindex_in_sitemap indexability high trivial remove_from_sitemap
canonical.missing indexability medium trivial add_canonical
canonical.points_elsewhere indexability
canonical.broken indexability critical small fix_canonical
canonical.chain indexability medium small fix_canonical
index.orphan internal-links high small add_internal_link
index.not_in_sitemap indexability
sitemap.missing technical medium small create_sitemap
robots.missing technical low trivial create_robots_txt
title.missing on-page critical trivial set_title
title.too_long on-page low trivial shorten_title
title.too_short on-page
title.duplicate on-page high small rewrite_title
meta_description.missing on-page medium trivial set_meta_description
meta_description.too_long on-page
meta_description.too_short on-page
meta_description.duplicate on-page low small rewrite_meta_description
h1.missing on-page high trivial add_h1
h1.multiple on-page
h1.duplicate on-page medium small rewrite_h1
headings.skipped_level on-page
lang.missing technical
content.thin content medium large expand_content
content.empty content critical medium fix_rendering
content.low_text_ratio content low medium reduce_page_weight
content.duplicate content high large consolidate_pages
links.deep_page internal-links medium medium reduce_crawl_depth
links.few_inbound internal-links medium small add_internal_link
links.too_many internal-links
links.generic_anchor internal-links low small improve_anchor_text
links.internal_nofollow internal-links
url.too_long technical
url.non_ideal_format technical
images.missing_alt on-page low small add_alt_text
images.missing_dimensions performance
images.broken technical
schema.missing structured-data low small add_schema
schema.parse_error structured-data medium trivial fix_jsonld
schema.incomplete structured-data medium small complete_schema
social.missing_og on-page
hreflang.no_return_link international high small fix_hreflang
hreflang.invalid_code international high trivial fix_hreflang
hreflang.missing_x_default international
performance.slow_response performance high medium improve_ttfb
performance.large_page performance medium medium reduce_page_weight"""
RULES = {r[0]: r[1:] for r in (line.split() for line in CATALOGUE.splitlines())}


@dataclass
class Crawl:
    """A crawl as frames: page rows, sitemap urls, orphans, and facts of the site."""

    pages: DataFrame
    sitemap: DataFrame | None = None
    orphans: DataFrame | None = None
    origin: str = ""
    robots_exists: bool = True


def is_html() -> Column:
    return F.col("error").isNull() & F.col("status").between(200, 299) & F.contains(F.coalesce("content_type", F.lit("")), F.lit("html"))


def noindex() -> Column:
    return F.coalesce(F.col("meta_robots").rlike(r"(?i)\bnoindex\b"), F.lit(False))


def is_indexable() -> Column:
    return ~noindex() & F.col("status").between(200, 299)


def _finding(rule: str, severity: str | Column, message: str | Column, **evidence: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    facts = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])) if evidence else F.lit(None).cast("string")
    return F.struct(F.lit(rule).alias("rule"), lit(severity).alias("severity"), lit(message).alias("message"), facts.alias("evidence"))


def _text(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def local_findings() -> Column:
    """The findings of all rules that need one page only, as an array."""
    c, html, idx = F.col, is_html(), is_indexable()
    n = lambda array, test: F.coalesce(F.size(F.filter(array, test)), F.lit(0))
    length = lambda name: F.coalesce(F.length(name), F.lit(0))
    own, canon = c("norm_final"), c("norm_canonical")
    http = n("images", lambda i: F.startswith(i["src"], F.lit("http:")))
    no_alt = n("images", lambda i: F.coalesce(F.trim(i["alt"]) == "", F.lit(True)))
    no_size = n("images", lambda i: i["width"].isNull() | i["height"].isNull())
    generic = n("links", lambda x: x["internal"] & F.lower(F.trim(x["anchor"])).isin(*GENERIC_ANCHORS))
    nofollow = n("links", lambda x: x["internal"] & x["nofollow"])
    path = F.regexp_extract("url", r"^https?://[^/?#]*([^?#]*)", 1)
    params = F.size(F.filter(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&"), lambda p: p != ""))
    levels = F.transform("headings", lambda h: h["level"])
    skipped = F.exists(F.sequence(F.lit(2), F.greatest(F.size(levels), F.lit(2))), lambda i: (i <= F.size(levels)) & (F.get(levels, i - 1) > F.get(levels, i - 2) + 1))
    og = lambda k: F.coalesce(F.element_at("social", F.lit(k)) != "", F.lit(False))
    words, bytes_, ratio = c("word_count"), c("bytes"), F.length("text") / F.greatest(c("bytes"), F.lit(1))
    rules = [
        (c("status") >= 500, _finding("status.5xx", "error", _text("Server error %d.", c("status")), status=c("status"))),
        (c("status").between(400, 499), _finding("status.4xx", "error", _text("Client error %d.", c("status")), status=c("status"), inbound_internal_links=c("inbound"))),
        (c("error").isNotNull(), _finding("status.fetch_failed", "error", F.concat(F.lit("Not fetched: "), c("error")), error=c("error"))),
        ((F.size("redirect_chain") > 0) & (c("url") != c("final_url")), _finding("redirect.chain", "warning", F.concat(F.lit("Redirects to "), c("final_url")), final_url=c("final_url"), hops=F.size("redirect_chain"))),
        (html & F.startswith(c("final_url"), F.lit("https:")) & (http > 0), _finding("security.http_link", "warning", _text("%d image(s) over HTTP.", http), count=http)),
        (html & noindex(), _finding("index.noindex", "warning", "Marked noindex.", meta_robots=c("meta_robots"), inbound_internal_links=c("inbound"))),
        (html & idx & c("canonical").isNull(), _finding("canonical.missing", "warning", "No canonical.")),
        (html & (canon != own), _finding("canonical.points_elsewhere", "notice", F.concat(F.lit("Canonical is "), c("canonical")), canonical=c("canonical"))),
        (html & _blank("title"), _finding("title.missing", "error", "No title.")),
        (html & (length("title") > TITLE[1]), _finding("title.too_long", "warning", _text("Title of %d characters.", length("title")), length=length("title"))),
        (html & ~_blank("title") & (length("title") < TITLE[0]), _finding("title.too_short", "notice", _text("Title of %d characters.", length("title")), length=length("title"))),
        (html & idx & _blank("meta_description"), _finding("meta_description.missing", "warning", "No meta description.")),
        (html & (length("meta_description") > META[1]), _finding("meta_description.too_long", "notice", _text("Meta description of %d characters.", length("meta_description")), length=length("meta_description"))),
        (html & ~_blank("meta_description") & (length("meta_description") < META[0]), _finding("meta_description.too_short", "notice", _text("Meta description of %d characters.", length("meta_description")), length=length("meta_description"))),
        (html & (F.size("h1") == 0) & (words > 50), _finding("h1.missing", "error", "No H1.")),
        (html & (F.size("h1") > 1), _finding("h1.multiple", "notice", _text("%d H1 headings.", F.size("h1")), count=F.size("h1"))),
        (html & skipped, _finding("headings.skipped_level", "notice", "A heading level is skipped.")),
        (html & _blank("lang"), _finding("lang.missing", "notice", "No language.")),
        (html & idx & (words > 0) & (words < THIN), _finding("content.thin", F.when(words < VERY_THIN, "error").otherwise("warning"), _text("%d words.", words), word_count=words)),
        (html & idx & (words == 0), _finding("content.empty", "error", "No text.")),
        (html & (bytes_ >= 20_000) & (words > 0) & (ratio < RATIO), _finding("content.low_text_ratio", "notice", "Little text for the size of the page.", ratio=js_round(ratio, 3))),
        (html & (c("depth") > DEPTH), _finding("links.deep_page", "notice", _text("%d clicks deep.", c("depth")), depth=c("depth"))),
        (html & idx & (c("depth") > 0) & (c("inbound") <= 1), _finding("links.few_inbound", "notice", _text("%d internal link(s) lead here.", c("inbound")), inbound=c("inbound"))),
        (html & (F.size("links") > LINKS), _finding("links.too_many", "notice", _text("%d links.", F.size("links")), links=F.size("links"))),
        (html & (generic > 0), _finding("links.generic_anchor", "notice", _text("%d internal link(s) with an anchor without topic.", generic), count=generic)),
        (html & (nofollow > 0), _finding("links.internal_nofollow", "notice", _text("%d internal link(s) are nofollow.", nofollow), count=nofollow)),
        (html & (F.length("url") > URL), _finding("url.too_long", "notice", _text("URL of %d characters.", F.length("url")), length=F.length("url"))),
        (html & (path.rlike("[A-Z]") | F.contains(path, F.lit("_")) | (params > 2)), _finding("url.non_ideal_format", "notice", "Capitals, underscores or many parameters in the URL.", parameters=params)),
        (html & (no_alt > 0), _finding("images.missing_alt", "warning", _text("%d of %d image(s) without alt text.", no_alt, F.size("images")), missing=no_alt, total=F.size("images"))),
        (html & (no_size > 0), _finding("images.missing_dimensions", "notice", _text("%d image(s) without dimensions.", no_size), count=no_size)),
        (html & idx & (F.size("jsonld") == 0) & (words > 200), _finding("schema.missing", "notice", "No structured data.")),
        (html & idx & ~(og("og:title") & og("og:image")), _finding("social.missing_og", "notice", "No og:title or og:image.", has_og_title=og("og:title"), has_og_image=og("og:image"))),
        (html & (F.size("hreflang") > 1) & ~F.exists("hreflang", lambda h: h["lang"] == "x-default"), _finding("hreflang.missing_x_default", "notice", "No x-default.")),
        (html & (c("fetch_ms") > SLOW), _finding("performance.slow_response", F.when(c("fetch_ms") > VERY_SLOW, "error").otherwise("warning"), _text("Took %d ms.", c("fetch_ms")), fetch_ms=c("fetch_ms"))),
        (html & (bytes_ > LARGE), _finding("performance.large_page", "warning", _text("%d bytes of HTML.", bytes_), bytes=bytes_)),
    ]
    single = F.array_compact(F.array(*[F.when(test, found) for test, found in rules]))
    none = F.filter(single, lambda _: F.lit(False))
    broken = F.transform(F.filter("jsonld", lambda b: F.get_json_object(b, "$.__parse_error").isNotNull()), lambda b: _finding("schema.parse_error", "error", "Structured data that cannot be parsed.", snippet=F.get_json_object(b, "$.__parse_error")))
    invalid = F.transform(F.filter("hreflang", lambda h: ~h["lang"].rlike(HREFLANG)), lambda h: _finding("hreflang.invalid_code", "error", F.concat(F.lit("Not a language code: "), h["lang"]), lang=h["lang"]))
    lacking = F.flatten(F.transform("jsonld", _incomplete))
    return F.concat(single, *[F.when(html, x).otherwise(none) for x in (broken, invalid, lacking)])


def _incomplete(block: Column) -> Column:
    """Findings for the types of a structured-data block that lack required properties."""
    props = F.from_json(block, "map<string,string>")
    kind = F.element_at(props, F.lit("@type"))
    kinds = F.coalesce(F.from_json(kind, "array<string>"), F.array(kind))
    table = F.create_map(*[F.lit(x) for k, v in REQUIRED.items() for x in (k, v)])
    missing = lambda k: F.filter(F.split(F.element_at(table, k), " "), lambda p: F.coalesce(F.element_at(props, p) == "", F.lit(True)))
    own = F.filter(F.array_compact(kinds), lambda k: F.coalesce(F.map_contains_key(table, k), F.lit(False)))
    found = F.filter(F.transform(own, lambda k: F.struct(k.alias("type"), missing(k).alias("missing"))), lambda x: F.size(x["missing"]) > 0)
    return F.transform(found, lambda x: _finding("schema.incomplete", "warning", F.concat(x["type"], F.lit(" lacks "), F.array_join(x["missing"], ", ")), type=x["type"], missing=x["missing"]))


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with normalised own and canonical urls and the number of internal links from other pages."""
    links = pages.select(F.col("url").alias("source"), F.explode("links").alias("l")).where("l.internal and l.url <> source")
    inbound = links.groupBy(F.col("l.url").alias("url")).agg(F.count("*").alias("inbound"))
    none = F.lit(None).cast("string")
    return pages.join(inbound, "url", "left").withColumns({"inbound": F.coalesce("inbound", F.lit(0)), "norm_final": normalize_url("final_url", none), "norm_canonical": normalize_url("canonical", none)})


def _rows(df: DataFrame, rule: str, severity: str | Column, message: str | Column, **evidence: Column) -> DataFrame:
    return df.select("url", _finding(rule, severity, message, **evidence).alias("f")).select("f.rule", "f.severity", "url", "f.message", "f.evidence")


def _link_rules(p: DataFrame, html: DataFrame) -> list[DataFrame]:
    links = html.select("url", F.explode("links").alias("l")).where("l.internal").select("url", F.col("l.url").alias("target")).distinct()
    broken = p.where("status >= 400 or error is not null").select(F.col("url").alias("target"))
    moved = p.where("url <> final_url").select(F.col("url").alias("target"))
    out = []
    for rule, severity, to, text in (("links.broken_internal", "error", broken, "%d internal link(s) lead to broken pages."), ("links.to_redirect", "notice", moved, "%d internal link(s) lead to redirects.")):
        hits = links.join(to.distinct(), "target", "left_semi").groupBy("url").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_set("target")), 1, 5).alias("targets"))
        out.append(_rows(hits, rule, severity, _text(text, F.col("n")), count=F.col("n"), targets=F.col("targets")))
    dead = p.where("status >= 400").select(F.col("url").alias("src")).distinct()
    images = html.select("url", F.explode("images").alias("i")).select("url", F.col("i.src").alias("src")).join(dead, "src", "left_semi").groupBy("url").agg(F.count("*").alias("n"))
    return [*out, _rows(images, "images.broken", "warning", _text("%d broken image(s).", F.col("n")), count=F.col("n"))]


def _canonical_rules(p: DataFrame, html: DataFrame) -> list[DataFrame]:
    keys = F.array_distinct(F.array("url", "final_url"))
    facts = ("url", "final_url", "status", "error", "canonical", "norm_canonical", "norm_final", "hreflang")
    # the page with the address itself before one that redirects there, then the least url
    order = F.struct(F.col("key") != F.col("url"), "url", "final_url", "status")
    by_key = p.select(F.explode(keys).alias("key"), *facts).groupBy("key").agg(F.min_by(F.struct(*facts), order).alias("t")).select("key", "t.*")
    t = by_key.select(F.col("key").alias("canonical"), *[F.col(x).alias(f"t_{x}") for x in ("url", "final_url", "status", "error", "canonical", "norm_canonical", "norm_final")])
    j = html.where("canonical is not null").join(t, "canonical")
    dead = (F.col("t_status") >= 400) | F.col("t_error").isNotNull()
    bad = j.where(dead | (F.col("t_url") != F.col("t_final_url")))
    chain = j.where("t_canonical is not null and t_norm_canonical <> t_norm_final and norm_canonical <> norm_final")
    alt = html.select("url", "norm_final", F.explode("hreflang").alias("h")).where("h.lang <> 'x-default'").select("url", "norm_final", "h.lang", "h.href")
    target = by_key.where("size(hreflang) > 0").select(F.col("key").alias("href"), F.transform("hreflang", lambda h: h["href"]).alias("back"))
    lost = alt.join(target, "href").where(~F.array_contains("back", F.col("norm_final")))
    return [
        _rows(bad, "canonical.broken", "error", F.when(dead, "The canonical page cannot be fetched.").otherwise("The canonical page redirects."), canonical=F.col("canonical")),
        _rows(chain, "canonical.chain", "warning", "The canonical page has another canonical.", chain=F.array("url", "canonical", "t_canonical")),
        _rows(lost, "hreflang.no_return_link", "error", F.concat("href", F.lit(" does not link back.")), target=F.col("href"), lang=F.col("lang")),
    ]


def _duplicate_rules(html: DataFrame) -> list[DataFrame]:
    own = html.where(is_indexable() & (F.col("canonical").isNull() | (F.col("norm_canonical") == F.col("norm_final"))))
    keys = {"title": F.lower(F.trim("title")), "meta_description": F.lower(F.trim("meta_description")), "h1": F.lower(F.trim(F.get("h1", F.lit(0))))}
    out = []
    for name, key in keys.items():
        k = own.withColumn("k", key).where("k is not null and k <> ''").select("url", "k")
        sizes = k.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").join(first_k(k, ["k"], "url", 6, "some"), "k")
        hits = k.join(sizes, "k")
        out.append(_rows(hits, f"{name}.duplicate", "error" if name == "title" else "warning", _text("%d other page(s) have the same.", F.col("n") - 1), value=truncate(F.col("k"), 120), duplicate_count=F.col("n"), others=F.slice(F.array_except("some", F.array("url")), 1, 5)))
    return out


def _site_rules(crawl: Crawl, html: DataFrame) -> list[DataFrame]:
    spark = crawl.pages.sparkSession
    one = lambda rule, severity, url, message: spark.createDataFrame([(rule, severity, url, message, None)], "rule string, severity string, url string, message string, evidence string")
    out = [] if crawl.robots_exists else [one("robots.missing", "notice", f"{crawl.origin}/robots.txt", "No robots.txt.")]
    if crawl.orphans is not None:
        out.append(_rows(crawl.orphans.select("url"), "index.orphan", "warning", "In the sitemap, but nothing links to it."))
    listed = None if crawl.sitemap is None or crawl.sitemap.isEmpty() else crawl.sitemap.select(F.col("url").alias("s")).distinct()
    if listed is None:
        return [*out, one("sitemap.missing", "warning", crawl.origin, "No sitemap.")]
    inside = html.where(~is_indexable()).join(listed, F.col("url") == F.col("s"), "left_semi")
    self_canonical = F.col("canonical").isNull() | (F.col("norm_canonical") == F.col("norm_final"))
    outside = html.where(is_indexable() & self_canonical).join(listed, F.col("url") == F.col("s"), "left_anti").join(listed, F.col("final_url") == F.col("s"), "left_anti")
    return [*out, _rows(inside, "index.noindex_in_sitemap", "error", "In the sitemap, but not indexable."), _rows(outside, "index.not_in_sitemap", "notice", "Indexable, but not in the sitemap.")]


def _content_duplicates(html: DataFrame) -> DataFrame:
    from webloom.operators.similarity import near_dup_clusters

    docs = html.where(is_indexable() & (F.col("word_count") >= 100)).select(F.col("url").alias("doc_id"), "text")
    c = near_dup_clusters(docs, DUPLICATE)
    return _rows(c.withColumnRenamed("doc_id", "url"), "content.duplicate", "error", _text("%d other page(s) have nearly the same text.", F.col("size") - 1), leader=F.col("leader"), similarity=F.col("similarity"), size=F.col("size"))


def run_audit(crawl: Crawl, only: list[str] | None = None, duplicates: bool = True) -> DataFrame:
    """All findings, or those of the rules or categories in ``only``.  ``duplicates`` includes the content comparison."""
    p = prepared(crawl.pages)
    html = p.where(is_html())
    local = p.select("url", F.explode(local_findings()).alias("f")).select("f.rule", "f.severity", "url", "f.message", "f.evidence")
    parts = [local, *_link_rules(p, html), *_canonical_rules(p, html), *_duplicate_rules(html), *_site_rules(crawl, html)]
    if duplicates and (not only or {"content", "content.duplicate"} & set(only)):
        parts.append(_content_duplicates(html))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    wanted = [r for r, v in RULES.items() if not only or r in only or v[0] in only]
    return out if not only else out.where(F.col("rule").isin(*wanted))


def _weight(severity: Column) -> Column:
    return F.when(severity == "error", 10).when(severity == "warning", 3).otherwise(1)


def by_rule(issues: DataFrame) -> DataFrame:
    """(rule, severity, n), the weightiest first; severity: the most severe one found."""
    g = issues.groupBy("rule").agg(F.max_by("severity", _weight(F.col("severity"))).alias("severity"), F.count("*").alias("n"))
    return g.orderBy(F.desc(_weight(F.col("severity")) * F.col("n")), "rule")


def health_score(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages, errors, warnings, notices and the score 0..100."""
    n = lambda test: F.count_if(test)
    s = issues.agg(n(F.col("severity") == "error").alias("errors"), n(F.col("severity") == "warning").alias("warnings"), n(F.col("severity") == "notice").alias("notices"), n(F.col("rule").isin(*SITE_RULES)).alias("site"))
    j = s.crossJoin(F.broadcast(pages.agg(F.count("*").alias("pages"))))  # one row each
    m = F.greatest("pages", F.lit(8))
    weighted = F.greatest(F.lit(0.0), F.col("errors") * 10.0 + F.col("warnings") * 3 + F.least(F.col("notices").cast("double"), m * 2.5) - F.col("site") * 3)
    score = js_round(clamp(F.exp(-(weighted / m) / 8.5) * 100 - F.col("site") * 4, 0, 100), 1)
    return j.select("pages", "errors", "warnings", "notices", F.when(F.col("pages") == 0, 0.0).otherwise(score).alias("health_score"))


def issues_to_actions(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """One action per rule that has a fix, with an impact that grows with the share of pages affected."""
    dim = issues.sparkSession.createDataFrame([(r, *v[1:]) for r, v in RULES.items() if len(v) > 1], "rule string, priority string, effort string, fix_type string")
    total = F.broadcast(pages.agg(F.count("*").alias("pages"), F.count_if(F.col("depth") > DEPTH).alias("deep")))
    first = F.min_by("severity", "url")
    examples = first_k(issues, ["rule"], "url", 8, "examples")
    g = issues.groupBy("rule").agg(F.count("*").alias("n"), first.alias("severity")).join(examples, "rule", "left").join(F.broadcast(dim), "rule").crossJoin(total)
    site = F.col("rule").isin(*SITE_RULES)
    coverage = F.when(site, 0.0).otherwise(clamp(F.col("n") / F.greatest("pages", F.lit(8)), 0, 1))
    base = F.when(F.col("severity") == "error", 70).when(F.col("severity") == "warning", 45).otherwise(22)
    words = F.replace(F.col("fix_type"), F.lit("_"), F.lit(" "))
    title = F.when(site, words).otherwise(F.concat(words, F.lit(" on "), F.col("n").cast("string"), F.when(F.col("n") == 1, " page").otherwise(" pages")))
    rows = g.select(
        F.concat(F.lit("audit."), "rule").alias("id"), "priority", "effort", F.lit("technical-seo").alias("category"), title.alias("title"),
        _text("Found on %d of %d pages.", F.col("n"), F.col("pages")).alias("detail"), F.when(F.col("n") == 1, F.get("examples", F.lit(0))).alias("target"), js_round(clamp(base + coverage * 30, 0, 100), 1).alias("impact_score"),
        F.to_json(F.struct("rule", F.col("n").alias("affected_pages"), "examples")).alias("evidence"), F.to_json(F.struct(F.col("fix_type").alias("type"), F.col("examples").alias("affected"))).alias("fix"),
    )
    deep = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("depth") > DEPTH).alias("deep")).where("deep > pages * 0.3 and pages > 20").select(
        F.lit("audit.architecture.too_deep").alias("id"), F.lit("high").alias("priority"), F.lit("large").alias("effort"), F.lit("technical-seo").alias("category"), F.lit("flatten the site's architecture").alias("title"),
        _text("%d of %d pages are more than four clicks deep.", F.col("deep"), F.col("pages")).alias("detail"), F.lit(None).cast("string").alias("target"), F.lit(78.0).alias("impact_score"),
        F.to_json(F.struct("deep", "pages")).alias("evidence"), F.lit('{"type":"add_hub_pages"}').alias("fix"),
    )
    return rows.unionByName(deep)


def filter_issues(issues: DataFrame, severity: str | None = None, rule: str | None = None, url_contains: str | None = None) -> DataFrame:
    for name, value in (("severity", severity), ("rule", rule)):
        issues = issues if value is None else issues.where(F.col(name) == value)
    return issues if url_contains is None else issues.where(F.contains(F.lower("url"), F.lit(url_contains.lower())))


def ranked(rows: DataFrame, partition: str, *order: Column) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
