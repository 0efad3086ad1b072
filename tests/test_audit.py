import json

import pytest
from pyspark.sql import functions as F

from webloom.operators import audit, linkgraph
from webloom.operators.actions import quick_wins, rank_actions
from webloom.schemas import PAGE
from webloom.sources.crawl import allowed, crawl, filter_allowed, orphans, parse_robots, parse_sitemap, url_filter
from webloom.sources.html import extract_page, perf_signals, read_pages

ARTICLE = json.dumps({"@type": "Article", "headline": "h", "image": "i", "datePublished": "d"})


def page(url, **over):
    base = dict(
        url=url, final_url=url, status=200, redirect_chain=[], content_type="text/html", bytes=20000, fetch_ms=200, title=f"A fine title for {url[-12:]}",
        meta_description="m" * 100 + url, meta_robots=None, canonical=url, lang="en", headings=[(1, "H"), (2, "S")], h1=[f"H {url}"], text="word " * 2000, word_count=600, links=[],
        images=[], jsonld=[ARTICLE], social={"og:title": "t", "og:image": "i"}, hreflang=[], depth=0, error=None,
    )
    return tuple((base | over).values())


def found(spark, *pages, sitemap=None, duplicates=False, **site):
    p = spark.createDataFrame(list(pages), PAGE)
    s = spark.createDataFrame([(u,) for u in sitemap], "url string") if sitemap else None
    issues = audit.run_audit(audit.Crawl(p, s, origin="https://e.com", **site), duplicates=duplicates)
    return issues, p


def rules(spark, *pages, **how):
    return sorted(r.rule for r in found(spark, *pages, **how)[0].collect())


A, B, C = "https://e.com/a", "https://e.com/b", "https://e.com/c"


def test_clean_page_has_no_errors(spark):
    issues, p = found(spark, page(A), sitemap=[A])
    assert [r.rule for r in issues.collect()] == [] and audit.health_score(issues, p).first().health_score == 100.0


@pytest.mark.parametrize(
    "over, rule",
    [
        (dict(status=503), "status.5xx"), (dict(status=404), "status.4xx"), (dict(error="timeout", status=0), "status.fetch_failed"),
        (dict(final_url=B, redirect_chain=[A], canonical=B), "redirect.chain"), (dict(images=[("http://e.com/i.png", "x", 1.0, 1.0, None)]), "security.http_link"),
        (dict(meta_robots="NOINDEX, follow"), "index.noindex"), (dict(canonical=None), "canonical.missing"), (dict(canonical=B), "canonical.points_elsewhere"),
        (dict(title=None), "title.missing"), (dict(title="x" * 61), "title.too_long"), (dict(title="short"), "title.too_short"), (dict(meta_description=" "), "meta_description.missing"),
        (dict(meta_description="x" * 161), "meta_description.too_long"), (dict(meta_description="x"), "meta_description.too_short"), (dict(h1=[]), "h1.missing"), (dict(h1=["a", "b"]), "h1.multiple"),
        (dict(headings=[(1, "a"), (3, "b")]), "headings.skipped_level"), (dict(lang=None), "lang.missing"), (dict(word_count=150), "content.thin"), (dict(word_count=0, jsonld=[]), "content.empty"),
        (dict(text="x"), "content.low_text_ratio"), (dict(depth=5, word_count=600), "links.deep_page"), (dict(depth=1), "links.few_inbound"),
        (dict(links=[(f"https://x.com/{k}", "t", None, False, False) for k in range(151)]), "links.too_many"), (dict(links=[(B, "Click here", None, True, False)]), "links.generic_anchor"),
        (dict(links=[(B, "topic", "nofollow", True, True)]), "links.internal_nofollow"), (dict(images=[("https://e.com/i.png", None, 1.0, 1.0, None)]), "images.missing_alt"),
        (dict(images=[("https://e.com/i.png", "x", None, 1.0, None)]), "images.missing_dimensions"), (dict(jsonld=[]), "schema.missing"), (dict(jsonld=['{"__parse_error": "{"}']), "schema.parse_error"),
        (dict(jsonld=['{"@type": ["Product", "Thing"], "name": "x"}']), "schema.incomplete"), (dict(social={}), "social.missing_og"), (dict(hreflang=[("xx-bad-code", A)]), "hreflang.invalid_code"),
        (dict(hreflang=[("en", A), ("de", B)]), "hreflang.missing_x_default"), (dict(fetch_ms=1600), "performance.slow_response"), (dict(bytes=3 << 20, text="word " * 200000), "performance.large_page"),
    ],
)
def test_local_rules(spark, over, rule):
    assert rule in rules(spark, page(A, **over), sitemap=[A])


def test_url_rules(spark):
    long = "https://e.com/" + "x" * 110
    assert "url.too_long" in rules(spark, page(long), sitemap=[long])
    assert "url.non_ideal_format" in rules(spark, page("https://e.com/A_b"), sitemap=["https://e.com/A_b"])


def test_severity_rises(spark):
    issues, _ = found(spark, page(A, word_count=40, fetch_ms=4000), sitemap=[A])
    got = {r.rule: r.severity for r in issues.collect()}
    assert got["content.thin"] == "error" and got["performance.slow_response"] == "error"


def test_rules_over_pages(spark):
    link = lambda u: (u, "topic", None, True, False)
    got = rules(spark, page(A, links=[link(B), link(B), link(C)]), page(B, status=404), page(C, final_url=C + "/x", canonical=C + "/x", redirect_chain=[C]), sitemap=[A])
    assert got.count("links.broken_internal") == 1 and got.count("links.to_redirect") == 1
    assert "canonical.broken" in rules(spark, page(A, canonical=B), page(B, status=404), sitemap=[A])
    assert "canonical.chain" in rules(spark, page(A, canonical=B), page(B, canonical=C), page(C), sitemap=[A])
    assert "images.broken" in rules(spark, page(A, images=[(B, "x", 1.0, 1.0, None)]), page(B, status=404), sitemap=[A])
    assert "hreflang.no_return_link" in rules(spark, page(A, hreflang=[("de", B), ("x-default", A)]), page(B, hreflang=[("de", B), ("x-default", B)]), sitemap=[A, B])


def test_duplicates(spark):
    same = dict(title="One and the same title here")
    assert rules(spark, page(A, **same), page(B, **same), sitemap=[A, B]).count("title.duplicate") == 2
    assert "title.duplicate" not in rules(spark, page(A, **same), page(B, canonical=A, **same), sitemap=[A, B])
    text = " ".join(f"alpha{k} beta{k}" for k in range(80))
    assert rules(spark, page(A, text=text), page(B, text=text), sitemap=[A, B], duplicates=True).count("content.duplicate") == 2


def test_site_rules_and_sitemap(spark):
    assert {"sitemap.missing", "robots.missing"} <= set(rules(spark, page(A), robots_exists=False))
    got = rules(spark, page(A, meta_robots="noindex"), page(B), sitemap=[A])
    assert "index.noindex_in_sitemap" in got and "index.not_in_sitemap" in got
    o = spark.createDataFrame([(C,)], "url string")
    assert "index.orphan" in rules(spark, page(A), sitemap=[A], orphans=o)


def test_empty_crawl(spark):
    p = spark.createDataFrame([], PAGE)
    issues = audit.run_audit(audit.Crawl(p), duplicates=True)
    assert {r.rule for r in issues.collect()} == {"sitemap.missing"}
    assert audit.health_score(issues, p).first().health_score == 0.0


def test_only_and_rule_catalogue(spark):
    assert len(audit.RULES) == 53 and sum(len(v) > 1 for v in audit.RULES.values()) == 34
    p = spark.createDataFrame([page(A, title=None, lang=None)], PAGE)
    assert {r.rule for r in audit.run_audit(audit.Crawl(p), ["on-page"], False).collect()} == {"title.missing"}


def test_actions_are_ranked(spark):
    issues, p = found(spark, page(A, title=None, canonical=None), sitemap=[A])
    ranked = rank_actions(audit.issues_to_actions(issues, p))
    ids = [r.id for r in ranked.collect()]
    assert ids[0] == "audit.title.missing" and len(ids) == len(set(ids)) and quick_wins(ranked).count() >= 1


def test_pagerank_closed_forms(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    nodes = frame([(x,) for x in "abc"], "node string")
    assert {r.page_rank for r in linkgraph.pagerank(nodes, frame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")).collect()} == {100.0}
    chain = linkgraph.pagerank(frame([(x,) for x in "1234"], "node string"), frame([("1", "2"), ("2", "3"), ("3", "4")], "src string, dst string"))
    assert [r.page_rank for r in chain.orderBy("node").collect()] == pytest.approx([31.38, 58.06, 80.73, 100], abs=0.05)
    assert linkgraph.pagerank(frame([], "node string"), frame([], "src string, dst string")).count() == 0


def test_link_graph_and_opportunities(spark):
    words = "we sell invoice software for small teams every day. " + "other words stand here. " * 30
    p = spark.createDataFrame([page(A, title="Invoice software", h1=["Invoice software"], word_count=200, text="about " * 90), page(B, title="News of the day", h1=["News"], text=words, word_count=200), page(C, depth=2, word_count=50)], PAGE)
    g = {r.url: r for r in linkgraph.link_graph(p, 5).collect()}
    assert g[C].orphan and not g[A].orphan
    got = linkgraph.link_opportunities(p).collect()
    assert [(r.to_url, r.from_url, r.anchor) for r in got] == [(A, B, "invoice software")] and "invoice software" in got[0].context


HTML = """<html lang="en-GB"><head><title> Big  title </title><meta name="description" content=" d "><link rel="canonical" href="/c"><link rel="stylesheet" href="s.css"><script src="x.js"></script>
<meta property="og:title" content="T"><link rel="alternate" hreflang="DE" href="/de"><script type="application/ld+json">{"@graph":[{"@type":"Product"}]}</script><script type="application/ld+json">{bad</script></head>
<body><nav><a href="/n">N</a></nav><article><h1>Head</h1><p>%s</p><a href="https://other.org/x" rel="nofollow">o</a><img data-src="/i.png" width="10"></article><footer>foot</footer></body></html>""" % ("many words " * 40)


def test_extract_page():
    p = extract_page("https://www.e.co.uk/a/", HTML)
    assert p["title"] == "Big title" and p["canonical"] == "https://www.e.co.uk/c" and p["lang"] == "en-GB" and p["h1"] == ["Head"] and p["meta_description"] == "d"
    assert [(x["internal"], x["nofollow"]) for x in p["links"]] == [(True, False), (False, True)]
    assert p["images"] == [{"src": "https://www.e.co.uk/i.png", "alt": None, "width": 10.0, "height": None, "loading": None}]
    assert json.loads(p["jsonld"][0])["@type"] == "Product" and "__parse_error" in p["jsonld"][1] and p["hreflang"] == [{"lang": "de", "href": "https://www.e.co.uk/de"}]
    assert "foot" not in p["text"] and "many words" in p["text"]
    assert perf_signals(HTML)["render_blocking_css"] == 1 and perf_signals(HTML)["render_blocking_js"] == 1


def test_read_pages_with_nulls(spark):
    df = read_pages(spark.createDataFrame([("https://e.com/", HTML), ("https://e.com/n", None)], "url string, html string"))
    got = {r.url: r for r in df.collect()}
    assert got["https://e.com/n"].error and got["https://e.com/"].word_count > 50


def test_robots_and_sitemaps(spark):
    text = "User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y$\nCrawl-delay: 2\nSitemap: https://e.com/s.xml\n\nUser-agent: bot\nDisallow: /"
    own = parse_robots(text, "other")
    assert own["delay"] == 2 and own["sitemaps"] == ["https://e.com/s.xml"]
    assert not allowed("/x/z", own["rules"]) and allowed("/x/y", own["rules"]) and not allowed("/q", parse_robots(text, "my bot")["rules"])
    urls = spark.createDataFrame([("https://e.com/x/1",), ("https://e.com/ok",)], "url string")
    assert [r.url for r in filter_allowed(urls, text).collect()] == ["https://e.com/ok"] and filter_allowed(urls, "<html>").count() == 2
    assert parse_sitemap("<urlset><url><loc> https://e.com/?a=1&amp;b=2 </loc></url></urlset>") == (["https://e.com/?a=1&b=2"], [])
    assert [r.url for r in url_filter(urls, ["/OK/i"], ["/x/"]).collect()] == ["https://e.com/ok"]


def test_offline_crawl(spark):
    link = lambda u: (u, "t", None, True, False)
    p = spark.createDataFrame([page(A, links=[link(B + "/")]), page(B, links=[link(C), link(A)]), page(C), page("https://e.com/lost")], PAGE)
    got, stopped = crawl(p, [A])
    assert [(r.url, r.depth) for r in got.orderBy("depth").collect()] == [(A, 0), (B, 1), (C, 2)]
    assert [r.url for r in orphans(p.select("url"), got.select("url")).collect()] == ["https://e.com/lost"]
    none, _ = crawl(p, ["https://nowhere.com/"])
    assert none.count() == 0


def test_filters(spark):
    issues, _ = found(spark, page(A, title=None, lang=None), sitemap=[A])
    assert [r.rule for r in audit.filter_issues(issues, severity="error", url_contains="E.COM").collect()] == ["title.missing"]
    assert audit.by_rule(issues).first().rule == "title.missing" and issues.where(F.col("rule") == "x").isEmpty()
