import json

import pytest

from webloom.plans.envelope import Budget, Envelope, ToolError
from webloom.plans.store import Store
from webloom.plans.tools import TOOLS, Context, call
from webloom.sources import payloads as Y

SITE = "https://shop.org/"


def html(k, links):
    text = f"Page number {k} about invoice software for small teams. " + " ".join(f"word{k}x{i}" for i in range(150))
    return f"<html lang='en'><head><title>Invoice software page {k} of the shop</title></head><body><article><h1>Topic {k}</h1><p>{text}</p>{''.join(f'<a href={u!r}>page of topic {u[-1]}</a>' for u in links)}</article></body></html>"


@pytest.fixture(scope="module")
def ctx(spark, tmp_path_factory):
    raw = [(SITE, html(0, ["/a", "/b"])), (f"{SITE}a", html(1, ["/b"])), (f"{SITE}b", html(2, ["/c", "/"])), (f"{SITE}c", html(3, []))]
    serp = {"organic": [{"position": 1, "link": f"{SITE}a", "title": "A"}, {"link": "https://www.rival.com/x", "title": "B"}, {"title": "no link"}], "peopleAlsoAsk": [{"question": "what is crm"}], "answerBox": {"a": 1}}
    ranked = {"items": [{"keyword_data": {"keyword": "CRM tools", "keyword_info": {"search_volume": 900, "cpc": 1.0}}, "ranked_serp_element": {"serp_item": {"rank_absolute": 3, "url": "u"}}}, {"keyword": "flat one", "position": 7, "search_volume": 100}, {"keyword": "lost"}]}
    speed = {"loadingExperience": {"metrics": {"LARGEST_CONTENTFUL_PAINT_MS": {"percentile": 3000}, "CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 5}}}, "lighthouseResult": {"categories": {"performance": {"score": 0.42}}, "audits": {"x": {"title": "X", "score": 0.1, "details": {"overallSavingsMs": 400}}, "y": {"title": "Y", "score": 1}}}}
    pay = lambda *rows: spark.createDataFrame([(k, json.dumps(b)) for k, b in rows], "key string, body string")
    perf = [(q, p, d, c, i, c / i, x) for q, p, d, c, i, x in (("near", "https://shop.org/a", "2026-01-20", 5, 1000, 12.0), ("top", "https://shop.org/b", "2026-01-20", 300, 1000, 2.0), ("old", "https://shop.org/b", "2025-12-20", 30, 300, 2.0))]
    inputs = {
        "raw_pages": spark.createDataFrame(raw, "url string, html string"), "serp": pay(("crm", serp)), "ranked": pay(("rival.com", ranked)), "page_speed": pay((SITE, speed)),
        "authority": pay(("rival.com", {"score": 6.5})), "backlinks": pay(("shop.org", {"items": [{"url_from": "u1", "anchor": " Shop ", "dofollow": False, "domain_from_rank": 3}, {"url_from": "u2", "anchor": "shop"}]})),
        "link_gap": pay(("blog.com", {"domain_intersection": {"1": {}, "2": {}, "99": {}}})), "metrics": pay(("m", {"result": [{"keyword": "CRM", "search_volume": 100, "cpc": 2.0, "monthly_searches": [{"year": 2025, "month": 2, "search_volume": 5}, {"year": 2025, "month": 1}]}]})),
        "suggestions": spark.createDataFrame([("crm", "one", '["crm", ["crm software", "best <b>crm</b>"]]'), ("crm a", "two", '[{"phrase": "crm app"}]')], "key string, engine string, body string"),
        "answers": spark.createDataFrame([("Use Rival or C++ Shop. Fine.", True), ("Only rival.", False)], "text string, domain_cited boolean"),
        "performance": spark.createDataFrame(perf, "query string, page string, date string, clicks bigint, impressions bigint, ctr double, position double").selectExpr("query", "page", "cast(date as date) as date", "clicks", "impressions", "ctr", "position"),
    }
    return Context(spark, Store(spark, str(tmp_path_factory.mktemp("store"))), inputs)


def ok(ctx, name, /, **args):
    e = call(ctx, name, **args)
    assert e.ok, e.error
    return json.loads(e.to_json())["data"]


def test_site_tools(ctx):
    crawl = ok(ctx, "seo_crawl_site", url=SITE, sitemap=[SITE, f"{SITE}lost"])
    assert {i["rule"] for i in crawl["issues"]} >= {"index.orphan", "canonical.missing"} and crawl["health"][0]["pages"] == 4
    assert ok(ctx, "seo_audit_issues", site="www.shop.org", rule="index.orphan")["issues"][0]["url"] == f"{SITE}lost"
    assert ok(ctx, "seo_page_inspect", url=SITE)["page"][0]["lang"] == "en"
    assert len(ok(ctx, "seo_internal_links", site="shop.org")["nodes"]) == 4
    ok(ctx, "seo_link_opportunities", site="shop.org")
    assert ok(ctx, "seo_next_actions", site="shop.org")["actions"]
    cut = call(ctx, "seo_crawl_site", url=SITE, max_depth=1, sitemap=[SITE, f"{SITE}lost"])
    second = json.loads(cut.to_json())["data"]
    assert crawl["stopped_reason"] == "complete" and second["stopped_reason"] == "max_depth" and cut.warnings and not second["orphans"]
    assert "index.orphan" not in {i["rule"] for i in second["issues"]} and ok(ctx, "seo_crawl_site", url=SITE, max_pages=2)["stopped_reason"] == "max_pages"
    assert ok(ctx, "seo_crawl_history", site="hop.org")["crawls"] == []
    second = ok(ctx, "seo_crawl_site", url=SITE, max_depth=1)["crawl_id"]
    diff = ok(ctx, "seo_crawl_diff", from_crawl=crawl["crawl_id"], to_crawl=second)
    assert {(p["kind"], p["url"]) for p in diff["pages"]} >= {("removed", f"{SITE}c")}
    assert ok(ctx, "seo_crawl_history", site="shop.org")["trend"][0]["crawls"] == 4
    assert call(ctx, "seo_audit_issues", crawl_id=5).error["code"] == "INVALID_INPUT"


def test_keyword_tools(ctx):
    words = ["best crm software", "crm software", "notion alternatives", "slack alternatives", "trello alternatives", "asana alternatives"]
    assert {k["keyword"] for k in ok(ctx, "seo_keyword_ideas", seed="crm", strategies=("plain", "alphabet"))["keywords"]} == {"crm software", "best crm", "crm app"}
    m = {k["keyword"]: k for k in ok(ctx, "seo_keyword_metrics", keywords=["CRM", "other thing"])["keywords"]}
    assert m["crm"]["volume"] == 100 and m["other thing"]["volume"] is None
    assert {k["keyword"]: k["method"] for k in ok(ctx, "seo_keyword_difficulty", keywords=["crm", "x y"], authority=50)["keywords"]} == {"crm": "serp", "x y": "lexical"}
    ok(ctx, "seo_cluster_keywords", keywords=words)
    ok(ctx, "seo_cluster_keywords", keywords=["crm", "x y"], use_serp=True)
    assert ok(ctx, "pseo_discover_patterns", keywords=words)["patterns"][0]["template"] == "{x} alternatives"
    plan = ok(ctx, "pseo_build_plan", keywords=words, template="{x} alternatives", base_path="/alt")
    assert len(plan["pages"]) == 4 and len(plan["links"]) == 12
    assert call(ctx, "seo_keyword_metrics").error["code"] == "INVALID_INPUT"


def test_keyword_tools_in_depth(ctx):
    deep = ok(ctx, "seo_keyword_ideas", seed="crm", strategies=("plain",), engines=["one"], depth=2, save_to_project="ideas")["keywords"]
    assert {k["keyword"] for k in deep} == {"crm software", "best crm"} and ctx.store.read("keywords").where("project = 'ideas'").count() == 2
    words = ["notion alternatives", "slack alternatives", "trello alternatives", "asana alternatives"]
    e = call(ctx, "pseo_build_plan", keywords=words, base_path="/alt", max_pages=2)
    plan = json.loads(e.to_json())["data"]
    assert plan["template"] == "{x} alternatives" and plan["hub"][0] == {"slug": "alt", "title": "Alternatives", "h1": "Alternatives", "links_to": 2} and len(e.warnings) == 2
    assert "entity_name" in {f["field"] for f in plan["data_model"]}


def test_performance_tools(ctx):
    assert ok(ctx, "seo_gsc_sites")["sites"] == [{"site": "https://shop.org"}]
    assert ok(ctx, "seo_gsc_performance", end="2026-01-21", filters=[("query", "contains", "nea")])["rows"][0]["query"] == "near"
    got = ok(ctx, "seo_gsc_opportunities", end="2026-01-21")
    assert got["striking"][0]["query"] == "near" and got["rising"]
    assert set(ok(ctx, "seo_gsc_opportunities", end="2026-01-21", include=["rising"])) == {"rising", "actions"}
    assert call(ctx, "seo_gsc_opportunities", include=["no"]).error["code"] == "INVALID_INPUT"
    assert "fewer than" in call(ctx, "seo_gsc_performance", end="2026-01-21", min_impressions=10**9).warnings[0]
    ok(ctx, "seo_gsc_performance", end="2026-01-21", dimensions=("query", "page"), save_snapshot=True, project="snap")
    changes = ok(ctx, "seo_rank_changes", project="snap")["changes"]
    assert [c["impressions"] for c in changes] == sorted((c["impressions"] for c in changes), reverse=True) and changes[0]["url"]
    assert "Nothing was stored" in call(ctx, "seo_gsc_performance", end="2026-01-21", save_snapshot=True).warnings[0]


def test_serp_tools(ctx):
    s = ok(ctx, "seo_serp", keyword="CRM")
    assert [(r["position"], r["domain"]) for r in s["results"]] == [(1, "shop.org"), (2, "rival.com")] and {f["feature"] for f in s["features"]} == {"featured_snippet", "people_also_ask"}
    assert ok(ctx, "seo_rank_check", domain="shop.org", project="p")["summary"][0]["ranking"] == 1
    assert ok(ctx, "seo_rank_changes", project="p")["changes"][0]["position"] == 1.0
    assert ok(ctx, "seo_competitors_discover", your_domain="shop.org")["competitors"][0]["domain"] == "rival.com"
    assert {g["keyword"] for g in ok(ctx, "seo_content_gap", your_domain="shop.org")["gaps"]} == {"crm tools", "flat one"}
    assert ok(ctx, "seo_domain_authority", scale=10)["domains"][0]["score"] == 65.0
    b = ok(ctx, "seo_backlinks", target="shop.org")
    assert b["anchors"] == [{"anchor": "shop", "n": 2}] and b["backlinks"][0]["nofollow"]
    assert ok(ctx, "seo_link_gap", competitors=["x", "y"])["domains"] == [{"source": "blog.com", "competitors": 2}]


def test_content_tools(ctx):
    b = ok(ctx, "seo_content_brief", keyword="crm")
    assert b["benchmarks"][0]["analysed"] == 1 and b["questions"] == [{"question": "what is crm"}]
    draft = "# CRM software guide\n\n" + "CRM software helps teams that sell and support people every single day of the year with care. " * 2 + "\n\n## Why CRM software\n\n- one\n- two\n\n## How\n\ntext [a](/a) [b](/b)"
    good = ok(ctx, "seo_content_score", keyword="crm software", title="CRM software", url="/crm-software", body=draft)["score"][0]
    stuffed = ok(ctx, "seo_content_score", keyword="crm software", title="x", body="crm software " * 40)["score"][0]
    assert good["score"] > stuffed["score"] and stuffed["over_optimized"] and not good["over_optimized"]
    assert ok(ctx, "seo_page_optimize", url=f"{SITE}a", keyword="crm")["score"]
    v = ok(ctx, "seo_ai_visibility", brand="C++ Shop", competitors=["Rival", "None"])
    assert v["report"][0]["visibility_rate"] == 50.0 and v["answers"][0]["competitors_mentioned"] == ["Rival"] and v["share"][0]["mentions"] == 2
    s = ok(ctx, "seo_page_speed")
    assert s["speed"][0]["score"] == 42.0 and [o["id"] for o in s["speed"][0]["opportunities"]] == ["x"] and [f["metric"] for f in s["findings"]] == ["lcp_ms"]
    drafts = ctx.spark.createDataFrame([(i, "T", "same words in all of the drafts here " * 10 + f"entity{i}", "m") for i in range(5)], "doc_id int, title string, text string, meta_description string")
    assert ok(ctx, "pseo_check_index_risk", drafts=drafts)["risk"][0]["verdict"] == "do_not_publish"


def test_brief_without_result_pages(ctx):
    e = call(ctx, "seo_content_brief", keyword="what is erp", cluster_keywords=["erp meaning"], questions=["What is ERP?"])
    b = json.loads(e.to_json())["data"]
    assert e.warnings and b["plan"][0]["target_words"] == 1500 and b["terms"][0] == {"term": "erp meaning", "document_frequency": 0, "avg_count": 0.0} and b["questions"] == [{"question": "What is ERP?"}]
    with_pages = ok(ctx, "seo_content_brief", keyword="crm")
    assert with_pages["format_signals"][0]["analysed"] == 1 and with_pages["format_signals"][0]["common_schema"] == []


def test_lookups_are_cached_and_counted(ctx):
    before = {r["provider"]: r["units"] for r in ok(ctx, "seo_usage")["usage"]}
    first, spent = ok(ctx, "seo_page_speed"), ctx.budget.spent
    assert ok(ctx, "seo_page_speed") == first and ctx.budget.spent == spent
    after = {r["provider"]: r["units"] for r in ok(ctx, "seo_usage")["usage"]}
    assert after["page_speed"] - before.get("page_speed", 0) in (0, 1) and after["page_speed"] == 1


def test_draft_scores(ctx):
    draft = "# CRM\n\n![CRM screen](x.png)\n\n| crm | b |\n|---|---|\n| c | d |\n\nSee [this](/a) and [that](./b)."
    got = call(ctx, "seo_content_score", keyword="crm", body=draft, required=["screen", "price"])
    s = json.loads(got.to_json())["data"]["score"][0]
    where = {p["location"]: (p["present"], p["applicable"]) for p in s["placements"]}
    assert where["image_alt"] == (True, True) and where["title"] == (False, False) and where["url"] == (False, False) and where["h1"] == (True, True)
    assert s["missing"] == ["price"] and s["internal_links"] == 2 and {a["id"].split(".")[1] for a in json.loads(got.to_json())["data"]["actions"]} == {"terms"}
    page = ok(ctx, "seo_page_optimize", url=f"{SITE}a", keyword="crm")["score"][0]
    assert all(p["applicable"] for p in page["placements"])
    spanish = ok(ctx, "seo_content_score", keyword="crm", body="Una frase corta.", language="es")["score"][0]
    assert spanish["reading_ease"] != ok(ctx, "seo_content_score", keyword="crm", body="Una frase corta.")["score"][0]["reading_ease"]


def test_prose_of_markdown():
    from webloom.operators.content import _prose

    assert _prose("| a | b |\n|---|---|\n| c | **d** |") .split() == ["a", "b", "c", "d"]
    assert _prose("> 1. *one* `code` ![alt](u) [text](v)\n```\nx\n```\n# Head\n- item ~~old~~ <b>bold</b>") == "one   alt text\nHead\nitem old  bold"


def test_command_line():
    from webloom.plans.cli import parse, settings

    defaults = {"keywords": ("x",), "limit": 10, "url": "", "robots": None}
    assert parse(["--keywords", "a", "--limit=5", "--url", "7"], defaults) == {"keywords": ["a"], "limit": 5, "url": "7"}
    assert parse(["--keywords", "a", "--keywords", "b", "--robots"], defaults) == {"keywords": ["a", "b"], "robots": True}
    with pytest.raises(ToolError) as e:
        parse(["--keyword", "a"], defaults)
    assert "--keywords" in e.value.remedy
    own = settings({"WEBLOOM_YEAR": "2030"}, "export WEBLOOM_STORE='s'\n# c\nWEBLOOM_YEAR=1\nWEBLOOM_BUDGET=3")
    assert own == {"store": "s", "budget": 3.0, "rows": 100, "year": 2030}


def test_failed_tasks(ctx):
    from webloom.plans.envelope import split_failed

    rows = ctx.spark.createDataFrame([(1, None), (2, "timeout")], "k int, error string")
    good, notes = split_failed(rows)
    assert [r.k for r in good.collect()] == [1] and "1 of 2" in notes[0]
    with pytest.raises(ToolError):
        split_failed(rows.where("error is not null"))
    assert split_failed(rows.limit(0))[1] == []


def test_store_versions(ctx, tmp_path):
    store = Store(ctx.spark, str(tmp_path / "v"))
    for k in range(3):
        store.set_project(f"p{k}", SITE)
        assert store.read("projects").count() == k + 1
    assert len([p for p in (tmp_path / "v" / "projects").iterdir() if p.name.startswith("v")]) == 2


def test_meta_tools(ctx):
    assert ok(ctx, "seo_project_set", name="p", site=SITE)["projects"][0]["name"] == "p"
    ok(ctx, "seo_project_set", name="p", site="https://new.org/", competitors=["x"])
    assert [p["site"] for p in ok(ctx, "seo_project_list")["projects"]] == ["https://new.org/"]
    ctx.store.record_usage("one", "t", 3)
    assert {"provider": "one", "calls": 1, "units": 3} in ok(ctx, "seo_usage")["usage"]
    ok(ctx, "seo_cache_clear")
    assert len(ok(ctx, "seo_capabilities")["capabilities"]) == 10 and len(TOOLS) == 36
    assert call(ctx, "nope").error["code"] == "NOT_FOUND" and call(ctx, "seo_serp", wrong=1).error["code"] == "INVALID_INPUT"


def test_store_keywords(ctx):
    k = ctx.spark.createDataFrame([("crm", 10, 5.0, None, "commercial", "seed")], "keyword string, volume bigint, difficulty double, cpc double, intent string, source string")
    ctx.store.save_keywords("q", k)
    ctx.store.set_tracked("q", ["CRM"])
    ctx.store.save_keywords("q", k.selectExpr("keyword", "cast(null as bigint) as volume", "difficulty", "2.0d as cpc", "intent", "source"))
    row = ctx.store.read("keywords").first()
    assert (row.volume, row.cpc, row.tracked) == (10, 2.0, True)
    assert ok(ctx, "seo_keyword_metrics", project="q")["keywords"]


def test_envelope_spills_and_budget(ctx, tmp_path):
    e = Envelope(True, {"rows": ctx.spark.range(10)})
    out = json.loads(e.to_json(3, str(tmp_path)))
    assert len(out["data"]["rows"]) == 3 and ctx.spark.read.json(out["meta"]["rows"]["artifact"]).count() == 10
    b = Budget(5)
    b.reserve(4)
    for budget in (b, Budget(0), Budget(float("nan"))):
        with pytest.raises(ToolError):
            budget.reserve(2)
    Budget().reserve(10**9)


def test_metrics_payload(ctx):
    assert [m.volume for m in Y.keyword_metrics(ctx.inputs["metrics"]).first().monthly_volumes] == [0, 5]
