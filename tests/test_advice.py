from pyspark.sql import functions as F

from webloom.functions import copy as C
from webloom.operators import advice as V
from webloom.operators.actions import rank_actions


def test_headlines_and_titles(spark):
    df = spark.createDataFrame([("best crm for the small team", "comparison"), ("what is seo", "glossary"), ("a very long keyword that goes on and on past sixty characters", "guide")], "k string, p string")
    got = df.select(C.headline(F.col("k")).alias("h"), C.headline(F.col("k"), "es").alias("es"), C.page_title(F.col("k"), F.col("p"), 2030).alias("t"), C.sections(F.col("k"), F.col("p")).alias("s"), C.schema_type(F.col("p"), F.lit("commercial")).alias("x"), C.data_requirements(F.col("p")).alias("d")).collect()
    assert got[0].h == "Best CRM for the Small Team" and got[0].es == "Best crm for the small team" and got[1].t == "What is SEO: meaning and use"
    assert got[0].t == "Best CRM for the Small Team side by side (2030)" and got[2].t.endswith("...") and len(got[2].t) == 60
    assert len(got[0].s) == 6 and got[0].x == "ItemList" and "pricing_tiers" in got[0].d and len(got[2].s) == 4
    m = df.select(C.meta_description(F.lit("crm"), F.lit("commercial")).alias("m"), C.suggested_title(F.lit("crm tools"), F.lit("commercial"), F.lit(False), F.lit(True), 2030).alias("t"), C.target_words(F.col("p"), F.lit("x")).alias("w")).first()
    assert m.m.startswith("Which crm suits you?") and m.t == "CRM Tools side by side (2030)" and m.w == 1400


def test_insight_actions(spark):
    frame = spark.createDataFrame
    striking = frame([("q1", "/a", 12.0, 1000, 5, 60, 55), ("q2", "/a", 14.0, 1000, 5, 120, 115)], "query string, page string, position double, impressions int, clicks int, potential_clicks int, potential_gain int")
    ctr = frame([("q", None, 2.0, 1000, 10, 1.0, 15.0, 140)], "query string, page string, position double, impressions int, clicks int, actual_ctr double, expected_ctr double, potential_gain int")
    cannibal = frame([("q", 900, 2, "/best", "high"), ("r", 900, 2, "/x", "low")], "query string, total_impressions int, n_pages int, primary_page string, severity string")
    decay = frame([("/d", 200, 50, -150, -75.0, 3.0, 15.0, "lost_rankings")], "page string, clicks_before int, clicks_after int, change int, change_pct double, position_before double, position_after double, likely_cause string")
    rising = frame([("new", 0, 500, 100.0, 30.0, True)], "query string, impressions_before int, impressions_after int, growth_pct double, position double, untapped boolean")
    got = rank_actions(V.insight_actions(striking, ctr, cannibal, decay, rising)).collect()
    assert [r.id for r in got][0] == "gsc.striking./a" and {r.id for r in got} == {"gsc.striking./a", "gsc.ctr.q", "gsc.cannibal.q", "gsc.decay./d", "gsc.rising.new"}
    assert got[0].priority == "critical" and 0 < got[0].impact_score <= 100 and '"gain":170' in got[0].evidence


def test_other_actions(spark):
    frame = spark.createDataFrame
    graph = frame([("/o", True), ("/p", False)], "url string, orphan boolean")
    opp = frame([("/t", "/s", "topic", "a topic here", 60.0)], "to_url string, from_url string, anchor string, context string, score double")
    assert {r.id for r in V.link_actions(graph, opp).collect()} == {"links.orphans_unlinked", "links.opportunity./t"}
    pages, issues = frame([("/x", "removed")], "url string, kind string"), frame([("r", "/y", "error", "new")], "rule string, url string, severity string, kind string")
    one, other = frame([("/z", True)], "url string, indexable boolean"), frame([("/z", False)], "url string, indexable boolean")
    assert {r.id for r in V.diff_actions(pages, issues, one, other, (90.0, 60.0)).collect()} == {"diff.new_errors", "diff.pages_disappeared", "diff.deindexed", "diff.health_declined"}
    assert V.diff_actions(pages.limit(0), issues.limit(0), one, one).count() == 0
    checks = frame([(1, "crm", False, True, True, False, 300, 1000, True, 20.0, ["a", "b"])], "doc_id int, keyword string, has_title boolean, has_h1 boolean, has_intro boolean, has_meta boolean, word_count int, target_words int, over_optimized boolean, reading_ease double, missing array<string>")
    assert {r.id.split(".")[1] for r in V.draft_actions(checks).collect()} == {"title", "meta", "length", "stuffing", "readability", "terms"}
    patterns = frame([("{x} alternatives", 5, 5, 100, 20.0, 72.0)], "template string, n_entities int, match_count int, total_volume int, avg_difficulty double, viability double")
    assert [(r.id, r.priority) for r in V.pattern_actions(patterns).collect()] == [("pseo.pattern.x-alternatives", "high")]
    report = frame([(4, 35.0, 10.0, 30.0)], "answers int, visibility_rate double, citation_rate double, visibility_score double")
    share, mood = frame([("Rival", 6, 60.0)], "name string, mentions int, share_pct double"), frame([(-50.0, "negative")], "score double, label string")
    assert {r.id for r in V.visibility_actions(report, share, mood).collect()} == {"ai.low_visibility", "ai.mentioned_not_cited", "ai.competitor_dominance", "ai.negative_narrative"}
    speed = frame([("/a", 40.0, 3000.0, 300.0, 0.0, [(100.0, "x", "X")]), ("/b", 40.0, 100.0, 10.0, 0.0, [(1500.0, "x", "X")])], "url string, score double, lcp_ms double, inp_ms double, cls double, opportunities array<struct<savings_ms:double,id:string,title:string>>")
    assert {r.id: r.priority for r in V.speed_actions(speed).collect()} == {"cwv./a": "high", "perf.headroom./b": "low"}
    assert len(V.default_prompts("crm", 2030)) == 5 and len(V.default_prompts("crm", 2030, "Acme")) == 7


def test_outline(spark):
    df = spark.createDataFrame([(["Pricing of tools"], ["what is crm?"], ["pricing", "free trial"])], "s array<string>, q array<string>, t array<string>")
    rows = df.select(V.outline(F.lit("crm tools"), F.lit("commercial"), F.col("s"), F.col("q"), F.col("t")).alias("o")).first().o
    assert [(r.level, r.heading) for r in rows] == [(1, "CRM Tools"), (2, "CRM Tools in short"), (2, "Pricing of tools"), (2, "Free Trial"), (2, "Questions people ask"), (3, "what is crm?"), (2, "Which option should you choose?")]
