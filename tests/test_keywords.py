import pytest
from pyspark.sql import functions as F

from webloom.operators import clusters, insights, keywords as K, programmatic as P, ranks as R, similarity as N
from webloom.operators.serp import content_gap, link_gap, overlap_pairs, serp_competitors


def intents(spark, *words, brands=()):
    df = spark.createDataFrame([(w,) for w in words], "keyword string")
    return {r.keyword: r for r in K.classify_intent(df, brands).collect()}


def test_intents(spark):
    got = intents(spark, "buy crm", "best crm software", "how to choose a crm", "crm login", "cómo funciona el software de fichaje", "zzz", "zzz yyy xxx qqq")
    assert [r.intent for r in got.values()] == ["transactional", "commercial", "informational", "navigational", "informational", "commercial", "informational"]
    assert got["zzz"].confidence == 0.3 and got["how to choose a crm"].is_question and not got["buy crm"].is_question
    assert intents(spark, "buy acme crm", brands=("Acme",))["buy acme crm"].intent == "navigational"
    assert intents(spark, "¿que es crm", "is crm free", "crm?", "qué crm", "island crm") and intents(spark, "island crm")["island crm"].is_question is False


def test_opportunity(spark):
    rows = [("a", 1000, 10.0, 2.0, 15.0), ("b", 1000, 90.0, 2.0, None), ("c", None, None, None, None), ("d", 1000, 10.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "keyword string, volume bigint, difficulty double, cpc double, position double")
    got = {r.keyword: r for r in K.score_keywords(df).collect()}
    assert got["a"].striking_distance and got["a"].opportunity > got["d"].opportunity > 0 and got["b"].opportunity < got["a"].opportunity
    assert got["c"].traffic_upside is None and got["c"].value_upside is None and got["c"].opportunity > 0


def test_difficulty(spark):
    df = spark.createDataFrame([(k,) for k in ("crm", "best crm software", "how to pick a crm for teams")], "keyword string").select("keyword", K.lexical_difficulty(F.col("keyword")).alias("d"))
    got = {r.keyword: r.d for r in df.collect()}
    assert got["crm"] == 86.0 and got["best crm software"] == 70.0 and got["how to pick a crm for teams"] < 30
    serp = spark.createDataFrame([("k", i, f"https://{d}/" if i < 3 else f"https://{d}/p", d) for i, d in enumerate(("wikipedia.org", "reddit.com", "a.com", "b.com"))], "keyword string, position int, url string, domain string")
    assert K.serp_difficulty(serp).first().difficulty == pytest.approx(12 + 13 + 9.6 + 9 - 4.5)
    auth = spark.createDataFrame([("wikipedia.org", 90.0), ("a.com", 60.0), ("b.com", 30.0)], "domain string, score double")
    assert K.serp_difficulty(serp, None, auth).first().method == "serp+authority"
    p = spark.range(1).select(*[c.alias(n) for n, c in K.personal_difficulty(F.lit(40.0), F.lit(80.0)).items()]).first()
    assert p.personal_difficulty == 18.0 and p.verdict == "easy"


def test_expansion(spark):
    seeds = spark.createDataFrame([(" CRM ",)], "seed string")
    got = {r.query for r in K.expand(seeds, 2030, ("plain", "questions", "commercial")).collect()}
    assert {"crm", "how to crm", "best crm", "crm near me", "crm 2030"} <= got and len(got) == 1 + 19 + 31
    assert "mejor crm" in {r.query for r in K.expand(seeds, 2030, ("commercial",), "es-AR").collect()}
    s = spark.createDataFrame([("a", "g", 0), ("a", "b", 3), ("b", "g", 1)], "keyword string, engine string, rank int")
    assert [(r.keyword, r.score) for r in K.rank_suggestions(s).collect()] == [("a", 95.0), ("b", 47.5)]


def greedy(order, joined):
    head = {}
    for x in order:
        if x not in head:
            head[x] = x
            for y in order:
                if y not in head and joined(x, y):
                    head[y] = x
    return head


def test_leaders_equal_the_greedy_scan(spark):
    import random

    rng = random.Random(2)
    for _ in range(3):
        nodes = list(range(25))
        edges = {(a, b) for a in nodes for b in nodes if a < b and rng.random() < 0.15}
        want = greedy(nodes, lambda a, b: (a, b) in edges)
        got = N.leaders(spark.createDataFrame([(n,) for n in nodes], "node int"), spark.createDataFrame(sorted(edges), "a int, b int"))
        assert {r.node: r.leader for r in got.collect()} == want


def test_leaders_in_rounds_equal_one_task(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (4, 6)], "a int, b int")
    nodes = spark.createDataFrame([(n,) for n in range(1, 9)], "node int")
    assert {tuple(r) for r in N.leaders(nodes, edges, 0).collect()} == {tuple(r) for r in N.leaders(nodes, edges).collect()}


def test_rare_tokens_both_ways(spark, monkeypatch):
    sets = spark.createDataFrame([(i, [f"t{k}" for k in range(i, i + 20)]) for i in range(6)], "doc_id int, tokens array<string>")
    one = {tuple(r) for r in N.similar_pairs(sets, 0.8).collect()}
    monkeypatch.setattr(N, "MAX_TOKENS", 0)
    assert {tuple(r) for r in N.similar_pairs(sets, 0.8).collect()} == one and {r[:2] for r in one} == {(i, j) for i in range(6) for j in range(i + 1, 6) if j - i <= 2}


def test_simhash_mode(spark):
    base = " ".join(f"alpha{k} beta{k}" for k in range(60))
    docs = spark.createDataFrame([(1, base), (2, base + " gamma"), (3, " ".join(f"other{k}" for k in range(90)))], "doc_id int, text string")
    assert [(r.a, r.b) for r in N.simhash_pairs(docs, 0.85).collect()] == [(1, 2)]
    assert spark.range(1).select(N.hamming_distance(F.lit(5), F.lit(-6)).alias("d")).first().d == 64


def test_lexical_clusters(spark):
    rows = [("crm software", 1000, 60.0), ("best crm software", 500, 50.0), ("crm software for startups", 100, 40.0), ("email marketing tools", 800, 55.0), ("best email marketing tools", 300, 45.0), ("invoice template", 50, 30.0)]
    k = spark.createDataFrame([(a, v, 30.0, None, o, "commercial") for a, v, o in rows], "keyword string, volume bigint, difficulty double, cpc double, opportunity double, intent string")
    m = {r.keyword: r.head for r in clusters.lexical_members(k).collect()}
    assert m["best crm software"] == "crm software" and m["best email marketing tools"] == "email marketing tools" and m["invoice template"] == "invoice template"
    up = clusters.roll_up(k, spark.createDataFrame(list(m.items()), "keyword string, head string")).collect()
    assert up[0].total_volume >= 1500 and {r.head for r in up} >= {"crm software", "email marketing tools"}


def test_serp_clusters(spark):
    res = [(k, i, f"https://{u}/") for k, urls in (("a", "pqrs"), ("b", "pqrx"), ("c", "xyz")) for i, u in enumerate(urls)]
    results = spark.createDataFrame([(k, i, u, u) for k, i, u in res], "keyword string, position int, url string, domain string")
    assert [(r.keyword_a, r.keyword_b, r.shared_urls) for r in overlap_pairs(results).collect()] == [("a", "b", 3)]
    k = spark.createDataFrame([(x, 10 - i, None) for i, x in enumerate(("a", "b", "c", "lonely words"))], "keyword string, volume bigint, opportunity double")
    assert {r.keyword: (r.head, r.method) for r in clusters.serp_members(k, results).collect()} == {"a": ("a", "serp"), "b": ("a", "serp"), "c": ("c", "serp"), "lonely words": ("lonely words", "lexical")}


def test_near_dup_clusters(spark):
    base = " ".join(f"alpha{k} beta{k} gamma{k}" for k in range(30))
    docs = spark.createDataFrame([(1, base), (2, base), (3, base + " delta"), (4, "short"), (5, " ".join(f"other{k}" for k in range(90))), (6, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.leader, r.size) for r in N.near_dup_clusters(docs).collect()} == {(1, 1, 3), (2, 1, 3), (3, 1, 3)}


def test_patterns_and_plan(spark):
    names = [f"{x} alternatives" for x in ("notion", "slack", "trello", "asana", "jira")] + ["outlier phrase here"]
    k = spark.createDataFrame([(n, 100 + i, 20.0, 1.0, "commercial") for i, n in enumerate(names)], "keyword string, volume bigint, difficulty double, cpc double, intent string")
    top = P.discover_patterns(k).orderBy(F.desc("viability")).first()
    assert top.template == "{x} alternatives" and top.n_entities == 5 and top.slot_position == "prefix" and top.page_type == "comparison"
    existing = spark.createDataFrame([("/Vs/slack-alternatives",)], "url string")
    plan = P.build_plan(k, "{x} alternatives", "/vs", existing).collect()
    assert [r.entity for r in plan] == ["jira", "asana", "trello", "notion"] and plan[0].url_path == "/vs/jira-alternatives"
    mesh = P.link_mesh(spark.createDataFrame([(f"/{i}",) for i in range(3)], "url string"), ["url"])
    assert {(r.url, r.target) for r in mesh.collect()} == {(f"/{a}", f"/{b}") for a in range(3) for b in range(3) if a != b}


ROW = "query string, page string, clicks bigint, impressions bigint, ctr double, position double"


def perf(spark, *rows):
    return spark.createDataFrame([(q, p, c, i, c / i, x) for q, p, c, i, x in rows], ROW)


def test_insights(spark):
    s = insights.striking_distance(perf(spark, ("near miss", "/a", 5, 1000, 12.0), ("already top", "/b", 300, 1000, 2.0), ("too deep", "/c", 0, 1000, 60.0), ("no volume", "/d", 0, 3, 12.0)))
    assert [r["query"] for r in s.collect()] == ["near miss"]
    c = insights.ctr_opportunities(perf(spark, ("bad snippet", "/a", 10, 1000, 2.0), ("normal", "/b", 28, 1000, 9.0)))
    assert [r["query"] for r in c.collect()] == ["bad snippet"]
    k = insights.cannibalization(perf(spark, ("shared", "/best", 50, 500, 4.0), ("shared", "/worse", 5, 400, 11.0), ("solo", "/x", 20, 300, 3.0), ("q", "/main", 100, 1000, 3.0), ("q", "/incidental", 0, 5, 80.0)))
    assert [(r["query"], r.primary_page, r.severity) for r in k.collect()] == [("shared", "/best", "high")]
    d = insights.content_decay(perf(spark, ("-", "/lost-rank", 100, 1000, 3.0), ("-", "/lost-demand", 100, 1000, 3.0), ("-", "/gone", 50, 100, 1.0)), perf(spark, ("-", "/lost-rank", 20, 1000, 15.0), ("-", "/lost-demand", 20, 200, 3.0)))
    assert {r.page: r.likely_cause for r in d.collect()} == {"/lost-rank": "lost_rankings", "/lost-demand": "lost_impressions", "/gone": "lost_impressions"}
    r = {x["query"]: x for x in insights.rising_queries(perf(spark, ("growing", "/", 1, 100, 30.0)), perf(spark, ("growing", "/", 5, 900, 30.0), ("new", "/", 1, 500, 5.0))).collect()}
    assert r["growing"].growth_pct == 800.0 and r["growing"].untapped and r["new"].growth_pct == 100.0


def test_ranks(spark):
    rows = [("a", 20.0, "2026-01-01 00:00:00", 1), ("a", 8.0, "2026-01-08 00:00:00", 2), ("b", 4.0, "2026-01-01 00:00:00", 3), ("b", 15.0, "2026-01-08 00:00:00", 4), ("c", 3.0, "2026-01-08 00:00:00", 5)]
    df = spark.createDataFrame(rows, "keyword string, position double, checked_at string, tie int").withColumn("checked_at", F.to_timestamp("checked_at"))
    assert {r.keyword: r.change for r in R.rank_changes(df).collect()} == {"a": 12.0, "b": -11.0, "c": None}
    assert {r.keyword: r.change for r in R.rank_diff(df, "2026-01-01", "2026-01-08").collect()} == {"a": 12.0, "b": -11.0, "c": None}
    assert R.rank_dates(df).count() == 2


def test_upsert_keeps_known_values(spark):
    ddl = "keyword string, volume bigint, difficulty double, cpc double, intent string, source string"
    got = R.upsert_keywords(spark.createDataFrame([("k", 5000, 3.5, None, "a", "seed")], ddl), spark.createDataFrame([("k", None, None, 1.0, "b", "x"), ("n", 1, None, None, "c", "y")], ddl))
    assert {r.keyword: tuple(r)[1:] for r in got.collect()} == {"k": (5000, 3.5, 1.0, "b", "seed"), "n": (1, None, None, "c", "y")}


def test_gaps_and_competitors(spark):
    r = spark.createDataFrame([("me", "k1", 30, 100), ("x", "k1", 3, 100), ("x", "k2", 5, 10), ("me", "k3", 2, 100), ("x", "k3", 1, 100), ("y", "k1", 9, 100)], "domain string, keyword string, position int, volume bigint")
    assert [(g.keyword, g.n_competitors, g.your_position) for g in content_gap(r, "me").collect()] == [("k1", 2, 30)]
    links = spark.createDataFrame([("s1", "x"), ("s1", "me"), ("s2", "x"), ("s2", "y"), ("s2", "x")], "source string, target string")
    assert [(g.source, g.n_competitors) for g in link_gap(links, "me").collect()] == [("s2", 2)]
    top = serp_competitors(r.select("keyword", "position", "domain", F.lit("u").alias("url")), "me").orderBy(F.desc("visibility")).first()
    assert top.domain == "x" and top.appearances == 3


def test_trend(spark):
    df = spark.createDataFrame([("a", m, 100 if m < 4 else 200) for m in range(1, 13)] + [("b", 1, 5)], "k string, m int, v int")
    assert {r.k: r.trend_pct for r in R.trend(df, ["k"], "m", "v").collect()} == {"a": 100.0, "b": None}
