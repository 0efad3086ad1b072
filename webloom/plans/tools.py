"""The 36 tools: named calls over the store and captured payloads, each giving an envelope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from webloom.functions import copy as W
from webloom.functions.url import hostname, registrable_domain, slugify
from webloom.operators import actions as X, advice as D, audit, clusters, content, crawldiff, insights, keywords as K, linkgraph, programmatic as P, ranks as R, serp as S, visibility as V
from webloom.operators.similarity import checkpointed
from webloom.plans.cache import read_through
from webloom.plans.envelope import Budget, Envelope, ToolError
from webloom.plans.store import Store
from webloom.sources import crawl as C, payloads as Y
from webloom.sources.html import read_pages, read_perf


@dataclass
class Context:
    """What tools work on: the store, and captured inputs by name.

    ``inputs``: raw_pages(url, html), performance(query, page, date, clicks, impressions, ctr, position), and payload tables
    (key, body): serp, metrics, ranked, authority, backlinks, link_gap, page_speed; suggestions(key, engine, body); answers(text,
    domain_cited).  ``today`` and ``year`` are what the caller says they are.
    """

    spark: SparkSession
    store: Store
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    budget: Budget = field(default_factory=Budget)
    year: int = 2026
    today: str = "2026-01-01"

    def need(self, name: str) -> DataFrame:
        if name not in self.inputs:
            raise ToolError("NOT_CONFIGURED", f"There is no captured input {name!r}.", f"Give Context.inputs[{name!r}].")
        return self.inputs[name]

    def lookup(self, name: str, namespace: str, tool: str, keys: list[str] | None = None) -> DataFrame:
        """(key, body) of a captured payload table, all or for some keys, through the cache: what it has not yet costs a unit each and
        is put down in the ledger."""
        source = self.need(name).select("key", "body")
        if keys is not None:
            wanted = self.spark.createDataFrame([(k.strip().lower(),) for k in keys], "low string")
            source = source.join(F.broadcast(wanted.distinct()), F.lower("key") == F.col("low"), "left_semi")
        number = F.row_number().over(Window.partitionBy("key").orderBy("body"))  # several payloads of a key are entries of their own
        numbered = source.select(F.concat(F.lit(f"{name}:"), "key", F.lit("#"), number.cast("string")).alias("key"), "body")
        asked: list[int] = []

        def fetch(misses: DataFrame) -> DataFrame:
            asked.append(misses.count())
            return numbered

        out = read_through(self.store, namespace, numbered.select("key"), fetch, self.budget)
        if asked:
            self.store.record_usage(name, tool, asked[0])
        own = F.regexp_replace(F.substring("key", len(name) + 2, 1 << 30), "#[0-9]+$", "")
        return out.where("body is not null").select(own.alias("key"), "body")

    def crawl_id(self, site: str | None, crawl_id: int | None) -> int:
        found = crawl_id if crawl_id is not None else self.store.latest_crawl(site or "")
        if found is None or self.store.read("crawls").where(F.col("crawl_id") == found).isEmpty():
            raise ToolError("INVALID_INPUT", "There is no such crawl.", "List crawls with seo_crawl_history.")
        return found

    def pages(self, crawl_id: int) -> DataFrame:
        return self.store.read("pages").where(F.col("crawl_id") == crawl_id)

    def issues(self, crawl_id: int) -> DataFrame:
        return self.store.read("issues").where(F.col("crawl_id") == crawl_id)

    def keywords(self, keywords: list[str] | None, project: str | None) -> DataFrame:
        """Scored keywords of a list or a project, with lexical difficulty where none is known."""
        if keywords:
            rows = self.spark.createDataFrame([(k, i) for i, k in enumerate(keywords)], "keyword string, i int")
            base = K.dedupe(rows, "i").select("keyword", *[F.lit(None).cast(t).alias(n) for n, t in (("volume", "bigint"), ("difficulty", "double"), ("cpc", "double"))])
        elif project:
            base = self.store.read("keywords").where(F.col("project") == project).select("keyword", "volume", "difficulty", "cpc")
        else:
            raise ToolError("INVALID_INPUT", "Neither keywords nor a project.", "Give one of them.")
        return K.score_keywords(base.withColumn("difficulty", F.coalesce("difficulty", K.lexical_difficulty(F.col("keyword")))))


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    defaults: dict
    run: Callable[..., Envelope]


TOOLS: dict[str, Tool] = {}


def tool(about: str, **defaults) -> Callable:
    def add(f: Callable[..., Envelope]) -> Callable[..., Envelope]:
        TOOLS[f.__name__] = Tool(f.__name__, about, defaults, f)
        return f

    return add


def call(ctx: Context, name: str, /, **args) -> Envelope:
    """Run a tool with its defaults; errors come back as envelopes."""
    try:
        if name not in TOOLS:
            raise ToolError("NOT_FOUND", f"There is no tool {name!r}.", "See webloom.plans.tools.TOOLS.")
        extra = set(args) - set(TOOLS[name].defaults)
        if extra:
            raise ToolError("INVALID_INPUT", f"Unknown arguments: {', '.join(sorted(extra))}.", f"Arguments: {', '.join(TOOLS[name].defaults)}.")
        return TOOLS[name].run(ctx, **(TOOLS[name].defaults | args))
    except ToolError as e:
        return Envelope(False, error={"code": e.code, "message": str(e), "remedy": e.remedy, "retryable": e.retryable})


# meta


# Capabilities, the captured input that each needs, and its tools.
CAPABILITIES = {
    "site_crawl_and_audit": ("raw_pages", "seo_crawl_site seo_audit_issues seo_page_inspect seo_internal_links seo_link_opportunities seo_crawl_diff seo_crawl_history"),
    "keyword_discovery": ("suggestions", "seo_keyword_ideas seo_cluster_keywords seo_keyword_difficulty"), "content_optimization": (None, "seo_content_score seo_content_brief seo_page_optimize"),
    "programmatic_seo": (None, "pseo_discover_patterns pseo_build_plan pseo_check_index_risk"), "keyword_metrics": ("metrics", "seo_keyword_metrics"), "live_serp": ("serp", "seo_serp seo_rank_check seo_competitors_discover seo_content_gap"),
    "own_site_performance": ("performance", "seo_gsc_sites seo_gsc_performance seo_gsc_opportunities"), "backlinks": ("backlinks", "seo_backlinks seo_domain_authority seo_link_gap"), "ai_visibility": ("answers", "seo_ai_visibility"), "page_speed": ("page_speed", "seo_page_speed"),
}


@tool("What is there to work with")
def seo_capabilities(ctx):
    rows = [(n, need is None or need in ctx.inputs, tools.split(), None if need is None or need in ctx.inputs else f"Context.inputs[{need!r}]") for n, (need, tools) in CAPABILITIES.items()]
    return Envelope(True, {"capabilities": ctx.spark.createDataFrame(rows, "capability string, available boolean, tools array<string>, unlock string")})


@tool("Ranked backlog over audit, links and search performance", site=None, crawl_id=None, end=None, limit=25)
def seo_next_actions(ctx, site, crawl_id, end, limit):
    found = ctx.crawl_id(site, crawl_id)
    rows = audit.issues_to_actions(ctx.issues(found), ctx.pages(found))
    g = checkpointed(linkgraph.link_graph(ctx.pages(found)))
    rows = rows.unionByName(D.link_actions(g, linkgraph.link_opportunities(ctx.pages(found))))
    if "performance" in ctx.inputs:
        rows = rows.unionByName(_insight_actions(_insights(ctx, end, 28, 30)))
    ranked = X.rank_actions(rows).limit(limit)
    return Envelope(True, {"priorities": X.summary(ranked), "quick_wins": X.quick_wins(ranked)}, actions=ranked)


@tool("Create or change a project", name="", site="", competitors=None)
def seo_project_set(ctx, name, site, competitors):
    if not name or not site:
        raise ToolError("INVALID_INPUT", "A project needs a name and a site.")
    ctx.store.set_project(name, site, competitors)
    return Envelope(True, {"projects": ctx.store.read("projects")})


@tool("All projects")
def seo_project_list(ctx):
    return Envelope(True, {"projects": ctx.store.read("projects").orderBy("name")})


@tool("Units per provider", since=None)
def seo_usage(ctx, since):
    rows = ctx.store.read("usage").withColumn("at", F.col("at").cast("timestamp_ntz"))
    return Envelope(True, {"usage": R.usage(rows, since).orderBy(F.desc("units"))})


@tool("Drop cached answers", namespace=None)
def seo_cache_clear(ctx, namespace):
    ctx.store.clear_cache(namespace)
    return Envelope(True)


# site


@tool("Crawl the captured pages from a start, audit and store them", url="", max_pages=200, max_depth=10, include=None, exclude=None, robots=None, sitemap=None, respect_robots=True)
def seo_crawl_site(ctx, url, max_pages, max_depth, include, exclude, robots, sitemap, respect_robots):
    chosen = C.url_filter(ctx.need("raw_pages"), include, exclude)
    open_to_us = C.filter_allowed(chosen, robots) if respect_robots else chosen
    pages = checkpointed(read_pages(open_to_us))
    site = ctx.spark.createDataFrame([(u,) for u in sitemap], "url string") if sitemap else None
    by_links, stopped = C.crawl(pages, [url], max_depth, max_pages)
    by_links = checkpointed(by_links)
    reached, more = by_links, stopped
    if sitemap:
        reached, more = C.crawl(pages, [url, *sitemap], max_depth, max_pages)
    own = checkpointed(pages.drop("depth").join(reached, "url").select(*pages.columns))
    if own.where(audit.is_html()).isEmpty():
        raise ToolError("FETCH_FAILED", f"No page could be read from {url}.", "Check the address and the captured pages.")
    # only a crawl that followed all links knows that nothing links to a page
    complete = stopped == more == "complete"
    lost = C.orphans(site, by_links) if site is not None and complete else None
    bundle = audit.Crawl(own, site, lost, url, bool(robots))
    issues = checkpointed(audit.run_audit(bundle))
    found = ctx.store.save_crawl(url, bundle, issues, more)
    notes = [] if complete else [f"The crawl stopped at its limit ({more}): findings cover the pages reached, and no orphans are reported."]
    blocked = chosen.count() - open_to_us.count()
    notes += [f"The robots rules keep {blocked} page(s) out."] if blocked else []
    failed = own.where("error is not null or status >= 400").count()
    notes += [f"{failed} page(s) could not be fetched."] if failed else []
    data = {"crawl_id": found, "stopped_reason": more, "by_rule": audit.by_rule(issues), "issues": issues, "health": audit.health_score(issues, own), "orphans": lost if lost is not None else []}
    return Envelope(True, data, warnings=notes, actions=X.rank_actions(audit.issues_to_actions(issues, own)))


@tool("Findings of a crawl", site=None, crawl_id=None, severity=None, rule=None, url_contains=None)
def seo_audit_issues(ctx, site, crawl_id, severity, rule, url_contains):
    issues = audit.filter_issues(ctx.issues(ctx.crawl_id(site, crawl_id)), severity, rule, url_contains)
    return Envelope(True, {"issues": issues, "by_rule": audit.by_rule(issues)})


@tool("One captured page in full", url="")
def seo_page_inspect(ctx, url):
    raw = ctx.need("raw_pages").where(F.col("url") == url)
    page = read_pages(raw)
    return Envelope(True, {"page": page, "perf": read_perf(raw), "readability": content.readability(page.select(F.col("url").alias("doc_id"), "text", "lang"))})


@tool("Internal link graph of a crawl", site=None, crawl_id=None, limit=40)
def seo_internal_links(ctx, site, crawl_id, limit):
    g = checkpointed(linkgraph.link_graph(ctx.pages(ctx.crawl_id(site, crawl_id))))
    return Envelope(True, {"nodes": g.orderBy(F.desc("page_rank"), "url").limit(limit), "starved": linkgraph.starved_pages(g), "hubs": linkgraph.hub_pages(g), "depths": linkgraph.depth_distribution(g), "orphans": g.where("orphan").select("url")}, actions=X.rank_actions(D.link_actions(g, linkgraph.link_opportunities(ctx.pages(ctx.crawl_id(site, crawl_id))))))


@tool("Pages that should link to others", site=None, crawl_id=None, targets=None, max_per_target=3, limit=50)
def seo_link_opportunities(ctx, site, crawl_id, targets, max_per_target, limit):
    return Envelope(True, {"opportunities": linkgraph.link_opportunities(ctx.pages(ctx.crawl_id(site, crawl_id)), targets, max_per_target, limit)})


@tool("What changed between two crawls", from_crawl=None, to_crawl=None, limit=60)
def seo_crawl_diff(ctx, from_crawl, to_crawl, limit):
    a, b = ctx.crawl_id(None, from_crawl), ctx.crawl_id(None, to_crawl)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    diff = crawldiff.diff_issues(ctx.issues(a), ctx.issues(b)).orderBy(rank, "rule", "url").limit(limit)
    pages = crawldiff.diff_pages(ctx.store.page_summaries(a), ctx.store.page_summaries(b))
    score = {r.crawl_id: r.health_score for r in ctx.store.read("crawls").where(F.col("crawl_id").isin(a, b)).select("crawl_id", "health_score").collect()}  # two rows
    acts = D.diff_actions(pages, crawldiff.diff_issues(ctx.issues(a), ctx.issues(b)), ctx.store.page_summaries(a), ctx.store.page_summaries(b), (score[a], score[b]))
    return Envelope(True, {"pages": pages, "issues": diff, "rules": crawldiff.rule_delta(ctx.issues(a), ctx.issues(b))}, actions=X.rank_actions(acts))


@tool("Crawls of a site and their trend", site="", limit=20)
def seo_crawl_history(ctx, site, limit):
    own = ctx.store.crawl_history(site, limit)
    return Envelope(True, {"crawls": own, "trend": crawldiff.crawl_trend(own)})


# keywords


@tool("Expanded keywords, ranked", seed="", strategies=K.STRATEGIES, engines=None, depth=1, language="en", include_only="all", with_metrics=True, save_to_project=None, limit=100)
def seo_keyword_ideas(ctx, seed, strategies, engines, depth, language, include_only, with_metrics, save_to_project, limit):
    seeds = ctx.spark.createDataFrame([(seed,)], "seed string")
    captured = Y.suggestions(ctx.need("suggestions"))
    captured = captured.where(F.col("engine").isin(*engines)) if engines else captured
    ranked = K.rank_suggestions(K.expand_captured(seeds, captured, ctx.year, tuple(strategies), language, depth).drop("seed"))
    own = K.classify_intent(ranked)
    test = {"all": F.lit(True), "questions": F.col("is_question"), "commercial": F.col("intent").isin("commercial", "transactional"), "long_tail": K.word_count(F.col("keyword")) >= 4}[include_only]
    own = own.where(test).orderBy(F.desc("score"), "keyword").limit(limit)
    if with_metrics and "metrics" in ctx.inputs:
        m = _metrics(ctx, "seo_keyword_ideas", None).select("keyword", "volume", F.col("difficulty").alias("known"), "cpc")
        own = own.join(m, "keyword", "left").withColumn("difficulty", F.coalesce("known", K.lexical_difficulty(F.col("keyword")))).drop("known")
    if save_to_project:
        own = checkpointed(own)
        have = [F.col(c) if c in own.columns else F.lit(None).cast(t).alias(c) for c, t in (("volume", "bigint"), ("difficulty", "double"), ("cpc", "double"))]
        ctx.store.save_keywords(save_to_project, own.select(F.lower("keyword").alias("keyword"), *have, "intent", F.lit("expanded").alias("source")))
    return Envelope(True, {"keywords": own}, warnings=[] if not with_metrics or "metrics" in ctx.inputs else ["No captured metrics: keywords come without volumes."])


def _metrics(ctx: Context, tool_name: str, keys: list[str] | None) -> DataFrame:
    """Metrics by keyword; of several rows of a keyword the one with the largest volume."""
    m = Y.keyword_metrics(ctx.lookup("metrics", "keyword_metrics", tool_name, keys))
    best = F.struct(F.coalesce("volume", F.lit(-1)), F.coalesce("difficulty", F.lit(-1.0)), F.coalesce("cpc", F.lit(-1.0)))
    return m.groupBy("keyword").agg(F.max_by(F.struct("volume", "difficulty", "cpc"), best).alias("m")).select("keyword", "m.*")


def _with_metrics(ctx: Context, keywords: DataFrame) -> DataFrame:
    if "metrics" not in ctx.inputs:
        return keywords
    m = _metrics(ctx, "seo_keyword_metrics", None)
    base = keywords.select("keyword", F.col("difficulty").alias("d")).join(m, "keyword", "left")
    return K.score_keywords(base.select("keyword", "volume", F.coalesce("difficulty", "d").alias("difficulty"), "cpc"))


@tool("Volume, difficulty and opportunity", keywords=None, project=None, authority=None, save_to_project=None)
def seo_keyword_metrics(ctx, keywords, project, authority, save_to_project):
    k = checkpointed(_with_metrics(ctx, ctx.keywords(keywords, project)))
    if save_to_project:
        ctx.store.save_keywords(save_to_project, k.select("keyword", "volume", "difficulty", "cpc", "intent", F.lit("metrics").alias("source")))
    return Envelope(True, {"keywords": k.withColumns(K.personal_difficulty(F.col("difficulty"), F.lit(authority).cast("double"))), "intents": k.groupBy("intent").count()})


@tool("Difficulty from result pages or from the words", keywords=None, project=None, authority=None)
def seo_keyword_difficulty(ctx, keywords, project, authority):
    k = ctx.keywords(keywords, project).select("keyword", F.col("difficulty").alias("lexical"))
    if "serp" in ctx.inputs:
        auth = Y.authority(ctx.inputs["authority"], 100) if "authority" in ctx.inputs else None
        k = k.join(K.serp_difficulty(Y.serp_rows(ctx.inputs["serp"]), Y.serp_features(ctx.inputs["serp"]), auth).select("keyword", "difficulty", "method"), "keyword", "left")
    else:
        k = k.withColumns({"difficulty": F.lit(None).cast("double"), "method": F.lit(None).cast("string")})
    out = k.select("keyword", F.coalesce("difficulty", "lexical").alias("difficulty"), F.coalesce("method", F.lit("lexical")).alias("method"))
    return Envelope(True, {"keywords": out.withColumns(K.personal_difficulty(F.col("difficulty"), F.lit(authority).cast("double")))})


@tool("Keyword clusters, a page each", keywords=None, project=None, use_serp=False, min_overlap=0.5, separate_questions=False, limit=50)
def seo_cluster_keywords(ctx, keywords, project, use_serp, min_overlap, separate_questions, limit):
    k = checkpointed(ctx.keywords(keywords, project))
    how = dict(min_overlap=min_overlap, separate_questions=separate_questions)
    members = clusters.serp_members(k, Y.serp_rows(ctx.need("serp")), **how) if use_serp else clusters.lexical_members(k, **how)
    c = clusters.roll_up(k, members.select("keyword", "head"), limit=limit)
    c = c.withColumns({"slug": slugify(F.col("head")), "title": W.page_title(F.col("head"), F.col("page_type"), ctx.year), "h1": W.headline(F.col("head"))})
    return Envelope(True, {"clusters": c, "members": members})


# search performance


@tool("Sites with search-performance rows")
def seo_gsc_sites(ctx):
    host = F.regexp_extract("page", r"^https?://[^/]+", 0)
    return Envelope(True, {"sites": ctx.need("performance").select(host.alias("site")).distinct()})


def _window(ctx: Context, end: str | None, days: int, compare_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the last ``days`` before ``end`` (by default three days before today, as rows come late), and of the days before those."""
    p = ctx.need("performance")
    last = F.lit(end).cast("date") if end else F.date_sub(F.lit(ctx.today).cast("date"), 3)
    age = F.date_diff(last, F.col("date"))
    return p.where((age >= 0) & (age < days)), p.where((age >= days) & (age < days + (compare_days or days)))


@tool("Performance by dimensions", dimensions=("query",), end=None, days=28, filters=(), min_impressions=0, save_snapshot=False, project=None, limit=100)
def seo_gsc_performance(ctx, dimensions, end, days, filters, min_impressions, save_snapshot, project, limit):
    now, _ = _window(ctx, end, days)
    all_rows = checkpointed(insights.performance(insights.filtered(now, list(filters)), *dimensions))
    rows, notes = all_rows.where(F.col("impressions") >= min_impressions), []
    if all_rows.isEmpty():
        notes.append("No rows in this period.")
    elif rows.isEmpty():
        notes.append(f"All {all_rows.count()} rows have fewer than {min_impressions} impressions.")
    if save_snapshot and not (project and "query" in dimensions):
        notes.append("Nothing was stored: a snapshot needs a project and the dimension query.")
    elif save_snapshot:
        url = F.col("page") if "page" in dimensions else F.lit(None).cast("string")
        ctx.store.save_ranks(project, rows.select(F.col("query").alias("keyword"), "position", url.alias("url"), "clicks", "impressions", (F.col("ctr") / 100).alias("ctr")), "search-performance")
    return Envelope(True, {"rows": rows.orderBy(F.desc("clicks"), *dimensions).limit(limit), "totals": insights.performance(now)}, warnings=notes)


def _rolled(rows: DataFrame, *keys: str) -> DataFrame:
    g = insights.performance(rows, *keys)
    return g.withColumn("ctr", F.col("ctr") / 100)


@tool("Quick wins from search performance", end=None, days=28, compare_days=None, min_impressions=30, include=None, limit=30)
def seo_gsc_opportunities(ctx, end, days, compare_days, min_impressions, include, limit):
    names = {"striking_distance": "striking", "ctr": "ctr", "cannibalization": "cannibalization", "decay": "decay", "rising": "rising"}
    if include and (unknown := set(include) - set(names)):
        raise ToolError("INVALID_INPUT", f"Unknown parts: {', '.join(sorted(unknown))}.", f"Parts: {', '.join(names)}.")
    found = _insights(ctx, end, days, min_impressions, compare_days)
    wanted = [names[n] for n in include] if include else list(found)
    own = {k: v if k in wanted else v.limit(0) for k, v in found.items()}
    return Envelope(True, {k: found[k].limit(limit) for k in wanted}, actions=X.rank_actions(_insight_actions(own)))


def _insights(ctx: Context, end: str | None, days: int, min_impressions: int, compare_days: int | None = None) -> dict[str, DataFrame]:
    now, before = _window(ctx, end, days, compare_days)
    both = _rolled(now, "query", "page")
    return {
        "striking": insights.striking_distance(both, min_impressions=min_impressions), "ctr": insights.ctr_opportunities(both), "cannibalization": insights.cannibalization(both),
        "decay": insights.content_decay(before, now), "rising": insights.rising_queries(_rolled(before, "query"), _rolled(now, "query")),
    }


def _insight_actions(found: dict[str, DataFrame]) -> DataFrame:
    return D.insight_actions(*(found[k] for k in ("striking", "ctr", "cannibalization", "decay", "rising")))


# result pages, links, competitors


@tool("A captured result page", keyword="", depth=10, with_authority=False)
def seo_serp(ctx, keyword, depth, with_authority):
    p = ctx.lookup("serp", "serp", "seo_serp", [keyword])
    rows = Y.serp_rows(p).where(F.col("position") <= depth)
    if with_authority and "authority" in ctx.inputs:
        rows = rows.join(Y.authority(ctx.lookup("authority", "backlinks", "seo_serp"), 100).select("domain", F.col("score").alias("authority")), "domain", "left")
    return Envelope(True, {"results": rows.orderBy("position"), "features": Y.serp_features(p), "questions": Y.questions(p)})


@tool("Positions of a domain", domain="", keywords=None, project=None)
def seo_rank_check(ctx, domain, keywords, project):
    rows = Y.serp_rows(ctx.need("serp"))
    rows = rows.where(F.col("keyword").isin(*keywords)) if keywords else rows
    mine = rows.where(F.col("domain") == domain).groupBy("keyword").agg(F.min("position").cast("double").alias("position"), F.min_by("url", "position").alias("url"))
    out = rows.select("keyword").distinct().join(mine, "keyword", "left")
    if project:
        ctx.store.save_ranks(project, out)
    total = out.agg(F.count("position").alias("ranking"), F.avg("position").alias("average"), F.count_if(F.col("position") <= 10).alias("top_10"))
    return Envelope(True, {"ranks": out.orderBy(F.asc_nulls_last("position"), "keyword"), "summary": total})


@tool("Changes of positions", project="", from_date=None, to_date=None, keyword=None, limit=80)
def seo_rank_changes(ctx, project, from_date, to_date, keyword, limit):
    rows = ctx.store.read("ranks").where(F.col("project") == project).withColumn("tie", F.xxhash64("url", "position"))
    if keyword:
        return Envelope(True, {"history": R.rank_history(rows.where(F.col("keyword") == keyword.lower()))})
    if from_date and to_date:
        return Envelope(True, {"changes": R.rank_diff(rows, from_date, to_date).orderBy(F.desc_nulls_last("change"), "keyword").limit(limit), "dates": R.rank_dates(rows)})
    c = R.rank_changes(rows, limit)
    return Envelope(True, {"changes": c, "gains": c.where("change > 0").orderBy(F.desc("change"), "keyword").limit(10), "losses": c.where("change < 0").orderBy("change", "keyword").limit(10)})


@tool("Domains that rank for the same keywords", keywords=None, your_domain=None, limit=20)
def seo_competitors_discover(ctx, keywords, your_domain, limit):
    return Envelope(True, {"competitors": S.serp_competitors(Y.serp_rows(ctx.lookup("serp", "serp", "seo_competitors_discover", keywords)), your_domain).orderBy(F.desc("visibility"), "domain").limit(limit)})


@tool("Keywords that others rank for", your_domain="", competitors=None, min_volume=50, max_position=20, limit=60)
def seo_content_gap(ctx, your_domain, competitors, min_volume, max_position, limit):
    rows = Y.ranked_keywords(ctx.need("ranked"))
    rows = rows.where(F.col("domain").isin(your_domain, *competitors)) if competitors else rows
    gap = S.content_gap(rows, your_domain, min_volume, max_position)
    o = K.opportunity_columns(F.col("volume"), F.lit(None).cast("double"), F.lit(None).cast("double"), K.intent_columns(F.col("keyword"))["intent"], K.word_count(F.col("keyword")))["opportunity"]
    boost = 1 + F.least(F.col("n_competitors") - 1, F.lit(3)) * 0.08
    return Envelope(True, {"gaps": gap.withColumn("opportunity", F.least(F.lit(100.0), o * boost)).orderBy(F.desc("opportunity"), "keyword").limit(limit)})


@tool("Authority of domains", domains=None, scale=100.0)
def seo_domain_authority(ctx, domains, scale):
    a = Y.authority(ctx.lookup("authority", "backlinks", "seo_domain_authority"), scale)
    return Envelope(True, {"domains": a.where(F.col("domain").isin(*domains)) if domains else a})


@tool("Backlinks of a target", target="", limit=50)
def seo_backlinks(ctx, target, limit):
    b = Y.backlinks(ctx.need("backlinks").where(F.col("key") == target))
    return Envelope(True, {"backlinks": b.limit(limit), "anchors": S.anchor_frequency(b)})


@tool("Domains that link to competitors only", your_domain=None, competitors=(), limit=100)
def seo_link_gap(ctx, your_domain, competitors, limit):
    r = Y.link_gap_rows(ctx.need("link_gap"), list(competitors))
    if your_domain and "backlinks" in ctx.inputs:  # who links to the own site leaves no gap
        mine = Y.backlinks(ctx.inputs["backlinks"].where(F.col("key") == your_domain)).select(registrable_domain(hostname(F.col("url_from"))).alias("source"))
        r = r.join(mine.distinct(), "source", "left_anti")
    return Envelope(True, {"domains": r.groupBy("source").agg(F.countDistinct("competitor").alias("competitors")).orderBy(F.desc("competitors"), "source").limit(limit)})


# content


def _plan(ctx: Context, keyword: str, language: str, brand_terms: list[str], sections: DataFrame, questions: DataFrame, terms: DataFrame, dated: DataFrame) -> DataFrame:
    """One row: intent, title, slug, description and outline of a brief."""
    listed = lambda df, c, n: df.limit(n).agg(F.collect_list(c).alias(c))  # noqa: E731  a few rows each
    k = F.lit(keyword.strip().lower())
    named = F.lit(any(b.lower() in keyword.lower() for b in brand_terms))
    intent = F.when(named, "navigational").otherwise(K.intent_columns(k)["intent"])
    return listed(sections, "heading", 8).crossJoin(listed(questions, "question", 6)).crossJoin(listed(terms, "term", 35)).crossJoin(dated).select(
        intent.alias("intent"), W.suggested_title(k, intent, K.is_question(k), F.col("dated"), ctx.year, language).alias("title"), slugify(k).alias("slug"),
        W.meta_description(k, intent, language).alias("meta_description"), D.outline(k, intent, F.col("heading"), F.col("question"), F.col("term"), language).alias("outline"),
    )


def _brief_without_results(ctx: Context, keyword: str, language: str, brand_terms: list[str], keywords: list[str], questions: list[str]) -> Envelope:
    """A brief from the keyword's cluster and questions alone."""
    frame = lambda rows, name: ctx.spark.createDataFrame([(x, i) for i, x in enumerate(rows)], f"{name} string, i int")
    terms = frame([k for k in keywords if k != keyword][:25], "term")
    unique = content.dedupe_questions(frame(questions, "question"), "i").limit(15)
    none = frame([], "heading")
    plan = _plan(ctx, keyword, language, brand_terms, none, unique, terms, ctx.spark.createDataFrame([(False,)], "dated boolean"))
    plan = plan.withColumn("target_words", F.when(F.col("intent") == "informational", 1500).otherwise(1000))
    zero = F.lit(0).cast("bigint")
    counted = terms.select("term", zero.alias("document_frequency"), F.lit(0.0).alias("avg_count"))
    return Envelope(True, {"plan": plan, "benchmarks": plan.select(zero.alias("analysed"), "target_words"), "terms": counted, "sections": none.select("heading"), "questions": unique}, warnings=["No captured result page for this keyword: nothing here comes from pages that rank."])


@tool("Brief from the ranking pages", keyword="", top_n=10, language="en", brand_terms=(), mine_questions=True, cluster_keywords=(), questions=())
def seo_content_brief(ctx, keyword, top_n, language, brand_terms, mine_questions, cluster_keywords, questions):
    mined: list[str] = list(questions)
    if mine_questions and "suggestions" in ctx.inputs:
        found = Y.suggestions(ctx.inputs["suggestions"]).where(F.contains(F.lower("keyword"), F.lit(keyword.strip().lower()))).select("keyword")
        mined += [r.keyword for r in found.where(K.is_question(F.col("keyword"))).distinct().orderBy("keyword").limit(20).collect()]
    serp = ctx.lookup("serp", "serp", "seo_content_brief", [keyword]) if "serp" in ctx.inputs else None
    if serp is None or "raw_pages" not in ctx.inputs or serp.isEmpty():
        return _brief_without_results(ctx, keyword, language, list(brand_terms), list(cluster_keywords), mined)
    top = Y.serp_rows(serp).where(F.col("position") <= top_n)
    pages = checkpointed(read_pages(ctx.need("raw_pages").join(top.select("url").distinct(), "url", "left_semi")))
    docs = pages.where("word_count >= 100").select(F.col("url").alias("doc_id"), "text", F.lit("all").alias("g"))
    asked = Y.questions(serp).select("question").unionByName(ctx.spark.createDataFrame([(q,) for q in mined], "question string")).withColumn("i", F.monotonically_increasing_id())
    terms, sections, unique = content.competitive_terms(docs, "g", 35).drop("g"), content.common_sections(pages), content.dedupe_questions(asked, "i")
    dated = pages.agg(((F.count_if(F.col("title").rlike("20[0-9][0-9]")) >= F.count("*") * 0.4) & (F.count("*") > 0)).alias("dated"))
    plan = _plan(ctx, keyword, language, list(brand_terms), sections, unique, terms, dated)
    return Envelope(True, {"plan": plan, "benchmarks": content.competitor_stats(pages), "format_signals": content.format_signals(pages), "features": Y.serp_features(serp), "terms": terms, "sections": sections, "questions": unique})


def _scored(ctx: Context, score: DataFrame) -> Envelope:
    score = checkpointed(score)
    return Envelope(True, {"score": score}, actions=X.rank_actions(D.draft_actions(content.draft_checks(score))))


@tool("Score of a draft", keyword="", title=None, meta_description=None, url=None, body="", required=None, secondary=None, target_words=None, language="en")
def seo_content_score(ctx, keyword, title, meta_description, url, body, required, secondary, target_words, language):
    row = [("draft", keyword, title, meta_description, url, body, required, secondary)]
    d = ctx.spark.createDataFrame(row, "doc_id string, keyword string, title string, meta_description string, url string, body string, required array<string>, secondary array<string>")
    return _scored(ctx, content.score_content(d, target_words, language))


@tool("Score of a captured page against the ranking ones", url="", keyword="", secondary=None, top_n=8, language="en")
def seo_page_optimize(ctx, url, keyword, secondary, top_n, language):
    brief = TOOLS["seo_content_brief"].run(ctx, **(TOOLS["seo_content_brief"].defaults | {"keyword": keyword, "top_n": top_n, "language": language}))
    page = read_pages(ctx.need("raw_pages").where(F.col("url") == url))
    if page.isEmpty():
        raise ToolError("NOT_FOUND", f"{url} is not among the captured pages.")
    terms = [r.term for r in brief.data["terms"].collect()]  # 35 at most
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    d = page.select(
        F.col("url").alias("doc_id"), F.lit(keyword).alias("keyword"), "title", "meta_description", "url", F.col("text").alias("body"), "headings", array(terms).alias("required"), array(secondary or []).alias("secondary"),
        F.filter(F.transform("images", lambda i: i["alt"]), lambda a: a != "").alias("image_alts"), F.size(F.filter("links", lambda x: x["internal"])).alias("internal_links"),
    )
    score = _scored(ctx, content.score_content(d, brief.data["benchmarks"].first().target_words, language, from_page=True))
    return Envelope(True, {**brief.data, **score.data}, actions=score.actions, warnings=brief.warnings)


@tool("Mentions in captured answers", brand="", topic=None, competitors=(), analyze_sentiment=True)
def seo_ai_visibility(ctx, brand, topic, competitors, analyze_sentiment):
    a = ctx.need("answers")
    a = a if "domain_cited" in a.columns else a.withColumn("domain_cited", F.lit(False))
    found = V.mentions(a, brand, list(competitors))
    report, share = V.visibility_report(found), V.share_of_voice(found)
    mood = V.sentiment(a) if analyze_sentiment and {"sentiment"} <= set(a.columns) else None
    data = {"report": report, "share": share, "answers": found, **({"sentiment": mood} if mood is not None else {})}
    if topic:
        data["prompts"] = [{"category": c, "prompt": p} for c, p in D.default_prompts(topic, ctx.year, brand)]
    return Envelope(True, data, actions=X.rank_actions(D.visibility_actions(report, share, mood)))


@tool("Speed of captured pages", url=None)
def seo_page_speed(ctx, url):
    s = Y.page_speed(ctx.lookup("page_speed", "page", "seo_page_speed", None if url is None else [url]))
    return Envelope(True, {"speed": s, "findings": Y.page_speed_actions(s)}, actions=X.rank_actions(D.speed_actions(s)))


# programmatic pages


@tool("Templates in a keyword set", keywords=None, project=None, min_entities=4, limit=20)
def pseo_discover_patterns(ctx, keywords, project, min_entities, limit):
    found = checkpointed(P.discover_patterns(ctx.keywords(keywords, project), min_entities))
    return Envelope(True, {"patterns": found.orderBy(F.desc("viability"), F.desc("total_volume"), "template").limit(limit)}, actions=X.rank_actions(D.pattern_actions(found)))


@tool("Page plan for a template", keywords=None, project=None, template="", base_path="/", max_pages=100, existing_urls=None, target_word_count=None)
def pseo_build_plan(ctx, keywords, project, template, base_path, max_pages, existing_urls, target_word_count):
    existing = ctx.spark.createDataFrame([(u,) for u in existing_urls], "url string") if existing_urls else None
    own = checkpointed(ctx.keywords(keywords, project))
    if not template:  # the most viable one
        best = P.discover_patterns(own).orderBy(F.desc("viability"), F.desc("total_volume"), "template").first()
        if best is None:
            raise ToolError("INVALID_INPUT", "The keywords share no template.", "Give one, as '{x} alternatives'.")
        template = best.template
    plan = P.build_plan(own, template, base_path, existing, max_pages)
    subject = F.replace(F.lit(template), F.lit("{x}"), F.col("entity"))
    kind = K.page_type(subject, F.col("intent"), subject, F.lit(0.0))
    plan = checkpointed(plan.withColumns({
        "title": W.page_title(subject, F.lit(""), ctx.year), "h1": W.headline(subject), "meta_description": W.meta_description(subject, F.col("intent")), "page_type": kind, "target_word_count": F.lit(target_word_count) if target_word_count else W.target_words(kind, F.col("intent")),
        "required_sections": W.sections(subject, kind), "schema_type": W.schema_type(kind, F.col("intent")), "data_requirements": W.data_requirements(kind),
    }))
    order = plan.select(F.col("url_path").alias("url"), (-F.coalesce("volume", F.lit(0))).alias("v"))
    n = P.match_entities(own, template).select("entity").distinct().count()
    least = plan.agg(F.min("target_word_count")).first()[0] or 0
    data = {"template": template, "pages": plan, "links": P.link_mesh(order, ["v", "url"]), "hub": P.hub_page(plan, template, base_path), "data_model": P.data_model(plan)}
    return Envelope(True, data, warnings=P.plan_notes(plan, n, max_pages, least))


@tool("Risk of a set of drafts before it is published", drafts=None, min_words=300, max_similarity=0.8)
def pseo_check_index_risk(ctx, drafts, min_words, max_similarity):
    """``drafts``: a frame (doc_id, title, text, meta_description)."""
    if drafts is None:
        raise ToolError("INVALID_INPUT", "No drafts.", "Give a DataFrame.")
    return Envelope(True, {"risk": content.index_risk(drafts, min_words, max_similarity)})
