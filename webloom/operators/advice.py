"""Findings to actions: rows of (id, priority, effort, category, title, detail, target, impact_score, evidence, fix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webloom.functions.mathx import clamp, js_round
from webloom.operators.groups import first_k

COLUMNS = ("id", "priority", "effort", "category", "title", "detail", "target", "impact_score", "evidence", "fix")


def _say(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *[c.cast("string") for c in cols])


def _actions(df: DataFrame, id: Column, priority: Column | str, effort: str, category: str, title: Column, detail: Column | str, target: Column, impact: Column | float, fix: str, *evidence: str) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    score = js_round(impact, 1) if isinstance(impact, Column) else F.lit(float(impact))
    facts = F.to_json(F.struct(*evidence)) if evidence else F.lit(None).cast("string")
    cols = (id, lit(priority), F.lit(effort), F.lit(category), title, lit(detail), target.cast("string"), score, facts, F.to_json(F.struct(F.lit(fix).alias("type"), target.cast("string").alias("to"))))
    return df.select(*[c.alias(n) for c, n in zip(cols, COLUMNS, strict=True)])


def _log(x: Column) -> Column:
    return F.log10(x + 1.0)


def insight_actions(striking: DataFrame, ctr: DataFrame, cannibal: DataFrame, decay: DataFrame, rising: DataFrame) -> DataFrame:
    """Actions from the five search-performance analyses, the best of each."""
    top = striking.orderBy(F.desc("potential_gain"), "query", "page").limit(40)
    g = top.groupBy("page").agg(F.sum("potential_gain").alias("gain"), F.count("*").alias("n"), F.max_by("query", "potential_gain").alias("best"), F.max_by("position", "potential_gain").alias("at")).orderBy(F.desc("gain"), "page").limit(12)
    target = F.coalesce("page", "best")
    near = _actions(g, F.concat(F.lit("gsc.striking."), target), F.when(F.col("gain") > 100, "critical").when(F.col("gain") > 30, "high").otherwise("medium"), "small", "rankings", _say("Bring %s to page one for %s more clicks a month", target, F.col("gain")),
                    _say("Position %s for \"%s\" and %s queries in all: a closer title, internal links, and the topics of the pages above.", F.col("at"), F.col("best"), F.col("n")), target, clamp(_log(F.col("gain")) * 18 + 45, 0, 100), "optimize_existing_page", "best", "gain", "n")
    c = ctr.orderBy(F.desc("potential_gain"), "query", "page").limit(10)
    target = F.coalesce("page", "query")
    snippet = _actions(c, F.concat(F.lit("gsc.ctr."), target), F.when(F.col("potential_gain") > 50, "high").otherwise("medium"), "trivial", "on-page", _say("Rewrite title and description for \"%s\": %s %% click, %s %% are usual", F.col("query"), F.col("actual_ctr"), F.col("expected_ctr")),
                       "The position is fine; the snippet does not earn the click.", target, clamp(_log(F.col("potential_gain")) * 20 + 40, 0, 95), "rewrite_title_and_meta", "query", "position", "impressions", "potential_gain")
    k = cannibal.where("severity <> 'low'").orderBy(F.desc("total_impressions"), "query").limit(8)
    merge = _actions(k, F.concat(F.lit("gsc.cannibal."), "query"), F.when(F.col("severity") == "high", "high").otherwise("medium"), "medium", "content", _say("Settle which of %s pages answers \"%s\"", F.col("n_pages"), F.col("query")),
                     _say("Merge into %s and redirect the others, or give each its own query.", F.col("primary_page")), F.col("primary_page"), clamp(_log(F.col("total_impressions")) * 12 + 45, 0, 92), "consolidate_pages", "query", "severity", "total_impressions")
    d = decay.orderBy("change", "page").limit(8)
    refresh = _actions(d, F.concat(F.lit("gsc.decay."), "page"), F.when(F.col("change") < -100, "high").otherwise("medium"), "medium", "content", _say("Refresh %s: clicks went from %s to %s", F.col("page"), F.col("clicks_before"), F.col("clicks_after")), decay_advice(), F.col("page"),
                       clamp(_log(F.abs("change")) * 18 + 40, 0, 95), "refresh_content", "change_pct", "likely_cause", "position_before", "position_after")
    r = rising.where("untapped").orderBy(F.desc("impressions_after"), "query").limit(6)
    build = _actions(r, F.concat(F.lit("gsc.rising."), "query"), "medium", "large", "content", _say("Give the rising query \"%s\" a page of its own (+%s %% impressions)", F.col("query"), F.col("growth_pct")), "Growing queries are easier to win early.", F.col("query"), clamp(_log(F.col("impressions_after")) * 14 + 38, 0, 88), "create_page", "impressions_before", "impressions_after", "position")
    return near.unionByName(snippet).unionByName(merge).unionByName(refresh).unionByName(build)


def decay_advice() -> Column:
    p = _say("position %s to %s", F.col("position_before"), F.col("position_after"))
    return (
        F.when(F.col("likely_cause") == "lost_rankings", F.concat(F.lit("Others overtook the page ("), p, F.lit("): compare it with what ranks now.")))
        .when(F.col("likely_cause") == "lost_impressions", F.lit("The position held; demand or the result page changed. See whether the topic is seasonal first."))
        .when(F.col("likely_cause") == "lost_ctr", F.lit("Position and impressions held; the snippet lost its clicks. Rewrite title and description."))
        .otherwise(F.concat(F.lit("Position and impressions both fell ("), p, F.lit("): rewrite it for today's intent.")))
    )


def _counted(df: DataFrame, name: str) -> DataFrame:
    """One row of the number of rows and the first 15 urls; none for an empty frame."""
    return df.agg(F.count("*").alias("n")).where("n > 0").crossJoin(F.broadcast(first_k(df, [], "url", 15, name)))  # one row each


def link_actions(graph: DataFrame, opportunities: DataFrame, limit: int = 20) -> DataFrame:
    """One action for all orphans, and one per page that others mention without a link."""
    o = _counted(graph.where("orphan"), "orphans")
    lone = _actions(o, F.lit("links.orphans_unlinked"), "high", "small", "internal-links", _say("Link to %s pages that no page links to", F.col("n")), "Pages without inbound links are hardly crawled.", F.lit(None), 84.0, "add_internal_link", "orphans")
    at = Window.partitionBy("to_url").orderBy(F.desc("score"), "from_url")
    # opportunities are limited per target
    g = opportunities.withColumn("i", F.row_number().over(at)).groupBy("to_url").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.slice(F.sort_array(F.collect_list(F.when(F.col("i") <= 5, F.struct("i", "from_url", "anchor", "context")))), 1, 5).alias("links")).orderBy(F.desc("best"), "to_url").limit(limit)
    mention = _actions(g, F.concat(F.lit("links.opportunity."), "to_url"), "medium", "trivial", "internal-links", _say("Link to %s from %s pages that mention it", F.col("to_url"), F.col("n")), "Each is an edit of one line.", F.col("to_url"), clamp(F.col("best") * 0.4 + 50, 0, 100), "add_internal_link", "links")
    return lone.unionByName(mention)


def diff_actions(pages: DataFrame, issues: DataFrame, before: DataFrame, after: DataFrame, health: tuple[float, float] | None = None) -> DataFrame:
    """Regressions between two crawls: ``pages`` and ``issues`` as of crawldiff, and both page summaries for what is indexable."""
    some = lambda df: _counted(df, "urls")
    none = F.lit(None)
    errors = _actions(some(issues.where("kind = 'new' and severity = 'error'")), F.lit("diff.new_errors"), "critical", "small", "regression", _say("Fix %s errors that are new since the last crawl", F.col("n")), "Something shipped between the crawls.", none, 92.0, "fix_regression", "urls")
    gone = _actions(some(pages.where("kind = 'removed'")), F.lit("diff.pages_disappeared"), "high", "small", "regression", _say("Redirect or restore %s pages that cannot be reached any more", F.col("n")), "Removed on purpose, or no longer linked.", none, 80.0, "redirect_or_restore", "urls")
    lost = before.where("indexable").select("url").join(after.where("not indexable").select("url"), "url")
    hidden = _actions(some(lost), F.lit("diff.deindexed"), "critical", "trivial", "regression", _say("Make %s pages indexable again", F.col("n")), "Mostly a noindex by accident.", none, 96.0, "remove_noindex", "urls")
    out = errors.unionByName(gone).unionByName(hidden)
    if health and health[1] - health[0] < -5:
        one = pages.sparkSession.createDataFrame([(float(health[0]), float(health[1]))], "health_before double, health_after double")
        out = out.unionByName(_actions(one, F.lit("diff.health_declined"), "high", "medium", "regression", _say("Health fell from %s to %s", F.col("health_before"), F.col("health_after")), "Start with the rules of the largest difference.", none, 85.0, "fix_regression", "health_before", "health_after"))
    return out


#: What a draft's score leads to: name, priority, effort, category, impact and kind of fix.
_DRAFT = (
    ("title", "critical", "trivial", "on-page", 90.0, "set_title"), ("h1", "high", "trivial", "on-page", 78.0, "set_h1"), ("intro", "high", "trivial", "on-page", 70.0, "rewrite_intro"), ("length", "medium", "large", "content", 58.0, "expand_content"),
    ("stuffing", "high", "small", "content", 65.0, "reduce_density"), ("meta", "low", "trivial", "on-page", 35.0, "set_meta_description"), ("readability", "low", "medium", "content", 30.0, "simplify_prose"),
)


def draft_actions(checks: DataFrame) -> DataFrame:
    """Actions for drafts ``(doc_id, keyword, has_title, has_h1, has_intro, has_meta, word_count, target_words, over_optimized,
    reading_ease, missing array<string>)``."""
    tests = {
        "title": ~F.col("has_title"), "h1": ~F.col("has_h1"), "intro": ~F.col("has_intro"), "meta": ~F.col("has_meta"), "length": F.col("word_count") < F.col("target_words") * 0.7,
        "stuffing": F.col("over_optimized"), "readability": (F.col("reading_ease") < 40) & (F.col("word_count") > 200),
    }
    words = {"title": "Put \"%s\" in the title", "h1": "Put \"%s\" in the H1", "intro": "Name \"%s\" in the first paragraph", "length": "Write more on \"%s\"", "stuffing": "Repeat \"%s\" less", "meta": "Write a description with \"%s\"", "readability": "Use shorter sentences on \"%s\""}
    out = None
    for name, priority, effort, category, impact, fix in _DRAFT:
        rows = _actions(checks.where(F.coalesce(tests[name], F.lit(False))), F.concat(F.lit(f"content.{name}."), F.col("doc_id").cast("string")), priority, effort, category, _say(words[name], F.col("keyword")), "From the draft's score.", F.col("doc_id"), impact, fix, "word_count", "target_words", "reading_ease")
        out = rows if out is None else out.unionByName(rows)
    n = F.size("missing")
    terms = _actions(checks.where(n > 0), F.concat(F.lit("content.terms."), F.col("doc_id").cast("string")), "high", "medium", "content", _say("Cover %s topics that the ranking pages share", n), "A missing term mostly is a missing section.", F.col("doc_id"), clamp(n * 3.0 + 50, 0, 95), "add_sections", "missing")
    return out.unionByName(terms)


def pattern_actions(patterns: DataFrame, limit: int = 8) -> DataFrame:
    top = patterns.orderBy(F.desc("viability"), F.desc("total_volume"), "template").limit(limit)
    slug = F.regexp_replace(F.regexp_replace("template", "[^a-z0-9]+", "-"), "^-+|-+$", "")
    v = F.col("viability")
    return _actions(top, F.concat(F.lit("pseo.pattern."), slug), F.when(v >= 70, "high").when(v >= 50, "medium").otherwise("low"), "large", "programmatic-seo", _say("Build a set of pages for \"%s\" with %s entities", F.col("template"), F.col("n_entities")), "Check the drafts for index risk before publishing.", F.col("template"), v, "build_pseo_set", "n_entities", "match_count", "total_volume", "avg_difficulty")


def visibility_actions(report: DataFrame, share: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """Actions from a visibility report, the competitors' shares and, where there is one, the sentiment (score, label, n)."""
    s, v, c = F.col("visibility_score"), F.col("visibility_rate"), F.col("citation_rate")
    none = F.lit(None)
    low = _actions(report.where((s < 40) & (F.col("answers") > 0)), F.lit("ai.low_visibility"), "high", "large", "ai-visibility", _say("The brand is in %s %% of answers only", v), "Answers name what trusted third parties discuss.", none, clamp(90 - s, 0, 95), "improve_ai_visibility", "visibility_rate", "citation_rate")
    cite = _actions(report.where((c < 20) & (v > 30)), F.lit("ai.mentioned_not_cited"), "medium", "medium", "ai-visibility", _say("Named in %s %% of answers, cited in %s %%", v, c), "Publish pages that are easy to quote.", none, 62.0, "publish_citable_pages", "visibility_rate", "citation_rate")
    top = share.orderBy(F.desc("mentions"), "name").limit(1).where("share_pct > 25")
    rival = _actions(top, F.lit("ai.competitor_dominance"), "medium", "large", "ai-visibility", _say("%s has %s %% of the mentions", F.col("name"), F.col("share_pct")), "See which sources the answers cite for them.", F.col("name"), clamp(F.col("share_pct") + 35, 0, 80), "target_citation_sources", "mentions", "share_pct")
    out = low.unionByName(cite).unionByName(rival)
    if sentiment is not None:
        bad = sentiment.where("label in ('negative', 'mixed')")
        out = out.unionByName(_actions(bad, F.lit("ai.negative_narrative"), F.when(F.col("label") == "negative", "high").otherwise("medium"), "medium", "ai-visibility", _say("Answers describe the brand as %s (%s)", F.col("label"), F.col("score")), "Answer the criticism where it stands.", none, clamp(55 - F.col("score") * 0.35, 0, 95), "correct_brand_narrative", "score", "label"))
    return out


def speed_actions(speed: DataFrame) -> DataFrame:
    """Actions from page-speed rows: failing metrics, or time to be won on pages that pass."""
    failing = F.array_compact(F.array(*[F.when(F.col(m) > x, F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(x).alias("goal"))) for m, x in (("lcp_ms", 2500.0), ("inp_ms", 200.0), ("cls", 0.1))]))
    s = speed.withColumns({"failing": failing, "recoverable_ms": F.aggregate("opportunities", F.lit(0.0), lambda a, o: a + o["savings_ms"])})
    n = F.size("failing")
    fix = _actions(s.where(n > 0), F.concat(F.lit("cwv."), "url"), F.when(n >= 2, "high").otherwise("medium"), "medium", "performance", _say("Fix %s failing web vitals on %s", n, F.col("url")), "Measured on real visits.", F.col("url"), clamp(n * 12.0 + 57, 0, 92), "fix_core_web_vitals", "failing", "score")
    rest = s.where((n == 0) & ((F.col("recoverable_ms") >= 1000) | (F.col("score") < 50)))
    spare = _actions(rest, F.concat(F.lit("perf.headroom."), "url"), "low", "medium", "performance", _say("Win back %s ms of load time on %s", F.col("recoverable_ms"), F.col("url")), "The page passes today.", F.col("url"), clamp(F.col("recoverable_ms") / 500 + 12, 0, 34), "fix_core_web_vitals", "recoverable_ms", "score")
    return fix.unionByName(spare)


#: Questions to ask assistants about a topic, and about a brand.
PROMPTS = (
    ("recommendation", "What is the best {t}? Give me a shortlist with reasons."), ("comparison", "What are the top {t} options in {y} and how do they compare?"), ("recommendation", "I'm evaluating {t} for a small team. What should I choose and why?"),
    ("pricing", "What are the most affordable {t} options that are still good?"), ("authority", "Which {t} do professionals actually use?"),
)
BRAND_PROMPTS = (("brand-direct", "Is {b} a good choice for {t}? What are its strengths and weaknesses?"), ("brand-defensive", "What are the best alternatives to {b}?"))


def default_prompts(topic: str, year: int, brand: str | None = None) -> list[tuple[str, str]]:
    """(category, prompt)."""
    return [(c, p.format(t=topic.strip(), y=year, b=brand)) for c, p in PROMPTS + (BRAND_PROMPTS if brand else ())]


def outline(keyword: Column, intent: Column, sections: Column, questions: Column, terms: Column, language: str | None = None) -> Column:
    """Ordered headings (level, heading) of a brief: the keyword, an answer, shared sections, terms without one, questions, a choice."""
    from webloom.functions.copy import copy_of, filled, headline
    from webloom.functions.text import stems

    c, titled = copy_of(language), headline(keyword, language)
    row = lambda level, text: F.struct(F.lit(level).alias("level"), text.alias("heading"))
    rows = lambda level, texts: F.transform(texts, lambda x: row(level, x))
    covered = F.flatten(F.transform(sections, stems))
    open_terms = F.slice(F.filter(terms, lambda t: ~F.arrays_overlap(stems(t), covered)), 1, 3)
    answer = F.when(intent == "informational", filled(c["what_is"], titled)).otherwise(filled(c["quick_answer"], titled))
    none = F.filter(F.array(row(0, F.lit(""))), lambda _: F.lit(False))
    faq = F.when(F.size(questions) > 0, F.concat(F.array(row(2, F.lit(c["faq"]))), rows(3, F.slice(questions, 1, 6)))).otherwise(none)
    choice = F.when(intent.isin("commercial", "transactional"), F.array(row(2, F.lit(c["choose"])))).otherwise(none)
    return F.concat(F.array(row(1, titled), row(2, answer)), rows(2, F.slice(sections, 1, 8)), rows(2, F.transform(open_terms, lambda t: headline(t, language))), faq, choice)
