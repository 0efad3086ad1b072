"""Captured provider payloads ``(key, body)`` as normalised rows; JSON is read natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webloom.functions.url import hostname, registrable_domain

_ORGANIC = "array<struct<position:int,rank:int,link:string,url:string,title:string,snippet:string,description:string>>"


def _get(path: str) -> Column:
    return F.get_json_object("body", path)


def serp_rows(payloads: DataFrame, lists: tuple[str, ...] = ("$.organic", "$.organic_results", "$.results")) -> DataFrame:
    """Result rows of SERP payloads: keyword, position (by index where none is given), url, title, snippet, domain; rows without a link go."""
    body = F.coalesce(*[_get(p) for p in lists])
    r = payloads.select(F.col("key").alias("keyword"), F.posexplode(F.from_json(body, _ORGANIC)).alias("i", "r")).withColumn("url", F.coalesce("r.link", "r.url")).where("url is not null and url <> ''")
    return r.select("keyword", F.coalesce("r.position", "r.rank", F.col("i") + 1).alias("position"), "url", F.coalesce("r.title", F.lit("")).alias("title"), F.coalesce("r.snippet", "r.description", F.lit("")).alias("snippet"), registrable_domain(hostname(F.col("url"))).alias("domain"))


#: Payload fields whose presence is a feature of the result page.
FEATURES = {"answerBox": "featured_snippet", "answer_box": "featured_snippet", "knowledgeGraph": "knowledge_panel", "knowledge_graph": "knowledge_panel", "peopleAlsoAsk": "people_also_ask", "related_questions": "people_also_ask", "topStories": "top_stories", "images": "image_pack", "videos": "video", "places": "local_pack", "shopping": "shopping", "ads": "ads"}


def serp_features(payloads: DataFrame) -> DataFrame:
    """(keyword, feature) of the features that a payload has."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.coalesce(_get(f"$.{k}"), F.lit("[]")).isin("[]", "{}", "null") == False, F.lit(v)) for k, v in FEATURES.items()])))  # noqa: E712
    return payloads.select(F.col("key").alias("keyword"), F.explode(found).alias("feature"))


def questions(payloads: DataFrame) -> DataFrame:
    """(keyword, question) of the questions that a payload lists."""
    rows = F.from_json(F.coalesce(_get("$.peopleAlsoAsk"), _get("$.related_questions")), "array<struct<question:string>>")
    return payloads.select(F.col("key").alias("keyword"), F.explode(rows).alias("q")).select("keyword", F.col("q.question").alias("question")).where("question is not null")


_METRIC = "struct<keyword:string,search_volume:bigint,volume:bigint,cpc:double,competition:double,keyword_difficulty:double,monthly_searches:array<struct<year:int,month:int,search_volume:bigint>>>"
_RANKED = "array<struct<keyword:string,keyword_data:struct<keyword:string,keyword_info:struct<search_volume:bigint,cpc:double>,keyword_properties:struct<keyword_difficulty:double>>,ranked_serp_element:struct<serp_item:struct<rank_absolute:int,url:string>>,search_volume:bigint,cpc:double,position:int,url:string>>"


def keyword_metrics(payloads: DataFrame) -> DataFrame:
    """keyword, volume, cpc, competition, difficulty and the monthly volumes in order of time."""
    m = payloads.select(F.explode(F.from_json(F.coalesce(_get("$.result"), _get("$.items"), F.col("body")), f"array<{_METRIC}>")).alias("m")).where("m.keyword is not null")
    months = F.array_sort(F.transform("m.monthly_searches", lambda x: F.struct(x["year"].alias("year"), x["month"].alias("month"), F.coalesce(x["search_volume"], F.lit(0)).alias("volume"))))
    return m.select(F.lower(F.trim("m.keyword")).alias("keyword"), F.coalesce("m.search_volume", "m.volume").alias("volume"), F.col("m.cpc").alias("cpc"), F.col("m.competition").alias("competition"), F.col("m.keyword_difficulty").alias("difficulty"), months.alias("monthly_volumes"))


def ranked_keywords(payloads: DataFrame) -> DataFrame:
    """(domain, keyword, position, url, volume, cpc, difficulty) of nested or flat rows; rows without keyword or position go."""
    r = payloads.select(F.col("key").alias("domain"), F.explode(F.from_json(F.coalesce(_get("$.items"), _get("$.result"), F.col("body")), _RANKED)).alias("r"))
    out = r.select(
        "domain", F.lower(F.coalesce("r.keyword_data.keyword", "r.keyword")).alias("keyword"), F.coalesce("r.ranked_serp_element.serp_item.rank_absolute", "r.position").alias("position"),
        F.coalesce("r.ranked_serp_element.serp_item.url", "r.url").alias("url"), F.coalesce("r.keyword_data.keyword_info.search_volume", "r.search_volume").alias("volume"),
        F.coalesce("r.keyword_data.keyword_info.cpc", "r.cpc").alias("cpc"), F.col("r.keyword_data.keyword_properties.keyword_difficulty").alias("difficulty"),
    )
    return out.where("keyword is not null and position is not null")


def authority(payloads: DataFrame, scale: float) -> DataFrame:
    """(domain, score 0..100) from payloads whose scores go up to ``scale``: 10, 100 or 1000."""
    score = F.coalesce(_get("$.score"), _get("$.rank"), _get("$.page_rank_decimal")).cast("double")
    return payloads.select(F.col("key").alias("domain"), F.least(F.lit(100.0), F.floor(score * (100.0 / scale) * 10 + 0.5) / 10).alias("score"))


def backlinks(payloads: DataFrame, limit: int = 1000) -> DataFrame:
    """(target, url_from, url_to, anchor, nofollow, rank), the links of the highest-ranked domains first."""
    kind = "array<struct<url_from:string,url_to:string,anchor:string,dofollow:boolean,domain_from_rank:double>>"
    b = payloads.select(F.col("key").alias("target"), F.explode(F.from_json(F.coalesce(_get("$.items"), F.col("body")), kind)).alias("b"))
    return b.select("target", "b.url_from", "b.url_to", "b.anchor", (~F.coalesce("b.dofollow", F.lit(True))).alias("nofollow"), F.col("b.domain_from_rank").alias("rank")).orderBy(F.desc_nulls_last("rank"), "url_from").limit(limit)


def link_gap_rows(payloads: DataFrame, competitors: list[str]) -> DataFrame:
    """(source, competitor): intersections keyed by the competitor's number from 1; unknown numbers go."""
    r = payloads.select(F.col("key").alias("source"), F.explode(F.map_keys(F.from_json(_get("$.domain_intersection"), "map<string,string>"))).alias("n"))
    names = F.array(*map(F.lit, competitors))
    return r.where(F.col("n").rlike("^[0-9]+$")).select("source", F.get(names, F.col("n").cast("int") - 1).alias("competitor")).where("competitor is not null")


def suggestions(payloads: DataFrame) -> DataFrame:
    """(via, engine, keyword, rank) of autocomplete payloads ``(key, engine, body)``: arrays with a list of texts, or objects with phrases."""
    plain = F.from_json(F.get_json_object("body", "$[1]"), "array<string>")
    objects = F.transform(F.from_json("body", "array<struct<phrase:string>>"), lambda x: x["phrase"])
    s = payloads.select(F.col("key").alias("via"), "engine", F.posexplode(F.coalesce(plain, F.array_compact(objects))).alias("rank", "keyword"))
    return s.select("via", "engine", F.trim(F.lower(F.regexp_replace("keyword", "<[^>]+>", ""))).alias("keyword"), "rank").where("keyword <> ''")


def page_speed(payloads: DataFrame) -> DataFrame:
    """(url, score, lcp_ms, inp_ms, cls, opportunities): field data, and the audits under 0.9 by the time they save."""
    metric = lambda name: F.get_json_object("body", f"$.loadingExperience.metrics.{name}.percentile").cast("double")
    kind = "map<string,struct<title:string,score:double,numericUnit:string,details:struct<overallSavingsMs:double>,metricSavings:map<string,double>>>"
    audits = F.map_entries(F.from_json(_get("$.lighthouseResult.audits"), kind))
    own = F.filter(audits, lambda a: a["value"]["score"] < 0.9)
    saving = lambda a: F.greatest(F.coalesce(a["value"]["details"]["overallSavingsMs"], F.lit(0.0)), F.coalesce(F.array_max(F.map_values(F.map_filter(a["value"]["metricSavings"], lambda k, _: k != "CLS"))), F.lit(0.0)))
    ranked = F.slice(F.reverse(F.array_sort(F.transform(own, lambda a: F.struct(saving(a).alias("savings_ms"), a["key"].alias("id"), a["value"]["title"].alias("title"))))), 1, 15)
    score = F.floor(_get("$.lighthouseResult.categories.performance.score").cast("double") * 100 + 0.5)
    return payloads.select(F.col("key").alias("url"), score.alias("score"), metric("LARGEST_CONTENTFUL_PAINT_MS").alias("lcp_ms"), metric("INTERACTION_TO_NEXT_PAINT").alias("inp_ms"), (metric("CUMULATIVE_LAYOUT_SHIFT_SCORE") / 100).alias("cls"), ranked.alias("opportunities"))


def page_speed_actions(speed: DataFrame) -> DataFrame:
    """(url, metric, value, limit) for field metrics past their thresholds of 2500 ms, 200 ms and 0.1."""
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"), F.lit(x).alias("limit")) for c, x in (("lcp_ms", 2500.0), ("inp_ms", 200.0), ("cls", 0.1))])
    return speed.select("url", F.explode(rows).alias("r")).select("url", "r.metric", "r.value", "r.limit").where("value > `limit`")
