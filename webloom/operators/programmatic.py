"""Keyword templates and page plans made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from webloom.functions.mathx import clamp, js_round
from webloom.functions.url import slugify
from webloom.operators.groups import first_k
from webloom.operators.keywords import LISTICLE, intent_columns, is_question, opportunity_columns, page_type, word_count


def _words(keyword: Column) -> Column:
    return F.split(F.trim(F.lower(keyword)), r"\s+")


def viability(entities: Column, avg_volume: Column, avg_difficulty: Column, intent: Column, constants: Column) -> Column:
    """How well a template lends itself to a set of pages, 0..100."""
    score = clamp(F.log10(entities) * 26, 0, 40) + F.when(avg_volume.isNotNull(), clamp(F.log10(avg_volume + 1.0) * 9, 0, 25)).otherwise(12)
    score = score + F.when(avg_difficulty.isNotNull(), clamp(22 * (1 - avg_difficulty / 100), 0, 22)).otherwise(11)
    return js_round(clamp(score + F.when(intent.isin("commercial", "transactional"), 8).otherwise(0) + clamp((constants - 1) * 4.0, 0, 10), 0, 100), 1)


def slots(keywords: DataFrame, min_entity: int = 2) -> DataFrame:
    """Each keyword of 2 to 8 words with each of its words blanked: template, entity, slot, n_words."""
    k = keywords.withColumn("w", _words(F.col("keyword"))).where("size(w) between 2 and 8")
    at = k.select("*", F.posexplode("w").alias("slot", "entity")).where(F.length("entity") >= min_entity)
    blank = F.transform("w", lambda x, i: F.when(i == F.col("slot"), "{x}").otherwise(x))
    return at.withColumns({"template": F.array_join(blank, " "), "n_words": F.size("w"), "constants": F.size(F.filter(blank, lambda x: x != "{x}"))}).where("constants > 0").drop("w")


def discover_patterns(keywords: DataFrame, min_matches: int = 4) -> DataFrame:
    """Templates of ``keywords(keyword, volume, difficulty, intent)`` with enough distinct entities, most viable first.

    Intent: the most frequent one, of equals the least name.
    """
    own = slots(keywords)
    g = own.groupBy("template").agg(
        F.countDistinct("entity").alias("n_entities"), F.count("*").alias("match_count"), F.coalesce(F.sum("volume"), F.lit(0)).alias("total_volume"),
        F.floor(F.avg("volume") + 0.5).cast("bigint").alias("avg_volume"), js_round(F.avg("difficulty"), 1).alias("avg_difficulty"), F.min("constants").alias("constants"),
        F.min("slot").alias("slot"), F.min("n_words").alias("n_words"), F.max(F.when(F.lower("keyword").rlike(LISTICLE), "best").otherwise("")).alias("all_text"),
        F.avg(is_question(F.col("keyword")).cast("double")).alias("questions"),
    ).where(F.col("n_entities") >= min_matches)
    votes = own.groupBy("template", "intent").agg(F.count("*").alias("n")).groupBy("template").agg(F.min_by("intent", F.struct(-F.col("n"), "intent")).alias("intent"))
    out = g.join(votes, "template")
    first = F.element_at(F.filter(F.split("template", " "), lambda x: x != "{x}"), 1)
    where = F.when(F.col("slot") == 0, "prefix").when(F.col("slot") == F.col("n_words") - 1, "suffix").otherwise("middle")
    return out.select(
        "template", "n_entities", "match_count", "total_volume", "avg_volume", "avg_difficulty", "intent", where.alias("slot_position"),
        viability(F.col("n_entities"), F.col("avg_volume"), F.col("avg_difficulty"), F.col("intent"), F.col("constants")).alias("viability"),
        page_type(F.replace(F.col("template"), F.lit("{x}"), first), F.col("intent"), F.col("all_text"), F.col("questions")).alias("page_type"),
    )


def match_entities(keywords: DataFrame, template: str) -> DataFrame:
    """``keywords`` that fit the template word by word, with their entity."""
    parts = template.strip().lower().split()
    k = keywords.withColumn("w", _words(F.col("keyword"))).where(F.size("w") == len(parts))
    for i, p in enumerate(parts):
        if p != "{x}":
            k = k.where(F.element_at("w", i + 1) == p)
    last = max((i for i, p in enumerate(parts) if p == "{x}"), default=None)
    return k.withColumn("entity", F.element_at("w", last + 1) if last is not None else F.lit(None).cast("string")).where("entity is not null").drop("w")


def link_mesh(pages: DataFrame, order: list[str], reach: int = 4) -> DataFrame:
    """(url, target, step): each page of ``pages(url)`` with the next ``reach`` ones in order, the first after the last.

    The order is numbered from counts per range of the sorted rows, so no single task holds all pages.
    """
    sorted_rows = pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id())
    from webloom.operators.similarity import checkpointed

    at = checkpointed(sorted_rows)
    counts = at.groupBy("part").agg(F.count("*").alias("n"), F.min("m").alias("m0"))
    offsets = counts.select("part", "m0", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))  # a row per partition
    total = at.agg(F.count("*").alias("total"))
    numbered = at.join(F.broadcast(offsets), "part").crossJoin(F.broadcast(total)).select("url", "total", (F.col("offset") + F.col("m") - F.col("m0")).alias("i"))
    steps = numbered.withColumn("step", F.explode(F.array(*map(F.lit, range(1, reach + 1))))).withColumn("j", (F.col("i") + F.col("step")) % F.col("total"))
    to = numbered.select(F.col("i").alias("j"), F.col("url").alias("target"))
    return steps.join(to, "j").where("url <> target").select("url", "target", "step")


def build_plan(keywords: DataFrame, template: str, base_path: str, existing: DataFrame | None = None, limit: int = 200) -> DataFrame:
    """Page specs for a template, one per entity, of ``keywords(keyword, volume, difficulty, cpc)``: primary and secondary
    keywords, slug, path, volume, intent and opportunity; ``existing(url)`` pages are left out."""
    m = match_entities(keywords, template)
    order = F.struct(-F.coalesce("volume", F.lit(0)), "keyword")
    g = m.groupBy("entity").agg(
        F.min_by(F.struct("keyword", "volume", "difficulty", "cpc"), order).alias("p"), F.sum("volume").alias("volume"), F.count("*").alias("n"),
    ).join(first_k(m, ["entity"], "keyword", 13, "all"), "entity").orderBy(F.desc(F.coalesce("volume", F.lit(0))), "entity").limit(limit)
    slug = slugify(F.replace(F.lit(template), F.lit("{x}"), F.col("entity")))
    out = g.withColumns({"slug": slug, "primary_keyword": F.col("p.keyword")}).withColumns({
        "url_path": F.concat(F.lit(base_path.rstrip("/") + "/"), "slug"), "intent": intent_columns(F.col("primary_keyword"))["intent"],
        "secondary_keywords": F.slice(F.array_except("all", F.array("primary_keyword")), 1, 12),
    })
    if existing is not None:
        out = out.join(existing.select(F.lower("url").alias("known")), F.lower("url_path") == F.col("known"), "left_anti")
    opp = opportunity_columns(F.col("p.volume"), F.col("p.difficulty"), F.col("p.cpc"), F.col("intent"), word_count(F.col("primary_keyword")))["opportunity"]
    return out.select("entity", "primary_keyword", "secondary_keywords", "slug", "url_path", "volume", F.col("p.difficulty").alias("difficulty"), "intent", opp.alias("opportunity"))


def plan_notes(plan: DataFrame, entities: int, limit: int, target_words: int) -> list[str]:
    """What to mind before pages are built from ``plan(volume, ...)`` of a template with ``entities`` entities."""
    n, known = plan.agg(F.count("*"), F.count("volume")).first()
    out = [f"{entities} entities fit, but the plan has the {limit} with most demand; publish them first and see that they are indexed."] if entities > limit else []
    out += ["No search volumes are known, so the order of entities says nothing about demand."] if n and not known else []
    return out + ([f"{n} pages of {target_words} words each are likely to be thin; check drafts with pseo_check_index_risk first."] if n > 50 and target_words < 500 else [])


def data_model(plan: DataFrame) -> DataFrame:
    """(field): what the pages of ``plan(data_requirements)`` need, each field once."""
    return plan.select(F.explode("data_requirements").alias("field")).distinct().orderBy("field")


def hub_page(plan: DataFrame, template: str, base_path: str) -> DataFrame:
    """One row: the page that leads to all others of the plan: slug, title, h1, links_to."""
    from webloom.functions.copy import headline

    name = headline(F.lit(" ".join(w for w in template.split() if w != "{x}")))
    return plan.agg(F.count("*").alias("links_to")).select(F.lit(base_path.strip("/")).alias("slug"), name.alias("title"), name.alias("h1"), "links_to")
