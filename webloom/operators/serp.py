"""Result pages ``(keyword, position, domain, url)`` and link edges: competitors, gaps, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from webloom.functions.mathx import js_round


def serp_competitors(results: DataFrame, own: str | None = None) -> DataFrame:
    """Per domain over its best result in each result page: appearances, visibility, coverage, average position, top ten."""
    per_page = results.where("domain is not null").groupBy("keyword", "domain").agg(F.min("position").alias("position"))
    n = results.agg(F.countDistinct("keyword").alias("n_pages"))
    g = per_page.groupBy("domain").agg(
        F.count("*").alias("appearances"), F.sum(1 / F.sqrt("position")).alias("v"), F.avg("position").alias("p"), F.count_if(F.col("position") <= 10).alias("top_10_count")
    )
    out = g.crossJoin(F.broadcast(n)).select(  # one row
        "domain", "appearances", js_round(F.col("v") / F.greatest(F.lit(1), F.col("n_pages")) * 100, 1).alias("visibility"),
        js_round(F.col("appearances") / F.greatest(F.lit(1), F.col("n_pages")) * 100, 1).alias("coverage_pct"), js_round(F.col("p"), 1).alias("avg_position"), "top_10_count",
    )
    return out if own is None else out.where(F.col("domain") != own)


def content_gap(ranked: DataFrame, own: str, min_volume: int = 50, max_position: int = 20) -> DataFrame:
    """Keywords of ``ranked(domain, keyword, position, volume)`` for which others rank and ``own`` does not rank well."""
    mine = ranked.where(F.col("domain") == own).groupBy("keyword").agg(F.min("position").alias("your_position"))
    theirs = ranked.where((F.col("domain") != own) & (F.col("position") <= max_position) & (F.coalesce("volume", F.lit(0)) >= min_volume))
    g = theirs.groupBy("keyword").agg(F.countDistinct("domain").alias("n_competitors"), F.min("position").alias("best_position"), F.max("volume").alias("volume"))
    return g.join(mine, "keyword", "left").where(F.col("your_position").isNull() | (F.col("your_position") > max_position))


def link_gap(links: DataFrame, own: str, competitors: list[str] | None = None) -> DataFrame:
    """Sources of ``links(source, target)`` that link to a competitor and not to ``own``, with how many competitors they link to."""
    to = links.where("source is not null and target is not null").select("source", "target").distinct()
    others = to.where(F.col("target") != own) if competitors is None else to.where(F.col("target").isin(*competitors))
    return others.groupBy("source").agg(F.count("*").alias("n_competitors")).join(to.where(F.col("target") == own), "source", "left_anti")


def overlap_pairs(results: DataFrame, min_shared: int = 3, top: int = 10) -> DataFrame:
    """Keyword pairs that share at least ``min_shared`` urls among their first ``top`` results.

    Candidates come from prefixes: of each keyword's urls in order of rarity all but ``min_shared - 1`` are listed, so a url that is
    on most result pages makes few pairs; the shared urls are then counted on whole sets.
    """
    pos = Window.partitionBy("keyword").orderBy("position", "url")
    sets = results.withColumn("n", F.row_number().over(pos)).where(F.col("n") <= top).select("keyword", "url").distinct()
    df = sets.groupBy("url").agg(F.count("*").alias("df"))
    arrays = sets.join(df, "url").groupBy("keyword").agg(F.sort_array(F.collect_list(F.struct("df", "url"))).alias("s"), F.collect_set("url").alias("urls"))
    prefix = arrays.select("keyword", F.explode(F.slice("s", 1, F.greatest(F.size("s") - (min_shared - 1), F.lit(0)))).alias("x")).select("keyword", F.col("x.url").alias("url"))
    pairs = prefix.alias("a").join(prefix.alias("b"), "url").where("a.keyword < b.keyword").select(F.col("a.keyword").alias("keyword_a"), F.col("b.keyword").alias("keyword_b")).distinct()
    sets_a, sets_b = (arrays.select(F.col("keyword").alias(f"keyword_{x}"), F.col("urls").alias(f"u{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ua", "ub")).cast("bigint")
    return pairs.join(sets_a, "keyword_a").join(sets_b, "keyword_b").select("keyword_a", "keyword_b", shared.alias("shared_urls")).where(F.col("shared_urls") >= min_shared)


def anchor_frequency(backlinks: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent anchors of ``backlinks(anchor)``, trimmed and lower-cased."""
    return backlinks.select(F.trim(F.lower("anchor")).alias("anchor")).where("anchor <> ''").groupBy("anchor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "anchor").limit(limit)
