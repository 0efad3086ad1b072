"""What changed between two crawls: pages, findings, rules, and the history of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from webloom.functions.mathx import js_round


def diff_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and changed pages: url, kind and the fields that changed, of rows (url, status, title, meta_description,
    indexable, word_count, depth, internal_links_in, simhash)."""
    a, b = before.alias("a"), after.alias("b")
    j = a.join(b, F.col("a.url") == F.col("b.url"), "full_outer")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    moved = lambda c, floor, share: F.abs(y(c) - x(c)) > F.greatest(F.lit(float(floor)), x(c) * share)
    tests = {c: ~x(c).eqNullSafe(y(c)) for c in ("status", "title", "meta_description", "indexable")}
    tests |= {"word_count": moved("word_count", 30, 0.1), "depth": ~x("depth").eqNullSafe(y("depth")), "internal_links_in": moved("internal_links_in", 2, 0.25)}
    tests["content_changed"] = (x("simhash") != 0) & (y("simhash") != 0) & (x("simhash") != y("simhash"))
    fields = F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests.items()]))
    kind = F.when(x("url").isNull(), "added").when(y("url").isNull(), "removed").otherwise("changed")
    none = F.array().cast("array<string>")
    out = j.select(F.coalesce(x("url"), y("url")).alias("url"), kind.alias("kind"), F.when(kind == "changed", fields).otherwise(none).alias("fields"))
    return out.where("kind <> 'changed' or size(fields) > 0")


def diff_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """New and resolved findings by (rule, url), whatever their messages."""
    key = ["rule", "url"]
    side = lambda df, name: df.groupBy(*key).agg(F.min("severity").alias(name))
    j = side(before, "b").join(side(after, "a"), key, "full_outer").where("a is null or b is null")
    return j.select("rule", "url", F.coalesce("a", "b").alias("severity"), F.when(F.col("b").isNull(), "new").otherwise("resolved").alias("kind"))


def rule_delta(before: DataFrame, after: DataFrame, limit: int = 40) -> DataFrame:
    """Findings per rule before and after where they differ, the largest difference first."""
    rows = before.select("rule", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("rule", F.lit(0).alias("b"), F.lit(1).alias("a")))
    g = rows.groupBy("rule").agg(F.sum("b").alias("before"), F.sum("a").alias("after")).withColumn("delta", F.col("after") - F.col("before"))
    return g.where("delta <> 0").orderBy(F.desc(F.abs("delta")), "rule").limit(limit)


def crawl_trend(crawls: DataFrame) -> DataFrame:
    """Per site of ``crawls(site, started_at, health_score)``: number of crawls and the newest minus the oldest score."""
    g = crawls.groupBy("site").agg(F.count("*").alias("crawls"), F.max_by("health_score", "started_at").alias("newest"), F.min_by("health_score", "started_at").alias("oldest"))
    return g.select("site", "crawls", js_round(F.col("newest") - F.col("oldest"), 1).alias("trend"))
