"""Search-performance insights over rows ``(query, page, clicks, impressions, ctr, position)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from webloom.functions.mathx import ctr_for_position, js_round
from webloom.operators.keywords import intent_columns

_FLOOR = lambda x: F.floor(x + 0.5).cast("bigint")


def striking_distance(rows: DataFrame, low: float = 8, high: float = 25, min_impressions: int = 30, limit: int = 100) -> DataFrame:
    """Queries just off page one with clicks to gain at position 5; ties by query and page."""
    potential = _FLOOR(F.col("impressions") * ctr_for_position(F.lit(5.0)))
    out = rows.where(F.col("query").isNotNull() & F.col("position").between(low, high) & (F.col("impressions") >= min_impressions)).select(
        "query", "page", js_round(F.col("position"), 1).alias("position"), "impressions", "clicks", js_round(F.col("ctr") * 100, 2).alias("ctr"),
        potential.alias("potential_clicks"), (potential - F.col("clicks")).alias("potential_gain"), intent_columns(F.col("query").cast("string"))["intent"].alias("intent"),
    )
    return out.where("potential_gain > 0").orderBy(F.desc("potential_gain"), "query", "page").limit(limit)


def ctr_opportunities(rows: DataFrame, min_impressions: int = 100, max_position: float = 10, ratio: float = 0.6, limit: int = 50) -> DataFrame:
    """Rows whose click-through rate is far below what their position predicts."""
    expected = ctr_for_position(F.floor(F.col("position") + 0.5).cast("double"))
    out = rows.where(F.col("query").isNotNull() & (F.col("impressions") >= min_impressions) & (F.col("position") <= max_position)).withColumn("expected", expected)
    out = out.where((F.col("expected") > 0) & (F.col("ctr") < F.col("expected") * ratio))
    return out.select(
        "query", "page", js_round(F.col("position"), 1).alias("position"), "impressions", "clicks", js_round(F.col("ctr") * 100, 2).alias("actual_ctr"),
        js_round(F.col("expected") * 100, 2).alias("expected_ctr"), js_round((F.col("expected") - F.col("ctr")) * 100, 2).alias("ctr_gap"),
        F.greatest(F.lit(0), _FLOOR(F.col("impressions") * F.col("expected")) - F.col("clicks")).cast("bigint").alias("potential_gain"),
    ).orderBy(F.desc("potential_gain"), "query", "page").limit(limit)


def cannibalization(rows: DataFrame, min_impressions: int = 50, min_pages: int = 2, limit: int = 50) -> DataFrame:
    """Queries for which several pages compete; a page counts with a tenth of the query's impressions."""
    by = Window.partitionBy("query")
    own = rows.where("query is not null and page is not null").withColumns({"total": F.sum("impressions").over(by), "n": F.count("*").over(by)})
    own = own.where((F.col("n") >= min_pages) & (F.col("total") >= min_impressions) & (F.col("impressions") >= F.col("total") * 0.1))
    best = F.min_by(F.struct("page", "impressions"), F.struct(js_round(F.col("position"), 1).alias("p"), F.col("page").alias("q")))
    out = own.groupBy("query").agg(F.first("total").alias("total_impressions"), F.count("*").alias("n_pages"), best.alias("best")).where(F.col("n_pages") >= min_pages)
    share = F.col("best.impressions") / F.col("total_impressions")
    severity = F.when((F.col("n_pages") >= 3) | (share < 0.65), "high").when(share < 0.85, "medium").otherwise("low")
    return out.select("query", "total_impressions", "n_pages", F.col("best.page").alias("primary_page"), severity.alias("severity")).orderBy(F.desc("total_impressions"), "query").limit(limit)


def content_decay(before: DataFrame, after: DataFrame, min_clicks: int = 10, min_drop: float = 20, limit: int = 50) -> DataFrame:
    """Pages that lost clicks between two periods, with the likely cause; vanished pages have zeros after."""

    def rolled(df: DataFrame, s: str) -> DataFrame:
        return df.where("page is not null").groupBy("page").agg(F.sum("clicks").alias(f"c{s}"), F.sum("impressions").alias(f"i{s}"), F.sum(F.col("position") * F.col("impressions")).alias(f"w{s}"))

    j = rolled(before, "b").where(F.col("cb") >= min_clicks).join(rolled(after, "a"), "page", "left").na.fill(0, ["ca", "ia", "wa"])
    at = lambda s: F.when(F.col(f"i{s}") > 0, F.col(f"w{s}") / F.col(f"i{s}")).otherwise(0.0)
    change = F.col("ca") - F.col("cb")
    pct = F.when(F.col("cb") > 0, change / F.col("cb") * 100).otherwise(0.0)
    worse, fewer = at("a") > at("b") + 1.5, F.col("ia") < F.col("ib") * 0.8
    cause = F.when(worse & fewer, "mixed").when(worse, "lost_rankings").when(fewer, "lost_impressions").otherwise("lost_ctr")
    return j.where(pct <= -min_drop).select(
        "page", F.col("cb").alias("clicks_before"), F.col("ca").alias("clicks_after"), change.alias("change"), js_round(pct, 1).alias("change_pct"), F.col("ib").alias("impressions_before"),
        F.col("ia").alias("impressions_after"), js_round(at("b"), 1).alias("position_before"), js_round(at("a"), 1).alias("position_after"), cause.alias("likely_cause"),
    ).orderBy("change", "page").limit(limit)


def rising_queries(before: DataFrame, after: DataFrame, min_impressions: int = 50, min_growth: float = 30, limit: int = 40) -> DataFrame:
    """Queries of fast-growing impressions; a new one counts as growth of 100 %."""
    prev = before.where("query is not null").groupBy("query").agg(F.sum("impressions").alias("p"))
    j = after.where(F.col("query").isNotNull() & (F.col("impressions") >= min_impressions)).join(prev, "query", "left").na.fill(0, ["p"])
    growth = F.when(F.col("p") > 0, (F.col("impressions") - F.col("p")) / F.col("p") * 100).otherwise(100.0)
    rounded = js_round(growth, 1)
    return j.where(growth >= min_growth).select(
        "query", F.col("p").cast("bigint").alias("impressions_before"), F.col("impressions").alias("impressions_after"), rounded.alias("growth_pct"),
        js_round(F.col("position"), 1).alias("position"), "clicks", (F.col("position") > 10).alias("untapped"),
    ).orderBy(F.desc(F.col("impressions_after") * (F.col("growth_pct") / 100)), "query").limit(limit)


def performance(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Totals by dimensions: clicks, impressions, ctr in per cent, impression-weighted position."""
    g = rows.groupBy(*dimensions).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"))
    some = F.col("impressions") > 0
    return g.select(*dimensions, "clicks", "impressions", js_round(F.when(some, F.col("clicks") / F.col("impressions")).otherwise(0.0) * 100, 2).alias("ctr"), js_round(F.when(some, F.col("w") / F.col("impressions")).otherwise(0.0), 1).alias("position"))


def filtered(rows: DataFrame, filters: list[tuple[str, str, str]], min_impressions: int = 0) -> DataFrame:
    """Rows that pass all filters (dimension, operator, value); operators: equals, contains, notEquals, notContains."""
    for dimension, op, value in filters:
        c = F.col(dimension).cast("string")
        test = {"equals": c == value, "contains": F.contains(c, F.lit(value)), "notEquals": c != value, "notContains": ~F.contains(c, F.lit(value))}[op]
        rows = rows.where(test)
    return rows.where(F.col("impressions") >= min_impressions)
