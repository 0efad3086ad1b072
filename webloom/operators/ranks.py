"""Rank snapshots ``(keyword, position, checked_at, tie[, clicks, impressions, url])``: changes, date diffs, history; ``tie`` orders
snapshots of the same time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from webloom.functions.mathx import js_round


def rank_changes(ranks: DataFrame, limit: int | None = None) -> DataFrame:
    """Latest and previous snapshot per keyword and the change (positive: better), in one window.

    With ``limit``, the keywords of most impressions and then of the best position.  url, clicks and impressions of the latest
    snapshot are kept where the table has them.
    """
    newest = Window.partitionBy("keyword").orderBy(F.desc("checked_at"), F.desc("tie"))
    out = ranks.withColumns({
        "n": F.row_number().over(newest), "previous_position": F.lead("position").over(newest), "previous_checked_at": F.lead("checked_at").over(newest),
    }).where("n = 1")
    more = [c for c in ("url", "clicks", "impressions") if c in ranks.columns]
    out = out.select("keyword", "position", "checked_at", "previous_position", "previous_checked_at", js_round(F.col("previous_position") - F.col("position"), 1).alias("change"), *more)
    if limit is None:
        return out
    order = [F.desc_nulls_last("impressions")] if "impressions" in more else []
    return out.orderBy(*order, F.asc_nulls_last("position"), "keyword").limit(limit)


def rank_diff(ranks: DataFrame, before: str, after: str) -> DataFrame:
    """Positions on two dates, the latest snapshot of each date, side by side."""
    newest = Window.partitionBy("keyword", "d").orderBy(F.desc("checked_at"), F.desc("tie"))
    days = ranks.withColumn("d", F.to_date("checked_at")).where(F.col("d").isin(F.lit(before).cast("date"), F.lit(after).cast("date")))
    last = days.withColumn("n", F.row_number().over(newest)).where("n = 1")
    # one pass instead of a full join of two scans: each keyword has at most a row per date
    at = lambda d: F.max(F.when(F.col("d") == F.lit(d).cast("date"), F.col("position")))
    return last.groupBy("keyword").agg(at(before).alias("before"), at(after).alias("after")).withColumn("change", js_round(F.col("before") - F.col("after"), 1))


def rank_history(ranks: DataFrame, limit: int = 60) -> DataFrame:
    """The newest snapshots of each keyword."""
    newest = Window.partitionBy("keyword").orderBy(F.desc("checked_at"), F.desc("tie"))
    return ranks.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit)


def rank_dates(ranks: DataFrame) -> DataFrame:
    """Distinct snapshot dates."""
    return ranks.select(F.to_date("checked_at").alias("date")).distinct()


def usage(ledger: DataFrame, since: str | None = None) -> DataFrame:
    """Calls and units per provider of ``ledger(provider, units, at)``."""
    rows = ledger if since is None else ledger.where(F.col("at") >= F.lit(since).cast("timestamp_ntz"))
    return rows.groupBy("provider").agg(F.count("*").alias("calls"), F.sum("units").alias("units"))


def upsert_keywords(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keywords ``(keyword, volume, difficulty, cpc, intent, source)`` after an upsert: a new null never erases an old value, the
    intent is always taken anew where there is one, and the source stays."""
    key = "keyword"
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    pick = lambda c, first, then: F.coalesce(F.col(f"{first}.{c}"), F.col(f"{then}.{c}")).alias(c)
    return j.select(pick(key, "a", "b"), *[pick(c, "b", "a") for c in ("volume", "difficulty", "cpc", "intent")], pick("source", "a", "b"))


def trend(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change in per cent from the mean of the first quarter of the points to that of the last; null under six points; from
    zero 100 or null."""
    by = Window.partitionBy(*keys)
    own = series.withColumns({"i": F.row_number().over(by.orderBy(order)), "n": F.count("*").over(by)})
    q = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    mean = lambda cond: F.avg(F.when(cond, F.col(value)))
    g = own.groupBy(*keys).agg(F.max("n").alias("points"), mean(F.col("i") <= q).alias("first"), mean(F.col("i") > F.col("n") - q).alias("last"))
    pct = F.when(F.col("first") == 0, F.when(F.col("last") > 0, 100.0)).otherwise((F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0)) * 100)
    return g.select(*keys, "points", js_round(F.when(F.col("points") >= 6, pct), 1).alias("trend_pct"))
