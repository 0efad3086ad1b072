"""Ranking of recommended actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Weights of priorities and divisors of efforts.
PRIORITY = {"critical": 1000, "high": 500, "medium": 200, "low": 50}
EFFORT = {"trivial": 1.0, "small": 1.4, "medium": 2.2, "large": 4.0}


def action_score() -> Column:
    lookup = lambda name, table: F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), F.col(name))
    return (lookup("priority", PRIORITY) + F.col("impact_score")) / lookup("effort", EFFORT)


def rank_actions(actions: DataFrame, order: str = "id") -> DataFrame:
    """One action per id (the first by ``order`` and title) by weight per effort, then id."""
    first = actions.groupBy("id").agg(F.min_by(F.struct(*actions.columns), F.struct(order, "title")).alias("a")).select("a.*")
    return first.withColumn("score", action_score()).orderBy(F.desc("score"), "id")


def action_id(category: Column, title: Column, target: Column) -> Column:
    """A stable id for an action without one."""
    return F.concat(category, F.lit("."), F.substring(F.sha2(F.concat_ws("|", category, title, F.coalesce(target, F.lit(""))), 256), 1, 12))


def summary(actions: DataFrame) -> DataFrame:
    """Actions per priority."""
    return actions.groupBy("priority").agg(F.count("*").alias("n"))


def quick_wins(ranked: DataFrame, n: int = 5) -> DataFrame:
    return ranked.where(F.col("effort").isin("trivial", "small")).orderBy(F.desc("score"), "id").limit(n)
