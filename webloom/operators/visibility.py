"""Mentions of brands in answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from webloom.functions.mathx import clamp, js_round


def brand_regex(brand: str) -> str:
    """Whole-word pattern; an edge that is no word character must stand at white space."""
    b = brand.lower()
    head = r"\b" if re.match(r"[A-Za-z0-9_]", b) else r"(?<!\S)"
    tail = r"\b" if re.search(r"[A-Za-z0-9_]$", b) else r"(?!\S)"
    return f"{head}{re.escape(b)}{tail}"


def _at(text: Column, brand: str) -> Column:
    """Offset from 0 of the first mention, or -1."""
    return F.regexp_instr(F.lower(text), F.lit(brand_regex(brand))) - 1


def mentions(answers: DataFrame, brand: str, competitors: list[str]) -> DataFrame:
    """``answers`` with brand_mentioned, mention_position (share of the text before it), mention_context and the competitors in order
    of their first mention."""
    t, at = F.coalesce("text", F.lit("")), _at(F.coalesce(F.col("text"), F.lit("")), brand)
    found = F.array_compact(F.array(*[F.when(_at(t, c) >= 0, F.struct(_at(t, c).alias("at"), F.lit(c).alias("name"))) for c in competitors if c.lower() != brand.lower()]))
    before = F.substring(t, F.lit(1), at)
    start = F.length(before) - F.length(F.substring_index(before, ".", -1))
    tail = F.substring(t, at + 1, F.length(t))
    dot = F.instr(tail, ".")
    context = F.substring(t, start + 1, at - start + F.when(dot > 0, dot).otherwise(200))
    return answers.withColumns({
        "brand_mentioned": at >= 0, "mention_position": F.when(at >= 0, js_round(at / F.greatest(F.length(t), F.lit(1)), 3)),
        "mention_context": F.when(at >= 0, F.substring(F.trim(context), 1, 300)), "competitors_mentioned": F.transform(F.array_sort(found), lambda x: x["name"]),
    })


def share_of_voice(found: DataFrame) -> DataFrame:
    """(name, mentions, share_pct) of competitors among all mentions, the brand's included."""
    brand = found.agg(F.count_if("brand_mentioned").alias("brand"))
    g = found.select(F.explode("competitors_mentioned").alias("name")).groupBy("name").agg(F.count("*").alias("mentions"))
    total = g.agg(F.coalesce(F.sum("mentions"), F.lit(0)).alias("all"))
    return g.crossJoin(F.broadcast(brand)).crossJoin(F.broadcast(total)).select("name", "mentions", js_round(F.col("mentions") / (F.col("all") + F.col("brand")) * 100, 1).alias("share_pct"))  # one row each


def visibility_report(found: DataFrame) -> DataFrame:
    """One row: answers, rates of mention and citation (``domain_cited``), and the score."""
    n = F.greatest(F.count("*"), F.lit(1))
    g = found.agg(F.count("*").alias("answers"), (F.count_if("brand_mentioned") / n * 100).alias("v"), (F.count_if("domain_cited") / n * 100).alias("c"), F.coalesce(F.avg(F.when(F.col("brand_mentioned"), 1 - F.coalesce("mention_position", F.lit(0.5)))), F.lit(0.0)).alias("p"))
    return g.select("answers", js_round(F.col("v"), 1).alias("visibility_rate"), js_round(F.col("c"), 1).alias("citation_rate"), js_round(clamp(F.col("v") * 0.55 + F.col("c") * 0.25 + F.col("p") * 20, 0, 100), 1).alias("visibility_score"))


def sentiment(labels: DataFrame) -> DataFrame:
    """One row from ``labels(sentiment)``: score from -100 to 100 and a label."""
    pos, neg = F.count_if(F.col("sentiment") == "positive"), F.count_if(F.col("sentiment") == "negative")
    g = labels.agg(pos.alias("positives"), neg.alias("negatives"), F.count("*").alias("n")).withColumn("score", js_round((F.col("positives") - F.col("negatives")) / F.greatest("n", F.lit(1)) * 100, 1))
    label = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), "mixed").when(F.col("score") >= 25, "positive").when(F.col("score") <= -25, "negative").otherwise("neutral")
    return g.withColumn("label", label)
