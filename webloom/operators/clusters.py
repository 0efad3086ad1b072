"""Keyword clusters: greedy by value, by distinctive words or by shared result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webloom.functions.mathx import js_round
from webloom.functions.text import stem_set
from webloom.operators.content import idf
from webloom.operators.keywords import LISTICLE, is_question, page_type
from webloom.operators.serp import overlap_pairs
from webloom.operators.similarity import checkpointed, leaders

#: Share of keywords from which a token is background, and share of the head's tokens a member must have.
BACKGROUND, CONTAINMENT = 0.6, 0.5


def _weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x["w"])


def _common(a: Column, b: Column) -> Column:
    """The elements of ``a`` whose token is in ``b``."""
    names = F.transform(b, lambda x: x["t"])
    return F.filter(a, lambda x: F.array_contains(names, x["t"]))


def joins(head: Column, cand: Column, min_overlap: float) -> Column:
    """Whether a keyword joins a head's cluster; both are arrays of (t, w, background)."""
    own = lambda x: F.filter(x, lambda y: ~y["background"])
    h, c = own(head), own(cand)
    contained = F.size(_common(head, cand)) / F.greatest(F.size(head), F.lit(1)) >= CONTAINMENT
    wh, wc, shared = _weight(h), _weight(c), _weight(_common(h, c))
    smaller = F.least(wh, wc)
    overlap = F.when(smaller < 1e-9, 0.0).otherwise(shared / F.greatest(smaller, F.lit(1e-9)))
    distinct = (wh < 1e-9) | (shared / F.greatest(wh, F.lit(1e-9)) >= min_overlap) | (overlap >= max(min_overlap, 0.66))
    return contained & F.when(F.size(h) == 0, F.size(c) == 0).when(F.size(c) == 0, False).otherwise(distinct)


def _order(size: Column) -> Column:
    """Nodes as structs in order of value: opportunity, volume, fewer words, keyword."""
    return F.struct((-F.coalesce("opportunity", F.lit(-1.0))).alias("o"), (-F.coalesce("volume", F.lit(-1)).cast("double")).alias("v"), size.alias("s"), "keyword")


def _prepared(keywords: DataFrame) -> DataFrame:
    k = keywords.withColumn("ts", stem_set(F.col("keyword"))).where("size(ts) > 0")
    weights = idf(k.select(F.col("keyword").alias("text")), BACKGROUND).select("token", "idf", "background", "df")
    long = k.select("keyword", F.explode("ts").alias("token")).join(weights, "token")
    toks = long.groupBy("keyword").agg(F.sort_array(F.collect_list(F.struct("df", F.col("token").alias("t"), F.col("idf").alias("w"), "background"))).alias("toks"))
    return k.join(toks, "keyword").withColumns({"node": _order(F.size("ts")), "question": is_question(F.col("keyword"))})


def lexical_members(keywords: DataFrame, min_overlap: float = 0.5, separate_questions: bool = False) -> DataFrame:
    """(keyword, head) for ``keywords(keyword, opportunity, volume, ...)`` of distinct keywords with content words.

    Candidates share one of the head's rarest tokens: all but half of them, rounded up, plus one must be listed for that.
    """
    p = checkpointed(_prepared(keywords).select("keyword", "node", "toks", "question"))
    n = F.size("toks")
    listed = p.select("node", "toks", "question", F.explode(F.slice("toks", 1, n - F.ceil(n * CONTAINMENT).cast("int") + 1)).alias("x")).select(F.col("node").alias("a"), F.col("toks").alias("ta"), F.col("question").alias("qa"), F.col("x.t").alias("t"))
    every = p.select(F.col("node").alias("b"), F.col("toks").alias("tb"), F.col("question").alias("qb"), F.explode("toks").alias("x")).select("b", "tb", "qb", F.col("x.t").alias("t"))
    pairs = listed.join(every, "t").where("a < b").dropDuplicates(["a", "b"])
    pairs = pairs.where("qa = qb") if separate_questions else pairs
    edges = pairs.where(joins(F.col("ta"), F.col("tb"), min_overlap)).select("a", "b")
    return leaders(p.select("node"), edges).select(F.col("node.keyword").alias("keyword"), F.col("leader.keyword").alias("head"))


def serp_members(keywords: DataFrame, results: DataFrame, min_shared: int = 3, top: int = 10, **lexical) -> DataFrame:
    """(keyword, head, method): by shared results where a keyword has any, the others by words."""
    have = keywords.join(results.select("keyword").distinct(), "keyword", "left_semi").withColumn("node", F.struct((-F.coalesce(F.col("opportunity"), F.col("volume").cast("double"), F.lit(0.0))).alias("o"), "keyword"))
    pairs = overlap_pairs(results, min_shared, top)
    node = lambda k, name: have.select(F.col("keyword").alias(k), F.col("node").alias(name))
    both = pairs.join(node("keyword_a", "x"), "keyword_a").join(node("keyword_b", "y"), "keyword_b")
    led = leaders(have.select("node"), both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).select(F.col("node.keyword").alias("keyword"), F.col("leader.keyword").alias("head"), F.lit("serp").alias("method"))
    rest = keywords.join(results.select("keyword").distinct(), "keyword", "left_anti")
    return led.unionByName(lexical_members(rest, **lexical).withColumn("method", F.lit("lexical")))


def roll_up(keywords: DataFrame, members: DataFrame, min_size: int = 1, limit: int | None = None) -> DataFrame:
    """Clusters: head, size, total_volume, avg_difficulty, intent (by volume-weighted vote) and page_type, the largest volume first."""
    j = members.join(keywords, "keyword")
    g = j.groupBy("head").agg(
        F.count("*").alias("size"), F.coalesce(F.sum("volume"), F.lit(0)).alias("total_volume"), js_round(F.avg("difficulty"), 1).alias("avg_difficulty"),
        F.max(F.when(F.lower("keyword").rlike(LISTICLE), "best").otherwise("")).alias("text"), F.avg(is_question(F.col("keyword")).cast("double")).alias("questions"),
    ).where(F.col("size") >= min_size)
    votes = j.groupBy("head", "intent").agg(F.sum(F.coalesce("volume", F.lit(10)) + 1).alias("w")).groupBy("head").agg(F.min_by("intent", F.struct(-F.col("w"), "intent")).alias("intent"))
    out = g.join(votes, "head").select("head", "size", "total_volume", "avg_difficulty", "intent", page_type(F.col("head"), F.col("intent"), F.col("text"), F.col("questions")).alias("page_type")).orderBy(F.desc("total_volume"), "head")
    return out if limit is None else out.limit(limit)
