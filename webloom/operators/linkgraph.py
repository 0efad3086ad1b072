"""Internal link graph: PageRank, degrees, starved and hub pages, link opportunities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from webloom.functions.mathx import clamp, js_round
from webloom.functions.text import content_tokens, stem_all, stem_set, tokens
from webloom.functions.url import slash_key
from webloom.operators.similarity import LOCAL_EDGES, checkpointed, count_phrase


def page_edges(pages: DataFrame, follow_only: bool = True) -> DataFrame:
    """Distinct internal edges (src, dst) between slash-insensitive keys; ``follow_only`` leaves nofollow links out."""
    e = pages.select(slash_key(F.col("url")).alias("src"), F.explode("links").alias("l")).where("l.internal")
    e = e.where("not l.nofollow") if follow_only else e
    return e.select("src", slash_key(F.col("l.url")).alias("dst")).where("src <> dst").distinct()


def _rank_in_one_task(linked: DataFrame, n: int, iterations: int, damping: float) -> DataFrame:
    """(node, r) of the nodes with links; all others have the value of ``node`` null."""

    def run(batches):  # noqa: ANN001, ANN202
        parts = [(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches]
        src, dst = [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]
        names = sorted({*src, *dst})
        at = {x: k for k, x in enumerate(names)}
        s, d = (np.array([at[x] for x in side], np.int64) for side in (src, dst))
        degree = np.bincount(s, minlength=len(names)).astype(float)
        r, rest, idle = np.full(len(names), 1.0 / n), 1.0 / n, n - len(names)  # ``rest``: of each node without any link
        for _ in range(iterations):
            lost = float(r[degree == 0].sum()) + rest * idle
            base = (1 - damping) / n + damping * lost / n
            got = np.bincount(d, weights=r[s] / degree[s], minlength=len(names)) if len(s) else r
            r, rest = base + damping * got, base
        yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.string()), pa.array([*r.tolist(), rest], pa.float64())], ["node", "r"])

    return linked.select(F.col("src").cast("string"), F.col("dst").cast("string")).coalesce(1).mapInArrow(run, "node string, r double")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 40, damping: float = 0.85, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, page_rank) scaled to 100 for the highest, of ``nodes(node)`` and ``edges(src, dst)``.

    A fixed number of iterations; the mass of nodes without links is spread evenly.  Up to ``local_edges`` edges go through one task.  More
    take one join and one aggregation per iteration, after each of which the ranks are checkpointed, so plans stay flat.
    """
    nodes = nodes.select("node").where("node is not null").distinct()
    inside = edges.where("src <> dst").select("src", "dst").distinct().join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    inside, n = checkpointed(inside), nodes.count()
    if not n:
        return nodes.withColumn("page_rank", F.lit(0.0))
    if inside.count() <= local_edges:
        got = checkpointed(_rank_in_one_task(inside, n, iterations, damping))
        rest = F.broadcast(got.where("node is null").select(F.col("r").alias("rest")))  # one row
        own = got.where("node is not null").select(F.col("node").alias("name"), "r")
        state = nodes.join(own, F.col("node").cast("string") == F.col("name"), "left").crossJoin(rest).select("node", F.coalesce("r", "rest").alias("r"))
    else:
        degree = inside.groupBy("src").agg(F.count("*").alias("degree"))
        linked = checkpointed(inside.join(degree, "src"))
        state = checkpointed(nodes.join(degree.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("degree").isNull().alias("dangling"), F.lit(1.0 / n).alias("r")))
        for _ in range(iterations):
            lost = state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("r"))), F.lit(0.0)).alias("lost"))
            got = linked.join(state.select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") / F.col("degree")).alias("got"))
            mixed = state.select("node", "dangling").join(got, "node", "left").crossJoin(F.broadcast(lost))  # one row
            r = (1 - damping) / n + F.lit(damping) * F.col("lost") / n + F.lit(damping) * F.coalesce("got", F.lit(0.0))
            state = checkpointed(mixed.select("node", "dangling", r.alias("r")))
    top = state.agg(F.max("r").alias("top"))
    return state.crossJoin(F.broadcast(top)).select("node", js_round(F.when(F.col("top") > 0, F.col("r") / F.col("top")).otherwise(0.0) * 100, 2).alias("page_rank"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) over distinct edges; targets outside the nodes count for the source."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return nodes.select("node").distinct().join(into, "node", "left").join(out, "node", "left").na.fill(0, ["in_degree", "out_degree"]).select("node", "in_degree", "out_degree")


def link_graph(pages: DataFrame, iterations: int = 40) -> DataFrame:
    """Per successful page: degrees, PageRank, depth, words, indexable, orphan."""
    p = pages.where(F.col("error").isNull() & F.col("status").between(200, 299)).withColumn("node", slash_key(F.col("url")))
    rank = pagerank(p.select("node"), page_edges(p), iterations)
    deg = degrees(p.select("node"), page_edges(p, follow_only=False))
    noindex = F.coalesce(F.col("meta_robots").rlike(r"(?i)\bnoindex\b"), F.lit(False))
    return p.join(rank, "node").join(deg, "node").select("url", "title", "depth", "in_degree", "out_degree", "page_rank", "word_count", (~noindex).alias("indexable"), ((F.col("in_degree") == 0) & (F.col("depth") > 0)).alias("orphan"))


def starved_pages(graph: DataFrame, limit: int = 25) -> DataFrame:
    """Indexable pages of 100 words or more in the last decile and under half the median rank, or with at most three links.

    The thresholds are elements of the sorted ranks, found from counts per distinct rank, not by numbering all pages in one task.
    """
    own = graph.where("indexable and word_count >= 100")
    counts = own.groupBy("page_rank").agg(F.count("*").alias("c"))  # at most 10 001 distinct values of two decimals
    run = counts.withColumn("upto", F.sum("c").over(Window.orderBy(F.desc("page_rank")))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda q: F.max(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("page_rank")))
    limits = run.agg(F.least(at(0.9), at(0.5) * 0.5).alias("threshold"))
    return own.crossJoin(F.broadcast(limits)).where("page_rank <= threshold or in_degree <= 3").drop("threshold").orderBy(F.desc("page_rank"), "url").limit(limit)


def hub_pages(graph: DataFrame, limit: int = 15) -> DataFrame:
    return graph.where("out_degree > 0").orderBy(F.desc("page_rank"), "url").limit(limit)


def depth_distribution(graph: DataFrame) -> DataFrame:
    return graph.groupBy("depth").agg(F.count("*").alias("n"))


def topic_phrases() -> Column:
    """The first H1 and the title up to a separator, lower-cased, of 2 to 6 content tokens."""
    cut = lambda c: F.lower(F.trim(F.get(F.split(c, r"\s+[|—–·-]\s+"), F.lit(0))))
    both = F.array_distinct(F.array_compact(F.array(cut(F.get("h1", F.lit(0))), cut(F.col("title")))))
    return F.filter(both, lambda p: F.size(content_tokens(p)).between(2, 6))


def link_opportunities(pages: DataFrame, targets: list[str] | None = None, max_per_target: int = 3, limit: int = 100) -> DataFrame:
    """Pages that mention a target's topic without a link to it: to_url, from_url, anchor, context, score.

    Without ``targets`` the 30 lowest-ranked pages are taken.  Sources are candidates only if they hold all of the phrase's stems,
    found by a join on its rarest stem; the phrase is then matched in the text.
    """
    p = pages.where(F.col("error").isNull() & F.col("status").between(200, 299) & (F.col("word_count") >= 80)).withColumn("node", slash_key(F.col("url")))
    rank = pagerank(p.select("node"), page_edges(p))
    p = checkpointed(p.join(rank, "node").select("node", "url", "title", "h1", "text", "page_rank", "links"))
    goal = p.where(F.col("node").isin([t.rstrip("/") for t in targets])) if targets else p.orderBy("page_rank", "url").limit(30)
    phrase = goal.select(F.col("node").alias("to"), F.col("url").alias("to_url"), F.concat_ws(" ", "title", F.array_join("h1", " ")).alias("to_topic"), F.posexplode(topic_phrases()).alias("pos", "anchor"))
    need = phrase.withColumn("needle", stem_all(content_tokens(F.col("anchor"))))
    hay = p.select("node", "url", "text", "page_rank", "links", F.concat_ws(" ", "title", F.array_join("h1", " ")).alias("topic"), stem_all(tokens(F.col("text"))).alias("hay"))
    words = hay.select("node", F.explode(F.array_distinct("hay")).alias("t"))
    df = words.join(F.broadcast(need.select(F.explode("needle").alias("t")).distinct()), "t", "left_semi").groupBy("t").agg(F.count("*").alias("df"))  # the targets' few phrases
    rarest = need.withColumn("x", F.explode("needle")).join(df, F.col("x") == F.col("t")).groupBy("to", "anchor").agg(F.min_by("t", F.struct("df", "t")).alias("t"))
    cand = need.join(rarest, ["to", "anchor"]).join(words, "t").where("node <> to").join(hay, "node")
    linked = F.exists("links", lambda x: x["internal"] & (slash_key(x["url"]) == F.col("to")))
    hit = cand.where(~linked & (F.size(F.array_except("needle", "hay")) == 0)).where(count_phrase("hay", "needle") > 0)
    short = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: (F.length(s) <= 500) & (F.size(F.array_except(F.col("needle"), stem_all(tokens(s)))) == 0))
    context = hit.withColumn("context", F.trim(F.get(short, F.lit(0)))).where("context is not null")
    a, b = stem_set(F.col("topic")), stem_set(F.col("to_topic"))
    overlap = F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.greatest(F.size(a) * F.size(b), F.lit(1))))
    one = context.withColumn("n", F.row_number().over(Window.partitionBy("to", "node").orderBy("pos"))).where("n = 1")
    best = one.withColumn("n", F.row_number().over(Window.partitionBy("to").orderBy(F.desc("page_rank"), "url"))).where(F.col("n") <= max_per_target)
    return best.select("to_url", F.col("url").alias("from_url"), "anchor", "context", js_round(clamp(F.col("page_rank") * 0.45 + overlap * 55, 0, 100), 1).alias("score")).orderBy(F.desc("score"), "to_url", "from_url").limit(limit)
