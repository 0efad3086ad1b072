"""Tables of the engine's concepts made from the test tables, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt to all cores if it is small."""
    return spread(table(spark, sf_dir, name))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), cents.alias("cents"))


SQL_EVENTS = """ev AS (SELECT event_id, ts, user_id, event_type, value, regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT AS k, floor(value * 100 + 0.5)::BIGINT AS cents FROM events)"""


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank snapshots: keyword = user, position = value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("keyword"), F.col("value").alias("position"), F.col("ts").alias("checked_at"), F.col("event_id").alias("tie"))


SQL_RANKS = "ranks AS (SELECT user_id AS keyword, value AS position, ts AS checked_at, event_id AS tie FROM events)"


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-performance rows by query (user) and page (k modulo 5)."""
    e = _events(spark, sf_dir).withColumn("m", F.col("k") % 5)
    g = e.groupBy("user_id", "m").agg(F.floor(F.sum("cents") / 1000).cast("bigint").alias("impressions"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("clicks"))
    position = (1 + (F.col("user_id") * 7 + F.col("m") * 13) % 40).cast("double")
    ctr = F.when(F.col("impressions") > 0, F.col("clicks") / F.greatest("impressions", F.lit(1))).otherwise(0.0)
    return g.select(F.col("user_id").cast("string").alias("query"), F.concat(F.lit("/p"), F.col("m").cast("string")).alias("page"), "clicks", "impressions", ctr.alias("ctr"), position.alias("position"))


SQL_PERFORMANCE = SQL_EVENTS + """,
perf AS (
  SELECT user_id::VARCHAR AS query, '/p' || m::VARCHAR AS page, clicks, impressions, CASE WHEN impressions > 0 THEN clicks::DOUBLE / impressions ELSE 0::DOUBLE END AS ctr, (1 + (user_id * 7 + m * 13) % 40)::DOUBLE AS position
  FROM (SELECT user_id, k % 5 AS m, floor(sum(cents)::DOUBLE / 1000)::BIGINT AS impressions, count(*) FILTER (event_type IN ('click', 'purchase')) AS clicks FROM ev GROUP BY 1, 2))"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows by page (k) before and after the middle of the month; a page's query is its number."""
    e = _events(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")

    def half(rows: DataFrame) -> DataFrame:
        g = rows.groupBy("k").agg(F.floor(F.sum("cents") / 100).cast("bigint").alias("impressions"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("clicks"), F.count("*").alias("c"))
        name = F.col("k").cast("string")
        return g.select(name.alias("query"), name.alias("page"), "clicks", "impressions", (1 + F.col("c") % 30).cast("double").alias("position"))

    return half(e.where(F.col("ts") < cut)), half(e.where(F.col("ts") >= cut))


def _sql_half(name: str, op: str) -> str:
    return f"""{name} AS (
  SELECT k::VARCHAR AS query, k::VARCHAR AS page, clicks, impressions, (1 + c % 30)::DOUBLE AS position
  FROM (SELECT k, floor(sum(cents)::DOUBLE / 100)::BIGINT AS impressions, count(*) FILTER (event_type IN ('click', 'purchase')) AS clicks, count(*) AS c FROM ev WHERE ts {op} TIMESTAMP '2024-01-16' GROUP BY k))"""


SQL_HALVES = f"{SQL_EVENTS},\n{_sql_half('bef', '<')},\n{_sql_half('aft', '>=')}"


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords: distinct part names with volume, difficulty and cpc."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    per = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    cents = F.sum(F.floor(F.col("p_retailprice") * 100 + 0.5).cast("bigint"))
    g = part.join(per, "p_partkey", "left").groupBy(F.lower("p_name").alias("keyword")).agg(F.sum("q").alias("volume"), (F.sum(F.col("p_size") * 2).cast("double") / F.count("*")).alias("difficulty"), (cents / F.count("*") / 10000).alias("cpc"))
    return g


SQL_KEYWORDS = """kw AS (
  SELECT lower(p_name) AS keyword, sum(q)::BIGINT AS volume, sum(p_size * 2)::DOUBLE / count(*) AS difficulty, sum(floor(p_retailprice * 100 + 0.5)::BIGINT)::DOUBLE / count(*) / 10000 AS cpc
  FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages: keyword = part name, domain = supplier, ordered by quantity."""
    from pyspark.sql import Window

    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    g = j.groupBy(F.lower("p_name").alias("keyword"), F.col("l_suppkey").alias("s")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    at = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("q"), "s"))
    domain = F.concat(F.lit("s"), F.col("s").cast("string"), F.lit(".com"))
    return g.select("keyword", at.alias("position"), domain.alias("domain"), F.concat(F.lit("https://"), domain, F.lit("/")).alias("url"), F.col("q").alias("volume"))


SQL_RESULTS = """serp AS (
  SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY q DESC, s) AS position, 's' || s::VARCHAR || '.com' AS domain, 'https://s' || s::VARCHAR || '.com/' AS url, q AS volume
  FROM (SELECT lower(p_name) AS keyword, l_suppkey AS s, sum(l_quantity::BIGINT)::BIGINT AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: consecutive k of purchases per user."""
    from pyspark.sql import Window

    e = _events(spark, sf_dir).where("event_type = 'purchase'")
    nxt = F.lead("k").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(F.col("k").alias("src"), nxt.alias("dst")).where("dst is not null and src <> dst").distinct()
    return e.select(F.col("k").alias("node")).distinct(), edges


SQL_GRAPH = SQL_EVENTS + """,
edges AS (SELECT DISTINCT src, dst FROM (SELECT k AS src, lead(k) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM ev WHERE event_type = 'purchase') WHERE dst IS NOT NULL AND src <> dst),
nodes AS (SELECT DISTINCT k AS node FROM ev WHERE event_type = 'purchase')"""


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' first lines as keywords."""
    return texts(spark, sf_dir, "documents").select("doc_id", F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("keyword"))


SQL_LINES = "fl AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS keyword FROM documents)"
