"""Tables of crawls, pages, findings, keywords, ranks, projects and usage as Parquet under one folder.

A table is a folder of versions, of which the newest marked one holds.  Appends add files to it; changes write a new version and then
its marker, an empty file made in one step, so a reader sees the old version or the new one.  All paths go through Hadoop's file
systems.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.operators import audit, ranks as R
from webloom.operators.similarity import checkpointed, simhash
from webloom.functions.text import stems
from webloom.schemas import ISSUE, KEYWORD, PAGE, RANK

SCHEMAS = {
    "crawls": "crawl_id bigint, site string, started_at timestamp, stopped_reason string, pages bigint, health_score double",
    "pages": f"crawl_id bigint, {PAGE}, indexable boolean, internal_links_in bigint, simhash bigint", "issues": f"crawl_id bigint, {ISSUE}", "keywords": f"project string, {KEYWORD}, tracked boolean",
    "ranks": RANK, "projects": "name string, site string, competitors array<string>, created_at timestamp", "usage": "provider string, tool string, units bigint, at timestamp",
    "cache": "namespace string, key string, body string, expires_at timestamp",
}
PARTITIONS = {"pages": ["crawl_id"], "issues": ["crawl_id"], "keywords": ["project"], "ranks": ["project"]}


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, table: str) -> str:
        """The folder of the version that holds."""
        fs, p = self._fs(f"{self.root}/{table}")
        marked = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        versions = sorted(int(n.removeprefix("_version.")) for n in marked if n.startswith("_version."))
        return f"{self.root}/{table}/v{versions[-1] if versions else 0}"

    def read(self, table: str) -> DataFrame:
        """The table, empty if nothing was written yet; partition filters are pushed down."""
        path = self.path(table)
        fs, p = self._fs(path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(path)

    def append(self, table: str, rows: DataFrame) -> None:
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
        rows.select(*names).write.mode("append").partitionBy(*PARTITIONS.get(table, [])).parquet(self.path(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write a new version and mark it; a failure before the mark leaves the old one.  Versions before the one replaced go."""
        old = int(self.path(table).rsplit("/v", 1)[-1])
        new = max(old + 1, time.time_ns())
        rows.write.partitionBy(*PARTITIONS.get(table, [])).parquet(f"{self.root}/{table}/v{new}")
        fs, mark = self._fs(f"{self.root}/{table}/_version.{new}")
        fs.create(mark, False).close()
        for f in fs.listStatus(self._fs(f"{self.root}/{table}")[1]):
            version = f.getPath().getName().removeprefix("_version.").removeprefix("v")
            if version.isdigit() and int(version) < old:
                fs.delete(f.getPath(), True)

    def save_crawl(self, site: str, crawl: audit.Crawl, issues: DataFrame, stopped_reason: str = "complete") -> int:
        """Store a crawl with its pages and findings; returns its id."""
        crawl_id = time.time_ns()
        p = audit.prepared(crawl.pages).withColumns({
            "crawl_id": F.lit(crawl_id), "indexable": audit.is_indexable(), "internal_links_in": F.col("inbound").cast("bigint"),
            "simhash": F.when(F.col("word_count") >= 50, simhash(stems(F.col("text")))),
        })
        self.append("pages", p)
        issues = checkpointed(issues)
        self.append("issues", issues.withColumn("crawl_id", F.lit(crawl_id)))
        head = audit.health_score(issues, crawl.pages).select("pages", "health_score").withColumns({"crawl_id": F.lit(crawl_id), "site": F.lit(site), "started_at": F.current_timestamp(), "stopped_reason": F.lit(stopped_reason)})
        self.append("crawls", head)
        return crawl_id

    def _crawls_of(self, site: str) -> DataFrame:
        bare = F.regexp_replace(F.lower("site"), r"^(https?://)?(www\.)?|/+$", "")
        return self.read("crawls").where(bare == site.lower().removeprefix("https://").removeprefix("http://").removeprefix("www.").rstrip("/"))

    def latest_crawl(self, site: str) -> int | None:
        """Id of the newest crawl of a site, with or without www."""
        return self._crawls_of(site).agg(F.max_by("crawl_id", "started_at").alias("id")).first().id

    def crawl_history(self, site: str, limit: int = 20) -> DataFrame:
        return self._crawls_of(site).orderBy(F.desc("started_at"), F.desc("crawl_id")).limit(limit)

    def page_summaries(self, crawl_id: int) -> DataFrame:
        return self.read("pages").where(F.col("crawl_id") == crawl_id).select("url", "status", "title", "meta_description", "indexable", "word_count", "depth", "internal_links_in", "simhash").orderBy("depth", "url")

    def save_keywords(self, project: str, rows: DataFrame) -> None:
        """Upsert by keyword: a null never erases a known value."""
        table = self.read("keywords")
        old = table.where(F.col("project") == project)
        cols = ["keyword", "volume", "difficulty", "cpc", "intent", "source"]
        merged = R.upsert_keywords(old.select(*cols), rows.select(*cols))
        rest = old.select("keyword", "words", "opportunity", "cluster", "position", "tracked")
        out = merged.join(rest, "keyword", "left").withColumns({"project": F.lit(project), "words": F.coalesce("words", F.size(F.split(F.trim("keyword"), r"\s+"))), "tracked": F.coalesce("tracked", F.lit(False))})
        self.replace("keywords", checkpointed(table.where(F.col("project") != project).unionByName(out.select(*table.columns))))

    def set_tracked(self, project: str, keywords: list[str], tracked: bool = True) -> None:
        t = self.read("keywords")
        hit = (F.col("project") == project) & F.col("keyword").isin(*[k.lower() for k in keywords])
        self.replace("keywords", checkpointed(t.withColumn("tracked", F.when(hit, F.lit(tracked)).otherwise(F.col("tracked")))))

    def save_ranks(self, project: str, rows: DataFrame, source: str = "serp") -> None:
        """Append snapshots; keywords in lower case, the device defaults to desktop and the time to now."""
        have = set(rows.columns)
        default = {"location": F.lit(""), "device": F.lit("desktop"), "checked_at": F.current_timestamp(), "source": F.lit(source)}
        out = rows.withColumns({"project": F.lit(project), "keyword": F.lower("keyword")})
        for f in self.spark.createDataFrame([], RANK).schema:
            if f.name not in have and f.name not in out.columns:
                out = out.withColumn(f.name, default.get(f.name, F.lit(None)).cast(f.dataType))
        self.append("ranks", out)

    def set_project(self, name: str, site: str, competitors: list[str] | None = None) -> None:
        row = self.spark.createDataFrame([(name, site, competitors or [], None)], SCHEMAS["projects"]).withColumn("created_at", F.current_timestamp())
        self.replace("projects", checkpointed(self.read("projects").where(F.col("name") != name).unionByName(row)))

    def record_usage(self, provider: str, tool: str, units: int) -> None:
        self.append("usage", self.spark.createDataFrame([(provider, tool, units)], "provider string, tool string, units bigint").withColumn("at", F.current_timestamp()))

    def clear_cache(self, namespace: str | None = None) -> None:
        """Drop a namespace, or what has expired."""
        t = self.read("cache")
        self.replace("cache", checkpointed(t.where(F.col("expires_at") > F.current_timestamp()) if namespace is None else t.where(F.col("namespace") != namespace)))
