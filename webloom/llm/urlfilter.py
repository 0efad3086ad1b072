"""URL allow and block rules in a trie over reversed host labels and then path segments.

The longest matching rule decides; of equally long ones a block entry, then the last in order of host and path.  The trie is broadcast
while the rules take at most ``max_broadcast_bytes``; a longer list
goes through an equi-join on the host suffixes of each URL instead, with the same verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import tidy

MAX_BROADCAST_BYTES = 64 << 20
#: In the join, URLs with a common suffix (as ``com``) are dealt to so many tasks.
SALTS = 32
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or without ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _AZ, _az), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or without ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Host labels from the right, then whole path segments, then a prefix of the last segment."""

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        """``rules``: (host, path, verdict).  Of equal rules with different verdicts the block entry wins."""
        self.root: dict = {}
        for host, path, verdict in sorted(rules, key=lambda r: r[2] != "allow"):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("." + label, {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            node.setdefault("tails", {})[tail] = (len(host + path), verdict != "allow", host + path, verdict)

    def find(self, host: str, path: str) -> tuple[int, bool, str, str] | None:
        """The longest rule that fits: its length, whether it blocks, the rule and its verdict."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            at, k = node, 0
            while at is not None and k < len(segments):
                for tail, rule in at.get("tails", {}).items():
                    if segments[k].startswith(tail) and (best is None or rule > best):
                        best = rule
                at, k = at.get("/" + segments[k]), k + 1
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule (null if none fits) and verdict (``default`` if none).

    ``rules``: (host, path, verdict) tuples, or a DataFrame of these columns.  Longest: in characters of host and path together; ties as
    said above.  URLs of any length are read whole; extra columns are not read.
    Null urls and those without ``://`` have an empty host and path and fit no rule.  Repeated rows give a row each; an empty
    table or rule list gives an empty result or the default throughout.
    """
    at = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    if isinstance(rules, DataFrame):
        total = rules.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
        if total > max_broadcast_bytes:
            return judge_by_join(at, rules, default)
        rules = [tuple(r) for r in rules.where("host is not null and path is not null").select("host", "path", "verdict").collect()]
    elif sum(len(h.encode()) + len(p.encode()) + 64 for h, p, _ in rules) > max_broadcast_bytes:
        return judge_by_join(at, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            found = [find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            cols = [*b.columns, pa.array([x and x[2] for x in found], pa.string()), pa.array([x[3] if x else default for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "verdict"])

    return at.mapInArrow(tidy(run), "page_id bigint, host string, path string, rule string, verdict string")


def judge_by_join(at: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by a join of host suffixes with the rules' hosts; for rule lists too long to broadcast.

    Each pair of host and path is judged once, so no row needs a number.  Suffixes that many URLs share are salted.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = rules.where("host is not null and path is not null").select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    urls = at.select("host", "path").distinct().withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    fits = urls.withColumn("rule_host", F.explode(suffixes)).join(own, ["rule_host", "salt"]).where("startswith(path, rule_path)")
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), (F.col("rule_verdict") != "allow"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    return at.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
