"""Exact set-similarity join, greedy leader clustering without a sequential scan, and phrase functions."""

from __future__ import annotations

import bisect
import hashlib
import math
import tempfile
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from webloom.functions.text import STOPWORDS, stems
from webloom.functions.words import stems_of, tokens as tokens_of

#: Edges that one task scans (16 MB), and the buckets of tokens whose numbers go to the tasks as a table (512 KB).
LOCAL_EDGES, MAX_TOKENS = 1_000_000, 1 << 16
#: Parts of a set beyond those that may differ, shared values asked for by parts that may differ, and the threshold from which sets are compared by parts.
SLACK, SHARED, LEAST_PARTS = 1.15, 0.1, 0.6
#: Fixed value: bits in which simhashes of documents worth comparing differ at most.
SIMHASH_DISTANCE = 28


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; a local session without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="webloom-checkpoint-"))
    return df.checkpoint(eager=True)


def _packed(words: list[str]) -> bytes:
    return zlib.compress("\0".join(words).encode("utf-8", "surrogatepass"), 1)


def _unpacked(n: int, packed: bytes) -> list[bytes]:
    return zlib.decompress(packed).split(b"\0") if n else []


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    return _mixed(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)))


def packed_sets(docs: DataFrame, min_tokens: int = 50) -> DataFrame:
    """(doc_id, class, row, n, words) of documents of at least ``min_tokens`` raw tokens, materialised.

    ``words``: the sorted stems, compressed; ``n`` their number; ``class``: the least doc_id with the same; ``row``: a number of its own.
    """

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            at, n, key, packed = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if len(raw := tokens_of(text)) >= min_tokens:
                    words = sorted(set(stems_of(raw)))
                    at.append(i), n.append(len(words)), packed.append(_packed(words)), key.append(hashlib.md5(packed[-1]).digest())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int32()), pa.array(key, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "n", "key", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = checkpointed(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n int, key binary, words binary"))
    classes = own.groupBy("key").agg(F.min("doc_id").alias("class"))
    return checkpointed(own.join(classes, "key").select("doc_id", "class", F.monotonically_increasing_id().alias("row"), "n", "words"))


def _weights(sets: DataFrame) -> np.ndarray:
    """How rare tokens are, by bucket of their hashes: a whole number for each of at most MAX_TOKENS buckets, so that sums are exact."""
    size = max(1, MAX_TOKENS)

    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros(size, np.int64)
        for b in batches:
            for n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total += np.bincount((_hashes(_unpacked(n, packed)) % np.uint64(size)).astype(np.int64), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    many = np.ones(size, np.int64)
    for r in sets.select("n", "words").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():  # at most MAX_TOKENS
        many[r.k] = r.n
    return np.maximum(1, np.floor(16 * np.log2(2 * many.max() / many))).astype(np.int64)


def _first(n: int, bounds: list[int], threshold: float) -> list[tuple[int, int, int, int]]:
    """For each scheme that a set of ``n`` tokens takes part in: its number, its parts, how many of their values are listed, and how
    many must be shared (negative if the set is too small for the scheme to be that of its size)."""
    share, most = (1 - threshold) / (1 + threshold), int(n / threshold + 1e-9)
    own, out = bisect.bisect(bounds, n) - 1, []
    for q in range(own, bisect.bisect(bounds, most)):
        top = bounds[q + 1] - 1
        differ = int(share * (n + min(top, most)) + 1e-9)
        least = max(1, int(SHARED * share * 2 * top))
        out.append((q, int(SLACK * share * 2 * top + 1e-9) + least, differ + least, least if q == own else -least))
    return out


def _listed(sets: DataFrame, threshold: float) -> DataFrame:
    """(k, row, least): the values under which sets are looked for, and how many of them similar sets share, negative as in ``_first``.

    Sets of similarity t differ in at most (1 - t) / (1 + t) of the sum of their sizes, D tokens.  Tokens are dealt into more than D parts
    by their hashes, so similar sets agree in all but D whole parts, and share k of the first D + k in any order of the parts' values;
    rare values come first.  A value is a set of several tokens, so that few other sets have it.  The number of parts must be the same
    for both: there is a scheme for each range of the larger size, and a set takes part in those of its own and larger partners' ranges.
    For thresholds under LEAST_PARTS, parts would hold less than two tokens, and values are single tokens.
    """
    weights = sets.sparkSession.sparkContext.broadcast(_weights(sets))
    bounds = [1]
    while bounds[-1] < 1 << 31:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))

    def values(n: int, packed: bytes) -> list[tuple[np.ndarray, int]]:
        if not n:
            return [(np.zeros(1, np.uint64), 1)]
        h = _hashes(_unpacked(n, packed))
        rare = weights.value[(h % np.uint64(len(weights.value))).astype(np.int64)]
        if threshold < LEAST_PARTS:
            return [(h[np.lexsort((h, -rare))][: n - math.ceil(n * threshold - 1e-9) + 1], 1)]
        out = []
        for q, parts, first, least in _first(n, bounds, threshold):
            part = (_mixed(h + np.uint64(q)) % np.uint64(parts)).astype(np.int64)
            rank = np.bincount(part, rare, parts).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.diff(part[order], prepend=-1))
            whole = np.zeros(parts, np.uint64)
            whole[part[order][at]] = np.add.reduceat(h[order], at)
            best = np.lexsort((whole, np.arange(parts), -rank))[:first]
            out.append((_mixed(whole[best] + _mixed(best.astype(np.uint64) + np.uint64(q << 32))), least))
        return out

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows, keys, least = [], [], []
            for row, n, packed in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                for own, shared in values(n, packed):
                    keys.append(own), rows.append(np.full(len(own), row)), least.append(np.full(len(own), shared, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rows)), pa.array(np.concatenate(least))], ["k", "row", "least"])

    return sets.select("row", "n", "words").mapInArrow(run, "k bigint, row bigint, least int")


def _verified(pairs: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs(x, y) of rows of ``ids(row, doc_id, n, words)`` at least as similar as ``threshold``."""
    side = lambda x: ids.select(F.col("row").alias(x), F.struct("doc_id", "n", "words").alias(f"s{x}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select(F.col("sx.n"), F.col("sx.words"), F.col("sy.n").alias("m"), F.col("sy.words").alias("other"), F.least("sx.doc_id", "sy.doc_id").alias("a"), F.greatest("sx.doc_id", "sy.doc_id").alias("b"))
    kind = ids.schema["doc_id"].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            at, sims = [], []
            for i, (n, x, m, y) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                shared = len(set(_unpacked(n, x)).intersection(_unpacked(m, y)))
                if (s := shared / (n + m - shared) if n + m else 1.0) >= threshold:
                    at.append(i), sims.append(s)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(4).take(at), b.column(5).take(at), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return both.where("a < b").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def _similar(sets: DataFrame, threshold: float) -> DataFrame:
    """``similar_pairs`` of materialised ``sets(row, doc_id, n, words)``."""
    listed = _listed(sets, threshold)
    side = lambda x: listed.select("k", F.col("row").alias(x), F.col("least").alias(f"l{x}"))
    # the larger set is in the scheme of its size, so there is one scheme for a pair
    met = side("x").join(side("y"), "k").where("x < y and (lx > 0 or ly > 0)").groupBy("x", "y").agg(F.count("*").alias("shared"), F.max(F.abs("lx")).alias("least"))
    return _verified(met.where("shared >= least").select("x", "y"), sets, threshold)


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for a < b of ``sets(doc_id, tokens)`` with Jaccard >= threshold > 0, exact.

    Empty sets are equal to each other and similar to nothing else.
    """

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            words = [sorted(set(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, words), pa.int32()), pa.array(map(_packed, words), pa.binary())], ["doc_id", "n", "words"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    packed = sets.select("doc_id", "tokens").where("tokens is not null").mapInArrow(run, f"doc_id {kind}, n int, words binary")
    return _similar(checkpointed(packed.withColumn("row", F.monotonically_increasing_id())), threshold)


def class_pairs(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The representatives of ``packed_sets``, and their similar pairs; copies need no pairs among themselves."""
    reps = sets.where("doc_id = class")
    return reps, _similar(reps, threshold)


def hamming_distance(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def simhash_pairs(docs: DataFrame, threshold: float, max_distance: int = SIMHASH_DISTANCE) -> DataFrame:
    """``similar_pairs`` of ``docs(doc_id, text)`` of which the simhashes differ in at most ``max_distance`` bits: the cheaper, not exact
    mode for many documents."""
    own = docs.select("doc_id", stems(F.col("text")).alias("w"))
    hashes = checkpointed(own.select("doc_id", simhash("w").alias("h")))
    pairs = similar_pairs(own.select("doc_id", F.array_distinct("w").alias("tokens")), threshold)
    side = lambda x: hashes.select(F.col("doc_id").alias(x), F.col("h").alias(f"h{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(hamming_distance(F.col("ha"), F.col("hb")) <= max_distance).select("a", "b", "similarity")


def _scan(edges: DataFrame) -> DataFrame:
    """(node, leader) of the nodes of at most LOCAL_EDGES edges, by the sequential scan in one task.  Nodes may be structs."""
    plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x

    def run(batches):  # noqa: ANN001, ANN202
        earlier: dict = {}
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for x, y in zip(map(plain, b.column(0).to_pylist()), map(plain, b.column(1).to_pylist()), strict=True):
                earlier.setdefault(x, set())
                earlier.setdefault(y, set()).add(x)
        lead: dict = {}
        for node in sorted(earlier):
            lead[node] = min((x for x in earlier[node] if lead[x] == x), default=node)
        if lead:
            whole = lambda xs: [dict(zip([f.name for f in kind], x, strict=True)) for x in xs] if pa.types.is_struct(kind) else list(xs)
            yield pa.RecordBatch.from_arrays([pa.array(whole(lead), kind), pa.array(whole(lead.values()), kind)], ["node", "leader"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, leader {kind}")


def leaders(nodes: DataFrame, edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Greedy leader clustering: ``(node, leader)`` for ``nodes(node)`` and ``edges(a, b)`` in which an earlier ``a`` may claim ``b``.

    The sequential scan (each unclaimed node becomes a leader and claims its later neighbours) gives the lexicographically first
    independent set.  Up to ``local_edges`` edges one task scans them.  More are worked off in rounds: nodes without an undecided earlier
    neighbour lead, their neighbours are claimed.  Both give the same.
    """
    live, lead = checkpointed(edges.select("a", "b").distinct()), None
    if live.count() <= local_edges:
        own = _scan(live)
        alone = nodes.select("node").distinct().join(live.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti")
        return own.unionByName(alone.select("node", F.col("node").alias("leader")))
    open_nodes = checkpointed(nodes.select("node").distinct())
    all_edges = live
    while not open_nodes.isEmpty():
        now = checkpointed(open_nodes.join(live.select(F.col("b").alias("node")).distinct(), "node", "left_anti"))
        lead = now if lead is None else checkpointed(lead.unionByName(now))
        claimed = live.join(now.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct()
        open_nodes = checkpointed(open_nodes.join(now, "node", "left_anti").join(claimed, "node", "left_anti"))
        left = open_nodes.withColumnRenamed("node", "a"), open_nodes.withColumnRenamed("node", "b")
        live = checkpointed(live.join(left[0], "a", "left_semi").join(left[1], "b", "left_semi"))
    if lead is None:
        return nodes.select("node", F.col("node").alias("leader"))
    by = all_edges.join(lead.withColumnRenamed("node", "a"), "a").join(lead.withColumnRenamed("node", "b"), "b", "left_anti").groupBy("b").agg(F.min("a").alias("leader"))
    return lead.select("node", F.col("node").alias("leader")).unionByName(by.select(F.col("b").alias("node"), "leader"))


def near_dup_clusters(docs: DataFrame, threshold: float = 0.85, min_tokens: int = 50) -> DataFrame:
    """(doc_id, leader, size, similarity) of clusters of two or more, in order of doc_id; similarity: the highest with the leader."""
    sets = packed_sets(docs, min_tokens)
    reps, pairs = class_pairs(sets, threshold)
    pairs = checkpointed(pairs)
    led = leaders(reps.select(F.col("doc_id").alias("node")), pairs.select("a", "b"))
    sims = led.join(pairs, (F.col("leader") == F.col("a")) & (F.col("node") == F.col("b")), "left").select(F.col("node").alias("class"), "leader", F.coalesce("similarity", F.lit(1.0)).alias("similarity"))
    members = sets.select("doc_id", "class").join(sims, "class")
    own = members.groupBy("leader").agg(F.count("*").alias("size"), F.max(F.when(F.col("doc_id") != F.col("leader"), F.col("similarity"))).alias("similarity")).where("size >= 2")
    return members.select("doc_id", "leader").join(own, "leader").select("doc_id", "leader", "size", (F.floor(F.col("similarity") * 1000 + 0.5) / 1000).alias("similarity"))


def _match(hay: list[str], needle: list[str], start: int) -> int:
    """End of a match of the needle at ``start`` with at most two stopwords between its words, or -1."""
    i, k, gaps = start, 0, 0
    while i < len(hay) and k < len(needle):
        if hay[i] == needle[k]:
            k += 1
        elif hay[i] in _STOP and gaps < 2:
            gaps += 1
        else:
            return -1
        i += 1
    return i if k == len(needle) else -1


_STOP = frozenset(STOPWORDS)


def phrase_count(hay: list[str], needle: list[str]) -> int:
    if not needle:
        return 0
    n = i = 0
    while i < len(hay):
        end = _match(hay, needle, i)
        n, i = (n + 1, end) if end > 0 else (n, i + 1)
    return n


@F.pandas_udf(LongType())
def count_phrase(hay: pd.Series, needle: pd.Series) -> pd.Series:
    """How often a phrase (stemmed content tokens) occurs in a text (stemmed tokens), without overlaps."""
    return pd.Series([phrase_count(list(h), list(n)) for h, n in zip(hay, needle, strict=True)])


def hash64(text: str) -> int:
    """FNV-1a of 64 bits over UTF-16 code units."""
    raw, h = text.encode("utf-16-le", "surrogatepass"), 0xCBF29CE484222325
    for k in range(0, len(raw), 2):
        h = (h ^ (raw[k] | raw[k + 1] << 8)) * 0x100000001B3 & (1 << 64) - 1
    return h


@F.pandas_udf(LongType())
def simhash(words: pd.Series) -> pd.Series:
    """64-bit simhash of stemmed tokens: 3-word shingles, or tokens of shorter texts; signed."""
    out, seen = [], {}
    for w in words:
        w = list(w)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else w
        if not shingles:
            out.append(0)
            continue
        h = np.array([seen.setdefault(s, hash64(s)) if len(seen) < 100_000 else hash64(s) for s in shingles], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
        v = sum(1 << k for k in range(64) if 2 * int(bits[k]) > len(shingles))
        out.append(v - (1 << 64) if v >> 63 else v)
    return pd.Series(out, dtype="int64")
