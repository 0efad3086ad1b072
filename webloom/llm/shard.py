"""Sharding by the minimax contiguous partition of ordered atomic groups.

Rows with the same group key (equal texts) form an atomic group.  Groups are ordered by a 64-bit hash of the text.  The
smallest capacity for which a greedy left-to-right filling needs no more shards than asked for is found by binary search, and
the shards are cut there.

The groups themselves never reach the driver.  It holds sums of bytes over ranges of the ordered keys, at most ``MAX_RANGES``
at first, and runs the search on them twice: once as if a range could be cut anywhere (a lower bound) and once as if ranges
were atomic (an upper bound).  Only ranges in which a cut can fall between those bounds are split further, with one small
aggregation over the keys per round, until each of them is a single group: then the capacity is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed

MAX_RANGES = 1 << 14
_LOW, _SPAN = -(1 << 63), 1 << 64


@dataclass
class Ranges:
    """Non-empty key ranges in order: first and last key seen, total size; ``single`` where both keys are one."""

    first: np.ndarray
    last: np.ndarray
    size: np.ndarray

    @property
    def single(self) -> np.ndarray:
        return self.first == self.last

    def spliced(self, where: np.ndarray, finer: Ranges) -> Ranges:
        parts = [np.concatenate([getattr(self, k)[~where], getattr(finer, k)]) for k in ("first", "last", "size")]
        order = np.argsort(parts[0], kind="stable")
        return Ranges(*(p[order] for p in parts))


def _reach(ends: np.ndarray, start: int, capacity: int) -> int:
    """The last range boundary that a shard from boundary ``start`` can reach within ``capacity``."""
    return int(np.searchsorted(ends, (ends[start]) + capacity, side="right")) - 1


def greedy_cuts(ends: np.ndarray, lo: int, hi: int, capacity: int, most: int) -> list[int] | None:
    """Cut boundaries of a greedy filling of the ranges lo..hi-1 with at most ``most`` shards, or None."""
    cuts, at = [], lo
    while at < hi:
        to = min(_reach(ends, at, capacity), hi)
        if to == at or len(cuts) == most:
            return None
        cuts.append(to)
        at = to
    return cuts


def _pieces(alone: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Runs of ranges between those that stand alone."""
    edges = [-1, *np.flatnonzero(alone).tolist(), n]
    return [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if a + 1 < b]


def _fits(ends: np.ndarray, pieces: list[tuple[int, int]], capacity: int, shards: int) -> bool:
    left = shards
    for lo, hi in pieces:
        cuts = greedy_cuts(ends, lo, hi, capacity, left)
        if cuts is None:
            return False
        left -= len(cuts)
    return True


def _fluid(ends: np.ndarray, pieces: list[tuple[int, int]], capacity: int, shards: int) -> bool:
    """Whether the shards could be enough if ranges of several groups could be cut anywhere."""
    return capacity > 0 and sum(-(-int(ends[hi] - ends[lo]) // capacity) for lo, hi in pieces) <= shards


def _least(test, lo: int, hi: int) -> int:
    """The least value in lo..hi that passes the monotone test; hi is known to pass."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if test(mid) else (mid + 1, hi)
    return lo


def _open(ends: np.ndarray, pieces: list[tuple[int, int]], low: int, high: int) -> np.ndarray:
    """Ranges in which a cut may fall for some capacity from ``low`` to ``high``."""
    out = np.zeros(len(ends) - 1, bool)
    for lo, hi in pieces:
        near = far = lo
        while near < hi:
            near_to = _reach(ends, near, low)
            far_to = min(int(np.searchsorted(ends, ends[far] + high, side="left")), hi)
            out[near_to : min(max(far_to, near_to + 1), hi)] = True
            if near_to >= hi:
                break
            near, far = max(near_to, near + 1), max(far_to, far)
    return out


def _collect(keyed: DataFrame, bucket: Column) -> Ranges:
    rows = keyed.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("s")).toPandas()
    rows = rows.sort_values("a")
    return Ranges(rows.a.to_numpy(np.int64), rows.b.to_numpy(np.int64), rows.s.to_numpy(np.int64))


def _finer(keyed: DataFrame, ranges: Ranges, split: np.ndarray, width: int) -> Ranges:
    """The ranges of ``split`` divided into up to ``width`` equal parts of their key spans."""
    spans = list(zip(ranges.first[split].tolist(), ranges.last[split].tolist(), strict=True))
    lows = np.array([a for a, _ in spans], np.int64)
    highs = np.array([b for _, b in spans], np.int64)
    cast = keyed.sparkSession.sparkContext.broadcast((lows, highs, width))

    @F.pandas_udf("bigint")
    def part(key: pd.Series) -> pd.Series:
        lo, hi, w = cast.value
        k = key.to_numpy(np.int64)
        at = np.clip(np.searchsorted(lo, k, side="right") - 1, 0, None)
        inside = (k >= lo[at]) & (k <= hi[at])
        step = ((hi[at].astype(np.uint64) - lo[at].astype(np.uint64)) // np.uint64(w)) + np.uint64(1)
        sub = ((k.astype(np.uint64) - lo[at].astype(np.uint64)) // step).astype(np.int64)
        return pd.Series(np.where(inside, at * w + sub, -1)).where(inside)

    return _collect(keyed, part("key"))


def minimax(keyed: DataFrame, shards: int, max_ranges: int = MAX_RANGES) -> tuple[int, list[int]]:
    """Capacity and, for each shard but the last, the last key that it holds, for ``keyed(key bigint, size bigint)``.

    A group that alone is larger than the others' capacity gets a shard of its own, and the rest is balanced anew over the
    remaining shards, so one hot group does not leave other shards empty.  No rows: capacity 0 and no cuts.
    """
    bits = (max_ranges - 1).bit_length()
    ranges = _collect(keyed, F.shiftright("key", 64 - bits))
    if not len(ranges.size):
        return 0, []
    alone: set[int] = set()  # keys of groups with a shard of their own
    while True:
        n = len(ranges.size)
        ends = np.concatenate([[0], np.cumsum(ranges.size)])
        apart = np.isin(ranges.first, list(alone)) & ranges.single
        pieces, left = _pieces(apart, n), shards - len(alone)
        if not pieces:
            return int(ranges.size.max()), _bounds(ranges, ends, pieces, apart, 0, left)
        most_single = int(ranges.size[ranges.single & ~apart].max(initial=0))
        inside = int(sum(ends[hi] - ends[lo] for lo, hi in pieces))
        floor = max(most_single, -(-inside // left), 1)
        high = _least(lambda c: _fits(ends, pieces, c, left), floor, inside) if left >= len(pieces) else inside
        low = _least(lambda c: _fluid(ends, pieces, c, left), floor, high)
        doubt = _open(ends, pieces, low, high) & ~ranges.single
        if doubt.any():
            width = max(4, min(4096, 8 * max_ranges // int(doubt.sum())))
            ranges = ranges.spliced(doubt, _finer(keyed, ranges, doubt, width))
            continue
        big = ranges.single & ~apart & (ranges.size == high)
        if big.any() and high > -(-inside // left) and n > len(alone) + 1:
            lone = int(ranges.first[np.flatnonzero(big)[0]])
            after = _pieces(apart | (ranges.first == lone), n)
            if left - 1 >= len(after):
                alone.add(lone)
                continue
        return high, _bounds(ranges, ends, pieces, apart, high, left)


def _bounds(ranges: Ranges, ends: np.ndarray, pieces: list[tuple[int, int]], apart: np.ndarray, capacity: int, left: int) -> list[int]:
    """Last keys of the shards.  Spare shards go to the runs with the largest shards; within a run the cuts move towards equal
    sizes as far as the capacity allows."""
    need = [len(greedy_cuts(ends, lo, hi, capacity, left) or [0]) for lo, hi in pieces]
    spare = left - sum(need)
    for _ in range(max(0, spare)):
        room = [(ends[hi] - ends[lo]) / k if k < hi - lo else -1 for (lo, hi), k in zip(pieces, need, strict=True)]
        if not room or max(room) < 0:
            break
        need[int(np.argmax(room))] += 1
    last: list[int] = [int(k) for k in ranges.last[np.flatnonzero(apart)]]
    for (lo, hi), k in zip(pieces, need, strict=True):
        at = lo
        back = [hi]  # the earliest boundary from which the remaining shards still hold the rest
        for _ in range(k - 1):
            back.append(max(int(np.searchsorted(ends, ends[back[-1]] - capacity, side="left")), lo))
        for j in range(k - 1, 0, -1):
            most = min(_reach(ends, at, capacity), hi - j)
            least = max(back[j], at + 1)
            goal = ends[at] + (ends[hi] - ends[at]) / (j + 1)
            to = int(np.searchsorted(ends, goal))
            to = to - 1 if to > 0 and goal - ends[to - 1] < ends[min(to, len(ends) - 1)] - goal else to
            at = min(max(to, least), most)
            last.append(int(ranges.last[at - 1]))
        last.append(int(ranges.last[hi - 1]))
    return sorted(last)[:-1]


def shard_documents(docs: DataFrame, shards: int = 24, cells: int = 1024) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its shard: doc_id, size, text_crc32, group_key, shard, slot.

    Size: UTF-8 bytes of the text plus 8 (null: 8).  ``text_crc32``: of the UTF-8 bytes (null: as of the empty text, 0).  Equal
    texts, and so repeated rows, share a shard.  ``slot`` numbers the rows of a shard from 0 without gaps.  Fewer groups than
    shards leave the last shards empty.  An empty table gives an empty result.

    Slots are counted in two steps, so that no task holds a whole shard: rows are dealt into cells by a hash, offsets are sums of the
    cells' counts (shards x cells at most), and rows are numbered within a cell, by doc_id and text.  Nothing depends on the partitioning.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = checkpointed(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(cells)).cast("int").alias("cell"),
    ))
    capacity, lasts = minimax(rows.select("key", "size"), shards)
    shard = F.lit(0)
    for k in lasts:
        shard = shard + (F.col("key") > F.lit(k)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", F.col("key").alias("group_key"), "cell", shard.cast("int").alias("shard"))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("offset"))
    at = Window.partitionBy("shard", "cell").orderBy("doc_id", "group_key")
    return placed.withColumn("rank", F.row_number().over(at) - 1).join(F.broadcast(offsets), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", "group_key", "shard", (F.col("offset") + F.col("rank")).cast("bigint").alias("slot"), F.lit(capacity).cast("bigint").alias("capacity")
    )
