"""Near duplicates by bottom-k sketches of word shingles.

1. One hash function gives each document's set of shingle hashes; equal sets form one class, and the k smallest hashes are its
   sketch.
2. Inverted lists of retained values give candidates.  If two sets are as similar as asked for, their sketches share at least
   ``least_shared`` values but for a chance below 1e-7, so it is enough to list a class under its rarest values (k minus that
   many, plus one).  Within a list each class is paired with one pivot, not with all others.
3. The sketch of the union estimates the similarity and filters the pairs; the exact Jaccard coefficient of the whole sets
   verifies them, from the texts.
4. Verified pairs give components.  In lists whose classes still belong to several of them all pairs across components are
   tested: as pairs in small lists, and in large ones in bounded blocks that give out only the links that join components.  So no
   link is lost to the choice of pivots, and no group's pairs are ever emitted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import any_columns, checkpointed, fresh_name, quoted, shingle_hashes, space_words, tidy, utf8
from .graph import components

K, WIDTH = 48, 5
#: At most this many values count as hot; they are the only ones that are broadcast.
MAX_HOT = 100_000
LIST_SPLIT, SMALL, BLOCK, BLOCK_SHINGLES = 100_000, 16, 2048, 1_500_000


@cache
def shared_of_k(percent: int, k: int = K) -> int:
    """Of the k values of a union's sketch, the number that two sets of the similarity share but for a binomial chance below 1e-7: 26
    of 48 at 0.85 and 22 at 0.80."""
    p, tail, m = percent / 100, 0.0, 0
    while m < k and (tail := tail + math.comb(k, m) * p**m * (1 - p) ** (k - m)) < 1e-7:
        m += 1
    return m


def least_shared(size: int, percent: int = 85, k: int = K) -> int:
    """Values that the sketches of two similar sets share."""
    return max(1, (min(size, k) * shared_of_k(percent, k)) // k)


def sign(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, digest of the set and sketch, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, sketches = [], [], []
            for t in b.column(2):
                h = shingle_hashes(space_words(t.as_py(), lower=True), WIDTH)
                counts.append(len(h))
                digests.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                sketches.append(h[:k].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sketches])]).astype(np.int32)
            values = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "th", "n_shingles", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(
        tidy(run), "doc_id bigint, th bigint, n_shingles bigint, digest binary, sketch array<bigint>"
    )


def _hot(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values in many sketches and how many, sorted by value; at most MAX_HOT of them whatever the table's size."""
    values = classes.select(F.explode("sketch").alias("v"))
    total = classes.agg(F.sum(F.size("sketch")).alias("n")).first().n or 0
    rows = values.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > max(64, total // MAX_HOT)).toPandas().sort_values("v")
    return rows.v.to_numpy(np.int64), rows.n.to_numpy(np.int64)


def _lists(classes: DataFrame, hot: tuple[np.ndarray, np.ndarray], percent: int, k: int) -> DataFrame:
    """(v, part, rank, id): the rarest values of each sketch; rank 0 for the most central classes.  A list of more than
    LIST_SPLIT classes is dealt in parts numbered from 0; other lists have part -1."""
    shared = classes.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for b in batches:
            out_v, out_part, out_rank, out_id = [], [], [], []
            for ident, size, sketch in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                v = np.array(sketch, np.int64)
                n = np.zeros(len(v), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
                    n = np.where(keys[at] == v, counts[at], 0)
                m = len(v) - least_shared(size, percent, k) + 1
                level = np.frexp(n.astype(float))[1]
                order = np.lexsort((v, level))[:m]
                parts = -(-n[order] // LIST_SPLIT)
                out_v.append(v[order])
                out_part.append(np.where(parts > 1, ident % np.maximum(1, parts), -1))
                out_rank.append(np.full(m, k - int((n > 0).sum())))
                out_id.append(np.full(m, ident, np.int64))
            if out_v:
                cols = [np.concatenate(x) for x in (out_v, out_part, out_rank, out_id)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int32, np.int64), strict=True)], ["v", "part", "rank", "id"])

    return classes.select("id", "n_shingles", "sketch").mapInArrow(tidy(run), "v bigint, part int, rank int, id bigint")


def _shared_lists(lists: DataFrame) -> DataFrame:
    """(v, rank, id, hub): the lists of two classes or more, each class with its list's most central one.

    One shuffle; sorted lists are streamed, and only the row before is remembered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "rank", "id", "hub"]
        held = [np.empty(0, np.int64)] * 4  # the last row while it is not known whether it is alone
        key, hub_before = None, 0
        for batch in batches:
            v, part, rank, ident = (np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held))
            if not len(v):
                continue
            start = np.concatenate([[len(held[0]) > 0 or key != (v[0], part[0])], (v[1:] != v[:-1]) | (part[1:] != part[:-1])])
            at = np.maximum.accumulate(np.where(start, np.arange(len(v)), -1))
            hub = np.where(at >= 0, ident[np.maximum(at, 0)], hub_before)
            alone = start & np.concatenate([start[1:], [False]]) & (part < 0)
            open_end = start[-1] and part[-1] < 0
            alone[-1] = open_end
            held = [x[-1:] if open_end else x[:0] for x in (v, part, rank, ident)]
            key, hub_before = (v[-1], part[-1]), hub[-1]
            cols = [x[~alone] for x in (v, rank, ident, hub)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].astype(np.int32)), pa.array(cols[2]), pa.array(cols[3])], names)

    dealt = lists.repartition("v", "part").sortWithinPartitions("v", "part", "rank", "id").select("v", "part", "rank", "id")
    return dealt.mapInArrow(tidy(run), "v bigint, rank int, id bigint, hub bigint")


def _first_pairs(lists: DataFrame) -> DataFrame:
    return lists.where("hub <> id").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()


def _labelled(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, id, comp, size): the lists of three classes or more with each class's component, without lists within one component."""
    members = lists.join(roots.withColumnRenamed("node", "id"), "id", "left").select("v", "id", F.coalesce("root", "id").alias("comp"))
    mixed = members.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x <> y and size > 2").select("v", "size")
    return members.join(mixed, "v")


def _small_list_pairs(members: DataFrame) -> DataFrame:
    """Every pair across components of the lists of at most SMALL classes: at most SMALL / 2 for each of their rows."""
    small = members.where(F.col("size") <= SMALL)
    one = small.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "comp"))).alias("m"))  # at most SMALL elements
    pairs = one.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.filter("m", lambda y: (y["id"] > F.col("x.id")) & (y["comp"] != F.col("x.comp")))).alias("y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _shares(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets, by products of slices of the incidence matrix.  Shingles of one
    set only take no part."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = counts[column] > 1
    owner, column = owner[keep], (np.cumsum(counts > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = max(64, min(4096, (8 << 20) // max(1, len(sets))))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        out += part[left] @ part[right].T
    return out


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> list[int]:
    """Positions of the pairs that join labels not yet joined; the others add nothing to the components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for k, (x, y) in enumerate(zip(label[a].tolist(), label[b].tolist(), strict=True)):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append(k)
    return out


def _block_links(percent: int):  # noqa: ANN202
    def links(group: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        own, comp, ident, n = (group.column(x).to_numpy() for x in ("own", "comp", "id", "n"))
        v, i, j = (group.column(x)[0].as_py() for x in ("v", "i", "j"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        # a pair that shares several lists is tested in that of the least value
        open_pairs = comp[left][:, None] != comp[right][None, :]
        open_pairs &= (100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :]))
        lists: dict[int, list[int]] = {}
        for k, values in enumerate(group.column("values").to_pylist()):
            for x in values:
                if x < v:
                    lists.setdefault(x, []).append(k)
        for rows in lists.values():
            if len(rows) > 1:
                has = np.zeros(len(own), bool)
                has[rows] = True
                open_pairs &= ~(has[left][:, None] & has[right][None, :])
        out_a, out_b = np.empty(0, np.int64), np.empty(0, np.int64)
        if open_pairs.any():
            used = np.zeros(len(own), bool)
            used[left[open_pairs.any(1)]] = used[right[open_pairs.any(0)]] = True
            packed = group.column("z")
            none = np.empty(0, np.uint64)
            sets = [shingle_hashes(space_words(unpack(packed[k].as_py()).decode("utf-8", "surrogatepass"), lower=True), WIDTH) if used[k] else none for k in range(len(own))]
            inter = _shares(sets, left, right).astype(float)
            size = np.array([len(x) for x in sets], float)
            # 100 * intersection >= percent * union, with the union as the sizes less the intersection
            inter *= 100 + percent
            inter -= percent * (size[left][:, None] + size[right][None, :])
            x, y = np.nonzero(open_pairs & (inter >= 0))
            a, b = left[x], right[y]
            kept = _forest(a, b, comp)
            out_a, out_b = np.minimum(ident[a[kept]], ident[b[kept]]), np.maximum(ident[a[kept]], ident[b[kept]])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return links


def _large_list_links(members: DataFrame, classes: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """Links across components in the lists of more than SMALL classes: all their pairs are tested on the whole sets, in pairs of
    blocks of bounded rows and shingles, and only the links that join components are given out."""
    large = members.where(F.col("size") > SMALL).join(classes.select("id", F.col("n_shingles").alias("n")), "id")
    totals = large.groupBy("v").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    values = large.groupBy("id").agg(F.collect_set("v").alias("values"))  # at most K
    rows = large.join(totals, "v").join(values, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "comp", "id", "n", "values")
    return dealt.join(packed, "id").groupBy("v", "i", "j").applyInArrow(_block_links(percent), "a bigint, b bigint").distinct()


def estimated(pairs: DataFrame, classes: DataFrame, least: float, k: int = K) -> DataFrame:
    """The pairs whose union sketch does not rule out the similarity."""
    one = classes.select("id", "sketch")
    both = pairs.join(one.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(one.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size(F.array_union("sa", "sb"))
    # the union's sketch holds the k smallest values of the two; all of the shared ones are in it but for those above its end
    end = F.element_at(F.array_sort(F.array_union("sa", "sb")), F.least(union, F.lit(k)))
    within = F.size(F.filter(F.array_intersect("sa", "sb"), lambda x: x <= end))
    return both.where((shared > 0) & (within >= F.lit(least) * F.least(union, F.lit(k)))).select("a", "b")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, th and the compressed text; what the verification shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(utf8(t.as_py())) for t in b.column(2)], pa.binary())], ["doc_id", "th", "z"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, th bigint, z binary")


def _packed(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, z): the compressed texts of the classes in ``nodes(id)``; one pass over the documents."""
    own = nodes.join(classes.select("id", "rep"), "id").select("id", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))
    text = _texts(docs)
    match = text["doc_id"].eqNullSafe(own["doc_id"]) & (text["th"] == own["th"])
    # where documents repeat so do the rows; one of each is enough
    return checkpointed(text.join(own, match).select("id", "z").dropDuplicates(["id"]))


def verified(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on the whole sets, computed from the texts ``packed(id, z)``."""
    both = pairs.join(packed.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b").join(packed.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").select("a", "b", "za", "zb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        whole = lambda z: shingle_hashes(space_words(unpack(z).decode("utf-8", "surrogatepass"), lower=True), WIDTH)
        last, first = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, za, zb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, first = a, whole(za.as_py())
                second = whole(zb.as_py())
                inter = len(np.intersect1d(first, second, assume_unique=True))
                keep.append(100 * inter >= percent * (len(first) + len(second) - inter))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return both.mapInArrow(tidy(run), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = K) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, th, n_shingles, component_id and kept.

    Linked: 100 * intersection >= percent * union of the sets of 5-word shingles (``percent`` >= 80).  ``component_id`` is the
    least doc_id reachable, the document's own included; ``kept`` says that they are the same.  Null or empty texts and those
    without words have no shingles, link with nothing and are kept.  Texts of fewer than 5 words have one shingle.  Repeated
    rows share a class; a null doc_id is kept only if its component has no other id.  An empty table gives an empty result.
    """
    signed = checkpointed(sign(docs, k))
    some = signed.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"))
    classes = checkpointed(some.withColumn("id", F.monotonically_increasing_id()))
    hot = _hot(classes)
    lists = checkpointed(_shared_lists(_lists(classes, hot, percent, k)))
    floor = shared_of_k(percent, k) / k - 1e-9
    tested = checkpointed(_first_pairs(lists))
    likely = checkpointed(estimated(tested, classes, floor, k))
    shared = lists.groupBy("v").agg(F.count("*").alias("n")).where("n > 2")
    nodes = likely.select(F.explode(F.array("a", "b")).alias("id")).unionByName(lists.join(shared, "v", "left_semi").select("id")).distinct()
    packed = _packed(docs, classes, nodes)
    roots = components(verified(likely, packed, percent))
    members = checkpointed(_labelled(lists, roots))
    if not members.isEmpty():
        more = checkpointed(estimated(_small_list_pairs(members).join(tested, ["a", "b"], "left_anti"), classes, floor, k))
        found = verified(more, packed, percent).unionByName(_large_list_links(members, classes, packed, percent))
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found))
    return _membership(signed, classes, roots)


def _membership(signed: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    comps = classes.select("digest", "id", "least_id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("root", "id"))
    least = comps.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = comps.join(least, "comp").select("digest", "component_id")
    rows = signed.select("doc_id", "th", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "th", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


@any_columns
def drop_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group: the rows that ``near_duplicates`` keeps, with all their columns, whatever their names.

    Of repeated rows of a kept document one stays; documents without words all stay, and so do null texts.  An empty table
    stays empty.
    """
    found = near_duplicates(docs, percent)
    ident, th = fresh_name(docs, "ident"), fresh_name(docs, "th")
    own = docs.withColumns({ident: F.col("doc_id").cast("bigint"), th: F.xxhash64("text")})
    same = lambda other: own[ident].eqNullSafe(other["doc_id"]) & (own[th] == other["th"])
    gone = found.where(~F.col("kept")).select("doc_id", "th").distinct()
    again = found.where("kept and n_shingles > 0").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "th")
    rest = own.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        once = own.join(again, same(again), "left_semi").dropDuplicates([ident, th])
        rest = rest.join(again, same(again), "left_anti").unionByName(once)
    return rest.select(*quoted(docs))
