"""Line deduplication by pairwise alignment.

A text is cut into lines, and lines into sentences, so a passage that stands inside a longer line is found too.  Documents that overlap
are found through the lines that they share: each line of a document is matched with the earliest
document that holds it, which gives one partner per line and never all pairs of a group.  A partner counts if at least one of
the shared lines is rare among the partners on offer, the rarest first.  The two documents are then aligned as patience diff
does: lines that occur once in both are anchors, the longest increasing chain of anchors is kept, and the lines between two
anchors are matched in order.  Lines that their partner doesn't align are tried with the other earlier documents that have them,
until one aligns them or none is left.  Aligned blocks of enough words go from the later document.

What is shuffled is a few numbers per line.  A group is the lines of one document that occur elsewhere, so it is bounded by that
document, however many others share them.  The lines are joined with those that several documents have after the latter are written,
so that a join of a line that very many documents have can be split.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import any_columns, checkpointed, fresh_name, quoted, tidy, utf8

#: A block goes if it has so many words in whole lines, or so many in all; a document goes with it if less than a share of its words is left.
MIN_BLOCK_WORDS, MIN_PART_WORDS, LEAST_LEFT = 4, 25, 0.2
#: Sentences of fewer words are taken together with the next one of the line.
SENTENCE_WORDS = 4
#: Partners of a line left over in the first round of trying others; keys that are broadcast.
FIRST_TRIED, MAX_BROADCAST_KEYS = 16, 1_000_000
#: Texts that are cut into units at once, about.
SLICE_BYTES = 1 << 20
_OWNER = "struct(doc_id is null as none, doc_id, th)"


def _marked(raw: bytes) -> bytes:
    """``raw`` with the space after a sentence end turned into a zero byte."""
    return raw.replace(b". ", b".\0").replace(b"! ", b"!\0").replace(b"? ", b"?\0")


def _units(line: bytes) -> tuple[list[bytes], list[int]]:
    """The units of a marked line, which joined by zero bytes give the line, and their words, counted by spaces; of a line without words: none."""
    if b"\0" not in line:
        return ([line], [line.count(b" ") + 1]) if line and not line.isspace() else ([], [])
    out, counts, held, words = [], [], None, 0
    for part in line.split(b"\0"):
        held = part if held is None else held + b"\0" + part
        words += part.count(b" ") + 1
        if words >= SENTENCE_WORDS:
            out.append(held)
            counts.append(words)
            held, words = None, 0
    if held is not None:  # the end of the line
        if held.strip(b" \t\x0b\x0c\r\0"):
            out.append(held)
            counts.append(words)
        elif out:
            out[-1] += b"\0" + held
    return out, counts


def _keyed_units(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of texts, keys and spots of the units of all ``texts``, cut as ``_units`` cuts; the key tells the first, second, ... of equal
    units of a text apart, and the spot has number, words, whether the unit occurs once, and whether it is the first (2) and the last (1) of its line.

    The parts between line and sentence ends are found in all texts at once.  One of SENTENCE_WORDS words always ends a unit, so only shorter ones are looked at one by one.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    texts = [t or b"" for t in texts]
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8).copy()
    marks = joined == 0
    marks[1:] |= (joined[1:] == 32) & ((joined[:-1] == 46) | (joined[:-1] == 33) | (joined[:-1] == 63))
    joined[marks] = 0
    ends = np.flatnonzero(marks | (joined == 10))
    spaces = np.flatnonzero(joined == 32)
    raw = joined.tobytes()
    starts = np.append(0, ends[:-1] + 1)
    words = np.diff(np.searchsorted(spaces, ends), prepend=0) + 1
    last = joined[ends] == 10
    first = np.append(True, last[:-1])
    whole = first & last
    closed, lost, units_end = np.ones(len(ends), bool), np.zeros(len(ends), bool), ends.copy()
    at, held, before = 0, 0, -2
    short = np.flatnonzero((words < SENTENCE_WORDS) & ~whole)
    for k, n, starts_line, ends_line in zip(short.tolist(), words[short].tolist(), first[short].tolist(), last[short].tolist(), strict=True):
        if k != before + 1 or starts_line or not held:
            at, held = k, 0
        held, before = held + n, k
        if held >= SENTENCE_WORDS:
            held = 0
        elif not ends_line:
            closed[k] = False
        elif not raw[starts[at] : ends[k]].strip(b" \t\x0b\x0c\r\0"):  # goes with the unit before, if the line has one
            lost[k] = True
            if not first[at]:
                units_end[at - 1] = ends[k]
    close = np.flatnonzero(closed)
    units_start = starts[np.append(0, close[:-1] + 1)]
    total = np.cumsum(words)[close]
    words = np.diff(total, prepend=0)
    found = [raw[x:y].strip() for x, y in zip(units_start.tolist(), units_end[close].tolist(), strict=True)]
    keep = ~lost[close] & ~(whole[close] & (np.fromiter(map(len, found), np.int64, len(found)) == 0))
    found = list(compress(found, keep.tolist()))
    close, words = close[keep], words[keep]
    row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), ends[close], "right")
    line = np.cumsum(first)[close]
    opens = np.diff(line, prepend=-1) != 0
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    keys, once = [digest(x, 1) for x in found], [1] * len(found)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if len(set(keys[lo:hi])) < hi - lo:
            at_of: dict[int, list[int]] = defaultdict(list)
            for k, key in enumerate(keys[lo:hi], lo):
                at_of[key].append(k)
            for same in at_of.values():
                if len(same) > 1:
                    for n, k in enumerate(same, 1):
                        keys[k], once[k] = digest(found[k], n), 0
    spot = np.arange(len(found)) - bounds[row] << 32 | np.minimum(words, (1 << 29) - 1) << 3 | np.array(once, np.int64) << 2 | opens << 1 | np.append(opens[1:], True)[: len(found)]
    return row, np.array(keys, np.uint64).view(np.int64), spot


def _spot(spot: str) -> dict[str, Column]:
    at = F.col(spot)
    return {"pos": F.shiftright(at, 32).cast("int"), "words": F.shiftright(at.bitwiseAND(F.lit((1 << 32) - 1)), 3).cast("int"), "once": at.bitwiseAND(F.lit(4)) != 0, "ends": at.bitwiseAND(F.lit(3)).cast("int")}


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, key, spot): one row per unit."""
    names = (("doc_id", pa.int64()), ("th", pa.int64()), ("key", pa.int64()), ("spot", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            slices = np.cumsum([len(t or b"") for t in texts]) // SLICE_BYTES
            bounds = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(texts)]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi > lo:
                    row, keys, spots = _keyed_units(texts[lo:hi])
                    at = pa.array(row + lo)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(keys), pa.array(spots)], [n for n, _ in names])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        tidy(run), "doc_id bigint, th bigint, key bigint, spot bigint"
    )


def _chain(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of points, sorted by the first number, whose second numbers increase (patience sorting)."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(points)
    for k, (_, y) in enumerate(points):
        n = bisect_left(tails, y)
        back[k] = at[n - 1] if n else -1
        if n == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[n], at[n] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(points[k])
        k = back[k]
    return out[::-1]


def patience(points: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Aligned (position, partner's position) of matched lines; ``points`` also say whether a line occurs once in both."""
    points = sorted(points)
    anchors = _chain([(x, y) for x, y, once in points if once])
    rest = [(x, y) for x, y, once in points if not once]
    if not rest:
        return anchors
    out, k = [], 0
    for (x0, y0), (x1, y1) in zip([(-1, -1), *anchors], [*anchors, (1 << 62, 1 << 62)], strict=True):
        gap = []
        while k < len(rest) and rest[k][0] < x1:
            if rest[k][0] > x0 and y0 < rest[k][1] < y1:
                gap.append(rest[k])
            k += 1
        out += _chain(gap)
        if x1 < 1 << 62:
            out.append((x1, y1))
    return out


def aligned(lines: list[tuple[int, int, int, int, bool, int]]) -> dict[int, int]:
    """Positions that a partner aligns, with that partner.

    ``lines``: (position among the document's lines with words, partner, partner's position, documents with the line, once in
    both, words).  Partners come in order of their rarest shared line; a line goes with the first partner that aligns it.
    """
    by: dict[int, list] = defaultdict(list)
    for pos, partner, other, df, once, words in lines:
        by[partner].append((pos, other, df, once, words))
    taken: dict[int, int] = {}
    for partner in sorted(by, key=lambda p: (min(x[2] for x in by[p]), -sum(x[4] for x in by[p]), p)):
        for pos, _ in patience([(x[0], x[1], x[3]) for x in by[partner]]):
            taken.setdefault(pos, partner)
    return taken


def _runs(positions: Iterable[int], size_at: dict[int, tuple[int, int]], least: tuple[int, int]) -> list[int]:
    """The positions in runs of enough words: all of a run of ``least[1]`` words, else its whole lines next to each other that have
    ``least[0]``.  ``size_at``: words of a position, and whether it is the first (2) and the last (1) of its line."""
    kept: list[int] = []
    run: list[int] = []
    for pos in [*sorted(positions), None]:
        if run and (pos is None or pos != run[-1] + 1):
            if sum(size_at[x][0] for x in run) >= least[1]:
                kept += run
            else:
                first = next((k for k, x in enumerate(run) if size_at[x][1] & 2), len(run))
                last = next((k for k in range(len(run) - 1, -1, -1) if size_at[run[k]][1] & 1), -1)
                lines = run[first : last + 1]
                if sum(size_at[x][0] for x in lines) >= least[0]:
                    kept += lines
            run = []
        run.append(pos)
    return kept


def _values(column: pa.Array) -> list:
    """``to_pylist``, faster for numbers without nulls."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


_OPEN = "array<struct<pos:int,key:bigint,words:int,once:boolean,ends:int,df:bigint,taken:boolean,partner_id:bigint>>"
_OPEN_TYPE = pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.int64()), ("words", pa.int32()), ("once", pa.bool_()), ("ends", pa.int32()), ("df", pa.int64()), ("taken", pa.bool_()), ("partner_id", pa.int64())]))


def deletions(docs: DataFrame, least: tuple[int, int] = (MIN_BLOCK_WORDS, MIN_PART_WORDS)) -> DataFrame:
    """(doc_id, th, gone array<int>, partners array<bigint>): the units to delete, by number from 0, of documents that lose any.

    The order of documents is that of doc_id, then of the text's hash; null ids come last.
    """
    lines = line_table(docs).withColumn("owner", F.expr(_OWNER))
    firsts = lines.groupBy("key").agg(F.min(F.struct("owner", "spot")).alias("first"), F.count("*").alias("n"), F.max("owner").alias("last")).where("first.owner <> last")
    firsts = checkpointed(firsts.select("key", F.col("first.owner").alias("hub"), F.col("first.spot").alias("hub_spot"), F.col("n").alias("df")))
    shared = lines.join(firsts, "key").where("owner <> hub")
    shared = checkpointed(shared.select("doc_id", "th", "key", "spot", F.xxhash64("hub").alias("partner"), F.col("hub.doc_id").alias("partner_id"), "hub_spot", "df"))
    mine, theirs = _spot("spot"), _spot("hub_spot")
    matched = shared.select("doc_id", "th", mine["pos"].alias("pos"), "partner", "partner_id", theirs["pos"].alias("hub_pos"), "df", (mine["once"] & theirs["once"]).alias("both"), mine["words"].alias("words"), "key", mine["once"].alias("once"), mine["ends"].alias("ends"))
    schema = (("doc_id", pa.int64()), ("th", pa.int64()), ("gone", pa.list_(pa.int32())), ("partners", pa.list_(pa.int64())), ("open", _OPEN_TYPE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def decide(key: tuple, rows: list[tuple]) -> tuple | None:
            ids = {r[3]: r[4] for r in rows}
            at = {r[2]: r for r in rows}
            size_at = {p: (r[8], r[11]) for p, r in at.items()}
            most = _runs(at, size_at, least)
            if not most:
                return None
            taken = aligned([(r[2], r[3], r[5], r[6], r[7], r[8]) for r in at.values()])
            if any(p not in taken for p in most):  # else no further line can go
                rest = [{"pos": p, "key": r[9], "words": r[8], "once": r[10], "ends": r[11], "df": r[6], "taken": p in taken, "partner_id": ids.get(taken.get(p))} for p, r in sorted(at.items())]
                return (*key, None, None, rest)
            gone = _runs(taken, size_at, least)
            return (*key, gone, sorted({ids[taken[p]] for p in gone if ids[taken[p]] is not None}), None) if gone else None

        key, rows = None, []
        for b in batches:
            done = []
            for r in zip(*map(_values, b.columns), strict=True):
                if r[:2] != key:
                    if rows and (x := decide(key, rows)):
                        done.append(x)
                    key, rows = r[:2], []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, (_, t) in enumerate(schema)], [n for n, _ in schema])
        if rows and (x := decide(key, rows)):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(x, schema, strict=True)], [n for n, _ in schema])

    first = checkpointed(matched.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "pos").mapInArrow(tidy(run), f"doc_id bigint, th bigint, gone array<int>, partners array<bigint>, open {_OPEN}"))
    settled = first.where("open is null").drop("open")
    mine = first.where("open is not null").select("doc_id", "th", F.explode("open").alias("x")).select("doc_id", "th", "x.*")
    if mine.isEmpty():
        return settled
    held = shared.select("key", F.expr(_OWNER).alias("partner"), "spot").unionByName(firsts.select("key", F.col("hub").alias("partner"), F.col("hub_spot").alias("spot")))
    return settled.unionByName(_settle(held, checkpointed(mine.withColumn("owner", F.expr(_OWNER))), least))


def _keyed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows with one of the keys, by a broadcast of at most MAX_BROADCAST_KEYS keys or else a shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys, on, "left_semi")


def _settle(held: DataFrame, mine: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The deletions of documents with lines left over, ``mine`` being their lines that an earlier document has and ``held`` all lines that several have.

    A line left over goes if any earlier document that has it aligns it, with all the lines that the two share.  Those documents are
    tried in rounds, a few of each line first and
    eight times as many in the next, chosen by hash; only lines that are still left come to the next round, the last of which
    has all the others.  Of ``held`` only the lines of a round's partners are taken; no text is read again.
    """
    left = mine.where(~F.col("taken")).select("owner", "pos", "key", "df")
    holders = checkpointed(_keyed(held, left.select("key").distinct(), ["key"]).select("key", "partner").distinct())
    keys = checkpointed(mine.select("key").distinct())
    most, tried, found = left.agg(F.max("df").alias("n")).first().n, 0, None
    share = F.pmod(F.xxhash64("partner"), F.lit(1 << 31)) / F.lit(1 << 31) * F.col("df")
    while True:
        upto = tried * 8 or FIRST_TRIED
        pairs = checkpointed(left.join(holders, "key").where(F.col("partner") < F.col("owner")).where((share >= tried) & (share < upto)).select("owner", "partner").distinct())
        partners = pairs.select("partner").distinct()
        theirs = _keyed(_keyed(held, partners, ["partner"]), keys, ["key"]).dropDuplicates(["key", "partner"])
        theirs = theirs.select("key", "partner", _spot("spot")["pos"].alias("other"), _spot("spot")["once"].alias("other_once"))
        points = pairs.join(mine.select("owner", "key", "pos", "once"), "owner").join(theirs, ["key", "partner"])
        points = points.select("owner", "partner", "pos", "other", (F.col("once") & F.col("other_once")).alias("both"))
        new = checkpointed(points.groupBy("owner", "partner").applyInArrow(_align, points.select("owner", "partner", "pos").schema))
        found = new if found is None else found.unionByName(new)
        tried = upto
        if tried >= most:
            break
        left = checkpointed(left.join(new, ["owner", "pos"], "left_anti"))
        if left.isEmpty():
            break
    best = found.groupBy("owner", "pos").agg(F.min("partner").alias("p"))
    rows = mine.join(best, ["owner", "pos"], "left").where("taken or p is not null")
    rows = rows.select("doc_id", "th", "pos", "words", "ends", F.when(F.col("taken"), F.col("partner_id")).otherwise(F.col("p.doc_id")).alias("partner_id"))

    def decide(group: pa.Table) -> pa.Table:
        at = {r["pos"]: r for r in group.to_pylist()}
        gone = [at[p] for p in _runs(at, {p: (r["words"], r["ends"]) for p, r in at.items()}, least)]
        out = [{"doc_id": gone[0]["doc_id"], "th": gone[0]["th"], "gone": [r["pos"] for r in gone], "partners": sorted({r["partner_id"] for r in gone} - {None})}] if gone else []
        return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("gone", pa.list_(pa.int32())), ("partners", pa.list_(pa.int64()))]))

    return rows.groupBy("doc_id", "th").applyInArrow(decide, "doc_id bigint, th bigint, gone array<int>, partners array<bigint>")


def _align(group: pa.Table) -> pa.Table:
    """The positions of one document that one partner aligns."""
    taken = {x for x, _ in patience(list(zip(*(group.column(c).to_pylist() for c in ("pos", "other", "both")), strict=True)))}
    return group.filter(pa.array([x in taken for x in group.column("pos").to_pylist()], pa.bool_())).select(["owner", "partner", "pos"])


def _without(text: str, gone: list[int]) -> str:
    """``text`` without units; a line that loses all of its units goes."""
    raw, drop, n, at, out = utf8(text), set(gone), 0, 0, []
    for line in _marked(raw).split(b"\n"):
        left, start, (units, _) = [], at, _units(line)
        for k, unit in enumerate(units, n):
            if k not in drop:
                left.append(raw[start : start + len(unit)])
            start += len(unit) + 1
        n += len(units)
        if len(left) == len(units):
            out.append(raw[at : at + len(line)])
        elif left:
            out.append(b" ".join(left).rstrip())
        at += len(line) + 1
    return b"\n".join(out).decode("utf-8", "surrogatepass")


def _cut(texts: pa.Array, gone: pa.Array) -> tuple[pa.Array, list[str], list[str], pa.Array]:
    """Which texts lose units, these before and after, and all texts after."""
    at = np.flatnonzero(pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))
    mask = np.zeros(len(texts), bool)
    mask[at] = True
    old = texts.take(pa.array(at)).to_pylist()
    new = [_without(t, g) for t, g in zip(old, gone.take(pa.array(at)).to_pylist(), strict=True)]
    mask = pa.array(mask)
    return mask, old, new, pc.replace_with_mask(texts, mask, pa.array(new, texts.type)) if new else texts


def _joined(docs: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The columns of ``docs`` and then two: units to delete and partners."""
    found = deletions(docs, least)
    new = {c: fresh_name(docs, c) for c in found.columns}
    gone = found.withColumnsRenamed(new)
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone[new["doc_id"]]) & (F.xxhash64(docs["text"]) == gone[new["th"]])
    return docs.join(gone, same, "left").select(*quoted(docs), new["gone"], new["partners"])


@any_columns
def clean(docs: DataFrame, least: tuple[int, int] = (MIN_BLOCK_WORDS, MIN_PART_WORDS), least_left: float = LEAST_LEFT) -> DataFrame:
    """``docs``, all columns, without the blocks that an earlier document has (``n_chars`` set anew where there is one).

    Documents that are left with less than ``least_left`` of their words go; what loses nothing stays, null and empty texts too.
    Repeated rows are one document and get the same text each; equal texts under different ids are different documents.  Documents
    with a null id come after all others.  An empty table stays empty.
    """
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(names, b.columns, strict=False))
            mask, old, new, left = _cut(cols["text"], b.column(len(names)))
            if new:
                cols["text"] = left
                if "n_chars" in cols:
                    cols["n_chars"] = pc.replace_with_mask(cols["n_chars"], mask, pa.array([len(t) for t in new], cols["n_chars"].type))
                kept = pa.array([len(n.split()) >= max(1, least_left * len(t.split())) for t, n in zip(old, new, strict=True)])
                yield pa.RecordBatch.from_arrays(list(cols.values()), names).filter(pc.replace_with_mask(pc.invert(mask), mask, kept))
            else:
                yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return _joined(docs, least).drop(fresh_name(docs, "partners")).mapInArrow(tidy(run), docs.schema)


def report(docs: DataFrame, least: tuple[int, int] = (MIN_BLOCK_WORDS, MIN_PART_WORDS)) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_deleted, deleted (numbers of units, which are lines or sentences of them, from 0),
    partners (earlier doc_ids), n_chars_left and clean_text.  Null text: no lines, and null clean_text.  Other cases: as ``clean``."""
    kinds = ("doc_id", "n_lines", "n_deleted", "deleted", "partners", "n_chars_left", "clean_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, gone, partners = b.columns
            left = _cut(texts, gone)[3]
            numbers = pc.add(pc.count_substring(texts, "\n"), 1), pc.list_value_length(gone), pc.utf8_length(left)
            n_lines, n_deleted, n_chars = (pc.fill_null(x, 0).cast(pa.int64()) for x in numbers)
            yield pa.RecordBatch.from_arrays([ids, n_lines, n_deleted, gone, partners, n_chars, left], kinds)

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("gone", "array<int>"), ("partners", "array<bigint>"))]
    return _joined(own, least).select("doc_id", "text", *lists).mapInArrow(
        tidy(run), "doc_id bigint, n_lines bigint, n_deleted bigint, deleted array<int>, partners array<bigint>, n_chars_left bigint, clean_text string"
    )
