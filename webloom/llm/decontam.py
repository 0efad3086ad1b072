"""Benchmark decontamination with a generalised suffix automaton over the words of the benchmark items.

The automaton is built once from the items, broadcast, and fed each document word by word.  Its state gives, at each word, the
longest suffix read so far that occurs in an item; where that is at least ``window`` words (or a whole shorter item) the words
are hit.  Items are taken in blocks of at most ``max_block_words`` words, one automaton each, so what is broadcast at a time does
not grow with the benchmark (a word takes 0.9 KB).  A document passes the blocks one after the other without a shuffle; between
two blocks the documents are checkpointed, so that workers hold one automaton only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import alnum_words, any_columns, checkpointed, fresh_name, quoted, tidy, utf8

WINDOW = 8
MAX_BLOCK_WORDS = 200_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Automaton:
    """Generalised suffix automaton of word sequences; states are list indexes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, seq in ids:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self._label(ids)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state for the suffixes of ``q`` that reach it from ``p`` in one step: ``q`` itself or a copy of it."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if (known := self.next[last].get(w)) is not None:
            return self._split(last, known, w)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p != -1:
            self.link[state] = self._split(p, self.next[p][w], w)
        return state

    def _label(self, ids: list[tuple[str, list[int]]]) -> None:
        """``full``: per state the items with a window there, by the state that holds the suffix of ``window`` words; ``short``:
        per state the (length, item) of whole shorter items that are suffixes; ``least``: the shortest length that hits."""
        n = len(self.next)
        order = sorted(range(n), key=self.length.__getitem__)
        self.anchor, own = [0] * n, {}
        for v in order[1:]:
            if self.length[v] >= self.window:
                up = self.link[v]
                self.anchor[v] = v if self.length[up] < self.window else self.anchor[up]
        full: dict[int, set[str]] = {}
        for name, seq in ids:
            v = size = 0  # a window of the item ends wherever ``window`` words or more have been read
            for w in seq:
                v, size = self.next[v][w], size + 1
                if size >= self.window:
                    full.setdefault(self.anchor[v], set()).add(name)
            if len(seq) < self.window:
                own.setdefault(v, []).append((len(seq), name))
        self.full = {k: tuple(sorted(x)) for k, x in full.items()}
        short: list[tuple[tuple[int, str], ...]] = [()] * n
        for v in order[1:]:
            short[v] = short[self.link[v]] + tuple(own.get(v, ()))
        self.short = {v: x for v, x in enumerate(short) if x}
        self.least = [min([self.window, *(m for m, _ in self.short.get(v, ()))]) for v in range(n)]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The (last word, matched length) of every hit, and the items hit."""
        step, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        hits: list[tuple[int, int]] = []
        anchors: set[int] = set()
        items: set[str] = set()
        v = size = 0
        for i, w in enumerate(map(self.vocab.get, words)):
            if w is None:
                v = size = 0
                continue
            to = step[v].get(w)
            if to is None:
                while v and to is None:
                    v = link[v]
                    to = step[v].get(w)
                if to is None:
                    v = size = 0
                    continue
                size = length[v]
            v = to
            size += 1
            if size >= least[v]:
                if size >= window:
                    anchors.add(self.anchor[v])
                    hits.append((i, size))
                fits = [x for x in self.short.get(v, ()) if x[0] <= size]
                if fits:
                    items.update(name for _, name in fits)
                    if size < window:
                        hits.append((i, max(m for m, _ in fits)))
        for a in anchors:
            items.update(self.full[a])
        return hits, items


def spans(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint (first, last) word spans that the hits cover, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((i - m + 1, i) for i, m in hits):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def blocks(items: DataFrame, window: int, max_words: int) -> Iterator[Automaton]:
    """Automata over blocks of items of at most ``max_words`` words (or one item), in order of item_id."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null").orderBy("i", "t")
    for row in rows.toLocalIterator():
        words = alnum_words(row.t)
        if not words:
            continue
        if block and size + len(words) > max_words:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((row.i, words))
        size += len(words)
    yield Automaton(block, window)


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_block_words: int = MAX_BLOCK_WORDS) -> DataFrame:
    """``docs`` with one more column, the last: a struct of spans (first and last word of each, flat), items (sorted) and n_words.

    It is called ``hits``, with underscores after it if ``docs`` has such a column.  Null or empty text: no words, no hits.  Items
    without words or id match nothing; items with the same id count once.  Repeated documents give a row each.  Empty
    tables give empty results or no hits.
    """
    spark, names, new = docs.sparkSession, docs.columns, fresh_name(docs, "hits")
    schema = ", ".join(f"{q} {f.dataType.simpleString()}" for q, f in zip(quoted(docs), docs.schema, strict=True))
    at, shared = names.index("text"), None
    for block in blocks(items, window, max_block_words):
        first = shared is None
        if not first:
            docs = checkpointed(docs)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            machine = shared.value
            for b in batches:
                before = [None] * b.num_rows if first else b.column(len(names)).to_pylist()
                rows = []
                for t, old in zip(b.column(at), before, strict=True):
                    words = alnum_words(t.as_py())
                    hits, found = machine.scan(words)
                    if old:
                        flat = old["spans"]
                        hits += [(flat[k + 1], flat[k + 1] - flat[k] + 1) for k in range(0, len(flat), 2)]
                        found |= set(old["items"])
                    rows.append({"spans": [x for s in spans(hits) for x in s] if hits else [], "items": sorted(found), "n_words": len(words)})
                kind = pa.struct([("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("n_words", pa.int64())])
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(rows, kind)], [*names, new])

        docs = docs.mapInArrow(tidy(run), f"{schema}, `{new}` struct<spans: array<int>, items: array<string>, n_words: bigint>")
    return docs


def report(docs: DataFrame, items: DataFrame, min_items: int = 2, **how) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_words, n_hit, n_items, the sorted items, and ``contaminated``.

    Extra columns are not read; all other cases are those of ``find_hits``.
    """
    d = find_hits(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), items, **how)
    n_hit = F.expr("aggregate(sequence(0, cast(size(hits.spans) / 2 as int)), 0L, (a, k) -> a + coalesce(get(hits.spans, 2 * k + 1) - get(hits.spans, 2 * k) + 1, 0))")
    n_items = F.size("hits.items").cast("bigint")
    return d.select("doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), n_items.alias("n_items"), F.col("hits.items").alias("items"), (n_items >= min_items).alias("contaminated"))


def cut(text: str, flat: list[int]) -> str:
    """``text`` without the words of the spans and what stands between them; one space is left between word characters."""
    raw, out, done = utf8(text), [], 0
    bounds = [m.span() for m in _WORD.finditer(raw)]
    for k in range(0, len(flat), 2):
        out.append(raw[done : bounds[flat[k]][0]])
        done = bounds[flat[k + 1]][1]
    out.append(raw[done:])
    return b" ".join(x.strip(b" ") for x in out if x.strip(b" ")).decode("utf-8", "surrogatepass")


@any_columns
def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, **how) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text`` (and ``n_chars`` set anew where there is one).

    A document goes whole when the spans cover more than ``max_coverage`` of its words.  Documents without hits, null and
    empty texts stay as they are; extra columns of any name and type too.  Other cases: as ``find_hits``.
    """
    names, schema, at = docs.columns, docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column(len(names)).to_pylist()
            if any(x["spans"] for x in found):
                texts, keep = b.column(at).to_pylist(), []
                for k, x in enumerate(found):
                    flat = x["spans"]
                    hit = sum(flat[1::2]) - sum(flat[::2]) + len(flat) // 2
                    keep.append(hit <= max_coverage * x["n_words"])
                    if flat and keep[-1]:
                        texts[k] = cut(texts[k], flat)
                cols = {n: b.column(i) for i, n in enumerate(names)}
                cols["text"] = pa.array(texts, pa.string())
                if "n_chars" in cols:
                    changed = [len(texts[k]) if x["spans"] else old for k, (x, old) in enumerate(zip(found, cols["n_chars"].to_pylist(), strict=True))]
                    cols["n_chars"] = pa.array(changed, cols["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names).filter(pa.array(keep, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(b.columns[: len(names)], names)

    return find_hits(docs, items, **how).mapInArrow(tidy(run), schema)
