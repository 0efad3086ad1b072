"""Sampled SentencePiece segmentations: Gumbel top-k without replacement by a perturbed A-star search over the lattice.

The pieces of a vocabulary file span a lattice over a text: an edge for each piece that occurs, and byte pieces for characters
that have none.  A piece of rank r weighs 1 / (r + offset) ** power, so segmentations have probabilities; masses of all paths
to the end are exact, by a backward pass.

A subset of paths has as its perturbed value a Gumbel variable at the logarithm of its mass, and the values of its parts follow
from it top down: one part inherits the value, the others get values below it.  The search keeps a queue of subsets by perturbed value.
The first is taken out; its winning path is drawn, which inherits the value and is the next sample; the subsets that branch
off that path go into the queue, at most as many as samples are still asked for, the best ones.  Samples come out in order of
their perturbed values and are distinct.  All draws are functions of the row's key, the sample and the position, so a row gives the
same samples in any partition.

Drawing is vectorised over many texts: the lattice falls apart at spaces and line ends, which no piece crosses, so each distinct
unit of a batch is built once.  Units are built in blocks and texts drawn in slices, so that what either needs on its way stays small.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Numbers, mix64, tidy

SPACE = "▁"
SAMPLES, POWER, OFFSET = 2, 1.5, 100.0
#: The public vocabulary file of the registered query; a parameter of the operator, never copied into the repository.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
#: Characters of texts that share their lattices, of units that are built at once, and of texts that are drawn at once; results don't depend on them.
CHUNK_CHARS, BLOCK_CHARS, SLICE_CHARS = 1_500_000, 100_000, 250_000
_U = np.uint64
#: Units: spaces with the word after them, or a line end, of any length.  No piece crosses these.
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: Numbers of draws apart from those along a path.
_TOP, _PICK, _BRANCH, _REST = (n << 60 for n in (1, 2, 3, 4))
#: Stands for a \u2581 of the text itself; valid UTF-8 has no such character.
LITERAL = "\ud800"


class Vocabulary:
    """Pieces, their log weights, the byte pieces and a trie of the pieces of a SentencePiece model."""

    def __init__(self, proto: bytes, power: float = POWER, offset: float = OFFSET) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(k) for k in range(n)]
        self.byte = {int(p[3:5], 16): k for k, p in enumerate(pieces) if model.is_byte(k)}
        normal = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        crossing = re.compile(f"[^{SPACE}]{SPACE}|\n")
        if over := [pieces[k] for k in normal if crossing.search(pieces[k])]:
            raise ValueError(f"{len(over)} pieces cross a space or a line end, {over[0]!r} first; the lattice has no edges for such")
        ids = {pieces[k]: k for k in normal}
        rank = np.full(n, n)
        rank[sorted(normal, key=model.get_score, reverse=True)] = np.arange(len(normal))
        self.log_weight = -power * np.log(rank + offset)
        texts = {k: p.replace(SPACE, " ").encode("utf-8") for p, k in ids.items()} | {k: bytes([b]) for b, k in self.byte.items()}
        self.texts = pa.array([texts.get(k, b"") for k in range(n)], pa.binary())
        steps: dict[int, int] = {}
        ends = [-1]
        for piece, k in ids.items():
            at = 0
            for c in piece:
                key = at << 21 | ord(c)
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                at = steps[key]
            ends[at] = k
        self.piece_at = np.array(ends, np.int64)
        # the steps in a hash table with open addressing, four slots a step and more
        self.bits = max(8, (4 * len(steps)).bit_length())
        self.slot_key, self.slot_to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        keys, to = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.slot_key[slot] < 0
            self.slot_key[slot[free]] = keys[free]  # of several steps for a slot the last stays
            done = self.slot_key[slot] == keys
            self.slot_to[slot[done]] = to[done]
            keys, to, slot = keys[~done], to[~done], (slot[~done] + 1) & (1 << self.bits) - 1
        self.runs: dict[int, int] = {}  # characters without a piece
        self.run_list: list[list[int]] = [[]]

        self.first_step = np.full(1 << 16, -1, np.int64)
        for key, at in steps.items():
            if key < 1 << 16:  # from the root
                self.first_step[key] = at

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(64 - self.bits)).astype(np.int64)

    def start(self, code: np.ndarray) -> np.ndarray:
        """The trie's states after a first character, or -1."""
        out = self.first_step[np.minimum(code, 0xFFFF)]
        rare = np.flatnonzero(code >= 0xFFFF)
        if len(rare):
            out[rare] = self.step(np.zeros(len(rare), np.int64), code[rare])
        return out

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's states after a character, or -1."""
        key = state << 21 | code
        slot = self._slot(key)
        there = self.slot_key[slot]
        out = np.where(there == key, self.slot_to[slot], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (1 << self.bits) - 1
            there = self.slot_key[slot[open_]]
            out[open_[there == key[open_]]] = self.slot_to[slot[open_[there == key[open_]]]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return out

    def run(self, code: int) -> int:
        """The byte pieces of a character: the piece if it is one, else the negative number of a run."""
        ids = [self.byte[b] for b in (SPACE if code == ord(LITERAL) else chr(code)).encode("utf-8", "surrogatepass")]
        if len(ids) == 1:
            return ids[0]
        if code not in self.runs:
            self.runs[code] = len(self.run_list)
            self.run_list.append(ids)
        return -self.runs[code]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of runs of pieces that end before ``ends``; the space that encoding puts in front of each is dropped.

        Taking all pieces from the table in one step lays their bytes out one after the other, so texts are spans of that buffer.
        """
        taken = self.texts.take(pa.array(ids, pa.int32()))
        _, at, raw = taken.buffers()
        bounds = np.frombuffer(at, np.int32, len(ids) + 1)[np.concatenate([[0], ends])]
        joined = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.tobytes()), raw])
        return pc.binary_replace_slice(joined, 0, 1, b"").cast(pa.string())


class Lattices:
    """The lattices of distinct units as one graph in arrays.

    A node is a character of a unit; its edges are neighbours in the arrays.  ``to`` is -1 at the end of a unit.  Units come joined, with their lengths.
    """

    def __init__(self, vocab: Vocabulary, units: str, sizes: np.ndarray) -> None:
        unit_end = np.cumsum(sizes)
        self.first = unit_end - sizes
        blocks = (_block(vocab, units[self.first[lo] : unit_end[hi - 1]], sizes[lo:hi], int(self.first[lo])) for lo, hi in _spans(unit_end, BLOCK_CHARS))
        degree, piece, to, prob = map(list, zip(*blocks, strict=True))
        self.degree = _joined(degree)
        self.starts = np.concatenate([[0], np.cumsum(self.degree)])
        kind = _kind(int(self.starts[-1]))
        self.starts = self.starts.astype(kind)
        self.piece, self.to, self.prob = _joined(piece), _joined(to), _joined(prob)
        self.node = np.repeat(np.arange(len(self.degree), dtype=kind), self.degree)


def _kind(n: int) -> type:
    """The type of numbers up to ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts in one array; their list is left empty."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _spans(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items that end at ``ends``, of at most ``most`` each or a single item."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def _block(vocab: Vocabulary, text: str, sizes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edges of each node of some units, and of the edges the piece, the node behind, where the first node is ``base``, and the probability."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    n = len(code)
    unit_end = np.cumsum(sizes)
    end = np.repeat(unit_end, sizes)
    live, state, depth, found = np.arange(n), np.zeros(n, np.int64), 0, []
    while len(live):
        state = vocab.step(state, code[live + depth]) if depth else vocab.start(code)
        ok = state >= 0
        live, state, depth = live[ok], state[ok], depth + 1
        piece = vocab.piece_at[state]
        hit = piece >= 0
        found.append((live[hit], depth, piece[hit]))
        more = live + depth < end[live]
        live, state = live[more], state[more]
    degree = np.zeros(n, np.int32)
    for src, _, _ in found:
        degree[src] += 1
    bare = np.flatnonzero(degree == 0)
    values, inverse = np.unique(code[bare], return_inverse=True)
    runs = np.array([vocab.run(c) for c in values.tolist()], np.int64)
    found.append((bare, 1, runs[inverse] if len(bare) else bare))
    degree[bare] = 1
    starts = np.concatenate([[0], np.cumsum(degree)])
    # the longest edges of a node come first: they mostly are the likeliest, so a draw ends soon
    total, free = int(starts[-1]), starts[:-1].copy()
    pieces, inner = np.empty(total, np.int32), np.empty(total, np.int64)
    for src, length, piece in found[::-1]:
        slot = free[src]
        free[src] += 1
        pieces[slot] = piece
        inner[slot] = src + length
    inner[inner == np.repeat(end, degree)] = n
    weight = np.where(pieces >= 0, vocab.log_weight[pieces], vocab.log_weight.min())
    mass = np.zeros(n + 1)  # logarithms of the masses to the end of the unit
    last_first = unit_end[np.argsort(-sizes, kind="stable")]
    reach = np.searchsorted(np.sort(-sizes), -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    for rest, units_there in enumerate(reach.tolist(), 1):
        own = last_first[:units_there] - rest
        width = degree[own]
        new = np.cumsum(width) - width
        e = np.repeat(starts[own] - new, width) + np.arange(int(width.sum()))
        x = weight[e] + mass[inner[e]]
        top = np.maximum.reduceat(x, new)
        mass[own] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, width)), new))
    prob = np.minimum(np.exp(weight + mass[inner] - np.repeat(mass[:n], degree)), 1.0)
    return degree, pieces, np.where(inner < n, inner + base, -1).astype(_kind(base + n)), prob


def _uniform(seed: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) as a function of a seed and a position."""
    x = mix64(seed + where.astype(_U) * _U(0x9E3779B97F4A7C15))
    return ((x >> _U(11)).astype(float) + 0.5) * (1.0 / (1 << 53))


def _paths(lat: Lattices, node: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A drawn path from each node to the end of its unit: edges in order of the input, and how many each has."""
    live, at, steps, found, k = np.arange(len(node)), node, np.zeros(len(node), np.int64), [], 0
    while len(live):
        edge, last = lat.starts[at], lat.starts[at + 1] - 1
        left = _uniform(seed[live], (place[live] << 26) + k) - lat.prob[edge]
        on = np.flatnonzero((left > 0) & (edge < last))
        while len(on):
            edge[on] += 1
            left[on] -= lat.prob[edge[on]]
            on = on[(left[on] > 0) & (edge[on] < last[on])]
        found.append((live, edge))
        k += 1
        steps[live] = k
        at = lat.to[edge]
        on = at >= 0
        live, at = live[on], at[on]
    start = np.cumsum(steps) - steps
    edges = np.empty(int(steps.sum()), lat.starts.dtype)
    for k, (who, edge) in enumerate(found):
        edges[start[who] + k] = edge
    return edges, steps


class _Search:
    """The queue and the samples of one text."""

    __slots__ = ("queue", "samples")

    def __init__(self) -> None:
        self.queue: list[tuple] = []
        self.samples: list[tuple[np.ndarray, float, float]] = []


def lattices(vocab: Vocabulary, texts: list[str]) -> tuple[Lattices, np.ndarray, np.ndarray]:
    """The lattices of the texts' distinct units, the first nodes of all units in order, and how many units each text has."""
    units, owners, index = array("q"), [], Numbers()
    for t in texts:
        own = _UNIT.findall(SPACE + t.replace(SPACE, LITERAL).replace(" ", SPACE))
        units.extend(index[u] for u in own)
        owners.append(len(own))
    joined, sizes = "".join(index), np.array([len(u) for u in index], np.int64)
    del index, own
    lat = Lattices(vocab, joined, sizes)
    return lat, lat.first[np.frombuffer(units, np.int64)], np.array(owners, np.int64)


def sample(vocab: Vocabulary, texts: list[str], seeds: list[int], k: int) -> tuple[Lattices, list[_Search]]:
    """Up to k samples of each text, and the lattices that their edges are of."""
    lat, first, owners = lattices(vocab, texts)
    return lat, draw(lat, first, owners, seeds, k)


def draw(lat: Lattices, first: np.ndarray, owners: np.ndarray, seeds: list[int], k: int) -> list[_Search]:
    """Up to k samples (edges, log probability, perturbed value) of each text; the best entry left in its queue has the next value.

    ``first`` and ``owners`` as ``lattices`` gives them.
    Entries of the queues: (minus the perturbed value, turn, path, position, edges taken there, logarithm of the subset's mass).
    """
    seed = mix64(np.array(seeds, _U))
    unit_end = np.cumsum(owners)
    unit_start = unit_end - owners
    edges, counts = _paths(lat, first, np.repeat(seed, owners), np.arange(len(first)) - np.repeat(unit_start, owners))
    ends = np.concatenate([[0], np.cumsum(counts)])
    found = [_Search() for _ in owners]
    top = -np.log(-np.log(_uniform(seed, np.full(len(owners), _TOP))))
    paths = [edges[ends[a] : ends[b]] for a, b in zip(unit_start.tolist(), unit_end.tolist(), strict=True)]
    todo = [(n, float(top[n]), 0, 0.0, (), paths[n], 0.0) for n in range(len(owners))]
    for turn in range(k):
        _record(lat, found, todo, seed, turn, k)
        if turn + 1 == k:
            break
        todo = _next(lat, found, seed, turn + 1, first, unit_start, unit_end)
    return found


def _next(lat: Lattices, found: list[_Search], seed: np.ndarray, turn: int, first: np.ndarray, unit_start: np.ndarray, unit_end: np.ndarray) -> list[tuple]:
    """Take the best subset of each text out of its queue and draw its winning path."""
    heads, nodes, seeds, sizes = [], [], [], []
    fresh = mix64(seed + _U(turn * 0x632BE5AB))
    u = _uniform(seed, np.full(len(seed), _PICK + turn))
    for n, search in enumerate(found):
        if not search.queue:
            continue
        minus, _, parent, at, used, mass = heapq.heappop(search.queue)
        node = int(lat.node[parent[at]])
        others = [e for e in range(int(lat.starts[node]), int(lat.starts[node + 1])) if e not in used]
        p = lat.prob[others]
        pick = others[min(int(np.searchsorted(np.cumsum(p), float(u[n]) * float(p.sum()))), len(others) - 1)]
        # what follows the edge: the rest of its unit, and the units after it
        tail = first[unit_start[n] + int((lat.to[parent[:at]] < 0).sum()) + 1 : unit_end[n]]
        inner = lat.to[pick : pick + 1] if lat.to[pick] >= 0 else lat.to[:0]
        nodes += [inner, tail]
        sizes.append(len(inner) + len(tail))
        seeds.append(fresh[n])
        heads.append((n, -minus, parent, at, used, pick, mass))
    if not heads:
        return []
    node = np.concatenate(nodes)
    start = np.cumsum(sizes) - sizes
    drawn, steps = _paths(lat, node, np.repeat(np.array(seeds, _U), sizes), np.arange(len(node)) - np.repeat(start, sizes))
    bound = np.concatenate([[0], np.cumsum(steps)])
    out = []
    for (n, value, parent, at, used, pick, mass), a, size in zip(heads, start.tolist(), sizes, strict=True):
        path = np.concatenate([parent[:at], np.array([pick], parent.dtype), drawn[bound[a] : bound[a + size]]])
        out.append((n, value, at, float(np.log(lat.prob[parent[:at]]).sum()), (*used, pick), path, mass))
    return out


def _record(lat: Lattices, found: list[_Search], todo: list[tuple], seed: np.ndarray, turn: int, k: int) -> None:
    """Record the drawn paths and queue the best of the subsets that branch off them from position ``at`` on; ``used`` edges at
    ``at`` are taken already.  Entries of ``todo``: (text, value, at, log probability before ``at``, used, path, mass).

    After the last path only the next perturbed value is asked for, so all that is left of its subset is queued as one.
    """
    sizes = np.array([len(x[5]) - x[2] for x in todo], np.int64)
    if not len(sizes):
        return
    tail = np.concatenate([x[5][x[2] :] for x in todo])
    start = np.cumsum(sizes) - sizes
    p = lat.prob[tail]
    logs = np.log(p)
    run = np.cumsum(logs, dtype=np.longdouble)  # so that a text's figures don't depend on the texts before it
    before, value = np.array([x[3] for x in todo]), np.array([x[1] for x in todo])
    head = (run - logs)[start]
    total = before + (run[start + sizes - 1] - head).astype(float)
    own = mix64(seed[[x[0] for x in todo]] ^ _U((turn + 1) * 0x9E3779B9))
    for (n, value_n, _, _, _, path, _), log_prob in zip(todo, total.tolist(), strict=True):
        found[n].samples.append((path, log_prob, value_n))
    if turn + 1 == k:
        mass = np.array([x[6] for x in todo])
        rest = -np.expm1(np.minimum(total - mass, 0.0))
        with np.errstate(divide="ignore"):
            got = _below(mass + np.log(np.where(rest > 1e-12, rest, 0.0)), value, _uniform(own, np.full(len(own), _REST)))
        for x, g in zip(todo, got.tolist(), strict=True):
            if g > -math.inf:
                heapq.heappush(found[x[0]].queue, (-g, turn, x[5], x[2], x[4], 0.0))
        return
    lead = (run - logs - np.repeat(head, sizes)).astype(float) + np.repeat(before, sizes)
    rest = np.where(lat.degree[lat.node[tail]] > 1, np.maximum(1.0 - p, 1e-300), 0.0)
    for x, s in zip(todo, start.tolist(), strict=True):
        if x[4]:
            node = int(lat.node[tail[s]])
            left = [e for e in range(int(lat.starts[node]), int(lat.starts[node + 1])) if e not in x[4]]
            rest[s] = float(lat.prob[left].sum()) if left else 0.0
    u = _uniform(np.repeat(own, sizes), np.arange(len(tail)) - np.repeat(start, sizes) + _BRANCH)
    with np.errstate(divide="ignore"):
        mass = lead + np.log(rest)
        got = _below(mass, np.repeat(value, sizes), u)
    want = k - turn
    for (n, _, at, _, used, path, _), s, size in zip(todo, start.tolist(), sizes.tolist(), strict=True):
        g = got[s : s + size]
        best = np.argpartition(g, size - want)[size - want :] if size > want else np.arange(size)
        for i in best.tolist():
            if g[i] > -math.inf:
                heapq.heappush(found[n].queue, (-float(g[i]), turn, path, at + i, used if i == 0 and used else (int(path[at + i]),), float(mass[s + i])))


def _below(mass: np.ndarray, value: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at the logarithms of masses, given that they are below values."""
    return mass - np.log(np.exp(np.minimum(mass - value, 700.0)) - np.log(u))


_SCHEMA = "doc_id bigint, sample int, ids array<int>, n_pieces bigint, log_prob double, perturbed double, inclusion double, text string"
_KINDS = (("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("text", pa.string()))
_CACHE: dict[tuple, Vocabulary] = {}


def _ids(vocab: Vocabulary, lat: Lattices, path: np.ndarray) -> np.ndarray:
    got = lat.piece[path]
    if got.min() >= 0:
        return got.astype(np.int32)
    return np.array([k for x in got.tolist() for k in ((x,) if x >= 0 else vocab.run_list[-x])], np.int32)


def encode(docs: DataFrame, vocabulary: str, samples: int = SAMPLES, seed: int = 0, power: float = POWER, decoded: bool = True) -> DataFrame:
    """For each row of ``docs(doc_id, text)`` up to ``samples`` distinct segmentations drawn without replacement.

    Columns: doc_id, sample (from 0, by falling perturbed value), ids, n_pieces, log_prob, perturbed, inclusion, and the text
    decoded from the ids (null unless ``decoded``), which equals the row's text.  ``inclusion``: the probability that the segmentation is among the
    samples given the next perturbed value; 1 where there are no further segmentations.  The key of a row is its doc_id and the hash
    of its text, so repeated rows give the same samples each.  Null and empty texts give one sample without pieces.  Texts
    with fewer segmentations give them all.  Long texts are taken whole.  Extra columns are not read; an empty table gives an empty result.

    ``vocabulary``: path of a SentencePiece model on the driver; its bytes are broadcast, up to MAX_MODEL_BYTES.
    """
    proto = Path(vocabulary).read_bytes()
    if len(proto) > MAX_MODEL_BYTES:
        raise ValueError(f"{vocabulary} has more than {MAX_MODEL_BYTES} bytes")
    digest, shared = hashlib.sha256(proto).hexdigest(), docs.sparkSession.sparkContext.broadcast(proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _CACHE.get((digest, power))
        if vocab is None:
            _CACHE.clear()
            vocab = _CACHE[digest, power] = Vocabulary(shared.value, power)
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            for lo, hi in _spans(ends, CHUNK_CHARS):
                yield from _batches(vocab, list(zip(*(c.slice(lo, hi - lo).to_pylist() for c in b.columns), strict=True)), samples, decoded)

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text"), F.lit(seed))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("key")).mapInArrow(tidy(run), _SCHEMA)


def _batches(vocab: Vocabulary, rows: list[tuple], samples: int, decoded: bool) -> Iterator[pa.RecordBatch]:
    """The samples of rows that share their lattices, slice by slice."""
    texts = [t for _, t, _ in rows if t]
    lat, first, owners = lattices(vocab, texts) if texts else (None, np.empty(0, np.int64), np.empty(0, np.int64))
    bounds, done = np.concatenate([[0], np.cumsum(owners)]), 0
    for lo, hi in _spans(np.cumsum([len(t or "") for _, t, _ in rows]), SLICE_CHARS):
        seeds = [k & (1 << 64) - 1 for _, t, k in rows[lo:hi] if t]
        to = done + len(seeds)
        yield _batch(vocab, lat, rows[lo:hi], draw(lat, first[bounds[done] : bounds[to]], owners[done:to], seeds, samples) if seeds else [], decoded)
        done = to


def _batch(vocab: Vocabulary, lat: Lattices | None, rows: list[tuple], found: list[_Search], decoded: bool) -> pa.RecordBatch:
    searches = iter(found)
    heads, ids, bare = [], [], []
    for doc_id, text, _ in rows:
        if not text:
            heads.append((doc_id, 0, 0, 0.0, None, 1.0))
            ids.append(np.empty(0, np.int32))
            bare.append(text is None)
            continue
        search = next(searches)
        edge = -search.queue[0][0] if search.queue else -math.inf
        for k, (path, log_prob, value) in enumerate(search.samples):
            own = _ids(vocab, lat, path)
            inclusion = 1.0 if edge == -math.inf else -math.expm1(-math.exp(min(log_prob - edge, 700.0)))
            heads.append((doc_id, k, len(own), round(log_prob, 6), round(value, 6), float(f"{inclusion:.6g}")))
            ids.append(own)
            bare.append(False)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    ends = np.cumsum([len(x) for x in ids]).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, pa.int32()))
    texts = pc.if_else(pa.array(bare, pa.bool_()), None, vocab.decode(flat, ends)) if decoded else pa.nulls(len(heads), pa.string())
    cols = [pa.array([h[k] for h in heads], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64()))]
    return pa.RecordBatch.from_arrays([cols[0], cols[1], lists, *cols[2:], texts], [n for n, _ in _KINDS])
