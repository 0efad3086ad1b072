"""Quality score from compressed sizes.

Two zstandard dictionaries are built, one from good and one from bad labelled texts.  A text is compressed with each, in short blocks
so that the dictionaries matter all the way, and the difference of the compressed sizes per byte, together with the sizes
themselves, goes through a logistic function fitted on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy, utf8

#: Labelled rows that training may use: at most so many of each class, the least by hash of the id.  Of a text of more than so many
#: bytes it takes blocks spread evenly over the whole text.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 2000, 32768
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 64 << 10, 1024, 3


@dataclass(frozen=True)
class Model:
    """Dictionaries and the weights of (1, size difference, good size, bad size, 1 / root of the length)."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float


def _blocks(raw: bytes, max_bytes: int | None = None) -> list[bytes]:
    """The blocks of a text, or as many as ``max_bytes`` holds, spread evenly from its start to its end."""
    n = -(-len(raw) // BLOCK_BYTES)
    most = n if max_bytes is None else max(1, max_bytes // BLOCK_BYTES)
    picked = range(n) if n <= most else [k * (n - 1) // max(1, most - 1) for k in range(most)]
    return [raw[k * BLOCK_BYTES : (k + 1) * BLOCK_BYTES] for k in picked]


class Scorer:
    def __init__(self, model: Model) -> None:
        import zstandard as z

        self.model = model
        own = [z.ZstdCompressionDict(d) if d else None for d in (model.good, model.bad)]
        for d in own:
            if d is not None:
                d.precompute_compress(level=LEVEL)
        self.pack = [z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) if d is not None else z.ZstdCompressor(level=LEVEL) for d in own]

    def features(self, parts: list[bytes], size: int) -> list[float]:
        """Of the blocks of a text of ``size`` bytes, all of them or a part."""
        n = sum(map(len, parts))
        if not n:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        good, bad = (sum(len(c.compress(x)) for x in parts) for c in self.pack)
        return [1.0, (bad - good) / n, good / n, bad / n, 1.0 / math.sqrt(size)]

    def score(self, text: str | None) -> float:
        if not text:
            return self.model.prior
        raw = utf8(text)
        z = sum(w * x for w, x in zip(self.model.weights, self.features(_blocks(raw), len(raw)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary of an eighth of the blocks at most; from blocks too few to train on, their plain content."""
    import zstandard as z

    if len(samples) >= 16:
        try:
            return z.train_dictionary(min(DICTIONARY_BYTES, max(2048, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
        except z.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on standardised columns; the weights are for the columns as given."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    out = w / scale
    out[0] -= float((w * mean / scale)[1:].sum())
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: str = "true", max_rows: int = MAX_TRAINING_ROWS, max_text_bytes: int = MAX_TRAINING_BYTES) -> Model:
    """A model from the labelled rows for which the SQL condition ``learn`` on ``doc_id`` holds.

    The bounded sample is the only thing collected: ``max_rows`` rows of each class by hash of the id, and of each at most
    ``max_text_bytes``, in blocks spread over the whole text (scores always take whole texts).  A document with several labels counts by the
    least, and one with several texts by the first in order; rows that repeat count once.  Null ids, labels and texts and empty texts are not learnt
    from.  With a class missing the score is the smoothed share of good rows for every text.
    """
    own = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).where(learn)
    order = own.withColumn("h", F.xxhash64("doc_id"))
    picked = order.where("quality = 1").orderBy("h", "doc_id").limit(max_rows).unionByName(order.where("quality = 0").orderBy("h", "doc_id").limit(max_rows))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    chosen = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality", "h").agg(F.min("text").alias("text"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [utf8(t.as_py()) for t in b.column(3)]
            cols = [*b.columns[:3], pa.array([_blocks(t, max_text_bytes) for t in raw], pa.list_(pa.binary())), pa.array(map(len, raw), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "quality", "h", "parts", "size"])

    rows = chosen.mapInArrow(tidy(spread), "doc_id bigint, quality int, h bigint, parts array<binary>, size bigint").collect()
    rows = sorted(rows, key=lambda r: (r.h, r.doc_id))
    prior = (sum(r.quality for r in rows) + 1) / (len(rows) + 2)
    sides = {q: [([bytes(x) for x in r.parts], r.size) for r in rows if r.quality == q] for q in (0, 1)}
    if min(map(len, sides.values())) < 4:
        return Model(b"", b"", (math.log(prior / (1 - prior)), 0, 0, 0, 0), prior)
    model = Model(*(_dictionary([x for parts, _ in sides[q][::2] for x in parts]) for q in (1, 0)), (0.0,) * 5, prior)
    scorer = Scorer(model)
    rest = [(q, *t) for q in (0, 1) for t in sides[q][1::2]]
    x = np.array([scorer.features(parts, size) for _, parts, size in rest])
    weights = _logistic(x, np.array([q for q, _, _ in rest], float))
    return Model(model.good, model.bad, tuple(map(float, weights)), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id and score in 0..1 over the whole text, higher for good quality.

    Null and empty texts get the share of good rows among the training rows.  Repeated rows get the same score each; a null doc_id
    stays null.  Extra columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id bigint, score double")
