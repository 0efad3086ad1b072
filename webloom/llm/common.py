"""Shared helpers: shared-folder checkpoints, byte tokenisers and vectorised 64-bit hashing."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_U = np.uint64


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; only a local session without that setting gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="webloom-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage; Spark's cleaner removes the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[str]:
    """The names of ``df``'s columns, safe to select whatever characters they have."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def any_columns(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator that returns the columns of its first argument: those that it doesn't know get plain names while it works, so
    their own may be any."""

    @wraps(operator)
    def renamed(docs: DataFrame, *args, **kw) -> DataFrame:  # noqa: ANN002, ANN003
        plain = [c if c in ("doc_id", "text", "n_chars") else f"extra {k}" for k, c in enumerate(docs.columns)]
        return operator(docs.toDF(*plain), *args, **kw).toDF(*docs.columns)

    return renamed


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """``run``, giving freed memory back to the system at the end of a partition: Python workers live on, and several of them
    share an executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return wrapped


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


_A_Z = bytes(range(65, 91))
_LOWER = bytes.maketrans(_A_Z, _A_Z.lower())
#: Lower-cases A-Z and turns every byte outside 0-9, a-z and non-ASCII into a space.
_ALNUM = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` lower-cases A-Z only."""
    raw = utf8(text)
    return (raw.translate(_LOWER) if lower else raw).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return utf8(text).translate(_ALNUM).split()


class Numbers(dict):
    """Numbers keys in order of their first look-up."""

    def __missing__(self, key: object) -> int:
        n = self[key] = len(self)
        return n


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element (wraps modulo 2**64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """A bounded cache word -> 64-bit hash, stable across processes."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORD_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([WORD_HASHES[w] for w in words], dtype=_U)


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words: the whole sequence as one; none: empty."""
    if not words:
        return np.empty(0, _U)
    h = word_hashes(words)
    n = len(words) - width + 1
    if n < 1:
        acc = np.zeros(1, _U)
        for x in h:
            acc = acc * _U(0x9E3779B97F4A7C15) + x
        return mix64(acc + _U(len(words)))
    acc = h[:n].copy()
    for k in range(1, width):
        acc = acc * _U(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix64(acc + _U(width)))
