"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and stores the measurements and one failure bit per rule.  A policy is a version number
and the mask of the rules it enforces: ``verdicts`` applies it to a ledger without reading a text again, and ``ablation``
computes for each rule what the policy would keep without it from counts of distinct masks alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import any_columns, tidy, utf8

LEDGER_VERSION = 1
#: Rule names by bit.
RULES = ("too_few_words", "repeated_words", "symbol_density", "upper_case_words", "exclamations", "duplicate_lines", "word_length")
BASE_MASK = 0b11


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy(1, RULES[:2]), Policy(2, RULES))}
DEFAULT_POLICY = POLICIES[2]

_SPACES, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_exclamations")
LEDGER_SCHEMA = "doc_id bigint, " + ", ".join(f"{m} bigint" for m in MEASURES) + ", fail_bits bigint, ledger_version int"


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    m = len(seen)
    pairs = ids[:-1] * m + ids[1:]
    if m > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    key = pairs[:-1] * m + ids[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    if len(counts) == len(key):
        return 0
    again, cover = counts[inverse] > 1, np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= again
    return int(cover.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one text; null counts as empty and gives zeros."""
    raw = utf8(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words), (len(text) if text else 0) - len(raw) + len(raw.translate(None, _SPACES)), len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), _repeated(words), sum(map(bytes.isupper, words)), raw.count(b"!"),
    )


def fail_bits(m: tuple[int, ...]) -> int:
    """One bit per rule; integer arithmetic only, so any engine gives the same bits."""
    words, chars, symbols, lines, dup, repeat, upper, exclaim = m
    failed = (
        words < 50, 100 * repeat > 50 * words, 100 * symbols > 20 * words, 100 * upper > 30 * words,
        100 * exclaim > 30 * words, lines >= 4 and 100 * dup > 50 * lines, words > 0 and not 2 * words <= chars <= 20 * words,
    )
    return sum(1 << k for k, x in enumerate(failed) if x)


def ledger(docs: DataFrame) -> DataFrame:
    """One ledger row per row of ``docs(doc_id, text)``: MEASURES, ``fail_bits`` and ``ledger_version``.

    Null or empty text: zeros, which fail ``too_few_words``.  A null doc_id stays null.  Repeated rows give a row each.  An empty
    table gives an empty ledger.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t.as_py()) for t in b.column(1)]
            cols = [b.column(0).cast(pa.int64())] + [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]
            cols += [pa.array([fail_bits(r) for r in rows], pa.int64()), pa.array([LEDGER_VERSION] * len(rows), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *MEASURES, "fail_bits", "ledger_version"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), LEDGER_SCHEMA)


def verdicts(book: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """``book`` with ``base_failed``, ``kept`` and ``policy_version``."""
    bits = F.col("fail_bits")
    return book.withColumns({
        "base_failed": bits.bitwiseAND(F.lit(BASE_MASK)) != 0, "kept": bits.bitwiseAND(F.lit(policy.mask | BASE_MASK)) == 0,
        "policy_version": F.lit(policy.version),
    })


def ablation(book: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger is first reduced to counts of distinct masks (at most 2**len(RULES) rows), whatever its size.
    """
    masks = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    enforced = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    rules = F.array(*[F.struct(F.lit(RULES.index(r)).alias("rule_bit"), F.lit(r).alias("rule")) for r in policy.rules])
    at = masks.withColumn("r", F.explode(rules)).select("fail_bits", "n", "r.rule_bit", "r.rule").withColumn("bit", F.expr("shiftleft(1L, rule_bit)"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return at.groupBy("rule").agg(
        n(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), n(enforced == F.col("bit")).alias("n_failed_alone"),
        n(enforced.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


@any_columns
def keep_good(docs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns, in one pass without a shuffle.

    Null and empty texts have too few words and go.  Repeated rows are judged each; an empty table stays empty.
    """
    at, mask = docs.columns.index("text"), policy.mask | BASE_MASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not fail_bits(measure(t.as_py())) & mask for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
