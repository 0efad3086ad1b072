"""The tokens and stems of ``webloom.functions.text`` in plain Python, for whole texts: a word is stemmed once a worker, not once a text."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from webloom.functions.text import _MARKED, _PLAIN, STOPWORDS

_FOLDED = {**dict(zip(_MARKED, _PLAIN, strict=True)), "'": "", "’": "", **{chr(k): "" for k in range(0x300, 0x370)}}
_MARK, _TOKEN, _STOP = re.compile("['’à-ɏ̀-ͯ]"), re.compile("[a-z0-9+#]+"), frozenset(STOPWORDS)


def tokens(text: str | None) -> list[str]:
    """ASCII tokens of letters, digits, + and # of the folded text."""
    low = (text or "").lower()
    low = low.replace("'", "") if low.isascii() else _MARK.sub(lambda m: _FOLDED.get(m[0], m[0]), low)
    return _TOKEN.findall(low)


def is_content(w: str) -> bool:
    return len(w) > 1 and w not in _STOP


def stem(w: str) -> str:
    """The rules of ``text.stem_all``, in their order."""
    n = len(w)
    if n <= 3:
        return w
    if w[-1] == "s":
        if w.endswith("ies") and n > 4:
            return w[:-3] + "y"
        if w.endswith("sses"):
            return w[:-2]
        if n > 4 and w.endswith(("ses", "xes", "zes", "ches", "shes")):
            return w[:-2]
        w = w if w.endswith(("ss", "us")) else w[:-1]
    if w.endswith("ing") and len(w) >= 7:
        w = w[:-3]
    return w[:-1] if w[-1] == "e" and (len(w) >= 6 or len(w) == 5 and w[-2] in "cgsvz") else w


class _Stems(dict):
    """A bounded cache of stems; None: no content token."""

    LIMIT = 200_000

    def __missing__(self, w: str) -> str | None:
        if len(self) >= self.LIMIT:
            self.clear()
        v = self[w] = stem(w) if is_content(w) else None
        return v


_STEMS = _Stems()


def stems_of(words: list[str]) -> list[str]:
    """Stems of the content tokens among ``words``, in order."""
    return [s for s in map(_STEMS.__getitem__, words) if s is not None]


#: Distinct tokens that a task counts before it passes them on (some 20 MB).
MAX_COUNTED = 200_000
_VOWELS, _SILENT, _LETTERS = re.compile("[aeiouy]{1,2}"), re.compile("(?:[^laeiouy]es|ed|[^laeiouy]e)$"), re.compile("[^a-z]")


class _Syllables(_Stems):
    """A bounded cache of the syllables of (token, whether it is Spanish), as of ``text.syllables``."""

    def __missing__(self, key: tuple[str, bool]) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        w = _LETTERS.sub("", key[0])
        n = len(w) and 1
        if len(w) > 3:
            n = max(1, len(_VOWELS.findall(w if key[1] else _SILENT.sub("", w).removeprefix("y"))))
        self[key] = n
        return n


_SYLLABLES = _Syllables()


@F.pandas_udf(StructType([*[StructField(c, IntegerType()) for c in ("n_tokens", "n_content", "n_stems")], StructField("stems_md5", StringType())]))
def token_stats(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        own = stems_of(words := tokens(t))
        rows.append((len(words), len(own), len(set(own)), hashlib.md5(" ".join(own).encode()).hexdigest()))
    return pd.DataFrame(rows, columns=["n_tokens", "n_content", "n_stems", "stems_md5"])


@F.pandas_udf(StructType([StructField(c, IntegerType()) for c in ("words", "sentences", "long_sentences", "syl")]))
def sentence_stats(parts: pd.Series, spanish: pd.Series) -> pd.DataFrame:
    """Of the sentences of a text: tokens, sentences, those of more than 30 tokens, and syllables."""
    rows = []
    for ss, es in zip(parts, spanish, strict=True):
        words = [tokens(x) for x in ss]
        rows.append((sum(map(len, words)), len(words), sum(len(w) > 30 for w in words), sum(_SYLLABLES[x, bool(es)] for w in words for x in w)))
    return pd.DataFrame(rows, columns=["words", "sentences", "long_sentences", "syl"])


@F.pandas_udf(IntegerType())
def content_size(text: pd.Series) -> pd.Series:
    """Content tokens of a text."""
    return pd.Series([len(stems_of(tokens(t))) for t in text], dtype="int32")


def token_numbers(docs: DataFrame) -> DataFrame:
    """(token, n): documents of ``docs(text)`` that have a stem, counted where they are; of those with any stem under null, of all under ""."""

    def run(batches):  # noqa: ANN001, ANN202
        rows = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["token", "n"])
        many: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                own = set(stems_of(tokens(text)))
                many.update(own)
                many[""] += 1
                many[None] += bool(own)
                if len(many) > MAX_COUNTED:
                    yield rows(many)
                    many.clear()
        yield rows(many)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
