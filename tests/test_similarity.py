import random

import pytest

from webloom.functions import words as W
from webloom.operators import similarity as N


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("threshold", [0.4, 0.75, 0.85, 1.0])
def test_similar_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(5)
    sets = [set()] * 2
    for n in (1, 2, 5, 9, 14, 30, 31, 60, 150):
        own = {f"w{rng.randrange(400)}" for _ in range(n)}
        for _ in range(6):
            gone = set(rng.sample(sorted(own), int(len(own) * rng.random() * 0.3)))
            sets.append(own - gone | {f"w{rng.randrange(400)}" for _ in range(rng.randrange(1 + len(own) // 8))})
    got = N.similar_pairs(spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "doc_id int, tokens array<string>"), threshold).collect()
    want = {(i, j): s for i in range(len(sets)) for j in range(i + 1, len(sets)) if (s := jaccard(sets[i], sets[j])) >= threshold}
    assert len(got) == len(want) and {(r.a, r.b): r.similarity for r in got} == want


def test_unlike_sets_of_common_tokens_are_not_compared(spark):
    rng = random.Random(6)
    names = [f"w{k}" for k in range(300)]  # every token is in a fifth of the sets: single tokens would bring all together
    df = spark.createDataFrame([(k, 60, N._packed(sorted(rng.sample(names, 60)))) for k in range(600)], "row bigint, n int, words binary")
    lists = N._listed(df, 0.85).groupBy("k").count().collect()
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in lists) < 600 and sum(r["count"] for r in lists) < 600 * 60 * 0.4


def test_near_dup_clusters_of_other_ids(spark):
    base = " ".join(f"alpha{k} beta{k}" for k in range(60))
    docs = spark.createDataFrame([("https://b/", base), ("https://a/", base + " gamma"), ("https://c/", base), ("https://d/", base.replace("a", "o")), ("https://e/", None)], "doc_id string, text string")
    got = {tuple(r) for r in N.near_dup_clusters(docs).collect()}
    assert got == {("https://a/", "https://a/", 3, 0.992), ("https://b/", "https://a/", 3, 0.992), ("https://c/", "https://a/", 3, 0.992)}
    assert N.near_dup_clusters(docs.where("doc_id is null")).count() == 0


def test_words_equal_the_column_expressions(spark):
    from pyspark.sql import functions as F

    from webloom.functions import text as T

    rng = random.Random(7)
    ends = ["s", "es", "ies", "sses", "ses", "xes", "zes", "ches", "shes", "ss", "us", "ing", "ings", "inges", "e", "ce", "ges", "ve", "ed", ""]
    texts = ["".join(f"a{chr(c)}b " for c in range(k, min(k + 4096, 0x110000)) if not 0xD800 <= c < 0xE000) for k in range(0, 0x20000, 4096)]
    texts += [" ".join("".join(rng.choice("abcest") for _ in range(rng.randrange(6))) + rng.choice(ends) for _ in range(2000)), "The teams' İSTANBUL c++ Straße naïve O’Neil ÉTÉ ΣΑΣ éte", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", T.tokens(F.col("text")).alias("w"), T.stems(F.col("text")).alias("s")).collect():
        assert (own := W.tokens(texts[r.i])) == r.w and W.stems_of(own) == r.s
