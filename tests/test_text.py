from pyspark.sql import functions as F

from webloom.functions import text as T, url as U
from webloom.operators.similarity import count_phrase, hash64
from webloom.sources.html import token_list


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(*cols).first()


def test_tokens_fold_accents_and_keep_signs(spark):
    r = one(spark, T.tokens(F.col("a")).alias("a"), T.tokens(F.col("n")).alias("n"), a="Café c++ & C# don’t Año", n=None)
    assert r.a == ["cafe", "c++", "c#", "dont", "ano"] and r.n == []
    assert token_list("Café c++ & C# don’t Año") == r.a


def test_content_tokens_drop_stopwords(spark):
    assert one(spark, T.content_tokens(F.col("a")).alias("a"), a="The best CRM for a team").a == ["best", "crm", "team"]


def test_stems(spark):
    words = "rating king billing invoicing invoice companies classes boxes status hoteles hotel plane tools ciudades ciudad"
    got = one(spark, F.transform(F.split("a", " "), T.stem).alias("a"), a=words).a
    assert got == ["rating", "king", "bill", "invoic", "invoic", "company", "class", "box", "status", "hotel", "hotel", "plane", "tool", "ciudad", "ciudad"]


def test_ngrams_of_short_arrays(spark):
    r = one(spark, T.ngrams(F.split("a", " "), 2).alias("two"), T.ngrams(F.split("a", " "), 5).alias("five"), a="a b c")
    assert r.two == ["a b", "b c"] and r.five == []


def test_sentences(spark):
    r = one(spark, T.sentences(F.col("a")).alias("a"), T.sentences(F.col("b")).alias("b"), a='Él trabaja. Ámbito. ¿Conviene? e.g. no', b='He said "yes." Then left.')
    assert len(r.a) == 3 and r.b == ['He said "yes."', "Then left."]


def test_phrases_allow_two_stopwords(spark):
    stems = F.transform(T.tokens(F.col("a")), T.stem)
    needle = F.transform(T.content_tokens(F.col("p")), T.stem)
    assert one(spark, count_phrase(stems, needle).alias("n"), a="tools for the teams and tool team, tool for of the team", p="tool team").n == 2


def test_hash_is_fnv1a():
    assert hash64("") == 0xCBF29CE484222325 and hash64("a") == 0xAF63DC4C8601EC8C


def test_normalize():
    assert U.normalize("HTTP://Example.com:80/a//b/index.html?utm_source=x&b=2&a=1#f") == "http://example.com/a/b/?a=1&b=2"
    assert U.normalize("../x/", "https://e.com/a/b") == "https://e.com/x/" and U.normalize("mailto:x@y.z") is None and U.normalize(None) is None


def test_domains(spark):
    hosts = ["www.example.co.uk", "a.b.example.com", "me.github.io", "localhost"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(U.registrable_domain(F.col("h")).alias("d"))
    assert [r.d for r in df.collect()] == ["example.co.uk", "example.com", "me.github.io", "localhost"]


def test_truncate(spark):
    assert one(spark, T.truncate(F.col("a"), 12).alias("a"), a="hello brave new world").a == "hello brave…"
