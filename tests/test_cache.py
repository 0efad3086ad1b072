import pytest
from pyspark.sql import functions as F

from webloom.operators.keywords import expand_captured
from webloom.plans.cache import cache_key, country_code, read_through, site_key
from webloom.plans.envelope import Budget, ToolError
from webloom.plans.store import Store


def test_read_through_asks_once(spark, tmp_path):
    store, asked = Store(spark, str(tmp_path / "s")), []

    def fetch(misses):
        asked.append(sorted(r.key for r in misses.collect()))
        return misses.where("key <> 'none'").select("key", F.concat(F.lit("body of "), "key").alias("body"))

    wanted = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    budget = Budget(3)
    read_through(store, "serp", wanted("a", "none", "a"), fetch, budget)
    got = {r.key: r.body for r in read_through(store, "serp", wanted("a", "b", "none"), fetch, budget).collect()}
    assert asked == [["a", "none"], ["b"]] and got == {"a": "body of a", "b": "body of b", "none": None} and budget.spent == 3
    with pytest.raises(ToolError):
        read_through(store, "serp", wanted("c"), fetch, budget)
    read_through(store, "page", wanted("a"), fetch)
    assert asked[-1] == ["a"]
    store.clear_cache("serp")
    assert store.read("cache").count() == 1


def test_keys_and_countries(spark):
    df = spark.createDataFrame([("Austin, Texas, United States", "HTTPS://www.E.com/x"), ("Spain", "e.com:80"), (None, "E")], "l string, s string")
    assert [(r.c, r.k) for r in df.select(country_code(F.col("l")).alias("c"), site_key(F.col("s")).alias("k")).collect()] == [("us", "www.e.com"), ("es", "e.com"), ("us", "e")]
    keys = df.select(cache_key(F.col("l"), F.lit("x")).alias("k")).collect()
    assert len({r.k for r in keys}) == 3


def test_expansion_in_two_steps(spark):
    captured = spark.createDataFrame([("crm", "g", "crm app", 0), ("crm app a", "g", "crm app android", 0), ("crm app a", "g", "crm app", 1), ("other", "g", "x", 0)], "via string, engine string, keyword string, rank int")
    seeds = spark.createDataFrame([("CRM",)], "seed string")
    assert [r.keyword for r in expand_captured(seeds, captured, 2030, ("plain",)).collect()] == ["crm app"]
    assert sorted(r.keyword for r in expand_captured(seeds, captured, 2030, ("plain",), depth=2).collect()) == ["crm app", "crm app android"]
