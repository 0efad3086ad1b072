"""Read-through caching of looked-up payloads: one left join for what is known, one anti-join for what is not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from webloom.operators.similarity import checkpointed
from webloom.plans.envelope import Budget
from webloom.plans.store import Store

#: Seconds for which a namespace's answers hold.
TTL = {"serp": 6 * 3600, "keyword_metrics": 7 * 24 * 3600, "suggest": 24 * 3600, "page": 3600, "backlinks": 3 * 24 * 3600, "gsc": 12 * 3600, "robots": 3600}
#: Country codes by name.
COUNTRIES = dict(x.split("=") for x in """united states=us,usa=us,us=us,united kingdom=gb,uk=gb,england=gb,canada=ca,australia=au,germany=de,france=fr,
spain=es,italy=it,netherlands=nl,belgium=be,sweden=se,norway=no,denmark=dk,finland=fi,poland=pl,portugal=pt,ireland=ie,india=in,japan=jp,
south korea=kr,brazil=br,mexico=mx,argentina=ar,south africa=za,singapore=sg,new zealand=nz,switzerland=ch,austria=at,israel=il,turkey=tr,
uae=ae,united arab emirates=ae""".replace("\n", "").split(","))


def cache_key(*parts: Column) -> Column:
    """A stable key of a call's arguments; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def read_through(store: Store, namespace: str, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame], budget: Budget | None = None, cost: float = 1.0) -> DataFrame:
    """(key, body) for ``wanted(key, ...)``: from the cache, and what is missing from ``fetch``, which gets those rows and gives
    (key, body).  Only misses cost; answers without a body are cached too, so they are not asked for again."""
    keys = wanted.dropDuplicates(["key"])
    live = store.read("cache").where((F.col("namespace") == namespace) & (F.col("expires_at") > F.current_timestamp())).groupBy("key").agg(F.max_by("body", "expires_at").alias("body"))
    hits = keys.select("key").join(live, "key")
    misses = checkpointed(keys.join(live, "key", "left_anti"))
    if misses.isEmpty():
        return hits
    if budget is not None:
        budget.reserve(cost * misses.count())
    got = checkpointed(misses.select("key").join(fetch(misses).select("key", "body"), "key", "left"))
    store.append("cache", got.withColumns({"namespace": F.lit(namespace), "expires_at": F.current_timestamp() + F.make_interval(secs=F.lit(TTL[namespace]))}))
    return hits.unionByName(got)


def country_code(location: Column) -> Column:
    """Of a name, or of what follows its last comma; else us."""
    table = F.create_map(*[F.lit(x) for k, v in COUNTRIES.items() for x in (k, v)])
    whole = F.trim(F.lower(location))
    at = lambda k: F.element_at(table, k)
    return F.coalesce(at(whole), at(F.trim(F.substring_index(whole, ",", -1))), F.lit("us"))


def site_key(site: Column) -> Column:
    """The host of a site given with or without a scheme."""
    host = F.regexp_extract(F.lower(F.trim(site)), r"^(?:https?://)?(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host).otherwise(F.lower(site))
