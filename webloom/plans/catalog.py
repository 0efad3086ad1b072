"""The registered queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from webloom.functions import text as T, url as U
from webloom.functions.mathx import js_round, sql_ctr, sql_round
from webloom.functions.words import token_stats
from webloom.operators import audit, content, crawldiff, insights, keywords as K, linkgraph, programmatic as P, ranks as R, serp as S, similarity as N, visibility as V
from webloom.operators.actions import action_score
from webloom.plans import stand_ins as A
from webloom.sources.html import read_pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


r = sql_round

# rank snapshots


@query(f"""WITH {A.SQL_RANKS},
n AS (SELECT *, row_number() OVER w AS rn, lead(position) OVER w AS previous_position, lead(checked_at) OVER w AS previous_checked_at FROM ranks WINDOW w AS (PARTITION BY keyword ORDER BY checked_at DESC, tie DESC))
SELECT keyword, position, checked_at, previous_position, previous_checked_at, {r('previous_position - position', 1)} AS change FROM n WHERE rn = 1""")
def rank_changes(spark, sf):
    return R.rank_changes(A.ranks(spark, sf))


@query(f"""WITH {A.SQL_RANKS},
n AS (SELECT *, checked_at::DATE AS d, row_number() OVER (PARTITION BY keyword, checked_at::DATE ORDER BY checked_at DESC, tie DESC) AS rn FROM ranks WHERE checked_at::DATE IN ('2024-01-08', '2024-01-15')),
a AS (SELECT keyword, position FROM n WHERE rn = 1 AND d = '2024-01-08'), b AS (SELECT keyword, position FROM n WHERE rn = 1 AND d = '2024-01-15')
SELECT coalesce(a.keyword, b.keyword) AS keyword, a.position AS before, b.position AS after, {r('a.position - b.position', 1)} AS change FROM a FULL OUTER JOIN b ON a.keyword = b.keyword""")
def rank_diff_dates(spark, sf):
    return R.rank_diff(A.ranks(spark, sf), "2024-01-08", "2024-01-15")


@query(f"WITH {A.SQL_RANKS} SELECT keyword, position, checked_at, n FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY checked_at DESC, tie DESC) AS n FROM ranks) WHERE n <= 60")
def rank_history_topn(spark, sf):
    return R.rank_history(A.ranks(spark, sf)).select("keyword", "position", "checked_at", F.col("n").cast("bigint").alias("n"))


@query(f"WITH {A.SQL_RANKS} SELECT DISTINCT checked_at::DATE AS date FROM ranks")
def rank_dates(spark, sf):
    return R.rank_dates(A.ranks(spark, sf))


@query(f"WITH {A.SQL_EVENTS} SELECT event_type AS provider, count(*) AS calls, sum(cents)::BIGINT AS units FROM ev WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")
def usage_rollup(spark, sf):
    e = A._events(spark, sf).select(F.col("event_type").alias("provider"), F.col("cents").alias("units"), F.col("ts").alias("at"))
    return R.usage(e, "2024-01-10")


# search performance


@query(f"""WITH {A.SQL_PERFORMANCE},
x AS (SELECT *, floor(impressions * 0.06::DOUBLE + 0.5::DOUBLE)::BIGINT AS potential_clicks FROM perf WHERE position BETWEEN 8 AND 25 AND impressions >= 30)
SELECT query, page, {r('position', 1)} AS position, impressions, clicks, {r('ctr * 100', 2)} AS ctr, potential_clicks, potential_clicks - clicks AS potential_gain, 'commercial' AS intent
FROM x WHERE potential_clicks > clicks""")
def striking_distance(spark, sf):
    return insights.striking_distance(A.performance(spark, sf), limit=1 << 30)


@query(f"""WITH {A.SQL_PERFORMANCE},
x AS (SELECT *, {sql_ctr('floor(position + 0.5::DOUBLE)')} AS expected FROM perf WHERE impressions >= 100 AND position <= 10)
SELECT query, page, {r('position', 1)} AS position, impressions, clicks, {r('ctr * 100', 2)} AS actual_ctr, {r('expected * 100', 2)} AS expected_ctr, {r('(expected - ctr) * 100', 2)} AS ctr_gap,
  greatest(0, floor(impressions * expected + 0.5::DOUBLE)::BIGINT - clicks)::BIGINT AS potential_gain
FROM x WHERE expected > 0 AND ctr < expected * 0.6::DOUBLE""")
def ctr_opportunities(spark, sf):
    return insights.ctr_opportunities(A.performance(spark, sf), limit=1 << 30)


@query(f"""WITH {A.SQL_PERFORMANCE},
x AS (SELECT *, sum(impressions) OVER (PARTITION BY query) AS total, count(*) OVER (PARTITION BY query) AS n FROM perf),
m AS (SELECT * FROM x WHERE n >= 2 AND total >= 400 AND impressions >= total * 0.1::DOUBLE),
g AS (SELECT query, max(total)::BIGINT AS total_impressions, count(*) AS n_pages, arg_min(page, (position, page)) AS primary_page, arg_min(impressions, (position, page)) AS i FROM m GROUP BY query HAVING count(*) >= 2)
SELECT query, total_impressions, n_pages, primary_page, CASE WHEN n_pages >= 3 OR i::DOUBLE / total_impressions < 0.65 THEN 'high' WHEN i::DOUBLE / total_impressions < 0.85 THEN 'medium' ELSE 'low' END AS severity FROM g""")
def cannibalization(spark, sf):
    return insights.cannibalization(A.performance(spark, sf), min_impressions=400, limit=1 << 30)


@query(f"""WITH {A.SQL_HALVES},
j AS (SELECT b.page, b.clicks AS cb, coalesce(a.clicks, 0) AS ca, b.impressions AS ib, coalesce(a.impressions, 0) AS ia, CASE WHEN b.impressions > 0 THEN b.position * b.impressions / b.impressions ELSE 0::DOUBLE END AS pb, CASE WHEN coalesce(a.impressions, 0) > 0 THEN a.position * a.impressions / a.impressions ELSE 0::DOUBLE END AS pa FROM bef b LEFT JOIN aft a USING (page) WHERE b.clicks >= 10)
SELECT page, cb AS clicks_before, ca AS clicks_after, ca - cb AS change, {r('(ca - cb)::DOUBLE / cb * 100', 1)} AS change_pct, ib AS impressions_before, ia AS impressions_after, {r('pb', 1)} AS position_before, {r('pa', 1)} AS position_after,
  CASE WHEN pa > pb + 1.5 AND ia < ib * 0.8::DOUBLE THEN 'mixed' WHEN pa > pb + 1.5 THEN 'lost_rankings' WHEN ia < ib * 0.8::DOUBLE THEN 'lost_impressions' ELSE 'lost_ctr' END AS likely_cause
FROM j WHERE (ca - cb)::DOUBLE / cb * 100 <= -20""")
def content_decay(spark, sf):
    return insights.content_decay(*A.halves(spark, sf), limit=1 << 30)


@query(f"""WITH {A.SQL_HALVES},
j AS (SELECT a.*, coalesce(b.impressions, 0) AS p, CASE WHEN coalesce(b.impressions, 0) > 0 THEN (a.impressions - b.impressions)::DOUBLE / b.impressions * 100 ELSE 100::DOUBLE END AS growth FROM aft a LEFT JOIN bef b USING (query) WHERE a.impressions >= 50)
SELECT query, p::BIGINT AS impressions_before, impressions AS impressions_after, {r('growth', 1)} AS growth_pct, {r('position', 1)} AS position, clicks, position > 10 AS untapped FROM j WHERE growth >= 30""")
def rising_queries(spark, sf):
    return insights.rising_queries(*A.halves(spark, sf), limit=1 << 30)


@query(f"""WITH {A.SQL_PERFORMANCE}
SELECT page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, {r('sum(clicks)::DOUBLE / sum(impressions) * 100', 2)} AS ctr, {r('sum(position * impressions) / sum(impressions)', 1)} AS position FROM perf GROUP BY page""")
def perf_by_dimensions(spark, sf):
    return insights.performance(A.performance(spark, sf), "page")


# result pages and links


@query(f"""WITH {A.SQL_RESULTS}, x AS (SELECT keyword, domain, min(position) AS position FROM serp GROUP BY 1, 2), n AS (SELECT count(DISTINCT keyword) AS n FROM serp)
SELECT domain, count(*) AS appearances, {r('sum(1 / sqrt(position)) / max(n) * 100', 1)} AS visibility, {r('count(*)::DOUBLE / max(n) * 100', 1)} AS coverage_pct, {r('avg(position)', 1)} AS avg_position, count(*) FILTER (position <= 10) AS top_10_count FROM x, n GROUP BY domain""")
def serp_competitors(spark, sf):
    return S.serp_competitors(A.results(spark, sf))


@query(f"""WITH {A.SQL_RESULTS}, mine AS (SELECT keyword, min(position) AS your_position FROM serp WHERE domain = 's7.com' GROUP BY 1),
theirs AS (SELECT keyword, count(DISTINCT domain) AS n_competitors, min(position) AS best_position, max(volume) AS volume FROM serp WHERE domain <> 's7.com' AND position <= 20 AND volume >= 50 GROUP BY 1)
SELECT keyword, n_competitors, best_position::BIGINT AS best_position, volume, your_position::BIGINT AS your_position FROM theirs LEFT JOIN mine USING (keyword) WHERE your_position IS NULL OR your_position > 20""")
def content_gap(spark, sf):
    out = S.content_gap(A.results(spark, sf), "s7.com")
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("best_position", "your_position")})


def _links(spark: SparkSession, sf: str) -> DataFrame:
    line, orders, sup, cust = (A.table(spark, sf, t) for t in ("lineitem", "orders", "supplier", "customer"))
    j = line.select("l_orderkey", "l_suppkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    j = j.join(sup.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target")), "l_suppkey").join(cust.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    # sources: customers' nations with the supplier, so that not every source links everywhere
    return j.select(F.concat_ws("-", F.col("nation").cast("string"), F.col("l_suppkey").cast("string")).alias("source"), (F.col("o_custkey") % 40).cast("string").alias("target"))


_SQL_LINKS = "links AS (SELECT DISTINCT c_nationkey::VARCHAR || '-' || l_suppkey::VARCHAR AS source, (o_custkey % 40)::VARCHAR AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey)"


@query(f"WITH {_SQL_LINKS} SELECT source, count(*) AS n_competitors FROM links WHERE target <> '3' AND source NOT IN (SELECT source FROM links WHERE target = '3') GROUP BY source")
def link_gap(spark, sf):
    return S.link_gap(_links(spark, sf), "3")


@query(f"""WITH {A.SQL_RESULTS}, t AS (SELECT keyword, url FROM serp WHERE position <= 10)
SELECT a.keyword AS keyword_a, b.keyword AS keyword_b, count(*) AS shared_urls FROM t a JOIN t b ON a.url = b.url AND a.keyword < b.keyword GROUP BY 1, 2 HAVING count(*) >= 3""")
def serp_overlap_pairs(spark, sf):
    return S.overlap_pairs(A.results(spark, sf))


@query(f"""WITH {A.SQL_RESULTS}, t AS (SELECT * FROM serp WHERE position <= 10),
auth AS (SELECT 's' || s_suppkey::VARCHAR || '.com' AS domain, (s_suppkey % 100)::DOUBLE AS score FROM supplier WHERE s_suppkey % 3 <> 0),
g AS (SELECT keyword, count(*) FILTER (domain IN ('s1.com', 's2.com', 's3.com', 's4.com', 's5.com')) AS big_brands, count(*) AS homepages, count(DISTINCT domain) AS unique_domains, 0::BIGINT AS serp_features, count(*) FILTER (domain IN ('s8.com', 's9.com')) AS ugc_results, count(score) AS na, avg(score) AS av, min(score) AS mi FROM t LEFT JOIN auth USING (domain) GROUP BY keyword),
p AS (SELECT *, 12 + big_brands * 6.5::DOUBLE + homepages * 3.2::DOUBLE + (10 - unique_domains) * 1.5::DOUBLE - ugc_results * 4.5::DOUBLE AS plain FROM g)
SELECT keyword, big_brands, homepages, unique_domains, serp_features, ugc_results, {r('least(100, greatest(0, CASE WHEN na >= 3 THEN plain * 0.35::DOUBLE + av * 0.55::DOUBLE + mi * 0.1::DOUBLE ELSE plain END))', 1)} AS difficulty, CASE WHEN na >= 3 THEN 'serp+authority' ELSE 'serp' END AS method FROM p""")
def serp_difficulty(spark, sf):
    sup = A.table(spark, sf, "supplier").where("s_suppkey % 3 <> 0")
    auth = sup.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".com")).alias("domain"), (F.col("s_suppkey") % 100).cast("double").alias("score"))
    return K.serp_difficulty(A.results(spark, sf), None, auth, ["s1.com", "s2.com", "s3.com", "s4.com", "s5.com"], ["s8.com", "s9.com"])


# keywords


def _sql_intent(k: str) -> str:
    """DuckDB expression of the intent of a trimmed lower-case keyword expression over tokens ``w`` and folded text ``fo``."""
    def hits(name: str) -> str:
        single = [t for t in K.LISTS[name] if " " not in t]
        parts = [f"{n} * len(list_intersect(w, [{', '.join(repr(t) for t in sorted({t for t in single if single.count(t) == n}))}]))" for n in sorted({single.count(t) for t in single})]
        parts += [f"(CASE WHEN contains({k}, '{t}') OR contains(fo, '{t}') THEN 1 ELSE 0 END)" for t in K.LISTS[name] if " " in t]
        return " + ".join(parts)

    return ", ".join(f"{hits(n)} AS n_{n}" for n in K.LISTS)


_SQL_QUESTION = "(k LIKE '%?' OR starts_with(k, '¿') OR regexp_matches(k, '^(" + K.ENGLISH_OPENERS + ")([^A-Za-z0-9_]|$)') OR regexp_matches(k, '^(" + K.SPANISH_OPENERS.replace("(?:", "(") + ")([\\s?!.,]|$)'))"


@query(f"""WITH {A.SQL_LINES},
b AS (SELECT doc_id, trim(lower(keyword)) AS k, {T.sql_tokens('trim(lower(keyword))')} AS w FROM fl),
c AS (SELECT *, array_to_string(w, ' ') AS fo, {_SQL_QUESTION} AS q FROM b),
d AS (SELECT *, {_sql_intent('k')} FROM c),
e AS (SELECT *, n_transactional * 3.2::DOUBLE AS t, n_commercial * 2.4::DOUBLE AS c0, n_navigational * 2.6::DOUBLE AS v, (n_informational + q::INT) * 1.9::DOUBLE AS i FROM d),
f AS (SELECT *, CASE WHEN c0 > 0 AND i > 0 AND NOT q THEN c0 + 1.5::DOUBLE ELSE c0 END AS c FROM e),
g AS (SELECT *, greatest(t, c, v, i) AS best FROM f)
SELECT doc_id, q AS is_question,
  CASE WHEN best = 0 THEN CASE WHEN len(w) <= 2 THEN 'commercial' ELSE 'informational' END WHEN t = best THEN 'transactional' WHEN c = best THEN 'commercial' WHEN v = best THEN 'navigational' ELSE 'informational' END AS intent,
  CASE WHEN best = 0 THEN 0.3::DOUBLE ELSE {r('least(0.95::DOUBLE, 0.45::DOUBLE + best / (t + c + v + i) * 0.5::DOUBLE)', 2)} END AS confidence FROM g""")
def intent_classification(spark, sf):
    return K.classify_intent(A.first_lines(spark, sf)).select("doc_id", "is_question", "intent", "confidence")


_SQL_LEXICAL = f"""least(95, greatest(1, least(82, greatest(12, 78 - (words - 1) * 11))::DOUBLE
  + CASE WHEN regexp_matches(k, '\\b(best|top|cheapest|reviews?)\\b') THEN 9 ELSE 0 END + CASE WHEN regexp_matches(k, '\\b(software|tool|tools|app|platform|service)\\b') THEN 5 ELSE 0 END
  + CASE WHEN regexp_matches(k, '\\b(vs|versus|alternative|alternatives)\\b') THEN -6 ELSE 0 END + CASE WHEN regexp_matches(k, '^(what|why|how|when|where|who|can|does|is|are)\\b') THEN -8 ELSE 0 END
  + CASE WHEN regexp_matches(k, '\\b(near me|in \\w+)\\b') THEN -5 ELSE 0 END + CASE WHEN words >= 6 THEN -6 ELSE 0 END + CASE WHEN len({T.sql_content('keyword')}) = 1 THEN 8 ELSE 0 END))"""


@query(f"""WITH {A.SQL_KEYWORDS}, x AS (SELECT keyword, lower(keyword) AS k, len(string_split_regex(trim(keyword), '\\s+')) AS words FROM kw) SELECT keyword, {r(_SQL_LEXICAL, 1)} AS difficulty FROM x""")
def keyword_difficulty_lexical(spark, sf):
    return A.keywords(spark, sf).select("keyword", K.lexical_difficulty(F.col("keyword")).alias("difficulty"))


@query(f"""WITH {A.SQL_KEYWORDS}, x AS (SELECT *, CASE WHEN volume > 0 THEN greatest(0, floor(volume * 0.06::DOUBLE + 0.5::DOUBLE)::BIGINT) END AS up, 2 AS words FROM kw)
SELECT keyword, volume, {r('difficulty', 2)} AS difficulty, {r('''least(100, greatest(0, CASE WHEN volume > 0 THEN least(55, greatest(0, log10(up + 1) * 22)) ELSE 30 END
  + least(25, greatest(0, 25 * (1 - pow(difficulty / 100, 1.5)))) + least(20, greatest(0, 0.8::DOUBLE * 12 + least(1, greatest(0, log10(cpc + 1) / log10(21::DOUBLE))) * 8))))''', 1)} AS opportunity, up AS traffic_upside FROM x""")
def keyword_opportunity(spark, sf):
    k = A.keywords(spark, sf)
    cols = K.opportunity_columns(F.col("volume"), F.col("difficulty"), F.col("cpc"), F.lit("commercial"), K.word_count(F.col("keyword")))
    return k.select("keyword", "volume", js_round(F.col("difficulty"), 2).alias("difficulty"), cols["opportunity"].alias("opportunity"), cols["traffic_upside"].alias("traffic_upside"))


def _sql_modifiers() -> str:
    return ", ".join(f"('{m}', {str(front).lower()})" for _, m, front in K.modifier_rows(K.STRATEGIES, 2026))


@query(f"""SELECT DISTINCT seed, CASE WHEN m = '' THEN seed WHEN front THEN m || ' ' || seed ELSE seed || ' ' || m END AS query FROM (SELECT DISTINCT trim(lower(p_name)) AS seed FROM part), (VALUES {_sql_modifiers()}) v(m, front)""")
def keyword_expansion(spark, sf):
    return K.expand(A.table(spark, sf, "part").select(F.col("p_name").alias("seed")).distinct(), 2026)


@query(f"""WITH {A.SQL_KEYWORDS}, s AS (SELECT keyword, volume, difficulty, 'commercial' AS intent, string_split_regex(trim(lower(keyword)), '\\s+') AS w FROM kw),
b AS (SELECT keyword, volume, difficulty, i, w[i] AS entity, array_to_string(list_transform(w, lambda x, j: CASE WHEN j = i THEN '{{x}}' ELSE x END), ' ') AS template, len(w) AS n FROM s, generate_series(1, 8) g(i) WHERE i <= len(w) AND len(w) BETWEEN 2 AND 8 AND length(w[i]) >= 2),
g AS (SELECT template, count(DISTINCT entity) AS n_entities, count(*) AS match_count, coalesce(sum(volume), 0)::BIGINT AS total_volume, floor(avg(volume) + 0.5::DOUBLE)::BIGINT AS avg_volume, {r('avg(difficulty)', 1)} AS avg_difficulty, min(i) AS slot, min(n) AS n FROM b GROUP BY template HAVING count(DISTINCT entity) >= 4)
SELECT template, n_entities, match_count, total_volume, avg_volume, avg_difficulty, CASE WHEN slot = 1 THEN 'prefix' WHEN slot = n THEN 'suffix' ELSE 'middle' END AS slot_position,
  {r('least(100, least(40, log10(n_entities) * 26) + least(25, log10(avg_volume + 1) * 9) + greatest(0, least(22, 22 * (1 - avg_difficulty / 100))) + 8 + (n - 2) * 4)', 1)} AS viability FROM g""")
def pattern_discovery(spark, sf):
    return P.discover_patterns(A.keywords(spark, sf).withColumn("intent", F.lit("commercial"))).select("template", "n_entities", "match_count", "total_volume", "avg_volume", "avg_difficulty", "slot_position", "viability")


@query(f"WITH {A.SQL_KEYWORDS}, s AS (SELECT keyword, volume, string_split_regex(trim(lower(keyword)), '\\s+') AS w FROM kw) SELECT keyword, w[2] AS entity, volume FROM s WHERE len(w) = 2 AND w[1] = 'blue'")
def entity_match(spark, sf):
    return P.match_entities(A.keywords(spark, sf), "blue {x}").select("keyword", "entity", "volume")


@query(f"""WITH {A.SQL_KEYWORDS}, p AS (SELECT '/' || replace(keyword, ' ', '-') AS url FROM kw), n AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS i, count(*) OVER () AS t FROM p)
SELECT a.url, b.url AS target, step::INT AS step FROM n a, generate_series(1, 4) g(step) JOIN n b ON b.i = (a.i + step) % a.t WHERE a.url <> b.url""")
def plan_link_mesh(spark, sf):
    return P.link_mesh(A.keywords(spark, sf).select(F.concat(F.lit("/"), F.regexp_replace("keyword", " ", "-")).alias("url")), ["url"])


@query(f"WITH {A.SQL_KEYWORDS} SELECT coalesce(sum(floor(volume * {sql_ctr('pos')} + 0.5::DOUBLE)), 0)::BIGINT AS clicks, {r('coalesce(sum(floor(volume * ' + sql_ctr('pos') + ' + 0.5::DOUBLE) * cpc), 0)', 2)} AS value FROM (SELECT volume, cpc, (length(keyword) % 30 + 1)::DOUBLE AS pos FROM kw) WHERE volume IS NOT NULL")
def traffic_value(spark, sf):
    return K.traffic_value(A.keywords(spark, sf).withColumn("position", (F.length("keyword") % 30 + 1).cast("double")))


@query(f"""WITH {A.SQL_KEYWORDS}, o AS (SELECT keyword, volume, difficulty, cpc, 'commercial' AS intent, 'seed' AS source FROM kw WHERE length(keyword) % 3 <> 0),
n AS (SELECT keyword, CASE WHEN length(keyword) % 2 = 0 THEN volume + 1 END AS volume, NULL::DOUBLE AS difficulty, cpc, 'informational' AS intent, 'expanded' AS source FROM kw WHERE length(keyword) % 4 <> 0)
SELECT coalesce(o.keyword, n.keyword) AS keyword, coalesce(n.volume, o.volume) AS volume, {r('coalesce(n.difficulty, o.difficulty)', 4)} AS difficulty, {r('coalesce(n.cpc, o.cpc)', 4)} AS cpc, coalesce(n.intent, o.intent) AS intent, coalesce(o.source, n.source) AS source FROM o FULL OUTER JOIN n ON o.keyword = n.keyword""")
def keyword_upsert(spark, sf):
    k, n = A.keywords(spark, sf), F.length("keyword")
    old = k.where(n % 3 != 0).select("keyword", "volume", "difficulty", "cpc", F.lit("commercial").alias("intent"), F.lit("seed").alias("source"))
    new = k.where(n % 4 != 0).select("keyword", F.when(n % 2 == 0, F.col("volume") + 1).alias("volume"), F.lit(None).cast("double").alias("difficulty"), "cpc", F.lit("informational").alias("intent"), F.lit("expanded").alias("source"))
    return R.upsert_keywords(old, new).withColumns({c: js_round(F.col(c), 4) for c in ("difficulty", "cpc")})


@query(f"""WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS v FROM orders GROUP BY 1, 2),
x AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY m) AS i, count(*) OVER (PARTITION BY p) AS n FROM m),
g AS (SELECT p, max(n) AS points, avg(v) FILTER (i <= greatest(1, n // 4)) AS a, avg(v) FILTER (i > n - greatest(1, n // 4)) AS b FROM x GROUP BY p)
SELECT p AS priority, points, CASE WHEN points >= 6 THEN {r('(b - a) / a * 100', 1)} END AS trend_pct FROM g""")
def trend_12m(spark, sf):
    m = A.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("m")).agg(F.count("*").alias("v"))
    return R.trend(m, ["priority"], "m", "v")


# texts


@query(f"""WITH t AS (SELECT doc_id, {T.sql_tokens('text')} AS w, {T.sql_stems('text')} AS s FROM documents)
SELECT doc_id, len(w)::INT AS n_tokens, len(s)::INT AS n_content, len(list_distinct(s))::INT AS n_stems, md5(array_to_string(s, ' ')) AS stems_md5 FROM t""")
def tokenize_stats(spark, sf):
    return A.texts(spark, sf, "documents").select("doc_id", token_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


_SQL_READABILITY = f"""WITH d AS (
  SELECT doc_id, starts_with(lower(coalesce(lang, '')), 'es') AS es, {T.sql_tokens('text')} AS w,
    list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?]["''”’»)\\]]?)\\s+([\\p{{Lu}}\\p{{Lt}}"''(¿¡«“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
e AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '[^a-z]', '', 'g')) AS v FROM d),
f AS (SELECT doc_id, es, len(w)::INT AS words, greatest(len(s), 1)::INT AS sentences, len(list_filter(s, lambda x: len({T.sql_tokens('x')}) > 30))::INT AS long_sentences,
  coalesce(list_sum(list_transform(v, lambda x: CASE WHEN length(x) = 0 THEN 0 WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(CASE WHEN es THEN x ELSE regexp_replace(regexp_replace(x, '([^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', '') END, '[aeiouy]{{1,2}}'))) END)), 0) AS syl FROM e),
g AS (SELECT *, words::DOUBLE / sentences AS wps, CASE WHEN words > 0 THEN syl::DOUBLE / words ELSE 0::DOUBLE END AS spw FROM f)
SELECT doc_id, words, sentences, {r('wps', 1)} AS avg_words, {r('spw', 2)} AS avg_syllables, CASE WHEN es THEN {r('206.84::DOUBLE - wps * 1.02::DOUBLE - spw * 60::DOUBLE', 1)} ELSE {r('206.835::DOUBLE - wps * 1.015::DOUBLE - spw * 84.6::DOUBLE', 1)} END AS reading_ease,
  CASE WHEN NOT es THEN {r('wps * 0.39::DOUBLE + spw * 11.8::DOUBLE - 15.59::DOUBLE', 1)} END AS grade_level, long_sentences FROM g"""


@query(_SQL_READABILITY)
def readability(spark, sf):
    return content.readability(A.texts(spark, sf, "documents"))


_SQL_TERMS = f"""d AS (SELECT doc_id, {T.sql_content('text')} AS w FROM documents),
g AS (SELECT doc_id, len(w) AS total, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i + 1], ' ')) || list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) AS term FROM d),
c AS (SELECT doc_id, term, count(*) AS n, {r('count(*)::DOUBLE / max(total) * 1000 * (1 + (len(string_split(term, chr(32))) - 1) * 0.6::DOUBLE)', 3)} AS score FROM g GROUP BY 1, 2 HAVING count(*) >= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS k FROM c)"""


@query(f"WITH {_SQL_TERMS} SELECT doc_id, term, n, score FROM ranked WHERE k <= 40")
def doc_terms_topk(spark, sf):
    return content.terms(A.texts(spark, sf, "documents"), 40).drop("rank")


@query(f"""WITH {_SQL_TERMS},
st AS (SELECT doc_id, term, n, k, array_to_string({T.sql_stems('term')}, ' ') AS key FROM ranked WHERE k <= 120),
one AS (SELECT doc_id, arg_min(term, k) AS term, arg_min(n, k) AS n FROM st WHERE key <> '' GROUP BY doc_id, key),
need AS (SELECT lang, greatest(2, ceil(count(*) * 0.5::DOUBLE)) AS need FROM documents GROUP BY lang),
t AS (SELECT lang, term, count(*) AS document_frequency, {r('avg(n)', 1)} AS avg_count FROM one JOIN documents USING (doc_id) GROUP BY 1, 2)
SELECT lang, term, document_frequency, avg_count FROM (SELECT t.*, row_number() OVER (PARTITION BY lang ORDER BY document_frequency DESC, avg_count DESC, term) AS i FROM t JOIN need USING (lang) WHERE document_frequency >= need) WHERE i <= 40""")
def competitive_terms(spark, sf):
    return content.competitive_terms(A.texts(spark, sf, "documents"), "lang")


@query(f"""WITH s AS (SELECT list_distinct({T.sql_stems('text')}) AS t FROM documents), k AS (SELECT t FROM s WHERE len(t) > 0), n AS (SELECT count(*) AS n FROM k), x AS (SELECT unnest(t) AS token FROM k)
SELECT token, count(*) AS df, {r('ln(max(n)::DOUBLE / count(*))', 6)} AS idf, count(*) >= max(n) * 0.6::DOUBLE AS background FROM x, n GROUP BY token""")
def idf_background(spark, sf):
    return content.idf(A.texts(spark, sf, "documents")).withColumn("idf", js_round(F.col("idf"), 6))


@query(f"""WITH s AS (SELECT doc_id, list_distinct({T.sql_stems('text')}) AS t FROM documents), n AS (SELECT count(*) AS n FROM s), x AS (SELECT doc_id, unnest(t) AS token FROM s), f AS (SELECT token, count(*) AS df FROM x GROUP BY 1),
e AS (SELECT doc_id, avg((df < n * 0.8::DOUBLE)::INT) AS u FROM x JOIN f USING (token), n GROUP BY doc_id)
SELECT max(n) AS documents, {r('sum(u) / max(n) * 100', 1)} AS uniqueness FROM e, n""")
def vocab_uniqueness(spark, sf):
    return content.vocabulary_uniqueness(A.texts(spark, sf, "documents"))


def _sql_pairs(source: str, threshold: float, least: int) -> str:
    """``c``: ids, token sets and classes of equal sets of ``source(id, text)``; ``p``: similar pairs of classes."""
    return f"""c AS MATERIALIZED (SELECT id, t, min(id) OVER (PARTITION BY t) AS class FROM (SELECT id, list_sort(list_distinct({T.sql_stems('text')})) AS t FROM ({source}) WHERE len({T.sql_tokens('text')}) >= {least})),
x AS MATERIALIZED (SELECT DISTINCT class, len(t) AS n, unnest(t) AS token FROM c WHERE id = class),
p AS MATERIALIZED (SELECT a, b, o::DOUBLE / (na + nb - o) AS similarity FROM (SELECT a.class AS a, b.class AS b, count(*) AS o, max(a.n) AS na, max(b.n) AS nb FROM x a JOIN x b ON a.token = b.token AND a.class < b.class GROUP BY 1, 2) WHERE o::DOUBLE / (na + nb - o) >= {threshold})"""


def _sql_clusters(source: str, threshold: float, least: int = 50) -> str:
    """And ``clusters``: the scan that makes each unclaimed node a leader which claims its later neighbours, node by node.  Needs RECURSIVE."""
    return f"""{_sql_pairs(source, threshold, least)},
nodes_in_order AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i, (SELECT list(a) FROM p WHERE b = id) AS earlier FROM (SELECT a AS id FROM p UNION SELECT b FROM p)),
scan(i, lead) AS (SELECT 0::BIGINT, [(SELECT min(id) FROM c)][:0] UNION ALL SELECT n.i, CASE WHEN list_has_any(lead, coalesce(earlier, [])) THEN lead ELSE list_append(lead, id) END FROM scan s JOIN nodes_in_order n ON n.i = s.i + 1),
lead AS MATERIALIZED (SELECT unnest(arg_max(lead, i)) AS id FROM scan),
led AS (SELECT n.id AS class, CASE WHEN n.id IN (SELECT id FROM lead) THEN n.id ELSE (SELECT min(a) FROM p WHERE b = n.id AND a IN (SELECT id FROM lead)) END AS leader FROM nodes_in_order n),
member AS MATERIALIZED (SELECT c.id, coalesce(leader, class) AS leader, CASE WHEN coalesce(leader, class) = class THEN 1::DOUBLE ELSE similarity END AS similarity FROM c LEFT JOIN led USING (class) LEFT JOIN p ON a = leader AND b = class),
clusters AS MATERIALIZED (SELECT id, leader, size, floor(s * 1000 + 0.5::DOUBLE) / 1000 AS similarity FROM member JOIN (SELECT leader, count(*) AS size, max(similarity) FILTER (id <> leader) AS s FROM member GROUP BY leader HAVING count(*) >= 2) USING (leader))"""


_SQL_DOCS = "SELECT doc_id AS id, text FROM documents"


@query(f"""WITH {_sql_pairs(_SQL_DOCS, 0.85, 50)}
SELECT a, b, {r('similarity', 6)} AS similarity, 'pair' AS kind FROM p UNION ALL SELECT class, id, 1, 'copy' FROM c WHERE id <> class""")
def near_dup_pairs(spark, sf):
    """Pairs of class representatives, and the members of the classes."""
    sets = N.packed_sets(A.texts(spark, sf, "documents"))
    pairs = N.class_pairs(sets, 0.85)[1].select("a", "b", js_round(F.col("similarity"), 6).alias("similarity"), F.lit("pair").alias("kind"))
    return pairs.unionByName(sets.where("doc_id <> class").select(F.col("class").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"), F.lit("copy").alias("kind")))


@query(f"WITH RECURSIVE {_sql_clusters(_SQL_DOCS, 0.85)} SELECT id AS doc_id, leader, size, similarity FROM clusters")
def near_dup_clusters(spark, sf):
    return N.near_dup_clusters(A.texts(spark, sf, "documents").select("doc_id", "text"))


@query(f"""WITH RECURSIVE {_sql_clusters(_SQL_DOCS, 0.75, 40)},
d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, source, {T.sql_content('text')} AS w, list_distinct({T.sql_stems('text')}) AS t FROM documents),
z AS (SELECT count(*) AS pages, count(*) FILTER (len(w) < 300) AS thin_pages, (SELECT count(*) FROM clusters) AS clustered, (SELECT count(DISTINCT leader) FROM clusters) AS clusters,
  (SELECT count(*) FROM (SELECT lower(trim(title, ' ')) AS k FROM d GROUP BY 1 HAVING count(*) > 1 AND k <> '')) AS duplicate_titles, (SELECT count(*) FROM (SELECT lower(trim(source, ' ')) AS k FROM d GROUP BY 1 HAVING count(*) > 1 AND k <> '')) AS duplicate_meta_descriptions FROM d),
xs AS (SELECT doc_id, unnest(t) AS token FROM d), df AS (SELECT token, count(*) AS df FROM xs GROUP BY 1),
u AS (SELECT doc_id, avg((df < pages * 0.8::DOUBLE)::INT) AS u FROM xs JOIN df USING (token), z GROUP BY 1),
y AS (SELECT z.*, {r('(SELECT coalesce(sum(u), 0) FROM u) / pages * 100', 1)} AS uniqueness FROM z),
k AS (SELECT *, {r('least(100, greatest(0, thin_pages::DOUBLE / pages * 45 + clustered::DOUBLE / pages * 50 + duplicate_titles::DOUBLE / pages * 25 + least(35, greatest(0, (80 - uniqueness) * 0.9::DOUBLE)) + CASE WHEN pages > 200 AND (thin_pages > pages * 0.2::DOUBLE OR clustered > pages * 0.2::DOUBLE) THEN 12 ELSE 0 END))', 1)} AS risk_score FROM y)
SELECT *, CASE WHEN risk_score >= 55 THEN 'do_not_publish' WHEN risk_score >= 28 THEN 'risky' ELSE 'safe' END AS verdict FROM k""")
def index_risk_summary(spark, sf):
    d = A.texts(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "text", F.col("source").alias("meta_description"))
    return content.index_risk(d)


# pages


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(A.texts(spark, sf, "pages").select("url", "html"))


@query("""WITH p AS (SELECT url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)
SELECT url, strlen(html)::BIGINT AS bytes, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<h1>'))::INT AS n_h1 FROM p""")
def page_extract(spark, sf):
    return _pages(spark, sf).select("url", "bytes", "lang", F.size("h1").alias("n_h1"))


@query("SELECT count(*) AS pages, sum(len(list_distinct(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>'))))::BIGINT AS links FROM pages")
def page_links(spark, sf):
    return _pages(spark, sf).agg(F.count("*").alias("pages"), F.sum(F.size("links")).cast("bigint").alias("links"))


@query("""WITH p AS (SELECT url, lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'))) AS k FROM pages)
SELECT k AS key, count(*) AS n FROM p WHERE k <> '' GROUP BY k HAVING count(*) > 1""")
def dup_titles(spark, sf):
    title = F.lower(F.trim(F.regexp_replace(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), r"\s+", " ")))
    return content.duplicate_groups(A.texts(spark, sf, "pages").select(title.alias("title")), "title")


def _audit(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The findings of all rules, and the pages."""
    p = N.checkpointed(_pages(spark, sf))
    return audit.run_audit(audit.Crawl(p, origin="https://example.com")), p


_SQL_AUDIT = f"""pg AS (SELECT url, strlen(html)::BIGINT AS bytes, regexp_replace(regexp_replace(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')), '&amp;', '&', 'g'), '&lt;', '<', 'g') AS title,
  trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS h1,
  replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', '', 'g'), '&amp;', '&') AS art,
  replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<nav>.*?</nav>|<footer>.*?(</footer>|$)|<!--.*?-->', '', 'g'), '(?s)<script>.*?</script>', '', 'g'), '<[^>]*>', '', 'g'), '&amp;', '&') AS bod FROM pages),
tx AS (SELECT *, CASE WHEN len({T.sql_tokens('art')}) >= 50 THEN trim(art) ELSE trim(bod) END AS text FROM pg),
wc AS MATERIALIZED (SELECT *, len({T.sql_tokens('text')}) AS words, length(title) AS tl FROM tx),
{_sql_clusters('SELECT url AS id, text FROM wc WHERE words >= 100', 0.85)},
iss AS (
  SELECT 'canonical.missing' AS rule, 'warning' AS severity, url FROM wc UNION ALL SELECT 'meta_description.missing', 'warning', url FROM wc UNION ALL SELECT 'social.missing_og', 'notice', url FROM wc
  UNION ALL SELECT 'title.missing', 'error', url FROM wc WHERE title = '' UNION ALL SELECT 'title.too_long', 'warning', url FROM wc WHERE tl > 60 UNION ALL SELECT 'title.too_short', 'notice', url FROM wc WHERE tl BETWEEN 1 AND 19
  UNION ALL SELECT 'content.thin', CASE WHEN words < 100 THEN 'error' ELSE 'warning' END, url FROM wc WHERE words BETWEEN 1 AND 299 UNION ALL SELECT 'content.empty', 'error', url FROM wc WHERE words = 0
  UNION ALL SELECT 'content.low_text_ratio', 'notice', url FROM wc WHERE bytes >= 20000 AND words > 0 AND length(text)::DOUBLE / bytes < 0.08 UNION ALL SELECT 'schema.missing', 'notice', url FROM wc WHERE words > 200
  UNION ALL SELECT 'title.duplicate', 'error', url FROM (SELECT url, title, count(*) OVER (PARTITION BY lower(title)) AS n FROM wc) WHERE n > 1 AND title <> ''
  UNION ALL SELECT 'h1.duplicate', 'warning', url FROM (SELECT url, h1, count(*) OVER (PARTITION BY lower(h1)) AS n FROM wc) WHERE n > 1 AND h1 <> ''
  UNION ALL SELECT 'content.duplicate', 'error', id FROM clusters
  UNION ALL SELECT 'sitemap.missing', 'warning', 'https://example.com')"""


@query(f"WITH RECURSIVE {_SQL_AUDIT} SELECT rule, severity, url FROM iss")
def audit_issues(spark, sf):
    return _audit(spark, sf)[0].select("rule", "severity", "url")


@query(f"WITH RECURSIVE {_SQL_AUDIT}, w AS (SELECT *, CASE severity WHEN 'error' THEN 10 WHEN 'warning' THEN 3 ELSE 1 END AS k FROM iss) SELECT rule, arg_max(severity, k) AS severity, count(*) AS n FROM w GROUP BY rule")
def audit_by_rule(spark, sf):
    return audit.by_rule(_audit(spark, sf)[0])


@query(f"""WITH RECURSIVE {_SQL_AUDIT}, s AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'notice') AS n, count(*) FILTER (rule = 'sitemap.missing') AS site, (SELECT count(*) FROM pages) AS p FROM iss)
SELECT p AS pages, e AS errors, w AS warnings, n AS notices, {r('least(100, greatest(0, exp(-(greatest(0, e * 10 + w * 3 + least(n, greatest(p, 8) * 2.5::DOUBLE) - site * 3) / greatest(p, 8)) / 8.5::DOUBLE) * 100 - site * 4))', 1)} AS health_score FROM s""")
def health_score(spark, sf):
    return audit.health_score(*_audit(spark, sf))


@query()
def audit_actions(spark, sf):
    return audit.issues_to_actions(*_audit(spark, sf)).withColumn("score", action_score())


@query(f"""WITH p AS (SELECT o_orderkey, CASE o_orderpriority[1:1] WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority, (o_orderkey % 101)::DOUBLE AS impact, CASE o_orderkey % 4 WHEN 0 THEN 'trivial' WHEN 1 THEN 'small' WHEN 2 THEN 'medium' ELSE 'large' END AS effort FROM orders)
SELECT o_orderkey AS id, priority, effort, {r("(CASE priority WHEN 'critical' THEN 1000 WHEN 'high' THEN 500 WHEN 'medium' THEN 200 ELSE 50 END + impact) / CASE effort WHEN 'trivial' THEN 1::DOUBLE WHEN 'small' THEN 1.4::DOUBLE WHEN 'medium' THEN 2.2::DOUBLE ELSE 4::DOUBLE END", 6)} AS score FROM p""")
def action_ranking(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    pick = lambda c, names: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    rows = A.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").otherwise("low").alias("priority"),
        pick(F.col("o_orderkey") % 4, ("trivial", "small", "medium", "large")).alias("effort"), (F.col("o_orderkey") % 101).cast("double").alias("impact_score"),
    )
    return rows.select("id", "priority", "effort", js_round(action_score(), 6).alias("score"))


_DROP = ", ".join(f"'{x}'" for x in sorted(U.TRACKING))


@query(f"""WITH p AS (SELECT page_id, url, string_split(regexp_replace(url, '#.*$', ''), '?') AS x FROM pages),
q AS (SELECT page_id, url, x[1] AS base, list_sort(list_filter(string_split(coalesce(x[2], ''), '&'), lambda y: y <> '' AND lower(string_split(y, '=')[1]) NOT IN ({_DROP}))) AS l FROM p)
SELECT page_id, base || CASE WHEN len(l) > 0 THEN '?' || array_to_string(l, '&') ELSE '' END AS normalized, regexp_replace(regexp_replace(url, '#.*$', ''), '/+(\\?|$)', '\\1') AS slash_key FROM q""")
def url_normalize(spark, sf):
    return A.texts(spark, sf, "pages").select("page_id", U.normalize_url(F.col("url"), F.lit(None).cast("string")).alias("normalized"), U.slash_key(F.col("url")).alias("slash_key"))


@query("""WITH p AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS host FROM pages)
SELECT page_id, host, array_to_string(string_split(regexp_replace(host, '^www\\.', ''), '.')[-2:], '.') AS domain FROM p""")
def registrable_domain(spark, sf):
    host = U.hostname(F.col("url"))
    return A.texts(spark, sf, "pages").select("page_id", host.alias("host"), U.registrable_domain(host).alias("domain"))


@query(f"WITH {A.SQL_GRAPH} SELECT dst AS url, count(*) AS inbound FROM edges GROUP BY dst")
def inbound_links(spark, sf):
    return A.graph(spark, sf)[1].groupBy(F.col("dst").alias("url")).agg(F.count("*").alias("inbound"))


def _sql_pagerank(n: int = 40) -> str:
    steps = ["r0 AS (SELECT node, 1::DOUBLE / (SELECT count(*) FROM nodes) AS r FROM nodes)"]
    for k in range(n):
        steps.append(f"""g{k + 1} AS (SELECT dst AS node, sum(r / d) AS g FROM inside JOIN r{k} ON node = src JOIN deg USING (src) GROUP BY dst),
r{k + 1} AS (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * coalesce((SELECT sum(r) FROM r{k} WHERE node NOT IN (SELECT src FROM deg)), 0) / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * coalesce(g, 0) AS r FROM nodes n LEFT JOIN g{k + 1} USING (node))""")
    return f"WITH {A.SQL_GRAPH}, inside AS MATERIALIZED (SELECT src, dst FROM edges WHERE dst IN (SELECT node FROM nodes)), deg AS (SELECT src, count(*) AS d FROM inside GROUP BY src), {', '.join(s.replace(' AS (', ' AS MATERIALIZED (', 1) for s in steps)} SELECT node, {r(f'r / (SELECT max(r) FROM r{n}) * 100', 2)} AS page_rank FROM r{n}"


@query(_sql_pagerank())
def pagerank(spark, sf):
    return linkgraph.pagerank(*A.graph(spark, sf))


@query(f"""WITH {A.SQL_GRAPH}, i AS (SELECT dst AS node, count(*) AS c FROM edges GROUP BY 1), o AS (SELECT src AS node, count(*) AS c FROM edges GROUP BY 1)
SELECT node, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree FROM nodes LEFT JOIN i USING (node) LEFT JOIN o USING (node)""")
def degree_report(spark, sf):
    return linkgraph.degrees(*A.graph(spark, sf))


# crawl diffs: the pages of even ids, and all but every fifth with changes


def _crawls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = A.texts(spark, sf, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.length("html").alias("n"))
    row = lambda title, words: [F.col("url"), F.lit(200).alias("status"), title.alias("title"), F.lit(None).cast("string").alias("meta_description"), F.lit(True).alias("indexable"), words.alias("word_count"), F.lit(1).alias("depth"), F.lit(3).alias("internal_links_in"), F.lit(0).cast("bigint").alias("simhash")]
    i = F.col("page_id")
    before = p.where(i % 2 == 0).select(*row(F.col("title"), F.col("n")))
    after = p.where(i % 5 != 0).select(*row(F.when(i % 3 == 0, "changed").otherwise(F.col("title")), F.col("n") + F.when(i % 7 == 0, 10_000).otherwise(20)))
    return before, after


_SQL_CRAWLS = """p AS (SELECT page_id AS i, url || '#' || page_id::VARCHAR AS url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n FROM pages),
b AS (SELECT url, title, n FROM p WHERE i % 2 = 0), a AS (SELECT url, CASE WHEN i % 3 = 0 THEN 'changed' ELSE title END AS title, n + CASE WHEN i % 7 = 0 THEN 10000 ELSE 20 END AS n FROM p WHERE i % 5 <> 0)"""


@query(f"""WITH {_SQL_CRAWLS}, j AS (SELECT coalesce(a.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'added' WHEN a.url IS NULL THEN 'removed' ELSE 'changed' END AS kind, a.title IS DISTINCT FROM b.title AS t, abs(a.n - b.n) > greatest(30, b.n * 0.1::DOUBLE) AS w FROM b FULL OUTER JOIN a ON a.url = b.url)
SELECT url, kind, CASE WHEN kind <> 'changed' THEN '' WHEN t AND w THEN 'title,word_count' WHEN t THEN 'title' ELSE 'word_count' END AS fields FROM j WHERE kind <> 'changed' OR t OR w""")
def crawl_diff_pages(spark, sf):
    return crawldiff.diff_pages(*_crawls(spark, sf)).withColumn("fields", F.array_join("fields", ","))


def _issues(pages: DataFrame) -> DataFrame:
    n = F.length("title")
    return pages.select(F.when(n > 60, "title.too_long").when(n < 20, "title.too_short").alias("rule"), F.when(n > 60, "warning").otherwise("notice").alias("severity"), "url").where("rule is not null")


_SQL_ISSUES = _SQL_CRAWLS + """, ib AS (SELECT CASE WHEN length(title) > 60 THEN 'title.too_long' ELSE 'title.too_short' END AS rule, CASE WHEN length(title) > 60 THEN 'warning' ELSE 'notice' END AS severity, url FROM b WHERE length(title) > 60 OR length(title) < 20),
ia AS (SELECT CASE WHEN length(title) > 60 THEN 'title.too_long' ELSE 'title.too_short' END AS rule, CASE WHEN length(title) > 60 THEN 'warning' ELSE 'notice' END AS severity, url FROM a WHERE length(title) > 60 OR length(title) < 20)"""


@query(f"""WITH {_SQL_ISSUES} SELECT rule, url, severity, 'new' AS kind FROM ia WHERE NOT EXISTS (SELECT 1 FROM ib WHERE ib.rule = ia.rule AND ib.url = ia.url)
UNION ALL SELECT rule, url, severity, 'resolved' FROM ib WHERE NOT EXISTS (SELECT 1 FROM ia WHERE ib.rule = ia.rule AND ib.url = ia.url)""")
def crawl_diff_issues(spark, sf):
    before, after = _crawls(spark, sf)
    return crawldiff.diff_issues(_issues(before), _issues(after))


@query(f"""WITH {_SQL_ISSUES}, u AS (SELECT rule, 1 AS x, 0 AS y FROM ib UNION ALL SELECT rule, 0, 1 FROM ia)
SELECT rule, sum(x)::BIGINT AS before, sum(y)::BIGINT AS after, (sum(y) - sum(x))::BIGINT AS delta FROM u GROUP BY rule HAVING sum(x) <> sum(y)""")
def crawl_diff_rule_delta(spark, sf):
    before, after = _crawls(spark, sf)
    return crawldiff.rule_delta(_issues(before), _issues(after))


# answers

_BRAND, _OTHERS = "the", ["and", "of", "with"]


def _mentions(spark: SparkSession, sf: str) -> DataFrame:
    return V.mentions(A.table(spark, sf, "conversations").where("role = 'assistant'"), _BRAND, _OTHERS)


_SQL_MENTIONS = """m AS (SELECT conv_id, turn, t, regexp_matches(l, '\\bthe\\b') AS b, strpos(regexp_replace(' ' || l, '\\bthe\\b', chr(1)), chr(1)) - 2 AS pos, regexp_matches(l, '\\band\\b') AS c1, regexp_matches(l, '\\bof\\b') AS c2, regexp_matches(l, '\\bwith\\b') AS c3
  FROM (SELECT conv_id, turn, coalesce(text, '') AS t, lower(coalesce(text, '')) AS l FROM conversations WHERE role = 'assistant'))"""


@query(f"""WITH {_SQL_MENTIONS} SELECT conv_id, turn, b AS brand_mentioned, CASE WHEN b THEN {r('pos::DOUBLE / greatest(length(t), 1)', 3)} END AS mention_position, (c1::INT + c2::INT + c3::INT)::INT AS n_competitors FROM m""")
def mention_analysis(spark, sf):
    return _mentions(spark, sf).select("conv_id", "turn", "brand_mentioned", "mention_position", F.size("competitors_mentioned").alias("n_competitors"))


@query(f"""WITH {_SQL_MENTIONS}, c AS (SELECT 'and' AS name FROM m WHERE c1 UNION ALL SELECT 'of' FROM m WHERE c2 UNION ALL SELECT 'with' FROM m WHERE c3)
SELECT name, count(*) AS mentions, {r('count(*)::DOUBLE / ((SELECT count(*) FROM c) + (SELECT count(*) FROM m WHERE b)) * 100', 1)} AS share_pct FROM c GROUP BY name""")
def share_of_voice(spark, sf):
    return V.share_of_voice(_mentions(spark, sf))
