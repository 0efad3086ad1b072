"""Keyword intent, difficulty, opportunity, expansion and suggestion ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webloom.functions.mathx import clamp, estimate_clicks, js_round
from webloom.functions.text import content_tokens, tokens

# Terms that signal an intent, one list per intent; terms of several words are parted by commas.
TRANSACTIONAL = """buy,purchase,order,checkout,coupon,discount,deal,deals,promo,cheap,cheapest,price,pricing,cost,quote,subscribe,signup,
sign up,free trial,download,install,hire,book,booking,shop,for sale,near me,delivery,shipping,comprar,compra,precio,precios,coste,costo,
cuesta,oferta,ofertas,descuento,barato,baratos,gratis,contratar,pedir,reservar,presupuesto,suscribirse,descargar,instalar,envio,en venta,
cerca de mi,cuanto sale,cuanto salen,cuotas,en cuotas,sin interes,mercado pago,envio gratis,conviene comprar,precio en pesos,comprar online"""
COMMERCIAL = """best,top,review,reviews,compare,comparison,vs,versus,alternative,alternatives,competitor,competitors,software,tool,tools,app,
apps,platform,service,services,agency,vendor,provider,solution,solutions,recommended,rated,ranking,which,worth it,pros and cons,features,
plans,mejor,mejores,comparar,comparativa,comparacion,alternativa,alternativas,opiniones,resenas,valoraciones,herramienta,herramientas,
programa,programas,plataforma,servicio,servicios,proveedor,proveedores,solucion,soluciones,caracteristicas,funciones,planes,
merece la pena,conviene,cual conviene,vale la pena,recomendados,recomendado,comparativa precios,mejor opcion"""
INFORMATIONAL = """what,why,how,when,where,who,guide,tutorial,learn,course,meaning,definition,define,example,examples,ideas,tips,checklist,
template,templates,explained,explain,benefits,types,difference,statistics,stats,trends,history,does,do,is,are,can,guia,tutorial,aprender,
curso,significado,definicion,ejemplo,ejemplos,ideas,consejos,plantilla,plantillas,explicado,ventajas,beneficios,tipos,diferencia,diferencias,
estadisticas,tendencias,historia,para que sirve,que es,como funciona,como hago,que tal,monotributo,factura electronica,como se hace,
paso a paso,requisitos"""
NAVIGATIONAL = """login,log in,sign in,signin,dashboard,portal,account,app,download app,careers,contact,support,status,docs,documentation,api,
iniciar sesion,acceder,acceso,cuenta,contacto,soporte,ayuda,panel,documentacion,mercado libre,afip,mi afip,homebanking"""
INTENT_WEIGHTS = {"transactional": 3.2, "commercial": 2.4, "navigational": 2.6, "informational": 1.9}
INTENT_VALUES = {"transactional": 1.0, "commercial": 0.8, "navigational": 0.35, "informational": 0.3}
ENGLISH_OPENERS = "what|why|how|when|where|who|which|can|could|should|would|will|does|do|did|is|are|was|were|has|have"
SPANISH_OPENERS = "para qu[eé]|por qu[eé]|cu[aá]nto cuesta|cu[aá]nto sale[n]?|c[oó]mo hago|d[oó]nde consigo|se puede|conviene|qu[eé]|c[oó]mo|cu[aá]ndo|d[oó]nde|qui[eé]n|cu[aá]l(?:es)?|cu[aá]nt[oa]s?|puedo"

LISTS = {name: [t.strip() for t in text.replace("\n", "").split(",")] for name, text in (("transactional", TRANSACTIONAL), ("commercial", COMMERCIAL), ("informational", INFORMATIONAL), ("navigational", NAVIGATIONAL))}


def is_question(keyword: Column) -> Column:
    k = F.trim(F.lower(keyword))
    return F.endswith(k, F.lit("?")) | F.startswith(k, F.lit("¿")) | k.rlike(f"^(?:{ENGLISH_OPENERS})(?![A-Za-z0-9_])") | k.rlike(f"^(?:{SPANISH_OPENERS})(?=[\\s?!.,]|$)")


def _hits(terms: list[str], keyword: Column, words: Column, folded: Column) -> Column:
    """How many list entries match; an entry that stands twice counts twice."""
    total = F.lit(0)
    single = [t for t in terms if " " not in t]
    for n in sorted({single.count(t) for t in single}):
        own = sorted({t for t in single if single.count(t) == n})
        total = total + F.size(F.array_intersect(words, F.array(*map(F.lit, own)))) * n
    for t in (t for t in terms if " " in t):
        total = total + (F.contains(keyword, F.lit(t)) | F.contains(folded, F.lit(t))).cast("int")
    return total


def intent_columns(keyword: Column, brands: tuple[str, ...] = ()) -> dict[str, Column]:
    """intent, confidence and intent_value of a keyword."""
    k = F.trim(F.lower(keyword))
    words = tokens(k)
    folded = F.array_join(words, " ")
    question = is_question(keyword)
    n = {name: _hits(terms, k, words, folded) for name, terms in LISTS.items()}
    n["informational"] = n["informational"] + question.cast("int")
    score = {name: n[name] * F.lit(w) for name, w in INTENT_WEIGHTS.items()}
    score["commercial"] = F.when((score["commercial"] > 0) & (score["informational"] > 0) & ~question, score["commercial"] + 1.5).otherwise(score["commercial"])
    best = F.greatest(*score.values())
    named = F.lit(None).cast("string")
    for name in reversed(INTENT_WEIGHTS):
        named = F.when(score[name] == best, F.lit(name)).otherwise(named)
    none = best == 0
    short = F.size(words) <= 2
    total = sum(score.values(), F.lit(0.0))
    intent = F.when(none, F.when(short, "commercial").otherwise("informational")).otherwise(named)
    confidence = F.when(none, 0.3).otherwise(js_round(F.least(F.lit(0.95), 0.45 + best / F.greatest(total, F.lit(1e-9)) * 0.5), 2))
    value = F.when(none, F.when(short, 0.6).otherwise(0.3)).otherwise(intent_value(intent))
    for b in (b.strip().lower() for b in brands):
        if b:
            brand = F.contains(k, F.lit(b))
            intent, confidence, value = F.when(brand, "navigational").otherwise(intent), F.when(brand, 0.9).otherwise(confidence), F.when(brand, 0.4).otherwise(value)
    return {"intent": intent, "confidence": confidence, "intent_value": value}


def intent_value(intent: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, v in INTENT_VALUES.items():
        out = F.when(intent == name, v).otherwise(out)
    return out


def classify_intent(keywords: DataFrame, brands: tuple[str, ...] = ()) -> DataFrame:
    """``keywords`` with intent, confidence, intent_value and is_question."""
    return keywords.withColumns({**intent_columns(F.col("keyword"), brands), "is_question": is_question(F.col("keyword"))})


def word_count(keyword: Column) -> Column:
    return F.size(F.split(F.trim(keyword), r"\s+"))


def lexical_difficulty(keyword: Column) -> Column:
    """Difficulty from the words alone: shorter and more commercial phrases are harder."""
    k, words = F.lower(keyword), word_count(keyword)
    points = (
        (r"\b(best|top|cheapest|reviews?)\b", 9), (r"\b(software|tool|tools|app|platform|service)\b", 5), (r"\b(vs|versus|alternative|alternatives)\b", -6),
        (r"^(what|why|how|when|where|who|can|does|is|are)\b", -8), (r"\b(near me|in \w+)\b", -5),
    )
    score = clamp(78 - (words - 1) * 11.0, 12, 82)
    for pattern, n in points:
        score = score + F.when(k.rlike(pattern), n).otherwise(0)
    score = score + F.when(words >= 6, -6).otherwise(0) + F.when(F.size(content_tokens(keyword)) == 1, 8).otherwise(0)
    return js_round(clamp(score, 1, 95), 1)


#: Domains that rank on brand strength, and those whose content comes from users.
AUTHORITY_DOMAINS = """wikipedia.org youtube.com amazon.com reddit.com linkedin.com facebook.com instagram.com x.com twitter.com quora.com
medium.com forbes.com nytimes.com theguardian.com bbc.com cnn.com businessinsider.com techcrunch.com github.com stackoverflow.com apple.com
google.com microsoft.com hubspot.com salesforce.com shopify.com wix.com squarespace.com wordpress.com canva.com zapier.com notion.so
investopedia.com healthline.com webmd.com mayoclinic.org nih.gov gov.uk usa.gov walmart.com ebay.com etsy.com yelp.com tripadvisor.com""".split()
USER_DOMAINS = ("reddit.com", "quora.com", "stackexchange.com", "stackoverflow.com", "medium.com")


def serp_difficulty(results: DataFrame, features: DataFrame | None = None, authority: DataFrame | None = None, big: list[str] | None = None, users: list[str] | None = None) -> DataFrame:
    """Difficulty per keyword from its first ten results ``(keyword, position, url, domain)``.

    ``features(keyword, feature)`` and ``authority(domain, score)`` refine it; three authority scores or more let them dominate.
    Of equal positions the least url comes first.
    """
    from pyspark.sql import Window

    top = results.withColumn("n", F.row_number().over(Window.partitionBy("keyword").orderBy("position", "url"))).where("n <= 10")
    scored = top.join(authority.select("domain", F.col("score").alias("authority")), "domain", "left") if authority is not None else top.withColumn("authority", F.lit(None).cast("double"))
    home = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/$", "") == ""
    stats = scored.groupBy("keyword").agg(
        F.count_if(F.col("domain").isin(*(big or AUTHORITY_DOMAINS))).alias("big_brands"), F.count_if(home & F.col("url").rlike("^[a-z]+://")).alias("homepages"),
        F.countDistinct("domain").alias("unique_domains"), F.count_if(F.col("domain").isin(*(users or USER_DOMAINS))).alias("ugc_results"),
        F.count("authority").alias("n_authority"), F.avg("authority").alias("avg_authority"), F.min("authority").alias("weakest_authority"),
    )
    if features is not None:
        stats = stats.join(features.groupBy("keyword").agg(F.count("*").alias("serp_features")), "keyword", "left").withColumn("serp_features", F.coalesce("serp_features", F.lit(0)))
    else:
        stats = stats.withColumn("serp_features", F.lit(0).cast("bigint"))
    plain = 12 + F.col("big_brands") * 6.5 + F.col("homepages") * 3.2 + (10 - F.col("unique_domains")) * 1.5 + F.col("serp_features") * 2 - F.col("ugc_results") * 4.5
    mixed = plain * 0.35 + F.col("avg_authority") * 0.55 + F.col("weakest_authority") * 0.1
    known = F.col("n_authority") >= 3
    return stats.select("keyword", "big_brands", "homepages", "unique_domains", "serp_features", "ugc_results", js_round(clamp(F.when(known, mixed).otherwise(plain), 0, 100), 1).alias("difficulty"), F.when(known, "serp+authority").otherwise("serp").alias("method"))


def personal_difficulty(difficulty: Column, authority: Column) -> dict[str, Column]:
    """Difficulty for a site of the given authority (null: the absolute one), and a verdict."""
    personal = F.when(authority.isNull(), difficulty).otherwise(clamp(difficulty - (authority - difficulty) * 0.55, 0, 100))
    verdict = F.when(personal < 20, "easy").when(personal < 40, "realistic").when(personal < 65, "stretch").otherwise("unrealistic")
    return {"personal_difficulty": F.when(authority.isNull(), difficulty).otherwise(js_round(personal, 1)), "verdict": verdict}


def opportunity_columns(volume: Column, difficulty: Column, cpc: Column, intent: Column, words: Column, position: Column | None = None, target: int = 5) -> dict[str, Column]:
    """opportunity 0..100, traffic_upside, value_upside and striking_distance; null means unknown and never zero."""
    now = position if position is not None else F.lit(None).cast("double")
    known = volume.isNotNull() & (volume > 0)
    upside = F.when(known, F.greatest(F.lit(0), estimate_clicks(volume, F.lit(float(target))) - F.when(now.isNotNull(), estimate_clicks(volume, now)).otherwise(0)))
    by_words = F.when(words <= 1, 26.0).when(words <= 3, 30.0).when(words <= 5, 24.0).otherwise(16.0)
    traffic = F.when(known, clamp(F.log10(upside + 1.0) * 22, 0, 55)).otherwise(by_words)
    d = F.coalesce(difficulty, F.lit(45.0))
    ease = clamp(25 * (1 - F.pow(d / 100, F.lit(1.5))), 0, 25)
    paid = F.when(cpc.isNotNull(), clamp(F.log10(cpc + 1.0) / F.log10(F.lit(21.0)), 0, 1)).otherwise(0.0)
    value = clamp(intent_value(intent) * 12 + paid * 8, 0, 20)
    near = F.coalesce((now > 10) & (now <= 20), F.lit(False))
    bonus = F.when(now.isNull(), 0).when(near, 18).when(now <= 3, -8).when(now <= 10, 10).when(now <= 40, 6).otherwise(1)
    return {"opportunity": js_round(clamp(traffic + ease + value + bonus, 0, 100), 1), "traffic_upside": upside.cast("bigint"), "value_upside": js_round(upside * cpc, 2), "striking_distance": near}


def score_keywords(keywords: DataFrame, target: int = 5) -> DataFrame:
    """``keywords(keyword, volume, difficulty, cpc[, position])`` with intent, words and opportunity, best first."""
    base = keywords.withColumns({"intent": intent_columns(F.col("keyword"))["intent"], "words": word_count(F.col("keyword"))})
    position = F.col("position") if "position" in keywords.columns else None
    own = opportunity_columns(F.col("volume"), F.col("difficulty"), F.col("cpc"), F.col("intent"), F.col("words"), position, target)
    return base.withColumns(own).orderBy(F.desc("opportunity"), "keyword")


def traffic_value(keywords: DataFrame) -> DataFrame:
    """Clicks and their price over ``keywords(volume, position, cpc)``; rows without volume or position don't count."""
    own = keywords.where("volume is not null and position is not null").withColumn("c", estimate_clicks(F.col("volume"), F.col("position").cast("double")))
    return own.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("clicks"), js_round(F.coalesce(F.sum(F.col("c") * F.col("cpc")), F.lit(0.0)), 2).alias("value"))


def dedupe(keywords: DataFrame, order: str) -> DataFrame:
    """One row per trimmed lower-case keyword, the first by ``order``; blank keywords go."""
    key = F.trim(F.lower("keyword"))
    first = F.min_by(F.struct(*keywords.columns), F.struct(F.col(order)))
    return keywords.where(key != "").groupBy(key.alias("key")).agg(first.alias("row")).select("row.*", "key").drop("keyword").withColumnRenamed("key", "keyword")


# Modifiers of keyword expansion by strategy, English and Spanish.
MODIFIERS = {
    "en": {
        "questions": "what,what is,why,how,how to,how much,how many,when,where,who,which,can,do,does,is,are,should,will,would",
        "prepositions": "for,with,without,to,in,on,near,like,from,about,vs",
        "comparisons": "vs,versus,or,alternative to,compared to,alternatives",
        "commercial": "best,top,cheap,cheapest,free,buy,price,pricing,cost,review,reviews,alternatives,software,tool,tools,app,platform,service,agency,template,templates,example,examples,ideas,checklist,guide,tutorial,course,for beginners,near me",
        "after": "near me,for beginners",
    },
    "es": {
        "questions": "que es,que,como,como funciona,como hago,por que,para que,para que sirve,cuando,donde,cual,cuales,cuanto cuesta,cuanto sale,quien,se puede",
        "prepositions": "para,con,sin,de,en,cerca de,como,vs,desde,sobre",
        "comparisons": "vs,o,alternativas,alternativas a,comparado con,comparativa,diferencia",
        "commercial": "mejor,mejores,barato,baratos,gratis,comprar,precio,precios,opiniones,resenas,alternativas,software,herramienta,herramientas,programa,programas,plantilla,plantillas,ejemplos,guia,tutorial,curso,en cuotas,online,cerca de mi",
        "after": "gratis,precio,precios,opiniones,resenas,online,en cuotas,cerca de mi",
    },
}
STRATEGIES = ("plain", "alphabet", "digits", "questions", "prepositions", "comparisons", "commercial")


def modifier_rows(strategies: tuple[str, ...], year: int, language: str = "en") -> list[tuple[str, str, bool]]:
    """(strategy, modifier, whether it goes in front of the seed); the year is a parameter."""
    own = MODIFIERS["es" if language.lower().startswith("es") else "en"]
    after = set(own["after"].split(","))
    rows: list[tuple[str, str, bool]] = []
    for s in strategies:
        if s == "plain":
            rows.append((s, "", False))
        elif s in ("alphabet", "digits"):
            rows += [(s, c, False) for c in ("abcdefghijklmnopqrstuvwxyz" if s == "alphabet" else "0123456789")]
        elif s == "commercial":
            rows += [(s, str(year), False), *((s, m, m not in after) for m in own[s].split(","))]
        else:
            rows += [(s, m, s == "questions") for m in own[s].split(",")]
    return rows


def expand(seeds: DataFrame, year: int, strategies: tuple[str, ...] = STRATEGIES, language: str = "en") -> DataFrame:
    """Distinct queries ``(seed, query)`` for ``seeds(seed)``: each seed with each modifier, which are a bounded list of literals."""
    rows = modifier_rows(strategies, year, language)
    dim = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(front).alias("front")) for _, m, front in rows])
    s = F.trim(F.lower("seed"))
    out = seeds.select(s.alias("seed"), F.explode(dim).alias("d"))
    query = F.when(F.col("d.m") == "", F.col("seed")).when(F.col("d.front"), F.concat_ws(" ", "d.m", "seed")).otherwise(F.concat_ws(" ", "seed", "d.m"))
    return out.select("seed", query.alias("query")).distinct()


def rank_suggestions(suggestions: DataFrame) -> DataFrame:
    """Score per keyword of ``suggestions(keyword, engine, rank)``: best rank, engines that agree, and hits."""
    g = suggestions.groupBy("keyword").agg(F.min("rank").alias("best_rank"), F.countDistinct("engine").alias("engines"), F.count("*").alias("hits"))
    score = js_round(F.lit(60.0) / (1 + F.col("best_rank")) + F.col("engines") * 15.0 + F.least("hits", F.lit(10)) * 2.5, 2)
    return g.withColumn("score", score).orderBy(F.desc("score"), "keyword")


def expand_captured(seeds: DataFrame, captured: DataFrame, year: int, strategies: tuple[str, ...] = STRATEGIES, language: str = "en", depth: int = 1, per_seed: int = 10) -> DataFrame:
    """(seed, keyword, engine, rank) of the captured suggestions ``(via, engine, keyword, rank)`` for the seeds' expansions.

    At depth 2 the ``per_seed`` best keywords of each seed are expanded by the alphabet, and what is new is added.
    """
    from pyspark.sql import Window

    via = lambda q: captured.join(q.select("seed", F.col("query").alias("via")).distinct(), "via").select("seed", "keyword", "engine", "rank")
    found = via(expand(seeds, year, strategies, language))
    if depth < 2:
        return found
    score = found.groupBy("seed", "keyword").agg((F.lit(60.0) / (1 + F.min("rank")) + F.countDistinct("engine") * 15 + F.least(F.count("*"), F.lit(10)) * 2.5).alias("s"))
    best = score.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("s"), "keyword"))).where((F.col("n") <= per_seed) & (F.col("keyword") != F.col("seed")))
    deeper = expand(best.select(F.col("keyword").alias("seed")).distinct(), year, ("alphabet",), language).withColumnRenamed("seed", "keyword")
    more = via(best.select("seed", "keyword").join(deeper, "keyword").select("seed", "query")).join(found.select("seed", "keyword"), ["seed", "keyword"], "left_anti")
    return found.unionByName(more)


# What makes a commercial cluster want a list of the best; page formats by words in a cluster's head, the first that fits;
# formats by intent for heads without such words.
LISTICLE = r"\b(best|top|reviews?)\b"
FORMATS = {
    "comparison": "vs|versus|compared to|alternative|alternatives|competitor", "glossary": "what is|definition|meaning|glossary|terminology", "tool": "calculator|generator|converter|checker|tool|template",
    "guide": "how to|guide|tutorial|step by step|checklist", "product": "buy|price|pricing|cost|for sale|shop|order",
}
BY_INTENT = {"transactional": "landing-page", "navigational": "landing-page", "commercial": "landing-page"}
ASKED = 0.6


def page_type(head: Column, intent: Column, all_text: Column, question_share: Column) -> Column:
    """Page format for a keyword cluster: by the words of its head, else by intent, where clusters for a list of the best are
    comparisons and informational ones guides if mostly questions."""
    named = [F.when(F.lower(head).rlike(rf"\b({words})\b"), F.lit(kind)) for kind, words in FORMATS.items()]
    listed = F.when((intent == "commercial") & F.lower(all_text).rlike(LISTICLE), "comparison")
    by_intent = F.element_at(F.create_map(*[F.lit(x) for pair in BY_INTENT.items() for x in pair]), intent)
    return F.coalesce(*named, listed, by_intent, F.when(question_share > ASKED, "guide").otherwise("blog-post"))
