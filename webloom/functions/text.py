"""Tokens, stems, phrases and readability as column expressions, and their DuckDB texts for the tests."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Stopwords, English and Spanish.
ENGLISH_STOPWORDS = """a about above after again all am an and any are as at be because been before being below between both but by
can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in
into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same
she should so some such t than that the their theirs them themselves then there these they this those through to too under until up
very was we were what when where which while who whom why will with you your yours yourself yourselves""".split()
SPANISH_STOPWORDS = """el la los las un una unos unas lo al del de en por para con sobre entre hasta desde durante segun que como
cuando donde quien cual cuales porque aunque si este esta estos estas ese esa esos esas aquel aquella su sus mi mis tu tus nuestro
nuestra nuestros nuestras le les se te nos yo ella ellos ellas usted es estan ser fue fueron hay ha han habia muy mas menos pero
tambien ya aun todavia todo toda todos todas otro otra otros otras cada mismo misma tanto ahora aqui alli asi bien puede pueden tiene
tienen hacer hace ver tienes puedes quieres quiere eres sois vais teneis podeis quereis vos aca alla che ustedes tenes queres podes
sabes haces vas anda mira fijate nomas igual""".split()
STOPWORDS = tuple(sorted({*ENGLISH_STOPWORDS, *SPANISH_STOPWORDS}))


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their base letters, from the Unicode decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not "̀" <= x <= "ͯ") if len(c) == 1 else ""
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folding()


def fold(text: Column) -> Column:
    """Lower case, Latin accents folded, apostrophes dropped.  Texts without marked letters skip the table."""
    low = F.lower(text)
    plain = F.when(low.rlike("[\\u00e0-\\u024f]"), F.translate(low, _MARKED, _PLAIN)).otherwise(low)
    return F.regexp_replace(plain, "['’\\u0300-\\u036f]", "")


def tokens(text: Column) -> Column:
    """ASCII tokens of letters, digits, + and #; null: none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9+#]+"), lambda t: t != "")


def _is_stopword(t: Column) -> Column:
    return t.isin(*STOPWORDS)


def content_tokens(text: Column) -> Column:
    """Tokens of two or more characters that are no stopwords."""
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~_is_stopword(t))


_DONE = "\x01"


def stem_all(words: Column) -> Column:
    """Suffix stripping by ordered rules; words of three letters or fewer stay.

    The rules go over the array in three passes, so that no intermediate form is computed twice; a mark at the end tells words for
    which an early rule was the last.
    """
    cut = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)
    ends = lambda x, *tails: F.right(x, F.lit(len(tails[0]))).isin(*tails)

    def first(w: Column) -> Column:
        size = F.length(w)
        plural = (
            F.when(ends(w, "ies") & (size > 4), F.concat(cut(w, 3), F.lit("y" + _DONE)))
            .when(ends(w, "sses"), F.concat(cut(w, 2), F.lit(_DONE)))
            .when((size > 4) & (ends(w, "ses", "xes", "zes") | ends(w, "ches", "shes")), F.concat(cut(w, 2), F.lit(_DONE)))
            .when(ends(w, "ss", "us"), w)
            .otherwise(cut(w, 1))
        )
        return F.when(size <= 3, F.concat(w, F.lit(_DONE))).when(ends(w, "s"), plural).otherwise(w)

    gerund = lambda w: F.when(ends(w, "ing") & (F.length(w) >= 7), cut(w, 3)).otherwise(w)
    bare = lambda w: F.when(ends(w, _DONE), cut(w, 1)).when(ends(w, "e") & ((F.length(w) >= 6) | (F.length(w) == 5) & ends(w, "ce", "ge", "se", "ve", "ze")), cut(w, 1)).otherwise(w)
    return F.transform(F.transform(F.transform(words, first), gerund), bare)


def stem(w: Column) -> Column:
    """``stem_all`` of one word."""
    return F.get(stem_all(F.array(w)), F.lit(0))


def stems(text: Column) -> Column:
    """Stemmed content tokens, in order."""
    return stem_all(content_tokens(text))


def stem_set(text: Column) -> Column:
    return F.array_distinct(stems(text))


def ngrams(words: Column, n: int) -> Column:
    """Contiguous n-grams joined by a space; none if there are fewer words."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def syllables(word: Column, spanish: Column) -> Column:
    """Vowel groups of at most two letters, without the silent endings of English; at least one."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    plain = F.when(spanish, w).otherwise(F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|ed|[^laeiouy]e)$", ""), "^y", ""))
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.size(F.regexp_extract_all(plain, F.lit("([aeiouy]{1,2})"), 1))))


def sentences(text: Column) -> Column:
    """Split after terminal punctuation, and a closing mark, before a capital or an opening mark."""
    parts = F.split(text, "(?<=[.!?][\"'”’»)\\]]?)\\s+(?=[\\p{Lu}\\p{Lt}\"'(¿¡«“])")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def truncate(text: Column, limit: int) -> Column:
    """Cut at a word boundary if that is past 60 % of the limit, with an ellipsis."""
    head = F.substring(text, 1, limit)
    last = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (last > limit * 0.6), F.substring(head, F.lit(1), last)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


# DuckDB texts of the same functions


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[''’]', '', 'g'), '[^a-z0-9+#]+'), lambda tk: tk <> '')"


def sql_content(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter({sql_tokens(x)}, lambda tk: length(tk) > 1 AND tk NOT IN ({words}))"


def sql_stem(w: str) -> str:
    plural = f"(CASE WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {w} NOT LIKE '%us' THEN left({w}, length({w}) - 1) ELSE {w} END)"
    gerund = f"(CASE WHEN {plural} LIKE '%ing' AND length({plural}) >= 7 THEN left({plural}, length({plural}) - 3) ELSE {plural} END)"
    bare = f"(CASE WHEN (length({gerund}) >= 5 AND regexp_matches({gerund}, '[cgsvz]e$')) OR (length({gerund}) >= 6 AND {gerund} LIKE '%e') THEN left({gerund}, length({gerund}) - 1) ELSE {gerund} END)"
    return f"(CASE WHEN length({w}) <= 3 THEN {w} WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' WHEN {w} LIKE '%sses' THEN left({w}, length({w}) - 2) WHEN regexp_matches({w}, '([sxz]|ch|sh)es$') AND length({w}) > 4 THEN left({w}, length({w}) - 2) ELSE {bare} END)"


def sql_stems(x: str) -> str:
    return f"list_transform({sql_content(x)}, lambda sw: {sql_stem('sw')})"
