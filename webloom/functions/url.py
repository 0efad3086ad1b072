"""URL functions as column expressions for absolute URLs; relative references go through the Arrow function below."""

from __future__ import annotations

from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Query parameters that track visits, and public suffixes of two labels.
TRACKING = frozenset("""utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid msclkid dclid twclid igshid
ttclid yclid mc_cid mc_eid ref referrer _hsenc _hsmi hsa_acc hsa_cam campaignid adgroupid sscid irclickid vero_id wickedid""".split())
TWO_LABEL_SUFFIXES = """co.uk org.uk me.uk ac.uk gov.uk net.uk sch.uk ltd.uk plc.uk com.au net.au org.au edu.au gov.au id.au co.nz
net.nz org.nz govt.nz ac.nz co.za org.za net.za web.za gov.za com.br net.br org.br gov.br edu.br com.mx org.mx gob.mx com.ar net.ar
org.ar gob.ar co.jp or.jp ne.jp ac.jp go.jp co.kr or.kr ne.kr go.kr com.cn net.cn org.cn gov.cn edu.cn com.hk org.hk net.hk gov.hk
com.sg net.sg org.sg gov.sg com.tr net.tr org.tr gov.tr co.in net.in org.in gov.in ac.in com.pl net.pl org.pl gov.pl co.il org.il
net.il gov.il com.tw net.tw org.tw gov.tw co.id or.id go.id web.id com.my net.my org.my gov.my com.ph net.ph org.ph gov.ph com.vn
net.vn org.vn gov.vn com.ua net.ua org.ua gov.ua com.es com.pt com.it com.de com.fr co.th in.th go.th github.io gitlab.io vercel.app
netlify.app pages.dev web.app firebaseapp.com""".split()
ASSETS = "jpg|jpeg|png|gif|webp|svg|ico|bmp|avif|css|js|mjs|map|json|xml|rss|atom|txt|csv|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|gz|tar|rar|7z|exe|dmg|apk|mp3|mp4|m4a|wav|ogg|webm|avi|mov|mkv|woff|woff2|ttf|otf|eot|wasm"


def hostname(url: Column) -> Column:
    """Lower-case host of an http(s) URL without port and user; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", F.regexp_replace(host, r"\.$", ""))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three after a suffix of two, without www."""
    bare = F.regexp_replace(host, r"^www\.", "")
    two = F.substring_index(bare, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def slash_key(url: Column) -> Column:
    """Scheme, host, path without its last slash, and query."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"/+(\?|$)", "$1")


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def slugify(text: Column) -> Column:
    from .text import fold

    slug = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, 80), "-+$", "")


def looks_like_html(url: Column) -> Column:
    return ~F.lower(F.regexp_replace(url, "[?#].*$", "")).rlike(rf"\.(?:{ASSETS})$")


def normalize(url: str | None, base: str | None = None) -> str | None:
    """Absolute http(s) URL without fragment, default port and tracking parameters, the others sorted; index pages become their folder."""
    try:
        parts = urlsplit(urljoin(base or "", (url or "").strip()))
        port = parts.port
    except ValueError:
        return None
    scheme, host = parts.scheme.lower(), (parts.hostname or "").rstrip(".")
    if scheme not in ("http", "https") or not host:
        return None
    if port and port != {"http": 80, "https": 443}[scheme]:
        host = f"{host}:{port}"
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in TRACKING)
    path = parts.path or "/"
    while "//" in path:
        path = path.replace("//", "/")
    head, _, tail = path.rpartition("/")
    if tail.lower().rsplit(".", 1)[0] in ("index", "default") and tail.lower().rsplit(".", 1)[-1] in ("htm", "html", "php", "asp", "aspx"):
        path = f"{head}/"
    return urlunsplit((scheme, host, quote(path, safe="/%:@!$&'()*+,;=~-._"), urlencode(pairs), ""))


@F.pandas_udf(StringType())
def normalize_url(url: pd.Series, base: pd.Series) -> pd.Series:
    """``normalize`` for columns; Arrow batches."""
    return pd.Series([normalize(u, b) for u, b in zip(url, base, strict=True)])
