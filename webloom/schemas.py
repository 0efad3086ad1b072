"""Schemas of the central tables, as Spark DDL."""

LINK = "struct<url:string,anchor:string,rel:string,internal:boolean,nofollow:boolean>"
IMAGE = "struct<src:string,alt:string,width:double,height:double,loading:string>"
PAGE = (
    "url string, final_url string, status int, redirect_chain array<string>, content_type string, bytes bigint, fetch_ms bigint, title string, "
    "meta_description string, meta_robots string, canonical string, lang string, headings array<struct<level:int,text:string>>, h1 array<string>, "
    f"text string, word_count int, links array<{LINK}>, images array<{IMAGE}>, jsonld array<string>, social map<string,string>, "
    "hreflang array<struct<lang:string,href:string>>, depth int, error string"
)
PERF = "struct<render_blocking_css:int,render_blocking_js:int,inline_style_bytes:bigint,inline_script_bytes:bigint,images_without_dimensions:int,images_without_lazy:int,total_dom_nodes:int>"
ISSUE = "rule string, severity string, url string, message string, evidence string"
ACTION = "id string, priority string, effort string, category string, title string, detail string, target string, impact_score double, evidence string, fix string"
KEYWORD = "keyword string, volume bigint, difficulty double, cpc double, intent string, source string, words int, opportunity double, cluster string, position double"
SERP = "keyword string, position int, url string, title string, snippet string, domain string"
RANK = "project string, keyword string, position double, url string, clicks bigint, impressions bigint, ctr double, source string, location string, device string, checked_at timestamp"
