"""The training-data operators against brute force, and their defined results for odd inputs."""

import hashlib
import html
import itertools
import json
import math
import random
import re
import tracemalloc
import zlib
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import chat, decontam, graph, gumbel, htmlmain, linedup, neardup, queries, rules, shard, urlfilter, zclassify

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Clashing names of columns that operators give out or use inside.
EXTRA = {"n_words": "'x'", "shard": "1.5", "kept": "'y'", "key": "cast(null as string)", "ids": "'z'", "gone": "1", "partners": "2", "th": "'t'", "_th": "3", "_hit": "'h'", "hit": "'i'", "spans": "4", "gone_id": "5", "again_id": "6",
         "gone_th": "7", "_id": "8", "_gone": "9", "_partners": "10", "n": "11", "size": "12", "cell": "13", "DIGEST": "14", "owner": "15"}


def clashing(df):
    return df.withColumns({k: F.expr(v) for k, v in EXTRA.items()} | {"a `b`.c": F.lit(1)})


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, first=0):
    rows = [(first + k, t, "en", "s", len(t) if t is not None else 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a null id, a long text, clashing columns."""
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (4, "one"), (None, "null id here"), (5, "long words " * 30000), (6, "one"), (7, "Ünï ▁ 𝕏 \x00 \r\n x")]
    return clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS))


def empty(spark):
    return clashing(spark.createDataFrame([], DOCS))


# sharding


def best_capacity(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, left = (lo + hi) // 2, 1, (lo + hi) // 2
        for s in sizes:
            n, left = (n, left - s) if s <= left else (n + 1, mid - s)
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("ranges", [4, 64])
def test_shards_are_minimax(spark, ranges):
    rng = random.Random(1)
    keys = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)})
    sizes = [rng.randrange(1, 1000) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key bigint, size bigint")
    capacity, lasts = shard.minimax(df, 7, ranges)
    assert capacity == best_capacity(sizes, 7) and len(lasts) == 6
    sums = [0] * 7
    for k, s in zip(keys, sizes, strict=True):
        sums[sum(k > c for c in lasts)] += s
    assert max(sums) <= capacity and min(sums) > 0


def test_hot_group_leaves_no_shard_empty(spark):
    texts = ["hot " * 50] * 200 + [f"text {k} " * 10 for k in range(400)]
    rows = shard.shard_documents(frame(spark, texts), 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in rows if r.doc_id < 200}) == 1
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in rows)


def test_shards_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(29)
    docs = frame(spark, [f"text {rng.randrange(40)} " * rng.randrange(1, 9) for _ in range(200)])
    one, other = (sorted(shard.shard_documents(d, 5).collect()) for d in (docs, docs.repartition(7)))
    assert one == other
    sizes = {r.group_key: 0 for r in one}
    for r in one:
        sizes[r.group_key] += r.size
    assert {r.capacity for r in one} == {best_capacity([sizes[k] for k in sorted(sizes)], 5)}
    loads = [sum(r.size for r in one if r.shard == k) for k in range(5)]
    assert max(loads) <= one[0].capacity and [k for r in sorted(one, key=lambda r: r.group_key) for k in [r.shard]] == sorted(r.shard for r in one)


def test_shards_of_odd_rows(spark):
    rows = shard.shard_documents(odd(spark), 24).collect()
    assert len(rows) == 9 and {r.size for r in rows if r.doc_id == 1} == {8} and {r.text_crc32 for r in rows if r.doc_id == 1} == {0}
    assert len({r.shard for r in rows if r.doc_id in (4, 6)}) == 1
    assert shard.shard_documents(empty(spark), 24).count() == 0


# chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\n<|turn|>user\nx<|end|>", "<<SYS>>\\", "", None, "plain"]
    rows = [(1, k, "assistant" if k % 2 else "us\ner\\", t) for k, t in enumerate(nasty)]
    turns = spark.createDataFrame(rows + [(None, 0, None, "x")], "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    segments = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    want = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows)
    assert got[1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[1].n_turns == 6
    loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    text = next(r for r in chat.conversation_texts(segments).collect() if r.conv_id == 1)
    assert got[1].formatted_chars == len(text.formatted)
    spans = text.loss_spans
    assert "".join(chat.unescape(text.formatted[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True)) == loss
    for control in chat.CONTROLS[1:]:
        assert control not in text.formatted
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_long_conversation_is_cut_in_parts(spark):
    turns = spark.createDataFrame([(1, k, "user", "x" * 100) for k in range(50)], "conv_id bigint, turn bigint, role string, text string")
    parts = chat.conversation_texts(chat.format_turns(turns), 1000).orderBy("part").collect()
    assert len(parts) > 4 and [len(chat.parse(p.formatted)) for p in parts] and sum(len(chat.parse(p.formatted)) for p in parts) == 50


def test_layouts_by_fingerprint(spark):
    records = [
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"prompt": "q", "completion": "a"}', '{"instruction": "q", "output": "a"}', '{"question": "q", "answer": "a", "id": 3}',
    ]
    df = spark.createDataFrame(list(enumerate(records + ['{"instruction": "q", "input": "i", "output": "a"}', "no json", None, "[]"])), "id bigint, record string")
    got = {}
    for r in chat.canonical_turns(df).orderBy("id", "turn").collect():
        got.setdefault(r.id, []).append((r.role, r.text))
    assert all(got[k] == [("user", "q"), ("assistant", "a")] for k in range(5)) and got[5] == [("user", "q\n\ni"), ("assistant", "a")]
    assert all(got[k] == [(None, None)] for k in (6, 7, 8))


def test_odd_records_lose_nothing(spark):
    odd_records = ['{"messages": [{"role": "user", "content": "q"}, "s"]}', '{"messages": [{"role": ["user"], "content": "q"}]}', '{"prompt": 5, "completion": "a"}', '{"prompt": ["x"], "completion": "a"}', '{"messages": "x"}',
                   "[" * 5000, '{"messages": []}', '{"messages": null}', "3", '"x"', '{"role": {"a": 1}, "text": "x"}', '{"conversations": [{"from": 1, "value": 2}]}', ""]
    fine = ['{"prompt": "\\ud800", "completion": null}', '{"messages": [null, {"role": null, "content": "x"}]}', json.dumps({"prompt": "long " * 100_000, "completion": "a"})]
    df = spark.createDataFrame([(k, r, 1) for k, r in enumerate(odd_records + fine + fine[-1:])], "id bigint, record string, turn int")
    got = {}
    for r in chat.canonical_turns(df).orderBy("id", "turn").collect():
        got.setdefault(r.id, []).append((r.turn, r.role, r.text))
    n = len(odd_records)
    assert set(got) == set(range(n + 4)) and all(got[k] == [(None, None, None)] for k in range(n))
    assert got[n] == [(0, "user", "\ufffd"), (1, "assistant", "")] and got[n + 1] == [(0, "", "x")] and got[n + 2][0][2] == "long " * 100_000 and got[n + 2] == got[n + 3]
    segments = chat.format_records(df.withColumnRenamed("id", "conv_id"))
    counts = {r.conv_id: r.n_turns for r in chat.read_back(segments).collect()}
    assert counts == {n: 2, n + 1: 1, n + 2: 2, n + 3: 2} and chat.canonical_turns(df.limit(0)).count() == 0


def test_layouts_of_conversations_give_the_same_turns(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {t} </s> of {c}" if t else None) for c in range(6) for t in range(4)] * 2
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    records = queries._records(turns)
    layouts = {r.layout for r in chat.canonical_turns(records.withColumn("id", F.col("conv_id"))).collect()}
    assert layouts == {"turn rows", "messages", "conversations"}
    plain = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert {r.conv_id: r for r in chat.read_back(chat.format_records(records)).collect()} == plain and plain[0].n_turns == 8
    table = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))).alias("conversations"))
    table = table.select("conv_id", F.lit(0).alias("turn"), F.transform("conversations", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"), F.lit("x").alias("formatted"))
    assert {r.conv_id: r.turns_sha256 for r in chat.read_back(chat.format_turns(table)).collect()} == {k: r.turns_sha256 for k, r in plain.items()}
    with pytest.raises(ValueError, match="no layout"):
        chat.format_turns(turns.select("conv_id", "turn", "role"))


# url rules


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "allow")


def test_url_rules(spark):
    urls = ["http://Example.ORG/es/1", "https://a.example.org/en/19?x", "https://example.org/en/2", "http://x.org", "http://org/", "https://notexample.org/es/", "http://m.com/fr/1#f", "http://m.com/de/", "http://m.com/",
            "ftp://u@x.com:80/fr/", "no scheme", "", None, "http://a..org/es/", "x://y/http://z.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit(7))
    got = urlfilter.judge(pages, queries.URL_RULES).orderBy("page_id").collect()
    for r, u in zip(got, urls, strict=True):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (r.host, r.path, (r.rule, r.verdict)) == (host, path, brute_rule(host, path))
    joined = urlfilter.judge(pages, queries.URL_RULES, max_broadcast_bytes=0).orderBy("page_id").collect()
    assert joined == got and urlfilter.judge(pages.limit(0), []).count() == 0
    ties = [("a.org", "/x/", "allow"), ("b.a.org", "/", "block"), ("c.a.org", "/", "allow"), ("a.org", "/y/", "allow"), ("d.a.org", "/", "allow")]
    hosts = [("http://b.a.org/x/y", "b.a.org/"), ("http://c.a.org/x/", "c.a.org/"), ("http://d.a.org/y/", "d.a.org/"), ("http://a.org/x/" + "z" * 300_000, "a.org/x/")] * 2
    odd_pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(hosts)], "page_id bigint, url string")
    for size in (1 << 20, 0):
        got = {r.page_id: r.rule for r in urlfilter.judge(odd_pages, ties, max_broadcast_bytes=size).collect()}
        assert got == {k: rule for k, (_, rule) in enumerate(hosts)}
    table = spark.createDataFrame([*queries.URL_RULES, ("org", "/", "block")], "host string, path string, verdict string")
    assert urlfilter.judge(pages, table).where("rule = 'org/'").first().verdict == "block"


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href="/x">Menu</a></nav><!-- ad --><div class="ad">Buy</div>
<div id="cookie-notice">Cookies</div><article><h1>Head &amp; more</h1><p>One<br>two&nbsp; three<p><b>Bold <form><input value="q">Send</form><script>var t="</p>";</script><ul><li>a<li>b</ul>
<section class="comments"><p>reader says</p></section><aside>side</aside></article><footer>&copy; f</footer></body></html>"""


def article(page):
    """The main text of a page by itself."""
    return htmlmain.main_texts([htmlmain.Page(page)], [0])[0].split("\n\n")


def test_main_text():
    assert article(PAGE) == ["Head & more", "One two three", "Bold", "a", "b"]
    assert article(None) == article("") == article("<p> </p>") == [""]
    long = "word " * 50_000
    assert article(f"<article><p>{long}<p>end</article>") == [long.strip(), "end"]


@pytest.mark.parametrize(("page", "want"), [
    ('<article><h2 id="social-contract">On it</h2><section id="comments-on-kant"><p>He wrote</p></section></article>', ["On it", "He wrote"]),
    ("<header>Site</header><main><header><h1>Title</h1></header><p>text</p></main>", ["Title", "text"]),
    ('<article>real</article><article class="comment">reader says</article>', ["real"]),
    ('<article>real<div class="comment-list"><p>reader</p></div><p class="ad-banner">buy</p><div role="search">find</div></article>', ["real"]),
    ('<body><div class="site-footer">foot</div><div hidden>no</div><p>only text <span class="share">tweet</span> here</body>', ["only text here"]),
    ("<main><p>intro</p><article><p>one</p><article><p>nested</p></article></article></main>", ["one", "nested"]),
])
def test_what_is_no_content(page, want):
    assert article(page) == want


def brute_repeats(streams, owner, run):
    where = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            where.setdefault(tuple(s[i : i + run]), set()).add(owner[k])
    out = []
    for s in streams:
        most = [1] * len(s)
        for i in range(len(s) - run + 1):
            for k in range(i, i + run):
                most[k] = max(most[k], len(where[tuple(s[i : i + run])]))
        out.append(most)
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 8])
def test_suffix_array_finds_all_repeats(run):
    rng = random.Random(run)
    streams = [[rng.randrange(4) for _ in range(rng.randrange(0, 40))] for _ in range(12)] + [[]]
    owner = [k // 2 for k in range(13)]
    assert [c.tolist() for c in htmlmain.repeats(streams, owner, run)] == brute_repeats(streams, owner, run)
    assert htmlmain.repeats([], [], run) == []
    order, rank = htmlmain.suffix_order(htmlmain.np.array(streams[3]), run)
    assert sorted(order.tolist()) == list(range(len(streams[3])))
    assert [streams[3][i : i + run] for i in order] == sorted(streams[3][i : i + run] for i in range(len(streams[3])))


def plain_article(page):
    """The main text of the test pages, whose articles hold nothing else, by regular expressions."""
    inner = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


@pytest.mark.parametrize("group_bytes", [1 << 23, 1 << 14])
def test_repetition_finds_articles_without_their_tag(spark, group_bytes):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain_article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in htmlmain.extract(pages, group_bytes=group_bytes).collect()} == want
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1div>"))
    got = {r.page_id: r.text for r in htmlmain.extract(bare, group_bytes=group_bytes).collect()}
    assert sum(got[k] != want[k] for k in want) <= (0 if group_bytes > 1 << 20 else 0.1 * len(want))


def test_boilerplate_by_host(spark):
    chrome = "this very same line stands on every page of the host"
    page = lambda k, host: (k, f"https://{host}/{k}", f"<body><div>{chrome}</div><p>page {k} has its own words number {k} and more of them {k}</p></body>")
    rows = [page(k, "a.org") for k in range(4)] + [page(9, "b.org"), page(9, "b.org"), (10, None, None), (11, "https://a.org/", ""), (12, "https://c.org/", PAGE)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(3))
    got = {}
    for r in htmlmain.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert all(chrome not in got[k][0] and f"number {k}" in got[k][0] for k in range(4))
    assert len(got[9]) == 2 and chrome in got[9][0]  # repeated rows are no distinct pages
    assert got[10] == [""] and got[11] == [""] and got[12][0].startswith("Head & more\n\nOne two three")
    assert htmlmain.extract(df.limit(0)).count() == 0


def test_repeats_count_over_all_groups_of_a_host(spark):
    """Whether a host's pages are in one group or in many, texts are the same: a line that a group has once is repeated in others."""
    rng = random.Random(4)
    lines = [" ".join(words(rng, rng.randrange(3, 12))) for _ in range(12)]

    def page(k):
        own = " ".join(words(rng, rng.randrange(0, 40)))
        return f"<body><div>{lines[0]}</div><div>{rng.choice(lines)}</div><p>{own}</p><div>{rng.choice(lines)}<p>{' '.join(words(rng, 9))}</div></body>"

    rows = [(k, f"https://a.org/{k}" if k % 3 else None, page(k)) for k in range(60)]
    rows += [(k, f"https://named.org/{k}", f"<div>{lines[0]}</div><article>{page(k)}</article>") for k in range(60, 80)]
    rows += [(k, "https://a.org/", f"<article>{lines[1]} {k}</article><article>{lines[0]}</article>") for k in range(80, 90)]
    rows += rows[:5] + [(90, None, None), (91, "https://a.org/", ""), (92, "https://a.org/", "<p>two words"), (93, "https://named.org/", "<nav>menu</nav>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = lambda n: sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in htmlmain.extract(df, group_pages=n).collect())
    want = got(10**6)
    assert len(want) == len(rows) and sum(lines[0] in t for k, _, t, _ in want if k < 60) < 20
    for n in (40, 7, 1):
        assert got(n) == want


# line dedup


def test_patience():
    assert linedup.patience([(0, 5, True), (1, 6, True), (2, 0, True), (3, 7, False), (4, 8, True)]) == [(0, 5), (1, 6), (3, 7), (4, 8)]
    rng = random.Random(3)
    for _ in range(50):
        points = [(k, y, True) for k, y in enumerate(rng.sample(range(30), 12))]
        best = max((c for n in range(13) for c in itertools.combinations(points, n) if all(a[1] < b[1] for a, b in zip(c, c[1:], strict=False))), key=len)
        assert len(linedup.patience(points)) == len(best)


def test_line_dedup_deletes_blocks_from_later_documents(spark):
    block = ["shared first line of a block", "shared second line of it", "short"]
    texts = ["\n".join(["own line number one here", *block, "tail of the first"]), "\n".join(["other opening words", *block, "", "other end"]), "short\nnothing else is shared here", "\n".join(block)]
    got = {r.doc_id: r for r in linedup.report(frame(spark, texts)).collect()}
    assert got[0].n_deleted == 0 and got[1].clean_text == "other opening words\n\nother end" and list(got[1].partners) == [0]
    assert got[2].n_deleted == 0 and got[3].n_deleted == 3
    kept = {r.doc_id: r for r in linedup.clean(frame(spark, texts)).collect()}
    assert set(kept) == {0, 1, 2} and kept[1].n_chars == len(kept[1].text)


def brute_units(text):
    """(unit, line) of a text: sentences of its lines, those of fewer than four words with the next one."""
    out = []
    for n, line in enumerate(text.split("\n")):
        held = ""
        for part in re.split(r"(?<=[.!?]) ", line):
            held = f"{held} {part}".strip() if held else part.strip()
            if len(held.split()) >= 4:
                out.append((held, n))
                held = ""
        if held:
            out.append((held, n))
    return out


def brute_deletions(texts):
    """Units that the earliest holders align, and those that any earlier document with them does, by pairwise alignment of all."""
    keyed, gone = [], []
    for t in texts:
        units, seen = brute_units(t), {}
        keyed.append([(x, seen.setdefault(x, []).append(0) or len(seen[x])) for x, _ in units])
        keys, own = keyed[-1], len(keyed) - 1
        once = lambda d, key: sum(x == key[0] for x, _ in keyed[d]) == 1
        points = lambda d, hub: [(k, keyed[d].index(key), once(own, key) and once(d, key)) for k, key in enumerate(keys) if key in keyed[d] and hub(key, d)]
        first = {key: next(d for d in range(own + 1) if key in keyed[d]) for key in keys}
        taken = set()
        for d in range(own):
            taken |= {x for x, _ in linedup.patience(points(d, lambda key, d: first[key] == d))} | {x for x, _ in linedup.patience(points(d, lambda key, d: True))}
        runs = [[k for _, k in g] for _, g in itertools.groupby(enumerate(sorted(taken)), lambda p: p[1] - p[0])]
        lost, n_words = [], [len(x.split()) for x, _ in units]
        for run in runs:
            whole = [k for k in run if {j for j, u in enumerate(units) if u[1] == units[k][1]} <= set(run)]
            lost += run if sum(n_words[k] for k in run) >= 25 else whole if sum(n_words[k] for k in whole) >= 4 else []
        gone.append(lost)
    return gone


def test_line_dedup_tries_other_partners(spark):
    p, q = (["\n".join(f"passage {n} line {k} of it" for k in range(6)) for n in "pq"])
    texts = [f"{p}\n{q}", f"{q}\n{p}", f"{q}\n{p}", f"{q}\nown words between the two passages\n{p}"]
    got = {r.doc_id: r for r in linedup.report(frame(spark, texts)).collect()}
    assert [got[k].n_deleted for k in range(4)] == [0, 6, 12, 12] and 1 in got[2].partners and 1 in got[3].partners
    assert {r.doc_id for r in linedup.clean(frame(spark, texts)).collect()} == {0, 1}  # little is left of 3
    assert {r.doc_id for r in linedup.clean(frame(spark, texts), least_left=0).collect()} == {0, 1, 3}


def test_copies_of_reordered_lines_leave_nothing(spark):
    texts = ["b has five words here\na has five words too", "a has five words too\nb has five words here\nc is a line of its own"]
    got = {r.doc_id: r for r in linedup.report(frame(spark, [*texts, texts[1]])).collect()}
    assert got[2].clean_text == "" and got[1].n_deleted == 1


def test_passages_inside_lines_go(spark):
    rng = random.Random(23)
    sentence = lambda: " ".join(words(rng, rng.randrange(5, 14), 10**6)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    assert len(passage.split()) > 50
    own = [[" ".join(words(rng, 30, 10**6)) for _ in range(2)] for _ in range(6)]
    texts = [f"{a} {passage} {b}" for a, b in own] + ["A. B c. D e f. " + " ".join(sentence() for _ in range(5))]
    got = {r.doc_id: r.clean_text for r in linedup.report(frame(spark, texts)).collect()}
    assert got[0] == texts[0] and got[6] == texts[6]
    for k in range(1, 6):
        left = got[k].split()
        assert set(" ".join(own[k]).split()) <= set(left) and len(set(left) & set(passage.split())) < 15


@pytest.mark.parametrize("first_tried", [1, 16])
def test_line_dedup_equals_pairwise_alignment(spark, monkeypatch, first_tried):
    monkeypatch.setattr(linedup, "FIRST_TRIED", first_tried)
    rng = random.Random(19)
    pool = [f"line {k}" + " with words" * (k % 3) for k in range(14)]
    parts = [f"Part {k}" + " of it" * (k % 5) + ".!?"[k % 3] for k in range(12)]
    line = lambda: rng.choice(pool) if rng.random() < 0.7 else " ".join(rng.choices(parts, k=rng.randrange(1, 7)))
    texts = ["\n".join([line() for _ in range(rng.randrange(1, 9))] + [f"own {k}"]) for k in range(70)]
    got = {r.doc_id: list(r.deleted) for r in linedup.report(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_deletions(texts)


def test_line_dedup_reads_no_text_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(linedup, "FIRST_TRIED", 1)
    cut, calls = linedup.line_table, []
    monkeypatch.setattr(linedup, "line_table", lambda docs: calls.append(1) or cut(docs))
    p, q = (["\n".join(f"passage {n} line {k} of it" for k in range(6)) for n in "pq"])
    texts = [f"{p}\n{q}", *[f"{q}\n{p}"] * 12]
    got = {r.doc_id: r.n_deleted for r in linedup.report(frame(spark, texts)).collect()}
    assert [got[k] for k in range(13)] == [0, 6, *[12] * 11] and len(calls) == 1


def test_units_of_many_texts_are_those_of_each():
    rng = random.Random(29)
    parts = ["a", "bb", " ", "  ", ". ", "! ", "?", ".", "\n", "\0", "\t", "\r", "\x0b", "\u00e9 c d e f", "one two three four", ". a b. "]
    for _ in range(3000):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(parts, k=rng.randrange(14))).encode() for _ in range(rng.randrange(1, 5))]
        row, keys, spots = linedup._keyed_units(texts)
        want = []
        for n, t in enumerate(texts):
            units = []
            for line in linedup._marked(t or b"").split(b"\n"):
                own = list(zip(*linedup._units(line), strict=True))
                units += [(x.strip(), w, (k == 0) * 2 + (k == len(own) - 1)) for k, (x, w) in enumerate(own)]
            every = [x for x, _, _ in units]
            want += [(n, (x, every[:k].count(x)), k << 32 | w << 3 | (every.count(x) == 1) << 2 | ends) for k, (x, w, ends) in enumerate(units)]
        assert [(r, s) for r, s in zip(row.tolist(), spots.tolist(), strict=True)] == [(n, s) for n, _, s in want]
        assert len(set(keys.tolist())) == len({x for _, x, _ in want}) == len(set(zip(keys.tolist(), (x for _, x, _ in want), strict=True)))


def test_line_dedup_of_odd_rows(spark):
    got = linedup.clean(odd(spark))
    assert got.columns == odd(spark).columns and got.count() == 9
    assert linedup.report(odd(spark)).count() == 9 and linedup.clean(empty(spark)).count() == 0 and linedup.report(empty(spark)).count() == 0
    twice = frame(spark, ["a line of more than four words"] * 2).unionByName(frame(spark, ["a line of more than four words"]))
    assert sorted(r.doc_id for r in linedup.clean(twice).collect()) == [0, 0]


# quality classifier


def test_quality_scores_separate_classes(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(("the", "house", "river", "walks", "slowly", "green", "and", "over")) for _ in range(80)) for _ in range(120)]
    bad = [" ".join(f"{rng.choice('xyzq')}{rng.randrange(999)}$$$" for _ in range(80)) for _ in range(120)]
    docs = frame(spark, [t for p in zip(good, bad, strict=True) for t in p] + ["", None])
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(160)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = zclassify.fit(docs, labels)
    got = {r.doc_id: r.score for r in zclassify.score(clashing(docs), model).collect()}
    assert all((got[k] > 0.5) == (k % 2 == 0) for k in range(160, 240)) and 0 < got[240] < 1 and got[240] == got[241]
    one = zclassify.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in zclassify.score(docs, one).collect()} and zclassify.score(empty(spark), one).count() == 0
    assert zclassify.fit(docs, labels.limit(0)).prior == 0.5
    again = zclassify.fit(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels))
    assert again == model  # rows that repeat count once
    scored = zclassify.score(odd(spark), model).collect()
    assert len(scored) == 9 and len({r.score for r in scored if r.doc_id == 4}) == 1 and [r.score for r in scored if r.doc_id is None]


def test_training_blocks_spread_over_the_whole_text():
    raw = bytes(range(256)) * 4000
    parts = zclassify._blocks(raw, 10 * zclassify.BLOCK_BYTES)
    assert len(parts) == 10 and parts[0] == raw[:1024] and parts[-1] == raw[-1024:]
    assert b"".join(zclassify._blocks(raw)) == raw and zclassify._blocks(b"") == [] and zclassify._blocks(b"x", 10) == [b"x"]


# decontamination


def brute_hits(text, items, window=8):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda c: c[0].lower(), t or "")
    w, hit, found = pattern.findall(low(text)), set(), set()
    for name, item in items:
        v = pattern.findall(low(item))
        m = min(window, len(v))
        for k in range(len(v) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == v[k : k + m]:
                    hit |= set(range(i, i + m))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [10**6, 5])
def test_decontamination_is_exact(spark, block):
    rng = random.Random(7)
    items = [(str(k), " ".join(words(rng, rng.choice((0, 1, 3, 8, 9, 20)), 6))) for k in range(12)] + [("12", None), ("0", "w1 w2 W3")]
    texts = [" ".join(words(rng, rng.randrange(0, 60), 6)) for _ in range(60)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("spans", F.lit(0))
    got = {r.doc_id: r for r in decontam.report(clashing(frame(spark, texts)), bench, max_block_words=block).collect()}
    for k, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        assert (got[k].n_words, got[k].n_hit, sorted(got[k]["items"]), got[k].contaminated) == (n, hit, found, len(found) >= 2)


def test_decontamination_cuts_spans(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = frame(spark, [f"Keep this, {item.upper()}! and that " + "more words " * 20, item, "clean", None])
    got = {r.doc_id: r for r in decontam.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string")).collect()}
    assert set(got) == {0, 2, 3} and got[0].text.startswith("Keep this, ! and that") and got[0].n_chars == len(got[0].text)
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    clash = decontam.decontaminate(clashing(docs), spark.createDataFrame([(1, item), (2, "something else that nobody has")], "item_id bigint, text string"), max_block_words=5)
    assert clash.columns == clashing(docs).columns and {r.doc_id for r in clash.collect()} == {0, 2, 3}
    assert decontam.decontaminate(odd(spark), nothing).count() == 9 and decontam.report(empty(spark), nothing).count() == 0


# near duplicates


def brute_components(texts, percent=85):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        n = len(sets[i] & sets[j])
        if n and 100 * n >= percent * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    return root, [len(s) for s in sets]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    texts = near_copies(rng, words(rng, 120, 10**6), 90, 4)  # a large list with links and near misses
    for _ in range(12):
        texts += near_copies(rng, words(rng, rng.choice((4, 5, 9, 60, 200)), 10**6), rng.choice((1, 2, 5)), 2)
    passage = words(rng, 30, 10**6)
    texts += [" ".join(words(rng, 30, 10**6) + passage) for _ in range(40)] + ["", None, "the same words", "THE same  words", "three words only"]
    rng.shuffle(texts)
    root, sizes = brute_components(texts)
    got = {r.doc_id: r for r in neardup.near_duplicates(clashing(frame(spark, texts))).collect()}
    assert len(set(root)) < len(texts) - 20
    for k in range(len(texts)):
        assert (got[k].component_id, got[k].n_shingles, got[k].kept) == (root[k], sizes[k], root[k] == k)
    kept = neardup.drop_duplicates(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_least_shared_follows_from_the_similarity():
    assert (neardup.shared_of_k(85), neardup.shared_of_k(80)) == (26, 22)
    assert (neardup.least_shared(500), neardup.least_shared(500, 80), neardup.least_shared(24, 80), neardup.least_shared(1, 80)) == (26, 22, 11, 1)


def test_near_dedup_stage_links_from_080(spark):
    rng = random.Random(17)
    texts = []
    for n in (60, 104, 204, 404) * 10:  # n words, cut to lengths that give 0.79 to 0.86 of n - 4 shingles
        w = words(rng, n, 10**6)
        share = rng.choice((0.79, 0.80, 0.81, 0.82, 0.83, 0.84, 0.86))
        texts += [" ".join(w), " ".join(w[: 4 + math.ceil(share * (n - 4))])]
    root, _ = brute_components(texts, 80)
    between = set(root) ^ set(brute_components(texts)[0])
    assert len(between) > 10
    docs = frame(spark, texts)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(root)


def test_near_duplicates_of_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark)).collect()
    assert len(got) == 9 and {(r.doc_id, r.kept) for r in got if r.n_shingles == 0} == {(1, True), (2, True), (3, True)}
    assert {r.component_id for r in got if r.doc_id in (4, 6)} == {4}
    kept = neardup.drop_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components_both_ways(spark):
    rng = random.Random(13)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    want = {(k, v) for k, v in root.items() if k != v}
    for limit in (10**6, 0):
        assert {(r.node, r.root) for r in graph.components(df, limit).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


# quality rules


def test_ledger_measures():
    m = dict(zip(rules.MEASURES, rules.measure("a b c\na b c\n\n#x! $ AB é\u00a0f\na b c"), strict=True))
    assert m == {"n_words": 13, "word_chars": 18, "n_symbols": 2, "n_lines": 4, "n_dup_lines": 2, "n_repeat_words": 9, "n_upper_words": 1, "n_exclamations": 1}
    assert rules.measure(None) == rules.measure("") == (0,) * 8


def test_ledger_of_odd_rows(spark):
    book = {}
    for r in rules.ledger(odd(spark)).collect():
        book.setdefault(r.doc_id, []).append(r)
    assert len(book[4]) == 2 and book[4][0] == book[4][1] and book[5][0].n_words == 60_000 and book[5][0].n_repeat_words == 60_000 and book[None][0].n_words == 3
    assert rules.measure("x" * 1_000_000)[:2] == (1, 1_000_000)


def brute_repeat(text):
    w = text.split()
    spots = [i for i in range(len(w) - 2) for j in range(len(w) - 2) if i != j and w[i : i + 3] == w[j : j + 3]]
    return len({i + k for i in spots for k in range(3)})


def test_repeated_words_equal_brute_force():
    rng = random.Random(17)
    for _ in range(60):
        t = " ".join(words(rng, rng.randrange(0, 40), 4))
        assert rules.measure(t)[5] == brute_repeat(t)


def test_policies_and_ablation(spark):
    clean = " ".join(f"word{k} " for k in range(60))
    docs = frame(spark, [clean, clean.upper(), "short", clean + "*** " * 60, None])
    book = rules.ledger(clashing(docs))
    kept = {r.doc_id: (r.base_failed, r.kept) for r in rules.verdicts(book).collect()}
    assert kept == {0: (False, True), 1: (False, False), 2: (True, False), 3: (False, False), 4: (True, False)}
    assert {r.doc_id for r in rules.verdicts(book, rules.POLICIES[1]).where("kept").collect()} == {0, 1, 3}
    report = {r.rule: r for r in rules.ablation(book).collect()}
    assert report["upper_case_words"].n_failed_alone == 1 and report["upper_case_words"].n_kept_without == 2 and report["too_few_words"].n_failed == 2
    assert [r.doc_id for r in rules.keep_good(docs).collect()] == [0] and rules.keep_good(odd(spark)).columns == odd(spark).columns
    assert rules.ledger(empty(spark)).count() == 0 and rules.ablation(rules.ledger(empty(spark))).count() == 0


# segmentations


@pytest.fixture(scope="module")
def vocab():
    return gumbel.Vocabulary(Path(gumbel.VOCABULARY).read_bytes())


def all_segmentations(text):
    """Every segmentation with its probability, by enumeration of the vocabulary file's pieces over the whole text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=gumbel.VOCABULARY)
    n = model.get_piece_size()
    ids = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
    rank = {k: r for r, k in enumerate(sorted(ids, key=model.get_score, reverse=True))}
    pieces = {model.id_to_piece(k): k for k in ids}
    byte = {model.id_to_piece(k): k for k in range(n) if model.is_byte(k)}
    whole, longest = "▁" + text.replace(" ", "▁"), max(map(len, pieces))
    weight = lambda r: (r + gumbel.OFFSET) ** -gumbel.POWER
    ends = {len(whole): {(): 1.0}}
    for at in range(len(whole) - 1, -1, -1):
        found = {}
        fits = [(whole[at:to], to) for to in range(at + 1, min(len(whole), at + longest) + 1) if whole[at:to] in pieces]
        edges = [((pieces[x],), weight(rank[pieces[x]]), to) for x, to in fits]
        edges = edges or [(tuple(byte[f"<0x{b:02X}>"] for b in whole[at].encode()), weight(n), at + 1)]
        for own, w, to in edges:
            for rest, x in ends[to].items():
                found[(*own, *rest)] = w * x
        ends[at] = found
    total = sum(ends[0].values())
    return {p: w / total for p, w in ends[0].items()}


def drawn_ids(vocab, lat, path):
    return tuple(gumbel._ids(vocab, lat, path).tolist())


def decoded(vocab, ids):
    return vocab.decode(htmlmain.np.array(ids, "int32"), htmlmain.np.array([len(ids)]))[0].as_py()


@pytest.mark.parametrize("text", ["the invoice a", "na\u00efve \U0001d54f\u2603 x\ny", "  two"])
def test_lattice_has_the_segmentations_of_the_vocabulary(vocab, text):
    paths = all_segmentations(text)
    assert all(decoded(vocab, p) == text for p in paths)
    lat, found = gumbel.sample(vocab, [text], [3], len(paths) + 2)
    got = {drawn_ids(vocab, lat, path): math.exp(log_prob) for path, log_prob, _ in found[0].samples}
    assert got == pytest.approx(paths)


def test_units_of_any_length(vocab):
    text = "ab" * 400 + "\n" + "x" * 300 + " " * 600 + "y"
    lat, found = gumbel.sample(vocab, [text], [1], 2)
    for path, _, _ in found[0].samples:
        assert decoded(vocab, drawn_ids(vocab, lat, path)) == text


def test_pieces_across_spaces_are_refused(monkeypatch):
    import sentencepiece

    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, k):
            return "of\u2581the" if k == 1000 else super().id_to_piece(k)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cross"):
        gumbel.Vocabulary(Path(gumbel.VOCABULARY).read_bytes())


def test_samples_follow_the_distribution(vocab):
    text, n = "the art", 4000
    paths = all_segmentations(text)
    lat, found = gumbel.sample(vocab, [text] * n, list(range(n)), 2)
    first, pairs = {}, 0
    for s in found:
        ids = [drawn_ids(vocab, lat, path) for path, _, _ in s.samples]
        assert ids[0] != ids[1] and s.samples[0][2] > s.samples[1][2]
        assert s.samples[0][1] == pytest.approx(math.log(paths[ids[0]]))
        first[ids[0]] = first.get(ids[0], 0) + 1
        pairs += ids[1] == max(paths, key=paths.get)
    for p, share in paths.items():
        assert abs(first.get(p, 0) / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3
    top = max(paths.values())
    second = sum(q * top / (1 - q) for q in paths.values() if q != top)  # without replacement
    assert abs(pairs / n - second) < 5 * (second * (1 - second) / n) ** 0.5 + 2e-3


def test_all_segmentations_come_out_in_order(vocab):
    paths = all_segmentations("art")
    lat, found = gumbel.sample(vocab, ["art"], [5], len(paths) + 3)
    got = [drawn_ids(vocab, lat, p) for p, _, _ in found[0].samples]
    assert set(got) == set(paths) and len(got) == len(paths) and not found[0].queue
    values = [v for _, _, v in found[0].samples]
    assert values == sorted(values, reverse=True)


def test_encoding_round_trips_and_is_seeded(spark):
    docs = odd(spark)
    rows = gumbel.encode(docs, gumbel.VOCABULARY, samples=3).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in rows} == texts and all(0 <= r.inclusion <= 1 and r.n_pieces == len(r.ids) for r in rows)
    again = gumbel.encode(docs.repartition(7), gumbel.VOCABULARY, samples=3).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.ids, r.log_prob)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    other = gumbel.encode(docs, gumbel.VOCABULARY, samples=3, seed=1).collect()
    assert sorted(map(key, rows)) != sorted(map(key, other)) and gumbel.encode(empty(spark), gumbel.VOCABULARY).count() == 0


def encoder(spark, monkeypatch):
    """What a Python worker runs for ``encode``: batches of (doc_id, text, key) to batches of samples."""
    taken, df = [], frame(spark, ["a"])
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: taken.append(run) or self)
    gumbel.encode(df, gumbel.VOCABULARY)
    return taken[0]


def batch_of(texts):
    n = pa.array(range(len(texts)), pa.int64())
    return pa.record_batch([n, pa.array(texts, pa.string()), n], ["doc_id", "text", "key"])


def letters(rng, n, most=9):
    """Words that are mostly distinct."""
    return ["".join(rng.choices("etaoinsrhldcumfpgwybvk", k=rng.randint(2, most))) for _ in range(n)]


def test_encoding_takes_little_memory(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(letters(rng, 400)) for _ in range(500)]
    run = encoder(spark, monkeypatch)
    list(run(iter([batch_of(["a"])])))  # the vocabulary is read
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch_of(texts)])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 1000 and peak < 100 * sum(map(len, texts))


def test_samples_do_not_depend_on_what_is_drawn_together(spark, monkeypatch):
    rng = random.Random(6)
    texts = [None, "", "\U0001d54f\u2603", "x" * 300, " ", *(" ".join(letters(rng, rng.randrange(40), 30)) for _ in range(40)), None, "\n\n a"]
    run = encoder(spark, monkeypatch)
    want = pa.Table.from_batches(run(iter([batch_of(texts)]))).to_pylist()
    assert [r["text"] for r in want if r["sample"] == 0] == texts
    for sizes in ((1, 1, 1), (900, 70, 200), (10**6, 50, 10**6), (10**6, 10**6, 50)):
        for name, size in zip(("CHUNK_CHARS", "BLOCK_CHARS", "SLICE_CHARS"), sizes, strict=True):
            monkeypatch.setattr(gumbel, name, size)
        assert pa.Table.from_batches(run(iter([batch_of(texts)]))).to_pylist() == want
