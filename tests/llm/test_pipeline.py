"""Registered queries and the pipeline on the smallest tables."""

import itertools
import re
import sys
import zlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from webloom.llm import linedup, queries

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_components, brute_deletions, empty, odd  # noqa: E402

SF = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(tuple(None if x is None else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert canonical(got) == canonical(want)


def test_quality_is_held_out_and_good(spark):
    got = queries.op6_quality(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet").merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert len(held) and (held.predicted == held.quality).mean() > 0.75


def test_sentencepiece_query_decodes_every_row(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_sentencepiece(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.text == texts[r.doc_id] for r in rows)


def test_shards_query_keeps_its_law(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = queries.op1_shard(spark, SF).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs) and set(got.law) == {"bytes"} and (got["size"] == got.text.str.encode("utf-8").str.len() + 8).all()
    assert (got.text_crc32 == [zlib.crc32(t.encode()) for t in got.text]).all() and got.groupby("text").shard.nunique().max() == 1
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    loads = got.groupby("shard")["size"].sum().reindex(range(24), fill_value=0)
    assert loads.max() - loads.min() <= 2 * got.groupby("text")["size"].sum().max()


def test_line_dedup_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    want = brute_deletions(list(docs.text))
    got = {r.doc_id: list(r.deleted) for r in queries.op5_line_dedup(spark, SF).collect()}
    assert [got[k] for k in docs.doc_id] == want


def cut_by_hand(text, items):
    """``text`` without the benchmark spans, or None if they cover more than half of its words."""
    spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    low = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x)
    w, hit = [low(text[a:b]) for a, b in spots], set()
    for item in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item))
        m = min(8, len(v))
        wanted = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
        hit |= {i + k for i in range(len(w) - m + 1) if m and tuple(w[i : i + m]) in wanted for k in range(m)}
    if len(hit) > 0.5 * len(w):
        return None
    out, done = [], 0
    for _, run in itertools.groupby(enumerate(sorted(hit)), lambda p: p[1] - p[0]):
        run = [k for _, k in run]
        out.append(text[done : spots[run[0]][0]])
        done = spots[run[-1]][1]
    return " ".join(x.strip(" ") for x in [*out, text[done:]] if x.strip(" ")) if hit else text


def test_stages_equal_brute_force(spark):
    """Each stage's whole output on its predecessor's, by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        if name == "quality_rules":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
            good = con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op9_quality_rules']}) WHERE kept").fetchall()
            texts = {i: texts[i] for (i,) in good}
        elif name == "line_dedup":
            ids = sorted(texts)
            want = {}
            for i, gone in zip(ids, brute_deletions([texts[i] for i in ids]), strict=True):
                left = linedup._without(texts[i], gone) if gone else texts[i]
                if not gone or len(left.split()) >= max(1, 0.2 * len(texts[i].split())):
                    want[i] = left
            texts = want
        elif name == "near_dedup":
            ids = sorted(texts)
            root, _ = brute_components([texts[i] for i in ids], 80)
            texts = {ids[k]: texts[ids[k]] for k in sorted(set(root))}
        else:
            texts = {i: t for i, x in texts.items() if (t := cut_by_hand(x, items)) is not None}
        assert {r.doc_id: (r.text, r.n_chars) for r in now.collect()} == {i: (t, len(t)) for i, t in texts.items()}, name


def test_stages_take_odd_tables(spark):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (odd(spark), empty(spark)):
            out = stage(spark, table, SF)
            assert out.columns == table.columns, name
            assert out.count() <= table.count()


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert 0.4 * n < docs.count() <= n
    left = spark.read.parquet(str(tmp_path / "decontamination"))
    texts = {r.doc_id: r.text for r in left.collect()}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.text == texts[r.doc_id] for r in rows)
    assert sorted((r.doc_id, r.sample, r.ids) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.sample, r.ids) for r in rows)
