"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from webloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_audit_actions_compare_contents(spark, tmp_path):
    words = " ".join(f"alpha{k} beta{k}" for k in range(80))
    html = "<html lang=\"en\"><head><title>{}</title></head><body><article><h1>{}</h1><p>{}</p></article></body></html>"
    rows = [(k, f"https://example.com/{k}", html.format(f"The title of page {k} here", f"Head {k}", w)) for k, w in enumerate((words, words, words.replace("a", "o")))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert any("content.duplicate" in str(r) for r in catalog.QUERIES["audit_actions"](spark, str(tmp_path)).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
