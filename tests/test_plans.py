"""Every query agrees with its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import netloom.plans as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_agrees_with_sql(spark, con, name):
    df = plans.QUERIES[name](spark, DATA)
    oracle = con.sql(plans.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(oracle.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [oracle.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in oracle.fetchall()), key=repr)


def test_a_query_inflates_the_bodies_of_all_pages(spark):
    got = plans.QUERIES["coded_bodies"](spark, DATA)
    assert got.filter("bytes is null or body_sha256 is null").count() == 0 and got.count() == spark.read.parquet(f"{DATA}/pages.parquet").count()


def test_a_query_compares_the_urls_of_all_pages(spark):
    got, urls = plans.QUERIES["url_set_compare_all"](spark, DATA).first(), {r["url"].split("#")[0] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("url").collect() if r["url"]}
    bare = {u.split("?")[0] for u in urls}
    assert (got["left_only"], got["right_only"], got["in_both"]) == (len(urls - bare), len(bare - urls), len(urls & bare))


def test_har_export_keeps_every_request(spark):
    import json

    rows = plans.QUERIES["har_export"](spark, DATA).collect()
    entries = [e for r in rows for e in json.loads(r["har"])["log"]["entries"]]
    assert len(entries) == 1500
    starts = [[e["startedDateTime"] for e in json.loads(r["har"])["log"]["entries"]] for r in rows]
    assert all(s == sorted(s) for s in starts)


def test_entry_imports_without_the_corpus_operators(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "netloom.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    import __spark_entry__ as e

    assert set(e.queries()) == set(plans.QUERIES)
    sys.modules.pop("__spark_entry__")
