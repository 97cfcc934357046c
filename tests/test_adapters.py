"""Chunks are put in order in tasks of bounded size, dealt by their request once."""

import pytest
from pyspark.sql import functions as F

import netloom.plans as plans
from netloom.plans import adapters

DATA = "/root/testdata/sf0.001"


def exchanges(df, capsys):
    df.explain()
    return capsys.readouterr().out.count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["inflated_attach", "chunk_deltas"])
def test_tasks_do_not_grow_with_the_chunks(spark, monkeypatch, capsys, name):
    whole = sorted(map(tuple, plans.QUERIES[name](spark, DATA).collect()), key=repr)
    monkeypatch.setattr(adapters, "_ROWS", 300, raising=False)
    got = plans.QUERIES[name](spark, DATA)
    assert exchanges(got, capsys) == 1
    assert sorted(map(tuple, got.collect()), key=repr) == whole
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 18 and max(sizes) < 600


def test_tasks_stay_small_where_the_requests_are_shuffled_too(spark, monkeypatch, capsys):
    whole = sorted(map(tuple, plans.QUERIES["chunk_deltas"](spark, DATA).collect()))
    monkeypatch.setattr(adapters, "_ROWS", 300, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = plans.QUERIES["chunk_deltas"](spark, DATA)
        assert exchanges(got, capsys) == 2  # of chunks and of requests, once each
        assert sorted(map(tuple, got.collect())) == whole
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) >= 18 and max(sizes) < 600
