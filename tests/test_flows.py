"""Flows of a stream must be told as a table's are."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import sequences
from netloom.streaming import flows

from tests.test_streaming import emitted

SCHEMA = "flow string, time_us long, ord long, seq long, size long, ts timestamp"


@pytest.fixture
def store(spark):
    name, value = flows.STORE
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, before)


def packets(spark, seed):
    rng, rows, base = random.Random(seed), [], 1_700_000_000_000_000
    for f in range(6):
        at, seq = base + rng.randrange(10**6), 0
        for i in range(80):
            at += rng.choice([0, 500, 3000, 60_000])
            size = rng.randrange(1, 1500)
            rows.append((f"f{f}", at, i, seq + rng.choice([0, 0, 0, -200, 900]), size))
            seq += size
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "flow string, time_us long, ord long, seq long, size long")
    return df.withColumn("ts", F.timestamp_micros("time_us")), base


def test_streams_of_flows_equal_tables(spark, tmp_path, store):
    table, base = packets(spark, 4)
    table.repartition(5).write.parquet(f"{tmp_path}/in")  # several triggers, in any order, within the delay
    ahead = spark.createDataFrame([("z", base + 10**9, 0, 0, 1)], "flow string, time_us long, ord long, seq long, size long").withColumn("ts", F.timestamp_micros("time_us"))
    ahead.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    got = emitted(flows.reassembled(stream()), f"{tmp_path}/a")
    right = sequences.reassembly(table, "flow", ["time_us", "ord"], "seq", "size")
    key = lambda df: sorted(map(tuple, df.select("flow", "packets", "duplicates", "holes", "new_bytes", "repeated_bytes").collect()))
    assert key(got) == key(right)
    got = emitted(flows.peaks(stream()), f"{tmp_path}/b")
    right = sequences.throughput(table, ["flow"], "time_us", "size", 100_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, right.select("flow", "peak_kbps").collect()))


def test_an_idle_flow_is_told_and_begins_anew(spark, tmp_path, store):
    at = lambda s: 1_700_000_000_000_000 + s * 1_000_000
    rows = [("a", at(0), 0, 0, 10), ("a", at(1), 1, 10, 10), ("a", at(100), 2, 500, 10), ("a", at(101), 3, 500, 10), (None, at(0), 0, 0, 1), ("z", at(1000), 0, 0, 1)]
    df = spark.createDataFrame(rows, "flow string, time_us long, ord long, seq long, size long").withColumn("ts", F.timestamp_micros("time_us"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = emitted(flows.reassembled(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), tmp_path)
    assert sorted(map(tuple, got.collect())) == [("a", 2, 0, 0, 20, 0), ("a", 2, 1, 0, 10, 10)]


def test_the_store_is_asked_for(spark):
    with pytest.raises(ValueError, match="providerClass"):
        flows.reassembled(packets(spark, 1)[0])
