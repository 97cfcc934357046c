"""Streams must emit what the same functions give over a table; lookups are decoded from hand-made messages."""

import struct
from datetime import datetime, timedelta

import pytest

from netloom.sources import lookups
from netloom.streaming import captures

T0 = datetime(2024, 1, 1)
SCHEMA = "conn string, ts timestamp, bytes long"


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def rows_of(df):
    return sorted(map(str, df.collect()))


def emitted(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@pytest.mark.parametrize("name", ["tumbling", "sliding", "sessions"])
def test_stream_matches_table(spark, tmp_path, name):
    f = {
        "tumbling": lambda d: captures.windowed_totals(d, ["conn"], "ts", "bytes"),
        "sliding": lambda d: captures.windowed_totals(d, ["conn"], "ts", "bytes", slide="50 milliseconds"),
        "sessions": lambda d: captures.connection_sessions(d, ["conn"], "ts", "bytes"),
    }[name]
    some = [(c, at(ms), n) for c, ms, n in [("a", 0, 5), ("a", 40, 7), ("a", 40, 7), ("b", 130, 1), (None, 150, 2), ("a", 50_000, 9), ("b", 90_000, None)]]
    # A row far ahead lets the watermark pass all others; it stays in the state itself.
    spark.createDataFrame([*some, ("z", at(10_000_000), 0)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = emitted(f(captures.follow(spark, f"{tmp_path}/in", SCHEMA)), tmp_path)
    assert rows_of(got) == rows_of(f(spark.createDataFrame(some, SCHEMA)))


def test_answers(spark):
    asked = spark.createDataFrame([("a", at(0)), ("b", at(0)), (None, at(0))], "conn string, ts timestamp")
    answers = spark.createDataFrame([("a", at(100)), ("a", at(9000)), ("b", at(-1)), (None, at(1))], "conn string, ts timestamp")
    got = {(r.conn, r.answered_at) for r in captures.answered(asked, answers, ["conn"], "ts").collect()}
    assert got == {("a", at(100)), ("b", None), (None, None)}


def test_lookups(spark):
    name = b"\x03www\x04Site\x03org\x00"
    head = lambda flags, told: struct.pack(">HHHHHH", 7, flags, 1, told, 0, 0)
    question = head(0x0100, 0) + name + struct.pack(">HH", 1, 1)
    alias = b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 4) + b"\x01x\xc0\x10"
    address = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([10, 0, 0, 9])
    answer = head(0x8180, 2) + question[12:] + alias + address
    assert lookups.message(question) == (7, False, 0, "www.site.org", [], [])
    assert lookups.message(answer) == (7, True, 0, "www.site.org", ["10.0.0.9"], ["x.site.org"])
    assert all(lookups.message(answer[:n]) is None for n in range(13, len(answer)))
    assert lookups.message(head(0, 0) + b"\xc0\x0c") is None
    ends = [("10.0.0.1", 5000, "8.8.8.8", 53), ("8.8.8.8", 53, "10.0.0.1", 5000)]
    wire = [("c", i, t, *ends[e], "udp", d) for i, (t, e, d) in enumerate([(10, 0, question), (20, 0, question), (35, 1, answer), (50, 1, b"x")])]
    packets = spark.createDataFrame(wire, "capture string, ord long, time_us long, src_ip string, src_port int, dst_ip string, dst_port int, proto string, payload binary")
    got = lookups.lookups(lookups.messages(packets)).collect()
    assert [(r.client, r.name, r.start, r.end, r.addresses) for r in got] == [("10.0.0.1 5000", "www.site.org", 20, 35, ["10.0.0.9"])]
