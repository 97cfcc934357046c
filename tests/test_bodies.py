import gzip
import zlib

import zstandard
from pyspark.sql import functions as F

from netloom.functions.bodies import decoded_body, inflated_per_chunk, plain_body


def test_codings(spark):
    text = b"hello " * 50_000
    raw = zlib.compressobj(wbits=-15)
    bare = raw.compress(text) + raw.flush()
    cases = [
        (1, gzip.compress(text), "gzip", text), (2, zlib.compress(text), "deflate", text), (3, bare, "Deflate", text), (4, zstandard.compress(text), "zstd", text),
        (5, text, None, text), (6, text, "identity", text), (7, text, "br", None), (8, None, "gzip", None), (9, b"", "gzip", b""),
        (10, gzip.compress(zlib.compress(text)), "deflate, gzip", text), (11, b"no gzip", "gzip", b""), (12, b"raw", "x-other", b"raw"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "i int, body binary, coding string")
    got = {r["i"]: r["p"] if r["p"] is None else bytes(r["p"]) for r in df.select("i", plain_body(F.col("body"), F.col("coding")).alias("p")).collect()}
    assert got == {i: want for i, _, _, want in cases}
    whole = gzip.compress(bytes(range(256)) * 4000)
    cut = spark.createDataFrame([(whole[: len(whole) // 2], "gzip")], "body binary, coding string").select(plain_body(F.col("body"), F.col("coding")).alias("p")).first()["p"]
    assert 0 < len(cut) < 1_024_000 and (bytes(range(256)) * 4000).startswith(bytes(cut))


def test_states_and_chunks(spark):
    body = gzip.compress(b"x" * 100_000)
    cases = [(1, body, "gzip", "decoded"), (2, body[:50], " GZIP ", "partial"), (3, b"a", "br", "undecoded"), (4, b"a", "odd", "unknown"), (5, b"a", None, "plain"), (6, None, "gzip", "plain")]
    df = spark.createDataFrame([c[:3] for c in cases], "i int, body binary, coding string")
    assert {r["i"]: r["s"] for r in df.select("i", decoded_body(F.col("body"), F.col("coding"))["state"].alias("s")).collect()} == {c[0]: c[3] for c in cases}
    parts = [body[:20], body[20:60], body[60:]]
    df = spark.createDataFrame([(1, parts, "gzip"), (2, parts, "br"), (3, parts, None), (4, [], "gzip")], "i int, parts array<binary>, coding string")
    got = {r["i"]: r["s"] for r in df.select("i", inflated_per_chunk(F.col("parts"), F.col("coding")).alias("s")).collect()}
    assert (len(got[1]), sum(got[1]), got[2], got[3], got[4]) == (3, 100_000, None, [20, 40, len(body) - 60], [])
