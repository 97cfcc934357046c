"""HTTP/1 requests in packet captures: messages begin where a segment begins with a request or status line.

Segments are numbered by message with window functions, so that a connection of any size is no more than sorted rows; only
the head of a message is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import bare_mime, header, leading_int, split_header, status_of
from netloom.operators.ownership import first_per
from netloom.operators.sequences import segments, unwrapped

#: Methods of requests, ports of lookups and of encrypted connections, and the preface of HTTP/2.
METHODS = ("GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS", "PATCH", "CONNECT", "TRACE")
LOOKUP_PORT, SECURE_PORT, PREFACE = 53, 443, "PRI * HTTP/2.0"
#: Bytes of a message's head at most.
HEAD = 256 << 10
_KEY = ("capture", "flow", "generation")


def protocol(proto: Column, src_port: Column, dst_port: Column, payload: Column) -> Column:
    """What a packet's payload speaks, by its first bytes and its ports; null where nothing tells."""
    text, first = F.decode(F.substring(payload, 1, 32), "ISO-8859-1"), F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).try_cast("int")
    at = lambda port: (src_port == port) | (dst_port == port)
    return (
        F.when(at(LOOKUP_PORT), "dns")
        .when((proto == "udp") & at(SECURE_PORT) & (first.bitwiseAND(0x40) != 0), "quic")
        .when((proto == "tcp") & text.startswith(PREFACE), "http2")
        .when((proto == "tcp") & (text.rlike(rf"^({'|'.join(METHODS)}) ") | text.startswith("HTTP/1.")), "http1")
        .when((proto == "tcp") & F.hex(F.substring(payload, 1, 2)).isin("1603"), "tls")
    )


def new_segments(flows: DataFrame) -> DataFrame:
    """The segments of TCP connections in order, without those that were seen before: their payload and size, and the direction as ``side``."""
    data = flows.filter("proto = 'tcp' and length(payload) > 0").withColumn("side", F.concat_ws(" ", "flow", F.col("generation").cast("string"), F.col("forward").cast("string")))
    whole = unwrapped(data, "side", ["time_us", "ord"], "seq").withColumn("size", F.length("payload").cast("long"))
    top = F.max(F.col("seq") + F.col("size")).over(Window.partitionBy("side").orderBy("time_us", "ord").rowsBetween(Window.unboundedPreceding, -1))
    seen = whole.withColumn("_top", top)
    return seen.filter(F.col("_top").isNull() | (F.col("seq") + F.col("size") > F.col("_top"))).drop("_top")


def _messages(rows: DataFrame, begins: Column) -> DataFrame:
    """One row for each message of a direction: its number from 1 on, times, bytes, first line and headers."""
    order = ["time_us", "ord"]
    told = segments(rows.withColumn("_b", begins), "side", order, F.col("_b"), "n").filter("n > 0")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("side", "n").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.when(before < HEAD, F.struct(*order, "payload"))
    one = told.withColumn("_head", head).groupBy(*_KEY, "side", "n").agg(
        F.min("time_us").alias("begin"), F.max("time_us").alias("end"), F.sum("size").alias("bytes"), F.min(F.struct(*order, "src_ip", "src_port", "dst_ip", "dst_port")).alias("first"), F.sort_array(F.collect_list("_head")).alias("parts")
    )
    text = F.decode(F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["payload"])), "ISO-8859-1")
    lines = F.split(F.split(text, "\r\n\r\n")[0], "\r\n")
    one = one.withColumn("lines", lines).drop("parts")
    return one.withColumns({"line": F.col("lines")[0], "headers": F.filter(F.transform(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), split_header), lambda h: h.isNotNull())}).drop("lines")


def http1_requests(flows: DataFrame) -> DataFrame:
    """Requests over plain connections with their answers: the n-th answer of a connection goes to its n-th request.

    capture, flow, generation, n, method, url, host, status, mime, headers, response_headers, server_ip, server_port, start, first_byte,
    end (us), bytes_out, bytes_in, length. A connection whose direction of requests is not known has none.
    """
    rows = new_segments(flows)
    text = F.decode(F.substring("payload", 1, 16), "ISO-8859-1")
    asked = _messages(rows, text.rlike(rf"^({'|'.join(METHODS)}) "))
    told = _messages(rows, text.rlike(r"^HTTP/1\.[01] \d{3}"))
    answers = told.select(*_KEY, "n", F.col("begin").alias("first_byte"), F.col("end").alias("_end"), F.col("bytes").alias("bytes_in"), F.col("headers").alias("response_headers"), status_of(F.col("line")).alias("status"))
    both = asked.join(answers, [*_KEY, "n"], "left")
    target = F.regexp_extract("line", r"^\S+ (\S+)", 1)
    host = F.coalesce(header(F.col("headers"), "host"), F.col("first.dst_ip"))
    return both.select(
        *_KEY,
        "n",
        F.regexp_extract("line", r"^(\S+)", 1).alias("method"),
        F.when(target.rlike("^https?://"), target).otherwise(F.concat(F.lit("http://"), host, target)).alias("url"),
        F.regexp_replace(host, r":\d+$", "").alias("host"),
        "status",
        bare_mime(header(F.col("response_headers"), "content-type")).alias("mime"),
        "headers",
        "response_headers",
        F.col("first.dst_ip").alias("server_ip"),
        F.col("first.dst_port").alias("server_port"),
        F.col("begin").alias("start"),
        "first_byte",
        F.greatest("end", "_end").alias("end"),
        F.col("bytes").alias("bytes_out"),
        F.coalesce("bytes_in", F.lit(0)).alias("bytes_in"),
        leading_int(header(F.col("response_headers"), "content-length")).alias("length"),
    )


def with_lookups(requests: DataFrame, lookups: DataFrame) -> DataFrame:
    """requests with dns_start and dns_end of the first lookup of their host that found their server."""
    found = lookups.select("capture", F.col("name").alias("host"), F.explode("addresses").alias("server_ip"), F.col("start").alias("dns_start"), F.col("end").alias("dns_end"))
    first = first_per(found, ["capture", "host", "server_ip"], ["dns_end", "dns_start"])
    return requests.join(first, ["capture", "host", "server_ip"], "left")
