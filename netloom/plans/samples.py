"""Queries over addresses, status, headers and sampled series."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions import network as N
from netloom.functions.bodies import plain_body
from netloom.operators import layout
from netloom.operators import series as S
from netloom.plans.adapters import REQUESTS, epoch_us, requests, table

_HOSTS = ("LocalHost", "api.internal", "www.example.org", "[::1]", "[fd12:3::4]", "[2001:db8::1]", "[::ffff:10.1.2.3]", "[::ffff:8.8.8.8]", "printer.local", "")


def private_hosts(spark, d):
    k = F.col("o_orderkey")
    quad = F.concat_ws(".", *[(k * a % b).cast("string") for a, b in ((37, 263), (11, 256), (7, 256), (1, 256))])
    host = F.when(k % 4 == 0, F.element_at(F.array(*map(F.lit, _HOSTS)), (F.expr("o_orderkey div 4") % len(_HOSTS) + 1).cast("int"))).otherwise(quad)
    return table(spark, d, "orders").select("o_orderkey", host.alias("host")).select("o_orderkey", "host", N.is_private_host(F.col("host")).alias("is_private"))


_PRIVATE = f"""
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN ({list(_HOSTS)!r})[o_orderkey // 4 % {len(_HOSTS)} + 1]
        ELSE concat_ws('.', o_orderkey * 37 % 263, o_orderkey * 11 % 256, o_orderkey * 7 % 256, o_orderkey % 256) END AS host FROM orders),
p AS (SELECT *, TRY_CAST(split_part(host, '.', 1) AS INT) AS a, TRY_CAST(split_part(host, '.', 2) AS INT) AS b, TRY_CAST(split_part(host, '.', 3) AS INT) AS c FROM h)
SELECT o_orderkey, host, CASE WHEN o_orderkey % 4 = 0 THEN host IN ('LocalHost', 'api.internal', '[::1]', '[fd12:3::4]', '[::ffff:10.1.2.3]', 'printer.local', '')
    ELSE a IN (0, 10, 127) OR a >= 224 OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 0)
        OR (a = 100 AND b BETWEEN 64 AND 127) END AS is_private FROM p
"""


def status_classes(spark, d):
    r = requests(spark, d).withColumn("code", F.element_at(F.array(*map(F.lit, (200, 301, 304, 404, 0, -1, 503))), (F.col("req") % 7 + 1).cast("int")))
    url = F.concat(F.lit("https://h/"), (F.expr("req div 3") % 5).cast("string"), F.lit("?q="), F.col("req").cast("string"), F.lit("#f"))
    first = F.first(N.document_part(url)).over(Window.partitionBy("page").orderBy("start", "req"))
    return r.select("page", "req", N.status_class(F.col("code")).alias("class"), N.time_label(F.col("req") / 2, F.col("code")).alias("label"), (N.document_part(url) != first).alias("is_cross_document"))


_STATUS = f"""
WITH {REQUESTS}, c AS (SELECT *, ([200, 301, 304, 404, 0, -1, 503])[req % 7 + 1] AS code, (req // 3) % 5 AS doc FROM r)
SELECT page, req, CASE WHEN code IN (404, 503, 0) THEN 'error' WHEN code = 301 THEN 'warning' ELSE 'ok' END AS class,
    CAST((req + 1) // 2 AS VARCHAR) || ' ms' || CASE WHEN code = 0 THEN ' (request canceled)' WHEN code = 200 THEN '' ELSE ' (' || code || ')' END AS label,
    doc <> first_value(doc) OVER (PARTITION BY page ORDER BY start, req) AS is_cross_document FROM c
"""


def page_document(spark, d):
    return S.page_document(requests(spark, d), "page", ["start", "req"], (F.col("status") == 200) & (F.col("priority") == "1-URGENT"), "req", "start")


def time_order(spark, d):
    r = requests(spark, d).select("req", (F.col("req") * 13 % 50).alias("s"), F.when(F.col("req") % 5 != 0, F.col("req") * 7 % 60).alias("f"), F.when(F.col("req") % 7 != 0, F.col("req") * 11 % 70).alias("e"))
    first, end = N.ordered_times(F.col("s"), F.col("f"), F.col("e"))
    return r.select("req", F.col("s").alias("start"), first.alias("first_byte"), end.alias("end"))


_TIME_ORDER = f"""
WITH {REQUESTS}, t AS (SELECT req, req * 13 % 50 AS s, CASE WHEN req % 5 <> 0 THEN req * 7 % 60 END AS f, CASE WHEN req % 7 <> 0 THEN req * 11 % 70 END AS e FROM r),
g AS (SELECT req, s, e, CASE WHEN f < s THEN s ELSE f END AS f, CASE WHEN e < s THEN s ELSE e END AS e1 FROM t)
SELECT req, s AS start, f AS first_byte, CASE WHEN e1 < f THEN f ELSE e1 END AS "end" FROM g
"""


def header_merge(spark, d):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.concat(F.lit(v), F.col("req").cast("string")).alias("value"))
    r = requests(spark, d).withColumn("extra", F.when(F.col("req") % 2 == 0, F.array(pair("ACCEPT", "x"), pair("Cookie", "c"))).otherwise(F.array(pair("host", "y"))))
    merged = N.merge_headers(F.array(pair("Host", "h"), pair("accept", "a")), F.col("extra"))
    return r.select("req", F.array_join(F.transform(merged, lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n").alias("headers"))


def response_ordinals(spark, d):
    e = table(spark, d, "events").filter("event_type in ('click', 'view', 'signup')")
    return S.pair_by_ordinal(e, "user_id", ["ts", "event_id"], F.col("event_type") != "signup", "event_id")


_ORDINALS = """
WITH e AS (SELECT *, event_type <> 'signup' AS q FROM events WHERE event_type IN ('click', 'view', 'signup')),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, q ORDER BY ts, event_id) AS ordinal FROM e)
SELECT a.user_id, a.ordinal, a.event_id AS request, b.event_id AS response FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND a.ordinal = b.ordinal AND NOT b.q WHERE a.q
"""


def host_of_address(spark, d):
    lookups = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(F.col("o_custkey") % 50, F.col("o_orderkey") % 70)).alias("address"))
    first = lookups.groupBy("address").agg(F.min_by("o_custkey", "o_orderkey").alias("host"))
    return table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 90).alias("address")).join(first, "address", "left").select("c_custkey", "host")


_HOST_OF = """
WITH l AS (SELECT o_orderkey, o_custkey, unnest([o_custkey % 50, o_orderkey % 70]) AS address FROM orders),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY address ORDER BY o_orderkey) = 1)
SELECT c_custkey, f.o_custkey AS host FROM customer LEFT JOIN f ON c_custkey % 90 = f.address
"""


def sequence_clock(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 17 == 0, F.col("event_id") * 1000 + 1).alias("absolute"), (F.col("event_id") * 7 % 90 + 1).alias("delta"), (F.col("event_id") * 100).alias("packet"))
    return S.sequence_clock(e, "user_id", "event_id", "absolute", "delta", "packet").select("user_id", "event_id", "clock")


_CLOCK = """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 17 = 0 THEN event_id * 1000 + 1 END AS a, event_id * 7 % 90 + 1 AS dt FROM events),
g AS (SELECT *, count(a) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e),
b AS (SELECT user_id, k, coalesce(max(a), min(event_id) * 100) AS base FROM g GROUP BY ALL)
SELECT user_id, event_id, CAST(base + sum(CASE WHEN a IS NULL THEN dt ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY event_id) AS BIGINT) AS clock FROM g JOIN b USING (user_id, k)
"""


def utilization_steps(spark, d):
    us = epoch_us("ts")
    t = F.when(F.col("event_id") % 4 == 0, us).when(F.col("event_id") % 4 == 1, F.expr("event_id % 5000")).when(F.col("event_id") % 4 == 2, F.expr("event_id % 90 * 1000000")).otherwise(F.lit(-5))
    e = table(spark, d, "events").select("user_id", "event_id", "value", S.repair_unit(t.cast("double"), F.lit(1704067200000.0), F.lit(600000.0)).alias("at"))
    return S.steps(e.filter("at between 0 and 600000"), "user_id", ["at", "event_id"], "at", "value")


_STEPS = """
WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) AS us FROM events), m AS (SELECT *, CASE event_id % 4 WHEN 0 THEN us / 1000.0 - 1704067200000.0 WHEN 1 THEN CAST(event_id % 5000 AS DOUBLE) WHEN 2 THEN event_id % 90 * 1000000.0 ELSE -5.0 END AS ms FROM e),
p AS (SELECT *, CAST(CASE WHEN ms > 30000000 THEN ms / 1000 ELSE ms END AS DOUBLE) AS x FROM m)
SELECT user_id, coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY x, event_id), x) AS x0, x AS x1, value FROM p WHERE x BETWEEN 0 AND 600000
"""


def smooth_slices(spark, d):
    s = requests(spark, d).groupBy("page", "priority", (F.col("req") % 512).alias("i")).agg(F.sum(F.col("req") * 7 % 1000).alias("us"))
    return S.smooth_slices(s, ["page", "priority"], "i", "us", 1000, 512, 200, 2.5, 8.0)


_SMOOTH = f"""
WITH {REQUESTS}, s AS (SELECT page, priority, req % 512 AS i, sum(req * 7 % 1000) AS us FROM r GROUP BY ALL),
x AS (SELECT p AS pixel, 8 + (p + 0.5) * 2.5::DOUBLE - 1.25 AS a, least(512.0::DOUBLE, 8 + (p + 0.5) * 2.5::DOUBLE + 1.25) AS b FROM range(201) t(p)),
o AS (SELECT page, priority, pixel, a, b, sum(us * (least(i + 1, b) - greatest(i, a))) AS work FROM s JOIN x ON i < b AND i + 1 > a GROUP BY ALL)
SELECT page, priority, CAST(pixel AS INTEGER) AS pixel, work / ((b - a) * 1000) AS share FROM o WHERE work > 0
"""


def real_runs(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", ((F.col("o_orderkey") * 31 + F.col("o_custkey")) % 3 == 0).alias("is_median"))
    return S.drop_medians(o, "o_custkey", F.col("is_median"))


_REAL = """SELECT o_orderkey, o_custkey, (o_orderkey * 31 + o_custkey) % 3 = 0 AS is_median FROM orders
    QUALIFY (o_orderkey * 31 + o_custkey) % 3 <> 0 OR bool_and((o_orderkey * 31 + o_custkey) % 3 = 0) OVER (PARTITION BY o_custkey)"""


def history_search(spark, d):
    p = table(spark, d, "part")
    return S.search(p, "WIDGET", ["p_name", "p_brand", "p_type"], [F.lower("p_name").desc(), F.col("p_partkey")], 2, 25).select("p_partkey", "p_name")


def request_bytes(spark, d):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    p = table(spark, d, "pages").select("page_id", N.request_bytes(F.lit("GET"), F.col("url"), F.lit(None).cast("string"), F.array(pair("Host", F.col("url")), pair("X", F.col("page_id").cast("string")))).cast("long").alias("bytes_out"))
    return p


def page_events(spark, d):
    k = F.col("o_orderkey")
    times = layout.page_events(*[k * a % m - 10 for a, m in ((3, 50), (5, 40), (7, 60), (11, 30), (13, 40), (17, 50), (19, 45))])
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in times.items()])


_EVENTS = """
WITH t AS (SELECT o_orderkey, k * 3 % 50 - 10 AS r, k * 5 % 40 - 10 AS ds, k * 7 % 60 - 10 AS de, k * 11 % 30 - 10 AS od, k * 13 % 40 - 10 AS ls, k * 17 % 50 - 10 AS le, k * 19 % 45 - 10 AS ol
    FROM (SELECT o_orderkey, o_orderkey AS k FROM orders))
SELECT o_orderkey, CASE WHEN r > 0 THEN r END AS render,
    CASE WHEN ds > 0 AND de > 0 THEN ds WHEN od > 0 THEN od WHEN de > 0 THEN de END AS nav_dom_start, CASE WHEN ds > 0 AND de > 0 THEN de WHEN od > 0 THEN od WHEN de > 0 THEN de END AS nav_dom_end,
    CASE WHEN le > 0 AND ls > 0 THEN ls WHEN le > 0 THEN le END AS nav_load_start, CASE WHEN le > 0 THEN le END AS nav_load_end, CASE WHEN ol > 0 THEN ol END AS load FROM t
"""


def plain_bodies(spark, d):
    p = table(spark, d, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"), F.when(F.col("page_id") % 3 == 0, "identity").when(F.col("page_id") % 3 == 1, "br").alias("coding"))
    return p.select("page_id", F.octet_length(plain_body(F.col("body"), F.col("coding"))).cast("long").alias("bytes"))


def _coded(body: pd.Series, coding: pd.Series) -> pd.Series:
    import zstandard

    code = {"gzip": gzip.compress, "deflate": zlib.compress, "zstd": zstandard.compress}
    return pd.Series([code[c](b) for b, c in zip(body, coding, strict=True)], dtype=object)


def coded_bodies(spark, d):
    """The bodies of all pages, coded with gzip, deflate or zstd and undone again."""
    coding = F.when(F.col("page_id") % 3 == 0, "gzip").when(F.col("page_id") % 3 == 1, "deflate").otherwise("zstd")
    p = table(spark, d, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"), coding.alias("coding"))
    plain = p.withColumn("body", F.pandas_udf(_coded, "binary")("body", "coding")).withColumn("plain", plain_body(F.col("body"), F.col("coding")))
    return plain.select("page_id", F.octet_length("plain").cast("long").alias("bytes"), F.sha2("plain", 256).alias("body_sha256"))


QUERIES = {f.__name__: f for f in (private_hosts, status_classes, page_document, time_order, header_merge, response_ordinals, host_of_address, sequence_clock, utilization_steps, smooth_slices, real_runs, history_search, request_bytes, page_events, plain_bodies, coded_bodies)}

SQL = {
    "private_hosts": _PRIVATE,
    "status_classes": _STATUS,
    "page_document": f"WITH {REQUESTS} SELECT page, req, start FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY CASE WHEN status = 200 AND priority = '1-URGENT' THEN 0 ELSE 1 END, start, req) = 1",
    "time_order": _TIME_ORDER,
    "header_merge": f"WITH {REQUESTS} SELECT req, CASE WHEN req % 2 = 0 THEN 'Host: h' || req || chr(10) || 'accept: x' || req || chr(10) || 'Cookie: c' || req ELSE 'Host: y' || req || chr(10) || 'accept: a' || req END AS headers FROM r",
    "response_ordinals": _ORDINALS,
    "host_of_address": _HOST_OF,
    "sequence_clock": _CLOCK,
    "utilization_steps": _STEPS,
    "smooth_slices": _SMOOTH,
    "real_runs": _REAL,
    "request_bytes": "SELECT page_id, CAST(2 * length(url) + length(page_id::VARCHAR) + 30 AS BIGINT) AS bytes_out FROM pages",
    "page_events": _EVENTS,
    "plain_bodies": "SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN octet_length(encode(coalesce(html, '')))::BIGINT END AS bytes FROM pages",
    "coded_bodies": "SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes, sha256(encode(coalesce(html, ''))) AS body_sha256 FROM pages",
    "history_search": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%widget%' OR lower(p_type) LIKE '%widget%' ORDER BY lower(p_name) DESC, p_partkey LIMIT 25 OFFSET 25",
}
