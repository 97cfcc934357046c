"""Queries over network logs, traces, protocol logs, exports and page statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions import text as X
from netloom.operators import layout, mainthread, netlog, outputs, pages, protocol, sequences, traces
from netloom.plans.adapters import CHUNKS, REQUESTS, SPANS, chunks, requests, spans, table
from netloom.plans.claims import _timed
from netloom.sources import http1, lookups
from netloom.streaming import captures as streaming


def _str(c):
    return F.col(c).cast("string")


def _streamed(spark, d):
    return requests(spark, d).withColumn("host", F.concat(F.lit("host"), (F.col("conn") % 50).cast("string"))).withColumn("stream_id", F.col("req") % 97).withColumn("path", F.concat(F.lit("/r/"), (F.col("req") % 500).cast("string")))


_STREAMED = f"{REQUESTS}, x AS (SELECT *, 'host' || conn % 50 AS host, req % 97 AS stream_id, '/r/' || req % 500 AS path FROM r)"


def session_inference(spark, d):
    r = _streamed(spark, d)
    asked = r.withColumn("session", F.when(F.col("req") % 5 == 0, F.col("conn")))
    streams = r.filter("status <> 404").select(F.col("conn").alias("session"), "host", "stream_id", "path")
    return netlog.infer_sessions(asked, streams).select("req", "session")


def stream_attributes(spark, d):
    r = _streamed(spark, d).withColumn("session", F.col("conn"))
    s = r.groupBy("session", "stream_id").agg((F.min("start") + 3).alias("first_byte"), (F.max("start") + 20).alias("end"), F.sum(F.col("req") % 1500).alias("bytes_in"), F.max(F.col("req") % 300).alias("weight"))
    s = s.filter("weight % 7 <> 0")
    r = r.withColumns({"first_byte": F.when(F.col("req") % 2 == 0, F.col("start") + 5), "end": F.when(F.col("req") % 3 != 0, F.col("start") + 9), "bytes_in": F.col("req") % 1000, "priority": F.when(F.col("req") % 4 == 0, F.lit("Own"))})
    return netlog.with_streams(r, s).select("req", "first_byte", "end", "bytes_in", "weight", "priority")


_STREAM_SQL = f"""
WITH {_STREAMED}, s AS (SELECT conn, stream_id, min(start) + 3 AS fb, max(start) + 20 AS e, sum(req % 1500) AS b, max(req % 300) AS w FROM x GROUP BY conn, stream_id HAVING max(req % 300) % 7 <> 0)
SELECT req, CASE WHEN req % 2 = 0 THEN start + 5 ELSE fb END AS first_byte, CASE WHEN req % 3 <> 0 THEN start + 9 ELSE e END AS "end",
    CAST(CASE WHEN b > req % 1000 THEN b ELSE req % 1000 END AS BIGINT) AS bytes_in, w AS weight,
    CASE WHEN req % 4 = 0 THEN 'Own' WHEN w >= 256 THEN 'Highest' WHEN w >= 220 THEN 'High' WHEN w >= 183 THEN 'Medium' WHEN w >= 147 THEN 'Low' WHEN w IS NOT NULL THEN 'Lowest' END AS priority
FROM x LEFT JOIN s USING (conn, stream_id)
"""


def socket_claims(spark, d):
    c = table(spark, d, "customer").filter("c_nationkey <> 3")
    sockets = c.select(F.col("c_custkey").alias("socket"), F.col("c_name").alias("address"), (F.col("c_custkey") * 10).alias("connect_start"), (F.col("c_custkey") * 10 + 7).alias("connect_end"), F.when(F.col("c_nationkey") % 3 == 0, F.lit("tls1.3")).alias("tls_version"))
    r = requests(spark, d).withColumnRenamed("conn", "socket")
    return netlog.claim_sockets(r, sockets, ["start", "req"], ["connect_start", "connect_end", "tls_version"], ["address"]).select("req", "socket", "address", "connect_start", "connect_end", "tls_version")


def lookup_claims(spark, d):
    """Each host's lookup goes to its first request that connects, else to its first one."""
    s = spans(spark, d).filter("kind <> 'view'").select("u", F.col("i").alias("req"), F.col("st").alias("start"), F.when(F.col("kind") == "click", F.col("st") + 500).alias("connect_start"))
    return netlog.claims(s, "u", ["start", "req"]).select("u", "claim", "bound")


def addresses_seen(spark, d):
    s = netlog.in_order_of_appearance(spans(spark, d), "u", "kind", ["st", "i"], "kinds")
    return s.select("u", F.array_join("kinds", ",").alias("kinds"))


def unreached_hosts(spark, d):
    host = lambda c: F.concat(F.lit("host"), F.col(c).cast("string"))
    c = table(spark, d, "customer")
    jobs = c.select(host("c_custkey").alias("host"), (F.col("c_custkey") * 3).alias("socket_start"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey") * 3 + 8).alias("socket_end"), F.when(F.col("c_nationkey") % 4 == 1, F.col("c_custkey")).alias("socket"), F.col("c_custkey").alias("ord"))
    r = requests(spark, d).select(F.concat(F.lit("host"), (F.col("conn") * 2).cast("string")).alias("host"), "start", F.lit(None).cast("bigint").alias("end"))
    urls = c.select(F.concat(F.lit("https://"), host("c_custkey"), F.lit(".example/"), "c_mktsegment").alias("url"), host("c_custkey").alias("host"))
    one = lambda df: df.withColumn("capture", F.lit("log"))
    return netlog.unreached(one(jobs), one(r), one(urls)).drop("capture")


def _phases(spark, d):
    r = requests(spark, d)
    return r.select("page", "req", "start", *[F.when(F.col("req") % m != 0, F.col("start") - k * (F.col("req") % 40)).alias(n) for n, m, k in _BACK])


_BACK = [(n, m, k) for m, k, n in zip((2, 3, 5, 7, 11, 13, 17, 19, 23), (9, 8, 7, 6, 5, 4, 12, -3, -20), [t for t in netlog.TIMES if t != "start"])]


def capture_origin(spark, d):
    done = netlog.rebased(_phases(spark, d).withColumn("start", F.col("start").cast("double")), "page")
    return done.select("page", "req", "start", *[F.col(t).cast("long").alias(t) for t in ("created", "end", "dns_start")])


_ORIGIN = f"""
WITH {REQUESTS}, p AS (SELECT page, req, start, {', '.join(f'CASE WHEN req % {m} <> 0 THEN start - {k} * (req % 40) END AS "{n}"' for n, m, k in _BACK)} FROM r),
z AS (SELECT page, min(least(start, {', '.join(f'"{n}"' for n, _, _ in _BACK)})) AS zero FROM p GROUP BY page)
SELECT page, req, CAST(start - zero AS DOUBLE) + (req % 10000) / CAST(1000000 AS DOUBLE) AS start, created - zero AS created, "end" - zero AS "end", dns_start - zero AS dns_start FROM p JOIN z USING (page)
"""


def network_hits(spark, d):
    c = chunks(spark, d, numbered=False).groupBy("req").agg(F.sum("bytes").cast("long").alias("bytes_in"), F.expr("max(ts) div 1000").alias("end"))
    r = requests(spark, d).join(c, "req", "left").withColumn("sent", F.when(F.col("req") % 11 != 0, F.col("start")))
    headers = F.when(F.col("status") == 404, F.array(F.lit("a: b"))).otherwise(F.array().cast("array<string>"))
    keep = traces.reached_network(F.col("sent"), headers, F.when(F.col("req") % 13 == 0, F.col("start")), F.when(F.col("req") % 3 == 0, F.col("end")), F.when(F.col("req") % 5 == 0, F.col("bytes_in")))
    return r.filter(keep).select("req")


def trace_base(spark, d):
    s = spans(spark, d).select(F.col("u").alias("capture"), F.col("st").alias("t"), F.col("kind"), F.col("i"))
    url = F.when(F.col("kind") == "click", "chrome://tracing/x").when(F.col("kind") == "view", "").otherwise(F.concat(F.lit("https://h/"), _str("i")))
    told = s.withColumn("timeline", F.when(traces.anchors_page(url), F.col("t"))).withColumn("netlog", F.when(F.col("i") % 7 == 0, F.col("t"))).withColumn("nav", F.lit(None).cast("bigint"))
    return traces.base_time(told, "capture", ["timeline", "netlog", "nav"])


def timeline_requests(spark, d):
    url = F.when(F.col("req") % 10 == 3, F.concat(F.lit("http://127.0.0.1:8888/"), _str("req"))).otherwise(F.concat(F.lit("https://h/"), (F.col("req") % 5000).cast("string")))
    r = requests(spark, d).withColumn("url", url)
    flag = lambda m, k=0: F.col("req") % m != k
    t = r.select("req", "url", flag(7).alias("has_id"), flag(11).alias("was_sent"), F.when(flag(13), F.col("start")).alias("requested"), (~flag(17)).alias("from_cache"), (~flag(19)).alias("from_worker"), F.when(F.col("status") == 200, 200).otherwise(0).alias("status"), (~flag(3)).alias("timed"))
    return traces.timeline_only(t, r.filter("status = 404").select("url")).select("req", "url")


_TIMELINE = f"""
WITH {REQUESTS}, u AS (SELECT *, CASE WHEN req % 10 = 3 THEN 'http://127.0.0.1:8888/' || req ELSE 'https://h/' || req % 5000 END AS url FROM r)
SELECT req, url FROM u WHERE req % 10 <> 3 AND req % 7 <> 0 AND req % 11 <> 0 AND req % 13 <> 0 AND req % 17 <> 0 AND req % 19 <> 0 AND (req % 3 = 0 OR status = 200)
    AND url NOT IN (SELECT url FROM u WHERE status = 404)
"""


def toplevel_tasks(spark, d):
    e = spans(spark, d).select(F.col("u").alias("thread"), F.col("i"), F.when(F.col("i") % 4 == 0, "B").otherwise("X").alias("ph"), F.concat(F.when(F.col("kind") == "view", "toplevel,").otherwise("blink.toplevel,"), "kind").alias("cat"), (F.col("du") % 200_000).alias("dur"))
    return traces.toplevel_tasks(e).select("thread", "i", "dur")


def clock_repair(spark, d):
    s = spans(spark, d)
    off = F.when(F.col("u") % 2 == 0, 3_600_000).otherwise(F.col("u") * 10)
    rows = s.select("u", "i", F.when(F.col("i") % 3 != 0, F.expr("st div 1000")).alias("outer"), (F.expr("st div 1000") + off).alias("inner"))
    done = traces.scaled(traces.one_clock(rows, "u", "i", "outer", "inner"), ["inner"], 2.0)
    return done.select("u", "i", "inner")


def _fetched(spark, d):
    r, conns, look = _timed(spark, d)
    r = r.withColumn("url", F.concat(F.when(F.col("req") % 9 == 0, "data:").otherwise("https://host"), _str("conn"), F.lit(".example/r/"), _str("req")))
    return outputs.page_requests(r, conns, look)


_FETCHED = f"""{REQUESTS}, {CHUNKS}, t AS (SELECT req, min(ts) AS t0, max(ts) AS t1 FROM c GROUP BY req),
q AS (SELECT r.*, coalesce(t0 // 1000, 0) AS first_data, coalesce(t1 // 1000, start) AS "end", conn % 40 AS dns_id FROM r LEFT JOIN t USING (req) WHERE req % 9 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY page, conn ORDER BY start, req) = 1 AS pc, row_number() OVER (PARTITION BY page, dns_id ORDER BY start, req) = 1 AS pd,
    CASE WHEN first_data > 0 THEN first_data ELSE "end" END AS f FROM q),
f AS (SELECT o.page, o.req, o.conn, o.status, o.start, o.first_data, o."end", greatest(0, o.f - o.start) AS wait, greatest(0, o."end" - o.f) AS receive,
    CASE WHEN pd AND dns_id * 4 - 9 >= dns_id * 3 THEN dns_id - 9 ELSE -1 END AS dns, CASE WHEN pc AND c_nationkey * 7 - 20 >= 0 THEN c_nationkey * 7 - 20 ELSE -1 END AS connect,
    CASE WHEN pc AND c_nationkey % 3 = 0 THEN greatest(0, c_nationkey * 7 - 25) ELSE -1 END AS ssl,
    CASE WHEN pd THEN dns_id * 3 END AS dns_start, CASE WHEN pd THEN dns_id * 4 - 9 END AS dns_end, CASE WHEN pc THEN c_custkey * 10 END AS connect_start,
    CASE WHEN pc THEN c_custkey * 10 + c_nationkey * 7 - 20 END AS connect_end, CASE WHEN pc AND c_nationkey % 3 = 0 THEN c_custkey * 10 + 5 END AS ssl_start
    FROM o LEFT JOIN customer ON c_custkey = conn)"""


def page_fetch(spark, d):
    f = _fetched(spark, d)
    return f.select("page", "req", *[F.col(c).cast("long").alias(c) for c in ("dns", "connect", "ssl", "wait", "receive", "dns_start", "dns_end", "connect_start", "connect_end", "ssl_start")])


def har_offsets(spark, d):
    o = outputs.with_offsets(_fetched(spark, d))
    return o.select("page", "req", *[F.col(c).cast("long").alias(c) for c in ("earliest", "_load_start", "_dns_start", "_connect_end", "_ssl_end", "_ttfb_end", "_download_end", "_all_end")])


_OFFSETS = f"""
WITH {_FETCHED}, e AS (SELECT page, CAST(min(least(CASE WHEN start > 0 THEN start END, CASE WHEN dns_start > 0 THEN dns_start END, CASE WHEN connect_start > 0 THEN connect_start END)) AS BIGINT) AS earliest FROM f GROUP BY page),
a AS (SELECT page, req, status, conn, wait, receive, dns, connect, earliest, start - earliest AS _load_start, CASE WHEN dns_start > 0 THEN dns_start - earliest END AS _dns_start, CASE WHEN connect_end > 0 THEN connect_end - earliest END AS _connect_end,
    CASE WHEN ssl > 0 THEN start - earliest END AS _ssl_end, CASE WHEN first_data > 0 THEN first_data - earliest END AS _ttfb_end, "end" - earliest AS _download_end, "end" - earliest AS _all_end FROM f JOIN e USING (page))
"""


#: What is read of an entry, as typed members: no VARIANT is made for each entry.
_ENTRY = "_n: bigint, request: struct<url: string>, response: struct<status: bigint, headers: array<struct<value: string>>, content: struct<size: bigint>>, time: double, _load_start: bigint, _ttfb_end: bigint, _all_end: bigint, connection: string"


def har_entries_back(spark, d):
    """The extended HAR of all pages, read again: every entry with its fields, in the order it was written in."""
    f = outputs.with_offsets(_fetched(spark, d))
    header = lambda n, v: F.array(F.struct(F.lit(n).alias("name"), v.alias("value")))
    f = f.withColumns({"method": F.lit("GET"), "http_version": F.lit("h2"), "headers": header("Host", _str("conn")), "response_headers": header("X-Req", _str("req")), "mime": F.lit("text/html"), "bytes_in": F.col("req") % 1000})
    named = f.select("page").distinct().select("page", F.concat(F.lit("Page "), _str("page")).alias("title"), F.create_map(F.lit("_run"), F.lit("1"), F.lit("other"), F.lit("2")).alias("ext"))
    doc = F.from_json("har", f"log struct<pages: array<struct<title: string, ext: map<string,string>>>, entries: array<struct<{_ENTRY}>>>")["log"]
    har = outputs.full_har(f, named, 200).withColumn("doc", doc)
    back = har.select("page", F.col("doc.pages")[0].alias("p"), F.explode("doc.entries").alias("e"))
    return back.select(
        "page",
        F.col("p.title").alias("title"),
        F.array_join(F.map_keys("p.ext"), ",").alias("fields"),
        F.col("e._n").alias("n"),
        F.col("e.request.url").alias("url"),
        F.col("e.response.status").alias("status"),
        F.col("e.response.headers")[0]["value"].alias("header"),
        F.col("e.response.content.size").alias("size"),
        F.floor("e.time").cast("long").alias("time"),
        F.col("e._load_start").alias("load_start"),
        F.col("e._ttfb_end").alias("ttfb_end"),
        F.col("e._all_end").alias("all_end"),
        F.col("e.connection").alias("connection"),
    )


_BACK_SQL = _OFFSETS + """, s AS (SELECT *, earliest + greatest(_load_start, coalesce(_connect_end, 0)) AS sent FROM a)
SELECT page, 'Page ' || page AS title, '_run' AS fields, row_number() OVER (PARTITION BY page ORDER BY sent, req) - 1 AS n, 'https://host' || conn || '.example/r/' || req AS url, CAST(status AS BIGINT) AS status, CAST(req AS VARCHAR) AS header,
    req % 1000 AS size, CAST(greatest(0, dns) + greatest(0, connect) + wait + receive AS BIGINT) AS time, _load_start AS load_start, _ttfb_end AS ttfb_end, _all_end AS all_end, CAST(conn AS VARCHAR) AS connection FROM s
"""


def simple_json_full(spark, d):
    r = requests(spark, d)
    odd = lambda m, c: F.when(F.col("req") % m != 0, c)
    e = r.select(
        "page", "req", "start",
        odd(3, F.concat(F.lit("https://a/"), _str("req"))).alias("url"),
        F.concat(F.lit("https://b/"), _str("req")).alias("_url"),
        odd(2, F.lit("https://full")).alias("_full_url"),
        odd(5, F.lit("POST")).alias("method"),
        odd(4, F.col("status")).alias("status"),
        F.col("status").alias("_responseCode"),
        outputs.iso_time(F.col("start")).alias("startedDateTime"),
        (F.col("req") % 77).alias("time"),
        F.when(F.col("req") % 6 == 0, "").otherwise("image/png").alias("mime"),
        odd(2, F.col("req") % 900).alias("_bytesIn"),
        (F.col("req") % 50 - 10).alias("body_size"),
        (F.col("req") % 30 - 15).alias("headers_size"),
        odd(7, F.col("req") % 20).alias("_ttfb_ms"),
        odd(8, F.lit("broken")).alias("_error"),
    )
    return outputs.simple_requests(e, "page", ["start", "req"]).drop("_n")


_FLAT_SQL = f"""
WITH {REQUESTS}
SELECT page, row_number() OVER (PARTITION BY page ORDER BY start, req) - 1 AS index, CASE WHEN req % 3 <> 0 THEN 'https://a/' || req ELSE 'https://b/' || req END AS url,
    CASE WHEN req % 2 <> 0 THEN 'https://full' WHEN req % 3 <> 0 THEN 'https://a/' || req ELSE 'https://b/' || req END AS full_url, '' AS host, CASE WHEN req % 5 <> 0 THEN 'POST' ELSE 'GET' END AS method, status, '' AS protocol, '' AS ip,
    strftime(make_timestamp(start * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS "startedDateTime", req % 77 AS time, '' AS type, CASE WHEN req % 6 = 0 THEN '' ELSE 'image/png' END AS "contentType",
    CASE WHEN req % 2 <> 0 THEN req % 900 ELSE greatest(0, req % 50 - 10) END AS "bytesIn", greatest(0, req % 30 - 15) AS "bytesOut", 0 AS "objectSize", CASE WHEN req % 7 <> 0 THEN req % 20 ELSE -1 END AS ttfb_ms,
    -1 AS load_ms, -1 AS download_ms, -1 AS dns_ms, -1 AS connect_ms, -1 AS ssl_ms, CASE WHEN req % 8 <> 0 THEN 'broken' END AS error FROM r
"""

_ENDS = ("_screen.jpg", "_screen.png", "_netlog.json.gz", "_netlog.txt.gz", "_lighthouse.html.gz", "_trace.json.gz", "_tcpdump.cap.gz")


def page_resources(spark, d):
    """Members named after documents, and which of them each of a capture's views finds."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    stem = F.concat((k % 7).cast("string"), F.when(k % 2 == 1, "_Cached").otherwise(""))
    name = F.when(k % 29 == 0, F.lit("lighthouse.html")).otherwise(F.concat(stem, F.element_at(F.array(*map(F.lit, _ENDS)), (k % 17 % 7 + 1).cast("int"))))
    members = docs.select("source", F.col("source").alias("capture"), F.concat(F.when(k % 3 == 0, "a/b/").otherwise(""), name).alias("member"), k.alias("ord"))
    views = members.select("capture").distinct().withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("cached", F.explode(F.array(F.lit(0), F.lit(1))))
    return pages.page_resources(views, members)


_RESOURCES = f"""
WITH m AS (SELECT source AS capture, doc_id AS ord, CASE WHEN doc_id % 29 = 0 THEN 'lighthouse.html' ELSE doc_id % 7 || CASE WHEN doc_id % 2 = 1 THEN '_Cached' ELSE '' END || ([{', '.join(f"'{e}'" for e in _ENDS)}])[doc_id % 17 % 7 + 1] END AS name,
    CASE WHEN doc_id % 3 = 0 THEN 'a/b/' ELSE '' END AS dir FROM documents),
v AS (SELECT capture, run, cached FROM (SELECT DISTINCT capture FROM m), range(7) AS a(run), range(2) AS b(cached)),
k(resource, rank, ending, mime, shared) AS (VALUES {', '.join(f"('{k}', {i}, '{e}', '{m}', false)" for k, x in pages.RESOURCES.items() for i, (e, m) in enumerate(x))}, ('lighthouse', 2, 'lighthouse.html', 'text/html', true), ('lighthouse', 3, 'lighthouse.html.gz', 'text/html', true)),
j AS (SELECT v.capture, CAST(run AS INTEGER) AS run, CAST(cached AS INTEGER) AS cached, resource, dir || name AS member, mime, rank, ord FROM v, k JOIN m ON m.capture = v.capture AND name = CASE WHEN shared THEN ending ELSE run || CASE WHEN cached = 1 THEN '_Cached' ELSE '' END || ending END)
SELECT capture, run, cached, resource, member, mime FROM j QUALIFY row_number() OVER (PARTITION BY capture, run, cached, resource ORDER BY rank, ord) = 1
"""


def page_totals(spark, d):
    k = F.col("req")
    r = requests(spark, d).withColumns({"load_start": F.col("start"), "load_ms": F.when(k % 3 != 0, k % 700), "ttfb_ms": k % 90 - 10, "bytes_in": k % 5000, "bytes_out": k % 300, "content_type": F.when(k % 4 == 0, "application/ocsp-response"), "blocking": k % 5 == 0, "kind": F.when(k % 2 == 0, "Script").otherwise("Stylesheet"), "doc_time": F.lit(800_000_000_000)})
    done = pages.page_totals(r, "page", ["load_start", "req"])
    return done.withColumn("ttfb", F.col("ttfb").cast("long"))


_TOTALS = f"""
WITH {REQUESTS}, t AS (SELECT *, CASE WHEN req % 3 <> 0 THEN req % 700 ELSE 0 END AS ms, start < 800000000000 AS early, status IN (200, 304) AND req % 90 >= 10 AND req % 4 <> 0 AS base FROM r)
SELECT page, CAST(sum(req % 5000) AS BIGINT) AS bytes_in, CAST(coalesce(sum(req % 5000) FILTER (early), 0) AS BIGINT) AS bytes_in_doc, CAST(sum(req % 300) AS BIGINT) AS bytes_out, CAST(coalesce(sum(req % 300) FILTER (early), 0) AS BIGINT) AS bytes_out_doc,
    count(*) AS requests, count(*) FILTER (early) AS requests_doc, count(*) FILTER (status = 200) AS responses_200, count(*) FILTER (status = 404) AS responses_404, count(*) FILTER (status NOT IN (200, 404)) AS responses_other,
    count(*) FILTER (req % 10 = 0) AS blocking_js, count(*) FILTER (req % 5 = 0 AND req % 2 = 1) AS blocking_css, arg_min(start + req % 90 - 10, (start, req)) FILTER (base) AS ttfb, greatest(800000000000, max(start + ms)) AS fully_loaded,
    CASE WHEN count(*) FILTER (status = 200) = 0 THEN CASE WHEN arg_min(status, (start, req)) >= 400 THEN arg_min(status, (start, req)) ELSE 0 END WHEN count(*) FILTER (status = 404) > 0 THEN 99999 END AS result FROM t GROUP BY page
"""


def processor_times(spark, d):
    s = spans(spark, d).select(F.col("u"), F.col("kind").alias("event"), (F.col("i") % 60).alias("slice"), (F.col("du") % 10_000).alias("usecs"), F.lit(450).alias("fully_loaded"), F.lit(200).alias("doc_time"))
    return pages.processor_times(s, "u", "event", 10_000)


_CPU = f"""
WITH {SPANS}, s AS (SELECT u, kind AS event, i % 60 AS slice, (du % 10000) / 1000.0 AS ms FROM v), t AS (SELECT u, event, coalesce(sum(ms) FILTER (slice < 45), 0) AS a, coalesce(sum(ms) FILTER (slice < 20), 0) AS b FROM s GROUP BY u, event),
x AS (SELECT u, event, a, b FROM t UNION ALL SELECT u, 'Idle', greatest(450 - sum(a), 0), greatest(200 - sum(b), 0) FROM t GROUP BY u)
SELECT u, event, CAST(round_even(a, 0) AS BIGINT) AS busy_ms, CAST(round_even(b, 0) AS BIGINT) AS busy_doc_ms FROM x
"""


def page_scores(spark, d):
    k = F.col("req")
    r = requests(spark, d).withColumns({"cache": k % 101 - 20, "cdn": k % 55 - 30, "keep_alive": F.lit(-1), "gzip": k % 9 - 4, "gzip_size": k % 7000, "gzip_target": F.floor(k % 7000 / 2), "image": k % 4 - 2, "image_size": k % 9000, "image_target": F.floor(k % 9000 / 3), "jpeg_size": k % 20_000, "jpeg_scans": k % 3})
    return pages.scores(r, "page")


_SCORES = f"""
WITH {REQUESTS} SELECT page, CAST(round_even(avg(req % 101 - 20) FILTER (req % 101 >= 20), 0) AS BIGINT) AS score_cache, CAST(round_even(avg(req % 55 - 30) FILTER (req % 55 >= 30), 0) AS BIGINT) AS score_cdn, CAST(NULL AS BIGINT) AS score_keep_alive,
    CASE WHEN sum(req % 7000) FILTER (req % 9 >= 4) > 0 THEN 100 - CAST(floor(sum(req % 7000 - req % 7000 // 2) FILTER (req % 9 >= 4) * 100 / sum(req % 7000) FILTER (req % 9 >= 4)) AS BIGINT) END AS score_gzip,
    CASE WHEN sum(req % 9000) FILTER (req % 4 >= 2) > 0 THEN 100 - CAST(floor(sum(req % 9000 - req % 9000 // 3) FILTER (req % 4 >= 2) * 100 / sum(req % 9000) FILTER (req % 4 >= 2)) AS BIGINT) END AS score_compress,
    CASE WHEN sum(req % 20000) > 0 THEN CAST(round_even(coalesce(sum(req % 20000) FILTER (req % 3 = 2), 0) * 100 / sum(req % 20000), 0) AS BIGINT) END AS score_progressive FROM r GROUP BY page
"""


def folded_slices(spark, d):
    s = spans(spark, d).select("u", F.when(F.col("kind").isin("click", "view"), "EvaluateScript").otherwise(F.col("kind")).alias("event"), (F.col("i") % 12).alias("slice"), (F.col("du") % 9_000 - 1_000).alias("usecs"))
    done = mainthread.folded_slices(s.withColumn("category", mainthread.category(F.col("event"))), ["u"], "category", "slice", "usecs")
    return done.select("u", "category", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("slices"))


_FOLDED = f"""
WITH {SPANS}, s AS (SELECT u, CASE WHEN kind IN ('click', 'view') THEN 'EvaluateScript' ELSE 'other' END AS category, i % 12 AS slice, greatest(0, du % 9000 - 1000) AS w FROM v),
n AS (SELECT u, max(slice) AS last FROM s GROUP BY u), g AS (SELECT u, category, slice, CAST(sum(w) AS BIGINT) AS w FROM s GROUP BY ALL), c AS (SELECT DISTINCT u, category FROM s)
SELECT u, category, string_agg(coalesce(w, 0), ',' ORDER BY k) AS slices FROM (SELECT c.u, c.category, k, w FROM c JOIN n USING (u), range(12) AS t(k) LEFT JOIN g ON g.u = c.u AND g.category = c.category AND g.slice = k WHERE k <= last) GROUP BY u, category
"""


def exclusive_times(spark, d):
    """Spans of two depths: children inside the spans that hold them; each slice's time goes to whose own it is."""
    s = spans(spark, d).select("u", (F.col("i") * 1_000_000).alias("a"), F.col("kind"), (F.col("du") % 400_000 + 200_000).alias("n"))
    outer = s.select("u", F.lit(1).alias("depth"), F.col("a").alias("start"), (F.col("a") + F.col("n")).alias("end"), F.col("kind").alias("name"))
    inner = s.select("u", F.lit(2).alias("depth"), (F.col("a") + 50_000).alias("start"), (F.col("a") + 50_000 + F.expr("n div 4")).alias("end"), F.when(F.col("kind") == "view", "view").otherwise("child").alias("name"))
    nested = mainthread.with_parents(outer.unionByName(inner), "u", "depth", "start", "name")
    return mainthread.exclusive_slices(nested, "u", "start", "end", "name", 1_000_000)


_EXCLUSIVE = f"""
WITH {SPANS}, s AS (SELECT u, i AS slice, kind, du % 400000 + 200000 AS n FROM v), x AS (SELECT u, slice, kind AS name, n - CASE WHEN kind <> 'view' THEN n // 4 ELSE 0 END AS w FROM s UNION ALL SELECT u, slice, 'child', n // 4 FROM s WHERE kind <> 'view')
SELECT u, name, slice, CAST(least(1000000, sum(w)) AS BIGINT) AS usecs FROM x GROUP BY u, name, slice
"""


def protocol_claims(spark, d):
    k = F.col("req")
    r = requests(spark, d).withColumns({"socket": F.when(k % 6 != 0, F.col("conn")), "host": F.concat(F.lit("h"), (F.col("conn") % 30).cast("string")), "dns_start": k % 8 - 3, "dns_end": k % 8, "connect_start": k % 8, "connect_end": k % 8 + 20, "ssl_start": F.when(k % 2 == 0, k % 8 + 10).otherwise(-1), "ssl_end": F.when(k % 2 == 0, k % 8 + 20).otherwise(-1)})
    return protocol.claim_phases(r, "page", "socket", "host", ["start", "req"]).select("page", "req", "dns_start", "dns_end", "connect_start", "connect_end", "ssl_start", "ssl_end")


_PROTOCOL = f"""
WITH {REQUESTS}, x AS (SELECT page, req, start, CASE WHEN req % 6 <> 0 THEN conn END AS socket, 'h' || conn % 30 AS host, req % 8 AS m FROM r),
o AS (SELECT *, socket IS NOT NULL AND row_number() OVER (PARTITION BY page, socket ORDER BY start, req) = 1 AS c FROM x),
p AS (SELECT *, CASE WHEN c AND m >= 3 THEN host END AS asks FROM o), q AS (SELECT *, asks IS NOT NULL AND row_number() OVER (PARTITION BY page, asks ORDER BY start, req) = 1 AS f FROM p)
SELECT page, req, CASE WHEN f THEN m - 3 END AS dns_start, CASE WHEN f THEN m END AS dns_end, CASE WHEN c THEN m END AS connect_start, CASE WHEN c THEN m + CASE WHEN req % 2 = 0 THEN 10 ELSE 20 END END AS connect_end,
    CASE WHEN c AND req % 2 = 0 THEN m + 10 END AS ssl_start, CASE WHEN c AND req % 2 = 0 THEN m + 20 END AS ssl_end FROM q
"""


def script_initiators(spark, d):
    e = spans(spark, d).filter("kind = 'view'")
    k = F.col("i")
    frame = lambda script, url: F.struct((k % script).alias("script"), url.alias("url"))
    parsed = e.select(F.col("u").alias("capture"), k.alias("ord"), (k % 20).alias("script"), F.when(k % 3 == 0, F.concat(F.lit("s"), _str("i"))).alias("url"), F.array(frame(15, F.lit(None).cast("string")), frame(17, F.when(k % 4 == 0, F.concat(F.lit("f"), _str("i"))))).alias("frames"))
    asked = spans(spark, d).filter("kind = 'click'").select(F.col("u").alias("capture"), k.alias("req"), F.when(k % 5 == 0, "own").alias("initiator_url"), F.array(frame(23, F.lit("")), frame(19, F.lit(None).cast("string"))).alias("frames"))
    return protocol.initiators(asked, protocol.script_urls(parsed)).select("capture", "req", "initiator")


_INITIATORS = f"""
WITH {SPANS}, p AS (SELECT u, i, CASE WHEN i % 4 = 0 THEN 'f' || i END AS f, CASE WHEN i % 3 = 0 THEN 's' || i END AS s FROM v WHERE kind = 'view'),
a AS (SELECT u, i AS ord, 1 AS n, i % 20 AS script, coalesce(f, s) AS url FROM p UNION ALL SELECT u, i, 0, i % 17, f FROM p), k AS (SELECT u, script, arg_min(url, (ord, n)) AS url FROM a WHERE url IS NOT NULL GROUP BY u, script)
SELECT c.u AS capture, c.i AS req, CASE WHEN c.i % 5 = 0 THEN 'own' ELSE coalesce(x.url, y.url) END AS initiator FROM v c LEFT JOIN k x ON x.u = c.u AND x.script = c.i % 23 LEFT JOIN k y ON y.u = c.u AND y.script = c.i % 19 WHERE kind = 'click'
"""


def scalar_rules(spark, d):
    """Rules over keys, types and encodings, on values made of pages."""
    k, p = F.col("page_id"), table(spark, d, "pages")
    part = lambda n: F.base64(F.encode(F.concat(F.lit(n), _str("page_id")), "UTF-8"))
    url = F.when(k % 3 == 0, F.concat(F.lit("https://t.example/result/240102_AB"), _str("page_id"), F.lit("/1/details/"))).when(k % 3 == 1, F.concat(F.lit("http://t.example/results.php?x=1&test=240102_Z"), _str("page_id"), F.lit("&y=2"))).otherwise(F.col("url"))
    sent = F.array(F.lit(":method: GET"), F.concat(F.lit("Host: h"), _str("page_id")), F.lit(" :bad"))
    return p.select(
        "page_id",
        X.bare_mime(F.concat(F.lit(" text/html ; charset="), _str("page_id"))).alias("mime"),
        X.lookup_host(F.concat(F.when(k % 2 == 0, "https://").otherwise(""), F.lit("h"), _str("page_id"), F.when(k % 5 == 0, ":443").otherwise(""))).alias("host"),
        X.base64url(F.translate(part("a?>~"), "+/=", "-_")).cast("string").alias("decoded"),
        F.unbase64(X.merge_base64(F.array(part("a"), part("bc"), part("def")))).cast("string").alias("merged"),
        X.view_title(k % 4, k % 2, F.col("url")).alias("title"),
        X.view_id(k % 4, k % 2).alias("view"),
        X.export_url(url).alias("export"),
        X.keylog_path(F.concat(_str("page_id"), F.element_at(F.array(*map(F.lit, (".cap.gz", ".pcapng", ".pcap", ".txt"))), (k % 4 + 1).cast("int")))).alias("keys"),
        X.urgency_priority(F.concat(F.lit("i, u="), (k % 9).cast("string"))).alias("priority"),
        X.request_url(F.lit(None).cast("string"), F.concat(F.lit("GET /p/"), _str("page_id"), F.lit(" HTTP/1.1")), F.when(k % 4 == 0, "ssl/h:443").when(k % 4 == 1, "h:80"), F.when(k % 4 == 2, True).when(k % 4 == 3, False), sent).alias("built"),
        layout.queue_end(k + 9, F.when(k % 2 == 0, k + 4), F.when(k % 3 == 0, k + 2), k + 12).alias("queue_end"),
    )


_SCALARS = """
SELECT page_id, 'text/html' AS mime, 'h' || page_id AS host, 'a?>~' || page_id AS decoded, 'a' || page_id || 'bc' || page_id || 'def' || page_id AS merged, 'Run ' || page_id % 4 || ', ' || CASE WHEN page_id % 2 = 1 THEN 'Repeat View' ELSE 'First View' END || ' for ' || url AS title,
    'page_' || page_id % 4 || '_' || page_id % 2 || '_1' AS view, CASE page_id % 3 WHEN 0 THEN 'https://t.example/export.php?bodies=1&test=240102_AB' || page_id WHEN 1 THEN 'http://t.example/export.php?bodies=1&test=240102_Z' || page_id ELSE url END AS export,
    page_id || (['.key_log.txt.gz', '.key_log.txt', '.key_log.txt', '.txt'])[page_id % 4 + 1] AS keys, (['Highest', 'Highest', 'High', 'Medium', 'Low', 'Low', 'Lowest', 'Lowest', 'Lowest'])[page_id % 9 + 1] AS priority,
    CASE WHEN page_id % 4 IN (0, 2) THEN 'https' ELSE 'http' END || '://h' || page_id || '/p/' || page_id AS built, least(page_id + 9, CASE WHEN page_id % 2 = 0 THEN page_id + 4 END, CASE WHEN page_id % 3 = 0 THEN page_id + 2 END, page_id + 12) AS queue_end FROM pages
"""


def time_clip(spark, d):
    s = spans(spark, d).select("u", "i", (F.col("st") / 1000).alias("begin"), (F.col("en") / 1000).alias("end"))
    origin = s.groupBy("u").agg(F.min("begin").alias("origin"))
    return layout.time_clip(s.join(origin, "u"), "begin", "end", F.col("origin"), 3600.0, 86400.0 * 10).select("u", "i", "span_ms")


def wrapped_sequences(spark, d):
    """Reassembly of counters of 24 bits that wrap."""
    c = chunks(spark, d).withColumn("conn", F.col("req") % 50)
    at = sequences.unwrapped(c.select("conn", "req", "seq", "bytes", ((F.col("req") * 9_000 + F.col("seq") * 700) % (1 << 24)).alias("s")), "conn", ["req", "seq"], "s", 24)
    return sequences.reassembly(at, "conn", ["req", "seq"], "s", "bytes")


_WRAPPED = f"""
WITH {CHUNKS}, x AS (SELECT req % 50 AS conn, req, seq, bytes, req * 9000 + seq * 700 AS s, row_number() OVER (PARTITION BY req % 50 ORDER BY req, seq) AS n FROM c),
w AS (SELECT *, s + bytes AS e, max(s + bytes) OVER (PARTITION BY conn ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x),
f AS (SELECT *, CASE WHEN top IS NULL THEN bytes ELSE greatest(0, e - greatest(top, s)) END AS fresh FROM w)
SELECT conn, count(*) AS packets, count(*) FILTER (e <= top) AS duplicates, count(*) FILTER (s > top) AS holes, CAST(sum(fresh) AS BIGINT) AS new_bytes, CAST(sum(bytes - fresh) AS BIGINT) AS repeated_bytes FROM f GROUP BY conn
"""


def extension_fields(spark, d):
    e = table(spark, d, "events").select("event_id", F.create_map(F.lit("_k"), _str("event_id"), F.lit("bodies"), F.lit("x"), F.lit("_own"), F.col("event_type"), F.lit("images"), F.lit("y"), F.lit("plain"), F.lit("z")).alias("m"))
    core = F.create_map(F.lit("_own"), F.lit("core"))
    joined = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return e.select("event_id", joined(pages.without(F.col("m"))).alias("slim"), joined(pages.extensions(core, F.col("m"))).alias("carried"), joined(pages.as_extensions(pages.without(F.col("m"), ("_k", "_own", *pages.BLOAT)))).alias("named"))


def _stamped(spark, d):
    return spans(spark, d).select("u", "kind", F.timestamp_micros("st").alias("ts"), (F.col("i") % 1500).alias("bytes"))


def stream_windows(spark, d):
    w = streaming.windowed_totals(_stamped(spark, d), ["kind"], "ts", "bytes", "1 hour", "30 minutes")
    return w.select("kind", F.unix_micros("begin").alias("begin"), "bytes", "chunks")


def stream_sessions(spark, d):
    w = streaming.connection_sessions(_stamped(spark, d), ["u"], "ts", "bytes", "6 hours")
    return w.select("u", F.unix_micros("begin").alias("begin"), F.unix_micros("end").alias("end"), "bytes", "chunks")


def _asked(spark, d):
    """Lookup packets made of events: a view asks, a click answers with one address; names are those of users."""
    number = lambda c, n: F.lpad(F.hex(c), n, "0")
    label = F.concat(F.lit("h"), F.col("u").cast("string"))
    name = F.concat(number(F.length(label), 2), F.hex(label), F.lit("076578616D706C6500"))
    answer = F.col("kind") == "click"
    head = F.concat(number(F.col("u") % 65536, 4), F.when(answer, "8180").otherwise("0100"), F.lit("0001"), F.when(answer, "0001").otherwise("0000"), F.lit("00000000"))
    record = F.when(answer, F.concat(F.lit("C00C00010001000000000004"), F.lit("0A00"), number(F.col("i") % 65536, 4))).otherwise("")
    s = spans(spark, d).filter("kind in ('view', 'click')").withColumn("payload", F.unhex(F.concat(head, name, F.lit("00010001"), record)))
    ends = (F.lit("10.9.9.9"), F.lit(5000)), (F.lit("8.8.8.8"), F.lit(53))
    return s.select(F.lit("c").alias("capture"), F.col("i").alias("ord"), F.col("st").alias("time_us"), F.lit("udp").alias("proto"), *[F.when(answer, ends[1 - k][j]).otherwise(ends[k][j]).alias(f"{n}_{p}") for k, n in enumerate(("src", "dst")) for j, p in enumerate(("ip", "port"))], "payload")


def decode_dns(spark, d):
    return lookups.messages(_asked(spark, d)).select("ord", "client", "id", "response", "name", F.array_join("addresses", ",").alias("addresses"))


def lookup_pairs(spark, d):
    return lookups.lookups(lookups.messages(_asked(spark, d))).select("name", "start", "end", F.array_join("addresses", ",").alias("addresses"))


def http1_pairs(spark, d):
    """Segments of plain connections made of requests: a request, its answer, and a repeated piece of it."""
    n = F.row_number().over(Window.partitionBy("conn").orderBy("start", "req"))
    r = requests(spark, d).withColumn("flow", F.concat(F.lit("f"), F.col("conn").cast("string"))).withColumn("at", n * F.lit(100).cast("long"))
    asked = F.concat(F.lit("GET /r/"), _str("req"), F.lit(" HTTP/1.1\r\nHost: h"), _str("conn"), F.lit("\r\nX: y\r\n\r\n"))
    told = F.concat(F.lit("HTTP/1.1 "), _str("status"), F.lit(" X\r\nContent-Type: text/css; a=b\r\nContent-Length: "), _str("req"), F.lit("\r\n\r\nbody"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.encode(t, "UTF-8").alias("payload")) for k, t in enumerate((asked, told, F.lit("more of the body"), F.lit("more of the body")))]))
    rows = r.select("flow", "conn", "req", "at", kinds.alias("s")).select("flow", "conn", "req", "at", "s.*").withColumn("forward", F.col("k") == 0)
    at = F.coalesce(F.sum(F.when(F.col("k") < 3, F.length("payload")).otherwise(0)).over(Window.partitionBy("flow", "forward").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("seq", at - F.when(F.col("k") == 3, F.length("payload")).otherwise(0))
    side = lambda c, s: F.when(F.col("forward") == (c == "src"), F.lit("10.0.0.1" if s == "ip" else 5000)).otherwise(F.lit("10.0.0.2" if s == "ip" else 80))
    flows = rows.select(F.lit("c").alias("capture"), "flow", F.lit(0).alias("generation"), "forward", (F.col("req") * 10 + F.col("k")).alias("ord"), (F.col("at") + F.col("k") * 7).alias("time_us"), F.lit("tcp").alias("proto"), *[side(c, s).alias(f"{c}_{s}") for c in ("src", "dst") for s in ("ip", "port")], "seq", "payload")
    return http1.http1_requests(flows).select("flow", "n", "method", "url", "host", "status", "mime", "server_ip", "start", "first_byte", "end", "bytes_out", "bytes_in", "length")


_HTTP1 = f"""
WITH {REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY conn ORDER BY start, req) AS n FROM r)
SELECT 'f' || conn AS flow, n, 'GET' AS method, 'http://h' || conn || '/r/' || req AS url, 'h' || conn AS host, status, 'text/css' AS mime, '10.0.0.2' AS server_ip, n * 100 AS start, n * 100 + 7 AS first_byte, n * 100 + 14 AS "end",
    CAST(length('GET /r/' || req || ' HTTP/1.1..Host: h' || conn || '..X: y....') AS BIGINT) AS bytes_out, CAST(length('HTTP/1.1 ' || status || ' X..Content-Type: text/css; a=b..Content-Length: ' || req || '....bodymore of the body') AS BIGINT) AS bytes_in, req AS length FROM n
"""


QUERIES = {f.__name__: f for f in (session_inference, stream_attributes, socket_claims, lookup_claims, addresses_seen, unreached_hosts, capture_origin, network_hits, trace_base, timeline_requests, toplevel_tasks, clock_repair, page_fetch, har_offsets, har_entries_back, simple_json_full, page_resources, page_totals, processor_times, page_scores, folded_slices, exclusive_times, protocol_claims, script_initiators, scalar_rules, time_clip, wrapped_sequences, extension_fields, stream_windows, stream_sessions, decode_dns, lookup_pairs, http1_pairs)}

SQL = {
    "session_inference": f"WITH {_STREAMED}, s AS (SELECT host, stream_id, path, min(conn) AS session FROM x WHERE status <> 404 GROUP BY ALL) SELECT req, CASE WHEN req % 5 = 0 THEN conn ELSE session END AS session FROM x LEFT JOIN s USING (host, stream_id, path)",
    "stream_attributes": _STREAM_SQL,
    "socket_claims": f"""
        WITH {REQUESTS}, o AS (SELECT *, row_number() OVER (PARTITION BY conn ORDER BY start, req) = 1 AS p FROM r)
        SELECT req, conn AS socket, c_name AS address, CASE WHEN p THEN c_custkey * 10 END AS connect_start, CASE WHEN p THEN c_custkey * 10 + 7 END AS connect_end, CASE WHEN p AND c_nationkey % 3 = 0 THEN 'tls1.3' END AS tls_version
        FROM o LEFT JOIN customer ON c_custkey = conn AND c_nationkey <> 3""",
    "lookup_claims": f"WITH {SPANS} SELECT u, i AS claim, st + CASE WHEN kind = 'click' THEN 500 ELSE 0 END AS bound FROM v WHERE kind <> 'view' QUALIFY row_number() OVER (PARTITION BY u ORDER BY kind <> 'click', st, i) = 1",
    "addresses_seen": f"WITH {SPANS}, f AS (SELECT u, kind, min((st, i)) AS first_at FROM v GROUP BY u, kind) SELECT u, string_agg(kind, ',' ORDER BY first_at) AS kinds FROM f GROUP BY u",
    "unreached_hosts": f"""
        WITH {REQUESTS} SELECT 'https://host' || c_custkey || '.example/' || c_mktsegment AS url, c_custkey * 3 AS start, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey * 3 + 8 ELSE greatest(c_custkey * 3, (SELECT max(start) FROM r)) END AS "end", 12029 AS status
        FROM customer WHERE c_nationkey % 4 <> 1 AND c_custkey NOT IN (SELECT conn * 2 FROM r)""",
    "capture_origin": _ORIGIN,
    "network_hits": f"""
        WITH {REQUESTS}, {CHUNKS}, t AS (SELECT req, sum(bytes) AS b, max(ts) // 1000 AS e FROM c GROUP BY req)
        SELECT req FROM r LEFT JOIN t USING (req) WHERE req % 11 <> 0 AND (status = 404 OR req % 13 = 0 OR (req % 3 = 0 AND e > start) OR (req % 5 = 0 AND b > 0))""",
    "trace_base": f"WITH {SPANS} SELECT u AS capture, coalesce(min(st) FILTER (kind NOT IN ('click', 'view') OR i % 7 = 0), 0) AS base FROM v GROUP BY u",
    "timeline_requests": _TIMELINE,
    "toplevel_tasks": f"WITH {SPANS} SELECT u AS thread, i, du % 200000 AS dur FROM v WHERE i % 4 <> 0 AND kind = 'view' AND du % 200000 >= 50000",
    "clock_repair": f"""
        WITH {SPANS}, f AS (SELECT u, count(*) FILTER (i % 3 <> 0) > 0 AS told FROM v GROUP BY u)
        SELECT u, i, (st // 1000 + CASE WHEN u % 2 = 0 THEN 3600000 ELSE u * 10 END - CASE WHEN told AND (u % 2 = 0 OR u * 10 > 60000) THEN CASE WHEN u % 2 = 0 THEN 3600000 ELSE u * 10 END ELSE 0 END) / 2.0 AS "inner" FROM v JOIN f USING (u)""",
    "page_fetch": f"WITH {_FETCHED} SELECT page, req, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("dns", "connect", "ssl", "wait", "receive", "dns_start", "dns_end", "connect_start", "connect_end", "ssl_start")) + " FROM f",
    "har_offsets": _OFFSETS + "SELECT page, req, earliest, _load_start, _dns_start, _connect_end, _ssl_end, _ttfb_end, _download_end, _all_end FROM a",
    "har_entries_back": _BACK_SQL,
    "simple_json_full": _FLAT_SQL,
    "page_resources": _RESOURCES,
    "page_totals": _TOTALS,
    "processor_times": _CPU,
    "page_scores": _SCORES,
    "folded_slices": _FOLDED,
    "exclusive_times": _EXCLUSIVE,
    "protocol_claims": _PROTOCOL,
    "script_initiators": _INITIATORS,
    "scalar_rules": _SCALARS,
    "time_clip": f"WITH {SPANS}, o AS (SELECT u, min(st) AS o FROM v GROUP BY u) SELECT u, i, CAST(860400000 AS DOUBLE) AS span_ms FROM v JOIN o USING (u) WHERE en >= o + 3600000000 AND st <= o + 864000000000",
    "wrapped_sequences": _WRAPPED,
    "stream_windows": f"WITH {SPANS} SELECT kind, st // 1800000000 * 1800000000 - k * 1800000000 AS begin, CAST(sum(i % 1500) AS BIGINT) AS bytes, count(*) AS chunks FROM v, range(2) AS t(k) GROUP BY ALL",
    "stream_sessions": f"""
        WITH {SPANS}, g AS (SELECT *, CASE WHEN st - lag(st) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY u ORDER BY st, i)),
        n AS (SELECT *, sum(fresh) OVER (PARTITION BY u ORDER BY st, i) AS s FROM g)
        SELECT u, min(st) AS begin, max(st) + 21600000000 AS "end", CAST(sum(i % 1500) AS BIGINT) AS bytes, count(*) AS chunks FROM n GROUP BY u, s""",
    "decode_dns": f"WITH {SPANS} SELECT i AS ord, '10.9.9.9 5000' AS client, CAST(u % 65536 AS INTEGER) AS id, kind = 'click' AS response, 'h' || u || '.example' AS name, CASE WHEN kind = 'click' THEN '10.0.' || i % 65536 // 256 || '.' || i % 256 ELSE '' END AS addresses FROM v WHERE kind IN ('view', 'click')",
    "lookup_pairs": f"""
        WITH {SPANS}, w AS (SELECT u, i, st, kind, lag(CASE WHEN kind = 'view' THEN st END) OVER (PARTITION BY u ORDER BY st, i) AS asked FROM v WHERE kind IN ('view', 'click'))
        SELECT 'h' || u || '.example' AS name, asked AS start, st AS "end", '10.0.' || i % 65536 // 256 || '.' || i % 256 AS addresses FROM w WHERE kind = 'click' AND asked IS NOT NULL""",
    "http1_pairs": _HTTP1,
    "extension_fields": "SELECT event_id, '_k=' || event_id || ',_own=' || event_type || ',plain=z' AS slim, '_k=' || event_id || ',_own=core' AS carried, '_plain=z' AS named FROM events",
}
