"""Queries whose input must be taken apart in order: streams of messages, slices of nested spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.operators import history, intervals, layout, mainthread, outputs, pages, traces
from netloom.plans.adapters import REQUESTS, SPANS, requests, spans, table
from netloom.sources import http1_framing, lookups

#: Bytes of a segment.
_CUT = 37


def _str(c):
    return F.col(c).cast("string")


def _sized(body):
    return F.concat(F.lit("Content-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"), body)


def http1_segments(spark, d):
    """Plain connections made of requests: both streams of a connection, cut into segments without regard to messages.

    Requests share segments; bodies look like requests and answers; some answers are interim, some chunked; segments come twice, or in
    another order.
    """
    n = F.row_number().over(Window.partitionBy("conn").orderBy("start", "req"))
    r = requests(spark, d).withColumn("n", n)
    body = F.concat(F.lit("GET /no HTTP/1.1\r\n\r\n"), _str("req"))
    post = F.concat(F.lit("POST /r/"), _str("req"), F.lit(" HTTP/1.1\r\nHost: h"), _str("conn"), F.lit("\r\n"), _sized(body))
    get = F.concat(F.lit("GET /r/"), _str("req"), F.lit(" HTTP/1.1\r\nHost: h"), _str("conn"), F.lit("\r\n\r\n"))
    told = F.concat(F.lit("HTTP/1.1 999 no\r\n\r\n"), _str("req"))
    line = F.concat(F.lit("HTTP/1.1 "), _str("status"), F.lit(" X\r\n"))
    chunked = F.concat(F.lit("Transfer-Encoding: chunked\r\n\r\n13\r\nHTTP/1.1 999 no\r\n\r\n\r\n"), F.lower(F.hex(F.length(_str("req")))), F.lit(";a=b\r\n"), _str("req"), F.lit("\r\n0\r\nT: GET / HTTP/1.1\r\n\r\n"))
    answer = F.concat(line, F.when(F.col("status") == 304, "\r\n").when(F.col("req") % 2 == 0, chunked).otherwise(_sized(told)))
    answer = F.concat(F.when(F.col("req") % 4 == 0, "HTTP/1.1 100 Continue\r\n\r\n").otherwise(""), answer)
    texts = r.select("conn", F.struct("n", F.when(F.col("req") % 3 == 0, post).otherwise(get).alias("asked"), answer.alias("told")).alias("text"))
    both = texts.groupBy("conn").agg(F.sort_array(F.collect_list("text")).alias("texts"))
    joined = lambda side: F.array_join(F.col("texts")[side], "").cast("binary")
    streams = both.select("conn", F.explode(F.create_map(F.lit(True), joined("asked"), F.lit(False), joined("told"))).alias("forward", "stream"))
    cut = streams.select("conn", "forward", "stream", F.explode(F.sequence(F.lit(0), F.length("stream") - 1, F.lit(_CUT))).alias("seq"))
    cut = cut.withColumn("k", F.expr(f"seq div {_CUT}")).withColumn("copy", F.explode(F.when(F.col("k") % 5 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    late = F.when((F.col("k") % 7 == 3), 15).otherwise(0) + F.col("copy") * 40
    return cut.select(
        F.lit("c").alias("capture"), F.concat(F.lit("f"), _str("conn")).alias("flow"), F.lit(0).alias("generation"), "forward", (F.col("k") * 10 + late + F.when(F.col("forward"), 0).otherwise(10_000_000)).alias("time_us"),
        (F.col("k") * 2 + F.col("copy")).alias("ord"), F.lit("tcp").alias("proto"), (F.col("seq") + 7).cast("long").alias("seq"), F.lit("10.0.0.1").alias("src_ip"), F.lit(5000).alias("src_port"), F.lit("10.0.0.2").alias("dst_ip"), F.lit(80).alias("dst_port"),
        F.expr(f"substring(stream, seq + 1, {_CUT})").alias("payload"),
    )


def http1_framing_(spark, d):
    return http1_framing.framed_requests(http1_segments(spark, d)).select("flow", "n", "method", "url", "status", "bytes_out", "bytes_in", "body_out", "body_in", "interim", "whole")


_FRAMING = f"""
WITH {REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY conn ORDER BY start, req) AS n, length(CAST(req AS VARCHAR)) AS l, length(CAST(conn AS VARCHAR)) AS c FROM r),
b AS (SELECT *, CASE WHEN req % 3 = 0 THEN 20 + l ELSE 0 END AS body_out, CASE WHEN status = 304 THEN 0 ELSE 19 + l END AS body_in FROM n)
SELECT 'f' || conn AS flow, n, CASE WHEN req % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, 'http://h' || conn || '/r/' || req AS url, status,
    CAST(CASE WHEN req % 3 = 0 THEN length('POST /r/ HTTP/1.1..Host: h..Content-Length: NN....') + l + c + body_out ELSE length('GET /r/ HTTP/1.1..Host: h....') + l + c END AS BIGINT) AS bytes_out,
    CAST(length('HTTP/1.1 200 X..') + CASE WHEN status = 304 THEN 2 WHEN req % 2 = 0 THEN length('Transfer-Encoding: chunked....13....') + 19 + length('N;a=b....') + l + length('0..T: GET / HTTP/1.1....') ELSE length('Content-Length: NN....') + body_in END AS BIGINT) AS bytes_in,
    CAST(body_out AS BIGINT) AS body_out, CAST(body_in AS BIGINT) AS body_in, CAST(req % 4 = 0 AS BIGINT) AS interim, true AS whole FROM b
"""

#: Width of a slice (us).
_WIDTH = 700_000


def overflowing_slices(spark, d):
    """Spans with three children each, which overlap: their names together often exceed a slice, over whose bounds some lie."""
    s = spans(spark, d).select("u", (F.col("i") * 1_000_000).alias("a"), "i", "kind", (F.col("du") % 500_000 + 300_000).alias("n"))
    outer = s.select("u", F.lit(1).alias("depth"), F.col("a").alias("start"), (F.col("a") + F.col("n")).alias("end"), F.col("kind").alias("name"), F.lit(None).cast("string").alias("parent"))
    child = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k")
    inner = s.select("u", "a", "n", "i", "kind", child).select("u", F.lit(2).alias("depth"), (F.col("a") + F.col("k") * 10_000).alias("start"), (F.col("a") + F.col("k") * 10_000 + F.expr("n * 2 div 3")).alias("end"), F.when((F.col("i") + F.col("k")) % 5 == 0, F.col("kind")).otherwise(F.concat(F.lit("c"), F.col("k").cast("string"))).alias("name"), F.col("kind").alias("parent"))
    return mainthread.exclusive_slices(outer.unionByName(inner), "u", "start", "end", "name", _WIDTH)


_OVERFLOW = f"""
WITH RECURSIVE {SPANS}, s AS (SELECT u, i * 1000000 AS a, i, kind, du % 500000 + 300000 AS n FROM v),
x AS (SELECT u, a AS st, a + n AS en, 1 AS depth, kind AS name, CAST(NULL AS VARCHAR) AS parent FROM s UNION ALL
    SELECT u, a + k * 10000, a + k * 10000 + n * 2 // 3, 2, CASE WHEN (i + k) % 5 = 0 THEN kind ELSE 'c' || k END, kind FROM s, range(1, 4) AS t(k)),
f AS (SELECT u, name, min((st, depth)) AS first_at FROM x GROUP BY u, name), o AS (SELECT u, name, row_number() OVER (PARTITION BY u ORDER BY first_at, name) AS rank FROM f),
y AS (SELECT x.u, sl AS slice, a.rank AS r, b.rank AS p, least(en, (sl + 1) * {_WIDTH}) - greatest(st, sl * {_WIDTH}) AS used, row_number() OVER (PARTITION BY x.u, sl ORDER BY st, depth, a.rank) AS k
    FROM (SELECT *, unnest(range(st // {_WIDTH}, (en - 1) // {_WIDTH} + 1)) AS sl FROM x WHERE parent IS DISTINCT FROM name) x JOIN o a ON a.u = x.u AND a.name = x.name LEFT JOIN o b ON b.u = x.u AND b.name = x.parent),
w AS (
    SELECT u, slice, CAST(0 AS BIGINT) AS k, list_transform(range(8), lambda z: CAST(0 AS BIGINT)) AS v, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS seen FROM y WHERE k = 1
    UNION ALL
    SELECT u, slice, k, CASE WHEN total <= {_WIDTH} THEN v ELSE list_transform(range(1, 9), lambda j: CASE WHEN j = r THEN v[j] ELSE
            least({_WIDTH} - used, coalesce(list_sum(list_transform(range(1, j + 1), lambda z: CASE WHEN z = r THEN 0 ELSE v[z] END)), 0))
            - least({_WIDTH} - used, coalesce(list_sum(list_transform(range(1, j), lambda z: CASE WHEN z = r THEN 0 ELSE v[z] END)), 0)) END) END,
        CASE WHEN total <= {_WIDTH} THEN total ELSE used + least({_WIDTH} - used, list_sum(v) - v[r]) END, seen
    FROM (
        SELECT w.u, w.slice, y.k, y.r, y.used, list_append(seen, y.r) AS seen, w.total + y.used - CASE WHEN y.p IS NOT NULL AND w.v[y.p] >= y.used THEN y.used ELSE 0 END AS total,
            list_transform(range(1, 9), lambda j: least({_WIDTH}, w.v[j] + CASE WHEN j = y.r THEN y.used WHEN j = y.p AND w.v[j] >= y.used THEN -y.used ELSE 0 END)) AS v
        FROM w JOIN y ON y.u = w.u AND y.slice = w.slice AND y.k = w.k + 1
    )
), z AS (SELECT u, slice, v, seen FROM w QUALIFY row_number() OVER (PARTITION BY u, slice ORDER BY k DESC) = 1)
SELECT z.u, o.name, z.slice, CAST(v[rank] AS BIGINT) AS usecs FROM z JOIN o USING (u) WHERE list_contains(seen, rank)
"""

def _drawn(spark, d):
    """Requests of which half tell offsets, some of them few, and half phases that follow one another; some came before their connection was up."""
    k = F.col("req")
    gone = lambda c, m: F.when(k % m != 0, c)
    told = {"_load_start": gone(k % 50, 4), "_start": gone(k % 45, 3), "_created": gone(k % 40, 5), "_dns_start": F.when(k % 7 == 0, -1).otherwise(gone(k % 30, 2)), "_dns_end": gone(k % 30 + 3, 6), "_connect_start": gone(k % 60, 4), "_connect_end": gone(k % 90, 3), "_ssl_start": gone(k % 70, 8), "_ssl_end": gone(k % 80, 9), "_ttfb_start": gone(k % 55, 10), "_ttfb_end": gone(k % 100, 11), "_download_end": gone(k % 400, 6), "_end": gone(k % 300, 13)}
    phases = {n: (k * a % m - o).cast("double") for n, a, m, o in (("blocked", 3, 20, 2), ("dns", 5, 30, 10), ("connect", 7, 50, 15), ("ssl", 9, 40, 20), ("send", 1, 5, 1), ("wait", 11, 200, 5), ("receive", 13, 300, 5))}
    r = requests(spark, d).withColumns({n: F.when(F.expr("req div 2 % 2 = 0"), c.cast("double")) for n, c in told.items()} | phases)
    return r.withColumn("start", F.col("start").cast("double")).withColumn("first_data", F.when(k % 9 == 0, F.col("start") + 77.0))


_DRAWN = f"""
WITH {REQUESTS}, d AS (SELECT page, req, conn, CAST(start AS DOUBLE) AS start, req // 2 % 2 = 0 AS tells,
    CASE WHEN req // 2 % 2 = 0 THEN {{'load': CASE WHEN req % 4 <> 0 THEN req % 50 END, 'begin': CASE WHEN req % 3 <> 0 THEN req % 45 END, 'made': CASE WHEN req % 5 <> 0 THEN req % 40 END, 'dns': CASE WHEN req % 7 = 0 THEN -1 WHEN req % 2 <> 0 THEN req % 30 END, 'dns_end': CASE WHEN req % 6 <> 0 THEN req % 30 + 3 END,
        'con': CASE WHEN req % 4 <> 0 THEN req % 60 END, 'con_end': CASE WHEN req % 3 <> 0 THEN req % 90 END, 'ssl': CASE WHEN req % 8 <> 0 THEN req % 70 END, 'ssl_end': CASE WHEN req % 9 <> 0 THEN req % 80 END, 'wait': CASE WHEN req % 10 <> 0 THEN req % 55 END, 'first': CASE WHEN req % 11 <> 0 THEN req % 100 END,
        'done': coalesce(CASE WHEN req % 6 <> 0 THEN req % 400 END, CASE WHEN req % 13 <> 0 THEN req % 300 END)}} END AS o,
    greatest(0, req * 3 % 20 - 2) AS blocked, greatest(0, req * 5 % 30 - 10) AS dns, greatest(0, req * 7 % 50 - 15) AS con, greatest(0, req * 9 % 40 - 20) AS ssl, greatest(0, req % 5 - 1) AS send, greatest(0, req * 11 % 200 - 5) AS wait, greatest(0, req * 13 % 300 - 5) AS receive, CASE WHEN req % 9 = 0 THEN start + 77 END AS seen FROM r),
a AS (SELECT *, coalesce(o.load, o.begin, o.dns, o.wait) IS NOT NULL AS absolute, coalesce(o.load, o.begin) AS origin FROM d),
b AS (SELECT *, coalesce(origin, o.wait, 0) AS q FROM a),
c AS (SELECT *, CASE WHEN o.dns >= 0 THEN o.dns ELSE q END AS ds FROM b), e AS (SELECT *, coalesce(o.dns_end, ds) AS de FROM c), f AS (SELECT *, coalesce(o.con, de) AS cs FROM e), g AS (SELECT *, coalesce(o.con_end, cs) AS ce FROM f),
h AS (SELECT *, coalesce(o.ssl, ce) AS ss FROM g), i AS (SELECT *, coalesce(o.ssl_end, ss) AS se FROM h), j AS (SELECT *, coalesce(origin, o.wait, se) AS s0 FROM i), k AS (SELECT *, coalesce(o.first, o.wait, origin, s0) AS f0 FROM j),
l AS (SELECT page, req, conn, start AS began, CASE WHEN absolute THEN greatest(s0, ce) ELSE start + blocked + dns + con + send END AS ordered,
    CASE WHEN absolute THEN {{'zero': start - coalesce(o.made, CASE WHEN origin >= 0 THEN origin END, 0)}} END AS z,
    CASE WHEN absolute THEN [coalesce(o.made, q), q, ds, de, cs, ce, ss, se, greatest(s0, ce), CASE WHEN s0 < ce THEN greatest(f0, ce) ELSE f0 END, coalesce(o.done, o.first, f0)] END AS t, absolute, o, blocked, dns, con, ssl, send, wait, receive, seen FROM k),
m AS (SELECT page, req, conn, began, ordered, CASE WHEN absolute AND o.dns >= 0 THEN least(began, z.zero + o.dns) ELSE began END AS st,
    CASE WHEN absolute THEN list_transform(t, lambda x: x + z.zero) ELSE [began, began + blocked, began + blocked, began + blocked + dns, began + blocked + dns, began + blocked + dns + con, began + blocked + dns + con, began + blocked + dns + con + ssl,
        began + blocked + dns + con + ssl + send, coalesce(seen, began + blocked + dns + con + ssl + send + wait), began + blocked + dns + con + send + wait + receive] END AS t FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ordered, req) AS "index", count(*) OVER (PARTITION BY page) AS n FROM m)
"""


def waterfall_rows(spark, d):
    """The first and last twenty rows of each page."""
    rows = layout.waterfall_rows(_drawn(spark, d), "page", "req", most=40)
    return rows.select("page", "req", "index", "row", "y1", "y2", *layout.TIMES, "max_ms", (F.round("x", 6) + 0.0).alias("x"), (F.round("pixels", 6) + 0.0).alias("pixels"))  # no zero below zero


def waterfall_connections(spark, d):
    """Pages with one row for each connection, those of the requests from the third on that have one."""
    r = _drawn(spark, d).withColumn("conn", F.when(F.col("req") % 6 != 0, F.col("conn")))
    return layout.waterfall_rows(r, "page", "req", filter_text="3-100000", conn="conn", row_height=4).select("page", "req", "index", "row", "y1", "y2")


_TIMES_SQL = ", ".join(f"t[{i}] - base AS {n}" for i, n in enumerate(("queue_start", "queue_end", "dns_start", "dns_end", "connect_start", "connect_end", "ssl_start", "ssl_end", "sent", "first_byte", '"end"'), 1))
_ROWS_SQL = _DRAWN + f""", p AS (SELECT *, CASE WHEN n > 40 AND "index" > 20 THEN "index" - 1 - (n - 40) + 4 ELSE "index" - 1 END AS row FROM n WHERE "index" <= 20 OR "index" > n - 20),
w AS (SELECT *, min(began) OVER (PARTITION BY page) AS base, max(t[11]) OVER (PARTITION BY page) AS last FROM p), x AS (SELECT *, greatest(0, last - base) AS max_ms FROM w)
SELECT page, req, "index", row, row * 18 + 18 AS y1, row * 18 + 35 AS y2, st - base AS start, {_TIMES_SQL}, max_ms, round(250 + (st - base) * (757 / max_ms), 6) + 0.0 AS x, round((t[11] - st) * (757 / max_ms), 6) + 0.0 AS pixels FROM x
"""
_CONNECTIONS_SQL = _DRAWN + """, p AS (SELECT *, CASE WHEN req % 6 <> 0 THEN 'c' || conn ELSE 'r' || req END AS shared FROM n WHERE "index" >= 3),
q AS (SELECT *, min("index") OVER (PARTITION BY page, shared) AS first_at FROM p), s AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY first_at) - 1 AS row FROM q)
SELECT page, req, "index", row, row * 4 + 4 AS y1, row * 4 + 7 AS y2 FROM s
"""


def sent_order(spark, d):
    """The place of each request in an export, which leaves one offset out, and as it is drawn."""
    r = layout.with_offsets_known(_drawn(spark, d)).withColumn("earliest", F.lit(1_600_000_000_000.0))
    delays = [F.col(c) for c in ("blocked", "dns", "connect", "send")]
    exported = layout.sent_order(layout.ORIGIN, F.col("start"), delays, F.col("earliest"))
    drawn = layout.sent_order(layout.DRAWN_ORIGIN, F.col("start"), delays)
    return layout.numbered(layout.numbered(r.select("page", "req", exported.alias("e"), drawn.alias("w")), "page", "e", "req", "exported"), "page", "w", "req", "drawn").select("page", "req", "exported", "drawn")


_SENT_SQL = _DRAWN.replace("n AS (SELECT *, row_number()", "nn AS (SELECT *, row_number()").rstrip() + """, x AS (SELECT page, req, start, blocked, dns, con, send, coalesce(o.load, o.dns, o.wait) IS NOT NULL AS absolute, o, coalesce(o.load, o.wait, 0) AS q FROM d),
y AS (SELECT *, coalesce(o.dns_end, CASE WHEN o.dns >= 0 THEN o.dns ELSE q END) AS de FROM x), v AS (SELECT *, coalesce(o.con_end, o.con, de) AS ce, coalesce(o.ssl_end, o.ssl, o.con_end, o.con, de) AS se FROM y),
u AS (SELECT page, req, CASE WHEN absolute THEN 1600000000000 + greatest(coalesce(o.load, o.wait, se), ce) ELSE start + blocked + dns + con + send END AS e FROM v)
SELECT u.page, u.req, row_number() OVER (PARTITION BY u.page ORDER BY e, u.req) - 1 AS exported, "index" - 1 AS drawn FROM u JOIN nn USING (page, req)
"""


def pointer_objects(spark, d):
    """Objects behind pointers that are used again, and kinds that later events leave out."""
    s = spans(spark, d).withColumn("pointer", F.col("u") % 10)
    told = traces.pointer_epochs(s, ["pointer"], "i", F.col("kind") == "signup", "object")
    told = traces.last_known(told, ["kind"], "i", F.when(F.col("i") % 9 == 0, F.col("u")), "source")
    return told.select("i", "pointer", "object", "source")


_POINTERS = f"""
WITH {SPANS} SELECT i, u % 10 AS pointer, max(CASE WHEN kind = 'signup' THEN i END) OVER (PARTITION BY u % 10 ORDER BY i) AS object,
    last_value(CASE WHEN i % 9 = 0 THEN u END IGNORE NULLS) OVER (PARTITION BY kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS source FROM v
"""


def log_with_timeline(spark, d):
    """Requests of a network log with what the last timeline request of their url tells, and those that only the timeline has."""
    r = requests(spark, d).withColumn("url", F.concat(F.lit("https://h/"), (F.col("req") % 3000).cast("string"))).withColumn("capture", F.col("page").cast("string"))
    logged = r.filter("req % 3 <> 0").select("capture", "req", "url", F.when(F.col("req") % 2 == 0, F.col("status")).alias("status"), F.when(F.col("req") % 5 == 0, F.col("priority")).otherwise("").alias("priority"))
    timeline = r.filter("req % 4 <> 0").select("capture", F.col("req").alias("ord"), "url", F.col("conn").cast("string").alias("kind"), F.col("status").alias("code"), F.concat(F.lit("p"), F.col("priority")).alias("importance"))
    both = traces.enriched(logged, timeline, {"status": "code", "priority": "importance"}, ("kind",))
    lone = timeline.join(logged.select("capture", "url").distinct(), ["capture", "url"], "left_anti")
    return both.unionByName(lone.select("capture", F.col("ord").alias("req"), "url", F.col("code").alias("status"), F.col("importance").alias("priority"), "kind")).select("capture", "req", "url", "status", "priority", "kind")


_LOGGED = f"""
WITH {REQUESTS}, x AS (SELECT CAST(page AS VARCHAR) AS capture, req, 'https://h/' || req % 3000 AS url, status, priority, CAST(conn AS VARCHAR) AS kind FROM r),
t AS (SELECT * FROM x WHERE req % 4 <> 0), m AS (SELECT capture, url, max(req) AS req FROM t GROUP BY ALL), last AS (SELECT t.* FROM t JOIN m USING (capture, url, req)), l AS (SELECT * FROM x WHERE req % 3 <> 0)
SELECT l.capture, l.req, l.url, coalesce(CASE WHEN l.req % 2 = 0 THEN l.status END, last.status) AS status, coalesce(CASE WHEN l.req % 5 = 0 THEN l.priority END, 'p' || last.priority, '') AS priority, last.kind FROM l LEFT JOIN last USING (capture, url)
UNION ALL SELECT capture, req, url, status, 'p' || priority, kind FROM t WHERE (capture, url) NOT IN (SELECT (capture, url) FROM l)
"""

def history_fold(spark, d):
    """What holds of each user's entry after its events: some put it, some change a value of it, some delete it."""
    op = F.when(F.col("kind").isin("view", "signup"), history.PUT).when(F.col("kind") == "error", history.DELETE).otherwise(history.UPDATE)
    told = spans(spark, d).select("u", "i", op.alias("op"), F.when(F.col("kind") != "purchase", F.col("i") % 100).alias("size"), F.when(F.col("kind") != "click", F.concat(F.lit("t"), _str("i"))).alias("title"))
    return history.fold(told, "u", "i", "op", ["size", "title"])


_HISTORY = f"""
WITH {SPANS}, b AS (SELECT u, arg_max(kind, i) AS last_kind, max(i) AS since FROM v WHERE kind IN ('view', 'signup', 'error') GROUP BY u), x AS (SELECT v.*, since FROM v JOIN b USING (u) WHERE last_kind <> 'error' AND i >= since)
SELECT u, arg_max(i % 100, i) FILTER (kind <> 'purchase') AS size, arg_max('t' || i, i) FILTER (kind <> 'click') AS title FROM x GROUP BY u
"""


def lookups_over_http(spark, d):
    """Lookups of connections made of users: questions in urls and in bodies, answers in bodies, of which some answer another name; cut into segments without regard to messages."""
    number = lambda c, n: F.lpad(F.hex(c), n, "0")
    label = lambda c: F.concat(number(F.length(c), 2), F.hex(c), F.lit("076578616D706C650000010001"))
    e = spans(spark, d).filter("kind in ('view', 'click')")
    name, other = F.concat(F.lit("h"), _str("u")), F.concat(F.lit("x"), _str("u"))
    question = F.unhex(F.concat(F.lit("000001000001000000000000"), label(name)))
    answer = F.unhex(F.concat(F.lit("000081800001000100000000"), label(F.when(F.col("i") % 5 == 0, other).otherwise(name)), F.lit("C00C000100010000000000040A00"), number(F.col("i") % 65536, 4)))
    raw = lambda c: F.encode(c, "UTF-8")
    kind = F.lit("Content-Type: application/dns-message\r\nContent-Length: ")
    get = raw(F.concat(F.lit("GET /q?dns="), F.translate(F.regexp_replace(F.base64(question), "=", ""), "+/", "-_"), F.lit(" HTTP/1.1\r\nHost: r\r\n\r\n")))
    post = F.concat(raw(F.concat(F.lit("POST /q HTTP/1.1\r\n"), kind, F.length(question).cast("string"), F.lit("\r\n\r\n"))), question)
    told = F.concat(raw(F.concat(F.lit("HTTP/1.1 200 OK\r\n"), kind, F.length(answer).cast("string"), F.lit("\r\n\r\n"))), answer)
    texts = e.select("u", "i", F.explode(F.create_map(F.lit(True), F.when(F.col("kind") == "view", get).otherwise(post), F.lit(False), told)).alias("forward", "data"))
    streams = texts.groupBy("u", "forward").agg(F.sort_array(F.collect_list(F.struct("i", "data"))).alias("parts"))
    streams = streams.select("u", "forward", F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["data"])).alias("stream"))
    cut = streams.select("u", "forward", "stream", F.explode(F.sequence(F.lit(0), F.length("stream") - 1, F.lit(_CUT))).alias("seq"))
    at = F.expr(f"seq div {_CUT}")
    flows = cut.select(
        F.lit("c").alias("capture"), F.concat(F.lit("f"), _str("u")).alias("flow"), F.lit(0).alias("generation"), "forward", (at + F.when(F.col("forward"), 0).otherwise(10_000_000)).cast("long").alias("time_us"), at.cast("long").alias("ord"), F.lit("tcp").alias("proto"),
        F.col("seq").cast("long").alias("seq"), F.lit("10.0.0.1").alias("src_ip"), F.lit(5000).alias("src_port"), F.lit("10.0.0.2").alias("dst_ip"), F.lit(80).alias("dst_port"), F.expr(f"substring(stream, seq + 1, {_CUT})").alias("payload"),
    )
    return lookups.http_lookups(http1_framing.exchanges(flows)).select("name", F.array_join("addresses", ",").alias("addresses"), "code")


_OVER_HTTP = f"WITH {SPANS} SELECT 'h' || u || '.example' AS name, '10.0.' || i % 65536 // 256 || '.' || i % 256 AS addresses, CAST(0 AS INTEGER) AS code FROM v WHERE kind IN ('view', 'click') AND i % 5 <> 0"

def utilization_shapes(spark, d):
    """Series of users in all shapes: a list of samples and their most, an object of them, with a bandwidth that some exceed, and none of these."""
    s = spans(spark, d).groupBy("u").agg(F.sort_array(F.collect_list("i")).alias("i"))
    point = lambda value: F.map_from_entries(F.transform("i", lambda x: F.struct((x * 10).cast("string").alias("k"), value(x).alias("v"))))
    bw = F.to_json(point(lambda x: x % 3000 * 1000))
    cpu = F.to_json(point(lambda x: (x % 90).cast("string")))
    text = F.concat(F.lit('{"bw":['), bw, F.lit(',"2500000",7],"cpu":{"data":'), cpu, F.lit(',"max":'), (F.col("u") % 300).cast("string"), F.lit(',"count":1},"note":[1,2],"mem":{"max":3}}'))
    raw = s.select("u", F.parse_json(text).alias("raw"), F.when(F.col("u") % 2 == 0, 2000.0).alias("bw_down"))
    told = pages.utilization(raw, ["u"], "raw", "bw_down")
    return told.select("u", "series", "ts", F.round("pct", 6).alias("pct"), "most", F.to_json("plain").alias("plain"))


_UTILIZATION = f"""
WITH RECURSIVE {SPANS}, e AS (SELECT u, i, row_number() OVER (PARTITION BY u ORDER BY i DESC) AS k, count(*) OVER (PARTITION BY u) AS n, i % 3000 * 1000.0 AS x FROM v WHERE u % 2 = 0),
c AS (SELECT u, k, n, i * 10.0 AS ts, least(x, 2000000.0) AS y, greatest(0, x - 2000000.0) AS carry FROM e WHERE k = 1
    UNION ALL SELECT c.u, c.k + 1, c.n, coalesce(e.i * 10.0, c.ts - (SELECT CASE WHEN count(*) > 1 THEN (max(i) FILTER (k = c.n - 1) - min(i)) * 10.0 ELSE 100.0 END FROM e z WHERE z.u = c.u)), least(coalesce(e.x, 0) + c.carry, 2000000.0), greatest(0, coalesce(e.x, 0) + c.carry - 2000000.0)
    FROM c LEFT JOIN e ON e.u = c.u AND e.k = c.k + 1 WHERE c.k < c.n OR c.carry > 0)
SELECT u, 'bw' AS series, ts, round(y / 2000000.0 * 100, 6) AS pct, 2000000.0::DOUBLE AS most, NULL AS plain FROM c
UNION ALL SELECT u, 'bw', i * 10.0, round(i % 3000 * 1000.0 / 2500000.0 * 100, 6), 2500000.0, NULL FROM v WHERE u % 2 <> 0
UNION ALL SELECT u, 'cpu', i * 10.0, round((i % 90) / greatest(1, u % 300)::DOUBLE * 100, 6), greatest(1, u % 300)::DOUBLE, NULL FROM v
UNION ALL SELECT DISTINCT u, 'note', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, '[1,2]' FROM v UNION ALL SELECT DISTINCT u, 'mem', NULL, NULL, NULL, '{{"max":3}}' FROM v
"""


def long_tasks_merged(spark, d):
    """Tasks of users, some of them toplevel, which join those that they meet."""
    s = spans(spark, d).select("u", "kind", (F.col("i") * 70_000).alias("a"), (F.col("i") * 70_000 + F.col("du") % 140_001).alias("b"), "i").withColumn("u", F.col("u") % 20)
    s = s.withColumn("b", F.when(F.col("i") % 4 == 0, F.col("a") + 70_000).otherwise(F.col("b")))
    return intervals.merged_long_tasks(s.filter("kind <> 'view' or u % 2 = 0"), s.filter("kind = 'view' and u % 2 = 1"), "u", "a", "b")


_TASKS = f"""
WITH {SPANS}, s AS (SELECT u % 20 AS u, kind, i * 70000 AS a, CASE WHEN i % 4 = 0 THEN i * 70000 + 70000 ELSE i * 70000 + du % 140001 END AS b FROM v),
t AS (SELECT u, a // 1000 AS s, (b + 999) // 1000 AS e, kind = 'view' AND u % 2 = 1 AS top FROM s WHERE CASE WHEN kind = 'view' AND u % 2 = 1 THEN b - a >= 50000 ELSE b - a > 50000 END), h AS (SELECT *, bool_or(top) OVER (PARTITION BY u) AS merges FROM t),
m AS (SELECT *, max(e) OVER (PARTITION BY u ORDER BY s, e, top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM h),
g AS (SELECT *, sum(CASE WHEN upto IS NULL OR s > upto OR (s = upto AND NOT merges) THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY s, e, top ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT u, min(s) AS start_ms, max(e) AS end_ms, count(*) AS n FROM g GROUP BY u, k
"""

#: Times of a page that a query makes of a number: name, factor, modulus, offset.
_MARKS = (("render", 3, 50, 5), ("dom_start", 5, 40, 9), ("dom_end", 7, 60, 20), ("on_dom", 11, 70, 30), ("load_start", 13, 80, 20), ("load_end", 17, 90, 15), ("on_load", 19, 30, 10), ("fcp", 23, 44, 11), ("lcp", 29, 33, 12), ("interactive", 31, 55, 13))


def page_marks(spark, d):
    """All times that are marked on a page, of which some were not measured."""
    k = F.col("c_custkey")
    told = layout.page_events(*[(k * a % m - o).cast("long") for _, a, m, o in _MARKS])
    return table(spark, d, "customer").select("c_custkey", *[c.alias(n) for n, c in told.items()])


_MARKS_SQL = "WITH m AS (SELECT c_custkey, " + ", ".join(f"c_custkey * {a} % {m} - {o} AS {n}" for n, a, m, o in _MARKS) + """ FROM customer)
SELECT c_custkey, CASE WHEN render > 0 THEN render END AS render, CASE WHEN dom_start > 0 AND dom_end > 0 THEN dom_start WHEN on_dom > 0 THEN on_dom WHEN dom_end > 0 THEN dom_end END AS nav_dom_start,
    CASE WHEN dom_start > 0 AND dom_end > 0 THEN dom_end WHEN on_dom > 0 THEN on_dom WHEN dom_end > 0 THEN dom_end END AS nav_dom_end, CASE WHEN load_end > 0 THEN CASE WHEN load_start > 0 THEN load_start ELSE load_end END END AS nav_load_start,
    CASE WHEN load_end > 0 THEN load_end END AS nav_load_end, CASE WHEN on_load > 0 THEN on_load END AS load, CASE WHEN fcp > 0 THEN fcp END AS fcp, CASE WHEN lcp > 0 THEN lcp END AS lcp, CASE WHEN interactive > 0 THEN interactive END AS nav_dom_interactive FROM m
"""


def requests_by_name(spark, d):
    """Requests of one page as they are handed out by page and number, without their bodies."""
    r = requests(spark, d).withColumn("body", F.lit("bulk"))
    return outputs.request(r, F.lit(7), F.when(F.col("req") % 100 == 5, F.col("req"))).select("page", "req", "status")


_NAMED = f"WITH {REQUESTS} SELECT page, req, status FROM r WHERE page = 7 AND req % 100 = 5"

QUERIES = {"http1_framing": http1_framing_, "overflowing_slices": overflowing_slices} | {f.__name__: f for f in (waterfall_rows, waterfall_connections, sent_order, pointer_objects, log_with_timeline, history_fold, lookups_over_http, utilization_shapes, long_tasks_merged, page_marks, requests_by_name)}
SQL = {"http1_framing": _FRAMING, "overflowing_slices": _OVERFLOW, "waterfall_rows": _ROWS_SQL, "waterfall_connections": _CONNECTIONS_SQL, "sent_order": _SENT_SQL, "pointer_objects": _POINTERS, "log_with_timeline": _LOGGED, "history_fold": _HISTORY, "lookups_over_http": _OVER_HTTP, "utilization_shapes": _UTILIZATION, "long_tasks_merged": _TASKS, "page_marks": _MARKS_SQL, "requests_by_name": _NAMED}
