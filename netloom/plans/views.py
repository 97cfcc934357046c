"""Queries over layout, text rules, statistics of pages and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import text as X
from netloom.operators import layout, outputs
from netloom.plans.adapters import CHUNKS, REQUESTS, chunks, requests, table

FLAGS = {1: "REVOKED", 2: "NAME_INVALID", 4: "DATE_INVALID", 8: "AUTHORITY_INVALID", 32: "NO_REVOCATION", 128: "INVALID"}
_CHROME = {"1-URGENT": "Highest", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Low", "5-LOW": "Lowest"}


def req_filter(spark, d):
    return layout.request_filter(requests(spark, d), ["page"], ["start", "req"], "1-5, 9,12-20").select("page", "req", "index")


def thumbnail_head_tail(spark, d):
    return layout.head_tail(requests(spark, d), ["page"], ["start", "req"], 15).select("page", "req", "index", "torn")


def connection_rows(spark, d):
    return layout.connection_rows(requests(spark, d), "page", "conn", ["start", "req"]).select("page", "req", "conn", "row")


def _phased(spark, d):
    return requests(spark, d).select("*", *[(F.col("req") * k % m - o).alias(n) for n, k, m, o in (("blocked", 3, 20, 2), ("dns", 5, 30, 10), ("connect", 7, 50, 15), ("send", 1, 5, 1), ("wait", 11, 200, 5), ("receive", 13, 300, 5))])


_PHASED = REQUESTS + ", p AS (SELECT *, " + ", ".join(f"req * {k} % {m} - {o} AS {n}" for n, k, m, o in (("blocked", 3, 20, 2), ("dns", 5, 30, 10), ("connect", 7, 50, 15), ("send", 1, 5, 1), ("wait", 11, 200, 5), ("receive", 13, 300, 5))) + " FROM r)"


def phase_geometry(spark, d):
    p = _phased(spark, d)
    cols = layout.sequential_phases(*[F.col(c) for c in ("start", "blocked", "dns", "connect", "send", "wait", "receive")])
    return p.select("page", "req", *[c.cast("long").alias(n) for n, c in cols.items()])


def har_entry_order(spark, d):
    from pyspark.sql import Window

    p = _phased(spark, d).withColumn("load_start", layout.load_start(F.col("start"), [F.col(c) for c in ("blocked", "dns", "connect", "send")]))
    return p.select("page", "req", "load_start", F.row_number().over(Window.partitionBy("page").orderBy("load_start", "req")).cast("long").alias("rank"))


def time_axis(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 37 + 11).cast("double").alias("max_ms"))
    return c.select("c_custkey", layout.axis_interval(F.col("max_ms"), 20).alias("step"))


_AXIS = """
WITH m AS (SELECT c_custkey, CAST(c_custkey * 37 + 11 AS DOUBLE) AS max_ms FROM customer), g AS (SELECT *, pow(10.0, floor(log10(max_ms / 20))) AS mag FROM m),
s AS (SELECT c_custkey, mag * f AS step, abs(20.0 - max_ms / (mag * f)) AS miss, f FROM g, (VALUES (1.0), (2.0), (5.0), (10.0)) AS t(f))
SELECT c_custkey, CAST(step AS DOUBLE) AS step FROM s QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY miss, f DESC) = 1
"""


def mime_category(spark, d):
    p = table(spark, d, "pages").withColumn("u", F.concat("url", F.element_at(F.array(*map(F.lit, ("/a.js", "/b.css?x=1", "/c.PNG", "/d.woff2", "/e", "/f.mp4"))), (F.col("page_id") % 6 + 1).cast("int"))))
    mime = F.when(F.col("page_id") % 5 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 7 == 0, "application/javascript")
    return p.select("page_id", X.mime_category(mime, F.col("u")).alias("category"))


_MIME = """
WITH p AS (SELECT page_id, url || (['/a.js', '/b.css?x=1', '/c.PNG', '/d.woff2', '/e', '/f.mp4'])[page_id % 6 + 1] AS u, CASE WHEN page_id % 5 = 0 THEN 'text/html' WHEN page_id % 7 = 0 THEN 'application/javascript' ELSE '' END AS m FROM pages),
x AS (SELECT *, lower(regexp_extract(u, '\\.([a-zA-Z0-9]+)(?:[?#]|$)', 1)) AS ext FROM p)
SELECT page_id, CASE WHEN m LIKE '%javascript' THEN 'js' WHEN m = 'text/html' THEN 'html' WHEN ext IN ('js', 'mjs') THEN 'js' WHEN ext = 'css' THEN 'css' WHEN ext IN ('html', 'htm') THEN 'html'
    WHEN ext IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'svg', 'avif', 'ico') THEN 'image' WHEN ext IN ('mp4', 'webm') THEN 'video' WHEN ext = 'swf' THEN 'flash' WHEN ext IN ('woff', 'woff2', 'ttf', 'otf', 'eot') THEN 'font' ELSE 'other' END AS category FROM x
"""


def sniff_mime(spark, d):
    t = table(spark, d, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    t = t.unionByName(table(spark, d, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("body")))
    return t.select("origin", "id", X.sniff_text(F.col("body")).alias("mime"))


_SNIFF = r"""
WITH t AS (SELECT 'page' AS origin, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
s AS (SELECT origin, id, lower(substring(body, 1, 1024)) AS s FROM t),
l AS (SELECT *, ltrim(s, E' \t\n\f\r\x0b\uFEFF\u00EF\u00BB\u00BF') AS t FROM s),
w AS (SELECT *, regexp_extract(t, '^\W*') AS mark, regexp_extract(t, '^\W*([a-z-]*)', 1) AS word, regexp_extract(t, '^[a-z]+') AS first,
    list_transform(regexp_extract_all(t, '[a-z-]+\s*:'), lambda n: string_split(rtrim(rtrim(n, ':')), '-')[-1]) AS names,
    regexp_extract_all(t, '<!?[a-z]+') AS tags, regexp_extract_all(s, '[a-z]+[ (;]') AS words, split_part(substring(t, strpos(t, '{') + 1), '}', 1) AS block FROM l),
k AS (SELECT *, substring(t, length(first) + 1, 1) AS after, regexp_replace(substring(t, 1, 64), '\s', '', 'g') AS dense FROM w)
SELECT origin, id, CASE
    WHEN s IS NULL THEN ''
    WHEN mark = '<' AND substring(word, 1, 4) IN ('html', 'head', 'body') OR mark = '<!' AND word[:7] = 'doctype' THEN 'text/html'
    WHEN t[:4] = '<!--' AND len(list_filter(tags, lambda x: x[:5] IN ('<html', '<head') OR x[:9] = '<!doctype')) > 0 THEN 'text/html'
    WHEN mark = '@' AND len(list_filter(['charset', 'import', 'media', 'font-face', 'keyframes', 'layer', 'supports', 'namespace'], lambda r: starts_with(word, r))) > 0 THEN 'text/css'
    WHEN contains(t, '{') AND regexp_matches(t[:1], '[a-z_]|[^\w\s<("''/@&;!{]') AND (contains(block, ':') OR contains(block, ';'))
        AND list_has_any(names, ['display', 'margin', 'padding', 'color', 'background', 'border', 'width', 'height', 'position', 'overflow', 'align', 'flex', 'grid']) THEN 'text/css'
    WHEN first IN ('var', 'let', 'const', 'import', 'export') AND after = ' ' OR first = 'function' AND after IN (' ', '(') OR first IN ('window', 'document', 'self', 'globalthis') AND after = '.'
        OR t[2:11] = 'use strict' OR starts_with(dense, '(function') OR starts_with(dense, '!function') OR starts_with(dense, 'voidfunction') OR starts_with(dense, '(()')
        OR (starts_with(t, '//') OR starts_with(t, '/*')) AND (contains(s, '=>') OR list_has_any(list_transform(words, lambda x: x[:-2]), ['var', 'let', 'const', 'import', 'export', 'function', 'return'])) THEN 'application/javascript'
    ELSE '' END AS mime FROM k
"""


def sniff_format(spark, d):
    heads = ['{"log":{"version":"1.2"', '{"traceEvents":[', '[{"method":"Network.x"', '{"constants":{"logEventTypes":', 'CLIENT_RANDOM a b', '{"data":{"runs":', 'plain']
    t = table(spark, d, "documents").select("doc_id", F.concat(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 7 + 1).cast("int")), F.coalesce("text", F.lit(""))).alias("body"))
    return t.select("doc_id", X.sniff_format(F.substring("body", 1, 65536)).alias("format"))


def header_parse(spark, d):
    r = requests(spark, d)
    lines = F.array(F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" X")), F.concat(F.lit("Content-Length: "), (F.col("req") * 7).cast("string"), F.lit("b")), F.lit(":path: /x"), F.concat(F.lit("ETag:"), F.col("priority")))
    h = r.select("req", lines.alias("lines")).withColumn("headers", F.filter(F.transform("lines", X.split_header), lambda x: x.isNotNull()))
    return h.select("req", X.status_of(F.col("lines")[0]).alias("status"), X.leading_int(X.header(F.col("headers"), "content-length")).alias("size"), X.header(F.col("headers"), "etag").alias("etag"), F.size("headers").cast("long").alias("n"))


def priority_map(spark, d):
    return requests(spark, d).select("req", X.priority_name(F.col("priority"), _CHROME).alias("priority"))


def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", X.url_host(u).alias("host"), X.url_path(u).alias("path"), X.url_port(u).cast("long").alias("port"), X.url_label(u, 40).alias("label"))


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"
_URL_PARTS = rf"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)', 1) AS p0, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*:(\d{{1,5}})(?:[/?#]|$)', 1) AS pt FROM pages),
q AS (SELECT *, CASE WHEN p0 = '' THEN '/' ELSE p0 END AS path FROM p), f AS (SELECT *, host || ' - ' || path AS lb FROM q)
SELECT page_id, host, path, CASE WHEN pt <> '' THEN CAST(pt AS BIGINT) WHEN lower(url) LIKE 'https:%' THEN 443 ELSE 80 END AS port,
    CASE WHEN length(lb) <= 40 THEN lb ELSE left(lb, 19) || '...' || right(lb, 18) END AS label FROM f
"""


def http_date(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("value"))
    return o.select("o_orderkey", X.http_date_ms(F.col("value")).alias("epoch_ms"))


def flag_names(spark, d):
    return requests(spark, d).select("req", X.flag_names(F.col("req"), FLAGS).alias("flags"))


_FLAG_NAMES = f"WITH {REQUESTS} SELECT req, concat_ws(',', " + ", ".join(f"CASE WHEN (req & {b}) <> 0 THEN '{n}' END" for b, n in FLAGS.items()) + ") AS flags FROM r"


def page_stats(spark, d):
    c = chunks(spark, d, numbered=False).groupBy("req").agg(F.sum("bytes").cast("long").alias("bytes"))
    r = requests(spark, d).join(c, "req", "left")
    n = lambda c: F.count(F.when(c, 1))
    return r.groupBy("page").agg(F.count(F.lit(1)).alias("requests"), n(F.col("status") == 200).alias("ok"), n(F.col("status") == 404).alias("not_found"), n(~F.col("status").isin(200, 404)).alias("other"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes_in"), F.max("start").alias("fully_loaded"))


def tile_summary(spark, d):
    s = page_stats(spark, d)
    return s.select("page", X.rating(F.col("requests"), 100, 160).alias("requests_rating"), X.rating(F.col("bytes_in"), 1_000_000, 2_000_000).alias("bytes_rating"), X.humanize_bytes(F.col("bytes_in")).alias("bytes_text"))


_STATS = f"""{REQUESTS}, {CHUNKS}, b AS (SELECT req, sum(bytes) AS bytes FROM c GROUP BY req),
s AS (SELECT page, count(*) AS requests, count(*) FILTER (status = 200) AS ok, count(*) FILTER (status = 404) AS not_found, count(*) FILTER (status NOT IN (200, 404)) AS other, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes_in, max(start) AS fully_loaded FROM r LEFT JOIN b USING (req) GROUP BY page)"""


def simple_json(spark, d):
    return outputs.flat_requests(outputs.entries(requests(spark, d), chunks(spark, d)))


_SIMPLE = f"""
WITH {REQUESTS}, {CHUNKS}, b AS (SELECT req, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(inflated) AS BIGINT) AS inflated, max(ts) // 1000 AS t1 FROM c GROUP BY req)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY start, req) AS index, 'https://host' || conn || '.example/r/' || req AS url, 'host' || conn || '.example' AS host, 'GET' AS method, status,
    coalesce(bytes, 0) AS bytes_in, coalesce(inflated, 0) AS object_size, coalesce(t1 - start, -1) AS load_ms FROM r LEFT JOIN b USING (req)
"""


def har_export(spark, d):
    return outputs.har_log(outputs.entries(requests(spark, d), chunks(spark, d)))


def ext_lift(spark, d):
    """Typed columns out of open extension fields; a name at the root wins over a lifted one."""
    e = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    m = F.col("v").cast("map<string,variant>")
    lifted = F.transform_keys(F.map_filter(m, lambda k, _: F.length(k) > 0), lambda k, _: F.concat(F.lit("_"), k))
    return e.select("event_id", F.try_variant_get(F.get(F.map_values(lifted), 0), "$", "bigint").alias("k"), F.array_join(F.map_keys(lifted), ",").alias("names"))


def gcm_round_trip(spark, d):
    """Authenticated decryption of what was encrypted with a key derived for each row; a wrong tag gives null."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32))
    sealed = t.withColumn("sealed", F.expr("aes_encrypt(text, key, 'GCM', 'DEFAULT', unhex(substr(sha2(key, 256), 1, 24)), 'aad')"))
    return sealed.select("doc_id", F.expr("cast(try_aes_decrypt(sealed, key, 'GCM', 'DEFAULT', 'aad') as string) = text").alias("opens"), F.expr("try_aes_decrypt(sealed, key, 'GCM', 'DEFAULT', 'bad') is null").alias("rejects"))


QUERIES = {f.__name__: f for f in (req_filter, thumbnail_head_tail, connection_rows, phase_geometry, har_entry_order, time_axis, mime_category, sniff_mime, sniff_format, header_parse, priority_map, url_parts, http_date, flag_names, page_stats, tile_summary, simple_json, har_export, ext_lift, gcm_round_trip)}

SQL = {
    "req_filter": f'WITH {REQUESTS}, n AS (SELECT page, req, row_number() OVER (PARTITION BY page ORDER BY start, req) AS "index" FROM r) SELECT * FROM n WHERE "index" BETWEEN 1 AND 5 OR "index" = 9 OR "index" BETWEEN 12 AND 20',
    "thumbnail_head_tail": f'WITH {REQUESTS}, n AS (SELECT page, req, row_number() OVER (PARTITION BY page ORDER BY start, req) AS "index", count(*) OVER (PARTITION BY page) AS n FROM r) SELECT page, req, "index", n > 15 AND "index" = 7 AS torn FROM n WHERE "index" <= 7 OR "index" > n - 8',
    "connection_rows": f"WITH {REQUESTS}, a AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY start, req) AS pos FROM r), f AS (SELECT *, min(pos) OVER (PARTITION BY page, conn) AS first FROM a) SELECT page, req, conn, dense_rank() OVER (PARTITION BY page ORDER BY first) - 1 AS row FROM f",
    "phase_geometry": f"""
        WITH {_PHASED}, a AS (SELECT *, start + greatest(0, blocked) AS queue_end FROM p), b AS (SELECT *, queue_end + greatest(0, dns) AS dns_end FROM a), e AS (SELECT *, dns_end + greatest(0, connect) AS connect_end FROM b),
        g AS (SELECT *, connect_end + greatest(0, send) AS request_start FROM e), h AS (SELECT *, request_start + greatest(0, wait) AS first_byte FROM g)
        SELECT page, req, queue_end, dns_end, connect_end, request_start, first_byte, first_byte + greatest(0, receive) AS "end" FROM h""",
    "har_entry_order": f"WITH {_PHASED}, l AS (SELECT page, req, start + greatest(0, blocked) + greatest(0, dns) + greatest(0, connect) + greatest(0, send) AS load_start FROM p) SELECT *, row_number() OVER (PARTITION BY page ORDER BY load_start, req) AS rank FROM l",
    "time_axis": _AXIS,
    "mime_category": _MIME,
    "sniff_mime": _SNIFF,
    "sniff_format": "SELECT doc_id, (['har', 'chrome-trace', 'cdp', 'netlog', 'keylog', 'wpt', 'unknown'])[doc_id % 7 + 1] AS format FROM documents",
    "header_parse": f"WITH {REQUESTS} SELECT req, CAST(status AS INTEGER) AS status, req * 7 AS size, priority AS etag, CAST(2 AS BIGINT) AS n FROM r",
    "priority_map": f"WITH {REQUESTS} SELECT req, CASE priority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CHROME.items()) + " ELSE priority END AS priority FROM r",
    "url_parts": _URL_PARTS,
    "http_date": "SELECT o_orderkey, epoch_us(date_trunc('second', o_orderdate)) // 1000 AS epoch_ms FROM orders",
    "flag_names": _FLAG_NAMES,
    "page_stats": f"WITH {_STATS} SELECT * FROM s",
    "tile_summary": f"""WITH {_STATS} SELECT page, CASE WHEN requests <= 100 THEN 'good' WHEN requests <= 160 THEN 'warning' ELSE 'poor' END AS requests_rating, CASE WHEN bytes_in <= 1000000 THEN 'good' WHEN bytes_in <= 2000000 THEN 'warning' ELSE 'poor' END AS bytes_rating,
        CASE WHEN bytes_in < 1024 THEN printf('%d B', bytes_in) WHEN bytes_in < 1048576 THEN printf('%.1f KB', bytes_in / 1024) ELSE printf('%.1f MB', bytes_in / 1048576) END AS bytes_text FROM s""",
    "simple_json": _SIMPLE,
    "ext_lift": "SELECT event_id, CAST(json_extract(props, '$.*')[1] AS BIGINT) AS k, array_to_string(list_transform(json_keys(props), lambda x: '_' || x), ',') AS names FROM events",
    "gcm_round_trip": "SELECT doc_id, true AS opens, true AS rejects FROM documents",
}
