"""Queries over ownership, joins and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import text as X
from netloom.operators import intervals, ownership
from netloom.plans.adapters import CHUNKS, REQUESTS, SPANS, chunks, requests, spans, table


def conn_owner(spark, d):
    return ownership.first_claim(requests(spark, d), ["page", "conn"], ["start", "req"]).select("req", "page", "conn", "is_owner")


def _timed(spark, d):
    """Requests with chunk times; connections and lookups derived from the customers."""
    c = chunks(spark, d, numbered=False).groupBy("req").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    r = requests(spark, d).join(c, "req", "left")
    r = r.withColumn("first_data", F.coalesce(F.expr("t0 div 1000"), F.lit(0))).withColumn("end", F.coalesce(F.expr("t1 div 1000"), F.col("start")))
    r = r.withColumn("dns_id", F.col("conn") % 40)
    conns = table(spark, d, "customer").select(F.col("c_custkey").alias("conn"), (F.col("c_custkey") * 10).alias("c_start"), (F.col("c_custkey") * 10 + F.col("c_nationkey") * 7 - 20).alias("c_end"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_custkey") * 10 + 5).alias("tls_start"))
    look = spark.range(40).select(F.col("id").alias("dns_id"), (F.col("id") * 3).alias("d_start"), (F.col("id") * 4 - 9).alias("d_end"))
    return r, conns, look


def request_timings(spark, d):
    return ownership.request_timings(*_timed(spark, d))


_TIMINGS = f"""
WITH {REQUESTS}, {CHUNKS}, t AS (SELECT req, min(ts) AS t0, max(ts) AS t1 FROM c GROUP BY req),
q AS (SELECT r.*, coalesce(t0 // 1000, 0) AS first_data, coalesce(t1 // 1000, start) AS "end", conn % 40 AS dns_id FROM r LEFT JOIN t USING (req)),
o AS (SELECT *, row_number() OVER (PARTITION BY page, conn ORDER BY start, req) = 1 AS pc, row_number() OVER (PARTITION BY page, dns_id ORDER BY start, req) = 1 AS pd,
    CASE WHEN first_data > 0 THEN first_data ELSE "end" END AS f FROM q),
p AS (SELECT o.page, o.req, o.start, o.f, o."end",
    CASE WHEN pd AND dns_id * 4 - 9 >= dns_id * 3 THEN dns_id - 9 ELSE -1 END AS dns,
    CASE WHEN pc AND c_nationkey * 7 - 20 >= 0 THEN c_nationkey * 7 - 20 ELSE -1 END AS connect,
    CASE WHEN pc AND c_nationkey % 3 = 0 THEN greatest(0, c_nationkey * 7 - 25) ELSE -1 END AS ssl
    FROM o LEFT JOIN customer ON c_custkey = conn)
SELECT page, req, CAST(dns AS BIGINT) AS dns, CAST(connect AS BIGINT) AS connect, CAST(ssl AS BIGINT) AS ssl, greatest(0, f - start) AS wait, greatest(0, "end" - f) AS receive,
    CAST(greatest(0, dns) + greatest(0, connect) + greatest(0, f - start) + greatest(0, "end" - f) AS BIGINT) AS total_ms FROM p
"""


def page_earliest(spark, d):
    s = spans(spark, d)
    return s.groupBy("u").agg(F.min(F.when(F.col("st") > 0, F.col("st"))).alias("earliest"), F.max("en").alias("latest"), F.count(F.lit(1)).alias("n"))


def http_only(spark, d):
    return table(spark, d, "pages").filter(X.is_web(F.col("url")) & ~X.is_noise(F.col("url"))).select("page_id", "url")


def network_activity(spark, d):
    c = chunks(spark, d).filter(F.col("seq") > 1).groupBy("req").agg(F.sum("bytes").cast("long").alias("bytes_in"))
    r = requests(spark, d).join(c, "req", "left")
    return r.filter((F.col("start") > 0) & ((F.coalesce("bytes_in", F.lit(0)) > 0) | (F.col("status") == 404))).select("req", F.coalesce("bytes_in", F.lit(0)).alias("bytes_in"))


def enrich_last_wins(spark, d):
    p = table(spark, d, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))
    o = table(spark, d, "pages").select(X.url_host(F.col("url")).alias("host"), F.col("page_id").alias("ord"), F.length("html").alias("size"))
    return ownership.enrich_last_wins(p, o, "host", "ord", ["size"]).select("page_id", "host", F.col("size").cast("long").alias("size"))


def timeline_synthesis(spark, d):
    r = requests(spark, d).filter("status = 200").select("req", F.lit("log").alias("origin"))
    o = chunks(spark, d, numbered=False).select("req").distinct().withColumn("origin", F.lit("timeline"))
    return ownership.union_unmatched(r, o, "req")


def first_per_url(spark, d):
    p = table(spark, d, "pages").withColumn("host", X.url_host(F.col("url")))
    return ownership.first_per(p, ["host"], ["page_id"]).select("host", "page_id", "url")


def dns_claim(spark, d):
    s = spans(spark, d)
    claims = s.filter("kind = 'click'").groupBy("u").agg(F.min(F.struct("st", "i")).alias("f")).select("u", F.col("f.i").alias("claim"), F.col("f.st").alias("bound"))
    look = s.filter("kind = 'view'").select("u", F.col("i").alias("l_id"), F.col("st").alias("l_start"), F.col("en").alias("l_end"))
    return intervals.claim_lookups(claims, look, "u")


_DNS_CLAIM = f"""
WITH {SPANS}, f AS (SELECT u, i AS claim, st AS bound FROM v WHERE kind = 'click' QUALIFY row_number() OVER (PARTITION BY u ORDER BY st, i) = 1),
l AS (SELECT u, i AS l_id, st AS l_start, en AS l_end FROM v WHERE kind = 'view'),
b AS (SELECT *, least(l_end, bound) AS clipped FROM f JOIN l USING (u) WHERE least(l_end, bound) >= l_start)
SELECT u, claim, l_id, l_start, clipped AS l_end FROM b QUALIFY row_number() OVER (PARTITION BY u ORDER BY clipped - l_start DESC, l_start, l_id) = 1
"""


def dns_pairing(spark, d):
    return intervals.pair_asof(spans(spark, d), "u", ["st", "i"], "kind", "signup", "click", "i")


def unlinked(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("conn"), "c_mktsegment")
    return c.join(requests(spark, d).select("conn").distinct(), "conn", "left_anti")


def initiator_chain(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("c"), F.expr("event_id div 3").alias("p")).filter("c > 0")
    return ownership.ancestry(e, "c", "p", 16)


_CHAIN = """
WITH RECURSIVE e AS (SELECT event_id AS c, event_id // 3 AS p FROM events WHERE event_id > 0),
w AS (SELECT c AS child, p AS root, 1 AS depth FROM e UNION ALL SELECT w.child, e.p, w.depth + 1 FROM w JOIN e ON w.root = e.c WHERE w.depth < 16)
SELECT child, arg_max(root, depth) AS root, CAST(max(depth) AS INTEGER) AS depth FROM w GROUP BY child
"""


def url_set_compare(spark, d):
    """The urls of all pages without their fragment against those in lower case without a last slash."""
    p, url = table(spark, d, "pages"), F.split_part("url", F.lit("#"), F.lit(1))
    return ownership.set_compare(p.select(url.alias("url")), p.select(F.rtrim(F.lower(url), F.lit("/")).alias("url")), "url")


def url_set_compare_all(spark, d):
    """The urls of all pages without their fragment against those without query and fragment."""
    url = F.split_part("url", F.lit("#"), F.lit(1))
    p = table(spark, d, "pages")
    return ownership.set_compare(p.select(url.alias("url")), p.select(F.split_part(url, F.lit("?"), F.lit(1)).alias("url")), "url")


QUERIES = {f.__name__: f for f in (conn_owner, request_timings, page_earliest, http_only, network_activity, enrich_last_wins, timeline_synthesis, first_per_url, dns_claim, dns_pairing, unlinked, initiator_chain, url_set_compare, url_set_compare_all)}

_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"

SQL = {
    "conn_owner": f"WITH {REQUESTS} SELECT req, page, conn, row_number() OVER (PARTITION BY page, conn ORDER BY start, req) = 1 AS is_owner FROM r",
    "request_timings": _TIMINGS,
    "page_earliest": f"WITH {SPANS} SELECT u, min(st) FILTER (st > 0) AS earliest, max(en) AS latest, count(*) AS n FROM v GROUP BY u",
    "http_only": "SELECT page_id, url FROM pages WHERE lower(url) SIMILAR TO 'https?://.*' AND NOT regexp_matches(url, '^(http://127\\.0\\.0\\.1:8888|chrome://tracing|chrome-extension://)')",
    "network_activity": f"WITH {REQUESTS}, {CHUNKS}, t AS (SELECT req, CAST(sum(bytes) AS BIGINT) AS bytes_in FROM c WHERE seq > 1 GROUP BY req) SELECT req, coalesce(bytes_in, 0) AS bytes_in FROM r LEFT JOIN t USING (req) WHERE start > 0 AND (coalesce(bytes_in, 0) > 0 OR status = 404)",
    "enrich_last_wins": f"WITH h AS (SELECT page_id, {_HOST} AS host, length(html) AS n FROM pages) SELECT page_id, host, last_value(n) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS size FROM h",
    "timeline_synthesis": f"WITH {REQUESTS}, {CHUNKS} SELECT req, 'log' AS origin FROM r WHERE status = 200 UNION ALL SELECT DISTINCT req, 'timeline' FROM c WHERE req NOT IN (SELECT req FROM r WHERE status = 200)",
    "first_per_url": f"SELECT {_HOST} AS host, page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1",
    "dns_claim": _DNS_CLAIM,
    "dns_pairing": f"WITH {SPANS}, w AS (SELECT u, kind, i AS response, lag(kind) OVER q AS pk, lag(i) OVER q AS request FROM v WHERE kind IN ('signup', 'click') WINDOW q AS (PARTITION BY u ORDER BY st, i)) SELECT u, response, request FROM w WHERE kind = 'click' AND pk = 'signup'",
    "unlinked": "SELECT c_custkey AS conn, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "initiator_chain": _CHAIN,
    "url_set_compare": """
        WITH a AS (SELECT DISTINCT split_part(url, '#', 1) AS url FROM pages), b AS (SELECT DISTINCT rtrim(lower(split_part(url, '#', 1)), '/') AS url FROM pages),
        n AS (SELECT count(*) FILTER (b.url IS NULL) AS left_only, count(*) FILTER (a.url IS NULL) AS right_only, count(*) FILTER (a.url = b.url) AS in_both FROM a FULL JOIN b ON a.url = b.url)
        SELECT *, CAST(floor(in_both * 1000 / greatest(left_only + in_both, 1) + 0.5) AS BIGINT) AS overlap_pct FROM n""",
    "url_set_compare_all": """
        WITH a AS (SELECT DISTINCT split_part(url, '#', 1) AS url FROM pages), b AS (SELECT DISTINCT split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages),
        n AS (SELECT count(*) FILTER (b.url IS NULL) AS left_only, count(*) FILTER (a.url IS NULL) AS right_only, count(*) FILTER (a.url = b.url) AS in_both FROM a FULL JOIN b ON a.url = b.url)
        SELECT *, CAST(floor(in_both * 1000 / greatest(left_only + in_both, 1) + 0.5) AS BIGINT) AS overlap_pct FROM n""",
}
