"""Exports: the flat request table and the extended HAR log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import is_web, url_host
from netloom.operators.layout import numbered
from netloom.operators.ownership import paid_requests

#: Times of a request's phases that only the request that pays for them has.
PAID = {"dns_start": "d_start", "dns_end": "d_end", "connect_start": "c_start", "connect_end": "c_end", "ssl_start": "tls_start"}


def entries(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requests with what their chunks add up to: page, req, start, url, method, status, bytes_in, object_size, load_ms, chunks."""
    c = chunks.groupBy("req").agg(
        F.sum("bytes").cast("long").alias("bytes_in"),
        F.sum("inflated").cast("long").alias("object_size"),
        F.expr("max(ts) div 1000").alias("last"),
        F.sort_array(F.collect_list(F.struct("seq", "ts", "bytes", "inflated"))).alias("chunks"),
    )
    url = F.concat(F.lit("https://host"), F.col("conn").cast("string"), F.lit(".example/r/"), F.col("req").cast("string"))
    both = requests.join(c, "req", "left").withColumn("url", url)
    return both.select("page", "req", "start", "url", F.lit("GET").alias("method"), "status", F.coalesce("bytes_in", F.lit(0)).alias("bytes_in"), F.coalesce("object_size", F.lit(0)).alias("object_size"), F.coalesce(F.col("last") - F.col("start"), F.lit(-1)).alias("load_ms"), "chunks")


def flat_requests(rows: DataFrame) -> DataFrame:
    """One flat row for each request, numbered within its page."""
    index = F.row_number().over(Window.partitionBy("page").orderBy("start", "req")).cast("long")
    return rows.select("page", index.alias("index"), "url", url_host(F.col("url")).alias("host"), "method", F.col("status").cast("int").alias("status"), "bytes_in", "object_size", "load_ms")


def page_requests(requests: DataFrame, connections: DataFrame, lookups: DataFrame) -> DataFrame:
    """The web requests of pages with their phases and the times of what they pay for; other schemes are left out.

    requests: page, req, conn, dns_id, start, first_data, end, url and more; connections and lookups as request_timings() has them.
    """
    both = paid_requests(requests.filter(is_web(F.col("url"))), connections, lookups)
    paid = {n: F.when(F.col("pays_dns" if c.startswith("d_") else "pays_connect"), F.col(c)) for n, c in PAID.items()}
    return both.withColumns(paid).drop(*PAID.values(), "pays_connect", "pays_dns")


def strip(df: DataFrame, *columns: str) -> DataFrame:
    """df without columns that were not asked for, such as bodies: they are then not read either."""
    return df.drop(*columns)


def request(requests: DataFrame, page, req, body: bool = False) -> DataFrame:
    """One request of a page, without its body unless it is asked for."""
    found = requests.filter((F.col("page") == page) & (F.col("req") == req))
    return found if body else strip(found, "body")


def with_offsets(requests: DataFrame) -> DataFrame:
    """requests with earliest (of their page: the first start, lookup or connection) and, where not told yet, offsets from it in whole ms.

    requests: start, first_data, end, dns_start, dns_end, connect_start, connect_end, ssl_start (ms) and ssl (its phase).
    """
    told = lambda c: F.when(F.col(c) > 0, F.col(c))
    first = requests.groupBy("page").agg(F.min(F.least(told("start"), told("dns_start"), told("connect_start"))).alias("earliest"))
    both = requests.join(first, "page")
    off = lambda c: F.floor(told(c) - F.col("earliest"))
    load = off("start")
    made = {
        "_load_start": load,
        **{f"_{n}": off(n) for n in ("dns_start", "dns_end", "connect_start", "connect_end", "ssl_start")},
        "_ssl_end": F.when(F.col("ssl") > 0, load),
        "_ttfb_start": load,
        "_ttfb_end": off("first_data"),
        "_download_start": off("first_data"),
        "_download_end": off("end"),
        "_all_end": off("end"),
    }
    return both.withColumns({n: F.coalesce(F.col(n), c) if n in requests.columns else c for n, c in made.items()})


#: Columns of a flat request: where they come from, first to last, and what they are without any.
FLAT = {
    "url": (("url", "_url"), ""),
    "full_url": (("_full_url", "url", "_url"), ""),
    "host": (("_host",), ""),
    "method": (("method", "_method"), "GET"),
    "status": (("status", "_responseCode"), 0),
    "protocol": (("_protocol",), ""),
    "ip": (("server_ip", "_ip_addr"), ""),
    "startedDateTime": (("startedDateTime",), None),
    "time": (("time",), None),
    "type": (("_type", "_request_type"), ""),
    "contentType": (("_contentType", "mime"), ""),
    "bytesIn": (("_bytesIn", "body_size"), 0),
    "bytesOut": (("_bytesOut", "headers_size"), 0),
    "objectSize": (("_objectSize", "content_size"), 0),
    **{n: ((f"_{n}",), -1) for n in ("ttfb_ms", "load_ms", "download_ms", "dns_ms", "connect_ms", "ssl_ms")},
    "error": (("_error",), None),
}


def simple_requests(entries_: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, index and FLAT: one flat row for each entry in its order; texts that are empty and sizes below 0 count as not told."""
    kinds = dict(entries_.dtypes)

    def known(c: str):
        if kinds[c] == "string":
            return F.nullif(F.col(c), F.lit(""))
        return F.when(F.col(c) > 0, F.col(c)) if c.endswith("_size") else F.col(c)

    index = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long") - 1
    flat = [F.coalesce(*[known(c) for c in names if c in kinds], F.lit(default)).alias(n) for n, (names, default) in FLAT.items()]
    return entries_.select(by, index.alias("index"), *flat)


def iso_time(ms):
    return F.date_format(F.timestamp_millis(F.floor(ms).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _log(**members) -> "F.Column":
    head = {"version": F.lit("1.2"), "creator": F.struct(F.lit("netloom").alias("name"), F.lit("1").alias("version"))}
    return F.to_json(F.struct(F.struct(*[c.alias(n) for n, c in {**head, **members}.items()]).alias("log")))


def full_har(requests: DataFrame, pages: DataFrame, block: int = 1000) -> DataFrame:
    """page, part, har: the extended HAR of each page as JSON; its entries, in the order in which they were sent, in parts of ``block``.

    requests: as with_offsets() makes them, with method, url, status, http_version, headers, response_headers, mime, bytes_in, conn and the
    phases dns, connect, ssl, wait, receive; pages: page, title, ext (a map). Names of ``ext`` that begin with an underscore become fields of the page.
    Where they are there: page_ref, what pages are called (else by their number), server_ip and body of requests, started_ms, on_content_load and on_load of pages.
    """
    has = lambda df, n: n in df.columns
    ref = (lambda df: F.col("page_ref")) if has(requests, "page_ref") else (lambda df: F.concat(F.lit("page_"), F.col("page").cast("string")))
    address = [F.coalesce("server_ip", F.lit("")).alias("serverIPAddress")] if has(requests, "server_ip") else []
    text = [F.col("body").alias("text")] if has(requests, "body") else []
    pos = lambda c: F.greatest(F.lit(0), F.col(c))
    rows = requests.withColumn("_sent", F.col("earliest") + F.greatest(F.col("_load_start"), F.coalesce("_connect_end", F.lit(0))))
    rows = numbered(rows, "page", "_sent", "req", "_n").withColumn("part", F.expr(f"_n div {block}"))
    offsets = [c for c in requests.columns if c.startswith("_")]
    nothing = F.array().cast("array<string>")
    entry = F.struct(
        F.col("_n"),
        iso_time(F.col("start")).alias("startedDateTime"),
        (pos("dns") + pos("connect") + F.col("wait") + F.col("receive")).alias("time"),
        ref(rows).alias("pageref"),
        F.struct("method", "url", F.col("http_version").alias("httpVersion"), nothing.alias("cookies"), "headers", nothing.alias("queryString"), F.lit(-1).alias("headersSize"), F.lit(-1).alias("bodySize")).alias("request"),
        F.struct("status", F.lit("").alias("statusText"), F.col("http_version").alias("httpVersion"), nothing.alias("cookies"), F.col("response_headers").alias("headers"), F.struct(F.col("bytes_in").alias("size"), F.col("mime").alias("mimeType"), F.lit(0).alias("compression"), *text).alias("content"), F.lit("").alias("redirectURL"), F.lit(-1).alias("headersSize"), F.col("bytes_in").alias("bodySize")).alias("response"),
        F.struct("dns", "connect", "ssl", F.lit(0).alias("send"), "wait", "receive").alias("timings"),
        F.col("conn").cast("string").alias("connection"),
        *address,
        *offsets,
    )
    parts = rows.groupBy("page", "part").agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.min("earliest").alias("earliest"))
    told = parts.join(pages, "page", "left")
    timings = [F.struct(*[F.coalesce(c, F.lit(-1.0)).alias(n) for n, c in (("onContentLoad", "on_content_load"), ("onLoad", "on_load"))]).alias("pageTimings")] if has(pages, "on_load") else []
    began = F.coalesce("started_ms", "earliest") if has(pages, "started_ms") else F.col("earliest")
    page = F.struct(ref(told).alias("id"), "title", iso_time(began).alias("startedDateTime"), *timings, F.map_filter("ext", lambda k, _: F.startswith(k, F.lit("_"))).alias("ext"))
    return told.select("page", "part", _log(pages=F.array(page), entries=F.col("entries")).alias("har"))


def har_log(rows: DataFrame, block: int = 1000) -> DataFrame:
    """page, part, har: the HAR log of each page as JSON, in parts of up to ``block`` entries in order of start.

    Entries are numbered by page and start alone, in blocks, so that no task holds all entries of a page.
    """
    entry = F.struct(
        F.col("_n").alias("_n"),
        F.concat(F.lit("page_"), F.col("page").cast("string")).alias("pageref"),
        iso_time(F.col("start")).alias("startedDateTime"),
        F.greatest(F.lit(0), F.col("load_ms")).alias("time"),
        F.struct("method", "url", F.lit("HTTP/1.1").alias("httpVersion")).alias("request"),
        F.struct("status", F.struct(F.col("object_size").alias("size")).alias("content")).alias("response"),
        F.col("bytes_in").alias("_bytesIn"),
        F.col("chunks").alias("_chunks"),
    )
    told = numbered(rows, "page", "start", "req", "_n").withColumn("part", F.expr(f"_n div {block}"))
    grouped = told.groupBy("page", "part").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return grouped.select("page", "part", _log(entries=F.col("entries")).alias("har"))
