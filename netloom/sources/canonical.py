"""One relation for captures of all formats: pages, and requests with times, phases, headers and connections; and HAR made of it.

Each reader's tables are brought to the columns of REQUEST and PAGE, so that every export reads the same ones. Times are
milliseconds, of the clock of the capture where it tells no other; a phase that was not measured is -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.text import split_header, url_host
from netloom.operators import outputs
from netloom.sources import lines
from netloom.sources.load import load, told_format

HEADERS = "array<struct<name: string, value: string>>"
#: Columns of requests, and of pages.
REQUEST = {
    "capture": "string", "page": "string", "page_ref": "string", "req": "bigint", "method": "string", "url": "string", "status": "int", "http_version": "string", "headers": HEADERS, "response_headers": HEADERS, "mime": "string",
    "bytes_in": "bigint", "conn": "string", "server_ip": "string", "start": "double", "first_data": "double", "end": "double", "dns_start": "double", "dns_end": "double", "connect_start": "double", "connect_end": "double", "ssl_start": "double",
    "dns": "double", "connect": "double", "ssl": "double", "wait": "double", "receive": "double",
}
PAGE = {"capture": "string", "page": "string", "page_ref": "string", "title": "string", "started_ms": "double", "on_content_load": "double", "on_load": "double", "ext": "map<string,variant>"}


def _typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with these columns alone, null where it lacks them."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in columns.items()])


def _page(ref: Column) -> dict[str, Column]:
    return {"page_ref": ref, "page": F.concat_ws("\t", "capture", ref)}


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with req, which tells its requests apart."""
    return df.withColumn("req", F.xxhash64("capture", *order))


def _spans(df: DataFrame) -> DataFrame:
    """df with its phases, by its times: a span that is not told or negative was not measured; nothing waits less than not at all."""
    for n in ("dns_start", "dns_end", "connect_start", "connect_end", "ssl_start", "first_data", "end"):
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("double"))
    span = lambda a, b: F.when(b >= a, b - a).otherwise(F.lit(-1.0))
    c = {n: F.col(n) for n in df.columns}
    up = F.coalesce(c["ssl_end"], c["connect_end"]) if "ssl_end" in c else c["connect_end"]
    first = F.coalesce(c["first_data"], c["end"], c["start"])
    done = F.coalesce(F.greatest(c["end"], first), first)
    phases = {"dns": span(c["dns_start"], c["dns_end"]), "connect": span(c["connect_start"], F.greatest(c["connect_end"], up)), "ssl": span(c["ssl_start"], up), "wait": F.greatest(F.lit(0.0), first - c["start"]), "receive": F.greatest(F.lit(0.0), done - first)}
    return df.withColumns({**phases, "first_data": first, "end": done})


def _lines(headers: Column) -> Column:
    return F.filter(F.transform(headers, split_header), lambda h: h.isNotNull())


def _single(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests of captures without pages, on one page for each capture, which begins with its first request."""
    r = requests.withColumns(_page(F.lit("1")))
    pages = r.groupBy("capture", "page", "page_ref").agg(F.min("start").alias("started_ms"), F.min_by("url", "start").alias("title"))
    return _typed(pages, PAGE), _typed(r, REQUEST)


def _har(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    phase = {n: F.col(f"{n}_ms") for n in ("dns", "connect", "ssl", "wait", "receive")}
    r = t["requests"].withColumnsRenamed({"page": "ref", "connection_id": "conn"})
    r = r.withColumns(_page(F.col("ref"))).withColumns(phase)
    pages = t["pages"].withColumns(_page(F.col("page_id")))
    return _typed(pages, PAGE), _typed(r, REQUEST)


def _views(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    r = t["requests"].withColumnRenamed("page", "ref").withColumns(_page(F.col("ref"))).withColumnRenamed("started_ms", "start")
    pos = lambda n: F.greatest(F.lit(0.0), F.coalesce(F.col(n), F.lit(0.0)))
    first = F.col("start") + pos("blocked") + pos("dns_ms") + pos("connect") + pos("ttfb_ms")
    r = r.withColumns({"dns": F.col("dns_ms"), "ssl": F.col("ssl_ms"), "wait": pos("ttfb_ms"), "receive": pos("download_ms"), "first_data": first, "end": first + pos("download_ms")})
    r = r.withColumnRenamed("request_headers", "headers")
    pages = t["pages"].withColumns(_page(F.col("page_id")))
    return _typed(pages, PAGE), _typed(r, REQUEST)


def _protocol(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    r = t["requests"].withColumnsRenamed({"http_method": "method", "first_byte": "first_data"}).withColumn("conn", F.col("socket"))
    return _single(_spans(_numbered(r, "request_id", "hop")))


def _trace(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    r = t["requests"].withColumnRenamed("first_byte", "first_data")
    times = ("start", "first_data", "end", "dns_start", "dns_end", "connect_start", "connect_end", "ssl_start", "ssl_end")
    r = r.withColumns({c: F.col(c) + F.col("base") for c in times}).withColumns({"conn": F.col("socket").cast("string"), "response_headers": _lines(F.col("headers")), "server_ip": _address(F.col("address")), "http_version": F.col("protocol")})
    return _single(_spans(_numbered(r.drop("headers"), "request_id", "source_id", "hop", "url")))


def _address(c: Column) -> Column:
    """An address without its port, or brackets."""
    return F.regexp_replace(F.regexp_replace(c, r":\d+$", ""), r"[\[\]]", "")


def _netlog(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    offset = t["events"].groupBy("capture").agg(F.max("tick_offset").alias("offset"))
    r = lines.netlog_joined(t["events"]).join(offset, "capture").withColumnsRenamed({"first_byte": "first_data"})
    times = ("start", "created", "first_data", "end", "dns_start", "dns_end", "connect_start", "connect_end", "ssl_start", "ssl_end")
    r = r.withColumns({c: F.col(c) + F.col("offset") for c in times}).withColumn("start", F.coalesce("start", "created"))
    status = F.regexp_extract(F.get("headers", F.lit(0)), r"^\S+ (\d{3})", 1).try_cast("int")
    r = r.withColumns({"conn": F.col("socket").cast("string"), "response_headers": _lines(F.col("headers")), "server_ip": _address(F.col("address")), "http_version": F.col("tls_next_proto"), "status": F.coalesce("status", status)})
    return _single(_spans(_numbered(r.drop("headers"), "source_id", "hop", "url")))


def _packets(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    ms = {c: F.col(c) / 1000.0 for c in ("start", "end", "dns_start", "dns_end")} | {"first_data": F.col("first_byte") / 1000.0}
    r = t["requests"].withColumns(ms).withColumns({"conn": F.concat_ws(" ", "flow", F.col("generation").cast("string")), "http_version": F.lit("HTTP/1.1")})
    r = _numbered(r, "flow", "generation").withColumn("req", F.shiftleft(F.shiftright("req", 20), 20) + F.col("n") % (1 << 20))  # those of one time keep their order
    return _single(_spans(r))


RELATIONS = {"har": _har, "wpt": _views, "wptagent": _views, "cdp": _protocol, "chrome-trace": _trace, "netlog": _netlog, "tcpdump": _packets}


def relation(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages and requests of the captures at path, which have one format, with the columns of PAGE and REQUEST.

    Raises ValueError for a format without requests.
    """
    kind = kind or told_format(spark, path)
    if kind not in RELATIONS:
        raise ValueError(f"captures of the format {kind} have no requests")
    return RELATIONS[kind](load(spark, path, kind))


def to_har(pages: DataFrame, requests: DataFrame, block: int = 1000) -> DataFrame:
    """page, part, har: the extended HAR of each page as JSON, its entries in parts of ``block``. Only web requests are entries."""
    known = requests.filter(F.col("url").rlike("(?i)^https?://") & F.col("start").isNotNull() & (url_host(F.col("url")) != ""))
    known = known.withColumns({n: F.coalesce(n, F.lit(-1.0)) for n in ("dns", "connect", "ssl")} | {n: F.coalesce(n, F.lit(0.0)) for n in ("wait", "receive")})
    nothing = F.array().cast(HEADERS)
    defaults = {"method": F.lit("GET"), "status": F.lit(0), "http_version": F.lit(""), "mime": F.lit(""), "bytes_in": F.lit(0).cast("bigint"), "headers": nothing, "response_headers": nothing}
    known = known.withColumns({n: F.coalesce(F.col(n), c) for n, c in defaults.items()})
    shown = pages.withColumn("ext", F.transform_values(F.coalesce("ext", F.create_map().cast("map<string,variant>")), lambda _, v: F.to_json(v)))
    return outputs.full_har(outputs.with_offsets(known), shown, block)
