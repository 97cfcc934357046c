"""Captures that are lines: browser network logs and TLS key logs. Lines are split over tasks, whatever a file's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.text import lookup_host, url_host
from netloom.operators import netlog
from netloom.operators.intervals import claim_lookups
from netloom.operators.ownership import written


def keylog(spark: SparkSession, path: str) -> DataFrame:
    """client_random, label, secret (lower-case hex); comments and lines of another form are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter("value not like '#%'").select(parts.alias("p")).filter("size(p) = 3")
    return lines.select(F.lower(F.col("p")[1]).alias("client_random"), F.col("p")[0].alias("label"), F.lower(F.col("p")[2]).alias("secret")).filter(F.col("client_random").rlike("^[0-9a-f]+$") & F.col("secret").rlike("^[0-9a-f]+$"))


def netlog_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(constants: capture, constants), (events: capture, time, type, phase, source_id, source_type, params).

    One event a line; lines that are cut short are skipped. An event's place in order is its time, then its text.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("capture"), F.regexp_replace(F.trim("value"), r",\s*$", "").alias("line"))
    head = lines.filter(F.col("line").startswith('{"constants":')).select("capture", F.try_parse_json(F.concat("line", F.when(F.col("line").endswith("}}"), "").otherwise("}"))).alias("v"))
    constants = head.select("capture", F.try_variant_get("v", "$.constants", "variant").alias("constants"))
    events = lines.filter(F.col("line").startswith("{") & ~F.col("line").startswith('{"constants":')).select("capture", "line", F.try_parse_json("line").alias("v")).filter("v is not null")
    get = lambda p, k: F.try_variant_get("v", p, k)
    return constants, events.select("capture", get("$.time", "string").try_cast("double").alias("time"), get("$.type", "int").alias("type"), get("$.phase", "int").alias("phase"), get("$.source.id", "bigint").alias("source_id"), get("$.source.type", "int").alias("source_type"), get("$.params", "variant").alias("params"), "line")


def named_events(constants: DataFrame, events: DataFrame) -> DataFrame:
    """events with the names of their types and sources; constants have one row for each capture."""
    names = lambda key: F.map_from_entries(F.transform(F.map_entries(F.try_variant_get("constants", f"$.{key}", "map<string,int>")), lambda e: F.struct(e["value"], e["key"])))
    maps = constants.select("capture", names("logEventTypes").alias("_types"), names("logSourceType").alias("_sources"), names("logEventPhase").alias("_phases"), F.coalesce(F.try_variant_get("constants", "$.timeTickOffset", "string").try_cast("double"), F.lit(0.0)).alias("tick_offset"))
    both = events.join(maps, "capture")
    return both.select("capture", "time", "tick_offset", F.col("_types")[F.col("type")].alias("event"), F.col("_sources")[F.col("source_type")].alias("source"), F.regexp_replace(F.col("_phases")[F.col("phase")], "^PHASE_", "").alias("phase"), "source_id", "params", "line")


def netlog_requests(events: DataFrame) -> DataFrame:
    """Requests of a network log: first and last writes of each url request's events, split where it is redirected."""
    from netloom.operators.sequences import segments

    own = events.filter("source = 'URL_REQUEST'").withColumn("key", F.concat_ws("\t", "capture", "source_id"))
    own = own.withColumn("_ended", F.lag(F.col("event") == "URL_REQUEST_REDIRECTED").over(_order("key")))
    own = segments(own, "key", ["time", "line"], F.coalesce("_ended", F.lit(False)), "hop")
    is_ = lambda *e: F.col("event").isin(*e)
    p = lambda path, kind: F.try_variant_get("params", path, kind)
    last = lambda c, when: F.max_by(c, F.when(when & c.isNotNull(), F.struct("time", "line")))
    sent = is_("HTTP_TRANSACTION_SEND_REQUEST", "HTTP_TRANSACTION_SEND_REQUEST_HEADERS", "HTTP_TRANSACTION_HTTP2_SEND_REQUEST_HEADERS", "HTTP_TRANSACTION_QUIC_SEND_REQUEST_HEADERS")
    got = is_("HTTP_TRANSACTION_READ_RESPONSE_HEADERS")
    any_ = F.lit(True)
    return own.groupBy("capture", "source_id", "hop").agg(
        last(F.split_part(p("$.url", "string"), F.lit("#"), F.lit(1)), any_).alias("url"),
        last(p("$.method", "string"), any_).alias("method"),
        last(p("$.priority", "string"), any_).alias("priority"),
        F.min(F.when(sent, F.col("time"))).alias("start"),
        F.min(F.when(got, F.col("time"))).alias("first_byte"),
        F.max("time").alias("end"),
        last(p("$.headers", "array<string>"), got).alias("headers"),
        F.min("time").alias("created"),
        last(p("$.stream_id", "bigint"), any_).alias("stream_id"),
        last(_path(p("$.headers", "array<string>")), sent).alias("path"),
        F.coalesce(F.sum(F.when(is_("URL_REQUEST_JOB_BYTES_READ"), p("$.byte_count", "bigint"))), F.lit(0)).alias("bytes_in"),
        F.coalesce(F.sum(F.when(is_("URL_REQUEST_JOB_FILTERED_BYTES_READ"), p("$.byte_count", "bigint"))), F.lit(0)).alias("inflated"),
    ).filter("url is not null")


def _order(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("time", "line")


def _path(headers: Column) -> Column:
    """The first line of headers that tells a path."""
    return F.get(F.filter(headers, lambda h: F.startswith(h, F.lit(":path:"))), F.lit(0))


def _param(path: str, kind: str) -> Column:
    return F.try_variant_get("params", path, kind)


_DEPENDS = "$.source_dependency.id"


def _last(c: Column, when: Column | None = None) -> Column:
    """The last value that is told, among the events for which ``when`` holds."""
    known = c.isNotNull() if when is None else when & c.isNotNull()
    return F.max_by(c, F.when(known, F.struct("time", "line")))


def _is(*names: str) -> Column:
    return F.col("event").isin(*names)


def _when(least: bool, *conditions: Column) -> Column:
    time = F.col("time")
    for c in conditions:
        time = F.when(c, time)
    return F.min(time) if least else F.max(time)


def netlog_sockets(events: DataFrame) -> DataFrame:
    """capture, socket, addresses, times of its connection and handshake, what was agreed, bytes. A connection is up at the latest when its handshake or its first bytes begin."""
    own = events.filter(F.col("source").isin("SOCKET", "UDP_SOCKET"))
    attempt, ssl = _is("TCP_CONNECT_ATTEMPT", "UDP_CONNECT"), _is("SSL_CONNECT")
    begins, ends = F.col("phase") == "BEGIN", F.col("phase") == "END"
    size = lambda *names: F.coalesce(F.sum(F.when(_is(*names), _param("$.byte_count", "bigint"))), F.lit(0))
    return own.groupBy("capture", F.col("source_id").alias("socket")).agg(
        _last(_param("$.address", "string"), ~_is("UDP_LOCAL_ADDRESS")).alias("address"),
        F.coalesce(_last(_param("$.source_address", "string")), _last(_param("$.address", "string"), _is("UDP_LOCAL_ADDRESS"))).alias("source_address"),
        _when(True, attempt, begins).alias("connect_start"),
        F.coalesce(_when(False, attempt, ends), F.least(_when(True, ssl), _when(True, _is("SOCKET_BYTES_SENT")))).alias("connect_end"),
        _when(True, ssl, begins).alias("ssl_start"),
        _when(False, ssl, ends).alias("ssl_end"),
        *[_last(_param(f"$.{n}", "string"), ssl).alias(f"tls_{n}") for n in ("version", "is_resumed", "next_proto", "cipher_suite")],
        size("SOCKET_BYTES_SENT", "UDP_BYTES_SENT").alias("bytes_out"),
        size("SOCKET_BYTES_RECEIVED", "UDP_BYTES_RECEIVED").alias("bytes_in"),
    )


def netlog_sessions(events: DataFrame) -> DataFrame:
    """capture, session, kind, socket, host of HTTP/2 and QUIC sessions."""
    own = events.filter(F.col("source").isin("HTTP2_SESSION", "QUIC_SESSION"))
    first = F.min_by(_param("$.host", "string"), F.when(_param("$.host", "string").isNotNull(), F.struct("time", "line")))
    return own.groupBy("capture", F.col("source_id").alias("session"), F.col("source").alias("kind")).agg(_last(_param(_DEPENDS, "bigint"), _is("HTTP2_SESSION_INITIALIZED")).alias("socket"), F.split_part(first, F.lit(":"), F.lit(1)).alias("host"))


def netlog_streams(events: DataFrame) -> DataFrame:
    """capture, session, stream_id, path, first_byte, end, bytes_in, weight of the streams of HTTP/2 and QUIC sessions."""
    own = events.filter(F.col("source").isin("HTTP2_SESSION", "QUIC_SESSION")).withColumn("stream_id", _param("$.stream_id", "bigint")).filter("stream_id is not null")
    data = _is("HTTP2_SESSION_RECV_DATA", "QUIC_SESSION_STREAM_FRAME_RECEIVED") & _param("$.size", "bigint").isNotNull()
    data = data | (_is("QUIC_SESSION_STREAM_FRAME_RECEIVED") & _param("$.length", "bigint").isNotNull())
    back = data | _is("HTTP2_SESSION_RECV_HEADERS", "QUIC_CHROMIUM_CLIENT_STREAM_READ_RESPONSE_HEADERS")
    sent = _is("HTTP2_SESSION_SEND_HEADERS", "QUIC_CHROMIUM_CLIENT_STREAM_SEND_REQUEST_HEADERS")
    return own.groupBy("capture", F.col("source_id").alias("session"), "stream_id").agg(
        _last(_path(_param("$.headers", "array<string>")), sent).alias("path"),
        _when(True, back).alias("first_byte"),
        _when(False, back).alias("end"),
        F.coalesce(F.sum(F.when(data, F.coalesce(_param("$.size", "bigint"), _param("$.length", "bigint")))), F.lit(0)).alias("bytes_in"),
        _last(_param("$.weight", "bigint")).alias("weight"),
    )


def netlog_jobs(events: DataFrame) -> DataFrame:
    """capture, job, group, socket_start, socket_end, socket, url_request, session of the jobs that find a stream for a request."""
    own = events.filter("source = 'HTTP_STREAM_JOB'")
    bound, asked = _is("SOCKET_POOL_BOUND_TO_SOCKET"), _is("HTTP_STREAM_JOB_BOUND_TO_REQUEST")
    pooled = _is("HTTP2_SESSION_POOL_IMPORTED_SESSION_FROM_SOCKET", "HTTP2_SESSION_POOL_FOUND_EXISTING_SESSION", "HTTP2_SESSION_POOL_FOUND_EXISTING_SESSION_FROM_IP_POOL")
    depends = _param(_DEPENDS, "bigint")
    return own.groupBy("capture", F.col("source_id").alias("job")).agg(
        _last(F.coalesce(_param("$.group_id", "string"), _param("$.group_name", "string"))).alias("group"),
        _when(False, _is("TCP_CLIENT_SOCKET_POOL_REQUESTED_SOCKET")).alias("socket_start"),
        F.coalesce(_when(False, bound), _when(True, asked | pooled)).alias("socket_end"),
        _last(depends, bound).alias("socket"),
        _last(depends, asked).alias("url_request"),
        _last(depends, pooled).alias("session"),
        F.min(F.struct("time", "line")).alias("ord"),
    )


def netlog_connect_jobs(events: DataFrame) -> DataFrame:
    """capture, connect_job, group, connect_start, connect_end, socket, lookup of the jobs that make a connection; lookup: the last one that was begun for it."""
    own = events.filter(F.col("source").isin("CONNECT_JOB", "SSL_CONNECT_JOB", "TRANSPORT_CONNECT_JOB"))
    made, depends = _is("TRANSPORT_CONNECT_JOB_CONNECT"), _param(_DEPENDS, "bigint")
    told = own.groupBy("capture", F.col("source_id").alias("connect_job")).agg(
        _last(F.coalesce(_param("$.group_id", "string"), _param("$.group_name", "string"))).alias("group"),
        _when(False, made, F.col("phase") == "BEGIN").alias("connect_start"),
        _when(False, made, F.col("phase") == "END").alias("connect_end"),
        _last(depends, _is("CONNECT_JOB_SET_SOCKET")).alias("socket"),
    )
    asked = events.filter(F.col("source").startswith("HOST_RESOLVER") & depends.isNotNull()).groupBy("capture", depends.alias("connect_job")).agg(_last(F.col("source_id")).alias("lookup"))
    return told.join(asked, ["capture", "connect_job"], "left")


def netlog_lookups(events: DataFrame) -> DataFrame:
    """capture, lookup, host, start, end: lookups that ended, from their first beginning to their last end."""
    own = events.filter(F.col("source").startswith("HOST_RESOLVER"))
    task, begins, ends = _is("HOST_RESOLVER_IMPL_REQUEST", "HOST_RESOLVER_DNS_TASK"), F.col("phase") == "BEGIN", F.col("phase") == "END"
    tried = lambda x: _is(f"HOST_RESOLVER_IMPL_ATTEMPT_{x}", f"HOST_RESOLVER_MANAGER_ATTEMPT_{x}")
    told = own.groupBy("capture", F.col("source_id").alias("lookup")).agg(
        F.min_by(_param("$.host", "string"), F.when(_param("$.host", "string").isNotNull(), F.struct("time", "line"))).alias("host"),
        F.coalesce(_when(True, task, begins), _when(True, tried("STARTED"))).alias("start"),
        F.greatest(_when(False, task, ends), _when(False, tried("FINISHED")), _when(False, _is("HOST_RESOLVER_IMPL_CACHE_HIT"))).alias("end"),
    )
    return told.withColumn("host", lookup_host(F.col("host"))).filter("host is not null and end >= start")


def netlog_addresses(events: DataFrame) -> DataFrame:
    """capture, host, addresses, aliases: what lookups found, in the order in which it was found first."""
    own = events.filter(_is("HOST_RESOLVER_DNS_TASK_EXTRACTION_RESULTS"))
    result = own.select("capture", "time", "line", F.posexplode(_param("$.results", "array<variant>")).alias("at", "r"))
    get = lambda path, kind: F.try_variant_get("r", path, kind)
    told = result.withColumn("endpoints", F.transform(get("$.endpoints", "array<variant>"), lambda e: F.try_variant_get(e, "$.address", "string"))).withColumn("alias", get("$.alias_target", "string"))
    named = told.join(told.groupBy("capture", "time", "line").agg(F.first(F.try_variant_get("r", "$.domain_name", "string"), ignorenulls=True).alias("host")), ["capture", "time", "line"])
    named = named.withColumn("key", F.struct("capture", "host"))
    found = named.select("key", "time", "line", "at", F.posexplode("endpoints").alias("place", "address")).filter("address is not null")
    seen = netlog.in_order_of_appearance(found, "key", "address", ["time", "line", "at", "place"], "addresses")
    other = netlog.in_order_of_appearance(named.filter("alias is not null"), "key", "alias", ["time", "line", "at"], "aliases")
    return seen.join(other, "key", "full").select("key.*", "addresses", "aliases")


def netlog_cached_urls(events: DataFrame) -> DataFrame:
    """capture, url of the entries of the disk cache that were asked for."""
    url = F.regexp_extract(_param("$.key", "string"), r"(https?://\S+)$", 1)
    return events.filter("source = 'DISK_CACHE_ENTRY'").select("capture", url.alias("url")).filter("url <> ''").distinct()


def netlog_stitched(events: DataFrame) -> DataFrame:
    """netlog_joined() with times that count from the earliest one of the capture; equal starts are kept apart."""
    r = netlog_joined(events)
    return netlog.rebased(r.withColumn("req", F.coalesce("source_id", F.lit(0))), "capture").drop("req")


def netlog_joined(events: DataFrame) -> DataFrame:
    """Requests of network logs with their socket and session, what their stream tells, the connection and lookup they pay for, and the addresses of their host.

    Times are the log's own. The events are written once, as each kind of object reads them. A request is added for each cached url of a host that a job tried to reach in vain.
    """
    inside = lambda c, name=None: F.when(F.col(c).isNotNull(), F.struct("capture", F.col(c).alias("id"))).alias(name or c)
    order = [F.coalesce("start", "created"), "source_id", "hop"]
    events = written(events)
    jobs = netlog_jobs(events)
    bound = jobs.filter("url_request is not null").groupBy("capture", F.col("url_request").alias("source_id")).agg(F.max_by(F.struct("socket", "session", "group"), "ord").alias("j"))
    r = netlog_requests(events).withColumn("host", url_host(F.col("url"))).join(bound, ["capture", "source_id"], "left")
    r = r.withColumns({"socket": F.col("j.socket"), "session": F.col("j.session"), "group": F.col("j.group")}).drop("j")
    pooled = netlog_sessions(events).select("capture", "session", F.col("socket").alias("_own"))  # a job that was given a session has its socket
    tried = jobs.join(pooled, ["capture", "session"], "left").withColumn("socket", F.coalesce("socket", "_own")).drop("_own")
    tried = tried.withColumn("host", F.regexp_extract("group", r"^.*/([^:]+):\d+$", 1)).filter("host <> ''")
    urls = netlog_cached_urls(events).withColumn("host", url_host(F.col("url")))
    in_vain = netlog.unreached(tried, r, urls)

    r = r.withColumns({"host": inside("host"), "session": inside("session"), "socket": inside("socket")})
    sessions = netlog_sessions(events).select(inside("session"), inside("socket", "own"), inside("host"))
    streams = netlog_streams(events).withColumn("session", inside("session"))
    asked = streams.filter("path is not null").join(sessions.filter("host is not null"), "session").select("session", "host", "stream_id", "path")
    r = netlog.with_streams(netlog.infer_sessions(r, asked), streams)
    r = r.join(sessions.select("session", "own"), "session", "left").withColumn("socket", F.coalesce("own", "socket")).drop("own")
    sockets = netlog_sockets(events).withColumn("socket", inside("socket"))
    r = netlog.claim_sockets(r, sockets, order, ["connect_start", "connect_end", "ssl_start", "ssl_end", "tls_version", "tls_next_proto"], ["address", "source_address"])

    found = netlog.claims(r.withColumn("req", F.struct("source_id", "hop")), "host", order)
    looked = netlog_lookups(events).select(inside("host"), F.col("lookup").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    best = claim_lookups(found, looked, "host").select(F.col("host.capture").alias("capture"), "claim.source_id", "claim.hop", F.col("l_start").alias("dns_start"), F.col("l_end").alias("dns_end"))
    r = r.join(best, ["capture", "source_id", "hop"], "left").join(netlog_addresses(events).select(inside("host"), "addresses", "aliases"), "host", "left")
    lost = in_vain.withColumns({"created": F.col("start"), "connect_start": F.col("start"), "connect_end": F.col("end"), "host": F.struct("capture", url_host(F.col("url")).alias("id"))})
    r = r.unionByName(lost, allowMissingColumns=True)
    return r.withColumns({c: F.col(f"{c}.id") for c in ("host", "session", "socket")})


