"""Captures that are JSON documents: HAR, result files of page tests, protocol logs and traces.

Each reader takes many captures at once and returns tables keyed by ``capture``, the file's path. Open extension fields
are VARIANT, which keeps names that differ only in case apart.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions.text import bare_mime, header, is_noise, leading_int, priority_name, split_header, status_of, url_host, view_id, view_title
from netloom.operators import netlog, protocol
from netloom.operators.ownership import written
from netloom.operators.pages import as_extensions, utilization, without
from netloom.operators.traces import anchors_page, base_time, enriched, last_known, one_clock, pointer_epochs, reached_network, timeline_only, toplevel_tasks
from netloom.sources import json_ranges, lines, ranges

#: Page timings that are lifted to the page under another name.
RENAMED = {"_firstPaint": "_render", "_largestContentfulPaint": "_LargestContentfulPaint", "_domInteractiveTime": "_domInteractive", "_userTimings": "_user_timing"}

#: Phases of a resource's timing, offsets in ms from its requestTime, and what they are called here.
TIMING = {"dnsStart": "dns_start", "dnsEnd": "dns_end", "connectStart": "connect_start", "connectEnd": "connect_end", "sslStart": "ssl_start", "sslEnd": "ssl_end"}

#: Characters of a document or of a slice of one: far enough below the 128 MiB that a VARIANT holds, which may be several times its text.
PIECE = 16 << 20
_VIEWS = {"firstView": {"requests": True}, "repeatView": {"requests": True}}
#: Where the arrays stand that the readers take apart, besides an array that is the whole document.
ARRAYS = {"log": {"pages": True, "entries": True}, "data": {"runs": {"*": _VIEWS}, "median": _VIEWS}, "traceEvents": True}


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")  # as VARIANT has it
    return out


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def pieces(text: str, size: int) -> list[tuple[int, str]]:
    """(first, JSON) of a document: its ARRAYS in slices of about ``size`` characters, each within the members that lead to it.

    first is the place of a slice's first element. Raises ValueError or IndexError where text is not JSON.
    """
    decode = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_refuse).raw_decode
    blank, found, runs = re.compile(r"[ \t\n\r]*").match, [], False

    def skip(at: int) -> int:
        return blank(text, at).end()

    def after(at: int, close: str) -> tuple[int, bool]:
        """Where the next element begins, or what follows the last one."""
        at = skip(at)
        if text[at] not in (",", close):
            raise ValueError(f"no comma at {at}")
        return (at + 1, True) if text[at] == close else (skip(at + 1), False)

    def elements(at: int, path: tuple[str, ...]) -> int:
        at, first, n = skip(at + 1), 0, 0
        if text[at] == "]":
            return at + 1
        start, last, over = at, at, False
        while not over:
            end = decode(text, at)[1]
            if end - start > size and n > first:
                found.append((path, first, start, last))
                first, start = n, at
            n, last = n + 1, end
            at, over = after(end, "]")
        found.append((path, first, start, last))
        return at

    def members(at: int, tree: dict, path: tuple[str, ...]) -> int:
        nonlocal runs
        at, keys, over = skip(at + 1), set(), False
        if text[at] == "}":
            return at + 1
        while not over:
            key, end = decode(text, at)
            at = skip(end)
            if not isinstance(key, str) or key in keys or text[at] != ":":
                raise ValueError(f"no member at {at}")
            keys.add(key)
            at, over = after(value(skip(at + 1), tree.get(key, tree.get("*")), (*path, key)), "}")
        runs = runs or path == ("data", "runs")
        return at

    def value(at: int, tree: dict | bool | None, path: tuple[str, ...]) -> int:
        if text[at] == "[" and (tree is True or not path):
            return elements(at, path)
        return members(at, tree, path) if text[at] == "{" and isinstance(tree, dict) else decode(text, at)[1]

    value(skip(0), ARRAYS, ())
    told = [x for x in found if not (runs and x[0][:2] == ("data", "median"))]  # the median counts where there are no runs
    return [(first, "".join(f"{{{json.dumps(k)}:" for k in path) + f"[{text[a:b]}]" + "}" * len(path)) for path, first, a, b in told]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """capture, first, doc: one JSON document for each file, gzipped or not; what is not JSON is left out.

    A VARIANT holds at most 128 MiB, so a document of more than ``PIECE`` characters is several rows: slices of the arrays
    that the readers take apart (``ARRAYS``), and first is the place of a slice's first element. A single element that
    is too large raises an error. A file of up to ``ranges.SMALL`` bytes is read by one task; a larger one is cut into byte
    ranges, unless it is gzipped or has none of the arrays at ``json_ranges.PATHS``: then one task reads it, below 2 GB.
    """
    size = PIECE

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = b"".join(ranges.inflated(iter([batch.column(1)[i].as_py()]))).decode("utf-8", "replace").removeprefix("\ufeff")
                try:
                    told = [(0, text)] if len(text) <= size else pieces(text, size)
                except (ValueError, IndexError):
                    continue
                for first, piece in told:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([first], pa.int64()), pa.array([piece])], names=["capture", "first", "text"])

    whole = lambda content: content.select("path", "content").mapInArrow(split, "capture string, first long, text string")
    rows = whole(spark.read.format("binaryFile").load(path).filter(F.col("length") <= ranges.SMALL))
    large = ranges.files(spark, path).filter(F.col("length") > ranges.SMALL)
    if large.take(1):
        kinds = written(ranges.zipped(large))
        parts, known = json_ranges.slices(kinds.filter("not gzipped"), ranges.RANGE, size)
        rest = [r["path"] for r in kinds.join(known.withColumnRenamed("capture", "path"), "path", "left_anti").collect()]
        rows = rows.unionByName(parts)
        if rest:
            rows = rows.unionByName(whole(spark.read.format("binaryFile").load(rest)))
    doc = F.try_parse_json("text")
    large = F.raise_error(F.concat(F.col("capture"), F.lit(": an element is too large for a VARIANT"))).cast("string")
    return rows.select("capture", F.col("first").cast("int").alias("first"), F.when((F.length("text") > 2 * size) & doc.isNull(), F.parse_json(large)).otherwise(doc).alias("doc")).filter("doc is not null")


def _explode(df: DataFrame, source: str) -> DataFrame:
    """df with ``pos`` and ``item``, the elements of a VARIANT array; pos counts from the document's first element."""
    elements = df.sparkSession.tvf.variant_explode_outer(F.col("s._source").outer()).select(F.col("pos").alias("_pos"), F.col("value").alias("item"))
    found = df.withColumn("_source", F.expr(source.replace("s.", ""))).alias("s").lateralJoin(elements)
    return found.withColumn("pos", F.col("_pos") + F.col("first")).drop("_source", "_pos").filter("pos is not null")


def _get(path: str, kind: str, source: str = "item"):
    return F.try_variant_get(source, path, kind)


def lift_page_timings(page, timings):
    """Extension fields of a page: its own, and those of its timings under their new names; the page's own win."""
    own = F.map_filter(page.cast("map<string,variant>"), lambda k, v: F.startswith(k, F.lit("_")) & v.isNotNull())
    inner = F.map_filter(timings.cast("map<string,variant>"), lambda k, v: F.startswith(k, F.lit("_")) & v.isNotNull())
    renamed = F.transform_keys(inner, lambda k, _: F.coalesce(_renamed(k), k))
    absent = F.map_filter(renamed, lambda k, _: ~F.map_contains_key(own, k))
    return F.when(timings.isNull(), own).otherwise(F.map_concat(absent, own))


def _renamed(k):
    out = None
    for a, b in RENAMED.items():
        out = F.when(k == a, b) if out is None else out.when(k == a, b)
    return out


def har_pages(docs: DataFrame) -> DataFrame:
    """capture, page_ord, page_id, title, started_ms, on_content_load, on_load, ext."""
    pages = _explode(docs, "try_variant_get(s.doc, '$.log.pages', 'variant')")
    return pages.select(
        "capture",
        F.col("pos").alias("page_ord"),
        _get("$.id", "string").alias("page_id"),
        _get("$.title", "string").alias("title"),
        F.unix_millis(F.try_to_timestamp(_get("$.startedDateTime", "string"))).alias("started_ms"),
        _get("$.pageTimings.onContentLoad", "double").alias("on_content_load"),
        _get("$.pageTimings.onLoad", "double").alias("on_load"),
        lift_page_timings(F.col("item"), _get("$.pageTimings", "variant")).alias("ext"),
    )


def har_requests(docs: DataFrame) -> DataFrame:
    """One row for each entry, in order, with its phases (-1: not measured), times and connection.

    An entry without timings has zeros; the first data come after all phases before the wait is over.
    """
    e = _explode(docs, "try_variant_get(s.doc, '$.log.entries', 'variant')")
    phase = {p: F.coalesce(_get(f"$.timings.{p}", "double"), F.lit(-1.0)) for p in ("blocked", "dns", "connect", "ssl", "send", "wait", "receive")}
    start = F.unix_millis(F.try_to_timestamp(_get("$.startedDateTime", "string"))).cast("double")
    pos = lambda p: F.greatest(F.lit(0.0), phase[p])
    first = F.coalesce(_get("$._firstDataTimeMs", "double"), start + pos("blocked") + pos("dns") + pos("connect") + pos("send") + pos("wait"))
    keys = ("connection", "_socket", "_connectionId", "_connectionIdentifier")
    conn = F.coalesce(*[F.nullif(F.coalesce(_get(f"$.{k}", "string"), F.lit("-1")), F.lit("-1")) for k in keys], F.when(phase["connect"] > 0, F.concat(F.lit("conn_"), F.col("pos").cast("string"))))
    return e.select(
        "capture",
        F.col("pos").alias("req"),
        F.coalesce(_get("$.pageref", "string"), F.lit("page_0")).alias("page"),
        F.coalesce(_get("$.request.method", "string"), F.lit("GET")).alias("method"),
        _get("$.request.url", "string").alias("url"),
        _get("$.response.status", "int").alias("status"),
        F.coalesce(_get("$._contentType", "string"), _get("$.response.content.mimeType", "string")).alias("mime"),
        F.coalesce(_get("$._bytesIn", "bigint"), _get("$.response.content.size", "bigint"), F.lit(0)).alias("bytes_in"),
        conn.alias("connection_id"),
        F.coalesce(_get("$.request.httpVersion", "string"), _get("$.response.httpVersion", "string")).alias("http_version"),
        *[_get(f"$.{s}.headers", "array<struct<name: string, value: string>>").alias(n) for s, n in (("request", "headers"), ("response", "response_headers"))],
        _get("$.serverIPAddress", "string").alias("server_ip"),
        start.alias("start"),
        first.alias("first_data"),
        F.coalesce(_get("$._lastDataTimeMs", "double"), first + pos("receive")).alias("end"),
        *[c.alias(f"{n}_ms") for n, c in phase.items()],
    )


def _views(docs: DataFrame) -> DataFrame:
    """capture, first, run, cached, view of all runs of result files, or of their median where they have no runs."""
    runs = docs.select("capture", "first", F.explode_outer(_get("$.data.runs", "map<string,variant>", "doc")).alias("run", "views"), _get("$.data.median", "variant", "doc").alias("median"))
    told = runs.select("capture", "first", F.coalesce("run", F.lit("median")).alias("run"), F.coalesce("views", "median").alias("views"))
    return told.select("capture", "first", "run", F.explode(F.create_map(F.lit(0), _get("$.firstView", "variant", "views"), F.lit(1), _get("$.repeatView", "variant", "views"))).alias("cached", "view")).filter("view is not null")


def view_pages(views: DataFrame) -> DataFrame:
    """capture, run, cached, page_id, title, started_ms, on_load, start_render, ext of views (capture, run, cached, view); ext has its other fields, without bulk."""
    get = lambda n, k: _get(f"$.{n}", k, "view")
    fields = F.map_filter(without(F.col("view").try_cast("map<string,variant>")), lambda k, v: (k != "requests") & v.isNotNull())
    return views.select(
        "capture",
        "run",
        "cached",
        view_id(F.col("run"), F.col("cached")).alias("page_id"),
        view_title(F.col("run"), F.col("cached"), get("URL", "string")).alias("title"),
        (get("date", "double") * 1000).cast("long").alias("started_ms"),
        F.coalesce(get("docTime", "double"), F.lit(-1.0)).alias("on_load"),
        F.coalesce(get("render", "double"), F.lit(-1.0)).alias("start_render"),
        as_extensions(fields).alias("ext"),
    )


def view_requests(views: DataFrame) -> DataFrame:
    """Requests of views (capture, first, run, cached, view) with their phases: -1 where not measured.

    A request was blocked from its creation to the first phase that follows it; connect includes the handshake; time is what the result says
    in all, else the sum of its phases; it began when it was created, else when it was loaded.
    """
    r = _explode(views, "try_variant_get(s.view, '$.requests', 'variant')")
    num = lambda n: _get(f"$.{n}", "double")
    ms = {n: F.coalesce(num(n), F.lit(-1.0)) for n in ("load_start", "dns_ms", "connect_ms", "ssl_ms", "ttfb_ms", "download_ms", "all_ms")}
    created = num("created")
    waits = [F.when(num(n) >= created, num(n) - created) for n in ("dns_start", "connect_start", "ssl_start", "ttfb_start")]
    blocked = F.coalesce(F.when(created >= 0, F.coalesce(*waits)), F.lit(-1.0))
    connect = F.coalesce(num("connect_ms") + F.greatest(F.lit(0.0), ms["ssl_ms"]), F.lit(-1.0))
    pos = lambda c: F.greatest(F.lit(0.0), c)
    whole = pos(blocked) + pos(ms["dns_ms"]) + pos(connect) + pos(ms["ttfb_ms"]) + pos(ms["download_ms"])
    began = F.coalesce(F.when(created >= 0, created), num("load_start"), F.lit(0.0))
    return r.select(
        "capture",
        "run",
        "cached",
        F.col("pos").alias("req"),
        view_id(F.col("run"), F.col("cached")).alias("page"),
        _get("$.full_url", "string").alias("url"),
        F.coalesce(_get("$.method", "string"), F.lit("GET")).alias("method"),
        F.regexp_extract(F.coalesce(_get("$.responseCode", "string"), F.lit("")), r"^\s*(\d+)", 1).try_cast("int").alias("status"),
        *[c.alias(n) for n, c in ms.items()],
        blocked.alias("blocked"),
        connect.alias("connect"),
        F.coalesce(num("all_ms"), whole).alias("time"),
        (_get("$.date", "double", "view") * 1000 + began).alias("started_ms"),
        *[F.filter(F.transform(_get(f"$.headers.{s}", "array<string>"), split_header), lambda h: h.isNotNull()).alias(f"{s}_headers") for s in ("request", "response")],
        _get("$.body_file", "string").alias("body_file"),
    )


def result_views(docs: DataFrame) -> DataFrame:
    """capture, first, run, cached, view of result files, each view once."""
    return _views(docs).filter("first = 0")


def wpt_pages(docs: DataFrame) -> DataFrame:
    """The views of result files as pages."""
    return view_pages(result_views(docs))


def wpt_requests(docs: DataFrame) -> DataFrame:
    """Requests of all runs and views of a result file, or of its median where it has no runs."""
    return view_requests(_views(docs))


def protocol_events(docs: DataFrame) -> DataFrame:
    """capture, ord, method, request_id, ts_ms, params: events of a protocol log that speak of the network or the page."""
    e = _explode(docs, "s.doc")
    method = _get("$.method", "string")
    kept = e.withColumn("method", method).filter(method.startswith("Network.") | method.startswith("Page.") | (method == "Debugger.scriptParsed"))
    return kept.select("capture", F.col("pos").alias("ord"), "method", _get("$.params.requestId", "string").alias("request_id"), (_get("$.params.timestamp", "double") * 1000).alias("ts_ms"), _get("$.params", "variant").alias("params"))


def _header_list(headers: Column) -> Column:
    """name and value of a VARIANT object of headers."""
    return F.transform(F.map_entries(headers.try_cast("map<string,string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))


def protocol_requests(events: DataFrame) -> DataFrame:
    """Requests of a protocol log: a request sent again under its id is a redirect and begins another one.

    first_byte: the first data or response; bytes_in: the total that the end states, else the sum of its parts; error
    12999 where nothing came back. The answer to a request that was redirected stands with the one that follows it. Times of
    connections stay with the first request of a socket, those of lookups with the first of a host. initiator: what
    made the request, by its own url or the first script of its stack that is known.
    """
    from netloom.operators.sequences import segments

    net = events.filter("request_id is not null").withColumn("key", F.concat_ws("\t", "capture", "request_id"))
    net = segments(net, "key", ["ord"], F.col("method") == "Network.requestWillBeSent", "hop").filter("hop > 0")
    is_ = lambda m: F.col("method") == f"Network.{m}"
    p = lambda path, kind: F.try_variant_get("params", path, kind)
    of = lambda m, c: F.min_by(c, F.when(is_(m), F.col("ord")))
    answer = of("responseReceived", p("$.response", "variant"))
    moved = of("requestWillBeSent", p("$.redirectResponse", "variant"))
    folded = net.groupBy("capture", "request_id", "hop").agg(
        F.min("ord").alias("ord"),
        of("requestWillBeSent", p("$.request.url", "string")).alias("url"),
        of("requestWillBeSent", p("$.request.method", "string")).alias("http_method"),
        _header_list(of("requestWillBeSent", p("$.request.headers", "variant"))).alias("headers"),
        of("requestWillBeSent", p("$.initiator.url", "string")).alias("initiator_url"),
        of("requestWillBeSent", p("$.initiator.stack.callFrames", "array<variant>")).alias("stack"),
        F.min(F.when(is_("requestWillBeSent"), F.col("ts_ms"))).alias("start"),
        F.min(F.when(is_("responseReceived") | is_("dataReceived"), F.col("ts_ms"))).alias("first_byte"),
        F.max(F.when(is_("loadingFinished") | is_("loadingFailed") | is_("dataReceived"), F.col("ts_ms"))).alias("end"),
        answer.alias("answer"),
        moved.alias("moved"),
        F.coalesce(F.max(F.when(is_("loadingFinished"), p("$.encodedDataLength", "bigint"))), F.sum(F.when(is_("dataReceived"), p("$.encodedDataLength", "bigint")))).alias("bytes_in"),
        F.max(is_("requestServedFromCache")).alias("from_cache"),
    )
    # the next hop tells how this one was answered, and when
    chain = Window.partitionBy("capture", "request_id").orderBy("hop")
    folded = folded.withColumns({"_moved": F.lead("moved").over(chain), "_then": F.lead("start").over(chain)})
    folded = folded.withColumn("answer", F.coalesce("answer", "_moved"))
    folded = folded.withColumns({"first_byte": F.when(F.col("_moved").isNotNull(), F.coalesce("first_byte", "_then")).otherwise(F.col("first_byte")), "end": F.when(F.col("_moved").isNotNull(), F.coalesce("end", "_then")).otherwise(F.col("end"))})
    a = lambda path, kind: F.try_variant_get("answer", path, kind)
    timed = a("$.timing.requestTime", "double") * 1000
    phase = {c: F.when(a(f"$.timing.{n}", "double") >= 0, timed + a(f"$.timing.{n}", "double")).otherwise(F.lit(-1.0)) for n, c in TIMING.items()}
    told = folded.filter(F.col("url").rlike("^https?://")).withColumns(
        {
            "status": a("$.status", "int"),
            "mime": a("$.mimeType", "string"),
            "socket": F.nullif(a("$.connectionId", "string"), F.lit("0")),
            "http_version": a("$.protocol", "string"),
            "server_ip": a("$.remoteIPAddress", "string"),
            "response_headers": _header_list(a("$.headers", "variant")),
            "host": url_host(F.col("url")),
            "error": F.when(F.col("first_byte").isNull() & ~F.col("from_cache"), 12999),
            "frames": F.transform(F.coalesce("stack", F.array().cast("array<variant>")), lambda f: F.struct(F.try_variant_get(f, "$.scriptId", "string").alias("script"), F.try_variant_get(f, "$.url", "string").alias("url"))),
            **phase,
        }
    )
    told = protocol.claim_phases(told, "capture", "socket", "host", ["start", "ord"]).withColumn("req", F.col("ord"))
    return protocol.initiators(told, protocol.script_urls(protocol_scripts(events))).drop("req", "stack", "frames", "initiator_url", "answer", "moved", "_moved", "_then")


def protocol_scripts(events: DataFrame) -> DataFrame:
    """capture, ord, script, url, frames (script, url) of the scripts that a protocol log tells of."""
    p = lambda path, kind: F.try_variant_get("params", path, kind)
    frame = lambda f: F.struct(F.try_variant_get(f, "$.scriptId", "string").alias("script"), F.try_variant_get(f, "$.url", "string").alias("url"))
    frames = F.transform(F.coalesce(p("$.stackTrace.callFrames", "array<variant>"), F.array().cast("array<variant>")), frame)
    return events.filter("method = 'Debugger.scriptParsed'").select("capture", "ord", p("$.scriptId", "string").alias("script"), p("$.url", "string").alias("url"), frames.alias("frames"))


def trace_events(docs: DataFrame) -> DataFrame:
    """capture, ord, ph, name, cat, pid, tid, ts, dur (us), id, pointer, args of a trace, wrapped or a bare array.

    id: what an event names; pointer: the address that it gives instead, which other objects may have later.
    """
    e = _explode(docs, "coalesce(try_variant_get(s.doc, '$.traceEvents', 'variant'), s.doc)")
    fields = (("ph", "string"), ("name", "string"), ("cat", "string"), ("pid", "bigint"), ("tid", "bigint"), ("ts", "bigint"), ("dur", "bigint"), ("id", "string"), ("args", "variant"))
    pointer = F.coalesce(_get("$.id2.local", "string"), _get("$.id2.global", "string")).alias("pointer")
    return e.select("capture", F.col("pos").alias("ord"), *[_get(f"$.{n}", k).alias(n) for n, k in fields], pointer)


def trace_netlog(events: DataFrame) -> DataFrame:
    """The network log within a trace, as lines.named_events() has it (ms): capture, time, tick_offset, event, source, phase, source_id, params, line.

    An event that tells no kind of source has that of the last event of its name. A pointer stands for a new object from each event that
    begins a request on; such an object is known by -1 less the place of that event. What was met before is known by the pointer itself.
    """
    number = lambda c: F.when(c.startswith("0x"), F.conv(F.substring(c, 3, 16), 16, 10).try_cast("bigint")).otherwise(leading_int(c))
    own = events.filter(F.contains(F.col("cat"), F.lit("netlog")) & F.col("args").isNotNull() & F.col("name").isNotNull())
    shared = F.col("id").isNull() & F.col("pointer").isNotNull()
    own = own.withColumn("own_id", number(F.coalesce("id", "pointer"))).withColumn("shared", shared).filter("own_id is not null")
    begins = F.col("shared") & F.col("name").isin("REQUEST_ALIVE", "URL_REQUEST_START_JOB") & (F.col("ph") == "b")
    own = pointer_epochs(own, ["capture", "own_id", "shared"], "ord", begins, "epoch")
    own = last_known(own, ["capture", "name"], "ord", F.try_variant_get("args", "$.source_type", "string"), "source").filter("source is not null")
    phase = F.when(F.lower("ph") == "b", "BEGIN").when(F.lower("ph") == "e", "END").otherwise("NONE")
    return own.select(
        "capture",
        (F.col("ts") / 1000.0).alias("time"),
        F.lit(0.0).alias("tick_offset"),
        F.col("name").alias("event"),
        "source",
        phase.alias("phase"),
        F.coalesce(-1 - F.col("epoch"), F.col("own_id")).cast("bigint").alias("source_id"),
        F.coalesce(F.try_variant_get("args", "$.params", "variant"), F.col("args")).alias("params"),
        F.format_string("%020d", F.col("ord")).alias("line"),
    )


def trace_timeline(events: DataFrame) -> DataFrame:
    """What the timeline of a trace tells of each resource: capture, request_id, url, times (ms) and more, one clock for each capture.

    A resource without an id goes by its url; has_id is false for it.
    """
    a = lambda path, kind: F.try_variant_get("args", path, kind)
    own_id = a("$.data.requestId", "string")
    e = events.withColumn("request_id", F.coalesce(own_id, a("$.url", "string"))).filter("request_id is not null").withColumn("ms", F.col("ts") / 1000.0)
    is_ = lambda n: F.col("name") == n
    sent, got, data, done = (is_(f"Resource{n}") for n in ("SendRequest", "ReceiveResponse", "ReceivedData", "Finish"))
    last = lambda c, when: F.max_by(c, F.when(when & c.isNotNull(), F.col("ord")))
    any_ = F.lit(True)
    parts = F.coalesce(F.sum(F.when(data, a("$.data.encodedDataLength", "bigint"))), F.lit(0))
    timing = lambda n: last(a(f"$.data.timing.{n}", "double"), got)
    rows = e.groupBy("capture", "request_id").agg(
        F.min("ord").alias("ord"),
        F.coalesce(last(a("$.url", "string"), any_), last(a("$.data.url", "string"), sent)).alias("url"),
        F.max(own_id.isNotNull()).alias("has_id"),
        F.max(sent).alias("was_sent"),
        last(F.col("ms"), sent).alias("requested"),
        last(a("$.data.requestMethod", "string"), sent).alias("method"),
        priority_name(last(a("$.data.priority", "string"), sent)).alias("priority"),
        last(a("$.data.renderBlocking", "string"), sent).alias("render_blocking"),
        last(a("$.data.resourceType", "string"), sent).alias("kind"),
        last(a("$.data.frame", "string"), sent).alias("frame"),
        F.coalesce(F.max(got & a("$.data.fromCache", "boolean")), F.lit(False)).alias("from_cache"),
        F.coalesce(F.max(got & a("$.data.fromServiceWorker", "boolean")), F.lit(False)).alias("from_worker"),
        last(a("$.data.statusCode", "int"), got).alias("status"),
        last(a("$.data.mimeType", "string"), got).alias("mime"),
        last(a("$.data.protocol", "string"), got).alias("protocol"),
        F.when(parts > 0, parts).otherwise(F.coalesce(last(a("$.data.encodedDataLength", "bigint"), done), F.lit(0))).alias("bytes_in"),
        last(F.coalesce(F.nullif(a("$.data.finishTime", "double"), F.lit(0.0)) * 1000, F.col("ms")), done).alias("finished"),
        (F.nullif(timing("requestTime"), F.lit(0.0)) * 1000).alias("timed_from"),
        timing("receiveHeadersEnd").alias("headers_end"),
        *[timing(n).alias(c) for n, c in TIMING.items()],
    )
    return one_clock(rows, "capture", "ord", "requested", "timed_from").withColumn("timed", F.col("timed_from").isNotNull())


def trace_requests(events: DataFrame) -> DataFrame:
    """Requests of a trace, from the page's beginning on (ms): those of its network log that reached the network, with what the
    timeline tells of their url, and those of the timeline that the log lacks, which were sent over the network and answered.

    The page begins with the first navigation, request of the log or request of the timeline that is not the harness's. A request of the log has no request_id.
    """
    rows = trace_timeline(events)
    logged = lines.netlog_joined(trace_netlog(events))
    began = logged.select("capture", F.array_min(F.array(*netlog.TIMES)).alias("at"))
    started = F.when(anchors_page(F.col("url")), F.least("requested", "timed_from"))
    moves = events.filter(F.col("name") == "navigationStart").select("capture", (F.col("ts") / 1000.0).alias("at"))
    base = base_time(rows.select("capture", started.alias("at")).unionByName(moves).unionByName(began), "capture", ["at"])

    logged = logged.filter(~is_noise(F.col("url")) & reached_network(F.col("start"), F.col("headers"), F.col("first_byte"), F.col("end"), F.col("bytes_in")))
    status = status_of(F.get("headers", F.lit(0)))
    logged = logged.withColumns({"status": F.coalesce("status", status), "mime": bare_mime(header(F.filter(F.transform("headers", split_header), lambda h: h.isNotNull()), "content-type"))})
    logged = enriched(logged, rows, {"priority": "priority", "bytes_in": "bytes_in", "mime": "mime", "status": "status"}, ("render_blocking", "kind", "frame"))
    from_base = {c: F.col(c) - F.col("base") for c in netlog.TIMES}
    told = logged.join(base, "capture").withColumns(from_base).withColumn("ord", F.lit(None).cast("bigint"))

    kept = timeline_only(rows, logged).join(base, "capture")
    from_zero = lambda c: F.col(c) - F.col("base")
    phase = {c: F.when(F.col(c) >= 0, from_zero("timed_from") + F.col(c)) for c in TIMING.values()}
    end = F.coalesce(from_zero("finished"), from_zero("requested"))
    first = F.when(F.col("headers_end") > 0, from_zero("timed_from") + F.col("headers_end"))
    kept = kept.withColumns({**phase, "start": F.coalesce(from_zero("timed_from"), from_zero("requested")), "first_byte": F.coalesce(first, end), "end": end})
    columns = ("capture", "request_id", "ord", "url", "method", "status", "mime", "protocol", "priority", "render_blocking", "kind", "frame", "bytes_in", "start", "first_byte", "end", *TIMING.values(), "base")
    more = ("source_id", "hop", "socket", "session", "address", "headers", "addresses", "aliases")
    told = told.withColumnRenamed("tls_next_proto", "protocol").withColumn("request_id", F.lit(None).cast("string")).select(*columns, *more)
    both = kept.select(*columns).unionByName(told, allowMissingColumns=True)
    return both.withColumns({"method": F.coalesce("method", F.lit("GET")), "priority": F.coalesce("priority", F.lit("Lowest"))})


def trace_base(requests: DataFrame) -> DataFrame:
    """capture, base (ms): where the page of a trace begins, by its requests."""
    return requests.groupBy("capture").agg(F.min("base").alias("base"))


def script_url(name: Column, args: Column) -> Column:
    """The web script that a trace event of this name works on, or null."""
    web = lambda path: F.when(F.startswith(F.try_variant_get(args, path, "string"), F.lit("http")), F.try_variant_get(args, path, "string"))
    own = F.when(name.isin("EvaluateScript", "v8.compile", "v8.parseOnBackground"), web("$.data.url"))
    called = F.coalesce(web("$.data.scriptName"), F.substring_index(web("$.data.url"), "#", 1))
    return F.coalesce(own, F.when(name == "FunctionCall", called))


def trace_spans(events: DataFrame) -> DataFrame:
    """thread, depth, name, start, end, script, parent: complete events and pairs of begin and end events of one name (us).

    An end of another name takes the open begin away and makes no span. parent: the name of the span that is open where one begins.
    """
    from netloom.operators.mainthread import pair_begin_end, with_parents

    e = events.withColumn("thread", F.concat_ws("\t", "capture", "pid", "tid")).withColumn("script", script_url(F.col("name"), F.col("args")))
    whole = F.when(F.col("ph") == "X", F.col("ts") + F.coalesce("dur", F.lit(0)))
    rows = e.filter("ph in ('B', 'E', 'X')").select("thread", "ts", "ord", "ph", "name", "script", whole.alias("whole"))
    spans = pair_begin_end(rows, "thread", ["ts", "ord"], F.col("ph") == "B", "ts", "name", same_name=True, whole_end=F.col("whole"), carried=("script",))
    return with_parents(spans, "thread", "depth", "start", "name").select("thread", "depth", "name", "start", "end", "script", "parent")


def trace_slices(spans: DataFrame, base: DataFrame) -> DataFrame:
    """thread, name, slice, usecs, slice_usecs: what each name has of the slices of a trace's threads, counted from its page's beginning on; earlier time is left out.

    base: capture, base (ms). Slices of a capture are as wide as slice_width() has it for the time that its spans take.
    """
    from netloom.operators.mainthread import exclusive_slices, slice_width

    told = spans.withColumn("capture", F.split_part("thread", F.lit("\t"), F.lit(1))).join(base.select("capture", F.floor(F.col("base") * 1000).alias("_base")), "capture")
    told = told.withColumns({"start": F.greatest(F.col("start") - F.col("_base"), F.lit(0)), "end": F.col("end") - F.col("_base")}).filter("end > 0")
    widths = told.groupBy("capture").agg(slice_width(F.max("end")).alias("slice_usecs"))
    told = told.join(widths, "capture")
    slices = exclusive_slices(told, "thread", "start", "end", "name", "slice_usecs")
    return slices.withColumn("capture", F.split_part("thread", F.lit("\t"), F.lit(1))).join(widths, "capture").drop("capture")


def trace_long_tasks(spans: DataFrame, events: DataFrame, base: DataFrame) -> DataFrame:
    """thread, start_ms, end_ms, n: the long tasks of a trace's threads from its page's beginning on: outermost spans, and tasks of the category toplevel."""
    from netloom.operators.intervals import merged_long_tasks

    zero = base.select("capture", F.floor(F.col("base") * 1000).alias("_base"))
    capture = F.split_part("thread", F.lit("\t"), F.lit(1))
    from_base = lambda df: df.join(zero, "capture").withColumns({"start": F.col("start") - F.col("_base"), "end": F.col("end") - F.col("_base")})
    own = from_base(spans.filter("depth = 1").withColumn("capture", capture)).select("thread", "start", "end")
    top = toplevel_tasks(events).withColumns({"thread": F.concat_ws("\t", "capture", "pid", "tid"), "start": F.col("ts"), "end": F.col("ts") + F.col("dur")})
    return merged_long_tasks(own, from_base(top).filter("end > 0").withColumn("start", F.greatest(F.col("start"), F.lit(0))).select("thread", "start", "end"), "thread", "start", "end")


def har_shell(docs: DataFrame) -> DataFrame:
    """capture, har: each document's log with pages and entries, which are empty where it has none, or none that are arrays. docs: whole documents."""
    part = lambda n: F.coalesce(_get(f"$.log.{n}", "array<variant>", "doc"), F.array().cast("array<variant>")).alias(n)
    creator = F.struct(F.lit("netloom").alias("name"), F.lit("1").alias("version")).alias("creator")
    return docs.select("capture", F.to_json(F.struct(F.struct(F.lit("1.2").alias("version"), creator, part("pages"), part("entries")).alias("log"))).alias("har"))


def view_utilization(views: DataFrame, bw_down: Column) -> DataFrame:
    """capture, run, cached and what pages.utilization() tells of each view's ``utilization``."""
    told = views.select("capture", "run", "cached", _get("$.utilization", "variant", "view").alias("utilization"), bw_down.cast("double").alias("bw_down"))
    return utilization(told, ["capture", "run", "cached"], "utilization", "bw_down")


def script_times(spans: DataFrame) -> DataFrame:
    """thread, script, name, start, end: the time of each script, by the name of what it did; what lies within the same of an outer span is left out."""
    from netloom.operators.intervals import drop_contained

    return drop_contained(spans.filter("script is not null"), ["thread", "script", "name"], "start", "end", "depth").select("thread", "script", "name", "start", "end")
