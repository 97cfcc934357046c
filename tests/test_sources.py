import gzip
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from netloom.functions import text as X
from netloom.sources import json_captures as J
from netloom.sources import archives, http1, lines, lookups, packets
from netloom.sources.load import load

PAGE = {
    "id": "p1", "title": "t", "startedDateTime": "2024-01-01T00:00:00.000Z", "_loadEventEnd": 1,
    "pageTimings": {"onContentLoad": 200, "onLoad": 300, "_firstPaint": 90, "_largestContentfulPaint": 250, "_domInteractiveTime": 180, "_loadEventEnd": 2},
}
ENTRY = {"pageref": "p1", "startedDateTime": "2024-01-01T00:00:00.100Z", "time": 100, "request": {"method": "GET", "url": "https://a.example/x"}, "response": {"status": 200, "content": {"size": 7, "mimeType": "text/css"}}, "timings": {"dns": 5, "connect": 10, "wait": 50, "receive": 35}}


def write(tmp_path, name, value):
    (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    return str(tmp_path / name)


def test_har(spark, tmp_path):
    docs = J.documents(spark, write(tmp_path, "a.har", {"log": {"version": "1.2", "pages": [PAGE], "entries": [ENTRY, {"startedDateTime": "2024-01-01T00:00:01Z"}]}}))
    page = J.har_pages(docs).select("page_id", "on_load", F.to_json("ext").alias("ext")).first()
    ext = json.loads(page["ext"])
    assert (page["page_id"], page["on_load"]) == ("p1", 300.0)
    assert (ext["_render"], ext["_LargestContentfulPaint"], ext["_domInteractive"], ext["_loadEventEnd"]) == (90, 250, 180, 1)
    first, second = J.har_requests(docs).orderBy("req").collect()
    assert (first["start"], first["first_data"], first["end"], first["connection_id"], first["bytes_in"]) == (1704067200100.0, 1704067200165.0, 1704067200200.0, "conn_0", 7)
    assert (second["page"], second["method"], second["first_data"] == second["start"], second["connection_id"]) == ("page_0", "GET", True, None)


def test_damaged_json_is_left_out(spark, tmp_path):
    assert J.documents(spark, write(tmp_path, "b.har", '{"log": {')).count() == 0


def test_wpt(spark, tmp_path):
    view = {"requests": [{"full_url": "https://a/", "responseCode": "200 OK", "dns_ms": 3}]}
    docs = J.documents(spark, write(tmp_path, "w.json", {"data": {"runs": {"1": {"firstView": view, "repeatView": view}}}}))
    rows = J.wpt_requests(docs).collect()
    assert sorted((r["run"], r["cached"], r["status"], r["dns_ms"], r["connect_ms"]) for r in rows) == [("1", 0, 200, 3.0, -1.0), ("1", 1, 200, 3.0, -1.0)]


def test_protocol_redirect_and_failure(spark, tmp_path):
    send = lambda i, u, t: {"method": "Network.requestWillBeSent", "params": {"requestId": i, "timestamp": t, "request": {"url": u, "method": "GET"}}}
    events = [
        {"method": "Other.x"}, send("1", "https://a/1", 1.0), send("1", "https://a/2", 1.5),
        {"method": "Network.responseReceived", "params": {"requestId": "1", "timestamp": 2.0, "response": {"status": 200, "mimeType": "text/html"}}},
        {"method": "Network.dataReceived", "params": {"requestId": "1", "timestamp": 2.1, "encodedDataLength": 10}},
        {"method": "Network.loadingFinished", "params": {"requestId": "1", "timestamp": 2.5, "encodedDataLength": 12}},
        send("2", "https://a/3", 3.0), {"method": "Network.loadingFailed", "params": {"requestId": "2", "timestamp": 3.1, "errorText": "x"}},
    ]
    got = J.protocol_requests(J.protocol_events(J.documents(spark, write(tmp_path, "c.json", events)))).orderBy("ord").collect()
    assert [(r["url"], r["hop"], r["status"], r["bytes_in"], r["error"]) for r in got] == [("https://a/1", 1, None, None, 12999), ("https://a/2", 2, 200, 12, None), ("https://a/3", 1, None, None, 12999)]
    assert (got[1]["start"], got[1]["first_byte"], got[1]["end"]) == (1500.0, 2000.0, 2500.0)


def test_trace_spans(spark, tmp_path):
    e = lambda ph, name, ts, **k: {"ph": ph, "name": name, "ts": ts, "pid": 1, "tid": 2, "cat": "c", **k}
    events = [e("E", "lost", 1), e("B", "outer", 10), e("B", "inner", 20), e("E", "inner", 30), e("X", "whole", 5, dur=7), e("E", "outer", 40)]
    for doc in (events, {"traceEvents": events}):
        rows = J.trace_spans(J.trace_events(J.documents(spark, write(tmp_path, "t.json", doc)))).collect()
        assert sorted((r["name"], r["start"], r["end"]) for r in rows) == [("inner", 20, 30), ("outer", 10, 40), ("whole", 5, 12)]


def test_trace_requests(spark, tmp_path):
    """Two clocks; noise, a cached resource and one that was never sent are no requests, and noise does not move the page's beginning."""
    hour = 3_600_000_000
    e = lambda name, ts, **data: {"ph": "I", "name": name, "ts": ts, "pid": 1, "tid": 2, "cat": "devtools.timeline", "args": {"data": data}}
    events = [
        e("ResourceSendRequest", 5_000, requestId="n", url="chrome://tracing/json"),
        e("ResourceSendRequest", 10_000, requestId="1", url="https://a/", requestMethod="POST", priority="VeryHigh"),
        e("ResourceReceiveResponse", 30_000, requestId="1", statusCode=200, mimeType="text/html", timing={"requestTime": (hour + 12_000) / 1e6, "dnsStart": 0, "dnsEnd": 2, "connectStart": -1, "receiveHeadersEnd": 15}),
        e("ResourceReceivedData", 31_000, requestId="1", encodedDataLength=70), e("ResourceReceivedData", 32_000, requestId="1", encodedDataLength=30),
        e("ResourceFinish", 40_000, requestId="1", encodedDataLength=999),
        e("ResourceSendRequest", 50_000, requestId="2", url="https://a/2"), e("ResourceReceiveResponse", 60_000, requestId="2", statusCode=404), e("ResourceFinish", 70_000, requestId="2", encodedDataLength=9),
        e("ResourceSendRequest", 50_000, requestId="3", url="https://a/3"), e("ResourceReceiveResponse", 60_000, requestId="3", statusCode=200, fromCache=True),
        e("ResourceReceiveResponse", 60_000, requestId="4", statusCode=200),
        {"ph": "I", "name": "blink.resource", "ts": 7, "pid": 1, "tid": 2, "cat": "c", "args": {"url": "https://a/prefetch"}},
    ]
    got = load(spark, write(tmp_path, "t.json", {"traceEvents": events}), "chrome-trace")["requests"].orderBy("ord").collect()
    assert [(r["url"], r["method"], r["status"], r["priority"], r["bytes_in"]) for r in got] == [("https://a/", "POST", 200, "Highest", 100), ("https://a/2", "GET", 404, "Lowest", 9)]
    one, two = got
    # the first resource that has both times puts the inner clock onto the outer one
    assert (one["base"], one["start"], one["first_byte"], one["end"]) == pytest.approx((10.0, 0.0, 15.0, 30.0))
    assert (one["dns_start"], one["dns_end"], one["connect_start"]) == (pytest.approx(0.0), pytest.approx(2.0), None)
    assert (two["start"], two["first_byte"], two["end"]) == pytest.approx((40.0, 60.0, 60.0))


def test_documents_over_the_size_of_a_variant(spark, tmp_path):
    """A trace of 140 MB: a VARIANT of it would be null."""
    event, n = json.dumps({"ph": "X", "name": "n", "cat": "c", "pid": 1, "tid": 2, "ts": 7, "dur": 1, "args": {"x": "y" * 100_000}}), 1400
    path = write(tmp_path, "large.json", '{"metadata": {"a": [1]}, "traceEvents": [' + ", ".join([event] * n) + "]}")
    events = J.trace_events(J.documents(spark, path)).select("ord", "ts")
    assert sorted(tuple(r) for r in events.collect()) == [(i, 7) for i in range(n)]


def test_slices_give_what_the_whole_gives(spark, tmp_path, monkeypatch):
    view = lambda n: {"requests": [{"full_url": f"https://a/{i}", "responseCode": 200} for i in range(n)]}
    har = {"log": {"version": "1.2", "pages": [PAGE, PAGE | {"id": "p2"}], "entries": [ENTRY | {"comment": '\\"]},{' * i} for i in range(9)]}}
    trace = [{"ph": "X", "name": f"n{i}", "ts": i, "pid": 1, "tid": 2} for i in range(9)]
    median = {"firstView": view(4)}
    cases = [
        (har, lambda d: J.har_pages(d).drop("ext"), 2), (har, J.har_requests, 9), (trace, lambda d: J.trace_events(d).drop("args"), 9), ({"x": [1], "traceEvents": trace}, lambda d: J.trace_events(d).drop("args"), 9),
        ({"data": {"median": median, "runs": {"1": {"firstView": view(5), "repeatView": view(3)}, "2": {"firstView": view(2)}}}}, J.wpt_requests, 10), ({"data": {"runs": {}, "median": median}}, J.wpt_requests, 4),
    ]
    for i, (value, read, n) in enumerate(cases):
        path = write(tmp_path, f"{i}.json", json.dumps(value, indent=i % 2 or None))
        got = []
        for size in (1 << 20, 60):
            monkeypatch.setattr(J, "PIECE", size)
            docs = J.documents(spark, path)
            got.append(sorted(map(repr, read(docs).collect())))
        assert got[0] == got[1] and len(got[0]) == n and docs.count() > 1
    monkeypatch.setattr(J, "PIECE", 4)
    for bad in ("[1, 2, 3", "[1, 2 3]", "[1, 2, 3, ]", '{"log": {"entries": [1, 2]}', '{"log": 1, "log": 2}', "[1, 2, NaN]"):
        assert J.documents(spark, write(tmp_path, "bad.json", bad)).count() == 0


def test_netlog(spark, tmp_path):
    types = {"HTTP_TRANSACTION_SEND_REQUEST": 1, "HTTP_TRANSACTION_READ_RESPONSE_HEADERS": 2, "URL_REQUEST_JOB_BYTES_READ": 3, "URL_REQUEST_REDIRECTED": 4, "URL_REQUEST_START_JOB": 5}
    constants = {"logEventTypes": types, "logSourceType": {"URL_REQUEST": 7}, "logEventPhase": {"PHASE_BEGIN": 1, "PHASE_NONE": 0}, "timeTickOffset": 1000}
    event = lambda t, kind, **p: json.dumps({"time": str(t), "type": types[kind], "phase": 0, "source": {"id": 9, "type": 7}, "params": p}) + ","
    text = "\n".join(['{"constants":' + json.dumps(constants) + "},", '"events": [', event(1, "URL_REQUEST_START_JOB", url="https://a/#f", method="GET"), event(2, "HTTP_TRANSACTION_SEND_REQUEST"), event(3, "URL_REQUEST_REDIRECTED"), event(4, "URL_REQUEST_START_JOB", url="https://b/"), event(5, "HTTP_TRANSACTION_READ_RESPONSE_HEADERS", headers=["HTTP/1.1 200 OK"]), event(6, "URL_REQUEST_JOB_BYTES_READ", byte_count=5), '{"time":"7","ty'])
    constants_, events = lines.netlog_lines(spark, write(tmp_path, "n.json", text))
    rows = lines.netlog_requests(lines.named_events(constants_, events)).orderBy("hop").collect()
    assert [(r["url"], r["start"], r["first_byte"], r["bytes_in"]) for r in rows] == [("https://a/", 2.0, None, 0), ("https://b/", None, 5.0, 5)]


def test_keylog(spark, tmp_path):
    rows = lines.keylog(spark, write(tmp_path, "k.txt", "# x\nCLIENT_RANDOM AB cd\nbad line\n")).collect()
    assert [tuple(r) for r in rows] == [("ab", "CLIENT_RANDOM", "cd")]


def frame(src, dst, seq, flags, body, vlan=False):
    tcp = struct.pack(">HHIIBBHHH", src, dst, seq, 0, 5 << 4, flags, 0, 0, 0) + body
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes([10, 0, 0, 1 if src > dst else 2]), bytes([10, 0, 0, 2 if src > dst else 1]))
    return b"\0" * 12 + (b"\x81\0\0\1" if vlan else b"") + b"\x08\0" + ip + tcp


def test_packets(spark, tmp_path):
    frames = [frame(5000, 80, 1, 2, b""), frame(5000, 80, 2, 24, b"abcd"), frame(5000, 80, 2, 24, b"abcd", True), frame(5000, 80, 10, 24, b"xy"), frame(80, 5000, 1, 17, b""), frame(5000, 80, 77, 2, b"")]
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", i, 5, len(f), len(f)) + f for i, f in enumerate(frames)) + b"cut"
    (tmp_path / "a.cap").write_bytes(data)
    p = packets.flows(packets.packets(spark, str(tmp_path / "a.cap")))
    assert [r["generation"] for r in p.orderBy("ord").collect()] == [0, 0, 0, 0, 0, 1]
    s = packets.flow_stats(p).collect()
    assert [(r["packets"], r["duplicates"], r["holes"], r["new_bytes"], r["repeated_bytes"]) for r in s] == [(3, 1, 1, 6, 4)]
    (tmp_path / "b.cap.gz").write_bytes(gzip.compress(data))
    assert packets.packets(spark, str(tmp_path / "b.cap.gz")).drop("capture").collect() == packets.packets(spark, str(tmp_path / "a.cap")).drop("capture").collect()


def test_sequence_numbers_that_wrap(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packets, "BATCH", 2)
    top = 1 << 32
    frames = [frame(5000, 80, seq % top, 24, b"abcd") for seq in (top - 6, top - 2, top + 2, top - 2, top + 6)]
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", i, 5, len(f), len(f)) + f for i, f in enumerate(frames))
    (tmp_path / "w.cap").write_bytes(data)
    s = packets.flow_stats(packets.flows(packets.packets(spark, str(tmp_path / "w.cap")))).collect()
    assert [(r["packets"], r["duplicates"], r["holes"], r["new_bytes"], r["repeated_bytes"]) for r in s] == [(5, 1, 0, 16, 4)]


def test_requests_and_lookups_over_tcp(spark, tmp_path):
    """A request in two segments, one of them sent again, its answer, and a lookup over a stream that tells its server."""
    parts = [b"GET /x HTTP/1.1\r\nHost: h.exa", b"mple\r\n\r\n"]
    sent = [(1, parts[0]), (1, parts[0]), (1 + len(parts[0]), parts[1])]
    back = [(9, b"HTTP/1.1 404 No\r\nContent-Type: text/css; q\r\n\r\n"), (9 + 46, b"body")]
    name = b"\x01h\x07example\0"
    ask = b"\0\7\1\0\0\1\0\0\0\0\0\0" + name + b"\0\1\0\1"
    tell = b"\0\7\x81\x80\0\1\0\1\0\0\0\0" + name + b"\0\1\0\1" + b"\xc0\x0c\0\1\0\1\0\0\0\0\0\4\x0a\0\0\2"
    size = lambda m: len(m).to_bytes(2, "big") + m
    told = size(tell)
    frames_ = [frame(5001, 53, 1, 24, size(ask)), frame(53, 5001, 1, 24, told[:9]), frame(53, 5001, 10, 24, told[9:])]
    frames_ += [frame(5000, 80, s, 24, b) for s, b in sent] + [frame(80, 5000, s, 24, b) for s, b in back]
    data = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", i, 0, len(f), len(f)) + f for i, f in enumerate(frames_))
    (tmp_path / "t.cap").write_bytes(data)
    tables = load(spark, str(tmp_path / "t.cap"))
    found = tables["lookups"].first()
    assert (found["name"], found["start"], found["end"], found["addresses"]) == ("h.example", 0, 2_000_000, ["10.0.0.2"])
    r = tables["requests"].collect()
    assert len(r) == 1 and (r[0]["url"], r[0]["status"], r[0]["mime"], r[0]["host"]) == ("http://h.example/x", 404, "text/css", "h.example")
    assert (r[0]["start"], r[0]["first_byte"], r[0]["end"], r[0]["bytes_out"], r[0]["dns_start"], r[0]["dns_end"]) == (3_000_000, 6_000_000, 7_000_000, len(b"".join(parts)), 0, 2_000_000)
    kinds = tables["packets"].select("ord", http1.protocol(F.col("proto"), F.col("src_port"), F.col("dst_port"), F.col("payload")).alias("k")).orderBy("ord").collect()
    assert [k["k"] for k in kinds] == ["dns"] * 3 + ["http1", "http1", None, "http1", None]


def test_an_answer_uses_up_its_question(spark):
    rows = [("c", i, i * 10, "a 1", 7, answer, 0, "h", ["1.1.1.1"], []) for i, answer in enumerate([False, False, True, True, False, True])]
    got = lookups.lookups(spark.createDataFrame(rows, lookups.MESSAGES)).orderBy("end").collect()
    assert [(r["start"], r["end"]) for r in got] == [(10, 20), (40, 50)]


def test_views_of_results_and_archives(spark, tmp_path):
    page = {"date": 100, "URL": "https://a/", "docTime": 50, "bodies": "large", "SpeedIndex": 7}
    asked = [
        {"full_url": "https://a/", "responseCode": 200, "created": 5, "dns_start": 3, "connect_start": 9, "dns_ms": 2, "connect_ms": 4, "ssl_ms": 3, "ttfb_ms": 10, "download_ms": 1, "headers": {"request": ["Host: a", ":bad"]}, "body_file": "001-body.txt"},
        {"full_url": "https://a/b", "load_start": 20, "all_ms": 77},
    ]
    docs = J.documents(spark, write(tmp_path, "w.json", {"data": {"runs": {"3": {"repeatView": {**page, "requests": asked}}}}}))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("3_Cached_devtools_requests.json.gz", gzip.compress(json.dumps({"pageData": page, "requests": asked}).encode()))
    rows = archives.members(spark, str(tmp_path / "a.zip"))
    for pages_, requests_ in ((J.wpt_pages(docs), J.wpt_requests(docs)), (archives.pages(rows), archives.requests(rows))):
        p = pages_.withColumn("ext", F.to_json("ext")).first()
        assert (p["page_id"], p["title"], p["started_ms"], p["on_load"], p["start_render"]) == ("page_3_1_1", "Run 3, Repeat View for https://a/", 100_000, 50.0, -1.0)
        assert json.loads(p["ext"]) == {"_date": 100, "_URL": "https://a/", "_docTime": 50, "_SpeedIndex": 7}
        one, two = requests_.orderBy("req").collect()
        assert (one["page"], one["blocked"], one["connect"], one["time"], one["started_ms"], one["status"]) == ("page_3_1_1", 4.0, 7.0, 24.0, 100_005.0, 200)
        assert [tuple(h) for h in one["request_headers"]] == [("Host", "a")] and one["body_file"] == "001-body.txt"
        assert (two["blocked"], two["connect"], two["time"], two["started_ms"], two["request_headers"]) == (-1.0, -1.0, 77.0, 100_020.0, None)


def test_netlog_is_stitched(spark, tmp_path):
    """A request over a job and a socket, one over a session that its stream's path tells, and a host that nobody reached."""
    names = ["HTTP_TRANSACTION_SEND_REQUEST", "URL_REQUEST_START_JOB", "SOCKET_POOL_BOUND_TO_SOCKET", "HTTP_STREAM_JOB_BOUND_TO_REQUEST", "TCP_CONNECT_ATTEMPT", "SSL_CONNECT", "HTTP2_SESSION_INITIALIZED", "HTTP2_SESSION_SEND_HEADERS", "HTTP2_SESSION_RECV_HEADERS", "HTTP2_SESSION_RECV_DATA", "HOST_RESOLVER_DNS_TASK", "HOST_RESOLVER_DNS_TASK_EXTRACTION_RESULTS", "TCP_CLIENT_SOCKET_POOL_REQUESTED_SOCKET", "DISK_CACHE_ENTRY_IMPL", "HTTP_TRANSACTION_HTTP2_SEND_REQUEST_HEADERS"]
    sources = ["URL_REQUEST", "SOCKET", "HTTP_STREAM_JOB", "HTTP2_SESSION", "HOST_RESOLVER_IMPL_JOB", "DISK_CACHE_ENTRY"]
    constants = {"logEventTypes": {n: i for i, n in enumerate(names)}, "logSourceType": {n: i for i, n in enumerate(sources)}, "logEventPhase": {"PHASE_BEGIN": 1, "PHASE_END": 2, "PHASE_NONE": 0}}
    told = []

    def event(t, source, number, kind, phase=0, **params):
        told.append(json.dumps({"time": str(t), "type": names.index(kind), "phase": phase, "source": {"id": number, "type": sources.index(source)}, "params": params}) + ",")

    at = lambda number: {"source_dependency": {"id": number}}
    event(100, "HOST_RESOLVER_IMPL_JOB", 30, "HOST_RESOLVER_DNS_TASK", 1, host="https://a.example:443")
    event(101, "URL_REQUEST", 1, "URL_REQUEST_START_JOB", url="https://a.example/x", method="GET")
    event(104, "HOST_RESOLVER_IMPL_JOB", 30, "HOST_RESOLVER_DNS_TASK_EXTRACTION_RESULTS", results=[{"domain_name": "a.example", "query_type": "A", "endpoints": [{"address": "2.2.2.2"}, {"address": "1.1.1.1"}, {"address": "2.2.2.2"}]}, {"alias_target": "b.example"}])
    event(105, "HOST_RESOLVER_IMPL_JOB", 30, "HOST_RESOLVER_DNS_TASK", 2)
    event(106, "SOCKET", 20, "TCP_CONNECT_ATTEMPT", 1, address="2.2.2.2:443")
    event(110, "SOCKET", 20, "TCP_CONNECT_ATTEMPT", 2)
    event(111, "SOCKET", 20, "SSL_CONNECT", 1)
    event(115, "SOCKET", 20, "SSL_CONNECT", 2, version="TLS 1.3", next_proto="h2")
    event(116, "HTTP_STREAM_JOB", 10, "SOCKET_POOL_BOUND_TO_SOCKET", **at(20))
    event(117, "HTTP_STREAM_JOB", 10, "HTTP_STREAM_JOB_BOUND_TO_REQUEST", **at(1))
    event(118, "URL_REQUEST", 1, "HTTP_TRANSACTION_SEND_REQUEST")
    event(119, "HTTP2_SESSION", 40, "HTTP2_SESSION_INITIALIZED", **at(20), host="a.example:443")
    event(120, "URL_REQUEST", 2, "URL_REQUEST_START_JOB", url="https://a.example/y", method="GET")
    event(121, "URL_REQUEST", 2, "HTTP_TRANSACTION_HTTP2_SEND_REQUEST_HEADERS", headers=[":method: GET", ":path: /y"], stream_id=3)
    event(121, "HTTP2_SESSION", 40, "HTTP2_SESSION_SEND_HEADERS", headers=[":path: /y"], stream_id=3, weight=220)
    event(125, "HTTP2_SESSION", 40, "HTTP2_SESSION_RECV_HEADERS", stream_id=3)
    event(128, "HTTP2_SESSION", 40, "HTTP2_SESSION_RECV_DATA", stream_id=3, size=900)
    event(130, "HTTP_STREAM_JOB", 11, "TCP_CLIENT_SOCKET_POOL_REQUESTED_SOCKET", group_id="ssl/lost.example:443")
    event(131, "DISK_CACHE_ENTRY", 50, "DISK_CACHE_ENTRY_IMPL", key="1/0/_dk_https://lost.example/z")
    path = write(tmp_path, "n.json", "\n".join(['{"constants":' + json.dumps(constants) + "},", '"events": [', *told]))
    got = {r["url"]: r for r in load(spark, path, "netlog")["requests"].collect()}
    one, two, lost = got["https://a.example/x"], got["https://a.example/y"], got["https://lost.example/z"]
    assert (one["socket"], one["address"], one["connect_start"], one["connect_end"], one["ssl_start"], one["ssl_end"], one["tls_next_proto"]) == (20, "2.2.2.2:443", 6.0, 10.0, 11.0, 15.0, "h2")
    assert (one["dns_start"], one["dns_end"], one["addresses"], one["aliases"]) == (0.0, 5.0, ["2.2.2.2", "1.1.1.1"], ["b.example"])
    assert one["start"] == pytest.approx(18.000001)
    assert (two["session"], two["socket"], two["address"], two["connect_start"], two["dns_start"]) == (40, 20, "2.2.2.2:443", None, None)
    assert (two["bytes_in"], two["first_byte"], two["weight"], two["priority"], two["addresses"]) == (900, 25.0, 220, "High", ["2.2.2.2", "1.1.1.1"])
    assert (lost["status"], lost["start"], lost["end"], lost["connect_start"], lost["host"]) == (12029, 30.0, 30.0, 30.0, "lost.example")


def test_sniff(spark):
    cases = {"tcpdump": b"\xa1\xb2\x3c\x4d...", "wptagent": b"PK\x03\x04..1_timeline_cpu.json", "perfetto": b"\x0a\x03abc\x0a\x01", "har": b'{ "log": {"version":"1.2"', "unknown": b"text"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "k string, v binary")
    assert {r["k"]: r["f"] for r in df.select("k", X.sniff_capture(F.col("v")).alias("f")).collect()} == {k: k for k in cases}
    more = {b"\n{ \"log\": {\"version\":\"1.2\"": "har", b"\x0a\x82\x01" + b"x" * 130 + b"\x0a": "perfetto", b"\x0a\x82\x01" + b"x" * 131 + b"\x0a": "unknown", b"\x0a": "unknown", b"PK\x03\x04 other.json": "unknown"}
    df = spark.createDataFrame([(bytearray(k),) for k in more], "v binary")
    assert {bytes(r["v"]): r["f"] for r in df.select("v", X.sniff_capture(F.col("v")).alias("f")).collect()} == more


def test_sniff_body(spark):
    cases = {
        b"\xff\xd8\xff\xe0": "image/jpeg", b"RIFF1234WEBPx": "image/webp", b"1234ftypheic": "image/heic", b"1234ftypavis": "image/avif", b"wOF2....": "font/woff2", b"\0\1\0\0": "font/ttf",
        b" \xef\xbb\xbf<!DOCTYPE x": "text/html", b"<!-- a -->\n<HTML>": "text/html", b"<!-- a -->": "", b"<?xml": "", b"{}": "", b"@Layer x": "text/css", b"body {\n color : red }": "text/css", b"body { a: b }": "",
        b"!function(){}": "application/javascript", b"( ( ) => 1": "application/javascript", b"// x\nlet a": "application/javascript", b"/* x */ no": "", b"export default": "application/javascript", b"": "",
    }
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "v binary")
    assert {bytes(r["v"]): r["f"] for r in df.select("v", X.sniff_body(F.col("v")).alias("f")).collect()} == cases


def test_trace_with_a_network_log(spark, tmp_path):
    """A pointer that two requests have, one after the other; a cache hit; a url that only the timeline tells; enrichment by url."""
    n = lambda ph, name, ts, pointer, source=None, **params: {"ph": ph, "name": name, "ts": ts * 1000, "pid": 1, "tid": 2, "cat": "disabled,netlog", "id2": {"local": pointer}, "args": {"params": params, **({"source_type": source} if source else {})}}
    e = lambda name, ts, **data: {"ph": "I", "name": name, "ts": ts * 1000, "pid": 1, "tid": 2, "cat": "devtools.timeline", "args": {"data": data}}
    events = [
        n("n", "URL_REQUEST_START_JOB", 90, "0xff", url="https://a/before"),  # no kind of source is known yet
        n("b", "REQUEST_ALIVE", 100, "0xff", "URL_REQUEST", priority="MEDIUM"),
        n("n", "URL_REQUEST_START_JOB", 101, "0xff", "URL_REQUEST", url="https://a/1#x", method="GET"),
        n("n", "HTTP_TRANSACTION_SEND_REQUEST", 102, "0xff", "URL_REQUEST"),
        n("n", "HTTP_TRANSACTION_READ_RESPONSE_HEADERS", 105, "0xff", "URL_REQUEST", headers=["HTTP/1.1 201 Made", "Content-Type: text/css; q"]),
        n("n", "URL_REQUEST_JOB_BYTES_READ", 106, "0xff", "URL_REQUEST", byte_count=7),
        n("b", "REQUEST_ALIVE", 110, "0xff"),
        n("n", "URL_REQUEST_START_JOB", 111, "0xff", url="https://a/2", method="POST"),
        n("n", "HTTP_TRANSACTION_SEND_REQUEST", 112, "0xff"),
        n("e", "REQUEST_ALIVE", 119, "0xff"),
        n("b", "REQUEST_ALIVE", 120, "0x10"),
        n("n", "URL_REQUEST_START_JOB", 121, "0x10", url="https://a/cached"),
        {**n("n", "TCP_CONNECT_ATTEMPT", 99, None, "SOCKET", address="1.1.1.1:443"), "id2": None, "id": "0x14"},
        e("ResourceSendRequest", 95, requestId="n", url="chrome://tracing/json"),
        e("ResourceSendRequest", 98, requestId="1", url="https://a/2", priority="VeryHigh", renderBlocking="blocking", frame="F"),
        e("ResourceReceiveResponse", 113, requestId="1", statusCode=404, mimeType="text/html"), e("ResourceReceivedData", 114, requestId="1", encodedDataLength=70),
        e("ResourceSendRequest", 130, requestId="2", url="https://a/3"), e("ResourceReceiveResponse", 131, requestId="2", statusCode=200), e("ResourceFinish", 132, requestId="2"),
    ]
    raw = J.trace_events(J.documents(spark, write(tmp_path, "t.json", {"traceEvents": events})))
    told = {(r["event"], r["time"]): r for r in J.trace_netlog(raw).collect()}
    assert {told["REQUEST_ALIVE", 100.0]["source_id"], told["URL_REQUEST_START_JOB", 101.0]["source_id"]} == {-2} and told["HTTP_TRANSACTION_SEND_REQUEST", 112.0]["source_id"] == -7
    assert told["TCP_CONNECT_ATTEMPT", 99.0]["source_id"] == 20 and ("URL_REQUEST_START_JOB", 90.0) not in told and told["REQUEST_ALIVE", 119.0]["phase"] == "END"
    got = {r["url"]: r for r in J.trace_requests(raw).collect()}
    assert set(got) == {"https://a/1", "https://a/2", "https://a/3"}
    one, two, three = (got[f"https://a/{i}"] for i in (1, 2, 3))
    assert (one["base"], one["start"], one["first_byte"], one["status"], one["mime"], one["bytes_in"], one["priority"]) == (98.0, 4.0, 7.0, 201, "text/css", 7, "MEDIUM")
    assert (two["method"], two["start"], two["status"], two["bytes_in"], two["priority"], two["render_blocking"], two["frame"], two["mime"]) == ("POST", 14.0, 404, 70, "Highest", "blocking", "F", "text/html")
    assert (three["start"], three["end"], three["status"], three["source_id"]) == (32.0, 34.0, 200, None)


def test_connect_jobs_and_pooled_sockets(spark):
    rows = []

    def event(t, source, number, kind, phase="NONE", **params):
        rows.append(("c", float(t), 0.0, kind, source, phase, number, json.dumps(params), f"{t:05d}"))

    at = lambda number: {"source_dependency": {"id": number}}
    event(1, "TRANSPORT_CONNECT_JOB", 5, "TRANSPORT_CONNECT_JOB_CONNECT", "BEGIN", group_name="old")
    event(2, "HOST_RESOLVER_IMPL_JOB", 6, "HOST_RESOLVER_DNS_TASK", "BEGIN", **at(5), host="https://p.example:443")
    event(3, "CONNECT_JOB", 5, "CONNECT_JOB_SET_SOCKET", **at(20), group_id="ssl/p.example:443")
    event(4, "TRANSPORT_CONNECT_JOB", 5, "TRANSPORT_CONNECT_JOB_CONNECT", "END")
    event(5, "HTTP2_SESSION", 40, "HTTP2_SESSION_INITIALIZED", **at(20), host="p.example:443")
    event(6, "HTTP_STREAM_JOB", 10, "TCP_CLIENT_SOCKET_POOL_REQUESTED_SOCKET", group_id="ssl/p.example:443")
    event(7, "HTTP_STREAM_JOB", 10, "HTTP2_SESSION_POOL_FOUND_EXISTING_SESSION", **at(40))
    event(8, "DISK_CACHE_ENTRY", 50, "X", key="1/0/_dk_https://p.example/z")
    event(9, "URL_REQUEST", 1, "URL_REQUEST_START_JOB", url="https://q.example/", method="GET")
    df = spark.createDataFrame(rows, "capture string, time double, tick_offset double, event string, source string, phase string, source_id long, params string, line string").withColumn("params", F.parse_json("params"))
    job = lines.netlog_connect_jobs(df).first()
    assert (job["connect_job"], job["group"], job["connect_start"], job["connect_end"], job["socket"], job["lookup"]) == (5, "ssl/p.example:443", 1.0, 4.0, 20, 6)
    assert {r["url"] for r in lines.netlog_stitched(df).collect()} == {"https://q.example/"}  # a job with a session's socket is not in vain
