"""Captures of each format become pages and requests, and HAR that reads back as the same requests."""

import io
import json
import struct
import zipfile

import pytest

from netloom.__main__ import main
from netloom.sources import canonical
from netloom.sources import json_captures as J
from netloom.sources.load import load

from tests.test_sources import frame

URLS = ["https://a.example/", "https://a.example/x.css"]


def har():
    entry = lambda i, u: {"pageref": "p1", "startedDateTime": f"2024-01-01T00:00:0{i}.000Z", "time": 9, "request": {"method": "GET", "url": u, "httpVersion": "h2", "headers": [{"name": "Accept", "value": "*/*"}]}, "response": {"status": 200, "headers": [{"name": "X", "value": "y"}], "content": {"size": 5, "mimeType": "text/css"}}, "timings": {"dns": 1, "connect": 2, "wait": 3, "receive": 4}, "serverIPAddress": "1.2.3.4"}
    return json.dumps({"log": {"version": "1.2", "pages": [{"id": "p1", "title": "T", "startedDateTime": "2024-01-01T00:00:00Z", "pageTimings": {"onLoad": 70, "onContentLoad": 50}, "_own": {"a": 1}}], "entries": [entry(i, u) for i, u in enumerate(URLS)]}}).encode()


def view():
    asked = lambda u, t: {"full_url": u, "responseCode": 200, "load_start": t, "dns_ms": 2, "ttfb_ms": 10, "download_ms": 1, "headers": {"request": ["Host: a"], "response": ["X: y"]}}
    return {"date": 1_700_000_000, "URL": URLS[0], "docTime": 50, "requests": [asked(u, 5 * i) for i, u in enumerate(URLS)]}


def wpt():
    return json.dumps({"data": {"id": "1", "runs": {"1": {"firstView": view()}}, "median": {}}}).encode()


def wptagent():
    out, one = io.BytesIO(), view()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("testinfo.json", "{}")
        z.writestr("1_devtools_requests.json", json.dumps({"requests": one.pop("requests"), "pageData": one}))
    return out.getvalue()


def cdp():
    events = []
    for i, u in enumerate(URLS):
        start = 10.0 + i
        events.append({"method": "Network.requestWillBeSent", "params": {"requestId": str(i), "timestamp": start, "request": {"url": u, "method": "GET", "headers": {"Accept": "*/*"}}, "initiator": {"stack": {"callFrames": [{"scriptId": "9", "url": ""}]}}}})
        timing = {"requestTime": start, "dnsStart": 1, "dnsEnd": 3, "connectStart": 3, "connectEnd": 20, "sslStart": 8, "sslEnd": 20}
        events.append({"method": "Network.responseReceived", "params": {"requestId": str(i), "timestamp": start + 0.1, "response": {"status": 200, "mimeType": "text/css", "connectionId": 7, "protocol": "h2", "remoteIPAddress": "1.2.3.4", "headers": {"X": "y"}, "timing": timing}}})
        events.append({"method": "Network.loadingFinished", "params": {"requestId": str(i), "timestamp": start + 0.2, "encodedDataLength": 9}})
    events.append({"method": "Debugger.scriptParsed", "params": {"scriptId": "9", "url": "https://a.example/s.js"}})
    return json.dumps(events).encode()


def trace():
    e = lambda name, ts, **data: {"ph": "I", "name": name, "ts": ts * 1000, "pid": 1, "tid": 2, "cat": "devtools.timeline", "args": {"data": data}}
    out = []
    for i, u in enumerate(URLS):
        out += [e("ResourceSendRequest", 100 + i, requestId=str(i), url=u), e("ResourceReceiveResponse", 150 + i, requestId=str(i), statusCode=200, mimeType="text/css"), e("ResourceFinish", 160 + i, requestId=str(i), encodedDataLength=9)]
    return json.dumps({"traceEvents": out}).encode()


def netlog():
    names, told = ["URL_REQUEST_START_JOB", "HTTP_TRANSACTION_SEND_REQUEST", "HTTP_TRANSACTION_READ_RESPONSE_HEADERS"], []
    constants = {"logEventTypes": {n: i for i, n in enumerate(names)}, "logSourceType": {"URL_REQUEST": 0}, "logEventPhase": {"PHASE_NONE": 0}, "timeTickOffset": "1700000000000"}
    for i, u in enumerate(URLS):
        for k, (name, params) in enumerate(zip(names, ({"url": u, "method": "GET"}, {}, {"headers": ["HTTP/1.1 200 OK", "Content-Type: text/css"]}), strict=True)):
            told.append(json.dumps({"time": str(100 + 10 * i + k), "type": names.index(name), "phase": 0, "source": {"id": i + 1, "type": 0}, "params": params}) + ",")
    return "\n".join(['{"constants":' + json.dumps(constants) + "},", '"events": [', *told]).encode()


def tcpdump():
    asked = b"".join(b"GET %s HTTP/1.1\r\nHost: a.example\r\n\r\n" % p for p in (b"/", b"/x.css"))
    back = b"HTTP/1.1 200 OK\r\nContent-Type: text/css\r\nContent-Length: 2\r\n\r\nok" * 2
    frames = [frame(5000, 80, 1, 24, asked), frame(80, 5000, 1, 24, back[:50]), frame(80, 5000, 51, 24, back[50:])]
    return struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1_700_000_000 + i, 0, len(f), len(f)) + f for i, f in enumerate(frames))


MAKERS = {"har": har, "wpt": wpt, "wptagent": wptagent, "cdp": cdp, "chrome-trace": trace, "netlog": netlog, "tcpdump": tcpdump}


@pytest.mark.parametrize("kind", MAKERS)
def test_har_of_each_format(spark, tmp_path, kind):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "capture").write_bytes(MAKERS[kind]())
    main([str(tmp_path / "in"), str(tmp_path / "out"), "--har"])
    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    log = json.loads(line)["log"]
    urls = [u.replace("https", "http") for u in URLS] if kind == "tcpdump" else URLS
    assert [e["request"]["url"] for e in log["entries"]] == urls and {e["response"]["status"] for e in log["entries"]} == {200}
    assert len(log["pages"]) == 1 and {e["pageref"] for e in log["entries"]} == {log["pages"][0]["id"]}
    assert all(e["timings"]["wait"] >= 0 and e["startedDateTime"].endswith("Z") for e in log["entries"])
    (tmp_path / "back.har").write_text(line)
    assert [r["url"] for r in load(spark, str(tmp_path / "back.har"))["requests"].orderBy("req").collect()] == urls
    if kind in ("har", "wpt", "wptagent"):
        assert log["entries"][0]["request"]["headers"] and log["entries"][0]["response"]["headers"] == [{"name": "X", "value": "y"}]
    if kind == "har":
        assert log["pages"][0]["pageTimings"] == {"onContentLoad": 50.0, "onLoad": 70.0} and log["entries"][0]["serverIPAddress"] == "1.2.3.4"


def test_flat_rows_and_formats_without_requests(spark, tmp_path):
    (tmp_path / "a.har").write_bytes(har())
    main([str(tmp_path / "a.har"), str(tmp_path / "flat"), "--flat"])
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "flat")).collect()]
    assert sorted((r["index"], r["url"], r["status"], r["ip"]) for r in rows) == [(0, URLS[0], 200, "1.2.3.4"), (1, URLS[1], 200, "1.2.3.4")]
    (tmp_path / "keys").write_text("CLIENT_RANDOM aa bb\n")
    with pytest.raises(ValueError, match="keylog"):
        canonical.relation(spark, str(tmp_path / "keys"))


def test_claims_and_initiators_of_a_protocol_log(spark, tmp_path):
    send = lambda i, u, t, **more: {"method": "Network.requestWillBeSent", "params": {"requestId": i, "timestamp": t, "request": {"url": u, "method": "GET"}, **more}}
    events = [*json.loads(cdp()), send("r", "https://b.example/1", 20.0), send("r", "https://b.example/2", 21.0, redirectResponse={"status": 301, "headers": {"Location": "/2"}}), {"method": "Network.responseReceived", "params": {"requestId": "r", "timestamp": 22.0, "response": {"status": 200}}}]
    (tmp_path / "c.json").write_text(json.dumps(events))
    got = {r["url"]: r for r in J.protocol_requests(J.protocol_events(J.documents(spark, str(tmp_path)))).collect()}
    one, two = got[URLS[0]], got[URLS[1]]
    assert (one["dns_start"], one["dns_end"], one["connect_start"], one["connect_end"], one["ssl_start"], one["ssl_end"]) == (10001.0, 10003.0, 10003.0, 10008.0, 10008.0, 10020.0)
    assert (two["dns_start"], two["connect_start"], two["socket"], two["initiator"], two["headers"][0]["name"]) == (None, None, "7", "https://a.example/s.js", "Accept")
    moved = got["https://b.example/1"]
    assert (moved["status"], moved["end"], moved["error"], moved["response_headers"][0]["value"], got["https://b.example/2"]["status"]) == (301, 21000.0, None, "/2", 200)
