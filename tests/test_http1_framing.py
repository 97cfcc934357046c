"""Messages are framed by their bytes, however segments cut them."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netloom.sources import http1_framing as H
from netloom.sources import lookups

FLOWS = "capture string, flow string, generation long, forward boolean, time_us long, ord long, proto string, seq long, src_ip string, src_port int, dst_ip string, dst_port int, payload binary"


def segments(client, server, cut=None, shuffle=0, repeat=0.0, seed=0):
    """(forward, seq, bytes) of two streams, the client's first, cut into segments."""
    rng = random.Random(seed)
    out = []
    for forward, stream in ((True, client), (False, server)):
        at, own = 0, []
        while at < len(stream):
            n = cut or rng.randrange(1, 60)
            own.append((forward, 1000 + at, stream[at : at + n]))
            at += n
        for i in range(len(own) - 1):
            if own and i and rng.random() < shuffle:
                own[i], own[i + 1] = own[i + 1], own[i]
        own = [x for s in own for x in ([s, s] if rng.random() < repeat else [s])]
        out += own
    return out


def run(parts):
    c = H.Connection(("c", "f", 0))
    for i, (forward, seq, data) in enumerate(parts):
        c.push(forward, seq, data, (i, i, ("1", 1), ("2", 2)))
    c.finish()
    return c.done


def told(done):
    return [(bytes(x["request"]["head"]).split(b" ")[1].decode(), x["answer"] and x["answer"]["status"], x["request"]["body"], x["answer"] and x["answer"]["body"], x["interim"]) for x in done]


def request(path, body=b"", method=b"GET", chunked=False):
    if chunked:
        body = b"".join(b"%x;x=y\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\nTrailer: GET / HTTP/1.1\r\n\r\n"
        return b"%s %s HTTP/1.1\r\nHost: h\r\nTransfer-Encoding: gzip, chunked\r\n\r\n" % (method, path) + body
    length = b"Content-Length: %d\r\n" % len(body) if body else b""
    return b"%s %s HTTP/1.1\r\nHost: h\r\n%s\r\n" % (method, path, length) + body


def answer(status, body=b"", head=b"", chunked=False):
    if chunked:
        body = b"".join(b"%X\r\n%s\r\n" % (len(body[i : i + 5]), body[i : i + 5]) for i in range(0, len(body), 5)) + b"0\r\n\r\n"
        return b"HTTP/1.1 %d X\r\ntransfer-encoding: chunked\r\n%s\r\n" % (status, head) + body
    return b"HTTP/1.1 %d X\r\n%sContent-Length: %d\r\n\r\n" % (status, head, len(body)) + body


def test_pipelined_requests_and_interim_answers():
    client = request(b"/a", b"GET /x HTTP/1.1\r\n\r\n", b"POST") + request(b"/b") + request(b"/c")
    server = b"HTTP/1.1 100 Go\r\n\r\n" + answer(200, b"HTTP/1.1 500 no\r\n\r\n") + answer(404, b"abc", chunked=True) + answer(500)
    for cut in (1, 2, 3, 7, 40, 10_000):
        assert told(run(segments(client, server, cut))) == [("/a", 200, 19, 19, 1), ("/b", 404, 0, 3, 0), ("/c", 500, 0, 0, 0)]


def test_answers_without_bodies():
    client = request(b"/h", method=b"HEAD") + request(b"/n") + request(b"/m") + request(b"/u")
    server = answer(200, b"", b"X: y\r\n").replace(b"Length: 0", b"Length: 999") + b"HTTP/1.1 204 No\r\n\r\n" + b"HTTP/1.1 304 Same\r\nContent-Length: 7\r\n\r\n" + b"HTTP/1.0 200 OK\r\n\r\nuntil the end"
    done = run(segments(client, server, 11))
    assert told(done) == [("/h", 200, 0, 0, 0), ("/n", 204, 0, 0, 0), ("/m", 304, 0, 0, 0), ("/u", 200, 0, 13, 0)]
    assert all(x["answer"]["whole"] for x in done)


def test_tunnels_and_upgrades_end_the_messages():
    assert told(run(segments(request(b"h:1", method=b"CONNECT") + b"GET /not HTTP/1.1\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\nHTTP/1.1 500 x\r\n\r\n", 1000)))[0][:2] == ("h:1", 200)
    done = run([(True, 0, request(b"/ws")), (False, 0, b"HTTP/1.1 101 Up\r\n\r\n"), (True, len(request(b"/ws")), request(b"/z"))])
    assert told(done) == [("/ws", 101, 0, 0, 0)]


def test_lost_segments():
    """What a gap cuts is told as it is; the next message begins where a segment begins with one."""
    one, two = request(b"/1", b"x" * 50, b"POST"), request(b"/2")
    parts = [(True, 0, one[:60]), (True, 80, two), (False, 0, answer(200, b"ok")), (False, 500, answer(201))]
    done = run(parts)
    assert [(t[0], t[1]) for t in told(done)] == [("/1", 200), ("/2", 201)] and not done[0]["request"]["whole"] and done[1]["request"]["whole"]
    assert run([(True, 0, b"middle of something"), (False, 0, b"more")]) == []
    assert told(run([(False, 0, b"dle"), (False, 3, answer(200, b"z"))])) == []  # nobody asked
    assert told(run([(True, 0, b"dle"), (True, 3, request(b"/late")), (False, 0, answer(200, b"z"))])) == [("/late", 200, 0, 1, 0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([200, 204, 304, 404, 500]), st.binary(max_size=40), st.booleans(), st.booleans(), st.integers(0, 2)), min_size=1, max_size=8), st.integers(0, 10**6))
def test_any_cut_gives_the_same_messages(messages, seed):
    client, server, right = b"", b"", []
    for i, (status, body, a, b, interim) in enumerate(messages):
        asked = body if a else b""
        client += request(b"/%d" % i, asked, b"PUT", chunked=b)
        server += b"HTTP/1.1 102 Wait\r\n\r\n" * interim
        server += b"HTTP/1.1 %d X\r\n\r\n" % status if status in (204, 304) else answer(status, body, chunked=a)
        right.append((f"/{i}", status, len(asked), 0 if status in (204, 304) else len(body), interim))
    assert told(run(segments(client, server, None, 0.3, 0.2, seed))) == right


@pytest.mark.parametrize("waiting", [0, 10**6])
def test_rows(spark, monkeypatch, waiting):
    monkeypatch.setattr(H, "WAITING", waiting)
    client, server = request(b"/a?q") + request(b"http://o/b", b"12345", b"POST"), b"HTTP/1.1 100 x\r\n\r\n" + answer(200, b"zz", b"Content-Type: text/css; a=b\r\n") + answer(404)
    rows = []
    for generation in (0, 1):
        for i, (forward, seq, data) in enumerate(segments(client, server, 9, 0.0, 0.3, 4)):
            ends = ("10.0.0.1", 5000, "10.0.0.2", 80) if forward else ("10.0.0.2", 80, "10.0.0.1", 5000)
            rows.append(("c", "f", generation, forward, 10 * i, i, "tcp", (seq + 2**32 - 1020) % 2**32, *ends, bytearray(data)))
    rows.append(("c", "g", 0, True, 0, 0, "udp", 0, "1", 1, "2", 2, bytearray(b"GET / HTTP/1.1\r\n\r\n")))
    got = H.framed_requests(spark.createDataFrame(rows, FLOWS).repartition(3)).orderBy("generation", "n").collect()
    assert [(r["generation"], r["n"], r["method"], r["url"], r["host"], r["status"], r["mime"], r["server_port"], r["body_out"], r["body_in"], r["interim"], r["whole"]) for r in got] == [
        x for g in (0, 1) for x in ((g, 1, "GET", "http://h/a?q", "h", 200, "text/css", 80, 0, 2, 1, True), (g, 2, "POST", "http://o/b", "h", 404, None, 80, 5, 0, 0, True))
    ]
    assert all(r["bytes_out"] + 0 and r["start"] < r["first_byte"] <= r["end"] for r in got)
    assert H.framed_requests(spark.createDataFrame([], FLOWS)).count() == 0


def dns(name, number=7, answer=None):
    q = b"".join(bytes([len(p)]) + p for p in name.encode().split(b".")) + b"\0\0\1\0\1"
    head = number.to_bytes(2, "big") + (b"\x81\x80\0\1\0\1\0\0\0\0" if answer else b"\1\0\0\1\0\0\0\0\0\0")
    return head + q + (b"\xc0\x0c\0\1\0\1\0\0\0\0\0\4" + bytes(answer) if answer else b"")


def test_lookups_over_requests(spark):
    encoded = base64.urlsafe_b64encode(dns("g.example")).rstrip(b"=")
    kind = b"Content-Type: application/dns-message\r\n"
    client = b"GET /dns-query?x=1&dns=" + encoded + b" HTTP/1.1\r\nHost: r\r\n\r\n" + request(b"/dns-query", dns("p.example"), b"POST").replace(b"Host: h\r\n", b"Host: h\r\n" + kind)
    client += request(b"/other") + b"GET /dns-query?dns=" + encoded + b" HTTP/1.1\r\n\r\n" + b"GET /dns-query?dns=" + encoded + b" HTTP/1.1\r\n\r\n"
    server = answer(200, dns("g.example", 0, (1, 2, 3, 4)), kind, chunked=True) + answer(200, dns("p.example", 0, (5, 6, 7, 8)), kind) + answer(200, b"page") + answer(200, dns("q.example", 0, (9, 9, 9, 9)), kind) + answer(200, b"broken", kind)
    rows = []
    for i, (forward, seq, data) in enumerate(segments(client, server, 23)):
        ends = ("10.0.0.1", 5000, "10.0.0.2", 80) if forward else ("10.0.0.2", 80, "10.0.0.1", 5000)
        rows.append(("c", "f", 0, forward, i, i, "tcp", seq, *ends, bytearray(data)))
    got = lookups.http_lookups(H.exchanges(spark.createDataFrame(rows, FLOWS))).orderBy("start").collect()
    assert [(r["name"], r["addresses"], r["client"], r["code"]) for r in got] == [("g.example", ["1.2.3.4"], "10.0.0.1 5000", 0), ("p.example", ["5.6.7.8"], "10.0.0.1 5000", 0)]
    assert all(r["start"] < r["end"] for r in got)


def test_segments_are_shuffled_once_and_captures_are_apart(spark, capsys):
    """Sequence numbers are unwrapped for each capture, where the segments of a connection are folded."""
    rows = []
    for capture, first in (("a", 0), ("b", 1_500_000_000), ("c", 3_000_000_000)):
        for i, (forward, seq, data) in enumerate(segments(request(b"/" + capture.encode()), answer(200, b"zz"), 9)):
            ends = ("10.0.0.1", 5000, "10.0.0.2", 80) if forward else ("10.0.0.2", 80, "10.0.0.1", None)
            rows.append((capture, "f", 0, forward, i, i, "tcp", seq + first, *ends, bytearray(data)))
    got = H.framed_requests(spark.createDataFrame(rows, FLOWS))
    got.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert [(r["capture"], r["url"], r["status"], r["body_in"], r["whole"]) for r in got.orderBy("capture").collect()] == [(c, f"http://h/{c}", 200, 2, True) for c in "abc"]
