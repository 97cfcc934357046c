"""HTTP/1 messages of packet captures, framed by their bytes.

The segments of a connection, both directions in order of time, pass through one fold with a carried state: what each
direction has in order so far, and where its current message stands. Lengths and chunk sizes tell where a message ends,
so requests may share a segment, bodies may hold anything, and interim answers are told from final ones. A
fold holds one message head and the segments that wait for a missing one; connections are sorted rows, never a group in memory.
"""

from __future__ import annotations

import heapq
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.text import bare_mime, header, leading_int, split_header, status_of
from netloom.sources.http1 import HEAD, METHODS

#: Bytes that wait for a missing segment at most, for each direction; then the gap is taken as lost.
WAITING = 4 << 20
#: Content types of which the bodies are kept, as rows then carry them, and bytes of such a body at most (what a lookup's length holds).
KEPT, MOST_BODY = re.compile(rb"(?im)^content-type[ \t]*:[ \t]*application/dns-message"), 65_535
#: Bytes that show whether a direction asks or answers.
SHOWN = 16
FIN, SYN, RST = 1, 2, 4
_REQUEST = re.compile(rb"(?:%s) \S" % "|".join(METHODS).encode())
_ANSWER = re.compile(rb"HTTP/1\.[01] \d{3}")
_LENGTH = re.compile(rb"(?im)^content-length[ \t]*:[ \t]*(\d{1,18})[ \t]*\r?$")
_CHUNKED = re.compile(rb"(?im)^transfer-encoding[ \t]*:.*\bchunked[ \t]*\r?$")
_BEGINNINGS = (*(m.encode() + b" " for m in METHODS), b"HTTP/1.")
_ENDLESS = 1 << 62
_HALF = 1 << 31


class Ordered:
    """One direction's bytes in the order of their sequence numbers: what was seen is cut off, what comes early waits."""

    def __init__(self):
        self.due, self.last, self.early, self.held = None, None, [], 0

    def unwrapped(self, seq: int) -> int:
        """A number of 32 bits as one that goes on beyond a wrap: the nearest to the one before."""
        if self.last is None:
            self.last = seq
        else:
            self.last += (seq - self.last + _HALF & 2 * _HALF - 1) - _HALF
        return self.last

    def push(self, seq: int, data: bytes, at: tuple) -> Iterable[tuple[bytes, tuple, bool]]:
        """(bytes, at, whether bytes before them are lost) of what is in order now."""
        if self.due is None:
            self.due = seq
        if seq <= self.due and not self.early:  # as most are: nothing waits
            fresh = data[self.due - seq :]
            self.due += len(fresh)
            return ((fresh, at, False),) if fresh else ()
        return self._waited(seq, data, at)

    def _waited(self, seq: int, data: bytes, at: tuple) -> Iterator[tuple[bytes, tuple, bool]]:
        heapq.heappush(self.early, (seq, at, data))
        self.held += len(data)
        while self.early and (self.early[0][0] <= self.due or self.held > WAITING):
            yield from self._next()

    def rest(self) -> Iterator[tuple[bytes, tuple, bool]]:
        while self.early:
            yield from self._next()

    def _next(self) -> Iterator[tuple[bytes, tuple, bool]]:
        seq, at, data = heapq.heappop(self.early)
        self.held -= len(data)
        fresh = data[max(0, self.due - seq) :]
        if fresh:
            gap = seq > self.due
            self.due = seq + len(data)
            yield fresh, at, gap


class Messages:
    """The messages of one direction. begin and end are the places ((time, ord), ...) of their first and last bytes."""

    def __init__(self, asks: bool):
        self.begins, self.asks, self.state, self.m = (_REQUEST if asks else _ANSWER), asks, "idle", None
        self.left = 0

    def feed(self, data: bytes, at: tuple, gap: bool, connection: Connection) -> None:
        """Take the next bytes. After a gap, or where bytes are no message, one begins where a segment begins with it."""
        if gap and self.state != "idle":
            self.cut(connection)
        if self.state == "lost":
            if not self.begins.match(data):
                return
            self.state = "idle"
        i, size = 0, len(data)
        while i < size:
            if self.state == "idle":
                if data[i] == 10 or data[i] == 13 and data[i + 1 : i + 2] == b"\n":  # empty lines between messages
                    i += 1 + (data[i] == 13)
                    continue
                self.m = {"begin": at, "end": at, "bytes": 0, "head": bytearray(), "body": 0, "line": bytearray(), "whole": False, "kept": None}
                self.state = "head"
            m, start = self.m, i
            if self.state == "head":
                head = m["head"]
                had = len(head)
                head += data[i : i + HEAD - had + 4]
                stop = head.find(b"\r\n\r\n", had - 3 if had > 3 else 0)
                if stop < 0:
                    i = size
                    if len(head) >= HEAD or (had < SHOWN <= len(head) and not self.begins.match(head)):  # told once, when so much is there
                        self.lose(at, i - start, connection)
                        return
                else:
                    del head[stop + 4 :]
                    i += stop + 4 - had
                    if not self.begins.match(head):
                        self.lose(at, i - start, connection)
                        return
                    self.framed(connection)
            elif self.state in ("body", "chunk"):
                n = min(self.left, size - i)
                if m["kept"] is not None and len(m["kept"]) <= MOST_BODY:
                    m["kept"] += data[i : i + n]
                self.left, i = self.left - n, i + n
                m["body"] += n
                if not self.left:
                    self.state = "done" if self.state == "body" else "after-chunk"
            else:  # a line: the size of a chunk, what ends it, or a trailer
                stop = data.find(b"\n", i)
                line = m["line"]
                line += data[i : (stop if stop >= 0 else size)][:1024]
                i = size if stop < 0 else stop + 1
                if stop >= 0:
                    self.line(bytes(line).strip())
                    line.clear()
            if m is self.m and m is not None:
                m["bytes"] += i - start
                m["end"] = at
                if self.state == "done":
                    self.close(connection, True)

    def framed(self, connection: Connection) -> None:
        """The head is whole: what follows it?"""
        head, m = bytes(self.m["head"]), self.m
        length, chunked = _LENGTH.search(head), _CHUNKED.search(head)
        m["kept"] = bytearray() if KEPT.search(head) else None
        m["status"] = None if self.asks else int(head[9:12])
        if self.asks:
            connection.asked(m)
            self.left = 0 if chunked is None and length is None else _ENDLESS
        else:
            m["interim"] = 100 <= m["status"] < 200 and m["status"] != 101
            method = None if m["interim"] else connection.answered(m)
            self.left = 0 if m["interim"] or m["status"] in (101, 204, 304) or method == b"HEAD" else _ENDLESS
        if self.left and chunked:
            self.state = "size"
        else:
            self.left = min(self.left, int(length[1])) if length else self.left
            self.state = "body" if self.left else "done"

    def line(self, line: bytes) -> None:
        if self.state == "size":
            try:
                self.left = int(line.split(b";")[0], 16)
            except ValueError:
                self.left = _ENDLESS  # not a size: all that follows is taken as the body
            self.state = "chunk" if self.left else "trailer"
        elif self.state == "after-chunk":
            self.state = "size"
        elif not line:  # the empty line after the last chunk and its trailers
            self.state = "done"

    def close(self, connection: Connection, whole: bool) -> None:
        m, self.m, self.state = self.m, None, "idle"
        # an answer that tells no length lasts until the connection ends
        m["whole"] = whole or (not self.asks and self.left > _ENDLESS >> 1)
        connection.ended(m, self.asks)
        if not self.asks and m.get("status") == 101:
            connection.over = True

    def lose(self, at: tuple, n: int, connection: Connection) -> None:
        """What was taken for a message is none, or none that can be followed."""
        self.m, self.state = None, "lost"

    def cut(self, connection: Connection) -> None:
        """Bytes are missing, or no more come."""
        if self.m is not None and "status" in self.m:
            self.close(connection, False)
        self.m, self.state = None, "lost"


class Connection:
    """Both directions of a connection: requests wait for their answers in order."""

    def __init__(self, key: tuple):
        self.key, self.asking, self.n, self.over = key, None, 0, False
        self.streams = {True: Ordered(), False: Ordered()}
        self.sides: dict[bool, Messages] = {}
        self.first: dict[bool, list] = {True: [], False: []}  # of each direction, until it is known which one asks
        self.open: deque[dict] = deque()  # requests, in order, until they and their answers have ended
        self.done: list[dict] = []

    def push(self, forward: bool, seq: int, data: bytes, at: tuple) -> None:
        stream = self.streams[forward]
        for some, when, gap in stream.push(stream.unwrapped(seq), data, at):
            self.take(forward, some, when, gap)

    def take(self, forward: bool, data: bytes, at: tuple, gap: bool) -> None:
        if self.over:
            return
        if self.asking is not None:
            self.sides[forward].feed(data, at, gap, self)
            return
        own = self.first[forward]
        own.append((data, at, gap))
        begin = b"".join(x[0] for x in own)
        asks = bool(_REQUEST.match(begin))
        if not asks and not _ANSWER.match(begin):
            if len(begin) >= SHOWN or not any(p[: len(begin)] == begin[: len(p)] for p in _BEGINNINGS):
                own.clear()  # neither; the next segment may be
            return
        self.asking = forward if asks else not forward
        self.sides = {self.asking: Messages(True), not self.asking: Messages(False)}
        for side, part in sorted(((s, x) for s, some in self.first.items() for x in some), key=lambda x: x[1][1][:2]):
            self.sides[side].feed(*part, self)
        self.first.clear()

    def asked(self, m: dict) -> None:
        self.n += 1
        self.open.append({"n": self.n, "request": m, "answer": None, "interim": 0})

    def answered(self, m: dict) -> bytes | None:
        """The method of the request that a final answer goes to."""
        waiting = next((x for x in self.open if x["answer"] is None), None)
        if waiting is None:
            return None
        waiting["answer"] = m
        method = bytes(waiting["request"]["head"].split(b" ", 1)[0])
        if method == b"CONNECT" and m["status"] // 100 == 2:
            self.over = True
        return method

    def ended(self, m: dict, asks: bool) -> None:
        m["ended"] = True
        if not asks and m.get("interim"):
            waiting = next((x for x in self.open if x["answer"] is None), None)
            if waiting is not None:
                waiting["interim"] += 1
        while self.open and self.open[0]["answer"] is not None and self.open[0]["answer"].get("ended") and self.open[0]["request"].get("ended"):
            self.done.append(self.open.popleft())

    def finish(self) -> None:
        for forward, stream in self.streams.items():
            for some, when, gap in stream.rest():
                self.take(forward, some, when, gap)
        for side in self.sides.values():
            side.cut(self)
        self.done += self.open
        self.open.clear()


def _listed(column: pa.Array) -> list:
    """The values of a column; equal texts are one object."""
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        return [texts[i] for i in coded.indices.to_numpy().tolist()]
    if pa.types.is_binary(column.type):
        ends, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].tolist(), memoryview(column.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
    return column.to_numpy(zero_copy_only=False).tolist()


ROWS = "capture string, flow string, generation long, n long, from_ip string, server_ip string, server_port int, asked string, told string, start long, first_byte long, answer_end long, asked_end long, bytes_out long, bytes_in long, body_out long, body_in long, interim long, whole boolean, from_port int, asked_body binary, told_body binary"


def exchanges(flows: DataFrame) -> DataFrame:
    """ROWS: each request of plain connections with its final answer, their heads, times (us) and bytes.

    flows: as packets.flows() makes them. interim: answers before the final one; whole: whether both messages ended where
    they must. Requests without an answer have nulls. A connection in which neither a request nor a status line begins a
    segment has no rows. asked_body and told_body are kept for the content types that KEPT names only. Rows of one connection pass through one task, sorted, a segment at a time.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (c.split() for c in ROWS.split(", "))]

    def row(c: Connection, x: dict) -> tuple:
        q, a = x["request"], x["answer"] or {}
        client, (server, port) = q["begin"][2], q["begin"][3]
        text = lambda m: m["head"][:-4].decode("latin-1") if m else None
        time = lambda m, k: m[k][0] if m else None
        body = lambda m: bytes(m["kept"]) if m and m["kept"] is not None and len(m["kept"]) <= MOST_BODY else None
        whole = bool(q["whole"] and a.get("whole"))
        return (*c.key, x["n"], client[0], server, port, text(q), text(a), time(q, "begin"), time(a, "begin"), time(a, "end"), time(q, "end"), q["bytes"], a.get("bytes"), q["body"], a.get("body"), x["interim"], whole, client[1], body(q), body(a))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, out = None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            for capture, flow, generation, forward, time, ord_, seq, data, src, src_port, dst, dst_port in zip(*map(_listed, batch.columns), strict=True):
                if c is None or c.key != (capture, flow, generation):
                    if c is not None:
                        c.finish()
                        out += [row(c, x) for x in c.done]
                    c = Connection((capture, flow, generation))
                c.push(forward, seq, data, (time, ord_, (src, src_port), (dst, dst_port)))
                if c.done:
                    out += [row(c, x) for x in c.done]
                    c.done.clear()
                if len(out) > 2000:
                    yield told()
        if c is not None:
            c.finish()
            out += [row(c, x) for x in c.done]
        yield told()

    data = flows.filter("proto = 'tcp' and length(payload) > 0")
    columns = ["capture", "flow", F.col("generation").cast("long").alias("generation"), "forward", "time_us", "ord", "seq", "payload", "src_ip", "src_port", "dst_ip", "dst_port"]
    dealt = data.select(*columns).repartition("capture", "flow", "generation").sortWithinPartitions("capture", "flow", "generation", "time_us", "ord")
    return dealt.mapInArrow(fold, ROWS)


def framed_requests(flows: DataFrame) -> DataFrame:
    """Requests of connections (flows), as requests_of() has them."""
    return requests_of(exchanges(flows))


def requests_of(exchanged: DataFrame) -> DataFrame:
    """Requests over plain connections, framed by bytes, with their final answers; columns as those of http1_requests() and more.

    capture, flow, generation, n, method, url, host, status, mime, headers, response_headers, server_ip, server_port, start, first_byte,
    end (us), bytes_out, bytes_in, length, body_out, body_in, interim, whole.
    """
    headers = lambda c: F.filter(F.transform(F.slice(c, 2, 1 << 30), split_header), lambda h: h.isNotNull())
    told = exchanged.withColumns({"asked": F.split("asked", "\r\n"), "told": F.split("told", "\r\n")})
    told = told.withColumns({"line": F.col("asked")[0], "headers": headers("asked"), "response_headers": F.when(F.col("told").isNotNull(), headers("told"))})
    told = told.withColumns({"_target": F.regexp_extract("line", r"^\S+ (\S+)", 1), "_host": F.coalesce(header(F.col("headers"), "host"), F.col("server_ip"))})
    target, host = F.col("_target"), F.col("_host")
    return told.select(
        "capture",
        "flow",
        "generation",
        "n",
        F.regexp_extract("line", r"^(\S+)", 1).alias("method"),
        F.when(target.rlike("^https?://"), target).otherwise(F.concat(F.lit("http://"), host, target)).alias("url"),
        F.regexp_replace(host, r":\d+$", "").alias("host"),
        status_of(F.col("told")[0]).alias("status"),
        bare_mime(header(F.col("response_headers"), "content-type")).alias("mime"),
        "headers",
        "response_headers",
        "server_ip",
        "server_port",
        "start",
        "first_byte",
        F.greatest("asked_end", "answer_end").alias("end"),
        "bytes_out",
        F.coalesce("bytes_in", F.lit(0)).alias("bytes_in"),
        leading_int(header(F.col("response_headers"), "content-length")).alias("length"),
        "body_out",
        "body_in",
        "interim",
        "whole",
    )
