"""Packet captures: packets as rows, with addresses, ports, flags and payload."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators.ownership import written
from netloom.operators.sequences import generations, reassembly, unwrapped
from netloom.sources import ranges

PACKETS = "capture string, ord long, time_us long, src_ip string, src_port int, dst_ip string, dst_port int, proto string, seq long, ack long, flags int, payload binary"
FIN, SYN, RST = 1, 2, 4
#: Packets that are handed on at a time.
BATCH = 20_000
#: Records that must follow one another for a place within a file to count as the beginning of one.
CHAIN = 8
_MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1), b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\x3c\x4d": (">", 1000), b"\x4d\x3c\xb2\xa1": ("<", 1000)}
_SECTION = b"\x0a\x0d\x0d\x0a"


class Framing:
    """How the records of a capture follow one another, by its first bytes."""

    def __init__(self, head: bytes):
        self.blocks, self.order, self.per_us, self.link, self.first = head[:4] == _SECTION, "<", 1, None, 0
        self.known = self.blocks or head[:4] in _MAGIC and len(head) >= 24
        if self.blocks:
            self.order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
        elif self.known:
            self.order, self.per_us = _MAGIC[head[:4]]
            self.link, self.first = struct.unpack_from(self.order + "I", head, 20)[0], 24
        self.head, self._fields = (12 if self.blocks else 16), struct.Struct(self.order + ("II" if self.blocks else "IIII"))

    def size(self, data: bytes, at: int) -> int | None:
        """Bytes of the record whose head is at a place; None if there can be none."""
        fields = self._fields.unpack_from(data, at)
        return fields[1] if self.blocks and fields[1] >= 12 else None if self.blocks else 16 + fields[2]

    def plausible(self, data: bytes, at: int) -> bool:
        """Whether a head stands there, as far as its fields tell. Only used to find records, never to refuse them."""
        fields = self._fields.unpack_from(data, at)
        if self.blocks:
            size = fields[1]
            return 12 <= size < 1 << 24 and size % 4 == 0 and (at + size > len(data) or data[at + size - 4 : at + size] == data[at + 4 : at + 8])
        _, frac, size, whole = fields
        return 0 < size <= min(whole, 1 << 18) and frac < 1_000_000 * self.per_us

    def found(self, data: bytes, begin: int, end: int, ends: bool) -> int | None:
        """The first place in [begin, end) from which CHAIN plausible records follow one another, or as many as the data hold."""
        for at in range(begin, min(end, len(data) - self.head + 1)):
            here, n = at, 0
            while n < CHAIN and here + self.head <= len(data) and self.plausible(data, here):
                here, n = here + self.size(data, here), n + 1
            if n and (n == CHAIN or here == len(data) or here > len(data) - self.head and (not ends or n > 1)):
                return at
        return None


class _Reader:
    """A file's bytes from a place on, a block at a time."""

    def __init__(self, blocks: Iterator[bytes], at: int = 0):
        self.blocks, self.data, self.base = blocks, b"", at

    def has(self, at: int, size: int) -> bool:
        """Whether so many bytes from a place on are there; bytes before it are let go."""
        if at + size > self.base + len(self.data):
            keep = [self.data[at - self.base :]] if at < self.base + len(self.data) else []
            skip, held = max(0, at - self.base - len(self.data)), sum(map(len, keep))
            while held < size and (more := next(self.blocks, b"")):
                if skip >= len(more):
                    skip -= len(more)
                    continue
                keep.append(more[skip:])
                held, skip = held + len(more) - skip, 0
            self.data, self.base = b"".join(keep), at
        return at + size <= self.base + len(self.data)


def walk(framing: Framing, reader: _Reader, at: int, end: int, whole: bool) -> Iterator[tuple[int, int | None, bytes]]:
    """(place, place of the next, record) of the records that begin before ``end``; a record that is cut short ends them, told by None.

    whole: give the records' bytes, else their heads.
    """
    while at < end and reader.has(at, framing.head):
        size = framing.size(reader.data, at - reader.base)
        if size is None or not reader.has(at, size):
            yield at, None, b""
            return
        i = at - reader.base
        yield at, at + size, reader.data[i : i + (size if whole else framing.head + 8)]
        at += size


def frame_of(framing: Framing, record: bytes, links: list[int]) -> tuple[int, int, bytes] | None:
    """(time in us, link type, frame) of a record; None for one without a frame. Interfaces that it describes are added to links."""
    if not framing.blocks:
        sec, frac, _, _ = struct.unpack_from(framing.order + "IIII", record)
        return sec * 1_000_000 + frac // framing.per_us, framing.link, record[16:]
    kind = struct.unpack_from(framing.order + "I", record)[0]
    if kind == 1:
        links.append(struct.unpack_from(framing.order + "H", record, 8)[0])
    elif kind == 6 and len(record) >= 28:
        face, high, low, n = struct.unpack_from(framing.order + "IIII", record, 8)
        return (high << 32) + low, links[face] if face < len(links) else 1, record[28 : 28 + n]
    return None


def decode(link: int, frame: bytes) -> tuple | None:
    """Addresses, ports, transport fields and payload of an IP packet over Ethernet (one VLAN tag) or Linux cooked frames."""
    at = {1: 12, 113: 14}.get(link)
    if at is None or len(frame) < at + 2:
        return None
    kind = int.from_bytes(frame[at : at + 2], "big")
    if kind == 0x8100:
        at += 4
        kind = int.from_bytes(frame[at : at + 2], "big")
    ip = frame[at + 2 :]
    if kind == 0x0800 and len(ip) >= 20:
        head, proto, end = (ip[0] & 15) * 4, ip[9], int.from_bytes(ip[2:4], "big")
        src, dst = ip[12:16], ip[16:20]
    elif kind == 0x86DD and len(ip) >= 40:
        head, proto, end = 40, ip[6], 40 + int.from_bytes(ip[4:6], "big")
        src, dst = ip[8:24], ip[24:40]
    else:
        return None
    body = ip[head : end if end > head else len(ip)]
    names = str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst))
    if proto == 6 and len(body) >= 20:
        sport, dport, seq, ack, off, flags = struct.unpack_from(">HHIIBB", body)
        return names[0], sport, names[1], dport, "tcp", seq, ack, flags, body[(off >> 4) * 4 :]
    if proto == 17 and len(body) >= 8:
        sport, dport = struct.unpack_from(">HH", body)
        return names[0], sport, names[1], dport, "udp", None, None, 0, body[8:]
    return None


def _rows(capture: str, framing: Framing, reader: _Reader, at: int, end: int, number: int, links: list[int]) -> Iterator[pa.RecordBatch]:
    """The packets of the records from ``at`` to ``end``; number: frames of the capture before them."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema, rows = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PACKETS.split(", "))]), []
    for _, _, record in walk(framing, reader, at, end, True):
        if record and (told := frame_of(framing, record, links)):
            if d := decode(*told[1:]):
                rows.append((capture, number, told[0], *d))
            number += 1
        if len(rows) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_BOUNDS = "path string, length long, offset long, start long, next long, frames long, links array<int>"


def _look(size: int):
    """A function of rows (path, length, offset, from) that finds, in each range, its first record and what follows its last one.

    from: where the first record is known to begin, else null. start is null in a range in which none begins. next is null where the
    records end for good: at a record that is cut short.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, offset, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end = min(offset + size, length)
                with ranges.opened(path) as f:
                    framing = Framing(f.read(24))
                    if begin is None and offset == 0:
                        begin = framing.first
                    if begin is None:
                        some = f.read_at(min(end - offset + (1 << 20), length - offset), offset)
                        at = framing.found(some, 0, end - offset, offset + len(some) < length)
                        begin = None if at is None else offset + at
                    last, frames, links = begin, 0, []
                    if begin is not None and framing.known:
                        for _, last, head in walk(framing, _Reader(ranges.blocks_of(f, begin, length), begin), begin, end, False):
                            if last is not None:
                                kind = struct.unpack_from(framing.order + "I", head)[0] if framing.blocks else 6
                                frames += kind == 6
                                if kind == 1:
                                    links.append(struct.unpack_from(framing.order + "H", head, 8)[0])
                row = [[path], [length], [offset], [begin], [last], [frames], [links]]
                types = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _BOUNDS.split(", ")])

    return look


def bounds(large: DataFrame, size: int) -> DataFrame:
    """path, offset, start, next, number, links of the ranges of large captures (path, length) in which records begin.

    Each range looks for its first record by itself. Along a file, it must be where the records of the ranges before lead to; ranges
    in which it is not are read again from there, until all agree: then no record depends on what looked like one.
    """
    found = written(ranges.cut(large, size).withColumn("from", F.lit(None).cast("long")).mapInArrow(_look(size), _BOUNDS))
    in_order = Window.partitionBy("path").orderBy("offset")
    while True:
        # where the records before lead to; -1: they have ended
        before = F.last(F.when(F.col("start").isNotNull(), F.coalesce("next", F.lit(-1))), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        told = found.withColumn("due", F.when(F.col("offset") == 0, F.col("start")).otherwise(before))
        inside = (F.col("due") >= F.col("offset")) & (F.col("due") < F.least(F.col("offset") + size, F.col("length")))
        told = told.withColumn("want", F.when(inside, F.col("due")))
        wrong = ~F.col("want").eqNullSafe(F.col("start"))
        first = F.row_number().over(Window.partitionBy("path", wrong).orderBy("offset")) == 1
        told = written(told.withColumn("again", wrong & first))
        if not told.filter("again").take(1):
            break
        anew = told.filter("again").select("path", "length", "offset", F.col("want").alias("from"))
        nothing = anew.filter("`from` is null").select("path", "length", "offset", *(F.lit(None).cast("long").alias(c) for c in ("start", "next")), F.lit(0).cast("long").alias("frames"), F.array().cast("array<int>").alias("links"))
        anew = anew.filter("`from` is not null").mapInArrow(_look(size), _BOUNDS).unionByName(nothing)
        found = written(told.filter("not again").select(*[c.split()[0] for c in _BOUNDS.split(", ")]).unionByName(anew))
    prior = in_order.rowsBetween(Window.unboundedPreceding, -1)
    done = told.withColumn("number", F.coalesce(F.sum("frames").over(prior), F.lit(0))).withColumn("known", F.flatten(F.collect_list("links").over(prior)))
    return done.filter("start is not null").select("path", "length", "offset", "start", "number", F.col("known").alias("links"))


def packets(spark: SparkSession, path: str, small: int | None = None, size: int | None = None) -> DataFrame:
    """The TCP and UDP packets of capture files, gzipped or not, in the order of each file; ord numbers its frames.

    A capture of up to ``small`` bytes is read by one task. A larger one is cut into ranges of ``size`` bytes, which are read
    apart; where it is gzipped, one task reads it, a block at a time.
    """
    small, size = small or ranges.SMALL, size or ranges.RANGE

    def from_start(capture: str, blocks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(ranges.inflated(blocks))
        reader.has(0, 24)
        framing = Framing(reader.data[:24])
        if framing.known:
            yield from _rows(capture, framing, reader, framing.first, 1 << 62, 0, [])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for capture, data in zip(*batch.columns, strict=True):
                yield from from_start(capture.as_py(), iter([data.as_py()]))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for capture in batch.column(0).to_pylist():
                with ranges.opened(capture) as f:
                    yield from from_start(capture, ranges.blocks_of(f, 0, 1 << 62))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for capture, length, offset, start, number, links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with ranges.opened(capture) as f:
                    framing = Framing(f.read(24))
                    reader = _Reader(ranges.blocks_of(f, start, length), start)
                    yield from _rows(capture, framing, reader, start, min(offset + size, length), number, links)

    content = spark.read.format("binaryFile").load(path)
    rows = content.filter(F.col("length") <= small).select("path", "content").mapInArrow(whole, PACKETS)
    large = ranges.files(spark, path).filter(F.col("length") > small)
    if not large.take(1):
        return rows
    kinds = written(ranges.zipped(large))
    rows = rows.unionByName(kinds.filter("gzipped").select("path").repartition("path").mapInArrow(streamed, PACKETS))
    found = bounds(kinds.filter("not gzipped").select("path", "length"), size)
    n = int(min(max(1, found.count()), 100_000))
    return rows.unionByName(found.repartition(n).mapInArrow(part, PACKETS))


def flows(packets_: DataFrame) -> DataFrame:
    """packets with flow (both directions, smaller end first), direction and generation (a new one on SYN after a close)."""
    a = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    b = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    name = lambda s: F.concat_ws(":", s["ip"], s["port"].cast("string"))
    flow = F.concat_ws(" ", "capture", "proto", name(F.least(a, b)), name(F.greatest(a, b)))
    keyed = packets_.withColumn("flow", flow).withColumn("forward", a <= b)
    has = lambda bit: F.col("flags").bitwiseAND(bit) != 0
    return generations(keyed, "flow", ["time_us", "ord"], has(SYN) & (F.col("flags").bitwiseAND(16) == 0), has(FIN) | has(RST))


def flow_stats(flows_: DataFrame) -> DataFrame:
    """Reassembly statistics of each direction of each TCP connection."""
    data = flows_.filter("proto = 'tcp' and length(payload) > 0").withColumn("size", F.length("payload").cast("long"))
    key = F.concat_ws(" ", "flow", F.col("generation").cast("string"), F.col("forward").cast("string"))
    whole = unwrapped(data.withColumn("key", key), "key", ["time_us", "ord"], "seq")
    return reassembly(whole, "key", ["time_us", "ord"], "seq", "size")
