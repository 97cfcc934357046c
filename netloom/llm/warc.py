"""Deterministic, sharded WARC writing and reading.

Records are sorted by page id and digest in ranges of about equal bytes. Bounds of ranges are weighted quantiles of the keys
that a hash picks, so they follow the pages alone and the same table always gives the same files. A task writes its range to
files that roll at a compressed size, under names of its own; the files of the attempts that counted are renamed to
their final names, listed in a manifest beside them, and what other attempts left is removed. Headers and digests are made anew from the payload, one gzip member for each record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Work, delete, text_or_empty

#: Compressed bytes at which a file ends, and the payload bytes from which copies are revisits.
ROLL, LEAST = 256 << 20, 1000
#: A range has 1 / RANGES of all bytes, within these bounds; it depends on the pages alone, as the files do.
RANGES, SPAN = 64, (8 << 20, 512 << 20)
#: All records carry one fixed date, so that files depend on the pages alone.
DATE = "2026-01-01T00:00:00Z"
#: The profile of a record that repeats another's payload; a fixed value of the WARC standard.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages that a hash picks for each range to find its bounds, and in all at least, about; and the greatest number of ranges.
PICKED, LEAST_PICKED, MOST_RANGES = 10, 10_000, 20_000

MANIFEST = "final string, tmp string, bytes long, records long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id} {digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record, uncompressed: a response with its payload, or a revisit that names the response it repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\r\n]", "", url) if url else None,
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
        "WARC-Profile": REVISIT if refers_to is not None else None,
        "WARC-Refers-To": _record_id(refers_to, digest) if refers_to is not None else None,
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)  # no time in the header
    return z.compress(data) + z.flush()


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def mark_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, payload_bytes, payload_digest) with refers_to: of equal payloads of at least ``least`` bytes, the largest page_id."""
    first = (
        pages.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(F.col("payload_digest").alias("_digest"), "_first")
    )
    first = Work(pages.sparkSession).table(first, "responses")
    told = pages.join(first, (pages["payload_digest"] == first["_digest"]) & (pages["payload_bytes"] >= least), "left")
    return told.withColumn("refers_to", F.when(F.col("_first") != F.col("page_id"), F.col("_first"))).drop("_first", "_digest")


def _bounds(pages: DataFrame, span: int | None) -> list[tuple[int | None, str]]:
    """The first key (page_id, payload_digest) of each range but the first; ranges have about equal bytes.

    Null ids come first. Rows of equal keys share a range; ids that repeat, and null ids, are told apart by their digests.
    """
    n, total = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("payload_bytes") + 512), F.lit(0))).first()
    target = max(span or min(max(total // RANGES, SPAN[0]), SPAN[1]), total // MOST_RANGES)
    every = max(1, n // max(LEAST_PICKED, PICKED * total // target))
    picked = pages.filter(F.pmod(F.xxhash64("page_id", "payload_digest"), F.lit(every)) == 0)
    key = ("page_id", "payload_digest")
    sums = picked.groupBy(*key).agg((F.sum(F.col("payload_bytes") + 512) * every).alias("w"))
    upto = F.sum("w").over(Window.orderBy(F.col("page_id").asc_nulls_first(), "payload_digest").rowsBetween(Window.unboundedPreceding, 0))  # PICKED * MOST_RANGES rows at most, about
    dealt = sums.select(F.struct(F.col("page_id").isNotNull().alias("some"), *key).alias("key"), F.floor((upto - F.col("w")) / target).alias("range"))
    firsts = dealt.groupBy("range").agg(F.min("key").alias("key")).orderBy("key").collect()  # MOST_RANGES rows and one at most
    return [(r["key"]["page_id"], r["key"]["payload_digest"]) for r in firsts[1:]]


def _range_of(bounds: list[tuple[int | None, str]]):
    """A function of page_id and payload_digest: the number of bounds that are not above them. Ids are compared as whole numbers."""
    known = sum(i is None for i, _ in bounds)
    ids, digests = [i for i, _ in bounds[known:]], [d for _, d in bounds]

    def number(page_id: int | None, digest: str) -> int:
        low, high = (0, known) if page_id is None else (known + bisect.bisect_left(ids, page_id), known + bisect.bisect_right(ids, page_id))
        return low + (bisect.bisect_right(digests[low:high], digest) if low < high else 0)  # an id that bounds a range, or several

    @F.arrow_udf("int")
    def numbers(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        return pa.array(map(number, page_id.to_pylist(), digest.to_pylist()), pa.int32())

    return numbers


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL, span: int | None = None, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files below folder; return their manifest: final, bytes, records, sha256.

    ``folder`` is on storage that all executors share. A null html has an empty payload, a null url no target; a null
    page_id is always a response and comes first. Rows that repeat a page_id are records each. An empty table gives no files
    and an empty manifest. A payload of any length is one record. Other columns are not read.
    """
    work, payload = Work(pages.sparkSession), F.encode(text_or_empty("html"), "UTF-8")
    known = work.table(pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest")), "digests")
    marks = work.table(mark_revisits(known, least).filter("refers_to is not null").select("page_id", "payload_digest", "refers_to").distinct(), "revisits")
    bounds = _bounds(known, span)
    ranges = len(bounds) + 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        fs, top = _fs(folder)
        attempt, state = uuid.uuid4().hex, {}

        def close() -> pd.DataFrame:
            state["out"].close()
            row = [[state["final"], state["tmp"], state["bytes"], state["n"], state["sha"].hexdigest()]]
            part = state["part"] + 1
            state.clear()
            state["part"] = part
            return pd.DataFrame(row, columns=["final", "tmp", "bytes", "records", "sha256"])

        last, mark = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["is_mark"]:
                    mark = r
                    continue
                same = mark.get("page_id") == r["page_id"] and mark.get("payload_digest") == r["payload_digest"]
                r["refers_to"] = mark["refers_to"] if same and mark else None
                if r["range"] != last or state.get("bytes", 0) >= roll:
                    if "out" in state:
                        yield close()
                    if r["range"] != last:
                        last, state["part"] = r["range"], 0
                if "out" not in state:
                    final = f"pages-{last:06d}-{state['part']:05d}.warc.gz"
                    tmp = f"_tmp/{final}.{attempt}"
                    fs.create_dir(f"{top}/_tmp", recursive=True)
                    state |= {"final": final, "tmp": tmp, "bytes": 0, "n": 0, "sha": hashlib.sha256(), "out": fs.open_output_stream(f"{top}/{tmp}", compression=None)}
                data = _gzip(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["refers_to"]))
                state["out"].write(data)
                state["sha"].update(data)
                state["bytes"] += len(data)
                state["n"] += 1
        if "out" in state:
            yield close()

    def to_pandas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in write(batches):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _fs(folder)
        for pdf in batches:
            for tmp, final, size in zip(pdf["tmp"], pdf["final"], pdf["bytes"], strict=True):
                info = fs.get_file_info(f"{top}/{final}")
                if info.type != pafs.FileType.File or info.size != size:  # a retried commit finds its work done
                    fs.move(f"{top}/{tmp}", f"{top}/{final}")
            yield pdf[["final", "bytes", "records", "sha256"]]

    # A revisit's mark travels with its page: it sorts before it, so that the pages are shuffled once.
    none = F.lit(None)
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"), none.cast("long").alias("refers_to"), F.lit(False).alias("is_mark"))
    notes = marks.select("page_id", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "payload_digest", "refers_to", F.lit(True).alias("is_mark"))
    rows = rows.unionByName(notes).withColumn("range", _range_of(bounds)("page_id", "payload_digest"))
    order = ["range", "page_id", "payload_digest", F.col("is_mark").desc(), "url"]
    sorted_rows = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions(*order)
    written = work.table(sorted_rows.mapInArrow(to_pandas, MANIFEST), "written")
    manifest = work.table(written.repartition("final").mapInPandas(commit, "final string, bytes long, records long, sha256 string"), "manifest")
    manifest.coalesce(1).write.json(f"{folder}/manifest")  # a line for each file
    delete(pages.sparkSession, f"{folder}/_tmp")  # what attempts that did not count have left
    return manifest


def parse_record(data: bytes) -> dict:
    """The fields of one uncompressed record; a response's payload is digested anew, a revisit's is taken from its headers."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, kind = int(re.search(rb"(?i)content-length: (\d+)", http)[1]), fields["WARC-Type"]
    digest = hashlib.sha1(payload).hexdigest() if kind == "response" else base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    number = lambda k: int(fields[k]) if k in fields else None
    if kind == "response" and ("sha1:" + base64.b32encode(bytes.fromhex(digest)).decode() != fields["WARC-Payload-Digest"] or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(block):
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the file ends within a record")


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that a manifest lists: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    An empty manifest gives no records. A file that is damaged or ends within a record raises an error. Other columns of
    the manifest are not read; a file that it lists twice is read twice.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for data in members(f):
                        rows.append(parse_record(data))
                        held += len(data)
                        if not payloads:
                            rows[-1]["payload"] = None
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("final").repartition(n, "final").mapInArrow(read, RECORDS)
