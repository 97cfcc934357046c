"""Large captures as byte ranges: files, what lies in them, and the ranges that tasks read apart.

Files of up to ``SMALL`` bytes are read whole by Spark. A larger one is cut into ranges, each of which a task opens by
itself at its place. Where records or elements begin is found for all ranges at once by a light pass, and checked along each
file, so that every record is read once and whole, by the task in whose range it begins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that one task reads whole, bytes of a range of a larger one, and bytes that are held at a time.
SMALL, RANGE, BLOCK = 128 << 20, 32 << 20, 1 << 20


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files at path; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def opened(path: str) -> pa.NativeFile:
    """The file at a uri, for reading at any place."""
    fs, at = pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.open_input_file(at)


def inflated(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks of a file without gzip, of one or several members; of one that is cut short or damaged, what could be read."""
    z = None
    for data in blocks:
        if z is None:
            if data[:2] != b"\x1f\x8b":
                yield data
                yield from blocks
                return
            z = zlib.decompressobj(47)
        while data:
            try:
                out = z.decompress(data)
            except zlib.error:
                return
            if out:
                yield out
            data = z.unused_data
            if z.eof and data:
                z = zlib.decompressobj(47)
                if data[:2] != b"\x1f\x8b":
                    return


def blocks_of(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    end = min(end, f.size())
    while start < end:
        data = f.read_at(min(BLOCK, end - start), start)
        yield data
        start += len(data)


def heads(spark: SparkSession, path: str, size: int) -> DataFrame:
    """capture, gzipped, head: the first bytes of each file, after gzip. Of a large file, no more is read than these take."""

    def first(blocks: Iterator[bytes]) -> tuple[bool, bytes]:
        raw, out = next(blocks, b""), b""
        for data in inflated(iter([raw])) if len(raw) >= size else inflated(_chain(raw, blocks)):
            out += data
            if len(out) >= size:
                break
        return raw[:2] == b"\x1f\x8b", out[:size]

    def told(rows: list[tuple]) -> pa.RecordBatch:
        names, gzipped, out = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(gzipped, pa.bool_()), pa.array(out, pa.binary())], names=["capture", "gzipped", "head"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield told([(name.as_py(), *first(iter([data.as_py()]))) for name, data in zip(*batch.columns, strict=True)])

    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with opened(name) as f:
                    rows.append((name, *first(blocks_of(f, 0, 1 << 62))))
            yield told(rows)

    schema = "capture string, gzipped boolean, head binary"
    content = spark.read.format("binaryFile").load(path)
    small = content.filter(F.col("length") <= SMALL).select("path", "content").mapInArrow(whole, schema)
    return small.unionByName(content.filter(F.col("length") > SMALL).select("path").mapInArrow(large, schema))


def _chain(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def cut(large: DataFrame, size: int) -> DataFrame:
    """path, length, offset of all ranges of files (path, length), one to a task as far as there are tasks."""
    each = large.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(size))).alias("offset"))
    n = large.agg(F.coalesce(F.sum(F.ceil(F.col("length") / size)), F.lit(1))).first()[0]
    return each.repartition(int(min(max(1, n), 100_000)))


def zipped(large: DataFrame) -> DataFrame:
    """path, length, gzipped of files (path, length), by their first bytes."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                with opened(name) as f:
                    out.append(f.read(2) == b"\x1f\x8b")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=["path", "length", "gzipped"])

    return large.select("path", "length").mapInArrow(told, "path string, length long, gzipped boolean")
