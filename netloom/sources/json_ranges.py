"""Large JSON captures in byte ranges: where their arrays lie, and the elements that begin in each range.

What a byte of JSON means depends on all before it: whether it lies in a string, and how deep. A first pass tells of each
range what it does to both, for either way in which it may begin; summed along the file, that gives the state in which every
range begins. A second pass looks for the arrays that readers take apart, a third counts their elements, and then
each range gives its elements as slices, with the place of the first one. A task holds a block of bytes, or a slice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ownership import written
from netloom.sources import ranges

#: Members that lead to arrays, from the document on: the paths of those that are taken apart, besides a document that is an array.
PATHS = (("log", "pages"), ("log", "entries"), ("traceEvents",))
_NAMES, _DEEPEST = {n for p in PATHS for n in p}, max(map(len, PATHS))
_QUOTE, _SLASH = 34, 92
_STEP = np.zeros(256, np.int8)
_STEP[[ord("["), ord("{")]], _STEP[[ord("]"), ord("}")]] = 1, -1
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "{}[],:"]] = True
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', re.S)


def _unescaped(b: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Places of the quotes that no backslash escapes, and whether the byte after b is escaped. escaped: whether the first byte is."""
    quotes, slashes = np.flatnonzero(b == _QUOTE), b == _SLASH

    def run(at: np.ndarray) -> np.ndarray:
        """Backslashes right before each place; the first byte's own escape counts as one more."""
        n, going = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        while going.any():
            here = at - n - 1
            going &= here >= -1
            going &= np.where(here >= 0, slashes[np.maximum(here, 0)], escaped)
            n += going
        return n

    kept = quotes[run(quotes) % 2 == 0]
    return kept, bool(run(np.array([len(b)]))[0] % 2)


def _escaped_at(f: pa.NativeFile, at: int) -> bool:
    """Whether the byte at a place follows an odd number of backslashes."""
    n, size = 0, 64
    while at - n > 0:
        size = min(size * 2, at - n)
        some = f.read_at(size, at - n - size)
        left = len(some) - len(some.rstrip(b"\\"))
        n += left
        if left < len(some):
            break
    return bool(n % 2)


def _blocks(f: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Place, bytes and unescaped quotes of blocks from start to end."""
    escaped = _escaped_at(f, start)
    for data in ranges.blocks_of(f, start, end):
        b = np.frombuffer(data, np.uint8)
        quotes, escaped = _unescaped(b, escaped)
        yield start, b, quotes
        start += len(b)


def effect(f: pa.NativeFile, start: int, end: int) -> tuple[int, int, int]:
    """Unescaped quotes of a range, modulo 2, and what it adds to the depth if it begins outside, or inside, a string."""
    odd, deltas = 0, [0, 0]
    for _, b, quotes in _blocks(f, start, end):
        at = np.flatnonzero(_STEP[b])
        inside = (np.searchsorted(quotes, at) + odd) % 2
        for k in (0, 1):
            deltas[k] += int(_STEP[b[at[inside == k]]].sum())
        odd = (odd + len(quotes)) % 2
    return odd, deltas[0], deltas[1]


def marks(f: pa.NativeFile, start: int, end: int, inside: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, bytes and depth after them of the brackets, commas and colons outside strings, from a range's state on."""
    for base, b, quotes in _blocks(f, start, end):
        at = np.flatnonzero(_MARKS[b])
        at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
        deep = depth + np.cumsum(_STEP[b[at]], dtype=np.int64)
        yield base + at, b[at], deep
        depth = int(deep[-1]) if len(deep) else depth
        inside = (inside + len(quotes)) % 2


def _key_before(f: pa.NativeFile, at: int) -> str | None:
    """The key of the member whose value begins at a place."""
    found = _KEY.search(f.read_at(min(at, 512), at - min(at, 512)))
    try:
        return json.loads(found[1]) if found else None
    except ValueError:
        return None


def landmarks(f: pa.NativeFile, start: int, end: int, inside: int, depth: int) -> list[tuple[str, int, int, str | None]]:
    """(what, place, level, key): the document and the named containers that open in a range; and where it first closes down to each level, anew after each of them."""
    out, waiting, before = [], set(range(_DEEPEST + 1)), ord(":")  # what came before the range may be a colon
    for at, ch, deep in marks(f, start, end, inside, depth):
        if not len(ch):
            continue
        step, named = _STEP[ch], {}
        valued = np.concatenate([[before], ch[:-1]]) == ord(":")
        for i in np.flatnonzero((step > 0) & (deep <= _DEEPEST + 1) & (valued | (deep == 1))).tolist():
            level = int(deep[i]) - 1
            key = _key_before(f, int(at[i])) if level else None
            if level == 0 or key in _NAMES:
                named[i] = ("[" if ch[i] == ord("[") else "{", int(at[i]), level, key)
        levels = waiting | {x[2] for x in named.values()}
        closes = np.flatnonzero((step < 0) & np.isin(deep, list(levels))).tolist()
        for i in sorted([*named, *closes]):
            if i in named:
                out.append(named[i])
                waiting.add(named[i][2])
            elif int(deep[i]) in waiting:
                out.append(("]", int(at[i]), int(deep[i]), None))
                waiting.discard(int(deep[i]))
        before = int(ch[-1])
    return out


def _mapped(rows: DataFrame, tell, schema: str) -> DataFrame:
    """rows through a function of (file, row) that gives a list of tuples of the schema."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with ranges.opened(row["path"]) as f:
                    for some in tell(f, row):
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    return rows.mapInArrow(run, schema)


def states(large: DataFrame, size: int) -> DataFrame:
    """path, length, offset, inside (1 within a string), depth: the state in which each range of the files (path, length) begins."""

    def tell(f: pa.NativeFile, row: dict) -> Iterator[list[tuple]]:
        yield [(row["path"], row["length"], row["offset"], *effect(f, row["offset"], min(row["offset"] + size, row["length"])))]

    found = written(_mapped(ranges.cut(large, size), tell, "path string, length long, offset long, odd int, out_delta long, in_delta long"))
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    told = found.withColumn("inside", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    told = told.withColumn("delta", F.when(F.col("inside") == 1, F.col("in_delta")).otherwise(F.col("out_delta")))
    return told.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0))).select("path", "length", "offset", "inside", "depth")


def arrays(began: DataFrame, size: int) -> DataFrame:
    """path, members, open, close, level of the arrays at PATHS, and of documents that are arrays. began: as states() gives it."""

    def tell(f: pa.NativeFile, row: dict) -> Iterator[list[tuple]]:
        found = landmarks(f, row["offset"], min(row["offset"] + size, row["length"]), row["inside"], row["depth"])
        yield [(row["path"], *x) for x in found]

    found = written(_mapped(began, tell, "path string, what string, at long, level long, key string"))
    opens = found.filter("what <> ']'").withColumnRenamed("at", "open")
    closes = found.filter("what = ']'").select(F.col("path").alias("_p"), F.col("at").alias("_at"), F.col("level").alias("_level"))
    ends = opens.join(closes, (F.col("path") == F.col("_p")) & (F.col("_level") == F.col("level")) & (F.col("_at") > F.col("open")), "left")
    spans = written(ends.groupBy("path", "what", "open", "level", "key").agg(F.min("_at").alias("close")))
    spans = spans.withColumn("close", F.coalesce("close", F.lit(1 << 62)))
    whole = spans.filter("what = '[' and level = 0").select("path", F.array().cast("array<string>").alias("members"), "open", "close", "level")
    out = whole
    for members in PATHS:
        outer = spans.filter("what = '{' and level = 0").select("path", F.col("open").alias("_a"), F.col("close").alias("_b"))
        for level, name in enumerate(members, 1):
            kind = "[" if level == len(members) else "{"
            own = spans.filter((F.col("what") == kind) & (F.col("level") == level) & (F.col("key") == name))
            inner = own.join(outer, "path").filter("open > _a and open < _b")
            outer = inner.select("path", F.col("open").alias("_a"), F.col("close").alias("_b"))
        out = out.unionByName(outer.select("path", F.lit(list(members)).alias("members"), F.col("_a").alias("open"), F.col("_b").alias("close"), F.lit(len(members)).cast("long").alias("level")))
    return out


def _starts(f: pa.NativeFile, row: dict, start: int, end: int) -> Iterator[np.ndarray]:
    """The bracket and commas after which elements of an array begin, in a range."""
    for at, ch, deep in marks(f, start, end, row["inside"], row["depth"]):
        hit = (deep == row["level"] + 1) & ((ch == ord(",")) | (at == row["open"])) & (at >= row["open"]) & (at < row["close"])
        yield at[hit]


def slices(large: DataFrame, size: int, piece: int) -> tuple[DataFrame, DataFrame]:
    """(capture, first, text) of the arrays of large files (path, length), in slices of about ``piece`` bytes; and the files that have such arrays.

    text is JSON: a slice within the members that lead to it; first is the place of its first element. What follows an
    array that is not closed is left out, as are elements that are not JSON.
    """
    began = written(states(large, size))
    spans = written(arrays(began, size))
    met = began.join(spans, "path").filter((F.col("open") < F.col("offset") + size) & (F.col("close") > F.col("offset")))

    def count(f: pa.NativeFile, row: dict) -> Iterator[list[tuple]]:
        n = sum(len(x) for x in _starts(f, row, row["offset"], min(row["offset"] + size, row["length"])))
        yield [(row["path"], row["open"], row["offset"], n)]

    counts = written(_mapped(met, count, "path string, open long, offset long, n long"))
    before = Window.partitionBy("path", "open").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("n > 0")
    work = met.join(counts.drop("n"), ["path", "open", "offset"])

    def give(f: pa.NativeFile, row: dict) -> Iterator[list[tuple]]:
        end, close = min(row["offset"] + size, row["length"]), row["close"]
        head = "".join(f"{{{json.dumps(k)}:" for k in row["members"]).encode() + b"["
        tail = b"]" + b"}" * len(row["members"])
        first, n, begin, stop, last = row["before"], 0, 0, 0, None

        def slice_() -> list[tuple]:
            return [(row["path"], first, (head + f.read_at(stop - begin, begin) + tail).decode("utf-8", "replace"))]

        starts = (int(x) for some in _starts(f, row, row["offset"], min(close, row["length"])) for x in some)
        for at in chain(starts, [close] if close < row["length"] else []):
            if last is not None:  # the element from there to here
                if n and at - begin > piece:
                    yield slice_()
                    first, n = first + n, 0
                begin, stop, n = (begin if n else last + 1), at, n + 1
            if at >= end or at == close:
                break
            last = at
        if n:
            yield slice_()

    n = int(min(max(1, work.count()), 100_000))
    told = _mapped(work.repartition(n), give, "capture string, first long, text string")
    return told, spans.select(F.col("path").alias("capture")).distinct()
