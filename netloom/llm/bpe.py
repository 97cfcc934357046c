"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to ``chunk`` characters is encoded as it is. A longer one is cut into chunks that overlap; each chunk is
pre-tokenised by itself, in parallel. A scan of the pattern from a given place depends on what follows only, so from
the first place where the boundaries of two neighbouring chunks coincide they agree for good: there the chunks are
stitched, unless white space comes before it. The pieces between stitches are encoded in parallel, and their ids follow one another. Neighbours that
never agree within their overlap are joined and scanned again from the last certain boundary.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of its overlap with the next one.
CHUNK, OVERLAP = 65_536, 1_024


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, built once for each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def encode(text: str | None, path: str) -> np.ndarray:
    return np.array(encoding(path).encode_ordinary(text or ""), dtype="<u4")


def boundaries(text: str, start: int = 0) -> list[int]:
    """Ends of the pre-tokens of text from start on."""
    return [m.end() for m in _pattern().finditer(text, start)]


def chunk_edges(text: str, start: int, chunk: int, overlap: int, size: int) -> dict:
    """Boundaries near both edges of text, a chunk with its overlap that begins at ``start`` of a text of ``size``."""
    ends = boundaries(text)
    if start + len(text) < size:  # the last match may go on in the next chunk, and look-ahead sees one character more
        ends = [e for e in ends if e < len(text) - 1]
    return {"head": [start] + [start + e for e in ends if e <= overlap], "tail": [start + e for e in ends if chunk <= e <= chunk + overlap]}


def stitches(edges: list[dict], chunk: int, text: str) -> list[int]:
    """Where the pieces of a text begin, from the edges of its chunks in order.

    The first chunk's boundaries are certain, a later one's from its stitch on. After neighbours that do not agree,
    the text is scanned on from the last stitch until the next chunk whose head meets that scan.
    """
    starts, scan, seen = [0], None, []
    for i, (before, after) in enumerate(zip(edges, edges[1:], strict=False), 1):
        tail = before["tail"]
        if scan is not None:
            last = after["head"][-1]
            while not seen or seen[-1] < last:
                if (m := next(scan, None)) is None:
                    break
                seen.append(m.end())
            tail = seen = [e for e in seen if e >= i * chunk]
        # a piece that ends in white space would be scanned otherwise by itself: what follows decides how such a run is cut
        meet = sorted(m for m in set(tail) & set(after["head"]) if not text[m - 1].isspace())
        if meet:
            starts.append(meet[0])
            scan, seen = None, []
        elif scan is None:
            scan = _pattern().finditer(text, starts[-1])
    return starts


def _long_pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """_row, piece, text: the pieces of long texts, from their chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                row, text = row.as_py(), text.as_py()
                for i, s in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pydict({"_row": [row], "i": [i], "size": [len(text)], "text": [text[s : s + chunk + overlap]]}, schema=pa.schema([("_row", pa.string()), ("i", pa.int32()), ("size", pa.int64()), ("text", pa.string())]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            edges = [chunk_edges(t, i * chunk, chunk, overlap, n) for t, i, n in zip(pdf["text"], pdf["i"], pdf["size"], strict=True)]
            yield pdf.assign(head=[e["head"] for e in edges], tail=[e["tail"] for e in edges])

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        text = "".join(t[:chunk] for t in pdf["text"])
        starts = stitches(pdf[["head", "tail"]].map(list).to_dict("records"), chunk, text)
        return pd.DataFrame({"_row": pdf["_row"].iloc[0], "piece": range(len(starts)), "text": [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = docs.mapInArrow(cut, "_row string, i int, size long, text string").repartition(n, "_row", "i")
    scanned = chunks.mapInPandas(scan, "_row string, i int, size long, text string, head array<long>, tail array<long>")
    return scanned.groupBy("_row").applyInPandas(stitch, "_row string, piece int, text string")


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row of docs.

    Null and empty texts have no ids. Rows that repeat an id are encoded each for itself; a null id stays null. An
    empty table gives an empty result; other columns are not read.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([encode(t, path).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_row": pdf["_row"], "piece": pdf["piece"], "ids": [encode(t, path).tobytes() for t in pdf["text"]]})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_row": pdf["_row"].iloc[:1], "ids": [b"".join(pdf.sort_values("piece")["ids"])]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, long = rows.schema["doc_id"].dataType.simpleString(), F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    short = rows.filter(~long).mapInArrow(whole, f"doc_id {kind}, ids binary")
    # Equal texts under one id have equal ids, so a long text is known by its id and digest; its repeats are joined back.
    known = rows.filter(long).withColumn("_row", F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2("text", 256)))
    again = known.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), F.first("doc_id").alias("doc_id"))
    cut = _long_pieces(known.dropDuplicates(["_row"]).select("_row", "text"), chunk, overlap)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = cut.repartition(n, "_row", "piece").mapInPandas(pieces, "_row string, piece int, ids binary").groupBy("_row").applyInPandas(together, "_row string, ids binary")
    spread = done.join(again, "_row").select("doc_id", "ids", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int"))).alias("_x")).drop("_x")
    return short.unionByName(spread)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (binary): the bytes of the ids one after another; not every cut is valid UTF-8.

    No ids decode to no bytes. Rows that repeat, and null ids of documents, are decoded each for itself; an empty table gives
    an empty result; other columns are not read. Ids that the file lacks raise an error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoding(path).decode_bytes
        for batch in batches:
            texts = [raw(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], names=["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, ids binary, decoded binary")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
