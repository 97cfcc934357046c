"""Compressed bodies of responses."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import zstandard
except ImportError:  # its bodies are then undecoded
    zstandard = None

_PIECE = 1 << 16
#: Content codings that are registered.
CODINGS = ("gzip", "x-gzip", "deflate", "br", "zstd")
#: What became of a body, from the best to the worst.
STATES = ("plain", "decoded", "unknown", "partial", "undecoded")


def _reader(body: bytes, coding: str):
    """A decompressor for the coding, or None where none is at hand."""
    if coding in ("gzip", "x-gzip", "deflate"):
        # deflate comes with a header or without one
        raw = coding == "deflate" and (len(body) < 2 or body[0] & 15 != 8 or int.from_bytes(body[:2], "big") % 31 != 0)
        return zlib.decompressobj(-15 if raw else 47)
    return zstandard.ZstdDecompressor().decompressobj() if coding == "zstd" and zstandard else None


_DAMAGE = (zlib.error, *([zstandard.ZstdError] if zstandard else []))


def _plain(body: bytes, coding: str) -> tuple[bytes | None, str]:
    """body without one content coding, and its state; what was read before a damaged place."""
    if coding in ("", "identity"):
        return body, "plain"
    if coding not in CODINGS:
        return body, "unknown"
    reader = _reader(body, coding)
    if reader is None:
        return None, "undecoded"
    out, state = [], "decoded"
    try:
        for at in range(0, len(body), _PIECE):
            out.append(reader.decompress(body[at : at + _PIECE]))
        if not reader.eof:
            state = "partial"
    except _DAMAGE:
        state = "partial"
    return b"".join(out), state


def _decoded(body: pd.Series, coding: pd.Series) -> pd.DataFrame:
    plain, states = [], []
    for b, codings in zip(body, coding, strict=True):
        told = ["plain"]
        for c in reversed((codings or "").lower().split(",")):  # the last one was applied last
            if b is not None:
                b, state = _plain(b, c.strip())
                told.append(state)
        plain.append(b)
        states.append(max(told, key=STATES.index))
    return pd.DataFrame({"body": plain, "state": states})


def decoded_body(body: Column, coding: Column) -> Column:
    """body without its content codings (gzip, deflate, zstd; several are separated by commas), and one of STATES.

    A coding that nobody knows leaves the bytes as they are (unknown). One that is known but has no decoder here (br)
    gives null (undecoded). A body that is cut short or damaged gives what could be read before that place (partial).
    Bodies that are not coded are not sent to Python.
    """
    coded = ~F.trim(F.lower(F.coalesce(coding, F.lit("")))).isin("", "identity") & body.isNotNull()
    told = F.pandas_udf(_decoded, "body binary, state string")(F.when(coded, body), coding)
    return F.when(coded, told).otherwise(F.struct(body.alias("body"), F.lit("plain").alias("state")))


def plain_body(body: Column, coding: Column) -> Column:
    """The body of decoded_body()."""
    return decoded_body(body, coding)["body"]


def _inflated(chunks: pd.Series, coding: pd.Series) -> pd.Series:
    out = []
    for parts, c in zip(chunks, coding, strict=True):
        parts, c = [] if parts is None else [bytes(p) for p in parts], (c or "").lower().strip()
        reader = _reader(parts[0] if parts else b"", c) if c not in ("", "identity") and c in CODINGS else None
        if reader is None:
            out.append([len(p) for p in parts] if c not in CODINGS else None)
            continue
        sizes = []
        for p in parts:
            try:
                sizes.append(0 if reader.eof else len(reader.decompress(p)))
            except _DAMAGE:
                sizes.append(0)
        out.append(sizes)
    return pd.Series(out)


def inflated_per_chunk(chunks: Column, coding: Column) -> Column:
    """How many bytes of the body each chunk (array of binary) brings once it is inflated; null where a coding has no decoder here.

    A decoder may hold bytes back, so single chunks can differ from another decoder's; their sum is the body's size.
    """
    return F.pandas_udf(_inflated, "array<bigint>")(chunks, coding)
