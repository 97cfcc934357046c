"""Name lookups in packet captures: messages over UDP as rows, answers paired with their questions."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import base64url

PORT, JUMPS = 53, 20
#: Record types whose data is an address or a name.
A, CNAME, AAAA = 1, 5, 28
HTTP_LOOKUPS = "capture string, client string, name string, start long, end long, code int, addresses array<string>, aliases array<string>"
MESSAGES = "capture string, ord long, time_us long, client string, id int, response boolean, code int, name string, addresses array<string>, aliases array<string>"


def _name(data: bytes, at: int) -> tuple[str, int]:
    """The name at a place, and where its text there ends; pointers lead elsewhere, at most JUMPS times."""
    parts, end, jumps = [], None, 0
    while n := data[at]:
        if n >= 0xC0:
            end, jumps = at + 2 if end is None else end, jumps + 1
            if jumps > JUMPS:
                raise ValueError("pointers in a circle")
            at = int.from_bytes(data[at : at + 2], "big") & 0x3FFF
        else:
            parts.append(data[at + 1 : at + 1 + n].decode("latin-1"))
            at += n + 1
    return ".".join(parts).lower(), at + 1 if end is None else end


def message(data: bytes) -> tuple[int, bool, int, str, list[str], list[str]] | None:
    """id, response, code, first name asked for, addresses, aliases; None if it is cut short or malformed."""
    try:
        number, flags, asked, told = (int.from_bytes(data[i : i + 2], "big") for i in range(0, 8, 2))
        at, name, addresses, aliases = 12, "", [], []
        for i in range(asked):
            found, at = _name(data, at)
            name, at = name if i else found, at + 4
        for _ in range(told):
            _, at = _name(data, at)
            kind, size = int.from_bytes(data[at : at + 2], "big"), int.from_bytes(data[at + 8 : at + 10], "big")
            at += 10
            if at + size > len(data):
                return None
            if (kind, size) in ((A, 4), (AAAA, 16)):
                addresses.append(str(ipaddress.ip_address(data[at : at + size])))
            elif kind == CNAME:
                aliases.append(_name(data, at)[0])
            at += size
        return number, bool(flags & 0x8000), flags & 15, name, addresses, aliases
    except (IndexError, ValueError):
        return None


def messages(packets: DataFrame) -> DataFrame:
    """The lookup messages among the UDP packets of ``packets``; client is the address and port that asks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*row[:4], *m) for *row, data in pdf.itertuples(index=False) if (m := message(bytes(data)))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGES.split(", ")])

    side = lambda s: F.concat_ws(" ", f"{s}_ip", F.col(f"{s}_port").cast("string"))
    client = F.when(F.col("dst_port") == PORT, side("src")).otherwise(side("dst"))
    own = packets.filter((F.col("proto") == "udp") & ((F.col("src_port") == PORT) | (F.col("dst_port") == PORT)))
    return own.select("capture", "ord", "time_us", client.alias("client"), "payload").mapInPandas(read, MESSAGES)


def frames(data: bytes, ends: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """(time, message) of a stream of messages, each after two bytes of its length; ends: (bytes so far, time) of the stream's segments."""
    at, k = 0, 0
    while at + 2 <= len(data):
        end = at + 2 + int.from_bytes(data[at : at + 2], "big")
        if end > len(data):
            return
        while ends[k][0] < end:
            k += 1
        yield ends[k][1], data[at + 2 : end]
        at = end


def stream_messages(segments: DataFrame) -> DataFrame:
    """The lookup messages of TCP connections, as messages() has them. segments: new segments of both directions, in order.

    The lookups of one direction of a connection are put together in one task.
    """

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time_us", "ord"])
        ends = list(zip(pdf["payload"].map(len).cumsum().tolist(), pdf["time_us"].tolist(), strict=True))
        first = pdf.iloc[0]
        told = frames(b"".join(map(bytes, pdf["payload"])), ends)
        rows = [(first["capture"], int(first["ord"]), t, first["client"], *m) for t, data in told if (m := message(data))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MESSAGES.split(", ")])

    side = lambda s: F.concat_ws(" ", f"{s}_ip", F.col(f"{s}_port").cast("string"))
    client = F.when(F.col("dst_port") == PORT, side("src")).otherwise(side("dst"))
    own = segments.filter((F.col("src_port") == PORT) | (F.col("dst_port") == PORT))
    return own.select("capture", "ord", "time_us", client.alias("client"), "side", "payload").groupBy("side").applyInPandas(read, MESSAGES)


def lookups(messages_: DataFrame) -> DataFrame:
    """capture, client, name, start, end (us), code, addresses, aliases: answers with the question of their client, id and name.

    An answer uses up its question, and a question asked again counts from its last time.
    """
    w = Window.partitionBy("capture", "client", "id", "name").orderBy("time_us", "ord")
    asked = messages_.withColumn("start", F.lag(F.when(~F.col("response"), F.col("time_us"))).over(w))
    return asked.filter("response and start is not null").select("capture", "client", "name", "start", F.col("time_us").alias("end"), "code", "addresses", "aliases")


def http_lookups(exchanges: DataFrame) -> DataFrame:
    """Lookups over HTTP, as lookups() has them: the question in the url (``dns``, base64url) or in the body of a POST, the answer in the body of the response.

    exchanges: http1_framing.exchanges(). An exchange counts where the answer is a message that answers, to a name that was asked for where the question can be read.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    fields = [(n, kinds[k]) for n, k in (c.split() for c in HTTP_LOOKUPS.split(", "))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for capture, client, start, end, asked, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                question, answer = message(asked) if asked else None, message(told)
                if answer and answer[1] and (question is None or question[3] == answer[3]):
                    out.append((capture, client, answer[3], start, end, *answer[2:3], *answer[4:]))
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    line = F.split_part("asked", F.lit("\r\n"), F.lit(1))
    encoded = F.nullif(F.regexp_extract(line, r"^GET \S*[?&]dns=([A-Za-z0-9_-]+)[&= ]", 1), F.lit(""))
    asked = F.coalesce(base64url(encoded), F.when(line.startswith("POST "), F.col("asked_body")))
    rows = exchanges.filter("told_body is not null").select("capture", F.concat_ws(" ", "from_ip", F.col("from_port").cast("string")).alias("client"), F.col("start"), F.col("answer_end").alias("end"), asked.alias("asked"), "told_body")
    return rows.mapInArrow(read, HTTP_LOOKUPS)
