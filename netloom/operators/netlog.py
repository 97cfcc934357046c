"""Stitching the objects of a network log: streams, sessions, sockets and lookups onto requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import nudged, weight_priority

#: Times of a request that move together.
TIMES = ("dns_start", "dns_end", "connect_start", "connect_end", "ssl_start", "ssl_end", "start", "created", "first_byte", "end")
#: Hosts that always count as known, and the status of a request whose host could not be reached.
KNOWN_HOSTS, UNREACHED = ("cache.pack.google.com", "clients1.google.com", "redirector.gvt1.com"), 12029


def infer_sessions(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """requests with ``session``: their own, or the smallest one of their host whose stream of their number asked for their path.

    requests: req, host, stream_id, path, session; streams: session, host, stream_id, path, which may repeat.
    """
    named = streams.groupBy("host", "stream_id", "path").agg(F.min("session").alias("_session"))
    both = requests.join(named, ["host", "stream_id", "path"], "left")
    return both.withColumn("session", F.coalesce("session", "_session")).drop("_session")


def with_streams(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """requests with what their stream tells: times where they have none, bytes where the stream has more, priority by weight.

    streams: session, stream_id (a key), first_byte, end, bytes_in, weight.
    """
    names = ("first_byte", "end", "bytes_in", "weight")
    s = streams.select("session", "stream_id", *[F.col(n).alias(f"_{n}") for n in names])
    both = requests.join(s, ["session", "stream_id"], "left")
    told = {
        "first_byte": F.coalesce("first_byte", "_first_byte"),
        "end": F.coalesce("end", "_end"),
        "bytes_in": F.when(F.col("_bytes_in") > F.col("bytes_in"), F.col("_bytes_in")).otherwise(F.col("bytes_in")),
        "weight": F.col("_weight"),
        "priority": F.coalesce(F.col("priority"), weight_priority(F.col("_weight"))),
    }
    return both.withColumns(told).drop(*[f"_{n}" for n in names])


def claim_sockets(requests: DataFrame, sockets: DataFrame, order: list[Column | str], first_only: list[str], for_all: list[str]) -> DataFrame:
    """requests with columns of their socket: ``for_all`` go to each of its requests, ``first_only`` to the first that uses it."""
    pays = (F.row_number().over(Window.partitionBy("socket").orderBy(*order)) == 1) & F.col("socket").isNotNull()
    held = sockets.select("socket", *[F.col(c).alias(f"_{c}") for c in (*first_only, *for_all)])
    both = requests.withColumn("_pays", pays).join(held, "socket", "left")
    told = both.withColumns({**{c: F.when(F.col("_pays"), F.col(f"_{c}")) for c in first_only}, **{c: F.col(f"_{c}") for c in for_all}})
    return told.drop("_pays", *[f"_{c}" for c in (*first_only, *for_all)])


def claims(requests: DataFrame, host: str, order: list[Column | str]) -> DataFrame:
    """host, claim, bound: the request that gets its host's lookup, and the time before which that must lie.

    The first request that connects claims, bound by its connect_start; for hosts to which none does, the first one, bound by its start.
    """
    late = F.col("connect_start").isNull()
    first = F.row_number().over(Window.partitionBy(host).orderBy(late, *order))
    named = requests.filter(F.col(host).isNotNull()).withColumn("_n", first).filter("_n = 1")
    return named.select(host, F.col("req").alias("claim"), F.coalesce("connect_start", "start").alias("bound"))


def in_order_of_appearance(df: DataFrame, by: str, value: str, order: list[str], out: str) -> DataFrame:
    """by, out: the different values of each group, in the order in which they came first."""
    first = df.groupBy(by, value).agg(F.min(F.struct(*order)).alias("_at"))
    return first.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(out))


def unreached(jobs: DataFrame, requests: DataFrame, urls: DataFrame) -> DataFrame:
    """Requests to hosts that no socket reached: capture, url, start, end, status, one for each cached url of such a host.

    jobs: capture, host, socket_start, socket_end, socket, ord; requests: capture, host, start, end; urls: capture, url,
    host. The first job of a host counts; without an end it lasts until the last time of all requests of its capture.
    """
    last = requests.groupBy("capture").agg(F.greatest(F.max("start"), F.max("end"), F.lit(0)).alias("_last"))
    tried = jobs.filter("socket is null and socket_start is not null and host is not null").filter(~F.col("host").isin(*KNOWN_HOSTS))
    failed = tried.join(requests.select("capture", "host").distinct(), ["capture", "host"], "left_anti")
    failed = failed.groupBy("capture", "host").agg(F.min_by(F.struct("socket_start", "socket_end"), "ord").alias("j"))
    told = urls.join(failed, ["capture", "host"]).join(last, "capture", "left")
    end = F.coalesce("j.socket_end", F.greatest("j.socket_start", "_last"))
    return told.select("capture", "url", F.col("j.socket_start").alias("start"), end.alias("end"), F.lit(UNREACHED).alias("status"))


def rebased(requests: DataFrame, by: str, times: tuple[str, ...] = TIMES) -> DataFrame:
    """requests with their times counted from the earliest one of their capture; equal starts are kept apart by the request's number."""
    least = requests.groupBy(by).agg(F.min(F.array_min(F.array(*times))).alias("_zero"))
    told = requests.join(least, by).withColumns({t: F.col(t) - F.col("_zero") for t in times}).drop("_zero")
    return told.withColumn("start", nudged(F.col("start"), F.col("req")))
