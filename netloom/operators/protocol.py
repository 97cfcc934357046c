"""What a browser's protocol log tells of connections, lookups and initiators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.ownership import first_claim


def claim_phases(requests: DataFrame, by: str, socket: str, host: str, order: list[str]) -> DataFrame:
    """requests whose connect and ssl times stay with the first request of a socket only, and dns times with the first of those of a host.

    requests: dns_start, dns_end, connect_start, connect_end, ssl_start, ssl_end; times below 0 are not told. A connection is up when its
    handshake begins.
    """
    owned = first_claim(requests, [by, socket], order, "_c")
    asks = F.col("_c") & (F.col("dns_start") >= 0)
    owned = first_claim(owned.withColumn("_h", F.when(asks, F.col(host))), [by, "_h"], order, "_d")
    told = lambda c, when: F.when(F.col(when) & (F.col(c) >= 0), F.col(c))
    paid = {"dns_start": told("dns_start", "_d"), "dns_end": told("dns_end", "_d"), **{c: told(c, "_c") for c in ("connect_start", "connect_end", "ssl_start", "ssl_end")}}
    done = owned.withColumns(paid).drop("_c", "_d", "_h")
    return done.withColumn("connect_end", F.when(F.col("ssl_start").isNotNull(), F.least("connect_end", "ssl_start")).otherwise(F.col("connect_end")))


def script_urls(parsed: DataFrame) -> DataFrame:
    """capture, script, url: where a script came from, by the first event that tells: the first url of its stack, which its frames share, else its own.

    parsed: capture, ord, script, url, frames (array of script, url).
    """
    e = parsed.withColumn("_first", F.get(F.filter("frames", lambda f: F.coalesce(f["url"] != "", F.lit(False))), F.lit(0))["url"])
    own = e.select("capture", "ord", F.lit(1).alias("n"), "script", F.coalesce("_first", F.nullif(F.col("url"), F.lit(""))).alias("url"))
    frames = e.select("capture", "ord", F.lit(0).alias("n"), F.explode(F.filter("frames", lambda f: F.coalesce(f["url"] != "", F.lit(False)) & f["script"].isNotNull())).alias("f"), "_first")
    shared = frames.select("capture", "ord", "n", F.col("f.script").alias("script"), F.col("_first").alias("url"))
    both = own.unionByName(shared).filter("url is not null")
    return both.groupBy("capture", "script").agg(F.min_by("url", F.struct("ord", "n")).alias("url"))


def initiators(requests: DataFrame, scripts: DataFrame) -> DataFrame:
    """requests with ``initiator``: its own url, else that of the first frame that has one or whose script is known.

    requests: capture, req, initiator_url, frames (array of script, url).
    """
    frames = requests.select("capture", "req", F.posexplode("frames").alias("_at", "f")).select("capture", "req", "_at", F.col("f.script").alias("script"), F.nullif(F.col("f.url"), F.lit("")).alias("own"))
    told = frames.join(scripts.withColumnRenamed("url", "known"), ["capture", "script"], "left").withColumn("found", F.coalesce("own", "known")).filter("found is not null")
    first = told.groupBy("capture", "req").agg(F.min_by("found", "_at").alias("_found"))
    return requests.join(first, ["capture", "req"], "left").withColumn("initiator", F.coalesce(F.nullif(F.col("initiator_url"), F.lit("")), F.col("_found"))).drop("_found")
