"""Who pays for a shared resource: first-claim ownership, request timings and first-match joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that the session names; a local session without one gets a temporary folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def first_claim(df: DataFrame, resource: list[str], order: list[str], out: str = "is_owner") -> DataFrame:
    """Mark the first row of each resource; a null resource is owned by nobody."""
    first = F.row_number().over(Window.partitionBy(*resource).orderBy(*order)) == 1
    known = F.lit(True)
    for c in resource:
        known = known & F.col(c).isNotNull()
    return df.withColumn(out, first & known)


def first_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def last_per(df: DataFrame, key: list[str], order: str, values: list[str]) -> DataFrame:
    """For each key the values of its last row: one hash aggregation, combined before the shuffle."""
    return df.groupBy(*key).agg(F.max(F.struct(order, *values)).alias("_l")).select(*key, *(F.col(f"_l.{v}") for v in values))


def span_ms(start: Column, end: Column) -> Column:
    """end - start, or -1 (not measured) where it is unknown or negative."""
    return F.when(end >= start, end - start).otherwise(F.lit(-1))


def paid_requests(requests: DataFrame, connections: DataFrame, lookups: DataFrame) -> DataFrame:
    """requests with the columns of their connection and lookup, pays_connect and pays_dns, and dns, connect, ssl, wait, receive, total_ms.

    dns, connect and ssl are paid by the first request of a lookup or connection only. requests: page, req, conn, dns_id, start, first_data, end;
    connections: conn, c_start, c_end, tls_start; lookups: dns_id, d_start, d_end. All times in ms; wait and receive are never negative.
    """
    owned = first_claim(first_claim(requests, ["page", "conn"], ["start", "req"], "pays_connect"), ["page", "dns_id"], ["start", "req"], "pays_dns")
    all_ = owned.join(connections, "conn", "left").join(lookups, "dns_id", "left")
    first = F.when(F.col("first_data") > 0, F.col("first_data")).otherwise(F.col("end"))
    connect = F.when(F.col("pays_connect"), span_ms(F.col("c_start"), F.col("c_end"))).otherwise(-1)
    ssl = F.when(F.col("pays_connect") & F.col("tls_start").isNotNull(), F.greatest(F.lit(0), F.col("c_end") - F.col("tls_start"))).otherwise(-1)
    dns = F.when(F.col("pays_dns"), span_ms(F.col("d_start"), F.col("d_end"))).otherwise(-1)
    wait, receive = F.greatest(F.lit(0), first - F.col("start")), F.greatest(F.lit(0), F.col("end") - first)
    total = F.greatest(F.lit(0), dns) + F.greatest(F.lit(0), connect) + wait + receive
    return all_.withColumns({n: c.cast("long") for n, c in (("dns", dns), ("connect", connect), ("ssl", ssl), ("wait", wait), ("receive", receive), ("total_ms", total))})


def request_timings(requests: DataFrame, connections: DataFrame, lookups: DataFrame) -> DataFrame:
    """page, req and the phases of each request, as paid_requests() has them."""
    return paid_requests(requests, connections, lookups).select("page", "req", "dns", "connect", "ssl", "wait", "receive", "total_ms")


def enrich_last_wins(rows: DataFrame, other: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """rows with the values of the last row of ``other`` that has their key; what rows have already stays."""
    last = last_per(other, [key], order, values)
    both = rows.join(last.withColumnsRenamed({v: f"_o_{v}" for v in values}), key, "left")
    filled = {v: F.coalesce(F.col(v), F.col(f"_o_{v}")) if v in rows.columns else F.col(f"_o_{v}") for v in values}
    return both.withColumns(filled).drop(*(f"_o_{v}" for v in values))


def union_unmatched(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows and those of ``other`` whose key rows lack."""
    return rows.unionByName(other.join(rows.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def ancestry(edges: DataFrame, child: str, parent: str, hops: int = 16) -> DataFrame:
    """child, root, depth: the chain of parents of each child, doubling the reach of a hop in every round.

    A chain longer than ``hops``, or a cycle, ends where the rounds end. Each round is written, so that a plan holds
    one join only.
    """
    up = edges.select(F.col(child).alias("c"), F.col(parent).alias("p"), F.lit(1).alias("d"))
    reach = 1
    while reach < hops:
        above = up.select(F.col("c").alias("c2"), F.col("p").alias("p2"), F.col("d").alias("d2"))
        up = written(up.join(above, up["p"] == above["c2"], "left").select("c", F.coalesce("p2", "p").alias("p"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
        reach *= 2
    return up.select(F.col("c").alias("child"), F.col("p").alias("root"), F.col("d").cast("int").alias("depth"))


def set_compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on either side only, on both, and the share of the left side that the right one has."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    sums = both.agg(n(l & ~r).alias("left_only"), n(r & ~l).alias("right_only"), n(l & r).alias("in_both"))
    return sums.withColumn("overlap_pct", F.floor(F.col("in_both") * 1000 / F.greatest(F.col("left_only") + F.col("in_both"), F.lit(1)) + 0.5).cast("long"))
