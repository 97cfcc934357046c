"""Intervals in time: coalescing, gaps, containment, claims and as-of pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_intervals(df: DataFrame, by: str, start: str, end: str, tie: str, touch: bool = True) -> DataFrame:
    """by, start, end, n: the union of overlapping intervals; ``touch``: those that only meet are one, too."""
    before = Window.partitionBy(by).orderBy(start, end, tie).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.max(end).over(before)
    fresh = F.when(upto.isNull() | ((F.col(start) > upto) if touch else (F.col(start) >= upto)), 1).otherwise(0)
    island = F.sum("_new").over(Window.partitionBy(by).orderBy(start, end, tie))
    marked = df.withColumn("_new", fresh).withColumn("_k", island)
    return marked.groupBy(by, "_k").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_k")


def long_tasks(df: DataFrame, by: str, start: str, end: str, tie: str, least_us: int = 50_000) -> DataFrame:
    """by, start_ms, end_ms, n: tasks longer than ``least_us``, widened to whole ms and coalesced."""
    ms = df.filter(F.col(end) - F.col(start) > least_us).select(by, F.expr(f"{start} div 1000").alias("s"), F.expr(f"({end} + 999) div 1000").alias("e"), tie)
    return coalesce_intervals(ms, by, "s", "e", tie, touch=False).select(by, F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n")


def merged_long_tasks(tasks: DataFrame, toplevel: DataFrame, by: str, start: str, end: str, least_us: int = 50_000) -> DataFrame:
    """by, start_ms, end_ms, n: tasks that took longer than ``least_us`` and toplevel ones that took as long or longer, widened to whole ms and coalesced.

    Tasks that only meet stay apart, unless their ``by`` has toplevel ones.
    """
    ms = lambda df, top: df.select(by, F.expr(f"{start} div 1000").alias("s"), F.expr(f"({end} + 999) div 1000").alias("e"), F.lit(top).alias("_top"))
    took = F.col(end) - F.col(start)
    both = ms(tasks.filter(took > least_us), False).unionByName(ms(toplevel.filter(took >= least_us), True))
    both = both.join(both.groupBy(by).agg(F.max("_top").alias("_any")), by)
    order = Window.partitionBy(by).orderBy("s", "e", "_top")
    upto = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = upto.isNull() | (F.col("s") > upto) | (~F.col("_any") & (F.col("s") == upto))
    marked = both.withColumn("_new", F.when(apart, 1).otherwise(0)).withColumn("_k", F.sum("_new").over(order))
    return marked.groupBy(by, "_k").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("_k")


def gaps(tasks: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """by, gap_start, gap_end: what disjoint intervals leave between them."""
    last = F.lag(end).over(Window.partitionBy(by).orderBy(start))
    return tasks.select(by, last.alias("gap_start"), F.col(start).alias("gap_end")).filter("gap_start is not null and gap_start < gap_end")


def drop_contained(df: DataFrame, by: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Rows that no earlier row of the same ``by`` contains: a running maximum instead of a join."""
    before = Window.partitionBy(*by).orderBy(F.col(start), F.col(end).desc(), F.col(tie)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", F.max(end).over(before)).filter(F.col("_m").isNull() | (F.col("_m") < F.col(end))).drop("_m")


def claim_lookups(claims: DataFrame, lookups: DataFrame, host: str) -> DataFrame:
    """For each host's one claim (host, bound), the lookup (host, l_id, l_start, l_end) that ran longest before it.

    Its end is clipped to the claim; lookups that begin after it do not fit, and ties go to the first lookup.
    """
    both = claims.join(lookups, host).withColumn("clipped", F.least("l_end", F.coalesce("bound", "l_end")))
    fit = both.withColumn("took", F.col("clipped") - F.col("l_start")).filter("took >= 0")
    best = fit.groupBy(host).agg(F.max(F.struct("took", (-F.col("l_start")).alias("s"), (-F.col("l_id")).alias("i"), "clipped", "claim")).alias("b"))
    return best.select(host, F.col("b.claim").alias("claim"), (-F.col("b.i")).alias("l_id"), (-F.col("b.s")).alias("l_start"), F.col("b.clipped").alias("l_end"))


def pair_asof(df: DataFrame, by: str, order: list[str], kind: str, request: str, response: str, value: str) -> DataFrame:
    """by, response, request: each response takes the last request before it, unless another response took it already."""
    w = Window.partitionBy(by).orderBy(*order)
    seen = df.filter(F.col(kind).isin(request, response)).withColumn("_prev", F.lag(F.struct(kind, value)).over(w))
    return seen.filter((F.col(kind) == response) & (F.col(f"_prev.{kind}") == request)).select(by, F.col(value).alias("response"), F.col(f"_prev.{value}").alias("request"))
