"""Ordered rows: running segments, chunk arithmetic, throughput and reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, by: str, order: list[str], begins: Column, out: str = "segment") -> DataFrame:
    """Number each row by how many rows that begin a segment come before it or are it: redirects, connection generations."""
    return df.withColumn(out, F.sum(F.when(begins, 1).otherwise(0)).over(Window.partitionBy(by).orderBy(*order)))


def generations(df: DataFrame, by: str, order: list[str], opens: Column, closes: Column, out: str = "generation") -> DataFrame:
    """A new generation begins where a row opens after one that closed since the last opening."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = df.withColumn("_closed", F.sum(F.when(closes, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    last = F.last(F.when(opens, F.col("_closed")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_new", F.when(opens & (F.coalesce("_closed", F.lit(0)) > F.coalesce(last, F.lit(0))), 1).otherwise(0))
    return marked.withColumn(out, F.sum("_new").over(w)).drop("_closed", "_new")


def first_last(df: DataFrame, by: str, order: str, value: str, first: Column, last: Column) -> DataFrame:
    """by, first_value, last_value: first and last write, each among the rows it holds for."""
    return df.groupBy(by).agg(F.min_by(value, F.when(first, F.col(order))).alias("first_value"), F.max_by(value, F.when(last, F.col(order))).alias("last_value"))


def attach_to_previous(df: DataFrame, by: str, order: str, is_raw: Column, value: str) -> DataFrame:
    """The raw rows, each with the value of the last filtered row that follows it before the next raw one."""
    numbered = segments(df.withColumn("_raw", is_raw), by, [order], F.col("_raw"), "_s").filter("_s > 0")
    fold = numbered.groupBy(by, "_s").agg(F.min(order).alias(order), F.min_by(value, order).alias(value), F.max_by(value, F.when(~F.col("_raw"), F.col(order))).alias("inflated"))
    return fold.select(by, order, value, "inflated")


def chunk_deltas(df: DataFrame, by: str, order: list[str], ts: str, start: Column) -> DataFrame:
    """Time since the previous chunk, for the first one since ``start``."""
    return df.withColumn("delta", F.col(ts) - F.coalesce(F.lag(ts).over(Window.partitionBy(by).orderBy(*order)), start))


def body_slices(df: DataFrame, by: str, order: str, size: str, total: Column) -> DataFrame:
    """from_byte, to_byte of each chunk in a body of ``total`` bytes: overlong tails are clamped, the last chunk takes the rest."""
    upto = F.sum(size).over(Window.partitionBy(by).orderBy(order))
    last = F.lead(order).over(Window.partitionBy(by).orderBy(order)).isNull()
    begin, end = F.least(upto - F.col(size), total), F.when(last, total).otherwise(F.least(upto, total))
    return df.withColumns({"from_byte": begin.cast("long"), "to_byte": end.cast("long")})


def throughput(df: DataFrame, by: list[str], ts_us: str, size: str, trail_us: int, least_us: int = 1000) -> DataFrame:
    """by, peak_kbps: the greatest bytes over elapsed time of the trailing windows that took longer than ``least_us``."""
    w = Window.partitionBy(*by).orderBy(ts_us).rangeBetween(-trail_us, 0)
    framed = df.select(*by, ts_us, F.sum(size).over(w).alias("b"), (F.col(ts_us) - F.min(ts_us).over(w)).alias("us")).filter(F.col("us") > least_us)
    return framed.groupBy(*by).agg(F.max(F.floor(F.col("b") * 8000 / F.col("us") + 0.5)).cast("long").alias("peak_kbps"))


def unwrapped(df: DataFrame, by: str, order: list[str], seq: str, bits: int = 32) -> DataFrame:
    """df with ``seq``, a counter of so many bits, as a number that goes on beyond a wrap: each is the nearest to the one before."""
    w, half, whole = Window.partitionBy(by).orderBy(*order), 1 << (bits - 1), 1 << bits
    step = F.pmod(F.col(seq) - F.lag(seq).over(w) + half, F.lit(whole)) - half
    return df.withColumn("_step", F.coalesce(step, F.col(seq))).withColumn(seq, F.sum("_step").over(w)).drop("_step")


def reassembly(df: DataFrame, flow: str, order: list[str], seq: str, size: str) -> DataFrame:
    """Statistics of a flow's segments: packets, duplicates, out of order, new and repeated bytes.

    A segment whose end was seen is a duplicate; one that begins beyond the greatest end leaves a hole; what was seen
    of an overlapping one is cut off.
    """
    before = Window.partitionBy(flow).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col(seq) + F.col(size)
    seen = df.withColumn("_end", end).withColumn("_top", F.max("_end").over(before))
    dup = F.col("_top").isNotNull() & (F.col("_end") <= F.col("_top"))
    fresh = F.when(F.col("_top").isNull(), F.col(size)).otherwise(F.greatest(F.lit(0), F.col("_end") - F.greatest(F.col("_top"), F.col(seq))))
    return seen.groupBy(flow).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count(F.when(dup, 1)).alias("duplicates"),
        F.count(F.when(F.col("_top").isNotNull() & (F.col(seq) > F.col("_top")), 1)).alias("holes"),
        F.sum(fresh).cast("long").alias("new_bytes"),
        F.sum(F.col(size) - fresh).cast("long").alias("repeated_bytes"),
    )


def carry_back(values: Column, limit: Column, kind: str = "bigint") -> Column:
    """An array walked from its end: what exceeds the limit moves to the sample before; what is left at the head becomes
    new samples before it."""
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(0).cast(kind).alias("carry"))
    step = lambda s, v: F.struct(F.concat(F.array(F.least(v + s["carry"], limit)), s["out"]).alias("out"), F.greatest(F.lit(0), v + s["carry"] - limit).cast(kind).alias("carry"))
    walked = F.aggregate(F.reverse(values), start, step)
    whole, rest = F.floor(walked["carry"] / limit).cast("int"), (walked["carry"] % limit).cast(kind)
    head = F.concat(F.when(rest > 0, F.array(rest)).otherwise(F.array().cast(f"array<{kind}>")), F.array_repeat(limit.cast(kind), whole))
    return F.concat(head, walked["out"])
