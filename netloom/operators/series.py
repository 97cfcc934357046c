"""Series over time: clocks made of deltas, step functions, unit repair and low-pass sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_clock(df: DataFrame, by: str, order: str, absolute: str, delta: str, packet: str, out: str = "clock") -> DataFrame:
    """df with the time of each event of a sequence: the last absolute time before it plus all deltas since.

    Where no absolute time came before, or it was 0, the sequence starts from the time of the packet of the first event
    that tells one or moves the clock. A null absolute time or delta is not told; a delta beside an absolute time has no effect.
    """
    run = Window.partitionBy(by).orderBy(order)
    marked = df.withColumn("_reset", F.sum(F.col(absolute).isNotNull().cast("int")).over(run))
    here = Window.partitionBy(by, "_reset").orderBy(order)
    moves = F.col(absolute).isNull() & ((F.coalesce(packet, F.lit(0)) > 0) | (F.coalesce(delta, F.lit(0)) != 0))
    given = F.coalesce(F.first(absolute).over(here), F.lit(0))
    packet_base = F.first(F.when(moves, F.greatest(F.coalesce(packet, F.lit(0)), F.lit(0))), ignorenulls=True).over(here)
    since = F.sum(F.when(F.col(absolute).isNull(), F.coalesce(delta, F.lit(0))).otherwise(0)).over(here)
    base = F.when(given != 0, given).otherwise(F.coalesce(packet_base, F.lit(0)))
    return marked.withColumn(out, base + since).drop("_reset")


def repair_unit(t: Column, page_start_ms: Column, max_ms: Column) -> Column:
    """Milliseconds since the start of the page of a sample's time, which may be in us or s or ms, since 1970 or the page's start."""
    ms = F.when(t > 1e15, t / 1000).otherwise(t)
    ms = F.when((ms > 1e9) & (ms < 1e12), ms * 1000).otherwise(ms)
    since = F.when(ms > 1e12, ms - page_start_ms).otherwise(ms)
    return F.when(since > max_ms * 50, since / 1000).otherwise(since)


def steps(df: DataFrame, by: str, order: list[str], x: str, value: str) -> DataFrame:
    """by, x0, x1, value: each sample's value holds from the sample before it; the first is a point."""
    before = F.lag(x).over(Window.partitionBy(by).orderBy(*order))
    return df.select(by, F.coalesce(before, x).alias("x0"), F.col(x).alias("x1"), value)


def smooth_slices(df: DataFrame, keys: list[str], index: str, value: str, width_us: int, count: int, pixels: int, per_pixel: float, skip: float = 0.0) -> DataFrame:
    """keys, pixel, share: busy share around each pixel from the values (us) of equal slices 0 to count - 1.

    A pixel spans ``per_pixel`` slices; ``skip`` slices lie before the first one. The window around its centre is a
    pixel or two slices wide, whichever is more, and slices count by the part that lies in it. Each slice is sent to the
    few pixels whose window it meets, and partial sums are combined before they move. Pixels without work have no row.
    """
    half = max(per_pixel, 2.0) / 2
    i, inside = F.col(index), (F.col(index) >= 0) & (F.col(index) < count) & (F.col(value) != 0)
    low = F.greatest(F.lit(0), F.floor((i - half - skip) / per_pixel - 0.5)).cast("int")
    high = F.least(F.lit(pixels), F.ceil((i + 1 + half - skip) / per_pixel - 0.5)).cast("int")
    met = df.filter(inside & (low <= high)).withColumn("pixel", F.explode(F.sequence(low, high)))
    centre = F.lit(skip) + (F.col("pixel") + 0.5) * per_pixel
    start, end = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(float(count)), centre + half)
    met = met.withColumn("_s", start).withColumn("_e", end).withColumn("_part", F.least(i + 1, F.col("_e")) - F.greatest(i, F.col("_s")))
    done = met.filter("_part > 0").groupBy(*keys, "pixel", "_s", "_e").agg(F.sum(F.col(value) * F.col("_part")).alias("_work")).filter("_work > 0")
    return done.select(*keys, "pixel", (F.col("_work") / ((F.col("_e") - F.col("_s")) * width_us)).alias("share"))


def page_document(requests: DataFrame, page: str, order: list[str], is_document: Column, *values: str) -> DataFrame:
    """One row per page: values of its first request that is a document, or else of its first one."""
    first = F.min(F.struct(F.when(is_document, 0).otherwise(1).alias("_r"), *order, *[F.col(v).alias(f"_{v}") for v in values]))
    return requests.groupBy(page).agg(first.alias("d")).select(page, *[F.col(f"d._{v}").alias(v) for v in values])


def pair_by_ordinal(df: DataFrame, by: str, order: list[str], is_request: Column, value: str) -> DataFrame:
    """by, ordinal, request, response: the n-th request of a connection with its n-th response, which may be missing."""
    n = F.row_number().over(Window.partitionBy(by, "_q").orderBy(*order))
    ranked = df.withColumn("_q", is_request).withColumn("ordinal", n.cast("long"))
    both = ranked.groupBy(by, "ordinal").agg(F.max(F.when(F.col("_q"), F.col(value))).alias("request"), F.max(F.when(~F.col("_q"), F.col(value))).alias("response"))
    return both.filter("request is not null")


def drop_medians(pages: DataFrame, capture: str, is_median: Column) -> DataFrame:
    """pages without the medians of captures that hold real runs."""
    real = F.max((~is_median).cast("int")).over(Window.partitionBy(capture))
    return pages.withColumn("_real", real).filter(~is_median | (F.col("_real") == 0)).drop("_real")


def search(history: DataFrame, text: str, columns: list[str], sort: list[Column], page: int, size: int) -> DataFrame:
    """Page ``page`` (from 1) of the rows that contain text in one of the columns, whatever its case."""
    wanted = text.lower()
    hit = F.lit(not wanted)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(wanted)), F.lit(False))
    return history.filter(hit).orderBy(*sort).offset((page - 1) * size).limit(size)
