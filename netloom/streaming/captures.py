"""Captures that still grow: the same questions over streams, with watermarks for what comes late.

Every function takes a batch table too, and then gives the rows that the stream has emitted when all its watermarks
have passed. State holds only windows, sessions or unanswered rows that the watermark has not passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def follow(spark: SparkSession, folder: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, at most ``files`` of them a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def _totals(size: str) -> list[Column]:
    return [F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("chunks")]


def windowed_totals(rows: DataFrame, by: list[str], ts: str, size: str, width: str = "100 milliseconds", slide: str | None = None, late: str = "10 seconds") -> DataFrame:
    """by, begin, end, bytes, chunks for each window of ``width`` (sliding by ``slide``, if given); later rows are left out."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    done = rows.withWatermark(ts, late).groupBy(*by, span.alias("_w")).agg(*_totals(size))
    return done.select(*by, F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "bytes", "chunks")


def connection_sessions(rows: DataFrame, by: list[str], ts: str, size: str, idle: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """by, begin, end, bytes, chunks for each stretch of a connection without a pause of ``idle``; end is when that pause is over."""
    done = rows.withWatermark(ts, late).groupBy(*by, F.session_window(ts, idle).alias("_w")).agg(*_totals(size))
    return done.select(*by, F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "bytes", "chunks")


def answered(asked: DataFrame, answers: DataFrame, by: list[str], ts: str, within: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Each asked row with the answers of the same key that come ``within`` that time, or once with a null ``answered_at``.

    Key columns must not be null; a row with a null key stays unanswered. Both sides hold by and ``ts``.
    """
    names = {c: f"_{c}" for c in by}
    left = asked.withWatermark(ts, late)
    right = answers.select(*(F.col(c).alias(n) for c, n in names.items()), F.col(ts).alias("answered_at")).withWatermark("answered_at", late)
    same = F.expr(" and ".join(f"`{c}` = `{n}`" for c, n in names.items()))
    timely = (F.col("answered_at") >= F.col(ts)) & (F.col("answered_at") <= F.col(ts) + F.expr(f"interval {within}"))
    return left.join(right, same & timely, "left").drop(*names.values())
