"""Views of general tables as spans, requests, chunks and urls, for running the operators on any star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, i, st, du, en, kind, props: timed spans of threads or pages, from events."""
    st, du = epoch_us("ts"), F.floor(F.col("value") * 60000000).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("i"), st.alias("st"), du.alias("du"), (st + du).alias("en"), F.col("event_type").alias("kind"), "props")


SPANS = """v AS (SELECT user_id AS u, event_id AS i, epoch_us(ts) AS st, CAST(floor(value * 60000000) AS BIGINT) AS du,
    epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS en, event_type AS kind, props FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req, page, conn, start (ms), status, priority, total: requests of pages over connections, from orders."""
    status = F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 304).otherwise(404)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("req"),
        (F.col("o_custkey") % 100).alias("page"),
        F.col("o_custkey").alias("conn"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) div 1000").alias("start"),
        status.alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total"),
    )


REQUESTS = """r AS (SELECT o_orderkey AS req, o_custkey % 100 AS page, o_custkey AS conn, epoch_us(o_orderdate) // 1000 AS start,
    CASE o_orderstatus WHEN 'F' THEN 200 WHEN 'O' THEN 304 ELSE 404 END AS status, o_orderpriority AS priority, o_totalprice AS total FROM orders)"""

#: lineitem has no key: this order is total.
_ORDER = ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


#: Chunks in a task that puts them in order, about.
_ROWS = 100_000


def chunks(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """req, seq, ts (us), bytes, inflated, line: chunks of response bodies, from lineitem; without seq unless they are numbered.

    Numbered chunks are dealt by req once, into tasks of about _ROWS rows however many there are; what follows by req stays there.
    """
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "req")
    if numbered:  # the count comes from the footers of the files
        rows = rows.repartition(1 + rows.count() // _ROWS, "req")
    seq = [F.row_number().over(Window.partitionBy("req").orderBy(*_ORDER)).cast("long").alias("seq")] if numbered else []
    return rows.select(
        "req",
        *seq,
        epoch_us("l_shipdate").alias("ts"),
        (F.col("l_quantity") * 100).cast("long").alias("bytes"),
        F.floor("l_extendedprice").cast("long").alias("inflated"),
        F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("flag"),
    )


CHUNKS = f"""c AS (SELECT l_orderkey AS req, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS seq,
    epoch_us(l_shipdate) AS ts, CAST(l_quantity * 100 AS BIGINT) AS bytes, CAST(floor(l_extendedprice) AS BIGINT) AS inflated,
    l_linenumber AS line, l_returnflag AS flag FROM lineitem)"""
