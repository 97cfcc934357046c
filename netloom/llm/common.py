"""What the corpus operators share: the shared work folder, written tables and filtered joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words; fixed by the contracts of the operators.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of the rows that cross to Python at once, and the session's setting of them.
BATCH_BYTES, _BATCH_BYTES = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Places of a filter of keys, and those of one of its bitmaps (what bitmap_construct_agg holds).
FILTER_BITS, BUCKET_BITS = 1 << 27, 1 << 15


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a local master gets a temporary folder; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Work:
    """Tables written once in the shared folder, so that a lost executor never costs more than one step."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._n, self._paths = spark, shared_folder(spark), 0, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as Parquet and return a scan of it; the scan's size is known to the planner."""
        self._n += 1
        path = f"{self.folder}/{self._n:02d}-{name}"
        df.write.parquet(path)
        self._paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, but: str | None = None) -> None:
        """Delete the tables of these names, or all but those of one name; nothing may read them any more."""
        for name in names or [n for n in self._paths if n != but]:
            for path in self._paths.pop(name, ()):
                delete(self.spark, path)


def parted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that may have a key of ``wanted``, and those that have none: a join need only shuffle the former.

    Keys are hashes (long). The filter is a bitmap of FILTER_BITS places, in buckets that are broadcast: 16 MB at most,
    whatever the number of keys. The more keys there are, the more rows pass it in vain; none is ever missed.
    """
    place = lambda k: F.pmod(k, F.lit(FILTER_BITS))
    keys = wanted.select(place(wanted_key).alias("_k")).select(F.expr(f"cast(_k div {BUCKET_BITS} as int)").alias("_bucket"), (F.col("_k") % BUCKET_BITS).alias("_bit"))
    bitmaps = F.broadcast(keys.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap")))
    told = rows.withColumn("_k", place(key)).join(bitmaps, F.expr(f"cast(_k div {BUCKET_BITS} as int)") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bitmap, cast(_k % {BUCKET_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (F.col("_k") % 8).cast("int")) == 1, F.lit(False))
    return told.filter(may).select(*rows.columns), told.filter(~may).select(*rows.columns)


def short_batches(spark: SparkSession) -> None:
    """Let whole texts cross to Python a few MB at a time, where the session still has Spark's own 64 MB.

    A batch is held several times: in buffers of the JVM, and in each worker next to the one before it.
    """
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
