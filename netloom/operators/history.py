"""A history of opened captures as a Parquet table of versions: entries are put, updated, deleted, listed and searched.

Nothing is changed in place. Each write adds a batch of versions; what holds is folded from them when it is read. A
compaction writes what holds as one batch that stands for all before it, which then need not be read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.series import search

PUT, UPDATE, DELETE = "put", "update", "delete"
_OWN = {"_op": "string", "_whole": "boolean"}


def fold(versions: DataFrame, key: str, version: str, op: str, values: list[str]) -> DataFrame:
    """key, values: what holds after all versions of each key, in their order.

    A put sets all values, an update those that it tells (not null), a delete takes the entry away. What comes before the last
    put or delete does not count; updates without an entry do nothing. Versions of a key are told apart by ``version``.
    """
    whole = F.max(F.struct(F.when(F.col(op) != UPDATE, F.col(version)).alias("v"), op))
    last = versions.filter(F.col(op) != UPDATE).groupBy(key).agg(whole.alias("_w")).filter(F.col(f"_w.{op}") == PUT).select(F.col(key).alias("_k"), F.col("_w.v").alias("_from"))
    rows = versions.join(last, (F.col(key) == F.col("_k")) & (F.col(version) >= F.col("_from")))
    told = [F.max_by(F.struct(v), F.when((F.col(op) == PUT) | F.col(v).isNotNull(), F.col(version))).alias(v) for v in values]
    return rows.groupBy(key).agg(*told).select(key, *[F.col(f"{v}.{v}").alias(v) for v in values])


class History:
    """A table of versions in a folder that all executors share. One writer at a time; readers see whole batches.

    schema: the values of an entry, as a dict of names to types; entries go by ``key``, a text.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: dict[str, str], key: str = "id"):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key

    def _batches(self) -> list[int]:
        """Numbers of the batches that were written whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=") and done(s))

    def _write(self, rows: DataFrame, op: str, whole: bool = False) -> None:
        """Rows that repeat a key within one write count once, as one of them."""
        kinds = {self.key: "string"} | self.schema
        told = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
        told = told.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        number = 1 + max(self._batches(), default=0)
        told.withColumns({"_op": F.lit(op), "_whole": F.lit(whole)}).write.mode("overwrite").parquet(f"{self.folder}/batch={number:06d}")

    def put(self, entries: DataFrame) -> None:
        self._write(entries, PUT)

    def update(self, entries: DataFrame) -> None:
        """Change the values that are not null of entries that exist."""
        self._write(entries, UPDATE)

    def delete(self, keys: DataFrame) -> None:
        self._write(keys, DELETE)

    def entries(self) -> DataFrame:
        """What holds: key and values, of the batches from the last compaction on."""
        kinds = ", ".join(f"`{n}` {t}" for n, t in ({self.key: "string"} | self.schema | _OWN).items())
        batches = self._batches()
        read = lambda n: self.spark.read.schema(kinds).parquet(f"{self.folder}/batch={n:06d}")
        # a compaction marks all its rows; an empty one leaves nothing to read either way
        last = next((i for i in reversed(range(len(batches))) if read(batches[i]).filter("_whole").limit(1).count()), 0)
        parts = [read(n).withColumn("_batch", F.lit(n)) for n in batches[last:]]
        if not parts:
            return self.spark.createDataFrame([], kinds).select(self.key, *self.schema)
        return fold(reduce(DataFrame.unionByName, parts), self.key, "_batch", "_op", list(self.schema))

    def compact(self) -> None:
        self._write(self.entries(), PUT, whole=True)

    def page(self, text: str, columns: list[str], sort: list[Column], page: int, size: int) -> DataFrame:
        """Page ``page`` (from 1) of the entries that contain text in one of the columns."""
        return search(self.entries(), text, columns, sort, page, size)
