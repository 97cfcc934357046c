"""Sharding by k-d tree partitioning, in DataFrame operations only.

The rows' metadata (size, characters, language) spans the dimensions. A node is split at the weighted median
of its widest dimension, weights being bytes; ties on the dimension are ordered by a hash of the text and then of the
id, so that equal texts stay side by side and a large group of them can still be cut. The medians of all nodes of a level
are found by narrowing histograms that all tasks fill together, one job for each narrowing; cuts are a small table that rows
are joined with, and the driver sees a few numbers for each node. Splitting goes on until a leaf has reached the target bytes; beyond MAX_LEAVES leaves are cut at equal sums of bytes in the order of the dimensions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import Work, text_or_empty

#: Bins of a histogram of a node, and the share of a node's bytes that a cut may be off.
BINS, SLACK = 4096, 0.0005
#: Nodes that the driver keeps at most; where more leaves are asked for, these are cut further without it.
MAX_LEAVES = 4096
#: Rows that are numbered in one task, about.
BLOCK_ROWS = 20_000
#: Keys that order the rows of a node after the dimension itself; they lie in 0 .. 2^52 - 1.
TIES = ("text_hash", "row_hash")
#: Levels after which the rows are written with their nodes.
WRITE_EVERY = 4


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of a row for each node, as one literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ", ".join(c.replace(" ", ":", 1) for c in schema.split(", ")) + ">>"
    return F.broadcast(spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("r")).select("r.*"))


def _spans(rows: DataFrame, dims: list[str]) -> dict[int, dict]:
    found = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{d}_{n}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    return {r["node"]: r.asDict() for r in found.collect()}  # at most MAX_LEAVES rows


def weighted_medians(rows: DataFrame, dims: list[str], spans: dict[int, dict], column: dict[int, int]) -> list[tuple]:
    """(node, column, c0, c1, c2) for each node: rows whose (column, *TIES) is at most (c0, c1, c2) hold half of its bytes.

    A node looks for its cut within a range of one key, first its column, then, within a single value of it, the ties.
    Each pass bins what is left of every node's range and keeps the bin in which the goal lies, until that bin is light
    enough or one value. A cut is off by SLACK of the bytes, or by the rows that are equal in all keys.
    """
    most, last = (1 << 52) - 1, len(TIES)
    left = {
        n: {"node": n, "col": column[n], "stage": 0, "lo": s[f"{dims[column[n]]}_lo"], "hi": s[f"{dims[column[n]]}_hi"], "goal": s["bytes"] / 2, "t0": 0, "t1": 0, "slack": s["bytes"] * SLACK}
        for n, s in spans.items()
    }
    schema = "node int, col int, stage int, lo long, hi long, goal double, t0 long, t1 long, slack double"
    done = []
    while left:
        asked = _listed(rows.sparkSession, [tuple(x.values()) for x in left.values()], schema)
        own = F.get(F.array(*dims), F.col("col"))
        v = F.when(F.col("stage") == 0, own).when(F.col("stage") == 1, F.col(TIES[0])).otherwise(F.col(TIES[1]))
        tied = ((F.col("stage") == 0) | (own == F.col("t0"))) & ((F.col("stage") < 2) | (F.col(TIES[0]) == F.col("t1")))
        mine = rows.join(asked, "node").withColumn("v", v).filter(tied & F.col("v").between(F.col("lo"), F.col("hi")))
        place = F.floor((F.col("v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo") + 1) * BINS)
        bins = mine.groupBy("node", "goal", place.alias("bin")).agg(F.sum("size").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        for r in bins.withColumn("upto", upto).filter("upto >= goal and upto - w < goal").collect():  # a row for each node
            x = left[r["node"]]
            before, over = x["goal"] - (r["upto"] - r["w"]), r["upto"] - x["goal"]
            if r["a"] == r["b"] and min(before, over) > x["slack"] and x["stage"] < last:
                x |= {("t0", "t1")[x["stage"]]: r["a"], "stage": x["stage"] + 1, "lo": 0, "hi": most, "goal": before}
            elif r["a"] == r["b"] or r["w"] <= x["slack"]:
                cut = [x["t0"], x["t1"], most]
                cut[x["stage"]] = r["b"] if over <= before else r["a"] - 1
                cut[x["stage"] + 1 :] = [most] * (last - x["stage"])
                done.append((x["node"], x["col"], *cut))
                del left[r["node"]]
            else:
                x |= {"lo": r["a"], "hi": r["b"], "goal": before}
    return done


def kd_leaves(rows: DataFrame, dims: list[str], leaves: int, work: Work | None = None) -> DataFrame:
    """rows with ``node``, their leaf from 0 on. rows: size, the dims (long) and the tie keys; ``leaves`` a power of two."""
    rows, whole = rows.withColumn("node", F.lit(0)), {}
    for level in range(max(0, leaves - 1).bit_length()):
        spans = _spans(rows, dims)
        if not whole and spans:
            top = next(iter(spans.values()))
            whole = {d: float(top[f"{d}_hi"] - top[f"{d}_lo"]) for d in dims}
        wide = lambda s, d: (s[f"{d}_hi"] - s[f"{d}_lo"]) / whole[d] if whole[d] else 0.0
        column = {n: max(range(len(dims)), key=lambda i: (wide(s, dims[i]), -i)) for n, s in spans.items()}
        cuts = _listed(rows.sparkSession, weighted_medians(rows, dims, spans, column), "node int, col int, c0 long, c1 long, c2 long")
        own, (first, second) = F.get(F.array(*dims), F.col("col")), TIES
        after = (F.col(first) > F.col("c1")) | ((F.col(first) == F.col("c1")) & (F.col(second) > F.col("c2")))
        right = (own > F.col("c0")) | ((own == F.col("c0")) & after)
        rows = rows.join(cuts, "node", "left").withColumn("node", F.col("node") * 2 + right.cast("int")).drop("col", "c0", "c1", "c2")
        if work and level % WRITE_EVERY == WRITE_EVERY - 1:
            rows = work.table(rows, "nodes")
    return rows


def cut_leaves(rows: DataFrame, dims: list[str], parts: int) -> DataFrame:
    """rows with each ``node`` cut into ``parts`` of near equal bytes, in the order of the dims and the tie keys; rows that are equal in all stay together."""
    upto = F.sum("size").over(Window.partitionBy("node").orderBy(*dims, *TIES).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    told = rows.withColumn("_upto", upto).withColumn("_whole", F.sum("size").over(Window.partitionBy("node")))
    return told.withColumn("node", F.expr(f"node * {parts}L + (_upto * {parts}L - 1) div _whole")).drop("_upto", "_whole")


def number_rows(rows: DataFrame, shard: str, order: list[str], total: int) -> DataFrame:
    """rows with ``slot``: gapless from 0 in each shard, numbered in blocks, so that no task holds a whole shard."""
    blocks = max(8, -(-total // BLOCK_ROWS))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    sizes = rows.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inner = F.row_number().over(Window.partitionBy(shard, "_block").orderBy(*order)) - 1
    return rows.withColumn("_in", inner).join(starts, [shard, "_block"]).withColumn("slot", F.col("_from") + F.col("_in")).drop("_block", "_in", "_from")


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("n_chars", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Leaves have near equal bytes; their number is ``shards`` or follows ``target_bytes``.

    A null text has no bytes, but each row counts one more. Metadata columns that docs lacks are left out; other columns are not read;
    strings are ordered by a hash. Null ids are rows like others and come first among equal places; a text of any length is one row, however
    much of a shard it fills; ties are ordered by hashes of text and row. Rows that repeat another fully stay together. An empty table gives an empty result.
    """
    spark, has = docs.sparkSession, {f.name: f.dataType.simpleString() for f in docs.schema}
    text = text_or_empty(text_col)
    numeric = ("bigint", "int", "smallint", "tinyint")
    dims = {"size_dim": F.octet_length(text).cast("long")}
    for m in metadata:
        if m in has:
            dims[f"{m}_dim"] = F.coalesce(F.col(m).cast("long") if has[m] in numeric else F.pmod(F.xxhash64(m), F.lit(1 << 20)), F.lit(-1)).cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 12).alias("text_hash"),
        F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(id_col), text), 12).alias("row_hash"),
        *[c.alias(k) for k, c in dims.items()],
    )
    work = Work(spark)
    rows = work.table(rows.withColumn("row", F.monotonically_increasing_id()), "metadata")  # tells rows apart that repeat
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = 1
    if target_bytes:
        shards = 1
        while size / (shards * parts) > target_bytes:
            shards, parts = (shards * 2, parts) if shards < MAX_LEAVES else (shards, parts * 2)
    leaves = kd_leaves(rows, list(dims), shards or 1, work)
    if parts > 1:
        leaves = cut_leaves(leaves, list(dims), parts)
    done = number_rows(leaves.withColumnRenamed("node", "shard"), "shard", ["doc_id", "text_crc32", "row_hash", "row"], count)
    return done.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
