"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

A frequent-items summary (the Misra-Gries family, ``approx_top_k_*``) names the digests that may hold a large share
of the rows. Their groups are counted exactly, and the verified winners, at most ``tracked`` rows, are broadcast:
copies of those texts are settled where they are read and never shuffled, even where rows repeat the winner's id. All
other digests meet in an ordinary shuffle, where no group can hold more than about ``1 / tracked`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import SPACES, Work, parted, text_or_empty, unused

#: Entries of the frequent-items summary, and so the greatest number of broadcast winners.
TRACKED = 1024
#: Summaries are merged in so many groups before the last merge.
MERGERS = 64


def normal_text(column: str) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(column), SPACES, " ")


def digest(column: str) -> Column:
    return F.sha2(normal_text(column), 256)


def numbered_digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (of the raw text), text_sha256, row: to be written, for a row's number holds as long as it is stored."""
    marks = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), digest(text_col).alias("text_sha256"))
    return marks.withColumn("row", F.monotonically_increasing_id())


def heavy_hitters(rows: DataFrame, key: str, id_col: str, tracked: int = TRACKED, least: int = 100, tie: str | None = None) -> DataFrame:
    """Exact winner (the smallest id; of equal ones, the least ``tie``) and size of each key that the summary names and that has at least ``least`` rows.

    Every key with more than about ``1 / tracked`` of the rows is among them; there are at most ``tracked``.
    """
    tracked = max(8, tracked)
    sketched = (
        rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_m"))
        .agg(F.expr(f"approx_top_k_accumulate({key}, {tracked})").alias("_s"))
        .groupBy(F.col("_m") * 0)  # by a key: a partition without summaries has nothing to combine
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s, {tracked}), {tracked * 3 // 4})").alias("_t"))
    )
    named = sketched.select(F.explode("_t").alias("_t")).select(F.col("_t.item").alias("_k"), F.col("_t.count").alias("_c"))
    named = named.filter(F.col("_k").isNotNull() & (F.col("_c") >= least)).select("_k")
    best = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("keep_id"), F.col(tie or id_col).alias("keep_row"))
    found = rows.join(F.broadcast(named), rows[key] == named["_k"], "left_semi").groupBy(key).agg(F.min(best).alias("_b"), F.count(F.lit(1)).alias("group_size"))
    return found.filter(F.col("group_size") >= least).select(key, "_b.keep_id", *(["_b.keep_row"] if tie else []), "group_size")


def mark_copies(rows: DataFrame, key: str, id_col: str, row: str, winners: DataFrame) -> DataFrame:
    """rows with keep_id, group_size and kept; ``winners`` from heavy_hitters() settle all rows of their keys without a shuffle.

    Exactly one row of each key is kept: of those with the smallest id, the one with the least number (``row``).
    """
    hot = F.broadcast(winners.select(F.col(key).alias("_hk"), F.col("keep_id").alias("_hid"), F.col("keep_row").alias("_hrow"), F.col("group_size").alias("_hn")))
    told = rows.join(hot, rows[key] == hot["_hk"], "left").drop("_hk")
    extra = ("_hid", "_hrow", "_hn")
    settled = told.filter("_hn is not null").withColumns({"keep_id": F.col("_hid"), "group_size": F.col("_hn"), "kept": F.col(row) == F.col("_hrow")})
    group = Window.partitionBy(key)
    met = told.filter("_hn is null").withColumns(
        {
            "keep_id": F.min(id_col).over(group),
            "group_size": F.count(F.lit(1)).over(group),
            "kept": F.row_number().over(group.orderBy(F.col(id_col).asc_nulls_last(), row)) == 1,
        }
    )
    return met.drop(*extra).unionByName(settled.drop(*extra))


def _marked(work: Work, docs: DataFrame, id_col: str, text_col: str, tracked: int) -> DataFrame:
    rows = work.table(numbered_digests(docs, id_col, text_col), "digests")
    winners = work.table(heavy_hitters(rows, "text_sha256", "doc_id", tracked, tie="row").coalesce(1), "winners")
    return mark_copies(rows, "text_sha256", "doc_id", "row", winners)


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other, and so are texts that differ in white space only. Of repeated
    rows (equal id and text) one is kept. A group whose ids are all null keeps one row and has a null keep_id; else a
    null id never wins. Texts of any length are digested whole. An empty table gives an empty result; other columns
    are not read.
    """
    told = _marked(Work(docs.sparkSession), docs, id_col, text_col, tracked)
    return told.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """The rows of docs that exact_copies() keeps, with the columns of docs, whatever their names.

    What is shuffled are digests, ids and the rows that go. What goes is told by id and raw text; where rows repeat both,
    one of them stays. Null and empty texts are one group; an empty table gives an empty result.
    """
    work, key, mark = Work(docs.sparkSession), unused(docs, "_id"), unused(docs, "_mark")
    told = _marked(work, docs, id_col, text_col, tracked)
    other = told.groupBy("doc_id", "mark").agg(F.max("kept").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    other = work.table(other.filter(~F.col("_stays") | (F.col("_rows") > 1)).withColumnsRenamed({"doc_id": key, "mark": mark}), "not-as-they-are")
    work.drop("digests", "winners")
    touched, left = parted(docs, F.xxhash64(text_col), other, F.col(mark))
    same = touched[id_col].eqNullSafe(other[key]) & (F.xxhash64(touched[text_col]) == other[mark])
    left = left.unionByName(touched.join(other, same, "left_anti"))
    repeated = other.filter("_stays")
    if not repeated.take(1):
        return left
    twins = touched.join(repeated, same, "left_semi")
    once = twins.groupBy(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_m")).agg(F.first(F.struct(*[touched[c] for c in docs.columns])).alias("_r"))
    return left.unionByName(once.select("_r.*"))
