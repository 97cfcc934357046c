"""Token counts by an exact length histogram.

Documents are aggregated by their encoded length; suffix sums over the histogram then answer, for every context
limit, how many documents exceed it, how many tokens a truncation keeps, and any quantile, without another pass.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.bpe import encoding

#: Lengths of a block share the first of the two levels of suffix sums.
BLOCK = 256


@lru_cache(maxsize=4)
def _counter(vocabulary: str):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def encoded_length(text_col: str, vocabulary: str) -> Column:
    """Tokens of each text under a byte-level rank file; null and empty texts have none."""
    return _counter(vocabulary)(F.col(text_col))


def length_histogram(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """n_tokens, docs: one row per encoded length that occurs. Ids and other columns are not read; rows count as they are."""
    return docs.select(encoded_length(text_col, vocabulary).alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens of length L or more, tokens left after truncation to L, and shares.

    Two levels: totals of blocks of lengths are summed over blocks, then lengths within their block, so that no task
    sorts all lengths. An empty histogram gives an empty result.
    """
    rows = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    later, all_blocks = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("_d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("_t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t"),
        F.sum("_d").over(all_blocks).alias("total_docs"),
        F.sum("_t").over(all_blocks).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at_least = F.col("docs_at_least")
    return (
        rows.join(blocks, "block")
        .withColumn("docs_at_least", F.col("_d") + F.sum("docs").over(within))
        .withColumn("tokens_at_least", F.col("_t") + F.sum(F.col("docs") * F.col("n_tokens")).over(within))
        .select(
            "n_tokens",
            "docs",
            "docs_at_least",
            "tokens_at_least",
            (at_least - F.col("docs")).alias("docs_truncated"),
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * at_least).alias("truncated_tokens"),
            ((F.col("total_docs") - at_least + F.col("docs")) / F.col("total_docs")).alias("share_up_to"),
            "total_docs",
            "total_tokens",
        )
    )


def context_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_truncated, truncated_tokens for limits that need not occur as lengths, from suffix_sums() alone; zeros where there are no documents."""
    n, rows = F.col("n_tokens"), []
    for limit in limits:
        longer = F.min_by(F.when(n > limit, F.struct("docs_at_least", "tokens_at_least")), F.when(n > limit, n))
        rows.append(F.struct(F.lit(limit).cast("long").alias("limit"), longer.alias("above")))
    told = sums.agg(F.array(*rows).alias("r"), F.max("total_tokens").alias("t")).select(F.explode("r").alias("r"), "t")
    over, tokens = F.coalesce("r.above.docs_at_least", F.lit(0)), F.coalesce("r.above.tokens_at_least", F.lit(0))
    return told.select("r.limit", over.alias("docs_truncated"), (F.coalesce("t", F.lit(0)) - tokens + F.col("r.limit") * over).alias("truncated_tokens"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents do not exceed; null where there are no documents."""
    row = [F.struct(F.lit(s).alias("share"), F.min(F.when(F.col("share_up_to") >= s - 1e-12, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return sums.agg(F.array(*row).alias("r")).select(F.explode("r").alias("r")).select("r.*")
