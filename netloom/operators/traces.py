"""Requests that a trace tells of in two ways, by its network log and by its timeline; where its page begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.text import is_noise

#: A main-thread task of this length blocks.
LONG_US = 50_000
#: Two clocks are told apart where they differ by more.
CLOCKS_MS = 60_000


def reached_network(start: Column, response_headers: Column, first_byte: Column, end: Column, bytes_in: Column) -> Column:
    """A request that was sent and of which something came back: headers, a first byte, a later end or bytes."""
    back = (F.coalesce(F.size(response_headers), F.lit(0)) > 0) | first_byte.isNotNull() | F.coalesce(end > start, F.lit(False)) | (F.coalesce(bytes_in, F.lit(0)) > 0)
    return start.isNotNull() & back


def anchors_page(url: Column) -> Column:
    """A timeline request that may be where the page begins: it has a url, which is not the harness's."""
    return F.coalesce(url != "", F.lit(False)) & ~is_noise(url)


def base_time(candidates: DataFrame, by: str, sources: list[str]) -> DataFrame:
    """by, base: the earliest time of all sources, zero where there is none. Times that do not count are null."""
    return candidates.groupBy(by).agg(F.coalesce(F.min(F.array_min(F.array(*sources))), F.lit(0)).alias("base"))


def timeline_only(timeline: DataFrame, logged: DataFrame) -> DataFrame:
    """Timeline requests that stand for themselves: real, sent, with a url that the network log lacks, over the network, and answered.

    timeline: url, has_id, was_sent, requested, from_cache, from_worker, status, timed; logged: url; both with capture, if logged has it.
    """
    answered = F.col("timed") | (F.coalesce("status", F.lit(0)) > 0)
    real = F.col("has_id") & F.col("was_sent") & F.col("requested").isNotNull() & anchors_page(F.col("url"))
    kept = timeline.filter(real & ~F.col("from_cache") & ~F.col("from_worker") & answered)
    key = [c for c in ("capture", "url") if c in logged.columns]
    return kept.join(logged.select(*key).distinct(), key, "left_anti")


def pointer_epochs(df: DataFrame, by: list[str], order: str, begins: Column, out: str) -> DataFrame:
    """df with ``out``: the first ``order`` of the object that a pointer stands for; a pointer is used again for another object from each row that begins one. Null before the first."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(out, F.last(F.when(begins, F.col(order)), ignorenulls=True).over(w))


def last_known(df: DataFrame, by: list[str], order: str, value: Column, out: str) -> DataFrame:
    """df with ``out``: the row's own value, or the last one that was told for its ``by`` before."""
    return df.withColumn("_v", value).withColumn(out, F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order))).drop("_v")


def enriched(requests: DataFrame, timeline: DataFrame, fill: dict[str, str], over: tuple[str, ...]) -> DataFrame:
    """requests (capture, url) with what the last timeline request of their url tells.

    fill: columns of requests that have nothing yet (null, or a number that is not above 0) and where their value comes from; over:
    columns of the timeline that requests take as they are.
    """
    names = sorted({*fill.values(), *over})
    last = timeline.filter("url <> ''").groupBy("capture", "url").agg(F.max(F.struct("ord", *names)).alias("_t"))
    both = requests.join(last, ["capture", "url"], "left")
    kinds = dict(requests.dtypes)
    own = lambda c: F.when(F.col(c) > 0, F.col(c)) if kinds[c] in ("int", "bigint", "double") else F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)
    told = {c: F.coalesce(own(c), F.col(f"_t.{t}"), F.col(c)) if c in requests.columns else F.col(f"_t.{t}") for c, t in fill.items()}
    return both.withColumns({**told, **{c: F.col(f"_t.{c}") for c in over}}).drop("_t")


def in_category(cat: Column, name: str) -> Column:
    """Whether an event's categories, a list, have this one."""
    return F.array_contains(F.transform(F.split(cat, ","), F.trim), name)


def toplevel_tasks(events: DataFrame) -> DataFrame:
    """Complete events of the category toplevel that block."""
    return events.filter((F.col("ph") == "X") & in_category(F.col("cat"), "toplevel") & (F.col("dur") >= LONG_US))


def scaled(df: DataFrame, columns: list[str], by: float) -> DataFrame:
    """df with times of another unit."""
    return df.withColumns({c: F.col(c) / by for c in columns})


def one_clock(df: DataFrame, by: str, order: str, outer: str, inner: str) -> DataFrame:
    """df with ``inner`` on the clock of ``outer`` where the first row of a capture that has both shows that they differ by over a minute."""
    both = F.col(outer).isNotNull() & F.col(inner).isNotNull()
    first = df.groupBy(by).agg(F.min_by(F.col(inner) - F.col(outer), F.when(both, F.col(order))).alias("_off"))
    off = F.when(F.abs("_off") > CLOCKS_MS, F.col("_off")).otherwise(0)
    return df.join(first, by, "left").withColumn(inner, F.col(inner) - F.coalesce(off, F.lit(0))).drop("_off")
