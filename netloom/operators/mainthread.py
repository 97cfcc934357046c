"""Main-thread activity: begin/end pairing, slice histograms, category folds and the busiest thread."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_begin_end(df: DataFrame, by: str, order: list[str], is_begin: Column, ts: str, name: str, same_name: bool = False, whole_end: Column | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """by, depth, start, end, name: spans of nested begin and end events, without replaying a stack.

    With S the running sum of +1 and -1 and M the running minimum of 0 and S, an end that lowers M closes nothing. Each
    other event has a depth, at which begins and ends alternate; an end closes the begin before it at its depth.
    ``same_name``: an end of another name takes the begin away, but makes no span. Events for which ``whole_end`` is not null
    are spans by themselves, one deeper than the begins that are open. ``carried``: columns of the begins, or of the whole
    events, that spans keep.
    """
    w = Window.partitionBy(by).orderBy(*order)
    whole = F.lit(None).cast(df.schema[ts].dataType) if whole_end is None else whole_end
    step = F.when(F.col("_e").isNotNull(), 0).when(F.col("_b"), 1).otherwise(-1)
    stepped = df.withColumn("_b", is_begin).withColumn("_e", whole).withColumn("_s", F.sum(step).over(w))
    low = stepped.withColumn("_m", F.least(F.lit(0), F.min("_s").over(w)))
    low = low.withColumn("_pm", F.coalesce(F.lag("_m").over(w), F.lit(0))).filter(F.col("_b") | F.col("_e").isNotNull() | (F.col("_m") == F.col("_pm")))
    alone = low.filter("_e is not null").select(by, (F.col("_s") - F.col("_m") + 1).cast("long").alias("depth"), F.col(ts).alias("start"), F.col("_e").alias("end"), F.col(name).alias("name"), *carried)
    low = low.filter("_e is null")
    deep = low.withColumn("depth", (F.col("_s") - F.col("_m") + F.when(F.col("_b"), 0).otherwise(1)).cast("long"))
    at = Window.partitionBy(by, "depth").orderBy(*order)
    paired = deep.withColumn("_p", F.lag(F.struct(F.col("_b").alias("b"), F.col(ts).alias("t"), F.col(name).alias("n"), *carried)).over(at))
    meets = (F.col("_p.n") == F.col(name)) if same_name else F.lit(True)
    pairs = paired.filter(~F.col("_b") & F.col("_p.b") & meets).select(by, "depth", F.col("_p.t").alias("start"), F.col(ts).alias("end"), F.col("_p.n").alias("name"), *(F.col(f"_p.{c}").alias(c) for c in carried))
    return pairs if whole_end is None else pairs.unionByName(alone)


def slice_width(span_us: Column) -> Column:
    """The largest power of ten, in microseconds, that leaves more than 2000 slices of a span."""
    power = F.greatest(F.lit(0.0), F.ceil(F.log10(span_us / 2000)) - 1)
    return F.when(span_us <= 2000, F.lit(1)).otherwise(F.pow(F.lit(10.0), power)).cast("long")


def slice_histogram(df: DataFrame, keys: list[str], start: str, end: str, width_us: int) -> DataFrame:
    """keys, slice, usecs: the time that spans have in each slice of a fixed width, counted from 0."""
    first, last = F.expr(f"{start} div {width_us}"), F.expr(f"greatest({start}, {end} - 1) div {width_us}")
    cut = df.select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b"), F.explode(F.sequence(first, last)).alias("slice"))
    part = F.least("_b", (F.col("slice") + 1) * width_us) - F.greatest("_a", F.col("slice") * width_us)
    return cut.groupBy(*keys, "slice").agg(F.sum(part).cast("long").alias("usecs"))


def fold_categories(df: DataFrame, keys: list[str], category: Column, usecs: str) -> DataFrame:
    """keys, category, usecs: event times by category; what is not positive does not count."""
    return df.filter(F.col(usecs) > 0).groupBy(*keys, category.alias("category")).agg(F.sum(usecs).cast("long").alias("usecs"))


def busiest(df: DataFrame, keys: list[str], thread: str, usecs: str) -> DataFrame:
    """keys, thread, usecs: the thread with the most time, of equals the smallest."""
    total = df.groupBy(*keys, thread).agg(F.sum(usecs).cast("long").alias("usecs"))
    best = total.groupBy(*keys).agg(F.max(F.struct("usecs", (-F.col(thread)).alias("t"))).alias("b"))
    return best.select(*keys, (-F.col("b.t")).alias(thread), F.col("b.usecs").alias("usecs"))


def with_idle(df: DataFrame, by: str, usecs: str, window_us: int) -> DataFrame:
    """by, busy, idle: time in a window of fixed length; idle time is never negative."""
    return df.groupBy(by).agg(F.sum(usecs).cast("long").alias("busy")).withColumn("idle", F.greatest(F.lit(0), F.lit(window_us) - F.col("busy")))


#: Events of the categories of main-thread work; all others are "other".
CATEGORIES = {
    "ParseHTML": ("ParseHTML", "ResourceReceivedData", "ResourceSendRequest", "ResourceReceivedResponse", "ResourceReceiveResponse", "ResourceFinish", "CommitLoad"),
    "Layout": ("Layout", "RecalculateStyles", "ParseAuthorStyleSheet", "ScheduleStyleRecalculation", "InvalidateLayout", "UpdateLayoutTree"),
    "Paint": ("Paint", "PaintImage", "PaintSetup", "CompositeLayers", "DecodeImage", "Decode Image", "ImageDecodeTask", "Rasterize", "GPUTask", "SetLayerTreeId", "layerId", "UpdateLayer", "UpdateLayerTree", "Draw LazyPixelRef", "Decode LazyPixelRef", "PrePaint", "Layerize"),
    "EvaluateScript": ("EvaluateScript", "EventDispatch", "FunctionCall", "GCEvent", "TimerInstall", "TimerFire", "TimerRemove", "XHRLoad", "XHRReadyStateChange", "v8.compile", "MinorGC", "MajorGC", "FireAnimationFrame", "ThreadState::completeSweep", "Heap::collectGarbage", "ThreadState::performIdleLazySweep"),
}


def category(event: Column, names: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The category of an event's name."""
    out = None
    for c, events in (names or CATEGORIES).items():
        out = F.when(event.isin(*events), c) if out is None else out.when(event.isin(*events), c)
    return out.otherwise("other")


def folded_slices(df: DataFrame, keys: list[str], group: str, slice_: str, usecs: str) -> DataFrame:
    """keys, group, values: for each category an array of the time in each slice, as long as the longest of its thread; what is not positive does not count.

    A category whose events all have no time is an array of zeros.
    """
    sums = df.groupBy(*keys, group, slice_).agg(F.sum(F.greatest(F.col(usecs), F.lit(0))).alias("_v"))
    known = sums.groupBy(*keys, group).agg(F.map_from_entries(F.collect_list(F.struct(slice_, "_v"))).alias("_m"), F.max(slice_).alias("_last"))
    size = F.max("_last").over(Window.partitionBy(*keys))
    told = known.withColumn("_size", size)
    return told.select(*keys, group, F.transform(F.sequence(F.lit(0), F.col("_size").cast("int")), lambda i: F.coalesce(F.try_element_at("_m", i.cast(dict(df.dtypes)[slice_])), F.lit(0))).alias("values"))


def with_parents(spans: DataFrame, by: str, depth: str, start: str, name: str) -> DataFrame:
    """spans with ``parent``: the name of the span of the depth above that began last before each; null at the top."""
    own = spans.withColumn("_k", F.col(depth)).withColumn("_up", F.lit(1))
    above = spans.select(by, (F.col(depth) + 1).alias("_k"), F.col(start), F.col(name).alias("_name"), F.lit(0).alias("_up"))
    w = Window.partitionBy(by, "_k").orderBy(start, "_up")
    both = own.unionByName(above, allowMissingColumns=True)
    return both.withColumn("parent", F.last("_name", ignorenulls=True).over(w)).filter("_up = 1").drop("_k", "_up", "_name")


def exclusive_slices(spans: DataFrame, by: str, start: str, end: str, name: str, width_us: int | str, depth: str = "depth") -> DataFrame:
    """by, name, slice, usecs: time in each slice that is an event's own, folded over the slice's spans in the order of their start and depth.

    spans: with ``depth`` and ``parent`` (a name, or null). A span adds its time to its name, at most the whole slice. Its parent loses
    as much if it has that much there. Where the names together exceed the slice, the others share what the span leaves,
    in the order in which their names came first for ``by``. A span of its parent's name adds nothing. Spans of a slice pass
    through the fold one by one; only the names of one slice are held. width_us: a number, or a column that is the same for all of a ``by``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}
    first = spans.groupBy(by, name).agg(F.min(F.struct(start, depth)).alias("_first"))
    ranks = first.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy("_first", name))).select(by, name, "_rank")
    at = [F.expr(f"{start} div {width_us}"), F.expr(f"greatest({start}, {end} - 1) div {width_us}")]
    own = spans.filter(~F.col(name).eqNullSafe(F.col("parent")) & (F.col(end) > F.col(start)))
    cut = own.select(by, name, "parent", start, end, depth, F.expr(f"cast({width_us} as bigint)").alias("_width"), F.explode(F.sequence(*at)).alias("slice"))
    used = F.least(F.col(end), (F.col("slice") + 1) * F.col("_width")) - F.greatest(F.col(start), F.col("slice") * F.col("_width"))
    parents = ranks.select(by, F.col(name).alias("parent"), F.col("_rank").alias("_parent"))
    cut = cut.join(ranks, [by, name]).join(parents, [by, "parent"], "left")
    rows = cut.select(by, "slice", "_rank", "_parent", used.cast("long").alias("_used"), "_width", start, depth).repartition(by, "slice").sortWithinPartitions(by, "slice", start, depth, "_rank")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shares, total, out = None, {}, 0, []

        def told() -> pa.RecordBatch:
            who, slices, names, sums = zip(*out, strict=True) if out else ((), (), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(who, kind), pa.array(slices, pa.int64()), pa.array(names, pa.int32()), pa.array(sums, pa.int64())], names=[by, "slice", "_rank", "usecs"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for who, slice_, rank, parent, n, width, *_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (who, slice_):
                    out += [(*key, r, v) for r, v in shares.items()] if key else []
                    key, shares, total = (who, slice_), {}, 0
                shares[rank] = shares.get(rank, 0) + n
                total += n
                if parent is not None and shares.get(parent, 0) >= n:
                    shares[parent] -= n
                    total -= n
                shares[rank] = min(shares[rank], width)
                if total > width:
                    left = width - n
                    for r in sorted(shares):
                        if r != rank:
                            shares[r] = min(shares[r], left)
                            left -= shares[r]
                    total = width - left
            if len(out) > 20_000:
                yield told()
        if key:
            out += [(*key, r, v) for r, v in shares.items()]
            yield told()

    folded = rows.mapInArrow(fold, f"`{by}` {kinds[by]}, slice long, _rank int, usecs long")
    return folded.join(ranks, [by, "_rank"]).select(by, name, "slice", "usecs")
