"""The geometry of a timeline: entry order, filters, rows, phases and the axis, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ownership import written


def numbered(rows: DataFrame, by: str, at: str, key: str, out: str) -> DataFrame:
    """rows with ``out``: their number from 0 in their group, by ``at`` and ``key``, which tell the rows of a group apart.

    Keys are sorted in ranges of about equal numbers of rows, wherever groups begin and whatever their values; a row's number
    is its place in its range and the rows of its group in earlier ranges. No task counts a whole group.
    """
    light = rows.select(by, at, key).repartitionByRange(by, at, key).sortWithinPartitions(by, at, key)
    placed = written(light.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    parts = placed.groupBy(by, "_range").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_from"))
    told = placed.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_r"))).select(F.col(by).alias("_by"), F.col(key).alias("_key"), (F.col("_id") + F.col("_from")).alias(out))
    return rows.join(told, F.col(by).eqNullSafe(F.col("_by")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_by", "_key")


def parse_filter(text: str) -> list[tuple[int, int]]:
    """Ranges of a filter such as "1-5,9"; parts that are not numbers are left out."""
    out = []
    for part in text.split(","):
        ends = [p.strip() for p in part.split("-")]
        if 1 <= len(ends) <= 2 and all(p.isdigit() for p in ends):
            out.append((int(ends[0]), int(ends[-1])))
    return out


def request_filter(df: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """Rows whose 1-based index in their group is in the filter; a filter without numbers keeps all."""
    numbered = df.withColumn("index", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    keep = F.lit(False)
    ranges = parse_filter(text)
    for a, b in ranges:
        keep = keep | F.col("index").between(a, b)
    return numbered.filter(keep) if ranges else numbered


def head_tail(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k // 2 and the last k - k // 2 rows of each group, with index and whether a gap follows."""
    w = Window.partitionBy(*by)
    numbered = df.withColumn("index", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    kept = numbered.filter((F.col("index") <= k // 2) | (F.col("index") > F.col("_n") - (k - k // 2)))
    return kept.withColumn("torn", (F.col("_n") > k) & (F.col("index") == k // 2)).drop("_n")


def connection_rows(df: DataFrame, page: str, conn: str, order: list[str]) -> DataFrame:
    """Each request's row when a connection has one row: connections in the order of their first request."""
    w = Window.partitionBy(page).orderBy(*order)
    at = df.withColumn("_at", F.row_number().over(w)).withColumn("_first", F.min("_at").over(Window.partitionBy(page, conn)))
    return at.withColumn("row", F.dense_rank().over(Window.partitionBy(page).orderBy("_first")).cast("long") - 1).drop("_at", "_first")


def load_start(start: Column, delays: list[Column]) -> Column:
    """When a request was sent: its start and its delays, of which those not measured (negative) do not count."""
    out = start
    for d in delays:
        out = out + F.greatest(F.lit(0), F.coalesce(d, F.lit(0)))
    return out


def sequential_phases(start: Column, blocked: Column, dns: Column, connect: Column, send: Column, wait: Column, receive: Column) -> dict[str, Column]:
    """Ends of the phases of a request whose timings follow one another; a request never starts before its connection is up."""
    pos = lambda c: F.greatest(F.lit(0), c)
    blocked_end = start + pos(blocked)
    dns_end = blocked_end + pos(dns)
    connect_end = dns_end + pos(connect)
    request_start = F.greatest(connect_end + pos(send), connect_end)
    first_byte = F.greatest(request_start + pos(wait), request_start)
    return {"queue_end": blocked_end, "dns_end": dns_end, "connect_end": connect_end, "request_start": request_start, "first_byte": first_byte, "end": first_byte + pos(receive)}


#: Offsets (ms from a page's origin) that an absolute request may tell, by what they stand for, first to last; null where they are not told.
ORIGIN, DRAWN_ORIGIN = ("_load_start",), ("_load_start", "_start")
SENT, ANSWERED, DONE = ("_ttfb_start",), ("_ttfb_end", "_first_byte", "_ttfb_start"), ("_download_end", "_end", "_load_end", "_ttfb_end", "_first_byte")
CONNECTING = ("dns", "connect", "ssl")


def with_offsets_known(df: DataFrame) -> DataFrame:
    """df with null columns for the offsets that it lacks."""
    names = [*DRAWN_ORIGIN, "_created", *SENT, *ANSWERED, *DONE, *(f"_{p}_{e}" for p in CONNECTING for e in ("start", "end"))]
    return df.withColumns({n: F.lit(None).cast("double") for n in names if n not in df.columns})


def _first_told(names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(n) for n in names])


def is_absolute(origin: tuple[str, ...] = DRAWN_ORIGIN) -> Column:
    """Whether a request tells offsets, so that its phases are where they say and do not follow one another."""
    return _first_told((*origin, "_dns_start", *SENT)).isNotNull()


def absolute_offsets(origin: tuple[str, ...] = DRAWN_ORIGIN) -> dict[str, Column]:
    """Offsets of the phases of an absolute request: each begins where it says, else where the one before ended, and ends where it says, else at once.

    A request is sent at its origin, but never before its connection is up.
    """
    began = _first_told(origin)
    out = {"queue_end": F.coalesce(began, *[F.col(n) for n in SENT], F.lit(0.0))}
    out["queue_start"] = F.coalesce(F.col("_created"), out["queue_end"])
    at = out["queue_end"]
    for p in CONNECTING:
        for e in ("start", "end"):
            at = F.when(F.col(f"_{p}_{e}") >= 0, F.col(f"_{p}_{e}")).otherwise(at)
            out[f"{p}_{e}"] = at
    sent = F.coalesce(began, *[F.col(n) for n in SENT], at)
    first = F.coalesce(_first_told(ANSWERED), began, sent)
    out["end"] = F.coalesce(_first_told(DONE), first)
    out["sent"] = F.greatest(sent, out["connect_end"])
    out["first_byte"] = F.when(sent < out["connect_end"], F.greatest(first, out["sent"])).otherwise(first)
    return out


def sent_order(origin: tuple[str, ...], start: Column, delays: list[Column], earliest: Column | None = None) -> Column:
    """What requests are ordered by: when they were sent. Exports leave ``_start`` out of the origin and count absolute ones from the earliest time; what is drawn counts them from zero."""
    offset = absolute_offsets(origin)["sent"] if earliest is None else absolute_offsets(origin)["sent"] + earliest
    return F.when(is_absolute(origin), offset).otherwise(load_start(start, delays))


#: Times of a row, in ms from the page's base.
TIMES = ("start", "queue_start", "queue_end", "dns_start", "dns_end", "connect_start", "connect_end", "ssl_start", "ssl_end", "sent", "first_byte", "end")


def row_times(start: Column, phases: dict[str, Column], first_data: Column, ended: Column) -> dict[str, Column]:
    """TIMES of a request (epoch ms), by its offsets where it tells any, else by its phases (blocked, dns, connect, ssl, send, wait, receive; ms), one after the other.

    An absolute request's offsets count from what leads from its creation, else its origin, to its start. A lookup may begin
    before the start. first_data and ended, where told, are later evidence for a request whose phases follow one another.
    """
    own = absolute_offsets()
    zero = start - F.when(F.col("_created").isNotNull(), F.col("_created")).otherwise(F.coalesce(F.when(_first_told(DRAWN_ORIGIN) >= 0, _first_told(DRAWN_ORIGIN)), F.lit(0.0)))
    told = {k: zero + c for k, c in own.items()}
    told["start"] = F.when(F.col("_dns_start") >= 0, F.least(start, zero + F.col("_dns_start"))).otherwise(start)

    pos = lambda n: F.greatest(F.lit(0.0), F.coalesce(phases[n], F.lit(0.0)))
    follow, at = {"start": start, "queue_start": start, "queue_end": start + pos("blocked")}, start + pos("blocked")
    for p in CONNECTING[:2]:
        follow[f"{p}_start"], at = at, at + pos(p)
        follow[f"{p}_end"] = at
    follow["ssl_start"], at = at, at + pos("ssl")
    follow["ssl_end"] = at
    follow["sent"] = at + pos("send")
    follow["first_byte"] = F.when(first_data > 0, first_data).otherwise(follow["sent"] + pos("wait"))
    whole = start
    for n in ("blocked", "dns", "connect", "send", "wait", "receive"):
        whole = whole + pos(n)
    follow["end"] = F.greatest(whole, F.coalesce(ended, whole))
    return {k: F.when(is_absolute(), told[k]).otherwise(follow[k]) for k in TIMES}


def waterfall_rows(
    requests: DataFrame,
    by: str,
    key: str,
    base: str | None = None,
    filter_text: str = "",
    most: int | None = None,
    conn: str | None = None,
    row_height: int = 18,
    width: int = 1012,
    labels: int = 250,
    first_s: float = 0.0,
    last_s: float | None = None,
) -> DataFrame:
    """One row for each request that is drawn: by, key, index, row, y1, y2, TIMES (ms from base_ms), base_ms, max_ms, x, pixels, torn.

    requests: ``by``, ``key``, start (epoch ms), phases as row_times() has them, and offsets. index: the place from 1 on in the order in
    which requests were sent; filter_text keeps some of them, as request_filter() does. base: a column with the page's own beginning, else the
    least start of what is drawn. most: of a page with more rows only the first and last halves are drawn, with a torn edge of four
    rows between. conn: requests of one connection share a row, in the order of its first; those without one have their own. last_s: the last second
    that is drawn, else all. x and pixels: where the bar begins, and its width.
    """
    known = with_offsets_known(requests)
    for n in ("blocked", "dns", "connect", "ssl", "send", "wait", "receive", "first_data", "ended"):
        if n not in known.columns:
            known = known.withColumn(n, F.lit(None).cast("double"))
    order = sent_order(DRAWN_ORIGIN, F.col("start"), [F.col(c) for c in ("blocked", "dns", "connect", "send")])
    rows = numbered(known.withColumn("_sent", order), by, "_sent", key, "index").withColumn("index", F.col("index") + 1)
    ranges = parse_filter(filter_text)
    if ranges:
        keep = F.lit(False)
        for a, b in ranges:
            keep = keep | F.col("index").between(a, b)
        rows = numbered(rows.filter(keep), by, "index", key, "_view")
    else:
        rows = rows.withColumn("_view", F.col("index") - 1)
    rows = rows.withColumn("torn", F.lit(0))
    if most:
        half = most // 2
        rows = rows.join(rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")), by)
        rows = rows.filter((F.col("_view") < half) | (F.col("_view") >= F.col("_n") - (most - half)))
        rows = rows.withColumn("torn", ((F.col("_n") > most) & (F.col("_view") >= half)).cast("int"))
        rows = rows.withColumn("_view", F.when(F.col("torn") == 1, F.col("_view") - (F.col("_n") - most)).otherwise(F.col("_view")))
    if conn:
        shared = F.coalesce(F.concat(F.lit("c"), F.col(conn).cast("string")), F.concat(F.lit("r"), F.col(key).cast("string")))
        rows = rows.withColumn("_shared", shared)
        first = rows.groupBy(by, "_shared").agg(F.min("_view").alias("_first"), F.min("torn").alias("_torn"))
        first = numbered(first, by, "_first", "_shared", "_row").select(by, "_shared", (F.col("_row") + 4 * F.col("_torn")).alias("row"))
        rows = rows.join(first, [by, "_shared"])
    else:
        rows = rows.withColumn("row", F.col("_view") + 4 * F.col("torn"))
    phases = {n: F.col(n) for n in ("blocked", "dns", "connect", "ssl", "send", "wait", "receive")}
    times = row_times(F.col("start"), phases, F.col("first_data"), F.col("ended"))
    rows = rows.select(by, key, "index", "row", "torn", *([F.col(base).alias("_base")] if base else []), F.col("start").alias("_started"), *[c.alias(f"_t_{n}") for n, c in times.items()])
    ends = F.max("_t_end").alias("_last")
    pages = rows.groupBy(by).agg(((F.min("_base") if base else F.min("_started")) + first_s * 1000).alias("base_ms"), ends)
    span = F.lit(max(0.0, (last_s - first_s) * 1000)) if last_s and last_s > 0 else F.greatest(F.lit(0.0), F.col("_last") - F.col("base_ms"))
    pages = pages.withColumn("max_ms", span.cast("double")).drop("_last")
    told = rows.join(pages, by).withColumns({n: F.col(f"_t_{n}") - F.col("base_ms") for n in TIMES})
    per_ms = F.when(F.col("max_ms") > 0, F.lit(width - labels - 5) / F.col("max_ms")).otherwise(F.lit(0.0))
    top = F.col("row") * row_height + row_height
    told = told.withColumns({"y1": top, "y2": top + row_height - 1, "x": labels + F.col("start") * per_ms, "pixels": (F.col("end") - F.col("start")) * per_ms})
    return told.select(by, key, "index", "row", "y1", "y2", *TIMES, "base_ms", "max_ms", "x", "pixels", "torn")


def waterfall_size(rows: DataFrame, by: str, row_height: int = 18, chart_height: int = 0) -> DataFrame:
    """by, rows, height, max_ms of what waterfall_rows() draws of each page; two rows of height are its frame."""
    sums = rows.groupBy(by).agg((F.max("row") + 1).alias("rows"), F.max("max_ms").alias("max_ms"))
    return sums.select(by, "rows", ((F.col("rows") + 2) * row_height + chart_height).alias("height"), "max_ms")


def axis_interval(max_ms: Column, ticks: int) -> Column:
    """1, 2, 5 or 10 times the power of ten below a tick's share, whichever gives the number of ticks nearest to the wanted one; the larger of equals."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(max_ms / ticks)))
    ranked = F.transform(F.array(*map(F.lit, (1.0, 2.0, 5.0, 10.0))), lambda f: F.struct(F.abs(ticks - max_ms / (f * power)).alias("miss"), (-f * power).alias("step")))
    return -F.array_min(ranked)["step"]


def download_spans(ts: Column, size: Column, kbps: int, not_before: Column) -> tuple[Column, Column]:
    """Start and end of a chunk's arrival: it ends at its time and took its bytes at the bandwidth, but not before the download began."""
    return F.greatest(not_before, ts - F.floor(size * 8 / kbps).cast("long")), ts


def queue_end(blocked_end: Column, dns_start: Column, connect_start: Column, ttfb_start: Column) -> Column:
    """When a request left the queue: no later than its first phase began; phases that are missing do not count."""
    return F.least(blocked_end, dns_start, connect_start, ttfb_start)


def time_clip(df: DataFrame, begin: str, end: str, origin_ms: Column, first_s: float | None = None, last_s: float | None = None) -> DataFrame:
    """Rows that lie in a clip of seconds from an origin, at least in part, with base_ms and span_ms; without a last second all that follow."""
    base = origin_ms + (first_s or 0.0) * 1000
    span = F.lit(max(0.0, (last_s - (first_s or 0.0)) * 1000) if last_s and last_s > 0 else None).cast("double")
    told = df.withColumn("base_ms", base.cast("double")).withColumn("span_ms", span)
    return told.filter((F.col(end) >= F.col("base_ms")) & (F.col("span_ms").isNull() | (F.col(begin) <= F.col("base_ms") + F.col("span_ms"))))


def page_events(render: Column, dom_start: Column, dom_end: Column, on_dom: Column, load_start: Column, load_end: Column, on_load: Column, fcp: Column | None = None, lcp: Column | None = None, dom_interactive: Column | None = None) -> dict[str, Column]:
    """Times (ms) to mark on a page: render, load, begin and end of nav_dom and nav_load, and fcp, lcp and nav_dom_interactive where given; null where not measured.

    A time that is not above 0 was not measured. nav_dom falls back to one point: on_dom, else its end. nav_load falls
    back to its end.
    """
    told = lambda c: F.when(c > 0, c)
    both = (dom_start > 0) & (dom_end > 0)
    point = F.coalesce(told(on_dom), told(dom_end))
    return {
        "render": told(render),
        "nav_dom_start": F.when(both, dom_start).otherwise(point),
        "nav_dom_end": F.when(both, dom_end).otherwise(point),
        "nav_load_start": F.when(load_end > 0, F.coalesce(told(load_start), load_end)),
        "nav_load_end": told(load_end),
        "load": told(on_load),
        **{n: told(c) for n, c in (("fcp", fcp), ("lcp", lcp), ("nav_dom_interactive", dom_interactive)) if c is not None},
    }
