"""Queries over sequences, intervals and main-thread activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import intervals, mainthread, sequences
from netloom.plans.adapters import CHUNKS, REQUESTS, SPANS, chunks, requests, spans, table

HOUR = 3_600_000_000
#: Categories that event kinds are folded into.
CATEGORIES = {"click": "EvaluateScript", "view": "Layout", "purchase": "Paint", "signup": "ParseHTML"}


def _category():
    out = None
    for k, v in CATEGORIES.items():
        out = F.when(F.col("kind") == k, v) if out is None else out.when(F.col("kind") == k, v)
    return out.otherwise("other")


_CATEGORY = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items()) + " ELSE 'other' END"


def session_generation(spark, d):
    s = sequences.generations(spans(spark, d), "u", ["st", "i"], F.col("kind") == "signup", F.col("kind").isin("error", "purchase"))
    return s.select("i", "u", F.col("generation").cast("long").alias("generation"))


def redirect_segments(spark, d):
    return sequences.segments(spans(spark, d), "u", ["st", "i"], F.col("kind") == "signup").select("i", "u", F.col("segment").cast("long").alias("segment"))


def first_last_fold(spark, d):
    return sequences.first_last(spans(spark, d), "u", "i", "st", F.col("kind") == "view", F.col("kind") == "click")


def chunk_rollup(spark, d):
    c = chunks(spark, d, numbered=False)
    return c.groupBy("req").agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("inflated").cast("long").alias("inflated"), F.count(F.lit(1)).alias("chunks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def inflated_attach(spark, d):
    return sequences.attach_to_previous(chunks(spark, d), "req", "seq", F.col("flag") != "N", "bytes")


def chunk_deltas(spark, d):
    c = chunks(spark, d).join(requests(spark, d).select("req", "start"), "req")
    return sequences.chunk_deltas(c, "req", ["seq"], "ts", F.col("start") * 1000).select("req", "seq", "delta")


def chunk_body_slices(spark, d):
    c = chunks(spark, d).withColumn("total", F.col("req") % 7 * 3000 + 1000)
    return sequences.body_slices(c, "req", "seq", "bytes", F.col("total")).select("req", "seq", "from_byte", "to_byte")


def chunk_download_spans(spark, d):
    from netloom.operators.layout import download_spans

    c = chunks(spark, d).join(requests(spark, d).select("req", "start"), "req").withColumn("ms", F.expr("ts div 1000"))
    a, b = download_spans(F.col("ms"), F.col("bytes"), 5, F.col("start"))
    return c.select("req", "seq", a.alias("from_ms"), b.alias("to_ms"))


def peak_bandwidth(spark, d):
    s = spans(spark, d).withColumn("bytes", F.col("i") % 1500)
    return sequences.throughput(s, ["u"], "st", "bytes", 24 * HOUR)


def byte_histogram(spark, d):
    s = spans(spark, d).withColumn("bytes", F.col("i") % 1500)
    hit = lambda *k: F.sum(F.when(F.col("kind").isin(*k), F.col("bytes")).otherwise(0)).cast("long")
    return s.groupBy("u", F.expr(f"st div {HOUR}").alias("bucket")).agg(hit("view").alias("bytes_in"), hit("click", "purchase").alias("bytes_out"), hit("error").alias("bytes_dup"))


def slice_histogram(spark, d):
    s = spans(spark, d).filter("du > 0").withColumn("category", _category())
    return mainthread.slice_histogram(s, ["u", "category"], "st", "en", HOUR)


def fold_categories(spark, d):
    return mainthread.fold_categories(spans(spark, d), ["u"], _category(), "du")


def main_thread(spark, d):
    return mainthread.busiest(spans(spark, d).withColumn("page", F.col("u") % 10), ["page"], "u", "du")


def long_tasks(spark, d):
    return intervals.long_tasks(spans(spark, d), "u", "st", "en", "i", 60_000_000)


def interval_union(spark, d):
    return intervals.coalesce_intervals(spans(spark, d), "u", "st", "en", "i")


def interactive_periods(spark, d):
    return intervals.gaps(long_tasks(spark, d), "u", "start_ms", "end_ms")


def js_timing_dedup(spark, d):
    return intervals.drop_contained(spans(spark, d), ["u", "kind"], "st", "en", "i").select("u", "kind", "i", "st", "en")


def begin_end_pairs(spark, d):
    s = spans(spark, d).filter("kind in ('signup', 'purchase')")
    return mainthread.pair_begin_end(s, "u", ["st", "i"], F.col("kind") == "signup", "st", "i")


def cpu_times(spark, d):
    return mainthread.with_idle(spans(spark, d), "u", "du", 10 * HOUR)


def carry_back(spark, d):
    s = spans(spark, d).groupBy("u", F.expr(f"st div {24 * HOUR}").alias("day")).agg(F.sum("du").cast("long").alias("v"))
    a = s.groupBy("u").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "v"))), lambda x: x["v"]).alias("a"))
    limit = F.lit(3_000_000_000).cast("long")
    return a.select("u", F.posexplode(sequences.carry_back(F.col("a"), limit)).alias("pos", "v")).select("u", "pos", "v")


_CARRY = f"""
WITH RECURSIVE {SPANS}, s AS (SELECT u, st // {24 * HOUR} AS day, CAST(sum(du) AS BIGINT) AS v FROM v GROUP BY ALL),
a AS (SELECT u, day, v, row_number() OVER (PARTITION BY u ORDER BY day DESC) AS n, count(*) OVER (PARTITION BY u) AS len FROM s),
w AS (SELECT u, n, len, least(v, 3000000000) AS out, greatest(0, v - 3000000000) AS carry FROM a WHERE n = 1
    UNION ALL SELECT w.u, w.n + 1, w.len, least(coalesce(a.v, 0) + w.carry, 3000000000), greatest(0, coalesce(a.v, 0) + w.carry - 3000000000)
    FROM w LEFT JOIN a ON a.u = w.u AND a.n = w.n + 1 WHERE w.n < w.len OR w.carry > 0)
SELECT u, CAST(max(n) OVER (PARTITION BY u) - n AS INTEGER) AS pos, out AS v FROM w
"""


def utilization(spark, d):
    s = spans(spark, d).withColumn("v", F.col("i") % 997)
    top = s.groupBy("kind").agg(F.greatest(F.lit(1), F.max("v")).alias("top"))
    return s.join(top, "kind").select("i", "kind", F.floor(F.col("v") * 100000 / F.col("top") + 0.5).cast("long").alias("pct_milli"))


def reassembly_stats(spark, d):
    c = chunks(spark, d).withColumn("sq", F.col("line") * 1500)
    return sequences.reassembly(c, "req", ["seq"], "sq", "bytes")


def layout_shift(spark, d):
    s = spans(spark, d)
    return s.filter("kind = 'view'").groupBy("u").agg(F.sum(F.expr("du div 1000")).cast("long").alias("shift_milli"), F.count(F.lit(1)).alias("shifts"))


def v8_stats(spark, d):
    s = spans(spark, d)
    return s.groupBy("u", "kind").agg(F.sum("du").cast("long").alias("dur"), F.count(F.lit(1)).alias("n"), F.min("st").alias("first_used"))


def category_rollup(spark, d):
    s = spans(spark, d).withColumn("run", F.col("u") % 5).withColumn("category", _category())
    return s.rollup("run", "category").agg(F.sum("du").cast("long").alias("usecs"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (session_generation, redirect_segments, first_last_fold, chunk_rollup, inflated_attach, chunk_deltas, chunk_body_slices, chunk_download_spans, peak_bandwidth, byte_histogram, slice_histogram, fold_categories, main_thread, long_tasks, interval_union, interactive_periods, js_timing_dedup, begin_end_pairs, cpu_times, carry_back, utilization, reassembly_stats, layout_shift, v8_stats, category_rollup)}


def _islands(rows: str, touch: str) -> str:
    return f"""
    b AS (SELECT *, max(e) OVER (PARTITION BY u ORDER BY s, e, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({rows})),
    k AS (SELECT *, sum(CASE WHEN m IS NULL OR s {touch} m THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY s, e, i) AS g FROM b),
    isl AS (SELECT u, min(s) AS s, max(e) AS e, count(*) AS n FROM k GROUP BY u, g)"""


_LONG = _islands("SELECT u, i, st // 1000 AS s, (en + 999) // 1000 AS e FROM v WHERE du > 60000000", ">=")

SQL = {
    "session_generation": f"""
        WITH {SPANS}, a AS (SELECT *, coalesce(sum(CASE WHEN kind IN ('error', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY st, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM v),
        b AS (SELECT *, coalesce(max(CASE WHEN kind = 'signup' THEN c END) OVER (PARTITION BY u ORDER BY st, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM a)
        SELECT i, u, CAST(sum(CASE WHEN kind = 'signup' AND c > p THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY st, i) AS BIGINT) AS generation FROM b""",
    "redirect_segments": f"WITH {SPANS} SELECT i, u, CAST(sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY u ORDER BY st, i) AS BIGINT) AS segment FROM v",
    "first_last_fold": f"WITH {SPANS} SELECT u, arg_min(st, i) FILTER (kind = 'view') AS first_value, arg_max(st, i) FILTER (kind = 'click') AS last_value FROM v GROUP BY u",
    "chunk_rollup": f"WITH {CHUNKS} SELECT req, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(inflated) AS BIGINT) AS inflated, count(*) AS chunks, min(ts) AS first_ts, max(ts) AS last_ts FROM c GROUP BY req",
    "inflated_attach": f"""
        WITH {CHUNKS}, s AS (SELECT *, sum(CASE WHEN flag <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY req ORDER BY seq) AS g FROM c)
        SELECT req, min(seq) AS seq, arg_min(bytes, seq) AS bytes, arg_max(bytes, seq) FILTER (flag = 'N') AS inflated FROM s WHERE g > 0 GROUP BY req, g""",
    "chunk_deltas": f"WITH {REQUESTS}, {CHUNKS} SELECT req, seq, ts - coalesce(lag(ts) OVER (PARTITION BY req ORDER BY seq), start * 1000) AS delta FROM c JOIN r USING (req)",
    "chunk_body_slices": f"""
        WITH {CHUNKS}, s AS (SELECT *, req % 7 * 3000 + 1000 AS total, CAST(sum(bytes) OVER (PARTITION BY req ORDER BY seq) AS BIGINT) AS upto, lead(seq) OVER (PARTITION BY req ORDER BY seq) IS NULL AS last FROM c)
        SELECT req, seq, least(upto - bytes, total) AS from_byte, CASE WHEN last THEN total ELSE least(upto, total) END AS to_byte FROM s""",
    "chunk_download_spans": f"WITH {REQUESTS}, {CHUNKS} SELECT req, seq, greatest(start, ts // 1000 - bytes * 8 // 5) AS from_ms, ts // 1000 AS to_ms FROM c JOIN r USING (req)",
    "peak_bandwidth": f"""
        WITH {SPANS}, f AS (SELECT u, st, sum(i % 1500) OVER q AS b, st - min(st) OVER q AS us FROM v WINDOW q AS (PARTITION BY u ORDER BY st RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW))
        SELECT u, CAST(max(floor(b * 8000 / us + 0.5)) AS BIGINT) AS peak_kbps FROM f WHERE us > 1000 GROUP BY u""",
    "byte_histogram": f"""
        WITH {SPANS} SELECT u, st // {HOUR} AS bucket, CAST(sum(CASE WHEN kind = 'view' THEN i % 1500 ELSE 0 END) AS BIGINT) AS bytes_in,
        CAST(sum(CASE WHEN kind IN ('click', 'purchase') THEN i % 1500 ELSE 0 END) AS BIGINT) AS bytes_out, CAST(sum(CASE WHEN kind = 'error' THEN i % 1500 ELSE 0 END) AS BIGINT) AS bytes_dup FROM v GROUP BY ALL""",
    "slice_histogram": f"""
        WITH {SPANS}, s AS (SELECT u, {_CATEGORY} AS category, st, en, unnest(range(st // {HOUR}, greatest(st, en - 1) // {HOUR} + 1)) AS slice FROM v WHERE du > 0)
        SELECT u, category, slice, CAST(sum(least(en, (slice + 1) * {HOUR}) - greatest(st, slice * {HOUR})) AS BIGINT) AS usecs FROM s GROUP BY ALL""",
    "fold_categories": f"WITH {SPANS} SELECT u, {_CATEGORY} AS category, CAST(sum(du) AS BIGINT) AS usecs FROM v WHERE du > 0 GROUP BY ALL",
    "main_thread": f"WITH {SPANS}, t AS (SELECT u % 10 AS page, u, CAST(sum(du) AS BIGINT) AS usecs FROM v GROUP BY ALL) SELECT page, u, usecs FROM t QUALIFY row_number() OVER (PARTITION BY page ORDER BY usecs DESC, u) = 1",
    "long_tasks": f"WITH {SPANS}, {_LONG} SELECT u, s AS start_ms, e AS end_ms, n FROM isl",
    "interval_union": f"WITH {SPANS}, {_islands('SELECT u, i, st AS s, en AS e FROM v', '>')} SELECT u, s AS start, e AS \"end\", n FROM isl",
    "interactive_periods": f"WITH {SPANS}, {_LONG}, g AS (SELECT u, lag(e) OVER (PARTITION BY u ORDER BY s) AS gap_start, s AS gap_end FROM isl) SELECT * FROM g WHERE gap_start < gap_end",
    "js_timing_dedup": f"""
        WITH {SPANS} SELECT u, kind, i, st, en FROM v
        QUALIFY coalesce(max(en) OVER (PARTITION BY u, kind ORDER BY st, en DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < en, true)""",
    "begin_end_pairs": f"""
        WITH {SPANS}, x AS (SELECT *, kind = 'signup' AS b, sum(CASE WHEN kind = 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY u ORDER BY st, i) AS s FROM v WHERE kind IN ('signup', 'purchase')),
        y AS (SELECT *, least(0, min(s) OVER (PARTITION BY u ORDER BY st, i)) AS m FROM x), z AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY u ORDER BY st, i), 0) AS pm FROM y),
        k AS (SELECT *, CAST(s - m + CASE WHEN b THEN 0 ELSE 1 END AS BIGINT) AS depth FROM z WHERE b OR m = pm),
        p AS (SELECT u, depth, b, lag(b) OVER q AS pb, lag(st) OVER q AS start, st AS "end", lag(i) OVER q AS name FROM k WINDOW q AS (PARTITION BY u, depth ORDER BY st, i))
        SELECT u, depth, start, "end", name FROM p WHERE NOT b AND pb""",
    "cpu_times": f"WITH {SPANS} SELECT u, CAST(sum(du) AS BIGINT) AS busy, CAST(greatest(0, {10 * HOUR} - sum(du)) AS BIGINT) AS idle FROM v GROUP BY u",
    "carry_back": _CARRY,
    "utilization": f"WITH {SPANS} SELECT i, kind, CAST(floor(i % 997 * 100000 / greatest(1, max(i % 997) OVER (PARTITION BY kind)) + 0.5) AS BIGINT) AS pct_milli FROM v",
    "reassembly_stats": f"""
        WITH {CHUNKS}, s AS (SELECT *, line * 1500 AS sq, line * 1500 + bytes AS e FROM c),
        m AS (SELECT *, max(e) OVER (PARTITION BY req ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s),
        f AS (SELECT *, CASE WHEN top IS NULL THEN bytes ELSE greatest(0, e - greatest(top, sq)) END AS fresh FROM m)
        SELECT req, count(*) AS packets, count(*) FILTER (e <= top) AS duplicates, count(*) FILTER (sq > top) AS holes, CAST(sum(fresh) AS BIGINT) AS new_bytes, CAST(sum(bytes - fresh) AS BIGINT) AS repeated_bytes FROM f GROUP BY req""",
    "layout_shift": f"WITH {SPANS} SELECT u, CAST(sum(du // 1000) AS BIGINT) AS shift_milli, count(*) AS shifts FROM v WHERE kind = 'view' GROUP BY u",
    "v8_stats": f"WITH {SPANS} SELECT u, kind, CAST(sum(du) AS BIGINT) AS dur, count(*) AS n, min(st) AS first_used FROM v GROUP BY u, kind",
    "category_rollup": f"WITH {SPANS}, w AS (SELECT u % 5 AS run, {_CATEGORY} AS category, du FROM v) SELECT run, category, CAST(sum(du) AS BIGINT) AS usecs, count(*) AS n FROM w GROUP BY ROLLUP (run, category)",
}
