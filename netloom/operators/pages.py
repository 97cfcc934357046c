"""What is told of a page as a whole: its resources in an archive, its statistics, processor times and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.sequences import carry_back

#: Endings of the members that hold a page's resource, in the order they are tried, and their types.
RESOURCES = {
    "screenshot": (("_screen.jpg", "image/jpeg"), ("_screen.png", "image/png")),
    "trace": (("_trace.json.gz", "application/json"),),
    "netlog": (("_netlog.json.gz", "application/json"), ("_netlog.txt.gz", "application/json")),
    "tcpdump": (("_tcpdump.cap.gz", "application/vnd.tcpdump.pcap"),),
    "lighthouse": (("_lighthouse.html", "text/html"), ("_lighthouse.html.gz", "text/html")),
}
#: Members that hold a resource of whichever page.
SHARED = {"lighthouse": (("lighthouse.html", "text/html"), ("lighthouse.html.gz", "text/html"))}
#: Names of a view's members that are not carried to its page, and content types of certificate checks.
BLOAT = ("bodies", "response_body", "thumbnails", "images", "videoFrames")
CHECKS = "ocsp-response|pkix-crl|pkix-cert|ca-cert"
#: Results of a page that found nothing, and of one with something missing.
NO_RESPONSE, MISSING = 12999, 99999


def page_resources(pages: DataFrame, members: DataFrame) -> DataFrame:
    """capture, run, cached, resource, member, mime: for each page and kind of resource the first candidate that its archive has.

    pages: capture, run, cached; members: capture, member, ord. A candidate is a member's name or the last part of its path.
    """
    own = [(k, i, end, mime, False) for k, ends in RESOURCES.items() for i, (end, mime) in enumerate(ends)]
    own += [(k, len(RESOURCES[k]) + i, name, mime, True) for k, names in SHARED.items() for i, (name, mime) in enumerate(names)]
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("resource"), F.lit(i).alias("rank"), F.lit(end).alias("end"), F.lit(mime).alias("mime"), F.lit(s).alias("shared")) for k, i, end, mime, s in own]))
    stem = F.concat(F.col("run").cast("string"), F.when(F.col("cached").cast("int") != 0, "_Cached").otherwise(""))
    asked = pages.withColumn("w", wanted).select("capture", "run", "cached", "w.*").withColumn("name", F.when(F.col("shared"), F.col("end")).otherwise(F.concat(stem, "end")))
    held = members.select("capture", "member", "ord", F.regexp_extract("member", "([^/]*)$", 1).alias("name"))
    found = asked.join(held, ["capture", "name"])
    best = found.groupBy("capture", "run", "cached", "resource").agg(F.min(F.struct("rank", "ord", "member", "mime")).alias("b"))
    return best.select("capture", "run", "cached", "resource", F.col("b.member").alias("member"), F.col("b.mime").alias("mime"))


def without(fields: Column, names: tuple[str, ...] = BLOAT) -> Column:
    """A map without these names."""
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def extensions(core: Column, fields: Column) -> Column:
    """core, a map, with the fields whose names begin with an underscore, where it has none of that name."""
    return F.map_concat(core, F.map_filter(fields, lambda k, _: F.startswith(k, F.lit("_")) & ~F.map_contains_key(core, k)))


def as_extensions(fields: Column) -> Column:
    """A map whose names get an underscore before them."""
    return F.transform_keys(fields, lambda k, _: F.concat(F.lit("_"), k))


def page_totals(requests: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Statistics of each page by its requests: bytes and requests in all and before doc_time, answers, blocking resources, ttfb, fully loaded, result.

    requests: status, load_start, load_ms, ttfb_ms, bytes_in, bytes_out, content_type, blocking, kind, doc_time, with the columns of ``order``.
    """
    n = lambda c: F.count(F.when(c, 1))
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    status, early = F.col("status"), F.col("load_start") < F.col("doc_time")
    first = F.struct(*order)
    base = (F.col("ttfb_ms") >= 0) & status.isin(200, 304) & ~F.coalesce(F.col("content_type"), F.lit("")).rlike(CHECKS)
    ok = n(status == 200)
    first_status = F.min_by("status", first)
    nothing = F.when(first_status >= 400, first_status).when(F.max("doc_time") > 0, 0).otherwise(NO_RESPONSE)
    return requests.groupBy(by).agg(
        total("bytes_in").alias("bytes_in"),
        total("bytes_in", early).alias("bytes_in_doc"),
        total("bytes_out").alias("bytes_out"),
        total("bytes_out", early).alias("bytes_out_doc"),
        F.count(F.lit(1)).alias("requests"),
        n(early).alias("requests_doc"),
        ok.alias("responses_200"),
        n(status == 404).alias("responses_404"),
        n(~F.coalesce(status.isin(200, 404), F.lit(False))).alias("responses_other"),
        n(F.col("blocking") & (F.col("kind") == "Script")).alias("blocking_js"),
        n(F.col("blocking") & (F.col("kind") == "Stylesheet")).alias("blocking_css"),
        F.min_by(F.floor(F.col("load_start") + F.col("ttfb_ms") + 0.5), F.when(base, first)).alias("ttfb"),
        F.greatest(F.max("doc_time"), F.max(F.col("load_start") + F.coalesce("load_ms", F.lit(0)))).alias("fully_loaded"),
        F.when(ok == 0, nothing).when(n(status == 404) > 0, MISSING).cast("int").alias("result"),
    )


def processor_times(slices: DataFrame, by: str, name: str, width_us: int) -> DataFrame:
    """by, name, busy_ms, busy_doc_ms: time of each event up to fully_loaded, and up to doc_time, with what is left of both as Idle.

    slices: slice (from 0), usecs, fully_loaded, doc_time (ms).
    """
    ms = F.col("usecs") / 1000
    inside = F.col("slice") < F.ceil(F.col("fully_loaded") * 1000 / width_us)
    early = inside & (F.col("slice") * width_us < F.col("doc_time") * 1000)
    told = slices.groupBy(by, name).agg(F.coalesce(F.sum(F.when(inside, ms)), F.lit(0.0)).alias("all"), F.coalesce(F.sum(F.when(early, ms)), F.lit(0.0)).alias("doc"), F.max("fully_loaded").alias("_end"), F.max("doc_time").alias("_doc"))
    idle = told.groupBy(by).agg(F.lit("Idle").alias(name), F.greatest(F.max("_end") - F.sum("all"), F.lit(0.0)).alias("all"), F.greatest(F.max("_doc") - F.sum("doc"), F.lit(0.0)).alias("doc"))
    both = told.select(by, name, "all", "doc").unionByName(idle)
    return both.select(by, name, F.rint("all").cast("long").alias("busy_ms"), F.rint("doc").cast("long").alias("busy_doc_ms"))


def scores(requests: DataFrame, by: str) -> DataFrame:
    """Scores of a page out of 100: means of those of its requests that have one, shares of bytes that need not be saved, and of bytes in progressive images.

    requests: cache, cdn, keep_alive (scores, below 0 if none), gzip, image (such scores) with gzip_size, gzip_target, image_size, image_target,
    and jpeg_size, jpeg_scans.
    """
    mean = lambda c: F.rint(F.avg(F.when(F.col(c) >= 0, F.col(c)))).cast("long")

    def kept(c: str) -> Column:
        size = F.sum(F.when(F.col(c) >= 0, F.col(f"{c}_size")))
        saved = F.sum(F.when(F.col(c) >= 0, F.col(f"{c}_size") - F.col(f"{c}_target")))
        return F.when(size > 0, 100 - (saved * 100 / size).cast("long"))

    scans = F.sum(F.when(F.col("jpeg_scans") > 1, F.col("jpeg_size")).otherwise(0))
    return requests.groupBy(by).agg(
        mean("cache").alias("score_cache"),
        mean("cdn").alias("score_cdn"),
        mean("keep_alive").alias("score_keep_alive"),
        kept("gzip").alias("score_gzip"),
        kept("image").alias("score_compress"),
        F.when(F.sum("jpeg_size") > 0, F.rint(scans * 100 / F.sum("jpeg_size")).cast("long")).alias("score_progressive"),
    )


def utilization(df: DataFrame, by: list[str], raw: str, bw_down: str) -> DataFrame:
    """by, series, ts, pct, most, plain: samples of each series of a VARIANT object, as percent of the most that it can be.

    A series is an array of its samples (an object of times) and their most, or an object with ``data`` and ``max``; any other is
    handed on as it is, in plain. Where a bandwidth (kbps) is told, what ``bw`` exceeds it moves to the samples before, and into new
    ones before the first.
    """
    known = df.withColumn("_r", F.coalesce(F.col(raw).try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>")))
    each = known.select(*by, F.col(bw_down).alias("_bw"), F.explode("_r").alias("series", "_v"))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    is_object = lambda c: F.coalesce(F.startswith(F.schema_of_variant(c), F.lit("OBJECT")), F.lit(False))
    listed = is_object(get("$[0]", "variant")) & (F.size(F.col("_v").try_cast("array<variant>")) >= 2)
    named = is_object(F.col("_v")) & is_object(get("$.data", "variant"))
    samples = F.when(listed, get("$[0]", "map<string,string>")).when(named, get("$.data", "map<string,string>"))
    number = lambda c: F.regexp_extract(c, r"^\s*([+-]?[0-9.]+(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    most = F.greatest(F.lit(1.0), F.coalesce(number(F.when(listed, get("$[1]", "string")).otherwise(get("$.max", "string"))), F.lit(1.0)))
    points = F.array_sort(F.transform(F.map_entries(samples), lambda e: F.struct(number(e["key"]).alias("ts"), number(e["value"]).alias("value"))))
    # a row of its own for what is used often: else it is made anew for each use
    told = each.select(*by, "series", "_v", F.explode(F.array(points)).alias("_p"), most.alias("_most"), F.when((F.col("series") == "bw") & (F.col("_bw") > 0), F.col("_bw") * 1000.0).alias("_limit"))
    values = F.transform("_p", lambda p: p["value"])
    moved = F.when(F.col("_limit").isNotNull(), carry_back(values, F.col("_limit"), "double")).otherwise(values)
    told = told.select("*", F.explode(F.array(moved)).alias("_values"))
    step = F.get("_p", F.lit(1))["ts"] - F.get("_p", F.lit(0))["ts"]
    told = told.withColumns({"_step": F.when(step > 0, step).otherwise(100.0), "_new": F.size("_values") - F.size("_p"), "most": F.coalesce("_limit", "_most")})
    at = lambda i: F.when(i >= F.col("_new"), F.get("_p", i - F.col("_new"))["ts"]).otherwise(F.get("_p", F.lit(0))["ts"] - (F.col("_new") - i) * F.col("_step"))
    made = told.withColumn("_s", F.transform("_values", lambda v, i: F.struct(at(i).alias("ts"), (v / F.col("most") * 100.0).alias("pct"))))
    shaped = made.filter("_p is not null").select(*by, "series", F.explode("_s").alias("s"), "most").select(*by, "series", "s.ts", "s.pct", "most", F.lit(None).cast("variant").alias("plain"))
    nothing = F.lit(None).cast("double")
    return shaped.unionByName(made.filter("_p is null").select(*by, "series", nothing.alias("ts"), nothing.alias("pct"), nothing.alias("most"), F.col("_v").alias("plain")))
