"""Archives of page-test agents: ZIP files whose members tell about runs, first and repeat views.

Members are rows, so whatever reads one kind of member runs over all archives at once. Nested archives of bodies are
opened, too. What is no archive, or a damaged member, gives no row.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions.text import leading_int
from netloom.operators import mainthread
from netloom.operators.ownership import first_claim
from netloom.sources import json_captures

_MEMBERS = "capture string, member string, inner string, content binary"
#: Names of members that belong to a view, and the columns of progress.csv.
VIEW_MEMBER = r"^(\d+)(_Cached)?_(devtools_requests\.json|bodies\.zip|progress\.csv|script_timing\.json|timeline_cpu\.json)(?:\.gz)?$"
PROGRESS = ("bw", "cpu", "mem")


def _open(name: str, data: bytes, nested: bool = True) -> Iterator[tuple[str, str | None, bytes]]:
    """member, inner name (in a nested archive), content; each member is read when it is asked for."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    for info in archive.infolist():
        try:
            content = archive.read(info)
            content = zlib.decompress(content, 47) if info.filename.endswith(".gz") else content
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError):
            continue
        if nested and info.filename.endswith("bodies.zip"):
            yield from ((info.filename, inner, body) for inner, _, body in _open(info.filename, content, False))
        else:
            yield info.filename, None, content


def members(spark: SparkSession, path: str) -> DataFrame:
    """capture, member, inner, content, run, cached, kind: one row per member; gzip is inflated by its name.

    run, cached and kind are null for members that belong to no view. An archive is read by one task, and its members
    leave it one at a time; archives of 2 GB or more are beyond what a row can hold.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for capture, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, inner, content in _open(capture, data.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([capture]), pa.array([member]), pa.array([inner], pa.string()), pa.array([content], pa.binary())], names=["capture", "member", "inner", "content"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, _MEMBERS)
    part = lambda i: F.regexp_extract("member", VIEW_MEMBER, i)
    known = F.col("member").rlike(VIEW_MEMBER)
    return rows.select("*", F.when(known, part(1).try_cast("int")).alias("run"), F.when(known, (part(2) != "").cast("int")).alias("cached"), F.when(known, part(3)).alias("kind"))


def _texts(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("kind") == kind).select("capture", "run", "cached", F.decode("content", "UTF-8").alias("text"))


def connectivity(rows: DataFrame) -> DataFrame:
    """capture, bw_down, bw_up, latency, plr of the test's description; zeros count as not told."""
    doc = F.try_parse_json(F.decode("content", "UTF-8"))
    info = rows.filter(F.col("member").isin("testinfo.json", "testinfo.json.gz")).select("capture", doc.alias("doc"))
    names = {"bw_down": "bwIn", "bw_up": "bwOut", "latency": "latency", "plr": "plr"}
    return info.select("capture", *[F.nullif(F.try_variant_get("doc", f"$.{n}", "double"), F.lit(0.0)).alias(c) for c, n in names.items()])


def progress(rows: DataFrame) -> DataFrame:
    """capture, run, cached, series (bw, cpu, mem), ts, value, most: samples of progress.csv.

    most: the largest value of the series, 100 for cpu. The last of several samples at a time counts; memory of -1 is
    not told, and cells that are no numbers are left out.
    """
    lines = _texts(rows, "progress.csv").select("capture", "run", "cached", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter("line > 0")
    cells = F.split(F.trim(F.regexp_replace("text", r"\r$", "")), ",")
    cell = lambda i: F.get(cells, F.lit(i))
    whole = lambda c: leading_int(c).cast("double")
    numbers = (whole(cell(1)), F.regexp_extract(cell(2), r"^\s*([+-]?[0-9.]+(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.when(cell(3) != "-1", whole(cell(3))))
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), v.alias("value")) for n, v in zip(PROGRESS, numbers, strict=True)]))
    told = lines.select("capture", "run", "cached", "line", leading_int(cell(0)).alias("ts"), long.alias("s")).select("*", "s.series", "s.value").filter("ts is not null and value is not null")
    last = told.groupBy("capture", "run", "cached", "series", "ts").agg(F.max_by("value", "line").alias("value"))
    most = F.greatest(F.lit(0.0), F.max("value").over(Window.partitionBy("capture", "run", "cached", "series")))
    return last.withColumn("most", F.when(F.col("series") == "cpu", 100.0).otherwise(most))


def _fields(df: DataFrame, source: str, name: str, value: str) -> DataFrame:
    """df with a row for each field of a VARIANT object."""
    return df.select("*", F.explode(F.col(source).try_cast("map<string,variant>")).alias(name, value))


def cpu_slices(rows: DataFrame) -> DataFrame:
    """capture, run, cached, slice_usecs, thread, event, slice, usecs: slices of timeline_cpu.json with work, of its main thread."""
    doc = _texts(rows, "timeline_cpu.json").withColumn("doc", F.try_parse_json("text"))
    main = doc.select("capture", "run", "cached", F.try_variant_get("doc", "$.slice_usecs", "long").alias("slice_usecs"), F.try_variant_get("doc", "$.main_thread", "string").alias("thread"), F.try_variant_get("doc", "$.slices", "map<string,variant>").alias("threads"))
    events = _fields(main.withColumn("events", F.try_element_at("threads", F.col("thread"))), "events", "event", "values")
    slices = events.select("capture", "run", "cached", "slice_usecs", "thread", "event", F.posexplode(F.col("values").try_cast("array<double>")).alias("slice", "usecs"))
    return slices.filter("usecs > 0")


def script_ranges(rows: DataFrame, names: list[str]) -> DataFrame:
    """capture, run, cached, url, n, start, end: times that scripts of a url ran on the main thread, for these events in this order."""
    doc = _texts(rows, "script_timing.json").withColumn("doc", F.try_parse_json("text"))
    root = doc.select("capture", "run", "cached", F.col("doc").try_cast("map<string,variant>").alias("root"))
    main = root.withColumn("thread", F.try_element_at("root", F.try_element_at("root", F.lit("main_thread")).try_cast("string")))
    urls = _fields(main.drop("root"), "thread", "url", "v").withColumn("events", F.col("v").try_cast("map<string,array<array<double>>>"))
    flat = F.flatten(F.transform(F.array(*map(F.lit, names)), lambda n: F.coalesce(F.try_element_at("events", n), F.array().cast("array<array<double>>"))))
    pairs = F.filter(flat, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    out = urls.select("capture", "run", "cached", "url", F.posexplode(pairs).alias("n", "p"))
    return out.select("capture", "run", "cached", "url", "n", F.col("p")[0].alias("start"), F.col("p")[1].alias("end"))


def bodies(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """entries (capture, run, cached, body_file and more) with ``body``, the member of the view's bodies that they name."""
    held = rows.filter((F.col("kind") == "bodies.zip") & F.col("inner").isNotNull()).groupBy("capture", "run", "cached", F.col("inner").alias("body_file")).agg(F.first("content").alias("body"))
    return entries.join(held, ["capture", "run", "cached", "body_file"], "left")


def _flat_views(rows: DataFrame) -> DataFrame:
    """capture, first, run, cached, view of devtools_requests.json; a view's own fields are those of its page, with its requests beside them."""
    doc = _texts(rows, "devtools_requests.json").withColumn("doc", F.try_parse_json("text")).filter("doc is not null")
    page, found = F.try_variant_get("doc", "$.pageData", "map<string,variant>"), F.try_variant_get("doc", "$.requests", "variant")
    both = F.map_concat(F.map_filter(F.coalesce(page, F.create_map().cast("map<string,variant>")), lambda k, _: k != "requests"), F.create_map(F.lit("requests"), found))
    return doc.select("capture", F.lit(0).alias("first"), "run", "cached", F.to_variant_object(both).alias("view"))


def pages(rows: DataFrame) -> DataFrame:
    """The views of archives as pages."""
    return json_captures.view_pages(_flat_views(rows))


def requests(rows: DataFrame) -> DataFrame:
    """The requests of the views of archives."""
    return json_captures.view_requests(_flat_views(rows))


def pages_with_side_data(rows: DataFrame) -> DataFrame:
    """pages() with what the other members of an archive tell of each view among ext: its connection (_bwDown, _bwUp, _latency, _plr),
    _utilization (series of times and percents, with the most of each) and _mainThreadSlices (width, and an array for each category).

    What a page tells itself stays. A view without a member has nothing of it.
    """
    view = ["capture", "run", "cached"]
    told = connectivity(rows)
    names = {"_bwDown": "bw_down", "_bwUp": "bw_up", "_latency": "latency", "_plr": "plr"}
    told = told.select("capture", F.create_map(*[x for k, c in names.items() for x in (F.lit(k), F.col(c).cast("variant"))]).alias("_wire"))

    samples = progress(rows).filter("most > 0").groupBy(*view, "series").agg(F.sort_array(F.collect_list(F.struct("ts", (F.col("value") / F.col("most") * 100).alias("pct")))).alias("points"), F.max("most").alias("most"))
    points = F.transform("points", lambda p: F.array(p["ts"].cast("double"), p["pct"]))
    series = F.map_from_entries(F.collect_list(F.struct("series", points.alias("points"))))
    most = F.map_from_entries(F.collect_list(F.struct(F.concat("series", F.lit("Max")), "most")))
    used = samples.groupBy(*view).agg(F.to_variant_object(F.struct(series.alias("series"), most.alias("most"))).alias("_used"))

    slices = cpu_slices(rows)
    folded = mainthread.folded_slices(slices.withColumn("category", mainthread.category(F.col("event"))), [*view, "slice_usecs"], "category", "slice", "usecs")
    busy = folded.groupBy(*view).agg(F.to_variant_object(F.struct(F.first("slice_usecs").alias("slice_usecs"), F.map_from_entries(F.collect_list(F.struct("category", "values"))).alias("slices"))).alias("_busy"))

    both = pages(rows).withColumn("_run", F.col("run").cast("string")).join(told, "capture", "left")
    for part, name in ((used, "_used"), (busy, "_busy")):
        keyed = part.select(F.col("capture").alias("_c"), F.col("run").cast("string").alias("_r"), F.col("cached").cast("int").alias("_h"), name)
        both = both.join(keyed, (F.col("capture") == F.col("_c")) & (F.col("_run") == F.col("_r")) & (F.col("cached").cast("int") == F.col("_h")), "left").drop("_c", "_r", "_h")
    nothing = F.create_map().cast("map<string,variant>")
    side = F.map_concat(F.coalesce("_wire", nothing), F.create_map(F.lit("_utilization"), F.col("_used"), F.lit("_mainThreadSlices"), F.col("_busy")))
    absent = F.map_filter(side, lambda k, v: v.isNotNull() & ~F.map_contains_key("ext", k))
    return both.withColumn("ext", F.map_concat(F.coalesce("ext", nothing), absent)).drop("_run", "_wire", "_used", "_busy")


def requests_with_scripts(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """requests() with js_timing (start, end): when the scripts of their url ran on the main thread, for the first request of each url of a view.

    names: the events that count, in their order; all of EvaluateScript's category unless given.
    """
    view = ["capture", "run", "cached"]
    ran = script_ranges(rows, names or list(mainthread.CATEGORIES["EvaluateScript"])).groupBy(*view, "url").agg(F.sort_array(F.collect_list(F.struct("n", "start", "end"))).alias("_ran"))
    ran = ran.select(F.col("capture").alias("_c"), F.col("run").cast("string").alias("_r"), F.col("cached").cast("int").alias("_h"), F.col("url").alias("_u"), F.transform("_ran", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("js_timing"))
    own = first_claim(requests(rows), [*view, "url"], ["req"], "_first")
    same = F.col("_first") & (F.col("capture") == F.col("_c")) & (F.col("run").cast("string") == F.col("_r")) & (F.col("cached").cast("int") == F.col("_h")) & (F.col("url") == F.col("_u"))
    return own.join(ran, same, "left").drop("_first", "_c", "_r", "_h", "_u")
