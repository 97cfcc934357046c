"""Loading captures whose format is told by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.text import sniff_capture
from netloom.sources import archives, http1, http1_framing, json_captures, lines, lookups, packets, ranges

#: Bytes of a file's beginning that tell its format.
HEAD = 65_536


def formats(spark: SparkSession, path: str) -> DataFrame:
    """capture, gzipped, format: one row per file, by its first 64 KB after gzip; of a large file no more is read."""
    return ranges.heads(spark, path, HEAD).select("capture", "gzipped", sniff_capture(F.col("head")).alias("format"))


def _netlog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    events = lines.named_events(*lines.netlog_lines(spark, path))
    return {"events": events, "requests": lines.netlog_stitched(events), "sockets": lines.netlog_sockets(events), "lookups": lines.netlog_lookups(events)}


def _protocol(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    events = json_captures.protocol_events(json_captures.documents(spark, path))
    return {"events": events, "requests": json_captures.protocol_requests(events)}


def _har(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    docs = json_captures.documents(spark, path)
    return {"pages": json_captures.har_pages(docs), "requests": json_captures.har_requests(docs)}


def _results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    docs = json_captures.documents(spark, path)
    views = json_captures.result_views(docs)
    return {"pages": json_captures.view_pages(views), "requests": json_captures.wpt_requests(docs), "utilization": json_captures.view_utilization(views, F.try_variant_get("view", "$.bwDown", "double"))}


def _trace(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    events = json_captures.trace_events(json_captures.documents(spark, path))
    spans = json_captures.trace_spans(events)
    requests = json_captures.trace_requests(events)
    base = json_captures.trace_base(requests)
    return {"events": events, "spans": spans, "scripts": json_captures.script_times(spans), "slices": json_captures.trace_slices(spans, base), "long_tasks": json_captures.trace_long_tasks(spans, events, base), "requests": requests}


def _packets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    read = packets.packets(spark, path)
    flows = packets.flows(read)
    said = lookups.messages(read).unionByName(lookups.stream_messages(http1.new_segments(flows)))
    plain = http1_framing.exchanges(flows)
    found = lookups.lookups(said).unionByName(lookups.http_lookups(plain))
    return {"packets": flows, "flow_stats": packets.flow_stats(flows), "lookups": found, "requests": http1.with_lookups(http1_framing.requests_of(plain), found)}


def _archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    rows = archives.members(spark, path)
    return {"members": rows, "pages": archives.pages_with_side_data(rows), "requests": archives.requests_with_scripts(rows), "connectivity": archives.connectivity(rows), "progress": archives.progress(rows), "cpu_slices": archives.cpu_slices(rows)}


READERS = {
    "har": _har,
    "wpt": _results,
    "cdp": _protocol,
    "chrome-trace": _trace,
    "netlog": _netlog,
    "keylog": lambda spark, path: {"keys": lines.keylog(spark, path)},
    "tcpdump": _packets,
    "wptagent": _archive,
}


def told_format(spark: SparkSession, path: str) -> str:
    """The format of the captures at path, by their content. Raises ValueError where there are several, or one that no reader knows."""
    found = sorted(r["format"] for r in formats(spark, path).select("format").distinct().collect())
    if len(found) != 1 or found[0] not in READERS:
        raise ValueError(f"{path} must hold captures of one known format, not: {', '.join(found) or 'nothing'}")
    return found[0]


def load(spark: SparkSession, path: str, kind: str | None = None) -> dict[str, DataFrame]:
    """The tables of the captures at path, which have one format; it is told by their content unless given.

    Raises ValueError where files are of several formats, or of one that no reader knows.
    """
    return READERS[kind or told_format(spark, path)](spark, path)
