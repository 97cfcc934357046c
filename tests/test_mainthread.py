"""Slices of nested spans against a walk over them one by one, and spans of traces."""

import json
import random

from pyspark.sql import functions as F

from netloom.operators import mainthread
from netloom.sources import json_captures as J

WIDTH = 100


def walk(rows):
    """rows (start, end, depth, name, parent): shares of names in slices, with the cap of a slice."""
    names, slices = [], {}
    for s, e, _, name, parent in sorted(rows, key=lambda r: (r[0], r[2])):
        if name not in names:
            names.append(name)
    for s, e, _, name, parent in sorted(rows, key=lambda r: (r[0], r[2])):
        if name == parent:
            continue
        for k in range(s // WIDTH, (max(s, e - 1)) // WIDTH + 1):
            used = min(e, (k + 1) * WIDTH) - max(s, k * WIDTH)
            if used <= 0:
                continue
            one = slices.setdefault(k, {"total": 0})
            one[name] = one.get(name, 0) + used
            one["total"] += used
            if parent is not None and one.get(parent, 0) >= used:
                one[parent] -= used
                one["total"] -= used
            one[name] = min(one[name], WIDTH)
            if one["total"] > WIDTH:
                room = WIDTH - used
                for other in names:
                    if other != name and other in one:
                        one[other] = min(one[other], room)
                        room -= one[other]
                one["total"] = WIDTH - room
    return {(k, n): v for k, one in slices.items() for n, v in one.items() if n != "total"}


def test_slices(spark):
    rng = random.Random(2)
    rows = []
    for u in range(40):
        for at in rng.sample(range(2000), 30):
            end, name = at + rng.randrange(0, 250), rng.choice("abc")
            rows.append((u, at, end, 1, name, None))
            for k in range(rng.randrange(4)):
                rows.append((u, at + k + 1, at + k + 1 + rng.randrange(0, 200), 2, rng.choice("abcd"), name))
    df = spark.createDataFrame(rows, "u long, start long, end long, depth int, name string, parent string").dropDuplicates(["u", "start", "depth"])
    kept = [tuple(r) for r in df.collect()]
    got = {}
    for r in mainthread.exclusive_slices(df, "u", "start", "end", "name", WIDTH).collect():
        got.setdefault(r["u"], {})[(r["slice"], r["name"])] = r["usecs"]
    for u in range(40):
        assert got.get(u, {}) == walk([r[1:] for r in kept if r[0] == u])
    assert max(v for one in got.values() for v in one.values()) == WIDTH
    assert mainthread.exclusive_slices(df.limit(0), "u", "start", "end", "name", WIDTH).count() == 0


def test_trace_spans_of_one_name_with_scripts(spark, tmp_path):
    event = lambda ph, name, ts, dur=None, **data: {"ph": ph, "name": name, "pid": 1, "tid": 2, "ts": ts, "cat": "x", **({"dur": dur} if dur is not None else {}), "args": {"data": data}}
    events = [
        event("B", "X", 10), event("E", "Y", 20),  # an end of another name makes no span
        event("B", "Run", 100), event("X", "EvaluateScript", 110, 50, url="https://a/s.js"), event("X", "EvaluateScript", 120, 10, url="https://a/s.js"), event("X", "FunctionCall", 130, 5, url="https://a/f.js#x"), event("E", "Run", 200),
        event("X", "FunctionCall", 300, 5, scriptName="native", url="chrome://x"),
    ]
    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": events}))
    spans = J.trace_spans(J.trace_events(J.documents(spark, str(tmp_path))))
    told = sorted((r["start"], r["end"], r["depth"], r["name"], r["parent"], r["script"]) for r in spans.collect())
    assert told == [
        (100, 200, 1, "Run", None, None),
        (110, 160, 2, "EvaluateScript", "Run", "https://a/s.js"),
        (120, 130, 2, "EvaluateScript", "Run", "https://a/s.js"),
        (130, 135, 2, "FunctionCall", "Run", "https://a/f.js"),
        (300, 305, 1, "FunctionCall", None, None),
    ]
    assert sorted((r["script"], r["start"], r["end"]) for r in J.script_times(spans).collect()) == [("https://a/f.js", 130, 135), ("https://a/s.js", 110, 160)]
    base = spark.createDataFrame([(spans.first()["thread"].split("\t")[0], 0.1)], "capture string, base double")
    slices = {(r["name"], r["slice"], r["slice_usecs"]): r["usecs"] for r in J.trace_slices(spans, base).collect()}
    told = {}
    for (name, at, width), n in slices.items():
        assert width == 1 and n in (0, 1)
        told[name] = told.get(name, 0) + n
    # at this width a slice is one event's: the call takes it from the script, whose parent it shares
    assert told == {"Run": 50, "EvaluateScript": 45, "FunctionCall": 10}


def test_widths_of_slices(spark):
    spans_us = {1: 1, 2000: 1, 2001: 1, 20_000: 1, 20_001: 10, 200_000: 10, 200_001: 100, 5_000_000: 1000}
    df = spark.createDataFrame([(k,) for k in spans_us], "s long")
    assert {r["s"]: r["w"] for r in df.select("s", mainthread.slice_width(F.col("s")).alias("w")).collect()} == spans_us


def test_long_tasks_of_a_trace(spark, tmp_path):
    event = lambda name, ts, dur, cat="x": {"ph": "X", "name": name, "pid": 1, "tid": 2, "ts": ts, "dur": dur, "cat": cat, "args": {}}
    events = [event("a", 1_000_000, 60_000), event("b", 1_060_000, 50_000), event("t", 1_060_000, 50_000, "toplevel"), event("c", 2_000_000, 50_001)]
    (tmp_path / "t.json").write_text(json.dumps(events))
    raw = J.trace_events(J.documents(spark, str(tmp_path)))
    base = raw.select("capture", F.lit(1000.0).alias("base")).distinct()
    got = sorted((r["start_ms"], r["end_ms"], r["n"]) for r in J.trace_long_tasks(J.trace_spans(raw), raw, base).collect())
    assert got == [(0, 110, 2), (1000, 1051, 1)]


def test_shells(spark, tmp_path):
    for name, doc in {"a": {}, "b": {"log": {"pages": 3, "entries": [{"x": 1}]}}, "c": {"log": {"pages": [1]}}}.items():
        (tmp_path / name).write_text(json.dumps(doc))
    got = {r["capture"][-1]: json.loads(r["har"])["log"] for r in J.har_shell(J.documents(spark, str(tmp_path))).collect()}
    assert {k: (v["pages"], v["entries"]) for k, v in got.items()} == {"a": ([], []), "b": ([], [{"x": 1}]), "c": ([1], [])} and got["a"]["version"] == "1.2"
