"""Captures that are read in byte ranges give what they give when they are read whole."""

import gzip
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from netloom.sources import json_captures, json_ranges, packets, ranges
from netloom.sources.load import formats, load

from tests.test_sources import frame


def classic(frames, order="<"):
    return struct.pack(order + "IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(order + "IIII", i, 5, len(f), len(f)) + f for i, f in enumerate(frames))


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def sections(frames, order="<"):
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order) + block(1, struct.pack(order + "HHI", 1, 0, 0), order)
    for i, f in enumerate(frames):
        if i == len(frames) // 2:
            out += block(1, struct.pack(order + "HHI", 113, 0, 0), order)
        cooked = i > len(frames) // 2 and i % 3 == 0
        f = b"\0" * 14 + f[12:] if cooked else f
        out += block(6, struct.pack(order + "IIIII", int(cooked), 0, i, len(f), len(f)) + f, order)
    return out


def some_frames(seed, n=120):
    """Frames of which some carry what looks like a capture themselves."""
    rng = random.Random(seed)
    inner = classic([frame(1, 2, 3, 4, bytes([rng.randrange(256)]) * rng.randrange(9)) for _ in range(12)])[24:]
    return [frame(5000, 80, i, 24, inner if rng.random() < 0.2 else rng.randbytes(rng.randrange(300))) for i in range(n)]


@pytest.mark.parametrize("make", [classic, lambda f: classic(f, ">"), sections, lambda f: sections(f, ">"), lambda f: classic(f)[:-7], lambda f: sections(f) + b"\6\0\0\0\xff\xff"])
def test_packets_by_ranges(spark, tmp_path, make):
    for i in range(2):
        (tmp_path / f"{i}.cap").write_bytes(make(some_frames(i)))
    (tmp_path / "z.cap").write_bytes(gzip.compress(make(some_frames(3))))
    whole = packets.packets(spark, str(tmp_path)).orderBy("capture", "ord").collect()
    parts = packets.packets(spark, str(tmp_path), small=100, size=2000).orderBy("capture", "ord").collect()
    assert whole == parts and len(whole) > 300


def test_what_looks_like_a_record_is_not_one(spark, tmp_path):
    """A range that begins within a frame full of records finds one of these, and is read again from the right place."""
    inner = classic([b"x" * 40] * 60)[24:]
    (tmp_path / "a.cap").write_bytes(classic([frame(5000, 80, 1, 24, inner), *some_frames(5, 30)]))
    large = ranges.files(spark, str(tmp_path))
    found = packets.bounds(large, 1000).orderBy("offset").collect()
    assert found[0]["start"] == 24 and found[1]["start"] == 24 + 16 + len(frame(5000, 80, 1, 24, inner))
    whole = packets.packets(spark, str(tmp_path)).orderBy("ord").collect()
    assert packets.packets(spark, str(tmp_path), small=100, size=1000).orderBy("ord").collect() == whole


def test_heads_of_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "SMALL", 1000)
    text = json.dumps({"log": {"version": "1.2", "pages": [], "entries": ["x" * 5000]}})
    (tmp_path / "a").write_text(text)
    (tmp_path / "b").write_bytes(gzip.compress(text.encode() + random.Random(1).randbytes(5000)))
    (tmp_path / "c").write_text(text[:40])
    (tmp_path / "d").write_bytes(b"\x1f\x8b damaged")
    assert sorted((r["capture"][-1], r["gzipped"], r["format"]) for r in formats(spark, str(tmp_path)).collect()) == [("a", False, "har"), ("b", True, "har"), ("c", False, "har"), ("d", True, "unknown")]
    assert [len(r["head"]) for r in ranges.heads(spark, str(tmp_path), 100).orderBy("capture").collect()] == [100, 100, 40, 0]


def test_members_of_gzip():
    data = gzip.compress(b"ab") + gzip.compress(b"cd")
    assert b"".join(ranges.inflated(iter([data]))) == b"abcd"
    assert b"".join(ranges.inflated(data[i : i + 3] for i in range(0, len(data), 3))) == b"abcd"
    assert b"".join(ranges.inflated(iter([data[:-4]]))) == b"abcd" and b"".join(ranges.inflated(iter([b"plain", b"er"]))) == b"plainer"


# --- JSON


def texts(rng, n):
    """Strings that look like structure, with escapes of all kinds."""
    parts = ['"', "\\", "\\\\", "{", "}", "[", "]", ",", ":", '"log":[', "é", "🙂", " ", "\n", "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def capture_texts(seed):
    rng = random.Random(seed)
    value = lambda d=0: rng.choice([1, None, True, rng.choice(texts(rng, 3)), *([] if d > 2 else [[value(d + 1) for _ in range(rng.randrange(3))], {t + str(i): value(d + 1) for i, t in enumerate(texts(rng, 2))}])])
    elements = lambda n: [{"a": value(), "entries": [value(), {"log": {"pages": [1]}}], "traceEvents": [3]} for _ in range(n)]
    shape = rng.choice([None, 2])
    return {
        "har": json.dumps({"pages": [9], "log": {"creator": {"pages": {"x": [1]}}, "pages": elements(3), "entries": elements(30), "x": value()}, "entries": [4]}, indent=shape, ensure_ascii=False),
        "trace": json.dumps({"metadata": value(), "traceEvents": elements(40), "log": [1, 2]}, indent=shape),
        "bare": json.dumps([value() for _ in range(60)], indent=shape),
        "none": json.dumps({"empty": value()}),
        "hollow": json.dumps({"traceEvents": [], "y": value()}),
    }


def rebuilt(rows):
    """Elements by their members and places."""
    out = {}
    for r in rows:
        doc, members = json.loads(r["text"]), []
        while isinstance(doc, dict):
            (k, doc), = doc.items()
            members.append(k)
        for i, x in enumerate(doc):
            assert out.setdefault((*members, r["first"] + i), x) is x  # each element once
    return out


@pytest.mark.parametrize("seed,size,piece", [(1, 7, 50), (2, 64, 1), (3, 100, 10_000), (4, 1000, 300)])
def test_json_by_ranges(spark, tmp_path, monkeypatch, seed, size, piece):
    monkeypatch.setattr(ranges, "BLOCK", 13)
    told = capture_texts(seed)
    for name, text in told.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows, known = json_ranges.slices(ranges.files(spark, str(tmp_path)), size, piece)
    found = {}
    for r in rows.collect():
        found.setdefault(r["capture"].rsplit("/", 1)[1], []).append(r)
    right = {k: json.loads(t) for k, t in told.items()}
    entries = {("log", n, i): x for n in ("pages", "entries") for i, x in enumerate(right["har"]["log"][n])}
    assert rebuilt(found["har"]) == entries
    assert rebuilt(found["trace"]) == {("traceEvents", i): x for i, x in enumerate(right["trace"]["traceEvents"])}
    assert rebuilt(found["bare"]) == {(i,): x for i, x in enumerate(right["bare"])}
    assert "none" not in found and rebuilt(found.get("hollow", [])) == {}
    assert {r["capture"].rsplit("/", 1)[1] for r in known.collect()} >= {"har", "trace", "bare", "hollow"}


def test_tables_of_large_files_equal_those_of_small_ones(spark, tmp_path, monkeypatch):
    entry = lambda i: {"startedDateTime": f"2024-01-01T00:00:{i % 60:02d}Z", "request": {"method": "GET", "url": f'https://a/{i}?"[{{'}, "response": {"status": 200}, "timings": {"wait": i, "connect": i % 3}}
    (tmp_path / "a.har").write_text(json.dumps({"log": {"version": "1.2", "pages": [{"id": "p", "title": "t"}], "entries": [entry(i) for i in range(300)]}}))
    (tmp_path / "b.har").write_bytes(gzip.compress((tmp_path / "a.har").read_bytes()))  # told by content, not by name
    names = ("pages", "requests")
    rows = lambda: {n: sorted(map(str, load(spark, str(tmp_path))[n].collect())) for n in names}
    whole = rows()
    monkeypatch.setattr(ranges, "SMALL", 1000)
    monkeypatch.setattr(ranges, "RANGE", 3000)
    monkeypatch.setattr(json_captures, "PIECE", 4000)
    assert rows() == whole and len(whole["requests"]) == 600
