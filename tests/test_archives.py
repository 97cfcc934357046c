import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from netloom.functions import network as N
from netloom.operators import series as S
from netloom.sources import archives as A

CPU = {"main_thread": "1:2", "slice_usecs": 1000, "total_usecs": 3000, "slices": {"1:2": {"Layout": [0, 5, 7], "Paint": [1]}, "1:3": {"Paint": [9]}}}
SCRIPT = {"main_thread": "1:2", "1:2": {"https://a/x.js": {"EvaluateScript": [[5, 6]], "FunctionCall": [[1, 2], [3]], "Other": [[8, 9]]}, "https://a/y.js": {}}}
CSV = "Offset Time (ms),Bandwidth In (bps),CPU Utilization (%),Memory\n0,100,1.5,-1\r\n100,300,20.25,77\n100,200,x\nbad,1,1,1\n\n"


def archive(path):
    nested = io.BytesIO()
    with zipfile.ZipFile(nested, "w") as z:
        z.writestr("001-body.txt", "hello")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("testinfo.json", json.dumps({"bwIn": 5000, "latency": 28, "plr": 0}))
        z.writestr("1_progress.csv.gz", gzip.compress(CSV.encode()))
        z.writestr("1_Cached_timeline_cpu.json", json.dumps(CPU))
        z.writestr("2_script_timing.json", json.dumps(SCRIPT))
        z.writestr("2_timeline_cpu.json", "not json")
        z.writestr("1_bodies.zip", nested.getvalue())


def test_archive_members(spark, tmp_path):
    archive(tmp_path / "a.zip")
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    rows = A.members(spark, str(tmp_path / "*.zip"))
    assert {(r["member"], r["inner"], r["run"], r["cached"]) for r in rows.collect()} == {
        ("testinfo.json", None, None, None), ("1_progress.csv.gz", None, 1, 0), ("1_Cached_timeline_cpu.json", None, 1, 1),
        ("2_script_timing.json", None, 2, 0), ("2_timeline_cpu.json", None, 2, 0), ("1_bodies.zip", "001-body.txt", 1, 0),
    }
    assert A.connectivity(rows).drop("capture").collect() == [(5000.0, None, 28.0, None)]
    samples = {(r["series"], r["ts"], r["value"], r["most"]) for r in A.progress(rows).collect()}
    assert samples == {("bw", 0, 100.0, 200.0), ("bw", 100, 200.0, 200.0), ("cpu", 0, 1.5, 100.0), ("cpu", 100, 20.25, 100.0), ("mem", 100, 77.0, 77.0)}
    assert {(r["cached"], r["event"], r["slice"], r["usecs"]) for r in A.cpu_slices(rows).collect()} == {(1, "Layout", 1, 5.0), (1, "Layout", 2, 7.0), (1, "Paint", 0, 1.0)}
    ranges = A.script_ranges(rows, ["FunctionCall", "EvaluateScript"]).orderBy("n").collect()
    assert [(r["url"], r["start"], r["end"]) for r in ranges] == [("https://a/x.js", 1.0, 2.0), ("https://a/x.js", 5.0, 6.0)]
    capture = rows.first()["capture"]
    entries = spark.createDataFrame([(capture, 1, 0, "001-body.txt"), (capture, 1, 1, "001-body.txt")], "capture string, run int, cached int, body_file string")
    assert {(r["cached"], r["body"] and bytes(r["body"])) for r in A.bodies(rows, entries).collect()} == {(0, b"hello"), (1, None)}


def test_clock_without_absolute_time_starts_at_the_packet(spark):
    rows = [("a", 1, None, None, 0), ("a", 2, None, 5, 100), ("a", 3, None, 5, 900), ("a", 4, 50, 7, 0), ("a", 5, None, None, 9), ("b", 1, None, 3, 0)]
    df = spark.createDataFrame(rows, "s string, i int, absolute long, delta long, packet long")
    assert [r["clock"] for r in S.sequence_clock(df, "s", "i", "absolute", "delta", "packet").orderBy("s", "i").collect()] == [0, 105, 110, 50, 50, 3]


def test_private_hosts_at_the_edges(spark):
    told = {"172.15.255.255": False, "172.16.0.0": True, "172.32.0.0": False, "100.63.1.1": False, "100.64.0.1": True, "223.255.255.255": False, "224.0.0.1": True, "300.1.1.1": True, "[fe7f::1]": False, "[FEBF::1]": True, "[]": True, "[64:ff9b::1]": True, "[::]": True, "[::1]": True, "[::2]": False, "[FD12:3456::1]": True, "[fe00::1]": False, "[100::]": True, "[0100:0:0:0:1::1]": True, "[100:0:0:1::1]": False, "[::ffff:10.1.2.3]": True, "[::ffff:8.8.8.8]": False, "[2001:db8:0:0:1:2:3:4]": False, "[1:2]": True, "[1::2::3]": True, "[2001:4860::8888]": False, "example.localhost": True, "localhost.example": False}
    df = spark.createDataFrame([(h,) for h in told] + [(None,)], "h string")
    assert {r["h"]: r["p"] for r in df.select("h", N.is_private_host(F.col("h")).alias("p")).collect()} == told | {None: True}


def test_side_data_of_pages(spark, tmp_path):
    asked = [{"full_url": u, "responseCode": 200} for u in ("https://a/x.js", "https://a/x.js", "https://a/y.js")]
    page = {"date": 1, "URL": "https://a/", "latency": 7}
    script = {"main_thread": "1:2", "1:2": {"https://a/x.js": {"EvaluateScript": [[5, 6]], "FunctionCall": [[1, 2]]}}}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("testinfo.json", json.dumps({"bwIn": 5000, "latency": 28}))
        for view in ("1", "1_Cached"):
            z.writestr(f"{view}_devtools_requests.json", json.dumps({"requests": asked, "pageData": page}))
        z.writestr("1_progress.csv", CSV)
        z.writestr("1_timeline_cpu.json", json.dumps(CPU))
        z.writestr("1_Cached_script_timing.json", json.dumps(script))
    rows = A.members(spark, str(tmp_path / "a.zip"))
    told = A.pages_with_side_data(rows).select("cached", F.to_json(F.to_variant_object("ext")).alias("ext")).collect()
    first, again = (json.loads(next(r["ext"] for r in told if int(r["cached"]) == c)) for c in (0, 1))
    assert first["_bwDown"] == 5000 and first["_latency"] == 7 and "_plr" not in first and "_utilization" not in again and again["_bwDown"] == 5000
    assert first["_utilization"] == {"series": {"bw": [[0, 50], [100, 100]], "cpu": [[0, 1.5], [100, 20.25]], "mem": [[100, 100]]}, "most": {"bwMax": 200, "cpuMax": 100, "memMax": 77}}
    assert first["_mainThreadSlices"] == {"slice_usecs": 1000, "slices": {"Layout": [0, 5, 7], "Paint": [1, 0, 0]}}
    ran = {(int(r["cached"]), r["req"]): r["js_timing"] for r in A.requests_with_scripts(rows, ["FunctionCall", "EvaluateScript"]).collect()}
    assert [tuple(x) for x in ran[1, 0]] == [(1, 2), (5, 6)] and sum(v is not None for v in ran.values()) == 1
