import gzip
import json

import pytest

from netloom.__main__ import main
from netloom.sources.load import formats, load

HAR = {"log": {"version": "1.2", "pages": [], "entries": [{"startedDateTime": "2024-01-01T00:00:00Z", "request": {"method": "GET", "url": "https://a/"}, "response": {"status": 200}, "timings": {"wait": 5}}]}}


def test_formats_and_tables(spark, tmp_path):
    (tmp_path / "a.har").write_text(json.dumps(HAR))
    (tmp_path / "b.har.gz").write_bytes(gzip.compress(json.dumps(HAR).encode()))
    assert sorted((r["gzipped"], r["format"]) for r in formats(spark, str(tmp_path)).collect()) == [(False, "har"), (True, "har")]
    assert load(spark, str(tmp_path))["requests"].count() == 2
    main([str(tmp_path), str(tmp_path / "out"), "--format", "har"])
    assert spark.read.parquet(str(tmp_path / "out" / "requests")).count() == 2
    (tmp_path / "keys.txt").write_text("CLIENT_RANDOM aa bb\n")
    with pytest.raises(ValueError, match="har, keylog"):
        load(spark, str(tmp_path))
    assert load(spark, str(tmp_path / "keys.txt"))["keys"].count() == 1
