"""A history by versions against a dict that is changed in place."""

import random

from pyspark.sql import functions as F

from netloom.operators.history import History


def test_history(spark, tmp_path):
    h, right, rng = History(spark, f"file://{tmp_path}/h", {"title": "string", "size": "long"}), {}, random.Random(3)
    assert h.entries().count() == 0
    frame = lambda rows: spark.createDataFrame(rows, "id string, title string, size long, other int")
    for step in range(9):
        keys = [f"k{i}" for i in rng.sample(range(12), 6)]
        op = ("put", "update", "delete", "update")[step % 4]
        rows = [(k, rng.choice([None, f"T{step}"]), rng.choice([None, step]), 1) for k in keys]
        getattr(h, op)(frame(rows + rows[:1] + [(None, "x", 1, 1)]))
        for k, title, size, _ in rows:
            if op == "put":
                right[k] = (title, size)
            elif op == "delete":
                right.pop(k, None)
            elif k in right:
                right[k] = (title or right[k][0], right[k][1] if size is None else size)
        if step == 5:
            h.compact()
        assert {r["id"]: (r["title"], r["size"]) for r in h.entries().collect()} == right
    (tmp_path / "h" / "batch=000099").mkdir()  # a write that never ended
    found = h.page("T", ["title"], [F.col("id")], 2, 2).collect()
    assert [r["id"] for r in found] == sorted(k for k, v in right.items() if v[0])[2:4]
    h.delete(frame([(k, None, None, 1) for k in right]))
    h.compact()
    assert h.entries().count() == 0
