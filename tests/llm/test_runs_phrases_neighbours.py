"""Periodic runs, phrases and neighbours against brute force, with nulls, empty and long values, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netloom.llm import ann, periodic_runs, phrases, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, runs string, phrase int, list long"
EDGES = [
    (1, None, "en", "x", 1, 1),
    (2, "", None, "x", 1, 1),
    (3, " \t\n ", "en", None, 1, 1),
    (4, "a a a a a a", "en", "x", 1, 1),
    (4, "a a a a a a", "en", "x", 1, 1),
    (4, "b  c\tb c b c b c x", None, "x", 1, 1),
    (None, "one two one two one two one two", "und", "x", None, None),
    (2**62 + 1, "Ä \x01 Ä \x00 " * 40, "de", "x", 1, 1),
    (6, "u v w " * 3000, "de", "x", 1, 1),
]


# --- periodic runs


def brute_runs(words, least_length, least_exponent):
    found = {}
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_length, least_exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e - s) for (s, e), q in found.items())


def collapse(words, runs):
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40).map(" ".join), max_size=4), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_runs_of_any_texts(texts, least):
    n, runs, collapsed = periodic_runs.find_runs(texts, *least)
    for text, k, own, kept in zip(texts, n, runs, collapsed, strict=True):
        right = brute_runs(text.split(), *least)
        assert [(r["start"], r["period"], r["length"]) for r in own] == right
        assert kept == collapse(text.split(), right) and k == len(text.split())


def test_runs_edge_rows(spark):
    rows = periodic_runs.periodic_runs(spark.createDataFrame(EDGES, SCHEMA)).collect()
    assert len(rows) == len(EDGES)
    right = Counter()
    for row in EDGES:
        words = (row[1] or "").encode().split()
        runs = brute_runs(words, 6, 4)
        right[(row[0], len(words), tuple(runs), collapse([w.decode() for w in words], runs))] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["period"], x["length"]) for x in r["runs"]), r["collapsed"]) for r in rows) == right
    assert periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame(EDGES, SCHEMA), least_exponent=1)


def test_runs_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    told = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert len(told) == len(docs)
    some = 0
    for d in docs:
        words, h = (d["text"] or "").encode().split(), zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = brute_runs(words, 6, 4)
        r, text = told[d["doc_id"]], b" ".join(words).decode()
        best = min(runs, key=lambda x: (-x[2], x[0], x[1]), default=None)
        assert (r["n_runs"], r["start"], r["period"], r["length"]) == (len(runs), *(best or (None, None, None)))
        assert r["exponent_milli"] == (1000 * best[2] // best[1] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(text.split(" ") if text else [], runs).encode()).hexdigest()
        some += bool(runs)
    assert some > 5


def test_repeats_of_edge_rows(spark):
    rows = [(i, t, 1) for i, t in [(None, "a b"), (1, None), (2, ""), (3, "x"), (3, "x")] + [(k, "p q r s t u") for k in range(40)]]
    out = queries.with_repeats(spark.createDataFrame(rows, "doc_id long, text string, _h int")).collect()
    assert len(out) == len(rows)
    assert {r["text"] for r in out if r["doc_id"] is None} == {"a b"} and any(r["text"] not in {t for _, t, _ in rows} for r in out)


# --- phrases


def brute_phrases(rows, max_words, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, f = Counter(), {}
    for lang, text in rows:
        counts = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for i in range(len(words)):
                counts.update(tuple(words[i:j]) for j in range(i + 1, min(len(words), i + max_words) + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if a >= least}
        scored = []
        for p, a in wanted.items():
            if len(p) < 2 or any(len(x) > len(p) and b >= a and any(x[i : i + len(p)] == p for i in range(len(x))) for x, b in wanted.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, x, y) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def phrase_rows(seed, docs=60):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "é", "\x00", "\x01", "a\x01b", "zz", "🙂", *(f"w{i}" for i in range(30))]
    texts = [rng.choice([" ", "\t", "  "]).join(rng.choices(words, k=rng.randrange(60))) + rng.choice([".", ", the cat sat! the cat sat on", "\nThe cat; sat", ""]) for _ in range(docs)]
    return [(i, t, rng.choice(["en", "de", None, "und"]), "x", 1, 1) for i, t in enumerate(texts)]


@pytest.mark.parametrize("max_words,least,top", [(5, 3, 2000), (3, 2, 7), (2, 4, 2000)])
def test_phrases(spark, max_words, least, top):
    rows = phrase_rows(max_words) + EDGES
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), max_words=max_words, least=least, top=top)
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[2], r[1]) for r in rows], max_words, least, top)


def test_phrases_hot_words_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TOGETHER", 500)
    rows = phrase_rows(8, 200) + [(i, f"hot hot w{i % 50} hot pair w{i % 7}", "en", "x", 1, 1) for i in range(300)]
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=5)
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[2], r[1]) for r in rows], 5, 5, 2000)


def test_phrases_of_nothing(spark):
    for rows in ([], [(1, None, None, None, None, None)], [(1, "", "en", None, None, None)], [(1, "x y z", "en", None, None, None)]):
        assert phrases.collocations(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_exact_scores(spark):
    counts = spark.createDataFrame([("en", "a", 1, 3 * 10**9 + 1), ("en", "b", 1, 2 * 10**9), ("en", "a b", 2, 10**9 + 7)], "lang string, phrase string, words int, f long")
    (row,) = phrases.score_phrases(counts, spark.createDataFrame([("en", 10**13 + 9)], "lang string, n long")).collect()
    assert row["score"] == 1000 * (10**9 + 7) * (10**13 + 9) // ((3 * 10**9 + 1) * 2 * 10**9)


@given(st.binary(max_size=6), st.binary(max_size=6))
def test_escaped_words_keep_their_order(x, y):
    assert phrases.unescape(phrases.escape(x)) == x and b"\x00" not in phrases.escape(x)
    assert (phrases.escape(x) < phrases.escape(y)) == (x < y) or x == y


# --- neighbours


def brute_nearest(rows, wanted, k):
    sizes = Counter(len(v) for i, v in rows if i is not None and good(v))
    if not sizes:
        return {}
    dim = max(sizes, key=lambda d: (sizes[d], d))
    kept = sorted({(i, tuple(v)) for i, v in rows if i is not None and good(v) and len(v) == dim})
    dot = lambda x, y: float(np.cumsum(np.array(x, np.float64) * np.array(y, np.float64))[-1])
    out = {}
    for i, v in kept:
        if wanted(i):
            near = sorted((-dot(u, v), j) for j, u in kept if j != i)[:k]
            out[(i, v)] = [(r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return out


def good(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def some_vectors(seed, n, dim=12):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)) * rng.uniform(0.1, 3, (n, 1))
    rows = [(int(i), [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    common = rows[1][1]
    rows += [(n + i, common) for i in range(150)] + [rows[0], rows[5]]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * dim, [None, *common[1:]], [nan, *common[1:]], [inf, *common[1:]], common[:-1]]
    return rows + [(10_000 + 20 * i, b) for i, b in enumerate(bad)] + [(None, common)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_of_edge_rows(spark, kind):
    rows = some_vectors(3, 300)
    data = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, ids string, class int").repartition(4)
    got = {}
    for r in ann.nearest(data, F.col("vec_id") % 20 == 0, k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    right = {i: v for (i, _), v in brute_nearest(rows, lambda i: i % 20 == 0, 7).items()}
    assert {i: sorted(v) for i, v in got.items()} == right  # one list here: nothing is lost but by the tests of hypotheses


def test_neighbours_with_fewer_candidates_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert ann.nearest(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], schema), F.lit(True)).count() == 0
    assert ann.nearest(spark.createDataFrame([(1, [1.0, 0.0])], schema), F.lit(True)).count() == 0
    two = ann.nearest(spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0])], schema), F.lit(True)).collect()
    assert sorted(map(tuple, two)) == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]


def test_recall_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 64)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((4000, 24)).astype(np.float32) + 2 * rng.standard_normal((30, 24)).astype(np.float32)[rng.integers(0, 30, 4000)]
    data = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(data, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert len(got) == 200
    wide = v.astype(np.float64)
    hits = 0
    for q, found in got.items():
        score = wide @ wide[q]
        score[q] = -np.inf
        hits += len({i for _, i in found} & set(np.argsort(-score)[:20].tolist()))
        assert [r for r, _ in sorted(found)] == list(range(1, 21))
    assert hits >= 0.9 * 20 * len(got)
