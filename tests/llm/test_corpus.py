"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import base64
import collections
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netloom.llm import bpe, exact_dedup, license_scan, lm_scoring, near_dup, packing, quality_rules, queries, sharding, token_counts, warc
from netloom.llm.common import Work, parted, shared_folder

DATA, MULTI, WORD = "/root/testdata/sf0.001", public_tokenizers.path(queries.MULTI), public_tokenizers.path(queries.WORD)
SCHEMA = "doc_id long, text string, lang string, n_chars long, keep_id long, kept string, n int, value string, node int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", "   ", "one two", "one\ttwo ", "x", "Ärger Ünder Straße, don't 123 日本語 🙂", "a" * 5000, words(rng, 9000)]
    base = words(rng, 120).split()
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [words(rng, 200) for _ in range(20)] + [texts[9]] * 150
    out = [(i, t, "en", 3, 1, "x", 1, "v", 2) for i, t in enumerate(texts)]
    return [*out, out[3], out[9], (None, "no id here at all", "de", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(pairs):
    sets = {i: shingle_set(t) for i, t in pairs if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (root(i), len(sets[i])) for i in ids}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, rows, empty):
    want = brute_components([r[:2] for r in rows])
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["component_id"], r["n_shingles"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_dup.near_duplicates(empty).count() == 0
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i, (c, _) in want.items() if i == c} | {None}


def test_near_duplicates_with_small_sketches(spark):
    """Chains of links beyond the size of a sketch."""
    rng = random.Random(8)
    base, rows = words(rng, 300, 10**6).split(), []
    for i in range(120):
        for _ in range(3):
            base[rng.randrange(len(base))] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, k=64).collect()}
    assert got == {i: c for i, (c, _) in brute_components(rows).items()}


def test_rows_that_repeat_an_id_with_other_texts(spark):
    a, b = words(random.Random(1), 80), words(random.Random(2), 80)
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (9, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (9, 5, False), (9, 5, False)]
    assert sorted(map(tuple, near_dup.drop_near_duplicates(df).collect())) == [(1, a), (5, b)]


@pytest.mark.parametrize("rounds", [0, 2])
def test_close_texts_that_are_not_close_enough(spark, monkeypatch, rounds):
    """Large groups around a text that is not there, in long lists of whole sets; some of them are linked, most are not."""
    monkeypatch.setattr(near_dup, "SHORT", 2)
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dup, "WORTH", 0)
    rng, rows = random.Random(11), []
    for size in (60, 150, 400):
        base = words(rng, size, 10**6).split()
        for _ in range(50):
            w = list(base)
            for _ in range(rng.randrange(size // 60, size // 18)):
                w[rng.randrange(size)] = f"n{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(w[: rng.randrange(size * 4 // 5, size + 1)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {i: c for i, (c, _) in brute_components(rows).items()}
    assert 10 < len(set(want.values())) < 140
    for k in (48, near_dup.K):
        assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, k=k).collect()} == want


def test_similarity_is_that_of_the_shingles():
    rng = random.Random(12)
    for n in (0, 1, 4, 5, 6, 40, 300):
        a = [f"w{rng.randrange(9)}" for _ in range(n)]
        for edits in (0, 1, 2, n // 9):
            b = list(a)
            for _ in range(edits):
                b[rng.randrange(len(b)) if b else 0 :] = ["x"]
                b += a[len(b) :]
            x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
            if x and y:
                assert near_dup.similar(" ".join(a), " ".join(b), 5, 75) == (100 * len(x & y) >= 75 * len(x | y))


def test_exact_copies(docs, rows, empty):
    norm = lambda t: " ".join(x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or ""))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[hashlib.sha256(norm(r[1]).encode()).hexdigest()].append(r[0])
    for tracked in (8, exact_dedup.TRACKED):
        got = exact_dedup.exact_copies(docs, tracked=tracked).collect()
        assert len(got) == len(rows)
        for r in got:
            ids = groups[r["text_sha256"]]
            assert (r["keep_id"], r["group_size"]) == (min((i for i in ids if i is not None), default=None), len(ids))
        kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
        assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert exact_dedup.exact_copies(empty).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert {hashlib.sha256(norm(r["text"]).encode()).hexdigest() for r in left.collect()} == set(groups)
    assert exact_dedup.drop_copies(empty).count() == 0


def test_exact_copies_of_rows_that_repeat(spark):
    """Groups large enough to be settled where they are read: of one id, of null ids, of both."""
    rows = [(7, "same")] * 300 + [(None, "none")] * 200 + [(None, "both")] * 150 + [(4, "both")] * 150 + [(3, "both"), (8, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_copies(df).collect()
    assert collections.Counter((r["keep_id"], r["group_size"]) for r in got) == {(7, 300): 300, (None, 200): 200, (3, 301): 301, (8, 1): 1}
    assert sorted(str(r["doc_id"]) for r in got if r["kept"]) == ["3", "7", "8", "None"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.drop_copies(df).collect()) == [("3", "both"), ("7", "same"), ("8", "one"), ("None", "none")]


def test_heavy_hitters_are_exact(spark):
    df = spark.createDataFrame([(i, f"k{i % 3 if i % 2 else i}") for i in range(3000)], "id long, k string")
    got = {r["k"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.heavy_hitters(df, "k", "id", 16).collect()}
    assert got == {"k0": (0, 501), "k1": (1, 500), "k2": (2, 501)}


def test_token_counts(docs, rows, empty):
    enc = bpe.encoding(MULTI)
    n = sorted(len(enc.encode_ordinary(r[1] or "")) for r in rows)
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs, MULTI))
    for r in sums.collect():
        size = r["n_tokens"]
        assert (r["docs"], r["docs_at_least"], r["tokens_at_least"]) == (n.count(size), sum(x >= size for x in n), sum(x for x in n if x >= size))
        assert (r["docs_truncated"], r["truncated_tokens"], r["total_tokens"]) == (sum(x > size for x in n), sum(min(x, size) for x in n), sum(n))
    limits = {r["limit"]: (r["docs_truncated"], r["truncated_tokens"]) for r in token_counts.context_limits(sums, [0, 10, 777, 10**7]).collect()}
    assert limits == {k: (sum(x > k for x in n), sum(min(x, k) for x in n)) for k in (0, 10, 777, 10**7)}
    for r in token_counts.length_quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["n_tokens"] == next(x for x in n if sum(y <= x for y in n) >= r["share"] * len(n) - 1e-9)
    assert token_counts.suffix_sums(token_counts.length_histogram(empty, MULTI)).count() == 0


@settings(max_examples=300, deadline=None)
@example("aaaaaaa  's's  \xa0a")
@given(st.lists(st.sampled_from(["a", "Z", "é", " ", "  ", "\n", "\t", "'s", "'", "12", "!?", "日", " ", "🙂", "aaaaaaaaaaaaaaaaaaaaaaaa"]), max_size=120).map("".join))
def test_stitched_pieces_encode_alike(text):
    whole, chunk, overlap = bpe.encode(text, MULTI).tolist(), 16, 8
    edges = [bpe.chunk_edges(text[s : s + chunk + overlap], s, chunk, overlap, len(text)) for s in range(0, len(text), chunk)]
    starts = bpe.stitches(edges, chunk, text)
    pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    assert "".join(pieces) == text and [i for p in pieces for i in bpe.encode(p, MULTI).tolist()] == whole


def test_bpe_round_trip(docs, rows, empty):
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r[0] if r[0] is not None else -1, np.array(own.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (200, 40)):
        got = bpe.decode_ids(bpe.encode_texts(docs, MULTI, chunk=chunk, overlap=overlap), MULTI).collect()
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode_texts(empty, MULTI).count() == 0


def test_packing(docs, rows, empty):
    tok = Tokenizer.from_file(WORD)
    tok.encode_special_tokens = True
    ids = {r[0]: np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows}
    got = packing.pack_documents(docs, WORD, group_docs=100).collect()
    covered, bins = collections.Counter(), collections.defaultdict(list)
    for r in got:
        own = ids[r["doc_id"]]
        assert zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(own)
        covered[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {i: len(ids[i]) * n for i, n in collections.Counter(r[0] for r in rows).items()}
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 4096
    assert packing.pack_documents(empty, WORD).count() == 0


def test_word_ids_agree_with_the_tokenizer():
    texts = [r[0] for r in duckdb.sql(f"select text from '{DATA}/documents.parquet'").fetchall()] + ["İstanbul ΣΑΣ naïve é <|endoftext|> \x01 a\x01b c 'S it's"]
    tok = Tokenizer.from_file(WORD)
    tok.encode_special_tokens = True
    for text, ids in zip(texts, packing.WordIds(WORD).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    room, want = [], []
    for s in sizes:
        b = next((i for i, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= s
        want.append(b)
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_quality_statistics_and_rules(spark, docs, rows, empty):
    got = collections.defaultdict(list)
    for r in quality_rules.statistics(docs).collect():
        got[r["doc_id"]].append(r)
    for r in rows:
        w, cover = (r[1] or "").encode().split(), set()
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        assert all((x["n_words"], x["n_repeat_words"]) == (len(w), len(cover)) for x in got[r[0]])
    assert quality_rules.text_counts("a b\n\n a b\n#a b\na b a b a b")[:5] == (12, 13, 1, 0, 11)
    assert quality_rules.judge(quality_rules.statistics(empty), []).count() == 0
    told = queries.QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed")
    hits = told.agg(F.count(F.when((F.col("quality") == 0) & ~F.col("kept"), 1)), F.count(F.when(F.col("quality") == 0, 1)), F.count(F.when((F.col("quality") == 1) & ~F.col("kept"), 1))).first()
    assert hits[0] >= 0.8 * hits[1] and hits[2] == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.learn(quality_rules.labelled_sample(docs, none), list(quality_rules.features())) == []


def test_base_counts_against_brute_force(docs, rows):
    got = collections.defaultdict(set)
    for r in quality_rules.statistics(docs).collect():
        got[r["doc_id"]].add((r["word_chars"], r["n_symbols"], r["n_dup_lines"]))
    space = " \t\n\x0b\x0c\r"
    for i, text, *_ in rows:
        lines = [x for x in (text or "").split("\n") if x.strip(space)]
        assert (sum(c not in space for c in text or ""), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:k] for k, x in enumerate(lines))) in got[i]
    mixed = "a b\n\t \na b\n# $|<>\na\u00a0b\n a b\na b\x85c\u2028d\n"
    lines = [x for x in mixed.split("\n") if x.strip(space)]
    want = (sum(c not in space for c in mixed), 5, sum(x in lines[:k] for k, x in enumerate(lines)))
    assert quality_rules.text_counts(mixed)[1:4] == want


def test_sample_of_labels_is_bounded(spark, docs, rows):
    labels = spark.createDataFrame([(i % 200, i % 2, 0) for i in range(5000)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    sample = quality_rules.labelled_sample(docs, labels, rows=100)
    assert 0 < len(sample) <= 100 and sample["doc_id"].is_unique
    assert len(quality_rules.labelled_sample(docs, labels)) == len({r[0] for r in rows if r[0] is not None and r[0] < 200})


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(rows)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(sizes.values()) == sum(len((r[1] or "").encode()) + 1 for r in rows)
    assert sharding.shard_documents(empty, 4).count() == 0
    assert 4 <= len({r["shard"] for r in sharding.shard_documents(docs, None, target_bytes=sum(sizes.values()) // 4).collect()}) <= 8


def test_sharding_reaches_the_target_beyond_the_leaves_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MAX_LEAVES", 4)
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(1, 60)), "en", 1) for i in range(800)]
    total = sum(len(t) + 1 for _, t, _, _ in rows)
    df = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, lang string, n_chars long")
    got, sizes, slots = sharding.shard_documents(df, None, target_bytes=total // 15).collect(), collections.Counter(), collections.defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 802 and sorted(sizes) == list(range(16)) and max(sizes.values()) < total / 15 * 1.1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1


def test_sharding_splits_at_weighted_medians(spark):
    """Two leaves: one is below the other in the widest dimension, then in the ties; bytes are halved as far as rows allow."""
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 80)), rng.randrange(1000)) for i in range(1500)] + [(9000 + i, "the same text", 10**6) for i in range(2500)] + [(5, None, None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(7)
    for leaves in (2, 8):
        done = sharding.shard_documents(df, leaves, metadata=("n_chars",)).collect()
        sizes = collections.Counter()
        for r in done:
            sizes[r["shard"]] += r["size"]
        total = sum(sizes.values())
        assert total == sum(len((t or "").encode()) + 1 for _, t, _ in rows) and len(done) == len(rows)
        assert sorted(sizes) == list(range(leaves)) and all(abs(x - total / leaves) < 0.01 * total / leaves + 400 for x in sizes.values())
    many = sharding.shard_documents(df, 32, metadata=("n_chars",)).collect()  # past the level at which rows are written
    assert len(many) == len(rows) and len({r["shard"] for r in many}) == 32
    table = spark.createDataFrame([(i, 1 + i % 7, i // 3, (i * 7) % 50, i % 5, i) for i in range(1000)], "id long, size long, a long, b long, text_hash long, row_hash long")
    halves = collections.defaultdict(list)
    for r in sharding.kd_leaves(table, ["b", "a"], 2).collect():
        halves[r["node"]].append((r["b"], r["text_hash"], r["row_hash"], r["size"]))  # both span all they can; the first is taken
    assert max(x[:3] for x in halves[0]) < min(x[:3] for x in halves[1])
    assert abs(sum(x[3] for x in halves[0]) - sum(x[3] for x in halves[1])) <= 7 + 2


def test_license_index_of_many_templates(spark):
    """Found by an index of 500 templates; brute force compares sets of words and shares no code with the operator."""
    rng = random.Random(9)
    templates = {f"t{i}": words(rng, rng.randrange(6, 200), 3000) for i in range(500)}
    texts = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 300), 3000).split()
        for name in rng.sample(sorted(templates), 2):
            own = templates[name].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        texts.append(" ".join(w))
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]
    sets = {n: set(grams(t.split())) for n, t in templates.items()}
    want = set()
    for i, t in enumerate(texts):
        s = grams(t.split())
        for name, own in sets.items():
            if len(own & set(s)) >= 0.75 * len(own) and any(len(own & set(s[k : k + len(own)])) >= 0.75 * len(own) for k in range(len(s))):
                want.add((i, name))
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    assert want <= {(r["doc_id"], r["license"]) for r in got} and len(want) > 60
    for r in got:  # windows are twice a template's length, so more may lie within one
        assert len(sets[r["license"]] & set(grams(texts[r["doc_id"]].split()))) >= 0.75 * len(sets[r["license"]])


def test_license_scan(spark, docs, empty):
    notice, rng = license_scan.LICENSES["MIT-grant"], random.Random(3)
    texts = [words(rng, 70) + " " + notice + " " + words(rng, 900), words(rng, 300), None, "", "Released under the MIT License.", notice.replace("merge", "x"), " ".join(notice.split()[:12])]
    found = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    brute, w = set(), license_scan.Words()
    for name, t in license_scan.LICENSES.items():
        own = set(w.shingles(t).tolist())
        for i, text in enumerate(texts):
            s = w.shingles(text).tolist()
            if any(len(own & set(s[k : k + len(own)])) >= 0.75 * len(own) for k in range(len(s))):
                brute.add((i, name))
    assert {(r["doc_id"], r["license"]) for r in found} == brute and (0, "MIT-grant") in brute and (5, "MIT-grant") in brute
    assert license_scan.scan_licenses(empty).count() == 0
    rows_, bands = license_scan.band_settings(0.4)
    assert (1 - 0.4**rows_) ** bands <= license_scan.LOSS


def test_operators_on_edge_rows(spark, docs, rows):
    """Null ids and texts, repeated rows and extra columns with clashing names: a row for a row."""
    ids = sorted(str(r[0]) for r in rows)
    models = lm_scoring.fit(docs, docs.filter("doc_id < 5"))
    assert sorted(str(r["doc_id"]) for r in lm_scoring.score(docs, *models).collect()) == ids
    notice = license_scan.LICENSES["MIT"]
    df = docs.withColumn("text", F.when(F.col("doc_id") == 3, F.lit(notice)).when(F.col("doc_id").isNull(), F.lit(notice)).otherwise(F.col("text"))).withColumn("license", F.lit("x"))
    assert sorted((str(r["doc_id"]), r["license"]) for r in license_scan.scan_licenses(df).collect()) == [("3", "MIT"), ("3", "MIT"), ("None", "MIT")]
    same = spark.createDataFrame([(1, "a b c")] * 500, "doc_id long, text string").repartition(3)
    packed = packing.pack_documents(same, WORD, group_docs=50)
    assert packed.count() == 500 and packed.select("sequence_id").distinct().count() > 3
    assert sorted(r["slot"] for r in sharding.shard_documents(same, 1).collect()) == list(range(500))


def test_pipeline_on_edge_rows(spark, docs, rows, tmp_path):
    """Nulls, repeated rows, extra columns and empty tables go through all stages."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 0, 0)], "doc_id long, quality int, toxic int")
    none = docs.limit(0)
    for name, table, marks in (("a", docs, labels), ("b", none, labels), ("c", docs, labels.limit(0))):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        marks.write.parquet(f"{folder}/labels.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, folder)
            assert kept.columns == docs.columns
        packed = corpus_pipeline.run(spark, folder)
        assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in kept.collect()}
        assert (kept.count() == 0) == (name == "b") and before.count() >= kept.count()


def test_lm_scores_tell_target_from_background(spark, empty):
    rng = random.Random(4)
    rows = [(i, words(rng, 60, 40) if i % 2 else " ".join(f"z{rng.randrange(40)}" for _ in range(60))) for i in range(200)] + [(200, None), (201, ""), (None, "w1 w2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = lm_scoring.fit(df, df.filter("doc_id % 2 = 1 and doc_id < 100"))
    got = {r["doc_id"]: r for r in lm_scoring.score(df, *models).collect()}
    near, far = ([got[i]["difference"] for i in range(100 + k, 200, 2)] for k in (1, 0))  # none is among the labelled
    assert max(near) < min(far) and min(far) > 1
    assert got[200]["n_tokens"] == 0 and got[201]["difference"] is None and got[None]["n_tokens"] == 2
    assert lm_scoring.score(empty, *lm_scoring.fit(empty, empty)).count() == 0


def test_lm_scores_count_each_word_and_bigram_for_itself(spark, monkeypatch):
    """Against exact counts, with more words and bigrams than 2^17 ids and 2^21 cells tell apart, over several blocks."""
    monkeypatch.setattr(lm_scoring, "BLOCK", 1 << 19, raising=False)
    rng = random.Random(6)
    rows = [(i, " ".join(f"u{rng.randrange(400_000)}" if rng.random() < 0.9 else f"W{rng.randrange(30)}" for _ in range(4000))) for i in range(100)]
    rows += [(100, None), (101, " "), (None, "w1 w2"), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    other = spark.createDataFrame([(1, "w1 w2 never seen w1"), (None, rows[3][1])], "doc_id long, text string")
    told = [(i, (t or "").lower().split()) for i, t in rows]
    models = []
    for kept in (lambda i: i is not None and i < 40, lambda i: True):
        uni, bi = collections.Counter(), collections.Counter()
        for i, w in told:
            if kept(i) and w:
                uni.update(["", *w])
                bi.update(zip(["", *w], w))
        models.append((uni, bi, sum(uni.values())))
    (_, _, near), (all_words, _, far) = models

    def loss(words_, model, scale):
        uni, bi, total = model
        own = lambda w: (uni[w] * scale + 1) / (total * scale + len(all_words))
        return [-np.log((bi[a, b] * scale + 4 * own(b)) / (uni[a] * scale + 4)) for a, b in zip(["", *words_], words_)]

    assert len(all_words) > 1 << 17
    fitted = lm_scoring.fit(df, df.filter("doc_id < 40"))
    for docs_, texts in ((df, told), (other, [(1, "w1 w2 never seen w1".split()), (None, told[3][1])])):
        got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["target_loss"], r["background_loss"], r["difference"]) for r in lm_scoring.score(docs_, *fitted).collect()), key=str)
        want = []
        for i, w in texts:
            a, b = loss(w, models[0], 1.0), loss(w, models[1], near / far)
            want.append((i is None, i, len(w), *((np.mean(a), np.mean(b), np.mean(a) - np.mean(b)) if w else (None,) * 3)))
        for g, x in zip(got, sorted(want, key=str), strict=True):
            assert g[:3] == x[:3] and (g[3:] == x[3:] or g[3:] == pytest.approx(x[3:], rel=1e-9, abs=1e-9))


def test_warc(spark):
    page, other = "<html>" + "é" * 600, "<p>" + "y" * 2000
    rows = [(1, "http://a/", page), (2, "http://b/", page), (3, None, None), (4, "http://d/", "short"), (5, "http://e/", "short"), (6, "x\r\ny", other), (7, "http://g/", page), (None, "http://h/", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folders = [f"{shared_folder(spark)}/warc" for _ in range(2)]
    manifests = [warc.write_warc(df, f, roll=300, span=2000) for f in folders]
    listed = [sorted(map(tuple, m.collect())) for m in manifests]
    assert listed[0] == listed[1] and len(listed[0]) > 2  # the same files again
    got = {r["page_id"]: r for r in warc.read_warc(manifests[0], folders[0]).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: r["refers_to"] for i, r in got.items()} == {1: 7, 2: 7, 3: None, 4: None, 5: None, 6: None, 7: None, None: None}
    assert bytes(got[6]["payload"]) == other.encode() and got[1]["payload"] is None and got[2]["record_type"] == "revisit"
    kept = sorted(os.listdir(folders[0].removeprefix("file://")))
    assert kept == sorted([*(r[0] for r in listed[0]), "manifest"])  # nothing of the attempts is left
    assert sorted(map(tuple, spark.read.json(f"{folders[0]}/manifest").select(manifests[0].columns).collect())) == listed[0]
    none = f"{shared_folder(spark)}/warc"
    assert warc.read_warc(warc.write_warc(df.limit(0), none), none).count() == 0


def test_warc_spreads_outlying_and_repeated_ids(spark):
    rows = [(i, None, f"page {i}" * 40, i) for i in range(800)] + [(10**15, "u", "far", 1)] + [(None, "v", f"none {i}" * 60, 2) for i in range(300)] + [(5, "w", f"again {i}" * 60, 3) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, range long").repartition(5)
    folder = f"{shared_folder(spark)}/warc"
    manifest = warc.write_warc(df, folder, span=30_000)
    sizes = [r["records"] for r in manifest.collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 20 and max(sizes) < 120
    got = warc.read_warc(manifest, folder).collect()
    assert sorted((str(r["page_id"]), bytes(r["payload"])) for r in got) == sorted((str(i), h.encode()) for i, _, h, _ in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, oracle = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    cols = df.columns
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, (tuple(r[oracle.columns.index(c)] for c in cols) for r in oracle.fetchall())))


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    verdicts = {r["doc_id"]: r["kept"] for r in queries.QUERIES["op5_quality_rules"](spark, DATA).collect()}
    left, seen = {}, set()
    for i in sorted(docs):
        key = " ".join(__import__("re").split(r"[\x20\x09-\x0D]+", docs[i]))
        if verdicts[i] and key not in seen:
            seen.add(key)
            left[i] = docs[i]
    want = {i for i, (c, _) in brute_components(list(left.items())).items() if i == c}
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in packed} == want
    tok, covered, used = Tokenizer.from_file(WORD), collections.Counter(), collections.Counter()
    tok.encode_special_tokens = True
    ids = {i: np.array([*tok.encode(docs[i] or "", add_special_tokens=False).ids, 2], "<u4") for i in want}
    for r in packed:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    assert covered == {i: len(x) for i, x in ids.items()} and max(used.values()) <= 4096


# --- ids beyond what a float holds, next to null ones; joins that shuffle only what they must

BIG = 2**53


def test_warc_keeps_large_ids_next_to_null_ones(spark, tmp_path):
    page = "p" * 2000
    rows = [(BIG + 1 + i, "u", page) for i in range(40)] + [(None, "u", page)]
    folder = f"file://{tmp_path}/warc"
    read = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder, span=8000), folder).collect()
    assert collections.Counter(r["record_type"] for r in read) == {"revisit": 39, "response": 2}
    assert {r["refers_to"] for r in read if r["record_type"] == "revisit"} == {BIG + 40}
    assert {r["page_id"] for r in read} == {r[0] for r in rows}


@settings(max_examples=5, deadline=None)
@given(ids=st.lists(st.integers(-(2**63), 2**63 - 1) | st.none(), max_size=30))
def test_any_ids_are_packed_and_archived(spark, tmp_path_factory, ids):
    docs = spark.createDataFrame([(i, f"word {n}") for n, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    packed = packing.pack_documents(docs, WORD).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r["doc_id"] for r in packed), key=key) == sorted(ids, key=key)
    folder = f"file://{tmp_path_factory.mktemp('w')}/warc"
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.lit("x" * 1500).alias("html"))
    read = warc.read_warc(warc.write_warc(pages, folder, span=4000), folder).collect()
    assert sorted((r["page_id"] for r in read), key=key) == sorted(ids, key=key)
    top = max((i for i in ids if i is not None), default=None)
    assert all(r["refers_to"] == (top if r["page_id"] is not None and r["page_id"] < top else None) for r in read)


def test_packed_ids_next_to_null_ones(spark):
    docs = spark.createDataFrame([(BIG + 1, "a b"), (BIG + 3, "c d"), (None, "e f")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in packing.pack_documents(docs, WORD).collect()} == {BIG + 1, BIG + 3, None}


def shuffled_bytes(spark, df):
    """Bytes that the exchanges of df's plan write, by its metrics."""
    df.write.format("noop").mode("overwrite").save()
    total, plan = 0, df._jdf.queryExecution().executedPlan()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            nodes.append(node.plan())
            continue
        if name == "Exchange":
            total += node.metrics().apply("shuffleBytesWritten").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


def test_joins_shuffle_what_goes_alone(spark):
    rng = random.Random(11)
    unique = [(i, words(rng, 150, 10**6)) for i in range(3000)]
    copies = [(10_000 + i, unique[i][1]) for i in range(60)] + [(BIG + 1, unique[0][1]), (None, unique[5][1])]
    docs = Work(spark).table(spark.createDataFrame(unique + copies, "doc_id long, text string").repartition(4), "docs")
    size = sum(len(t) for _, t in unique)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for drop in (exact_dedup.drop_copies, near_dup.drop_near_duplicates):
            left = drop(docs)
            assert shuffled_bytes(spark, left) < 0.1 * size
            gone = {10_000 + i for i in range(60)} | {BIG + 1}
            assert {r["doc_id"] for r in left.select("doc_id").collect()} - {None} == {i for i, _ in unique + copies if i is not None} - gone
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filter_of_keys_misses_none(spark):
    rows = spark.range(5000).withColumn("extra", F.lit("x"))
    wanted = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("k"))
    may, rest = parted(rows, F.xxhash64("id"), wanted, F.col("k"))
    assert may.columns == rest.columns == rows.columns and may.count() + rest.count() == 5000
    assert {r["id"] for r in may.collect()} >= set(range(0, 5000, 7)) and may.count() < 730
    nothing, all_ = parted(rows, F.xxhash64("id"), wanted.limit(0), F.col("k"))
    assert (nothing.count(), all_.count()) == (0, 5000)
