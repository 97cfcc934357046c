"""Cross-entropy difference of two matched n-gram models.

Target and background model are interpolated bigram models of the same order, smoothing and vocabulary: all lower-cased
words of the fitted documents. Words and bigrams are known by 63 bits of their hashes, and each is counted for itself,
over all documents; tables of counts grow with the corpus and are spread over buckets of hashes. The background's counts
are scaled to the target's total: both models then have as much evidence against the same smoothing.

Documents are written once as blocks of bounded size. A block sends each distinct word and bigram once, with its counts,
to the bucket of its hash, and gets back what all blocks have of it, in the same order; so a frequent word costs one entry
for each block, and no task or driver holds more than a block or a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Work, parted

#: Bytes of text of a block (a longer document is a block of its own), bytes of text for each bucket, least buckets.
BLOCK, BUCKET, LEAST_BUCKETS = 4 << 20, 4 << 20, 64
#: Weight of the unigram model behind a context.
BETA = 4.0
#: Hash of what stands before the first word.
START = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of words; their last bit is 1."""
    return _mixed(hashes) | np.uint64(1)


def bigram_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of bigrams, from the hashes of both words; their last bit is 0."""
    return _mixed(_mixed(first) * np.uint64(0xC2B2AE3D27D4EB4F) + second) & ~np.uint64(1)


class Grams:
    """The words and bigrams of a block's texts: ``keys`` are distinct and sorted.

    For each text ``lengths`` has its words. For each word in turn ``pairs`` has the place of its bigram, ``own`` its own
    and ``before`` its context's, all as places in ``keys``; ``starts`` is the place of the mark before the first word.
    """

    def __init__(self, texts: list[str | None]):
        known, parts, lengths = {}, [], []
        for text in texts:
            words = (text or "").lower().encode().split()
            lengths.append(len(words))
            if words:
                for w in set(words).difference(known):
                    known[w] = 1 + len(known)
                parts.append(np.array([0, *map(known.__getitem__, words)], np.int64))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        hashes = np.fromiter((START, *map(xxhash.xxh3_64_intdigest, known)), np.uint64, 1 + len(known))
        inside = ids[1:] > 0
        both, at = np.unique(ids[:-1][inside] * len(hashes) + ids[1:][inside], return_inverse=True)
        first, second = np.divmod(both, len(hashes))
        keys, places = np.unique(np.concatenate([word_keys(hashes), bigram_keys(hashes[first], hashes[second])]), return_inverse=True)
        words, bigrams = places[: len(hashes)], places[len(hashes) :]
        self.keys, self.lengths, self.starts = keys, np.array(lengths, np.int64), words[0]
        self.pairs, self.before, self.own = bigrams[at], words[first][at], words[second][at]

    def counts(self, marked: np.ndarray) -> np.ndarray:
        """How often each key occurs in the marked texts."""
        n, told = len(self.keys), np.repeat(marked, self.lengths)
        out = np.bincount(self.pairs[told], minlength=n) + np.bincount(self.own[told], minlength=n)
        out[self.starts] += np.count_nonzero(marked & (self.lengths > 0))
        return out


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, in the order of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits, byte by byte of their values, compressed."""
    return pa.compress(b"".join(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, n * columns * 8, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).view(np.uint64).ravel() for c in raw]


def blocks_of(docs: DataFrame) -> DataFrame:
    """block, size, data: docs (doc_id, text, is_target) as written blocks of about ``BLOCK`` bytes of text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, n = [], 0, TaskContext.get().partitionId() << 33

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in waiting:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "size", "data"])

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < batch.num_rows:
                had = int(ends[at - 1]) if at else 0
                to = min(batch.num_rows, 1 + int(np.searchsorted(ends, had + BLOCK - size)))
                waiting.append(batch.slice(at, to - at))
                size, at = size + int(ends[to - 1]) - had, to
                if size >= BLOCK:
                    yield row()
                    waiting, size, n = [], 0, n + 1
        if waiting:
            yield row()

    return Work(docs.sparkSession).table(docs.select("doc_id", "text", "is_target").mapInArrow(pack, "block long, size long, data binary"), "blocks")


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _texts(table: pa.Table) -> Grams:
    return Grams(table.column(1).to_pylist())


def gram_counts(blocks: DataFrame, buckets: int, counted: bool, asks: bool) -> DataFrame:
    """bucket, block (null unless it ``asks``), n, data: distinct keys of each block by bucket, with its counts or zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = _texts(table := _read(data.as_buffer()))
                if not grams.lengths.any():
                    continue
                keys, target = grams.keys, np.array(table.column(2).to_pylist(), bool)
                near, far = (grams.counts(m) if counted else np.zeros(len(keys)) for m in (target, np.ones_like(target)))
                cuts = np.flatnonzero(np.diff(where := _bucket(keys, buckets), prepend=-1))
                ends, rows = [*cuts[1:], len(keys)], []
                for i, j in zip(cuts, ends, strict=True):
                    rows.append((where[i], block if asks else None, j - i, _packed(np.diff(keys[i:j], prepend=np.uint64(0)), near[i:j], far[i:j])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "block", "n", "data"])

    return blocks.select("block", "data").mapInArrow(count, "bucket long, block long, n long, data binary")


def add_up(parts: DataFrame) -> DataFrame:
    """What all blocks together have of each key, for the blocks that ask: block, bucket, n, data in the order of their keys.

    A row without a block has the bucket's own: its distinct words and their sums.
    """

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        parts = [_unpacked(r["data"], r["n"], 3) for r in rows]
        keys, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
        near, far = (np.bincount(at, np.concatenate([p[k] for p in parts]).astype(np.float64), len(keys)).astype(np.int64) for k in (1, 2))
        words = (keys & np.uint64(1)).astype(bool) & (far > 0)
        told, i = [(None, rows[0]["bucket"], int(words.sum()), int(near[words].sum()), int(far[words].sum()), None)], 0
        for r in rows:
            own, i = at[i : i + r["n"]], i + r["n"]
            if r["block"] is not None:
                told.append((r["block"], r["bucket"], r["n"], None, None, _packed(near[own], far[own])))
        kinds = (pa.int64(),) * 5 + (pa.binary(),)
        return pa.Table.from_arrays([pa.array([r[k] for r in told], t) for k, t in enumerate(kinds)], names=["block", "bucket", "n", "target", "background", "data"])

    return parts.groupBy("bucket").applyInArrow(answer, "block long, bucket long, n long, target long, background long, data binary")


@dataclass
class Model:
    """One of two matched models of the same documents: their written blocks, which hold all that is counted."""

    docs: DataFrame
    blocks: DataFrame
    name: str


def losses(grams: Grams, counts: np.ndarray, words: int, total: float, scale: float) -> np.ndarray:
    """Negative log probability of each word, in nats, from the counts of the grams' keys; unseen words share the mark's place."""
    scaled = counts * scale
    own = (scaled[grams.own] + 1) / (total * scale + max(1, words))
    return -np.log((scaled[grams.pairs] + BETA * own) / (scaled[grams.before] + BETA))


def fit(docs: DataFrame, target_ids: DataFrame) -> tuple[Model, Model]:
    """Target and background model from all docs (doc_id, text); ``target_ids`` names the target's documents.

    The background counts every row; rows that repeat count each time. Ids that are null, or that docs lacks, name
    nothing; ids that repeat name their rows once. Null and empty texts add nothing, texts of any length are counted
    whole, and tables without rows give models without counts. Other columns are not read.
    """
    ids = Work(docs.sparkSession).table(target_ids.select("doc_id").filter("doc_id is not null").distinct(), "target-ids")
    may, rest = parted(docs.select("doc_id", "text"), F.xxhash64("doc_id"), ids, F.xxhash64("doc_id"))
    named = may.join(ids.withColumn("is_target", F.lit(True)), "doc_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    marked = named.unionByName(rest.withColumn("is_target", F.lit(False)))
    blocks = blocks_of(marked)
    return Model(docs, blocks, "target"), Model(docs, blocks, "background")


def score(docs: DataFrame, target: Model, background: Model) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference (each per token; below 0: closer to the target).

    Texts without words have 0 tokens and null losses; a text of any length is scored whole, and an empty table gives an
    empty result. Repeated rows are scored each for itself, null ids stay null, and other columns are not read. Other docs than the fitted ones only ask for counts and add none.
    """
    if target.blocks is not background.blocks or (target.name, background.name) != ("target", "background"):
        raise ValueError("score needs the target and background model of one fit")
    fitted, same = target.blocks, docs is target.docs
    blocks = fitted if same else blocks_of(docs.select("doc_id", "text", F.lit(False).alias("is_target")))
    size = (fitted if same else fitted.unionByName(blocks)).agg(F.sum("size")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET))
    parts = gram_counts(fitted, buckets, True, same)
    if not same:
        parts = parts.unionByName(gram_counts(blocks, buckets, False, True))
    answers = Work(docs.sparkSession).table(add_up(parts), "answers")
    words, near, far = (x or 0 for x in answers.filter("block is null").agg(F.sum("n"), F.sum("target"), F.sum("background")).first())
    scale = near / far if near and far else 1.0

    def judge(block: pa.Table, told: pa.Table) -> pa.Table:
        table = _read(block.column("data")[0].as_buffer())
        grams, out = _texts(table), np.zeros((3, table.num_rows))
        if told.num_rows:
            parts = [_unpacked(r["data"], r["n"], 2) for r in sorted(told.to_pylist(), key=lambda r: r["bucket"])]
            a, b = (np.concatenate([p[k] for p in parts]).astype(np.float64) for k in (0, 1))
            each = losses(grams, a, words, near, 1.0), losses(grams, b, words, far, scale)
            some = grams.lengths > 0
            starts = (np.cumsum(grams.lengths) - grams.lengths)[some]
            for i, x in enumerate((*each, each[0] - each[1])):
                out[i][some] = np.add.reduceat(x, starts) / grams.lengths[some]
        none = grams.lengths == 0
        return pa.Table.from_arrays([table.column(0), pa.array(grams.lengths), *[pa.array(x, mask=none) for x in out]], names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = answers.filter("block is not null").select("block", "bucket", "n", "data")
    return blocks.select("block", "data").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(judge, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, difference double")
