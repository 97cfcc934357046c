"""Packing token sequences by first-fit decreasing, with a tournament tree of bin capacities.

Documents fall into groups by a hash of their row, which repeated rows do not share: groups are random, of bounded size, and packed independently. A
document longer than a sequence is cut into full pieces, which are sequences by themselves, and a rest. The rests of a
group are placed longest first, each into the first bin with room, which the tree finds in logarithmic time.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netloom.llm.common import Work, short_batches

#: Tokens of a sequence, and the id that ends each document.
LENGTH, END_ID = 4096, 2
#: Documents of a group, on average.
GROUP_DOCS = 8192
#: Words whose ids a Python worker remembers, twice: those met lately, and those met before them.
MEMORY = 150_000
_MARK = "\x01"


class WordIds:
    """Token ids of white-space separated words under a lower-casing BPE file with word ends, remembered by word.

    Words in Latin letters are merged in bulk: each pre-token is followed by a mark that stands for the word end, and
    the marked vocabulary gives the same merges in the same order. All other words go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pre = regex.compile(f"({split})")
        end, special = spec["model"]["end_of_word_suffix"], {t["content"] for t in spec["added_tokens"]}
        raw = {chr(c): b for b, c in self._byte_letters()}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                core = token[: -len(end)] if token.endswith(end) and token != end else token
                ranks[bytes(raw[ch] for ch in core) + (_MARK.encode() if core != token else b"")] = i
        self.bulk = tiktoken.Encoding("words", pat_str=f"[^{_MARK}\\n]*{_MARK}|\\n", mergeable_ranks=ranks, special_tokens={})
        self.line, self.known, self.old = ranks[b"\n"], {}, {}

    @staticmethod
    def _byte_letters() -> list[tuple[int, int]]:
        """Byte and code point of its letter in byte-level vocabularies: printable Latin-1 as it is, the rest from 256 on."""
        plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)]
        return [(b, b) for b in plain] + [(b, 256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)]

    def _learn(self, words: list[bytes]) -> None:
        latin = []
        for w in words:
            if (w.isascii() or max(w.decode()) < "ɐ") and _MARK.encode() not in w:
                latin.append(w)
            else:
                self.known[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if latin:
            text = unicodedata.normalize("NFC", b"\n".join(latin).decode()).lower() + "\n"
            ids = self.bulk.encode_to_numpy(self.pre.sub(rf"\1{_MARK}", text), disallowed_special=()).astype("<u4")
            data, begin = ids.tobytes(), 0
            for w, e in zip(latin, np.flatnonzero(ids == self.line).tolist(), strict=True):
                self.known[w] = data[4 * begin : 4 * e]
                begin = e + 1

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [(t or "").encode().split() for t in texts]
        if len(self.known) > MEMORY:
            self.old, self.known = self.known, {}
        missing = set().union(*split).difference(self.known)
        again = missing.intersection(self.old)  # frequent words are never learned anew
        self.known.update((w, self.old[w]) for w in again)
        self._learn(list(missing - again))
        return [b"".join([self.known[w] for w in words]) for words in split]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class BinTree:
    """A tournament tree: each leaf is a bin's room, each inner node the larger of its two; bins open in order."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put size into the first bin with room for it; return the bin."""
        room, node = self.room, 1
        while node < self.leaves:
            node = 2 * node if room[2 * node] >= size else 2 * node + 1
        room[node] -= size
        at, node = node - self.leaves, node // 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
        return at


def first_fit_decreasing(sizes: list[int], room: int) -> list[int]:
    """The bin of each size, which are in decreasing order and at most ``room`` each."""
    tree = BinTree(len(sizes), room)
    return [tree.place(s) for s in sizes]


def slices(batch: pa.RecordBatch, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (doc_id, text), texts of about so many bytes at a time: a text is held several times while it is encoded."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, ids: the ids of each document with its end, as little-endian unsigned 32-bit integers.

    Null and empty texts are the end id alone; texts of any length are encoded whole. Rows that repeat, and null ids, stay as
    they are; other columns are not read; an empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                ids = pa.array([x + end for x in word_ids(path).encode(part.column(1).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 7) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Ties in length are broken by id, start and checksum. Rows that repeat an
    id are packed each for itself; a null id stays null and comes after all others of its length. A text of any length is
    encoded whole and cut into as many pieces as it fills; other columns are not read. An empty table gives an empty result. Ids are never shuffled:
    what is shuffled is a few numbers for each document.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                ids = [x + end for x in word_ids(path).encode(part.column(1).to_pylist())]
                full = [[zlib.crc32(x[i : i + 4 * length]) for i in range(0, len(x), 4 * length)] for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(full, pa.list_(pa.int64()))], names=["doc_id", "tokens", "crcs"])

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        ids, tokens, crcs = (group.column(c).to_pylist() for c in ("doc_id", "tokens", "crcs"))
        rows, rests, n = [], [], 0
        for d, (total, sums) in enumerate(zip(tokens, crcs, strict=True)):
            for i, crc in enumerate(sums):
                size = min(length, total - i * length)
                if size == length:
                    rows.append((d, i * length, size, crc, n, 0))
                    n += 1
                else:
                    rests.append((-size, (ids[d] is None, ids[d] or 0), i * length, crc, d))
        rests.sort()
        bins = first_fit_decreasing([-r[0] for r in rests], length)
        used: dict[int, int] = {}
        for (size, _, start, crc, d), b in zip(rests, bins, strict=True):
            rows.append((d, start, -size, crc, n + b, used.get(b, 0)))
            used[b] = used.get(b, 0) - size
        of, start, size, crc, at, offset = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
        sequence = pc.add(at, pa.scalar(key[0].as_py() << 32, pa.int64()))
        own = group.select(["doc_id", "tokens"]).take(of)
        return pa.Table.from_arrays([own.column(0), start, size, crc, own.column(1), sequence, offset], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    work = Work(docs.sparkSession)
    measured = work.table(rows.mapInArrow(measure, f"doc_id {kind}, tokens long, crcs array<long>").withColumn("row", F.monotonically_increasing_id()), "lengths")
    groups = max(1, -(-measured.count() // group_docs))
    grouped = measured.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups))).drop("row")
    return grouped.groupBy("group").applyInArrow(pack, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
