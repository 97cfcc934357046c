"""Phrases of words that occur together more often than their parts suggest, by Suffix-sigma.

Texts are cut into pieces, and pieces where two words stand together too rarely for any phrase. Each place of a piece gives
one suffix, truncated to the most words of a phrase. Suffixes are counted where they are read, shuffled by language and first
word, sorted in reverse lexicographic order, and one stack counts all their prefixes in a single pass. A first word that
holds many of all words is dealt by its next two words too, and what that leaves of its counts in several places is added
up afterwards. Scores come last, from a join of each phrase's parts.

Which words and pairs are frequent is counted before, by hashes. Hashes only decide where pieces are cut: two that
meet spare a cut, and no count depends on them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Work, short_batches

#: Words of a phrase at most, its occurrences at least, and the phrases of a language that are returned.
MAX_WORDS, LEAST, TOP = 5, 100, 2000
#: Language of rows without one.
UNKNOWN = "und"
#: Bytes at which pieces end; words end at spaces and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Suffixes that a task counts together, and different words that it counts together: what both need in memory is bounded.
TOGETHER, VOCABULARY = 2_000_000, 1 << 20
#: Bits of the filter of frequent words and pairs: for each of them at least, and at most, which is enough for 16 million. Some rarer ones pass it too; counts stay right.
BITS_EACH, MOST_BITS, CHUNK_BITS = 8, 1 << 27, 1 << 15
#: A first word with more than 1 / SHARE of all words is dealt by its next two words, to one of SPREAD places.
SHARE, SPREAD = 256, 64
_CUT = b"."
_TO_CUT = bytes(_CUT[0] if c in ENDS else c for c in range(256))


def escape(word: bytes) -> bytes:
    """word without zero bytes, so that words joined by zero bytes sort as lists of words do."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in word or b"\x01" in word else word


def unescape(word: bytes) -> bytes:
    return word.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01") if b"\x01" in word else word


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(lang + b"\x00" + w) for w in words], np.uint64)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Numbers below 2^41; their last bit is 1."""
    return ((hashes >> np.uint64(23)) | np.uint64(1)).astype(np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers below 2^41; their last bit is 0."""
    x = (first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + second
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(23)) & ~np.uint64(1)).astype(np.int64)


class Words:
    """Numbers of the words of one language that a task has met; 0 is the end of a piece."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.numbers[_CUT]

    def of(self, texts: list[str]) -> np.ndarray:
        """The numbers of the words of texts; ASCII capitals are lowered; each piece ends with a 0."""
        data = "\n".join(texts).encode().lower().translate(_TO_CUT).replace(_CUT, b" . ")
        return np.array([*map(self.numbers.__getitem__, data.split()), 0], np.int32)


def _by_language(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[str, list[str]]]:
    """Language and texts of a batch of (text, lang), about so many characters at a time."""
    held: dict[str, list] = {}
    for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            entry = held.setdefault(lang, [0, []])
            entry[0] += len(text)
            entry[1].append(text)
            if entry[0] > size:
                yield lang, held.pop(lang)[1]
    yield from ((lang, texts) for lang, (_, texts) in held.items())


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))


class Held:
    """The word numbers of the texts that a task has read, by language, until they are too many."""

    def __init__(self):
        self.of: dict[str, tuple[Words, list[np.ndarray]]] = {}

    def add(self, lang: str, texts: list[str]) -> None:
        words, ids = self.of.setdefault(lang, (Words(), []))
        ids.append(words.of(texts))

    def full(self) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        """Language, words and numbers of what must be counted now, so that what is left is within TOGETHER and VOCABULARY."""
        places = {k: sum(map(len, ids)) for k, (_, ids) in self.of.items()}
        while self.of and (sum(places.values()) > TOGETHER or sum(len(w.numbers) for w, _ in self.of.values()) > VOCABULARY):
            yield self.take(most := max(places, key=places.__getitem__))
            del places[most]

    def take(self, lang: str) -> tuple[str, list[bytes], np.ndarray]:
        words, ids = self.of.pop(lang)
        return lang, list(words.numbers), np.concatenate(ids)


def _per_flush(count_, names: list[str]):
    """A function of batches (text, lang) that yields what count_(lang, words, numbers) makes of them, some millions of words at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            for lang, texts in _by_language(batch):
                held.add(lang, texts)
                for full in held.full():
                    yield from (pa.RecordBatch.from_arrays(x, names=names) for x in count_(*full))
        for lang in list(held.of):
            yield from (pa.RecordBatch.from_arrays(x, names=names) for x in count_(*held.take(lang)))

    return counted


def key_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """key, f: occurrences of each word and of each pair of words that follow one another in a piece, by hashes that tell languages apart."""

    def counted(lang: str, words: list[bytes], at: np.ndarray) -> Iterator[list[pa.Array]]:
        hashes = word_hashes(lang.encode(), words)
        single = np.bincount(at, minlength=len(words))[1:]
        inside = (at[:-1] > 0) & (at[1:] > 0)
        pairs, sums = np.unique(at[:-1][inside].astype(np.int64) << 32 | at[1:][inside], return_counts=True)
        keys = np.concatenate([word_keys(hashes[1:]), pair_keys(hashes[pairs >> 32], hashes[pairs & 0xFFFFFFFF])])
        sums = np.concatenate([single, sums])
        for i in range(0, len(keys), 1 << 16):
            yield [pa.array(keys[i : i + (1 << 16)]), pa.array(sums[i : i + (1 << 16)])]

    found = _texts(docs, text_col, lang_col).mapInArrow(_per_flush(counted, ["key", "f"]), "key long, f long")
    return found.groupBy("key").agg(F.sum("f").alias("f"))


def key_filter(keys: DataFrame) -> bytes:
    """A bit for each key, modulo a number of bits that follows theirs up to MOST_BITS: 16 MB at most, whatever the number of keys."""
    bits = min(MOST_BITS, max(CHUNK_BITS, 1 << (BITS_EACH * keys.count() - 1).bit_length()))
    place = F.col("key") % F.lit(bits)
    placed = keys.select(F.floor(place / CHUNK_BITS).cast("int").alias("chunk"), (place % CHUNK_BITS).alias("bit"))
    maps = placed.repartition("chunk").groupBy("chunk").agg(F.bitmap_construct_agg("bit").alias("map"))
    whole = np.zeros(bits // 8, np.uint8)
    for chunk, m in maps.collect():  # MOST_BITS / CHUNK_BITS rows at most, 16 MB
        whole[chunk * CHUNK_BITS // 8 : (chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(m, np.uint8)
    return whole.tobytes()


def suffixes(docs: DataFrame, frequent: bytes, hot: set[int], max_words: int, text_col: str, lang_col: str) -> DataFrame:
    """dealt, suffix, f: what each task has counted of the truncated suffixes, each cut where a word or pair is not frequent.

    suffix: language and words, escaped, joined by zero bytes; of a place whose word is not frequent, the language alone.
    dealt: a hash of language and first word, and where that is ``hot`` of the next two words too.
    """

    def counted(lang: str, words: list[bytes], at: np.ndarray) -> Iterator[list[pa.Array]]:
        bits, tag = np.frombuffer(frequent, np.uint8), lang.encode()

        def told(keys: np.ndarray) -> np.ndarray:
            keys = keys % (8 * len(bits))
            return (bits[keys >> 3] >> (keys & 7).astype(np.uint8) & 1).astype(bool)

        hashes = word_hashes(tag, words)
        known = told(word_keys(hashes))
        known[0] = False
        names = [escape(w) if k else b"" for w, k in zip(words, known.tolist(), strict=True)]
        order = sorted(np.flatnonzero(known).tolist(), key=names.__getitem__)
        place = np.zeros(len(words), np.int64)  # in the order of words; 0 for those that are cut out
        place[order] = np.arange(1, len(order) + 1)
        rest = int(np.count_nonzero(at)) - int(np.count_nonzero(known[at]))
        kept, hashes = [b"", *(names[i] for i in order)], np.concatenate([hashes[:1], hashes[order]])
        head = escape(tag)
        if rest:
            yield [pa.array([0]), pa.array([head], pa.binary()), pa.array([rest])]
        at = place[at]
        goes_on = np.zeros(len(at), bool)
        inside = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
        goes_on[inside] = told(pair_keys(hashes[at[inside]], hashes[at[inside + 1]]))
        begin = np.flatnonzero(at)
        columns, going = [at[begin]], np.ones(len(begin), bool)
        for k in range(1, max_words):
            last = np.minimum(begin + k - 1, len(at) - 1)
            going = going & goes_on[last]
            columns.append(np.where(going, at[np.minimum(last + 1, len(at) - 1)], 0))
        packed, used = [columns[0]], len(kept)
        for c in columns[1:]:
            if used * len(kept) < 1 << 62:
                packed[-1] = packed[-1] * len(kept) + c
                used *= len(kept)
            else:
                packed.append(c)
                used = len(kept)
        by = np.lexsort(packed[::-1]) if len(packed) > 1 else np.argsort(packed[0])
        new = np.zeros(len(by), bool)
        new[:1] = True
        for p in packed:
            p = p[by]
            new[1:] |= p[1:] != p[:-1]
        first = np.flatnonzero(new)
        sums, rows = np.diff(np.append(first, len(by))), by[first]
        deal = (hashes >> np.uint64(2)).astype(np.int64)
        is_hot = np.isin(word_keys(hashes), np.array(sorted(hot), np.int64))
        texts, first_part = pa.array(kept, pa.binary()), pa.scalar(head, pa.binary())
        for i in range(0, len(rows), 1 << 15):
            part = [c[rows[i : i + (1 << 15)]] for c in columns]
            following = sum((deal[c] * 31**k for k, c in enumerate(part[1:3])), np.zeros(len(part[0]), np.int64))
            dealt = np.where(is_hot[part[0]], deal[part[0]] + 1 + following % SPREAD, deal[part[0]])
            joined = pc.binary_join_element_wise(first_part, *(texts.take(pa.array(p, mask=p == 0)) for p in part), b"\x00", null_handling="skip")
            yield [pa.array(dealt), joined, pa.array(sums[i : i + (1 << 15)])]

    return _texts(docs, text_col, lang_col).mapInArrow(_per_flush(counted, ["dealt", "suffix", "f"]), "dealt long, suffix binary, f long")


def count_prefixes(sorted_suffixes: DataFrame, least: int, hot: set[int]) -> DataFrame:
    """lang, phrase, words, f of the prefixes of suffixes in reverse order, by one stack; below ``least`` only where the rest may be elsewhere.

    A language itself is a prefix without words: its f are the words of this part of the suffixes.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[bytes] = []  # language and words of the suffix before
        sums: list[int] = []
        out: list[tuple[str, str, int, int]] = []

        def in_parts() -> bool:
            """Whether other tasks may have the same prefix: languages, and a hot word with one more at most."""
            return len(path) == 1 or len(path) <= 3 and int(word_keys(word_hashes(unescape(path[0]), [unescape(path[1])]))[0]) in hot

        def close(down_to: int) -> None:
            while len(path) > down_to:
                f = sums.pop()
                if f >= least or in_parts():
                    out.append((unescape(path[0]).decode(), b" ".join(map(unescape, path[1:])).decode(), len(path) - 1, f))
                path.pop()
                if sums:
                    sums[-1] += f

        def told() -> pa.RecordBatch:
            lang, phrase, words, f = zip(*out, strict=True) if out else ((), (), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(words, pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "words", "f"])

        for batch in batches:
            for suffix, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts, same = suffix.split(b"\x00"), 0
                for x, y in zip(parts, path, strict=False):
                    if x != y:
                        break
                    same += 1
                close(same)
                path += parts[same:]
                sums += [0] * (len(parts) - same)
                sums[-1] += f
            if len(out) > 20_000:
                yield told()
        close(0)
        yield told()

    return sorted_suffixes.select("suffix", "f").mapInArrow(prefixes, "lang string, phrase string, words int, f long")


def phrase_counts(work: Work, docs: DataFrame, max_words: int, least: int, text_col: str, lang_col: str) -> DataFrame:
    """lang, phrase, words, f of all phrases of 1 to ``max_words`` words that occur ``least`` times; with 0 words, all words of a language."""
    keys = work.table(key_counts(docs, text_col, lang_col).filter(F.col("f") >= least), "keys")
    single = keys.filter("key % 2 = 1")
    total = single.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    hot = {r["key"] for r in single.filter(F.col("f") > total / SHARE).collect()}  # SHARE rows at most
    found = suffixes(docs, key_filter(keys), hot, max_words, text_col, lang_col)
    counts = count_prefixes(found.repartition("dealt").sortWithinPartitions(F.desc("suffix")), least, hot)
    counts = counts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    return work.table(counts.filter((F.col("f") >= least) | (F.col("words") == 0)), "counts")


def _joined(words: str, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def score_phrases(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of phrases by their lowest-scoring cut; ties go to the shortest first part.

    The product of 1000, a and n has room for 38 digits, an error and no wrong number beyond. totals: lang, n.
    """
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = counts.filter("words > 1").withColumn("_w", F.split("phrase", " ", -1)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("f").alias("a"), "k", _joined("_w", 1, F.col("k")).alias("_left"), _joined("_w", F.col("k") + 1, F.col("words") - F.col("k")).alias("_right"))
    for part, name in (("_left", "l"), ("_right", "r")):  # one row for each part: a part of many phrases is a skewed, never a squared, key
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr("cast(1000 * cast(a as decimal(19,0)) as decimal(23,0)) * cast(n as decimal(19,0))"))
    cuts = cuts.withColumn("score", F.expr("score div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "words", "a", "l", "r", "n")).alias("_c"))
    return lowest.select("lang", "phrase", *(f"_c.{c}" for c in ("words", "a", "l", "r", "n", "score")))


def longest_only(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """scored without the phrases that a longer one contains at all their occurrences.

    Counts never grow with a phrase, so if a longer phrase is as frequent, one that is longer by a single word is.
    """
    longer = counts.filter("words > 2").withColumn("_w", F.split("phrase", " ", -1))
    one_less = F.array(_joined("_w", 1, F.col("words") - 1), _joined("_w", 2, F.col("words") - 1))
    inner = longer.select("lang", F.explode(one_less).alias("phrase"), F.col("f").alias("_f")).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
    return scored.join(inner, ["lang", "phrase"], "left").filter("_f is null or _f < a").drop("_f")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score; by score and a, descending, then by the bytes of the phrase.

    A null lang is ``und``. Null and empty texts have no words. Every row counts, repeated ones as often as they come; ids
    are not read, nor are other columns. A phrase never reaches over the end of a piece. Texts of any length are taken
    whole. An empty table, or one without frequent phrases, gives an empty result.
    """
    work = Work(docs.sparkSession)
    counts = phrase_counts(work, docs, max_words, least, text_col, lang_col)
    work.drop("keys")
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    scored = work.table(longest_only(score_phrases(counts.filter("words > 0"), totals), counts), "scored")
    work.drop("counts")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    first = scored.withColumn("_r", F.row_number().over(some)).filter(F.col("_r") <= top).drop("_r")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", *(F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")))
