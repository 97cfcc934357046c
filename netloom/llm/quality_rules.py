"""Learned decision lists over text statistics.

Each document gets interpretable statistics. From labelled ones, sequential covering grows conjunctions of thresholds
that single out bad documents: a rule adds the condition with the greatest information gain until it covers bad ones
only, is pruned on held-out rows, and what it covers is taken away. The ordered rules become one Spark conditional
expression, so that applying them is a projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm.common import short_batches

#: Labelled rows that the learner sees at most; a uniform sample by a hash of the id.
SAMPLE_ROWS = 50_000
#: A rule has at most so many conditions, covers so many bad training and so many held-out rows at least, and has this precision on the latter.
CONDITIONS, COVER, HELD_OUT, PRECISION, RULES = 3, 5, 3, 0.98, 12
#: Fixed values of the base rule.
SYMBOLS, SPACE_BYTES, FEWEST_WORDS, REPEATED_PERCENT = "#*$%&|<>", " \t\n\x0b\x0c\r", 50, 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_digits")
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words that lie in a window of three words that occurs twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1].astype(np.int64) * n_distinct + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)  # dense again, so that the next product fits
    windows = pairs[:-1].astype(np.int64) * n_distinct + ids[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[which] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; words are runs of anything but ASCII white space."""
    text = text or ""
    words = text.encode().split()
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE_BYTES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(known)),
        len(lines),
        len(known),
        int(((chars >= 65) & (chars <= 90)).sum()),
        int(((chars >= 48) & (chars <= 57)).sum()),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), whole: str | None = None) -> DataFrame:
    """doc_id, ``carry``, the whole row as a struct if ``whole`` names it, and COUNTS for each row.

    Null and empty texts have zeros; repeated rows and null ids count each for itself; a text of any length is read
    whole. An empty table gives an empty result. Columns that are not asked for are not read.
    """
    short_batches(docs.sparkSession)
    row = [F.struct(*[docs[c] for c in docs.columns]).alias(whole)] if whole else [F.col(text_col).alias("_text")]
    rows = docs.select(*row, F.col(id_col).alias("doc_id"), *carry)
    kept = rows.schema.fields[0 if whole else 1 :]
    at = docs.columns.index(text_col) if whole else None  # the text crosses to Python once

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                texts = part.column(0) if at is None else part.column(0).field(at)
                table = np.array([text_counts(t.as_py()) for t in texts], np.int64).reshape(-1, len(COUNTS))
                out = part.columns[len(part.columns) - len(kept) :]
                yield pa.RecordBatch.from_arrays([*out, *(pa.array(table[:, i]) for i in range(len(COUNTS)))], names=[*(f.name for f in kept), *COUNTS])

    return rows.mapInArrow(count, T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def features() -> dict[str, Column]:
    """What rules speak of, from COUNTS; a text without words has zeros."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / n,
        "distinct_share": F.col("n_distinct_words") / n,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "words_per_line": F.col("n_words") / lines,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, by: dict[str, Column]) -> Column:
        return by[self.feature] > self.threshold if self.above else by[self.feature] <= self.threshold


def _covers(rule: tuple[Condition, ...], x: pd.DataFrame) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: pd.DataFrame, bad: np.ndarray, names: list[str], barred: set[tuple[str, bool]]) -> tuple[Condition, ...]:
    """A conjunction that covers bad rows; it doesn't begin with a barred feature and direction."""
    rule, inside = (), np.ones(len(x), bool)
    while len(rule) < CONDITIONS and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best = (0.0, None)
        for f in names:
            v, b = x[f].to_numpy()[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            ends = np.flatnonzero(v[1:] > v[:-1])  # thresholds lie between different values
            if not len(ends):
                continue
            p_low, n_low = np.cumsum(b)[ends], np.cumsum(~b)[ends]
            for above, p, n in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
                gain = np.where(p >= COVER, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -1)
                if not rule and (f, above) in barred:
                    continue
                i = int(gain.argmax())
                if gain[i] > best[0] + 1e-9:
                    best = (gain[i], Condition(f, above, float((v[ends[i]] + v[ends[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _precision(rule: tuple[Condition, ...], x: pd.DataFrame, bad: np.ndarray) -> float:
    inside = _covers(rule, x)
    return (bad[inside].sum() + 1) / (inside.sum() + 2) if inside.any() else 0.0


def learn(sample: pd.DataFrame, names: list[str], label: str = "bad", seed: int = 0) -> list[tuple[Condition, ...]]:
    """Rules for bad rows in the order found; none if there are no labels to learn from."""
    order = np.random.default_rng(seed).permutation(len(sample))
    x = sample.iloc[order].reset_index(drop=True)
    held = np.arange(len(x)) % 3 == 0
    rules: list[tuple[Condition, ...]] = []
    barred: set[tuple[str, bool]] = set()  # beginnings that led to no rule that holds on held-out rows
    while len(rules) < RULES and len(x):
        bad = x[label].to_numpy(bool)
        rule = _grow(x[~held], bad[~held], names, barred)
        if not rule:
            break
        first = (rule[0].feature, rule[0].above)
        while len(rule) > 1 and _precision(rule[:-1], x[held], bad[held]) >= _precision(rule, x[held], bad[held]):
            rule = rule[:-1]
        test = _covers(rule, x[held])
        if test.sum() < HELD_OUT or bad[held][test].mean() < PRECISION:
            barred.add(first)
            continue
        rules.append(rule)
        left = ~_covers(rule, x)
        x, held = x[left].reset_index(drop=True), held[left]
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The number of the first rule that holds, from 1 on, or 0: an ordered conditional expression."""
    by, out = features(), None
    for i, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(by)
        out = F.when(holds, i) if out is None else out.when(holds, i)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """doc_id, ``bad`` and features of at most ``rows`` labelled documents, chosen by a hash of their id before any text is read.

    A document with several labels counts as bad only if all say so; null ids and labels are left out, and of rows
    that repeat an id the one with the least features speaks. Statistics are taken of the sample only, and the driver
    gets ``rows`` rows of numbers at most, however many labels there are.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 0).alias("bad"))
    n = known.count()
    if n > rows:  # the share that five standard deviations keep below ``rows``
        share = (rows - 5 * rows**0.5) / n
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(rows)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    told = statistics(chosen, carry=("bad",)).select("doc_id", "bad", F.struct(*[c.alias(f) for f, c in features().items()]).alias("x"))
    pdf = told.groupBy("doc_id", "bad").agg(F.min("x").alias("x")).select("doc_id", "bad", "x.*").toPandas()
    return pdf.sort_values("doc_id").reset_index(drop=True)


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def judge(counts: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """counts with base_failed, rule (0: none) and kept; every row of counts has one row, and an empty table none."""
    return counts.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
