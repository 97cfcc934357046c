"""Periodic runs of words, from the tandem repeats that Stoye and Gusfield find in a suffix tree.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. The suffixes of some
texts are sorted together by doubling, each text's apart from the others', and the nodes of their suffix trees are the
intervals of equal prefixes in that order. Of each node all leaves but those of its largest child are visited (the
smaller-half rule, which keeps visits to n log n): where a leaf and the leaf one node depth before or behind it lie below
the same node and go on differently, a branching tandem repeat stands. Each run ends in one such repeat for its period, so
rotating a repeat to the left as far as words agree gives the run; repeats that give the same run are merged, and the
least period stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import short_batches

#: Words of the shortest run, and how often its period fits into it at least.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Bytes of text whose suffixes are sorted together; a longer text is sorted by itself.
TOGETHER = 1 << 20

RUNS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_ranks(words: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: an array that holds equal numbers where the 2^k words from two places on are equal; all differ in the last.

    Numbers are in the order of the prefixes. words: texts one after the other; an id belongs to one text only, and each
    text ends with an id that comes once. A prefix that reaches over an end is therefore met nowhere else.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], words[order][1:] != words[order][:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    levels, step = [rank], 1
    open_ = order[np.repeat(sizes > 1, sizes)]
    while len(open_):
        old, then = rank[open_], rank[open_ + step]
        by = np.lexsort((then, old))
        open_, old, then = open_[by], old[by], then[by]
        at = np.arange(len(open_))
        new_class = np.concatenate([[True], old[1:] != old[:-1]])
        new_group = new_class | np.concatenate([[True], then[1:] != then[:-1]])
        class_start = np.maximum.accumulate(np.where(new_class, at, 0))
        groups = np.flatnonzero(new_group)
        sizes = np.diff(np.append(groups, len(open_)))
        rank = rank.copy()
        rank[open_] = old + np.repeat(groups, sizes) - class_start
        open_ = open_[np.repeat(sizes > 1, sizes)]
        levels.append(rank)
        step *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes from a[i] and b[i] on have in common."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += (levels[k][a + out] == levels[k][b + out]).astype(np.int64) << k
    return out


def inner_nodes(common: list[int], least: int) -> list[tuple[int, int, int, int, int]]:
    """Nodes of the suffix tree with ``least`` leaves or more: depth, first and last leaf, first and last leaf of the largest child.

    common[i] is what leaves i and i + 1 have in common. Nodes of depth 0 are left out: they hold whole texts.
    """
    nodes, path = [], []  # path: depth, first leaf, largest child's first and last leaf, from the root down
    for i, depth in enumerate([*common, 0]):
        left = child_left = child_right = i
        while path and path[-1][0] > depth:
            d, left, big_left, big_right = path.pop()
            if i - left + 1 >= least:
                nodes.append((d, left, i, big_left, big_right))
            child_left, child_right = left, i
            if path and path[-1][0] >= depth and i - left > path[-1][3] - path[-1][2]:
                path[-1][2:] = left, i
        if depth and (not path or path[-1][0] < depth):
            path.append([depth, left, child_left, child_right])
    return nodes


def branching_repeats(words: np.ndarray, levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of tandem repeats whose next word differs from the one a period before it; each may come more than once.

    least: occurrences of the repeated words in the text, below which a repeat is not wanted.
    """
    rank = levels[-1]
    order = np.empty(len(words), np.int64)
    order[rank] = np.arange(len(words))
    common = np.zeros(max(0, len(words) - 1), np.int64)
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    common[near] = common_prefixes(levels, order[near], order[near + 1])
    nodes = np.array(inner_nodes(common.tolist(), least), np.int64).reshape(-1, 5)
    starts, periods = [], []
    for of, sizes, begin in ((nodes, nodes[:, 3] - nodes[:, 1], nodes[:, 1]), (nodes, nodes[:, 2] - nodes[:, 4], nodes[:, 4] + 1)):
        # the leaves left and right of the largest child
        at = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        depth, low, high = (np.repeat(of[:, c], sizes) for c in (0, 1, 2))
        leaf = order[at]
        for first in (leaf, leaf - depth):
            second = first + depth
            other = second if first is leaf else first
            inside = (other >= 0) & (other < len(words))
            there = rank[np.where(inside, other, 0)]
            found = np.flatnonzero(inside & (there >= low) & (there <= high))
            found = found[words[second[found]] != words[second[found] + depth[found]]]
            starts.append(first[found])
            periods.append(depth[found])
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(words: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least so many words and periods, by start and period. words: as for suffix_ranks()."""
    levels = suffix_ranks(words)
    start, period = branching_repeats(words, levels, least_exponent)
    end = start + 2 * period
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left; what agrees is a repeated stretch, shorter than twice the last step
        to = start - (1 << k)
        here = np.maximum(to, 0)
        start = np.where((to >= 0) & (levels[k][here] == levels[k][here + period]), to, start)
    long = end - start >= np.maximum(least_length, least_exponent * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    once = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, period = start[once], end[once], period[once]
    by = np.lexsort((period, start))
    return start[by], (end - start)[by], period[by]


def _together(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    part, held = [], 0
    for t in texts:
        if part and held + len(t or "") > size:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t or "")
    if part:
        yield part


def find_runs(texts: list[str | None], least_length: int, least_exponent: int) -> tuple[list[int], list[list[dict]], list[str]]:
    """Words, runs and collapsed text of each text."""
    split = [(t or "").encode().split() for t in texts]
    ids, n = np.empty(sum(map(len, split)) + len(split), np.int64), 0
    ends, used = [], 0
    for words in split:
        known: dict[bytes, int] = {}
        ids[n : n + len(words)] = [known.setdefault(w, len(known)) for w in words]
        ids[n : n + len(words)] += used
        n += len(words) + 1
        used += len(known) + 1
        ids[n - 1] = used - 1
        ends.append(n)
    start, length, period = runs_of(ids, least_length, least_exponent)
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, start + length, -1)
    gone = np.cumsum(gone)[:n] > 0
    cut = np.searchsorted(start, ends)
    runs, collapsed, at, begin = [], [], 0, 0
    for words, to, end in zip(split, cut.tolist(), ends, strict=True):
        own = slice(at, to)
        runs.append([{"start": s - begin, "length": m, "period": p} for s, m, p in zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True)])
        if to > at:
            words = [words[i] for i in np.flatnonzero(~gone[begin : end - 1]).tolist()]
        collapsed.append(b" ".join(words).decode())
        at, begin = to, end
    return [len(w) for w in split], runs, collapsed


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are split at ASCII white space and numbered from 0. collapsed: the words, joined by one space, without those that
    some run contains after its first period. A null or empty text has no words, no runs and an empty collapsed text. Rows
    that repeat an id, and null ids, are each a text of their own. A text of any length is taken whole, in memory that grows
    with its words. An empty table gives an empty result; other columns are not read. Nothing is shuffled. At least two
    periods make a run: least_exponent is 2 or more.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            at = 0
            for texts in _together(batch.column(1).to_pylist(), TOGETHER):
                n, runs, collapsed = find_runs(texts, least_length, least_exponent)
                columns = [batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
                at += len(texts)

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RUNS}")
