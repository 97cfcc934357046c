"""Near-duplicates by bottom-k sketches from one hash function.

A document's set of word shingles is kept as its ``k`` smallest hashes, or whole if it has no more. Documents with
equal sets form a class with one representative. The retained values of representatives make inverted lists. Two sets
of Jaccard similarity ``threshold`` or more share so many retained values that they meet in the lists of their rarest
ones, so common values need no list at all. Candidates are filtered by the similarity that the union of two sketches
estimates, and confirmed on the shingles themselves.

Lists are not expanded into all pairs. Each list first pairs its members with a few pivots, those whose values are
held by others most; verified links are joined into components, and pairs within a component cannot change it. Where
members of several components are left in a list, short lists pair them all. The members of long ones get lists
anew, of their whole sets: there a similar set must share an exact number of values, which depends on both sizes, so
that a large group of texts that are close, but not close enough, hardly meets in them. All pairs that may link are
thereby checked, and the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Work, parted, short_batches, unused

#: Words of a shingle, percent of similarity, values of a sketch, and the chance that a filter loses a link.
SHINGLE, PERCENT, K, LOSS = 5, 75, 160, 1e-6
MEMORY = 100_000
#: Members of a list that others meet in a round; rounds of random pivots at most, and the pairs a posting from which one is worth while.
PIVOTS, ROUNDS, WORTH = 4, 3, 8
#: Lists of so many members are paired at once; longer ones get lists of whole sets.
SHORT = 16
#: Ratio of the sizes of sets that share a class in lists of whole sets.
RATIO = 1.1
#: Retained values have so many bits: few enough to be stored tightly, enough that two sets share none by chance.
BITS = 48


class Shingles:
    """Hashes of a text's distinct shingles, in order. ASCII capitals are lowered; words are split at ASCII white space."""

    def __init__(self, width: int = SHINGLE):
        self.width, self.known = width, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted, of 64 bits. A text with fewer words than a shingle is one shingle; one without words has none."""
        words, known = (text or "").encode().lower().split(), self.known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > MEMORY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        ids = np.array([known[w] for w in words], np.uint64)
        width = min(self.width, len(ids))
        n = len(ids) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = (out ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out * np.uint64(0xD6E8FEB86659FD93))


def similar(x: str, y: str, width: int, percent: int) -> bool:
    """Whether the sets of shingles of two texts are similar enough: on the words themselves, not on hashes."""
    a, b = x.encode().lower().split(), y.encode().lower().split()
    if len(a) < width or len(b) < width:
        return a == b  # a shorter text is one shingle, which no longer text has
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in a + b], np.int64)
    n, size = len(ids) - width + 1, len(known)
    grams, bound = ids[:n], size
    for i in range(1, width):
        if bound * size >= 1 << 62:
            grams, bound = np.unique(grams, return_inverse=True)[1].astype(np.int64), n
        grams, bound = grams * size + ids[i : i + n], bound * size
    left, right = np.unique(grams[: len(a) - width + 1]), np.unique(grams[len(a) :])
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def fewest_shared(k: int, share: float, loss: float) -> int:
    """The most t such that fewer than t of k values, each wanted with this chance, come with a chance of ``loss`` at most."""
    total = 0.0
    for t in range(k + 1):
        total += comb(k, t) * share**t * (1 - share) ** (k - t)
        if total > loss:
            return t
    return k


def must_share(n_x: Column, n_y: Column, k: int, percent: int, loss: float) -> Column:
    """Retained values that two similar sets of these sizes have in common: certain if both are whole, else but for ``loss``.

    Similar sets have ``percent / (100 + percent)`` of both sizes in common. Of the retained values of a set, each is
    in the other with a chance of their share in it, which grows with the ratio of the sizes; what both retain is k
    less the larger of two such counts of the others, hence half of ``loss`` for either.
    """
    whole = F.ceil(percent * (n_x + n_y) / (100 + percent))
    least = [fewest_shared(k, percent / (100 + percent) * (1 + r / 100), loss / 2) for r in range(percent, 101)]
    ratio = F.floor(100 * F.least(n_x, n_y) / F.greatest(n_x, n_y)).cast("int")
    drawn = F.get(F.array(*[F.lit(t) for t in least]), F.greatest(ratio - percent, F.lit(0)))
    return F.when((n_x <= k) & (n_y <= k), whole).otherwise(F.least(whole, drawn))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The rows of batches, few at a time: what is made of them may be larger than they are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, width: int) -> DataFrame:
    """doc_id, mark (of the text), n, print (of the set), sketch for each row of docs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for part in _parts(batches):
            sets = [shingles.of(t) for t in part.column(2).to_pylist()]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            lists = pa.array([np.unique(s[:k] >> np.uint64(64 - BITS)).astype(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), lists], names=["doc_id", "mark", "n", "print", "sketch"])

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, n long, print binary, sketch array<long>")


def _ranked(values: DataFrame) -> DataFrame:
    """id, n, v: the values (df, value) of each set that some other set holds too, rarest first. values: id, n, value."""
    common = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return values.join(common, "value").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))


def _prefix(ranked: DataFrame, shared: Column) -> DataFrame:
    """value, id, n, left of the rarest values of each set, of which any set that shares ``shared`` values has one.

    left: how many values of the set are as common as this one or more so, itself included. Values that no other set
    holds are the rarest; they take their places and need no list.
    """
    lists = ranked.withColumn("room", (F.size("v") - shared + 1).cast("int")).filter("room > 0")
    lists = lists.select("id", "n", F.size("v").alias("_m"), F.posexplode(F.slice("v", F.lit(1), F.col("room"))).alias("_at", "_v"))
    return lists.select("_v.value", "id", "n", "_m", (F.col("_m") - F.col("_at")).alias("left"))


def rare_postings(sets: DataFrame, k: int, percent: int, loss: float) -> DataFrame:
    """value, id, n, left, lone: the rarest retained values of each set, as many as any similar set must meet; none unique.

    lone: the share, in thousandths, of the set's retained values that no other set retains.
    """
    t = fewest_shared(k, percent / 100, loss)
    whole = F.ceil(F.col("n") * percent / 100)  # of any similar set, this many values at least are in this one
    shared = F.when(F.floor(F.col("n") * 100 / percent) <= k, whole).otherwise(F.least(F.lit(t), whole))
    lists = _prefix(_ranked(sets.select("id", "n", F.explode("sketch").alias("value"))), shared)
    kept = F.least(F.col("n"), F.lit(k))
    return lists.select("value", "id", "n", "left", F.floor(1000 * (kept - F.col("_m")) / kept).cast("int").alias("lone"))


def _side(s: str, *names: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{s}") for c in names]


def _pairs(both: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of x and y, the smaller id first."""
    swap = F.col("id_y") < F.col("id_x")
    pick = lambda p, q: F.when(swap, F.col(p)).otherwise(F.col(q))
    return both.select(pick("id_y", "id_x").alias("a"), pick("n_y", "n_x").alias("n_a"), pick("id_x", "id_y").alias("b"), pick("n_x", "n_y").alias("n_b")).distinct()


def _may_link(k: int, percent: int, loss: float) -> Column:
    """For members x and y of a list, of different components: if this is the rarest value they share, enough may follow; and their sizes allow it."""
    n_x, n_y = F.col("n_x"), F.col("n_y")
    near = (n_x * 100 >= n_y * percent) & (n_y * 100 >= n_x * percent)
    return (F.col("c_x") != F.col("c_y")) & near & (F.least("left_x", "left_y") >= must_share(n_x, n_y, k, percent, loss))


_MEMBER = ("id", "n", "left", "c")


def _pairs_with_pivots(lists: DataFrame, may_link: Column, salt: int) -> DataFrame:
    """Pairs of each list's members with up to PIVOTS of them: at salt 0 those that share most, else chosen by a hash."""
    draw = F.xxhash64(F.lit(salt), "id")
    first = (F.col("lone") if salt == 0 else F.lit(0)).alias("l")
    drawn = lists.groupBy("value", F.pmod(draw, F.lit(PIVOTS)).alias("g")).agg(F.min(F.struct(first, draw.alias("h"), *_MEMBER)).alias("p"))
    pivots = drawn.select("value", *(F.col(f"p.{c}").alias(f"{c}_x") for c in _MEMBER))
    return _pairs(lists.select("value", *_side("y", *_MEMBER)).join(pivots, "value").filter(may_link))


def _pairs_in_short_lists(lists: DataFrame, may_link: Column) -> DataFrame:
    """All pairs of the members of lists with at most SHORT members."""
    x, y = (lists.filter(F.col("members") <= SHORT).select("value", *_side(s, *_MEMBER)) for s in "xy")
    return _pairs(x.join(y, "value").filter((F.col("id_x") < F.col("id_y")) & may_link))


def _pairs_by_whole_sets(work: Work, full: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that may be similar, by lists of their whole sets. full: id, n, c, hashes.

    The larger set of a pair looks the smaller one up. The larger shares ``percent`` of its values at least, the
    smaller ``2 * percent / (100 + percent)`` of its own, so that the smaller one's lists are short. What the larger one still
    holds from its place in a list on bounds the size of the sets that are worth looking at: lists are split by classes of sizes.
    """
    n, left = F.col("n"), F.col("left")
    lists = _prefix(_ranked(full.select("id", "n", F.explode("hashes").alias("value"))), F.ceil(n * percent / 100))
    lists = work.table(lists.drop("_m").join(full.select("id", "c"), "id"), "whole-postings")
    size_class = lambda c: F.floor(F.log(c.cast("double")) / log(RATIO)).cast("int")
    index = lists.filter(left >= F.ceil(n * 2 * percent / (100 + percent))).withColumn("size", size_class(n))
    tops = index.groupBy("value", "size", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("value", "size").agg(F.max(F.struct("m", "c"))["c"].alias("top"))
    tops = work.table(tops, "tops")
    largest = F.least(n, F.floor(left * (100 + percent) / percent) - n)
    smallest = F.ceil(n * percent / 100)
    probe = lists.filter(largest >= smallest).withColumn("size", F.explode(F.sequence(size_class(smallest), size_class(largest))))
    index = index.join(tops, ["value", "size"]).select("value", "size", *_side("y", *_MEMBER), "top")
    probe = probe.join(tops, ["value", "size"]).select("value", "size", *_side("x", *_MEMBER), (F.col("c") == F.col("top")).alias("in_top"))
    n_x, n_y = F.col("n_x"), F.col("n_y")
    fits = (F.col("c_x") != F.col("c_y")) & (n_y <= n_x) & (F.least("left_x", "left_y") >= F.ceil(percent * (n_x + n_y) / (100 + percent)))
    outside = probe.filter(~F.col("in_top")).join(index, ["value", "size"]).filter(fits)
    inside = probe.filter("in_top").join(index.filter("c_y <> top"), ["value", "size"]).filter(fits)
    return _pairs(outside.select("id_x", "n_x", "id_y", "n_y").unionByName(inside.select("id_x", "n_x", "id_y", "n_y")))


def estimate(pairs: DataFrame, sets: DataFrame, k: int, percent: int, loss: float) -> DataFrame:
    """a, b of the pairs whose sketches allow the threshold: of the k smallest values of both, enough are in both."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("sketch").alias(f"s_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    smallest = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    common = F.array_intersect("s_a", "s_b")
    in_both, shared = F.size(F.array_intersect(smallest, common)), F.size(common)
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    sure = 100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)
    return both.filter(F.when(whole, sure).otherwise(in_both >= F.lit(fewest_shared(k, percent / 100, loss)))).select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """a, b of the pairs whose full sets are similar enough. texts: id, text."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            a, b, x, y = part.columns
            keep = pa.array([similar(p.as_py(), q.as_py(), width, percent) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    side = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def components(work: Work, links: DataFrame) -> DataFrame:
    """id, component for each id in links (a, b): the smallest id that is reachable.

    Each round hooks every node to its smallest neighbour below it, shortens the trees to their roots by doubling, and
    contracts the links to roots. Nodes hook to smaller ones only, so trees have no cycles; rounds are logarithmic.
    """
    edges = work.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    forest = None
    while edges.take(1):
        up = work.table(edges.groupBy("u").agg(F.min("v").alias("root")), "hooks")
        while True:
            above = up.select(F.col("u").alias("_p"), F.col("root").alias("_r"))
            doubled = up.join(above, up["root"] == above["_p"], "left").select("u", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved"))
            doubled = work.table(doubled, "roots")
            moved = bool(doubled.filter("moved").take(1))
            up = doubled.select("u", "root")
            if not moved:
                break
        if forest is None:
            forest = up
        else:
            above = up.select(F.col("u").alias("_p"), F.col("root").alias("_r"))
            moved_up = forest.join(above, forest["root"] == above["_p"], "left").select("u", F.coalesce("_r", "root").alias("root"))
            forest = work.table(moved_up.unionByName(up), "forest")
        ends = {s: up.select(F.col("u").alias(f"_{s}"), F.col("root").alias(f"r_{s}")) for s in "uv"}
        moved_edges = edges.join(ends["u"], edges["u"] == ends["u"]["_u"], "left").join(ends["v"], edges["v"] == ends["v"]["_v"], "left")
        x, y = F.coalesce("r_u", "u"), F.coalesce("r_v", "v")
        edges = work.table(moved_edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter("u > v").distinct(), "edges")
    if forest is None:
        return work.table(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "labels")
    roots = forest.select(F.col("root").alias("id"), F.col("root").alias("component")).distinct()
    return work.table(forest.select(F.col("u").alias("id"), F.col("root").alias("component")).unionByName(roots), "labels")


class _Lists:
    """The lists of one table of documents, the components so far, and the steps that join them."""

    def __init__(self, work: Work, docs: DataFrame, nodes: DataFrame, sets: DataFrame, postings: DataFrame, k: int, percent: int, width: int, loss: float):
        self.work, self.docs, self.nodes, self.sets, self.postings = work, docs, nodes, sets, postings
        self.k, self.percent, self.width, self.loss = k, percent, width, loss
        self.may_link, self.labels = _may_link(k, percent, loss), None

    def texts(self, ids: DataFrame) -> DataFrame:
        """id, text of nodes (id, several times or once)."""
        wanted = self.work.table(self.nodes.join(ids.select("id").distinct(), "id").select("id", "first.*"), "wanted")
        rows, _ = parted(self.docs, F.col("mark"), wanted, F.col("mark"))
        rows = rows.join(wanted, ["doc_id", "mark"]).select("id", "text")
        return rows.groupBy("id").agg(F.first("text").alias("text"))  # rows may repeat

    def link(self, pairs: DataFrame) -> None:
        """Confirm pairs and join what they link."""
        close = self.work.table(estimate(pairs, self.sets, self.k, self.percent, self.loss), "close")
        texts = self.work.table(self.texts(close.select(F.explode(F.array("a", "b")).alias("id"))), "texts")
        links = verify(close, texts, self.percent, self.width)
        if self.labels is not None:
            links = links.unionByName(self.labels.select(F.col("id").alias("a"), F.col("component").alias("b")))
        self.labels = components(self.work, links)
        self.work.drop("close", "texts", "wanted", "edges", "hooks", "roots", "forest")

    def mixed(self) -> tuple[DataFrame, int]:
        """The lists whose members lie in several components, with c and members; and the pairs left in the long ones, without their largest component's own."""
        held = self.postings.join(self.labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        held = self.work.table(held, "held")
        sizes = held.groupBy("value", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("value")
        lists = sizes.agg(F.max("m").alias("top"), F.sum("m").alias("members"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        lists = self.work.table(lists, "mixed")
        left = lists.filter(F.col("members") > SHORT).agg(F.coalesce(F.sum(F.expr("(members - top) * members")), F.lit(0))).first()[0]
        return self.work.table(held.join(lists.select("value", "members"), "value"), "mixed-lists"), left


def _told(docs: DataFrame, id_col: str, text_col: str, percent: int, k: int, width: int, loss: float) -> DataFrame:
    """doc_id, mark, n, component_id, kept for each row of docs."""
    work = Work(docs.sparkSession)
    sketched = work.table(sketches(docs, id_col, text_col, k, width), "sketches")
    rows = work.table(sketched.drop("sketch"), "rows")
    linked = sketched.filter("n > 0 and doc_id is not null")
    classes = linked.groupBy("print").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "mark")).alias("first"))
    sets = work.table(classes.withColumn("id", F.monotonically_increasing_id()), "sets")
    work.drop("sketches")
    nodes = work.table(sets.select("id", "print", "first"), "nodes")
    postings = work.table(rare_postings(sets, k, percent, loss), "postings")
    met = work.table(sets.select("id", "sketch").join(postings.select("id").distinct(), "id", "left_semi"), "met")
    work.drop("sets")
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    state = _Lists(work, source, nodes, met, postings, k, percent, width, loss)

    state.link(_pairs_with_pivots(postings.withColumn("c", F.col("id")), state.may_link, 0))
    lists, left = state.mixed()
    size = postings.count()
    for salt in range(1, ROUNDS + 1):
        if left <= WORTH * size:
            break
        state.link(_pairs_with_pivots(lists, state.may_link, salt))
        work.drop("held", "mixed", "mixed-lists")
        before = left
        lists, left = state.mixed()
        if left > 0.8 * before:  # what is left apart is hardly linked
            break
    pairs = _pairs_in_short_lists(lists, state.may_link)
    if left:
        hard = work.table(lists.filter(F.col("members") > SHORT).select("id", "c").distinct(), "hard")
        full = work.table(_whole_sets(state.texts(hard), width).join(hard, "id"), "whole")
        pairs = pairs.unionByName(_pairs_by_whole_sets(work, full, percent)).distinct()
    state.link(pairs)

    labels = state.labels.join(nodes.select("id", "first.doc_id"), "id")
    labels = labels.join(labels.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("id", "component_id")
    named = nodes.join(labels, "id", "left").select("print", F.coalesce("component_id", "first.doc_id").alias("component_id"))
    told = rows.join(named, "print", "left")
    told = told.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    told = told.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    told = work.table(told.select("doc_id", "mark", "n", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "told")
    work.drop(but="told")
    return told


def _whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """id, n, hashes of whole sets. texts: id, text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for part in _parts(batches):
            sets = [shingles.of(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "n", "hashes"])

    return texts.select("id", "text").mapInArrow(hashed, "id long, n long, hashes array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = K, width: int = SHINGLE, loss: float = LOSS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    What is linked are texts: rows that repeat an id with other texts are documents of their own, and a component has
    the smallest id of its texts. Rows of equal text and id share one verdict. A null id is linked with nothing and kept, with a null
    component; so are texts that are null, empty or without words, each its own component. An empty table gives an
    empty result; other columns are not read. Sizes count 64-bit hashes of shingles, and sets are told apart by 128 bits of
    hashes of them: two that meet would be taken for one, with a chance of less than 1e-9 for a document of a million words.
    """
    told = _told(docs, id_col, text_col, percent, k, width, loss)
    return told.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with the columns of docs: rows go by id and text, so no text is lost with another's.

    Null and empty texts, texts without words and null ids all stay. An empty table gives an empty result. Only rows that go are shuffled with their texts.
    """
    key, mark = unused(docs, "_gone"), unused(docs, "_mark")
    gone = _told(docs, id_col, text_col, PERCENT, K, SHINGLE, LOSS).filter("not kept").select(F.col("doc_id").alias(key), F.col("mark").alias(mark)).distinct()
    may_go, stays = parted(docs, F.xxhash64(text_col), gone, F.col(mark))
    return stays.unionByName(may_go.join(gone, (may_go[id_col] == gone[key]) & (F.xxhash64(may_go[text_col]) == gone[mark]), "left_anti"))
