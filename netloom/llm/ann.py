"""Nearest neighbours by inner product: inverted lists, and in each probed list an adaptive scan of dimensions.

Vectors get one more component, so that the largest inner product is the least distance, and are rotated at random: then
some of the components of a difference tell, with a known error, how long it is. A list keeps its rotated vectors in
blocks of columns. A scan adds up distances block by block and, after each, a hypothesis test abandons the candidates whose
partial distance makes it unlikely that they are nearer than the best found so far. What survives is scored on the original
vectors, in double precision.

Equal vectors are one class, with its ``k + 1`` smallest ids, of which any answer has at most ``k``: a vector that is very
common is searched once and found once. Each query first scans its nearest list; what it finds there bounds the scans
of all others. How many lists a query probes is measured on a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Work, unused

#: Neighbours of a query; vectors of a list on average, and lists at most (beyond, lists grow and have more blocks).
K, LIST, MOST_LISTS = 20, 1024, 4096
#: Vectors and queries of a block, components of a block of columns, vectors after which a scan updates its bounds.
BLOCK, QUERIES, COLUMNS, STEP = 2048, 512, 16, 256
#: Vectors that the lists are fitted on at most, and their bytes; queries that the number of probed lists is measured with, and the recall it must reach there.
SAMPLE, SAMPLE_BYTES, TRIALS, RECALL = 65_536, 32 << 20, 256, 0.97
#: Deviations by which a partial distance must exceed the bound.
DEVIATIONS = 3.0
ROUNDS = 8


class Space(NamedTuple):
    """What all tasks know: the components and their type, the scale and greatest length, the rotation, the lists' centres, probed lists."""

    dim: int
    kind: str
    scale: float
    longest: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int

    def place(self, v: np.ndarray) -> np.ndarray:
        """Vectors with one component more, of length 1 all, rotated."""
        return lifted(v, self.scale, self.longest) @ self.rotation

    def place_queries(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        return np.concatenate([v, np.zeros((len(v), 1))], axis=1) @ self.rotation


def lifted(v: np.ndarray, scale: float, longest: float) -> np.ndarray:
    v = v.astype(np.float64) / scale / longest
    return np.concatenate([v, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", v, v)))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of y."""
    return np.maximum(0, np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y) - 2 * x @ y.T)


def cluster(points: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of k-means."""
    centres = points[rng.choice(len(points), lists, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([distances(points[i : i + 8192], centres).argmin(1) for i in range(0, len(points), 8192)])
        sizes = np.bincount(own, minlength=lists)
        by = np.argsort(own, kind="stable")
        used = np.flatnonzero(sizes)
        centres = points[rng.choice(len(points), lists, replace=True)]  # for a list without points
        centres[used] = np.add.reduceat(points[by], np.cumsum(sizes)[used] - sizes[used]) / sizes[used][:, None]
    return centres


def lists_needed(points: np.ndarray, tried: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest lists that hold so many of the k nearest points of the tried ones, which are points themselves."""
    own = np.concatenate([distances(points[i : i + 8192], centres).argmin(1) for i in range(0, len(points), 8192)])
    near = np.argsort(distances(tried, points), axis=1)[:, 1 : k + 1]
    order = np.argsort(np.argsort(distances(tried, centres), axis=1), axis=1)
    place = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1 if len(place) else len(centres)


def fit(classes: DataFrame, dim: int, kind: str, k: int, seed: int = 7) -> Space:
    """The lists, from at most SAMPLE classes that a hash picks; lengths and the scale from all. classes: class, v (not empty)."""
    top = classes.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))).alias("scale"), F.count(F.lit(1)).alias("n")).first()
    length = F.aggregate("v", F.lit(0.0), lambda s, c: s + (c.cast("double") / F.lit(top["scale"])) * (c.cast("double") / F.lit(top["scale"])))
    longest = float(np.sqrt(classes.agg(F.max(length)).first()[0])) * (1 + 1e-12)
    some = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * dim)))
    picked = classes.orderBy(F.xxhash64(F.lit(seed), "class"), "class").limit(some).select("v").toArrow()  # SAMPLE_BYTES at most
    v = picked.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
    points = lifted(v, top["scale"], longest) @ rotation
    centres = cluster(points, max(1, min(MOST_LISTS, len(points) // 8, -(-top["n"] // LIST))), rng)
    space = Space(dim, kind, top["scale"], longest, rotation, centres, len(centres))
    return space._replace(probes=lists_needed(points, space.place_queries(v[:TRIALS]), centres, k, RECALL))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def assigned(classes: DataFrame, space: Space) -> DataFrame:
    """classes (class, v, ids) with the list of each."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = distances(space.place(_vectors(part.column(1), space.dim)), space.centres).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *part.columns], names=["list", "class", "v", "ids"])

    rows = classes.select("class", "v", "ids")
    return rows.mapInArrow(assign, f"list int, class long, v {rows.schema['v'].dataType.simpleString()}, ids array<long>")


def column_starts(width: int) -> list[int]:
    """Where blocks of columns begin and the last ends; a short rest belongs to the last."""
    return [*range(0, max(1, width - COLUMNS // 2), COLUMNS), width]


def blocks(rows: DataFrame, space: Space) -> DataFrame:
    """list, sizes (ids of each vector), ids, v, columns: BLOCK vectors of a list at most, rotated, in blocks of columns. rows: as assigned() gives them, written."""
    parts = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_parts")))  # MOST_LISTS rows at most
    dealt = rows.join(parts, "list").withColumn("_part", F.pmod(F.xxhash64("class"), F.col("_parts")))
    dealt = dealt.repartition("list", "_part").sortWithinPartitions("list", "_part").select("list", "v", "ids")
    starts = column_starts(space.dim + 1)

    def block(of: int, v: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
        x = space.place(v).astype(np.float32)
        columns = [np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in zip(starts, starts[1:], strict=False)]
        flat = np.array([i for own in ids for i in own], np.int64).tobytes()
        sizes = np.array([len(own) for own in ids], np.int32).tobytes()
        values = ([of], pa.int32()), ([sizes], pa.binary()), ([flat], pa.binary()), ([v.tobytes()], pa.binary()), ([columns], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in values], names=["list", "sizes", "ids", "v", "columns"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, vs, ids = None, [], []
        for batch in batches:
            lists = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(lists)]
            v, own = _vectors(batch.column(1), space.dim), batch.column(2).to_pylist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if lists[a] != last and ids:
                    yield block(last, np.concatenate(vs), ids)
                    vs, ids = [], []
                last = int(lists[a])
                while a < b:
                    to = min(b, a + BLOCK - len(ids))
                    vs.append(v[a:to])
                    ids += own[a:to]
                    a = to
                    if len(ids) == BLOCK:
                        yield block(last, np.concatenate(vs), ids)
                        vs, ids = [], []
        if ids:
            yield block(last, np.concatenate(vs), ids)

    return dealt.mapInArrow(pack, "list int, sizes binary, ids binary, v binary, columns array<binary>")


def probes(asked: DataFrame, space: Space) -> DataFrame:
    """list, nth, class, q for the lists that each query probes, nearest first. asked: class, v."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = _vectors(part.column(1), space.dim)
                near = np.argsort(distances(space.place_queries(v), space.centres), axis=1, kind="stable")[:, : space.probes]
                rows = np.repeat(np.arange(len(v)), near.shape[1])
                q = pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(rows))
                nth = np.tile(np.arange(near.shape[1], dtype=np.int32), len(v))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(nth), part.column(0).take(pa.array(rows)), q], names=["list", "nth", "class", "q"])

    return asked.select("class", "v").mapInArrow(find, "list int, nth int, class long, q binary")


def products(v: np.ndarray, q: np.ndarray, which: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Inner products of pairs, in double precision and in the order of components, as a plain sum has them."""
    out, some = np.empty(len(who)), max(1, (1 << 20) // v.shape[1])
    for i in range(0, len(who), some):
        out[i : i + some] = np.cumsum(v[which[i : i + some]].astype(np.float64) * q[who[i : i + some]].astype(np.float64), axis=1)[:, -1]
    return out


def scan(x: list[np.ndarray], v: np.ndarray, first_ids: np.ndarray, placed: list[np.ndarray], q: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector, score and squared distance of each query's k best vectors among those nearer than its bound, best first.

    x, placed: rotated vectors and queries in blocks of columns; v, q: the original ones; bounds: squared distances.
    """
    width = sum(b.shape[1] for b in x)
    bounds = bounds.copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    for at in range(0, len(v), STEP):
        part = [b[at : at + STEP] for b in x]
        far = distances(placed[0], part[0])
        seen = part[0].shape[1]
        for b in range(len(part)):
            if b:
                gap = placed[b][who] - part[b][which]  # noqa: F821
                far = far + np.einsum("ij,ij->i", gap, gap)
                seen += part[b].shape[1]
            room = 1 + 1e-4 if seen == width else (1 + DEVIATIONS / np.sqrt(seen)) ** 2
            limit = bounds * room * seen / width + 1e-6
            if b:
                stay = far <= limit[who]
                who, which, far = who[stay], which[stay], far[stay]
            else:
                who, which = np.nonzero(far <= limit[:, None])
                far = far[who, which]
        score = products(v, q, at + which, who)
        who, which, score, far = (np.concatenate(p) for p in zip(best, (who, at + which, score, far.astype(np.float64)), strict=True))
        by = np.lexsort((first_ids[which], -score, who))
        who, which, score, far = who[by], which[by], score[by], far[by]
        start = np.searchsorted(who, np.arange(len(q)))
        nth = np.arange(len(who)) - start[who]
        last = nth == k - 1
        bounds[who[last]] = np.minimum(bounds[who[last]], far[last])
        best = tuple(a[nth < k] for a in (who, which, score, far))
    return best


def search(index: DataFrame, asked: DataFrame, space: Space, k: int) -> DataFrame:
    """class, score, far, ids of the k best vectors of each block that a query probes. asked: list, class, q, bound."""
    kind, starts = np.dtype(space.kind), column_starts(space.dim + 1)
    per_list = F.pmod(F.xxhash64("class"), F.lit(8))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["list", "classes", "qs", "bounds"]
        for batch in batches:
            lists = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(lists)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for i in range(a, b, QUERIES):
                    part = batch.slice(i, min(QUERIES, b - i))
                    qs = b"".join(part.column(2).to_pylist())
                    values = ([int(lists[a])], pa.int32()), ([part.column(1).to_numpy().tobytes()], pa.binary()), ([qs], pa.binary()), ([part.column(3).to_numpy().tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in values], names=names)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                classes, qs, bounds, sizes, ids, vs, columns = (c[i].as_py() for c in batch.columns)
                sizes, ids, v = np.frombuffer(sizes, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(vs, kind).reshape(-1, space.dim)
                q = np.frombuffer(qs, kind).reshape(-1, space.dim)
                ends = np.cumsum(sizes)
                x = [np.frombuffer(c, np.float32).reshape(len(v), -1) for c in columns]
                turned = space.place_queries(q).astype(np.float32)
                placed = [turned[:, a:b] for a, b in zip(starts, starts[1:], strict=False)]
                who, which, score, far = scan(x, v, ids[ends - sizes], placed, q, np.frombuffer(bounds, np.float64), k)
                own = sizes[which]
                flat = ids[np.repeat((ends - sizes)[which] - np.cumsum(own) + own, own) + np.arange(own.sum())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(classes, np.int64)[who]), pa.array(score), pa.array(far), lists], names=["class", "score", "far", "ids"])

    dealt = asked.select("list", "class", "q", "bound").repartition("list", per_list).sortWithinPartitions("list")
    packed = dealt.mapInArrow(pack, "list int, classes binary, qs binary, bounds binary")
    both = packed.join(index, "list").select("classes", "qs", "bounds", "sizes", "ids", "v", "columns")
    return both.mapInArrow(scanned, "class long, score double, far double, ids array<long>")


def nearest(vectors: DataFrame, wanted: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``wanted`` holds for, its k nearest of all rows but those of its own id.

    Nearness is the inner product in double precision; ties go to the smaller id. Rows without an id, and vectors that
    are null, empty, zero, or hold a null or non-finite component, take no part; nor do vectors whose number of components
    is not the most common one (of equally common ones, the largest). Rows that repeat id and vector count once. Rows
    that give one id several vectors are each a candidate and each a query. Where there are fewer candidates than k, all
    found are returned; an empty table gives an empty result. Other columns are not read. Lists are fitted on a sample
    (SAMPLE), but hold every vector.
    """
    spark = vectors.sparkSession
    work, kind = Work(spark), vectors.schema[vec_col].dataType.elementType.simpleString()
    flag = unused(vectors, "_wanted")
    v = F.col(vec_col) if kind in ("float", "double") else F.col(vec_col).cast("array<double>")
    rows = vectors.withColumn(flag, F.coalesce(wanted, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("v"), F.col(flag).alias("asked"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = f"query_id {rows.schema['id'].dataType.simpleString()}, rank int, vec_id {rows.schema['id'].dataType.simpleString()}, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == common["d"])
    once = rows.groupBy("v", "id").agg(F.max("asked").alias("asked"))
    least = once.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= k + 1)
    classes = least.groupBy("v").agg(F.sort_array(F.collect_list(F.col("id").cast("long"))).alias("ids"))  # k + 1 at most
    classes = work.table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    asked = once.filter("asked").join(classes.select("v", "class"), "v")
    asked = work.table(asked.select("id", "class"), "asked")
    space = fit(classes, common["d"], "f4" if kind == "float" else "f8", k)
    lists = work.table(assigned(classes, space), "lists")
    index = work.table(blocks(lists, space), "index")
    questions = classes.join(asked.select("class").distinct(), "class", "left_semi")
    probed = work.table(probes(questions, space), "probes")
    work.drop("lists")
    most = k + 1  # a class's own ids may be the query's

    def merged(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("class").orderBy(F.desc("score"), F.col("ids")[0])
        return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most)

    near = work.table(merged(search(index, probed.filter("nth = 0").withColumn("bound", F.lit(float("inf"))), space, most)), "near")
    bounds = near.filter(F.col("_n") == most).select("class", F.col("far").alias("bound"))
    rest = probed.filter("nth > 0").join(bounds, "class", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    found = near.drop("_n").unionByName(search(index, rest, space, most))
    each = merged(found).select("class", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") <= most)
    told = work.table(each.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("best")), "told")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)
    answers = asked.join(told, "class").select(F.col("id").alias("query_id"), F.posexplode(others).alias("_at", "_b"))
    answers = answers.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_b.vec_id").cast(rows.schema["id"].dataType).alias("vec_id"), "_b.score")
    answers = work.table(answers, "answers")
    work.drop(but="answers")
    return answers
