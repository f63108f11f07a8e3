"""Approximate nearest neighbours by inner product: an inverted multi-index.

Vectors are cut into two halves, each with its own k-means centroids, fitted on at most ``FIT_ROWS`` different
vectors; a cell is a pair of centroids and every different vector is an entry of its cell.  A query walks the pairs
from the best summed inner product downwards with a heap until the cells passed hold ``share`` of all entries, and all
entries of those cells are ranked by their exact inner product in double precision.  That is the only way at any size.

Rows of equal vectors are one entry with its ``top + 1`` smallest ids, which is all that a query can need of them, and
queries of equal vectors are searched once; so copies don't pile up in a cell.  Entries are dealt out by first
centroid in parts of some ``PART`` entries, at least ``PARTS`` of them, and queries in blocks of ``BLOCK``; a query goes to the parts that hold
cells it passes, with the sum at which its walk ended, and a task ranks one block against one part and returns ``top + 1`` for
each query.  An entry is copied once for each block and a query once for each part that it passes.  Only centroids and
cell counts reach the driver.

``share`` is two fifths because part of such tables is directionless: neighbours of a random unit vector are hardly nearer
than the rest, and a smaller share loses them.  Recall by share, from ``recall``, is in the README.

Defined results: vectors that are null, empty, zero, or that hold null or non-finite components take no part, nor do rows
with a null id; vectors of different lengths have no inner product, so each length is a table of its own; every row is a
candidate, also one that repeats another's id or vector, and a query leaves out one row of its own id and vector; repeated queries
are answered each; with fewer than ``top`` candidates all are returned; ties go to the smaller id; an empty table gives an
empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

TOP = 20
EVERY = 20
FIT_ROWS = 16_384
CENTROIDS = 128
SHARE = 0.4
PART = 32_768
PARTS = 16
BLOCK = 16_384
_EMPTY = "query_id long, rank int, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int) -> float:
    """Cells in order of ``first[i] + second[j]`` until they hold ``need`` entries: the sum of the last of them."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    held = counts[np.ix_(a, b)].tolist()
    heap, reached, total, last = [(-(x[0] + y[0]), 0, 0)], [-1] * len(a), 0, np.inf
    pop, push = heapq.heappop, heapq.heappush
    while heap and total < need:
        s, i, j = pop(heap)
        last = -s
        total += held[i][j]
        reached[i] = j
        # A pair is offered once both pairs before it have been passed.
        if i + 1 < len(a) and reached[i + 1] == j - 1:
            push(heap, (-(x[i + 1] + y[j]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j):
            push(heap, (-(x[i] + y[j + 1]), i, j + 1))
    return last


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v, h, g)`` of the rows that take part; ``h`` and ``g`` are 128 bits of hash, by which vectors are equal."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    valid = valid.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    return valid.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.reverse("v"), F.lit(1))})


def entries(valid: DataFrame, top: int, every: int) -> DataFrame:
    """Different vectors ``(h, g, v, key, ids, asked)``, with the smallest ids of their rows, and whether one is a query's.
    Vectors are shuffled once, copies of a task as one."""
    place = F.row_number().over(Window.partitionBy("h", "g").orderBy("vec_id"))
    few = valid.select("h", "g", "vec_id").withColumn("_place", place).where(F.col("_place") <= top + 1)
    few = few.groupBy("h", "g").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    one = valid.groupBy("h", "g").agg(F.first("v").alias("v"), F.max(F.col("vec_id") % every == 0).alias("asked"))
    return one.join(few, ["h", "g"]).withColumn("key", F.xxhash64("h", "g"))


def dealt(counts: np.ndarray, size: int, least: int) -> list[tuple[int, int]]:
    """First part and number of parts of each first centroid, from its number of entries: neighbouring small ones share a
    part, a large one has several."""
    size = max(1, min(size, -(-int(counts.sum()) // least)))
    out, part, held = [], 0, 0
    for n in counts.tolist():
        if held and held + n > size:
            part, held = part + 1, 0
        parts = max(1, -(-n // size))
        out.append((part, parts))
        if parts > 1:
            part, held = part + parts, 0
        else:
            held += n
    return out


def search(vectors: DataFrame, top: int = TOP, every: int = EVERY, share: float = SHARE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows whose id ``every`` divides."""
    valid = usable(vectors)
    lengths = sorted(r[0] for r in valid.select(F.size("v")).distinct().collect())
    found = vectors.sparkSession.createDataFrame([], _EMPTY)
    for n in lengths:
        one = _search(valid.where(F.size("v") == n), top, every, share)
        found = one if len(lengths) == 1 else found.unionByName(one)
    return found


def _search(valid: DataFrame, top: int, every: int, share: float) -> DataFrame:
    different = checkpointed(entries(valid, top, every))
    wanted = different.where("asked").select("key", "v")
    x = _matrix(different.orderBy(F.xxhash64("key"), "key").limit(FIT_ROWS).select("v").toArrow().column(0))
    half = x.shape[1] // 2
    k = max(1, min(CENTROIDS, len(x) // 4))
    halves = (kmeans(x[:, :half], k) if half else np.zeros((1, 0)), kmeans(x[:, half:], k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"))
            if len(m):
                cells = [pa.array(nearest(y, c).astype(np.int32)) for y, c in zip((m[:, :half], m[:, half:]), halves)]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("ids"), b.column("v"), *cells], names=["key", "ids", "v", "c1", "c2"])

    kind = different.schema["v"].dataType.simpleString()
    placed = checkpointed(different.select("key", "ids", "v").mapInArrow(place, f"key long, ids array<long>, v {kind}, c1 int, c2 int"))
    counts = np.zeros((len(halves[0]), len(halves[1])), np.int64)
    for r in placed.groupBy("c1", "c2").count().collect():  # at most CENTROIDS squared
        counts[r["c1"], r["c2"]] = r["count"]
    need = int(np.ceil(share * counts.sum()))
    parts = dealt(counts.sum(axis=1), PART, PARTS)
    held = counts > 0
    blocks = max(1, -(-wanted.count() // BLOCK))

    def sums(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return q[:, :half] @ halves[0].T, q[:, half:] @ halves[1].T

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 64):
                piece = b.slice(s, 64)
                row, at, end = [], [], []
                for i, (m, n) in enumerate(zip(*sums(_matrix(piece.column("v"))))):
                    least = walk(m, n, counts, need) - 1e-9  # the same sum can differ by its last digits where it is computed again
                    passed = np.flatnonzero((held & (m[:, None] + n >= least)).any(axis=1))
                    mine = sorted({p for c in passed.tolist() for p in range(parts[c][0], sum(parts[c]))})
                    row += [i] * len(mine)
                    at += mine
                    end += [least] * len(mine)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), piece.column("key").take(row), piece.column("v").take(row), pa.array(end, pa.float64())], names=["part", "key", "v", "least"])

    salt = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    probes = wanted.mapInArrow(probe, f"part int, key long, v {kind}, least double").withColumn("block", salt)
    of = [F.element_at(F.array(*[F.lit(int(p[i])) for p in parts]), F.col("c1") + 1) for i in (0, 1)]
    part = (of[0] + F.pmod(F.xxhash64("key"), of[1].cast("long"))).cast("int")
    copies = placed.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out_key, out_own, out_ids, out_scores = [], [], [], []
        if left.num_rows and right.num_rows:
            e, c1, c2, ids, own = _matrix(left["v"]), left["c1"].to_numpy(), left["c2"].to_numpy(), left["ids"].to_pylist(), left["key"].to_pylist()
            q, keys, least = _matrix(right["v"]), right["key"].to_pylist(), right["least"].to_numpy()
            for s in range(0, len(q), 64):
                some = q[s : s + 64]
                m, n = sums(some)
                score = np.where(m[:, c1] + n[:, c2] >= least[s : s + 64, None], some @ e.T, -np.inf)
                for i, row in enumerate(score):
                    best = np.flatnonzero(row >= np.partition(row, -(top + 1))[-(top + 1)]) if len(row) > top + 1 else np.arange(len(row))
                    found = sorted((-row[j], x, own[j]) for j in best if row[j] > -np.inf for x in ids[j])[: top + 1]
                    if found:
                        out_key.append(keys[s + i])
                        out_scores.append([-x for x, _, _ in found])
                        out_ids.append([x for _, x, _ in found])
                        out_own.append([x == keys[s + i] for _, _, x in found])
        kinds = {"key": pa.int64(), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64()), "own": pa.list_(pa.bool_())}
        return pa.table({n: pa.array(x, t) for (n, t), x in zip(kinds.items(), (out_key, out_ids, out_scores, out_own))})

    at = ["part", "block"]
    tops = copies.groupBy(*at).cogroup(probes.groupBy(*at)).applyInArrow(rank, "key long, ids array<long>, scores array<double>, own array<boolean>")
    near = F.arrays_zip("scores", "ids", "own")
    zipped = F.transform(near, lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("vec_id"), x["own"].alias("own")))
    best = tops.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list(zipped))), 1, top + 1).alias("best"))
    named = valid.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("h", "g").alias("key"))
    # A query's own row goes; of several with its id and vector the first.
    mine = F.array_position(F.transform("best", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.filter("best", lambda x, i: i + 1 != F.col("_mine"))
    ranked = named.join(best, "key").withColumn("_mine", mine).select("query_id", F.posexplode(F.slice(others, 1, top)).alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def recall(vectors: DataFrame, found: DataFrame, queries: int = 200, top: int = TOP, every: int = EVERY) -> float:
    """Share of the true neighbours that ``found`` has, over the ``queries`` smallest query ids, whose neighbours are computed
    against all rows by brute force."""
    valid = usable(vectors)
    asked = valid.where(F.col("vec_id") % every == 0).orderBy("vec_id").limit(queries).select("vec_id", "v").toArrow()
    ids, q = asked["vec_id"].to_numpy(), _matrix(asked["v"])

    def nearest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score, have = q @ _matrix(b.column("v")).T, b.column("vec_id").to_numpy()
                score[ids[:, None] == have] = -np.inf
                take = np.argsort(-score, axis=1, kind="stable")[:, :top]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, take.shape[1])), pa.array(have[take].ravel()), pa.array(np.take_along_axis(score, take, 1).ravel())], names=["query_id", "vec_id", "score"]
                )

    every_one = valid.select("vec_id", "v").mapInArrow(nearest_of, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = every_one.withColumn("_place", place).where((F.col("_place") <= top) & (F.col("score") > float("-inf"))).select("query_id", "vec_id")
    hit = true.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return float(hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0])
