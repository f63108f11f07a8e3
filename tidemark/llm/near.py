"""SimHash near-duplicates at a given Jaccard similarity of five-word shingles: the pipeline's form of operator 2.

Links: texts whose sets of shingles have a Jaccard similarity of 4/5 or more.  Classes: what links reach.  A link is
always decided by the whole sets; the indexes only say which texts to compare.

Texts with the same words in the same order are one node, so exact copies never multiply.  Nodes are tied in two ways:

* by the Gray-order index of :mod:`simhash`, over the fingerprints of the same five-word shingles, at its radius;
* by ``BANDS`` keys of ``ROWS`` min-hashes each, a node to the smallest with the same key.  At a similarity of 0.8 fingerprints
  of 64 bits differ in about ten, and a radius that finds such pairs would need buckets that grow with the square of the table;
  so the index alone can't give right results there.  A pair of similarity s has no common key with probability
  (1 - s**ROWS)**BANDS: 3 in a million at 0.8, less above.

What ties reach is a cluster.  A cluster's texts are then compared exactly, all with all, but texts that already have their
class leave the comparison.  Clusters of more than ``PART`` shingles are cut into parts, and each pair of parts is a task's work.

Defined results: words are what ASCII white space parts, with A-Z lower-cased; texts of fewer than five words are one
shingle; null texts and texts without words are one class; repeated rows are kept, each with its class; a null id counts
after all others as a representative; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from . import simhash
from .common import alone, checkpointed, free_name, text_slices
from .simhash import components

SHINGLE = 5
#: The least similarity of a link, as a fraction.
LEAST, OF = 4, 5
BANDS, ROWS = 32, 5
SEED = 42
#: Shingles of a cluster that one task compares; larger clusters are cut into parts of about this size.
PART = 1 << 18
#: Most nodes of clusters that are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 200_000
_CHUNK = 1 << 12
_WORDS = 1 << 13

_made = np.random.default_rng(SEED)
_XOR = _made.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _made.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_PLACE = _made.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    """Hash of each word, kept for the words of a task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxh64_intdigest(word, SEED)
        return h


def split(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def node_of(words: list[bytes]) -> int:
    """The node of a text, a signed 64-bit number."""
    h = xxh64_intdigest(b" ".join(words), SEED)
    return h - (1 << 64) if h >> 63 else h


def shingles(words: list[bytes], known: dict | None = None) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((_Hashes() if known is None else known).__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        total += h[k : k + n] * _PLACE[k]
    return np.unique(_mix(total))


def bands(hashes: np.ndarray) -> list[int]:
    """The ``BANDS`` keys of a set, each of ``ROWS`` min-hashes; none of an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        least = np.minimum(least, [((part ^ x) * t).min() for x, t in zip(_XOR, _TIMES)])
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64).tolist()


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, row, node, fp, size, bands)``, a row for each row; a map without a shuffle.  ``row`` is a hash of the text as
    it stands, ``node`` one of its words, ``fp`` its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("near")
        known = _Hashes()
        for part, texts in text_slices(batches, text_col):
            nodes, fps, sizes, keys = [], [], [], []
            for text in texts:
                words = split(text)
                found = shingles(words, known)
                nodes.append(node_of(words))
                fps.append(simhash.of_hashes(found))
                sizes.append(len(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(x, pa.int64()) for x in (nodes, fps, sizes)), pa.array(keys, pa.list_(pa.int64()))],
                names=[id_col, "row", "node", "fp", "size", "bands"],
            )

    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("row long, node long, fp long, size long, bands array<long>").fields])
    return docs.select(id_col, row_of(text_col).alias("row"), text_col).mapInArrow(run, schema)


def row_of(text_col: str = "text") -> Column:
    return F.xxhash64(text_col)


class _Index:
    """Sets by shingle: which of the sets ``which`` hold a hash."""

    def __init__(self, sets: list[np.ndarray], which: np.ndarray):
        held = np.concatenate([sets[i] for i in which]) if len(which) else np.zeros(0, np.uint64)
        owner = np.repeat(which, [len(sets[i]) for i in which])
        by = np.argsort(held, kind="stable")
        self.owner, held = owner[by], held[by]
        self.keys, self.start, self.count = np.unique(held, return_index=True, return_counts=True)
        self.live = len(which)

    def shared(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """How many of the hashes each of the ``n`` sets has, as far as it stands in the index."""
        if not len(self.keys):
            return np.zeros(n, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        at = at[self.keys[at] == hashes]
        count = self.count[at]
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.bincount(self.owner[np.repeat(self.start[at], count) + within], minlength=n)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first set that links reach from it."""
    n = len(sets)
    sizes, root = np.array([len(s) for s in sets], np.int64), np.full(n, -1)
    index = _Index(sets, np.arange(n))
    left = n
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], left, queue = first, left - 1, [first]
        while queue and left:
            if 2 * left <= index.live:
                index = _Index(sets, np.flatnonzero(root < 0))
            i = queue.pop()
            shared = index.shared(sets[i], n)
            near = np.flatnonzero((shared > 0) & (root < 0) & (shared * (LEAST + OF) >= LEAST * (sizes + sizes[i])))
            root[near], left = first, left - len(near)
            queue.extend(near.tolist())
    return root


def compare(clusters: DataFrame) -> DataFrame:
    """``(a, b)``: spanning links of the nodes in each ``(cluster, pair)`` of ``clusters(cluster, pair, node, text)``."""
    n = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = clusters.repartition(n, "cluster", "pair").sortWithinPartitions("cluster", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            root = linked(list(held.values()))
            nodes = np.fromiter(held, np.int64, len(held))
            joined = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[joined]), pa.array(nodes[root[joined]])], names=["a", "b"])

        held: dict[int, np.ndarray] = {}  # the sets of the bucket at hand
        now, known = None, _Hashes()
        for part, texts in text_slices(batches, "text"):
            for cluster, pair, node, text in zip(*(part.column(k).to_pylist() for k in range(3)), texts):
                if (cluster, pair) != now:
                    if len(held) > 1:
                        yield solve()
                    held, now = {}, (cluster, pair)
                if node not in held:
                    held[node] = shingles(split(text), known)
        if len(held) > 1:
            yield solve()

    return dealt.select("cluster", "pair", "node", "text").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, part: int = PART, text_col: str = "text") -> DataFrame:
    """``(a, b)``: links between the different nodes ``nodes(node, fp, size, bands)`` of ``docs`` that connect whatever is in
    reach."""
    routed = nodes.select("node", F.explode("bands").alias("key"))
    shared = routed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    ties = routed.join(checkpointed(shared), "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    by_fp = checkpointed(nodes.where("size > 0").groupBy("fp").agg(F.min("node").alias("to")))
    near = simhash.links(by_fp.select("fp"))
    a, b = (by_fp.select(F.col("fp").alias(c), F.col("to").alias(f"_{c}")) for c in "ab")
    ties = ties.unionByName(near.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    same = nodes.where("size > 0").select("fp", "node").join(by_fp, "fp").where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b"))
    found = components(ties.unionByName(same)).join(nodes.select("node", "size"), "node").select("node", F.col("root").alias("cluster"), "size")
    found = checkpointed(found)
    large = found.groupBy("cluster").agg(F.sum("size").alias("size")).where(F.col("size") > part)
    large = checkpointed(large.select("cluster", F.ceil(F.col("size") / part).cast("long").alias("parts")))
    if large.isEmpty():
        dealt = found.select("node", "cluster", F.array(F.lit(0).cast("long")).alias("pairs"))
    else:  # each pair of parts of a large cluster is compared on its own
        mine = F.pmod(F.xxhash64("node"), F.col("parts"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda s: F.least(mine, s) * (1 << 31) + F.greatest(mine, s))
        dealt = found.join(F.broadcast(large), "cluster", "left")
        dealt = dealt.select("node", "cluster", F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs).alias("pairs"))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array([node_of(split(t)) for t in texts], pa.int64()), piece.column(0)], names=["node", "text"])

    texts = docs.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(named, "node long, text string")
    few = found.count() <= BROADCAST_NODES
    texts = texts.join(F.broadcast(dealt) if few else dealt, "node")
    # Of exact copies one is compared.
    one = texts.groupBy("node").agg(F.first("text").alias("text"), F.first("cluster").alias("cluster"), F.first("pairs").alias("pairs"))
    return compare(one.select("cluster", F.explode("pairs").alias("pair"), "node", "text"))


def _clustered(docs: DataFrame, part: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(id_col, row, node)`` of every row, and ``(node, least)``: the first row of each node's class."""
    rows = checkpointed(prints(docs, id_col, text_col))
    first = F.min(F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col("row").alias("row")))
    nodes = checkpointed(rows.groupBy("node").agg(first.alias("least"), *[F.first(c).alias(c) for c in ("fp", "size", "bands")]))
    found = components(links(docs, nodes, part, text_col))
    smallest = checkpointed(found.join(nodes, "node").groupBy("root").agg(F.min("least").alias("least")))
    joined = found.join(smallest, "root").select("node", "least")
    alone = nodes.join(found.select("node"), "node", "left_anti").select("node", "least")
    return rows.select(id_col, "row", "node"), joined.unionByName(alone)


def classes(docs: DataFrame, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, node, component_id)`` for every row of ``docs``."""
    rows, firsts = _clustered(docs, part, id_col, text_col)
    return rows.join(firsts.select("node", F.col("least.id").alias("component_id")), "node").select(id_col, "node", "component_id")


def one_of_each(docs: DataFrame, part: int = PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, null after all others, then the smallest hash of
    its text.  Of rows that are alike in both, the first by their other columns stays."""
    _, firsts = _clustered(docs, part, id_col, text_col)
    firsts = firsts.select(F.col("least.id").alias("_id"), F.col("least.row").alias("_row")).distinct()
    kept = docs.join(firsts, docs[id_col].eqNullSafe(F.col("_id")) & (row_of(text_col) == F.col("_row")), "left_semi").select(*docs.columns)
    others = F.to_json(F.struct(*[F.col(c) for c in sorted(docs.columns) if c not in (id_col, text_col)], F.lit(0).alias("_")))
    place = F.row_number().over(Window.partitionBy(id_col, row_of(text_col)).orderBy(others))
    name = free_name(docs, "place")
    return kept.withColumn(name, place).where(F.col(name) == 1).drop(name)
