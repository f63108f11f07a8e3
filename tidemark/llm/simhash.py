"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: 64 bits from the XXH64 of all 4-word shingles.  Links: ``radius`` or fewer differing bits.
Components: the smallest id that links reach.

Equal fingerprints are one node, so exact copies never multiply.  Nodes are routed by the pigeonhole rule: of
``blocks`` bit blocks, two fingerprints that differ in ``radius`` bits agree in at least ``blocks - radius``; so
every choice of that many blocks is a table, keyed by the bits in them.  ``blocks`` follows from the number of nodes
so that a bucket of unrelated fingerprints stays small.  A bucket is searched with an index: its codes in Gray
order, runs of ``FAN`` codes share a node that keeps the bits on which all below agree, and pairs of nodes whose
shared bits already differ too often are pruned whole, from the top down.  A bucket gives a spanning forest of its
links, never its pairs.  Buckets of more than ``HOT`` nodes are cut into parts, and each pair of parts is a task's work.

Components come from alternating star contractions, cut by checkpoints; nothing is collected.

Defined results: null and empty texts have no shingles and the fingerprint 0, which links like any other; texts of
fewer than four words are one shingle; repeated rows are kept, each with its class; a null id counts after all others
as a representative; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import checkpointed, text_slices

SHINGLE = 4
RADIUS = 4
SEED = 42
FAN = 16
#: Nodes of a bucket that one task searches; larger buckets are cut into parts of this size.
HOT = 20_000
_PAIRS = 1 << 18


# --- fingerprints -----------------------------------------------------------------------------------------------


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, most significant first."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes as a signed 64-bit number: the bits set in over half of them."""
    return int(np.packbits(_counts(hashes) * 2 > len(hashes)).view(">u8")[0].astype(np.int64)) if len(hashes) else 0


def fingerprint(text: str | None) -> int:
    """The text's fingerprint as a signed 64-bit number."""
    words = text.encode().lower().split() if text else []  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    if len(words) <= SHINGLE:
        h = xxh64_intdigest(b" ".join(words), SEED)
        return h - (1 << 64) if h >> 63 else h
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[: len(words) - SHINGLE] + 1)).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1 :].tolist())], np.uint64)
    return of_hashes(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)``, a row for each row; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t) for t in texts], pa.int64())], names=[id_col, "fp"])

    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


# --- the index --------------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over the codes of buckets, in Gray order within each.  Level 0 are the codes; a node above has, for its run
    of ``FAN``, the bits that all codes below share (``mask``), their values (``bits``) and the buckets it spans."""

    def __init__(self, codes: np.ndarray, buckets: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), buckets))
        everything, of = np.full(len(codes), ~np.uint64(0), np.uint64), buckets[self.order]
        self.levels = [(everything, codes[self.order], of, of)]
        while len(self.levels[-1][0]) > 1:
            mask, bits, first, last = self.levels[-1]
            at = np.arange(0, len(mask), FAN)
            every, some = np.bitwise_and.reduceat(bits & mask, at), np.bitwise_or.reduceat(bits & mask, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            self.levels.append((shared, every & shared, first[at], last[np.minimum(at + FAN, len(mask)) - 1]))

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of places in one bucket whose codes differ in at most ``radius`` bits."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = np.arange(FAN)
        per = max(1, _PAIRS // (FAN * FAN))
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                keep = a < b
                if keep.any():
                    yield self.order[a[keep]], self.order[b[keep]]
                continue
            if len(a) > per:
                stack.extend((level, a[k : k + per], b[k : k + per]) for k in range(0, len(a), per))
                continue
            mask, bits, first, last = self.levels[level - 1]
            x = (a[:, None, None] * FAN + step[None, :, None] + 0 * step[None, None, :]).ravel()
            y = (b[:, None, None] * FAN + step[None, None, :] + 0 * step[None, :, None]).ravel()
            keep = (x <= y) & (y < len(mask))
            x, y = x[keep], y[keep]
            # No bucket in common, or too many differences on bits that both nodes share: prune the groups whole.
            near = first[y] <= last[x]
            x, y = x[near], y[near]
            near = np.bitwise_count((bits[x] ^ bits[y]) & mask[x] & mask[y]) <= radius
            if near.any():
                stack.append((level - 1, x[near], y[near]))


class Forest:
    """Union-find over a bucket's places, joined by blocks of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            self.root = root


def bucket_links(keys: np.ndarray, codes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (member, root) of the rows of each key; rows of a key stand together."""
    n = len(keys)
    forest = Forest(n)
    if n:
        for a, b in GrayIndex(codes, keys).pairs(radius):
            forest.join(a, b)
    linked = np.flatnonzero(forest.root != np.arange(n))
    return linked, forest.root[linked]


# --- routing ----------------------------------------------------------------------------------------------------


def block_count(nodes: int, radius: int) -> int:
    """Bit blocks so that buckets of unrelated fingerprints hold at most some 256 nodes: a row more to shuffle costs as much
    as some hundred comparisons.  5 blocks up to 2**20 nodes, 6 up to 2**29, 7 up to 2**35, then 8."""
    blocks = radius + 1
    while blocks < 2 * radius and (64 * (blocks - radius)) // blocks < np.log2(max(nodes, 1)) - 8:
        blocks += 1
    return blocks


def tables(blocks: int, radius: int) -> list[int]:
    """Bit masks of the tables: every choice of ``blocks - radius`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``(a, b)``: links between the different fingerprints of ``nodes(fp)`` that connect whatever is in reach."""
    spark = nodes.sparkSession
    masks = tables(block_count(nodes.count(), radius), radius)
    routes = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    routed = nodes.select("fp", F.explode(routes).alias("r")).select("r.t", "r.key", "fp")
    crowded = routed.groupBy("t", "key").count().where(F.col("count") > hot)
    crowded = checkpointed(crowded.select("t", "key", F.ceil(F.col("count") / hot).cast("int").alias("parts")))
    if crowded.isEmpty():
        dealt = routed.withColumn("pair", F.lit(0).cast("long"))
    else:  # each pair of parts of a crowded bucket is a bucket of its own
        joined = routed.join(crowded, ["t", "key"], "left")
        part = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long"))
        other = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda s: F.least(part, s.cast("long")) * (1 << 20) + F.greatest(part, s.cast("long")))
        )
        dealt = joined.select("t", "key", "fp", F.explode(other).alias("pair"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "t", "key", "pair").sortWithinPartitions("t", "key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t, key, pair, fp) -> pa.RecordBatch:
            bucket = np.cumsum(np.concatenate(([0], (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
            a, b = bucket_links(bucket, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

        kept: list[tuple] = []  # the bucket that may go on in the next batch
        for batch in batches:
            cols = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if not len(cols[0]):
                continue
            kept.append(cols)
            last = tuple(c[-1] for c in cols[:3])
            if all((c[0] == x) for c, x in zip(kept[0][:3], last)):
                continue
            cols = tuple(np.concatenate(x) for x in zip(*kept))
            cut = len(cols[0]) - int(np.argmax(((cols[0] != last[0]) | (cols[1] != last[1]) | (cols[2] != last[2]))[::-1]))
            yield solve(*(c[:cut] for c in cols))
            kept = [tuple(c[cut:] for c in cols)]
        if kept:
            yield solve(*(np.concatenate(x) for x in zip(*kept)))

    return dealt.select("t", "key", "pair", "fp").mapInArrow(run, "a long, b long")


# --- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``, by alternating large and small stars."""
    e = F.col
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = checkpointed(edges), None
    while True:
        both = edges.union(edges.select(e("v").alias("u"), e("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(e("v") > e("u")).select(e("v").alias("u"), e("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(e("v").alias("u"), e("m").alias("v")), F.struct(e("u").alias("u"), e("m").alias("v")))).alias("x"))
        edges = checkpointed(small.select("x.u", "x.v").where("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen:
            roots = edges.select(e("v").alias("node")).distinct()
            return edges.select(e("u").alias("node"), e("v").alias("root")).unionByName(roots.withColumn("root", e("node")))
        seen = now


def classes(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp, component_id)`` for every row of ``docs``."""
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    found = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    # One row a component, written: the join with its members then has two plain sides, and a large one can be split.
    smallest = checkpointed(found.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("component_id")))
    linked = found.join(smallest, "root").select("fp", "component_id")
    alone = nodes.join(found.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return prints.join(linked.unionByName(alone), "fp").select(id_col, "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
