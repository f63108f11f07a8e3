"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text's fingerprint for each window of ``span`` words is the smallest hash of the ``k``-word grams inside it.  Neighbouring
windows mostly share theirs: of each run of windows with equal fingerprints one is kept, with the run's bounds.
Equal windows have equal fingerprints, so joining what is kept of the texts with the fingerprints of the benchmark loses no shared
span of ``span`` or more words.  Each hit is extended over the windows of its run, whose words are compared with the
benchmark's; runs of hit windows make up the spans.  Benchmark items of fewer words than ``span`` are one window of
their own length, and its hash is their fingerprint.

The texts pass once for each ``BROADCAST_WINDOWS`` windows of the benchmark, which are counted first and broadcast in blocks.
What is kept of a text and hit is written, with a row for each document; texts with hits are then read again and compared.
Their hits are broadcast up to ``BROADCAST_ROWS`` documents, which are counted; beyond it texts are shuffled once.

Defined results: null or empty texts have no words, no hits, and aren't contaminated; repeated documents give a
row each; items with null or empty text have no windows, and items with a null id are left out; an empty benchmark
hits nothing; null document ids are kept; other columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SEPARATORS, UPPER, checkpointed, let

SPAN = 8
GRAM = 5
#: Windows and item ids of them that are broadcast at once.
BROADCAST_WINDOWS = 500_000
#: Documents with hits that are broadcast, and hits in them.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Runs of anything but ASCII non-alphanumerics, A-Z lower-cased: those become spaces, and spaces part the words."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS)))
    return F.when(spaced != "", F.split(spaced, " +")).otherwise(F.array().cast("array<string>"))


def row_of() -> Column:
    """Tells rows that share an id apart, by a hash of their texts."""
    return F.xxhash64("text")


def _paired(x: Column, shift: int, f) -> Column:
    """``f(x[i], x[i + shift])`` for all i that have both."""
    n = F.greatest(F.size(x) - shift, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + shift), n), f)


def _reach(x: Column, width: int, f, then) -> Column:
    """``then`` of the array of f over every ``width`` neighbours, by doubling."""

    def grow(have: int, y: Column, base: Column) -> Column:
        if have == width:
            return then(y)
        if 2 * have <= width:
            return let(_paired(y, have, f), lambda z: grow(2 * have, z, base))
        if f is _least:  # overlapping is allowed
            return let(_paired(y, width - have, f), then)
        n = F.greatest(F.size(base) - have, F.lit(0))
        return let(F.zip_with(F.slice(y, F.lit(1), n), F.slice(base, F.lit(1 + have), n), f), lambda z: grow(have + 1, z, base))

    return grow(1, x, x)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _mix(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def fingerprints(word_array: Column, span: int = SPAN, k: int = GRAM) -> Column:
    """By window start: the smallest k-gram hash in each window of ``span`` words."""
    hashes = F.transform(word_array, lambda w: F.xxhash64(w))
    found = let(hashes, lambda h: _reach(h, k, _mix, lambda g: _reach(g, span - k + 1, _least, lambda m: m)))
    return F.when(F.size(word_array) >= span, found).otherwise(F.array().cast("array<bigint>"))


def winnow(word_array: Column, span: int = SPAN, k: int = GRAM) -> Column:
    """``array<struct<fp, begin, end>>``: runs of windows, by start, that have the same fingerprint; ``end`` is the last's."""

    def runs(m: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(m) - 1)
        begins = F.when(F.size(m) > 0, F.filter(places, lambda i: (i == 0) | (F.get(m, i) != F.get(m, F.greatest(i - 1, F.lit(0))))))

        def bounds(b: Column) -> Column:
            nexts = F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(m)))
            return F.zip_with(b, nexts, lambda x, y: F.struct(F.get(m, x).alias("fp"), x.alias("begin"), (y - 1).alias("end")))

        return let(F.coalesce(begins, F.array().cast("array<int>")), lambda b: F.when(F.size(b) > 0, bounds(b)))

    none = F.array().cast("array<struct<fp:bigint,begin:int,end:int>>")
    return let(fingerprints(word_array, span, k), lambda m: F.coalesce(runs(m), none))


def windows(bench: DataFrame, span: int, k: int) -> DataFrame:
    """``(fp, len, window, items, whole)`` of the benchmark's windows, each different window once; ``whole`` is the least
    number of words of an item with the window."""
    items = bench.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    items = items.select("item_id", "w", F.least(F.size("w"), F.lit(span)).alias("len")).where("len > 0")
    at = items.select("item_id", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    cut = at.select("item_id", "len", F.size("w").alias("whole"), F.slice("w", F.col("at"), F.col("len")).alias("w"))
    fp = F.when(F.col("len") == span, fingerprints(F.col("w"), span, k)[0]).otherwise(F.xxhash64("w"))
    cut = cut.select("item_id", "len", "whole", F.array_join("w", " ").alias("window"), fp.alias("fp"))
    return cut.groupBy("fp", "len", "window").agg(F.collect_set("item_id").alias("items"), F.min("whole").alias("whole"))


def hits(docs: DataFrame, bench: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """``(doc_id, row, n_words, spans, items, whole)``: ``row`` is :func:`row_of` the text; ``spans`` are the hit windows as sorted ``(begin, end)`` word places, ``end``
    excluded; ``items`` the ids of benchmark items that have any; ``whole`` is the least number of words of an item of ``span``
    or more words that has any, null if none has."""
    bench_windows = checkpointed(windows(bench, span, k))
    short = sorted(r[0] for r in bench_windows.where(F.col("len") < span).select("len").distinct().collect())  # under span of them
    size = bench_windows.agg(F.coalesce(F.sum(F.size("items") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BROADCAST_WINDOWS))
    split = docs.select("doc_id", row_of().alias("row"), words(F.col("text")).alias("w"))
    w = F.col("w")

    def whole_items(m: int) -> Column:
        places = F.when(F.size(w) >= m, F.sequence(F.lit(0), F.size(w) - m)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(m).alias("len"), F.xxhash64(F.slice(w, i + 1, F.lit(m))).alias("fp"), i.alias("begin"), i.alias("end")))

    def passed(block: int) -> DataFrame:
        fps = bench_windows.where(F.pmod(F.xxhash64("fp"), F.lit(blocks)) == block).select("len", "fp").distinct()
        kept = [F.transform(winnow(w, span, k), lambda r: F.struct(F.lit(span).alias("len"), r["fp"].alias("fp"), r["begin"].alias("begin"), r["end"].alias("end"))), *map(whole_items, short)]
        if block == 0:  # length 0 carries the document itself
            kept.append(F.array(F.struct(F.lit(0).alias("len"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("begin"), F.lit(0).alias("end"))))
            fps = fps.union(docs.sparkSession.range(1).select(F.lit(0), F.lit(0).cast("long")))
        each = split.select("doc_id", "row", F.size(w).alias("n_words"), F.explode(F.concat(*kept)).alias("r")).select("doc_id", "row", "n_words", "r.*")
        return each.join(F.broadcast(fps), ["len", "fp"], "left_semi")

    # A document's hits together, as far as a task has them; so a text that is repeated without end stays one row.
    found = reduce(DataFrame.unionByName, map(passed, range(blocks)))
    run = F.struct("len", "begin", "end")
    found = checkpointed(
        found.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("len") == 0).alias("copies"), F.collect_set(F.when(F.col("len") > 0, run)).alias("runs"))
    )
    with_runs = found.where(F.size("runs") > 0).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "runs")
    rows, runs = with_runs.agg(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    few = max(rows, runs // 16) <= BROADCAST_ROWS
    texts = docs.select("doc_id", row_of().alias("row"), "text")
    texts = texts.join(F.broadcast(with_runs) if few else with_runs, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    texts = texts.select("doc_id", "row", "runs", words(F.col("text")).alias("w"))

    def extended(r: Column) -> Column:
        """All windows of a run."""
        return F.transform(F.sequence(r["begin"], r["end"]), lambda i: F.struct(r["len"].alias("len"), i.alias("begin"), F.array_join(F.slice(w, i + 1, r["len"]), " ").alias("window")))

    spread = texts.select("doc_id", "row", F.explode(F.flatten(F.transform("runs", extended))).alias("x")).select("doc_id", "row", "x.*")
    own = bench_windows.select("len", "window", "items", "whole")
    hit = spread.join(F.broadcast(own) if blocks == 1 else own, ["len", "window"])
    place = F.struct("begin", (F.col("begin") + F.col("len")).alias("end"))
    hit = hit.groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_set(place)).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.min(F.when(F.col("len") == span, F.col("whole"))).alias("whole"),
    )
    none = found.select("doc_id", "row", "n_words", "copies", F.lit(None).cast(hit.schema["spans"].dataType).alias("spans"), F.lit(None).cast(hit.schema["items"].dataType).alias("items"), F.lit(None).cast("int").alias("whole"))
    both = none.unionByName(hit.select("doc_id", "row", F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("long").alias("copies"), "spans", "items", "whole"))
    grouped = both.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
        *[F.coalesce(F.first(c, ignorenulls=True), F.array().cast(hit.schema[c].dataType)).alias(c) for c in ("spans", "items")],
        F.max("whole").alias("whole"),
    )
    each = grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "row", "n_words", "spans", "items", "whole")


def covered(spans: Column) -> Column:
    """Number of places in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], acc["end"]))).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"])


def longest(spans: Column) -> Column:
    """Words of the longest unbroken run in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit(0).alias("most"))

    def add(acc: Column, s: Column) -> Column:
        begin, end = F.when(s["begin"] <= acc["end"], acc["begin"]).otherwise(s["begin"]), F.greatest(acc["end"], s["end"])
        return F.struct(begin.alias("begin"), end.alias("end"), F.greatest(acc["most"], end - begin).alias("most"))

    return F.aggregate(spans, start, add, lambda acc: acc["most"])


def report(found: DataFrame, least_items: int = 2) -> DataFrame:
    """The contract's columns of what :func:`hits` returns."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("spans")).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
        longest(F.col("spans")).cast("long").alias("longest_span"),
    )
