"""Resolution, scans, lookups, metadata: fixed cases and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookup, mutate, resolve, scan
from tidemark.plans import compact, generations, manifest
from tidemark.plans.manifest import Edit, FileMeta, Version
from tidemark.schema import successor

LOG = "key string, seq long, type byte, value string"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def pairs(df):
    return sorted((r["key"], r["value"]) for r in df.collect())


def test_as_of(spark):
    rows = log(spark, ("key1", 10, 1, "val1_seq10"), ("key1", 20, 1, "val1_seq20"), ("key1", 30, 0, ""))
    want = {5: [], 10: [("key1", "val1_seq10")], 15: [("key1", "val1_seq10")], 25: [("key1", "val1_seq20")], 35: []}
    assert {s: pairs(resolve.live(rows, s)) for s in want} == want


def test_tombstone_filter_stands_above_ranking(spark):
    rows = log(spark, ("a", 1, 1, "x"), ("a", 2, 0, ""), ("b", 1, 1, ""))
    assert pairs(resolve.live(rows)) == [("b", "")]  # an empty value is live
    assert resolve.latest(rows, keep_tombstones=True).count() == 2


def test_resolution_ignores_split_order_and_replay(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(20)}", s, int(rng.random() < 0.8), f"v{s}") for s in range(300)]
    want = {}
    for k, _, t, v in rows:
        want[k] = (t, v)
    want = sorted((k, v) for k, (t, v) in want.items() if t)
    rng.shuffle(rows)
    whole = log(spark, *rows)
    assert pairs(resolve.live(whole)) == want
    assert pairs(resolve.live(resolve.tiers(log(spark, *rows[:70]), log(spark, *rows[50:]), whole))) == want


def test_resolution_prunes_before_the_shuffle(spark):
    plan = resolve.latest(log(spark, ("a", 1, 1, "x")))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_empty_log(spark):
    empty = spark.createDataFrame([], LOG)
    assert pairs(resolve.live(empty)) == []
    assert scan.totals(resolve.live(empty)).first().asDict() == {"entries": 0, "key_bytes": 0, "value_bytes": 0}
    assert scan.neighbours(resolve.live(empty)).count() == 0
    assert generations.file_meta(empty).count() == 0


def test_ordered_reads(spark):
    rows = spark.createDataFrame([(k, k) for k in ("apple", "banana", "cherry", "date")], "key string, value string")
    key = lambda df: [r["key"] for r in df.collect()]
    assert key(scan.seek(rows, "b")) == ["banana"]
    assert key(scan.seek(rows, "cat")) == ["cherry"]
    assert key(scan.seek(rows, "date")) == ["date"]
    assert key(scan.seek(rows, "zebra")) == []
    assert key(scan.first(rows)) == ["apple"] and key(scan.last(rows)) == ["date"]
    assert key(scan.after(rows, "apple")) == ["banana"] and key(scan.before(rows, "apple")) == []
    assert key(scan.bounded(rows, "b", 2)) == ["banana", "cherry"]
    assert key(scan.in_order(rows)) == ["apple", "banana", "cherry", "date"]
    got = sorted(tuple(r) for r in scan.neighbours(rows).collect())
    assert got == [("apple", None, "banana"), ("banana", "apple", "cherry"), ("cherry", "banana", "date"), ("date", "cherry", None)]


def test_integer_order(spark):
    rows = spark.createDataFrame([(k, "") for k in (10, 5, 20, 15)], "key long, value string")
    assert [r["key"] for r in scan.in_order(rows).collect()] == [5, 10, 15, 20]
    assert scan.seek(rows, 12).first()["key"] == 15 and scan.seek(rows, 25).first() is None


def test_binary_prefix_and_order(spark):
    keys = [b"", b"\x00", b"a", b"a\xff", b"a\xff\xff", b"b", b"\xff", b"\xff\xff"]
    rows = spark.createDataFrame([(bytearray(k), "") for k in keys], "key binary, value string")
    got = lambda p: [bytes(r["key"]) for r in scan.in_order(scan.prefixed(rows, p)).collect()]
    assert got(b"a") == [b"a", b"a\xff", b"a\xff\xff"]
    assert got(b"a\xff") == [b"a\xff", b"a\xff\xff"]
    assert got(b"\xff") == [b"\xff", b"\xff\xff"]
    assert got(b"") == sorted(keys)


def test_successor():
    assert successor(b"ab") == b"ac" and successor(b"a\xff") == b"b"
    assert successor(b"\xff\xff") is None and successor(b"") is None
    assert successor("ab") == "ac" and successor("a\U0010ffff") == "b" and successor("퟿") == ""


def test_lookups(spark):
    rows = log(spark, ("a", 1, 1, "x"), ("a", 2, 1, "y"), ("b", 3, 1, "z"), ("b", 4, 0, ""))
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "key string")
    assert pairs(lookup.get(rows, "a")) == [("a", "y")] and pairs(lookup.get(rows, "b")) == []
    for n in (None, lookup.BROADCAST_KEYS + 1):
        assert sorted(((r["key"], r["value"]) for r in lookup.multi_get(rows, keys, n=n).collect()), key=str) == [("a", "y"), ("b", None), ("c", None)]
        assert [r["key"] for r in lookup.contains(rows, keys, n=n).collect()] == ["a"]
        assert sorted(r["key"] for r in lookup.absent(rows, keys, n=n).collect()) == ["b", "c"]


def test_sequence_numbers_follow_the_order(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("o"))
    got = mutate.numbered(rows, 7, "o", "key").collect()
    by = sorted(got, key=lambda r: r["seq"])
    assert [r["seq"] for r in by] == list(range(8, 1008))
    assert [(r["o"], r["key"]) for r in by] == sorted((r["o"], r["key"]) for r in got)
    assert mutate.numbered(rows.limit(0), 7, "o").count() == 0


def test_duplicate_versions(spark):
    rows = log(spark, ("a", 1, 1, "x"), ("a", 1, 1, "x"), ("b", 1, 1, "x"), ("b", 1, 1, "y"))
    assert [r["key"] for r in resolve.duplicate_versions(rows).collect()] == ["b"]


def test_as_of_each(spark):
    rows = log(spark, ("a", 1, 1, "x"), ("a", 5, 0, ""), ("a", 9, 1, "z"))
    reads = spark.createDataFrame([("a", 0), ("a", 3), ("a", 6), ("a", 9), ("q", 9)], "key string, as_of long")
    assert sorted(tuple(r) for r in resolve.as_of_each(rows, reads).collect()) == [("a", 3, "x"), ("a", 9, "z")]


# --- metadata -----------------------------------------------------------------------------------------------------


def meta(level, number, low, high, size=1):
    return FileMeta(level, number, size, low.encode(), high.encode())


def test_edit_round_trip():
    edit = Edit("byte_comparator", 100, 200, 1000, None, [(0, 5), (1, 10)], [meta(0, 15, "a", "m", 4096), meta(1, 16, "n", "z", 8192)])
    assert Edit.parse(edit.line().rstrip("\n")) == edit


def test_manifest_apply_and_replay():
    one = Edit(added=[meta(0, 3, "apple", "banana"), meta(0, 4, "carrot", "date"), meta(1, 5, "egg", "fig")], last_sequence=500)
    two = Edit(deleted=[(0, 3)], added=[meta(1, 6, "grape", "kiwi")], last_sequence=600)
    version = Version().apply(one).apply(two)
    for v in (version, manifest.replay(one.line() + two.line()), manifest.replay(version.snapshot().line())):
        assert [f.number for f in v.at(0)] == [4] and [f.number for f in v.at(1)] == [5, 6]
        assert v.last_sequence == 600 and v.next_file == 7
    assert manifest.replay(one.line() + two.line()[:30]).last_sequence == 500  # torn


def test_manifest_damage_raises():
    from tidemark.errors import Corruption

    one, two = Edit(last_sequence=1).line(), Edit(last_sequence=2).line()
    with pytest.raises(Corruption):
        manifest.replay(one.replace("1", "7", 1) + two + two)
    with pytest.raises(Corruption):
        manifest.replay(Edit("other_comparator").line() + one + one)


def test_sequence_never_goes_back():
    assert Version().apply(Edit(last_sequence=9)).apply(Edit(last_sequence=3)).last_sequence == 9


def test_pick_by_number_of_files():
    v = Version().apply(Edit(added=[meta(0, n, "c", "f") for n in (2, 3, 4, 5)] + [meta(1, 6, "a", "b"), meta(1, 7, "d", "e"), meta(1, 8, "f", "g")]))
    plan = compact.pick(v)
    assert plan.level == 0 and {f.number for f in plan.inputs} == {2, 3, 4, 5} and {f.number for f in plan.lower} == {7, 8}
    assert compact.pick(v, 5) is None


@pytest.mark.parametrize("level", [1, 2, 3, 4, 5])
def test_pick_by_size(level):
    limit = 4 ** (level - 1) << 20
    files = [meta(level, 2, "a", "c", limit), meta(level, 3, "d", "f", 0), meta(level + 1, 4, "b", "b"), meta(level + 1, 5, "d", "d")]
    assert compact.pick(Version().apply(Edit(added=files))) is None
    files[1] = meta(level, 3, "d", "f", 1)
    plan = compact.pick(Version().apply(Edit(added=files)))
    assert plan.level == level and [f.number for f in plan.files] == [2, 4]


def test_last_level_is_never_picked():
    assert compact.pick(Version().apply(Edit(added=[meta(6, 2, "a", "z", 1 << 40)]))) is None


def test_merge_keeps_a_deletion_while_deeper_files_cover_its_key(spark):
    rows = log(spark, ("a", 2, 0, ""), ("a", 1, 1, "x"), ("m", 3, 0, ""), ("p", 1, 1, "v"), ("p", 4, 1, "w"))
    deeper = spark.createDataFrame([("l", "n"), ("m", "o")], "smallest_key string, largest_key string")
    got = sorted((r["key"], r["type"], r["value"]) for r in compact.merged(rows, deeper).collect())
    assert got == [("m", 0, ""), ("p", 1, "w")]
    assert sorted(r["key"] for r in compact.merged(rows, [("l", "n"), ("m", "o")]).collect()) == ["m", "p"]
    assert sorted(r["key"] for r in compact.merged(rows, []).collect()) == ["p"]


def test_split_gives_disjoint_ranges(spark):
    rows = spark.range(1000).select(F.format_string("k%05d", F.pmod("id", F.lit(300))).alias("key"), F.col("id").alias("seq"), F.lit(1).cast("byte").alias("type"), F.lit("v").alias("value"))
    parts = compact.split(rows, 10, 3).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.min("key").alias("a"), F.max("key").alias("b")).orderBy("a").collect()
    assert len(parts) > 1 and all(x["b"] < y["a"] for x, y in zip(parts, parts[1:]))


def test_generations_are_cut_by_bytes(spark):
    rows = [(f"k{s}", s, 1, "x" * (s % 7)) for s in range(500)]
    total, want = 0, {}
    for k, s, _, v in rows:
        want[s] = total // 1000
        total += len(k) + len(v) + 97
    got = {r["seq"]: r["generation"] for r in generations.generations(log(spark, *rows), 1000, stretch=8).collect()}
    assert got == want


def test_files_that_stand_alone():
    files = [meta(1, 1, "a", "c"), meta(1, 2, "d", "f"), meta(2, 3, "e", "g"), meta(1, 4, "h", "i"), meta(0, 5, "k", "l"), meta(2, 6, "m", "m"), meta(3, 7, "m", "n")]
    alone, rest = manifest.apart(files)
    assert [f.number for f in alone] == [1, 4] and sorted(f.number for f in rest) == [2, 3, 5, 6, 7]
    assert manifest.apart([]) == ([], [])


def test_prune_and_overlap(spark):
    files = spark.createDataFrame([(0, 1, "a", "f"), (0, 2, "g", "k"), (1, 3, "f", "g")], "level long, number long, smallest_key string, largest_key string")
    number = lambda df: sorted(r["number"] for r in df.collect())
    assert number(manifest.prune_point(files, "f")) == [1, 3]
    assert number(manifest.prune_range(files, "k", "z")) == [2]
    assert sorted(map(tuple, manifest.overlaps(files.where("level = 0"), files.where("level = 1")).collect())) == [(1, 3), (2, 3)]


def test_deletions_find_their_ranges_without_a_join(spark):
    from tidemark.plans import compact

    rows = spark.range(2_000).select(F.format_string("k%05d", "id").cast("binary").alias("key"), F.col("id").alias("seq"), (F.col("id") % 2).cast("tinyint").alias("type"), F.lit(b"v").alias("value"))
    ranges = [(f"k{i:05d}".encode(), f"k{i + 4:05d}".encode()) for i in range(0, 2_000, 20)]
    out = compact.merged(rows, ranges)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(ranges) > compact.FEW_RANGES and "Join" not in plan
    assert sorted(bytes(r.key) for r in out.collect()) == [f"k{i:05d}".encode() for i in range(2_000) if i % 2 or i % 20 <= 4]
    same = compact.merged(rows, spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in ranges[:5]], "smallest_key binary, largest_key binary"))
    assert same.count() == 1_000 + 5 * 3


def test_as_of_each_with_a_hot_key(spark):
    from tidemark.operators import resolve

    log = [("hot", s, int(s % 5 > 0), f"v{s}") for s in range(0, 600, 2)] + [(f"k{s % 7}", s, 1, f"w{s}") for s in range(1, 60, 2)] + [("hot", 100, 1, "both"), ("hot", 100, 0, "")]
    reads = [("hot", a) for a in (-1, 0, 1, 5, 99, 100, 101, 350, 10_000)] + [("k3", 30), ("none", 5), ("hot", 5)]
    got = resolve.as_of_each(spark.createDataFrame(log, "key string, seq long, type byte, value string"), spark.createDataFrame(reads, "key string, as_of int"))
    want = set()
    for key, a in reads:
        seen = sorted((s, t, v) for k, s, t, v in log if k == key and s <= a)
        if seen and seen[-1][1]:
            want.add((key, a, seen[-1][2]))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ties_of_an_order_spread_over_parts(spark):
    from tidemark.operators import mutate

    rows = spark.range(4_000).select(F.lit(7).alias("at"), F.col("id").cast("string").alias("key"))
    got = mutate.numbered(rows, 10, "at")
    assert sorted(r.seq for r in got.collect()) == list(range(11, 4_011))
    assert got.select(F.spark_partition_id().alias("p")).groupBy("p").count().where("count > 100").count() > 1


def test_murmur3_of_many_keys_and_filters():
    import random

    from tidemark.functions import bloom

    draw = random.Random(5)
    keys = [draw.randbytes(n) for n in [*range(0, 30), *range(0, 30)]]
    assert bloom.murmur3_many(keys).tolist() == [bloom.murmur3(k) for k in keys]
    made = bloom.build([b"key:%d" % i for i in range(5_000)])
    assert bloom.may_hold_many([b"key:%d" % i for i in range(5_000)], made).all()
    assert bloom.may_hold_many([b"none:%d" % i for i in range(5_000)], made).mean() < 0.03
