"""Registered queries of the engine, each with the SQL that checks it.

Logs: ``mlog`` from events (a key a user, errors delete) and ``clog`` from orders (a key a customer, status F deletes).
Every query runs over its whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bloom
from .operators import lookup, mutate, resolve, scan
from .operators.ordered import sum_before
from .options import Options
from .plans import compact, generations, manifest
from .schema import DELETION, in_prefix
from .sources import wal
from .sources.files import checkpointed, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = " ".join(sql.format(**_SQL).split())
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        F.col("event_id").alias("seq"),
        F.when(gone, 0).otherwise(1).cast("tinyint").alias("type"),
        F.when(gone, "").otherwise(F.col("props")).alias("value"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust:"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("key"),
        F.col("o_orderkey").alias("seq"),
        F.when(gone, 0).otherwise(1).cast("tinyint").alias("type"),
        F.when(gone, "").otherwise(F.col("o_orderpriority")).alias("value"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest(event_log(spark, sf_dir)).select("key", "seq", "value")


_EVENTS = """(select concat('user:', lpad(cast(user_id as varchar(20)), 6, '0')) as key, event_id as seq,
 case when event_type = 'error' then 0 else 1 end as type, case when event_type = 'error' then '' else props end as value from events)"""
_ORDERS = """(select concat('cust:', lpad(cast(o_custkey as varchar(20)), 8, '0')) as key, o_orderkey as seq,
 case when o_orderstatus = 'F' then 0 else 1 end as type, case when o_orderstatus = 'F' then '' else o_orderpriority end as value from orders)"""


def _top(log: str, where: str = "true") -> str:
    return f"(select key, seq, type, value from (select *, row_number() over (partition by key order by seq desc, type desc) as rn from {log} l0 where {where}) l1 where rn = 1)"


def _live(log: str, where: str = "true") -> str:
    return f"(select key, seq, value from {_top(log, where)} l2 where type = 1)"


_BYTES = f"(select *, octet_length(encode(key)) + octet_length(encode(value)) + 97 as bytes from {_EVENTS} b0)"
_GENS = f"""(select key, seq, type, value, bytes, cast(floor(coalesce(sum(bytes) over (order by seq rows between unbounded preceding and 1 preceding), 0) / 65536.0) as bigint) as generation from {_BYTES} g0)"""
_META = f"""(select cast(0 as bigint) as level, generation + 1 as number, cast(sum(bytes) as bigint) as file_size, min(key) as smallest_key, max(key) as largest_key,
 count(*) as entries, max(seq) as last_seq from {_GENS} m0 group by generation)"""
#: A manifest of several levels: files of the level-0 list, dealt out to levels by number.
_LEVELS = f"""(select number % 4 as level, number, file_size, smallest_key, largest_key from {_META} v0)"""


def _cut(budget: int) -> str:
    """Files of a compacted run: live rows in key order, cut by bytes; their key ranges are narrow."""
    return f"""(select output + 1 as number, cast(sum(bytes) as bigint) as file_size, min(key) as smallest_key, max(key) as largest_key from (select key, bytes,
 cast(floor(coalesce(sum(bytes) over (order by key rows between unbounded preceding and 1 preceding), 0) / {budget}.0) as bigint) as output from
 (select key, octet_length(encode(key)) + octet_length(encode(value)) + 97 as bytes from {_live(_EVENTS)} n0) n1) n2 group by output)"""


_SQL = {
    "mlog": _EVENTS, "clog": _ORDERS, "gens": _GENS, "meta": _META, "levels": _LEVELS, "top": _top(_EVENTS), "live": _live(_EVENTS), "corders": _live(_ORDERS),
    "asof": _live(_EVENTS, "seq <= 5000"), "small": _cut(1024), "large": _cut(2048),
}


# --- mutations ----------------------------------------------------------------------------------------------------


@query("select key, seq, cast(type as bigint) as type, value from {mlog} t where type = 1")
def kv_put_log(spark, sf_dir):
    return mutate.puts(event_log(spark, sf_dir).where(F.col("type") != DELETION)).withColumn("type", F.col("type").cast("long"))


@query("select key, seq, cast(0 as bigint) as type, '' as value from {mlog} t where type = 0")
def kv_delete_log(spark, sf_dir):
    return mutate.deletions(event_log(spark, sf_dir).where(F.col("type") == DELETION)).withColumn("type", F.col("type").cast("long"))


@query("select c_custkey as id, row_number() over (order by c_acctbal, c_custkey) + 100 as seq from customer")
def kv_sequence_numbers(spark, sf_dir):
    return mutate.numbered(table(spark, sf_dir, "customer"), 100, "c_acctbal", "c_custkey").select(F.col("c_custkey").alias("id"), "seq")


# --- resolution ---------------------------------------------------------------------------------------------------


@query("select key, seq, value from {live} t")
def kv_latest(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("select key, seq, value from {corders} t")
def kv_latest_orders(spark, sf_dir):
    return resolve.latest(order_log(spark, sf_dir)).select("key", "seq", "value")


@query("select key, seq, cast(type as bigint) as type, value from {top} t")
def kv_latest_with_tombstones(spark, sf_dir):
    return resolve.latest(event_log(spark, sf_dir), keep_tombstones=True).select("key", "seq", F.col("type").cast("long").alias("type"), "value")


@query("select key, seq, value from {asof} t")
def kv_as_of(spark, sf_dir):
    return resolve.latest(event_log(spark, sf_dir), as_of=5000).select("key", "seq", "value")


@query(
    """select key, as_of, value from (select r.key, r.as_of, l.type, l.value, row_number() over (partition by r.key, r.as_of order by l.seq desc, l.type desc) as rn
    from (select distinct key, s.as_of from {mlog} k, (values (cast(100 as bigint)), (2500), (7500)) s(as_of)) r join {mlog} l on l.key = r.key and l.seq <= r.as_of) x where rn = 1 and type = 1"""
)
def kv_as_of_each(spark, sf_dir):
    log = event_log(spark, sf_dir)
    reads = log.select("key").distinct().withColumn("as_of", F.explode(F.array(*[F.lit(s).cast("long") for s in (100, 2500, 7500)])))
    return resolve.as_of_each(log, reads)


@query("select key, seq, value from {live} t")
def kv_tier_merge(spark, sf_dir):
    """The log split in three overlapping tiers resolves as it does whole."""
    log = event_log(spark, sf_dir)
    return resolve.latest(resolve.tiers(log.where("seq % 3 = 0"), log.where("seq % 3 > 0"), log.where("seq % 5 = 0"))).select("key", "seq", "value")


@query("select key, seq, value from {live} t")
def kv_replay_idempotent(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return resolve.latest(log.unionByName(log)).select("key", "seq", "value")


@query("select key, seq, cast(type as bigint) as type, row_number() over (partition by key order by seq desc, type desc) as place from {mlog} t")
def kv_internal_order(spark, sf_dir):
    """The place that the operator's order gives each row among those of its key."""
    placed = checkpointed(resolve.internal_order(event_log(spark, sf_dir)).withColumn("_id", F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("key").orderBy("_id"))
    return placed.select("key", "seq", F.col("type").cast("long").alias("type"), place.cast("long").alias("place"))


@query("select key, seq, cast(2 as bigint) as versions from {mlog} t where seq % 97 = 7")
def kv_duplicate_versions(spark, sf_dir):
    """A log with every row twice, some of them changed the second time."""
    log = event_log(spark, sf_dir)
    again = log.withColumn("value", F.when(F.col("seq") % 97 == 7, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    return resolve.duplicate_versions(log.unionByName(again))


# --- lookups ------------------------------------------------------------------------------------------------------


@query("select key, value from {live} t where key = 'user:000017'")
def kv_get_hit(spark, sf_dir):
    return lookup.get(event_log(spark, sf_dir), "user:000017")


@query("select key, value from {live} t where key = (select min(key) from {top} d where type = 0)")
def kv_get_deleted(spark, sf_dir):
    log = event_log(spark, sf_dir)
    gone = resolve.latest(log, keep_tombstones=True).where(F.col("type") == DELETION).agg(F.min("key")).first()[0]
    return lookup.get(log, gone)


@query("select key, value from {live} t where key = 'user:none'")
def kv_get_missing(spark, sf_dir):
    return lookup.get(event_log(spark, sf_dir), "user:none")


def _asked(spark: SparkSession) -> DataFrame:
    return spark.range(0, 400, 3).select(F.concat(F.lit("user:"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("key"))


_ASKED = "(select concat('user:', lpad(cast(i * 3 as varchar(20)), 6, '0')) as key from range(134) q(i))"


@query("select a.key, l.value from " + _ASKED + " a left join {live} l on l.key = a.key")
def kv_multi_get(spark, sf_dir):
    return lookup.multi_get(event_log(spark, sf_dir), _asked(spark))


@query("select l.key from {live} l where l.key in (select key from " + _ASKED + " a)")
def kv_contains(spark, sf_dir):
    return lookup.contains(event_log(spark, sf_dir), _asked(spark))


@query("select a.key from " + _ASKED + " a where a.key not in (select key from {live} l)")
def kv_absent(spark, sf_dir):
    return lookup.absent(event_log(spark, sf_dir), _asked(spark))


# --- ordered reads ------------------------------------------------------------------------------------------------


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.live(event_log(spark, sf_dir))


@query("select count(*) as entries, cast(sum(octet_length(encode(key))) as bigint) as key_bytes, cast(sum(octet_length(encode(value))) as bigint) as value_bytes from {live} t")
def kv_scan_full_stats(spark, sf_dir):
    return scan.totals(_rows(spark, sf_dir))


@query("select key, value from {live} t")
def kv_scan(spark, sf_dir):
    return scan.in_order(_rows(spark, sf_dir))


@query("select key, value from {live} t where key >= 'user:000020' and key < 'user:000060'")
def kv_range(spark, sf_dir):
    return scan.between(_rows(spark, sf_dir), "user:000020", "user:000060")


@query("select key, value from {live} t where starts_with(key, 'user:00001')")
def kv_prefix(spark, sf_dir):
    return scan.prefixed(_rows(spark, sf_dir), "user:00001")


@query("select key, value from {live} t where key >= 'user:000050' order by key limit 10")
def kv_scan_n(spark, sf_dir):
    return scan.bounded(_rows(spark, sf_dir), "user:000050", 10)


@query("select key, value from {live} t order by key limit 1")
def kv_first(spark, sf_dir):
    return scan.first(_rows(spark, sf_dir))


@query("select key, value from {live} t order by key desc limit 1")
def kv_last(spark, sf_dir):
    return scan.last(_rows(spark, sf_dir))


@query("select key, value from {live} t where key >= 'user:0000155' order by key limit 1")
def kv_seek(spark, sf_dir):
    return scan.seek(_rows(spark, sf_dir), "user:0000155")


@query("select key, value from {live} t where key > 'user:000017' order by key limit 1")
def kv_next(spark, sf_dir):
    return scan.after(_rows(spark, sf_dir), "user:000017")


@query("select key, value from {live} t where key < 'user:000017' order by key desc limit 1")
def kv_prev(spark, sf_dir):
    return scan.before(_rows(spark, sf_dir), "user:000017")


@query("select key, lag(key) over (order by key) as previous_key, lead(key) over (order by key) as next_key from {live} t")
def kv_next_prev_all(spark, sf_dir):
    return scan.neighbours(_rows(spark, sf_dir))


@query("select c_custkey as id, concat('cust:', lpad(cast(c_custkey as varchar(20)), 8, '0')) as key, c_name as name from customer where c_custkey >= 10 and c_custkey < 20 or c_custkey >= 100 and c_custkey < 200")
def kv_prefix_customers(spark, sf_dir):
    """Two prefixes of an immutable keyed set."""
    keyed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("cust:"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("key"), F.col("c_name").alias("name"))
    return keyed.where((in_prefix(F.col("key"), "cust:0000001") & (F.col("id") < 20)) | in_prefix(F.col("key"), "cust:000001"))


# --- runs and metadata --------------------------------------------------------------------------------------------


@query("select generation, count(*) as entries, cast(sum(bytes) as bigint) as bytes from {gens} t group by generation")
def kv_flush_generations(spark, sf_dir):
    return generations.generations(event_log(spark, sf_dir)).groupBy("generation").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations.file_meta(event_log(spark, sf_dir))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir).select((F.col("number") % 4).alias("level"), "number", "file_size", "smallest_key", "largest_key")


@query("select * from {meta} t")
def kv_file_meta(spark, sf_dir):
    return _meta(spark, sf_dir)


@query("select level, cast(sum(file_size) as bigint) as bytes from {levels} t group by level")
def kv_level_bytes(spark, sf_dir):
    return manifest.level_bytes(_levels(spark, sf_dir))


@query("select level, count(*) as files from {levels} t group by level")
def kv_level_files(spark, sf_dir):
    return manifest.level_files(_levels(spark, sf_dir))


@query("select distinct number from {levels} t")
def kv_live_files(spark, sf_dir):
    return manifest.live_files(_levels(spark, sf_dir))


@query("select level, number, row_number() over (order by level, case when level = 0 then -number end, smallest_key, number) as place from {levels} t")
def kv_probe_order(spark, sf_dir):
    """The place that the operator's order gives each file.  A manifest is small: one row a file."""
    placed = checkpointed(manifest.probe_order(_levels(spark, sf_dir)).withColumn("_id", F.monotonically_increasing_id()))
    return placed.select("level", "number", F.row_number().over(Window.orderBy("_id")).cast("long").alias("place"))


def _cut_files(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    cut = compact.output_numbers(flagship(spark, sf_dir), budget)
    ranges = [F.sum("bytes").alias("file_size"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key")]
    return cut.groupBy("output").agg(*ranges).select((F.col("output") + 1).alias("number"), "file_size", "smallest_key", "largest_key")


@query("select number from {small} t where smallest_key <= 'user:000075' and largest_key >= 'user:000075'")
def kv_prune_point(spark, sf_dir):
    return manifest.prune_point(_cut_files(spark, sf_dir, 1024), "user:000075").select("number")


@query("select number from {small} t where not (largest_key < 'user:000040' or smallest_key > 'user:000055')")
def kv_prune_range(spark, sf_dir):
    return manifest.prune_range(_cut_files(spark, sf_dir, 1024), "user:000040", "user:000055").select("number")


@query("select number from {small} t where not (largest_key < 'user:000040' or smallest_key > 'user:000055')")
def kv_candidates(spark, sf_dir):
    """The same by the manifest's bisection."""
    version = _version(_cut_files(spark, sf_dir, 1024).withColumn("level", F.lit(1)))
    return spark.createDataFrame([(f.number,) for f in version.candidates(b"user:000040", b"user:000055")], "number long")


@query("select a.number, b.number as other from {small} a, {large} b where not (b.largest_key < a.smallest_key or b.smallest_key > a.largest_key)")
def kv_overlaps(spark, sf_dir):
    return manifest.overlaps(_cut_files(spark, sf_dir, 1024), _cut_files(spark, sf_dir, 2048))


def _version(files: DataFrame) -> manifest.Version:
    rows = files.collect()  # a manifest: one row a file
    return manifest.Version().apply(
        manifest.Edit(added=[manifest.FileMeta(int(r["level"]), r["number"], r["file_size"], r["smallest_key"].encode(), r["largest_key"].encode()) for r in rows])
    )


def _picked(spark: SparkSession, plan: compact.Compaction | None) -> DataFrame:
    rows = [] if plan is None else [(f.level, f.number) for f in plan.files]
    return spark.createDataFrame(rows, "level long, number long")


def _two_levels(spark: SparkSession, sf_dir: str, upper: int, times: int = 1) -> DataFrame:
    """Small files in a level, larger ones over the same keys, numbered from 1001 on, in the next."""
    small = _cut_files(spark, sf_dir, 1024).select(F.lit(upper).cast("long").alias("level"), "number", (F.col("file_size") * times).alias("file_size"), "smallest_key", "largest_key")
    large = _cut_files(spark, sf_dir, 2048).select(F.lit(upper + 1).cast("long").alias("level"), (F.col("number") + 1000).alias("number"), "file_size", "smallest_key", "largest_key")
    return small.unionByName(large)


@query(
    """with u as (select * from {small} s where number between 3 and 7) select cast(0 as bigint) as level, number from u union all select cast(1 as bigint), number + 1000 from {large} t
    where not (largest_key < (select min(smallest_key) from u) or smallest_key > (select max(largest_key) from u))"""
)
def kv_pick_l0(spark, sf_dir):
    files = _two_levels(spark, sf_dir, 0).where("level > 0 or number between 3 and 7")
    return _picked(spark, compact.pick(_version(files), 4))


@query(
    """with p as (select * from {small} s where (select sum(file_size) * 1000 from {small} z) > 1048576 order by smallest_key limit 1) select cast(1 as bigint) as level, number from p
    union all select cast(2 as bigint), t.number + 1000 from {large} t, p where not (t.largest_key < p.smallest_key or t.smallest_key > p.largest_key)"""
)
def kv_pick_size(spark, sf_dir):
    return _picked(spark, compact.pick(_version(_two_levels(spark, sf_dir, 1, times=1000))))


@query("select key, seq, cast(type as bigint) as type, value from {top} t")
def kv_compact_dedup(spark, sf_dir):
    """The newest version of each key, deletions kept: every file may lie above older data."""
    everywhere = spark.createDataFrame([("", "\U0010ffff")], "smallest_key string, largest_key string")
    merged = compact.merged(event_log(spark, sf_dir), everywhere)
    return merged.select("key", "seq", F.col("type").cast("long").alias("type"), "value")


@query(
    """select key, seq, cast(type as bigint) as type, value from {top} t where type = 1 or exists (select 1 from {meta} d where d.number % 5 = 2 and t.key between 'user:000040' and 'user:000090')"""
)
def kv_tombstone_gc(spark, sf_dir):
    deeper = _meta(spark, sf_dir).where("number % 5 = 2").select(F.lit("user:000040").alias("smallest_key"), F.lit("user:000090").alias("largest_key"))
    return compact.merged(event_log(spark, sf_dir), deeper).select("key", "seq", F.col("type").cast("long").alias("type"), "value")


@query(
    """select output, count(*) as entries, min(key) as smallest_key, max(key) as largest_key from (select key, cast(floor(coalesce(sum(octet_length(encode(key)) + octet_length(encode(value)) + 97)
    over (order by key rows between unbounded preceding and 1 preceding), 0) / 4096.0) as bigint) as output from {live} t) x group by output"""
)
def kv_output_split(spark, sf_dir):
    cut = compact.output_numbers(resolve.latest(event_log(spark, sf_dir)), 4096)
    return cut.groupBy("output").agg(F.count("*").alias("entries"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"))


@query("select count(*) as entries, cast(0 as bigint) as overlapping, true as several from {live} t")
def kv_split_disjoint(spark, sf_dir):
    """What the store writes: parts of a run by key range, none of which overlaps another."""
    rows = flagship(spark, sf_dir).withColumn("type", F.lit(1))
    cut = checkpointed(compact.split(rows, 6 * 1024, 1024).withColumn("part", F.spark_partition_id()))
    parts = cut.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))  # a row a file
    parts = parts.withColumn("before", F.lag("high").over(Window.orderBy("low")))
    return parts.agg(F.sum("n").alias("entries"), F.count_if(F.col("before") >= F.col("low")).alias("overlapping"), (F.count("*") > 1).alias("several"))


@query(
    """select level, number, file_size from {levels} t where not (number % 3 = 0) union all select level + 1, number, file_size from {levels} u where number % 3 = 0"""
)
def kv_edit_apply(spark, sf_dir):
    files = _levels(spark, sf_dir).select("level", "number", "file_size")
    moved = files.where("number % 3 = 0")
    return manifest.edit_apply(files, moved, moved.withColumn("level", F.col("level") + 1))


@query(
    """select level, number, file_size from (select *, row_number() over (partition by level, number order by edit desc, action) as rn from
    (select number as edit, 'add' as action, level, number, file_size from {levels} a union all select number + 3, 'delete', level, number, file_size from {levels} d where number % 2 = 0
    union all select number + 5, 'add', level, number, file_size + 1 from {levels} r where number % 4 = 0) x) y where rn = 1 and action = 'add'"""
)
def kv_manifest_replay(spark, sf_dir):
    files = _levels(spark, sf_dir).select("level", "number", "file_size")

    def step(rows: DataFrame, action: str, later: int, grown: int) -> DataFrame:
        return rows.select((F.col("number") + later).alias("edit"), F.lit(action).alias("action"), "level", "number", (F.col("file_size") + grown).alias("file_size"))

    return manifest.fold(step(files, "add", 0, 0).union(step(files.where("number % 2 = 0"), "delete", 3, 0)).union(step(files.where("number % 4 = 0"), "add", 5, 1)))


@query("select max(seq) as last_sequence, count(*) as records from {mlog} t")
def kv_last_sequence(spark, sf_dir):
    return event_log(spark, sf_dir).agg(F.max("seq").alias("last_sequence"), F.count("*").alias("records"))


@query("select cast(0 as bigint) as false_negatives, count(*) as keys from (select distinct key from {mlog} t) k")
def kv_bloom_no_false_negative(spark, sf_dir):
    """A filter over the keys, built a run at a time, holds all of them.  Runs grow in number with the keys, not in size."""
    keys = event_log(spark, sf_dir).select(F.col("key").cast("binary").alias("key")).distinct()

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 16):
                found = batch.column(0).slice(at, 1 << 16).to_pylist()
                held = bloom.may_hold_many(found, bloom.build(found))
                yield pa.RecordBatch.from_arrays([pa.array([int((~held).sum())]), pa.array([len(found)])], names=["missed", "n"])

    per_run = keys.mapInArrow(build, "missed long, n long")
    return per_run.agg(F.coalesce(F.sum("missed"), F.lit(0)).alias("false_negatives"), F.coalesce(F.sum("n"), F.lit(0)).alias("keys"))


@query("select key, seq, cast(type as bigint) as type, value from {mlog} t")
def kv_crc_frames(spark, sf_dir):
    """Each mutation framed with its checksum by built-in functions, and decoded again."""
    framed = wal.frames(event_log(spark, sf_dir))
    decoded = wal.decode(framed.select(F.col("seq").cast("string").alias("path"), F.col("frame").alias("content")))
    return decoded.select(F.col("key").cast("string").alias("key"), "seq", F.col("type").cast("long").alias("type"), F.col("value").cast("string").alias("value"))


@query(
    """select event_type, p50, p95, p99 from (select event_type, max(case when i = floor(n * 0.50) then value end) as p50, max(case when i = floor(n * 0.95) then value end) as p95,
    max(case when i = floor(n * 0.99) then value end) as p99 from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n
    from events) x group by event_type) y"""
)
def kv_latency_percentiles(spark, sf_dir):
    """By index, element floor(n * q) of the sorted values, from counts of each different value, which combine before
    the shuffle.  The counts are summed along (type, value) by parts, so no task meets all values of a type."""
    counted = table(spark, sf_dir, "events").groupBy("event_type", "value").count()
    placed = checkpointed(sum_before(counted, "count", "before", "event_type", "value"))
    types = placed.groupBy("event_type").agg(F.min("before").alias("first"), F.sum("count").alias("n"))  # a row a type
    placed = placed.join(F.broadcast(types), "event_type").withColumn("high", F.col("before") + F.col("count") - F.col("first"))
    pick = lambda q: F.min(F.when(F.col("high") > F.floor(F.col("n") * q), F.col("value")))
    return placed.groupBy("event_type").agg(pick(0.50).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))


# --- a store, end to end ------------------------------------------------------------------------------------------


@query("select key, value from {live} t")
def kv_store_reopened(spark, sf_dir):
    """The log written to a store in two bulk batches, flushed, compacted, closed, opened again, and read."""
    from .store import Store

    log = event_log(spark, sf_dir)
    where = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    with Store.open(spark, where, Options(max_level0_files=2)) as store:
        store.apply_many(log.where("seq % 2 = 0"), "seq")
        store.flush()
        late = log.where("seq % 2 = 1")
        # Sequence numbers are the store's own: what the second half mustn't hide comes again after it.
        store.apply_many(late.unionByName(resolve.latest(log, keep_tombstones=True)), "seq")
        store.maintain()
    with Store.open(spark, where) as store:
        rows = checkpointed(store.live().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")))
        store._files.delete("")
    return rows


@query("select a.key, l.value from " + _ASKED + " a left join {live} l on l.key = a.key")
def kv_store_multi_get(spark, sf_dir):
    """Bulk lookups in a store's sorted files, which the manifest prunes for the keys."""
    from .store import Store

    where = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    with Store.open(spark, where, Options(max_file_size=2048)) as store:
        store.apply_many(event_log(spark, sf_dir), "seq")
        store.flush()
        found = checkpointed(store.multi_get(_asked(spark)).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")))
        store._files.delete("")
    return found


@query(
    """select cast(place as bigint) as place, key, value from (select row_number() over (order by key) as place, key, value from {live} t) x where place <= 40
    union all select cast(-place as bigint), key, value from (select row_number() over (order by key desc) as place, key, value from {live} t) y where place <= 40"""
)
def kv_cursor_walk(spark, sf_dir):
    """A cursor's first forty entries, and its last forty backwards."""
    from .store import Store

    where, seen = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", []
    with Store.open(spark, where, Options(max_file_size=2048)) as store:
        store.apply_many(event_log(spark, sf_dir), "seq")
        store.flush()
        cursor = store.snapshot().cursor(page=16)
        for start, step, sign in ((cursor.seek_to_first, cursor.next, 1), (cursor.seek_to_last, cursor.prev, -1)):
            start()
            for place in range(1, 41):
                if not cursor.valid():
                    break
                seen.append((sign * place, cursor.key().decode(), cursor.value().decode()))
                step()
        store._files.delete("")
    return spark.createDataFrame(seen, "place long, key string, value string")
