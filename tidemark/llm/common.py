"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts the words of the license and decontamination contracts: ASCII but letters and digits.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: For str.translate: lower-cases A-Z only.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id's text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, max_rows: int = 512, max_bytes: int = 4 << 20
) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches into slices of bounded rows and text bytes, so that a worker's memory is bounded
    by one slice and the longest single text.  Yields the slice and its texts (None for null)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.schema.get_field_index(column)
        lengths = pc.binary_length(batch.column(k)).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            size += n or 0
            if i + 1 - start >= max_rows or size >= max_bytes or i + 1 == len(lengths):
                part = batch.slice(start, i + 1 - start)
                yield part, part.column(k).to_pylist()
                start, size = i + 1, 0


_caches: dict[str, Callable[[], None]] = {}


def alone(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called where a task of an operator begins, with what empties its caches in this worker: those of the other operators that
    the worker has served before are emptied, so that a pipeline's stages don't add up."""
    for other in [o for o in _caches if o != owner]:
        _caches.pop(other)()
    _caches[owner] = clear


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir isn't set; on a cluster it has to name a shared folder")
            import tempfile

            where = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(where)
    return df.checkpoint()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_chars: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``per_class`` rows of either class, where ``train`` holds of the document id.  Rows
    come by their id's hash, so the choice is the same on every run.  Texts of more than ``max_chars`` are not used
    for learning, and of rows that share an id only the one with the smallest text is, which bounds what the driver holds."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(train & F.col("label").isin(0, 1)).distinct()
    order = F.xxhash64("doc_id")
    picked = known.where("label = 0").orderBy(order, "doc_id").limit(per_class).union(known.where("label = 1").orderBy(order, "doc_id").limit(per_class))
    fits = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    one = fits.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = one.toArrow()  # bounded: twice per_class rows
    by = sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), rows["text"].to_pylist()))
    return [t for _, _, t in by], [y for _, y, _ in by]


def appended(docs: DataFrame, text_col: str, name: str, values, begin: Callable[[], None] = lambda: None) -> DataFrame:
    """``docs`` with a double column ``name``: ``values(texts)`` of bounded slices.  A column of that name is replaced.
    ``begin`` is called in each task first."""
    if name.lower() == text_col.lower():
        raise ValueError(f"{name} is the column of the texts")
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for part, texts in text_slices(batches, text_col, max_bytes=2 << 20):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values(texts), pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)
