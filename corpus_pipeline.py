"""A corpus pipeline over ``documents``: quality, toxicity, near duplicates, benchmark passages, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``.  All but the last return the columns of
``docs``; the last returns ids and digests.  Between stages rows are written and read again.

Defined results: rows with null or empty text have quality 0 and go in the first stage; rows that share an id but no class
of near duplicates all stay, and so do rows with a null id that duplicate nothing; each is judged by its own text; other
columns are carried along; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, near, quality, toxicity
from tidemark.llm.common import checkpointed, fold, free_name, read_table
from tidemark.llm.queries import word_bpe_path

#: Score at and above which a document counts as good, or as toxic.
QUALITY = 0.3
TOXIC = 0.3
#: A document goes if it holds windows of two benchmark items, or a run of so many words that the benchmark has, or of all
#: words of an item that has fewer (but a full window): one shared window of 8 words can be chance, a passage isn't.
PASSAGE = 13
#: Most ids that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    name = free_name(docs, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= QUALITY).drop(name)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)
    name = free_name(docs, "score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < TOXIC).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, the one with the smallest id.  Near duplicates have a Jaccard
    similarity of 0.8 or more over five-word shingles, which the whole sets decide; op2's index and min-hashes say what to
    compare."""
    return near.one_of_each(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(docs, read_table(spark, sf_dir, "benchmark"))
    passage = decontaminate.longest(F.col("spans")) >= F.least(F.lit(PASSAGE), F.col("whole"))  # least skips null
    gone = found.where((F.size("items") >= 2) | passage).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    gone = checkpointed(gone.distinct())
    few = gone.count() <= BROADCAST_IDS
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (decontaminate.row_of() == F.col("_row"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(docs, word_bpe_path()))


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each),
    ("decontaminate", not_contaminated),
    ("bpe", encoded),
]

#: The two networks have no SQL form; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
