"""A training corpus from ``documents``: language, near copies, benchmark leaks, mixture, shards.

Every stage takes the session, the documents that its predecessor kept, and the
folder of the input tables.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow.llm import decontamination, language_id, mixing, ngram_join, sharding
from courtflow.llm.queries import SHARDS
from courtflow.llm.tables import keep, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is in none of the languages that the labelled texts show."""
    prototypes = language_id.learn(docs)
    rows = docs.select(F.struct(*docs.columns).alias("whole"), "text")
    known = language_id.identify(rows, prototypes, ["whole"])
    return known.where(~language_id.rejected()).select("whole.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that five-word shingles link at a similarity of 0.8."""
    return ngram_join.keep_one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontamination.uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every source as often as its weight asks, at most twice; a document that is taken twice is two rows."""
    return mixing.take(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add shard and slot, contiguous shards of near-equal bytes."""
    return sharding.sharded(docs, SHARDS)


STAGES = [("language", language), ("near copies", near_copies), ("leaks", leaks), ("mixture", mixture), ("shards", shards)]

#: The first stage learns and cannot be put in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = keep(docs)
    return docs
