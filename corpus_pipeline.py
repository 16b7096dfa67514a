"""From raw documents to training shards: what is toxic, repeated or leaked goes, the rest is mixed and sharded.

Each stage takes all rows that the one before kept and writes its own; the next one reads them.
Stages tolerate nulls in any column, empty texts, repeated rows and empty tables, as their
operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.llm.decontaminate import uncontaminated
from thicket.llm.mixing import mixed
from thicket.llm.near_dedup import keep_one
from thicket.llm.shared import Scratch, table
from thicket.llm.sharding import shuffled_shards
from thicket.llm.toxicity import without_toxic

#: Fits, hashes and draws that SQL can't express; the tests hold the stages against plain versions.
ORACLE_SQL = None

SHARDS = 8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return without_toxic(spark, docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return keep_one(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return uncontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in uniform order, in shards of equal size: the columns of documents, shard and slot."""
    return shuffled_shards(spark, docs, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
