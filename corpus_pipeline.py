"""Corpus pipeline: toxicity filter, near-duplicates, decontamination, mixing, sharding.

Each stage takes all that the one before kept; between stages the documents are written as
Parquet to the shared folder and read again, so a lost executor repeats one stage's tasks only.

In every stage null texts count as empty ones, rows are kept or dropped one by one (repeated rows and
rows without an id too), columns besides the documents' own keep their values whatever their names, and
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm import decontam, mixing, shards, simhash, toxicity
from promolens.llm.common import save, table

N_SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from the labels kept for training. Where
    documents of either class are missing there, all are kept."""
    model = toxicity.train_on_seen(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "__toxicity").filter(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; copies without an id
    stay only where the whole group has none. Very short and empty texts are grouped like any other."""
    return simhash.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), prefix="__")
    return found.filter(F.size("__spans") == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target shares, in a global random order; null sources are one
    source. A document of an over-represented source may draw no copy."""
    return mixing.replicate(docs, names=("__copies", "__copy")).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, and the one they would have if one more were appended. Copies of an
    id share a shard; rows without an id are in one shard."""
    return shards.with_shard(docs, N_SHARDS, grown="grown_shard")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: The toxicity model and the SimHash components can't be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
