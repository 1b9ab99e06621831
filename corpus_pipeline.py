"""The corpus pipeline: its stages over the documents table, each fed with all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shotmetrics.llm import catalog, decontamination, mixing, near_dedup, sharding, toxicity
from shotmetrics.llm.shared import table

# SQL has no votes of nearest examples and no drawn matrix of shard counts.
ORACLE_SQL = None

# Share of the tokens that the mixing stage may keep; a document is taken once at most.
TOKEN_BUDGET = (3, 4)
SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(spark, docs, index)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_duplicates(docs, width=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, catalog.LEVELS, catalog.WEIGHTS, budget=TOKEN_BUDGET, epochs=1, seed=catalog.SEED)
    return mixed.select("row.*")


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.uniform_shards(docs, SHARDS, catalog.SEED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass all stages, with their shard and slot.

    Each stage but the last is written to the shared folder and read again, so
    a lost executor costs no more than its stage.
    """
    docs = table(spark, sf_dir, "documents")
    *early, (_, last) = STAGES
    for name, stage in early:
        folder = catalog.shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return last(spark, docs, sf_dir)
