"""A training-data pipeline over ``documents``: each stage's rows are written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from detframe.llm import langid, mixing, simhash, slots, templates
from detframe.llm.common import documents, land


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language cannot be told (null text, no letter) go."""
    return langid.drop_undetermined(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window, verbatim or re-parameterised, go."""
    return templates.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining row's shard and place in it."""
    return slots.sharded(docs)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix_sources), ("sharding", shard)]

#: Learnt code lengths, fingerprints and seeded rounding have no SQL form; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
