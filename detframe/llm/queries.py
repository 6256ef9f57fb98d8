"""The dealt operators on their whole tables, with the columns their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from detframe.llm import conversations, langid, linecrf, lmscore, mixing, quality, runs, simhash, slots, substrings, templates, tokenfiles, urllists
from detframe.llm.common import documents


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(documents(spark, sf_dir))


def op2_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(documents(spark, sf_dir))


def op5_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.sharded(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).drop("key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urllists.judged(urllists.dated_captures(pages), urllists.derived_lists(pages))


def op10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(documents(spark, sf_dir))


def op12_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_substring_fm_index": op1_substrings,
    "op2_attention_scores": op2_attention,
    "op3_language_ppm": op3_language,
    "op4_ranked_token_files": op4_token_files,
    "op5_virtual_slots": op5_slots,
    "op6_pivotal_mixing": op6_mixing,
    "op7_simhash_multi_index": op7_simhash,
    "op8_risk_controlled_quality": op8_quality,
    "op9_temporal_url_lists": op9_url_lists,
    "op10_template_decontamination": op10_templates,
    "op11_periodic_runs": op11_runs,
    "op12_line_crf_quality": op12_line_crf,
    "op13_conversation_repair": op13_conversations,
}
ORACLES: dict[str, str] = {"op9_temporal_url_lists": urllists.ORACLE}
