"""Queries and oracle SQL of the training-data operators, one opN_<name> each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import bpe, chat, decontaminate, edit_counts, embedding_dedup, html_text, jaccard, quality, token_files, toxicity
from framewright.llm.common import read_table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op1_rows(spark, read_table(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op2_rows(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.op3_rows(read_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op4_rows(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.op6_rows(read_table(spark, sf_dir, "embeddings"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8_rows(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op9_rows(read_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op10_rows(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_chat_format": op1_chat_format, "op2_toxicity": op2_toxicity, "op3_edit_counts": op3_edit_counts, "op4_token_files": op4_token_files, "op5_decontamination": op5_decontamination, "op6_embedding_dedup": op6_embedding_dedup, "op7_html_text": op7_html_text, "op8_quality": op8_quality, "op9_bpe": op9_bpe, "op10_jaccard_join": op10_jaccard_join}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.OP1_SQL, "op6_embedding_dedup": embedding_dedup.OP6_SQL, "op10_jaccard_join": jaccard.OP10_SQL}
