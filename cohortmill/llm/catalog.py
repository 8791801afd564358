"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cohortmill.llm import (
    chat, decontaminate, divergence, language, licenses, mixing, nearcopies, neighbours, periods, personal, quality, repeats, secrets,
)
from cohortmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of all documents."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated byte strings of all documents, every copy removed."""
    return repeats.repeat_digest(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents by source."""
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return nearcopies.near_digest(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back."""
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every twentieth vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return language.languages(table(spark, sf_dir, "documents"))


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal.personal_digest(table(spark, sf_dir, "documents"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents."""
    return periods.period_digest(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the sources of each language, and the terms that set them apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_decontaminate,
        op3_quality,
        op4_repeats,
        op5_mix_sources,
        op6_near_copies,
        op7_licenses,
        op8_chat,
        op9_nearest,
        op10_language,
        op11_personal,
        op12_periods,
        op13_divergence,
        pipeline,
    )
}

SQL: dict[str, str] = {
    "op2_decontaminate": decontaminate.SQL,
    "op5_mix_sources": mixing.SQL,
    "op6_near_copies": nearcopies.SQL,
    "op7_licenses": licenses.SQL,
    "op8_chat": chat.SQL,
    "op11_personal": personal.SQL,
    "op12_periods": periods.SQL,
    "op13_divergence": divergence.SQL,
}
