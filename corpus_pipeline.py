"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before it kept and is written before the next one reads
it. All but the last return the columns of ``documents``; after the mix an id may have
several rows, one for each time its words are taken. Packing returns one row per piece of a
sequence. SQL can't express the stages, so there is no ``ORACLE_SQL``; the tests follow each
stage by brute force.

Cases: a null text counts as empty; all empty texts are equal, so one of them passes the exact
stage, and the mix, which takes words, leaves it out; very long texts go through whole; of ties
the largest id stays among equal texts and the least among near copies; rows that repeat an id,
and those without one, stay or go together up to the mix, so one of them that is kept keeps the
others; an empty table gives no rows; further columns, whatever their names, are kept up to the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import apportion_mix, chosen_path, chunk_dedup, lang_fusion, residual_packing
from folioforge.llm.queries import TOKENIZER, documents_language
from folioforge.plans.scratch import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go."""
    return lang_fusion.accepted(docs, "doc_id", "text", **documents_language(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return chunk_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the least id stays."""
    return chosen_path.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights by repeating and cutting documents."""
    return apportion_mix.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return residual_packing.packed(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mix", mix),
    ("pack", pack),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
