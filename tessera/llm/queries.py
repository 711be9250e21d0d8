"""Thin queries over the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_bpe import bpe_encode_decode

    return bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_records import token_records

    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op9_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_parsing import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_jaccard": op5_jaccard,
    "op6_token_counts": op6_token_counts,
    "op2_substrings": op2_substrings,
    "op3_quality": op3_quality,
    "op7_sharding": op7_sharding,
    "op8_html": op8_html,
    "op9_parsing": op9_parsing,
    "op10_token_records": op10_token_records,
}
#: SQL can't express the tokenizers (op1, op6, op10), the hash ring (op7) and the style tree (op8).
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
