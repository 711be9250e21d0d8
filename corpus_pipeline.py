"""Corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the documents that stay,
with all their columns, and from the last stage the token ids of each.

Every stage takes null, empty and very long texts, null and repeated doc_ids, repeated rows, columns of any other name
and type, and empty tables (the stages' docstrings say what becomes of them). Ties between copies go to the
smallest doc_id, null last. Rows are independent of the order they come in, except which of several rows equal in doc_id and text stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op1_bpe, op3_quality, op4_decontaminate, op5_jaccard, op9_parsing
from tessera.llm.common import materialize, shared_dir, table

#: No SQL: the suffix-array and tokenizer stages have none. tests/llm/test_pipeline.py checks it by brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts have too few words and go; repeated rows fare alike."""
    return op3_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the row with the smallest doc_id stays (null last, then by the text's hash).

    Of rows equal in doc_id and text any one stays; texts without words link with nothing, so all of them stay.
    """
    return op5_jaccard.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document holds are taken out of the text; every row stays, and n_chars follows.

    Null texts stay null. Rows that share a doc_id are one place, so neither is earlier; null doc_ids come last.
    """
    return op9_parsing.remove_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; texts without words, null ones too, stay."""
    return op4_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text, one row for each document; null text counts as empty."""
    return op1_bpe.bpe_encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_texts=True).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
