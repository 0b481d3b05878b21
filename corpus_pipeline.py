"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the columns of ``documents``.

1. language: documents whose language is unknown (no text, no letter, or like none of the learned languages) go.
2. near_duplicates: one document of each class of near copies stays, the one with the smallest doc_id.
3. decontamination: documents that hold a window of a benchmark item go.
4. packing: the rest is tokenised and packed into sequences, one row per piece.

Nulls, empty and repeated rows follow the operators' texts: a null text is rejected by stage 1, a repeated row stays
once after stage 2, an empty table passes all stages.  Further columns of ``documents`` are kept until stage 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontaminate, language_id, near_dedup, packing
from leafmill.llm.common import new_folder
from leafmill.llm.queries import CAPACITY, word_tokenizer

#: A text with a smaller share of its language's letter runs, as times the usual share, is in none of the learned languages.
LEAST_SHARE = 0.6
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known(docs, LEAST_SHARE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, *word_tokenizer(), 0, CAPACITY), CAPACITY)


STAGES: list[tuple[str, Stage]] = [("language", language), ("near_duplicates", near_duplicates),
                                   ("decontamination", decontamination), ("packing", best_fit_packing)]
#: None: language scores, near copies and best fit are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
