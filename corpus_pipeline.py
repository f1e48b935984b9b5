"""Corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, packing.

``STAGES`` is a list of (name, function). A function takes (spark, docs, sf_dir), where ``docs`` is a
stored table, and returns a DataFrame; all but the last return the columns of ``docs``. ``run`` applies
them to ``documents``; each stage's result is written as Parquet below ``spark.checkpoint.dir`` and read
again by the next one, so a lost executor repeats tasks of one stage only.

What leaves: documents without a known language; all but the largest id of equal texts; all but the
smallest id of each group of near copies; documents with words of a benchmark window. Clean documents stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chalkline.llm import decontaminate, exact, language, neardup, packing
from chalkline.llm.common import saved, table

TOKENIZER = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.drop_unknown_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), added=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the language model nor the tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
