"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

Quality rules drop documents far from their language, line dedup cuts lines that repeat an earlier
one, near-dedup leaves one document of each group of near copies (Jaccard similarity of 5-word
shingles of at least 0.8), decontamination drops documents with benchmark items, and packing lays
the rest out in sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courseloom.llm import decontaminate, lines, near, packing, quality
from courseloom.llm.common import importable, step
from courseloom.llm.tokens import PACKED_BY, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return near.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(docs, vocabulary(PACKED_BY))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("decontamination", decontamination), ("packing", best_fit_packing)]

# the stages' models and tree searches are no SQL; tests/llm/test_pipeline.py has them by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = step(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
