"""The training-data pipeline: documents -> encoded training text.

``STAGES`` are (name, function) pairs.  A function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``; ``text`` and
``n_chars`` change where lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import decontam, line_dedup, minhash, quality, sentencepiece_nbest
from tandem.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: a line of several documents stays in the first alone."""
    return line_dedup.drop_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group of similarity 0.8 and more stays."""
    return minhash.one_of_each(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with ten consecutive words of a test item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the n best segmentations, their scores, and the round trip."""
    return sentencepiece_nbest.encode_columns(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: SQL cannot state a learned classifier or a lattice search; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
