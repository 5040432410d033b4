"""Quality classifier: supervised subword embeddings (see ``subword``).

A document's vector is the mean of its hashed words, word pairs and character
n-grams, case kept (shouting is a sign of junk).  ``labels`` are learned only
outside the held-out fold, from at most ``Config.max_train_per_class`` rows of
each class; ``lang``, ``source`` and ``doc_id`` are never inputs of a score.

Defined results: a text without words (null, empty, white space) scores by the
bias alone; a row with null ``doc_id`` is scored like any other and held out of
nothing; without usable labels every text scores the smoothed share of label 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subword
from .common import held_out

CONFIG = subword.Config(lower=False, pairs=True)
KEEP_AT = 0.3


def score_quality(documents: DataFrame, labels: DataFrame, config: subword.Config = CONFIG) -> DataFrame:
    """doc_id, score: probability that the label is 1."""
    return subword.score_documents(documents, subword.fit(documents, labels, "quality", config))


def keep_good(documents: DataFrame, labels: DataFrame, config: subword.Config = CONFIG,
              least: float = KEEP_AT) -> DataFrame:
    """The rows of ``documents`` (all columns) whose quality score is ``least`` or more."""
    return subword.keep_documents(documents, subword.fit(documents, labels, "quality", config), least)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(documents, labels)
    return scored.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
