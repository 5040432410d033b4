"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A toxic remark may be a few words in a long text, so the bag is a passage of
eight words: its lower-cased words and character n-grams are averaged, and a
text is as toxic as its most toxic passage.  Vectors and softmax are trained
jointly (see ``subword``); a misspelling never seen shares most of its
character n-grams with the words it comes from.

Labels are learned only outside the held-out fold, from at most
``Config.max_train_per_class`` rows of each class.  Defined results as in
``quality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subword
from .common import held_out

CONFIG = subword.Config(passage=8)
TOXIC_AT = 0.5


def score_toxicity(documents: DataFrame, labels: DataFrame, config: subword.Config = CONFIG) -> DataFrame:
    """doc_id, score: probability that the label is 1."""
    return subword.score_documents(documents, subword.fit(documents, labels, "toxic", config))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(documents, labels)
    return scored.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
