"""The corpus pipeline: toxicity, near-duplicates, repeated passages, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept and returns a DataFrame
with the columns of `documents`; the last returns packed pieces. n_chars follows the text where a stage cuts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, stored
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.simhash import one_of_each
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.toxicity import fit, held_out, score

#: Documents with at least this calibrated probability of label 1 are rejected.
TOXIC = 0.3


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of this corpus, doesn't reject."""
    model = fit(docs, load(spark, sf_dir, "labels"), train=~held_out())
    return score(docs, model).where(F.col("toxicity") < TOXIC).drop("toxicity")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are similar by 0.8 or more."""
    return one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one, or earlier in themselves."""
    return _sized(remove_repeats(docs, spans_col=None))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3 in turn; a document is a row for each time that the mix takes it."""
    return _sized(mix(docs, places=False))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the classifier nor the tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
