"""A corpus in five stages: toxic texts go, copies go, near copies go, sources are mixed, sequences are packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from factorloom.llm.scratch import cut


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.3; the network learns from the labelled rows of the stage's own input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, labels, threshold=0.3)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one with the smallest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8 or more, the one with the smallest doc_id."""
    return jaccard_join.keep_one_of_each(docs, words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice has two rows."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece of a document, with its ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram jaccard join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: A trained network decides in the first stage and a tokenizer in the last; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are stored before the next reads them.

    Null, empty and blank texts score as clean, one of them stays in exact dedup (and one blank text), they
    are near copies of nothing, have no words and so are never taken by the mix. Rows with null or
    repeated keys are told apart by their texts. A null source is a source. Extra columns are carried
    through the first four stages, whatever their names. Empty tables give an empty table; without labels
    of both classes no text counts as toxic.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
