"""A corpus from documents: toxic texts go, copies and near copies once, sources mixed to their weights, texts as token ids.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each to the shared folder and reads it back, so
a lost executor costs no more than the stage at hand. A stage judges its own input: the mix weighs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import byte_bpe, exact_dedup, jaccard_join, mixture, toxicity
from cellweave.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cutoff; learnt from docs and the labels table."""
    return toxicity.unoffensive(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar shingle sets: the one of least id."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixture.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their number and digest, and the digest of the bytes they decode to."""
    return byte_bpe.encoded(docs, byte_bpe.default_ranks())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: The classifier, the components and the merges are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
