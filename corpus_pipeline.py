"""From raw documents to sharded training data: filter, dedup, decontaminate, mix and shard.

Each stage works on all that the one before kept. All but the last return the columns of ``documents``; the last adds
the shard. Columns come back as they were, whatever their names, and each stage says what it does with nulls, texts
without words and repeated rows. A document that the mix takes several times is that many rows. Stages meet in Parquet tables in the shared
folder, so that a lost executor repeats at most one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import decontam, minhash, mixing, quality, sharding
from rivulet.session import prepare, workspace


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.

    Documents without labels, with a null doc_id, and null or empty texts are judged like any other; repeated rows are
    judged alike. Without labels the heuristics alone train the scorer. No rows give no rows.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more).

    The smallest doc_id of a group stays; of rows with one doc_id the first by text. Rows with a null doc_id and texts
    without words are like nothing and stay. No rows give no rows.
    """
    return minhash.unique_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Texts without words contain nothing, items without words are in nothing; repeated rows stay or go together. An
    empty benchmark leaves all rows, no rows give none.
    """
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own; texts without words come once an epoch of their source; repeated rows share
    what is taken of them. No rows give no rows.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards; a column named shard is replaced.

    A null doc_id is a key like any other, rows that repeat a doc_id share a shard. No rows give no rows.
    """
    return sharding.assigned(docs)


STAGES = [
    ("quality classifier", classify),
    ("near dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("source mix", mix),
    ("sharding", shard),
]

# Training, near-duplicate classes and hashed draws are beyond SQL; the tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = workspace(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
