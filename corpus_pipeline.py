"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm import exact_dedup, minhash, mixing, packing, toxicity
from tideglass.llm.common import documents, written
from tideglass.llm.language import fold

#: What a worker remembers and has in parts when it packs: less than by default, as its memory is shared with the stages before.
MEMO, CHARS = 400_000, 1_000_000
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the limit. The network learns from labelled documents outside the held-out third."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), toxicity.FOLDS) != toxicity.HELD)
    return toxicity.score(docs, toxicity.learn(docs, labels)).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id: five words, a similarity of 0.8 or more.

    42 bands of 6 minima: a pair at 0.8 shares a band with probability 1 - (1 - 0.8^6)^42 = 0.999997.
    """
    return minhash.near_dedup(docs, percent=80, bands=42, rows=6)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document that is taken twice is two rows."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and their places in sequences of 4096 tokens at most; packing.assembled() joins them."""
    return packing.pack_documents(docs, ids=True, memo=MEMO, chars=CHARS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training a network, components and a fitted plan are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
