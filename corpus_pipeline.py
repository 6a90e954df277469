"""Documents to packed training sequences: quality classifier, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import binpack, mixing, quality, shinglesim
from lectern.llm.common import crc_remainder, materialise, release, written
from lectern.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled rows among them that are not held out."""
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), held_out, threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose five-word shingles are 0.8 or more alike."""
    return shinglesim.keep_one(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, weights=(1, 2, 3), cap=3.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 tokens."""
    return binpack.pack(docs, tokenizer_path(), capacity=4096, end_id=1)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of the documents. Once a stage is stored, what it was made from is deleted."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, mark, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
