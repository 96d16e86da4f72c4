"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before kept. Between stages the documents are written as
Parquet and read again, so a lost executor costs no more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from docaudit.session import settled, tune


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 6)."""
    tune(spark)
    return quality_rules.without_rejected(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts (operator 2)."""
    tune(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 4)."""
    tune(spark)
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document occurs as often as it is taken (operator 1)."""
    tune(spark)
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences (operator 3)."""
    tune(spark)
    pieces = packing.pack_documents(docs, packing.default_tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality_rules", drop_rejected),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix),
    ("packing", pack),
]

ORACLE_SQL = None  # robust estimates, sampling and tokenising are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
