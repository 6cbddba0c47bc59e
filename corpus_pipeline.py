"""From raw documents to packed sequences, in stages written to the shared folder.

Toxic documents go, then exact copies, near copies (one of each group stays) and documents
that hold benchmark passages; what is left is packed into sequences of 1024 tokens. Every
stage works on all rows that the one before kept and returns them with all their columns;
the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm.common import table, tune, written
from cuesheet.llm.decontaminate import drop_contaminated
from cuesheet.llm.exact_dedup import drop_copies
from cuesheet.llm.ngram_join import drop_near_copies
from cuesheet.llm.packing import pack, token_pieces
from cuesheet.llm.toxicity import drop_toxic, learn


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return drop_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return drop_copies(docs, stored=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return drop_near_copies(docs, stored=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The learned scores and the fitted patterns have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    The stages that drop copies rely on it: they know rows by their places in those files.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
