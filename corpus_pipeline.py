"""A corpus made ready for training: five stages, each by one operator of ``leafsift.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. Both quality stages learn from the labelled rows
of the whole ``documents`` table, so that what an earlier stage took away does not bias them. Empty tables give empty
tables; a null text is an empty one; what each operator does with nulls, ties and repeated rows is in its module.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.llm import packing, passages, quality_rules, secret_scans, simhash
from leafsift.llm.batches import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage classifier scores below one half go."""
    model = passages.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learn=F.lit(True))
    return passages.keep(docs, model)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the boosted trees score below one half go."""
    forest = quality_rules.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, forest)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay."""
    return secret_scans.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, and the place of each in sequences of 4096 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=4096)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: No SQL can say what a fitted model, a tokenizer or a genetic algorithm returns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
