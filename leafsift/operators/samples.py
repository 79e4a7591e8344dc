"""Labelled blocks: collecting, removing and reviewing training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.operators.blocks import FEATURES_V1, fragment_features
from leafsift.operators.encoding import encode_blocks, with_block_entries
from leafsift.operators.linear import decision_values
from leafsift.operators.listing import random_row


def labelled_blocks(fragments: DataFrame, root_mode: str = "element") -> DataFrame:
    """``id, body, y`` with the six stored features; any label above 0 is 1, else -1."""
    features = fragment_features(fragments, "id", "body", root_mode).select(F.col("page_id").alias("id"), *FEATURES_V1)
    y = F.when(F.col("y") > 0, 1).otherwise(-1)
    return fragments.select("id", "body", y.alias("y")).join(features, "id", "left")


def without_samples(samples: DataFrame, removed: DataFrame) -> DataFrame:
    return samples.join(removed.select("id"), "id", "left_anti")


def training_rows(samples: DataFrame, root_mode: str = "element") -> DataFrame:
    """Sparse rows ``id, idx, value`` of every labelled block's full features."""
    features = fragment_features(samples, "id", "body", root_mode).withColumnRenamed("page_id", "id")
    return encode_blocks(features, ["id"])


def review(samples: DataFrame, model: DataFrame, seed: int) -> DataFrame:
    """One sample with its score and features."""
    one = random_row(samples.select("id", "body", "y"), seed)
    features = fragment_features(one, "id", "body").withColumnRenamed("page_id", "id")
    return one.select("id", "y").join(decision_values(with_block_entries(features), model), "id")
