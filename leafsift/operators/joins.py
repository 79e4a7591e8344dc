"""Incremental and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "id", done_key: str = "id") -> DataFrame:
    """Rows whose key is not in ``done``."""
    return rows.join(done.select(F.col(done_key).alias(key)), key, "left_anti")


def untagged(articles: DataFrame, tags: DataFrame, null_aware: bool = False) -> DataFrame:
    """Articles without a tag.

    ``null_aware`` gives SQL's ``NOT IN``: a single tag row without an article makes
    the result empty. Written as an anti join and one flag, so the tag table need
    not be broadcast as Spark's own null-aware join would.
    """
    found = unprocessed(articles, tags.filter(F.col("article_id").isNotNull()), "id", "article_id")
    if not null_aware:
        return found
    nulls = tags.agg(F.count_if(F.col("article_id").isNull())).scalar()
    return found.filter(nulls == 0)


def with_tag(articles: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """Articles that carry the tag."""
    carriers = tags.filter(F.col("name") == name).select(F.col("article_id").alias("id"))
    return articles.join(carriers, "id", "left_semi")


def tags_of(articles: DataFrame, tags: DataFrame) -> DataFrame:
    """Articles with their sorted tag list; an empty list if there is none."""
    lists = tags.groupBy(F.col("article_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("tags"))
    return articles.join(lists, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def with_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles whose id is listed in ``ids(id)``."""
    return articles.join(ids.select("id"), "id", "left_semi")
