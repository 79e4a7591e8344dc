"""Articles to tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.operators.joins import untagged
from leafsift.operators.keywords import tags_with_fallback
from leafsift.operators.vectors import corpus_idf
from leafsift.sources.tables import new_tags


def tag_articles(articles: DataFrame, stored: DataFrame, k: int = 10, idf: DataFrame | None = None) -> DataFrame:
    """New ``name, article_id`` pairs for articles that have no tag yet.

    Word weights come from ``idf``, by default that of all ``articles``, so an article's tags do not depend on
    which others are still untagged.
    """
    own = idf is None
    idf = corpus_idf(articles, "text") if own else idf
    found = tags_with_fallback(untagged(articles, stored), "id", "text", k, idf, complete=own)
    return new_tags(found.select(F.col("word").alias("name"), F.col("id").alias("article_id")), stored)
