"""Streams over newly stored pages and URLs.

What earlier batches stored is kept in runs (``sources/runs.py``): a batch reads the buckets that its own ids, words or URLs fall into, from
a number of runs that grows with the logarithm of the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leafsift.functions.urls import without_fragment
from leafsift.operators.vectors import document_frequency, document_words
from leafsift.plans.extract import extract_articles
from leafsift.plans.tagging import tag_articles
from leafsift.session import release, stored
from leafsift.sources.runs import Runs
from leafsift.sources.schemas import TABLES
from leafsift.sources.tables import shaped
from leafsift.streaming.feedback import available

SEEN_BUCKETS = 256
#: The word under which the number of documents is kept; no word is empty.
ALL_DOCUMENTS = ""


def seen_urls(spark: SparkSession, path: str, buckets: int = SEEN_BUCKETS) -> Runs:
    """The stored URLs, each once."""
    return Runs(spark, path, "url string", "url", buckets)


def stored_tags(spark: SparkSession, path: str, buckets: int = SEEN_BUCKETS) -> Runs:
    """The stored tags, dealt by article."""
    return Runs(spark, path, TABLES["article_tags"], "article_id", buckets)


def word_frequencies(spark: SparkSession, path: str, buckets: int = SEEN_BUCKETS) -> Runs:
    """``word, df``: in how many stored documents each word stands. Batches add what they saw; sums are taken on merging and on reading."""
    return Runs(spark, path, "word string, df bigint", "word", buckets, combine=lambda rows: rows.groupBy("word").agg(F.sum("df").alias("df")))


def add_frequencies(store: Runs, number: int, docs: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """Add a batch of documents; then ``word, df, idf`` of the batch's words over all documents up to this batch."""
    counted = stored(document_words(docs, id_col, text_col), "words")
    size = counted.agg(F.lit(ALL_DOCUMENTS).alias("word"), F.count(F.lit(1)).alias("df"))
    fresh = stored(document_frequency(counted).unionByName(size), "frequencies")
    sums = stored(store.combine(store.before(number, fresh).unionByName(fresh)), "frequencies")
    store.append(number, fresh)
    release(counted, fresh)
    n = sums.filter(F.col("word") == ALL_DOCUMENTS).agg(F.coalesce(F.max("df"), F.lit(0))).scalar()
    return sums.filter(F.col("word") != ALL_DOCUMENTS).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def pages_to_tags(
    rss: DataFrame, model: DataFrame, articles_path: str, tags_path: str, checkpoint: str, idf_path: str | None = None, frequencies_path: str | None = None
) -> DataStreamWriter:
    """Extract and tag each batch of new pages with the batch jobs.

    The stream's checkpoint says which pages are done, so no anti join is needed. Word weights come from the stored idf table, so that tags equal
    those of the batch job with that table, or from frequencies kept up batch by batch at ``frequencies_path``, so that they equal those of the
    batch job with the idf of all articles so far. Of the known tags only those of the batch's articles are read.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found, _ = extract_articles(batch, model)
        target = f"{articles_path}/batch={number}"
        found.write.mode("overwrite").parquet(target)
        articles = spark.read.schema(found.schema).parquet(target)
        idf = spark.read.parquet(idf_path) if idf_path else None
        if frequencies_path:
            idf = add_frequencies(word_frequencies(spark, frequencies_path), number, articles)
        tags = stored_tags(spark, tags_path)
        known = tags.before(number, articles.select(F.col("id").alias("article_id")))
        tags.append(number, shaped(tag_articles(articles, known, idf=idf), "article_tags"))

    return available(rss, checkpoint).foreachBatch(store)


def new_urls(urls: DataFrame, seen_path: str, checkpoint: str, buckets: int = SEEN_BUCKETS) -> DataStreamWriter:
    """Store URLs never seen before, without fragments. What was seen is a table, not stream state, so state stays bounded."""

    def store(batch: DataFrame, number: int) -> None:
        seen = seen_urls(batch.sparkSession, seen_path, buckets)
        fresh = stored(batch.select(without_fragment(F.col("url")).alias("url")).distinct(), "urls")
        seen.append(number, fresh.join(seen.before(number, fresh), "url", "left_anti"))
        release(fresh)

    return available(urls, checkpoint).foreachBatch(store)
