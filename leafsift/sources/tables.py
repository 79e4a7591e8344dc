"""Reading and writing the stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.sources.schemas import TABLES


def create_table(spark: SparkSession, name: str, path: str | None = None, stored_as: str | None = None) -> None:
    """Create a declared table, under its own name or another, unless it exists."""
    columns = ", ".join(f"`{c.strip().split(' ', 1)[0]}` {c.strip().split(' ', 1)[1]}" for c in TABLES[name].split(","))
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{stored_as or name}` ({columns}) USING parquet{where}")


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table with its declared schema; empty when nothing was written yet."""
    try:
        return spark.read.schema(TABLES[name]).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], TABLES[name])


def shaped(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with exactly the declared columns; missing ones are null."""
    declared = [part.strip().split(" ", 1) for part in TABLES[name].split(",")]
    return rows.select(
        *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in declared]
    )


def append(rows: DataFrame, name: str, path: str, partition_by: list[str] | None = None) -> None:
    writer = shaped(rows, name).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_articles(articles: DataFrame, path: str) -> None:
    """Append articles in one folder per day, so that recent ones are found by partition."""
    dated = shaped(articles, "article").withColumn("day", F.substring("date", 1, 10))
    dated.write.mode("append").partitionBy("day").parquet(path)


def write_bucketed(rows: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store rows bucketed by ``key`` and read them again; joins on it then leave them in place.

    Every task writes the files of its own rows, so nothing is shuffled.
    """
    writer = rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return rows.sparkSession.table(table)


def new_tags(found: DataFrame, stored: DataFrame) -> DataFrame:
    """``name, article_id`` pairs that are not stored yet, each once."""
    pairs = found.select("name", "article_id").distinct()
    return pairs.join(stored.select("name", "article_id"), ["name", "article_id"], "left_anti")


def insert_tags(found: DataFrame, path: str) -> None:
    spark = found.sparkSession
    fresh = new_tags(found, read_table(spark, "article_tags", path))
    append(fresh.withColumn("id", F.xxhash64("name", "article_id")), "article_tags", path)


def ranked_json(ranked: DataFrame, updated_at: str) -> DataFrame:
    """One JSON document per ranked article, each with the update time."""
    fields = [c for c in ranked.columns if c != "rank"]
    document = F.to_json(F.struct(F.lit(updated_at).alias("updateTime"), F.struct(*fields).alias("article")))
    return ranked.select("rank", document.alias("value"))


def ranked_document(ranked: DataFrame, updated_at: str, top: int = 5000) -> DataFrame:
    """The first ``top`` ranks as one JSON document, which one task gathers."""
    fields = [c for c in ranked.columns if c != "rank"]
    rows = F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("a"))))
    return ranked.filter(F.col("rank") <= top).agg(
        F.to_json(
            F.struct(F.lit(updated_at).alias("updateTime"), F.transform(rows, lambda r: r["a"]).alias("articles"))
        ).alias("value")
    )


def write_ranked(ranked: DataFrame, updated_at: str, path: str, top: int = 5000) -> None:
    ranked_document(ranked, updated_at, top).write.mode("overwrite").text(path)
