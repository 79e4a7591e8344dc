"""Streams over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from leafsift.operators import events as E
from leafsift.sources.schemas import ARTICLE_EVENT


def event_stream(spark: SparkSession, path: str, schema: str = ARTICLE_EVENT, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def intake(events: DataFrame, accepted_path: str, rejected_path: str, checkpoint: str) -> DataStreamWriter:
    """Route events: known names to one table, the rest to another.

    A batch that is run again after a failure overwrites its own folder, so no row
    is stored twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        E.accepted(batch).write.mode("overwrite").parquet(f"{accepted_path}/batch={number}")
        E.rejected(batch).write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    return available(events, checkpoint).foreachBatch(store)


def hourly_opinions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Opinions per article and hour; an hour's state is dropped once the watermark passes it."""
    kept = events.filter(F.col("name").isin(*E.OPINIONS)).withWatermark("time", late)
    rows = kept.select("time", "name", E.article_id(F.col("evt_attr")).alias("id")).filter(F.col("id").isNotNull())
    return rows.groupBy(F.window("time", "1 hour"), "id", "name").agg(F.count(F.lit(1)).alias("n"))


def hourly_counters(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per article, name and hour; state is dropped once the watermark passes."""
    ids = F.explode(E.event_articles(F.col("name"), F.col("evt_attr")))
    rows = E.accepted(events).withWatermark("time", late).select("time", "name", ids.alias("id"))
    return rows.groupBy(F.window("time", "1 hour"), "id", "name").agg(F.count(F.lit(1)).alias("n"))


def append_hours(counts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Store each hour once, when it is complete, in a folder for its micro-batch."""

    def store(batch: DataFrame, number: int) -> None:
        hours = batch.select(F.col("window.start").alias("hour"), "id", "name", "n")
        hours.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return available(counts, checkpoint).outputMode("append").foreachBatch(store)


def recent_sums(hours: DataFrame, as_of: Column, back: int = 48) -> DataFrame:
    """``id, name, n`` over the stored hours that began in the last ``back`` hours before ``as_of``."""
    fresh = (F.col("hour") >= as_of - F.expr(f"interval {back} hours")) & (F.col("hour") < as_of)
    return hours.filter(fresh).groupBy("id", "name").agg(F.sum("n").alias("n"))


def counter_deltas(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Counters of every micro-batch in a folder of its own; ``total_counters`` adds them up."""

    def store(batch: DataFrame, number: int) -> None:
        E.counters(batch).drop("ctr").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return available(events, checkpoint).foreachBatch(store)


def total_counters(deltas: DataFrame) -> DataFrame:
    summed = deltas.groupBy("id").agg(*[F.sum(f"n_{n}").cast("bigint").alias(f"n_{n}") for n in E.EVENT_NAMES])
    return summed.withColumn("ctr", F.when(F.col("n_show") > 0, F.col("n_click") / F.col("n_show")))


def feedback_rows(events: DataFrame, articles: DataFrame, columns: list[str], path: str, checkpoint: str) -> DataStreamWriter:
    """Opinions joined with the article table, appended batch by batch."""

    def store(batch: DataFrame, number: int) -> None:
        E.feedback(batch, articles, columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return available(events, checkpoint).foreachBatch(store)


def available(stream: DataFrame, checkpoint: str) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)


def run_to_end(writer: DataStreamWriter) -> None:
    """Process everything available, then stop."""
    query = writer.start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
