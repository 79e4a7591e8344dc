"""Changes written back to stored tables: only the partitions they touch are written again, and each change is one commit (see ``sources.snapshots``).

A change that is run again gives the same table: scores and removals by what they are, likes because a batch of events is counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.operators import events as E
from leafsift.operators import listing
from leafsift.operators.samples import without_samples
from leafsift.sources.snapshots import Snapshots, batch_digest

SAMPLE_PARTS = 64


def article_store(spark: SparkSession, path: str) -> Snapshots:
    """Articles by day."""
    return Snapshots(spark, "article", path, F.substring("date", 1, 10))


def sample_store(spark: SparkSession, path: str) -> Snapshots:
    """Labelled blocks, dealt by id to a fixed number of partitions."""
    return Snapshots(spark, "main_content_feat", path, F.pmod("id", F.lit(SAMPLE_PARTS)))


def store_scores(store: Snapshots, scores: DataFrame) -> None:
    """Write ``scores(id, score)`` into the stored articles, day by day."""
    store.change(scores, lambda rows: listing.set_scores(rows, scores))


def store_likes(store: Snapshots, events: DataFrame, batch: tuple[str, int] | None = None) -> bool:
    """Add the like events to ``n_like`` of the stored articles, day by day; False if that batch has been added before.

    A batch is known by its source and number, which rises, or else by its events.
    """
    liked = E.opinions(events).filter(F.col("y") == 1)
    add = lambda rows: E.add_likes(rows, events).withColumn("n_like", F.col("n_like").cast("int"))
    return store.change(liked, add, batch or batch_digest(events, "id", "name", "time", "evt_attr"))


def append_samples(store: Snapshots, samples: DataFrame) -> None:
    store.append(samples)


def remove_samples(store: Snapshots, removed: DataFrame) -> None:
    """Delete the labelled blocks listed in ``removed(id)``."""
    store.change(removed, lambda rows: without_samples(rows, removed))
