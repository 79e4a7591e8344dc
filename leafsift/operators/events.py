"""The event log: feedback joins and engagement counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted event names and the two that carry an opinion.
EVENT_NAMES = ("show", "click", "like", "hate")
OPINIONS = ("like", "hate")


def article_id(attrs: Column) -> Column:
    """``article_id`` of the event JSON, number or text; null if it is neither."""
    return F.get_json_object(attrs, "$.article_id").try_cast("bigint")


def event_articles(name: Column, attrs: Column) -> Column:
    """Every article an event names: a comma-separated list for show, one id otherwise."""
    listed = F.split(F.get_json_object(attrs, "$.articles"), ",")
    many = F.filter(F.transform(listed, lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull())
    one = F.filter(F.array(article_id(attrs)), lambda x: x.isNotNull())
    return F.when(name == "show", F.coalesce(many, F.array().cast("array<bigint>"))).otherwise(one)


def accepted(events: DataFrame) -> DataFrame:
    return events.filter(F.col("name").isin(*EVENT_NAMES))


def rejected(events: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("name").isin(*EVENT_NAMES), F.lit(False))
    return events.filter(~known)


def attrs_json(attrs: Column) -> Column:
    """A map of request arguments as the stored JSON text."""
    return F.to_json(attrs)


def opinions(events: DataFrame) -> DataFrame:
    """``id, y, n``: how often each article was liked (1) or hated (-1).

    Counting first keeps an article with a third of all events from becoming one
    hot join key: the sums are combined before any shuffle.
    """
    kept = events.filter(F.col("name").isin(*OPINIONS))
    y = F.when(F.col("name") == "like", 1).otherwise(-1)
    rows = kept.select(article_id(F.col("evt_attr")).alias("id"), y.alias("y")).filter(F.col("id").isNotNull())
    return rows.groupBy("id", "y").agg(F.count(F.lit(1)).alias("n"))


COPIES_PER_ROW = 10_000


def repeated(rows: DataFrame, keys: list[str], n_col: str = "n") -> DataFrame:
    """Each row ``n`` times. A large ``n`` is cut into parts that go to different tasks first."""
    n, size = F.col(n_col), F.lit(COPIES_PER_ROW)
    last = F.floor((n - 1) / size)
    parts = rows.filter(n > 0).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    apart = parts.repartition(*keys, "_part")
    copies = F.sequence(F.lit(1).cast("bigint"), F.least(size, n - F.col("_part") * size).cast("bigint"))
    return apart.withColumn("_copy", F.explode(copies)).drop("_copy", "_part", n_col)


def feedback(events: DataFrame, articles: DataFrame, columns: list[str]) -> DataFrame:
    """``id, y`` and article columns, one row per opinion event."""
    return repeated(opinions(events).join(articles.select("id", *columns), "id"), ["id", "y"])


def latest_opinions(events: DataFrame) -> DataFrame:
    """``id, y`` by the newest opinion on each article."""
    kept = events.filter(F.col("name").isin(*OPINIONS))
    rows = kept.select(
        article_id(F.col("evt_attr")).alias("id"),
        F.unix_micros("time").alias("_t"),
        F.when(F.col("name") == "like", 1).otherwise(-1).alias("y"),
    ).filter(F.col("id").isNotNull())
    newest = rows.groupBy("id").agg(
        F.max(F.when(F.col("y") == 1, F.col("_t"))).alias("_l"), F.max(F.when(F.col("y") == -1, F.col("_t"))).alias("_h")
    )
    liked = F.col("_h").isNull() | (F.col("_l") >= F.col("_h"))
    return newest.select("id", F.when(liked, 1).otherwise(-1).alias("y"))


def recent(events: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    after = F.col("time") > as_of - F.expr(f"interval {hours} hours")
    return events.filter(after & (F.col("time") <= as_of))


def counters(events: DataFrame) -> DataFrame:
    """``id, n_show, n_click, n_like, n_hate, ctr`` per article."""
    ids = F.explode(event_articles(F.col("name"), F.col("evt_attr")))
    rows = accepted(events).select("name", ids.alias("id"))

    def times(name: str) -> Column:
        return F.sum(F.when(F.col("name") == name, 1).otherwise(0))

    counted = rows.groupBy("id").agg(*[times(n).alias(f"n_{n}") for n in EVENT_NAMES])
    return counted.withColumn("ctr", F.when(F.col("n_show") > 0, F.col("n_click") / F.col("n_show")))


def add_likes(articles: DataFrame, events: DataFrame) -> DataFrame:
    """Articles with the like events added to ``n_like``; a missing count is 0."""
    likes = opinions(events).filter(F.col("y") == 1).select("id", F.col("n").alias("_n"))
    added = F.coalesce("n_like", F.lit(0)) + F.coalesce("_n", F.lit(0))
    touched = F.when(F.col("_n").isNotNull(), added).otherwise(F.col("n_like"))
    return articles.join(likes, "id", "left").withColumn("n_like", touched).drop("_n")
