"""Raw pages to ``rss`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions import html as H
from leafsift.functions.dates import asctime
from leafsift.operators.tree import with_page_fields


def project_pages(pages: DataFrame, crawled_at: Column, id_col: str = "page_id") -> DataFrame:
    """``id, title, link, desc, body, html, date`` of each page; ``crawled_at`` dates them. ``html`` is the page as it came."""
    return with_page_fields(pages.withColumn("_date", asctime(crawled_at))).select(
        F.col(id_col).alias("id"),
        "title",
        F.col("url").alias("link"),
        F.col("description").alias("desc"),
        H.page_body(F.col("html")).alias("body"),
        "html",
        F.col("_date").alias("date"),
    )


def route_by_type(responses: DataFrame) -> DataFrame:
    """Adds ``route``: json or html; responses without a type and images are dropped."""
    kind = F.lower("content_type")
    route = F.when(kind == "application/json", "json").when(~F.startswith(kind, F.lit("image")), "html")
    return responses.withColumn("route", route).filter(F.col("route").isNotNull())
