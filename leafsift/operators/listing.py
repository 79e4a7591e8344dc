"""Listing, paging and candidate queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.dates import parse_date_text
from leafsift.operators.joins import with_tag

PAGE_SIZE = 10
SORTABLE = ("id", "title", "link", "date", "score", "n_like")


def by_site(articles: DataFrame, site: str, wildcards: bool = False) -> DataFrame:
    """Articles whose link contains ``site``; ``wildcards`` lets % and _ act as in LIKE."""
    link = F.col("link")
    return articles.filter(link.like(f"%{site}%") if wildcards else F.contains(link, F.lit(site)))


def favourites(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("n_like").isNotNull() & (F.col("n_like") > 0))


def score_or_zero() -> Column:
    return F.coalesce(F.col("score"), F.lit(0.0))


def shuffled() -> Column:
    return F.md5(F.col("id").cast("string").cast("binary"))


def default_order() -> list[Column]:
    """Newest day, best score, then a stable shuffle by hashed id."""
    return [F.substring("date", 1, 10).desc(), score_or_zero().desc(), shuffled().asc()]


def recommended_order() -> list[Column]:
    return [score_or_zero().desc(), F.col("id").asc()]


def caller_order(text: str) -> list[Column]:
    """``column [asc|desc], ...`` over the sortable columns; anything else is refused."""
    order = []
    for part in text.split(","):
        name, _, direction = part.strip().partition(" ")
        direction = direction.strip().lower() or "asc"
        if name not in SORTABLE or direction not in ("asc", "desc"):
            raise ValueError(f"cannot order by {part.strip()!r}")
        order.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_first())
    return [*order, F.col("id").asc()]


def list_articles(
    articles: DataFrame,
    tags: DataFrame | None = None,
    site: str | None = None,
    liked: bool = False,
    tag: str | None = None,
    recommended: bool = False,
    order_by: str | None = None,
    offset: int = 0,
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """One page of articles: filters are combined, then ordered and cut."""
    if site is not None:
        articles = by_site(articles, site)
    if liked:
        articles = favourites(articles)
    if tag is not None:
        if tags is None:
            raise ValueError("a tag filter needs the tag table")
        articles = with_tag(articles, tags, tag)
    if recommended:
        order = recommended_order()
    elif order_by is not None:
        order = caller_order(order_by)
    else:
        order = default_order()
    return articles.orderBy(*order).offset(offset).limit(limit)


def page_offsets(offset: int, size: int = PAGE_SIZE) -> tuple[int, int]:
    """Offsets of the previous and the next page."""
    return max(0, offset - size), offset + size


def page_after(articles: DataFrame, score: float, last_id: int, limit: int = PAGE_SIZE) -> DataFrame:
    """The next page in recommended order after a known row; deep pages cost no more than the first."""
    later = (score_or_zero() < score) | ((score_or_zero() == score) & (F.col("id") > last_id))
    return articles.filter(later).orderBy(*recommended_order()).limit(limit)


def by_id(rows: DataFrame, id_: int) -> DataFrame:
    return rows.filter(F.col("id") == id_)


def random_row(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """One arbitrary row, the same for the same seed: the smallest hash of key and seed."""
    mixed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))
    return rows.orderBy(mixed, key).limit(1)


def candidates(articles: DataFrame, as_of: Column, hours: int = 48, min_score: float = 0.1) -> DataFrame:
    """Recently dated articles with a score above the bar."""
    fresh = parse_date_text(F.col("date")) > as_of - F.expr(f"interval {hours} hours")
    return articles.filter((F.col("score") > min_score) & fresh)


def best(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(*recommended_order()).limit(n)


def to_score(articles: DataFrame, rescore_all: bool = False) -> DataFrame:
    """Articles without a score yet; zero counts as none."""
    return articles if rescore_all else articles.filter(score_or_zero() == 0)


def set_scores(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Articles with the scores of ``scores(id, score)`` where there is one."""
    new = scores.select("id", F.col("score").alias("_new"))
    return articles.join(new, "id", "left").withColumn("score", F.coalesce("_new", "score")).drop("_new")
