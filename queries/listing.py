"""Listing, paging and candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafsift.operators import listing as L
from leafsift.plans.paging import Place, page_by_day
from leafsift.session import scratch_path
from leafsift.sources.tables import append_articles
from queries import registrar
from queries import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

_A = f"WITH {V.SQL_ARTICLES}"
_AT = f"WITH {V.SQL_ARTICLES}, {V.SQL_TAGS}"
_DEFAULT = "left(date, 10) DESC, coalesce(score, 0) DESC, md5(id::VARCHAR)"


def _show(rows):
    return rows.select("id", "title", "date", "score")


_PICK = " SELECT id, title, date, score FROM articles "


@query("l01_page", _AT + _PICK + f"WHERE link LIKE '%.example.com%' AND id IN (SELECT article_id FROM tags WHERE name = 'fr') ORDER BY {_DEFAULT} LIMIT 10 OFFSET 10")
def l01(spark, sf):
    return _show(L.list_articles(V.articles(spark, sf), V.tags(spark, sf), site=".example.com", tag="fr", offset=10))


@query("l01_combined_filters", _AT + _PICK + f"WHERE link LIKE '%src4%' AND n_like IS NOT NULL AND n_like > 0 AND id IN (SELECT article_id FROM tags WHERE name = 'en') ORDER BY {_DEFAULT} LIMIT 10")
def l01_combined(spark, sf):
    return _show(L.list_articles(V.articles(spark, sf), V.tags(spark, sf), site="src4", liked=True, tag="en"))


@query("l02_by_site", _A + _PICK + "WHERE link LIKE '%src7.%'")
def l02(spark, sf):
    return _show(L.by_site(V.articles(spark, sf), "src7."))


@query("l02_by_site_wildcards", _A + _PICK + "WHERE link LIKE '%src_.example%9%'")
def l02_wild(spark, sf):
    return _show(L.by_site(V.articles(spark, sf), "src_.example%9", wildcards=True))


@query("l03_favourites", _A + _PICK + "WHERE n_like IS NOT NULL AND n_like > 0")
def l03(spark, sf):
    return _show(L.favourites(V.articles(spark, sf)))


@query("l04_default_order", _A + _PICK + f"ORDER BY {_DEFAULT} LIMIT 10 OFFSET 20")
def l04(spark, sf):
    return _show(L.list_articles(V.articles(spark, sf), offset=20))


def _by_day(spark, sf, at):
    """The articles in one folder per day, and the place of the row at an offset."""
    path = scratch_path(spark, "articles-by-day")
    append_articles(V.articles(spark, sf), path)
    row = L.list_articles(V.articles(spark, sf), offset=at, limit=1).select("date", "score", "id").first()
    return path, row and Place(*row)


@query("l04_page_by_day", _A + _PICK + f"ORDER BY {_DEFAULT} LIMIT 10 OFFSET 40")
def l04_by_day(spark, sf):
    path, place = _by_day(spark, sf, 39)
    return _show(page_by_day(spark, path, place))


@query("l07_previous_by_day", _A + f", kept AS (SELECT * FROM articles WHERE link LIKE '%src4%'), place AS (SELECT left(date, 10) AS d, coalesce(score, 0) AS s, md5(id::VARCHAR) AS m FROM articles ORDER BY {_DEFAULT} LIMIT 1 OFFSET 300)"
       " SELECT id, title, date, score FROM kept, place WHERE left(date, 10) > d OR (left(date, 10) = d AND (coalesce(score, 0) > s OR (coalesce(score, 0) = s AND md5(id::VARCHAR) < m)))"
       " ORDER BY left(date, 10), coalesce(score, 0), md5(id::VARCHAR) DESC LIMIT 10")
def l07_previous(spark, sf):
    path, place = _by_day(spark, sf, 300)
    page = page_by_day(spark, path, place, back=True, where=lambda rows: L.by_site(rows, "src4"))
    return _show(page if place else page.limit(0))  # nothing stands before a row that is not there


@query("l05_recommended_order", _A + _PICK + "ORDER BY coalesce(score, 0) DESC, id LIMIT 10")
def l05(spark, sf):
    return _show(L.list_articles(V.articles(spark, sf), recommended=True))


@query("l06_caller_order", _A + _PICK + "ORDER BY date ASC NULLS FIRST, score DESC NULLS LAST, id LIMIT 10")
def l06(spark, sf):
    return _show(L.list_articles(V.articles(spark, sf), order_by="date asc, score desc"))


@query("l07_third_page", _A + _PICK + "ORDER BY coalesce(score, 0) DESC, id LIMIT 10 OFFSET 20")
def l07(spark, sf):
    _, second = L.page_offsets(0)
    _, third = L.page_offsets(second)
    return _show(L.list_articles(V.articles(spark, sf), recommended=True, offset=third))


@query("l07_page_after_row", _A + _PICK + "WHERE coalesce(score, 0) < 0.5 OR (coalesce(score, 0) = 0.5 AND id > 40) ORDER BY coalesce(score, 0) DESC, id LIMIT 10")
def l07_after(spark, sf):
    return _show(L.page_after(V.articles(spark, sf), 0.5, 40))


@query("l08_by_id", _A + _PICK + "WHERE id = 17")
def l08(spark, sf):
    return _show(L.by_id(V.articles(spark, sf), 17))


@query("l08_page_by_id", "SELECT page_id AS id, url AS link FROM pages WHERE page_id = 23")
def l08_page(spark, sf):
    return L.by_id(V.rss(spark, sf), 23).select("id", "link")


@query("l09_random_row", _A + _PICK + "ORDER BY md5(id || '-42'), id LIMIT 1")
def l09(spark, sf):
    return _show(L.random_row(V.articles(spark, sf), 42))


_RECENT = f"score > 0.1 AND strptime(date, '%Y-%m-%d %H:%M:%S') > TIMESTAMP '{V.AS_OF_TEXT}' - INTERVAL 48 HOUR"


@query("l10_candidates", _A + _PICK + f"WHERE {_RECENT}")
def l10(spark, sf):
    return _show(L.candidates(V.articles(spark, sf), V.as_of()))


@query("l11_top_candidates", _A + _PICK + f"WHERE {_RECENT} ORDER BY score DESC, id LIMIT 50")
def l11(spark, sf):
    return _show(L.best(L.candidates(V.articles(spark, sf), V.as_of()), 50))


@query("x01_shown_fields", _A + " SELECT id, regexp_extract(link, '^[a-z]+://([^/?#]*)', 1) AS site, printf('%.3f', coalesce(score, -1.0)) AS score FROM articles")
def x01(spark, sf):
    from leafsift.functions.text import three_decimals
    from leafsift.functions.urls import site

    return V.articles(spark, sf).select("id", site(F.col("link")).alias("site"), three_decimals(F.col("score")).alias("score"))
