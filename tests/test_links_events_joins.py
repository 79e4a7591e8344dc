import datetime
import json

import pytest
from pyspark.sql import functions as F

from leafsift.operators import events as E
from leafsift.operators import joins as J
from leafsift.operators import links as L
from leafsift.operators import listing
from leafsift.operators.encoding import require_frame
from leafsift.operators.projection import route_by_type
from leafsift.sources import fixed, tables
from leafsift.sources.fixed import ALLOWED_DOMAINS, URL_RULES


def test_rules_first_and_any_prefix(spark):
    rows = [
        ("https://www.leiphone.com/news/1", True, True),
        ("https://www.leiphone.com/latest/1", False, True),
        ("https://www.leiphone.com/x", False, False),
        ("https://m.arxiv.org/abs/1", True, True),
        ("https://arxiv.org/pdf/1", False, False),
        ("https://elsewhere.example.com/pdf/1", True, True),
    ]
    df = spark.createDataFrame(rows, "u string, f boolean, a boolean")
    got = df.select("f", "a", L.matches_rules(F.col("u"), URL_RULES).alias("gf"), L.matches_rules(F.col("u"), URL_RULES, "any").alias("ga"))
    assert all((r["f"], r["a"]) == (r["gf"], r["ga"]) for r in got.collect())


def test_domains_match_whole_labels(spark):
    rows = [("https://www.zhihu.com/", True), ("https://zhihu.com:8080/a", True), ("https://notzhihu.com/", False), ("https://zhihu.com.evil.org/", False)]
    df = spark.createDataFrame(rows, "u string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", L.in_domains(F.col("u"), ALLOWED_DOMAINS)).collect())


def test_json_and_image_responses(spark):
    rows = [
        (1, "http://h/a", "application/json", '{"u": "https://x.example.com/1", "v": "HTTP://y.example.com/2"}'),
        (2, "http://h/a", "text/html", "<a class=q href='/p?x=1&amp;y=2'>l</a><a name=n>no</a>"),
        (3, "http://h/a", "image/gif", "<a href='/no'>"),
        (4, "http://h/a", None, "<a href='/no'>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, content_type string, html string")
    got = L.resolve_links(L.response_links(df)).select("page_id", "target").collect()
    assert sorted(map(tuple, got)) == [(1, "HTTP://y.example.com/2"), (1, "https://x.example.com/1"), (2, "http://h/p?x=1&y=2")]
    assert route_by_type(df).count() == 2


def test_images(spark):
    body = '<img src="a.png"><img src="" data-src="/b.png"><img src="data:xx"><img alt=q><IMG SRC=c.png>'
    df = spark.createDataFrame([(1, body, "http://h/d/e")], "id long, body string, link string")
    assert sorted(r["image_url"] for r in L.image_urls(df).collect()) == ["http://h/b.png", "http://h/d/a.png", "http://h/d/c.png"]


def test_frontier_counts_and_skips_seen(spark):
    pages = spark.createDataFrame(
        [(1, "https://arxiv.org/list", '<a href="/abs/1">a</a><a href="/pdf/1">b</a>'), (2, "https://arxiv.org/x", '<a href="/abs/1">a</a><a href="/abs/2">c</a>')],
        "page_id long, url string, html string",
    )
    seen = spark.createDataFrame([("https://arxiv.org/abs/2",)], "url string")
    rows = L.frontier(pages, URL_RULES, ALLOWED_DOMAINS, seen).collect()
    assert [tuple(r) for r in rows] == [("https://arxiv.org/abs/1", 2, 1)]


def test_seed_tables(spark):
    assert (fixed.url_rules(spark).count(), fixed.allowed_domains(spark).count(), fixed.start_urls(spark).count()) == (13, 21, 37)


AT = datetime.datetime(2024, 1, 1)


def events(spark, *rows):
    data = [(i, name, AT + datetime.timedelta(minutes=i), attr) for i, (name, attr) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, name string, time timestamp, evt_attr string")


def test_feedback_reads_every_id_form(spark):
    e = events(
        spark,
        ("like", '{"article_id": "7"}'),
        ("hate", '{"article_id": 7}'),
        ("like", '{"article_id": "x"}'),
        ("like", '{"_tid": "q"}'),
        ("like", "not json"),
        ("click", '{"article_id": 7}'),
        ("like", '{"article_id": 7}'),
        ("like", '{"article_id": 99}'),
    )
    a = spark.createDataFrame([(7, "t"), (8, "u")], "id long, title string")
    rows = sorted((r["id"], r["y"], r["title"]) for r in E.feedback(e, a, ["title"]).collect())
    assert rows == [(7, -1, "t"), (7, 1, "t"), (7, 1, "t")]
    latest = E.latest_opinions(e).filter("id = 7").collect()
    assert latest[0]["y"] == 1


def test_many_copies_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(E, "COPIES_PER_ROW", 3)
    rows = spark.createDataFrame([(1, 1, 7), (2, 1, 3), (3, -1, 1), (4, 1, 0)], "id long, y int, n long")
    got = E.repeated(rows, ["id", "y"]).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 7, 2: 3, 3: 1}


def test_counters_and_routes(spark):
    e = events(
        spark,
        ("show", '{"articles": "1,2, 3,x,"}'),
        ("show", '{"articles": "1"}'),
        ("click", '{"article_id": "1"}'),
        ("signup", '{"article_id": "1"}'),
        (None, '{"article_id": "1"}'),
        ("show", '{"_tid": "no list"}'),
    )
    rows = {r["id"]: r for r in E.counters(e).collect()}
    assert {k: r["n_show"] for k, r in rows.items()} == {1: 2, 2: 1, 3: 1}
    assert rows[1]["n_click"] == 1 and rows[1]["ctr"] == 0.5 and rows[2]["ctr"] == 0.0
    assert E.accepted(e).count() == 4 and E.rejected(e).count() == 2


def test_recent_excludes_the_exact_edge(spark):
    e = events(spark, ("like", "{}"), ("like", "{}"))
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert [r["id"] for r in E.recent(e, as_of).collect()] == [1]


def test_add_likes_fills_missing_counts(spark):
    a = spark.createDataFrame([(1, None), (2, 3), (3, None)], "id long, n_like int")
    e = events(spark, ("like", '{"article_id": 1}'), ("like", '{"article_id": 1}'), ("like", '{"article_id": 2}'))
    assert {r["id"]: r["n_like"] for r in E.add_likes(a, e).collect()} == {1: 2, 2: 4, 3: None}


def test_null_aware_anti_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    tags = spark.createDataFrame([("t", 1), ("t", None)], "name string, article_id long")
    whole = tags.filter("article_id is not null")
    assert [r["id"] for r in J.untagged(a, tags).collect()] == [2]
    assert J.untagged(a, tags, null_aware=True).count() == 0
    assert J.untagged(a, whole, null_aware=True).count() == 1
    a.createOrReplaceTempView("a_t")
    tags.createOrReplaceTempView("t_t")
    assert spark.sql("SELECT * FROM a_t WHERE id NOT IN (SELECT article_id FROM t_t)").count() == 0


def test_listing_edges(spark):
    rows = [(1, "2024-01-01 00:00:01", None), (2, "2024-01-01 00:00:00", 0.5), (3, "2024-01-02 00:00:00", 0.1), (4, "2024-01-03 00:00:00", 0.11)]
    a = spark.createDataFrame([(i, "t", f"http://s/{i}", d, s, 0) for i, d, s in rows], "id long, title string, link string, date string, score double, n_like int")
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp")
    # 2 is exactly 48 hours old and 3 scores exactly 0.1: neither counts
    assert [r["id"] for r in listing.candidates(a, as_of).collect()] == [4]
    assert [r["id"] for r in listing.list_articles(a, recommended=True).collect()] == [2, 4, 3, 1]
    assert [r["id"] for r in listing.to_score(a).collect()] == [1]
    assert listing.page_offsets(0) == (0, 10) and listing.page_offsets(25) == (15, 35)
    with pytest.raises(ValueError):
        listing.list_articles(a, order_by="score desc; drop table article")
    with pytest.raises(ValueError):
        listing.list_articles(a, tag="x")


def test_encoder_refuses_other_inputs():
    for data in ({"f_site": "x"}, [], 3):
        with pytest.raises(TypeError):
            require_frame(data)


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "article_tags")
    assert tables.read_table(spark, "article_tags", path).count() == 0
    found = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1)], "name string, article_id long")
    tables.insert_tags(found, path)
    tables.insert_tags(found, path)
    assert tables.read_table(spark, "article_tags", path).count() == 2
    ranked = spark.createDataFrame([(2, 8, "b"), (1, 9, "a")], "rank int, id long, title string")
    tables.write_ranked(ranked, "2024-01-01 00:00:00", str(tmp_path / "ranked"))
    document = json.loads(spark.read.text(str(tmp_path / "ranked")).first()["value"])
    assert document == {"updateTime": "2024-01-01 00:00:00", "articles": [{"id": 9, "title": "a"}, {"id": 8, "title": "b"}]}
    lines = [json.loads(r["value"]) for r in tables.ranked_json(ranked, "t").orderBy("rank").collect()]
    assert [line["article"]["id"] for line in lines] == [9, 8]
