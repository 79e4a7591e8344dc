import datetime
import hashlib
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from leafsift.operators.tree import with_page_fields
from leafsift.functions import dates, hashing, html, text, urls


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema).repartition(1)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_md5_bucket_equals_hashlib(spark):
    words = ["", "a", "f_site:x", "größe", "漢字", "f_tag_n:-3", "x" * 5000]
    got = values(spark, [(w,) for w in words], "w string", *[hashing.md5_bucket(F.col("w"), m) for m in (10_000, 9_000, 7)])
    want = [tuple(int(hashlib.md5(w.encode()).hexdigest(), 16) % m for m in (10_000, 9_000, 7)) for w in words]
    assert got == want
    assert want[2][0] == 9639


BASES = ["http://a.example.com/b/c/d?q#f", "https://h:8080", "http://h_x.example.com/p/", "http://h/x.html#t"]
LINKS = ["", "y", "./y", "../y", "../../y", "../../../y", "/y/./z/../w", "//o.example.com/k", "?n=1", "#part",
         "https://abs.example.com/q?w=1#e", "mailto:a@b.c", "y?a=../b", "g/", "..", "."]


@pytest.mark.parametrize("base", BASES)
def test_resolve_equals_urljoin(spark, base):
    got = values(spark, [(base, link) for link in LINKS], "b string, l string", urls.resolve(F.col("b"), F.col("l")))
    assert [g[0] for g in got] == [urljoin(base, link) for link in LINKS]


def test_site_keeps_port_and_underscore(spark):
    rows = ["http://a.b:81/x", "http://a_b.c/d", "no scheme", "", "https://u@h/x?y"]
    got = values(spark, [(r,) for r in rows], "u string", urls.site(F.col("u")))
    assert [g[0] for g in got] == [urlparse(r).netloc for r in rows]


def test_asctime_both_ways(spark):
    at = datetime.datetime(2019, 5, 6, 20, 7, 54)
    (row,) = values(spark, [(at,)], "t timestamp", dates.asctime(F.col("t")), dates.asctime_to_date_text(dates.asctime(F.col("t"))))
    assert row == ("Mon May  6 20:07:54 2019", "2019-05-06 20:07:54")
    (row,) = values(spark, [("nonsense",)], "t string", dates.asctime_to_date_text(F.col("t")))
    assert row == (None,)


def test_entities_named_and_numeric(spark):
    (row,) = values(spark, [("&lt;b&gt; &amp;lt; &#233;&#128512; &copy;",)], "t string", html.decode_entities(F.col("t")))
    assert row == ("<b> &lt; é😀 ©",)


def test_strip_noise_pairs_different_names_and_any_case(spark):
    page = "<BODY class=x>a<script>var t='</p>';</script>b<STYLE>c</style>d<embed src=q>e</object>f</body>"
    (row,) = values(spark, [(page,)], "t string", html.strip_noise(F.col("t")))
    assert row == ("abdf",)


def test_entities_are_decoded_once_from_left_to_right(spark):
    rows = [("a&#x27;b &#X41;", "a'b A"), ("&#38;lt; &amp;amp;", "&lt; &amp;"), ("&#0;&#55296;&#99999999999;", "\ufffd" * 3), ("&nope; & &;", "&nope; & &;"), (None, None)]
    assert [g[0] for g in values(spark, [(r[0],) for r in rows], "t string", html.decode_entities(F.col("t")))] == [r[1] for r in rows]


def test_page_fields_come_from_the_tree(spark):
    page = (
        "<html><head><!-- <title>no</title> --><title>A &amp; B</title><meta name=\"keywords\" content=\"k\"><meta content='d' name=\"description\">"
        "</head><body id=1><script>var x = '<a href=\"/js\">';</script><a title=\"a>b\" href='/q?x=1&amp;y=2'>x</a><img SRC=i.png src=j.png></body></html>"
    )
    rows = spark.createDataFrame([(1, page), (2, "plain"), (3, None)], "page_id long, html string")
    got = {r["page_id"]: r for r in with_page_fields(rows).collect()}
    assert (got[1]["title"], got[1]["description"], got[1]["hrefs"]) == ("A & B", "d", ["/q?x=1&y=2"])
    assert [(i["src"], i["data_src"]) for i in got[1]["images"]] == [("i.png", None)]
    assert all((got[i]["title"], got[i]["description"], got[i]["hrefs"], got[i]["images"]) == ("", "", [], []) for i in (2, 3))
    (row,) = values(spark, [(page,)], "t string", html.page_body(F.col("t")))
    assert row[0].startswith("<body id=1>") and row[0].endswith("</body>")


def test_attribute_forms(spark):
    attrs = [' href="a b" x=1', " HREF='q'", " href=plain class=c", ' data-href="no"', ""]
    got = values(spark, [(a,) for a in attrs], "t string", html.attribute(F.col("t"), "href"))
    assert [g[0] for g in got] == ["a b", "q", "plain", None, None]


def test_words_and_csv(spark):
    (row,) = values(spark, [("Ünïcode a bc_1 漢字 x-yz",)], "t string", text.words(F.col("t")), text.keyword_csv(text.words(F.col("t"))))
    assert row == (["ünïcode", "bc_1", "漢字", "yz"], "ünïcode,bc_1,漢字,yz")


def test_scalars(spark):
    got = values(spark, [("", None), ("7", 0.1234)], "s string, x double", text.safe_int(F.col("s")), text.three_decimals(F.col("x")))
    assert got == [(0, "-1.000"), (7, "0.123")]


def test_rewrite_keeps_quotes_and_protocol_relative(spark):
    body = '<img src="/a.png"><a href="/b">x</a><img src="//cdn/c">'
    (row,) = values(spark, [(body,)], "b string", urls.rewrite_root_links(F.col("b"), F.lit("https://h:1/p")), urls.rewrite_root_links(F.col("b"), F.lit("https://h:1/p"), True))
    assert row[0] == '<img src="https://h:1/a.png"><a href="https://h:1/b">x</a><img src="//cdn/c">'
    assert row[1] == '<img src=h:1/a.png"><a href="h:1/b">x</a><img src=h:1//cdn/c">'
