"""The given tables seen as the engine's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsift.functions.dates import date_text
from leafsift.operators.projection import project_pages
from leafsift.plans.extract import clean_pages
from leafsift.session import scratch_path
from leafsift.sources.tables import write_bucketed

AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hours_back(key: str) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(as_of()) - F.col(key) * 3 % 720 * 3600)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


# Markup that a search by pattern misreads: a comment, a script and a quoted ">" around links, titles and descriptions.
TRICKY_HEAD = (
    '<!-- <title>gone</title><meta name="description" content="gone"> -->'
    '<meta name="description" content="page {id} &amp;amp; &#39;q&#x27; > end">'
)
TRICKY_BODY = (
    '<!-- <a href="/gone"> <img src="/gone.png"> --><script>var x = \'<a href="/js">\';</script>'
    '<a title="a>b" href="/q?x=1&amp;y={id}">q</a><a href="/part#one">1</a><a href=\'/part#two\'>2</a>'
    '<a href="mailto:a@b.example.com">m</a><a href="javascript:void(0)">j</a><a name="none">n</a>'
)


def tricky_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The given pages with such markup put into every head and body."""
    n = F.col("page_id").cast("string")
    filled = lambda text: F.replace(F.lit(text), F.lit("{id}"), n)
    html = F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), filled(TRICKY_HEAD)))
    return pages(spark, sf).withColumn("html", F.replace(html, F.lit("<body>"), F.concat(F.lit("<body>"), filled(TRICKY_BODY))))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean_pages(pages(spark, sf))


def rss(spark: SparkSession, sf: str) -> DataFrame:
    """Projected pages; ``html`` keeps the raw page."""
    raw = pages(spark, sf).withColumn("_at", hours_back("page_id"))
    projected = project_pages(raw, F.col("_at"))
    return projected


def _bucketed(spark: SparkSession, rows: DataFrame, name: str, key: str) -> DataFrame:
    path = scratch_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_bucketed(rows, f"{name}_{path.rsplit('-', 1)[1]}", key, buckets, path)


def stored_rss(spark: SparkSession, sf: str) -> DataFrame:
    """The projected pages as a crawl stores them, bucketed by id: what is joined to them comes to the pages."""
    return _bucketed(spark, rss(spark, sf), "rss", "id")


def stored_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _bucketed(spark, pages(spark, sf), "pages", "page_id")


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    name = (
        F.when(F.col("event_type") == "view", "show")
        .when(F.col("event_type") == "purchase", "like")
        .when(F.col("event_type") == "error", "hate")
        .otherwise(F.col("event_type"))
    )
    tid = F.concat(F.lit('{"_tid": "t'), F.col("user_id").cast("string"))
    following = ((k.cast("int") + 1) % 100).cast("string")
    shown = F.concat(tid, F.lit('", "articles": "'), k, F.lit(","), following, F.lit('"}'))
    single = F.concat(tid, F.lit('", "article_id": '), k, F.lit("}"))
    attr = F.when(F.col("event_type") == "view", shown).otherwise(single)
    return e.select(F.col("event_id").alias("id"), name.alias("name"), F.col("ts").cast("timestamp").alias("time"), attr.alias("evt_attr"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles, without scores and likes: the body is plain text."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("link"),
        F.col("text").alias("body"),
        F.col("text"),
        date_text(hours_back("doc_id")).alias("date"),
        F.lit(0).alias("f_img_n"),
        "lang",
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a score from the labels and the likes of the events."""
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    likes = (
        events(spark, sf).filter(F.col("name") == "like")
        .groupBy(F.get_json_object("evt_attr", "$.article_id").cast("bigint").alias("id"))
        .agg(F.count(F.lit(1)).alias("n_like"))
    )
    points = F.col("quality") * 6 - F.col("toxic") * 4 + F.col("id") % 7 - 2
    joined = texts(spark, sf).join(labels, "id", "left").join(likes, "id", "left")
    return joined.select(
        "id", "title", "link", "body", "text", "date", (points.cast("double") / 10).alias("score"), "n_like", "f_img_n", "lang"
    )


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """A stored tag table: language and source of every second document, and two rows without an article."""
    d = table(spark, sf, "documents").filter(F.col("doc_id") % 2 == 0)
    rows = d.select(F.explode(F.array("lang", "source")).alias("name"), F.col("doc_id").alias("article_id"))
    loose = d.select("lang").distinct().select(F.col("lang").alias("name"), F.lit(None).cast("bigint").alias("article_id"))
    return rows.unionByName(loose)


def model(spark: SparkSession) -> DataFrame:
    """Weights by a fixed rule, for scoring queries."""
    idx = F.col("id").cast("int")
    weight = ((F.col("id") * 7919 % 2003 - 1001) / F.lit(5000.0)).cast("double")
    rows = spark.range(10_000).select(F.lit("rule").alias("model"), idx.alias("idx"), weight.alias("weight"))
    return rows.unionByName(spark.range(1).select(F.lit("rule").alias("model"), F.lit(-1).alias("idx"), F.lit(-0.25).alias("weight")))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled blocks: the article, nav, footer and div sources of every page."""
    pieces = []
    for n, (tag, y) in enumerate((("article", 1), ("nav", -1), ("footer", -1), ("div", -1))):
        source = F.regexp_extract("html", f"(?s)<{tag}[ >].*</{tag}>", 0)
        pieces.append(
            pages(spark, sf).select((F.col("page_id") * 4 + n).alias("id"), source.alias("body"), F.lit(y).alias("y"))
        )
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


# ------------------------------------------------------------------ SQL

SQL_EVENTS = """
article_event AS (
  SELECT event_id AS id,
         CASE event_type WHEN 'view' THEN 'show' WHEN 'purchase' THEN 'like' WHEN 'error' THEN 'hate' ELSE event_type END AS name,
         ts AS time, json_extract_string(props, '$.k')::BIGINT AS k, user_id, event_type
  FROM events
)"""

SQL_ARTICLES = (
    SQL_EVENTS
    + """,
likes AS (SELECT k AS doc_id, count(*) AS n_like FROM article_event WHERE name = 'like' GROUP BY k),
articles AS (
  SELECT d.doc_id AS id, substring(d.text, 1, 60) AS title,
         'https://' || d.source || '.example.com/' || d.doc_id AS link, d.text AS body, d.text AS text,
         strftime(TIMESTAMP '2024-01-31 00:00:00' - to_hours(d.doc_id * 3 % 720), '%Y-%m-%d %H:%M:%S') AS date,
         CAST(l.quality * 6 - l.toxic * 4 + d.doc_id % 7 - 2 AS DOUBLE) / 10 AS score,
         k.n_like AS n_like, d.lang AS lang
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN likes k ON k.doc_id = d.doc_id
)"""
)

SQL_TAGS = """
tags AS (
  SELECT unnest([lang, source]) AS name, doc_id AS article_id FROM documents WHERE doc_id % 2 = 0
  UNION ALL
  SELECT DISTINCT lang, NULL FROM documents WHERE doc_id % 2 = 0
)"""

SQL_MODEL = """
model AS (
  SELECT range AS idx, ((range * 7919) % 2003 - 1001) / 5000.0::DOUBLE AS weight FROM range(10000)
)"""
SQL_INTERCEPT = "-0.25"


def sql_bucket(text: str, buckets: int) -> str:
    """MD5 modulo ``buckets`` by 32-bit chunks."""
    step = (1 << 32) % buckets
    out = f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {buckets})"
    for start in (9, 17, 25):
        out = f"(({out} * {step} + ('0x' || substr(md5({text}), {start}, 8))::BIGINT) % {buckets})"
    return out
