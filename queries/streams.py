"""Streams run to their end over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafsift.functions.urls import is_http, resolve
from leafsift.operators import events as E
from leafsift.operators import links as L
from leafsift.operators.vectors import corpus_idf
from leafsift.session import scratch_path
from leafsift.sources.schemas import ARTICLE_EVENT
from leafsift.streaming import crawl as C
from leafsift.streaming import feedback as S
from queries import pages as P
from queries import registrar
from queries import tables as B
from queries import text as W
from queries import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _stored(spark, rows, name, files=4):
    """Rows written as several files for a file stream to pick up."""
    path = scratch_path(spark, name)
    rows.repartition(files).write.parquet(path)
    return path


def _event_stream(spark, sf):
    path = _stored(spark, V.events(spark, sf), "events-in")
    return S.event_stream(spark, path, ARTICLE_EVENT, per_trigger=2)


def _event_stream_in_order(spark, sf):
    """The events as they come in: four files, one after the other, each later than the one before."""
    rows, path = V.events(spark, sf), scratch_path(spark, "events-in")
    step = rows.agg(F.max("id")).scalar() / 4
    for part in range(4):
        rows.filter((F.col("id") > part * step) | (F.lit(part) == 0)).filter(F.col("id") <= (part + 1) * step).coalesce(1).write.mode("append").parquet(path)
    return S.event_stream(spark, path, ARTICLE_EVENT, per_trigger=1)


# An hour is stored once the watermark, the latest event time less the delay, has passed its end.
def _closed(names: str) -> str:
    last = f"(SELECT max(time) FROM article_event WHERE name IN ({names}))"
    return f"name IN ({names}) AND date_trunc('hour', time) + INTERVAL 1 HOUR <= {last} - INTERVAL 2 HOUR"


@query("st01_intake",
       f"WITH {V.SQL_EVENTS} SELECT id, name, CASE WHEN name IN ('show', 'click', 'like', 'hate') THEN 'accepted' ELSE 'rejected' END AS route FROM article_event")
def st01(spark, sf):
    good, bad, state = (scratch_path(spark, n) for n in ("accepted", "rejected", "state"))
    S.run_to_end(S.intake(_event_stream(spark, sf), good, bad, state))
    a = spark.read.parquet(good).select("id", "name", F.lit("accepted").alias("route"))
    return a.unionByName(spark.read.parquet(bad).select("id", "name", F.lit("rejected").alias("route")))


@query("st02_recent_feedback",
       f"WITH {V.SQL_EVENTS} SELECT k AS id, name, count(*) AS n FROM article_event WHERE name IN ('like', 'hate') "
       f"AND time > TIMESTAMP '{V.AS_OF_TEXT}' - INTERVAL 48 HOUR AND time <= TIMESTAMP '{V.AS_OF_TEXT}' GROUP BY k, name")
def st02_batch(spark, sf):
    rows = E.recent(V.events(spark, sf), V.as_of()).filter(F.col("name").isin(*E.OPINIONS))
    return rows.groupBy(E.article_id(F.col("evt_attr")).alias("id"), "name").agg(F.count(F.lit(1)).alias("n"))


_HOURS = f"""WITH {V.SQL_EVENTS}, hours AS (
 SELECT date_trunc('hour', time) AS hour, k AS id, name, count(*) AS n FROM article_event WHERE {_closed("'like', 'hate'")} GROUP BY ALL)"""


def _hours(spark, sf):
    out, state = scratch_path(spark, "hours"), scratch_path(spark, "state")
    S.run_to_end(S.append_hours(S.hourly_opinions(_event_stream_in_order(spark, sf), late="2 hours"), out, state))
    return spark.read.schema("hour timestamp, id bigint, name string, n bigint").parquet(out)


@query("st02_recent_feedback_windows",
       _HOURS + """, spread AS (SELECT id, name, n, hour - to_hours(unnest(range(48))) AS start_at FROM hours)
 SELECT start_at, name, sum(n)::BIGINT AS n, count(DISTINCT id) AS n_articles FROM spread GROUP BY start_at, name""")
def st02(spark, sf):
    # the sums over every 48 hours are taken from the stored hours
    hours = _hours(spark, sf).withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(47))))
    start = (F.col("hour") - F.make_dt_interval(hours="back")).cast("timestamp_ntz")
    rows = hours.groupBy(start.alias("start_at"), "name", "id").agg(F.sum("n").alias("n"))
    return rows.groupBy("start_at", "name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_articles"))


@query("st02_recent_sums", _HOURS + " SELECT id, name, sum(n)::BIGINT AS n FROM hours WHERE hour >= TIMESTAMP '2024-01-28 00:00:00' AND hour < TIMESTAMP '2024-01-30 00:00:00' GROUP BY id, name")
def st02_sums(spark, sf):
    return S.recent_sums(_hours(spark, sf), F.lit("2024-01-30 00:00:00").cast("timestamp"))


@query("st03_live_counters", B.SQL["a11_counters"])
def st03(spark, sf):
    out, state = scratch_path(spark, "deltas"), scratch_path(spark, "state")
    S.run_to_end(S.counter_deltas(_event_stream(spark, sf), out, state))
    return S.total_counters(spark.read.parquet(out)).withColumn("ctr", F.round("ctr", 6))


_ALL_NAMES = "'show', 'click', 'like', 'hate'"


@query("st03_hourly_counters",
       f"""WITH {V.SQL_EVENTS}, named AS (
 SELECT date_trunc('hour', time) AS start_at, name, unnest(CASE WHEN name = 'show' THEN [k, (k + 1) % 100] ELSE [k] END) AS id
 FROM article_event WHERE {_closed(_ALL_NAMES)})
 SELECT start_at, name, id, count(*) AS n FROM named GROUP BY ALL""")
def st03_hourly(spark, sf):
    out, state = scratch_path(spark, "hourly"), scratch_path(spark, "state")
    S.run_to_end(S.append_hours(S.hourly_counters(_event_stream_in_order(spark, sf), late="2 hours"), out, state))
    return spark.read.parquet(out).select(F.col("hour").cast("timestamp_ntz").alias("start_at"), "name", "id", "n")


@query("st04_live_feedback", B.SQL["j01_feedback"])
def st04(spark, sf):
    out, state = scratch_path(spark, "feedback"), scratch_path(spark, "state")
    a = V.articles(spark, sf).withColumn("n_body", F.octet_length("body").cast("bigint"))
    columns = ["link", "title", "n_body", "date"]
    S.run_to_end(S.feedback_rows(_event_stream(spark, sf), a, columns, out, state))
    return spark.read.parquet(out).drop("batch").withColumn("y", F.col("y").cast("bigint"))


@query("st05_pages_to_articles", P.SQL["h10_articles"])
def st05(spark, sf):
    rss = P._rss_html(spark, sf).drop("body").withColumnRenamed("html", "body")
    path = _stored(spark, rss, "rss-in")
    stream = spark.readStream.schema(rss.schema).option("maxFilesPerTrigger", 2).parquet(path)
    articles, tags, state = (scratch_path(spark, n) for n in ("articles", "tags", "state"))
    S.run_to_end(C.pages_to_tags(stream, V.model(spark), articles, tags, state))
    return spark.read.parquet(articles).select("id", "title", "link", "body", "date")


@query("st05_pages_to_tags",
       P._ARTICLES + ", found AS (SELECT m.page_id AS doc_id, t.text FROM main m JOIN texts t USING (page_id) WHERE strlen(t.text) >= 500), "
       + W._fallback_sql("found", "documents") + " SELECT DISTINCT word AS name, id AS article_id FROM fallback")
def st05_tags(spark, sf):
    rss = P._rss_html(spark, sf).drop("body").withColumnRenamed("html", "body")
    path = _stored(spark, rss, "rss-in")
    stream = spark.readStream.schema(rss.schema).option("maxFilesPerTrigger", 2).parquet(path)
    articles, tags, state, idf = (scratch_path(spark, n) for n in ("articles", "tags", "state", "idf"))
    corpus_idf(V.texts(spark, sf), "text").write.parquet(idf)
    S.run_to_end(C.pages_to_tags(stream, V.model(spark), articles, tags, state, idf))
    return C.stored_tags(spark, tags).read().select("name", "article_id")


@query("st06_new_urls", f"WITH {P._TARGETS} SELECT DISTINCT target AS url FROM targets")
def st06(spark, sf):
    links = L.page_links(V.tricky_pages(spark, sf)).select(resolve(F.col("url"), F.col("href")).alias("url")).filter(is_http(F.col("url")))
    path = _stored(spark, links, "urls-in")
    stream = spark.readStream.schema("url string").option("maxFilesPerTrigger", 1).parquet(path)
    seen, state = scratch_path(spark, "seen"), scratch_path(spark, "state")
    S.run_to_end(C.new_urls(stream, seen, state))
    return C.seen_urls(spark, seen).read()


