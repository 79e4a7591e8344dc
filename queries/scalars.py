"""Scalar functions over whole tables, and the functions offered to callers."""

from __future__ import annotations

from pyspark.sql import functions as F


from leafsift.functions.dates import DATE_TEXT, date_text, parse_date_text
from leafsift.functions.hashing import trace_id
from leafsift.functions.text import bytes_without_spaces, safe_int, three_decimals
from leafsift.functions.urls import path, site
from leafsift.operators.tree import register_sql
from leafsift.plans import extract as X
from queries import pages as P
from queries import registrar
from queries import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


def _docs(spark, sf):
    return V.table(spark, sf, "documents")


@query("x12_strings",
       """SELECT doc_id, text LIKE '%the%' AS likes, left(text, 10) AS first10, lower(text) AS low,
 replace(text, 'e', '_') AS swapped, string_split(text, ' ')[1] AS head, array_to_string(string_split(text, ' '), ',') AS joined,
 starts_with(text, 'The') AS starts, contains(text, 'ing') AS has, strlen(replace(text, ' ', '')) AS n_bytes, strlen(text) AS n_all FROM documents""")
def strings(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", t.like("%the%").alias("likes"), F.substring(t, 1, 10).alias("first10"),
        F.lower(t).alias("low"), F.replace(t, F.lit("e"), F.lit("_")).alias("swapped"),
        F.split(t, " ")[0].alias("head"), F.array_join(F.split(t, " "), ",").alias("joined"),
        F.startswith(t, F.lit("The")).alias("starts"), F.contains(t, F.lit("ing")).alias("has"),
        bytes_without_spaces(t).cast("bigint").alias("n_bytes"), F.octet_length(t).cast("bigint").alias("n_all"),
    )


@query("x12_regex",
       """SELECT doc_id, len(regexp_extract_all(text, 'none|hidden|hide')) AS hits, regexp_replace(text, '[aeiou]+', '*', 'g') AS starred,
 regexp_matches(text, '^[A-Z]') AS capital, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), ' ') AS names FROM documents""")
def regex(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", F.regexp_count(t, F.lit("none|hidden|hide")).cast("bigint").alias("hits"),
        F.regexp_replace(t, "[aeiou]+", "*").alias("starred"), t.rlike("^[A-Z]").alias("capital"),
        F.array_join(F.regexp_extract_all(t, F.lit("[A-Z][a-z]+"), F.lit(0)), " ").alias("names"),
    )


@query("x12_hashes",
       """SELECT event_id, md5(event_type) AS kind, substr(md5(epoch(date_trunc('second', ts))::BIGINT::VARCHAR), 1, 10)
 || epoch(date_trunc('second', ts))::BIGINT AS trace FROM events""")
def hashes(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select("event_id", F.md5(F.col("event_type").cast("binary")).alias("kind"), trace_id(F.col("ts").cast("timestamp")).alias("trace"))


@query("x12_nulls",
       "SELECT d.doc_id, coalesce(l.quality, 0)::BIGINT AS quality, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'fine' END AS verdict "
       "FROM documents d LEFT JOIN labels l USING (doc_id)")
def nulls(spark, sf):
    rows = _docs(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left")
    verdict = F.when(F.col("toxic") == 1, "toxic").otherwise("fine")
    return rows.select("doc_id", F.coalesce("quality", F.lit(0)).cast("bigint").alias("quality"), verdict.alias("verdict"))


@query("x12_json",
       """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS doc FROM events""")
def json(spark, sf):
    e = V.table(spark, sf, "events")
    doc = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")))
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), doc.alias("doc"))


@query("x12_casts",
       """SELECT doc_id, TRY_CAST(substring(source, 4) AS BIGINT) AS n, TRY_CAST(text AS BIGINT) AS m,
 CASE WHEN doc_id % 2 = 0 THEN 0 ELSE substring(source, 4)::BIGINT END AS safe FROM documents""")
def casts(spark, sf):
    digits = F.substring("source", 4, 9)
    blank = F.when(F.col("doc_id") % 2 == 0, "").otherwise(digits)
    return _docs(spark, sf).select(
        "doc_id", digits.try_cast("bigint").alias("n"), F.col("text").try_cast("bigint").alias("m"),
        safe_int(blank).cast("bigint").alias("safe"),
    )


@query("x12_math",
       """SELECT doc_id, round(ln(1 + n_chars::DOUBLE), 6) AS l1p, round(ln(n_chars + 1e-4), 6) AS l, trunc(log2(n_chars::DOUBLE))::BIGINT AS steps,
 n_chars // 500 AS halves, trunc(-n_chars / 7.0)::BIGINT AS cut FROM documents WHERE n_chars > 0""")
def math(spark, sf):
    n = F.col("n_chars")
    return _docs(spark, sf).filter(n > 0).select(
        "doc_id", F.round(F.log1p(n.cast("double")), 6).alias("l1p"), F.round(F.log(n + F.lit(1e-4)), 6).alias("l"),
        F.log2(n.cast("double")).cast("bigint").alias("steps"), F.expr("n_chars div 500").alias("halves"),
        (-n / F.lit(7.0)).cast("bigint").alias("cut"),
    )


@query("x12_three_decimals", "SELECT event_id, printf('%.3f', CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE value END) AS shown FROM events")
def decimals(spark, sf):
    value = F.when(F.col("event_id") % 5 != 0, F.col("value"))
    return V.table(spark, sf, "events").select("event_id", three_decimals(value).alias("shown"))


@query("x12_dates",
       f"""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, epoch(date_trunc('second', ts))::BIGINT AS seconds,
 epoch(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S'))::BIGINT AS again, ts > TIMESTAMP '{V.AS_OF_TEXT}' - INTERVAL 48 HOUR AS recent FROM events""")
def dates(spark, sf):
    at = F.col("ts").cast("timestamp")
    return V.table(spark, sf, "events").select(
        "event_id", date_text(at).alias("shown"), F.unix_timestamp(at).alias("seconds"),
        F.unix_timestamp(parse_date_text(F.date_format(at, DATE_TEXT))).alias("again"),
        (at > V.as_of() - F.expr("interval 48 hours")).alias("recent"),
    )


@query("x12_urls", f"SELECT page_id, {P._SITE.format('url')} AS site, {P._PATH.format('url')} AS path FROM pages")
def urls(spark, sf):
    return V.pages(spark, sf).select("page_id", site(F.col("url")).alias("site"), path(F.col("url")).alias("path"))


@query("x12_arrays",
       """SELECT page_id, list_max(n) AS longest, list_min(n) AS shortest, n[1] AS first, coalesce(list_max(list_filter(n, lambda x: x > 1000000)), 0) AS none FROM (
 SELECT page_id, list_transform(regexp_extract_all(html, '<p>([^<]*)', 1), lambda x: strlen(x)) AS n FROM pages)""")
def arrays(spark, sf):
    n = F.transform(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), F.lit(1)), lambda x: F.octet_length(x).cast("bigint"))
    rows = V.pages(spark, sf).select("page_id", n.alias("n"))
    none = F.coalesce(F.array_max(F.filter("n", lambda x: x > 1_000_000)), F.lit(0)).cast("bigint")
    return rows.select(
        "page_id", F.array_max("n").alias("longest"), F.array_min("n").alias("shortest"),
        F.try_element_at("n", F.lit(1)).alias("first"), none.alias("none"),
    )


@query("x02_extract_main_content", P.SQL["h07_main_content"])
def x02(spark, sf):
    return X.main_content(V.cleaned(spark, sf), V.model(spark)).select("page_id", "body")


@query("x02_score_features", P.SQL["h08_ranked_blocks"])
def x02_scores(spark, sf):
    return P.QUERIES["h08_ranked_blocks"](spark, sf)


@query("x03_nodes_in_sql", P._TREE + " SELECT page_id, tag, count(*) AS n, sum(pre)::BIGINT AS places FROM nodes GROUP BY page_id, tag")
def x03(spark, sf):
    register_sql(spark)
    V.cleaned(spark, sf).createOrReplaceTempView("leafsift_cleaned_pages")
    return spark.sql(
        "SELECT p.page_id, n.tag, count(*) AS n, sum(n.pre) AS places "
        "FROM leafsift_cleaned_pages p, LATERAL html_nodes(p.html) n GROUP BY p.page_id, n.tag"
    )


