"""Feature encoding of blocks and articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafsift.functions.hashing import md5_bucket
from leafsift.functions.text import pick, words
from leafsift.operators import encoding as E
from leafsift.operators.blocks import block_features
from leafsift.operators.profile import article_features
from leafsift.operators.tree import node_table
from queries import pages as P
from queries import registrar
from queries import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


@query("e01_md5_bucket",
       f"SELECT doc_id, {V.sql_bucket('text', 10000)}::BIGINT AS wide, {V.sql_bucket('source', 9000)}::BIGINT AS narrow FROM documents")
def e01(spark, sf):
    d = V.table(spark, sf, "documents")
    return d.select(
        "doc_id", md5_bucket(F.col("text"), 10_000).cast("bigint").alias("wide"),
        md5_bucket(F.col("source"), 9_000).cast("bigint").alias("narrow"),
    )


def _block_features(spark, sf, tags=True):
    rows = block_features(node_table(V.cleaned(spark, sf)), with_tags=tags)
    return rows.withColumn("pre", F.col("pre").cast("bigint"))


_FEATS = P._FEATS
_COUNTS = [n for n in E.SLOTS if n != "f_link_density"]


@query("e02_scaled_counts", _FEATS + " SELECT page_id, pre, " + ", ".join(f"round(ln(1 + {n}::DOUBLE), 6) AS {n}" for n in _COUNTS) + " FROM feats")
def e02(spark, sf):
    rows = E.scale_features(_block_features(spark, sf, False))
    return rows.select("page_id", "pre", *[F.round(n, 6).alias(n) for n in _COUNTS])


@query("e03_scaled_density", _FEATS + " SELECT page_id, pre, round(ln(1e-4 + f_link_density), 6) AS f_link_density FROM feats")
def e03(spark, sf):
    rows = E.scale_features(_block_features(spark, sf, False))
    return rows.select("page_id", "pre", F.round("f_link_density", 6).alias("f_link_density"))


_ENTRIES = _FEATS + ", " + P.sql_block_entries()


def _rounded(rows):
    return rows.select("page_id", "pre", F.col("idx").cast("bigint").alias("idx"), F.round("value", 6).alias("value"))


@query("e04_dense_slots", _ENTRIES + " SELECT page_id, pre, slot::BIGINT AS idx, round(x, 6) AS value FROM slots")
def e04(spark, sf):
    rows = _block_features(spark, sf, False)
    return _rounded(rows.select("page_id", "pre", F.inline(F.array(*E.dense_entries()))))


_STEP = V.sql_bucket("name || ':' || trunc(x * 3)::BIGINT", 9000)


@query("e05_step_buckets", _ENTRIES + f" SELECT page_id, pre, (1000 + {_STEP})::BIGINT AS idx, 1.0::DOUBLE AS value FROM slots")
def e05(spark, sf):
    rows = _block_features(spark, sf, False)
    return _rounded(rows.select("page_id", "pre", F.inline(E.step_entries())))


_TAG = V.sql_bucket("'f_all_tags:' || tag", 9000)


@query("e06_tag_buckets", _FEATS + f" SELECT page_id, pre, (1000 + {_TAG})::BIGINT AS idx, 1.0::DOUBLE AS value "
       "FROM (SELECT page_id, pre, unnest(f_all_tags) AS tag FROM feats)")
def e06(spark, sf):
    rows = _block_features(spark, sf)
    return _rounded(rows.select("page_id", "pre", F.inline(E.tag_entries(F.col("f_all_tags")))))


@query("e07_sparse_rows", _ENTRIES + " SELECT page_id, pre, idx::BIGINT AS idx, round(sum(value), 6) AS value FROM entries GROUP BY page_id, pre, idx")
def e07(spark, sf):
    return _rounded(E.sum_entries(E.encode_blocks(_block_features(spark, sf), ["page_id", "pre"]), ["page_id", "pre"]))


@query("e08_site_bucket", f"SELECT doc_id AS id, {V.sql_bucket('''('f_site:' || source || '.example.com')''', 10000)}::BIGINT AS idx FROM documents")
def e08(spark, sf):
    from leafsift.functions.urls import site

    rows = V.articles(spark, sf).withColumn("f_site", site(F.col("link")))
    return rows.select("id", E.hashed(F.array(E.site_text()))[0]["idx"].cast("bigint").alias("idx"))


_KW = V.sql_bucket("'f_title_keywords:' || kw", 10000)


@query("e09_keyword_buckets",
       f"SELECT id, {_KW}::BIGINT AS idx FROM (SELECT doc_id AS id, unnest(string_split(csv, ',')) AS kw FROM "
       "(SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE replace(lower(substring(text, 1, 60)), ' ', ',') END AS csv FROM documents))")
def e09(spark, sf):
    csv = F.when(F.col("id") % 10 == 0, "").otherwise(F.replace(F.lower("title"), F.lit(" "), F.lit(",")))
    rows = V.articles(spark, sf).withColumn("f_title_keywords", csv)
    entries = rows.select("id", F.inline(E.hashed(E.keyword_texts("f_title_keywords"))))
    return entries.select("id", F.col("idx").cast("bigint").alias("idx"))


@query("e10_age_step",
       "SELECT page_id AS id, trunc(log2(1 + ((page_id * 3) % 720) / 4.0::DOUBLE))::BIGINT AS step FROM pages")
def e10(spark, sf):
    rows = V.rss(spark, sf)
    from leafsift.functions.dates import parse_asctime

    return rows.select("id", E.age_step(parse_asctime(F.col("date")), V.as_of()).cast("bigint").alias("step"))


@query("e11_length_step", "SELECT doc_id AS id, trunc(log2((1 + strlen(text) // 500)::DOUBLE))::BIGINT AS step FROM documents")
def e11(spark, sf):
    return V.articles(spark, sf).select("id", E.length_step(F.octet_length("text")).cast("bigint").alias("step"))


@query("e12_image_step", "SELECT page_id AS id, trunc(log2((1 + page_id % 40)::DOUBLE))::BIGINT AS step FROM pages")
def e12(spark, sf):
    # The given pages hold no image: their number is taken from the id.
    return V.pages(spark, sf).select(F.col("page_id").alias("id"), E.image_step(F.col("page_id") % 40).cast("bigint").alias("step"))


@query("e13_checked_input", "SELECT count(*) AS n, true AS refused FROM documents")
def e13(spark, sf):
    """A frame is taken as it is, its rows gathered in a list are refused."""
    rows = V.table(spark, sf, "documents").select("doc_id")
    counted = E.require_frame(rows).agg(F.count(F.lit(1)).alias("n"))
    try:
        E.require_frame(rows.take(3))
        refused = False
    except TypeError:
        refused = True
    return counted.withColumn("refused", F.lit(refused))


@query("e14_pick_by_index",
       "SELECT id, CASE WHEN len(w) >= 3 THEN w[3] || ' ' || w[1] || ' ' || w[len(w)] WHEN len(w) > 0 THEN w[len(w)] || ' ' || w[1] ELSE '' END AS picked "
       "FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}_]{2,})', 1) AS w FROM documents)")
def e14(spark, sf):
    rows = V.texts(spark, sf).select("id", words(F.col("text")).alias("w"))
    last = F.size("w") - 1
    at = F.when(F.size("w") >= 3, F.array(F.lit(2), F.lit(0), last)).when(F.size("w") > 0, F.array(last, F.lit(0))).otherwise(F.array().cast("array<int>"))
    return rows.select("id", F.array_join(pick(F.col("w"), at), " ").alias("picked"))


# ------------------------------------------------------------ whole article rows

SQL_WORD = r"regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}_]{{2,}})', 1)"


def sql_keywords(name: str, source: str, column: str, k: int, corpus: str | None = None) -> str:
    """CTE ``name(id, word, weight, rank)``: TF-IDF keywords of ``source`` with the idf of ``corpus``."""
    corpus = corpus or source
    return f"""
{name}_c AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT id, unnest({SQL_WORD.format(column)}) AS word FROM {corpus}) GROUP BY word),
{name}_t AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest({SQL_WORD.format(column)}) AS word FROM {source}) GROUP BY id, word),
{name} AS (
  SELECT * FROM (
    SELECT id, word, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS rank FROM (
      SELECT t.id, t.word, round(t.tf * (ln((1 + (SELECT count(*) FROM {corpus}))::DOUBLE / (1 + c.df)) + 1), 9) AS weight
      FROM {name}_t t JOIN {name}_c c USING (word)))
  WHERE rank <= {k}
)"""


def sql_article_features(source: str = "articles", corpus: str = "articles") -> str:
    """CTE ``article_feat`` over ``source``."""
    return f"""{sql_keywords("tk", source, "title", 20, corpus)}, {sql_keywords("bk", source, "text", 200, corpus)},
article_feat AS (
  SELECT a.id, regexp_extract(a.link, '^[a-z]+://([^/?#]*)', 1) AS f_site,
         coalesce((SELECT string_agg(lower(word), ',' ORDER BY rank) FROM tk WHERE tk.id = a.id), '') AS f_title_keywords,
         coalesce((SELECT string_agg(lower(word), ',' ORDER BY rank) FROM bk WHERE bk.id = a.id), '') AS f_content_keywords,
         a.date AS f_date, strlen(a.text) AS f_content_len, 0::BIGINT AS f_img_n
  FROM {source} a
)"""


def sql_article_entries(source: str = "article_feat", keys: str = "id") -> str:
    """CTE ``entries(keys, idx)``; every value is 1."""
    as_of = f"TIMESTAMP '{V.AS_OF_TEXT}'"
    hours = f"(epoch({as_of}) - epoch(strptime(f_date, '%Y-%m-%d %H:%M:%S'))) / 3600"
    texts = {
        "": "'f_site:' || f_site",
        "d": f"'f_date:' || trunc(log2(1 + {hours} / 4))::BIGINT",
        "l": "'f_content_len:' || trunc(log2((1 + f_content_len // 500)::DOUBLE))::BIGINT",
        "i": "'f_img_n:' || trunc(log2((1 + f_img_n)::DOUBLE))::BIGINT",
        "t": "'f_title_keywords:' || unnest(string_split(f_title_keywords, ','))",
        "c": "'f_content_keywords:' || unnest(string_split(f_content_keywords, ','))",
    }
    rows = " UNION ALL ".join(f"SELECT {keys}, {text} AS t FROM {source}" for text in texts.values())
    return f"entries AS (SELECT {keys}, {V.sql_bucket('t', 10000)} AS idx FROM ({rows}))"


ARTICLE_FEATURES = f"WITH {V.SQL_ARTICLES}, {sql_article_features()}"


@query("e07_article_rows", f"{ARTICLE_FEATURES}, {sql_article_entries()} SELECT id, idx::BIGINT AS idx, count(*)::DOUBLE AS value FROM entries GROUP BY id, idx")
def e07_articles(spark, sf):
    encoded = E.encode_articles(article_features(V.texts(spark, sf)), ["id"], V.as_of())
    return E.sum_entries(encoded, ["id"]).select("id", F.col("idx").cast("bigint").alias("idx"), "value")
