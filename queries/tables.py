"""Stored tables, joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafsift.operators import events as E
from leafsift.operators import joins as J
from leafsift.operators import listing as L
from leafsift.operators.diversify import global_rank
from leafsift.operators.linear import decision_values, load_model, predicted_class, save_model
from leafsift.operators.encoding import encode_articles, with_article_entries
from leafsift.operators.profile import article_features
from leafsift.plans import ranking as R
from leafsift.plans.storing import article_store, store_likes, store_scores
from leafsift.session import scratch_path
from leafsift.sources import tables as S
from queries import encoding as Q
from queries import pages as P
from queries import registrar
from queries import sql_tree as T
from queries import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

_TITLE = T.decode(P._RAW_TITLE)
_RSS = f"SELECT page_id AS id, {_TITLE} AS title, url AS link, strlen(regexp_extract(html, '(?s)<body>(?:.*</body>|.*)', 0)) AS n_body, '' AS \"desc\" FROM pages"


@query("s01_append_pages", _RSS)
def s01(spark, sf):
    path = scratch_path(spark, "rss")
    rows = V.rss(spark, sf)
    # two appends, as two crawl runs would make
    S.append(rows.filter(F.col("id") % 2 == 0), "rss", path)
    S.append(rows.filter(F.col("id") % 2 == 1), "rss", path)
    stored = S.read_table(spark, "rss", path)
    return stored.select("id", "title", "link", F.octet_length("body").cast("bigint").alias("n_body"), "desc")


@query("s02_create_if_absent", "SELECT count(*) AS n, count(DISTINCT url) AS n_links FROM pages")
def s02(spark, sf):
    path = scratch_path(spark, "table")
    name = "t_" + path.rsplit("-", 1)[1]
    S.create_table(spark, "rss", path, name)
    S.create_table(spark, "rss", path, name)
    S.shaped(V.rss(spark, sf), "rss").write.insertInto(name)
    return spark.table(name).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("link").alias("n_links"))


# Two thirds of the pages count as processed.
_J2 = "SELECT page_id AS id, url AS link FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 <> 0)"


def _unprocessed(spark, sf):
    done = V.pages(spark, sf).filter(F.col("page_id") % 3 != 0).select(F.col("page_id").alias("id"))
    return J.unprocessed(V.rss(spark, sf), done).select("id", "link")


query("j02_unprocessed", _J2)(_unprocessed)
query("s03_scan_unprocessed", _J2)(_unprocessed)


@query("s04_append_articles", f"WITH {V.SQL_ARTICLES} SELECT id, title, link, date, substring(date, 1, 10) AS day, strlen(body) AS n FROM articles")
def s04(spark, sf):
    path = scratch_path(spark, "article")
    S.append_articles(V.articles(spark, sf), path)
    stored = spark.read.parquet(path)
    day = F.date_format("day", "yyyy-MM-dd") if dict(stored.dtypes)["day"] == "date" else F.col("day")
    return stored.select("id", "title", "link", "date", day.alias("day"), F.octet_length("body").cast("bigint").alias("n"))


_WITH_TAGS = f"WITH {V.SQL_ARTICLES}, {V.SQL_TAGS}"


@query("j03_untagged", _WITH_TAGS + " SELECT id, title FROM articles WHERE id NOT IN (SELECT article_id FROM tags WHERE article_id IS NOT NULL)")
def j03(spark, sf):
    return J.untagged(V.articles(spark, sf), V.tags(spark, sf)).select("id", "title")


# one tag table with tags of no article, which empties the result, and one without
@query("j03_untagged_null_aware",
       _WITH_TAGS + " SELECT id, title, 'nulls' AS tags FROM articles WHERE id NOT IN (SELECT DISTINCT article_id FROM tags) "
       "UNION ALL SELECT id, title, 'none' FROM articles WHERE id NOT IN (SELECT article_id FROM tags WHERE article_id IS NOT NULL)")
def j03_nulls(spark, sf):
    a, tags = V.articles(spark, sf), V.tags(spark, sf)
    with_nulls = J.untagged(a, tags, null_aware=True).select("id", "title", F.lit("nulls").alias("tags"))
    without = J.untagged(a, tags.filter(F.col("article_id").isNotNull()), null_aware=True)
    return with_nulls.unionByName(without.select("id", "title", F.lit("none").alias("tags")))


@query("s05_scan_untagged", _WITH_TAGS + " SELECT id, title, link, body FROM articles WHERE id NOT IN (SELECT article_id FROM tags WHERE article_id IS NOT NULL)")
def s05(spark, sf):
    return J.untagged(V.articles(spark, sf), V.tags(spark, sf)).select("id", "title", "link", "body")


@query("s06_insert_tags", f"WITH {V.SQL_TAGS} SELECT DISTINCT name, article_id FROM (SELECT name, article_id FROM tags WHERE article_id IS NOT NULL UNION ALL SELECT lang, doc_id FROM documents)")
def s06(spark, sf):
    path = scratch_path(spark, "tags")
    d = V.table(spark, sf, "documents")
    S.insert_tags(V.tags(spark, sf).filter(F.col("article_id").isNotNull()), path)
    # the second run repeats half of the first one's pairs
    S.insert_tags(d.select(F.col("lang").alias("name"), F.col("doc_id").alias("article_id")), path)
    return S.read_table(spark, "article_tags", path).select("name", "article_id")


_TRAIN = f"""WITH {V.SQL_ARTICLES},
 opinions AS (SELECT k AS id, CASE WHEN name = 'like' THEN 1 ELSE -1 END AS y FROM article_event WHERE name IN ('like', 'hate')),
 new_opinions AS (SELECT * FROM opinions WHERE id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 3)),
 judged AS (SELECT * FROM articles WHERE id IN (SELECT id FROM new_opinions)),
 {Q.sql_article_features("judged", "articles")}"""


def _training(spark, sf):
    known = V.table(spark, sf, "documents").filter(F.col("doc_id") % 4 == 3).select(F.col("doc_id").alias("id"))
    return R.weighted_rows(V.events(spark, sf), V.articles(spark, sf), known)


_FEAT_COLUMNS = "f_site, f_title_keywords, f_content_keywords, f_date, f_content_len, f_img_n"


@query("ml04_training_rows", _TRAIN + f" SELECT o.id, o.y::BIGINT AS y, {_FEAT_COLUMNS} FROM new_opinions o JOIN article_feat f ON f.id = o.id")
def ml04(spark, sf):
    rows = R.repeat_rows(_training(spark, sf))
    return rows.withColumn("y", F.col("y").cast("bigint")).withColumn("f_img_n", F.col("f_img_n").cast("bigint"))


@query("s07_append_training_rows", _TRAIN + " SELECT o.id, o.y::BIGINT AS y, f_site, f_content_len, f_date FROM new_opinions o JOIN article_feat f ON f.id = o.id")
def s07(spark, sf):
    path = scratch_path(spark, "feat")
    S.append(R.repeat_rows(_training(spark, sf)), "article_feat", path)
    stored = S.read_table(spark, "article_feat", path)
    return stored.select("id", F.col("y").cast("bigint").alias("y"), "f_site", "f_content_len", "f_date")


@query("s08_scan_training_rows", _TRAIN + f" SELECT o.y::BIGINT AS y, {_FEAT_COLUMNS} FROM new_opinions o JOIN article_feat f ON f.id = o.id")
def s08(spark, sf):
    path = scratch_path(spark, "feat")
    S.append(R.repeat_rows(_training(spark, sf)), "article_feat", path)
    rows = S.read_table(spark, "article_feat", path)
    rows = rows.withColumn("y", F.col("y").cast("bigint")).withColumn("f_img_n", F.col("f_img_n").cast("bigint"))
    return rows.select("y", *[c.strip() for c in _FEAT_COLUMNS.split(",")])


@query("s09_to_score", f"WITH {V.SQL_ARTICLES} SELECT id, score FROM articles WHERE score = 0 OR score IS NULL")
def s09(spark, sf):
    return L.to_score(V.articles(spark, sf)).select("id", "score")


@query("s10_set_scores", f"WITH {V.SQL_ARTICLES} SELECT id, CASE WHEN id % 4 = 1 THEN id / 8.0::DOUBLE ELSE score END AS score FROM articles")
def s10(spark, sf):
    store = article_store(spark, scratch_path(spark, "article"))
    store.append(V.articles(spark, sf))
    new = V.table(spark, sf, "documents").filter(F.col("doc_id") % 4 == 1).select(
        F.col("doc_id").alias("id"), (F.col("doc_id") / 8.0).alias("score")
    )
    for _ in range(2):  # run again, it gives the same
        store_scores(store, new)
    return store.read().select("id", "score")


@query("s11_append_events",
       f"WITH {V.SQL_EVENTS} SELECT id, name, 't' || user_id AS tid, CASE WHEN name = 'show' THEN k || ',' || ((k + 1) % 100) END AS articles, "
       "CASE WHEN name <> 'show' THEN k::VARCHAR END AS article_id FROM article_event WHERE name IN ('show', 'click', 'like', 'hate')")
def s11(spark, sf):
    path = scratch_path(spark, "events")
    e = V.events(spark, sf)
    attrs = F.create_map(
        F.lit("_tid"), F.get_json_object("evt_attr", "$._tid"),
        F.when(F.col("name") == "show", "articles").otherwise("article_id"),
        F.coalesce(F.get_json_object("evt_attr", "$.articles"), F.get_json_object("evt_attr", "$.article_id")),
    )
    S.append(E.accepted(e.withColumn("evt_attr", E.attrs_json(attrs))), "article_event", path)
    stored = S.read_table(spark, "article_event", path)
    found = {"tid": "_tid", "articles": "articles", "article_id": "article_id"}
    return stored.select("id", "name", *[F.get_json_object("evt_attr", f"$.{p}").alias(c) for c, p in found.items()])


@query("s12_count_likes",
       f"WITH {V.SQL_ARTICLES} SELECT id, CASE WHEN n_like IS NULL THEN NULL ELSE n_like * 2 END AS n_like FROM articles")
def s12(spark, sf):
    store = article_store(spark, scratch_path(spark, "article"))
    store.append(V.articles(spark, sf))
    for _ in range(2):  # the same batch counts once
        store_likes(store, V.events(spark, sf))
    return store.read().select("id", F.col("n_like").cast("bigint").alias("n_like"))


@query("s16_ranked_json",
       f"""WITH {V.SQL_ARTICLES}, top AS (SELECT id, title, link, row_number() OVER (ORDER BY score DESC, id) AS rank FROM articles WHERE score > 0.1)
 SELECT rank, '{V.AS_OF_TEXT}' AS updated, id, title, link FROM top WHERE rank <= 50""")
def s16(spark, sf):
    path = scratch_path(spark, "ranked")
    best = L.best(V.articles(spark, sf).filter(F.col("score") > 0.1), 50)
    ranked = global_rank(best, F.desc("score"), F.asc("id"), partitions=1)
    S.write_ranked(ranked.select("rank", "id", "title", "link"), V.AS_OF_TEXT, path)
    schema = "updateTime string, articles array<struct<id: bigint, title: string, link: string>>"
    stored = spark.read.text(path).select(F.from_json("value", schema).alias("d"))
    rows = stored.select(F.col("d.updateTime").alias("updated"), F.posexplode("d.articles").alias("p", "a"))
    return rows.select((F.col("p") + 1).cast("bigint").alias("rank"), "updated", "a.id", "a.title", "a.link")


# ---------------------------------------------------------------- scores

_SCORES = f"""{Q.ARTICLE_FEATURES}, {Q.sql_article_entries()}, {V.SQL_MODEL},
 scores AS (SELECT id, round(sum(weight) + {V.SQL_INTERCEPT}, 9) AS new FROM entries JOIN model USING (idx) GROUP BY id)"""


def _scores(spark, sf, model=None):
    rows = with_article_entries(article_features(V.texts(spark, sf)), V.as_of())
    return decision_values(rows, model or V.model(spark)).select("id", "score")


@query("ml02_article_scores", _SCORES + " SELECT id, round(new, 6) AS score FROM scores")
def ml02(spark, sf):
    return _scores(spark, sf).select("id", F.round("score", 6).alias("score"))


@query("ml02_block_scores", P.BLOCK_SCORES + " SELECT page_id, pre, round(score, 6) AS score FROM scored")
def ml02_blocks(spark, sf):
    return P.scored(spark, sf).select("page_id", F.col("pre").cast("bigint").alias("pre"), F.round("score", 6).alias("score"))


@query("s17_stored_model", SQL["ml02_article_scores"])
def s17(spark, sf):
    path = scratch_path(spark, "model")
    save_model(V.model(spark), path)
    return _scores(spark, sf, load_model(spark, path, "rule")).select("id", F.round("score", 6).alias("score"))


@query("ml03_score_unscored",
       _SCORES + " SELECT a.id, round(CASE WHEN coalesce(a.score, 0) = 0 THEN s.new ELSE a.score END, 6) AS score FROM articles a JOIN scores s USING (id)")
def ml03(spark, sf):
    rows = R.score_articles(V.articles(spark, sf), V.model(spark), V.as_of())
    return rows.select("id", F.round("score", 6).alias("score"))


@query("ml03_rescore_all", SQL["ml02_article_scores"])
def ml03_all(spark, sf):
    rows = R.score_articles(V.articles(spark, sf), V.model(spark), V.as_of(), rescore_all=True)
    return rows.select("id", F.round("score", 6).alias("score"))


@query("ml05_classes", _SCORES + " SELECT id, CASE WHEN new > 0 THEN 1 ELSE -1 END::BIGINT AS class FROM scores")
def ml05(spark, sf):
    return _scores(spark, sf).select("id", predicted_class(F.col("score")).cast("bigint").alias("class"))


@query("a08_accuracy",
       _SCORES + " SELECT count(*) AS n, round(avg(CASE WHEN (new > 0) = (quality = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM scores JOIN labels ON doc_id = id")
def a08(spark, sf):
    from leafsift.operators.linear import accuracy

    y = F.when(F.col("quality") == 1, 1).otherwise(-1)
    labels = V.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), y.alias("y"))
    return accuracy(_scores(spark, sf).join(labels, "id")).select("n", F.round("accuracy", 6).alias("accuracy"))


@query("a09_nonzero_weights",
       # weights by rule, each moved by how many documents' texts fall into its slot
       f"WITH {V.SQL_MODEL}, used AS (SELECT {V.sql_bucket('text', 10000)} AS idx, count(*) AS n FROM documents GROUP BY 1) "
       "SELECT idx::BIGINT AS idx, trunc((weight + coalesce(n, 0)) * 1e3) / 1e3 AS weight FROM model LEFT JOIN used USING (idx) WHERE abs(weight + coalesce(n, 0)) > 0")
def a09(spark, sf):
    from leafsift.functions.hashing import md5_bucket
    from leafsift.operators.linear import nonzero_weights

    used = V.table(spark, sf, "documents").groupBy(md5_bucket(F.col("text"), 10_000).alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    moved = V.model(spark).join(used, "idx", "left").withColumn("weight", F.col("weight") + F.coalesce("n", F.lit(0)))
    return nonzero_weights(moved).select(F.col("idx").cast("bigint").alias("idx"), "weight")


# ---------------------------------------------------------------- joins


@query("j01_feedback",
       f"WITH {V.SQL_ARTICLES} SELECT b.id, CASE WHEN name = 'like' THEN 1 ELSE -1 END::BIGINT AS y, b.link, b.title, strlen(b.body) AS n_body, b.date "
       "FROM article_event a JOIN articles b ON a.k = b.id WHERE a.name IN ('like', 'hate')")
def j01(spark, sf):
    a = V.articles(spark, sf).withColumn("n_body", F.octet_length("body").cast("bigint"))
    rows = E.feedback(V.events(spark, sf), a, ["link", "title", "n_body", "date"])
    return rows.withColumn("y", F.col("y").cast("bigint"))


@query("j01_latest_opinion",
       f"""WITH {V.SQL_EVENTS} SELECT k AS id, CASE WHEN max(time) FILTER (name = 'hate') IS NULL
 OR max(time) FILTER (name = 'like') >= max(time) FILTER (name = 'hate') THEN 1 ELSE -1 END::BIGINT AS y
 FROM article_event WHERE name IN ('like', 'hate') GROUP BY k""")
def j01_latest(spark, sf):
    return E.latest_opinions(V.events(spark, sf)).select("id", F.col("y").cast("bigint").alias("y"))


@query("j04_unfeatured", f"WITH {V.SQL_ARTICLES} SELECT a.id FROM articles a WHERE a.id NOT IN (SELECT doc_id FROM labels)")
def j04(spark, sf):
    return J.unprocessed(V.articles(spark, sf), V.table(spark, sf, "labels"), "id", "doc_id").select("id")


@query("j05_with_tag", _WITH_TAGS + " SELECT id, title FROM articles WHERE id IN (SELECT article_id FROM tags WHERE name = 'fr')")
def j05(spark, sf):
    return J.with_tag(V.articles(spark, sf), V.tags(spark, sf), "fr").select("id", "title")


@query("j06_tags_of", _WITH_TAGS + " SELECT a.id, coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM tags t WHERE t.article_id = a.id), '') AS tags FROM articles a")
def j06(spark, sf):
    return J.tags_of(V.articles(spark, sf), V.tags(spark, sf)).select("id", F.array_join("tags", ",").alias("tags"))


@query("j07_with_ids", f"WITH {V.SQL_ARTICLES} SELECT id, title FROM articles WHERE id IN (SELECT DISTINCT k FROM article_event WHERE name = 'click')")
def j07(spark, sf):
    clicks = V.events(spark, sf).filter(F.col("name") == "click")
    return J.with_ids(V.articles(spark, sf), clicks.select(E.article_id(F.col("evt_attr")).alias("id"))).select("id", "title")


# ---------------------------------------------------------------- aggregations


@query("a01_distinct", "SELECT DISTINCT lang, source FROM documents")
def a01(spark, sf):
    return V.table(spark, sf, "documents").select("lang", "source").distinct()


@query("a02_distinct_words", f"SELECT doc_id AS id, len(list_distinct({Q.SQL_WORD.format('text')})) AS n FROM documents")
def a02(spark, sf):
    from leafsift.functions.text import words

    return V.articles(spark, sf).select("id", F.size(F.array_distinct(words(F.col("text")))).cast("bigint").alias("n"))


@query("a03_counts_by_predicate", P._TREE + " SELECT page_id, count(*) FILTER (tag = 'a') AS n_a, count(*) FILTER (tag IN ('p', 'blockquote')) AS n_p, count(*) FILTER (tag LIKE '#%') AS n_other FROM nodes GROUP BY page_id")
def a03(spark, sf):
    from leafsift.operators.tree import node_table

    return node_table(V.cleaned(spark, sf)).groupBy("page_id").agg(
        F.count_if(F.col("tag") == "a").alias("n_a"), F.count_if(F.col("tag").isin("p", "blockquote")).alias("n_p"),
        F.count_if(F.startswith("tag", F.lit("#"))).alias("n_other"),
    )


@query("a04_subtree_extremes", P._FEATS + " SELECT page_id, sum(f_text_n)::BIGINT AS bytes, max(f_element_maxtextlen) AS longest, max(f_dom_depth) AS deepest, min(f_depth_to_p) AS nearest FROM feats GROUP BY page_id")
def a04(spark, sf):
    rows = Q._block_features(spark, sf, False)
    return rows.groupBy("page_id").agg(
        F.sum("f_text_n").alias("bytes"), F.max("f_element_maxtextlen").alias("longest"), F.max("f_dom_depth").alias("deepest"),
        F.min("f_depth_to_p").alias("nearest"),
    )


@query("a07_summed_entries", f"{Q.ARTICLE_FEATURES}, {Q.sql_article_entries()} SELECT idx::BIGINT AS idx, count(*)::DOUBLE AS value FROM entries GROUP BY idx")
def a07(spark, sf):
    from leafsift.operators.encoding import sum_entries

    rows = encode_articles(article_features(V.texts(spark, sf)), ["id"], V.as_of())
    return sum_entries(rows, []).select(F.col("idx").cast("bigint").alias("idx"), "value")


SQL_COUNTERS = f"""WITH {V.SQL_EVENTS}, named AS (
  SELECT name, unnest(CASE WHEN name = 'show' THEN [k, (k + 1) % 100] ELSE [k] END) AS id FROM article_event
  WHERE name IN ('show', 'click', 'like', 'hate')),
 counted AS (SELECT id, count(*) FILTER (name = 'show') AS n_show, count(*) FILTER (name = 'click') AS n_click,
  count(*) FILTER (name = 'like') AS n_like, count(*) FILTER (name = 'hate') AS n_hate FROM named GROUP BY id)"""


@query("a11_counters", SQL_COUNTERS + " SELECT *, CASE WHEN n_show > 0 THEN round(n_click / n_show::DOUBLE, 6) END AS ctr FROM counted")
def a11(spark, sf):
    return E.counters(V.events(spark, sf)).withColumn("ctr", F.round("ctr", 6))


@query("w04_global_rank", f"WITH {V.SQL_ARTICLES} SELECT id, row_number() OVER (ORDER BY coalesce(score, 0) DESC, id) AS rank FROM articles")
def w04(spark, sf):
    rows = V.articles(spark, sf).select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return global_rank(rows, F.desc("score"), F.asc("id")).select("id", "rank")
