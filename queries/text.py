"""Words, keywords, vectors, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafsift.functions.text import keyword_csv, words
from leafsift.operators import keywords as K
from leafsift.operators import profile as R
from leafsift.operators import vectors as W
from leafsift.operators.diversify import best_similarity, diversify, similar_to
from leafsift.plans.tagging import tag_articles
from leafsift.session import cut, stored
from queries import encoding as E
from queries import registrar
from queries import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)

_WORD = E.SQL_WORD.format("text")


@query("t01_words", f"SELECT doc_id AS id, len(w) AS n, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {_WORD} AS w FROM documents)")
def t01(spark, sf):
    rows = V.texts(spark, sf).select("id", words(F.col("text")).alias("w"))
    return rows.select("id", F.size("w").cast("bigint").alias("n"), F.array_join("w", " ").alias("words"))


@query("t01_chat_words", f"SELECT conv_id, turn, len({_WORD}) AS n FROM conversations")
def t01_chat(spark, sf):
    c = V.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.size(words(F.col("text"))).cast("bigint").alias("n"))


def _top_sql(column, k):
    return f"WITH {V.SQL_ARTICLES}, {E.sql_keywords('kw', 'articles', column, k)} SELECT id, word, round(weight, 6) AS weight, rank FROM kw"


def _top(rows):
    return rows.select("id", "word", F.round("weight", 6).alias("weight"), F.col("rank").cast("bigint").alias("rank"))


@query("t02_title_keywords", _top_sql("title", 20))
def t02_title(spark, sf):
    return _top(K.top_keywords(V.texts(spark, sf), "id", "title", 20))


@query("t02_body_keywords", _top_sql("text", 200))
def t02_body(spark, sf):
    return _top(K.top_keywords(V.texts(spark, sf), "id", "text", 200))


@query("w02_top10_keywords", _top_sql("text", 10))
def w02(spark, sf):
    return _top(K.top_keywords(V.texts(spark, sf), "id", "text", 10))


def _quoted(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _tokens_sql(name, stop):
    return f"{name} AS (SELECT doc_id AS id, list_filter({_WORD}, lambda w: NOT list_contains({_quoted(stop)}, w)) AS w FROM documents)"


def _edges_sql(name, tokens, span):
    pairs = " UNION ALL ".join(
        f"SELECT id, unnest(w[1:len(w) - {g}]) AS a, unnest(w[{g + 1}:]) AS b FROM {tokens} WHERE len(w) > {g}" for g in range(1, span)
    )
    return f"""{name} AS (
  SELECT id, src, dst, count(*) AS weight FROM (
    SELECT id, a AS src, b AS dst FROM ({pairs}) UNION ALL SELECT id, b, a FROM ({pairs})) GROUP BY id, src, dst)"""


def _rank_sql(tag, tokens, span, k=10):
    """CTEs ending in ``{tag}_top``: ten unrolled rounds of the co-occurrence rank."""
    parts = [
        _edges_sql(f"{tag}_e", tokens, span),
        f"{tag}_o AS (SELECT id, src, sum(weight) AS total FROM {tag}_e GROUP BY id, src)",
        f"{tag}_m AS (SELECT e.id, e.src, e.dst, e.weight::DOUBLE / o.total AS share FROM {tag}_e e JOIN {tag}_o o USING (id, src))",
        f"{tag}_0 AS (SELECT id, src AS word, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) AS s FROM {tag}_o)",
    ]
    for r in range(1, K.RANK_ROUNDS + 1):
        parts.append(
            f"{tag}_{r} AS (SELECT m.id, m.dst AS word, {1 - K.DAMPING:.2f} + {K.DAMPING} * sum(m.share * p.s) AS s "
            f"FROM {tag}_m m JOIN {tag}_{r - 1} p ON p.id = m.id AND p.word = m.src GROUP BY m.id, m.dst)"
        )
    parts.append(
        f"{tag}_top AS (SELECT * FROM (SELECT id, word, round(s, 9) AS weight, row_number() OVER (PARTITION BY id "
        f"ORDER BY round(s, 9) DESC, word) AS rank FROM {tag}_{K.RANK_ROUNDS}) WHERE rank <= {k})"
    )
    return ", ".join(parts)


@query("t03_edges",
       f"WITH {_tokens_sql('tw', K.STOP_WORDS)}, {_edges_sql('e', 'tw', K.WIDE_SPAN)} "
       "SELECT id, src, count(*) AS partners, sum(weight)::BIGINT AS weight, min(dst) AS lowest, max(weight) AS heaviest FROM e GROUP BY id, src")
def t03_edges(spark, sf):
    rows = K.cooccurrence_edges(V.texts(spark, sf), "id", K.wide_tokens(F.col("text")), K.WIDE_SPAN, grouped=True)
    return rows.select(
        "id", "src", F.size("edges").cast("bigint").alias("partners"), F.aggregate("edges.weight", F.lit(0).cast("bigint"), lambda s, w: s + w).alias("weight"),
        F.array_min("edges.dst").alias("lowest"), F.array_max("edges.weight").alias("heaviest"),
    )


def _ranked(rows):
    return rows.select("id", "word", F.round("weight", 6).alias("weight"), F.col("rank").cast("bigint").alias("rank"))


@query("t03_textrank", f"WITH {_tokens_sql('tw', K.STOP_WORDS)}, {_rank_sql('r', 'tw', K.WIDE_SPAN)} SELECT id, word, round(weight, 6) AS weight, rank FROM r_top")
def t03(spark, sf):
    return _ranked(K.textrank(V.texts(spark, sf), "id", "text"))


@query("t04_english_textrank", f"WITH {_tokens_sql('tn', K.ENGLISH_STOP_WORDS)}, {_rank_sql('r', 'tn', K.NARROW_SPAN)} SELECT id, word, round(weight, 6) AS weight, rank FROM r_top")
def t04(spark, sf):
    return _ranked(K.english_textrank(V.texts(spark, sf), "id", "text"))


def _fallback_sql(source="documents", corpus=None):
    corpus = corpus or source
    return f"""{_tokens_sql('tw', K.STOP_WORDS).replace('FROM documents', f'FROM {source}')},
 {_tokens_sql('tn', K.ENGLISH_STOP_WORDS).replace('FROM documents', f'FROM {source}')},
 routes AS (SELECT a.id, CASE WHEN len(a.w) >= 2 THEN 'wide' WHEN len(b.w) >= 2 THEN 'narrow' ELSE 'tfidf' END AS source
            FROM tw a JOIN tn b USING (id)),
 {_rank_sql('a', 'tw', K.WIDE_SPAN)}, {_rank_sql('b', 'tn', K.NARROW_SPAN)},
 fd AS (SELECT doc_id AS id, text FROM {source}), fc AS (SELECT doc_id AS id, text FROM {corpus}), {E.sql_keywords('c', 'fd', 'text', 10, 'fc')},
 fallback AS (
  SELECT id, word, rank, source FROM (
    SELECT id, word, rank, 'wide' AS source FROM a_top UNION ALL SELECT id, word, rank, 'narrow' FROM b_top
    UNION ALL SELECT id, word, rank, 'tfidf' FROM c) JOIN routes USING (id, source))"""


# Every third text is cut to words of one of the stop lists, so that all three methods are used.
_SHORT = """short AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'the of and ' || source || ' one'
 WHEN doc_id % 3 = 1 THEN 'if or about ' || doc_id ELSE text END AS text FROM documents)"""


@query("t05_fallback", f"WITH {_SHORT}, {_fallback_sql('short')} SELECT id, word, rank, source FROM fallback")
def t05(spark, sf):
    doc = V.table(spark, sf, "documents")
    text = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("the of and "), "source", F.lit(" one")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("if or about "), F.col("doc_id").cast("string")))
        .otherwise(F.col("text"))
    )
    rows = K.tags_with_fallback(doc.select(F.col("doc_id").alias("id"), text.alias("text")), "id", "text")
    return rows.select("id", "word", F.col("rank").cast("bigint").alias("rank"), "source")


@query("t06_new_tags",
       f"WITH {V.SQL_TAGS}, left_over AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT article_id FROM tags WHERE article_id IS NOT NULL)), "
       f"{_fallback_sql('left_over', 'documents')} SELECT DISTINCT word AS name, id AS article_id FROM fallback")
def t06(spark, sf):
    return tag_articles(V.texts(spark, sf), V.tags(spark, sf))


def sql_vectors(source: str = "articles", column: str = "text") -> str:
    """CTE ``vec(id, word, weight)``: normalised TF-IDF."""
    w = E.SQL_WORD.format(column)
    return f"""
v_t AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest({w}) AS word FROM {source}) GROUP BY id, word),
v_i AS (SELECT word, ln((1 + (SELECT count(*) FROM {source}))::DOUBLE / (1 + count(*))) + 1 AS idf FROM v_t GROUP BY word),
v_w AS (SELECT id, word, tf * idf AS x FROM v_t JOIN v_i USING (word)),
vec AS MATERIALIZED (SELECT id, word, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM v_w)"""


@query("t07_tfidf", f"WITH {V.SQL_ARTICLES}, {sql_vectors()} SELECT id, word, round(weight, 6) AS weight FROM vec")
def t07(spark, sf):
    entries = W.vector_entries(W.tfidf_vectors(V.texts(spark, sf), "id", "text"))
    return entries.select("id", "word", F.round("weight", 6).alias("weight"))


@query("a10_document_frequency",
       f"SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_WORD}) AS word FROM documents) GROUP BY word")
def a10(spark, sf):
    return W.document_frequency(W.document_words(V.texts(spark, sf), "id", "text"))


def ranked_documents(spark, sf):
    a = V.articles(spark, sf).select("id", F.coalesce("score", F.lit(0.0)).alias("score"), "text")
    return W.tfidf_vectors(a, "id", "text", keep=("score",))


def sql_kept(ranked: str, threshold: float = 0.05) -> str:
    """CTEs ``ordered``, ``near`` and ``kept(rank, id, place)``: the row-by-row loop. ``ranked`` selects id, score."""
    return f"""
ordered AS MATERIALIZED (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM ({ranked})),
placed AS MATERIALIZED (SELECT o.place, v.word, v.weight FROM vec v JOIN ordered o USING (id)),
near AS MATERIALIZED (
  SELECT hi, list(lo) AS los FROM (
    SELECT b.place AS hi, a.place AS lo FROM placed a JOIN placed b ON a.word = b.word AND a.place < b.place
    GROUP BY a.place, b.place HAVING sum(a.weight * b.weight) >= {threshold})
  GROUP BY hi),
walk AS MATERIALIZED (
  WITH RECURSIVE loop(i, kept) AS (
    SELECT 0::BIGINT, []::BIGINT[]
    UNION ALL
    SELECT l.i + 1, CASE WHEN list_has_any(l.kept, coalesce(n.los, []::BIGINT[])) THEN l.kept ELSE list_append(l.kept, l.i + 1) END
    FROM loop l LEFT JOIN near n ON n.hi = l.i + 1 WHERE l.i < (SELECT max(place) FROM ordered)
  ) SELECT i, kept FROM loop
),
kept AS (
  SELECT row_number() OVER (ORDER BY place) AS rank, o.id, o.score, o.place
  FROM (SELECT unnest(kept) AS place FROM walk WHERE i = (SELECT max(i) FROM walk)) k JOIN ordered o USING (place)
)"""


_KEPT = f"WITH {V.SQL_ARTICLES}, {sql_vectors()}, {sql_kept('SELECT id, coalesce(score, 0) AS score FROM articles WHERE id IN (SELECT id FROM vec)')}"


def _kept(spark, sf):
    ranked = ranked_documents(spark, sf)
    return ranked, cut(diversify(ranked.select("score", "id", "terms", "weights"), vectors=True))


def _repeated(rows):
    """``id, score`` of the rows whose id other rows have as well, stored: few rows or none, as a rule."""
    ids = rows.groupBy("id").count().filter("count > 1").select("id")
    return stored(rows.select("id", "score").join(ids, "id", "left_semi"), "repeated")


@query("ml06_diversified", _KEPT + " SELECT rank, id, score FROM kept")
def ml06(spark, sf):
    rows = diversify(ranked_documents(spark, sf).select("score", "id", "terms", "weights"))
    return rows.select(F.col("rank").cast("bigint").alias("rank"), "id", "score")


_TO_KEPT = _KEPT + """, sims AS (SELECT a.id, k.id AS target, k.place AS target_place, sum(a.weight * b.weight) AS similarity
 FROM kept k JOIN vec b ON b.id = k.id JOIN vec a ON a.word = b.word GROUP BY a.id, k.id, k.place)"""


@query("t08_cosine_to_kept", _TO_KEPT + " SELECT id, target, round(similarity, 6) AS similarity FROM sims WHERE similarity >= 0.05")
def t08(spark, sf):
    rows = similar_to(*_kept(spark, sf), 0.05)
    return rows.select("id", "target", F.round("similarity", 6).alias("similarity"))


@query("j08_similar_to_better",
       _TO_KEPT + " SELECT s.id, s.target, round(similarity, 6) AS similarity FROM sims s JOIN ordered o USING (id) "
       "WHERE o.place > s.target_place AND similarity >= 0.05")
def j08(spark, sf):
    ranked, kept = _kept(spark, sf)
    # a pair brings its scores along; only ids that several rows have meet all scores of theirs
    mine = _repeated(ranked).select("id", F.col("score").alias("_mine"))
    theirs = _repeated(kept).select(F.col("id").alias("target"), F.col("score").alias("_theirs"))
    pairs = similar_to(ranked, kept, 0.05, keep=("score",)).filter("id IS NOT NULL AND target IS NOT NULL")
    pairs = pairs.join(mine, "id", "left").join(theirs, "target", "left")
    own, other = F.coalesce("_mine", "score"), F.coalesce("_theirs", "target_score")
    rows = pairs.filter((own < other) | ((own == other) & (F.col("id") > F.col("target"))))
    return rows.select("id", "target", F.round("similarity", 6).alias("similarity"))


@query("a06_best_similarity", _TO_KEPT + " SELECT id, round(max(similarity), 6) AS similarity FROM sims GROUP BY id")
def a06(spark, sf):
    return best_similarity(*_kept(spark, sf)).select("id", F.round("similarity", 6).alias("similarity"))


@query("t09_keyword_csv",
       f"WITH {V.SQL_ARTICLES}, {E.sql_keywords('kw', 'articles', 'text', 20)} SELECT id, string_agg(lower(word), ',' ORDER BY rank) AS csv FROM kw GROUP BY id")
def t09(spark, sf):
    ranked = K.top_keywords(V.texts(spark, sf), "id", "text", 20).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("k"))
    return ranked.select("id", keyword_csv(F.col("k.word")).alias("csv"))


@query("t10_article_features", E.ARTICLE_FEATURES + " SELECT * FROM article_feat")
def t10(spark, sf):
    return R.article_features(V.texts(spark, sf)).withColumn("f_img_n", F.col("f_img_n").cast("bigint"))


SQL_PROFILE = f"""{V.SQL_ARTICLES},
judged AS (SELECT DISTINCT k AS id, name AS opinion FROM article_event WHERE name IN ('like', 'hate')
           AND time > TIMESTAMP '{V.AS_OF_TEXT}' - INTERVAL 48 HOUR AND time <= TIMESTAMP '{V.AS_OF_TEXT}'),
chosen AS (SELECT * FROM articles WHERE id IN (SELECT id FROM judged)),
{E.sql_keywords("pt", "chosen", "title", 20, "articles")}, {E.sql_keywords("pb", "chosen", "text", 200, "articles")},
profile AS (
  SELECT DISTINCT opinion, 'title' AS field, lower(word) AS word FROM pt JOIN judged USING (id)
  UNION SELECT DISTINCT opinion, 'content', lower(word) FROM pb JOIN judged USING (id)
)"""


@query("t11_recent_profile", f"WITH {SQL_PROFILE} SELECT opinion, field, word FROM profile")
def t11(spark, sf):
    return R.recent_profile(V.events(spark, sf), V.texts(spark, sf), V.as_of())


@query("t12_profile_similarity",
       f"""WITH {SQL_PROFILE}, {sql_vectors()},
 pv AS (SELECT opinion, word, idf / sqrt(sum(idf * idf) OVER (PARTITION BY opinion)) AS weight
        FROM profile JOIN v_i USING (word) WHERE field = 'content'),
 sims AS (SELECT v.id, p.opinion, sum(v.weight * p.weight) AS s FROM vec v JOIN pv p USING (word) GROUP BY v.id, p.opinion)
 SELECT a.id, round(coalesce((SELECT s FROM sims x WHERE x.id = a.id AND opinion = 'like'), 0), 6) AS f_like_similarity,
        round(coalesce((SELECT s FROM sims x WHERE x.id = a.id AND opinion = 'hate'), 0), 6) AS f_hate_similarity FROM articles a""")
def t12(spark, sf):
    a = V.texts(spark, sf)
    rows = R.profile_similarity(a, R.recent_profile(V.events(spark, sf), a, V.as_of()))
    return rows.select("id", F.round("f_like_similarity", 6).alias("f_like_similarity"), F.round("f_hate_similarity", 6).alias("f_hate_similarity"))
