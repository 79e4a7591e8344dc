"""Article features, the recent-feedback profile, and similarity to it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.urls import site
from leafsift.operators import events as E
from leafsift.operators.keywords import keyword_lists, top_keywords
from leafsift.operators.tree import TEXT, page_nodes
from leafsift.operators.vectors import corpus_idf, document_words, unit, vector_entries, weighted_words, word_idf
from leafsift.session import stored

TITLE_KEYWORDS, CONTENT_KEYWORDS = 20, 200


def with_text(rows: DataFrame, html_col: str = "body") -> DataFrame:
    """Adds the text of an HTML column and its image count; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, images = [], []
            for source in batch.column(batch.schema.get_field_index(html_col)).to_pylist():
                nodes = page_nodes(source or "")
                texts.append("".join(n[6] for n in nodes if n[4] == TEXT))
                images.append(sum(n[4] == "img" for n in nodes))
            columns = [*batch.columns, pa.array(texts, pa.string()), pa.array(images, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "text", "f_img_n"])

    plain = rows.drop("text", "f_img_n")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, f"{fields}, text string, f_img_n int")


def article_features(articles: DataFrame, title_idf: DataFrame | None = None, body_idf: DataFrame | None = None, complete: bool = False) -> DataFrame:
    """``id, f_site, f_title_keywords, f_content_keywords, f_date, f_content_len, f_img_n``.

    ``articles(id, title, link, date, text, f_img_n)`` carry their text. Only words
    are shuffled, never whole texts. ``complete`` says that the given idf have all words of ``articles``.
    """
    base = articles.select(
        "id",
        site(F.col("link")).alias("f_site"),
        F.col("date").alias("f_date"),
        F.octet_length("text").cast("bigint").alias("f_content_len"),
        F.col("f_img_n").cast("int").alias("f_img_n"),
    )
    titles = keyword_lists(articles, "id", "title", TITLE_KEYWORDS, "f_title_keywords", title_idf, complete)
    bodies = keyword_lists(articles, "id", "text", CONTENT_KEYWORDS, "f_content_keywords", body_idf, complete)
    joined = base.join(titles, "id", "left").join(bodies, "id", "left")
    return joined.select(
        "id",
        "f_site",
        F.coalesce("f_title_keywords", F.lit("")).alias("f_title_keywords"),
        F.coalesce("f_content_keywords", F.lit("")).alias("f_content_keywords"),
        "f_date",
        "f_content_len",
        "f_img_n",
    )


def recent_profile(events: DataFrame, articles: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """``opinion, field, word``: distinct keywords of articles liked or hated lately.

    One row a word rather than one list, as a profile grows with the feedback.
    Word weights come from the whole article table.
    """
    judged = E.opinions(E.recent(events, as_of, hours)).select(
        "id", F.when(F.col("y") == 1, "like").otherwise("hate").alias("opinion")
    )
    chosen = articles.join(judged.select("id").distinct(), "id", "left_semi")
    parts = []
    for field, column, k in (("title", "title", TITLE_KEYWORDS), ("content", "text", CONTENT_KEYWORDS)):
        keywords = top_keywords(chosen, "id", column, k, idf=corpus_idf(articles, column), complete=True)
        rows = keywords.join(judged, "id").select("opinion", F.lit(field).alias("field"), F.lower("word").alias("word"))
        parts.append(rows)
    return parts[0].unionByName(parts[1]).distinct()


def profile_vectors(profile: DataFrame, idf: DataFrame) -> DataFrame:
    """``target, word, weight``: content words of each opinion, weighted by idf, normalised."""
    rows = profile.filter(F.col("field") == "content").select("word", F.col("opinion").alias("target"))
    weighted = rows.join(idf.select("word", "idf"), "word")
    norms = weighted.groupBy("target").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("_n"))
    return weighted.join(F.broadcast(norms), "target").select("target", "word", (F.col("idf") / F.col("_n")).alias("weight"))


def profile_similarity(articles: DataFrame, profile: DataFrame) -> DataFrame:
    """``id, f_like_similarity, f_hate_similarity``: cosine of each article to the two profiles.

    Only the articles' words that stand in a profile are summed, each beside the norm of its whole article.
    """
    counted = stored(document_words(articles, "id", "text"), "words")
    idf = stored(word_idf(counted), "idf")
    to = lambda opinion: F.max(F.when(F.col("target") == opinion, F.col("weight")))
    weights = profile_vectors(profile, idf).groupBy("word").agg(to("like").alias("_like"), to("hate").alias("_hate"))
    rows = weighted_words(counted, idf, complete=True).select("id", "terms", unit(F.col("weights")).alias("weights"))
    entries = vector_entries(rows).join(weights, "word")
    near = entries.groupBy("id").agg(*[F.sum(F.col("weight") * F.col(f"_{o}")).alias(f"_s_{o}") for o in ("like", "hate")])
    return articles.select("id").join(near, "id", "left").select(
        "id",
        F.coalesce("_s_like", F.lit(0.0)).alias("f_like_similarity"),
        F.coalesce("_s_hate", F.lit(0.0)).alias("f_hate_similarity"),
    )
