"""Events and articles to a like model, scores and the daily list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.urls import rewrite_root_links
from leafsift.operators import listing
from leafsift.operators.diversify import diversify
from leafsift.operators.encoding import as_examples, encode_articles, with_article_entries
from leafsift.operators.events import latest_opinions, opinions, repeated
from leafsift.operators.linear import FitResult, decision_values, fit_l1_svm
from leafsift.operators.profile import article_features
from leafsift.operators.vectors import corpus_idf, tfidf_vectors
from leafsift.session import stored

LIKE_C = 0.1
BLOCK_C = 0.05


def weighted_rows(events: DataFrame, articles: DataFrame, known: DataFrame | None = None, latest_only: bool = False) -> DataFrame:
    """Training rows ``id, y, n, f_...`` of articles with feedback that are not in ``known`` yet.

    ``n`` is the number of equal rows: features are built once per article however
    many events it has.
    """
    if latest_only:
        counted = latest_opinions(events).withColumn("n", F.lit(1).cast("bigint"))
    else:
        counted = opinions(events)
    if known is not None:
        counted = counted.join(known.select("id").distinct(), "id", "left_anti")
    chosen = articles.join(counted.select("id").distinct(), "id", "left_semi")
    features = article_features(chosen, corpus_idf(articles, "title"), corpus_idf(articles, "text"), complete=True)
    return counted.join(features, "id")


def repeat_rows(weighted: DataFrame) -> DataFrame:
    """Stored form: one row per event."""
    return repeated(weighted, ["id", "y"])


def like_examples(weighted: DataFrame, as_of: Column) -> DataFrame:
    """``id, y, weight, idx, value``: weighted training rows as the fit reads them."""
    return as_examples(encode_articles(weighted, ["id", "y", "n"], as_of), ["id", "y", "n"]).withColumnRenamed("n", "weight")


def fit_like_model(weighted: DataFrame, as_of: Column, c: float = LIKE_C, tol: float = 1e-6, **options) -> FitResult:
    """Fit on weighted training rows; ages are taken at ``as_of``."""
    return fit_l1_svm(like_examples(weighted, as_of), c, tol=tol, **options)


def score_articles(articles: DataFrame, model: DataFrame, as_of: Column, rescore_all: bool = False) -> DataFrame:
    """Articles with their scores filled in; stored scores stay unless ``rescore_all``."""
    # read four times below, and the given articles may be joins
    held = stored(articles.select("id", "title", "link", "date", "text", "f_img_n", "score"), "articles")
    wanted = listing.to_score(held, rescore_all)
    if rescore_all:
        features = article_features(wanted)
    else:
        features = article_features(wanted, corpus_idf(held, "title"), corpus_idf(held, "text"), complete=True)
    scores = decision_values(with_article_entries(features, as_of), model).select("id", "score")
    return listing.set_scores(articles, scores)


def daily_list(
    articles: DataFrame, as_of: Column, top: int | None = 5000, threshold: float = 0.05, html: bool = True
) -> DataFrame:
    """``rank, score, id, title, link, body, date``: recent well-scored articles without near repeats.

    Jobs run while the frame is built.
    """
    chosen = listing.candidates(articles, as_of)
    vectors = tfidf_vectors(chosen, "id", "text", keep=("score",))
    # A text without words is like nothing, so it is always kept.
    empty = chosen.select("id", "score").join(vectors.select("id"), "id", "left_anti")
    nothing = [F.array().cast("array<string>").alias("terms"), F.array().cast("array<double>").alias("weights")]
    ranked = vectors.select("score", "id", "terms", "weights").unionByName(empty.select("score", "id", *nothing))
    kept = diversify(ranked, top, threshold).select("rank", "id")
    body = rewrite_root_links(F.col("body"), F.col("link")) if html else F.col("body")
    shown = chosen.select("id", "score", "title", "link", body.alias("body"), "date")
    # ``kept`` holds at most ``top`` rows; without that bound it is not small.
    return shown.join(kept if top is None else F.broadcast(kept), "id").select("rank", "score", "id", "title", "link", "body", "date")
