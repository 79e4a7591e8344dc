"""Raw pages to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.dates import asctime_to_date_text
from leafsift.functions.html import strip_noise
from leafsift.operators.blocks import FEATURES, best_blocks, block_features, ranked_blocks
from leafsift.operators.encoding import with_block_entries
from leafsift.operators.joins import unprocessed
from leafsift.operators.linear import decision_values
from leafsift.operators.profile import with_text
from leafsift.operators.tree import node_table
from leafsift.session import cut

KEYS = ["page_id", "pre", "src_start", "src_end", "f_text_n"]
MIN_TEXT_BYTES = 500


def clean_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[Column, ...] = ()) -> DataFrame:
    return pages.select(F.col(id_col).alias("page_id"), strip_noise(F.col(html_col)).alias("html"), *keep)


def dom_features(cleaned: DataFrame, with_tags: bool = True) -> DataFrame:
    return block_features(node_table(cleaned), with_tags=with_tags)


def score_blocks(cleaned: DataFrame, model: DataFrame) -> DataFrame:
    """``page_id, pre, src_start, src_end, f_text_n, score`` of every block."""
    return decision_values(with_block_entries(dom_features(cleaned)), model).select(*KEYS, "score")


def rank_blocks(cleaned: DataFrame, model: DataFrame) -> DataFrame:
    """All blocks of each page with features and score, best first."""
    keys = ["page_id", "pre", "last", "src_start", "src_end", *FEATURES]
    return ranked_blocks(decision_values(with_block_entries(dom_features(cleaned)), model).select(*keys, "score"))


def block_html(cleaned: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds the source of each block. Only page and offsets move; pages stored bucketed by id stay in place."""
    placed = blocks.join(cleaned.select("page_id", F.col("html").alias("_html")), "page_id")
    piece = F.substring(F.col("_html"), F.col("src_start") + 1, F.col("src_end") - F.col("src_start"))
    return placed.withColumn("body", piece).drop("_html")


def main_content(cleaned: DataFrame, model: DataFrame) -> DataFrame:
    """``page_id, body`` and the other columns of ``cleaned``: the main block of each page, empty if none qualifies.

    The chosen offsets, one narrow row a page, go to the pages. With pages stored bucketed by id
    (``tables.write_bucketed``) no HTML is shuffled.
    """
    chosen = best_blocks(score_blocks(cleaned.select("page_id", "html"), model)).select("page_id", "src_start", "src_end")
    placed = cleaned.join(chosen, "page_id", "left")
    piece = F.substring(F.col("html"), F.col("src_start") + 1, F.col("src_end") - F.col("src_start"))
    others = [c for c in cleaned.columns if c not in ("page_id", "html")]
    return placed.select("page_id", F.coalesce(piece, F.lit("")).alias("body"), *others)


def extract_articles(
    rss: DataFrame,
    model: DataFrame,
    done: DataFrame | None = None,
    html_col: str = "body",
    min_bytes: int = MIN_TEXT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """New articles ``(id, title, link, body, date, text)`` and the outcome ``(id, outcome)`` of every page tried.

    Recording outcomes keeps pages that fail the gate from being tried again. The bodies found are
    stored once when this is called, as both results read them.
    """
    fresh = rss if done is None else unprocessed(rss, done)
    header = (F.col("title"), F.col("link"), asctime_to_date_text(F.col("date")).alias("date"))
    bodies = main_content(clean_pages(fresh, "id", html_col, header), model).withColumnRenamed("page_id", "id")
    texts = cut(with_text(bodies, "body")).withColumn("_kept", F.octet_length("text") >= min_bytes)
    articles = texts.filter("_kept").select("id", "title", "link", "body", "date", "text", "f_img_n")
    outcome = F.when(F.col("_kept"), "article").otherwise("short")
    return articles, texts.select("id", outcome.alias("outcome"))
