"""Features to sparse (idx, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions.dates import parse_date_text
from leafsift.functions.hashing import md5_buckets

WIDTH = 10_000
DENSE_WIDTH = 1_000

# Slot order of the dense block features.
SLOTS = (
    "f_p_n", "f_tag_n", "f_h_n", "f_np_n", "f_text_n", "f_img_n", "f_a_n", "f_form_element_n", "f_element_maxtextlen",
    "f_none_n", "f_side_n", "f_main_n", "f_child_div_n", "f_child_p_n", "f_link_density", "f_nav_n", "f_li_n", "f_li_a_n",
    "f_h1_n", "f_dom_depth", "f_depth_to_p",
)


def require_frame(data: object) -> DataFrame:
    if not isinstance(data, DataFrame):
        raise TypeError(f"expected a DataFrame, got {type(data).__name__}")
    return data


def scaled(name: str) -> Column:
    """Counts on a log scale; link density on its own log scale."""
    if name == "f_link_density":
        return F.log(F.lit(1e-4) + F.col(name))
    return F.log1p(F.col(name).cast("double"))


def scale_features(features: DataFrame) -> DataFrame:
    return features.select(*[scaled(c).alias(c) if c in SLOTS else F.col(c) for c in features.columns])


def _entry(idx: Column, value: Column) -> Column:
    return F.struct(idx.cast("int").alias("idx"), value.cast("double").alias("value"))


def dense_entries() -> list[Column]:
    return [_entry(F.lit(slot), scaled(name)) for slot, name in enumerate(SLOTS)]


def _ones(idx: Column) -> Column:
    return F.transform(idx, lambda i: _entry(i, F.lit(1.0)))


def _sparse(texts: Column) -> Column:
    buckets = md5_buckets(texts, WIDTH - DENSE_WIDTH)
    return _ones(F.transform(buckets, lambda b: b + DENSE_WIDTH))


def _step_text(name: str) -> Column:
    return F.concat(F.lit(f"{name}:"), (scaled(name) * 3).cast("int").cast("string"))


def step_entries() -> Column:
    """Each scaled feature once more, cut into steps of a third and hashed."""
    return _sparse(F.array(*[_step_text(name) for name in SLOTS]))


def tag_entries(tags: Column) -> Column:
    return _sparse(F.transform(tags, lambda t: F.concat(F.lit("f_all_tags:"), t)))


def with_block_entries(features: DataFrame) -> DataFrame:
    """Adds ``entries``, the (idx, value) list of each block's features; duplicates are not yet summed."""
    parts = [F.array(*dense_entries()), step_entries()]
    if "f_all_tags" in require_frame(features).columns:
        parts.append(tag_entries(F.col("f_all_tags")))
    return features.withColumn("entries", F.concat(*parts))


def encode_blocks(features: DataFrame, keys: list[str]) -> DataFrame:
    """Long rows ``keys, idx, value`` of block features; duplicates are not yet summed."""
    return with_block_entries(features).select(*keys, F.inline("entries"))


def age_step(date: Column, as_of: Column) -> Column:
    """Age in steps that double; a date still to come is new (step 0), a missing one has the step -1."""
    hours = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp(date)) / 3600)
    return F.when(date.isNull(), F.lit(-1)).otherwise(F.log2(1 + hours / 4).cast("int"))


def length_step(length: Column) -> Column:
    return F.log2((F.lit(1) + F.floor(length / 500)).cast("double")).cast("int")


def image_step(images: Column) -> Column:
    return F.log2((F.lit(1) + images).cast("double")).cast("int")


def _named(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), value.cast("string"))


def site_text() -> Column:
    return _named("f_site", F.col("f_site"))


def keyword_texts(name: str) -> Column:
    """Empty text still gives one empty keyword."""
    return F.transform(F.split(F.col(name), ","), lambda k: _named(name, k))


def hashed(texts: Column) -> Column:
    return _ones(md5_buckets(texts, WIDTH))


def article_entries(as_of: Column) -> Column:
    single = [
        site_text(),
        _named("f_date", age_step(parse_date_text(F.col("f_date")), as_of)),
        _named("f_content_len", length_step(F.col("f_content_len"))),
        _named("f_img_n", image_step(F.col("f_img_n"))),
    ]
    return hashed(F.concat(F.array(*single), keyword_texts("f_title_keywords"), keyword_texts("f_content_keywords")))


def with_article_entries(features: DataFrame, as_of: Column) -> DataFrame:
    """Adds ``entries``, the (idx, value) list of each article's features; ages are taken at ``as_of``."""
    return require_frame(features).withColumn("entries", article_entries(as_of))


def encode_articles(features: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Long rows ``keys, idx, value`` of article features; ages are taken at ``as_of``."""
    return with_article_entries(features, as_of).select(*keys, F.inline("entries"))


def sum_entries(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse rows with duplicate positions summed."""
    return encoded.groupBy(*keys, "idx").agg(F.sum("value").alias("value"))


def as_examples(encoded: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with parallel ``idx`` and ``value`` arrays in index order; a feature that is null has no position and is left out."""
    entry = F.when(F.col("idx").isNotNull(), F.struct("idx", "value"))
    rows = sum_entries(encoded, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select(*keys, F.col("e.idx").alias("idx"), F.col("e.value").alias("value"))
