"""Links, URL rules and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsift.functions import html as H
from leafsift.functions import urls as U
from leafsift.operators.projection import route_by_type
from leafsift.operators.tree import node_table, with_page_fields


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, url, href``: every link of every page, unresolved, as the page's tree has them."""
    found = with_page_fields(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.explode("hrefs").alias("href"))


def response_links(responses: DataFrame) -> DataFrame:
    """Links of routed responses ``(page_id, url, content_type, html)``: anchors of HTML, bare URLs of JSON."""
    routed = route_by_type(responses)
    is_json = F.col("route") == "json"
    split = routed.select(
        "page_id", "url", F.when(~is_json, F.col("html")).alias("html"), F.when(is_json, H.urls_in_json(F.col("html"))).alias("_found")
    )
    links = F.coalesce(F.col("_found"), F.col("hrefs"))
    return with_page_fields(split).select("page_id", "url", F.explode(links).alias("href"))


def resolve_links(links: DataFrame) -> DataFrame:
    return links.withColumn("target", U.resolve(F.col("url"), F.col("href")))


def matches_rules(url: Column, rules: list[tuple[str, list[str]]], mode: str = "first") -> Column:
    """Whether a URL passes the prefix rules.

    The first rule whose domain occurs in the URL's site decides; a site without a
    rule passes. ``first`` tests only that rule's first prefix, ``any`` all of them.
    """
    if mode not in ("first", "any"):
        raise ValueError(f"unknown mode {mode!r}")
    # A lambda variable keeps the URL from being resolved and parsed again for every rule.
    parsed = F.transform(F.array(url), lambda u: F.struct(U.site(u).alias("site"), U.path(u).alias("path")))
    return F.exists(parsed, lambda part: _verdict(part["site"], part["path"], rules, mode))


def _verdict(site: Column, path: Column, rules: list[tuple[str, list[str]]], mode: str) -> Column:
    verdict = F
    for domain, prefixes in rules:
        passes = F.lit(False)
        for prefix in prefixes[:1] if mode == "first" else prefixes:
            passes = passes | F.startswith(path, F.lit(prefix))
        verdict = verdict.when(F.contains(site, F.lit(domain)), passes)
    return verdict.otherwise(F.lit(True)) if rules else F.lit(True)


def in_domains(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of ``domains`` or below one."""
    suffixes = F.array(*[F.lit(f".{d}") for d in domains])

    def inside(name: Column) -> Column:
        return name.isin(*domains) | F.exists(suffixes, lambda suffix: F.endswith(name, suffix))

    return F.exists(F.transform(F.array(url), U.host), inside)


def not_seen(urls: DataFrame, seen: DataFrame | None, column: str = "target") -> DataFrame:
    """Each URL once, without its fragment and without those in ``seen(url)``."""
    fresh = urls.withColumn(column, U.without_fragment(F.col(column))).dropDuplicates([column])
    if seen is None:
        return fresh
    return fresh.join(seen.select(U.without_fragment(F.col("url")).alias(column)), column, "left_anti")


def frontier(
    pages: DataFrame,
    rules: list[tuple[str, list[str]]],
    domains: list[str] | None = None,
    seen: DataFrame | None = None,
    mode: str = "first",
) -> DataFrame:
    """URLs to crawl next with how many links lead to them: resolve, filter, drop known ones.

    With a ``content_type``, responses are routed first and JSON gives bare URLs. Only http targets
    count, and fragments are cut off. Counting by URL is the de-duplication: the map-side half of the aggregation
    shrinks even a URL that every page links to before it is shuffled.
    """
    links = response_links(pages) if "content_type" in pages.columns else page_links(pages)
    target = F.col("target")
    edges = resolve_links(links).filter(U.is_http(target)).withColumn("target", U.without_fragment(target))
    edges = edges.filter(matches_rules(target, rules, mode))
    if domains is not None:
        edges = edges.filter(in_domains(target, domains))
    counted = edges.groupBy("target").agg(F.count(F.lit(1)).alias("n_links"), F.min("page_id").alias("first_page"))
    if seen is not None:
        counted = counted.join(seen.select(U.without_fragment(F.col("url")).alias("target")), "target", "left_anti")
    return counted


def image_urls(articles: DataFrame, id_col: str = "id", html_col: str = "body", link_col: str = "link") -> DataFrame:
    """``id, src, image_url``: images of each article, resolved against its link."""
    plain = articles.select(F.col(id_col).alias("id"), F.col(link_col).alias("_link"), F.col(html_col).alias("_html"))
    rows = with_page_fields(plain, "_html").select("id", "_link", F.inline("images"))
    src = F.coalesce(F.nullif(F.col("src"), F.lit("")), F.col("data_src"))
    kept = rows.withColumn("src", src).filter(F.col("src").isNotNull() & ~F.startswith("src", F.lit("data:")))
    return kept.select("id", "src", U.resolve(F.col("_link"), F.col("src")).alias("image_url"))


def anchor_nodes(pages: DataFrame) -> DataFrame:
    """``page_id, pre, href``: the same links from the node table, with their places."""
    nodes = node_table(pages).filter((F.col("tag") == "a"))
    href = H.decode_entities(H.attribute(F.col("attrs"), "href"))
    return nodes.select("page_id", "pre", href.alias("href")).filter(F.col("href").isNotNull())
