"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site(url: Column) -> Column:
    """Network location with its port; empty when the URL has none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def host(url: Column) -> Column:
    """Lower-case host: the site without user info and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(site(url), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)


def _merge_dots(raw: Column) -> Column:
    """Remove ``.`` and ``..`` segments from an absolute path."""
    parts = F.split(raw, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    joined = F.array_join(kept, "/")
    closed = F.when(last.isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(F.startswith(closed, F.lit("/")), closed).otherwise(F.concat(F.lit("/"), closed))


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of ``link`` as seen on page ``base`` (RFC 3986, section 5)."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    link_path = F.regexp_extract(link, r"^([^?#]*)", 1)
    link_rest = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, _merge_dots(link_path), link_rest))
        .when(F.startswith(link, F.lit("?")), F.concat(no_query, link))
        .when(F.startswith(link, F.lit("#")), F.concat(no_fragment, link))
        .otherwise(F.concat(root, _merge_dots(F.concat(folder, link_path)), link_rest))
    )


def without_fragment(url: Column) -> Column:
    """The URL of the resource itself: two URLs that differ in their fragment are one page."""
    return F.regexp_replace(url, r"#.*$", "")


def is_http(url: Column) -> Column:
    return url.rlike(r"^(?i)https?://[^/?#]")


def rewrite_root_links(body: Column, link: Column, faithful: bool = False) -> Column:
    """Make root-relative ``src`` and ``href`` values absolute.

    ``faithful`` keeps the plain string form: no scheme, the quote after ``src=``
    lost and ``//host`` touched as well. The default form corrects all three.
    """
    if faithful:
        netloc = site(link)
        with_src = F.replace(body, F.lit('src="/'), F.concat(F.lit("src="), netloc, F.lit("/")))
        return F.replace(with_src, F.lit('href="/'), F.concat(F.lit('href="'), netloc, F.lit("/")))
    root = F.regexp_extract(link, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    marked = F.regexp_replace(body, r'\b(src|href)="/(?!/)', '$1="\u0001/')
    return F.replace(marked, F.lit("\u0001"), root)
